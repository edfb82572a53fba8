"""Near-duplicates and repeated substrings against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash

from pyspark.sql import functions as F

from chronoloom.llm import simhash, substrings
from chronoloom.llm.components import connected_components


def words(rng, n, size=400):
    return [f"w{rng.randint(0, size)}" for _ in range(n)]


def corpus(seed=3):
    """Texts with copies, near copies, shared passages, odd ones."""
    rng = random.Random(seed)
    base = [words(rng, rng.choice([3, 20, 60, 200])) for _ in range(40)]
    shared = words(rng, 50)
    texts = []
    for k, w in enumerate(base):
        texts.append(" ".join(w))
        for _ in range(k % 4):
            near = list(w)
            near[rng.randrange(len(near))] = "Changed"
            texts.append(" ".join(near))
        if k % 3 == 0:
            texts.append(" ".join(words(rng, 10) + shared + words(rng, 12)))
        if k % 10 == 0:
            texts += [texts[0]] * 2
    texts += ["", None, " \n ", "one", "One", "x " * 300, "y\x00z\xa0 é " * 30, " ".join(words(rng, 30000))]
    return texts


def fingerprint(text, width):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in t.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if x]
    s = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] if len(w) >= width else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(fps, ids, reach):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= reach:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(fps)):
        if ids[i] is not None:
            least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least.get(find(i)) for i in range(len(fps))]


def test_near_duplicates(spark):
    texts = corpus()
    ids = list(range(len(texts)))
    random.Random(1).shuffle(ids)
    ids[5] = None
    ids[7] = ids[8]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in zip(ids, texts)], "doc_id long, text string, fp int, component_id int")
    fps = [fingerprint(t, 4) for t in texts]
    found = sorted((r["doc_id"] or -1, r["fp"] & (2**64 - 1), r["component_id"] or -1) for r in simhash.near_duplicates(docs).collect())
    assert found == sorted((i or -1, f, c or -1) for i, f, c in zip(ids, fps, roots(fps, ids, 4)))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_thinning_takes_five_words_and_four_fifths(spark):
    """Of texts whose five-word shingles overlap by 0.8 and whose fingerprints are within reach one stays; others all stay."""
    rng = random.Random(12)
    texts, groups = [], []
    for g in range(25):
        w = words(rng, 300, 5000)
        texts.append(" ".join(w))
        groups.append(g)
        for _ in range(g % 3):
            near = list(w)
            near[rng.randrange(300)] = "other"
            texts.append(" ".join(near))
            groups.append(g)
        half = w[:150] + words(rng, 150, 5000)
        texts.append(" ".join(half))
        groups.append(100 + g)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.keep_one(docs).collect()}
    assert kept == {groups.index(g) for g in set(groups)}


@pytest.mark.parametrize("block", [16, 1024])
def test_no_similar_pair_is_lost_behind_one_that_is_not(spark, monkeypatch, block):
    """Components of all links within reach and of the similarity, where many links within reach lack it."""
    monkeypatch.setattr(simhash.links_between, "__defaults__", (block,))
    rng = random.Random(31)
    texts = []
    for _ in range(3):
        w = words(rng, 300, 5000)
        for _ in range(50):
            near = list(w)
            for at in rng.sample(range(300), rng.randint(1, 14)):
                near[at] = f"e{rng.randint(0, 10**6)}"
            texts.append(" ".join(near))
    fps = [simhash.fingerprint(t.encode(), 2, True) for t in texts]
    fps[5:12] = fps[:7]  # different texts of one fingerprint
    given = [(i, hashlib.md5(t.encode()).hexdigest(), int(np.uint64(f).view(np.int64))) for i, (t, f) in enumerate(zip(texts, fps))]
    monkeypatch.setattr(simhash, "fingerprints", lambda *_: spark.createDataFrame(given, "doc_id long, mark string, fp long"))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(296)} for t in texts]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 4]
    good = [(i, j) for i, j in near if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert 0 < len(good) < len(near)
    root = list(range(len(texts)))
    for _ in range(len(texts)):
        for i, j in good:
            root[i] = root[j] = min(root[i], root[j])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = [(r["root"], r["least"]) for r in simhash.similar_texts(docs, 5, 4, 0.8).collect()]
    groups = {}
    for name, i in found:
        groups.setdefault(name, set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(i for i, r in enumerate(root) if r == g) for g in set(root))


def test_one_row_of_each_group_stays(spark):
    """Ids that repeat with the same and with another text, null ids, null and empty texts, extra columns, very long texts."""
    text, near, long = "a b c d e f g h " * 9, "a b c d e f g h " * 9 + "i", " ".join(words(random.Random(2), 20000, 10**6))
    rows = [(1, "zz yy", 0), (0, "zz yy", 1), (1, text, 2), (1, text, 3), (None, text, 4), (None, "only here", 5), (None, "only here", 6), (7, None, 7), (8, "", 8), (9, " ", 9), (2, near, 10), (11, long, 11), (12, long + " more", 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark int").withColumns({"row": F.lit("x"), "n": F.lit(1), "root": F.lit(2)})
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    found = sorted(r["mark"] for r in kept.collect())
    assert found in ([1, 2, 5, 7, 11], [1, 3, 5, 7, 11], [1, 2, 6, 7, 11], [1, 3, 6, 7, 11])
    assert simhash.keep_one(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n", [100, 10**8, 10**12])
@pytest.mark.parametrize("reach", [4, 10])
def test_masks_meet_every_pair_within_reach(n, reach):
    rng = random.Random(n)
    chosen = simhash.masks(n, reach)
    for _ in range(300):
        bits = sum(1 << b for b in rng.sample(range(64), reach))
        assert any(bits & m == 0 for m in chosen)


@pytest.mark.parametrize("block", [4, 64, 4096])
def test_links_connect_what_brute_force_connects(spark, block):
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 2**63, 12, dtype=np.uint64)
    fps = set(map(int, rng.integers(0, 2**63, 200, dtype=np.uint64))) | {0, 2**64 - 1}
    for c in centres.tolist():
        for _ in range(25):
            x = c
            for b in rng.integers(0, 64, rng.integers(0, 6)).tolist():
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    links = simhash.fingerprint_links(spark.createDataFrame([(s,) for s in signed], "fp long"), block=block).collect()
    assert all(bin((r["a"] ^ r["b"]) & (2**64 - 1)).count("1") <= 4 for r in links)
    found = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    expected = roots(fps, signed, 4)
    assert len({found.get(s, s) for s in signed}) == len(set(expected))
    groups = {}
    for s, e in zip(signed, expected):
        groups.setdefault(e, set()).add(found.get(s, s))
    assert all(len(g) == 1 for g in groups.values())


def test_gray_index_prunes_nothing_that_is_near():
    rng = np.random.default_rng(9)
    fps = np.unique(rng.integers(0, 2**10, 500, dtype=np.uint64) << np.uint64(30))
    index = simhash.GrayIndex(fps)
    found = {(int(fps[j]), int(index.fps[k])) for js, ks in index.links(fps, 4) for j, k in zip(js, ks)}
    assert found == {(int(a), int(b)) for a in fps for b in fps if bin(int(a) ^ int(b)).count("1") <= 4}


def test_components_of_long_paths(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 300), (5, 5)]
    found = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(61)}, 100: 100, 200: 100, 300: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_repeats(texts, length):
    docs = [(t or "").encode().split() for t in texts]
    seen = {}
    for w in docs:
        for i in range(len(w) - length + 1):
            key = tuple(w[i : i + length])
            seen[key] = seen.get(key, 0) + 1
    kept = []
    for w in docs:
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        kept.append([x for x, g in zip(w, gone) if not g])
    return docs, kept


@pytest.mark.parametrize("wide", [1, 256])
def test_substrings(spark, monkeypatch, wide):
    monkeypatch.setattr(substrings, "WIDE", wide)
    texts = corpus(4)
    rng = random.Random(8)
    line = words(rng, 36)
    texts += [" ".join(words(rng, 5) + line + words(rng, 40)) for _ in range(12)] + [" ".join(["same"] * 100), "\n".join(line + line)]
    ids = [None if k == 3 else k for k in range(len(texts))]
    docs = spark.createDataFrame([(i, t, "s", 7) for i, t in zip(ids, texts)], "doc_id long, text string, spans string, mark int")
    whole, kept = brute_repeats(texts, 35)
    found = sorted((r["doc_id"] or -1, r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.digests(docs).collect())
    assert found == sorted((i or -1, len(w), len(w) - len(k), hashlib.sha256(b" ".join(k)).hexdigest()) for i, w, k in zip(ids, whole, kept))
    cut = substrings.remove_repeats(docs)
    assert cut.columns == docs.columns
    expected = {i: (b" ".join(k).decode() if len(k) < len(w) else t) for i, t, w, k in zip(ids, texts, whole, kept)}
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == expected
    assert substrings.digests(docs.limit(0)).count() == 0


def test_repeated_rows_are_occurrences(spark):
    text = " ".join(f"u{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")
    assert [r["n_removed"] for r in substrings.digests(docs).collect()] == [40, 40]


@pytest.mark.parametrize("wide", [1, 256])
def test_words_said_again_and_again_make_few_rows(spark, monkeypatch, wide):
    monkeypatch.setattr(substrings, "WIDE", wide)
    rng = random.Random(5)
    cycles = [["same"], ["very", "hot"], ["a", "b", "a"], words(rng, 28), words(rng, 40)]
    texts = [" ".join(words(rng, 9) + cycle * (n // len(cycle)) + cycle[: n % len(cycle)] + words(rng, 9)) for cycle in cycles for n in (34, 36, 71, 3000)]
    for text in texts:
        _, content, first, size, times = substrings.regions(text.encode())
        assert len(content) < 500 and (first + size * times).tolist() == [*first[1:], len(text.split()) - 34]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole, kept = brute_repeats(texts, 35)
    assert {r["doc_id"]: r["text"] for r in substrings.remove_repeats(docs).collect()} == {i: (b" ".join(k).decode() if len(k) < len(w) else t) for i, (t, w, k) in enumerate(zip(texts, whole, kept))}
    assert sorted((r["n_words"], r["n_removed"]) for r in substrings.digests(docs).collect()) == sorted((len(w), len(w) - len(k)) for w, k in zip(whole, kept))


def test_automaton_counts_occurrences():
    rng = random.Random(6)
    sequences = [[rng.choice("abc") for _ in range(rng.randint(1, 12))] for _ in range(12)]
    weights = [rng.randint(1, 3) for _ in sequences]
    automaton = substrings.SuffixAutomaton(sequences, weights)

    def times(part):
        return sum(w * sum(s[i : i + len(part)] == part for i in range(len(s) - len(part) + 1)) for s, w in zip(sequences, weights))

    for k, s in enumerate(sequences):
        for end, got in enumerate(automaton.matching(k)):
            assert got == max((n for n in range(1, end + 2) if times(s[end + 1 - n : end + 1]) >= 2), default=0)
