"""SetSketch near-duplicates, phrase collocations and whitening against brute force."""

import random
import re
import tracemalloc
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from chronoloom.llm import collocations, setsketch, whitening
from chronoloom.llm.common import small_batches


def texts(seed=5):
    """Texts with copies, near copies above and below the wanted similarity, chains of near copies, odd ones."""
    rng = random.Random(seed)
    found = []
    for k in range(30):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([3, 12, 60, 200]))]
        found.append(" ".join(base))
        for step in range(k % 5):
            base = list(base)
            for _ in range(1 + step % 3):
                base[rng.randrange(len(base))] = f"n{rng.randrange(3000)}"
            found.append(" ".join(base))
        if k % 6 == 0:
            found += [" ".join(base).upper(), " ".join(base) + " "]
    return found + ["", None, " \n ", "one", "One", "one two three", "y\x00z\xa0 é " * 30, "x " * 300, " ".join(f"w{rng.randrange(9)}" for _ in range(40000))]


def shingle_set(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))} if words else set()


def components(sets, ids):
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(sets)):
        if ids[i] is not None:
            least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least.get(find(i)) for i in range(len(sets))]


@pytest.mark.parametrize("block", [1024, 3])
def test_near_duplicates_by_registers(spark, block):
    own = texts()
    ids = [1000 - 3 * i for i in range(len(own))]
    ids[4] = ids[5]  # a doc_id that repeats with another text
    ids[7] = None
    rows = [(i, t, "e", 1) for i, t in zip(ids, own)] + [(ids[0], own[0], "again", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, size int")
    sets = [shingle_set(t) for _, t, *_ in rows]
    expected = sorted(zip([r[0] for r in rows], map(len, sets), components(sets, [r[0] for r in rows])), key=repr)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in setsketch.near_duplicates(docs, block=block).collect()), key=repr) == expected
    assert setsketch.near_duplicates(docs.limit(0)).count() == 0


def test_links_that_the_smallest_hides(spark):
    """Texts of one bucket whose smallest lacks the similarity to some that are near each other."""
    rng = random.Random(1)
    base = [f"w{i}" for i in range(100)]
    own = []
    for group in range(6):  # groups about 0.7 from each other, near copies within
        changed = list(base)
        for at in rng.sample(range(100), 5):
            changed[at] = f"g{group}.{at}"
        for copy in range(5):
            near = list(changed)
            near[(7 * copy + group) % 100] = f"c{group}.{copy}"
            own.append(" ".join(near))
    docs = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string")
    expected = components([shingle_set(t) for t in own], list(range(len(own))))
    for block in (1024, 4):
        assert [r["component_id"] for r in setsketch.near_duplicates(docs, block=block).orderBy("doc_id").collect()] == expected


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(3)
    for shared, only_a, only_b in ((800, 100, 100), (300, 500, 200), (0, 400, 400), (50, 5, 0), (1000, 0, 0)):
        estimates = []
        for _ in range(30):
            h = rng.integers(0, 1 << 63, shared + only_a + only_b, dtype=np.uint64)
            a, b = h[: shared + only_a], np.concatenate([h[:shared], h[shared + only_a :]])
            s = setsketch.sketches(np.concatenate([a, b, h]), np.array([len(a), len(b), len(h)]))
            assert (setsketch.merged(s[0], s[1]) == s[2]).all()
            larger, smaller = (s[0] > s[1]).sum(), (s[0] < s[1]).sum()
            estimates.append(setsketch.estimate(np.array([larger]), np.array([smaller]), setsketch.M, np.array([float(len(a))]), np.array([float(len(b))]))[0])
        true = shared / (shared + only_a + only_b)
        assert np.mean(estimates) == pytest.approx(true, abs=0.03)
        assert np.std(estimates) <= 1.3 * (true * (1 - true) / setsketch.M) ** 0.5 + 0.005


def test_sketch_is_the_one_of_all_values():
    """Stopping early leaves every register as it would be."""
    rng = np.random.default_rng(4)
    h = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    whole = setsketch.sketches(h, np.array([500]))[0]
    each = setsketch.sketches(h, np.ones(500, int)).max(axis=0)
    assert (whole == each).all()


def phrases(rows, longest, least, subsumed, top):
    counts, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    key = lang, tuple(words[i : i + k])
                    counts[key] = counts.get(key, 0) + 1
    found = {}
    candidates = {key: a for key, a in counts.items() if len(key[1]) > 1 and a >= least}
    hidden = {}
    for (lang, w), f in candidates.items():
        for size in range(2, len(w)):
            for i in range(len(w) - size + 1):
                hidden[lang, w[i : i + size]] = max(f, hidden.get((lang, w[i : i + size]), 0))
    for (lang, w), a in candidates.items():
        score, k = min((1000000 * a * a // (counts[lang, w[:k]] * counts[lang, w[k:]]), k) for k in range(1, len(w)))
        if 100 * hidden.get((lang, w), 0) < subsumed * a or (lang, w) not in hidden:
            found.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), counts[lang, w[:k]], counts[lang, w[k:]]))
    return [(lang, rank, p.decode(), -a, l, r, n[lang], -s) for lang, own in found.items() for rank, (s, a, p, l, r) in enumerate(sorted(own)[:top], 1)]


@pytest.mark.parametrize("longest, least, top", [(3, 3, 2000), (2, 2, 7), (5, 2, 2000)])
def test_collocations(spark, longest, least, top, monkeypatch):
    rng = random.Random(6)
    words = ["a", "B", "c", "New", "york", "city", "x\x00", "é", "日本"]
    rows = [(rng.choice(["en", "fr", None, "und"]), "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", ","]) for _ in range(rng.randint(0, 60)))) for _ in range(120)]
    rows += [("en", None), ("en", ""), ("de", " .,\n"), ("en", "New York City " * 3000), ("en", "..new york..")] + rows[:5]
    monkeypatch.setattr(collocations, "SHARD", 300)
    docs = spark.createDataFrame([(lang, text, "n", 1) for lang, text in rows], "lang string, text string, phrase string, n int").repartition(3)
    found = collocations.collocations(docs, longest, least, 50, top)
    assert sorted(map(tuple, found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())) == sorted(phrases(rows, longest, least, 50, top))
    assert collocations.collocations(docs.limit(0)).count() == 0


def test_shards_come_to_workers_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(collocations, "PIECE", 64)
    docs = spark.createDataFrame([("en", "a b. c " * 500), ("fr", ""), ("en", "d e f " * 200), ("de", "é 日本 " * 40)], "lang string, text string").coalesce(1)
    stored = collocations.settle(collocations.shards(docs, 700), "shards")
    hashes = stored.selectExpr("shard", "cast(concat('12345678', lpad(shard, 8, '0')) as binary) hashes")
    rows = collocations._pieces(stored, hashes).collect()
    assert max(len(r["data"]) for r in rows) <= 64 < stored.selectExpr("max(length(tokens))").first()[0]
    for r in stored.collect():
        own = [x for x in rows if x["shard"] == r["shard"]]
        kinds = [b"".join(x["data"] for x in own if x["kind"] == kind) for kind in range(3)]
        assert kinds == [r["words"], r["tokens"], b"12345678%08d" % r["shard"]] and [x["at"] for x in own] == sorted(x["at"] for x in own)


def test_a_task_holds_little_beside_its_shard(spark, monkeypatch):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own, seen = spark.conf.get(name), {}
    stored = collocations.settle

    def settle(df, tag, *group):
        seen.setdefault(tag, int(df.sparkSession.conf.get(name)))
        table = stored(df, tag, *group)
        if tag == "shards":
            files = [pq.ParquetFile(f.removeprefix("file://")) for f in table.inputFiles()]
            seen["group"] = max(f.metadata.row_group(k).num_rows for f in files for k in range(f.metadata.num_row_groups))
        return table

    monkeypatch.setattr(collocations, "settle", settle)
    monkeypatch.setattr(collocations, "shards", lambda docs, cut=collocations.shards: cut(docs, 20))
    monkeypatch.setattr(collocations, "CHUNK", 50)
    docs = spark.createDataFrame([("en", f"a b c{i} d e ") for i in range(300)], "lang string, text string").coalesce(1)
    counts, _ = collocations.phrase_counts(docs)
    assert {(r["phrase"], r["f"]) for r in counts.collect()} == {("a", 300), ("b", 300), ("d", 300), ("e", 300), ("a b", 300), ("d e", 300)}
    assert all(seen[tag] * collocations.PIECE <= 1 << 20 for tag in ("shards", "frequent", "phrases")) and 1 <= seen["group"] <= 4
    assert spark.conf.get(name) == own
    with small_batches(spark, 64):
        sizes = spark.range(0, 1000, 1, 1).mapInArrow(lambda batches: (pa.record_batch([pa.array([b.num_rows])], ["n"]) for b in batches), "n long").collect()
    assert [r["n"] for r in sizes] == [64] * 15 + [40]


def test_looking_up_hashes_takes_little_memory():
    rng = np.random.default_rng(4)
    words = [b"w%d" % i for i in range(5000)]
    tokens = rng.integers(1, 5001, 600_000).astype(np.int32)
    shard = collocations._Shard("en", words, tokens.tobytes(), None)
    ends = shard.ends(2)
    shard.frequent = np.sort(np.unique(shard.hashes(ends[::3], 2)))
    expected = np.isin(shard.hashes(ends, 2), shard.frequent)
    tracemalloc.start()
    found = shard.chosen(ends, 2)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(found, expected) and most < 8_000_000
    shard.frequent = shard.frequent[:0]
    assert not shard.chosen(ends, 2).any()


def test_automaton_counts_every_phrase():
    rng = np.random.default_rng(2)
    for vocabulary, depth in ((3, 4), (40, 3), (1 << 30, 3)):
        tokens = rng.integers(0, min(vocabulary, 60) + 1, 500) * (vocabulary // min(vocabulary, 60))
        automaton = collocations.Automaton(tokens, depth)
        for size in range(1, depth + 1):
            expected = Counter(tuple(w) for i in range(len(tokens) - size + 1) if (w := tokens[i : i + size].tolist()) and 0 not in w)
            ends, counts = automaton.phrases(size)
            assert {tuple(tokens[e - size + 1 : e + 1].tolist()): c for e, c in zip(ends, counts.tolist())} == expected
        # a link leads to a shorter phrase that ends at more places
        state = np.nonzero(automaton.link > 0)[0]
        up = automaton.link[state]
        assert (automaton.length[up] < automaton.length[state]).all() and (automaton.count[up] > automaton.count[state]).all()


def test_collocations_against_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM read_parquet('/root/testdata/sf0.001/documents.parquet')")
    expected = con.execute("SELECT lang, rank, phrase, a, l, r, n, score FROM (" + collocations.OP13_SQL + ")").fetchall()
    found = collocations.op13_collocations(spark, "/root/testdata/sf0.001").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert sorted(map(tuple, found.collect())) == sorted(expected)


def test_limbs_and_products_are_exact():
    rng = np.random.default_rng(0)
    for high in (1, 1 << 15, 1 << 16, 1 << 31, 1 << 60):
        x = rng.integers(-high, high, (50, 4), endpoint=True)
        parts = whitening.limbs(x)
        assert all(np.abs(p).max() <= 1 << 15 for p in parts)
        assert (sum(p.astype(np.int64).astype(object) << (16 * k) for k, p in enumerate(parts)) == x.astype(object)).all()
        exact = x.astype(object).T @ x.astype(object)
        assert (sum(g * (1 << power) for power, g in whitening.gram(x).items()) == exact).all()


def test_small_eigenvalues_beside_large_ones():
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.normal(size=(6, 6)))[0].astype(np.longdouble)
    e = np.array([1e12, 3e6, 2e3, 1.0, 1e-1, 1e-2], np.longdouble)
    values, axes = whitening.eigen((q * e) @ q.T)
    assert np.allclose((values / e).astype(float), 1, atol=1e-4)
    assert np.abs(axes.T @ axes - np.eye(6)).max() < 1e-14


def test_whitening(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(60, 5)) @ rng.normal(size=(5, 5)) + 3
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(5, base[5].tolist()), (None, base[6].tolist()), (7, base[8].tolist())]
    odd = [(90, None), (91, [1.0, None, 2.0, 3.0, 4.0]), (92, [1.0, float("nan"), 0.0, 0.0, 0.0]), (93, [float("inf")] * 5), (94, []), (95, [1e300] * 5), (96, [1.0, 2.0]), (97, [3.0, 5.0]), (98, [2.0])]
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows + odd], "vec_id long, embedding array<double>, n int, x string").repartition(4)
    found = whitening.whiten(table, components=3).collect()
    x = [tuple(int(np.floor(64 * c)) + 1_000_000 for c in v) for _, v in rows]
    fit = sorted(set(x))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    v = np.array([[float(Fraction(sum(n * n * a[i] * a[j] for a in fit) - n * sums[i] * sums[j], n**3)) for j in range(5)] for i in range(5)])
    e, q = np.linalg.eigh(v)
    e, q = e[::-1], q[:, ::-1]
    five = [r for r in found if r["vec_id"] not in (96, 97)]
    assert len(five) == 3 * len(rows)
    got = {}
    for r in five:
        assert r["n"] == n and r["identity_error"] < 1e-9
        assert r["explained"] == pytest.approx(e[r["component"] - 1] / np.trace(v), rel=1e-9)
        got.setdefault((r["vec_id"], int(r["deviation"])), {}).setdefault(r["component"], []).append(r["whitened"])
    centre = np.array([float(Fraction(s, n)) for s in sums])
    signs = {}
    for (vec_id, _), own in zip(rows, x):
        y = [n * c - s for c, s in zip(own, sums)]
        mine = got[vec_id, sum(c * c for c in y)]
        for k in range(3):
            value = float((np.array(own) - centre) @ q[:, k] / e[k] ** 0.5)
            close = [g for g in mine[k + 1] if abs(abs(g) - abs(value)) < 1e-9]
            assert close
            if abs(value) > 1e-6:
                signs.setdefault(k, set()).add(np.sign(value * close[0]))
    assert all(len(s) == 1 for s in signs.values())
    # two vectors have one component with variance, one has none, and so have none at all
    assert sorted((r["vec_id"], r["component"], round(abs(r["whitened"]), 9)) for r in found if r["vec_id"] in (96, 97)) == [(96, 1, 1.0), (97, 1, 1.0)]
    assert whitening.whiten(table.limit(0)).count() == 0


def test_whitening_of_the_table(spark):
    found = whitening.op12_embedding_whitening(spark, "/root/testdata/sf0.001")
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").count()
    assert dict(found.dtypes)["deviation"] == "bigint" and found.count() == 16 * rows
    assert found.agg(F.max("identity_error")).first()[0] < 1e-4
