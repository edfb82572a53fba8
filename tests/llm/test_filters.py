"""Decontamination, URL filter, rollups and top-k against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.llm import decontaminate, rollup, topk, urls
from chronoloom.llm.common import read_table

ITEM = "A train left Paris at 9 and went 120 km to Lyon while another train waited there for its first guests."
PARTS = [(1, ITEM), (2, "the quick brown fox jumps over the lazy dog near the river bank at dawn"), (3, "short items count too here"), (4, ""), (5, None), (6, "?? !!"), (7, "Then Anna gave Bob 5 apples and later that day Bob gave Anna 3 pears back after lunch")]


def leaks(spark, docs, items=PARTS):
    found = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string, hits int"), spark.createDataFrame(items, "item_id long, text string"))
    return {(r["doc_id"], r["item_id"]): r["verbatim"] for r in found.collect()}


def test_leaks(spark):
    other = ITEM.replace("Paris", "Berlin").replace("Lyon", "Bonn").replace("120", "95").replace(" 9 ", " 7 ")
    mixed = "It said: " + ITEM + " Later " + ITEM.replace("Paris", "Berlin")
    filler = "something else stood before it and after it "
    docs = [(1, filler + ITEM + " " + filler), (2, filler + other), (3, mixed), (4, filler * 50), (5, None), (6, ""), (7, "THE QUICK, BROWN FOX JUMPS -- OVER THE LAZY DOG NEAR THE RIVER BANK AT DAWN!"), (8, "the quick brown fox"), (9, "well, short items count too here."), (None, filler + ITEM), (10, (filler + "the quick brown fox jumps over the lazy dog near the river bank at dawn ") * 300), (7, "x"), (11, "Then Carl gave Dora 6 apples and later that day Dora gave Carl 2 pears back after lunch"), (12, "Then Carl gave Dora 6 apples and later that day Emil gave Fred 2 pears back after lunch")]
    rows = [(i, t, 0) for i, t in docs]
    assert leaks(spark, rows) == {(1, 1): True, (2, 1): False, (3, 1): True, (11, 7): False, (None, 1): True, (7, 2): True, (9, 3): True, (10, 2): True}
    assert leaks(spark, rows[:0]) == {}
    assert leaks(spark, rows, []) == {}
    table = spark.createDataFrame(rows, "doc_id long, text string, hits int")
    kept = decontaminate.without_leaks(table, spark.createDataFrame(PARTS, "item_id long, text string"))
    assert kept.columns == table.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 4, 5, 6, 8, 12]


def test_each_occurrence_is_judged_by_itself(spark):
    """A worksheet of two versions, one version with stray windows of other values, and versions with a word put in."""
    first = ITEM.replace("Paris", "Berlin").replace("Lyon", "Bonn").replace("120", "95")
    second = ITEM.replace("Paris", "Rome").replace("Lyon", "Pisa").replace("120", "380")
    stray = " ".join(ITEM.replace("Paris", "Oslo").split()[:9])
    inside = [x.replace("while another", "while yet another") for x in (first, second)]
    docs = [(1, f"He said: {first} More of it: {second}", 0), (2, f"He said: {stray} and then much later on: {first}", 0), (3, f"He said: {first} and so on {stray}", 0), (4, f"He said: {inside[0]} More of it: {inside[1]}", 0), (None, "So: " + first, 0), (None, "So: " + second, 0), (5, stray, 0)]
    assert leaks(spark, docs) == {(1, 1): False, (2, 1): False, (3, 1): False, (4, 1): False, (None, 1): False}


def test_names_at_the_beginning_of_sentences(spark):
    items = [(1, "Tom has 5 apples. Tom buys 3 more. How many apples does Tom have?"), (2, "Which river flows through Paris?")]
    docs = [(1, "Ann has 9 apples. Ann buys 4 more. How many apples does Ann have?", 0), (2, "He asked 'Which river flows through Paris?'", 0), (3, "Ann has 9 apples. Bob buys 4 more. How many apples does Carl have?", 0)]
    assert leaks(spark, docs, items) == {(1, 1): False, (2, 2): True}


def test_items_poor_in_literals_are_found_as_they_are(spark):
    items = [(1, "What is 12 + 7?"), (2, "What is 345 * 12 - 7?"), (3, "12 + 7 = 19"), (4, "Anna, Bob, Carl, Dora, Emil, Fred, Gus, Hans, Ida"), (5, "in 1815")]
    docs = [(k, f"so it said: {t} and no more", 0) for k, t in items] + [(6, "so it said: What is 13 + 8? and 13 + 8 = 21", 0)]
    found = leaks(spark, docs, items)
    assert {(k, k): True for k, _ in items}.items() <= found.items()
    assert not any(k == 6 for k, _ in found)


def test_items_without_an_id_and_two_texts_under_one(spark):
    """A text that stands verbatim is found whatever its id; what the two texts of an id match doesn't add up."""
    text = lambda k: " ".join(f"word{k}x{i}" for i in range(30))
    items = spark.createDataFrame([(None, text(1)), (5, text(2)), (5, text(3)), (5, text(3)), (6, None)], "item_id long, text string")
    docs = [(1, "before " + text(1) + " after"), (2, text(2)), (3, "in " + text(3)), (4, " ".join(text(2).split()[:14])), (5, text(2) + " and " + text(3)), (6, "clean words"), (7, None)]
    table = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, n int, item string")
    found = sorted(((r["doc_id"], r["item_id"]) for r in decontaminate.leaks(table, items).collect()), key=repr)
    assert found == sorted([(1, None), (2, 5), (3, 5), (5, 5), (5, 5)], key=repr)
    kept = decontaminate.without_leaks(table, items)
    assert kept.columns == table.columns and sorted(r["doc_id"] for r in kept.collect()) == [4, 6, 7]


def test_decontamination_is_brute_force(spark):
    """On texts without slots, items are found where half of their 8-word windows are."""
    sf = "/root/testdata/sf0.01"

    def tokens(text):
        return [w for w in (re.sub(r"^\W+|\W+$", "", x).lower() for x in (text or "").split()) if w]

    places = {}
    items = {r["item_id"]: tokens(r["text"]) for r in read_table(spark, sf, "benchmark").collect()}
    for k, t in items.items():
        for i in range(len(t) - 7):
            places.setdefault(tuple(t[i : i + 8]), set()).add((k, i))
    hits = {}
    for r in read_table(spark, sf, "documents").collect():
        t = tokens(r["text"])
        for i in range(len(t) - 7):
            for k, j in places.get(tuple(t[i : i + 8]), ()):
                hits.setdefault((r["doc_id"], k), set()).add(j)
    expected = {x for x, js in hits.items() if len(js) >= 0.5 * (len(items[x[1]]) - 7)}
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.op7_decontamination(spark, sf).collect()} == expected


def test_the_screen_loses_no_match(spark, monkeypatch):
    """Items of all widths, with literal words next to each other and apart, in documents as they are and changed."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["Anna", "Bob", "12", "7", "km"] * 6
    items = [(k, " ".join(rng.choices(words, k=rng.randint(1, 14)))) for k in range(60)]
    docs = [(k, " ".join(rng.choices(words, k=9)) + " " + t.replace("12", "15").replace("Bob", "Carl" if k % 2 else "Bob") + " " + " ".join(rng.choices(words, k=20)), 0) for k, t in items]
    found = leaks(spark, docs, items)
    monkeypatch.setattr(decontaminate, "screen", lambda *_: F.lit(True))
    assert found == leaks(spark, docs, items)
    assert len(found) > 30


def judged(url, rules):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


URLS = [None, "", "no scheme", "http://A.Net/x", "http://net/", "http://net", "https://m.example.net/en/1?q", "x://example.com/de/", "x://example.com/de", "a://b://c.net/", "http://org/fr/2#t", "http://sub.org/fr/", "http://xorg/fr/", "http://u@h.net:80/p", "http:///p", "http://é.net/ü"]


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "r", "h") for i, u in enumerate(URLS + URLS[:4])], "page_id long, url string, rule string, host string")
    found = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(pages, urls.RULES).collect()}
    assert found == {i: judged(u, urls.RULES) for i, u in enumerate(URLS + URLS[:4])}
    assert urls.judge(pages.limit(0), urls.RULES).count() == 0


def test_cascade_is_exact_with_many_false_positives(spark, monkeypatch):
    monkeypatch.setattr(urls, "BITS", 2)
    monkeypatch.setattr(urls, "PROBES", 1)
    universe = spark.range(20000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    listed = universe.where("hash(key) % 7 = 0")
    cascade = urls.BloomCascade.build(listed, universe)
    assert len(cascade.levels) > 3
    assert universe.where(cascade.contains(F.col("key")) != (F.hash("key") % 7 == 0)).count() == 0


def test_rollup(spark, tmp_path):
    ledger = rollup.TokenLedger(spark, f"file://{tmp_path}/l")
    assert ledger.totals().count() == 0
    rows = [(i, "hot" if i % 3 else f"s{i % 4}", None if i % 5 == 0 else "en", "word " * (i % 9)) for i in range(200)]
    docs = spark.createDataFrame(rows + [(None, None, None, None)], "doc_id long, source string, lang string, text string")
    first = rollup.inserts(docs, "words-1", rollup.count_words(F.col("text")))
    ledger.commit(1, first)
    ledger.commit(1, first)
    gone = ledger.rows(1).where("doc_id < 50")
    for _ in range(3):
        ledger.commit(2, rollup.negated(gone))
    ledger.commit(3, first.limit(0))
    expected = {}
    for i, s, lang, t in [*rows[50:], (None, None, None, "")]:
        n, k = expected.get((s, lang), (0, 0))
        expected[s, lang] = n + 1, k + len(t.split())

    def totals():
        return {(r["source"], r["lang"]): (r["n_docs"], r["n_tokens"]) for r in ledger.totals().collect()}

    assert totals() == expected
    assert ledger.current().count() == 151
    # a crash before a batch is published, new or again, changes nothing; the retry counts once
    ledger.stage(rollup.negated(first))
    assert totals() == expected
    name = ledger.stage(rollup.negated(gone))
    assert totals() == expected
    ledger.publish(2, name)
    assert totals() == expected and len(ledger.published()) == 3


def test_rollup_query_is_its_sql(spark, tmp_path, monkeypatch):
    """Repeated ids, copies under one id and under many, null texts and ids, and no rows at all."""
    import duckdb

    from chronoloom.llm import common

    monkeypatch.setattr(common, "HEAVY", 4)  # the copied text and the empty one are heavy
    long = "x" * 41 + " a, b"
    rows = [(0, "aa bb", "s", "en"), (1, "aa bb", "s", "en"), (1, "zz", "s", "en"), (1, "zz", "s", "en"), (2, long, None, "en"), (3, long, "s", None), (None, long, "s", "en"), (None, "only here", "s", "en"), (None, "only here", "s", "en"), (4, None, "s", "en"), (5, None, "s", "en"), (6, "", "s", "en"), (7, "", "s", "en"), (8, "é ü-ö " * 2000, "t", "de")]
    rows += [(k, "the same for all", "hot", "en") for k in range(20, 60)]
    names = "doc_id long, text string, source string, lang string"
    for k, part in enumerate((rows, [])):
        spark.createDataFrame(part, names).write.parquet(f"{tmp_path}/{k}/documents.parquet")
        found = sorted(map(str, map(tuple, rollup.op8_token_rollup(spark, f"{tmp_path}/{k}").select("source", "lang", "version", "n_docs", "n_tokens").collect())))
        with duckdb.connect() as db:
            db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/{k}/documents.parquet/*.parquet')")
            assert found == sorted(map(str, db.execute(rollup.OP8_SQL).fetchall()))


def brute_topk(rows, k=10, scale=1024):
    good = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in good:
        if q % 100 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q and len(b) == len(a))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("bucket", [7, 2048])
def test_topk(spark, monkeypatch, bucket):
    monkeypatch.setattr(topk, "BUCKET", bucket)
    monkeypatch.setattr(topk, "BLOCK", 24)
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=8) * 10 ** rng.uniform(-3, 1)).astype(np.float32).tolist()) for i in range(600)]
    rows += [(600, rows[0][1]), (700, rows[1][1]), (701, rows[1][1]), (702, None), (703, [None] * 8), (800, [float("nan")] * 8), (801, [float("inf")] * 8), (900, [0.0] * 8), (1000, [1.0, 2.0]), (1001, [3.0, 4.0]), (None, rows[5][1]), (300, rows[9][1]), (300, rows[300][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = sorted(tuple(r) for r in topk.search_all(table, table.where("vec_id % 100 = 0")).collect())
    assert found == brute_topk(rows)
    assert topk.search_all(table.limit(0), table.limit(0)).count() == 0


def test_topk_of_large_numbers(spark):
    rows = [(i, [float(10**4 * (i + 1)), float(-3 * i), 0.5]) for i in range(30)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in topk.search_all(table, table.where("vec_id % 100 = 0")).collect()) == brute_topk(rows)


@pytest.mark.parametrize("spread,most", [(1.0, 0.2), (0.0, 1.0)])
def test_topk_prunes_vectors_of_spread_lengths(spread, most):
    """With the floor of the longest vectors most parts of the table are never multiplied; vectors of one length are."""
    rng = np.random.default_rng(3)
    x = np.floor(1024 * rng.normal(size=(30000, 16)) * np.exp(spread * rng.normal(size=(30000, 1))))
    order = np.argsort(-np.einsum("ij,ij->i", x, x), kind="stable")
    x, ids = x[order], np.arange(30000)
    verified = 0
    for q in x[::3000]:
        floor = float(topk.search(topk.buckets_of(ids[:2048], x[:2048]), -1, q, 10)[1][-1])
        found = []
        for s in range(0, 30000, 5000):  # parts as they lie on executors
            buckets = topk.buckets_of(ids[s : s + 5000], x[s : s + 5000])
            found += [(int(-v), int(i)) for i, v in zip(*topk.search(buckets, -1, q, 10, floor))]
            verified += sum(b.verified for b in buckets)
        scores = x @ q
        assert sorted(found)[:10] == [(int(-scores[i]), int(i)) for i in np.lexsort((ids, -scores))[:10]]
    assert verified / (10 * 30000) <= most


def test_columns_of_any_name_stay(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x", 5, "k", "old"), (2, None, 6, None, None)], "page_id long, url string, __keys int, `row` string, verdict string")
    found = urls.judge(pages, urls.RULES)
    assert found.columns == ["page_id", "url", "__keys", "row", "verdict", "host", "path", "rule"]
    assert [tuple(r) for r in found.orderBy("page_id").collect()] == [(1, "http://a.net/x", 5, "k", "block", "a.net", "/x", "net/"), (2, None, 6, None, "allow", "", "", None)]
