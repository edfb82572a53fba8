"""Classifiers: the identities they rest on, and accuracy on rows they did not learn from."""

import random
import tracemalloc
import zlib

import numpy as np
import pytest

from chronoloom.llm import quality, toxicity
from chronoloom.llm.common import read_table

SF = "/root/testdata/sf0.1"


def labelled(n=160, seed=1):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [f"w{rng.randint(0, 60)}" for _ in range(rng.randint(5, 40))]
        bad = i % 4 == 0
        if bad:
            words[rng.randrange(len(words))] = rng.choice(["Nasty", "vile,", "VILE"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return rows, labels


def test_pair_sum_identity():
    rng = np.random.default_rng(0)
    model = quality.FactorisationMachine(50, 4)
    model.linear, model.factors, model.bias = rng.normal(size=50), rng.normal(size=(50, 4)), 0.3
    places, values = np.array([1, 5, 9, 33]), rng.normal(size=4)
    pairs = sum(model.factors[a] @ model.factors[b] * x * y for i, (a, x) in enumerate(zip(places, values)) for b, y in list(zip(places, values))[i + 1 :])
    assert model.margin(places, values) == pytest.approx(0.3 + values @ model.linear[places] + pairs)


def test_odd_texts_have_scores(spark):
    docs = spark.createDataFrame([(1, None, 5.0), (2, "", 1.0), (None, "word", 1.0), (2, "x" * 100000, 1.0)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, label int")
    model = quality.train(docs, none)
    assert all(0 <= r["score"] <= 1 for r in quality.score_documents(docs, model).collect())
    index = toxicity.train(docs, none)
    assert [r["score"] for r in toxicity.score_documents(docs, index).collect()] == [0.5] * 4
    assert quality.keep_good(docs, model).columns == docs.columns
    odd = spark.createDataFrame([(1, None), (None, 1), (2, 7), (2, 1), (2, 0)], "doc_id long, label int")
    assert quality.train(docs, odd) and toxicity.train(docs, odd)
    assert quality.score_documents(docs.limit(0), model).count() == toxicity.score_documents(docs.limit(0), index).count() == 0


def by_hand(docs, labels, k=toxicity.K):
    """Score and neighbours of every text in plain numpy: documents in one dense matrix, no blocks."""
    bags = {i: toxicity.Counter(toxicity._terms((t or "").lower())) for i, t in docs}
    first = {}
    for i, label in sorted(labels):  # equal texts with equal labels count once
        first.setdefault((dict(docs)[i] or "", label), i)
    ids = sorted(i for i in first.values() if bags[i])
    label = dict(labels)
    y = np.array([label[i] for i in ids], float)
    terms = sorted({t for i in ids for t in bags[i]})
    has = np.array([[t in bags[i] for t in terms] for i in ids], float)
    df = np.array([sum(t in b for b in bags.values()) for t in terms])
    phi = np.array([0 if len(set(x)) == 1 or len(set(y)) == 1 else abs(np.corrcoef(x, y)[0, 1]) for x in has.T])
    scale = (np.log((1 + len(docs)) / (1 + df)) + 1) * (toxicity.FLOOR + phi)

    def vector(bag):
        w = np.array([1 + np.log(bag[t]) if bag[t] else 0 for t in terms]) * scale
        return w / max(np.sqrt(w @ w), 1e-300)

    examples = np.array([vector(bags[i]) for i in ids])

    def nearest(v, without=None):
        cosines = sorted((-round(float(c), 12), i, n) for n, (c, i) in enumerate(zip(examples @ v, ids)) if n != without)
        return [(-c, i, n) for c, i, n in cosines[:k] if c < 0]

    def step(near):
        if not near:
            return toxicity.STEPS + 1
        w = [1 / (max(0.0, 1 - c) + toxicity.SOFT) for c, _, _ in near]
        return int(round(toxicity.STEPS * sum(x for x, (_, _, n) in zip(w, near) if y[n]) / sum(w)))

    calibration = toxicity.rising([step(nearest(v, n)) for n, v in enumerate(examples)], y, y)
    found = {i: nearest(vector(b)) for i, b in bags.items()}
    return {i: (calibration[step(near)], [x[1] for x in near], [x[0] for x in near]) for i, near in found.items()}


def lettered(rows):
    return [(i, t and "".join(chr(ord(c) + 49) if c.isdigit() else c for c in t)) for i, t in rows]  # terms are letters


@pytest.mark.parametrize("marked", [True, False])
def test_scores_and_evidence_are_brute_force(spark, marked):
    rows, labels = labelled()
    if not marked:
        labels = [(i, 0) for i, _ in labels]
    rows += [(500, rows[3][1]), (501, rows[4][1])]
    labels += [(500, labels[3][1]), (501, labels[4][1])]
    extra = [(1000 + i, t + " w1 w2") for i, t in rows[1:60:2]] + [(2000, "zz unseen"), (2001, None), (2002, "w1 w2 w3"), (2003, "vile " * 3000), (2004, "12 34")]
    rows = lettered(rows + extra)
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, label int"))
    expected = by_hand(rows, labels)
    got = toxicity.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), model, evidence=toxicity.K).collect()
    assert len(got) == len(rows)
    for r in got:
        score, ids, cosines = expected[r["doc_id"]]
        assert [e["doc_id"] for e in r["evidence"]] == ids, r["doc_id"]
        assert np.allclose([e["cosine"] for e in r["evidence"]], cosines) and r["score"] == pytest.approx(score)


def test_blocks_are_left_out_and_no_neighbour_is_lost():
    rng = np.random.default_rng(5)
    size, terms = 900, 60
    group = rng.integers(0, 6, size)  # groups of texts have words of their own, and rare ones beside
    bags = [sorted({*(g * 8 + rng.integers(0, 8, 5)).tolist(), *rng.integers(48, terms, 2).tolist()}) for g in group]
    ends = np.concatenate([[0], np.cumsum([len(b) for b in bags])])
    codes, labels = np.concatenate(bags), (group == 0).astype(float)
    row, counts, scale = np.repeat(np.arange(size), np.diff(ends)), rng.integers(1, 9, len(codes)), rng.random(terms) + 0.1
    order = toxicity.clustered(row, codes, counts, scale, labels)
    assert sorted(order.tolist()) == list(range(size))
    moved = np.concatenate([[0], np.cumsum(np.diff(ends)[order])])
    where = np.concatenate([np.arange(ends[d], ends[d + 1]) for d in order])
    index = toxicity.BlockMaxIndex({str(t): t for t in range(terms)}, scale, moved, codes[where], counts[where], order, labels[order])
    dense = np.zeros((size, terms))
    for d in range(size):
        at, w = index.example(d)
        dense[d, at] = w
    queries = [index.example(d) for d in range(0, size, 5)]
    for (at, w), (docs, cosines) in zip(queries, index.nearest(queries, 7)):
        all_cosines = np.round(dense[:, at] @ w, 12)
        expected = [d for d in np.lexsort((index.ids, -all_cosines)).tolist()[:7] if all_cosines[d] > 0]
        assert docs.tolist() == expected and np.allclose(cosines, all_cosines[expected])
    assert index.visited < 0.5 * index.met


def test_training_keeps_within_its_terms(spark):
    rows, labels = labelled()
    docs, marks = spark.createDataFrame(lettered(rows), "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, label int")
    model = toxicity.train(docs, marks, most_terms=500)
    assert 400 < len(model.index.codes) <= 500 and toxicity.train(docs, marks, most_terms=0).sent is None
    assert toxicity.train(docs, marks, limit=40).index.size == 40


def held_out(spark, query, column, modulus, value):
    truth = {r["doc_id"]: r[column] for r in read_table(spark, SF, "labels").collect()}
    rows = query(spark, SF).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == value) and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    return [(truth[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in truth]


def test_quality_held_out(spark):
    pairs = held_out(spark, quality.op3_quality_classifier, "quality", 3, 1)
    assert sum(a == b for a, b in pairs) / len(pairs) > 0.98


def test_toxicity_held_out(spark):
    pairs = held_out(spark, toxicity.op2_toxicity_neighbours, "toxic", 5, 0)
    assert sum(a == b for a, b in pairs) / len(pairs) > 0.97
    assert sum(a == b == 1 for a, b in pairs) / sum(a for a, _ in pairs) > 0.85


def test_training_rows_stay_small_in_the_driver(spark):
    """300 texts of some 2,700 features take the driver 8 bytes for each, not an object."""
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 1 << 20, 3000)), i % 2) for i in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, text string, label int").repartition(3).localCheckpoint()
    rows.clear()
    tracemalloc.start()
    quality.train(table.select("doc_id", "text"), table.select("doc_id", "label"))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 14e6
