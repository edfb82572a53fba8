"""Operators against plain Python, on odd and random inputs."""

import random
import re

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronoloom.functions import text as X
from chronoloom.functions.stopwords import ENGLISH
from chronoloom.operators import communities as M
from chronoloom.operators import consensus as C
from chronoloom.operators import graph as G
from chronoloom.operators import knn as K
from chronoloom.operators import lineage as L
from chronoloom.operators import nullmodels as N
from chronoloom.operators import series as S
from chronoloom.operators import vectors as V
from chronoloom.sources import tables as D


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first()["y"]


@pytest.mark.parametrize(
    "title, expected",
    [("The Time Machine", "time machine"), ("A  Tale-of Two!", "tale of two"), ("The The", "the"), ("", ""), ("Les Misérables", "les mis rables"), (None, None)],
)
def test_norm_title(spark, title, expected):
    assert one(spark, title, X.norm_title(F.col("x"))) == expected


@pytest.mark.parametrize("name, expected", [("Verne, Jules", "jules"), ("Homer", "homer"), ("", ""), (" , ", ""), ("Mary  Shelley ", "shelley")])
def test_surname(spark, name, expected):
    assert one(spark, name, X.surname(F.col("x"))) == expected


@pytest.mark.parametrize("text, expected", [("September 1st 2004", 2004), ("c. 380 BC", None), ("20190", None), ("1813 and 1999", 1813), ("2100", None), (None, None)])
def test_year(spark, text, expected):
    assert one(spark, text, X.year_in(F.col("x"))) == expected


@pytest.mark.parametrize("text, expected", [('x DATA = {"a":{"b":1}} {', '{"a":{"b":1}}'), ("DATA = {", None), ("none", None), ("DATA = }{}", "{}")])
def test_balanced(spark, text, expected):
    assert one(spark, text, X.balanced_object(F.col("x"), "DATA =")) == expected


def test_stop_list():
    assert len(ENGLISH) == len(set(ENGLISH)) == 318


def test_upper_median_and_modes(spark):
    rows = spark.createDataFrame([("a", 5, 3), ("a", 1, 1), ("a", 9, 0), ("a", 1, 2), ("a", 5, 4), ("a", 7, 5), ("b", None, 6)], "k string, v int, ord int")
    assert [tuple(r) for r in C.upper_median(rows, ["k"], "v").collect()] == [("a", 5)]
    assert {(r["k"], r["v"]) for r in C.mode_first_seen(rows, ["k"], "v", "ord").collect()} == {("a", 1)}


def test_places_are_a_total_order(spark):
    values = random.Random(1).sample(range(10000), 500)
    rows = spark.createDataFrame([(v,) for v in values], "v int").repartition(5)
    placed = {r["v"]: r["place"] for r in C.places(rows, [F.asc("v")]).collect()}
    assert placed == {v: i + 1 for i, v in enumerate(sorted(values))}


def test_ranges_are_cut_once(spark):
    """Enough rows that ranges come from a sample, and columns that only one reader of the ranges needs."""
    n = 60000
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(n).select(F.col("id"), ((F.col("id") * 7919) % n).alias("v"), F.concat_ws("-", "id", "id").alias("more")).repartition(8)
        found = C.places(rows, [F.asc("v")])
        assert found.where(f"place = v + 1 and v = (id * 7919) % {n} and more is not null").count() == found.count() == n
        sums = C.running_sums(rows, [F.asc("v")], ["v"])
        assert sums.where("place = v + 1 and sum_v = v * (v + 1) div 2").count() == sums.count() == n
        tests = rows.select("id", (F.col("v") / (20 * n)).alias("p"))  # p (rank - 1) / 20 n: all are discoveries
        assert N.benjamini_hochberg(tests, "p").where("discovery").count() == n
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def vectors(spark, n=60, seed=5):
    rng = np.random.default_rng(seed)
    rows = [(i, np.round(rng.normal(size=4), 1).tolist(), int(rng.integers(1700, 1760))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, v array<double>, year int")


def ranking(rows):
    m = np.array([v for _, v, _ in rows])
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
    sims = np.round(m @ m.T, 12)
    return {i: sorted((j for j in range(len(rows)) if j != i), key=lambda j: (-sims[i, j], j)) for i in range(len(rows))}


@pytest.mark.parametrize("block", [9, 2048])
@pytest.mark.parametrize("k", [1, 6, 100])
def test_nearest(spark, block, k):
    rows, table = vectors(spark)
    found = {}
    for r in K.nearest(table, "id", "v", D.settle, k, block).collect():
        found.setdefault(r["src"], {})[r["place"]] = r["dst"]
    assert {i: [f[p] for p in sorted(f)] for i, f in found.items()} == {i: js[:k] for i, js in ranking(rows).items()}


def test_bounds_leave_blocks_out(spark):
    """Clustered vectors: under half of the pairs of a row and a block are compared, with the same neighbours; zeros, repeats and nulls among them."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(12, 6))
    rows = [(i, (centres[i % 12] + 0.05 * rng.normal(size=6)).tolist(), int(rng.integers(1700, 1760))) for i in range(240)]
    rows += [(240 + i, rows[i][1], 1700 + i) for i in range(20)] + [(260, [0.0] * 6, 1710)]
    table = spark.createDataFrame(rows + [(999, None, 1700)], "id long, v array<double>, year int")
    assert K.share_compared(table, "id", "v", D.settle, 3, 20) < 0.5
    order = ranking(rows)
    found = {}
    for r in K.nearest(table, "id", "v", D.settle, 3, 20).collect():
        found.setdefault(r["src"], {})[r["place"]] = r["dst"]
    assert {i: [f[p] for p in sorted(f)] for i, f in found.items()} == {i: js[:3] for i, js in order.items()}
    orders = spark.createDataFrame([(i, v, [y, 3500 - y, 1700]) for i, v, y in rows], "id long, v array<double>, years array<int>")
    lives = K.lifetimes_of_orders(orders, "id", "v", "years", D.settle, 3, 40).collect()
    for trial, years in enumerate(zip(*([y, 3500 - y, 1700] for _, _, y in rows))):
        for t in sorted(set(years))[::7]:
            expected = {(i, j) for i in range(len(rows)) if years[i] <= t for j in [j for j in order[i] if years[j] <= t][:3]}
            assert {(r["src"], r["dst"]) for r in lives if r["trial"] == trial and r["start"] <= t and (r["stop"] is None or t < r["stop"])} == expected


@pytest.mark.parametrize("block", [13, 2048])
def test_lifetimes_are_the_yearly_graphs(spark, block):
    rows, table = vectors(spark, 50)
    order, years = ranking(rows), [y for _, _, y in rows]
    lives = K.lifetimes(table, "id", "v", "year", D.settle, 3, block).collect()
    for t in sorted(set(years)):
        expected = {(i, j) for i in range(len(rows)) if years[i] <= t for j in [j for j in order[i] if years[j] <= t][:3]}
        assert {(r["src"], r["dst"]) for r in lives if r["start"] <= t and (r["stop"] is None or t < r["stop"])} == expected


def test_what_is_moved_grows_with_groups(spark):
    """A block is copied once for each group on either side, however many blocks there are, and all of its rows are compared."""
    rows, table = vectors(spark, 900, 3)
    blocks = K._blocks(table, "id", "v", None, 9, K._kth(2), D.settle)
    heads = K._heads(blocks)
    met = K._meetings(blocks, heads, lambda q, c: K.pd.DataFrame({"q": [len(q)], "c": [len(c)], "pairs": [sum(len(x.ids) for x in q) * sum(len(x.ids) for x in c)]}), "q int, c int, pairs long").collect()
    assert len(heads) > 2 * K.GROUPS and max(max(r["q"], r["c"]) for r in met) <= K.HELD
    assert sum(r["pairs"] for r in met) == 900 * 900
    assert sum(r["q"] + r["c"] for r in met) == 2 * len(heads) * max(K.GROUPS, -(-len(heads) // K.HELD))


def test_short_products_choose_what_long_ones_decide():
    """Candidates looked through in 32 bits leave the same best as all products in 64 bits; near-ties and repeats, few and many, among them."""
    rng = np.random.default_rng(3)
    u = rng.normal(size=(700, 16))
    u[300:340] = u[7] + 1e-9 * rng.normal(size=(40, 16))
    u[340:400] = u[8]
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    ids, floors = np.arange(700) * 3, np.full(700, np.pi)
    found, looked = K._Best(u, ids, floors, 5), 0
    for s in range(0, 700, 140):
        bar = found.sims.min(axis=1) - 1e-11
        looked += np.isfinite(bar).all() and found._passing(u[s : s + 140], np.arange(700), bar) is not None
        found.add(u[s : s + 140], ids[s : s + 140])
    sims = np.round(u @ u.T, 12)
    np.fill_diagonal(sims, -np.inf)
    for r in range(700):
        assert found.near[r].tolist() == [ids[j] for j in sorted(range(700), key=lambda j: (-sims[r, j], j))[:5]]
    assert looked


@pytest.mark.parametrize("listed", [7, 1 << 18])
def test_listed_pairs_in_the_order_of_years(spark, listed, monkeypatch):
    """Every pair once, by products of groups of blocks and not by a join of all rows, however few are listed at a time."""
    from chronoloom.operators import pairblocks as B

    monkeypatch.setattr(B, "LISTED", listed)
    rng = np.random.default_rng(4)
    rows = [(i * 5, int(rng.integers(1700, 1720)), rng.normal(size=4).tolist(), i % 3) for i in range(60)]
    pairs = B.later_pairs(spark.createDataFrame(rows, "id long, year int, v array<double>, kind int"), 4)
    assert not re.search("NestedLoop|Cartesian", pairs._jdf.queryExecution().executedPlan().toString())
    found = sorted((r["from_id"], r["to_id"], round(r["product"], 9), r["same"], r["gap"]) for r in pairs.collect())
    assert found == sorted((a, b, round(float(np.dot(u, v)), 9), k == m, z - y) for a, y, u, k in rows for b, z, v, m in rows if y < z)


def test_influence_edges_with_nulls(spark, tmp_path):
    """An author without a vector or a form still has edges."""
    from chronoloom import registry

    rows = [(i, None if i == 3 else [float(i + 1), 2.0], None if i == 4 else i) for i in range(9)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    con.execute("CREATE TABLE orders (o_custkey BIGINT, o_orderkey BIGINT)")
    found = registry.QUERIES["influence_edges"](spark, str(tmp_path)).select("from_id", "to_id", "conceptual", "same_form", "year_gap").collect()
    expected = con.execute("SELECT from_id, to_id, conceptual, same_form, year_gap FROM (" + registry.ORACLES["influence_edges"] + ")").fetchall()
    plain = lambda r: tuple(round(x, 3) if isinstance(x, float) else x for x in r)
    assert sorted(map(plain, found), key=repr) == sorted(map(plain, expected), key=repr) and len(found) == 36


@pytest.mark.parametrize("block", [3, 2048])
def test_products_of_listed_pairs(spark, block):
    """Each pair keeps its columns and gets its product, null where an end has no vector; vectors don't go with the pairs."""
    from chronoloom.operators import pairblocks as B

    rows, table = vectors(spark, 20)
    listed = [(i, j, f"{i}-{j}") for i in range(22) for j in range(0, 22, 3)]
    pairs = spark.createDataFrame(listed, "from_id long, to_id long, src string")
    found = {(r["from_id"], r["to_id"], r["src"]): r["product"] for r in B.pair_products(table.select("id", "v"), pairs, block=block).collect()}
    own = {i: np.array(v) for i, v, _ in rows}
    assert found == {(i, j, s): pytest.approx(own[i] @ own[j], abs=1e-12) if i < 20 and j < 20 else None for i, j, s in listed}


def links(spark, seed=1, n=30, m=60):
    rng = random.Random(seed)
    pairs = sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)})
    return pairs, spark.createDataFrame(pairs, "a long, b long")


def test_clustering(spark):
    pairs, table = links(spark)
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    expected = {}
    for x, ns in near.items():
        t = sum((a, b) in set(pairs) for a in ns for b in ns if a < b)
        expected[x] = (len(ns), t, 2 * t / (len(ns) * (len(ns) - 1)) if len(ns) > 1 else 0.0)
    found = {r["node"]: (r["degree"], r["triangles"], r["coefficient"]) for r in G.clustering(table).collect()}
    assert set(found) == set(expected) and all(found[x] == pytest.approx(expected[x]) for x in found)


def test_components_and_communities(spark):
    pairs, table = links(spark, 3, 40, 30)
    root = {x: x for p in pairs for x in p}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    assert {r["node"]: r["component"] for r in G.components(table, D.settle).collect()} == root


def test_communities_by_moves(spark):
    """Many graphs at once, each within 2 % of the modularity of one graph in one task; a disconnected one, ties, an empty table."""
    from one_task import louvain

    rng = random.Random(4)
    graphs = {}
    for run, (n, groups, inside, across) in enumerate([(90, 6, 0.5, 0.02), (60, 3, 0.3, 0.05), (40, 40, 0.0, 0.1), (12, 2, 1.0, 0.0)]):
        graphs[run] = [(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < (inside if a % groups == b % groups else across)]
    table = spark.createDataFrame([(run, a, b) for run, pairs in graphs.items() for a, b in pairs], "run long, a long, b long")
    settings = spark.createDataFrame([(run, 1.0, 42) for run in graphs], "run long, resolution double, seed int")
    found = M.louvain(table, settings, D.settle)
    q = {r["run"]: (r["communities"], r["modularity"]) for r in M.modularity(table, found, settings).collect()}
    of = {run: {} for run in graphs}
    for r in found.collect():
        of[r["run"]][r["node"]] = r["community"]

    def modularity(pairs, own):
        d = {x: sum(x in p for p in pairs) for x in own}
        m = len(pairs)
        return sum(own[a] == own[b] for a, b in pairs) / m - sum((sum(d[x] for x in own if own[x] == c) / (2 * m)) ** 2 for c in set(own.values()))

    for run, pairs in graphs.items():
        assert set(of[run]) == {x for p in pairs for x in p}
        assert all(c == min(x for x in of[run] if of[run][x] == c) for c in set(of[run].values()))
        assert q[run] == (len(set(of[run].values())), pytest.approx(modularity(pairs, of[run])))
        a, b = np.array(pairs).T
        assert q[run][1] >= 0.98 * modularity(pairs, louvain(a, b, 1.0, 42)) - (0.02 if run == 2 else 0)
    assert q[3][0] == 2
    alone = M.louvain(table.where("run = 1"), settings, D.settle).collect()
    assert {r["node"]: r["community"] for r in alone} == of[1]
    assert M.louvain(table.limit(0), settings, D.settle).count() == 0


def test_graphs_dealt_to_tasks_move_alike(spark, monkeypatch):
    """Many graphs, each in a task, get the communities of the joins, to the node; also where some are over the bound; no round runs over all of them."""
    rng = random.Random(6)
    graphs = {}
    for run, (n, groups, inside, across) in enumerate([(90, 6, 0.5, 0.02), (60, 3, 0.3, 0.05), (70, 70, 0.0, 0.06), (12, 2, 1.0, 0.0), (50, 5, 0.6, 0.1), (2, 1, 1.0, 0.0)]):
        graphs[run] = [(7 * a - 100, 7 * b - 100) for a in range(n) for b in range(a + 1, n) if rng.random() < (inside if a % groups == b % groups else across)]
    table = spark.createDataFrame([(run, a, b) for run, pairs in graphs.items() for a, b in pairs], "run long, a long, b long")
    settings = spark.createDataFrame([(run, 1.0 + run / 4, 40 + run) for run in graphs], "run long, resolution double, seed int")
    rows = lambda found: {(r["run"], r["node"]): r["community"] for r in found.collect()}
    expected = rows(M.louvain(table, settings, D.settle))
    assert rows(M.louvain_of_many(table, settings, D.settle, whole=sorted(map(len, graphs.values()))[3])) == expected
    monkeypatch.setattr(M, "louvain", None)
    assert rows(M.louvain_of_many(table, settings, D.settle)) == expected
    assert M.louvain_of_many(table.limit(0), settings, D.settle).count() == 0


def test_spans_of_years_are_the_yearly_graphs(spark):
    """Yearly communities made a span at a time against those by joins, with timelines of their own, years without books and open ends."""
    rng = random.Random(3)
    lives = [(g, a, b, s, rng.choice([None, s + rng.randint(1, 9)])) for g in (0, 3) for a in range(40) for b in rng.sample(range(40), 3) for s in [rng.randint(-5, 12)]]
    table = spark.createDataFrame(lives, "g int, src long, dst long, start int, stop int")
    years = spark.createDataFrame([(y,) for y in range(-5, 16) if y % 5], "year int")
    rows = lambda found: sorted(map(tuple, found.select("g", "snapshot", "label", "book_id").collect()))
    expected = rows(L.snapshot_communities(table, years, D.settle, by="g", whole=0))
    assert expected and rows(L.snapshot_communities(table, years, D.settle, by="g")) == expected
    assert rows(L.snapshot_communities(table, years, D.settle, by="g", whole=150)) == expected
    alone = L.snapshot_communities(table.where("g = 3").drop("g"), years, D.settle).collect()
    assert sorted((3, r["snapshot"], r["label"], r["book_id"]) for r in alone) == [r for r in expected if r[0] == 3]


def test_overlap_join(spark):
    sets = {1: {"x", "y"}, 2: {"y", "z", "w"}, 3: {"y"}, 4: {"q"}, 5: {"x", "y", "z", "w"}}
    table = spark.createDataFrame([(k, m) for k, ms in sets.items() for m in ms], "k long, m string")
    expected = {(a, b): len(sets[a] & sets[b]) / min(len(sets[a]), len(sets[b])) for a in sets for b in sets if a < b}
    assert {(r["a"], r["b"]): r["overlap"] for r in G.overlaps(table, "k", "m", D.settle).collect()} == {p: o for p, o in expected.items() if o >= 0.5}
    rng = random.Random(1)
    sets = {k: {"hot", *(f"m{rng.randrange(60)}" for _ in range(rng.randint(0, 7)))} for k in range(150)}  # a member that all hold
    table = spark.createDataFrame([(k, m) for k, ms in sets.items() for m in ms], "k long, m string")
    for least in (0.3, 0.5, 1.0):
        expected = {(a, b): len(sets[a] & sets[b]) / min(len(sets[a]), len(sets[b])) for a in sets for b in sets if a < b}
        assert {(r["a"], r["b"]): r["overlap"] for r in G.overlaps(table, "k", "m", D.settle, least).collect()} == {p: o for p, o in expected.items() if o >= least}
    # sets of one or two members must ask for the member that all hold; larger ones need not
    larger = {k: ms for k, ms in sets.items() if len(ms) > 2}
    part = spark.createDataFrame([(k, m) for k, ms in larger.items() for m in ms], "k long, m string")
    assert G.overlap_candidates(part, "k", "m", 0.5)[1].count() < len(larger) * (len(larger) - 1) / 4


@pytest.mark.parametrize("wide", [64, 4, 0])
def test_pairs_of_sets_are_told_where_they_meet(spark, monkeypatch, wide):
    """Pairs that share several members come once, without a list of pairs being moved, and so do those of sets too large to be carried."""
    rng = random.Random(7)
    sets = {k: {"hot", *(f"m{rng.randrange(20)}" for _ in range(rng.randint(0, 9)))} - ({"hot"} if k % 3 else set()) for k in range(60)}
    table = spark.createDataFrame([(k, m) for k, ms in sets.items() for m in ms], "k long, m string").withColumnRenamed("m", "name")
    monkeypatch.setattr(G, "WIDE", wide)
    pairs = [tuple(r) for r in G.shared_pairs(table, "k", "name", D.settle).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(a, b) for a in sets for b in sets if a != b and sets[a] & sets[b]}
    for least in (0.3, 1.0):
        expected = sorted((a, b, len(sets[a] & sets[b])) for a in sets for b in sets if a < b and sets[a] & sets[b] and len(sets[a] & sets[b]) / min(len(sets[a]), len(sets[b])) >= least)
        assert sorted((r["a"], r["b"], r["shared"]) for r in G.overlaps(table, "k", "name", D.settle, least).collect()) == expected
    if wide == 64:
        plan = G.shared_pairs(table, "k", "name", D.settle)._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" not in plan  # nothing gathers pairs to drop those that repeat


def test_lineage_events(spark):
    """Two communities merge in the third year; the corpus of three groups has a birth for each."""
    rows = [(1, "a", 1), (2, "a", 1), (3, "a", 1), (4, "b", 1), (5, "b", 1), (6, "b", 1)]
    first = [(t, label, i) for t in (1, 2) for i, label, _ in rows]
    table = spark.createDataFrame(first + [(3, "m", i) for i in range(1, 7)], "snapshot int, label string, book_id long")
    years = spark.createDataFrame([(y,) for y in (1, 2, 3, 4)], "year int")
    found = {r["year"]: (r["n_communities"], r["births"], r["splits"], r["merges"]) for r in L.timeline(table, years).collect()}
    assert found == {1: (2, 2, 0, 0), 2: (2, 0, 0, 0), 3: (1, 0, 0, 1), 4: (0, 0, 0, 0)}
    corpus = D.synthetic_corpus(spark).selectExpr("title book_id", "substr(title, 1, 2) label", "year")
    grown = L.timeline(L.cumulative(corpus), corpus)
    assert grown.agg(F.sum("births")).first()[0] == 3


def test_takeoff_is_the_loop(spark):
    rng = random.Random(2)
    rows, expected = [], {}
    for term in range(40):
        values = [max(0.0, rng.gauss(y / 3, 4)) if term else 0.0 for y in range(30)]
        rows += [(str(term), 1800 + y, v) for y, v in enumerate(values)]
        peak, hit = max(values), None
        if peak > 0:
            for i in range(30):
                if all(v >= 0.5 * peak for v in values[i : i + 10]):
                    hit = 1800 + i
                    break
        expected[str(term)] = hit
    table = spark.createDataFrame(rows, "term string, year int, freq double")
    assert {r["term"]: r["takeoff"] for r in S.takeoff(table, [0.5], value="freq").collect()} == expected


def test_must_match_fails_loudly(spark):
    left, right = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x")], "k int, v string")
    with pytest.raises(Exception, match="no match"):
        S.must_match(left, right, "k").collect()
    assert S.must_match(left.where("k = 1"), right, "k").count() == 1


def test_closed_form_is_the_simulation(spark):
    rng = np.random.default_rng(0)
    pool = rng.normal(size=400)
    own = pool[:30] + 0.4
    z = N.pool_z(spark.createDataFrame([(float(x),) for x in own], "v double"), spark.createDataFrame([(float(x),) for x in pool], "v double"), "v").first()["z"]
    means = rng.choice(pool, (20000, 30)).mean(axis=1)
    assert z == pytest.approx((own.mean() - means.mean()) / means.std(), abs=0.1)


def test_average_ranks(spark):
    rows = spark.createDataFrame([(3,), (1,), (3,), (2,), (3,)], "v int")
    assert sorted((r["v"], r["r"]) for r in N.average_ranks(rows, "v", "r").collect()) == [(1, 1.0), (2, 2.0), (3, 4.0), (3, 4.0), (3, 4.0)]


def test_sparse_detrending_is_the_dense_one(spark):
    rng = np.random.default_rng(1)
    n, d = 20, 15
    m = np.where(rng.random((n, d)) < 0.4, rng.random((n, d)), 0.0)
    years = rng.integers(1700, 1800, n)
    weights = spark.createDataFrame([(i, f"t{j}", float(m[i, j])) for i in range(n) for j in range(d) if m[i, j]], "id long, term string, w double")
    table = spark.createDataFrame([(i, int(y)) for i, y in enumerate(years)], "id long, year int")
    pairs = spark.createDataFrame([(i, j) for i in range(n) for j in range(n) if i < j], "from_id long, to_id long")
    yc = years - years.mean()
    x = m - np.outer(yc, yc @ m / (yc @ yc))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for r in V.detrended_cosine(weights, table, pairs, "id").collect():
        assert r["cosine"] == pytest.approx(float(x[r["from_id"]] @ x[r["to_id"]]), abs=1e-9)


def test_pairs_meet_short_rows(spark):
    """Products and weights from a row for each document are those of a row for each term; no row for each term and pair is joined."""
    rng = random.Random(11)
    texts = [(i, " ".join(rng.choice(["ab", "cd", "ef", "gh", "ij", "kl", "mn"][: 2 + i % 6]) for _ in range(rng.randint(0, 30)))) for i in range(40)] + [(40, None), (41, "zz zz")]
    docs = spark.createDataFrame(texts, "id long, text string")
    pairs = spark.createDataFrame([(i, j) for i in range(42) for j in range(0, 43, 5) if i != j], "from_id long, to_id long")
    weights = D.settle(V.tfidf(docs, "id", "text", 3, 0.9, 5))
    vectors, idf = V.term_vectors(docs, "id", "text", D.settle, 3, 0.9, 5)
    rows = lambda df: {(r[0], r[1]): pytest.approx(r[2], abs=1e-12) for r in df.collect()}
    found = V.vector_products(vectors, idf, pairs, "id")
    expected = rows(V.sparse_products(weights, pairs, "id"))
    assert len(expected) > 100 and {(r[0], r[1]): r[2] for r in found.collect()} == expected
    assert sorted((r["id"], round(r["w"], 9)) for r in V.weights_of(vectors, idf, "id").collect()) == sorted((r["id"], round(r["w"], 9)) for r in weights.collect())
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    apart = spark.createDataFrame([(i, "ab ab" if i < 9 else "cd") for i in range(18)], "id long, text string")
    apart, own = V.term_vectors(apart, "id", "text", D.settle, 3, 0.9, 5)
    few = spark.range(2001).selectExpr("IF(id < 2000, 1, 10) AS from_id", "11L AS to_id").coalesce(1)  # whole batches that share nothing
    assert [r["dot"] for r in V.vector_products(apart, own, few, "id").collect()] == [pytest.approx(1.0)]
    none, idf = V.term_vectors(docs.limit(0), "id", "text", D.settle)
    assert V.vector_products(none, idf, pairs, "id").count() == 0


def test_json_sources_and_resume(spark, tmp_path):
    (tmp_path / "b.json").write_text('{"books": [{"title": "A", "genres": ["x"]}, {"title": "B"}]}')
    assert [r["title"] for r in D.read_json_document(spark, str(tmp_path / "b.json"), "books", D.BOOK).collect()] == ["A", "B"]
    assert D.read_json_array(spark, str(tmp_path / "missing.json"), "title string").count() == 0
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert D.append_new(rows, str(tmp_path / "t"), "k") == 2
    assert D.append_new(rows.unionByName(spark.createDataFrame([(3, "c")], "k int, v string")), str(tmp_path / "t"), "k") == 1
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3
    D.write_csv(rows, str(tmp_path / "c"), ["k"])
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 2


def test_catalog_texts_and_pages(spark, tmp_path):
    from chronoloom.sources import pages, web

    def book(i, **more):
        return {"id": i, "title": f"T{i}", "authors": [{"name": "A", "birth_year": 1800}], "formats": {"text/plain": f"file://{tmp_path}/{i}.txt"}, "bookshelves": ["s", "s"], "subjects": ["u"]} | more

    import json

    (tmp_path / "2.json").write_text(json.dumps({"results": [book(3, title=None), book(4, authors=[]), book(5)], "next": None}))
    (tmp_path / "1.json").write_text(json.dumps({"results": [book(1), book(2, formats={"text/plain": "x.zip"})], "next": f"file://{tmp_path}/2.json"}))
    (tmp_path / "1.txt").write_text("first")
    found = web.read_catalog(spark, f"file://{tmp_path}/1.json")
    assert [(r["id"], r["labels"]) for r in found.orderBy("id").collect()] == [(1, ["s", "u"]), (5, ["s", "u"])]
    assert web.read_catalog(spark, f"file://{tmp_path}/1.json", 1).count() == 1
    urls = found.select("id", F.array(F.lit(f"file://{tmp_path}/none"), "text_url").alias("urls"))
    assert {r["id"]: r["text"] for r in web.fetch_texts(urls).collect()} == {1: "first", 5: None}
    assert "__DATA__" not in pages.page("<script>const D = __DATA__;</script>", {"books": found.select("id", "title")})
    with pytest.raises(ValueError):
        pages.payload({"n": spark.range(10)}, 5)
    assert "polyline" in pages.line_figure(spark.range(5).selectExpr("id x", "id * id y"), "x", "y")


def test_a_broken_scan_goes_on_where_it_stopped(spark, tmp_path):
    """Pages that can't be had, and a page that can't be read, end the scan; the next one goes on there, and every row is there once."""
    import json

    from chronoloom.sources import web

    def put(k, rows, after):
        page = {"results": [{"id": i, "title": f"T{i}", "authors": [{"name": "A"}], "formats": {"text/plain": f"{i}.txt"}} for i in rows], "next": after and f"file://{tmp_path}/{after}.json"}
        (tmp_path / f"{k}.json").write_text(json.dumps(page))

    def run(pages):
        web.ingest_catalog(spark, f"file://{tmp_path}/1.json", str(tmp_path / "table"), str(tmp_path / "state"), pages, 1)

    def found():
        return sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "table")).collect())

    put(1, [1, 2], 2)
    put(2, [3], 3)
    with pytest.raises(Exception):  # noqa: B017, PT011  the third page isn't there
        run(1)
    assert found() == [1, 2, 3]
    put(3, [4, 5], 4)
    put(4, [6], 5)
    (tmp_path / "5.json").write_text(json.dumps({"results": [{"id": 7, "title": "T", "authors": ["odd"]}], "next": None}))
    with pytest.raises(Exception):  # noqa: B017, PT011  the fifth has a row that can't be read
        run(3)
    assert set(found()) <= {1, 2, 3, 4, 5, 6}
    put(5, [7], None)
    run(3)
    assert found() == [1, 2, 3, 4, 5, 6, 7]
    run(2)
    assert found() == [1, 2, 3, 4, 5, 6, 7]


def test_embedding_cache(spark):
    from chronoloom.sources import web

    rows = spark.createDataFrame([(1, "aa"), (2, "b" * 9000), (3, None)], "k int, t string")
    cache = spark.createDataFrame([(1, [9.0]), (7, [1.0])], "k int, embedding array<double>")
    found = web.with_embeddings(rows, cache, "k", "t", lambda text: F.array(F.length(text).cast("double")))
    assert {r["k"]: r["embedding"] for r in found.collect()} == {1: [9.0], 2: [6000.0], 3: [0.0]}


def test_embedding_falls_back_to_tfidf(spark):
    """A model that fails in a task gives way to TF-IDF for all rows, whose products are those of the long form."""
    from chronoloom.sources import web

    texts = ["red fox jumps", "red fox sleeps", "blue whale", "", None, "whale fox fox"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    found, backend = web.embed_or_tfidf(rows, "k", "t", lambda text: F.array(F.length(text).cast("double")), D.settle)
    assert backend == "model" and {r["k"]: r["embedding"] for r in found.collect()} == {i: [float(len(t or ""))] for i, t in enumerate(texts)}
    broken = lambda text: F.array(F.raise_error(F.concat(F.lit("no model for "), text)).cast("double"))
    found, backend = web.embed_or_tfidf(rows, "k", "t", broken, D.settle, min_df=1, max_df=0.9)
    vectors = {r["k"]: np.array(r["embedding"]) for r in found.collect()}
    assert backend == "tfidf" and set(vectors) == set(range(6)) and not vectors[3].any() and not vectors[4].any()
    long = {}
    for r in V.tfidf(rows, "k", "t", 1, 0.9).collect():
        long.setdefault(r["k"], {})[r["term"]] = r["w"]
    for a in range(6):
        for b in range(6):
            assert vectors[a] @ vectors[b] == pytest.approx(sum(w * long.get(b, {}).get(term, 0.0) for term, w in long.get(a, {}).items()))


def test_student_tail():
    assert N.student_tail(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert N.student_tail(0.0, 5) == 1.0
    assert N.student_tail(1.8, 128) == pytest.approx(0.0742, abs=1e-3)


def test_spearman_p(spark):
    assert spark.createDataFrame([(0.157, 130), (0.5, 2)], "r double, n long").select(N.spearman_p(F.col("r"), F.col("n")).alias("p")).collect()[0]["p"] == pytest.approx(0.0745, abs=1e-3)


def test_lanes(spark):
    """The first free lane, else the one that ends first: against the fold in plain Python."""
    from chronoloom.operators import layout

    rng = random.Random(3)
    rows = [(i, round(rng.random(), 3), rng.randrange(3)) for i in range(120)]
    expected = {}
    for band in range(3):
        ends = [-1.0, -1.0, -1.0]
        for i, x, _ in sorted((r for r in rows if r[2] == band), key=lambda r: (r[1], r[0])):
            lane = next((k for k in range(3) if ends[k] <= x), min(range(3), key=lambda k: ends[k]))
            ends[lane] = x + 0.05
            expected[i] = lane
    found = layout.lanes(spark.createDataFrame(rows, "author_id long, x double, band int"), 0.05, 3)
    assert {r["author_id"]: r["lane"] for r in found.collect()} == expected


def test_order_statistics_by_counts(spark):
    """Medians, gaps and first books of groups against sorted lists; nulls, ties, a group of one."""
    rng = random.Random(5)
    rows = [(i, f"g{rng.randrange(4)}", rng.choice([None, *range(1700, 1712)])) for i in range(90)] + [(900, "one", 1800), (901, "none", None)]
    table = spark.createDataFrame(rows, "book_id long, label string, year int")
    own = {}
    for i, g, y in rows:
        own.setdefault(g, []).append((y, i))
    medians = {r["label"]: r["year"] for r in C.upper_median(table, ["label"], "year").collect()}
    years = {g: sorted(y for y, _ in ys if y is not None) for g, ys in own.items()}
    assert medians == {g: ys[len(ys) // 2] for g, ys in years.items() if ys}
    whole = table.where("year is not null")
    for r in L.describe(whole).collect():
        ys, n = years[r["label"]], len(years[r["label"]])
        assert r["year_median"] == (ys[(n - 1) // 2] + ys[n // 2]) // 2
        assert r["largest_gap"] == max((b - a for a, b in zip(ys, ys[1:])), default=None)
        assert r["exemplars"] == ",".join(str(i) for _, i in sorted(x for x in own[r["label"]] if x[0] is not None)[:5])


def test_shuffled_years_keep_the_calendar(spark):
    books = spark.createDataFrame([(i, 1700 + i * i % 13) for i in range(50)], "book_id long, year int")
    dealt = {r["book_id"]: r["years"] for r in L.shuffled_years(books, 3, 7).collect()}
    assert all(years[0] == 1700 + i * i % 13 and len(years) == 4 for i, years in dealt.items())
    for trial in range(4):
        assert sorted(y[trial] for y in dealt.values()) == sorted(1700 + i * i % 13 for i in range(50))
    assert len({tuple(y[t] for _, y in sorted(dealt.items())) for t in range(4)}) == 4


def test_spread_of_runs_is_that_of_draws(spark):
    """Mean and deviation of the null spread against draws by another generator."""
    rng = np.random.default_rng(1)
    years = rng.integers(1700, 1900, 60)
    members = spark.createDataFrame([(i, "a" if i < 8 else "b", int(y)) for i, y in enumerate(years)] + [(99, "c", None)], "book_id long, label string, year int")
    sizes = spark.createDataFrame([(8,), (40,), (1,)], "n long")
    found = {r["n"]: (r["mean"], r["sd"]) for r in N.null_spread(members, sizes, 1500, 3).collect()}
    for n in (8, 40):
        drawn = np.array([rng.permutation(years)[:n].std() for _ in range(4000)])
        assert found[n][0] == pytest.approx(drawn.mean(), rel=0.03) and found[n][1] == pytest.approx(drawn.std(), rel=0.1)
    assert found[1] == (0.0, 0.0)


@pytest.mark.parametrize("margin", [6.0, -1.5])
def test_each_trial_has_its_own_order(spark, margin):
    """Every community's draws are the first of each trial's order of all books, whatever the margin leaves to be sorted."""
    from hashlib import md5

    years = {i: 1700 + i * i % 97 for i in range(90)}
    labels = {i: "a" if i % 9 == 0 else "b" if i % 3 else "c" for i in years}
    members = spark.createDataFrame([(i, labels[i], y) for i, y in years.items()], "book_id long, label string, year int")
    expected = {}
    for n in {sum(x == y for y in labels.values()) for x in "abc"}:
        drawn = [np.std([years[i] for i in sorted(years, key=lambda i: md5(f"42:{t}:{i}".encode()).hexdigest())[:n]]) for t in range(40)]
        expected[n] = (np.mean(drawn), np.std(drawn))
    for r in N.concentration(members, 40).collect():
        assert r["z"] == pytest.approx((r["sigma"] - expected[r["n"]][0]) / expected[r["n"]][1])
    found = N.ordered_spread(members, spark.createDataFrame([(n,) for n in expected], "n long"), 40, 42, margin)
    assert {r["n"]: pytest.approx((r["mean"], r["sd"])) for r in found.collect()} == expected


def test_a_figure_is_drawn_whole_or_not_at_all(spark, monkeypatch):
    from chronoloom.sources import pages

    monkeypatch.setattr(pages, "ROWS", 5)
    points = spark.range(6).selectExpr("id AS x", "id AS y")
    assert pages.line_figure(points.limit(5), "x", "y").count(",") == 5
    with pytest.raises(ValueError):
        pages.line_figure(points, "x", "y")


def test_recurring_groups_and_their_significance(spark):
    """Against the fold and the medians in plain Python."""
    import random
    from statistics import median

    from chronoloom.operators import graph, nullmodels

    rng = random.Random(8)
    sets, years = {}, {i: 1700 + (i * 37) % 200 for i in range(80)}
    for resolution in (1.0, 2.0):
        for seed in range(5):
            for c, start in enumerate(range(0, 80, 10 if resolution == 1.0 else 8)):
                own = {x for x in range(start, min(80, start + 8)) if rng.random() < 0.9} | ({rng.randrange(80)} if seed else set())
                sets[int(resolution * 10) + seed, resolution, seed, c] = own
    rows = [(run, r, seed, node, c) for (run, r, seed, c), own in sets.items() for node in own]
    found = spark.createDataFrame(rows, "run long, resolution double, seed int, node long, community long")
    groups = {}
    for (run, r, _, c), own in sorted(sets.items(), key=lambda x: (x[0][1], x[0][2], x[0][3])):
        if len(own) >= 5:
            for g in groups.setdefault(r, []):
                if len(g[0] & own) / len(g[0] | own) >= 0.5:
                    g[0] &= own
                    g[1].append((run, c))
                    break
            else:
                groups[r].append([set(own), [(run, c)]])
    expected = {(r, ",".join(map(str, sorted(core))), len(held)) for r, gs in groups.items() for core, held in gs}
    assert {(x["resolution"], x["core"], x["seeds_seen"]) for x in graph.recurring(found, 5).collect()} == expected
    assert any(x["stable"] for x in graph.recurring(found, 5).collect())
    members = spark.createDataFrame([(i, y) for i, y in years.items()], "book_id long, year int")
    z = nullmodels.set_concentration(found, members, 50)
    zs = {(x["run"], x["community"]): x["z"] for x in z.collect()}
    assert len(zs) == len(sets)
    result = nullmodels.recurring_significance(graph.recurring_members(found), z, 5).collect()
    assert len(result) == sum(map(len, groups.values()))
    for x in result:
        held = groups[x["resolution"]][x["place"]][1]
        own = sorted((zs[h], *h) for h in held)
        assert (x["run"], x["community"]) == own[len(own) // 2][1:]
        assert abs(x["z_median"] - median(v for v, *_ in own)) < 1e-9 and x["tests"] == len(groups[x["resolution"]])
        assert x["significant"] == (x["z_median"] <= nullmodels.bonferroni_z(x["tests"]) and len(held) >= 3)


def test_mutations_of_yearly_graphs(spark):
    """A group that splits and joins again in its yearly graphs."""
    from chronoloom import registry

    from chronoloom.operators import lineage

    def ring(nodes):
        return [(a, b) for a in nodes for b in nodes if a < b]

    both, halves = ring(range(8)), ring(range(4)) + ring(range(4, 8))
    lives = [(a, b, 1, 2 if (a, b) not in halves else None) for a, b in both] + [(a, b, 3, None) for a, b in both if (a, b) not in halves]
    lives += [(a, b, 1, None) for a, b in ring(range(20, 24))]
    table = spark.createDataFrame(lives, "src long, dst long, start int, stop int")
    years = spark.createDataFrame([(1,), (2,), (3,)], "year int")
    found = lineage.timeline(lineage.snapshot_communities(table, years, D.settle), years).orderBy("year").collect()
    assert [(r["n_communities"], r["births"], r["splits"], r["merges"]) for r in found] == [(2, 2, 0, 0), (3, 0, 1, 0), (2, 0, 0, 1)]
    sf = "/root/testdata/sf0.001"
    row = registry.QUERIES["excess_spearman_p"](spark, sf).first()
    assert row["n"] < 3 or 0 <= row["p"] <= 1


@pytest.mark.parametrize("block", [7, 2048])
def test_pairs_in_the_order_of_years(spark, block):
    """Thresholds, best later ones, places and an order statistic against the list of all pairs; ties, equal years, odd rows."""
    from chronoloom.operators import pairblocks as B

    rng = np.random.default_rng(2)
    v = rng.normal(size=(40, 3))
    v[5:9] = v[4]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    years = rng.integers(0, 12, 40)
    rows = spark.createDataFrame([(i, int(years[i]), v[i].tolist()) for i in range(40)] + [(99, None, [1.0, 0.0, 0.0])], "id long, year int, v array<double>")
    dot = {(i, j): float(v[i] @ v[j]) for i in range(40) for j in range(40) if years[i] < years[j]}
    assert {(r["from_id"], r["to_id"]) for r in B.pairs_from(rows, 0.3, block).collect()} == {p for p, x in dot.items() if x >= 0.3}
    order = {i: sorted((j for a, j in dot if a == i), key=lambda j: (-round(dot[i, j], 9), j)) for i in range(40)}
    assert {(r["from_id"], r["to_id"], r["place"]) for r in B.best_later(rows, 4, block=block).collect()} == {(i, j, k) for i, js in order.items() for k, j in enumerate(js[:4], 1)}
    pairs = spark.createDataFrame([(i, j) for i in range(0, 40, 3) for j in range(40) if i != j] + [(1, 99), (99, 1), (1, 500)], "from_id long, to_id long")
    expected = {(i, j, k) for i in range(0, 40, 3) for k, j in enumerate(order[i], 1)}
    assert {(r["from_id"], r["to_id"], r["place"]) for r in B.places_of(rows, pairs, block=block).collect()} == expected
    assert {r["id"]: r["later"] for r in B.later_counts(rows).collect()} == {i: len(order[i]) for i in range(40)}
    for few in (1 << 20, 1):
        assert B.value_at(rows, 0.93, block, few).first()["value"] == pytest.approx(sorted(dot.values())[int(len(dot) * 0.93)], abs=1e-12)
    assert B.value_at(rows.limit(0), 0.93).count() == 0


def test_groups_meet_once_in_the_order_of_years(spark):
    """A block is copied once for each group, and of two groups only what rises in years is multiplied, each pair once."""
    from chronoloom.operators import pairblocks as B

    rng = np.random.default_rng(5)
    rows = [(i * 3, int(rng.integers(1700, 1715)), rng.normal(size=3).tolist()) for i in range(120)]
    packed, parts, groups = B._packed(spark.createDataFrame(rows, "id long, year int, v array<double>"), 5)
    met = B._met(packed, groups).toPandas()
    assert groups == B.GROUPS and len(met) == groups * packed.count()
    found, multiplied = [], 0
    for _, part in met.groupby(["i", "j"]):
        for a, b in B._in_order(part):
            for some, those, whole in B._tiles(a, b, 7, 11):
                early, late = a.years[some][:, None] < b.years[those][None], (a.ids[some], b.ids[those])
                assert early.all() or not whole
                multiplied += early.size
                i, j = np.nonzero(early)
                found += zip(late[0][i].tolist(), late[1][j].tolist())
    assert sorted(found) == sorted((a, b) for a, y, _ in rows for b, z, _ in rows if y < z)
    assert multiplied < 0.75 * 120 * 120


@pytest.mark.parametrize("margin", [0, 3])
def test_a_value_at_a_place_takes_few_passes(spark, margin, monkeypatch):
    """Bounds from the pairs of some rows leave few products to bin; all pairs are gone through three times at most, and again where bounds miss."""
    from chronoloom.operators import pairblocks as B

    monkeypatch.setattr(B, "TRIED", 40)
    rng = np.random.default_rng(6)
    v = rng.normal(size=(400, 5))
    v[:200] += margin * (np.arange(200) % 7 == 0)[:, None]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    years = rng.integers(0, 30, 400)
    rows = spark.createDataFrame([(i, int(years[i]), v[i].tolist()) for i in range(400)] + [(900, 3, [None] * 5)], "id long, year int, v array<double>")
    dots = np.sort((v @ v.T)[years[:, None] < years[None]])
    passes, over = [], B._over_packed
    monkeypatch.setattr(B, "_over_packed", lambda *a: passes.append(1) or over(*a))
    for share in (0.0, 0.5, 0.93, 0.9999):
        passes.clear()
        assert B.value_at(rows, share, 64, 1000).first()["value"] == pytest.approx(dots[int(len(dots) * share)], abs=1e-12)
        assert len(passes) <= 4


def test_lineage_without_members_being_moved(spark):
    """Communities and lineage followed in tasks against memberships and their joins; also where some spans, or all, go by joins."""
    rng = random.Random(4)
    lives = [(g, a, b, s, rng.choice([None, s + rng.randint(1, 14)])) for g in (0, 3) for a in range(40) for b in rng.sample(range(40), 3) for s in [rng.randint(-9, 24)]]
    table = spark.createDataFrame(lives, "g int, src long, dst long, start int, stop int")
    years = spark.createDataFrame([(y,) for y in range(-9, 28) if y % 5 and not 10 < y < 18], "year int")
    members = D.settle(L.snapshot_communities(table, years, D.settle, by="g"))
    names = ["g", "snapshot", "t", "prev", "curr", "jaccard"]
    rows = lambda found, columns: sorted(map(tuple, found.select(*columns).collect()))
    communities, links = rows(members.select("g", "snapshot", "label").distinct(), names[:2] + ["label"]), rows(L.lineage(members, years, by="g"), names)
    assert links
    for whole in (M.WHOLE, 120):
        now, found = L.snapshot_lineage(table, years, D.settle, by="g", whole=whole)
        assert rows(now, names[:2] + ["label"]) == communities and rows(found, names) == links
    alone = L.snapshot_lineage(table.where("g = 3").drop("g"), years, D.settle)[1]
    assert [(3, *r) for r in rows(alone, names[1:])] == [r for r in links if r[0] == 3]


def test_lifetimes_for_several_k_come_from_one_search(spark):
    _, table = vectors(spark, 50)
    found = K.lifetimes_of_ks(table, "id", "v", "year", D.settle, [2, 3, 5], 13).collect()
    for k in (2, 3, 5):
        alone = K.lifetimes(table, "id", "v", "year", D.settle, k, 13).collect()
        of = lambda r: (r["src"], r["dst"], r["start"], r["stop"])
        assert sorted(map(of, alone), key=repr) == sorted((of(r) for r in found if r["k"] == k), key=repr)


def test_moves_are_the_same_however_many_links_are_looked_at(monkeypatch):
    """Rounds over few links at a time and over all; ids far apart and near; and what a graph takes is some 120 bytes a link."""
    import tracemalloc

    rng = np.random.default_rng(7)
    a, b = rng.integers(0, 300, 1500) * 5, rng.integers(0, 300, 1500) * 5
    expected = M.moved(a, b, 1.2, 3)
    for some in (7, 100):
        monkeypatch.setattr(M, "SOME", some)
        for far in (1, 10**9):
            nodes, community = M.moved(a * far, b * far, 1.2, 3) if far == 1 else M.moved(np.append(a, far), np.append(b, far), 1.2, 3)
            assert nodes[: len(expected[0])].tolist() == expected[0].tolist() and community[: len(expected[0])].tolist() == expected[1].tolist()
    monkeypatch.undo()
    a = np.repeat(np.arange(200_000), 5)
    b = (a + rng.integers(1, 2000, len(a))) % 200_000
    tracemalloc.start()
    M.moved(a, b, 1.0, 42, 2, 2)
    assert tracemalloc.get_traced_memory()[1] < 200 * len(a)
    tracemalloc.stop()


def test_what_grows_is_not_broadcast(spark):
    """Sets of many runs, their places in the orders and their z are merged, however small they look to the driver."""
    rng = random.Random(2)
    sets = spark.createDataFrame([(run, c, node) for run in range(3) for c in range(4) for node in rng.sample(range(40), 6)], "run long, community long, node long")
    members = spark.createDataFrame([(i, 1700 + i * 7 % 90) for i in range(40)], "book_id long, year int")
    found = N.set_concentration(sets, members, 20)
    assert len(found.collect()) == 12
    joins = re.findall(r"(BroadcastHashJoin|SortMergeJoin) \[([a-z]+)", found._jdf.queryExecution().executedPlan().toString())
    assert {on for _, on in joins} >= {"key", "place", "run"} and not [on for kind, on in joins if kind == "BroadcastHashJoin" and on in ("key", "place", "run", "node")]


def test_the_fold_of_communities_apart(spark):
    """Communities without a common node, as graphs give them, against the fold over sets; halves of a core that both reach the bound among them."""
    from chronoloom.operators import graph

    rng = random.Random(5)
    rows, groups = [], []
    for seed in range(6):
        nodes = list(range(90))
        for _ in range(seed * 4):
            i, j = rng.randrange(90), rng.randrange(90)
            nodes[i], nodes[j] = nodes[j], nodes[i]
        size = rng.choice([10, 20])
        for c in range(0, 90, size):
            own = set(nodes[c : c + size])
            rows += [(seed, 1.5, seed, node, c) for node in own]
            if len(own) >= 5:
                for g in groups:
                    if len(g[0] & own) / len(g[0] | own) >= 0.5:
                        g[0] &= own
                        g[1].append((seed, c))
                        break
                else:
                    groups.append([own, [(seed, c)]])
    found = graph.recurring_members(spark.createDataFrame(rows, "run long, resolution double, seed int, node long, community long")).collect()
    expected = [(place, ",".join(map(str, sorted(core))), len(held), *h) for place, (core, held) in enumerate(groups) for h in held]
    assert [(r["place"], r["core"], r["seeds_seen"], r["run"], r["community"]) for r in found] == expected
    fold = graph._Fold(1.5, 0.5, 5)
    fold.add(pd.DataFrame({"run": 1, "community": [0] * 9, "node": range(9)}))
    assert fold.cores[0].nbytes == 72


def test_detrending_by_short_rows(spark):
    """Cosines from short rows against those of a row for each term; a document without terms, pairs that share none; no pair is joined a third time."""
    rng = random.Random(12)
    words = ["ab", "cd", "ef", "gh", "ij", "kl", "mn", "op", "qr"]
    texts = [(i, " ".join(rng.choice(words[i % 3 * 3 :][: 2 + i % 5]) for _ in range(rng.randint(0, 12))), 1700 + i * 37 % 90) for i in range(40)] + [(40, None, 1711), (41, "zz zz", 1800)]
    docs = spark.createDataFrame(texts, "id long, text string, year int")
    pairs = spark.createDataFrame([(i, j) for i in range(42) for j in range(0, 43, 5) if i != j], "from_id long, to_id long")
    vecs, idf = V.term_vectors(docs, "id", "text", D.settle)
    found = V.detrended_products(vecs, idf, docs.select("id", "year"), pairs, "id", D.settle)
    expected = V.detrended_cosine(V.weights_of(vecs, idf, "id"), docs.select("id", "year"), pairs, "id")
    of = lambda rows: {(r["from_id"], r["to_id"]): r["cosine"] for r in rows.collect()}
    assert of(found) == {p: pytest.approx(c, abs=1e-9) for p, c in of(expected).items()} and found.count() == expected.count()
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Join" in line and re.search("(from|to)_id", line)]
