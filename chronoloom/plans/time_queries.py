"""Snapshots, lineage, null models, term series and what the pages show of them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import consensus as C
from ..operators import communities as M
from ..operators import graph as G
from ..operators import knn as K
from ..operators import layout
from ..operators import lineage as L
from ..operators import nullmodels as N
from ..operators import pairblocks as B
from ..operators import pairsums as P
from ..operators import series as S
from ..operators import vectors as V
from ..sources.fixtures import table, view, with_views
from ..sources.tables import settle
from .base import query
from .vector_queries import SEEDS, near, near_graph, near_sql, sweep

#: Draws of a null model, as many as published results were taken with.
TRIALS = 3000
ERAS = [("early", 1660, 1750), ("middle", 1750, 1840), ("late", 1840, 1890), ("last", 1890, 1930)]
PANELS = [1700, 1750, 1800, 1850, 1900, 1928]


def _members(spark, sf_dir):
    return view(spark, sf_dir, "vecs").select("book_id", "label", "year")


def _followed(spark, sf_dir):
    """Communities of each year's own graph of nearest neighbours, and their lineage."""
    return L.snapshot_lineage(_lives(spark, sf_dir), _members(spark, sf_dir), settle)


_LIVES = (
    ", bt AS (SELECT *, list(yb) OVER (PARTITION BY src ORDER BY sim DESC, dst ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM sm), "
    "lv AS (SELECT src, dst, greatest(ya, yb) AS start, CASE WHEN len(before) >= 6 THEN list_sort(before)[6] END AS stop FROM bt), "
    "al AS (SELECT * FROM lv WHERE stop IS NULL OR start < stop)"
)
_YEARS = "ys AS (SELECT DISTINCT year AS snapshot FROM vecs)"


def _grown(tail: str, more: str = "", of: str = "SELECT 0 AS g, 6 AS k, src, dst, sim, ya, yb FROM sm", before: str = "") -> str:
    """of: the neighbours (g: which timeline, k: neighbours that count).  Tables mb (memberships), li (lineage), tl (timeline)."""
    return near_sql(
        tail,
        f"{before}, sg AS ({of}), "
        "bt AS (SELECT *, list(yb) OVER (PARTITION BY g, src ORDER BY sim DESC, dst ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM sg), "
        "al AS MATERIALIZED (SELECT * FROM (SELECT g, src, dst, greatest(ya, yb) AS start, CASE WHEN len(before) >= k THEN list_sort(before)[k] END AS stop FROM bt) WHERE stop IS NULL OR start < stop), "
        + _YEARS
        + ", ll AS MATERIALIZED (SELECT DISTINCT CAST(g * 100000 + snapshot AS BIGINT) AS run, least(src, dst) AS a, greatest(src, dst) AS b FROM al JOIN ys ON start <= snapshot AND (stop IS NULL OR snapshot < stop)), "
        "lg AS (SELECT DISTINCT run, CAST(1 AS DOUBLE) AS resolution, 42 AS seed FROM ll), " + M.rounds_sql("ll", "lg", L.ROUNDS, L.LEVELS) + ", "
        "mb AS MATERIALIZED (SELECT CAST(run // 100000 AS INTEGER) AS g, CAST(run % 100000 AS INTEGER) AS snapshot, community AS label, node AS book_id FROM lv QUALIFY count(*) OVER (PARTITION BY run, community) >= 3), "
        "od AS (SELECT snapshot, row_number() OVER (ORDER BY snapshot) AS t FROM ys), "
        "mt AS (SELECT g, t, snapshot, label, book_id, count(*) OVER (PARTITION BY g, t, label) AS n FROM mb JOIN od USING (snapshot)), "
        "li AS MATERIALIZED (SELECT c.g, c.snapshot, c.t, p.label AS prev, c.label AS curr, count(*) / CAST(p.n + c.n - count(*) AS DOUBLE) AS jaccard FROM mt c JOIN mt p ON p.g = c.g AND p.t = c.t - 1 AND p.book_id = c.book_id GROUP BY c.g, c.snapshot, c.t, p.label, c.label, p.n, c.n HAVING count(*) / CAST(p.n + c.n - count(*) AS DOUBLE) >= 0.3), "
        "nw AS (SELECT g, snapshot, count(*) AS n_communities, count(*) FILTER (k IS NULL) AS births, count(*) FILTER (k > 1) AS merges FROM (SELECT DISTINCT g, snapshot, label FROM mb) LEFT JOIN (SELECT g, snapshot, curr AS label, count(*) AS k FROM li GROUP BY ALL) USING (g, snapshot, label) GROUP BY g, snapshot), "
        "ch AS (SELECT g, snapshot, count(*) FILTER (k > 1) AS splits FROM (SELECT g, snapshot, prev, count(*) AS k FROM li GROUP BY ALL) GROUP BY g, snapshot), "
        "tl AS MATERIALIZED (SELECT g, snapshot AS year, coalesce(n_communities, 0) AS n_communities, coalesce(births, 0) AS births, coalesce(splits, 0) AS splits, coalesce(merges, 0) AS merges FROM ys CROSS JOIN (SELECT DISTINCT g FROM sg) LEFT JOIN nw USING (g, snapshot) LEFT JOIN ch USING (g, snapshot))" + more,
    )


@query(_grown("SELECT snapshot, CAST(t AS INTEGER) AS t, prev, curr, round(jaccard, 6) AS jaccard FROM li"))
def lineage_jaccard(spark, sf_dir):
    return _followed(spark, sf_dir)[1].withColumn("jaccard", F.round("jaccard", 6))


def _timeline(spark, sf_dir):
    return L.events(*_followed(spark, sf_dir), _members(spark, sf_dir))


@query(_grown("SELECT year, n_communities, births, splits, merges, births + splits + merges AS mutations FROM tl"))
def mutation_timeline(spark, sf_dir):
    return _timeline(spark, sf_dir)


@query(_grown("SELECT year, CAST(sum(births) OVER w AS BIGINT) AS cum_births, CAST(sum(splits) OVER w AS BIGINT) AS cum_splits, CAST(sum(merges) OVER w AS BIGINT) AS cum_merges, max(n_communities) OVER w AS max_n_communities FROM tl WINDOW w AS (ORDER BY year ROWS UNBOUNDED PRECEDING)"))
def ledger_cumsum(spark, sf_dir):
    return L.running(_timeline(spark, sf_dir), "year", ["births", "splits", "merges"], ["n_communities"])


@query(_grown("SELECT era, CAST(sum(births) AS BIGINT) AS births, CAST(sum(splits) AS BIGINT) AS splits, CAST(sum(merges) AS BIGINT) AS merges, round(sum(splits) / CAST(greatest(sum(merges), 1) AS DOUBLE), 6) AS ratio FROM tl JOIN er ON year >= lo AND year < hi GROUP BY era", ", er(era, lo, hi) AS (VALUES " + ", ".join(f"('{n}', {a}, {b})" for n, a, b in ERAS) + ")"))
def era_totals(spark, sf_dir):
    return L.era_totals(_timeline(spark, sf_dir), ERAS).withColumn("ratio", F.round("ratio", 6))


#: Permutations that shuffled_year_null is registered with; each costs a whole timeline.
SHUFFLES = 4
_SHUFFLED = (
    f", tr AS (SELECT CAST(range AS INTEGER) AS trial FROM range({SHUFFLES})), bk AS (SELECT row_number() OVER (ORDER BY book_id) AS r, year FROM vecs), "
    "sh AS (SELECT trial, book_id, row_number() OVER (PARTITION BY trial ORDER BY md5(concat_ws(':', '7', CAST(trial AS VARCHAR), CAST(book_id AS VARCHAR))), book_id) AS r FROM vecs, tr), "
    "pm AS MATERIALIZED (SELECT trial + 1 AS trial, sh.book_id, bk.year FROM sh JOIN bk USING (r) UNION ALL SELECT 0, book_id, year FROM vecs)"
)
_EVENTS = ("births", "splits", "merges", "mutations")


@query(
    _grown(
        "SELECT kind, o.n AS observed, round(avg(s.n), 6) AS mean, round(stddev_pop(s.n), 6) AS deviation, round((o.n - avg(s.n)) / nullif(stddev_pop(s.n), 0), 4) AS z, count(*) AS trials FROM ev o JOIN ev s USING (kind) WHERE o.g = 0 AND s.g > 0 GROUP BY kind, o.n",
        ", ev AS (SELECT g, unnest(['births', 'splits', 'merges', 'mutations']) AS kind, CAST(unnest([sum(births), sum(splits), sum(merges), sum(births + splits + merges)]) AS BIGINT) AS n FROM tl GROUP BY g)",
        "SELECT p.trial AS g, 6 AS k, src, dst, sim, p.year AS ya, q.year AS yb FROM sm JOIN pm p ON p.book_id = src JOIN pm q ON q.book_id = dst AND q.trial = p.trial",
        _SHUFFLED,
    )
)
def shuffled_year_null(spark, sf_dir, trials: int = SHUFFLES):
    """The events of the whole timeline against those under permutations of the years over the books."""
    books = view(spark, sf_dir, "vecs")
    years = settle(L.shuffled_years(books, trials, 7))
    vectors = books.select("book_id", "embedding").join(years, "book_id")
    lives = K.lifetimes_of_orders(vectors, "book_id", "embedding", "years", settle)
    groups = spark.range(trials + 1).select(F.col("id").cast("int").alias("trial"))
    found = L.snapshot_lineage(lives, _members(spark, sf_dir), settle, by="trial")
    return N.events_z(L.events(*found, _members(spark, sf_dir), "trial", groups), list(_EVENTS))


def _lives(spark, sf_dir):
    return K.lifetimes(view(spark, sf_dir, "vecs"), "book_id", "embedding", "year", settle)


@query(near_sql("SELECT * FROM al", _LIVES))
def snapshot_edge_intervals(spark, sf_dir):
    return _lives(spark, sf_dir)


@query(near_sql("SELECT y AS year, CAST((SELECT count(*) FROM al WHERE start <= y AND (stop IS NULL OR y < stop)) AS BIGINT) AS n FROM (SELECT start AS y FROM al UNION SELECT stop FROM al WHERE stop IS NOT NULL)", _LIVES))
def snapshot_edge_counts(spark, sf_dir):
    return L.live_counts(_lives(spark, sf_dir))


_TURN = 1890


@query(
    _grown(
        f"SELECT CAST(g AS INTEGER) AS k, before, after, splits, merges, round((after / greatest(last - {_TURN} + 1, 1)) / greatest(before / greatest({_TURN} - first, 1), 1e-9), 2) AS ratio FROM (SELECT g, CAST(coalesce(sum(births + splits + merges) FILTER (year < {_TURN}), 0) AS BIGINT) AS before, CAST(coalesce(sum(births + splits + merges) FILTER (year >= {_TURN}), 0) AS BIGINT) AS after, CAST(sum(splits) AS BIGINT) AS splits, CAST(sum(merges) AS BIGINT) AS merges, min(year) AS first, max(year) AS last FROM tl GROUP BY g)",
        of="SELECT k AS g, k, src, dst, sim, ya, yb FROM sm, (VALUES (4), (6), (8), (10)) x(k)",
    )
)
def timeline_k_sweep(spark, sf_dir):
    """Of the yearly graphs of 4, 6, 8 and 10 neighbours: mutations before a year and from it on, and the ratio of their yearly rates."""
    lives = K.lifetimes_of_ks(view(spark, sf_dir, "vecs"), "book_id", "embedding", "year", settle, [4, 6, 8, 10])
    years = _members(spark, sf_dir)
    found = L.events(*L.snapshot_lineage(lives, years, settle, by="k"), years, "k", spark.createDataFrame([(k,) for k in (4, 6, 8, 10)], "k int"))
    early = F.col("year") < _TURN
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("mutations"))), F.lit(0)).alias
    spans = found.groupBy("k").agg(total(early)("before"), total(~early)("after"), F.min("year").alias("first"), F.max("year").alias("last"), F.sum("splits").alias("splits"), F.sum("merges").alias("merges"))
    rate = (F.col("after") / F.greatest(F.col("last") - _TURN + 1, F.lit(1))) / F.greatest(F.col("before") / F.greatest(_TURN - F.col("first"), F.lit(1)), F.lit(1e-9))
    return spans.select("k", "before", "after", "splits", "merges", F.round(rate, 2).alias("ratio"))


# -- communities and null models

@query(with_views("SELECT label, n, year_min, year_max, round(sd, 6) AS year_std, list_sort(ys)[least(4, n)] AS birth_year FROM (SELECT label, count(*) AS n, min(year) AS year_min, max(year) AS year_max, stddev_pop(year) AS sd, list(year) AS ys FROM vecs GROUP BY label) WHERE n >= 4", "vecs"))
def community_summary(spark, sf_dir):
    """The spread of each community, and the year of its fourth book."""
    members = _members(spark, sf_dir)
    fourth = C.value_places(members, ["label"], "year").where(F.col("upto") >= F.least(F.col("total"), F.lit(4))).groupBy("label").agg(F.min("year").alias("birth_year"))
    found = members.groupBy("label").agg(F.count("*").alias("n"), F.min("year").alias("year_min"), F.max("year").alias("year_max"), F.round(F.stddev_pop("year"), 6).alias("year_std"))
    return found.where("n >= 4").join(fourth, "label")


@query(with_views(", g AS (SELECT *, year - lag(year) OVER (PARTITION BY label ORDER BY year, book_id) AS gap FROM vecs) SELECT label, count(*) AS n, CAST(floor(median(year)) AS INTEGER) AS year_median, max(gap) AS largest_gap, round(stddev_pop(year), 1) AS year_std, array_to_string(list_slice(list(book_id ORDER BY year, book_id), 1, 5), ',') AS exemplars FROM g GROUP BY label", "vecs").replace(") ,", "),"))
def community_describe(spark, sf_dir):
    return L.describe(_members(spark, sf_dir))


_CONC = (
    f", tr AS (SELECT CAST(range AS INTEGER) AS trial FROM range({TRIALS})), rk AS (SELECT trial, CAST(year AS DOUBLE) AS y, row_number() OVER (PARTITION BY trial ORDER BY md5(concat_ws(':', '42', CAST(trial AS VARCHAR), CAST(book_id AS VARCHAR))), book_id) AS r FROM vecs, tr), "
    "ow AS (SELECT label, count(*) AS n, stddev_pop(year) AS sigma FROM vecs GROUP BY label), "
    "nl AS (SELECT n, avg(sd) AS mean, stddev_pop(sd) AS dev FROM (SELECT n, trial, stddev_pop(y) AS sd FROM (SELECT DISTINCT n FROM ow) JOIN rk ON r <= n GROUP BY n, trial) GROUP BY n), "
    "cz AS (SELECT label, ow.n, sigma, (sigma - mean) / dev AS z FROM ow JOIN nl ON ow.n = nl.n)"
)
#: The same with draws from the runs of fewer orders.
_RUNS = (
    ", ow AS (SELECT label, count(*) AS n, stddev_pop(year) AS sigma FROM vecs GROUP BY label), nb AS (SELECT count(*) AS m FROM vecs), "
    f"tr AS (SELECT unnest(range(CAST(ceil({TRIALS} / floor(m / (SELECT max(n) FROM ow))) AS BIGINT))) AS trial FROM nb), "
    "rk AS MATERIALIZED (SELECT trial, row_number() OVER w AS r, sum(CAST(year AS BIGINT)) OVER w AS s, sum(CAST(year AS BIGINT) * year) OVER w AS ss FROM vecs, tr WINDOW w AS (PARTITION BY trial ORDER BY md5(concat_ws(':', '42', CAST(trial AS VARCHAR), CAST(book_id AS VARCHAR))), book_id ROWS UNBOUNDED PRECEDING)), "
    f"dr AS (SELECT n, i // (m // n) AS trial, (i % (m // n)) * n AS lo FROM (SELECT DISTINCT n FROM ow), nb, range({TRIALS}) x(i)), "
    "sp AS (SELECT d.n, CAST(b.s - coalesce(a.s, 0) AS DOUBLE) AS s, CAST(b.ss - coalesce(a.ss, 0) AS DOUBLE) AS ss FROM dr d JOIN rk b ON b.trial = d.trial AND b.r = d.lo + d.n LEFT JOIN rk a ON a.trial = d.trial AND a.r = d.lo), "
    "nl AS (SELECT n, avg(sd) AS mean, stddev_pop(sd) AS dev FROM (SELECT n, sqrt(greatest(ss / n - (s / n) * (s / n), 0)) AS sd FROM sp) GROUP BY n), "
    "cz AS (SELECT label, ow.n, sigma, (sigma - mean) / dev AS z FROM ow JOIN nl ON ow.n = nl.n)"
)


def _conc_sql(tail: str, null: str = _CONC) -> str:
    return with_views(null + " " + tail, "vecs").replace(") ,", "),")


def _conc(spark, sf_dir):
    return N.concentration(_members(spark, sf_dir), TRIALS)


@query(_conc_sql("SELECT label, n, round(sigma, 6) AS sigma, round(z, 4) AS z FROM cz"))
def concentration_z(spark, sf_dir):
    return _conc(spark, sf_dir).select("label", "n", F.round("sigma", 6).alias("sigma"), F.round("z", 4).alias("z"))


@query(_conc_sql("SELECT label, n, round(z, 4) AS z, z <= -2.0 AS emergent, year_min, year_max FROM cz JOIN (SELECT label, min(year) AS year_min, max(year) AS year_max FROM vecs GROUP BY label) USING (label)"))
def emergent(spark, sf_dir):
    """Which communities are concentrated in time."""
    spans = _members(spark, sf_dir).groupBy("label").agg(F.min("year").alias("year_min"), F.max("year").alias("year_max"))
    return _conc(spark, sf_dir).join(spans, "label").select("label", "n", F.round("z", 4).alias("z"), (F.col("z") <= -2.0).alias("emergent"), "year_min", "year_max")


_LIMITS = ", ".join(f"({n}, {N.bonferroni_z(n)!r})" for n in range(1, 101))


@query(_conc_sql(f"SELECT label, round(z, 4) AS z, z <= (SELECT cut FROM (VALUES {_LIMITS}) l(tests, cut) WHERE tests = (SELECT count(*) FROM cz)) AS significant FROM cz"))
def bonferroni(spark, sf_dir):
    """Concentration after correction for as many tests as there are labels (the SQL knows the limits up to a hundred)."""
    found = settle(_conc(spark, sf_dir))
    limit = found.agg(F.count("*").alias("tests")).select(N.bonferroni_limit(F.greatest("tests", F.lit(1))).alias("cut"))
    return found.join(F.broadcast(limit)).select("label", F.round("z", 4).alias("z"), (F.col("z") <= F.col("cut")).alias("significant"))  # one row


_P = "p AS (SELECT c_custkey, abs(c_acctbal) / 100000 AS p FROM customer), r AS (SELECT *, row_number() OVER (ORDER BY p, c_custkey) AS k, count(*) OVER () AS m FROM p)"


@query(f"WITH {_P} SELECT c_custkey, coalesce(p <= (SELECT max(p) FROM r WHERE p <= 0.05 * k / m), FALSE) AS discovery FROM r")
def benjamini_hochberg(spark, sf_dir):
    tests = table(spark, sf_dir, "customer").select("c_custkey", (F.abs("c_acctbal") / 100000).alias("p"))
    return N.benjamini_hochberg(tests, "p").select("c_custkey", "discovery")


@query()
def subcluster_significance(spark, sf_dir):
    """Of each resolution, the groups of communities that return across seeds: the representative, the spread of z and the corrected verdict.

    Each different set of books is tested once.
    """
    found = settle(sweep(spark, sf_dir))
    groups = settle(G.recurring_members(found))
    z = N.set_concentration(found.join(groups.select("run", "community").distinct().hint("merge"), ["run", "community"], "left_semi"), _members(spark, sf_dir), TRIALS)
    rows = N.recurring_significance(groups, settle(z), SEEDS)
    return rows.select("resolution", "run", "community", "n", *(F.round(c, 4).alias(c) for c in ("z_median", "z_min", "z_max")), "seeds_seen", "tests", "stable", "significant_raw", "significant")


# -- influence

def _authors(spark, sf_dir):
    """Authors with the unit vector v."""
    who = view(spark, sf_dir, "authors").select("author_id", "earliest_year", "form", "n_books", F.col("embedding").cast("array<double>").alias("v"))
    return who.withColumn("v", F.transform("v", lambda x: x / F.greatest(F.sqrt(V.dot(F.col("v"), F.col("v"))), F.lit(1e-9))))


def _edge_columns(pairs, *more):
    """Of rows with both ends' columns: what an edge shows."""
    return pairs.select(F.col("from_author_id").alias("from_id"), F.col("to_author_id").alias("to_id"), *more, (F.col("from_form") == F.col("to_form")).alias("same_form"), (F.col("to_earliest_year") - F.col("from_earliest_year")).alias("year_gap"), ((F.col("from_n_books") + F.col("to_n_books")) / 2.0).alias("density"), F.least("from_n_books", "to_n_books").alias("min_books"), *(c for c in pairs.columns if c == "src"))


def _edges(spark, sf_dir):
    """Every pair of authors in the order of their years, with the similarity of their vectors: by products of blocks, and by a join where something is null."""
    who = settle(_authors(spark, sf_dir))
    # a vector with a null or without a number has no product
    whole = F.expr("author_id is not null and earliest_year is not null and form is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null)")
    whole = F.coalesce(whole, F.lit(False))
    known, odd = who.where(whole), who.where(~whole)
    pairs = B.later_pairs(known.select(F.col("author_id").alias("id"), F.col("earliest_year").alias("year"), "v", F.col("form").alias("kind")))
    found = pairs.select("from_id", "to_id", F.col("product").alias("conceptual"), F.col("same").alias("same_form"), F.col("gap").cast("int").alias("year_gap"))
    if odd.isEmpty():
        return found

    def joined(a, b):
        a, b = (x.select(*(F.col(c).alias(f"{s}_{c}") for c in x.columns)) for s, x in (("from", a), ("to", b)))
        return _edge_columns(a.join(b, F.col("from_earliest_year") < F.col("to_earliest_year")), V.dot(F.col("from_v"), F.col("to_v")).alias("conceptual")).select(*found.columns)

    return found.unionByName(joined(odd, who)).unionByName(joined(known, odd))


def _pool(spark, sf_dir, thresholds=None):
    """Moments of all pairs by t: of the authors with at least t books (0: all)."""
    who = _authors(spark, sf_dir)
    t = F.lit(0) if thresholds is None else F.explode(thresholds)
    return P.year_moments(who.select(t.alias("t"), "n_books", F.col("earliest_year").alias("year"), "v").where("t = 0 or n_books >= t"))


_EDGE = (
    ", ad AS (SELECT author_id, earliest_year, form, n_books, CAST(embedding AS DOUBLE[]) AS e FROM authors), "
    "ed AS (SELECT a.author_id AS from_id, b.author_id AS to_id, list_cosine_similarity(a.e, b.e) AS conceptual, a.form = b.form AS same_form, b.earliest_year - a.earliest_year AS year_gap, (a.n_books + b.n_books) / 2.0 AS density, least(a.n_books, b.n_books) AS min_books FROM ad a JOIN ad b ON a.earliest_year < b.earliest_year), "
    "dc AS (SELECT ed.*, src FROM ed JOIN pairs USING (from_id, to_id))"
)


def _edge_sql(tail: str, more: str = "") -> str:
    return with_views(_EDGE + more + " " + tail, "authors", "pairs").replace(") ,", "),")


def _documented(spark, sf_dir):
    """The documented pairs that are edges: joins by author of what is small, and one product a pair, its vectors met in groups."""
    who = settle(_authors(spark, sf_dir))
    a, b = (who.drop("v").select(*(F.col(c).alias(f"{s}_{c}") for c in who.columns if c != "v")) for s in ("from", "to"))
    pairs = view(spark, sf_dir, "pairs").withColumnsRenamed({"from_id": "from_author_id", "to_id": "to_author_id"})
    pairs = pairs.join(a, "from_author_id").join(b, "to_author_id").where("from_earliest_year < to_earliest_year")
    return B.pair_products(who.select(F.col("author_id").alias("id"), "v"), _edge_columns(pairs), "conceptual")


@query(_edge_sql("SELECT from_id, to_id, round(conceptual, 4) AS conceptual, same_form, year_gap FROM ed"))
def influence_edges(spark, sf_dir):
    return _edges(spark, sf_dir).select("from_id", "to_id", F.round("conceptual", 4).alias("conceptual"), "same_form", "year_gap")


@query(_edge_sql("SELECT round(corr(conceptual, year_gap), 6) AS r, count(*) AS n FROM ed"))
def signal_corr(spark, sf_dir):
    moments = settle(_pool(spark, sf_dir))  # read by two plans
    x, xx, y, yy, xy, n = (F.col(c) for c in ("total", "squares", "gap", "gap_squares", "gap_products", "n"))
    r = F.try_divide(n * xy - x * y, F.sqrt(F.greatest((n * xx - x * x) * (n * yy - y * y), F.lit(0.0))))
    both = P.pair_moments(moments).join(P.gap_moments(moments).drop("n"), "t")
    none = spark.range(1).select(F.lit(0).alias("t"))
    return none.join(both, "t", "left").select(F.round(F.when(n >= 3, r), 6).alias("r"), F.coalesce(n, F.lit(0).cast("long")).alias("n"))


@query(_edge_sql("SELECT src, count(*) AS n, count(*) FILTER (same_form) AS same_form, round(avg(conceptual) FILTER (same_form), 6) AS same_mean, round(avg(conceptual) FILTER (NOT same_form), 6) AS cross_mean FROM dc GROUP BY src"))
def same_form_rate(spark, sf_dir):
    c = F.col("conceptual")
    return _documented(spark, sf_dir).groupBy("src").agg(F.count("*").alias("n"), F.count_if("same_form").alias("same_form"), F.round(F.avg(F.when(F.col("same_form"), c)), 6).alias("same_mean"), F.round(F.avg(F.when(~F.col("same_form"), c)), 6).alias("cross_mean"))


def _z_sql(value: str, keep: str = "TRUE") -> str:
    return _edge_sql(
        f"SELECT n, round(observed, 6) AS observed, round((observed - m) / (s / sqrt(n) + 1e-12), 4) AS z FROM (SELECT count(*) AS n, avg({value}) AS observed FROM dc WHERE {keep}) a, (SELECT avg({value}) AS m, stddev_pop({value}) AS s FROM ed WHERE {keep2(keep)}) b"
    )


def keep2(keep: str) -> str:
    """The pool's own condition: that of the pairs without their source."""
    return "TRUE" if keep.startswith("src") else keep


def _z(spark, sf_dir, keep: str = "true", thresholds=None):
    """n, observed, z of the documented pairs that `keep` chooses against the pool; thresholds: the numbers of books instead of none."""
    t = F.lit(0) if thresholds is None else F.explode(thresholds)
    rows = _documented(spark, sf_dir).where(keep).withColumn("t", t).where("t = 0 or min_books >= t")
    found = N.moments_z(rows, P.pair_moments(_pool(spark, sf_dir, thresholds)), "conceptual", ["t"])
    return found.select("t", "n", F.round("observed", 6).alias("observed"), F.round("z", 4).alias("z"))


@query(_z_sql("conceptual", "src = 'known'"))
def permutation_z(spark, sf_dir):
    return _z(spark, sf_dir, "src = 'known'").drop("t")


@query(_z_sql("conceptual", "src = 'wikidata'"))
def wikidata_z(spark, sf_dir):
    return _z(spark, sf_dir, "src = 'wikidata'").drop("t")


@query(_z_sql("density"))
def density_z(spark, sf_dir):
    """The mean number of books of a pair's ends against the pool, whose sums follow from counts by year."""
    who = view(spark, sf_dir, "authors").where("earliest_year is not null and n_books is not null")
    sums = [F.count("*").cast("double").alias("k"), F.sum("n_books").cast("double").alias("s"), F.sum(F.col("n_books").cast("double") * F.col("n_books")).alias("ss")]
    years = who.groupBy("earliest_year").agg(*sums).withColumn("sign", F.lit(-1.0)).unionByName(who.agg(*sums).withColumn("earliest_year", F.lit(None).cast("int")).withColumn("sign", F.lit(1.0)), allowMissingColumns=True)
    k, s, ss, sign = F.col("k"), F.col("s"), F.col("ss"), F.col("sign")
    # over all ordered pairs, (a + b) / 2 sums to k s and its square to (k ss + s s) / 2
    pool = years.agg((F.sum(sign * k * k) / 2).alias("n"), (F.sum(sign * k * s) / 2).alias("total"), (F.sum(sign * (k * ss + s * s) / 2) / 2).alias("squares")).withColumn("t", F.lit(0))
    found = N.moments_z(_documented(spark, sf_dir).withColumn("t", F.lit(0)), pool, "density", ["t"])
    return found.select("n", F.round("observed", 6).alias("observed"), F.round("z", 4).alias("z"))


@query(_z_sql("conceptual", "min_books >= 4"))
def well_represented_z(spark, sf_dir):
    return _z(spark, sf_dir, thresholds=F.array(F.lit(4))).drop("t")


_SWEEP = ", tt AS (SELECT CAST(range AS INTEGER) AS t FROM range(1, 7)), a AS (SELECT t, count(*) AS n, avg(conceptual) AS observed FROM dc JOIN tt ON min_books >= t GROUP BY t), b AS (SELECT t, avg(conceptual) AS m, stddev_pop(conceptual) AS s FROM ed JOIN tt ON min_books >= t GROUP BY t)"


@query(_edge_sql("SELECT t, n, round(observed, 6) AS observed, round((observed - m) / (s / sqrt(n) + 1e-12), 4) AS z FROM a JOIN b USING (t) WHERE n >= 5", _SWEEP))
def threshold_sweep(spark, sf_dir):
    return _z(spark, sf_dir, thresholds=F.sequence(F.lit(1), F.lit(6))).where("n >= 5")


@query(_edge_sql("SELECT src, n, CASE WHEN z > 3 THEN 'survives' ELSE 'does not survive' END AS verdict FROM (SELECT src, n, (observed - m) / (s / sqrt(n) + 1e-12) AS z FROM (SELECT src, count(*) AS n, avg(conceptual) AS observed FROM dc GROUP BY src) a, (SELECT avg(conceptual) AS m, stddev_pop(conceptual) AS s FROM ed) b)"))
def influence_verdict(spark, sf_dir):
    rows = _documented(spark, sf_dir).withColumn("t", F.lit(0))
    pool = P.pair_moments(_pool(spark, sf_dir)).join(rows.select("t", "src").distinct(), "t")
    return N.verdict(N.moments_z(rows, pool, "conceptual", ["t", "src"]), "z").select("src", "n", "verdict")


_BINS = ", qs AS (SELECT list_sort(list_distinct(list_transform(quantile_cont(year_gap, [0.0, 0.25, 0.5, 0.75, 1.0]), lambda x: CAST(round(x) AS BIGINT)))) AS q FROM dc), bn AS (SELECT unnest(q) AS lo, unnest(list_slice(q, 2, len(q))) AS hi, q[-1] AS last FROM qs), bb AS (SELECT * FROM bn WHERE hi IS NOT NULL)"


@query(_edge_sql("SELECT lo, hi, count(*) AS n, round(avg(conceptual), 6) AS mean FROM dc JOIN bb ON year_gap >= lo AND (year_gap < hi OR (hi = last AND year_gap = hi)) GROUP BY lo, hi HAVING count(*) >= 5", _BINS))
def quantile_bins(spark, sf_dir):
    """Quartile bins of the year gap of documented pairs: rounded, distinct bounds, the last bin closed."""
    rows = _documented(spark, sf_dir)
    bounds = rows.agg(F.array_sort(F.array_distinct(F.transform(F.percentile("year_gap", [0.0, 0.25, 0.5, 0.75, 1.0]), lambda x: F.round(x).cast("long")))).alias("q"))
    bins = bounds.select("q", F.explode(F.sequence(F.lit(1), F.size("q") - 1)).alias("i")).select(F.get("q", F.col("i") - 1).alias("lo"), F.get("q", F.col("i")).alias("hi"), F.element_at("q", -1).alias("last"))
    inside = (F.col("year_gap") >= F.col("lo")) & ((F.col("year_gap") < F.col("hi")) | ((F.col("hi") == F.col("last")) & (F.col("year_gap") == F.col("hi"))))
    return rows.join(F.broadcast(bins), inside).groupBy("lo", "hi").agg(F.count("*").alias("n"), F.round(F.avg("conceptual"), 6).alias("mean")).where("n >= 5")  # four rows


_EXC = ", bs AS (SELECT min_books, avg(conceptual) AS base FROM ed GROUP BY min_books), ex AS (SELECT min_books AS x, round(conceptual - base, 9) AS y FROM dc JOIN bs USING (min_books)), rx AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM ex)"


@query(_edge_sql("SELECT round(corr(rx, ry), 6) AS rho, count(*) AS n FROM rx", _EXC))
def excess_spearman(spark, sf_dir):
    # pairs whose lesser number of books is m: those of at least m less those of at least the next number
    books = [r["n_books"] for r in view(spark, sf_dir, "authors").select("n_books").distinct().orderBy("n_books").collect()]  # as many as there are numbers of books
    pool = P.pair_moments(_pool(spark, sf_dir, F.array(*map(F.lit, books)))) if books else spark.createDataFrame([], "t int, n long, total double, squares double")
    above = pool.select(F.col("n").alias("n2"), F.col("total").alias("total2"), F.create_map(*(F.lit(x) for pair in zip(books[1:], books) for x in pair))[F.col("t")].alias("t")) if len(books) > 1 else pool.select(F.col("n").alias("n2"), F.col("total").alias("total2"), "t").limit(0)
    n, total = F.col("n") - F.coalesce("n2", F.lit(0)), F.col("total") - F.coalesce("total2", F.lit(0.0))
    base = pool.join(above, "t", "left").select(F.col("t").alias("min_books"), F.try_divide(total, n).alias("base"))
    rows = _documented(spark, sf_dir).join(base, "min_books").select(F.col("min_books").alias("x"), F.round(F.col("conceptual") - F.col("base"), 9).alias("y"))
    ranked = N.average_ranks(N.average_ranks(rows, "x", "rx"), "y", "ry")
    return ranked.agg(F.round(F.corr("rx", "ry"), 6).alias("rho"), F.count("*").alias("n"))


@query()
def excess_spearman_p(spark, sf_dir):
    """excess_spearman with the two-sided p of its rank correlation, for which SQL has no distribution."""
    return excess_spearman(spark, sf_dir).withColumn("p", F.round(N.spearman_p(F.col("rho"), F.col("n")), 4))


# -- term series

_SER = "gd AS (SELECT term, CAST(range AS INTEGER) AS year FROM (SELECT DISTINCT term FROM series), range(1800, 1832)), dn AS (SELECT term, year, coalesce(freq, 0.0) AS freq FROM gd LEFT JOIN series USING (term, year)), smo AS (SELECT *, avg(freq) OVER (PARTITION BY term ORDER BY year ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS smooth FROM dn)"


def _ser_sql(tail: str, more: str = "") -> str:
    return with_views(f", {_SER}{more} {tail}", "series").replace(") ,", "),")


def _dense(spark, sf_dir):
    return S.dense(view(spark, sf_dir, "series"), 1800, 1831)


@query(_ser_sql("SELECT term, year, round(smooth, 6) AS smooth FROM smo"))
def smooth_series(spark, sf_dir):
    return S.smoothed(_dense(spark, sf_dir)).select("term", "year", F.round("smooth", 6).alias("smooth"))


@query(_ser_sql("SELECT term, round(max(smooth), 6) AS peak, arg_min(year, (-smooth, year)) AS peak_year FROM smo GROUP BY term"))
def peaks(spark, sf_dir):
    return S.peaks(S.smoothed(_dense(spark, sf_dir))).withColumn("peak", F.round("peak", 6))


_TAKE = ", pk AS (SELECT *, max(smooth) OVER (PARTITION BY term) AS peak FROM smo), tk AS (SELECT term, year, share, peak, min(CASE WHEN smooth >= share * peak THEN 1 ELSE 0 END) OVER (PARTITION BY term, share ORDER BY year ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS held FROM pk, (VALUES (0.5), (0.8), (0.95)) s(share))"


@query(_ser_sql("SELECT term, CAST(share AS DOUBLE) AS share, min(year) FILTER (held = 1 AND peak > 0) AS takeoff FROM tk GROUP BY term, share", _TAKE))
def takeoff(spark, sf_dir):
    return S.takeoff(S.smoothed(_dense(spark, sf_dir)), [0.5, 0.8, 0.95])


@query(_ser_sql("SELECT term, q25, q50, q75, q75 - q25 AS iqr FROM (SELECT term, min(year) FILTER (c / t >= 0.25) AS q25, min(year) FILTER (c / t >= 0.5) AS q50, min(year) FILTER (c / t >= 0.75) AS q75 FROM (SELECT *, sum(freq) OVER (PARTITION BY term ORDER BY year ROWS UNBOUNDED PRECEDING) AS c, sum(freq) OVER (PARTITION BY term) AS t FROM dn) GROUP BY term)"))
def mass_percentiles(spark, sf_dir):
    return S.mass_years(_dense(spark, sf_dir))


@query(_ser_sql("SELECT term, min(year) FILTER (freq > 0 AND used >= least(5, rest)) AS first FROM (SELECT *, count(*) FILTER (freq > 0) OVER (PARTITION BY term ORDER BY year ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS used, count(*) OVER (PARTITION BY term ORDER BY year ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM dn) GROUP BY term"))
def first_attestation(spark, sf_dir):
    return S.attested(_dense(spark, sf_dir))


@query(_ser_sql("SELECT genre AS term, year, sum(freq) AS freq FROM dn JOIN (VALUES ('buying', 'click'), ('buying', 'purchase'), ('joining', 'signup'), ('joining', 'view')) g(genre, term) USING (term) GROUP BY 1, 2"))
def term_sum(spark, sf_dir):
    genres = spark.createDataFrame([("buying", "click"), ("buying", "purchase"), ("joining", "signup"), ("joining", "view")], "genre string, term string")
    return S.summed(_dense(spark, sf_dir), genres)


@query(_ser_sql("SELECT term, drift, coalesce(term = (SELECT arg_max(term, (drift, term)) FROM df WHERE drift IS NOT NULL), FALSE) AS worst FROM df", _TAKE + ", tf AS (SELECT term, share, min(year) FILTER (held = 1 AND peak > 0) AS y FROM tk GROUP BY term, share), df AS (SELECT a.term, b.y - a.y AS drift FROM tf a JOIN tf b ON a.term = b.term AND a.share = 0.5 AND b.share = 0.8)"))
def label_drift(spark, sf_dir):
    t = S.takeoff(S.smoothed(_dense(spark, sf_dir)), [0.5, 0.8])
    return S.drift(t.where("share = 0.5"), t.where("share = 0.8"), "term", "takeoff")


@query(_ser_sql("SELECT round(CASE WHEN count(*) >= 3 THEN corr(peak, total) END, 6) AS r FROM (SELECT term, max(smooth) AS peak, sum(freq) AS total FROM smo GROUP BY term)"))
def cross_clock_corr(spark, sf_dir):
    rows = S.smoothed(_dense(spark, sf_dir)).groupBy("term").agg(F.max("smooth").alias("peak"), F.sum("freq").alias("total"))
    joined = S.must_match(rows.select("term", "peak"), rows.select("term", "total"), "term")
    return joined.agg(F.round(N.pearson("peak", "total"), 6).alias("r"))


@query(_ser_sql("SELECT kind, key, sum(freq) AS total FROM (SELECT 'term' AS kind, term AS key, freq FROM dn UNION ALL SELECT 'all', 'all', freq FROM dn UNION ALL SELECT 'control', left(term, 1), freq FROM dn) GROUP BY kind, key"))
def series_breakdown(spark, sf_dir):
    rows = _dense(spark, sf_dir)
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), c.alias("key")) for k, c in (("term", F.col("term")), ("all", F.lit("all")), ("control", F.left("term", F.lit(1)))))))
    return rows.withColumn("k", kinds).groupBy("k.kind", "k.key").agg(F.sum("freq").alias("total"))


_FIT = (
    "WITH g AS (SELECT CAST(year - 1659 AS DOUBLE) AS x, CAST(sum(n) OVER (ORDER BY year ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS c FROM (SELECT year, count(*) AS n FROM vecs GROUP BY year)), "
    "f AS (SELECT regr_slope(c, x) AS slope, regr_intercept(c, x) AS intercept, regr_slope(ln(c), ln(x)) AS power, exp(regr_intercept(ln(c), ln(x))) AS scale, var_pop(c) * count(*) AS total FROM g) "
    "SELECT round(first(slope), 6) AS slope, round(first(intercept), 6) AS intercept, round(first(power), 6) AS power, round(first(scale), 6) AS scale, "
    "round(1 - sum((c - slope * x - intercept) ** 2) / first(total), 6) AS r2_line, round(1 - sum((c - scale * x ** power) ** 2) / first(total), 6) AS r2_power FROM g, f"
)


@query(with_views("", "vecs").rstrip() + ", " + _FIT.removeprefix("WITH "))
def curve_fit(spark, sf_dir):
    """A line and a power law through the running number of books, and how much of its variance each explains."""
    yearly = _members(spark, sf_dir).groupBy("year").agg(F.count("*").alias("n"))
    grown = L.running(yearly, "year", ["n"], []).select((F.col("year") - 1659).cast("double").alias("x"), F.col("cum_n").cast("double").alias("c"))
    return S.fits(grown, "x", "c").select(*(F.round(c, 6).alias(c) for c in ("slope", "intercept", "power", "scale", "r2_line", "r2_power")))


# -- what the pages show

@query(with_views("SELECT y.year, l.label, (SELECT count(*) FROM vecs v WHERE v.label = l.label AND v.year <= y.year) AS n, (SELECT count(*) FROM vecs v WHERE v.label = l.label AND v.year <= y.year) >= 3 AS active FROM (SELECT DISTINCT year FROM vecs) y, (SELECT DISTINCT label FROM vecs) l", "vecs"))
def asof_counts(spark, sf_dir):
    return L.as_of_counts(_members(spark, sf_dir), _members(spark, sf_dir))


@query(near_sql("SELECT a, b, greatest(x.year, y.year) AS year, x.label = y.label AS same FROM gr JOIN vecs x ON a = x.book_id JOIN vecs y ON b = y.book_id"))
def edge_birth(spark, sf_dir):
    return L.edge_births(near_graph(spark, sf_dir), _members(spark, sf_dir))


@query(with_views(f", p(panel) AS (VALUES {', '.join(f'({p})' for p in PANELS)}), l AS (SELECT panel, (SELECT count(*) FROM vecs WHERE year <= panel) AS live FROM p) SELECT panel, live, live - coalesce(lag(live) OVER (ORDER BY panel), 0) AS new FROM l", "vecs").replace(") ,", "),"))
def panel_deltas(spark, sf_dir):
    return L.panel_deltas(_members(spark, sf_dir), PANELS)


@query(with_views("SELECT min(year) AS first, (SELECT min(year) FROM vecs WHERE year > (SELECT min(year) FROM vecs)) AS next FROM vecs", "vecs"))
def solo_period(spark, sf_dir):
    return L.solo_period(_members(spark, sf_dir))


@query(with_views("SELECT frame, book_id, round(exp(-(frame - year) / 6.0), 6) AS flash, CAST(round(least(1.0, (frame - year) / 8.0), 6) AS DOUBLE) AS grown FROM vecs, (VALUES (1700), (1800), (1900)) f(frame) WHERE year <= frame", "vecs"))
def frame_state(spark, sf_dir):
    return L.frame_states(_members(spark, sf_dir), "book_id", [1700, 1800, 1900]).select("frame", "book_id", F.round("flash", 6).alias("flash"), F.round("grown", 6).alias("grown"))


@query(_edge_sql("SELECT ed.from_id, ed.to_id, round(conceptual, 4) AS conceptual, v.n IS NOT NULL AS validated FROM ed LEFT JOIN (SELECT from_id, to_id, count(*) AS n FROM pairs GROUP BY 1, 2) v USING (from_id, to_id) WHERE conceptual >= 0.3 OR v.n IS NOT NULL"))
def edge_slider(spark, sf_dir):
    """Edges over a threshold, and all validated ones."""
    proof = settle(_documented(spark, sf_dir).select("from_id", "to_id", "conceptual").dropDuplicates(["from_id", "to_id"]))
    over = B.pairs_from(_ended(spark, sf_dir), 0.3).withColumnRenamed("product", "conceptual").join(proof.select("from_id", "to_id"), ["from_id", "to_id"], "left_anti")
    rows = over.withColumn("validated", F.lit(False)).unionByName(proof.withColumn("validated", F.lit(True)))
    return rows.select("from_id", "to_id", F.round("conceptual", 4).alias("conceptual"), "validated")


def _ended(spark, sf_dir):
    return settle(_authors(spark, sf_dir).select(F.col("author_id").alias("id"), F.col("earliest_year").alias("year"), "v"))


@query(_edge_sql("SELECT from_id, to_id, validated, CAST(k AS INTEGER) AS place, total - 12 AS beyond FROM (SELECT ed.from_id, ed.to_id, v.n IS NOT NULL AS validated, row_number() OVER (PARTITION BY ed.from_id ORDER BY round(conceptual, 9) DESC, ed.to_id) AS k, count(*) OVER (PARTITION BY ed.from_id) AS total FROM ed LEFT JOIN (SELECT from_id, to_id, count(*) AS n FROM pairs GROUP BY 1, 2) v USING (from_id, to_id)) WHERE k <= 12 OR validated"))
def node_focus(spark, sf_dir):
    """Of every author as the focus: the twelve most similar later ones and all validated."""
    who = _ended(spark, sf_dir)
    proof = settle(B.places_of(who, view(spark, sf_dir, "pairs").select("from_id", "to_id").distinct())).withColumn("validated", F.lit(True))
    best = B.best_later(who, 12).join(proof.select("from_id", "to_id", "validated"), ["from_id", "to_id"], "left").withColumn("validated", F.coalesce("validated", F.lit(False)))
    rows = best.unionByName(proof.where("place > 12").select(*best.columns))
    later = B.later_counts(who).select(F.col("id").alias("from_id"), (F.col("later") - 12).alias("beyond"))
    return rows.join(later, "from_id").select("from_id", "to_id", "validated", "place", "beyond")


@query(near_sql("SELECT label, book_id, year, CAST(row_number() OVER (PARTITION BY label ORDER BY coalesce(year, 0), book_id) AS INTEGER) AS place, (SELECT count(*) FROM gr JOIN vecs x ON a = x.book_id JOIN vecs y ON b = y.book_id WHERE x.label = y.label AND x.label = v.label) AS inner_edges FROM vecs v"))
def genre_focus(spark, sf_dir):
    m = _members(spark, sf_dir)
    inner = L.edge_births(near_graph(spark, sf_dir), m).where("same").join(m.select(F.col("book_id").alias("a"), "label"), "a").groupBy("label").agg(F.count("*").alias("k"))
    placed = m.withColumn("place", F.row_number().over(Window.partitionBy("label").orderBy(F.coalesce("year", F.lit(0)), "book_id")))
    return placed.join(inner, "label", "left").select("label", "book_id", "year", "place", F.coalesce("k", F.lit(0)).cast("long").alias("inner_edges"))


@query(_conc_sql(", sn AS (SELECT label, min(year) AS lo, max(year) AS hi FROM vecs GROUP BY label) SELECT label, round(100.0 * (lo - (SELECT min(lo) FROM sn)) / ((SELECT max(hi) FROM sn) - (SELECT min(lo) FROM sn)), 6) AS left_pct, round(greatest(1.5, 100.0 * (hi - lo) / ((SELECT max(hi) FROM sn) - (SELECT min(lo) FROM sn))), 6) AS width_pct, CAST(row_number() OVER (ORDER BY round(z, 6), label) AS INTEGER) AS place FROM sn JOIN cz USING (label)", _RUNS).replace(") , sn", "), sn"))
def genre_rank_bars(spark, sf_dir):
    spans = _members(spark, sf_dir).groupBy("label").agg(F.min("year").alias("lo"), F.max("year").alias("hi")).join(N.concentration_of_runs(_members(spark, sf_dir), TRIALS).select("label", "z"), "label")
    ends = spans.agg(F.min("lo").alias("first"), F.max("hi").alias("last"))
    rows = spans.join(F.broadcast(ends)).withColumn("span", F.col("last") - F.col("first"))  # one row
    return rows.select("label", F.round(100.0 * (F.col("lo") - F.col("first")) / F.col("span"), 6).alias("left_pct"), F.round(F.greatest(F.lit(1.5), 100.0 * (F.col("hi") - F.col("lo")) / F.col("span")), 6).alias("width_pct"), F.row_number().over(Window.orderBy(F.round("z", 6), "label")).alias("place"))


@query(_edge_sql("SELECT (SELECT count(*) FROM authors) AS n_authors, count(*) AS n_edges, min(year_gap) AS min_gap, max(year_gap) AS max_gap, count(*) FILTER (same_form) AS same_form, (SELECT count(*) FROM dc) AS n_documented FROM ed"))
def header_stats(spark, sf_dir):
    who = view(spark, sf_dir, "authors").where("earliest_year is not null")
    years = who.groupBy("earliest_year").agg(F.count("*").alias("k"))
    steps = years.withColumn("gap", F.col("earliest_year") - F.lag("earliest_year").over(Window.orderBy("earliest_year")))  # a row a year
    # pairs in the order of years: half of all ordered pairs less those of one year
    forms = who.where("form is not null").groupBy("form", "earliest_year").agg(F.count("*").alias("k")).groupBy("form").agg(F.sum("k").alias("s"), F.sum(F.col("k") * F.col("k")).alias("kk"))
    edges = steps.agg(((F.sum("k") * F.sum("k") - F.sum(F.col("k") * F.col("k"))) / 2).cast("long").alias("n_edges"), F.min("gap").alias("min_gap"), (F.max("earliest_year") - F.min("earliest_year")).alias("max_gap"))
    edges = edges.join(F.broadcast(forms.agg((F.sum(F.col("s") * F.col("s") - F.col("kk")) / 2).cast("long").alias("same_form"))))  # one row
    authors = view(spark, sf_dir, "authors").agg(F.count("*").alias("n_authors"))
    return edges.join(F.broadcast(authors)).join(F.broadcast(_documented(spark, sf_dir).agg(F.count("*").alias("n_documented"))))  # single rows


@query(_edge_sql("SELECT round(c, 6) AS cut FROM (SELECT conceptual AS c, row_number() OVER (ORDER BY conceptual) - 1 AS i, count(*) OVER () AS n FROM ed) WHERE i = CAST(floor(n * 0.93) AS BIGINT)"))
def pct93_cutoff(spark, sf_dir):
    """The value at 93 per cent of the sorted similarities, by place."""
    return B.value_at(_ended(spark, sf_dir), 0.93).select(F.round("value", 6).alias("cut"))


@query(_edge_sql("SELECT DISTINCT least(from_id, to_id) AS node FROM dc UNION SELECT greatest(from_id, to_id) FROM dc"))
def related_nodes(spark, sf_dir):
    return _documented(spark, sf_dir).select(F.explode(F.array("from_id", "to_id")).alias("node")).distinct()


@query(with_views("SELECT author_id, round(CASE WHEN n > 1 THEN (r - 1) / CAST(n - 1 AS DOUBLE) ELSE 0 END, 6) AS x, CAST(form AS INTEGER) AS band FROM (SELECT author_id, form, row_number() OVER (ORDER BY earliest_year, author_id) AS r, count(*) OVER () AS n FROM authors)", "authors"))
def rank_layout(spark, sf_dir):
    """Places from left to right by year, in bands by form."""
    who = C.places(view(spark, sf_dir, "authors").select("author_id", "form", "earliest_year"), [F.asc("earliest_year"), F.asc("author_id")])
    n = who.agg(F.count("*").alias("n"))
    return who.join(F.broadcast(n)).select("author_id", F.round(F.when(F.col("n") > 1, (F.col("place") - 1) / (F.col("n") - 1)).otherwise(0.0), 6).alias("x"), F.col("form").cast("int").alias("band"))  # one row


@query()
def lane_packing(spark, sf_dir):
    """Labels in the first of four lanes that is free, in order of place; an ordered fold in each band."""
    return layout.lanes(rank_layout(spark, sf_dir), 0.02, 4)
