"""TF-IDF, detrending, similarity and k-nearest-neighbour graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stopwords import ENGLISH
from ..operators import communities as M
from ..operators import graph as G
from ..operators import knn as K
from ..operators import vectors as V
from ..sources.fixtures import table, view, with_views
from ..sources.tables import settle
from .base import query

_STOP = ", ".join(f"'{w}'" for w in ENGLISH)
_TFIDF = (
    f", tk AS (SELECT book_id, unnest(regexp_extract_all(lower(description), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM books), "
    f"tc AS (SELECT book_id, term, count(*) AS tf FROM tk WHERE term NOT IN ({_STOP}) GROUP BY ALL), "
    "nn AS (SELECT count(*) AS n FROM books), "
    "voc AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM tc GROUP BY term HAVING count(*) >= 3 AND count(*) <= 0.4 * (SELECT n FROM nn) ORDER BY cf DESC, term LIMIT 20000), "
    "raw AS (SELECT book_id, tc.term, (1 + ln(tf)) * (ln((1.0 + n) / (1 + df)) + 1) AS w FROM tc JOIN voc USING (term), nn), "
    "wt AS (SELECT book_id, term, w / greatest(sqrt(sum(w * w) OVER (PARTITION BY book_id)), 1e-9) AS w FROM raw) "
)
_PAIR = ", pr AS (SELECT DISTINCT from_id, to_id FROM (SELECT o_custkey % n AS from_id, o_orderkey % n AS to_id FROM orders, (SELECT count(*) AS n FROM documents) x) y WHERE from_id <> to_id) "


def _sql(tail: str, more: str = "") -> str:
    return with_views("", "books").rstrip() + _TFIDF.rstrip() + more.rstrip() + " " + tail


def _weights(spark, sf_dir):
    return V.tfidf(view(spark, sf_dir, "books"), "book_id", "description")


def _pairs(spark, sf_dir):
    n = table(spark, sf_dir, "documents").agg(F.count("*").alias("n"))
    orders = table(spark, sf_dir, "orders").join(F.broadcast(n))  # one row
    return orders.select((F.col("o_custkey") % F.col("n")).alias("from_id"), (F.col("o_orderkey") % F.col("n")).alias("to_id")).where("from_id <> to_id").distinct()


@query(_sql("SELECT book_id, term, round(w, 6) AS w FROM wt"))
def tfidf_weights(spark, sf_dir):
    return _weights(spark, sf_dir).withColumn("w", F.round("w", 6))


@query(_sql("SELECT a.from_id, a.to_id, round(sum(x.w * y.w), 6) AS cosine FROM pr a JOIN wt x ON a.from_id = x.book_id JOIN wt y ON a.to_id = y.book_id AND x.term = y.term GROUP BY ALL", _PAIR))
def tfidf_cosine(spark, sf_dir):
    vectors, idf = V.term_vectors(view(spark, sf_dir, "books"), "book_id", "description", settle)
    return V.vector_products(vectors, idf, _pairs(spark, sf_dir), "book_id").select("from_id", "to_id", F.round("dot", 6).alias("cosine"))


_BETA = ", yc AS (SELECT book_id, year - avg(year) OVER () AS y FROM books), bt AS (SELECT term, sum(w * y) / (SELECT sum(y * y) FROM yc) AS beta FROM wt JOIN yc USING (book_id) GROUP BY term)"


@query(_sql("SELECT term, round(beta * 1000, 6) AS beta FROM bt", _BETA))
def year_trend(spark, sf_dir):
    return V.trend(_weights(spark, sf_dir), view(spark, sf_dir, "books").select("book_id", "year"), "book_id").select("term", F.round(F.col("beta") * 1000, 6).alias("beta"))


@query(
    _sql(
        "SELECT from_id, to_id, round((coalesce(d.dot, 0) - b.y * a.p - a.y * b.p + a.y * b.y * a.bb) / (a.len * b.len), 6) AS cosine FROM pr "
        "JOIN rw a ON from_id = a.book_id JOIN rw b ON to_id = b.book_id LEFT JOIN dd d USING (from_id, to_id)",
        _PAIR + _BETA + ", b2 AS (SELECT sum(beta * beta) AS bb FROM bt), pp AS (SELECT book_id, sum(w * beta) AS p, sum(w * w) AS xx FROM wt JOIN bt USING (term) GROUP BY book_id), "
        "rw AS (SELECT book_id, y, coalesce(p, 0) AS p, bb, greatest(sqrt(greatest(coalesce(xx, 0) - 2 * y * coalesce(p, 0) + y * y * bb, 0)), 1e-9) AS len FROM yc LEFT JOIN pp USING (book_id), b2), "
        "dd AS (SELECT from_id, to_id, sum(x.w * z.w) AS dot FROM pr JOIN wt x ON from_id = x.book_id JOIN wt z ON to_id = z.book_id AND x.term = z.term GROUP BY ALL)",
    )
)
def detrended_cosine(spark, sf_dir):
    years = view(spark, sf_dir, "books").select("book_id", "year")
    vectors, idf = V.term_vectors(view(spark, sf_dir, "books"), "book_id", "description", settle)
    return V.detrended_products(vectors, idf, years, _pairs(spark, sf_dir), "book_id", settle).withColumn("cosine", F.round("cosine", 6))


@query(
    _sql(
        "SELECT author, term, mean, CAST(place AS INTEGER) AS place FROM (SELECT author, term, mean, row_number() OVER (PARTITION BY author ORDER BY mean DESC, term) AS place FROM (SELECT author, term, round(sum(w) / any_value(size), 9) AS mean FROM wt JOIN books USING (book_id) JOIN (SELECT author, count(*) AS size FROM books GROUP BY author) s USING (author) GROUP BY author, term)) WHERE place <= 10"
    )
)
def cluster_top_terms(spark, sf_dir):
    return V.top_terms(settle(_weights(spark, sf_dir)), view(spark, sf_dir, "books").select("book_id", "author"), "book_id", "author")


@query(with_views("SELECT from_id, to_id, src, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine FROM pairs JOIN authors a ON from_id = a.author_id JOIN authors b ON to_id = b.author_id", "authors", "pairs"))
def pair_cosine(spark, sf_dir):
    who = view(spark, sf_dir, "authors").select("author_id", "embedding")
    a, b = who.toDF("from_id", "va"), who.toDF("to_id", "vb")
    return view(spark, sf_dir, "pairs").join(a, "from_id").join(b, "to_id").select("from_id", "to_id", "src", F.round(V.cosine(F.col("va"), F.col("vb")), 6).alias("cosine"))


NEAR = (
    "vd AS (SELECT book_id, label, year, CAST(embedding AS DOUBLE[]) AS e FROM vecs), "
    "sm AS (SELECT a.book_id AS src, b.book_id AS dst, round(list_cosine_similarity(a.e, b.e), 12) AS sim, a.year AS ya, b.year AS yb FROM vd a JOIN vd b ON a.book_id <> b.book_id), "
    "nr AS (SELECT src, dst, sim FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS k FROM sm) WHERE k <= 6), "
    "gr AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM nr), bw AS (SELECT a AS u, b AS v FROM gr UNION ALL SELECT b, a FROM gr)"
)


def near_sql(tail: str, more: str = "") -> str:
    return with_views("", "vecs").rstrip() + ", " + NEAR + more + " " + tail


def near(spark, sf_dir, k: int = 6):
    return K.nearest(view(spark, sf_dir, "vecs"), "book_id", "embedding", settle, k)


def near_graph(spark, sf_dir):
    return K.undirected(near(spark, sf_dir))


@query(near_sql("SELECT src, dst, round(sim, 6) AS sim FROM nr"))
def knn_edges(spark, sf_dir):
    return near(spark, sf_dir).select("src", "dst", F.round("sim", 6).alias("sim"))


@query(near_sql("SELECT a, b FROM gr"))
def knn_graph(spark, sf_dir):
    return near_graph(spark, sf_dir)


@query(near_sql("SELECT round(100.0 * avg(CASE WHEN x.label = y.label THEN 1 ELSE 0 END), 1) AS pct FROM gr JOIN vecs x ON a = x.book_id JOIN vecs y ON b = y.book_id"))
def author_confound_pct(spark, sf_dir):
    who = view(spark, sf_dir, "vecs").select("book_id", "label")
    ends = near_graph(spark, sf_dir).join(who.toDF("a", "la"), "a").join(who.toDF("b", "lb"), "b")
    return ends.agg(F.round(100 * F.avg((F.col("la") == F.col("lb")).cast("int")), 1).alias("pct"))


@query(near_sql("SELECT u AS node, count(*) AS degree FROM bw GROUP BY u"))
def degree(spark, sf_dir):
    return G.degrees(near_graph(spark, sf_dir))


_CC = (
    ", dg AS (SELECT u AS node, count(*) AS d FROM bw GROUP BY u), tr AS (SELECT x.a, x.b, z.b AS c FROM gr x JOIN gr z ON x.b = z.a JOIN gr y ON y.a = x.a AND y.b = z.b), "
    "tn AS (SELECT node, count(*) AS t FROM (SELECT a AS node FROM tr UNION ALL SELECT b FROM tr UNION ALL SELECT c FROM tr) GROUP BY node), "
    "cc AS (SELECT node, d AS degree, CAST(coalesce(t, 0) AS BIGINT) AS triangles, CASE WHEN d < 2 THEN 0.0 ELSE 2.0 * coalesce(t, 0) / (d * (d - 1)) END AS coefficient FROM dg LEFT JOIN tn USING (node))"
)


@query(near_sql("SELECT node, degree, triangles, CAST(round(coefficient, 6) AS DOUBLE) AS coefficient FROM cc", _CC))
def clustering_coefficient(spark, sf_dir):
    return G.clustering(settle(near_graph(spark, sf_dir))).withColumn("coefficient", F.round("coefficient", 6))


@query(near_sql("SELECT a, b FROM gr WHERE a IN (SELECT node FROM cc WHERE coefficient > 0.1) AND b IN (SELECT node FROM cc WHERE coefficient > 0.1)", _CC))
def prune_low_clustering(spark, sf_dir):
    return G.prune(settle(near_graph(spark, sf_dir)), 0.1)  # read by several plans


_TIGHT = ", tg AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM nr WHERE sim >= 0.38), bt AS (SELECT a AS u, b AS v FROM tg UNION ALL SELECT b, a FROM tg)"


def tight(spark, sf_dir):
    return K.undirected(near(spark, sf_dir).where("sim >= 0.38"))


@query(near_sql("SELECT book_id FROM vecs WHERE book_id IN (SELECT u FROM bt)", _TIGHT))
def isolates_removed(spark, sf_dir):
    return G.without_isolates(view(spark, sf_dir, "vecs").select("book_id"), tight(spark, sf_dir), "book_id")


@query(near_sql("SELECT node, min(seen) AS component FROM rc GROUP BY node", _TIGHT + ", rc AS (SELECT * FROM walk)").replace("WITH ", "WITH RECURSIVE ", 1).replace(", rc AS (SELECT * FROM walk)", ", rc(node, seen) AS (SELECT DISTINCT u, u FROM bt UNION SELECT bt.v, rc.seen FROM rc JOIN bt ON rc.node = bt.u)"))
def components(spark, sf_dir):
    return G.components(tight(spark, sf_dir), settle)


_LP = "".join(
    f", l{i + 1} AS (SELECT u AS node, arg_min(label, (-n, label)) AS label FROM (SELECT u, label, count(*) AS n FROM bw JOIN l{i} ON v = node GROUP BY u, label) GROUP BY u)" for i in range(3)
)


@query(near_sql("SELECT node, label FROM l3", ", l0 AS (SELECT DISTINCT u AS node, u AS label FROM bw)" + _LP))
def label_prop(spark, sf_dir):
    return G.label_propagation(near_graph(spark, sf_dir), 3, settle)


#: Resolutions and seeds of a sweep.
RESOLUTIONS, SEEDS = (1.0, 1.25, 1.5, 1.75, 2.0, 2.5, 3.0), 10

_ONE = ", lg AS (SELECT CAST(0 AS BIGINT) AS run, CAST(1 AS DOUBLE) AS resolution, 42 AS seed), ll AS (SELECT CAST(0 AS BIGINT) AS run, a, b FROM gr), "
_SWEEP = f", lg AS (SELECT CAST({SEEDS} * i + s AS BIGINT) AS run, CAST(r AS DOUBLE) AS resolution, CAST(s AS INTEGER) AS seed FROM (VALUES {', '.join(f'({i}, {r})' for i, r in enumerate(RESOLUTIONS))}) x(i, r), range({SEEDS}) y(s)), ll AS (SELECT run, a, b FROM gr, lg), "


def _one(spark, sf_dir):
    """The whole graph as one run: links and setting."""
    links = near_graph(spark, sf_dir).select(F.lit(0).cast("long").alias("run"), "a", "b")
    return links, spark.range(1).select(F.col("id").alias("run"), F.lit(1.0).alias("resolution"), F.lit(42).alias("seed"))


@query(near_sql("SELECT node, community FROM lv", _ONE + M.rounds_sql("ll", "lg")))
def louvain_communities(spark, sf_dir):
    """Local moves by modularity and contraction, over the whole graph by joins."""
    return M.louvain(*_one(spark, sf_dir), settle).select("node", "community")


@query(near_sql("SELECT node, comm FROM lvs0_1", _ONE + M.rounds_sql("ll", "lg", 1, 1)))
def louvain_round(spark, sf_dir):
    """Where one round of moves takes the nodes."""
    return M.first_round(*_one(spark, sf_dir), settle).select("node", "comm")


@query(
    near_sql(
        "SELECT count(*) AS communities, round(sum(inside / m2 - (total / m2) * (total / m2)), 6) AS modularity FROM (SELECT x.community, CAST(count(*) AS DOUBLE) AS total, CAST(count(*) FILTER (x.community = y.community) AS DOUBLE) AS inside FROM bw JOIN lv x ON x.node = u JOIN lv y ON y.node = v GROUP BY x.community), (SELECT CAST(count(*) AS DOUBLE) AS m2 FROM bw)",
        _ONE + M.rounds_sql("ll", "lg"),
    )
)
def louvain_modularity(spark, sf_dir):
    """How many communities there are, and their modularity."""
    links, graphs = _one(spark, sf_dir)
    links = settle(links)
    return M.modularity(links, M.louvain(links, graphs, settle), graphs).select("communities", F.round("modularity", 6).alias("modularity"))


def sweep(spark, sf_dir):
    """run, resolution, seed, node, community of every resolution and seed, all at once."""
    settings = spark.createDataFrame([(SEEDS * i + s, r, s) for i, r in enumerate(RESOLUTIONS) for s in range(SEEDS)], "run long, resolution double, seed int")
    return M.louvain_of_many(settle(near_graph(spark, sf_dir)), settings, settle).join(F.broadcast(settings), "run").select("run", "resolution", "seed", "node", "community")


@query(near_sql("SELECT run, resolution, seed, node, community FROM lv JOIN lg USING (run)", _SWEEP + M.rounds_sql("ll", "lg")))
def louvain_sweep(spark, sf_dir):
    return sweep(spark, sf_dir)


@query()
def recurring_groups(spark, sf_dir):
    return G.recurring(sweep(spark, sf_dir), SEEDS)


_OV = "sz AS (SELECT book_id, count(*) AS n FROM baskets GROUP BY book_id), ov AS (SELECT x.book_id AS a, y.book_id AS b, count(*) AS shared FROM baskets x JOIN baskets y ON x.genre = y.genre AND x.book_id < y.book_id GROUP BY 1, 2)"


@query(with_views(f", {_OV} SELECT a, b, shared, round(shared / CAST(least(p.n, q.n) AS DOUBLE), 6) AS overlap FROM ov JOIN sz p ON a = p.book_id JOIN sz q ON b = q.book_id WHERE shared / CAST(least(p.n, q.n) AS DOUBLE) >= 0.5", "baskets").replace(") ,", "),"))
def genre_overlap_edges(spark, sf_dir):
    return G.overlaps(view(spark, sf_dir, "baskets"), "book_id", "genre", settle).withColumn("overlap", F.round("overlap", 6))


_FREQ = "fr AS (SELECT genre, count(*) * (count(*) - 1) AS n FROM baskets GROUP BY genre HAVING count(*) > 1)"


@query(with_views(f", {_FREQ} SELECT genre, n FROM fr WHERE n > (SELECT median(n) - stddev_samp(n) FROM fr) AND n < (SELECT median(n) + stddev_samp(n) FROM fr)", "baskets").replace(") ,", "),"))
def genre_edges_band(spark, sf_dir):
    """Genres whose number of directed edges lies strictly within a deviation of the median; edges are counted, not listed."""
    n = view(spark, sf_dir, "baskets").groupBy("genre").agg((F.count("*") * (F.count("*") - 1)).alias("n")).where("n > 0")
    band = n.agg(F.median("n").alias("m"), F.stddev_samp("n").alias("s"))
    return n.join(F.broadcast(band)).where("n > m - s and n < m + s").select("genre", "n")  # one row


@query(with_views(f", {_FREQ}, kp AS (SELECT genre FROM fr WHERE n < 0.1 * (SELECT sum(n) FROM fr)) SELECT DISTINCT x.book_id AS src, y.book_id AS dst FROM baskets x JOIN baskets y ON x.genre = y.genre AND x.book_id <> y.book_id WHERE x.genre IN (SELECT genre FROM kp)", "baskets").replace(") ,", "),"))
def genre_edges_p10(spark, sf_dir):
    rows = view(spark, sf_dir, "baskets")
    n = rows.groupBy("genre").agg((F.count("*") * (F.count("*") - 1)).alias("n")).where("n > 0")
    kept = n.join(F.broadcast(n.agg(F.sum("n").alias("all")))).where("n < 0.1 * all").select("genre")  # one row
    return G.shared_pairs(rows.join(kept, "genre"), "book_id", "genre", settle)
