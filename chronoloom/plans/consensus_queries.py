"""Merging of claims, author aggregates, joins of validation sources."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import consensus as C
from ..sources.fixtures import table, view, with_views
from .base import query

_KEYED = "k AS (SELECT *, lower(title) || '|' || list_filter(string_split(lower(author), ' '), lambda t: t <> '')[-1] AS key FROM claims WHERE year >= 1660 AND year < 1929)"
_CANON = (
    f"{_KEYED}, y AS (SELECT key, year, count(*) AS n, min(ord) AS first FROM k GROUP BY key, year), "
    "m AS (SELECT key, year, row_number() OVER (PARTITION BY key ORDER BY n DESC, first) AS r FROM y), "
    "a AS (SELECT key, arg_min(title, ord) AS title, arg_min(author, ord) AS author, list_sort(list(DISTINCT provider)) AS models, CAST(count(DISTINCT list_name) AS INTEGER) AS n_lists FROM k GROUP BY key), "
    "canon AS (SELECT a.title, a.author, m.year, CAST(n_lists + len(models) AS INTEGER) AS support, array_to_string(models, ',') AS models, n_lists FROM a JOIN m ON a.key = m.key AND m.r = 1)"
)


def _sql(tail: str, head: str = _CANON) -> str:
    return with_views("", "claims").rstrip() + ", " + head.replace("lower(title) ||", "trim(regexp_replace(lower(title), '^(the|a|an) ', '')) ||") + " " + tail


def _canon(spark, sf_dir):
    return C.consensus(view(spark, sf_dir, "claims"), 1660, 1929)


@query(_sql("SELECT * FROM canon"))
def canon_consensus(spark, sf_dir):
    return _canon(spark, sf_dir).withColumn("models", F.array_join("models", ","))


@query(_sql("SELECT count(*) AS n, count(*) FILTER (models = 'p0,p1') AS both_models, count(*) FILTER (n_lists >= 2) AS two_lists FROM canon"))
def cross_confirm_counts(spark, sf_dir):
    return _canon(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(F.size("models") == 2).alias("both_models"), F.count_if(F.col("n_lists") >= 2).alias("two_lists"))


@query(_sql("SELECT title, author, CAST(row_number() OVER (ORDER BY support DESC, year, title, author) AS INTEGER) AS place FROM canon"))
def canon_order(spark, sf_dir):
    """Places by support, then year: a total order, so by a sort of ranges and counts of the ranges before."""
    return C.places(_canon(spark, sf_dir), [F.desc("support"), F.asc("year"), F.asc("title"), F.asc("author")]).select("title", "author", "place")


@query(_sql("SELECT CAST(floor(year / 20.0) * 20 AS INTEGER) AS bucket, count(*) AS n FROM canon GROUP BY 1"))
def canon_by_20y(spark, sf_dir):
    return _canon(spark, sf_dir).groupBy(X.bucket(F.col("year")).alias("bucket")).agg(F.count("*").alias("n"))


@query(_sql("SELECT key, list_sort(list(year))[CAST(floor(count(*) / 2) AS INTEGER) + 1] AS year, CAST(count(DISTINCT provider) AS INTEGER) AS support FROM k GROUP BY key", _KEYED))
def upper_median_year(spark, sf_dir):
    keyed = C.keyed_claims(view(spark, sf_dir, "claims"), 1660, 1929)
    support = keyed.groupBy("key").agg(F.count_distinct("provider").cast("int").alias("support"))
    return support.join(C.upper_median(keyed, ["key"], "year"), "key", "left").select("key", "year", "support")


_WHO = "w AS (SELECT DISTINCT CASE WHEN o_orderkey % 3 = 0 THEN concat('G. Sur', o_custkey % 997) WHEN o_orderkey % 3 = 1 THEN concat('Given Sur', o_custkey % 997) ELSE concat('Given M. Sur', o_custkey % 997) END AS name FROM orders)"


@query(f"WITH {_WHO}, s AS (SELECT name, list_filter(string_split(lower(name), ' '), lambda t: t <> '')[-1] AS surname FROM w) SELECT name, first_value(name) OVER (PARTITION BY surname ORDER BY length(name) DESC, name DESC) AS canonical FROM s")
def alias_by_surname(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    last = (F.col("o_custkey") % 997).cast("string")
    name = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("G. Sur"), last)).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("Given Sur"), last)).otherwise(F.concat(F.lit("Given M. Sur"), last))
    return C.aliases(orders.select(name.alias("name")).distinct())


_WORDS = "array_to_string(list_slice(list_filter(regexp_split_to_array(description, '[ \\t\\n\\x0b\\f\\r]+'), lambda w: w <> ''), 1, 250), ' ')"


@query(
    with_views(
        f", r AS (SELECT *, row_number() OVER (PARTITION BY author ORDER BY year, book_id) AS rn FROM books) "
        f"SELECT author, min(year) AS earliest_year, count(*) AS n_books_total, count(*) FILTER (rn <= 6) AS n_books_used, md5(string_agg({_WORDS}, ' ' ORDER BY rn) FILTER (rn <= 6)) AS digest_md5 FROM r GROUP BY author",
        "books",
    ).replace(") , r AS", "), r AS")
)
def author_digest(spark, sf_dir):
    found = C.author_digests(view(spark, sf_dir, "books"))
    return found.withColumn("digest_md5", F.md5("digest")).drop("digest")


@query(with_views("SELECT author, arg_min(book_id, (year, book_id)) AS book_id FROM books GROUP BY author", "books"))
def one_per_author(spark, sf_dir):
    return view(spark, sf_dir, "books").groupBy("author").agg(F.min_by("book_id", F.struct("year", "book_id")).alias("book_id"))


@query(with_views("SELECT label, year FROM (SELECT label, year, row_number() OVER (PARTITION BY label ORDER BY count(*) DESC, min(book_id)) AS r FROM vecs GROUP BY label, year) WHERE r = 1", "vecs"))
def mode_first_seen(spark, sf_dir):
    return C.mode_first_seen(view(spark, sf_dir, "vecs"), ["label"], "year", "book_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey IS NOT NULL)")
def resume_anti(spark, sf_dir):
    return C.not_done(table(spark, sf_dir, "orders").select("o_orderkey"), table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


_HELD = "SELECT from_id, to_id, src FROM pairs p JOIN authors a ON p.from_id = a.author_id JOIN authors b ON p.to_id = b.author_id WHERE a.earliest_year < b.earliest_year"


@query(with_views(_HELD, "authors", "pairs"))
def heldout_pairs_semi(spark, sf_dir):
    return C.forward_pairs(view(spark, sf_dir, "pairs"), view(spark, sf_dir, "authors")).select("from_id", "to_id", "src")


@query(with_views("SELECT coalesce(k.from_id, w.from_id) AS from_id, coalesce(k.to_id, w.to_id) AS to_id, CASE WHEN k.from_id IS NOT NULL AND w.from_id IS NOT NULL THEN 'both' WHEN w.from_id IS NULL THEN 'known' ELSE 'wikidata' END AS validated FROM (SELECT * FROM pairs WHERE src = 'known') k FULL OUTER JOIN (SELECT * FROM pairs WHERE src = 'wikidata') w ON k.from_id = w.from_id AND k.to_id = w.to_id", "pairs"))
def validated_merge(spark, sf_dir):
    pairs = view(spark, sf_dir, "pairs")
    return C.merge_validations(pairs.where("src = 'known'"), pairs.where("src = 'wikidata'"))


@query(with_views("SELECT from_id, to_id, src, CASE WHEN from_id % 2 = 0 THEN concat('read by Author', to_id, ' often') END AS note FROM pairs", "pairs"))
def note_attribution(spark, sf_dir):
    name = F.concat(F.lit("Author"), F.col("to_id").cast("string"))
    notes = F.when(F.col("from_id") % 2 == 0, F.array(F.lit("no name here"), F.concat(F.lit("read by "), name, F.lit(" often")), F.concat(F.lit("again "), name))).otherwise(F.array(F.lit("nothing")))
    return view(spark, sf_dir, "pairs").select("from_id", "to_id", "src", C.first_note(notes, name).alias("note"))


@query("SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 0 THEN c_mktsegment END, 'other') AS form FROM customer")
def set_except_default(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    return C.with_default(customers.select("c_custkey"), customers.where("c_acctbal > 0").select("c_custkey", F.col("c_mktsegment").alias("form")), "c_custkey", "form", "other")


@query("WITH u AS (SELECT p_name AS term, p_partkey AS ord FROM part UNION ALL SELECT lower(p_type), 10000000 + p_partkey FROM part UNION ALL SELECT lower(p_brand), 20000000 + p_partkey FROM part) SELECT term, min(ord) AS ord FROM u GROUP BY term")
def terms_union_distinct(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    terms = p.select(F.col("p_name").alias("term"), F.col("p_partkey").alias("ord"))
    for at, name in ((10_000_000, "p_type"), (20_000_000, "p_brand")):
        terms = terms.unionByName(p.select(F.lower(name).alias("term"), (F.col("p_partkey") + at).alias("ord")))
    return C.distinct_in_order(terms, ["term"], "ord")


@query("SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def counts_by_form(spark, sf_dir):
    nations = table(spark, sf_dir, "nation")
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n")).join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "n")


@query("SELECT s_suppkey, coalesce(min(l_shipdate_year) FILTER (l_shipdate_year >= floor), birth + 30) AS year FROM (SELECT s_suppkey, CAST(1950 + s_nationkey AS INTEGER) AS birth, CAST(greatest(1950 + s_nationkey + 45, 1400) AS INTEGER) AS floor, CAST(extract(year FROM l_shipdate) AS INTEGER) AS l_shipdate_year FROM supplier LEFT JOIN lineitem ON s_suppkey = l_suppkey) GROUP BY s_suppkey, birth")
def publication_year(spark, sf_dir):
    """The least edition year not before the floor, else birth plus thirty."""
    who = table(spark, sf_dir, "supplier").select("s_suppkey", (F.lit(1950) + F.col("s_nationkey")).alias("birth"))
    editions = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), F.year("l_shipdate").alias("edition"))
    return C.publication_years(who, editions, "s_suppkey", 45)


@query("WITH l AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_linenumber, l_suppkey) AS k FROM lineitem) SELECT l_orderkey, count(*) FILTER (k <= 6) AS n FROM l GROUP BY l_orderkey")
def head_per_group(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_partkey", "l_linenumber", "l_suppkey")
    return table(spark, sf_dir, "lineitem").withColumn("k", F.row_number().over(w)).where("k <= 6").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query(with_views(r"""SELECT book_id, year, array_to_string(labels, '|') AS labels FROM (SELECT book_id, TRY_CAST(nullif(regexp_extract(description, '\b(1[0-9]{3}|20[0-9]{2})\b', 1), '') AS INTEGER) AS year, list_filter([source, lang], lambda g: g NOT IN ('fr', 'src1', 'src2')) AS labels FROM books) WHERE year IS NOT NULL AND len(labels) > 0""", "books"))
def datable_books(spark, sf_dir):
    """Books with a year in their text and a tracked label: what snapshots are made of."""
    books = view(spark, sf_dir, "books").withColumn("labels", F.array("source", "lang"))
    return C.datable(books, "book_id", "description", "labels", ["fr", "src1", "src2"]).withColumn("labels", F.array_join("labels", "|"))
