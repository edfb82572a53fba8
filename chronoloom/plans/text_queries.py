"""Cleaning and matching of titles, names, years and embedded data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.fixtures import table, view, with_views
from .base import query

#: Odd titles, authors and dates, beside those of the tables.
TITLES = ["The Time Machine", "An  Old-Fashioned Girl!", "a", "The The", "Les Misérables", "", "1984", "A Tale of Two Cities"]
AUTHORS = ["Verne, Jules", "Homer", "", "Hölderlin", "Anonymous", "The Koran", "Mary  Shelley", "O'Brien", "St. John-Smith"]
DATES = ["September 1st 2004", "c. 380 BC", "", "published 1813, reprinted 1894", "20190", "in 2100 or 1999"]


def _sql_list(values: list[str]) -> str:
    return ", ".join("('" + v.replace("'", "''") + "')" for v in values)


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "part").select(F.concat(F.lit("The "), F.col("p_name"), F.lit(": "), F.col("p_type"), F.lit(" No. "), F.col("p_partkey").cast("string")).alias("x"))
    return spark.createDataFrame([(t,) for t in TITLES], "x string").unionByName(own)


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "customer").select(F.concat(F.col("c_mktsegment"), F.lit(", "), F.col("c_name")).alias("x"))
    other = table(spark, sf_dir, "part").select(F.col("p_name").alias("x"))
    return spark.createDataFrame([(t,) for t in AUTHORS], "x string").unionByName(own).unionByName(other)


_T = f"titles(x) AS (SELECT * FROM (VALUES {_sql_list(TITLES)}) UNION ALL SELECT concat('The ', p_name, ': ', p_type, ' No. ', CAST(p_partkey AS VARCHAR)) FROM part)"
_N = f"names(x) AS (SELECT * FROM (VALUES {_sql_list(AUTHORS)}) UNION ALL SELECT concat(c_mktsegment, ', ', c_name) FROM customer UNION ALL SELECT p_name FROM part)"


def _norm(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(trim(regexp_replace(lower({x}), '[^a-z0-9 ]', ' ', 'g')), '^(the|a|an) ', ''), ' +', ' ', 'g'))"


@query(f"WITH {_T} SELECT x, {_norm('x')} AS norm FROM titles")
def norm_title(spark, sf_dir):
    return _titles(spark, sf_dir).select("x", X.norm_title(F.col("x")).alias("norm"))


@query(f"WITH {_T} SELECT x, array_to_string(list_sort(list_distinct(list_filter(string_split({_norm('x')}, ' '), lambda t: t <> ''))), ' ') AS tokens FROM titles")
def norm_tokens(spark, sf_dir):
    return _titles(spark, sf_dir).select("x", F.array_join(F.array_sort(X.title_tokens(F.col("x"))), " ").alias("tokens"))


_SURNAME = "lower(coalesce(list_filter(regexp_split_to_array(x, '[,\\s]+'), lambda t: t <> '')[-1], ''))"


@query(f"WITH {_N} SELECT x, {_SURNAME} AS surname FROM names")
def surname_key(spark, sf_dir):
    return _names(spark, sf_dir).select("x", X.surname(F.col("x")).alias("surname"))


@query(f"WITH {_N} SELECT x, {_norm('x')} || '|' || {_SURNAME} AS key FROM names")
def composite_key(spark, sf_dir):
    return _names(spark, sf_dir).select("x", X.match_key(F.col("x"), F.col("x")).alias("key"))


@query(f"WITH {_N} SELECT x FROM names WHERE {_norm('x')} NOT IN ({', '.join(repr(n) for n in X.NOT_PERSONS)}) AND regexp_matches(trim(x), '^[A-Za-z.\\-'' ]+$')")
def person_filter(spark, sf_dir):
    return _names(spark, sf_dir).where(X.is_person(F.col("x")))


@query(f"WITH d(x) AS (SELECT * FROM (VALUES {_sql_list(DATES)}) UNION ALL SELECT strftime(o_orderdate, 'on %d.%m.%Y') FROM orders) SELECT x, TRY_CAST(nullif(regexp_extract(x, '\\b(1[0-9]{{3}}|20[0-9]{{2}})\\b', 1), '') AS INTEGER) AS year FROM d")
def parse_year(spark, sf_dir):
    own = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "'on 'dd.MM.yyyy").alias("x"))
    return spark.createDataFrame([(t,) for t in DATES], "x string").unionByName(own).select("x", X.year_in(F.col("x")).alias("year"))


@query(with_views("SELECT CAST(floor(earliest_year / 20.0) * 20 AS INTEGER) AS bucket, count(*) AS n FROM authors GROUP BY 1", "authors"))
def bucket_20y(spark, sf_dir):
    return view(spark, sf_dir, "authors").groupBy(X.bucket(F.col("earliest_year")).alias("bucket")).agg(F.count("*").alias("n"))


@query(with_views("SELECT author_id, CASE WHEN earliest_year < 0 THEN concat(-earliest_year, ' BCE') ELSE CAST(earliest_year AS VARCHAR) END AS label FROM authors", "authors"))
def bce_format(spark, sf_dir):
    return view(spark, sf_dir, "authors").select("author_id", X.year_label(F.col("earliest_year")).alias("label"))


@query(with_views("SELECT author_id, earliest_year > 1802 AS datable FROM authors", "authors"))
def datable(spark, sf_dir):
    return view(spark, sf_dir, "authors").select("author_id", X.is_datable(F.col("earliest_year"), 1800).alias("datable"))


@query(with_views("SELECT book_id FROM books WHERE year >= 1660 AND year < 1929", "books"))
def year_range(spark, sf_dir):
    return view(spark, sf_dir, "books").where((F.col("year") >= 1660) & (F.col("year") < 1929)).select("book_id")


_WRAPPED = "concat('Intro text *** START OF THE WORK *** ', text, ' *** END OF THE WORK *** licence')"


@query(f"SELECT doc_id, md5(regexp_replace(regexp_replace({_WRAPPED}, '(?is)^.*?\\*\\*\\*\\s*START OF.*?\\*\\*\\*', ''), '(?is)\\*\\*\\*\\s*END OF.*', '')) AS digest FROM documents")
def strip_boilerplate(spark, sf_dir):
    wrapped = F.concat(F.lit("Intro text *** START OF THE WORK *** "), F.col("text"), F.lit(" *** END OF THE WORK *** licence"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.without_boilerplate(wrapped)).alias("digest"))


@query("SELECT doc_id, nullif(array_to_string(list_slice(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0b\\f\\r]+'), lambda w: w <> ''), 1, 250), ' '), '') AS head FROM documents")
def first_n_words(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.first_words(F.col("text"), 250).alias("head"))


@query("SELECT event_id, CAST(json_extract(regexp_extract(concat('Sure: [', props, ', {\"k\": 1}] done.'), '(?s)(\\[.*\\])', 1), '$[0].k') AS BIGINT) AS first_k, CAST(json_array_length(regexp_extract(concat('Sure: [', props, ', {\"k\": 1}] done.'), '(?s)(\\[.*\\])', 1)) AS INTEGER) AS n FROM events")
def json_array_extract(spark, sf_dir):
    said = F.concat(F.lit("Sure: ["), F.col("props"), F.lit(', {"k": 1}] done.'))
    found = table(spark, sf_dir, "events").select("event_id", X.json_array(said, "array<struct<k: bigint>>").alias("a"))
    return found.select("event_id", F.get("a", F.lit(0))["k"].alias("first_k"), F.size("a").alias("n"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN concat(url, '.txt') ELSE concat(url, '.utf8.txt') END AS picked FROM pages WHERE url IS NOT NULL")
def mime_pick(spark, sf_dir):
    first = F.when(F.col("page_id") % 3 == 0, F.concat("url", F.lit(".txt"))).otherwise(F.concat("url", F.lit(".zip")))
    formats = F.create_map(F.lit("text/html"), F.col("url"), F.lit("text/plain"), first, F.lit("text/plain; charset=utf-8"), F.concat("url", F.lit(".utf8.txt")))
    return table(spark, sf_dir, "pages").where("url is not null").select("page_id", X.plain_text_url(formats).alias("picked"))


@query("SELECT doc_id, concat_ws('|', source, lang, 'shelf', CASE WHEN lang = 'en' THEN NULL ELSE concat('in ', lang) END) AS labels FROM documents")
def ordered_distinct_labels(spark, sf_dir):
    first, second = F.array("source", "lang", F.lit("shelf")), F.array(F.lit("shelf"), F.col("source"), F.when(F.col("lang") == "en", F.col("lang")).otherwise(F.concat(F.lit("in "), F.col("lang"))))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(X.ordered_labels(first, second), "|").alias("labels"))


@query("SELECT doc_id, concat_ws('|', source, lang) AS labels FROM documents")
def clean_labels(spark, sf_dir):
    labels = F.array("source", F.concat(F.lit("Category: "), F.col("source")), "lang", F.concat("lang", F.lit(" -- Fiction")), F.lit("Best Books Ever Listings"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(X.clean_labels(labels), "|").alias("labels"))


@query("SELECT doc_id, coalesce(nullif(CASE WHEN lang = 'fr' THEN '' WHEN lang = 'de' THEN NULL ELSE source END, ''), concat('t', doc_id), '') AS text FROM documents")
def fallback_text(spark, sf_dir):
    description = F.when(F.col("lang") == "fr", "").when(F.col("lang") == "de", F.lit(None)).otherwise(F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", X.description_or_title(description, F.concat(F.lit("t"), F.col("doc_id").cast("string"))).alias("text"))


@query("SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, regexp_extract(html, 'lang=\"([a-z]+)\"', 1) AS lang, TRY_CAST(nullif(regexp_extract(html, 'track\\(([0-9]+)\\)', 1), '') AS INTEGER) AS track FROM pages")
def page_embedded_extract(spark, sf_dir):
    html = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract(html, "(?s)<title>(.*?)</title>", 1).alias("title"), F.regexp_extract(html, 'lang="([a-z]+)"', 1).alias("lang"), F.nullif(F.regexp_extract(html, r"track\(([0-9]+)\)", 1), F.lit("")).try_cast("int").alias("track"))


@query("SELECT event_id, concat('{\"a\":', props, ',\"b\":{\"c\":{}}}') AS found FROM events")
def embedded_json_balanced(spark, sf_dir):
    page = F.concat(F.lit('<script>let x = {}; const DATA = {"a":'), F.col("props"), F.lit(',"b":{"c":{}}}; const MORE = {"z":{}};</script>'))
    return table(spark, sf_dir, "events").select("event_id", X.balanced_object(page, "const DATA =").alias("found"))


@query("SELECT event_id, CAST(json_extract(regexp_extract(concat('Plotly.newPlot(\"g\", [', props, '], {\"t\": 1});'), '(?s)Plotly\\.newPlot\\(.*?(\\[.*?\\])\\s*,\\s*\\{', 1), '$[0].k') AS BIGINT) AS k FROM events")
def embedded_json_regex(spark, sf_dir):
    page = F.concat(F.lit('Plotly.newPlot("g", ['), F.col("props"), F.lit('], {"t": 1});'))
    found = F.regexp_extract(page, r"(?s)Plotly\.newPlot\(.*?(\[.*?\])\s*,\s*\{", 1)
    return table(spark, sf_dir, "events").select("event_id", F.get(F.from_json(found, "array<struct<k: bigint>>"), F.lit(0))["k"].alias("k"))


@query("SELECT p_partkey, p_name AS title, CASE WHEN p_size % 2 = 0 THEN p_brand END AS author, CASE WHEN p_size % 2 = 0 THEN CAST(1900 + p_size AS INTEGER) END AS year FROM part")
def hover_parse(spark, sf_dir):
    full = F.concat(F.lit("<b>"), F.col("p_name"), F.lit("</b><br>"), F.col("p_brand"), F.lit(" ("), (F.col("p_size") + 1900).cast("string"), F.lit(")"))
    return table(spark, sf_dir, "part").select("p_partkey", X.hover_fields(F.when(F.col("p_size") % 2 == 0, full).otherwise(F.col("p_name"))).alias("h")).select("p_partkey", "h.*")


@query("SELECT p_partkey, p_name AS label, CAST(p_size AS DOUBLE) / 10 AS z, p_size > 25 AS emergent FROM part")
def trace_name_parse(spark, sf_dir):
    name = F.concat(F.col("p_name"), F.lit(" (z=+"), (F.col("p_size") / 10).cast("string"), F.lit(")"), F.when(F.col("p_size") > 25, " ★").otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", X.trace_fields(name).alias("t")).select("p_partkey", "t.*")


@query(f"WITH {_T} SELECT x, replace(replace(replace(concat('<', x, '> & co'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS html FROM titles")
def html_escape(spark, sf_dir):
    return _titles(spark, sf_dir).select("x", X.escape_html(F.concat(F.lit("<"), F.col("x"), F.lit("> & co"))).alias("html"))


@query("SELECT p_partkey, round(p_size / 255.0, 6) AS red FROM part")
def hex_colour(spark, sf_dir):
    code = F.format_string("#%02x10ff", F.col("p_size"))
    return table(spark, sf_dir, "part").select("p_partkey", F.get(X.colour(code), F.lit(0)).alias("red"))


@query("SELECT p_partkey, round(40 + 560 * (p_retailprice - min(p_retailprice) OVER ()) / nullif(max(p_retailprice) OVER () - min(p_retailprice) OVER (), 0), 6) AS x FROM part")
def min_max_scale(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    ends = parts.agg(F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi"))
    share = F.try_divide(F.col("p_retailprice") - F.col("lo"), F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)))
    return parts.join(F.broadcast(ends)).select("p_partkey", F.round(40 + 560 * share, 6).alias("x"))  # ends is one row


@query(
    "WITH w AS (SELECT p_partkey, p_size, list_distinct(string_split(p_name, ' ')) AS want, lower(p_brand) AS surname FROM part), "
    "g AS (SELECT p_partkey AS hit, p_size, lower(p_brand) AS authors, list_distinct(string_split(p_name || ' ' || lower(p_type), ' ')) AS got, row_number() OVER (PARTITION BY p_size ORDER BY p_retailprice DESC, p_partkey) AS ord FROM part), "
    "m AS (SELECT w.p_partkey, hit, row_number() OVER (PARTITION BY w.p_partkey ORDER BY ord) AS k FROM w JOIN g USING (p_size) WHERE ord <= 6 AND len(list_intersect(want, got)) / CAST(greatest(len(want), 1) AS DOUBLE) >= 0.5 AND contains(authors, surname)) "
    "SELECT p_partkey, hit FROM m WHERE k = 1"
)
def fuzzy_title_match(spark, sf_dir):
    """The first of the six first search results (here: parts of the size by price) whose title holds half of the wanted
    tokens and among whose authors (here: the brand) is the wanted surname, if one is known."""
    parts = table(spark, sf_dir, "part")
    results = parts.select(F.col("p_partkey").alias("hit"), "p_size", F.lower("p_brand").alias("authors"), X.title_tokens(F.concat_ws(" ", "p_name", "p_type")).alias("got"), F.row_number().over(Window.partitionBy("p_size").orderBy(F.desc("p_retailprice"), "p_partkey")).alias("ord")).where("ord <= 6")
    wanted = parts.select("p_partkey", "p_size", F.lower("p_brand").alias("surname"), X.title_tokens(F.col("p_name")).alias("want"))
    named = (F.col("surname") == "") | F.contains(F.col("authors"), F.col("surname"))
    found = wanted.join(results, "p_size").where((X.title_overlap(F.col("want"), F.col("got")) >= 0.5) & named)
    return found.groupBy("p_partkey").agg(F.min_by("hit", "ord").alias("hit"))


@query("SELECT page_id, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS link FROM pages) GROUP BY page_id")
def page_links(spark, sf_dir):
    links = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("link"))
    return links.groupBy("page_id").agg(F.count("*").alias("n"))


@query(
    "WITH e AS (SELECT event_id, round(CAST(user_id AS DOUBLE) / 7 + 1e-9, 6) AS x, round(value, 6) AS y FROM events), v AS (SELECT x, y, min(event_id) AS node FROM e GROUP BY x, y) "
    "SELECT e.event_id, v.node FROM e JOIN v USING (x, y)"
)
def coordinate_join(spark, sf_dir):
    """Which node an edge's end lies on, by coordinates rounded to six digits."""
    ends = table(spark, sf_dir, "events").select("event_id", F.round(F.col("user_id") / 7 + 1e-9, 6).alias("x"), F.round("value", 6).alias("y"))
    nodes = ends.groupBy("x", "y").agg(F.min("event_id").alias("node"))
    return ends.join(nodes, ["x", "y"]).select("event_id", "node")
