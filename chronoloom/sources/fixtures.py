"""The engine's entities over the driver's tables: whole tables, with pseudo-years that depend on ids only.

Each view is one SQL text that Spark and DuckDB both read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "books": "SELECT doc_id AS book_id, concat('t', doc_id) AS title, concat(source, '-', lang) AS author, CAST(1660 + (doc_id * 37) % 269 AS INT) AS year, source, lang, text AS description FROM documents",
    "claims": "SELECT o_orderkey AS ord, CASE WHEN o_orderkey % 2 = 0 THEN 'p0' ELSE 'p1' END AS provider, concat('list', o_custkey % 14) AS list_name, concat('The Title ', o_custkey % 997) AS title, concat('Given Sur', o_custkey % 13) AS author, CAST(1655 + (o_orderkey * 7) % 280 AS INT) AS year FROM orders",
    "baskets": "SELECT DISTINCT l_orderkey AS book_id, concat('g', l_partkey) AS genre FROM lineitem",
    "vecs": "SELECT vec_id AS book_id, embedding, label, CAST(1660 + (vec_id * 37) % 269 AS INT) AS year FROM embeddings",
    "authors": "SELECT vec_id AS author_id, concat('Given Author', vec_id) AS name, CAST(-762 + (vec_id * 211) % 2681 AS INT) AS earliest_year, label % 5 AS form, CAST(1 + vec_id % 6 AS INT) AS n_books, embedding FROM embeddings",
    "pairs": "SELECT DISTINCT o_custkey % n AS from_id, o_orderkey % n AS to_id, CASE WHEN (o_custkey + o_orderkey) % 3 = 0 THEN 'wikidata' ELSE 'known' END AS src FROM orders CROSS JOIN (SELECT count(*) AS n FROM embeddings) x WHERE o_custkey % n <> o_orderkey % n",
    "series": "SELECT event_type AS term, CAST(1800 + extract(day FROM ts) AS INT) AS year, CAST(count(*) AS DOUBLE) AS freq FROM events GROUP BY 1, 2",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view with its tables as arguments of the query, so none is left behind in the session's catalog."""
    named = re.sub(r"\b(FROM|JOIN) (" + "|".join(TABLES) + r")\b", r"\1 {\2}", VIEWS[name])
    return spark.sql(named, **{t: table(spark, sf_dir, t) for t in set(re.findall(r"\{(\w+)\}", named))})


def with_views(sql: str, *names: str) -> str:
    """An oracle query with the views it uses in front."""
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in names) + " " + sql
