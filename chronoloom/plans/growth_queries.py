"""The corpus as a stream, and results as the pages take them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources import tables as D
from ..sources import web
from ..sources.fixtures import table, view, with_views
from ..streaming import growth
from .base import query


@query("SELECT year, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CAST(1800 + extract(day FROM ts) AS INTEGER) AS year, count(*) AS n FROM events GROUP BY 1) GROUP BY year")
def stream_growth(spark, sf_dir):
    """Events dealt in four files, taken in by Structured Streaming."""
    base = f"{D.shared_dir(spark)}/growth-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("book_id"), (1800 + F.dayofmonth("ts")).alias("year"))
    rows.repartition(4).write.parquet(f"{base}/in")
    growth.run_to_ledger(spark, f"{base}/in", "book_id long, year int", f"{base}/ledger", f"{base}/state")
    return growth.ledger(spark, f"{base}/ledger")


@query(with_views("SELECT book_id, title, author, year FROM books", "books"))
def json_round_trip(spark, sf_dir):
    """Books written as JSON and read again with their schema."""
    path = f"{D.shared_dir(spark)}/books-{uuid.uuid4().hex}"
    D.write_json_result(view(spark, sf_dir, "books").select("book_id", "title", "author", "year"), path)
    return D.read_json_result(spark, path, "book_id long, title string, author string, year int")


@query("SELECT l_orderkey AS i, l_partkey AS j, l_quantity AS value FROM lineitem UNION ALL SELECT l_partkey, l_orderkey, l_quantity FROM lineitem")
def edge_matrix(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("b"), F.col("l_quantity").alias("value"))
    return D.edge_matrix(edges)


@query("SELECT label, count(*) AS n, string_agg(concat('{\"id\":', vec_id, '}'), ',' ORDER BY vec_id) AS payload FROM embeddings GROUP BY label")
def page_payload(spark, sf_dir):
    """A community's members as the page's JSON records (a page shows what a browser can hold, so a community is small)."""
    rows = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct(F.col("vec_id").alias("id")))).alias("m"))
    return rows.select("label", "n", F.array_join(F.transform("m", lambda x: F.to_json(F.struct(x["id"].alias("id")))), ",").alias("payload"))


@query("SELECT count(*) AS n, CAST(sum(year) AS BIGINT) AS years FROM (VALUES (1950), (1951), (1952), (1953), (1954), (1955), (1955), (1956), (1957), (1958), (1959), (1960), (1984), (1985), (1986), (1987), (1988), (1989)) t(year)")
def synthetic_corpus(spark, sf_dir):
    return D.synthetic_corpus(spark).agg(F.count("*").alias("n"), F.sum("year").alias("years"))


@query("WITH a AS (SELECT DISTINCT p_name AS term FROM part), s AS (SELECT p_name, list(p_retailprice ORDER BY p_partkey) AS ts FROM part WHERE p_name NOT LIKE 'red%' GROUP BY p_name), j AS (SELECT a.term, s.ts FROM a LEFT JOIN s ON a.term = s.p_name) SELECT term, CAST(1700 + unnest(range(len(ts))) AS INTEGER) AS year, unnest(ts) AS freq FROM j WHERE ts IS NOT NULL UNION ALL SELECT term, NULL, NULL FROM j WHERE ts IS NULL")
def ngram_series(spark, sf_dir):
    """Series by term from answers named "Term (All)" in any case; terms without an answer stay, with nulls."""
    parts = table(spark, sf_dir, "part")
    answers = parts.where("p_name not like 'red%'").groupBy("p_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_retailprice"))), lambda x: x["p_retailprice"]).alias("timeseries"))
    answers = answers.select(F.concat(F.initcap("p_name"), F.lit(" (All)")).alias("ngram"), "timeseries").unionByName(answers.select(F.col("p_name").alias("ngram"), "timeseries"))
    return web.term_series(parts.select(F.col("p_name").alias("term")).distinct(), answers, 1700)


@query("WITH e AS (SELECT c_custkey AS qid, concat('n', c_custkey % 700) AS label FROM customer), f AS (SELECT label AS name, min(qid) AS qid FROM e GROUP BY label) SELECT DISTINCT t.label AS \"from\", f.name AS \"to\" FROM f JOIN orders o ON o.o_custkey = f.qid JOIN e t ON t.qid = o.o_orderkey % 1500")
def influence_lookup(spark, sf_dir):
    """Names to entities, their influences, and back to names."""
    entities = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("qid"), F.concat(F.lit("n"), (F.col("c_custkey") % 700).cast("string")).alias("label"))
    claims = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("qid"), (F.col("o_orderkey") % 1500).alias("target"))
    return web.influences(entities.select(F.col("label").alias("name")).distinct(), entities, claims)
