"""Sources that answer by URL: paged catalogs, texts with mirrors, frequency series, influence statements.

Any URL that urllib opens will do, file: included.  What a service has answered is best landed as a table once; the
functions below the fetchers work on such tables.
"""

from __future__ import annotations

import json
import random
import time
import urllib.request
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..operators import vectors as V

CATALOG = "id long, title string, author string, birth_year int, text_url string, labels array<string>"


def fetch(url: str, tries: int = 4, most: float = 8.0, sleep=time.sleep) -> bytes:
    """The body of a URL; waits a doubling time, up to `most` seconds and some chance, between tries."""
    for n in range(tries):
        try:
            with urllib.request.urlopen(url, timeout=60) as answer:
                return answer.read()
        except OSError:
            if n == tries - 1:
                raise
            sleep(min(2**n, most) + random.random())
    raise AssertionError


class PagedCatalog(DataSource):
    """A catalog of pages {"results": [...], "next": url}.  Options: url (the first page), target (rows at most; none: all).

    Pages name their successor, so one task reads them in order.  Rows without title, author or plain text are left out.
    As a stream the pages are partitions: a batch follows the successors of up to `pages` pages (16) and its tasks read
    one page each; the offset names the page to go on with, so a scan that broke goes on there.  tries: of a page (4).
    """

    @classmethod
    def name(cls) -> str:
        return "paged_catalog"

    def schema(self) -> str:
        return CATALOG

    def reader(self, schema) -> DataSourceReader:
        return _CatalogReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _CatalogStream(self.options)


class _CatalogReader(DataSourceReader):
    def __init__(self, options):
        self.url, self.target = options["url"], int(options.get("target", "0"))

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition) -> Iterator[tuple]:
        url, found = self.url, 0
        while url:
            page = json.loads(fetch(url))
            for row in _rows(page):
                yield row
                found += 1
                if found == self.target:
                    return
            url = page.get("next")


def _rows(page: dict) -> Iterator[tuple]:
    for row in page.get("results", []):
        author = (row.get("authors") or [{}])[0]
        text = next((u for kind, u in (row.get("formats") or {}).items() if kind.startswith("text/plain") and not u.endswith(".zip")), None)
        if not (row.get("title") and author.get("name") and text):
            continue
        labels = list(dict.fromkeys([*(row.get("bookshelves") or []), *(row.get("subjects") or [])]))[:8]
        yield row.get("id"), row["title"], author["name"], author.get("birth_year"), text, labels


class _Page(InputPartition):
    def __init__(self, url: str):
        super().__init__(url)


class _CatalogStream(DataSourceStreamReader):
    """Offsets: next, the page to go on with (empty at the end), and pages, those of the batch that ends there, a line each."""

    def __init__(self, options):
        self.url, self.pages, self.tries, self.at = options["url"], int(options.get("pages", "16")), int(options.get("tries", "4")), None

    def initialOffset(self) -> dict:
        return {"next": self.url, "pages": ""}

    def latestOffset(self) -> dict:
        self.at = self.at or self.initialOffset()
        url, taken = self.at["next"], []
        while url and len(taken) < self.pages:
            try:
                after = json.loads(fetch(url, self.tries)).get("next") or ""
            except OSError:
                if not taken:
                    raise
                break  # what was reached is taken in first
            taken.append(url)
            url = after
        if taken:
            self.at = {"next": url, "pages": "\n".join(taken)}
        return self.at

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.at = self.at or end  # after a restart the last batch that was planned comes first
        return [] if start == end else [_Page(url) for url in end["pages"].split("\n")]

    def read(self, partition) -> Iterator[tuple]:
        yield from _rows(json.loads(fetch(partition.value, self.tries)))

    def commit(self, end: dict) -> None:
        pass


def ingest_catalog(spark: SparkSession, url: str, path: str, checkpoint: str, pages: int = 16, tries: int = 4) -> None:
    """Takes all pages that can be reached into the table at path.  After a failure, again with the same checkpoint: every row is there once."""
    spark.dataSource.register(PagedCatalog)
    rows = spark.readStream.format("paged_catalog").option("url", url).option("pages", pages).option("tries", tries).load()
    query = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def read_catalog(spark: SparkSession, url: str, target: int = 0) -> DataFrame:
    spark.dataSource.register(PagedCatalog)
    return spark.read.format("paged_catalog").option("url", url).option("target", target).load()


def fetch_texts(rows: DataFrame, key: str = "id", urls: str = "urls", tries: int = 2) -> DataFrame:
    """key, text: what the first of a row's URLs that answers holds; null if none does."""

    def first(mirrors) -> str | None:
        for url in mirrors if mirrors is not None else []:
            try:
                return fetch(url, tries, 0.1).decode("utf-8", "replace")
            except OSError:
                continue
        return None

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "text": [first(m) for m in batch[urls]]})

    return rows.select(F.col(key).cast("long"), urls).mapInPandas(work, f"{key} long, text string")


def term_series(asked: DataFrame, answers: DataFrame, year_start: int) -> DataFrame:
    """asked: term.  answers: ngram, timeseries.  term, year, freq of the all-cases series; an unanswered term has one row with nulls."""
    whole = answers.where(F.col("ngram").endswith(" (All)")).select(F.lower(F.regexp_replace("ngram", r" \(All\)$", "")).alias("__t"), "timeseries")
    joined = asked.join(whole, F.lower("term") == F.col("__t"), "left")
    return joined.select("term", F.posexplode_outer("timeseries").alias("i", "freq")).select("term", (F.col("i") + year_start).alias("year"), F.col("freq").cast("double").alias("freq"))


def influences(names: DataFrame, entities: DataFrame, claims: DataFrame) -> DataFrame:
    """names: name.  entities: qid, label.  claims: qid, target (the first was influenced by the second).

    from, to: pairs whose both ends are named, the influence first, once each.
    """
    found = names.join(entities, F.col("name") == F.col("label")).groupBy("name").agg(F.min("qid").alias("qid"))
    targets = claims.join(entities.select(F.col("qid").alias("target"), F.col("label").alias("from")), "target")
    pairs = found.join(targets, "qid").select("from", F.col("name").alias("to")).distinct()
    return pairs.join(names.select(F.col("name").alias("from")).distinct(), "from", "left_semi").select("from", "to")


def with_embeddings(rows: DataFrame, cache: DataFrame, key: str, text: str, embed, chars: int = 6000) -> DataFrame:
    """key, embedding: from the cache where it has the key, else embed(series of texts) of the first chars of the text."""
    missing = rows.join(cache, key, "left_anti").select(key, embed(F.substring(F.coalesce(text, F.lit("")), 1, chars)).alias("embedding"))
    return cache.join(rows.select(key), key, "left_semi").select(key, "embedding").unionByName(missing)


def embed_or_tfidf(rows: DataFrame, key: str, text: str, embed, cut, chars: int = 6000, **tfidf) -> tuple[DataFrame, str]:
    """key, embedding of every row, and which back end made them: `embed` (of a column of texts, their first chars), or, if it
    fails in any way, unit vectors of TF-IDF weights over the whole corpus (tfidf: its bounds).  A row without a term has zeros.

    One back end serves all rows, as vectors of two can't be compared.  cut: stores a table and reads it again, so a
    failure in a task shows here.
    """
    try:
        return cut(rows.select(key, embed(F.substring(F.coalesce(text, F.lit("")), 1, chars)).alias("embedding"))), "model"
    except Exception:  # whatever a model, its download or a worker may raise
        weights = cut(V.tfidf(rows.select(key, text), key, text, **tfidf))
    terms = weights.select("term").distinct()
    numbered = terms.withColumn("i", F.row_number().over(Window.orderBy("term")) - 1)  # max_features rows at most
    size = terms.count()

    @F.pandas_udf("array<double>")
    def dense(at: pd.Series, w: pd.Series) -> pd.Series:
        out = []
        for i, x in zip(at, w):
            v = np.zeros(size)
            if i is not None:
                v[np.asarray(i, int)] = x
            out.append(v)
        return pd.Series(out)

    held = weights.join(F.broadcast(numbered), "term").groupBy(key).agg(F.collect_list(F.struct("i", "w")).alias("t"))
    both = rows.select(key).join(held, key, "left")
    return both.select(key, dense(F.col("t.i"), F.col("t.w")).alias("embedding")), "tfidf"
