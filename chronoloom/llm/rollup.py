"""Token counts as delta-maintained rollups.

A ledger of signed rows (doc_id, mark, source, lang, version, n_docs, n_tokens) grows by batches.  An insert adds a row,
a delete adds its negative, a revised count adds the negative of the old row and the new one, so the totals by source,
language and tokenizer version are plain sums, whatever the order of batches.  `mark` is the md5 of the text: with the
doc_id it tells rows apart, so that a delete takes the row that is meant even where a doc_id repeats.

Each commit stores the batch's rows and, beside them, the batch's own sums by group (the delta).  The rollup is the sum
of the deltas: reading the totals costs a few rows for each batch, whatever the number of documents.  A commit writes
aside and is then published by one rename of a small file named after the batch, so a batch is there whole or not at
all, a batch committed again takes the place of the first, and a crash in between leaves the earlier state as it was.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_counted, read_table, settle, shared_dir

LEDGER = "doc_id long, mark string, source string, lang string, version string, n_docs long, n_tokens long"
TOTALS = ["source", "lang", "version"]
_COLUMNS = [c.split()[0] for c in LEDGER.split(", ")]


def count_words(text: Column) -> Column:
    """Tokenizer version words-1: runs of anything but white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def count_long_words(text: Column) -> Column:
    """Words of over 40 characters, which version words-2 leaves out."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]{41,}")).cast("long")


def count_pieces(text: Column) -> Column:
    """Tokenizer version pieces-1: runs of letters and digits, and single signs."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}\\x20\\x09-\\x0D]")).cast("long")


def _summed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Sums by keys, combined in each task before the shuffle, so that a hot source sends a row a task."""
    return rows.groupBy(*keys).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


class TokenLedger:
    """A ledger in a folder that all executors reach.  Null sources, languages, marks and ids are values like others."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def stage(self, rows: DataFrame) -> str:
        """Writes a batch of signed rows and its sums under a name of their own, which no reader looks at until it is published."""
        name = f"data/{uuid.uuid4().hex}"
        rows.select(*_COLUMNS).write.parquet(f"{self.folder}/{name}/rows")
        stored = self.spark.read.schema(LEDGER).parquet(f"{self.folder}/{name}/rows")
        _summed(stored, TOTALS).coalesce(1).write.parquet(f"{self.folder}/{name}/sums")
        return name

    def publish(self, batch: int, name: str) -> None:
        """Makes a staged batch the one of that number, by one rename over the earlier one if there is any."""
        jvm, aside, final = self._jvm, self._path(f"published/.{uuid.uuid4().hex}"), self._path(f"published/{int(batch)}.json")
        out = aside.getFileSystem(self._conf).create(aside, True)
        out.write(bytearray(json.dumps({"batch": int(batch), "data": name}).encode()))
        out.close()
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self._conf).rename(aside, final, how)

    def commit(self, batch: int, rows: DataFrame) -> None:
        """Stores a batch of signed rows.  A second commit of a number takes the first one's place and adds nothing to it."""
        self.publish(batch, self.stage(rows))

    def published(self) -> dict[int, str]:
        """Folder of each batch (one small file for each is read)."""
        found = self.spark.createDataFrame([], "value string")
        place = self._path("published")
        if place.getFileSystem(self._conf).exists(place):
            found = self.spark.read.option("pathGlobFilter", "*.json").text(f"{self.folder}/published")
        listed = [json.loads(r["value"]) for r in found.collect()]
        return {x["batch"]: x["data"] for x in listed}

    def _read(self, kind: str, schema: str, batches=None) -> DataFrame:
        paths = [f"{self.folder}/{name}/{kind}" for batch, name in self.published().items() if batches is None or batch in batches]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def rows(self, *batches: int) -> DataFrame:
        """The signed rows of the batches given, or of all."""
        return self._read("rows", LEDGER, batches or None)

    def current(self) -> DataFrame:
        """The counts that hold now, one row for each document and version (rows that a table repeats add up)."""
        return _summed(self.rows(), ["doc_id", "mark", *TOTALS]).where("n_docs <> 0 or n_tokens <> 0")

    def totals(self) -> DataFrame:
        """source, lang, version, n_docs, n_tokens: the sum of the batches' deltas; groups that have no document left are not listed."""
        deltas = self._read("sums", "source string, lang string, version string, n_docs long, n_tokens long")
        return _summed(deltas, TOTALS).where("n_docs <> 0 or n_tokens <> 0")


def inserts(docs: DataFrame, version: str, count: Column) -> DataFrame:
    """A signed row for each row of docs; its mark is the column of that name, or else the md5 of the text."""
    mark = F.col("mark") if "mark" in docs.columns else F.md5("text")
    return docs.select(F.col("doc_id").cast("long"), mark.alias("mark"), F.col("source").cast("string"), F.col("lang").cast("string"), F.lit(version).alias("version"), F.lit(1).cast("long").alias("n_docs"), count.alias("n_tokens"))


def negated(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"n_docs": -F.col("n_docs"), "n_tokens": -F.col("n_tokens")})


def counted_documents(docs: DataFrame) -> DataFrame:
    """Of each row of docs (doc_id, text, source, lang): mark, n_words, n_long, n_pieces, and whether it is a copy.

    A copy has the text of a row with a smaller doc_id (or has no doc_id, and a row with one has its text).  Null texts
    are no copies of each other; rows that repeat both a doc_id and a text are not copies of each other either.  The
    texts are read once and not shuffled: from then on rows are as narrow as their counts.
    """
    text = F.col("text")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), F.md5(text).alias("mark"), count_words(text).alias("n_words"), count_long_words(text).alias("n_long"), count_pieces(text).alias("n_pieces"))
    rows = settle(rows, "counts")
    firsts = settle(rows.where("mark is not null").groupBy("mark").agg(F.min("doc_id").alias("first"), F.count("*").alias("n_same")).where("n_same > 1"), "firsts")
    found = join_counted(rows, firsts, ["mark"], "n_same", how="left")
    return found.withColumn("copy", F.col("n_same").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("first"))).drop("first", "n_same")


def op8_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four batches over all documents, one of them committed twice; returns the totals that the ledger keeps.

    1 inserts every document's words-1 count.  2 inserts every pieces-1 count.  3 deletes the documents whose text is
    the same as that of a smaller doc_id, in both versions.  4 revises words-1 to words-2, which counts no word longer
    than 40 characters.  Nulls and repeats are as in counted_documents(); an empty table has no totals.
    """
    docs = settle(counted_documents(read_table(spark, sf_dir, "documents")), "counted")
    ledger = TokenLedger(spark, f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}")
    words, pieces = (lambda rows: inserts(rows, "words-1", F.col("n_words"))), (lambda rows: inserts(rows, "pieces-1", F.col("n_pieces")))
    ledger.commit(1, words(docs))
    ledger.commit(2, pieces(docs))
    copies, left = docs.where("copy"), docs.where("not copy")
    ledger.commit(3, negated(words(copies).unionByName(pieces(copies))))
    for _ in range(2):
        ledger.commit(4, inserts(left, "words-2", F.col("n_words") - F.col("n_long")).unionByName(negated(words(left))))
    return ledger.totals()


OP8_SQL = """
WITH d AS (SELECT *, min(doc_id) OVER (PARTITION BY md5(text)) AS first FROM documents),
k AS (SELECT source, lang, coalesce(text, '') AS t FROM d WHERE text IS NULL OR doc_id IS NOT DISTINCT FROM first),
c AS (SELECT source, lang, 'pieces-1' AS version, len(regexp_extract_all(t, '[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}\\x20\\x09-\\x0D]')) AS n FROM k
      UNION ALL
      SELECT source, lang, 'words-2', len(list_filter(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+'), lambda w: length(w) <= 40)) FROM k)
SELECT source, lang, version, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens FROM c GROUP BY source, lang, version
"""
