"""Reading and storing of tables: JSON documents and arrays, stored steps, whole-file results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOOK = "title string, author string, date_published string, genres array<string>, description string, gutenberg_id long, source string, canon_support int, canon_lists int, canon_models array<string>"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; a local session that names none gets a temporary one."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors reach")
        known = f"file://{tempfile.mkdtemp(prefix='chronoloom-')}"
        spark.conf.set("spark.checkpoint.dir", known)
    return known.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """Writes a table in the shared folder and reads it again, which ends its lineage."""
    path = f"{shared_dir(df.sparkSession)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_json_document(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    """Rows of {"key": [...]}."""
    whole = T.StructType([T.StructField(key, T.ArrayType(T._parse_datatype_string(schema)))])
    return spark.read.schema(whole).json(path, multiLine=True).select(F.inline(key))


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of [...]; a missing file is an empty table."""
    try:
        return spark.read.schema(schema).json(path, multiLine=True)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], schema)


def read_json_result(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What write_json_result() wrote."""
    return spark.read.schema(schema).json(path)


def write_json_result(df: DataFrame, path: str) -> None:
    """One JSON object a row; the commit protocol leaves the whole result or none."""
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """One CSV with a header, for tables as small as a timeline."""
    df.orderBy(*order).coalesce(1).write.mode("overwrite").csv(path, header=True)


def append_new(df: DataFrame, path: str, key: str) -> int:
    """Appends the rows whose key the stored table doesn't hold; returns how many there were."""
    spark = df.sparkSession
    try:
        done = spark.read.schema(df.schema).parquet(path).select(key)
        df = df.join(done, key, "left_anti")
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
    new = settle(df)
    n = new.count()
    if n:
        new.write.mode("append").parquet(path)
    return n


def edge_matrix(edges: DataFrame) -> DataFrame:
    """i, j, value of a symmetric matrix from its edges; a missing cell is a missing row."""
    return edges.select(F.col("a").alias("i"), F.col("b").alias("j"), "value").unionByName(edges.select(F.col("b").alias("i"), F.col("a").alias("j"), "value"))


def synthetic_corpus(spark: SparkSession) -> DataFrame:
    """Eighteen works in three groups of six: one genre, another beside it, and from 1984 one that shares the first's label."""
    rows = []
    for stem, start, genres, words in (
        ("SF", 1950, ["science fiction"], "rocket planet orbit alien starship"),
        ("MY", 1955, ["mystery"], "detective clue murder suspect alibi"),
        ("CP", 1984, ["science fiction", "cyberpunk"], "hacker cyberspace neon implant matrix"),
    ):
        rows += [(f"{stem}-{i}", start + i, genres, words) for i in range(6)]
    return spark.createDataFrame(rows, "title string, year int, genres array<string>, description string")
