"""What the operators of this subpackage share: tables, the shared folder, batches of rows."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import shared_dir


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame, tag: str, group: int | None = None) -> DataFrame:
    """Writes a table in the shared folder and reads it again: lineage ends there, and a lost executor costs no recomputation of it.

    group: rows of a Parquet row group at most, for rows of megabytes, of which Parquet otherwise holds 100 before it looks at their size.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    (df.write if group is None else df.write.option("parquet.block.row.count.limit", group)).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is run inside sends its Python workers Arrow batches of so many rows at most; afterwards the session's own limit holds again."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(own)) if int(own) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, own)


#: A key that holds over one in so many rows is heavy: fewer than this many keys can be.
HEAVY = 1000


def join_counted(rows: DataFrame, keyed: DataFrame, keys: Sequence[str], count: str, how: str = "inner") -> DataFrame:
    """rows joined with keyed, which has a row for each key and, in `count`, how many of rows have that key.

    Keys that hold over 1 in HEAVY of keyed's rows are broadcast (fewer than HEAVY of them can be), so a hot key is
    joined where its rows lie; the others meet by a shuffle in which no key is large.  Both sides should be stored, as
    they are read twice.  Null keys match nothing.
    """
    total = keyed.agg(F.coalesce(F.sum(count), F.lit(0)).cast("long")).first()[0]
    hot = keyed[count] * HEAVY > total
    heavy, light = F.broadcast(keyed.where(hot)), keyed.where(~hot)
    rest = rows.join(F.broadcast(keyed.where(hot).select(*keys)), list(keys), "left_anti")
    return rows.join(heavy, list(keys)).unionByName(rest.join(light, list(keys), how))


def forget(df: DataFrame) -> None:
    """Deletes the files of a table that settle() wrote and that no plan reads any longer."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in {name.rpartition("/")[0] for name in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The column's values, with the empty string for null."""
    return [x or "" for x in batch.column(name).to_pylist()]


def bytes_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The column's values in UTF-8, with the empty string for null."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def doc_columns(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns of any name cannot clash."""
    return docs.select(*(docs[n] for n in names))


def crc_mod(column: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.crc32(column.cast("string").cast("binary")) % F.lit(modulus)


def runs(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Whole groups of a partition sorted by keys: each table yielded holds complete runs of equal keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = [batch.column(k)[batch.num_rows - 1] for k in keys]
        cut = batch.num_rows
        low, high = 0, batch.num_rows
        while low < high:  # the first row of the last run: keys are sorted, so equality with the last key is monotone
            mid = (low + high) // 2
            if [batch.column(k)[mid] for k in keys] == last:
                high = mid
            else:
                low = mid + 1
        cut = low
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        elif held and [held[-1].column(k)[held[-1].num_rows - 1] for k in keys] != last:
            yield pa.Table.from_batches(held)
            held = [batch]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)
