"""Sums over all ordered pairs of vectors without forming the pairs.

For unit vectors u the sum of dot(u_a, u_b) over all pairs is the squared length of the sum of the vectors, and the sum
of dot squared is the squared Frobenius norm of their second moments (the sum of outer products).  Pairs in the order of
years are half of all pairs less those of one year, so the pool of n (n - 1) / 2 pairs costs one pass over n vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_PARTIAL = "t int, year long, n long, s array<double>, r array<double>"


def _rows(t: int, year: int | None, x: np.ndarray) -> tuple:
    """n, the sum, and at most as many vectors as dimensions that have the second moments of x."""
    small = np.linalg.qr(x, mode="r") if len(x) > x.shape[1] else x
    return t, year, len(x), x.sum(axis=0).tolist(), small.ravel().tolist()


def year_moments(units: DataFrame) -> DataFrame:
    """units: t (group), year, v (unit vector, of one dimension).  t, year, n, s (sum of the vectors), norm (squared Frobenius norm
    of their second moments); the rows with year null are of all years together.

    Vectors are combined in each batch by group and year, so what is dealt out grows with the vectors at most, and what
    a group's task reads with the batches; it keeps one matrix.  Rows without a year or vector are left out.
    """
    rows = units.select(F.col("t").cast("int"), F.col("year").cast("long"), "v").where("year is not null and v is not null and size(v) > 0")

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            t, year = batch.column("t").to_numpy(), batch.column("year").to_numpy()
            x = batch.column("v").flatten().to_numpy().reshape(len(t), -1)
            order = np.lexsort((year, t))
            t, year, x = t[order], year[order], x[order]
            new_t = np.append(True, t[1:] != t[:-1])
            new = new_t | np.append(True, year[1:] != year[:-1])
            out = []
            for starts, whole in ((np.nonzero(new)[0], False), (np.nonzero(new_t)[0], True)):
                for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(t)]):
                    out.append(_rows(int(t[s]), None if whole else int(year[s]), x[s:e]))
            names = ["t", "year", "n", "s", "r"]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group and year: one sum and one matrix are held at a time."""
        key, n, s, m, out = None, 0, None, None, []

        def close() -> None:
            if key is not None:
                out.append({"t": key[0], "year": key[1], "n": n, "s": s.tolist(), "norm": float((m * m).sum())})

        for batch in batches:
            for row in batch.to_pylist():
                own, vector = (row["t"], row["year"]), np.array(row["s"])
                r = np.array(row["r"]).reshape(-1, len(vector))
                if own == key:
                    n, s, m = n + row["n"], s + vector, m + r.T @ r
                else:
                    close()
                    key, n, s, m = own, row["n"], vector, r.T @ r
        close()
        if out:
            yield pa.RecordBatch.from_pylist(out, pa.schema([("t", pa.int32()), ("year", pa.int64()), ("n", pa.int64()), ("s", pa.list_(pa.float64())), ("norm", pa.float64())]))

    parts = rows.mapInArrow(combine, _PARTIAL).repartition("t", "year").sortWithinPartitions("t", "year")
    return parts.mapInArrow(merge, "t int, year long, n long, s array<double>, norm double")


def pair_moments(moments: DataFrame) -> DataFrame:
    """moments: year_moments().  t, n, total, squares: number of pairs in the order of years, sums of their products and of the squares."""
    length = F.aggregate("s", F.lit(0.0), lambda a, x: a + x * x)
    sign = F.when(F.col("year").isNull(), 1).otherwise(-1)  # all pairs less those of one year
    found = moments.groupBy("t").agg(F.sum(sign * F.col("n") * F.col("n")).alias("n"), F.sum(sign * length).alias("total"), F.sum(sign * F.col("norm")).alias("squares"))
    return found.select("t", (F.col("n") / 2).cast("long").alias("n"), (F.col("total") / 2).alias("total"), (F.col("squares") / 2).alias("squares"))


def gap_moments(moments: DataFrame) -> DataFrame:
    """moments: year_moments().  t, n, gap, gap_squares and gap_products: sums over pairs in the order of years of the gap, its square,
    and the gap times the product.  Running sums over the distinct years, one window for each component of the vectors."""
    years = moments.where("year is not null")
    before = Window.partitionBy("t").orderBy("year").rowsBetween(Window.unboundedPreceding, -1)
    counts = years.select("t", "year", "n", *(F.coalesce(F.sum(x).over(before), F.lit(0)).alias(name) for x, name in ((F.col("n"), "k"), (F.col("n") * F.col("year"), "y"), (F.col("n") * F.col("year") * F.col("year"), "yy"))))
    gaps = counts.groupBy("t").agg(F.sum(F.col("n") * F.col("k")).alias("n"), F.sum(F.col("n") * (F.col("k") * F.col("year") - F.col("y"))).cast("double").alias("gap"), F.sum(F.col("n") * (F.col("k") * F.col("year") * F.col("year") - 2 * F.col("year") * F.col("y") + F.col("yy"))).cast("double").alias("gap_squares"))
    parts = years.select("t", "year", F.posexplode("s").alias("k", "s"))
    before = Window.partitionBy("t", "k").orderBy("year").rowsBetween(Window.unboundedPreceding, -1)
    running = parts.select("t", "year", "s", F.coalesce(F.sum("s").over(before), F.lit(0.0)).alias("p"), F.coalesce(F.sum(F.col("s") * F.col("year")).over(before), F.lit(0.0)).alias("q"))
    products = running.groupBy("t").agg(F.sum(F.col("s") * (F.col("year") * F.col("p") - F.col("q"))).alias("gap_products"))
    return gaps.join(products, "t")
