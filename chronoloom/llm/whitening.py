"""Whitening of integer vectors by a digit-slice GEMM.

Every component becomes a whole number, x = floor(scale * c) + offset.  Each part of the different vectors is multiplied
with itself in limbs: x = sum of limb_k * 2^(16 k), every limb within +-2^15, so a product of two limb matrices over at
most 2^22 rows is a sum that float64 holds exactly, and BLAS may add it in any order.  Sums by power of two are added up
by Spark as decimals and recombined as big integers: n^2 V = n X'X - S S' is exact whatever the offset.  Only V, d x d
for dimension d, comes to the driver; its eigenvectors are found in float64 and refined by rotations in extended precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_columns, read_table, settle

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
LIMB, ROWS = 16, 1 << 22
#: An eigenvalue below this share of the largest is not told from zero.
LEAST = 1e-15
_KIND = "dim int, i int, j int, power int, part decimal(38,0)"


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """Matrices of float64 within +-2^15 whose sum, times 2^(16 k), is x."""
    found = []
    while True:
        low = ((x + (1 << (LIMB - 1))) & ((1 << LIMB) - 1)) - (1 << (LIMB - 1))
        found.append(low.astype(np.float64))
        x = (x >> LIMB) + (low < 0)
        if not x.any():
            return found


def gram(x: np.ndarray) -> dict[int, np.ndarray]:
    """X'X by power of two: sums over the powers' matrices of whole numbers, each exact."""
    out: dict[int, np.ndarray] = {}
    for at in range(0, len(x), ROWS):
        parts = limbs(x[at : at + ROWS])
        for k, a in enumerate(parts):
            for m, b in enumerate(parts):
                out[LIMB * (k + m)] = out.get(LIMB * (k + m), 0) + (a.T @ b).astype(np.int64).astype(object)
    return out


def whole_vectors(rows: DataFrame, column: str, scale: int, offset: int) -> DataFrame:
    """vec_id and x of every row whose vector has only finite components that fit a long once scaled."""
    rows = doc_columns(rows, "vec_id", column).toDF("vec_id", "v").where("v is not null").withColumn("v", F.col("v").cast("array<double>"))
    fits = F.forall("v", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) <= F.lit(float(1 << 61)) / F.lit(float(scale))), F.lit(False)))
    return rows.where(fits).select("vec_id", F.transform("v", lambda c: F.floor(c * F.lit(float(scale))).cast("long") + F.lit(offset).cast("long")).alias("x"))


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each dimension in a batch: the rows that have it, and their vectors."""
    column = batch.column("x")
    sizes, flat = column.value_lengths().to_numpy(zero_copy_only=False), column.flatten().to_numpy()
    starts = np.cumsum(sizes) - sizes
    for dim in np.unique(sizes).tolist():
        if dim:
            rows = np.nonzero(sizes == dim)[0]
            yield dim, rows, flat[starts[rows][:, None] + np.arange(dim)].reshape(len(rows), dim)


def _moments(fit: DataFrame) -> DataFrame:
    """dim, i, j, power, part: sums of products (i <= j); i = -1 for the sums S, i = -2 for n."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for dim, _, x in _matrices(batch):
                for power, g in gram(x).items():
                    held[dim, "xx", power] = held.get((dim, "xx", power), 0) + g
                held[dim, "n", 0] = held.get((dim, "n", 0), 0) + len(x)
                for k, part in enumerate(limbs(x)):
                    held[dim, "s", LIMB * k] = held.get((dim, "s", LIMB * k), 0) + part.sum(axis=0).astype(np.int64).astype(object)
        for (dim, what, power), value in held.items():
            if what == "xx":
                i, j = np.triu_indices(dim)
                value = value[i, j]
            else:
                i, j = (np.full(dim, -1), np.arange(dim)) if what == "s" else (np.array([-2]), np.array([0]))
                value = np.atleast_1d(np.array(value, object))
            columns = [pa.array(np.full(len(i), dim, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(np.full(len(i), power, np.int32))]
            yield pa.record_batch([*columns, pa.array([str(int(v)) for v in value]).cast(pa.decimal128(38, 0))], ["dim", "i", "j", "power", "part"])

    return fit.select("x").mapInArrow(work, _KIND).groupBy("dim", "i", "j", "power").agg(F.sum("part").alias("part"))


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix of long doubles, falling, and unit eigenvectors by column, the largest entry of each positive.

    The float64 eigenvectors are made orthogonal in extended precision, and what is left beside the diagonal is rotated
    away there, so small eigenvalues beside large ones are right as well.
    """
    q = np.linalg.eigh(v.astype(np.float64))[1].astype(np.longdouble)
    one = np.eye(len(v), dtype=np.longdouble)
    for _ in range(2):
        q = q @ (3 * one - q.T @ q) / 2
    t = q.T @ v @ q
    floor = 2 * np.finfo(np.longdouble).eps * np.abs(t).max()
    for _ in range(12):
        rest = False
        for i in range(len(v) - 1):
            size = np.sqrt(np.abs(t[i, i] * np.diag(t)))
            for j in (np.nonzero(np.abs(t[i, i + 1 :]) > np.maximum(floor, 1e-18 * size[i + 1 :]))[0] + i + 1).tolist():
                if abs(t[i, j]) <= floor:
                    continue
                rest = True
                half = (t[j, j] - t[i, i]) / (2 * t[i, j])
                tan = (1 if half >= 0 else -1) / (abs(half) + np.sqrt(half * half + 1))
                cos = 1 / np.sqrt(tan * tan + 1)
                turn = np.array([[cos, tan * cos], [-tan * cos, cos]], np.longdouble)
                t[:, [i, j]] = t[:, [i, j]] @ turn
                t[[i, j]] = turn.T @ t[[i, j]]
                q[:, [i, j]] = q[:, [i, j]] @ turn
        if not rest:
            break
    e = np.diag(t)
    order = np.argsort(-e, kind="stable")
    e, q = e[order], q[:, order]
    return e, q * np.sign(q[np.abs(q).argmax(axis=0), np.arange(len(v))])


class Whitening:
    """What was fitted on the different vectors of one dimension."""

    def __init__(self, dim: int, n: int, sums: list[int], products: dict[tuple[int, int], int], components: int = COMPONENTS):
        self.n, self.sums = n, sums
        v = np.empty((dim, dim), np.longdouble)
        for (i, j), p in products.items():
            v[i, j] = v[j, i] = _ratio(n * p - sums[i] * sums[j], n * n)
        e, q = eigen(v)
        known = int(((e > LEAST * e[0]) & (e > 0)).sum())
        self.trace = float(np.trace(v))
        self.values = e[: min(components, known)]
        self.axes = q[:, : len(self.values)]
        self.map = (self.axes / np.sqrt(self.values)).astype(np.float64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact."""
        if self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0) < 1 << 62:
            return x * np.int64(self.n) - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def deviations(self, y: np.ndarray) -> list[int]:
        """Squared lengths of the rows, exact."""
        if y.dtype != object and y.shape[1] * int(np.abs(y).max(initial=0)) ** 2 < 1 << 62:
            return (y * y).sum(axis=1).tolist()
        return [sum(int(c) * int(c) for c in row) for row in y]

    def project(self, y: np.ndarray) -> np.ndarray:
        return (y.astype(np.float64) / self.n) @ self.map


def _ratio(a: int, b: int) -> np.longdouble:
    """a / b of big integers, to a long double's precision."""
    high = a / b
    top, bottom = high.as_integer_ratio()
    return np.longdouble(high) + np.longdouble((a * bottom - top * b) / (b * bottom))


def fit(vectors: DataFrame, components: int = COMPONENTS) -> dict[int, Whitening]:
    """vectors: x, each once.  The whitening of each dimension that occurs."""
    found: dict[int, dict] = {}
    for r in _moments(vectors).toLocalIterator():
        own = found.setdefault(r["dim"], {})
        own[r["i"], r["j"]] = own.get((r["i"], r["j"]), 0) + (int(r["part"]) << r["power"])
    return {dim: Whitening(dim, own[-2, 0], [own[-1, j] for j in range(dim)], {k: p for k, p in own.items() if k[0] >= 0}, components) for dim, own in found.items()}


def identity_errors(vectors: DataFrame, models: dict[int, Whitening]) -> dict[int, float]:
    """Of each dimension, the largest absolute entry of the whitened vectors' covariance minus the identity.

    Parts are centred by their own means before multiplying, and merged by the pairwise update of moments.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, _, x in _matrices(batch):
                w = models[dim].project(models[dim].centred(x))
                mean = w.mean(axis=0)
                yield pa.record_batch([pa.array([dim], pa.int32()), pa.array([len(w)], pa.int64()), pa.array([mean.tolist()], pa.list_(pa.float64())), pa.array([((w - mean).T @ (w - mean)).ravel().tolist()], pa.list_(pa.float64()))], ["dim", "n", "mean", "moment"])

    parts = vectors.select("x").mapInArrow(work, "dim int, n long, mean array<double>, moment array<double>")
    total: dict[int, tuple] = {}
    for r in parts.toLocalIterator():  # a row of components^2 numbers for each batch
        n, mean, moment = r["n"], np.array(r["mean"]), np.array(r["moment"]).reshape(len(r["mean"]), len(r["mean"]))
        if r["dim"] in total:
            m, other, own = total[r["dim"]]
            apart = mean - other
            moment, mean, n = moment + own + np.outer(apart, apart) * (n * m / (n + m)), other + apart * (n / (n + m)), n + m
        total[r["dim"]] = n, mean, moment
    return {dim: float(np.abs(moment / n - np.eye(len(mean))).max(initial=0.0)) for dim, (n, mean, moment) in total.items()}


def whiten(rows: DataFrame, column: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """rows: vec_id and a vector.  vec_id, component, n, deviation (decimal), whitened, explained, identity_error for each row and component.

    Rows whose vector is null or holds null or non-finite components, or components too large for a long, take no part;
    neither do empty vectors.  Vectors of different dimensions are fitted apart.  Vectors that repeat are fitted once and
    returned for every row, with or without a vec_id; a deviation of over 38 digits is null.  Components without variance (fewer different vectors than
    components, constant dimensions) can't be scaled and are left out, so one vector alone gives no row, as does an
    empty table.  The driver holds one d x d matrix for each dimension d.
    """
    whole = settle(whole_vectors(rows, column, scale, offset), "whole")
    vectors = settle(whole.select("x").distinct(), "different")
    models = fit(vectors, components)
    errors = identity_errors(vectors, models)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, at, x in _matrices(batch):
                own = models[dim]
                k = len(own.values)
                if not k:
                    continue
                y = own.centred(x)
                each = np.repeat(np.arange(len(at)), k)
                explained = np.array([float(e) / own.trace for e in own.values])
                deviation = pa.array([str(d) if d < 10**38 else None for d in own.deviations(y)], pa.string()).cast(pa.decimal128(38, 0))
                yield pa.record_batch(
                    [
                        batch.column("vec_id").take(pa.array(at[each])),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                        pa.array(np.full(len(each), own.n, np.int64)),
                        deviation.take(pa.array(each)),
                        pa.array(own.project(y).ravel()),
                        pa.array(np.tile(explained, len(at))),
                        pa.array(np.full(len(each), errors[dim])),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return whole.mapInArrow(work, "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every vector of `embeddings`; odd rows as in whiten().  A deviation that no long holds is null."""
    return whiten(read_table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation AS long)"))
