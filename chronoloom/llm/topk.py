"""Exact top-k inner products by norm buckets.

Candidates are sorted by length and cut into buckets of similar length.  For a query q with a running k-th best score
t, a bucket whose longest vector has length l can only matter if the cosine with q reaches t / (|q| l), the bucket's
local threshold.  Over 1 no vector can qualify and, as later buckets are shorter, the query is finished (length
pruning).  For a high threshold, coordinate pruning takes q's largest coordinate f: a vector with cosine c to q has
its normalised f-th coordinate within c q_f +- sqrt((1 - c^2)(1 - q_f^2)), so only the slice of the bucket's list,
sorted by that coordinate, is verified.  Otherwise the bucket is verified whole.  Scores are exact integers.

The table is stored in the order of length, so its parts are ranges of length.  Each query first meets the BUCKET longest
vectors of all: the k-th best score there is its floor, carried to every part, which need only find what reaches it.
Queries go out in blocks of bounded size; a part whose vectors are too short for every query of a block isn't read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, settle, shared_dir

K, SCALE, EVERY = 10, 1024, 100
#: Components of the queries of one block (they are broadcast, so 8 bytes for each bound that), vectors of one bucket, and the
#: local threshold from which the coordinate lists are used.
BLOCK, BUCKET, STEEP = 1 << 22, 2048, 0.6
#: Below this every sum of products is an exact double.
EXACT = float(1 << 53)


class Bucket:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, lengths: np.ndarray):
        self.ids, self.vectors, self.lengths = ids, vectors, lengths
        self.longest = float(lengths.max(initial=0.0))
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.verified = 0  # products taken, for measurements

    def by_coordinate(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self.lists:
            value = self.vectors[:, f] / np.maximum(self.lengths, 1e-300)
            order = np.argsort(value, kind="stable")
            self.lists[f] = value[order], order
        return self.lists[f]


def products(vectors: np.ndarray, q: np.ndarray, bound: float) -> np.ndarray:
    """Integer inner products: by doubles where every partial sum is exact, else by Python's integers."""
    if bound < EXACT:
        return (vectors @ q).astype(np.int64)
    return np.array([sum(int(a) * int(b) for a, b in zip(v, q)) for v in vectors], object)


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best by score, ties to the smaller id."""
    if len(scores) > 4 * k and scores.dtype != object:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.nonzero(scores >= least)[0]
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    order = sorted(range(len(scores)), key=lambda i: (-scores[i], ids[i]))
    return np.array(order[:k], np.int64)


def search(buckets: list[Bucket], query_id: int, q: np.ndarray, k: int, floor: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
    """ids and scores of the k best vectors for q that reach the floor, without rows of the query's own id; buckets in descending length."""
    ids, scores = np.empty(0, np.int64), np.empty(0, np.int64)
    length = float(np.sqrt(q @ q))
    focus = int(np.argmax(np.abs(q))) if len(q) else 0
    for b in buckets:
        bound = length * b.longest
        full = len(ids) == k
        threshold = max(float(scores[-1]), floor) if full else floor
        if bound * (1 + 1e-9) < threshold:
            break
        take = None
        local = threshold / bound if bound > 0 and threshold > -np.inf else -1.0
        if local >= STEEP:
            c, x = min(local * (1 - 1e-9), 1.0), float(q[focus]) / length
            spread = np.sqrt(max(0.0, (1 - c * c) * (1 - x * x))) + 1e-7
            # cosines above c keep the coordinate above the lower bound, and below the upper one while c exceeds |x|
            value, order = b.by_coordinate(focus)
            low = np.searchsorted(value, c * x - spread, "left") if x > 0 or c > abs(x) else 0
            high = np.searchsorted(value, c * x + spread, "right") if x < 0 or c > abs(x) else len(value)
            if high - low < len(value) // 2:
                take = order[low:high]
        found_ids, vectors = (b.ids, b.vectors) if take is None else (b.ids[take], b.vectors[take])
        found = products(vectors, q, bound)
        b.verified += len(found)
        keep = found_ids != query_id
        if floor > -np.inf:
            keep &= found >= floor
        if full:
            keep &= found >= scores[-1]
        found, found_ids = found[keep], found_ids[keep]
        if len(found):
            found, found_ids = np.concatenate([scores, found]), np.concatenate([ids, found_ids])
            top = best_of(found, found_ids, k)
            ids, scores = found_ids[top], found[top]
    return ids, scores


def integer_vectors(rows: DataFrame, scale: int) -> DataFrame:
    """vec_id and v, floor(scale * x) of each component as doubles; without rows whose vector is null or holds null or non-finite components."""
    wide = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    rows = rows.select(F.col("vec_id").cast("long"), wide.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(F.col("v").isNotNull() & F.col("vec_id").isNotNull() & fine)


def _matrix(column: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the lists, and their floored components one after another."""
    return np.diff(column.offsets.to_numpy()), np.floor(scale * column.flatten().to_numpy(zero_copy_only=False))


def buckets_of(ids: np.ndarray, vectors: np.ndarray) -> list[Bucket]:
    lengths = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    order = np.argsort(-lengths, kind="stable")
    return [Bucket(ids[o], vectors[o], lengths[o]) for o in (order[s : s + BUCKET] for s in range(0, len(order), BUCKET))]


def search_all(candidates: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE) -> DataFrame:
    """candidates and queries: vec_id, embedding.  Returns query_id, rank, vec_id, score of each query's k best candidates.

    A query's own id is no candidate for it.  A vector meets only vectors of its own dimension.  Rows that repeat a
    vec_id are candidates each, and queries each, with k rows of their own; ties go to the smaller vec_id.  Rows without
    an id take no part, nor do vectors that are null or hold null or non-finite components.  With no candidate a query
    has no row.  Scores are exact; one that does not fit a long fails the query.

    The answers of a block are stored before the next one is asked, so a lost executor costs a part of one block.
    """
    spark = candidates.sparkSession
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + F.floor(x * scale) * F.floor(x * scale)))
    pool = integer_vectors(candidates, scale).withColumn("length", size)
    pool = settle(pool.repartitionByRange(F.desc("length")).sortWithinPartitions(F.desc("length")), "pool")
    longest = pool.orderBy(F.desc("length"), "vec_id").limit(BUCKET).select("vec_id", "v").toArrow()  # BUCKET rows
    asked = settle(_floors(integer_vectors(queries, scale), longest, k, scale), "asked")
    folder, n = f"{shared_dir(spark)}/answers-{uuid.uuid4().hex}", 0
    for n, block in enumerate(_blocks(asked), 1):
        _answer(pool, block, k, scale).withColumn("block", F.lit(n)).write.parquet(f"{folder}/{n}")
    kind = "query int, query_id long, vec_id long, score long, block int"
    found = spark.read.schema(kind).option("recursiveFileLookup", True).parquet(folder) if n else spark.createDataFrame([], kind)
    best = Window.partitionBy("block", "query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _floors(asked: DataFrame, longest: pa.Table, k: int, scale: int) -> DataFrame:
    """vec_id, v and floor: the k-th best score among the longest vectors of all, minus infinity if there are fewer."""
    sent = asked.sparkSession.sparkContext.broadcast(longest)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pools = {dim: buckets_of(*x) for dim, x in _by_dimension(sent.value, scale).items()} if sent.value.num_rows else {}
        for batch in batches:
            if not batch.num_rows:
                continue
            floors = np.full(batch.num_rows, -np.inf)
            sizes, flat = _matrix(batch.column("v"), scale)
            ends = np.cumsum(sizes)
            for i, q_id in enumerate(batch.column("vec_id").to_pylist()):
                scores = search(pools.get(int(sizes[i]), []), q_id, flat[ends[i] - sizes[i] : ends[i]], k)[1]
                if len(scores) == k:
                    floors[i] = float(scores[-1]) if abs(int(scores[-1])) < EXACT else -np.inf
            yield pa.record_batch([*batch.columns, pa.array(floors)], ["vec_id", "v", "floor"])

    return asked.mapInArrow(work, "vec_id long, v array<double>, floor double")


def _blocks(asked: DataFrame) -> Iterator[pa.Table]:
    """The queries, block by block; a block has BLOCK components at most (or one query)."""
    rows, weight = [], 0
    schema = pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.float64())), ("floor", pa.float64())])
    for r in asked.toLocalIterator():
        if rows and weight + len(r["v"]) > BLOCK:
            yield pa.Table.from_pylist(rows, schema)
            rows, weight = [], 0
        rows.append(r.asDict())
        weight += len(r["v"])
    if rows:
        yield pa.Table.from_pylist(rows, schema)


def _answer(pool: DataFrame, rows: pa.Table, k: int, scale: int) -> DataFrame:
    """query (the row's place in the block), query_id, vec_id, score: of each part of the pool the k best that reach the query's floor."""
    sent = pool.sparkSession.sparkContext.broadcast(rows)
    questions = _by_dimension(rows, scale, "place")
    least = np.inf
    for dim, (place, vectors) in questions.items():
        lengths, floors = np.sqrt(np.einsum("ij,ij->i", vectors, vectors)), rows["floor"].to_numpy()[place]
        # no shorter vector reaches the floor of any query of the block
        least = min(least, float(np.where((floors > 0) & (lengths > 0), floors / np.maximum(lengths, 1e-300), 0.0).min()))
    near = pool.where(F.col("length") >= F.lit(least * (1 - 1e-9))).select("vec_id", "v")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        questions = _by_dimension(sent.value, scale, "place")
        query_ids, floors = sent.value["vec_id"].to_numpy(), sent.value["floor"].to_numpy().copy()
        kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:  # a batch is a bounded number of candidates: its buckets are searched and dropped
            if not batch.num_rows:
                continue
            for dim, own in _by_dimension(pa.Table.from_batches([batch]), scale).items():
                if dim not in questions:
                    continue
                buckets = buckets_of(*own)
                for j, q in zip(questions[dim][0].tolist(), questions[dim][1]):
                    got = search(buckets, int(query_ids[j]), q, k, floors[j])
                    old = kept.get(j)
                    if old is not None:
                        both = np.concatenate([old[0], got[0]]), np.concatenate([old[1], got[1]])
                        top = best_of(both[1], both[0], k)
                        got = both[0][top], both[1][top]
                    kept[j] = got
                    if len(got[1]) == k and abs(int(got[1][-1])) < EXACT:
                        floors[j] = max(floors[j], float(got[1][-1]))
        for j, (ids, scores) in kept.items():
            if len(ids):
                yield pa.record_batch([pa.array([j] * len(ids), pa.int32()), pa.array([int(query_ids[j])] * len(ids), pa.int64()), pa.array(ids.tolist(), pa.int64()), pa.array([int(s) for s in scores], pa.int64())], ["query", "query_id", "vec_id", "score"])

    return near.mapInArrow(work, "query int, query_id long, vec_id long, score long")


def _by_dimension(table: pa.Table, scale: int, name: str = "vec_id") -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of each dimension, vec_id (or the places of the rows) and the floored vectors."""
    found: dict[int, tuple] = {}
    ids = np.arange(table.num_rows) if name == "place" else table["vec_id"].to_numpy()
    column = table["v"].combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    sizes, flat = _matrix(column, scale)
    ends = np.cumsum(sizes)
    for dim in np.unique(sizes).tolist():
        rows = np.nonzero(sizes == dim)[0]
        flat_at = (ends[rows] - dim)[:, None] + np.arange(dim)
        found[dim] = ids[rows], flat[flat_at].reshape(len(rows), dim)
    return found


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id and score for every vec_id divisible by EVERY against all rows; odd rows as in search_all()."""
    rows = read_table(spark, sf_dir, "embeddings")
    return search_all(rows, rows.where(F.col("vec_id") % EVERY == 0))


OP9_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT row_number() OVER () AS q, * FROM v WHERE vec_id % 100 = 0),
s AS (SELECT q.q, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM u q JOIN v c ON q.vec_id <> c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
