"""MinHash near-duplicates with SetSketch registers.

Every shingle deals each of M registers an exponential value, in rising order; a register keeps the smallest that any
shingle of the set deals it, on an exponential scale (floor(1 - log_BASE x), cut to 16 bits).  Registers of a union are
the larger ones of its parts, and two sets agree on a register with a probability near their similarity.

1. Texts of the same words are one class.  Each class goes, by BANDS bands of ROWS registers, to the buckets of its
   register values; at a similarity of 0.8 two sets share none with a probability of 5e-8.
2. In each bucket every class is held against the smallest: the joint likelihood of the registers that are larger, smaller
   and equal gives an estimate of the similarity, and what is near the wanted one is verified on the full sets.  The
   pairs that hold form components.
3. Where a bucket has classes of several components, those outside its largest component are compared with all others,
   and the largest itself with none of its own.  Again the estimate chooses, the full sets decide, and pairs that
   are connected already are passed over.  Large buckets are dealt in pairs of parts.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bytes_of, doc_columns, forget, join_counted, read_table, runs, settle
from .components import connected_components

SHINGLE, SIMILARITY = 4, 0.8
#: Registers, their base, their largest value, the rate of the exponential values, and registers of a band.
M, BASE, LARGEST, RATE, ROWS = 128, 1.001, (1 << 16) - 1, 20.0, 4
BANDS = M // ROWS
#: Standard deviations (of M agreeing registers) by which an estimate may miss.
SLACK = 4.0
#: Classes of a part of a bucket, and of one whose texts are compared.
BLOCK = 1024
_LOG = np.log(BASE)


def shingles(data: bytes, width: int = SHINGLE) -> set[bytes]:
    """The different shingles of a text in UTF-8, A-Z lower-cased; a shorter text is one, a text without a word has none."""
    words = data.lower().split()
    if not words:
        return set()
    return {b" ".join(words)} if len(words) < width else set(map(b" ".join, zip(*(words[i:] for i in range(width)))))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketches(hashes: np.ndarray, sizes: np.ndarray, m: int = M) -> np.ndarray:
    """Registers (a row each) of consecutive sets of different 64-bit hashes, sizes of them in each set.

    The values of a hash rise from round to round, and its registers are a permutation that it chooses; once the next
    values could change no register of its set, a hash deals no more.
    """
    found = np.zeros((len(sizes), m), np.int64)
    own = np.repeat(np.arange(len(sizes)), sizes)
    state = hashes.copy()
    start, step = (hashes & np.uint64(m - 1)).astype(np.int64), (_mix(hashes) >> np.uint64(40)).astype(np.int64) | 1
    value = np.zeros(len(hashes))
    for j in range(m):
        if not len(own):
            break
        state = _mix(state + np.uint64(0x9E3779B97F4A7C15))
        uniform = ((state >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)
        value = value - np.log(uniform) / (RATE * (m - j))
        register = np.clip(np.floor(1 - np.log(value) / _LOG) + (LARGEST >> 1), 0, LARGEST).astype(np.int64)
        np.maximum.at(found.reshape(-1), own * m + ((start + j * step) & (m - 1)), register)
        alive = register > found.min(axis=1)[own]
        own, state, start, step, value = own[alive], state[alive], start[alive], step[alive], value[alive]
    return found.astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union."""
    return np.maximum(a, b)


def estimate(larger: np.ndarray, smaller: np.ndarray, m: int, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """The similarity of greatest likelihood, of sets of known sizes of which so many registers of a are larger and smaller than b's."""
    u, v = size_a / (size_a + size_b), size_b / (size_a + size_b)
    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    c = (BASE - 1) / BASE

    def above(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """p(x), the chance that a register is larger by elements of share x, and its derivative."""
        return -np.log1p(-x * c) / _LOG, c / (1 - x * c) / _LOG

    for _ in range(20):  # the likelihood is concave: the sign of its derivative tells the side
        mid = (low + high) / 2
        (p, dp), (q, dq) = above(np.maximum(u - v * mid, 1e-12)), above(np.maximum(v - u * mid, 1e-12))
        rising = -larger * v * dp / p - smaller * u * dq / q + (m - larger - smaller) * (v * dp + u * dq) / np.maximum(1 - p - q, 1e-12) > 0
        low, high = np.where(rising, mid, low), np.where(rising, high, mid)
    return (low + high) / 2


def _near(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, similarity: float) -> np.ndarray:
    """Of pairs of sketches, those whose estimate and sizes allow the similarity."""
    m = a.shape[1]
    least = similarity - SLACK * (similarity * (1 - similarity) / m) ** 0.5
    fits = np.minimum(size_a, size_b) >= similarity * np.maximum(size_a, size_b)
    return fits & (estimate((a > b).sum(axis=1), (a < b).sum(axis=1), m, size_a, size_b) >= least)


def overlap(x: set[bytes], y: set[bytes], similarity: float) -> bool:
    if min(len(x), len(y)) < similarity * max(len(x), len(y)):
        return False
    both = len(x & y)
    return 100 * both >= round(100 * similarity) * (len(x) + len(y) - both)


def classes_of(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, key (128-bit hash of the words; null without words), size of the set, sketch, of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                keys, sizes, hashes = [], [], []
                for data in bytes_of(batch):
                    found = shingles(data, width)
                    keys.append(xxhash.xxh3_128_digest(b" ".join(data.lower().split())) if found else None)
                    sizes.append(len(found))
                    hashes.append(np.fromiter(map(xxhash.xxh64_intdigest, found, repeat(0)), np.uint64, len(found)))
                sketch = sketches(np.concatenate(hashes), np.array(sizes))
                yield pa.record_batch([batch.column("doc_id"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array([r.tobytes() for r in sketch], pa.binary())], ["doc_id", "key", "size", "sketch"])

    rows = doc_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(work, "doc_id long, key binary, size long, sketch binary")


def _banded(nodes: DataFrame) -> DataFrame:
    """nodes: id, size, sketch, ...  Each of them in each of its buckets."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                bands = [struct.pack("<Q", k) for k in range(BANDS)]
                keys = [xxhash.xxh64_intdigest(s[k * 2 * ROWS : (k + 1) * 2 * ROWS] + bands[k]) for s in batch.column("sketch").to_pylist() for k in range(BANDS)]
                each = pa.array(np.repeat(np.arange(batch.num_rows), BANDS))
                yield pa.record_batch([batch.column("id").take(each), pa.array(np.array(keys, np.uint64).view(np.int64))], ["id", "bucket"])

    return nodes.select("id", "sketch").mapInArrow(work, "id long, bucket long")


def _verified(pairs: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs a, b whose full sets are so similar."""
    both = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [overlap(shingles(x, width), shingles(y, width), similarity) for x, y in zip(bytes_of(batch, "text_a"), bytes_of(batch, "text_b"))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(work, "a long, b long")


def _sketch_rows(column: pa.Array) -> np.ndarray:
    data = column.to_pylist()
    return np.frombuffer(b"".join(data), np.uint16).reshape(len(data), -1)


def _against_first(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs a, b that are near by their sketches."""
    a = settle(pairs.groupBy("a").agg(F.count("*").alias("pairs")).join(nodes.toDF("a", "size_a", "sketch_a"), "a"), "firsts")
    b = nodes.toDF("b", "size_b", "sketch_b")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                size = [batch.column(c).to_numpy().astype(float) for c in ("size_a", "size_b")]
                keep = _near(_sketch_rows(batch.column("sketch_a")), _sketch_rows(batch.column("sketch_b")), *size, similarity)
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    both = join_counted(pairs, a, ["a"], "pairs").drop("pairs").join(b, "b")
    return both.select("a", "b", "size_a", "sketch_a", "size_b", "sketch_b").mapInArrow(work, "a long, b long")


KEYS = ["bucket", "lo", "hi"]


def _dealt(banded: DataFrame, roots: DataFrame, block: int) -> DataFrame:
    """id, root, minor, own, bucket, lo, hi: the classes of buckets with several components, in the pairs of parts in which they are compared.

    A class outside the bucket's largest component (minor) goes to every pair that holds its part; one of the largest goes
    to its own part's pair with each part of minor ones, and minor ones are few or the bucket's pairs are its work.
    """
    held = settle(banded.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")), "held")
    by_root = held.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    largest = by_root.groupBy("bucket").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("most")).where("n > most")
    largest = settle(largest.withColumn("parts", F.ceil((F.col("n") - F.col("most")) / F.lit(block)).cast("int")).withColumn("mains", F.ceil(F.col("most") / F.lit(block)).cast("int")), "several")
    rows = join_counted(held, largest, ["bucket"], "n").withColumn("minor", F.col("root") != F.col("main"))
    # parts from 0 are of minor classes, parts below 0 of the largest component
    own = F.when(F.col("minor"), F.pmod(F.xxhash64("id"), F.col("parts"))).otherwise(-1 - F.pmod(F.xxhash64("id"), F.col("mains"))).cast("int")
    others = F.when(F.col("minor"), F.concat(F.sequence(-F.col("mains"), F.lit(-1)), F.sequence(F.lit(0), F.col("parts") - 1))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    rows = rows.withColumn("own", own).withColumn("other", F.explode(others))
    return rows.select("id", "root", "minor", "own", "bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))


def _groups(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each pair of parts in a table sorted by KEYS: the places to compare with each other (the same twice in one part)."""
    k = np.stack([table[x].to_numpy().astype(np.int64) for x in KEYS])
    own = table["own"].to_numpy()
    starts = np.append(np.nonzero(np.append(True, (k[:, 1:] != k[:, :-1]).any(axis=0)))[0], k.shape[1])
    for s, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
        at = np.arange(s, e)
        if k[1, s] == k[2, s]:
            yield at, at
        else:
            first = own[s:e] == k[1, s]
            if first.any() and not first.all():
                yield at[first], at[~first]


def _open_pairs(table: pa.Table, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs of different components that are near by their sketches, some at a time."""
    sketch, size, root = _sketch_rows(table["sketch"]), table["size"].to_numpy().astype(float), table["root"].to_numpy()
    for left, right in _groups(table):
        step = max(1, (1 << 18) // len(right))
        for s in range(0, len(left), step):
            x, y = np.repeat(left[s : s + step], len(right)), np.tile(right, len(left[s : s + step]))
            keep = (root[x] != root[y]) & (np.minimum(size[x], size[y]) >= similarity * np.maximum(size[x], size[y]))
            if left is right:
                keep &= x < y
            x, y = x[keep], y[keep]
            if len(x):
                near = _near(sketch[x], sketch[y], size[x], size[y], similarity)
                yield x[near], y[near]


def _between(banded: DataFrame, nodes: DataFrame, roots: DataFrame, texts: DataFrame, width: int, similarity: float, block: int) -> DataFrame:
    """Links a, b of classes in a common bucket that connect, with the components there are, all that such links connect."""
    kind = "id long, root long, own int, bucket long, lo int, hi int, size long, sketch binary"
    names = [c.split()[0] for c in kind.split(", ")]

    def sort(df: DataFrame) -> DataFrame:
        return df.repartition(*KEYS).sortWithinPartitions(*KEYS, "id")

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows that have a pair to verify."""
        for table in runs(batches, KEYS):
            wanted = np.zeros(table.num_rows, bool)
            for x, y in _open_pairs(table, similarity):
                wanted[x] = wanted[y] = True
            if wanted.any():
                yield from table.filter(pa.array(wanted)).select(names).combine_chunks().to_batches()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, KEYS):
            data, name, own = table["text"].cast(pa.binary()), table["id"].to_pylist(), table["root"].to_pylist()
            sets: dict[int, set[bytes]] = {}
            above: dict[int, int] = {}
            out = []

            def find(x: int) -> int:
                while x in above:
                    above[x] = above.get(above[x], above[x])
                    x = above[x]
                return x

            for x, y in _open_pairs(table, similarity):
                for i, j in zip(x.tolist(), y.tolist()):
                    p, q = find(own[i]), find(own[j])
                    if p != q:
                        for k in (i, j):
                            if k not in sets:
                                sets[k] = shingles(data[k].as_py(), width)
                        if overlap(sets[i], sets[j], similarity):
                            above[max(p, q)] = min(p, q)
                            out.append((name[i], name[j]))
            if out:
                a, b = map(list, zip(*out))
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    dealt = sort(_dealt(banded, roots, block).join(nodes, "id").select(*names))
    wanted = settle(dealt.mapInArrow(some, kind), "open")
    return sort(wanted.join(texts, "id").select(*names, "text")).mapInArrow(work, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = SHINGLE, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs (doc_id, text; further columns are not looked at).

    Two texts are linked if their sets of shingles overlap by `similarity` of their union; component_id is the smallest
    doc_id reachable.  Null texts and texts without words have an empty set and are linked with nothing; rows that repeat a
    doc_id keep their own row; rows without a doc_id are linked by their text but never name a component (a component
    of only such rows has the id null).  An empty table gives an empty table.
    """
    rows = settle(classes_of(docs, width), "sketches")
    counted = rows.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"), F.min(F.struct("size", "sketch")).alias("s"))
    classes = settle(counted.select("key", F.xxhash64("key").alias("id"), "least", "n", "s.*"), "classes")
    if classes.count() != classes.agg(F.count_distinct("id")).first()[0]:
        raise ValueError("two classes have one 64-bit id")
    nodes = classes.select("id", "size", "sketch")
    every = settle(_banded(nodes), "banded")
    heads = settle(every.groupBy("bucket").agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1"), "heads")
    banded = settle(join_counted(every, heads, ["bucket"], "n").select("bucket", "id", "a"), "company")
    forget(every)
    pairs = settle(banded.where("id <> a").select("a", F.col("id").alias("b")).distinct(), "pairs")
    ids = banded.select("id").distinct()
    near = settle(_against_first(pairs, nodes, similarity), "near")
    texts = settle(_texts(docs, classes.join(ids, "id").select("id", "key")), "texts")
    banded = banded.drop("a")
    found = settle(_verified(near, texts, width, similarity), "found")
    first = settle(connected_components(found), "first").select(F.col("node").alias("id"), "root")
    more = settle(_between(banded, nodes, first, texts, width, similarity, block), "more")
    roots = settle(connected_components(found.unionByName(more)), "roots").withColumnRenamed("node", "id")
    named = settle(classes.join(roots, "id", "left").select("key", "least", "n", F.coalesce("root", "id").alias("root")), "named")
    heads = settle(named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("texts")), "component_heads")
    named = settle(join_counted(named, heads, ["root"], "texts").select("key", "component_id", "n"), "named")
    linked = join_counted(rows.select("doc_id", "size", "key").where("key is not null"), named, ["key"], "n").select("doc_id", "size", "component_id")
    alone = rows.where("key is null").select("doc_id", "size", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumnRenamed("size", "n_shingles")


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """ids: id, key.  id and text of one row of each."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [xxhash.xxh3_128_digest(b" ".join(data.lower().split())) for data in bytes_of(batch)]
            yield pa.record_batch([pa.array(keys, pa.binary()), batch.column("text")], ["key", "text"])

    keyed = doc_columns(docs, "text").where("text is not null").mapInArrow(work, "key binary, text string")
    return keyed.join(ids, "key").groupBy("id").agg(F.first("text").alias("text"))


def op11_setsketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row; nulls, repeats and empty tables as in near_duplicates(), and a row without a doc_id isn't kept by it."""
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
