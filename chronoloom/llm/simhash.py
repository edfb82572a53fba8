"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints are linked when they differ in at most `reach` bits.  The 64 bits are cut in blocks, m more than the
reach: two fingerprints within reach agree in m blocks at least, so every link lies in a bucket (which m blocks, their
bits).  m grows with the number of fingerprints, so buckets stay small.  In a bucket the fingerprints are sorted by
Gray rank; leaves of consecutive fingerprints keep the bit pattern that their members share, upper nodes the pattern
that their leaves share, and a lookup adds up the differences from the root down and leaves a whole group out once the
sum exceeds the reach.  A bucket larger than BLOCK is dealt in pairs of parts, so no task holds more than two parts; of
each bucket only a spanning forest of its links is kept, nearest links first.

Where a similarity of texts is asked for as well, fingerprints only choose what is compared: every link is verified by
the texts, also between different texts of one fingerprint, and where a link of the forest lacks the similarity, all
links between what is still apart are verified in their bucket before a forest is taken.  Those fingerprints are of the
different pairs of neighbouring words, since a changed word changes five shingles of five words but two of two: at a
similarity of 0.8 in shingles of five, fingerprints of these lie about as near as others do at 0.9.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bytes_of, doc_columns, join_counted, read_table, runs, settle
from .components import connected_components

SHINGLE, SEED, REACH = 4, 42, 4
BLOCK, LEAF, FAN = 4096, 32, 8
#: Fingerprints of a part of a bucket whose texts are compared there.
TEXT_BLOCK = 1024
#: Bits of a bucket's key at least.
FINE = 8
#: Large buckets up to which their list is sent to every task.
FEW = 100_000
#: Of texts to be thinned out: words of a shingle, similarity, words of a shingle of their fingerprints (each counted once), and
#: the bits by which such texts' fingerprints mostly differ at most.
THIN_WIDTH, SIMILARITY, PRINT_WIDTH, THIN_REACH = 5, 0.8, 2, 10
_SLICE = 1 << 15
#: What a pair of parts of a bucket is known by.
KEYS = ["mask", "value", "lo", "hi"]


def fingerprint(data: bytes, width: int = SHINGLE, distinct: bool = False) -> int:
    """The 64-bit fingerprint of a text in UTF-8; 0 if it has no word.  distinct: shingles that repeat count once."""
    words = data.lower().split()
    if not words:
        return 0
    if distinct:
        found = list(shingles(data, width))
    else:
        found = [b" ".join(words)] if len(words) < width else list(map(b" ".join, zip(*(words[i:] for i in range(width)))))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(found), _SLICE):
        part = found[at : at + _SLICE]
        h = np.fromiter(map(xxhash.xxh64_intdigest, part, repeat(SEED)), np.uint64, len(part))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(found), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE, distinct: bool = False) -> DataFrame:
    """doc_id, mark (md5 of the text) and fp (the fingerprint as a signed long) of every row; a null text counts as empty."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(x, width, distinct) for x in bytes_of(batch)], np.uint64).view(np.int64)
            yield pa.record_batch([batch.column("doc_id"), batch.column("mark"), pa.array(fp, pa.int64())], ["doc_id", "mark", "fp"])

    return _marked(docs).mapInArrow(work, "doc_id long, mark string, fp long")


def _marked(docs: DataFrame) -> DataFrame:
    rows = doc_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumn("mark", F.md5("text"))


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each 64-bit word in the reflected Gray order."""
    x = x.astype(np.uint64, copy=True)
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def _shared(x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each run that begins at starts: the bits that all its members share, and their values."""
    both, either = np.bitwise_and.reduceat(x, starts), np.bitwise_or.reduceat(x, starts)
    return ~(both ^ either), both


class GrayIndex:
    """Hierarchical index of distinct fingerprints."""

    def __init__(self, fps: np.ndarray):
        self.fps = fps[np.argsort(gray_rank(fps), kind="stable")]
        self.leaf = np.arange(0, len(fps), LEAF)
        self.leaf_mask, self.leaf_bits = _shared(self.fps, self.leaf)
        up = np.arange(0, len(self.leaf), FAN)
        all_leaves = np.append(self.leaf, len(fps))
        self.top_mask, self.top_bits = _shared(self.fps, all_leaves[up])
        self.leaf_mask &= ~np.repeat(self.top_mask, FAN)[: len(self.leaf)]  # a leaf keeps only what its upper node lacks

    def links(self, queries: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (place in queries, place in self.fps) within reach, block by block."""
        step = max(1, (1 << 20) // max(1, len(self.top_mask) * FAN))
        for at in range(0, len(queries), step):
            q = queries[at : at + step]
            far = np.bitwise_count((q[:, None] ^ self.top_bits) & self.top_mask)
            i, node = np.nonzero(far <= reach)
            far = far[i, node]
            i, far = np.repeat(i, FAN), np.repeat(far, FAN)
            leaf = (node[:, None] * FAN + np.arange(FAN)).ravel()
            keep = leaf < len(self.leaf)
            i, far, leaf = i[keep], far[keep], leaf[keep]
            far = far + np.bitwise_count((q[i] ^ self.leaf_bits[leaf]) & self.leaf_mask[leaf])
            keep = far <= reach
            i, leaf = i[keep], leaf[keep]
            for s in range(0, len(i), 1 << 15):
                k = (self.leaf[leaf[s : s + (1 << 15)], None] + np.arange(LEAF)).ravel()
                j = np.repeat(i[s : s + (1 << 15)], LEAF)
                keep = k < len(self.fps)
                j, k = j[keep], k[keep]
                keep = np.bitwise_count(q[j] ^ self.fps[k]) <= reach
                yield j[keep] + at, k[keep]


def forest(left: np.ndarray, right: np.ndarray, reach: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between left and right (or within left, if they are the same)."""
    index = GrayIndex(right)
    nodes = np.unique(np.concatenate([left, right]))
    root = np.arange(len(nodes))
    at_left, at_right = np.searchsorted(nodes, left), np.searchsorted(nodes, index.fps)
    kept = []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for j, k in index.links(left, reach):
        a, b = at_left[j], at_right[k]
        differ = root[a] != root[b]
        a, b = a[differ], b[differ]
        near = np.argsort(np.bitwise_count(nodes[a] ^ nodes[b]), kind="stable")
        for x, y in zip(a[near].tolist(), b[near].tolist()):
            p, q = find(x), find(y)
            if p != q:
                root[max(p, q)] = min(p, q)
                kept.append((x, y))
        for _ in range(3):
            root = root[root]
    signed = nodes.view(np.int64)
    return [(int(signed[x]), int(signed[y])) for x, y in kept]


def masks(n: int, reach: int, block: int = BLOCK) -> list[int]:
    """Bit masks such that any two fingerprints within reach agree on one: all choices of m out of reach + m blocks, with
    the least m, 3 at most, that takes FINE bits and for which n evenly spread fingerprints make buckets of no more than block."""
    for m in (1, 2, 3):
        blocks = reach + m
        if m == 3 or 64 * m // blocks >= FINE and n <= block << (64 * m // blocks):
            break
    bounds = [64 * i // blocks for i in range(blocks + 1)]
    parts = [(1 << high) - (1 << low) for low, high in zip(bounds, bounds[1:])]
    return [sum(chosen) for chosen in combinations(parts, m)]


def _dealt(fps: DataFrame, chosen: list[int], block: int) -> DataFrame:
    """The rows of fps (fp and further columns) in each of their buckets: mask, value, lo, hi (a pair of the bucket's parts), own (the row's part)."""
    signed = [m - (1 << 64) if m >> 63 else m for m in chosen]
    keyed = fps.withColumn("k", F.explode(F.array(*(F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("value")) for i, m in enumerate(signed)))))
    keyed = keyed.select(*fps.columns, "k.*")
    large = settle(keyed.groupBy("mask", "value").count().where(F.col("count") > block), "large")
    large = F.broadcast(large) if large.count() <= FEW else large
    keyed = keyed.join(large, ["mask", "value"], "left")
    # a bucket over the block size: each fingerprint goes to every pair of parts that holds its own
    parts = F.ceil(F.coalesce("count", F.lit(1)) / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64(*fps.columns, "mask"), parts).cast("int")
    keyed = keyed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    return keyed.select(*fps.columns, "mask", "value", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own")


def _buckets(table: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each pair of parts in a table sorted by KEYS: its mask, and the places of the rows to compare with each other (the same twice in a part)."""
    k = np.stack([table[x].to_numpy().astype(np.int64) for x in KEYS])
    own = table["own"].to_numpy()
    starts = np.append(np.concatenate([[0], np.nonzero((k[:, 1:] != k[:, :-1]).any(axis=0))[0] + 1]), k.shape[1])
    for s, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
        at = np.arange(s, e)
        if k[2, s] == k[3, s]:
            if e - s > 1:
                yield int(k[0, s]), at, at
        else:
            first = own[s:e] == k[2, s]
            if first.any() and not first.all():
                yield int(k[0, s]), at[first], at[~first]


def fingerprint_links(fps: DataFrame, reach: int = REACH, block: int = BLOCK) -> DataFrame:
    """fps: distinct fp.  Links a, b that connect exactly what the links within reach connect."""
    keyed = _dealt(fps.select("fp"), masks(fps.count(), reach, block), block)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, KEYS):
            fp = table["fp"].to_numpy().view(np.uint64)
            out = [x for _, left, right in _buckets(table) for x in forest(fp[left], fp[right], reach)]
            if out:
                a, b = zip(*out)
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return keyed.repartition(*KEYS).sortWithinPartitions(*KEYS, "fp").mapInArrow(work, "a long, b long")


def shingles(data: bytes, width: int) -> set[bytes]:
    words = data.lower().split()
    return {b" ".join(words)} if len(words) < width else set(map(b" ".join, zip(*(words[i:] for i in range(width)))))


def _overlap(x: set[bytes], y: set[bytes], similarity: float) -> bool:
    if min(len(x), len(y)) < similarity * max(len(x), len(y)):
        return False
    both = len(x & y)
    return both >= similarity * (len(x) + len(y) - both)


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted: mark, least (of its rows' doc_ids).  mark and text of each; rows that repeat both are combined before they are dealt out."""
    rows, wanted = _marked(docs), wanted.select("least", F.col("mark").alias("own"))
    found = rows.join(wanted, (rows["mark"] == wanted["own"]) & rows["doc_id"].eqNullSafe(wanted["least"]))
    return settle(found.groupBy("mark").agg(F.first("text").alias("text")), "texts")


def _similar(links: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """The links (of marks) whose texts share so much of their shingles."""
    ends = links.select(F.explode(F.array("a", "b")).alias("mark")).distinct()
    texts = _texts(docs, nodes.join(ends, "mark").select("mark", "least"))
    both = links.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b").select("a", "b", "text_a", "text_b")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(bytes_of(batch, "text_a"), bytes_of(batch, "text_b")):
                keep.append(_overlap(shingles(x, width), shingles(y, width), similarity))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(work, "a string, b string")


def _apart(fp: np.ndarray, root: np.ndarray, left: np.ndarray, right: np.ndarray, reach: int, lower: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs within reach that have different roots and agree on none of the lower masks, where they would be found as well."""
    index = GrayIndex(fp[right])
    places = right[np.argsort(gray_rank(fp[right]), kind="stable")]
    for j, k in index.links(fp[left], reach):
        x, y = left[j], places[k]
        keep = root[x] != root[y]
        if left is right:
            keep &= x < y
        x, y = x[keep], y[keep]
        for m in lower:
            keep = (fp[x] ^ fp[y]) & m != 0
            x, y = x[keep], y[keep]
        yield x, y


def links_between(nodes: DataFrame, texts: DataFrame, width: int, reach: int, similarity: float, block: int = TEXT_BLOCK) -> DataFrame:
    """nodes: mark, fp, root.  texts: mark, text.  Links a, b (of marks) within reach and of that similarity that connect, with
    the links within each root, exactly what all such links connect."""
    chosen = masks(nodes.count(), reach, block)
    bits = np.array(chosen, np.uint64)
    kind = "fp long, root string, mark string, mask int, value long, lo int, hi int, own int"

    def columns(table: pa.Table) -> tuple[np.ndarray, list[str], np.ndarray]:
        root = table["root"].to_pylist()
        return table["fp"].to_numpy().view(np.uint64), root, np.unique(np.array(root, object), return_inverse=True)[1]

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows that have a pair to compare."""
        for table in runs(batches, KEYS):
            fp, _, root = columns(table)
            wanted = np.zeros(len(fp), bool)
            for mask, left, right in _buckets(table):
                for x, y in _apart(fp, root, left, right, reach, bits[:mask]):
                    wanted[x] = wanted[y] = True
            yield from table.filter(pa.array(wanted)).to_batches()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, KEYS):
            fp, name, root = columns(table)
            data, mark = table["text"].cast(pa.binary()), table["mark"].to_pylist()
            out = []
            for mask, left, right in _buckets(table):
                sets = {i: shingles(data[i].as_py(), width) for i in np.union1d(left, right).tolist()}
                above: dict[str, str] = {}

                def find(x: str) -> str:
                    while x in above:
                        above[x] = above.get(above[x], above[x])
                        x = above[x]
                    return x

                for x, y in _apart(fp, root, left, right, reach, bits[:mask]):
                    for i, j in zip(x.tolist(), y.tolist()):
                        p, q = find(name[i]), find(name[j])
                        if p != q and _overlap(sets[i], sets[j], similarity):
                            above[max(p, q)] = min(p, q)
                            out.append((mark[i], mark[j]))
            if out:
                a, b = map(list, zip(*out))
                yield pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])

    def sort(df: DataFrame) -> DataFrame:
        return df.repartition(*KEYS).sortWithinPartitions(*KEYS, "fp", "mark")

    wanted = settle(sort(_dealt(nodes.select("fp", "root", "mark"), chosen, block)).mapInArrow(some, kind), "wanted")
    return sort(wanted.join(texts, "mark")).mapInArrow(work, "a string, b string")


def similar_links(nodes: DataFrame, docs: DataFrame, width: int, reach: int, similarity: float) -> DataFrame:
    """nodes: mark, fp, least of each different text.  Links of marks that connect exactly what the links within reach and of that similarity connect.

    First a forest of the links within reach is verified, in which the texts of one fingerprint hang on one of them.  A
    link that lacks the similarity may have stood for others that have it.  Only the groups that fall apart so are
    looked at again; of the others nothing can be missing.
    """
    classes = settle(nodes.groupBy("fp").agg(F.min("mark").alias("head"), F.count("*").alias("n")), "classes")
    heads = classes.select("fp", "head")
    between = fingerprint_links(classes.select("fp"), reach).distinct().toDF("x", "y")
    between = between.join(heads.toDF("x", "a"), "x").join(heads.toDF("y", "b"), "y").select("a", "b")
    within = join_counted(nodes.select("fp", "mark"), settle(classes.where("n > 1"), "shared"), ["fp"], "n").where("mark <> head").select(F.col("head").alias("a"), F.col("mark").alias("b"))
    links = settle(between.unionByName(within), "forest")
    similar = settle(_similar(links, nodes, docs, width, similarity), "similar")
    groups, parts = settle(connected_components(links), "groups"), settle(connected_components(similar), "parts")
    apart = groups.toDF("mark", "group").distinct().join(parts.toDF("mark", "root").distinct(), "mark", "left").withColumn("root", F.coalesce("root", "mark"))
    split = apart.groupBy("group").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("group")
    apart = settle(apart.join(split, "group").join(nodes, "mark").select("mark", "fp", "root", "least"), "apart")
    if apart.isEmpty():
        return similar
    return similar.unionByName(settle(links_between(apart, _texts(docs, apart), width, reach, similarity), "between"))


def near_duplicates(docs: DataFrame, width: int = SHINGLE, reach: int = REACH) -> DataFrame:
    """doc_id, fp and component_id of every row of docs (doc_id, text; further columns are not looked at).

    component_id is the smallest doc_id reachable over links: fingerprints within reach.  Null and empty texts have the
    fingerprint zero and are linked like others; rows that repeat a doc_id keep their own row; rows without a doc_id are
    linked by their text but never name a component (a component of only such rows has the id null).  An empty table
    gives an empty table.
    """
    rows = settle(fingerprints(docs, width).select("doc_id", "fp"), "fingerprints")
    classes = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "classes")
    roots = settle(connected_components(fingerprint_links(classes.select("fp"), reach)), "roots")
    named = settle(classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")), "named")
    heads = settle(named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("texts")), "heads")
    named = settle(join_counted(named, heads, ["root"], "texts").select("fp", "component_id", "n"), "named")
    return join_counted(rows, named, ["fp"], "n").select("doc_id", "fp", "component_id")


def similar_texts(docs: DataFrame, width: int = THIN_WIDTH, reach: int = THIN_REACH, similarity: float = SIMILARITY, print_width: int = PRINT_WIDTH) -> DataFrame:
    """mark (md5), least, n and root of each different text of docs (doc_id, text).

    Texts of one root are connected by links: fingerprints (of the different shingles of print_width words) within reach,
    and sets of shingles of `width` words that overlap by `similarity` of their union.  least is the smallest doc_id of
    the text's rows, null if none has one, and n how many rows have that id and text.  Null texts count as empty; texts
    without a word are alike.
    """
    rows = settle(fingerprints(docs, print_width, True).groupBy("mark", "doc_id").agg(F.min("fp").alias("fp"), F.count("*").alias("n")), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("n"))).alias("first")
    nodes = settle(rows.groupBy("mark").agg(F.min("fp").alias("fp"), first).select("mark", "fp", F.col("first.doc_id").alias("least"), F.col("first.n").alias("n")), "nodes")
    roots = settle(connected_components(similar_links(nodes, docs, width, reach, similarity)), "roots")
    return nodes.join(roots, nodes["mark"] == roots["node"], "left").select("mark", "least", "n", F.coalesce("root", "mark").alias("root"))


def keep_one(docs: DataFrame, width: int = THIN_WIDTH, reach: int = THIN_REACH, similarity: float = SIMILARITY, print_width: int = PRINT_WIDTH) -> DataFrame:
    """One row of each group of similar_texts(), all columns as they were: that of the smallest doc_id (ids before null, ties by the text's md5).

    Rows are told apart by doc_id and text, so a doc_id that repeats with another text is judged for itself; of rows that
    repeat both one stays.  An empty table gives an empty table.
    """
    found = settle(similar_texts(docs, width, reach, similarity, print_width), "texts")
    first = F.min(F.struct(F.col("least").isNull().alias("none"), F.col("least"), F.col("mark"), F.col("n"))).alias("first")
    kept = found.groupBy("root").agg(first).select(F.coalesce("first.least", F.lit(0).cast("long")).alias("id"), F.col("first.none").alias("none"), F.col("first.mark").alias("mark"))
    # the row is kept in one column, so that no name of its own can clash
    row = F.struct(*(docs[c] for c in docs.columns)).alias("row")
    own = docs["doc_id"].cast("long")
    keyed = docs.select(row, F.coalesce(own, F.lit(0).cast("long")).alias("id"), own.isNull().alias("none"), F.md5(F.coalesce(docs["text"], F.lit(""))).alias("mark"))
    return keyed.join(kept, ["id", "none", "mark"], "left_semi").dropDuplicates(["id", "none", "mark"]).select("row.*")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint and component_id of every row; nulls, repeats and empty tables as in near_duplicates()."""
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
