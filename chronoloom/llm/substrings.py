"""Substring dedup: suffix automata of reference shards, matching statistics, removal of repeated spans.

A window is `length` consecutive words; it repeats if its word sequence also starts anywhere else, in the same text or
another.  Automata of the whole corpus have no size bound that a broadcast could rest on, and each text would have to be
streamed through all of them.  So the reference is cut into shards by content, and rows are sent to the shard that can
match them instead:

1. The anchor of a window is its 8-word sequence of smallest hash (the leftmost of equals).  Equal windows have equal
   anchors at equal places.  Each text is cut into regions, the runs of windows that share an anchor; every window of
   the corpus lies in exactly one region.  Equal regions that follow each other (a word or a few, again and again) are
   one row with their number.  An anchor that occurs once has no repeated window (most anchors go here).
2. Equal regions of an anchor are counted, not copied.  If all regions of an anchor are equal, all its windows repeat.
3. Otherwise the anchor's different regions form a reference shard.  A suffix automaton over their words, weighted by
   how often each region occurs, gives for each place of a region the longest suffix that occurs twice or more (its
   matching statistics); where that reaches the window length, the window repeats.
4. An anchor with more than WIDE different regions (a common line amid different texts) would make a hot shard.  Its
   windows are taken in parts, PART neighbours at equal places to the anchor; the words that a part's windows have in
   common are counted by 128-bit fingerprints, and where they repeat, the part's windows are counted likewise.  Both
   counts are combined before they are dealt out, so no task gathers the shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bytes_of, doc_columns, join_counted, read_table, runs, settle

LENGTH, ANCHOR, WIDE, PART = 35, 8, 256, 4
SPANS = "array<struct<first: int, mask: long, size: int, times: int>>"
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_BASE, _STEP, _ROLL = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F))


class _Powers:
    """Powers of an odd base and of its inverse, modulo 2^64, as many as were asked for."""

    def __init__(self, base: np.uint64):
        self.base, self.inverse = int(base), pow(int(base), -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, base in (("up", self.base), ("down", self.inverse)):
                p = np.full(size, base, np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))
        return self.up[:n], self.down[:n]


_bytes_powers, _word_powers = _Powers(_BASE), _Powers(_STEP)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in a text in UTF-8."""
    inside = np.empty(len(data) + 2, np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = ~_WHITE[np.frombuffer(data, np.uint8)]
    step = np.diff(inside)
    return np.nonzero(step == 1)[0], np.nonzero(step == -1)[0]


def word_hashes(data: bytes) -> np.ndarray:
    starts, ends = word_bounds(data)
    raw = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    up, down = _bytes_powers.get(len(raw) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(raw * up[:-1], dtype=np.uint64)])
    return _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def _grams(words: np.ndarray, k: int) -> np.ndarray:
    grams = np.zeros(len(words) - k + 1, np.uint64)
    for j in range(k):
        grams = grams * _ROLL + words[j : len(words) - k + 1 + j]
    return _mix(grams)


def parts_of(words: list[bytes], size: int, length: int, k: int = ANCHOR) -> list[dict]:
    """Of a region's words: fingerprints of what each part's windows have in common, and of the windows."""
    lead = int(_grams(word_hashes(b" ".join(words[:length])), k).argmin())  # where the anchor stands
    found: dict[int, dict] = {}
    for i in range(size):
        p = (lead - i) // PART
        if p not in found:
            core = words[lead - PART * p : lead - PART * p - PART + 1 + length]
            found[p] = {"core": xxhash.xxh3_128_digest(b" ".join(core)), "windows": []}
        found[p]["windows"].append({"i": i, "print": xxhash.xxh3_128_digest(b" ".join(words[i : i + length]))})
    return list(found.values())


def regions(data: bytes, length: int = LENGTH, k: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a text: each region's anchor, content hash, first window, number of windows, and how often it follows itself, the first included."""
    words = word_hashes(data)
    n = len(words) - length + 1
    if n < 1:
        return (np.empty(0, np.int64),) * 5
    grams = _grams(words, k)
    span = length - k + 1
    at = np.empty(n, np.int64)
    for s in range(0, n, 1 << 15):  # by parts, so that very long texts need no more memory
        e = min(n, s + (1 << 15))
        at[s:e] = np.arange(s, e) + np.lib.stride_tricks.sliding_window_view(grams[s : e + span - 1], span).argmin(axis=1)
    first = np.concatenate([[0], np.nonzero(np.diff(at))[0] + 1])
    size = np.diff(np.append(first, n))
    up, down = _word_powers.get(len(words) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[:-1], dtype=np.uint64)])
    content = _mix((sums[first + size + length - 1] - sums[first]) * down[first] + size.astype(np.uint64))
    anchor = grams[at[first]]
    new = np.ones(len(first), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1]) | (size[1:] != size[:-1])
    times = np.diff(np.append(np.nonzero(new)[0], len(first)))
    return anchor[new].view(np.int64), content[new].view(np.int64), first[new], size[new], times


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences, each with a weight."""

    def __init__(self, sequences: list[list], weights: list[int]):
        self.length, self.link, self.next, self.count = [0], [-1], [{}], [0]
        self.ends: list[list[int]] = []
        for words, weight in zip(sequences, weights):
            last, ends = 0, []
            for w in words:
                last = self._extend(last, w)
                self.count[last] += weight
                ends.append(last)
            self.ends.append(ends)
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            self.count[self.link[s]] += self.count[s]

    def _extend(self, last: int, w) -> int:
        length, link, nxt = self.length, self.link, self.next
        q = nxt[last].get(w)
        if q is not None and length[q] == length[last] + 1:
            return q
        if q is None:
            new = self._state(length[last] + 1, {})
            p = last
            while p >= 0 and w not in nxt[p]:
                nxt[p][w] = new
                p = link[p]
            if p < 0:
                link[new] = 0
                return new
            q = nxt[p][w]
            if length[q] == length[p] + 1:
                link[new] = q
                return new
        else:
            new, p = -1, last
        copy = self._state(length[p] + 1, dict(nxt[q]))
        link[copy] = link[q]
        link[q] = copy
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = copy
            p = link[p]
        if new < 0:
            return copy
        link[new] = copy
        return new

    def _state(self, length: int, arcs: dict) -> int:
        self.length.append(length)
        self.link.append(-1)
        self.next.append(arcs)
        self.count.append(0)
        return len(self.length) - 1

    def matching(self, k: int) -> list[int]:
        """For each place of the k-th sequence, the length of the longest suffix there that occurs with weight 2 or more in all."""
        found = []
        for s in self.ends[k]:
            while s > 0 and self.count[s] < 2:
                s = self.link[s]
            found.append(self.length[s] if s > 0 else 0)
        return found


def _candidates(docs: DataFrame, length: int) -> DataFrame:
    """anchor, content, doc_id, mark, first, size, times of every region whose anchor occurs at least twice."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [regions(x, length) for x in bytes_of(batch)]
            if not found:
                continue
            each = pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found]))
            parts = [np.concatenate([f[i] for f in found]) for i in range(5)]
            yield pa.record_batch([pa.array(parts[0]), pa.array(parts[1]), batch.column("doc_id").take(each), batch.column("mark").take(each), *(pa.array(p.astype(np.int32)) for p in parts[2:])], ["anchor", "content", "doc_id", "mark", "first", "size", "times"])

    def scan(columns: str) -> DataFrame:
        return docs.mapInArrow(work, "anchor long, content long, doc_id long, mark long, first int, size int, times int").selectExpr(*columns.split())

    # stored, so that both sides of the join are plain exchanges and the part of a hot anchor can be split
    often = settle(scan("anchor times").groupBy("anchor").agg(F.sum("times").alias("n")).where("n > 1").select("anchor"), "anchors")
    return scan("anchor content doc_id mark first size times").join(often, "anchor")


def _identified(docs: DataFrame) -> DataFrame:
    """doc_id, text and mark, a hash of the text: together they tell rows apart even where a doc_id repeats."""
    rows = doc_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumn("mark", F.xxhash64("text"))


def _of_document(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Joins on doc_id (null matches null) and mark; the right side's keys go."""
    right = right.withColumnsRenamed({"doc_id": "__doc_id", "mark": "__mark"})
    return left.join(right, left["doc_id"].eqNullSafe(right["__doc_id"]) & (left["mark"] == right["__mark"]), how).drop("__doc_id", "__mark")


def _shard_masks(shards: DataFrame, length: int) -> DataFrame:
    """shards: anchor, content, weight, region (its words' bytes).  anchor, content, mask (bit i: window i repeats)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["anchor"]):
            anchor = table["anchor"].to_numpy()
            content, weight, region = table["content"].to_pylist(), table["weight"].to_pylist(), table["region"].to_pylist()
            bounds = np.append(np.concatenate([[0], np.nonzero(np.diff(anchor))[0] + 1]), len(anchor)).tolist()
            masks = []
            for s, e in zip(bounds[:-1], bounds[1:]):
                automaton = SuffixAutomaton([r.split() for r in region[s:e]], weight[s:e])
                for k in range(e - s):
                    masks.append(sum(1 << i for i, m in enumerate(automaton.matching(k)[length - 1 :]) if m >= length))
            yield pa.record_batch([pa.array(anchor), pa.array(content, pa.int64()), pa.array(masks, pa.int64())], ["anchor", "content", "mask"])

    return shards.repartition("anchor").sortWithinPartitions("anchor", "content").mapInArrow(work, "anchor long, content long, mask long")


def repeated_windows(docs: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """length: from ANCHOR to ANCHOR + 62 words, so that a region's windows fit the bits of a mask.  Two tables: doc_id, mark, spans (SPANS: first window, mask of windows; so every `size` windows, `times` times) of each text with repeated windows; and doc_id,
    mark, text of each text that has a candidate."""
    if not ANCHOR <= length < 63 + ANCHOR:
        raise ValueError(f"windows of {length} words: {ANCHOR} to {62 + ANCHOR} are possible")
    rows = _identified(docs)
    found = settle(_candidates(rows, length), "regions")
    counted = found.groupBy("anchor", "content", "size").agg(F.sum("times").alias("weight"), F.min(F.struct("doc_id", "mark", "first")).alias("at"))
    counted = settle(counted, "counted")
    groups = settle(counted.groupBy("anchor").agg(F.count("*").alias("different")), "groups")
    same = counted.join(groups.where("different = 1"), "anchor").select("anchor", "content", F.expr("shiftleft(1L, size) - 1").alias("mask"))
    mixed = counted.join(groups.where("different > 1"), "anchor").select("anchor", "content", "size", "weight", "at.*", (F.col("different") > WIDE).alias("wide"))
    holders = found.select("doc_id", "mark").distinct()
    texts = settle(_of_document(rows, holders), "texts")
    wanted = mixed.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("anchor", "content", "size", "weight", "first", "wide")).alias("regions"))
    parts = settle(_region_texts(_of_document(texts.dropDuplicates(["doc_id", "mark"]), wanted), length), "parts")
    narrow = _shard_masks(parts.where("region is not null").select("anchor", "content", "weight", "region"), length)
    cores = parts.where("region is null").select("anchor", "content", "weight", F.explode("parts").alias("p")).select("anchor", "content", "weight", "p.*")
    # counts are stored, and what holds a large part of the rows is joined where they lie
    common = settle(cores.groupBy("core").agg(F.sum("weight").alias("n"), F.count("*").alias("rows")).where("n > 1").drop("n"), "cores")
    windows = settle(join_counted(cores, common, ["core"], "rows").select("anchor", "content", "weight", F.explode("windows").alias("w")).select("anchor", "content", "weight", "w.*"), "windows")
    twice = settle(windows.groupBy("print").agg(F.sum("weight").alias("n"), F.count("*").alias("rows")).where("n > 1").drop("n"), "twice")
    wide = join_counted(windows, twice, ["print"], "rows").groupBy("anchor", "content").agg(F.expr("bit_or(shiftleft(1L, i))").alias("mask"))
    masks = settle(same.unionByName(narrow).unionByName(wide).where("mask <> 0"), "masks")
    spans = found.join(masks, ["anchor", "content"]).groupBy("doc_id", "mark").agg(F.collect_set(F.struct("first", "mask", "size", "times")).alias("spans"))
    return settle(spans, "spans"), texts


def _region_texts(rows: DataFrame, length: int) -> DataFrame:
    """anchor, content, weight, and region (the words, joined by one space) or, of a wide anchor, its parts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[dict] = []
            for data, wanted in zip(bytes_of(batch), batch.column("regions").to_pylist()):
                words = data.split()
                for r in wanted:
                    own = words[r["first"] : r["first"] + r["size"] + length - 1]
                    out.append({"anchor": r["anchor"], "content": r["content"], "weight": r["weight"], "region": None if r["wide"] else b" ".join(own), "parts": parts_of(own, r["size"], length) if r["wide"] else None})
                    if len(out) >= 5000:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)

    schema = pa.schema([("anchor", pa.int64()), ("content", pa.int64()), ("weight", pa.int64()), ("region", pa.binary()), ("parts", pa.list_(pa.struct([("core", pa.binary()), ("windows", pa.list_(pa.struct([("i", pa.int32()), ("print", pa.binary())])))])))])
    return rows.select("text", "regions").mapInArrow(work, "anchor long, content long, weight long, region binary, parts array<struct<core: binary, windows: array<struct<i: int, print: binary>>>>")


def keep_words(data: bytes, spans: list[dict], length: int) -> tuple[list[bytes], int]:
    """The words that no repeated window covers, and the number of all words."""
    words = data.split()
    if not spans:
        return words, len(words)
    step = np.zeros(len(words) + 1, np.int64)
    for s in spans:
        mask, at, size = s["mask"], s["first"], s["size"]
        reach = (s["times"] - 1) * size + 1
        while mask:
            if mask & 1:
                step[at : at + reach : size] += 1
                step[at + length : at + length + reach : size] -= 1
            mask >>= 1
            at += 1
    return [w for w, covered in zip(words, np.cumsum(step[:-1]).tolist()) if not covered], len(words)


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """All rows and columns of docs; a text with repeated windows becomes its remaining words, joined by one space.

    Texts without a repeated window stay as they are, as do null and empty ones.  Rows that repeat a doc_id and a text
    are occurrences of their own: each loses what the other holds too.  An empty table gives an empty table.
    """
    spans, _ = repeated_windows(docs, length)
    # the row is kept in one column, so that no name of its own can clash
    row = F.struct(*(docs[c] for c in docs.columns)).alias("row")
    whole = docs.select(row, docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("mark"))
    joined = _of_document(whole, spans, "left").select("row", "spans")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("row")
            columns, fields = rows.flatten(), list(rows.type)
            at = [f.name for f in fields].index("text")
            texts = []
            for text, spans in zip(columns[at], batch.column("spans").to_pylist()):
                texts.append(b" ".join(keep_words(text.as_buffer().to_pybytes(), spans, length)[0]).decode("utf-8", "replace") if spans and text.is_valid else text.as_py())
            columns[at] = pa.array(texts, pa.string())
            yield pa.record_batch([pa.StructArray.from_arrays(columns, fields=fields)], ["row"])

    kind = T.StructType([T.StructField("row", T.StructType(docs.schema.fields))])
    return joined.mapInArrow(work, kind).select("row.*")


def _digests(rows: DataFrame, length: int) -> DataFrame:
    """rows: doc_id, mark, text, spans.  doc_id, mark, n_words, n_removed, kept_sha256."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, digest = [], [], []
            for data, spans in zip(bytes_of(batch), batch.column("spans").to_pylist()):
                kept, words = keep_words(data, spans, length)
                n.append(words)
                removed.append(words - len(kept))
                digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.record_batch([batch.column("doc_id"), batch.column("mark"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "mark", "n_words", "n_removed", "kept_sha256"])

    return rows.select("doc_id", "mark", "text", "spans").mapInArrow(work, "doc_id long, mark long, n_words long, n_removed long, kept_sha256 string")


def digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row; only texts with candidates are moved between executors."""
    spans, texts = repeated_windows(docs, length)
    changed = _digests(_of_document(texts, spans), length)
    whole = _digests(_identified(docs).withColumn("spans", F.array().cast(SPANS)), length)
    kept = _of_document(whole, spans.select("doc_id", "mark"), "left_anti")
    return changed.unionByName(kept).drop("mark")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row; null texts have no words, repeated rows are occurrences of their own."""
    return digests(read_table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
h AS (SELECT doc_id, list_transform(range(1, greatest(len(w) - 33, 1)), lambda i: md5(array_to_string(list_slice(w, i, i + 34), ' '))) AS hs FROM d),
k AS (SELECT doc_id, unnest(range(1, len(hs) + 1)) AS i, unnest(hs) AS h FROM h),
r AS (SELECT doc_id, i FROM k QUALIFY count(*) OVER (PARTITION BY h) > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM r),
a AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS word FROM d),
s AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS kept, count(*) AS n FROM a ANTI JOIN c USING (doc_id, j) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s USING (doc_id)
"""
