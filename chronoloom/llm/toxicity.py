"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

A text's vector has all its terms that an example has, with (1 + log count) * idf * (FLOOR + association) as weight and
unit length; idf counts all documents, association is the phi coefficient of term and label on the examples, so words that tell
the labels apart weigh most and no word is left out.  Without labels of both kinds it is the plain TF-IDF.

Examples are ordered by label and cluster and cut in blocks.  Of terms that many examples have, the index keeps the largest
weight in each block and the weights of a block as a matrix; of the others, postings.  A query sums its postings, adds the
block maxima of its common terms to an upper bound for each block, visits blocks from the highest bound down and leaves out those
whose bound is below the k-th best cosine: no example that could enter the k best is lost.  The k nearest vote with the
weight 1 / (distance + SOFT), the vote is calibrated on the examples, each judged by the others, and the neighbours are the evidence.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, doc_columns, read_table, settle, texts_of

#: What training takes at most: labelled rows, those with the smallest hash of their id, and different terms of all of them together.
TRAIN_ROWS, TRAIN_TERMS = 12_000, 6_000_000
#: Weight of a term that says nothing about labels, beside an association of 0 to 1.
FLOOR = 0.02
#: Neighbours, examples in a block, softening of distances, steps of the calibration.
K, BLOCK, SOFT, STEPS = 15, 16, 0.05, 20
#: A term in one of so many examples or more is common; texts that are looked up at once; blocks a text visits in the first round.
DENSE, AT_ONCE, FIRST = 16, 128, 16
#: Clusters that order the examples, by so many of the commonest terms, in so many rounds.
CLUSTERS, CLUSTER_TERMS, CLUSTER_ROUNDS = 64, 512, 4
#: A term: a run of letters.
_terms = re.compile(r"[^\W\d_]+").findall


class BlockMaxIndex:
    """place: number of each term; scale: its weight; ends, codes, counts: the terms of example d are codes[ends[d]:ends[d + 1]]; ids, labels: of the examples.

    Examples are numbered in the order of their blocks.  The index is sent as these counts, and each worker builds postings and matrices from them once.
    """

    def __init__(self, place: dict[str, int], scale: np.ndarray, ends: np.ndarray, codes: np.ndarray, counts: np.ndarray, ids: np.ndarray, labels: np.ndarray):
        self.place, self.scale, self.ends, self.codes, self.counts, self.ids, self.labels = place, scale, ends, codes, counts, ids, labels
        self.size, self.blocks = len(ids), -(-len(ids) // BLOCK)
        self.visited = self.met = 0  # blocks whose cosines were taken, of all that queries met
        self.matrix: np.ndarray | None = None

    def __reduce__(self):
        terms = sorted(self.place, key=self.place.__getitem__)
        small = [x.astype(np.min_scalar_type(int(x.max(initial=0)))) for x in (self.ends, self.codes, self.counts)]
        return _unpacked, (terms, self.scale, *small, self.ids, self.labels)

    def build(self) -> BlockMaxIndex:
        if self.matrix is not None or not self.size:
            return self
        row = np.repeat(np.arange(self.size, dtype=np.int32), np.diff(self.ends))
        own = (1 + np.log(self.counts)) * self.scale[self.codes]
        own /= np.sqrt(np.bincount(row, own * own, self.size))[row]
        total = np.bincount(self.codes, minlength=len(self.place))
        common = np.nonzero(total * DENSE > self.size)[0]
        self.row = np.full(len(self.place), -1, np.int32)
        self.row[common] = np.arange(len(common))
        at = self.row[self.codes]
        wide, few = at >= 0, at < 0
        self.matrix = np.zeros((self.blocks, len(common), BLOCK))
        self.matrix[row[wide] // BLOCK, at[wide], row[wide] % BLOCK] = own[wide]
        self.most = self.matrix.max(axis=2).T.copy()
        order = np.argsort(self.codes[few], kind="stable")
        self.docs, self.weights = row[few][order], own[few][order]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(self.codes[few], minlength=len(self.place)))])
        return self

    def vector(self, counts: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        known = [t for t in counts if t in self.place]
        terms = np.fromiter(map(self.place.__getitem__, known), np.int64, len(known))
        order = np.argsort(terms)
        return self._unit(terms[order], np.fromiter(map(counts.__getitem__, known), float, len(known))[order])

    def example(self, d: int) -> tuple[np.ndarray, np.ndarray]:
        s, e = self.ends[d], self.ends[d + 1]
        return self._unit(self.codes[s:e].astype(np.int64), self.counts[s:e].astype(float))

    def _unit(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(counts)) * self.scale[terms]
        return terms, w / np.sqrt(w @ w) if len(w) else w

    def nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int = K, without: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of each vector, places and cosines of the k nearest examples (cosine over 0, ties to the smaller id, then place)."""
        self.build()
        for at in range(0, len(vectors), AT_ONCE):
            yield from self._nearest(vectors[at : at + AT_ONCE], k, None if without is None else without[at : at + AT_ONCE])

    def _nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int, without: list[int] | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if not self.size:
            yield from ((np.empty(0, np.int64), np.empty(0)) for _ in vectors)
            return
        n = len(vectors)
        left, few = np.zeros((n, self.matrix.shape[1])), np.zeros((n, self.blocks * BLOCK))
        for i, (terms, w) in enumerate(vectors):
            row = self.row[terms]
            left[i, row[row >= 0]] = w[row >= 0]
            terms, w = terms[row < 0], w[row < 0]
            sizes = self.starts[terms + 1] - self.starts[terms]
            where = np.arange(sizes.sum()) + np.repeat(self.starts[terms] - np.cumsum(sizes) + sizes, sizes)
            few[i] = np.bincount(self.docs[where], self.weights[where] * np.repeat(w, sizes), few.shape[1])
        bounds = left @ self.most + few.reshape(n, self.blocks, BLOCK).max(axis=2) + 1e-9
        cosines, floor = np.full(few.shape, -1.0), np.full(n, 1e-9)
        for most in (FIRST, self.blocks):
            wanted = bounds > np.maximum(floor, 2e-9)[:, None]
            if most < self.blocks:
                last = np.partition(bounds, -most, axis=1)[:, -most]
                wanted &= bounds >= last[:, None]
            for b in np.nonzero(wanted.any(axis=0))[0].tolist():
                rows, span = np.nonzero(wanted[:, b])[0], slice(b * BLOCK, (b + 1) * BLOCK)
                cosines[rows, span] = few[rows, span] + left[rows] @ self.matrix[b]
            bounds[wanted] = -1
            self.visited += int(wanted.sum())
            if without is not None:
                cosines[np.arange(n), without] = -1
            if cosines.shape[1] > k:
                floor = np.partition(cosines, -k, axis=1)[:, -k]
        self.met += bounds.size
        for i in range(n):
            docs = np.nonzero(cosines[i] >= max(1e-12, floor[i] - 1e-11))[0]
            found = np.round(cosines[i, docs], 12)
            docs = docs[np.lexsort((docs, self.ids[docs], -found))[:k]]
            yield docs, cosines[i, docs]

    def vote(self, docs: np.ndarray, cosines: np.ndarray) -> int:
        """The step of the weighted share of label 1 among the neighbours; the last step if there is none."""
        if not len(docs):
            return STEPS + 1
        w = 1 / (np.maximum(0.0, 1 - cosines) + SOFT)
        return int(round(STEPS * float(w @ self.labels[docs]) / float(w.sum())))


def _unpacked(terms: list[str], scale: np.ndarray, ends: np.ndarray, codes: np.ndarray, counts: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> BlockMaxIndex:
    return BlockMaxIndex({t: i for i, t in enumerate(terms)}, scale, ends.astype(np.int64), codes.astype(np.int32), counts.astype(np.int32), ids, labels)


@dataclass
class Model:
    """The index, as it was sent to the workers (None without examples), and the calibrated score by step of the vote."""

    index: BlockMaxIndex
    sent: Broadcast | None
    calibration: np.ndarray


def rising(steps: list[int], labels: np.ndarray, all_labels: np.ndarray) -> np.ndarray:
    """Share of label 1 by step; steps are pooled until they rise.  The last step is that of rows without neighbours."""
    seen, ones = np.zeros(STEPS + 2), np.zeros(STEPS + 2)
    np.add.at(seen, steps, 1)
    np.add.at(ones, steps, labels)
    prior = all_labels.mean() if len(all_labels) else 0.5
    ideal = np.linspace(0, 1, STEPS + 1)
    groups = [[ones[i] + ideal[i], seen[i] + 1, 1] for i in range(STEPS + 1)]
    pooled: list[list[float]] = []
    for g in groups:  # pool adjacent violators
        pooled.append(list(g))
        while len(pooled) > 1 and pooled[-2][0] / pooled[-2][1] > pooled[-1][0] / pooled[-1][1]:
            last = pooled.pop()
            pooled[-1] = [a + b for a, b in zip(pooled[-1], last)]
    shares = [g[0] / g[1] for g in pooled for _ in range(int(g[2]))]
    none = (ones[-1] + prior) / (seen[-1] + 1)
    return np.array([*shares, none])


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS, most_terms: int = TRAIN_TERMS) -> Model:
    """docs: doc_id, text.  labels: doc_id, label (0 or 1; other values and nulls are passed over; of several the largest counts).

    Equal texts count once.  Without labels every score is a half.
    """
    clean = labels.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = clean.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)  # limit rows, so small enough to send to every task
    rows = doc_columns(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.col("doc_id").cast("long"), "label", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.groupBy(F.xxhash64("text").alias("h"), "label").agg(F.min_by("text", "doc_id").alias("text"), F.min("doc_id").alias("doc_id")).drop("h")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Counter(_terms(x.lower())) for x in texts_of(batch)]
            yield pa.record_batch([batch.column("doc_id"), batch.column("label").cast(pa.int32()), pa.array([list(c) for c in found], pa.list_(pa.string())), pa.array([list(c.values()) for c in found], pa.list_(pa.int32()))], ["doc_id", "label", "terms", "counts"])

    bags = settle(rows.mapInArrow(work, "doc_id long, label int, terms array<string>, counts array<int>"), "bags")
    bags = bags.where(F.size("terms") > 0).withColumn("place", F.xxhash64("doc_id"))
    sizes = bags.select("place", "doc_id", "label", F.size("terms").alias("size")).orderBy("place", "doc_id", "label").toPandas()  # limit rows of four numbers
    fit = sizes[sizes["size"].cumsum() <= most_terms]
    if fit.empty:
        return Model(BlockMaxIndex({}, np.empty(0), np.zeros(1, np.int64), np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0)), None, np.full(STEPS + 2, 0.5))
    index = _index(docs, bags.where(F.col("place") <= int(fit["place"].max())))
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(index)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The vote of the other examples on each."""
        own = sent.value
        for batch in batches:
            places = batch.column("id").to_pylist()
            steps = [own.vote(*found) for found in own.nearest([own.example(d) for d in places], without=places)]
            yield pa.record_batch([batch.column("id"), pa.array(steps, pa.int32())], ["id", "step"])

    votes = spark.range(0, index.size, 1, max(1, index.size // 512)).mapInArrow(judge, "id long, step int").toArrow()
    labels = index.labels[votes["id"].to_numpy()]
    return Model(index, sent, rising(votes["step"].to_pylist(), labels, labels))


def _index(docs: DataFrame, bags: DataFrame) -> BlockMaxIndex:
    """The index over all terms of the examples."""
    table = bags.orderBy("doc_id", "label").select("doc_id", "label", "terms", "counts").toArrow()  # TRAIN_TERMS terms at most
    ids, labels = table["doc_id"].to_numpy(), table["label"].to_numpy().astype(float)
    lists = table["terms"].combine_chunks()
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())]).astype(np.int64)
    coded = pc.dictionary_encode(lists.flatten())
    place, codes = {t: i for i, t in enumerate(coded.dictionary.to_pylist())}, coded.indices.to_numpy()
    counts = table["counts"].combine_chunks().flatten().to_numpy()
    del table, lists, coded  # the driver has no room for two
    sent = docs.sparkSession.sparkContext.broadcast(place)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many documents of the task have each term."""
        place = sent.value
        df = np.zeros(len(place) + 1, np.int64)  # the last counts the documents
        for batch in batches:
            for x in texts_of(batch):
                df[[place[t] for t in place.keys() & _terms(x.lower())]] += 1
            df[-1] += batch.num_rows
        some = np.nonzero(df)[0]
        for at in range(0, len(some), 1 << 16):
            yield pa.record_batch([pa.array(some[at : at + (1 << 16)]), pa.array(df[some[at : at + (1 << 16)]])], ["term", "df"])

    found = doc_columns(docs, "text").mapInArrow(work, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    sent.destroy()
    df = np.zeros(len(place) + 1)
    df[found["term"].to_numpy()] = found["df"].to_numpy()
    row = np.repeat(np.arange(len(ids)), np.diff(ends))
    scale = (np.log((1 + df[-1]) / (1 + df[:-1])) + 1) * (FLOOR + association(codes, labels[row], len(place), labels))
    order = clustered(row, codes, counts, scale, labels)
    sizes = np.diff(ends)[order]
    moved = np.concatenate([[0], np.cumsum(sizes)])
    where = np.arange(len(codes)) + np.repeat(ends[order] - moved[:-1], sizes)
    return BlockMaxIndex(place, scale, moved, codes[where], counts[where], ids[order], labels[order])


def association(codes: np.ndarray, label: np.ndarray, terms: int, labels: np.ndarray) -> np.ndarray:
    """Size of the phi coefficient of having a term and of the label, over the examples; 0 where one of them doesn't vary."""
    n, ones = float(len(labels)), float(labels.sum())
    both, seen = np.bincount(codes, label, terms), np.bincount(codes, minlength=terms).astype(float)
    spread = np.sqrt(seen * (n - seen) * ones * (n - ones))
    return np.divide(np.abs(n * both - seen * ones), spread, out=np.zeros(terms), where=spread > 0)


def clustered(row: np.ndarray, codes: np.ndarray, counts: np.ndarray, scale: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """The examples by label and cluster, so that those of a block are alike: rounds of means of unit vectors, from centres evenly spaced."""
    size = len(labels)
    common = np.argsort(-np.bincount(codes, minlength=len(scale)), kind="stable")[:CLUSTER_TERMS]
    at = np.full(len(scale), -1)
    at[common] = np.arange(len(common))
    held = at[codes] >= 0
    vectors = np.zeros((size, len(common)), np.float32)
    vectors[row[held], at[codes[held]]] = (1 + np.log(counts[held])) * scale[codes[held]]
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    centres = vectors[np.linspace(0, size - 1, min(CLUSTERS, size)).astype(int)]
    for _ in range(CLUSTER_ROUNDS):
        near = np.argmax(vectors @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, vectors)
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    cosines = vectors @ centres.T
    near = np.argmax(cosines, axis=1)
    return np.lexsort((-cosines[np.arange(size), near], near, labels))


def score_documents(docs: DataFrame, model: Model, evidence: int = 3) -> DataFrame:
    """doc_id, score, evidence (the nearest examples: doc_id, label, cosine) of every row (doc_id, text).

    Null texts count as empty; texts without a term of any example have no evidence and the calibrated score of such texts.
    """
    index_sent, calibration = model.sent, model.calibration
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("label", pa.int32()), ("cosine", pa.float64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None if index_sent is None else index_sent.value
        for batch in batches:
            texts = texts_of(batch)
            found: dict[str, tuple] = {}
            different = list(dict.fromkeys(texts)) if own else []
            for at in range(0, len(different), AT_ONCE):
                part = different[at : at + AT_ONCE]
                for text, (places, cosines) in zip(part, own.nearest([own.vector(Counter(_terms(x.lower()))) for x in part])):
                    seen = [{"doc_id": int(own.ids[d]), "label": int(own.labels[d]), "cosine": float(c)} for d, c in zip(places[:evidence].tolist(), cosines.tolist())]
                    found[text] = float(calibration[own.vote(places, cosines)]), seen
            got = [found.get(x, (float(calibration[-1]), [])) for x in texts]
            yield pa.record_batch([batch.column("doc_id"), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], kind)], ["doc_id", "score", "evidence"])

    rows = doc_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(work, "doc_id long, score double, evidence array<struct<doc_id: long, label: int, cosine: double>>")


def op2_toxicity_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence of every row; null texts count as empty, rows without an id are not held out."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = train(docs, labels.where(crc_mod(F.col("doc_id"), 5) != 0).select("doc_id", F.col("toxic").alias("label")))
    held = F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out")
    return score_documents(docs, model).select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
