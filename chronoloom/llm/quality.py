"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

    y(x) = b + sum_i w_i x_i + 1/2 sum_f [ (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2 ]

The bracket is the sum over all pairs <v_i, v_j> x_i x_j, in time linear in the features.  Features of a text: its
lower-cased words, hashed (log counts, of unit length together), and its structure and size in steps (share of
repeated neighbours, of distinct words, of capitals, signs, digits and bars, word and line length, number of words and
bytes).  No label, language, source or id is a feature.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bytes_of, crc_mod, doc_columns, read_table

#: Labelled rows that training takes at most: those with the smallest hash of their id, the same in every run.
TRAIN_ROWS = 6000
#: Slots of hashed words, steps of each statistic, rank, passes over the sample.
SLOTS, STEPS, RANK, EPOCHS = 1 << 14, 12, 8, 6
STATISTICS = 10
WIDTH = SLOTS + STATISTICS * STEPS
WORDS = 500_000


class _Slots(dict):
    """Word in UTF-8 -> its slot."""

    def __missing__(self, word: bytes) -> int:
        slot = xxhash.xxh32_intdigest(word) % SLOTS
        if len(self) < WORDS:
            self[word] = slot
        return slot


_slots = _Slots()
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SIGN = np.zeros(256, bool)
_SIGN[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def _step(share: float) -> int:
    return min(STEPS - 1, int(share * STEPS))


def features(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the features of a text in UTF-8."""
    words = data.lower().split()
    n = len(words)
    slot = np.fromiter(map(_slots.__getitem__, words), np.int64, n)
    counts = np.bincount(slot, minlength=0) if n else np.empty(0, np.int64)
    used = np.nonzero(counts)[0]
    weight = np.log1p(counts[used])
    size = float(np.sqrt(weight @ weight)) or 1.0
    chars = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    total = max(1, len(data))
    lines = data.count(b"\n") + 1
    statistics = [
        _step(np.count_nonzero(slot[1:] == slot[:-1]) / max(1, n - 1)),
        _step(len(used) / max(1, n)),
        _step(min(1.0, chars[_UPPER].sum() / total * 1.2)),
        _step(min(1.0, chars[_SIGN].sum() / total * 4)),
        _step(min(1.0, chars[_DIGIT].sum() / total * 4)),
        _step(min(1.0, chars[124] / max(1, n))),
        _step(min(1.0, len(data) / max(1, n) / 24)),
        _step(min(1.0, np.log2(1 + n / lines) / 12)),
        _step(min(1.0, np.log2(1 + n) / 18)),
        _step(min(1.0, np.log2(1 + len(data)) / 24)),
    ]
    places = np.concatenate([used, SLOTS + STEPS * np.arange(STATISTICS) + statistics])
    return places, np.concatenate([weight / size, np.full(STATISTICS, 0.5)])


class FactorisationMachine:
    def __init__(self, width: int = WIDTH, rank: int = RANK, seed: int = 7):
        self.bias = 0.0
        self.linear = np.zeros(width)
        self.factors = np.random.default_rng(seed).normal(0, 0.02, (width, rank))

    def margin(self, places: np.ndarray, values: np.ndarray) -> float:
        v = self.factors[places]
        sums = values @ v
        return self.bias + float(values @ self.linear[places]) + 0.5 * float(sums @ sums - (values * values) @ (v * v).sum(axis=1))

    def score(self, places: np.ndarray, values: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.margin(places, values), -30, 30))))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], epochs: int = EPOCHS, rate: float = 0.15, decay: float = 1e-5, seed: int = 7) -> FactorisationMachine:
        """Logistic loss, one row at a time with Adagrad steps."""
        rng = np.random.default_rng(seed)
        g_linear, g_factors = np.full_like(self.linear, 1e-2), np.full_like(self.factors, 1e-2)
        share = (sum(labels) + 0.5) / (len(labels) + 1)
        self.bias = float(np.log(share / (1 - share)))
        g_bias = 1.0
        for _ in range(epochs):
            for r in rng.permutation(len(rows)).tolist():
                places, values = rows[r][0], rows[r][1].astype(np.float64)
                error = self.score(places, values) - labels[r]
                v = self.factors[places]
                sums = values @ v
                d_linear = error * values + decay * self.linear[places]
                d_factors = error * (values[:, None] * sums - v * (values * values)[:, None]) + decay * v
                g_linear[places] += d_linear * d_linear
                g_factors[places] += d_factors * d_factors
                g_bias += error * error
                self.linear[places] -= rate * d_linear / np.sqrt(g_linear[places])
                self.factors[places] -= 0.3 * rate * d_factors / np.sqrt(g_factors[places])
                self.bias -= rate * error / np.sqrt(g_bias)
        return self


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> FactorisationMachine:
    """docs: doc_id, text.  labels: doc_id, label (0 or 1; other values and nulls are passed over; of several the smallest counts).

    Without labels every score is a half.
    """
    clean = labels.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("label").alias("label"))
    chosen = clean.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)  # limit rows, so small enough to send to every task
    sample = doc_columns(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumn("mark", F.xxhash64(F.coalesce("text", F.lit(""))))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(x) for x in bytes_of(batch)]
            yield pa.record_batch([batch.column("doc_id"), batch.column("mark"), batch.column("label").cast(pa.int32()), pa.array([p.astype(np.int32).tobytes() for p, _ in found], pa.binary()), pa.array([v.astype(np.float32).tobytes() for _, v in found], pa.binary())], ["doc_id", "mark", "label", "places", "values"])

    seen: dict[int, tuple] = {}  # limit rows, each as two rows of bytes: neither the driver's JVM nor Python has an object for each number
    for row in sample.select(F.col("doc_id").cast("long"), "mark", "label", "text").mapInArrow(work, "doc_id long, mark long, label int, places binary, values binary").toLocalIterator():
        key = (row["doc_id"], row["mark"])  # rows that repeat a doc_id and a text count once
        if key not in seen:
            seen[key] = np.frombuffer(row["places"], np.int32), np.frombuffer(row["values"], np.float32), row["label"]
    rows = [seen[k] for k in sorted(seen)]
    model = FactorisationMachine()
    if not rows:
        return model
    return model.fit([(p, v) for p, v, _ in rows], [y for _, _, y in rows])


def score_documents(docs: DataFrame, model: FactorisationMachine) -> DataFrame:
    """doc_id and score of every row (doc_id, text); null texts count as empty, an empty table gives an empty table."""
    sent = docs.sparkSession.sparkContext.broadcast((model.bias, model.linear.astype(np.float32), model.factors.astype(np.float32)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = FactorisationMachine(1, 1)
        own.bias, own.linear, own.factors = sent.value
        for batch in batches:
            scores = [own.score(*features(x)) for x in bytes_of(batch)]
            yield pa.record_batch([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return doc_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "doc_id long, score double")


def keep_good(docs: DataFrame, model: FactorisationMachine, threshold: float = 0.5) -> DataFrame:
    """The rows of docs whose text scores at least the threshold, all columns as they were.

    Null texts count as empty; each row is judged by its text alone, so repeated rows and ids fare alike; an empty table gives an empty table.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.bias, model.linear.astype(np.float32), model.factors.astype(np.float32)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = FactorisationMachine(1, 1)
        own.bias, own.linear, own.factors = sent.value
        for batch in batches:
            yield batch.filter(pa.array([own.score(*features(x)) >= threshold for x in bytes_of(batch)], pa.bool_()))

    return docs.mapInArrow(work, T.StructType(docs.schema.fields))


def training_labels(labels: DataFrame) -> DataFrame:
    """The labels that the classifier may learn from."""
    return labels.where(crc_mod(F.col("doc_id"), 3) != 1).select("doc_id", F.col("quality").alias("label"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; null texts count as empty, rows without an id are not held out."""
    docs = read_table(spark, sf_dir, "documents")
    scored = score_documents(docs, train(docs, training_labels(read_table(spark, sf_dir, "labels"))))
    return scored.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
