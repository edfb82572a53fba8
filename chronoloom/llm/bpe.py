"""Byte-pair encoding and decoding by a token automaton compiled from the merges.

The automaton reads tokens: its states are the last token read (and a start state), and it accepts exactly the token
sequences that byte-pair merging can leave.  It begins as one loop for each byte and grows by one gadget for each merge
(u, v) -> w, in rank order.  The gadget
  * cuts the arc v from the state behind u, since the pair no longer survives, and
  * adds the arc w wherever u could be taken and v after it; the state behind w starts as that behind v.
An explicit table would have a cell for each pair of tokens (2.5e9 here), so a state keeps the gadget that made it and
inherits its arcs as they stood then; `step` resolves a cell along those gadgets once and keeps it in the table.

A word is encoded by walking the arcs that spell it: at each place the longest arc that the table allows is tried
first, and dead ends are remembered.  Since one sequence is accepted for each word, the walk that reaches the end is
the encoding.  Decoding emits the arcs' labels.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import doc_columns, read_table, texts_of

#: Fixed value: the pattern of byte-level tokenizers that splits text before the merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words, their length, and table cells that a worker keeps at most; beyond them it computes anew.
WORDS, LONGEST, CELLS = 400_000, 64, 1_000_000


def byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class TokenAutomaton:
    """labels: bytes of each token id.  merges: (left id, right id, id) in rank order."""

    def __init__(self, labels: list[bytes], merges: list[tuple[int, int, int]]):
        self.labels = labels
        n = len(labels)
        self.rank, self.left, self.right = [-1] * n, [-1] * n, [-1] * n
        self.cut: dict[tuple[int, int], int] = {}
        self.cells: dict[tuple[int, int], bool] = {}
        made = {w for _, _, w in merges}
        self.arcs = {label: t for t, label in enumerate(labels) if len(label) == 1 and t not in made}
        for rank, (u, v, w) in enumerate(merges):
            self._gadget(rank, u, v, w)
        self.longest = max(map(len, self.arcs))

    def _gadget(self, rank: int, u: int, v: int, w: int) -> None:
        if self._resolve(u, v, rank):  # else no path spells w through u and v, and the gadget adds no arc
            self.rank[w], self.left[w], self.right[w] = rank, u, v
            self.arcs[self.labels[w]] = w
        self.cut.setdefault((u, v), rank)

    def _resolve(self, state: int, arc: int, before: int) -> bool:
        """Whether the state had the arc when the gadgets up to `before`, without it, were in place."""
        cut, rank = self.cut, self.rank
        while True:
            at = cut.get((state, arc))
            if at is not None and at < before:
                return False
            r, a = rank[state], rank[arc]
            if r < 0 and a < 0:
                return True
            if a >= r:  # the arc is the younger: it was put where its left part could be taken, its own cut included
                arc, before = self.left[arc], a + 1
            else:  # the state is the younger: it began as the state behind its right part
                state, before = self.right[state], r

    def step(self, state: int, arc: int) -> bool:
        cell = self.cells.get((state, arc))
        if cell is None:
            cell = self._resolve(state, arc, 1 << 40)
            if len(self.cells) < CELLS:
                self.cells[state, arc] = cell
        return cell

    def encode(self, word: bytes) -> list[int]:
        arcs, n = self.arcs, len(word)
        whole = arcs.get(word)
        if whole is not None:
            return [whole]
        path: list[int] = []
        ends = [0]
        tries = [min(n, self.longest)]
        dead: set[tuple[int, int]] = set()
        while True:
            at, size = ends[-1], tries[-1]
            while size:
                arc = arcs.get(word[at : at + size])
                if arc is not None and (not path or self.step(path[-1], arc)) and (at + size, arc) not in dead:
                    break
                size -= 1
            if not size:  # a dead end: one arc back, and shorter
                ends.pop()
                tries.pop()
                dead.add((at, path.pop()))
                continue
            tries[-1] = size - 1
            path.append(arc)
            if at + size == n:
                return path
            ends.append(at + size)
            tries.append(min(n - at - size, self.longest))


class _Words(dict):
    """Word -> its ids as little-endian bytes."""

    def __init__(self, automaton: TokenAutomaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.automaton.encode(word.encode()), "<i4").tobytes()
        if len(self) < WORDS and len(word) <= LONGEST:
            self[word] = ids
        return ids


class Codec:
    """A byte-level tokenizer file of the tokenizers library, with special tokens taken from texts as that library does."""

    def __init__(self, spec: dict):
        alphabet = byte_alphabet()
        vocab, special = spec["model"]["vocab"], {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels = [b""] * (max([*vocab.values(), *special.values()]) + 1)
        for token, i in vocab.items():
            if token not in special:
                self.labels[i] = bytes(alphabet[c] for c in token)
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.words = _Words(TokenAutomaton(self.labels, [(vocab[u], vocab[v], vocab[u + v]) for u, v in pairs]))
        for token, i in special.items():
            self.labels[i] = token.encode()
        self.special = special
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.find = regex.compile(PATTERN).findall
        self.decimal = [str(i).encode() for i in range(len(self.labels))]

    def encode(self, text: str) -> np.ndarray:
        word = self.words.__getitem__
        if self.split is None or not any(s in text for s in self.special):
            return np.frombuffer(b"".join(map(word, self.find(text))), "<i4")
        parts = []
        for part in self.split.split(text):
            own = self.special.get(part)
            parts.append(b"".join(map(word, self.find(part))) if own is None else np.array([own], "<i4").tobytes())
        return np.frombuffer(b"".join(parts), "<i4")

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}


def load_codec(spark: SparkSession, path: str):
    """A broadcast of the tokenizer file's text (a few MB, read on the driver) as a function that gives the codec.

    A worker compiles the automaton once and keeps it for its later tasks.
    """
    text = open(path, encoding="utf-8").read() if "://" not in path else "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    key, sent = hashlib.sha256(text.encode()).hexdigest(), spark.sparkContext.broadcast(text)

    def codec() -> Codec:
        if key not in _CODECS:
            _CODECS[key] = Codec(json.loads(sent.value))
        return _CODECS[key]

    return codec


def encode_documents(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """All columns of docs, and the ids of the text (null and empty texts: no ids) in a new column, which replaces one of that name.

    Rows are independent of one another: ties, repeated rows and repeated doc_ids need no rule; an empty table gives
    an empty table.
    """
    codec = load_codec(docs.sparkSession, path)
    rest = [f for f in docs.schema if f.name != ids]
    schema = T.StructType([*rest, T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = codec().encode
        for batch in batches:
            found = pa.array([encode(x) for x in texts_of(batch, text)], pa.list_(pa.int32()))
            yield pa.record_batch([*batch.columns, found], [*batch.schema.names, ids])

    return docs.select(*(docs[f.name] for f in rest)).mapInArrow(work, schema)


def decode_documents(docs: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """All columns of docs, and the text that the ids spell (null: the empty text) in a column, which replaces one of that name."""
    codec = load_codec(docs.sparkSession, path)
    rest = [f for f in docs.schema if f.name != text]
    schema = T.StructType([*rest, T.StructField(text, T.StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = codec().decode
        for batch in batches:
            found = pa.array([decode(x or []) for x in batch.column(ids).to_pylist()], pa.string())
            yield pa.record_batch([*batch.columns, found], [*batch.schema.names, text])

    return docs.select(*(docs[f.name] for f in rest)).mapInArrow(work, schema)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row: encodes, and decodes what it encoded, in one pass.

    The ids stay in the worker, so a pass over a large table moves only the digests.  Null texts count as empty.
    """
    codec = load_codec(docs.sparkSession, path)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec()
        for batch in batches:
            n, coded, decoded = [], [], []
            for text in texts_of(batch):
                ids = c.encode(text).tolist()
                n.append(len(ids))
                coded.append(hashlib.sha256(b",".join(map(c.decimal.__getitem__, ids))).hexdigest())
                decoded.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
            yield pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = doc_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_checked(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids and decodes (the ids spell the text, null as empty) of every row."""
    codec = load_codec(docs.sparkSession, path)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec()
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):  # ids take more room than text
                part = batch.slice(start, 1000)
                ids, same = [], []
                for text in texts_of(part):
                    ids.append(c.encode(text))
                    same.append(c.decode(ids[-1].tolist()) == text)
                columns = [part.column("doc_id"), part.column("lang"), part.column("source"), pa.array([len(i) for i in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(same, pa.bool_())]
                yield pa.record_batch(columns, ["doc_id", "lang", "source", "n_tokens", "ids", "decodes"])

    rows = doc_columns(docs, "doc_id", "lang", "source", "text")
    return rows.mapInArrow(work, "doc_id long, lang string, source string, n_tokens long, ids array<int>, decodes boolean")


def vocabulary(name: str) -> str:
    """Where the installed public vocabularies keep a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row; null texts count as empty, repeated rows each have their own."""
    return round_trip(read_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
