"""Token ids in seekable files: independent zstandard frames, a seek table at the end, a checksum for each frame.

A file is one shard of the documents in ascending doc_id order:

    frame of document 0 | frame of document 1 | ... | directory (skippable) | seek table (skippable)

A frame holds one document's ids as little-endian unsigned 32-bit integers.  The directory is a skippable frame
(magic 0x184D2A50) that holds, for each document, its id and the number of ids before it in the file, as signed 64-bit
integers (a null doc_id has the smallest integer).  The seek table follows the public seekable format: a skippable
frame (magic 0x184D2A5E) with the compressed size, the decompressed size and the low 32 bits of the content's XXH64
for each frame, then the number of frames, a descriptor byte (0x80: checksums are there) and the magic 0x8F92EAB1.  A
reader reads the end of the file, then only the frames of the documents asked for.

Files are written under a temporary name and moved into place, so a task that runs again leaves one whole file.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import byte_alphabet, vocabulary
from .common import bytes_of, doc_columns, read_table, shared_dir

#: Fixed values of the seekable format.
SEEK_MAGIC, FOOTER_MAGIC, DIRECTORY_MAGIC, CHECKED = 0x184D2A5E, 0x8F92EAB1, 0x184D2A50, 0x80
NO_ID = -(1 << 63)
#: Entries that a worker keeps for chunks of plain texts and of others, and their length at most, so that the memory is
#: bounded; beyond them it computes anew.
CHUNKS, OTHERS, LONGEST = 700_000, 100_000, 64


def frame(ids: np.ndarray, packer: zstandard.ZstdCompressor) -> tuple[bytes, tuple[int, int, int]]:
    raw = ids.astype("<u4").tobytes()
    packed = packer.compress(raw)
    return packed, (len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF)


def trailer(directory: list[tuple[int, int]], entries: list[tuple[int, int, int]]) -> bytes:
    listed = np.array(directory, "<i8").tobytes()
    table = np.array(entries, "<u4").tobytes() + struct.pack("<IBI", len(entries), CHECKED, FOOTER_MAGIC)
    return struct.pack("<II", DIRECTORY_MAGIC, len(listed)) + listed + struct.pack("<II", SEEK_MAGIC, len(table)) + table


class TokenFile:
    """Random access to one file.  source: a seekable binary file object of `size` bytes."""

    def __init__(self, source, size: int):
        self.source = source
        source.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != FOOTER_MAGIC or flags != CHECKED:
            raise ValueError("no seek table at the end of the file")
        source.seek(size - 9 - 12 * n - 8 - 16 * n - 8)
        body = source.read(8 + 16 * n + 8 + 12 * n)
        if struct.unpack("<II", body[:8]) != (DIRECTORY_MAGIC, 16 * n) or struct.unpack("<II", body[8 + 16 * n : 16 + 16 * n]) != (SEEK_MAGIC, 12 * n + 9):
            raise ValueError("damaged directory or seek table")
        self.directory = np.frombuffer(body, "<i8", 2 * n, 8).reshape(n, 2)
        self.entries = np.frombuffer(body, "<u4", 3 * n, 16 + 16 * n).reshape(n, 3).astype(np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.entries[:, 0])])
        self.unpack = zstandard.ZstdDecompressor().decompress

    def __len__(self) -> int:
        return len(self.entries)

    def ids(self, k: int) -> np.ndarray:
        """The ids of the k-th document; only its frame is read."""
        self.source.seek(int(self.offsets[k]))
        return self._checked(k, self.source.read(int(self.entries[k, 0])))

    def _checked(self, k: int, packed: bytes) -> np.ndarray:
        raw = self.unpack(packed, max_output_size=int(self.entries[k, 1])) if self.entries[k, 1] else b""
        if len(raw) != self.entries[k, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.entries[k, 2]:
            raise ValueError(f"checksum of frame {k} differs")
        return np.frombuffer(raw, "<u4")

    def places(self, doc_ids) -> np.ndarray:
        """The frames of the given documents that are in the file."""
        return np.nonzero(np.isin(self.directory[:, 0], np.asarray(list(doc_ids), np.int64)))[0]

    def scan(self) -> Iterator[np.ndarray]:
        """The ids of each document in order, read front to back."""
        self.source.seek(0)
        for k, size in enumerate(self.entries[:, 0].tolist()):
            yield self._checked(k, self.source.read(size))


class _Plain(dict):
    """Lower-case chunk of plain characters -> its ids as little-endian bytes, word by word from the library's own model."""

    #: Fixed value: the tokenizer file's pattern, for those characters.
    cut = re.compile("[a-zß-öø-ÿ]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^\\s0-9a-zß-öø-ÿ]+").findall

    def __init__(self, tokenizer: Tokenizer):
        super().__init__()
        self.tokenize, self.pack = tokenizer.model.tokenize, lambda ids: struct.pack(f"<{len(ids)}I", *ids)
        spelled = {b: c for c, b in byte_alphabet().items()}
        self.spelling = {c: "".join(spelled[b] for b in chr(c).encode()) for c in range(256)}

    def __missing__(self, chunk: str) -> bytes:
        words = self.cut(chunk)
        if len(words) == 1:
            ids = self.pack([t.id for t in self.tokenize(chunk.translate(self.spelling))])
        else:
            ids = b"".join(map(self.__getitem__, words))
        if len(self) < CHUNKS and len(chunk) <= LONGEST:
            self[chunk] = ids
        return ids


class TextEncoder(dict):
    """Ids of a text as the tokenizers library gives them, for a tokenizer that drops white space.

    Such a tokenizer never joins what white space parts, so a text is taken chunk by chunk, and a worker encodes each
    distinct chunk once: a text of plain characters by the library's model, after lower-casing and the tokenizer's own
    pattern; any other text by the library whole.
    """

    #: ASCII without < (special tokens), and Latin-1 letters: for these lower() is the normalizer.
    plain = re.compile("[\\t-\\r !-;=-~À-ÿ]*").fullmatch

    def __init__(self, spec: str):
        super().__init__()
        tokenizer = Tokenizer.from_str(spec)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self.tokenizer, self.chunks = tokenizer, _Plain(tokenizer)

    def __missing__(self, chunk: bytes) -> bytes:
        ids = np.array(self.tokenizer.encode(chunk.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()
        if len(self) < OTHERS and len(chunk) <= LONGEST:
            self[chunk] = ids
        return ids

    def encode(self, data: bytes) -> bytes:
        text = data.decode("utf-8", "replace")
        if self.plain(text):
            return b"".join(map(self.chunks.__getitem__, text.lower().split()))
        return b"".join(map(self.__getitem__, data.split()))


_ENCODERS: dict[int, TextEncoder] = {}


def _open(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri) if "://" in uri else pyarrow.fs.FileSystem.from_uri(f"file://{uri.removeprefix('file:')}")


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> DataFrame:
    """Encodes every text (null: empty), appends end_id and writes the files under folder, a URI that all executors reach.

    Returns a row per file: shard, path, n_docs, n_tokens.  Shards follow one another in ascending doc_id (null ids
    come first); rows that repeat a doc_id each keep a frame; an empty table writes no file.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(open(tokenizer, encoding="utf-8").read())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        shard = TaskContext.get().partitionId()
        fs, base = _open(folder)
        name = f"{base}/shard-{shard:06d}.tok"
        part = f"{base}/.shard-{shard:06d}-{uuid.uuid4().hex}"
        directory: list[tuple[int, int]] = []
        entries: list[tuple[int, int, int]] = []
        before, out = 0, None
        packer = zstandard.ZstdCompressor(level=1, write_checksum=False)
        for batch in batches:
            if not batch.num_rows:
                continue
            key = hash(sent.value)
            encode = (_ENCODERS.get(key) or _ENCODERS.setdefault(key, TextEncoder(sent.value))).encode
            out = out or fs.open_output_stream(part)
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), bytes_of(batch)):
                ids = np.frombuffer(encode(data) + struct.pack("<I", end_id), "<u4")
                packed, entry = frame(ids, packer)
                out.write(packed)
                directory.append((NO_ID if doc_id is None else doc_id, before))
                entries.append(entry)
                before += len(ids)
        if out:
            out.write(trailer(directory, entries))
            out.close()
            fs.move(part, name)
            yield pa.RecordBatch.from_pylist([{"shard": shard, "path": f"{folder.rstrip('/')}/shard-{shard:06d}.tok", "n_docs": len(entries), "n_tokens": before}])

    rows = doc_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    fs, base = _open(folder)
    fs.create_dir(base, recursive=True)
    return rows.mapInArrow(work, "shard long, path string, n_docs long, n_tokens long")


def read_token_files(spark: SparkSession, files: list, doc_ids: list[int] | None = None, ids: bool = True) -> DataFrame:
    """files: the rows that write_token_files returned (one for each file, so bounded by the number of files).

    Returns doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, the ids themselves.
    With doc_ids only those documents' frames are read and decompressed.
    """
    first, listed = 0, []
    for f in sorted(files, key=lambda f: f["shard"]):
        listed.append((f["path"], first))
        first += f["n_tokens"]
    wanted = None if doc_ids is None else sorted(doc_ids)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("first").to_pylist()):
                fs, name = _open(path)
                with fs.open_input_file(name) as source:
                    tokens = TokenFile(source, source.size())
                    places = range(len(tokens)) if wanted is None else tokens.places(wanted).tolist()
                    found = tokens.scan() if wanted is None else map(tokens.ids, places)
                    rows: list[tuple] = []
                    weight = 0
                    for k, got in zip(places, found):
                        doc_id, before = tokens.directory[k].tolist()
                        rows.append((None if doc_id == NO_ID else doc_id, first + before, len(got), zlib.crc32(got), got.astype(np.int32) if ids else None))
                        weight += len(got) if ids else 1
                        if weight >= 1_000_000:
                            yield _batch(rows, ids)
                            rows, weight = [], 0
                    if rows:
                        yield _batch(rows, ids)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids
    table = spark.createDataFrame(listed, "path string, first long")
    return table.repartition(max(1, len(listed))).mapInArrow(work, schema)


def _batch(rows: list[tuple], ids: bool) -> pa.RecordBatch:
    columns = list(zip(*rows))
    arrays = [pa.array(c, pa.int64()) for c in columns[:4]]
    if ids:
        arrays.append(pa.array(list(columns[4]), pa.list_(pa.int32())))
    return pa.record_batch(arrays, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(arrays)])


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every row, read back from the files; null texts are empty, an empty table has no file and no row."""
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    files = write_token_files(read_table(spark, sf_dir, "documents"), folder, vocabulary("word_bpe_49k.json"), 2).collect()
    return read_token_files(spark, files, ids=False)
