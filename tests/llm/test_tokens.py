"""BPE automaton and token files against the tokenizers library."""

import hashlib
import json
import random
import zlib

import numpy as np
import pyarrow.fs
import pytest
from tokenizers import Tokenizer

from chronoloom.llm import bpe, tokenfile

BYTE, WORD = bpe.vocabulary("byte_bpe_50k.json"), bpe.vocabulary("word_bpe_49k.json")
ALPHABETS = ["ab", "a", "aeiou ths", "abcdefghijklmnopqrstuvwxyz   ", "  \n\tab'sd1!", "éèß日本語中文абв a", "0123456789 .,", "ABc İΣσς ́<|>", "don't we'LL 'S 12 34a5"]
TEXTS = ["", "a<|endoftext|>b <|endoftext|><|startoftext|>", "a" * 5000, "ab" * 3000, " " * 300, "\x85\xa0\u2003x", "word " * 20000]


def samples(n):
    rng = random.Random(5)
    return TEXTS + ["".join(rng.choice(a) for _ in range(rng.randint(0, 40))) for a in ALPHABETS for _ in range(n)]


def test_codec_is_the_library():
    codec, library = bpe.Codec(json.load(open(BYTE))), Tokenizer.from_file(BYTE)
    for text in samples(300):
        ids = codec.encode(text).tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False) == text


@pytest.mark.parametrize("merges", [[("a", "a")], [("a", "a"), ("aa", "a")], [("a", "b"), ("b", "a"), ("ab", "a")], [("b", "a"), ("a", "ba"), ("a", "a"), ("aa", "aa")]])
def test_automaton_accepts_only_merged_sequences(merges):
    labels = [bytes([c]) for c in range(256)]
    ids = {chr(c): c for c in range(128)}
    rules = []
    for u, v in merges:
        ids[u + v] = len(labels)
        labels.append((u + v).encode())
        rules.append((ids[u], ids[v], ids[u + v]))
    automaton = bpe.TokenAutomaton(labels, rules)
    rng = random.Random(1)
    for _ in range(300):
        word = "".join(rng.choice("ab") for _ in range(rng.randint(1, 14)))
        parts = list(word)
        for u, v in merges:  # plain merging
            at = 0
            while at < len(parts) - 1:
                if (parts[at], parts[at + 1]) == (u, v):
                    parts[at : at + 2] = [u + v]
                at += 1
        assert automaton.encode(word.encode()) == [ids[p] for p in parts]


def test_round_trip_and_documents(spark):
    rows = [(i, t, "x") for i, t in enumerate(samples(3))] + [(None, None, "y"), (0, "again", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    library = Tokenizer.from_file(BYTE)
    found = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.round_trip(docs, BYTE).collect()}
    expected = set()
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        expected.add((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert found == expected
    coded = bpe.encode_documents(docs, BYTE)  # replaces the clashing column
    assert coded.columns == ["doc_id", "text", "ids"]
    back = bpe.decode_documents(coded.withColumnRenamed("text", "before"), BYTE)
    assert all((r["before"] or "") == r["text"] for r in back.collect())
    assert bpe.round_trip(docs.limit(0), BYTE).count() == 0


def test_encoder_of_files_is_the_library():
    own, library = tokenfile.TextEncoder(open(WORD).read()), Tokenizer.from_file(WORD)
    for text in samples(300):
        assert np.frombuffer(own.encode(text.encode()), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_files(spark, tmp_path):
    rows = [(i * 7 % 101, t, 1) for i, t in enumerate(samples(2))] + [(None, None, 2), (3, "twice", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int")
    files = tokenfile.write_token_files(docs, f"file://{tmp_path}/t", WORD, 2).collect()
    library = Tokenizer.from_file(WORD)
    expected = sorted(((i, library.encode(t or "", add_special_tokens=False).ids + [2]) for i, t, _ in rows), key=lambda x: (x[0] is not None, x[0] or 0))
    found = tokenfile.read_token_files(spark, files).collect()
    found.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in found] == [i for i, _ in expected]
    assert sorted(map(tuple, (r["ids"] for r in found))) == sorted(tuple(ids) for _, ids in expected)
    before = 0
    for r in found:
        assert r["start"] == before and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        before += r["n_tokens"]
    some = tokenfile.read_token_files(spark, files, doc_ids=[3, 14]).collect()
    assert sorted(r["doc_id"] for r in some) == sorted(i for i, _ in expected if i in (3, 14))
    assert tokenfile.read_token_files(spark, tokenfile.write_token_files(docs.limit(0), f"file://{tmp_path}/e", WORD, 2).collect()).count() == 0


def test_damage_is_noticed(spark, tmp_path):
    files = tokenfile.write_token_files(spark.createDataFrame([(1, "some words here")], "doc_id long, text string").coalesce(1), f"file://{tmp_path}/t", WORD, 2).collect()
    path = files[0]["path"].removeprefix("file://")
    data = bytearray(open(path, "rb").read())
    data[10] ^= 1
    open(path, "wb").write(data)
    with pyarrow.fs.LocalFileSystem().open_input_file(path) as source, pytest.raises(Exception):
        tokenfile.TokenFile(source, source.size()).ids(0)
