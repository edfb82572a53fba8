"""The pipeline on planted documents."""

import random

import corpus_pipeline
from chronoloom.llm import bpe


def prose(rng, n):
    out = []
    for k in range(n):
        w = "".join(rng.choice(["an", "er", "th", "on", "ti", "es", "lo", "ra"]) for _ in range(rng.randint(1, 3)))
        out.append(w.capitalize() if k % 12 == 0 else w + "." if k % 12 == 11 else w)
    return " ".join(out)


def junk(rng):
    return "\n".join(" ".join([rng.choice(["Ner", "Tho", "Ras"])] * 12) for _ in range(12))


def planted(spark, path):
    rng = random.Random(7)
    docs, labels, kind = [], [], {}

    def add(text, what, quality=None):
        i = len(docs)
        docs.append((i, text, "en", f"s{i % 3}", len(text) if text is not None else None))
        kind[i] = what
        if quality is not None:
            labels.append((i, quality, 0))

    items = [(k, prose(rng, 30)) for k in range(6)]
    for _ in range(120):
        add(prose(rng, rng.randint(60, 200)), "clean", 1)
    for _ in range(60):
        add(junk(rng), "junk", 0)
    for _ in range(20):
        add(prose(rng, rng.randint(60, 200)), "clean")
        add(junk(rng), "junk")
    original = docs[3][1]
    add(original, "copy")
    add(original.replace(original.split()[30], "elsewhere", 1), "near copy")
    passage = prose(rng, 60)
    for _ in range(3):
        add(f"{prose(rng, 80)} {passage} {prose(rng, 50)}", "passage")
    add(f"{prose(rng, 70)} {items[2][1]} {prose(rng, 70)}", "leak")
    add(None, "null")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return docs, kind, passage


def test_stages(spark, tmp_path):
    docs, kind, passage = planted(spark, f"{tmp_path}/sf")
    found = {r["doc_id"]: r for r in corpus_pipeline.run(spark, f"{tmp_path}/sf").collect()}
    assert {kind[i] for i in found} <= {"clean", "passage", "null"}
    assert {i for i in kind if kind[i] in ("clean", "passage")} <= set(found)
    assert all(r["decodes"] for r in found.values())
    codec = bpe.load_codec(spark, bpe.vocabulary("byte_bpe_50k.json"))()
    texts = {i: codec.decode(r["ids"]) for i, r in found.items()}
    assert all(texts[i] == docs[i][1] for i in found if kind[i] == "clean")
    assert not any(passage in texts[i] for i in found)
    assert all(len(texts[i].split()) == 130 for i in found if kind[i] == "passage")


def test_stages_keep_the_columns(spark, tmp_path):
    planted(spark, f"{tmp_path}/sf")
    docs = spark.read.parquet(f"{tmp_path}/sf/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, f"{tmp_path}/sf").dtypes == docs.dtypes, name
        assert stage(spark, docs.limit(0), f"{tmp_path}/sf").count() == 0, name
