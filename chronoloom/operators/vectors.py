"""TF-IDF in long form, normalisation, detrending by year, similarity of pairs and top terms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stopwords import ENGLISH

#: Documents are dealt in GROUPS groups, or more of HELD times DOCS at most.
DOCS, GROUPS, HELD = 2048, 12, 32
#: A term: two or more letters, digits or underscores.
TERM = r"[\p{L}\p{N}_]{2,}"


def term_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, term, tf: counts of the lower-case terms that are no stop words."""
    terms = docs.select(key, F.explode(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(TERM), F.lit(0))).alias("term"))
    return terms.where(~F.col("term").isin(ENGLISH)).groupBy(key, "term").agg(F.count("*").alias("tf"))


def vocabulary(counts: DataFrame, n: DataFrame, min_df: int, max_df: float, max_features: int) -> DataFrame:
    """term, df, idf.  n: one row, n.  Terms in min_df documents at least and a share max_df at most; of those the most frequent."""
    terms = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    kept = terms.join(F.broadcast(n)).where((F.col("df") >= min_df) & (F.col("df") <= F.col("n") * max_df))  # n is one row
    kept = kept.orderBy(F.desc("cf"), "term").limit(max_features)
    return kept.select("term", "df", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def tfidf(docs: DataFrame, key: str, text: str, min_df: int = 3, max_df: float = 0.4, max_features: int = 20000) -> DataFrame:
    """key, term, w: (1 + ln tf) idf, of unit length for each document.  Documents without a term have no row."""
    counts = term_counts(docs, key, text)
    words = vocabulary(counts, docs.agg(F.count("*").alias("n")), min_df, max_df, max_features)
    raw = counts.join(F.broadcast(words), "term").select(key, "term", ((1 + F.log("tf")) * F.col("idf")).alias("w"))  # max_features rows at most
    lengths = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("len"))
    return raw.join(lengths, key).select(key, "term", (F.col("w") / F.greatest("len", F.lit(1e-9))).alias("w"))


def term_vectors(docs: DataFrame, key: str, text: str, cut, min_df: int = 3, max_df: float = 0.4, max_features: int = 20000) -> tuple[DataFrame, list[float]]:
    """The weights of tfidf() in a row for each document: key, terms (numbers, rising), counts, length (before it was made 1); and each term's idf.

    Only numbers and counts are kept, so a row takes some bytes a term.  cut: stores a table and reads it again.
    """
    counts = cut(term_counts(docs, key, text))
    words = vocabulary(counts, docs.agg(F.count("*").alias("n")), min_df, max_df, max_features).select("term", "idf").orderBy("term").collect()  # max_features rows at most
    number = "short" if len(words) < 1 << 15 else "int"
    known = docs.sparkSession.createDataFrame([(w["term"], i, w["idf"]) for i, w in enumerate(words)], f"term string, number {number}, idf double")
    rows = counts.join(F.broadcast(known), "term").withColumn("w", (1 + F.log("tf")) * F.col("idf"))
    rows = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("number", F.col("tf").cast("int").alias("tf")))).alias("t"), F.greatest(F.sqrt(F.sum(F.col("w") * F.col("w"))), F.lit(1e-9)).alias("length"))
    return cut(rows.select(key, F.col("t.number").alias("terms"), F.col("t.tf").alias("counts"), "length")), [w["idf"] for w in words]


def weights_of(vectors: DataFrame, idf: list[float], key: str) -> DataFrame:
    """key, term (its number), w of what term_vectors() gives."""
    known = vectors.sparkSession.createDataFrame(list(enumerate(idf)), "term int, idf double")
    rows = vectors.select(key, "length", F.explode(F.arrays_zip("terms", "counts")).alias("t")).select(key, "length", F.col("t.terms").cast("int").alias("term"), F.col("t.counts").alias("tf"))
    return rows.join(F.broadcast(known), "term").select(key, "term", ((1 + F.log("tf")) * F.col("idf") / F.col("length")).alias("w"))  # a row for each term of the vocabulary


def year_products(vectors: DataFrame, idf: list[float], years: DataFrame, key: str) -> tuple[DataFrame, float, float]:
    """Of what term_vectors() gives: key, p (the product with the slopes of trend()) and xx (with itself) of each document, the slopes' product
    with themselves, and the mean year.

    A task sums a number for each term of the vocabulary, the slopes are the sum of these, and a second pass takes each row's products
    with them: no row for each term is moved.
    """
    weight = np.array(idf)
    mean, squares = years.agg(F.avg("year"), F.var_pop("year") * F.count("year")).first()
    if mean is None:
        return vectors.select(key, F.lit(0.0).alias("p"), F.lit(0.0).alias("xx")).limit(0), 0.0, 0.0

    def flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, term and weight of every entry."""
        row = np.repeat(np.arange(batch.num_rows), batch.column("terms").value_lengths().to_numpy(zero_copy_only=False))
        term = batch.column("terms").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        counts = batch.column("counts").flatten().to_numpy(zero_copy_only=False)
        return row, term, (1 + np.log(counts)) * weight[term] / batch.column("length").to_numpy(zero_copy_only=False)[row]

    def slopes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(weight))
        for batch in batches:
            row, term, w = flat(batch)
            sums += np.bincount(term, w * (batch.column("year").to_numpy(zero_copy_only=False)[row] - mean), len(weight))
        at = np.flatnonzero(sums)
        yield pa.record_batch([pa.array(at), pa.array(sums[at])], ["term", "s"])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, term, w = flat(batch)
            p, xx = np.bincount(row, w * beta[term], batch.num_rows), np.bincount(row, w * w, batch.num_rows)
            yield pa.record_batch([batch.column(key), pa.array(p.astype(float)), pa.array(xx.astype(float))], [key, "p", "xx"])

    dated = vectors.join(years.where("year is not null").select(key, F.col("year").cast("double").alias("year")), key)
    beta = np.zeros(len(weight))
    for r in dated.mapInArrow(slopes, "term long, s double").groupBy("term").agg(F.sum("s").alias("s")).collect():  # a row for each term of the vocabulary
        beta[r["term"]] = r["s"] / max(squares, 1e-12)
    kind = dict(vectors.dtypes)[key]
    return vectors.mapInArrow(products, f"{key} {kind}, p double, xx double"), float(beta @ beta), float(mean)


def detrended_products(vectors: DataFrame, idf: list[float], years: DataFrame, pairs: DataFrame, key: str, cut) -> DataFrame:
    """detrended_cosine() from what term_vectors() gives, by grouped_products(): pairs are joined with nothing else."""
    found, bb, mean = year_products(vectors, idf, years, key)
    y = F.col("year") - F.lit(mean)
    rows = years.select(key, y.alias("y")).join(found, key, "left").select(key, "y", F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("xx", F.lit(0.0)).alias("xx"))
    rows = rows.withColumn("len", F.greatest(F.sqrt(F.greatest(F.col("xx") - 2 * F.col("y") * F.col("p") + F.col("y") * F.col("y") * F.lit(bb), F.lit(0.0))), F.lit(1e-9)))
    rows = rows.join(vectors, key, "left")
    none = [F.coalesce(c, F.array().cast(dict(vectors.dtypes)[c])).alias(c) for c in ("terms", "counts")]
    rows = rows.select(key, *none, F.coalesce("length", F.lit(1.0)).alias("length"), "y", "p", "len")
    met = grouped_products(rows, idf, pairs, key, ("y", "p", "len"), cut)
    value = F.col("dot") - F.col("y_b") * F.col("p_a") - F.col("y_a") * F.col("p_b") + F.col("y_a") * F.col("y_b") * F.lit(bb)
    return met.select("from_id", "to_id", (value / (F.col("len_a") * F.col("len_b"))).alias("cosine"))


def grouped_products(vectors: DataFrame, idf: list[float], pairs: DataFrame, key: str, more: tuple[str, ...], cut) -> DataFrame:
    """from_id, to_id, dot (0 where no term is shared) and the numbers `more` of both ends (_a and _b), for pairs of known ends; keys are whole numbers.

    Documents are dealt in groups and pairs in groups of both ends; documents go to the groups of pairs in bytes, so what is moved
    is a short row for each pair, and each document twice for each group, however many pairs it is in.
    """
    weight = np.array(idf)
    parts = max(1, -(-vectors.count() // DOCS))
    groups = max(min(GROUPS, parts), -(-parts // HELD))
    of = lambda c: F.pmod(F.xxhash64(c), F.lit(groups)).cast("int")
    numbers = ("length", *more)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("own").to_numpy()
            for g in np.unique(own):
                some = batch.take(pa.array(np.flatnonzero(own == g)))
                sizes = some.column("terms").value_lengths().to_numpy(zero_copy_only=False)
                flat = [some.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int32) for c in ("terms", "counts")]
                values = np.stack([some.column(c).to_numpy(zero_copy_only=False) for c in numbers])
                row = [int(g), some.column(key).to_numpy().astype(np.int64), sizes.astype(np.int32), *flat, values.T.astype(float)]
                yield pa.RecordBatch.from_pylist([dict(zip(names, [row[0], *(x.tobytes() for x in row[1:])]))], schema)

    names = ["own", "ids", "sizes", "terms", "counts", "numbers"]
    schema = pa.schema([("own", pa.int32()), *((c, pa.binary()) for c in names[1:])])
    packed = cut(vectors.withColumn("own", of(key)).mapInArrow(pack, "own int, ids binary, sizes binary, terms binary, counts binary, numbers binary"))
    others = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    sides = packed.select(F.col("own").alias("i"), others.alias("j"), F.lit(True).alias("first"), *names[1:]).unionByName(packed.select(others.alias("i"), F.col("own").alias("j"), F.lit(False).alias("first"), *names[1:]))

    def side(rows: pd.DataFrame) -> tuple[np.ndarray, ...]:
        """Ids, rising, and of each its place in the entries, number of entries and numbers; the entries' terms and counts."""
        ids, sizes, terms, counts, values = (np.frombuffer(b"".join(rows[c]), k) for c, k in zip(names[1:], (np.int64, np.int32, np.int32, np.int32, float)))
        order = np.argsort(ids)
        return ids[order], (sizes.cumsum() - sizes)[order], sizes[order].astype(np.int64), values.reshape(len(ids), -1)[order], terms, counts

    def entries(own: tuple[np.ndarray, ...], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row * terms + term, rising, and weight of every entry of the documents at these places."""
        _, start, size, values, terms, counts = own
        n = size[at]
        row = np.repeat(np.arange(len(at)), n)
        place = np.arange(len(row)) - np.repeat(n.cumsum() - n, n) + np.repeat(start[at], n)
        term = terms[place].astype(np.int64)
        return row * len(weight) + term, (1 + np.log(counts[place])) * weight[term] / values[at, 0][row]

    def work(part: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        out = []
        first = blocks["first"].to_numpy(bool)
        if len(part) and first.any() and not first.all():
            a, b = side(blocks[first]), side(blocks[~first])
            froms, tos = part["from_id"].to_numpy(), part["to_id"].to_numpy()
            i, j = (np.minimum(np.searchsorted(x[0], ends), len(x[0]) - 1) for x, ends in ((a, froms), (b, tos)))
            known = np.flatnonzero((a[0][i] == froms) & (b[0][j] == tos))
            for s in range(0, len(known), 2000):
                some = known[s : s + 2000]
                (x, w), (y, z) = entries(a, i[some]), entries(b, j[some])
                place = np.searchsorted(y, x)
                both = np.flatnonzero(np.append(y, -1)[place] == x)
                dot = np.bincount(x[both] // max(1, len(weight)), w[both] * z[place[both]], len(some)).astype(float)
                ends = {f"{c}_{e}": own[3][at[some], k] for k, c in enumerate(more, 1) for e, own, at in (("a", a, i), ("b", b, j))}
                out.append(pd.DataFrame({"from_id": froms[some], "to_id": tos[some], "dot": dot} | ends))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ["from_id", "to_id", "dot", *kept]})

    kept = [f"{c}_{e}" for c in more for e in "ab"]
    asked = pairs.select("from_id", "to_id", of("from_id").alias("i"), of("to_id").alias("j"))
    return asked.groupBy("i", "j").cogroup(sides.groupBy("i", "j")).applyInPandas(work, "from_id long, to_id long, dot double" + "".join(f", {c} double" for c in kept))


def vector_products(vectors: DataFrame, idf: list[float], pairs: DataFrame, key: str) -> DataFrame:
    """sparse_products() of what term_vectors() gives: a pair meets two short rows, not a row for each term."""
    weight = np.array(idf)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, 2000):
                batch = whole.slice(s, 2000)
                n = batch.num_rows
                at, w = [], []
                for side in "ab":
                    terms, counts = batch.column(f"terms_{side}"), batch.column(f"counts_{side}")
                    row = np.repeat(np.arange(n), terms.value_lengths().to_numpy(zero_copy_only=False))
                    term = terms.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                    at.append(row * len(weight) + term)
                    length = batch.column(f"length_{side}").to_numpy()
                    w.append((1 + np.log(counts.flatten().to_numpy(zero_copy_only=False))) * weight[term] / length[row])
                place = np.searchsorted(at[1], at[0])
                both = np.nonzero(np.append(at[1], -1)[place] == at[0])[0]
                row = at[0][both] // max(1, len(weight))
                dot, shared = np.bincount(row, w[0][both] * w[1][place[both]], n).astype(float), np.bincount(row, minlength=n) > 0
                yield pa.record_batch([batch.column("from_id"), batch.column("to_id"), pa.array(dot)], ["from_id", "to_id", "dot"]).filter(pa.array(shared))

    side = lambda end, s: vectors.select(F.col(key).alias(end), *(F.col(c).alias(f"{c}_{s}") for c in ("terms", "counts", "length")))
    met = pairs.select("from_id", "to_id").join(side("from_id", "a"), "from_id").join(side("to_id", "b"), "to_id")
    kinds = dict(pairs.dtypes)
    return met.mapInArrow(work, f"from_id {kinds['from_id']}, to_id {kinds['to_id']}, dot double")


def trend(weights: DataFrame, years: DataFrame, key: str) -> DataFrame:
    """term, beta: slope of each feature on the centred year over all rows, zeros included.  years: key, year of every row."""
    centre = years.agg(F.avg("year").alias("mean"), F.var_pop("year").alias("v"), F.count("*").alias("n"))
    rows = weights.join(years, key).join(F.broadcast(centre))  # one row
    return rows.groupBy("term").agg((F.sum(F.col("w") * (F.col("year") - F.col("mean"))) / F.first(F.greatest(F.col("v") * F.col("n"), F.lit(1e-12)))).alias("beta"))


def detrended_cosine(weights: DataFrame, years: DataFrame, pairs: DataFrame, key: str, dots: DataFrame | None = None) -> DataFrame:
    """from_id, to_id, cosine of the pairs after detrending, without densifying.

    Row i becomes x_i - y_i b, so a product is x_i x_j - y_j (x_i b) - y_i (x_j b) + y_i y_j (b b): the sparse product,
    a number for each row and one number in all.  dots: the sparse products, if they are known.
    """
    beta = trend(weights, years, key)
    bb = beta.agg(F.sum(F.col("beta") * F.col("beta")).alias("bb"))
    centre = years.agg(F.avg("year").alias("mean"))
    p = weights.join(beta, "term").groupBy(key).agg(F.sum(F.col("w") * F.col("beta")).alias("p"), F.sum(F.col("w") * F.col("w")).alias("xx"))
    rows = years.join(p, key, "left").join(F.broadcast(centre)).join(F.broadcast(bb)).select(key, (F.col("year") - F.col("mean")).alias("y"), F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("xx", F.lit(0.0)).alias("xx"), F.coalesce("bb", F.lit(0.0)).alias("bb"))  # two single rows
    rows = rows.withColumn("length", F.greatest(F.sqrt(F.greatest(F.col("xx") - 2 * F.col("y") * F.col("p") + F.col("y") * F.col("y") * F.col("bb"), F.lit(0.0))), F.lit(1e-9)))
    dots = sparse_products(weights, pairs, key) if dots is None else dots
    a, b = (rows.select(F.col(key).alias(e), *(F.col(c).alias(f"{c}_{s}") for c in ("y", "p", "length", "bb"))) for e, s in (("from_id", "a"), ("to_id", "b")))
    both = pairs.select("from_id", "to_id").join(a, "from_id").join(b, "to_id").join(dots, ["from_id", "to_id"], "left")
    value = F.coalesce("dot", F.lit(0.0)) - F.col("y_b") * F.col("p_a") - F.col("y_a") * F.col("p_b") + F.col("y_a") * F.col("y_b") * F.col("bb_a")
    return both.select("from_id", "to_id", (value / (F.col("length_a") * F.col("length_b"))).alias("cosine"))


def sparse_products(weights: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """from_id, to_id, dot of the pairs that share a term."""
    left = weights.select(F.col(key).alias("from_id"), "term", F.col("w").alias("wa"))
    right = weights.select(F.col(key).alias("to_id"), "term", F.col("w").alias("wb"))
    return pairs.select("from_id", "to_id").join(left, "from_id").join(right, ["to_id", "term"]).groupBy("from_id", "to_id").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))


def top_terms(weights: DataFrame, members: DataFrame, key: str, cluster: str, n: int = 10) -> DataFrame:
    """cluster, term, mean, place: the n terms of the largest mean weight, members without the term counting as zero."""
    sizes = members.groupBy(cluster).agg(F.count("*").alias("size"))
    sums = weights.join(members, key).groupBy(cluster, "term").agg(F.sum("w").alias("s"))
    means = sums.join(sizes, cluster).select(cluster, "term", F.round(F.col("s") / F.col("size"), 9).alias("mean"))
    return means.withColumn("place", F.row_number().over(Window.partitionBy(cluster).orderBy(F.desc("mean"), "term"))).where(F.col("place") <= n)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Of two dense vectors; 0 if one is missing."""
    return F.coalesce(dot(a, b) / (F.greatest(F.sqrt(dot(a, a)), F.lit(1e-9)) * F.greatest(F.sqrt(dot(b, b)), F.lit(1e-9))), F.lit(0.0))
