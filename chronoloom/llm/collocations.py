"""Phrase collocations by generalised suffix automata of bounded depth, one for each shard.

1. Texts are cut in pieces and words; a shard is some million words of one language, with its own dictionary.
2. The automaton of a shard is built only to the depth of the longest phrase: its states are the classes of phrases that
   end at the same places (endpos), each with its number of occurrences, its longest phrase and the suffix link to the
   class of the next shorter suffix that ends at more places.  It comes from sorting the places by the words read
   backwards: the runs at each depth are the phrases, and a run as large as the one around it is the same state.
3. Counts are reduced over all shards by a 64-bit hash of the phrase, in slices of bounded size.  What reaches the least
   count goes back to the shards that have it, and only phrases whose first and last words less one (its suffix link
   and the state that an arc leads from) both reach it are counted at the next length.  So neither a vocabulary nor a list of
   phrases is ever sent to all tasks.  Hashes only choose: the phrases that remain are counted once more as they are.
4. Cuts, scores and subsumption are joins on those counts.  As counts fall with every word added, it is enough to look at
   phrases longer by one word, which a phrase meets as their suffix (link) or their beginning (arc).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bytes_of, doc_columns, join_counted, read_table, runs, settle, small_batches

WORDS, LEAST, SUBSUMED, TOP = 3, 10, 50, 2000
#: Words of a shard (a text is never cut, so one may have more), bytes of text split at a time, hashes of a slice on average, parts
#: of a language that are ranked apart before the whole is, and bytes of a shard that a row brings to a worker.
SHARD, CHUNK, SLICE, PARTS, PIECE = 1 << 20, 1 << 22, 1 << 17, 64, 1 << 11
#: What a task holds beside its shard: rows of an Arrow batch either way, shards of a stored row group, places whose hashes are looked up at a time.
BATCH, GROUP, STEP = 512, 4, 1 << 16
#: A-Z to a-z, what ends a piece to a full stop.
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz.........")
_ROLL = np.uint64(0xC2B2AE3D27D4EB4F)


def words_of(data: bytes) -> list[bytes]:
    """Lower-case words, with b"." between pieces; no word holds a full stop."""
    return data.translate(_PLAIN).replace(b".", b" . ").split()


def _mix(x: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Automaton:
    """Suffix automaton, to a depth, of pieces of words: tokens are whole numbers, 0 between pieces."""

    def __init__(self, tokens: np.ndarray, depth: int):
        self.tokens = tokens
        ends = np.nonzero(tokens)[0].astype(np.int32)  # a shard has under 2^31 places
        back = [tokens[ends]]
        for k in range(1, depth):
            word = tokens[ends - k]
            word[(ends < k) | (back[-1] == 0)] = 0
            back.append(word)
        bits = int(tokens.max(initial=0)).bit_length()
        if bits * depth <= 63:
            key = np.zeros(len(ends), np.int64)
            for b in back:
                key <<= bits
                key |= b
            order = np.argsort(key).astype(np.int32)
            del key
        else:
            order = np.lexsort(back[::-1]).astype(np.int32)
        new = np.zeros(len(ends), bool)
        new[:1] = True
        length, count, end, link = ([np.full(1, x, np.int32)] for x in (0, 0, 0, -1))
        state = np.zeros(len(ends), np.int32)  # of each place, the state of its phrase of the depth reached
        made = 1
        for k, b in enumerate(back, 1):
            b = b[order]
            new[1:] |= b[1:] != b[:-1]
            runs_at = np.nonzero(new)[0].astype(np.int32)
            there = b[runs_at] > 0
            first = runs_at[there]
            size = np.diff(np.append(runs_at, np.int32(len(ends))))[there]
            del runs_at
            up = state[first]
            whole = np.concatenate(count)
            grown = (whole[up] == size) & (up > 0)  # the same places: the state's longest phrase is longer by a word
            lengths = np.concatenate(length)
            lengths[up[grown]] = k
            fresh = np.nonzero(~grown)[0]
            own = up.copy()
            own[fresh] = made + np.arange(len(fresh), dtype=np.int32)
            made += len(fresh)
            length, count = [lengths, np.full(len(fresh), k, np.int32)], [whole, size[fresh]]
            end.append(ends[order[first[fresh]]])
            link.append(up[fresh])
            alive = b > 0
            state[alive] = np.repeat(own, size)
        #: Of each state: the length of its longest phrase, at how many places it ends, one of them, and its suffix link.
        self.length, self.count, self.end, self.link = np.concatenate(length), np.concatenate(count), np.concatenate(end), np.concatenate(link)

    def phrases(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each phrase of so many words: where it ends (one place), and its number of occurrences."""
        has = np.nonzero((self.length >= size) & (np.where(self.link >= 0, self.length[self.link], size) < size))[0]
        return self.end[has], self.count[has]


def shards(docs: DataFrame, size: int = SHARD) -> DataFrame:
    """docs: lang, text.  shard, lang, words (different ones, a line each), tokens (32-bit numbers from 1 of these, 0 between pieces), n (words)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId() << 32, 0
        numbers: dict[str, dict[bytes, int]] = {}
        parts: dict[str, list[np.ndarray]] = {}
        names = ["shard", "lang", "words", "tokens", "n"]

        def full(lang: str) -> pa.RecordBatch:
            nonlocal made
            tokens = np.concatenate(parts.pop(lang))
            made += 1
            words = pa.array([b"\n".join(numbers.pop(lang))], pa.binary())
            return pa.record_batch([pa.array([part + made - 1]), pa.array([lang]), words, pa.array([tokens.tobytes()], pa.binary()), pa.array([int(np.count_nonzero(tokens))])], names)

        def add(lang: str, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
            coded = pa.array(words_of(b".".join(texts)), pa.binary()).dictionary_encode()
            known = numbers.setdefault(lang, {})
            place = np.array([0 if w == b"." else known.setdefault(w, len(known) + 1) for w in coded.dictionary.to_pylist()], np.int32)
            parts.setdefault(lang, []).append(np.append(place[coded.indices.to_numpy()] if len(place) else place, np.int32(0)))
            if sum(map(len, parts[lang])) >= size:
                yield full(lang)

        texts: dict[str, list[bytes]] = {}
        waiting: dict[str, int] = {}
        for batch in batches:
            for lang, data in zip(batch.column("lang").to_pylist(), bytes_of(batch)):
                texts.setdefault(lang, []).append(data)
                waiting[lang] = waiting.get(lang, 0) + len(data)
                if waiting[lang] >= CHUNK:
                    yield from add(lang, texts.pop(lang))
                    waiting[lang] = 0
        for lang, own in texts.items():
            yield from add(lang, own)
        for lang in list(parts):
            yield full(lang)

    rows = doc_columns(docs, "lang", "text").select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    return rows.mapInArrow(work, "shard long, lang string, words binary, tokens binary, n long")


class _Shard:
    """The phrases of a shard that may reach the least count, by length."""

    def __init__(self, lang: str, words: list[bytes], tokens: bytes, frequent: np.ndarray | None):
        self.words, self.tokens, self.frequent = words, np.frombuffer(tokens, np.int32), frequent
        own = xxhash.xxh64_intdigest(lang.encode())
        self.hash = np.fromiter((xxhash.xxh64_intdigest(w, own) for w in [b"", *words]), np.uint64, len(words) + 1)

    def hashes(self, ends: np.ndarray, size: int) -> np.ndarray:
        found = np.empty(len(ends), np.uint64)
        for s in range(0, len(ends), STEP):
            part = ends[s : s + STEP]
            h = np.full(len(part), size, np.uint64)
            for k in range(size - 1, -1, -1):
                h = h * _ROLL + self.hash[self.tokens[part - k]]
            found[s : s + STEP] = _mix(h)
        return found

    def keep(self, size: int) -> Automaton:
        """The automaton of depth `size` over the words that lie in a frequent phrase of size - 1 words."""
        tokens = self.tokens
        if self.frequent is not None and size > 1:
            ok = np.zeros(len(tokens), bool)
            ends = self.ends(size - 1)
            ends = ends[self.chosen(ends, size - 1)]
            for k in range(size - 1):
                ok[ends - k] = True
            tokens = np.where(ok, tokens, np.int32(0))
        return Automaton(tokens, size)

    def ends(self, size: int) -> np.ndarray:
        inside = self.tokens > 0
        for k in range(1, size):
            inside[k:] &= self.tokens[:-k] > 0
            inside[:k] = False
        return np.nonzero(inside)[0].astype(np.int32)

    def chosen(self, ends: np.ndarray, size: int) -> np.ndarray:
        """Which of the phrases are frequent; `frequent` is sorted."""
        found = np.zeros(len(ends), bool)
        for s in range(0, len(ends) if len(self.frequent) else 0, STEP):
            h = self.hashes(ends[s : s + STEP], size)
            place = np.searchsorted(self.frequent, h)
            found[s : s + STEP] = self.frequent[np.minimum(place, len(self.frequent) - 1)] == h
        return found

    def counted(self, size: int, known: bool) -> tuple[np.ndarray, np.ndarray]:
        """End and count of the phrases of so many words.  known: of the frequent ones; else of those whose suffix and beginning are."""
        automaton = self.keep(size)
        ends, counts = automaton.phrases(size)
        if known:
            keep = self.chosen(ends, size)
        elif self.frequent is not None and size > 1:
            keep = self.chosen(ends, size - 1) & self.chosen(ends - 1, size - 1)
        else:
            return ends, counts
        return ends[keep], counts[keep]


def _pieces(stored: DataFrame, hashes: DataFrame | None = None) -> DataFrame:
    """shard, lang, at, kind (0: words, 1: tokens, 2: hashes), data: shards in rows of PIECE bytes and hashes by slice, a shard's one after the other.

    A task streams such rows, so no batch or sort holds shards whole, however many come to one part.
    """
    words, tokens, at = F.ceil(F.length("words") / PIECE).cast("int"), F.ceil(F.length("tokens") / PIECE).cast("int"), F.col("at")
    rows = stored.select("shard", "lang", "words", "tokens", words.alias("parts"), F.explode(F.sequence(F.lit(0), words + tokens - 1)).alias("at"))
    data = F.when(at < F.col("parts"), F.substring("words", at * PIECE + 1, F.lit(PIECE))).otherwise(F.substring("tokens", (at - F.col("parts")) * PIECE + 1, F.lit(PIECE)))
    rows = rows.select("shard", "lang", "at", (at >= F.col("parts")).cast("int").alias("kind"), data.alias("data"))
    if hashes is None:
        return rows  # a shard is one stored row, so its pieces are in one task
    last = hashes.select("shard", F.lit(None).cast("string").alias("lang"), F.lit((1 << 31) - 1).alias("at"), F.lit(2).alias("kind"), F.col("hashes").alias("data"))
    return rows.unionByName(last).repartition("shard").sortWithinPartitions("shard", "at")


def _shards_of(batches: Iterator[pa.RecordBatch], known: bool) -> Iterator[tuple[int, str, _Shard]]:
    """The shards of _pieces(); known: with their frequent hashes."""
    for table in runs(batches, ["shard"]):
        at = table["shard"].to_numpy()
        first = np.append(np.nonzero(np.append(True, at[1:] != at[:-1]))[0], len(at)).tolist()
        for s, e in zip(first[:-1], first[1:]):
            own = table.slice(s, e - s)
            ends = np.searchsorted(own["kind"].to_numpy(), [0, 1, 2, 3]).tolist()
            words, tokens, hashes = (b"".join(own["data"].slice(lo, hi - lo).to_pylist()) for lo, hi in zip(ends[:-1], ends[1:]))
            lang = own["lang"][0].as_py()
            yield int(at[s]), lang, _Shard(lang, words.split(b"\n") if words else [], tokens, np.sort(np.frombuffer(hashes, np.uint64)) if known else None)


def _hashed(found: DataFrame, sizes: list[int], slices: int, known: bool) -> DataFrame:
    """slice, shard, hashes, counts of the phrases of these sizes that may reach the least count."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, _, own in _shards_of(batches, known):
            h, n = [], []
            for size in sizes:
                ends, counts = own.counted(size, False)
                h.append(own.hashes(ends, size))
                n.append(counts.astype(np.uint32))
            h, n = np.concatenate(h), np.concatenate(n)
            order = np.argsort(h)
            h, n = h[order], n[order]
            at = (h >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32)
            first = np.append(np.nonzero(np.append(True, at[1:] != at[:-1]))[0], len(h)) if len(h) else np.zeros(1, int)
            first = first.tolist()
            for k in range(0, len(first) - 1, BATCH):
                rows = [(int(at[s]), shard, h[s:e].tobytes(), n[s:e].tobytes()) for s, e in zip(first[k : k + BATCH], first[k + 1 : k + BATCH + 1])]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["slice", "shard", "hashes", "counts"])

    return found.mapInArrow(work, "slice long, shard long, hashes binary, counts binary")


def _frequent(hashed: DataFrame, least: int) -> DataFrame:
    """shard, hashes: of each shard's phrases those that occur `least` times in all."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["slice"]):
            at = table["slice"].to_numpy()
            first = np.append(np.nonzero(np.append(True, at[1:] != at[:-1]))[0], len(at)).tolist()
            for s, e in zip(first[:-1], first[1:]):
                h = [np.frombuffer(x, np.uint64) for x in table["hashes"].slice(s, e - s).to_pylist()]
                n = np.concatenate([np.frombuffer(x, np.uint32) for x in table["counts"].slice(s, e - s).to_pylist()])
                each, place = np.unique(np.concatenate(h), return_inverse=True)
                total = np.bincount(place, n, len(each))
                keep = np.split(total[place] >= least, np.cumsum([len(x) for x in h])[:-1])
                rows = [(shard, x[k].tobytes()) for shard, x, k in zip(table["shard"].slice(s, e - s).to_pylist(), h, keep) if k.any()]
                if rows:
                    shard, data = zip(*rows)
                    yield pa.record_batch([pa.array(shard, pa.int64()), pa.array(data, pa.binary())], ["shard", "hashes"])

    return hashed.repartition("slice").sortWithinPartitions("slice").mapInArrow(work, "shard long, hashes binary")


def _spelled(found: DataFrame, longest: int) -> DataFrame:
    """lang, words, phrase, f of each shard's phrases: the frequent ones, and of the longest those made of frequent ones."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, lang, own in _shards_of(batches, True):
            words = pa.array([b"", *own.words], pa.binary())
            for size in range(1, longest + 1):
                ends, counts = own.counted(size, size < max(longest, 3))
                for s in range(0, len(ends), 1 << 15):
                    part = ends[s : s + (1 << 15)]
                    text = pc.binary_join_element_wise(*(words.take(pa.array(own.tokens[part - k])) for k in range(size - 1, -1, -1)), b" ")
                    n = len(part)
                    yield pa.record_batch([pa.array([lang] * n), pa.array(np.full(n, size, np.int32)), text.cast(pa.string()), pa.array(counts[s : s + (1 << 15)].astype(np.int64))], ["lang", "words", "phrase", "f"])

    return found.mapInArrow(work, "lang string, words int, phrase string, f long")


def phrase_counts(docs: DataFrame, longest: int = WORDS, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Two tables: lang, words, phrase, f of every phrase of up to `longest` words that occurs `least` times or more in a language; lang, n (words)."""
    with small_batches(docs.sparkSession, BATCH):
        return _phrase_counts(docs, longest, least)


def _phrase_counts(docs: DataFrame, longest: int, least: int) -> tuple[DataFrame, DataFrame]:
    stored = settle(shards(docs), "shards", GROUP)
    totals = settle(stored.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    words = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    slices = max(1, min(2 * words // SLICE, 1 << 30))
    frequent = settle(_frequent(_hashed(_pieces(stored), [1, 2][:longest], slices, False), least), "frequent")
    for size in range(3, longest):
        frequent = frequent.unionByName(settle(_frequent(_hashed(_pieces(stored, frequent), [size], slices, True), least), "frequent"))
    counts = _spelled(_pieces(stored, frequent), longest).groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    return settle(counts, "phrases"), totals


def collocations(docs: DataFrame, longest: int = WORDS, least: int = LEAST, subsumed: int = SUBSUMED, top: int = TOP) -> DataFrame:
    """docs: lang, text.  lang, rank, phrase, a, l, r, n, score: each language's best phrases of 2 to `longest` words.

    A null text counts as empty, a null lang as `und`; rows that repeat count again; texts without words add nothing, and
    an empty table gives an empty table.  Ties of the score go to the larger a, then to the smaller phrase.
    """
    found, totals = phrase_counts(docs, longest, least)
    part = lambda a, b: F.array_join(F.slice("w", a, b), " ")
    several = found.where("words > 1").withColumnRenamed("f", "a").withColumn("w", F.split("phrase", " "))
    cuts = several.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = settle(cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest")), "cuts")
    for name, side in (("l", "first"), ("r", "rest")):
        use = settle(cuts.groupBy("lang", side).agg(F.count("*").alias("uses")), "uses")
        known = settle(use.join(found.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side]), "known")
        cuts = settle(join_counted(cuts, known, ["lang", side], "uses").drop("uses", side), "cuts")
    score = F.expr("CAST((CAST(1000000 AS decimal(7,0)) * (CAST(a AS decimal(15,0)) * CAST(a AS decimal(15,0)))) div (CAST(l AS decimal(19,0)) * CAST(r AS decimal(19,0))) AS long)")
    lowest = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # the suffix link of a longer phrase and the state that its last arc leaves
    longer = several.where("words > 2").select("lang", F.col("a").alias("f"), F.explode(F.array(part(F.lit(1), F.col("words") - 1), part(F.lit(2), F.col("words") - 1))).alias("phrase"))
    longest_f = longer.groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    free = lowest.join(longest_f, ["lang", "phrase"], "left").where(F.col("f").isNull() | (100 * F.col("f") < subsumed * F.col("a"))).select("lang", "phrase", "a", "cut.*")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salted = free.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    few = salted.withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("place") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first TOP phrases of each lang of `documents` with their counts and scores; odd rows as in collocations()."""
    return collocations(read_table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase
      FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, CAST(count(*) AS HUGEINT) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM f WHERE k > 1 AND f >= 10),
s AS (SELECT c.lang, c.k, c.phrase, c.a, c.cut, x.f AS l, y.f AS r, 1000000 * c.a * c.a // (x.f * y.f) AS score
      FROM c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.cut], ' ') AND x.k = c.cut
      JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.cut + 1:], ' ') AND y.k = c.k - c.cut),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
u AS (SELECT lang, phrase, max(f) AS f FROM (SELECT lang, f, unnest([array_to_string(string_split(phrase, ' ')[1:2], ' '), array_to_string(string_split(phrase, ' ')[2:3], ' ')]) AS phrase FROM f WHERE k = 3 AND f >= 10) GROUP BY ALL),
r AS (SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, score
      FROM b LEFT JOIN u ON u.lang = b.lang AND u.phrase = b.phrase WHERE u.f IS NULL OR 100 * u.f < 50 * a)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score FROM r JOIN n USING (lang) WHERE rank <= 2000
"""
