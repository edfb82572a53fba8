"""URL filters: a Bloom filter cascade over the corpus's own keys.  DataFrame functions only.

Level 0 holds the listed keys.  The corpus's keys that pass level 0 without being listed are its false positives; level
1 holds those, level 2 the listed keys that pass level 1, and so on, until a level has no false positive.  A key of the
corpus is listed if and only if the first level that rejects it is odd, or, if it passes all, the last level is even.
Every key that the table can ask for takes part in the building, so membership is exact, and asking needs no join: the
levels are literals of the expression, a few bytes for each listed key and fewer for each false positive.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_columns, read_table, settle

#: The rules of op10: (verdict, host, path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Bits for each key of a level, probes of a key, and levels at most (the build stops with an error beyond).
BITS, PROBES, LEVELS = 16, 4, 64


def _places(key: Column, level: int, size: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level), F.lit(i)), F.lit(size)) for i in range(PROBES)]


class BloomCascade:
    """levels: (bits as signed 64-bit words, size in bits)."""

    def __init__(self, levels: list[tuple[list[int], int]]):
        self.levels = levels

    @staticmethod
    def _passes(key: Column, level: int, words: list[int], size: int) -> Column:
        bits = F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")  # folded to one literal
        return reduce(lambda a, b: a & b, (F.getbit(F.get(bits, F.floor(at / 64).cast("int")), (at % 64).cast("int")) == 1 for at in _places(key, level, size)))

    def contains(self, key: Column) -> Column:
        """Exact for every key of the universe that the cascade was built over."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for level, (bits, size) in reversed(list(enumerate(self.levels))):
            answer = F.when(self._passes(key, level, bits, size), answer).otherwise(F.lit(level % 2 == 1))
        return answer

    @classmethod
    def build(cls, listed: DataFrame, universe: DataFrame) -> BloomCascade:
        """listed and universe: a column `key`.  Only bit places come to the driver, at most the size of a level."""
        inside = listed.select("key").distinct()
        outside = universe.select("key").distinct().join(inside, "key", "left_anti")
        levels: list[tuple[list[int], int]] = []
        while len(levels) < LEVELS:
            held, others = (inside, outside) if len(levels) % 2 == 0 else (outside, inside)
            for level, (bits, size) in enumerate(levels):  # those that pass all levels so far
                held = held.where(cls._passes(F.col("key"), level, bits, size))
                others = others.where(cls._passes(F.col("key"), level, bits, size))
            n = held.count()
            if not n and levels:
                break
            size = max(64, BITS * n)
            places = held.select(F.explode(F.array(*_places(F.col("key"), len(levels), size))).alias("at"))
            filled = places.select(F.floor(F.col("at") / 64).alias("word"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
            own = [0] * (size // 64 + 1)
            for row in filled.toLocalIterator():
                own[row["word"]] = row["bits"]
            levels.append((own, size))
            if not others.where(cls._passes(F.col("key"), len(levels) - 1, *levels[-1])).limit(1).count():
                break
        else:
            raise ValueError("the cascade doesn't end: a key collides on every level")
        return cls(levels)


def host_of(url: Column) -> Column:
    """Behind the first :// up to / ? # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_keys(host: Column, path: Column, depths: list[int]) -> Column:
    """Every key, `host suffix` + `path prefix`, that could fit, the longest first.

    Suffixes begin at a label; prefixes have the lengths that rules' paths have.
    """
    labels = F.split(host, r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))
    prefixes = F.array(*(F.substring(path, 1, n) for n in sorted(depths, reverse=True)))
    fitting = F.filter(prefixes, lambda p: F.reduce(F.array(*(F.lit(n) for n in depths)), F.lit(False), lambda ok, n: ok | (F.length(p) == n)))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(fitting, lambda p: F.concat(s, p))))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], url: str = "url") -> DataFrame:
    """All columns of pages, and host, path, rule and verdict (which replace columns of those names).

    Two cascades, for the rules that block and for those that allow, are built over the keys of all urls.  The rule is
    the longest key of the url that either cascade holds (of one length: the one with the longer host); without one it
    is null, and the verdict is the blocking cascade's on the url's own keys, which holds none of them: allow.  Null,
    empty and odd urls have an empty host and fit no rule; rows are judged one by one, so repeats need no rule.
    """
    depths = sorted({len(p) for _, _, p in rules}) or [1]
    host, path = host_of(F.col("__url")), path_of(F.col("__url"))
    # the row is kept in one column, so that no name of its own can clash
    keyed = pages.select(F.struct(*(pages[c] for c in pages.columns)).alias("row"), pages[url].cast("string").alias("__url")).withColumn("host", host).withColumn("path", path)
    keyed = keyed.withColumn("__keys", F.when(F.col("host") != "", rule_keys(F.col("host"), F.col("path"), depths)).otherwise(F.array().cast("array<string>")))
    spark = pages.sparkSession
    universe = doc_columns(pages, url).select(F.col(url).cast("string").alias("u")).select(host_of(F.col("u")).alias("h"), path_of(F.col("u")).alias("p")).where("h <> ''").select(F.explode(rule_keys(F.col("h"), F.col("p"), depths)).alias("key")).distinct()
    universe = settle(universe, "universe")  # every level asks for it
    cascades = {}
    for verdict in ("block", "allow"):
        listed = spark.createDataFrame([(h + p,) for v, h, p in rules if v == verdict], "key string")
        cascades[verdict] = BloomCascade.build(listed, universe)
    hits = {v: F.filter(F.col("__keys"), c.contains) for v, c in cascades.items()}
    longest = {v: F.element_at(F.array_sort(h, lambda a, b: F.length(b) - F.length(a)), F.lit(1)) for v, h in ((v, F.when(F.size(h) > 0, h)) for v, h in hits.items())}
    judged = keyed.withColumn("__block", longest["block"]).withColumn("__allow", longest["allow"])
    blocks = F.col("__block").isNotNull() & (F.col("__allow").isNull() | (F.length("__block") > F.length("__allow")))
    judged = judged.withColumn("rule", F.when(blocks, F.col("__block")).otherwise(F.col("__allow")))
    judged = judged.withColumn("verdict", F.when(blocks, F.lit("block")).otherwise(F.lit("allow")))
    found = ["host", "path", "rule", "verdict"]
    own = [F.col(c) if c in found else F.col("row").getField(c).alias(c) for c in pages.columns]
    return judged.select(*own, *(c for c in found if c not in pages.columns))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule and verdict of every page by RULES; null and odd urls are allowed, repeated rows judged each."""
    pages = doc_columns(read_table(spark, sf_dir, "pages"), "page_id", "url")
    return judge(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


OP10_SQL = """
WITH cut AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(verdict, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
fits AS (
  SELECT page_id, rhost || rpath AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC) AS k
  FROM cut JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT c.page_id, c.host, c.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM cut c LEFT JOIN fits f ON c.page_id = f.page_id AND f.k = 1
"""
