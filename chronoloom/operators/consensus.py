"""Consensus of claims, author aggregates and joins of validation sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.tables import settle


def keyed_claims(claims: DataFrame, first: int, before: int) -> DataFrame:
    """Claims of the years first <= year < before, with their match key; claims without a readable year go."""
    year = F.col("year").try_cast("int")
    return claims.withColumn("year", year).where((year >= first) & (year < before)).withColumn("key", X.match_key(F.col("title"), F.col("author")))


def mode_first_seen(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """keys and the most frequent value; of equally frequent ones the one seen first."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"), F.min(order).alias("__first"))
    return counted.groupBy(*keys).agg(F.min_by(value, F.struct((-F.col("__n")).alias("n"), "__first")).alias(value))


def consensus(claims: DataFrame, first: int, before: int) -> DataFrame:
    """claims: ord, provider, list_name, title, author, year.  title, author, year, support, models, n_lists for each work.

    The first title and author in the order of the claims, the most frequent year, all providers and lists once.
    """
    keyed = keyed_claims(claims, first, before)
    merged = keyed.groupBy("key").agg(F.min_by("title", F.when(F.col("title").isNotNull(), F.col("ord"))).alias("title"), F.min_by("author", F.when(F.col("author").isNotNull(), F.col("ord"))).alias("author"), F.array_sort(F.collect_set("provider")).alias("models"), F.count_distinct("list_name").cast("int").alias("n_lists"))
    years = mode_first_seen(keyed, ["key"], "year", "ord")
    return merged.join(years, "key").select("title", "author", "year", (F.col("n_lists") + F.size("models")).alias("support"), "models", "n_lists")


def value_places(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value, n, upto, total: how often each value occurs in its group, how many of the group are up to it, and how many it has.

    Rows are counted by value first, so what is ordered in a group is its different values (a calendar, for years), not its rows.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    return counts.withColumn("upto", F.sum("n").over(w)).join(total, keys)


def upper_median(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value: the element at half the count of a group's sorted values, not interpolated."""
    return value_places(rows, keys, value).where(F.col("upto") > F.floor(F.col("total") / 2)).groupBy(*keys).agg(F.min(value).alias(value))


def first_rows(rows: DataFrame, keys: list[str], order: list[Column], n: int, by: str, parts: int = 64) -> DataFrame:
    """The first n rows of each group with their place; a group is cut in parts (by a hash of `by`), and the first n of each part are ordered together."""
    part = F.pmod(F.xxhash64(by), F.lit(parts))
    few = rows.withColumn("__part", part).withColumn("place", F.row_number().over(Window.partitionBy(*keys, "__part").orderBy(*order))).where(F.col("place") <= n)
    return few.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= n).drop("__part")


def datable(books: DataFrame, key: str, text: str, labels: str, untracked: list[str]) -> DataFrame:
    """key, year, labels of the books that a timeline can hold: a year stands in the text, and a label is left without those untracked."""
    rows = books.select(key, X.year_in(F.col(text)).alias("year"), F.filter(labels, lambda g: g.isNotNull() & ~g.isin(*untracked)).alias("labels"))
    return rows.where(F.col("year").isNotNull() & (F.size("labels") > 0))


def _ranges(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Rows with __part, the range of the order that they lie in.  Stored, as ranges come from a sample, and one drawn again would cut elsewhere."""
    return settle(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))


def places(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Rows with their place from 1 in a total order: ranges are sorted apart, and a range adds the sizes of those before."""
    ranges = _ranges(rows, order)
    local = ranges.withColumn("__k", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    sizes = ranges.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return local.join(before.select("__part", "__before"), "__part").withColumn("place", (F.col("__k") + F.col("__before")).cast("int")).drop("__part", "__k", "__before")


def running_sums(rows: DataFrame, order: list[Column], sums: list[str]) -> DataFrame:
    """Rows with their place (long) from 1 in a total order, and the sums of columns up to it: ranges are sorted apart, and a range adds what those before hold."""
    ranges = _ranges(rows, order)
    w = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = ranges.select("*", F.count(F.lit(1)).over(w).alias("__k"), *(F.sum(c).over(w).alias(f"__{c}") for c in sums))
    whole = ranges.groupBy("__part").agg(F.count(F.lit(1)).alias("__k"), *(F.sum(c).alias(f"__{c}") for c in sums))
    b = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    before = whole.select("__part", *(F.coalesce(F.sum(c).over(b), F.lit(0)).alias(f"{c}_b") for c in ("__k", *(f"__{c}" for c in sums))))
    total = lambda c: (F.col(c) + F.col(f"{c}_b")).cast("long")
    return local.join(before, "__part").select(*rows.columns, total("__k").alias("place"), *(total(f"__{c}").alias(f"sum_{c}") for c in sums))


def aliases(names: DataFrame) -> DataFrame:
    """name and the longest name of the same surname (of equally long ones the last in order)."""
    keyed = names.withColumn("surname", X.surname(F.col("name")))
    longest = keyed.groupBy("surname").agg(F.max_by("name", F.struct(F.length("name"), "name")).alias("canonical"))
    return keyed.join(longest, "surname").select("name", "canonical")


def author_digests(books: DataFrame, works: int = 6, words: int = 250) -> DataFrame:
    """author, earliest_year, n_books_total, n_books_used and digest, the heads of the earliest works in order."""
    rows = books.where(F.col("year").isNotNull())
    ranked = rows.withColumn("rn", F.row_number().over(Window.partitionBy("author").orderBy("year", "book_id"))).where(F.col("rn") <= works)
    heads = ranked.select("author", "rn", X.first_words(F.col("description"), words).alias("head"))
    used = heads.groupBy("author").agg(F.count("*").alias("n_books_used"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "head"))), lambda x: x["head"]), " ").alias("digest"))
    totals = rows.groupBy("author").agg(F.min("year").alias("earliest_year"), F.count("*").alias("n_books_total"))
    return totals.join(used, "author")


def not_done(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return todo.join(done, key, "left_anti")


def forward_pairs(pairs: DataFrame, authors: DataFrame) -> DataFrame:
    """Documented pairs whose both ends are known authors, the first earlier than the second, with both ends' columns."""
    a = authors.select(F.col("author_id").alias("from_id"), F.col("earliest_year").alias("from_year"), F.col("n_books").alias("from_books"), F.col("form").alias("from_form"), F.col("embedding").alias("from_embedding"))
    b = authors.select(F.col("author_id").alias("to_id"), F.col("earliest_year").alias("to_year"), F.col("n_books").alias("to_books"), F.col("form").alias("to_form"), F.col("embedding").alias("to_embedding"))
    return pairs.join(a, "from_id").join(b, "to_id").where("from_year < to_year")


def merge_validations(known: DataFrame, other: DataFrame, name: str = "wikidata") -> DataFrame:
    a = known.select("from_id", "to_id", F.lit(True).alias("a"))
    b = other.select("from_id", "to_id", F.lit(True).alias("b"))
    both = a.join(b, ["from_id", "to_id"], "full_outer")
    return both.select("from_id", "to_id", F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), "known").otherwise(name).alias("validated"))


def first_note(notes: Column, name: Column) -> Column:
    """The first note that holds the name, else null."""
    return F.get(F.filter(notes, lambda n: F.contains(n, name)), F.lit(0))


def with_default(asked: DataFrame, answered: DataFrame, key: str, value: str, default: str) -> DataFrame:
    return asked.join(answered, key, "left").select(key, F.coalesce(value, F.lit(default)).alias(value))


def distinct_in_order(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min(order).alias(order))


def publication_years(who: DataFrame, editions: DataFrame, key: str, after: int = 15, least: int = 1400, fallback: int = 30) -> DataFrame:
    """who: key, birth; editions: key, edition.  The least edition not before birth + after and least, else birth + fallback."""
    floor = F.greatest(F.coalesce("birth", F.lit(1385)) + after, F.lit(least))
    joined = who.join(editions, key, "left")
    return joined.groupBy(key, "birth").agg(F.min(F.when(F.col("edition") >= floor, F.col("edition"))).alias("y")).select(key, F.coalesce("y", F.col("birth") + fallback).alias("year"))
