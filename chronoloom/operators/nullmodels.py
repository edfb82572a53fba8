"""Null models: concentration in time, permutation z-scores, corrections for many tests."""

from __future__ import annotations

from decimal import Decimal
from math import exp, lgamma, log, sqrt
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import settle
from .consensus import places, running_sums

#: Rows of ordered_spread() that a task makes.
ORDERED = 1 << 22


def draw(trial: Column, key: Column, seed: int) -> Column:
    """A pseudo-random order that any engine can repeat: the md5 of seed, trial and key."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), trial.cast("string"), key.cast("string")))


def concentration(members: DataFrame, trials: int, seed: int = 42) -> DataFrame:
    """members: book_id, label, year.  label, n, sigma, z: how far the spread of a community's years is from that of as
    many years drawn without replacement from all.  A trial orders all books once; a community of n takes its first n.
    """
    own = members.groupBy("label").agg(F.count("*").alias("n"), F.stddev_pop("year").alias("sigma"))
    null = ordered_spread(members, settle(own.select("n").distinct()), trials, seed)
    return own.join(null, "n").select("label", "n", "sigma", F.try_divide(F.col("sigma") - F.col("mean"), F.col("sd")).alias("z"))


def concentration_of_runs(members: DataFrame, trials: int, seed: int = 42) -> DataFrame:
    """As concentration(), with draws by null_spread()."""
    own = members.groupBy("label").agg(F.count("*").alias("n"), F.stddev_pop("year").alias("sigma"))
    null = null_spread(members, own.select("n").distinct(), trials, seed)
    return own.join(null, "n").select("label", "n", "sigma", F.try_divide(F.col("sigma") - F.col("mean"), F.col("sd")).alias("z"))


def ordered_spread(members: DataFrame, sizes: DataFrame, trials: int, seed: int, margin: float = 6.0) -> DataFrame:
    """n, mean, sd of the spread of the first n years of each trial's own order of all books, for each of sizes (n; a row for each size).

    Only the first of a trial, up to the largest size, can be drawn, so books whose order lies beyond that share and a margin (in
    deviations) go before they are sorted; a trial with too few left takes all of its books.  Trials lie one behind the other in
    ranges sorted apart, and a draw is a running sum less that where its trial begins.
    """
    spark = members.sparkSession
    total, most = members.count(), sizes.agg(F.max("n")).first()[0] or 0
    books = members.select("book_id", F.col("year").cast("long").alias("y"))
    parts = max(spark.sparkContext.defaultParallelism, total * trials // ORDERED)
    dealt = books.repartition(parts, "book_id").withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    dealt = dealt.withColumn("h", draw(F.col("trial"), F.col("book_id"), seed))
    share = most / max(total, 1)
    limit = int((share + (margin * sqrt(share) + margin) / sqrt(max(total, 1))) * (1 << 32))
    first = F.conv(F.substring("h", 1, 8), 16, 10).cast("long") < limit
    some = settle(dealt.where(first)) if limit < 1 << 32 else dealt
    if limit < 1 << 32:
        held = some.groupBy("trial").agg(F.count("*").alias("held"))
        short = [r["trial"] for r in spark.range(trials).select(F.col("id").cast("int").alias("trial")).join(held, "trial", "left").where(F.coalesce("held", F.lit(0)) < most).collect()]  # a number for each trial at most
        if short:
            some = some.unionByName(dealt.where(F.col("trial").isin(short) & ~first))
    y = F.coalesce("y", F.lit(0).cast("long"))
    rows = some.select("trial", "h", "book_id", y.alias("y"), (y * y).alias("yy"), F.col("y").isNotNull().cast("long").alias("dated"))
    sums = running_sums(rows, [F.asc("trial"), F.asc("h"), F.asc("book_id")], ["y", "yy", "dated"]).withColumn("trial", F.col("trial").cast("int"))
    sums = settle(sums.select("trial", "place", "y", "yy", "dated", "sum_y", "sum_yy", "sum_dated"))
    before = sums.groupBy("trial").agg(F.min("place").alias("from"), *(F.min_by(F.col(f"sum_{c}") - F.col(c), "place").alias(f"b_{c}") for c in ("y", "yy", "dated")))
    ends = before.join(F.broadcast(sizes.where("n > 0"))).withColumn("place", F.col("from") + F.col("n") - 1)  # a row for each size
    draws = ends.join(sums.select("place", "sum_y", "sum_yy", "sum_dated"), "place")
    s, ss, c = (F.col(f"sum_{x}") - F.col(f"b_{x}") for x in ("y", "yy", "dated"))
    spread = F.when(c > 0, F.sqrt(F.greatest(ss / c - (s / c) * (s / c), F.lit(0.0))))
    return draws.groupBy("n").agg(F.avg(spread).alias("mean"), F.stddev_pop(spread).alias("sd"))


def null_spread(members: DataFrame, sizes: DataFrame, trials: int, seed: int) -> DataFrame:
    """n, mean, sd of the spread of n years drawn without replacement, for each of sizes (n; a row for each size).

    All books are ordered at random once and cut in runs of n: every run is a draw, so one order gives as many draws as
    it has whole runs, and orders are made until the largest size has its trials.  Orders lie one behind the other in
    ranges sorted apart, and a draw is the difference of running sums at its two ends.
    """
    books = members.where("year is not null").select("book_id", F.col("year").cast("long").alias("y"))
    need = books.agg(F.count("*").alias("all")).join(F.broadcast(sizes.agg(F.max("n").alias("most"))))  # one row
    need = need.where("most > 0").select("all", F.ceil(F.lit(trials) / F.floor(F.col("all") / F.col("most"))).cast("int").alias("orders"))
    dealt = books.join(F.broadcast(need)).select("book_id", "y", (F.col("y") * F.col("y")).alias("yy"), F.explode(F.sequence(F.lit(0), F.col("orders") - 1)).alias("trial"))  # one row
    dealt = dealt.withColumn("h", draw(F.col("trial"), F.col("book_id"), seed))
    sums = running_sums(dealt, [F.asc("trial"), F.asc("h"), F.asc("book_id")], ["y", "yy"]).select("place", "sum_y", "sum_yy")
    runs = sizes.where("n > 0").join(F.broadcast(need)).select("n", "all", F.floor(F.col("all") / F.col("n")).alias("per"), F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("i"))  # one row
    first = F.floor(F.col("i") / F.col("per")).cast("long") * F.col("all") + (F.col("i") % F.col("per")) * F.col("n")
    ends = runs.select("n", "i", F.explode(F.array(F.struct(first.alias("place"), F.lit(-1).alias("sign")), F.struct((first + F.col("n")).alias("place"), F.lit(1).alias("sign")))).alias("e")).select("n", "i", "e.*")
    draws = ends.hint("merge").join(sums, "place").groupBy("n", "i").agg(F.sum(F.col("sign") * F.col("sum_y")).alias("s"), F.sum(F.col("sign") * F.col("sum_yy")).alias("ss"))
    spread = F.sqrt(F.greatest(F.col("ss") / F.col("n") - (F.col("s") / F.col("n")) * (F.col("s") / F.col("n")), F.lit(0.0)))
    return draws.groupBy("n").agg(F.avg(spread).alias("mean"), F.stddev_pop(spread).alias("sd"))


def bonferroni_z(tests: int, alpha: float = 0.05) -> float:
    """One-sided critical z of that many tests."""
    return NormalDist().inv_cdf(alpha / tests)


def bonferroni_limit(tests: Column, alpha: float = 0.05) -> Column:
    """bonferroni_z() of a column, for tables as small as their groups of tests."""
    @F.pandas_udf("double")
    def limit(n: pd.Series) -> pd.Series:
        return n.map(lambda x: bonferroni_z(int(x), alpha))

    return limit(tests.cast("long"))


def benjamini_hochberg(rows: DataFrame, p: str, alpha: float = 0.05) -> DataFrame:
    """rows with rank and discovery: p at most the largest p with p <= alpha rank / tests (one row a test); ranges of p are ranked apart."""
    n = rows.agg(F.count("*").alias("m"))
    ranked = places(rows, [F.asc(p)]).withColumnRenamed("place", "rank").join(F.broadcast(n))  # one row
    limit = (F.lit(Decimal(str(alpha))) * F.col("rank")).cast("double") / F.col("m")  # rounded once, as decimals are multiplied exactly
    cut = ranked.agg(F.max(F.when(F.col(p) <= limit, F.col(p))).alias("cut"))
    return ranked.join(F.broadcast(cut)).withColumn("discovery", F.coalesce(F.col(p) <= F.col("cut"), F.lit(False))).drop("m", "cut")  # one row


def pool_z(pairs: DataFrame, pool: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """by, n, observed, z: the mean over documented pairs against means of as many draws with replacement from the pool.

    Such means have the pool's mean and its deviation over root n, so no draw is needed.  Null without pairs or pool.
    """
    by = by or []
    own = pairs.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("observed"))
    null = pool.where(F.col(value).isNotNull()).groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))
    both = own.join(null, by) if by else own.join(F.broadcast(null))  # one row
    z = (F.col("observed") - F.col("mean")) / (F.col("sd") / F.sqrt("n") + 1e-12)
    return both.select(*by, "n", "observed", F.when(F.col("n") > 0, z).alias("z"))


def moments_z(pairs: DataFrame, moments: DataFrame, value: str, by: list[str]) -> DataFrame:
    """As pool_z(), from the pool's n, total and squares by group instead of its rows."""
    own = pairs.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("observed"))
    mean = F.col("total") / F.col("pool")
    null = moments.withColumnRenamed("n", "pool").where("pool > 0").select(*by, mean.alias("mean"), F.sqrt(F.greatest(F.col("squares") / F.col("pool") - mean * mean, F.lit(0.0))).alias("sd"))
    z = (F.col("observed") - F.col("mean")) / (F.col("sd") / F.sqrt("n") + 1e-12)
    return own.join(null, by).select(*by, "n", "observed", z.alias("z"))


def events_z(rows: DataFrame, kinds: list[str]) -> DataFrame:
    """rows: trial (0: as it was) and a column for each kind of event.  kind, observed, mean, deviation, z, trials: totals against those of the trials."""
    totals = rows.groupBy("trial").agg(*(F.sum(c).alias(c) for c in kinds)).select("trial", F.explode(F.array(*(F.struct(F.lit(c).alias("kind"), F.col(c).alias("n")) for c in kinds))).alias("e")).select("trial", "e.*")
    own = F.max(F.when(F.col("trial") == 0, F.col("n")))
    drawn = F.when(F.col("trial") > 0, F.col("n"))
    found = totals.groupBy("kind").agg(own.alias("observed"), F.avg(drawn).alias("mean"), F.stddev_pop(drawn).alias("deviation"), F.count(drawn).alias("trials"))
    z = F.try_divide(F.col("observed") - F.col("mean"), F.nullif("deviation", F.lit(0.0)))
    return found.select("kind", "observed", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"), F.round(z, 4).alias("z"), "trials")


def average_ranks(rows: DataFrame, value: str, name: str) -> DataFrame:
    """rows with the average rank of value: the mean of the places that equal values take, ranges of values placed apart."""
    ranked = places(rows.select(value), [F.asc(value)]).groupBy(value).agg(F.avg("place").alias(name))
    return rows.join(ranked, value)


def pearson(x: str, y: str, least: int = 3) -> Column:
    """Correlation of the rows with both values; null for fewer than least."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    return F.when(F.count_if(both) >= least, F.corr(x, y))


def verdict(rows: DataFrame, z: str, least: float = 3.0) -> DataFrame:
    return rows.withColumn("verdict", F.when(F.col(z) > least, "survives").when(F.col(z).isNull(), "untested").otherwise("does not survive"))


def set_concentration(sets: DataFrame, members: DataFrame, trials: int, seed: int = 42) -> DataFrame:
    """sets: run, community, node.  run, community, z: communities of many runs, each different set of nodes tested once."""
    keyed = settle(sets.groupBy("run", "community").agg(F.md5(F.array_join(F.array_sort(F.collect_list("node")), ",")).alias("key"), F.count("*").alias("n")))
    first = keyed.groupBy("key").agg(F.min(F.struct("run", "community")).alias("s")).select("key", "s.*")
    # a table that comes to the driver to be broadcast as it is small when packed may be large there: these grow, and are merged
    own = sets.join(first.hint("merge"), ["run", "community"]).join(members.select(F.col("book_id").alias("node"), "year").hint("merge"), "node")
    sigma = own.groupBy("key").agg(F.count("*").alias("n"), F.stddev_pop("year").alias("sigma"))
    null = null_spread(members, sigma.select("n").distinct(), trials, seed)
    z = sigma.join(null, "n").select("key", F.try_divide(F.col("sigma") - F.col("mean"), F.col("sd")).alias("z"))
    return keyed.join(z.hint("merge"), "key").select("run", "community", "n", "z")


def recurring_significance(members: DataFrame, z: DataFrame, seeds: int, share: float = 0.6) -> DataFrame:
    """members: resolution, place, seeds_seen, run, community.  z: run, community, n, z.

    Of each group: z_median, z_min, z_max over its communities, the representative (that at half the count in the order
    of z, so no single lucky run speaks for the group), whether it is stable, and whether it is concentrated: by itself,
    and, if stable, after correction for as many tests as its resolution has groups.
    """
    rows = members.join(z.hint("merge"), ["run", "community"])
    key = ["resolution", "place"]
    w = Window.partitionBy(*key).orderBy("z", "run", "community")
    counted = rows.groupBy(*key).agg(F.count("*").alias("seen"), F.median("z").alias("z_median"), F.min("z").alias("z_min"), F.max("z").alias("z_max"))
    mid = rows.withColumn("k", F.row_number().over(w)).join(counted.hint("merge"), key).where(F.col("k") == F.floor(F.col("seen") / 2) + 1)
    tests = members.select(*key).distinct().groupBy("resolution").agg(F.count("*").alias("tests")).withColumn("limit", bonferroni_limit(F.col("tests")))
    stable = F.col("seeds_seen") >= share * seeds
    columns = [*key, "run", "community", "n", "z_median", "z_min", "z_max", "seeds_seen", "tests", stable.alias("stable")]
    return mid.join(tests, "resolution").select(*columns, (F.col("z_median") <= -2.0).alias("significant_raw"), ((F.col("z_median") <= F.col("limit")) & stable).alias("significant"))


def spearman_p(rho: Column, n: Column) -> Column:
    """Two-sided p of a rank correlation by the t distribution with n - 2 degrees of freedom; null for n under 3."""
    @F.pandas_udf("double")
    def tail(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) or pd.isna(d) or d < 1 else student_tail(abs(a), d) for a, d in zip(t, df)])

    t = rho * F.sqrt((n - 2) / F.greatest(1 - rho * rho, F.lit(1e-300)))
    return F.when(n >= 3, tail(t.cast("double"), (n - 2).cast("double")))


def student_tail(t: float, df: float) -> float:
    """P(|T| >= t): the regularised incomplete beta function at df / (df + t^2), by its continued fraction."""
    x = df / (df + t * t)
    if x >= 1:
        return 1.0

    def fraction(x: float, a: float, b: float) -> float:
        c, d = 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d if abs(d) > 1e-300 else 1e-300)
        h = d
        for m in range(1, 500):
            for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 + term * d
                d = 1 / (d if abs(d) > 1e-300 else 1e-300)
                c = 1 + term / (c if abs(c) > 1e-300 else 1e-300)
                h *= c * d
            if abs(c * d - 1) < 1e-14:
                break
        return h

    def beta(x: float, a: float, b: float) -> float:
        front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x))
        return front * fraction(x, a, b) / a

    a, b = df / 2, 0.5
    return beta(x, a, b) if x < (a + 1) / (a + b + 2) else 1 - beta(1 - x, b, a)
