"""Dating of terms from yearly frequencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dense(series: DataFrame, first: int, last: int) -> DataFrame:
    """term, year, freq for every year from first to last; what is missing is zero."""
    grid = series.select("term").distinct().select("term", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("year"))
    return grid.join(series, ["term", "year"], "left").select("term", "year", F.coalesce("freq", F.lit(0.0)).alias("freq"))


def smoothed(rows: DataFrame, width: int = 9) -> DataFrame:
    """Centred moving average whose window shrinks at the ends."""
    w = Window.partitionBy("term").orderBy("year").rowsBetween(-(width // 2), width // 2)
    return rows.withColumn("smooth", F.avg("freq").over(w))


def peaks(rows: DataFrame, value: str = "smooth") -> DataFrame:
    """term, peak, peak_year: the largest value, and the first year that has it."""
    return rows.groupBy("term").agg(F.max(value).alias("peak"), F.min_by("year", F.struct((-F.col(value)).alias("v"), "year")).alias("peak_year"))


def _ahead(span: int) -> object:
    return Window.partitionBy("term").orderBy("year").rowsBetween(0, span - 1)


def takeoff(rows: DataFrame, shares: list[float], persist: int = 10, value: str = "smooth") -> DataFrame:
    """term, share, takeoff: the first year at a share of the peak or more that stays so for persist years or to the end; null for a flat series."""
    top = rows.groupBy("term").agg(F.max(value).alias("peak"))
    each = rows.join(top, "term").withColumn("share", F.explode(F.array(*(F.lit(s) for s in shares))))
    w = Window.partitionBy("term", "share").orderBy("year").rowsBetween(0, persist - 1)
    held = F.min((F.col(value) >= F.col("share") * F.col("peak")).cast("int")).over(w)
    return each.withColumn("held", held).groupBy("term", "share").agg(F.min(F.when((F.col("held") == 1) & (F.col("peak") > 0), F.col("year"))).alias("takeoff"))


def mass_years(rows: DataFrame, shares: tuple = (0.25, 0.5, 0.75)) -> DataFrame:
    """term, q25, q50, q75, iqr: the first years by which the shares of the whole mass have come; null without mass."""
    w = Window.partitionBy("term").orderBy("year").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = rows.groupBy("term").agg(F.sum("freq").alias("total"))
    run = rows.withColumn("cum", F.sum("freq").over(w)).join(total, "term")
    found = run.groupBy("term").agg(*(F.min(F.when((F.col("total") > 0) & (F.col("cum") / F.col("total") >= s), F.col("year"))).alias(f"q{int(100 * s)}") for s in shares))
    return found.withColumn("iqr", F.col("q75") - F.col("q25"))


def attested(rows: DataFrame, need: int = 5, span: int = 10) -> DataFrame:
    """term, first: the first year with a use that has need years with one (or all that are left) among the next span."""
    used = F.count_if(F.col("freq") > 0).over(_ahead(span))
    left = F.count("*").over(Window.partitionBy("term").orderBy("year").rowsBetween(0, Window.unboundedFollowing))
    marked = rows.withColumn("used", used).withColumn("left", left)
    return marked.groupBy("term").agg(F.min(F.when((F.col("freq") > 0) & (F.col("used") >= F.least(F.lit(need), F.col("left"))), F.col("year"))).alias("first"))


def summed(rows: DataFrame, genres: DataFrame) -> DataFrame:
    """genres: genre, term.  term (the genre), year, freq: the sum of a genre's terms."""
    return genres.join(rows, "term").groupBy(F.col("genre").alias("term"), "year").agg(F.sum("freq").alias("freq"))


def drift(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """key, drift: b minus a (null if either is), and whether it is the largest."""
    both = a.select(key, F.col(value).alias("va")).join(b.select(key, F.col(value).alias("vb")), key).select(key, (F.col("vb") - F.col("va")).alias("drift"))
    worst = both.agg(F.max_by(key, F.when(F.col("drift").isNotNull(), F.struct("drift", key))).alias("worst"))
    return both.join(F.broadcast(worst)).select(key, "drift", F.coalesce(F.col(key) == F.col("worst"), F.lit(False)).alias("worst"))  # one row


def must_match(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join in which each row on the left has to find one on the right; else the query fails when it runs."""
    hit = right.withColumn("__hit", F.lit(True))
    joined = left.join(hit, key, "left")
    return joined.where(F.coalesce(F.col("__hit"), F.raise_error(F.concat(F.lit(f"no match for {key} "), F.col(key).cast("string"))).cast("boolean"))).drop("__hit")


def fits(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Straight line and power law (a line through the logs of positive values); r2 on the original scale, 0 without variance."""
    lx, ly = F.log(F.col(x).cast("double")), F.log(F.when(F.col(y) > 0, F.col(y)).cast("double"))
    both = rows.withColumn("lx", F.when(ly.isNotNull(), lx)).withColumn("ly", ly)
    c = both.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_slope("ly", "lx").alias("power"), F.exp(F.regr_intercept("ly", "lx")).alias("scale"), F.var_pop(y).alias("v"), F.count("*").alias("n"))
    line, law = F.col("slope") * F.col(x) + F.col("intercept"), F.col("scale") * F.pow(F.col(x).cast("double"), F.col("power"))

    def r2(fit: Column) -> Column:
        return F.when(F.first("v") > 0, 1 - F.sum((F.col(y) - fit) * (F.col(y) - fit)) / (F.first("v") * F.first("n"))).otherwise(0.0)

    return both.join(F.broadcast(c)).agg(F.first("slope").alias("slope"), F.first("intercept").alias("intercept"), F.first("power").alias("power"), F.first("scale").alias("scale"), r2(line).alias("r2_line"), r2(law).alias("r2_power"))  # one row
