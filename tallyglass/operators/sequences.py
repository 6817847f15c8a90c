"""Order-dependent rules as window functions: filling, splitting, inheriting, runs, running allowances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TAIL_MS = 4000


def fill_end_times(cues: DataFrame, group: str, order: list[str], start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """A missing end becomes the next start, one beyond it is cut to it; the last missing end is its start and four seconds."""
    nxt = F.lead(start).over(Window.partitionBy(group).orderBy(*order))
    last = F.coalesce(F.col(end), F.when(nxt.isNull(), F.col(start) + TAIL_MS))
    return cues.withColumn(end, F.least(last, nxt))


def gaps(rows: DataFrame, group: str, order: list[str], begin: Column, end: Column) -> DataFrame:
    """Append gap: the distance from the end of the row before; null for the first."""
    return rows.withColumn("gap", begin - F.lag(end).over(Window.partitionBy(group).orderBy(*order)))


def words(rows: DataFrame, group: str, order: list[str], threshold: Column) -> DataFrame:
    """Append word: numbers rows from 0 by the gaps over a threshold so far."""
    over = F.coalesce((F.col("gap") > threshold).cast("int"), F.lit(0))
    return rows.withColumn("word", F.sum(over).over(Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def context(rows: DataFrame, group: str, order: list[str], text: str, most: int = 12) -> DataFrame:
    """Append context: the last ``most`` texts before a row, without empty and missing ones."""
    said = F.coalesce(F.col(text) != "", F.lit(False))
    among = Window.partitionBy(group, said).orderBy(*order).rowsBetween(1 - most, 0)  # rows with text, by themselves
    before = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_recent", F.when(said, F.collect_list(text).over(among)))
    return rows.withColumn("context", F.coalesce(F.last("_recent", ignorenulls=True).over(before), F.array().cast("array<string>"))).drop("_recent")


def inherit(rows: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """A missing value becomes the next known one of its group, else the last known before."""
    w = Window.partitionBy(group).orderBy(*order)
    after = F.first(value, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    before = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(value, F.coalesce(after, before))


def queue(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Append position (from 1) and ahead: how many wait before."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("position", place).withColumn("ahead", F.col("position") - 1)


def runs(rows: DataFrame, group: str, order: list[str], value: str, least: int = 3) -> DataFrame:
    """Runs of one value in a row of at least ``least``: group, value, first and last order column, length."""
    w = Window.partitionBy(group).orderBy(*order)
    same = Window.partitionBy(group, value).orderBy(*order)
    island = F.row_number().over(w) - F.row_number().over(same)
    found = rows.withColumn("_i", island).groupBy(group, value, "_i")
    return found.agg(F.min(order[0]).alias("first_id"), F.max(order[0]).alias("last_id"), F.count("*").alias("length")).where(F.col("length") >= least).drop("_i")


def allowance(rows: DataFrame, keys: list[str], order: list[str], used: str, cap: float) -> DataFrame:
    """Append left: what remains of a key's allowance after a row, never below 0."""
    so_far = F.sum(used).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("left", F.greatest(F.lit(cap) - so_far, F.lit(0)))


def change_feed(rows: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the row before in their group, first ones included."""
    before = F.lag(value).over(Window.partitionBy(group).orderBy(*order))
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    marked = rows.withColumn("before", before).withColumn("_place", place)
    return marked.where((F.col("_place") == 1) | ~F.col(value).eqNullSafe(F.col("before"))).drop("_place")


def otsu_threshold(rows: DataFrame, value: str) -> DataFrame:
    """One row: the threshold half above the value that parts a histogram with the most variance between its sides.

    Negative values don't count; fewer than two leave 12, a single distinct value itself. The variance is
    compared by whole numbers up to a common factor; of equals the first wins. The histogram of a
    measured size is small; its running sums are a window over it.
    """
    counts = rows.where(F.col(value) >= 0).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    upto = Window.partitionBy("_one").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("_one")
    c = counts.withColumn("_one", F.lit(1))
    c = c.select(
        "v", F.sum("n").over(upto).alias("n0"), F.sum(F.col("n") * F.col("v")).over(upto).alias("s0"), F.sum("n").over(every).alias("n"), F.sum(F.col("n") * F.col("v")).over(every).alias("s")
    )
    between = F.pow(F.col("s0") * F.col("n") - F.col("s") * F.col("n0"), F.lit(2)) / (F.col("n0") * (F.col("n") - F.col("n0")))
    c = c.withColumn("between", F.when(F.col("n0") < F.col("n"), F.round(between, 6)))
    found = c.agg(F.max("n").alias("n"), F.min("v").alias("low"), F.count("*").alias("values"), F.max_by("v", F.struct(F.coalesce("between", F.lit(-1.0)).alias("b"), (-F.col("v")).alias("v"))).alias("at"))
    level = F.when(F.coalesce("n", F.lit(0)) < 2, 12.0).when(F.col("values") == 1, F.col("low")).otherwise(F.col("at") + 0.5)
    return found.select(level.alias("threshold"))
