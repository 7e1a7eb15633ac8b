"""Tallies, histograms and exact quantiles over run and task snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Upper bounds of the duration buckets (a value on a bound is below it); one more bucket is open.
BOUNDS = (0.1, 1.0, 10.0, 60.0, 300.0, 3600.0)


def tally(rows: DataFrame, key: str, amount: Column | None = None) -> DataFrame:
    """key, n: how many rows, or how much, for each key; a null key counts as one."""
    return rows.groupBy(key).agg((F.count("*") if amount is None else F.sum(amount)).alias("n"))


def top(tallied: DataFrame, key: str, k: int = 5) -> DataFrame:
    """The k keys with the largest n, ties by key."""
    return tallied.orderBy(F.desc("n"), F.asc(key)).limit(k)


def shares(tallied: DataFrame, key: str) -> DataFrame:
    """key, share of the total."""
    total = tallied.agg(F.sum("n")).scalar()
    return tallied.withColumn("total", total).where("total <> 0").select(key, (F.col("n") / F.col("total")).alias("share"))


def task_tallies(tasks: DataFrame) -> DataFrame:
    """task, attempts, retries, waits over all runs; tasks without any of them are left out."""
    found = tasks.groupBy("task").agg(F.sum("attempts").alias("attempts"), F.sum("retries").alias("retries"), F.sum("resource_waits").alias("waits"))
    return found.where("attempts > 0 or retries > 0 or waits > 0")


def bucket_of(value: Column) -> Column:
    """Number of the bucket of a value, from 0."""
    found = F.lit(len(BOUNDS))
    for n in reversed(range(len(BOUNDS))):
        found = F.when(value <= BOUNDS[n], n).otherwise(found)
    return found


def histogram(values: DataFrame, column: str) -> DataFrame:
    """bucket, upper (null: open), n for every bucket, empty ones too; null values aren't counted."""
    spark = values.sparkSession
    buckets = spark.createDataFrame([(n, b) for n, b in enumerate([*BOUNDS, None])], "bucket int, upper double")
    counted = values.where(F.col(column).isNotNull()).groupBy(bucket_of(F.col(column)).alias("bucket")).agg(F.count("*").alias("n"))
    return F.broadcast(buckets).join(counted, "bucket", "left").select("bucket", "upper", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def moments(values: DataFrame, column: str) -> DataFrame:
    """count, total, mean, least, greatest; zeros if there are no values."""
    c, zero = F.col(column), F.lit(0.0)
    return values.agg(
        F.count(c).alias("count"), F.coalesce(F.sum(c), zero).alias("total"), F.coalesce(F.avg(c), zero).alias("mean"), F.coalesce(F.min(c), zero).alias("least"),
        F.coalesce(F.max(c), zero).alias("greatest"),
    )


def quantiles(values: DataFrame, column: str, fractions: tuple[float, ...]) -> DataFrame:
    """fraction, value: the value at place round(fraction * (n - 1)), halves to even, of the sorted values; 0.0 of none.

    Places come from a running count over the distinct values, so rows are combined before they are put in order. The
    order is made in ranges: a range's count says at which place it starts, and only the counts meet in one task.
    """
    if any(not 0 <= f <= 1 for f in fractions):
        raise ValueError("a fraction must lie between 0 and 1")
    spark, parts = values.sparkSession, 256
    counted = values.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("n"))
    # Cut points of the ranges: an approximation will do, since counts are exact.
    cuts = counted.agg(F.percentile_approx("v", [i / parts for i in range(1, parts)], 10_000).alias("cuts")).first().cuts or []
    at = F.lit(0)
    if cuts:
        bounds = F.array(*[F.lit(float(c)) for c in sorted(set(cuts))])
        at = F.size(F.filter(bounds, lambda b: b < F.col("v")))
    ranged = counted.withColumn("part", at)
    sizes = ranged.groupBy("part").agg(F.sum("n").alias("size"))
    order = Window.partitionBy(F.lit(0)).orderBy("part")
    starts = sizes.select(F.col("part").alias("p"), (F.sum("size").over(order) - F.col("size")).alias("start"), F.sum("size").over(Window.partitionBy(F.lit(0))).alias("total"))
    own = F.sum("n").over(Window.partitionBy("part").orderBy("v"))
    placed = ranged.withColumn("until", own).join(F.broadcast(starts), F.col("part") == F.col("p")).select("v", (F.col("start") + F.col("until") - F.col("n")).alias("low"), (F.col("start") + F.col("until")).alias("high"), "total")
    asked = spark.createDataFrame([(float(f),) for f in fractions], "fraction double")
    place = lambda f: F.rint(f * (F.col("total") - 1))
    here = F.filter(F.array(*[F.lit(float(f)) for f in fractions]), lambda f: (place(f) >= F.col("low")) & (place(f) < F.col("high")))
    found = placed.select(F.explode(here).alias("f"), "v")
    return asked.join(F.broadcast(found), F.col("fraction") == F.col("f"), "left").select("fraction", F.coalesce("v", F.lit(0.0)).alias("value"))


def ran(tasks: DataFrame) -> DataFrame:
    """Tasks whose durations count: they ran, and have one."""
    return tasks.where("attempts > 0 and duration is not null")


def slowest(tasks: DataFrame, k: int = 5) -> DataFrame:
    """task, total: the k task names with the longest durations over all runs."""
    return ran(tasks).groupBy("task").agg(F.sum("duration").alias("total")).orderBy(F.desc("total"), "task").limit(k)


def flakiest(tasks: DataFrame, k: int = 5) -> DataFrame:
    """task, n: the k task names with the most retries."""
    return top(tasks.groupBy("task").agg(F.sum("retries").alias("n")).where("n > 0"), "task", k)


def run_summary(runs: DataFrame) -> DataFrame:
    """runs, succeeded, failed, success_rate (0 without runs), attempts, retries."""
    n, good = F.count("*"), F.count_if(F.col("state") == "succeeded")
    return runs.agg(
        n.alias("runs"), good.alias("succeeded"), F.count_if(F.col("state") == "failed").alias("failed"), F.when(n == 0, 0.0).otherwise(good / F.when(n == 0, 1).otherwise(n)).alias("success_rate"),
        F.coalesce(F.sum("attempts"), F.lit(0)).alias("attempts"), F.coalesce(F.sum("retries"), F.lit(0)).alias("retries"),
    )


def merge_tallies(*parts: DataFrame) -> DataFrame:
    """Tallies of several sources (key, n), added up: what partial aggregation does."""
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    key = found.columns[0]
    return found.groupBy(key).agg(F.sum("n").alias("n"))


def merge_histograms(*parts: DataFrame) -> DataFrame:
    """Histograms of several sources, added up bucket by bucket."""
    return reduce(DataFrame.unionByName, parts).groupBy("bucket", "upper").agg(F.sum("n").alias("n"))


def merge_moments(*parts: DataFrame) -> DataFrame:
    """Moments of several sources as those of all their values; sources without values have no say."""
    some, zero = F.col("count") > 0, F.lit(0.0)
    count, total = F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.sum("total"), zero)
    return reduce(DataFrame.unionByName, parts).agg(
        count.alias("count"), total.alias("total"), F.when(count > 0, total / F.when(count > 0, count)).otherwise(zero).alias("mean"),
        F.coalesce(F.min(F.when(some, F.col("least"))), zero).alias("least"), F.coalesce(F.max(F.when(some, F.col("greatest"))), zero).alias("greatest"),
    )


def pool_peaks(moves: DataFrame) -> DataFrame:
    """run_id, pool, peak, final from rows run_id, seq, kind, pool, units: the running sum of what is acquired less what is released."""
    change = F.when(F.col("kind") == "resource_acquired", F.col("units")).when(F.col("kind") == "resource_released", -F.col("units")).otherwise(0)
    used = F.sum(change).over(Window.partitionBy("run_id", "pool").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return moves.withColumn("used", used).groupBy("run_id", "pool").agg(F.greatest(F.lit(0), F.max("used")).alias("peak"), F.max_by("used", "seq").alias("final"))
