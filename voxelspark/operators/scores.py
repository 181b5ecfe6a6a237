"""Results of benchmark runs: times by group, composite times, storage and performance scores."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values
from . import stats


def composite(times: DataFrame, seconds: str = "seconds") -> DataFrame:
    """(t_x, t_y, t_z, t_composite) of rows (axis, type, seconds): means of the groups that are there, then of the axes."""
    axis = times.groupBy("axis").agg(F.avg(seconds).alias("t"))
    of = lambda a: F.max(F.when(F.col("axis") == a, F.col("t"))).alias(f"t_{a}")
    return axis.agg(of("x"), of("y"), of("z"), F.avg("t").alias("t_composite"))


def composite_sixth(times: DataFrame, seconds: str = "seconds") -> DataFrame:
    """The other definition in use: the sum of all group times over six, and half sums for each axis."""
    of = lambda a: (F.sum(F.when(F.col("axis") == a, F.col(seconds))) / 2).alias(f"t_{a}")
    return times.agg(of("x"), of("y"), of("z"), (F.sum(seconds) / 6.0).alias("t_composite"))


def attributed(groups: DataFrame, total: str = "total_seconds", count: str = "slices") -> DataFrame:
    """A merged read's time shared out by slices."""
    every = Window.partitionBy(total)
    return groups.withColumn("seconds", F.col(total) * F.col(count) / F.sum(count).over(every))


def best_of(runs: DataFrame, seconds: str = "seconds") -> DataFrame:
    """The quickest repeat of each group (axis, type)."""
    return runs.groupBy("axis", "type").agg(F.min_by("iteration", seconds).alias("iteration"), F.min(seconds).alias("seconds"))


def summary(runs: DataFrame, *by: str, seconds: str = "seconds") -> DataFrame:
    """Number, total, least, mean, median, greatest time and coefficient of variation of each group."""
    return runs.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum(seconds).alias("total"), F.min(seconds).alias("least"), F.avg(seconds).alias("mean"),
        F.median(seconds).alias("median"), F.max(seconds).alias("most"), stats.variation(seconds).alias("cv"),
    )


def storage_score(ratio: Column | str) -> Column:
    """20 points, one less for each tenth that begins above a ratio of 1.5, none below 0."""
    over = F.ceil(F.round((values.double(ratio) - 1.5) / 0.1, 9))
    return F.greatest(F.lit(0), F.lit(20) - F.greatest(F.lit(0), over)).cast("int")


def storage_points(ratio: float) -> int:
    return max(0, 20 - max(0, math.ceil(round((ratio - 1.5) / 0.1, 9))))


def performance_score(baseline: Column | str, seconds: Column | str) -> Column:
    return F.try_divide(values.double(baseline), values.double(seconds)) * 60


def amplification(read: Column | str, asked: Column | str) -> Column:
    """Bytes read over bytes asked for; 1 where nothing was asked for."""
    return F.coalesce(F.try_divide(values.double(read), values.double(asked)), F.lit(1.0))


def dedup_ratio(eliminated: Column | str, logical: Column | str) -> Column:
    return F.coalesce(F.try_divide(values.double(eliminated), values.double(logical)), F.lit(0.0))


def merged_profiles(profiles: DataFrame, sums: list[str], tops: list[str], lasts: list[str], order: str, *by: str) -> DataFrame:
    """Profiles of several batches as one: counters add up, gauges keep the greatest, labels the latest."""
    return profiles.groupBy(*by).agg(
        *(F.sum(c).alias(c) for c in sums), *(F.max(c).alias(c) for c in tops), *(F.max_by(c, order).alias(c) for c in lasts)
    )
