"""Statistics that planning and reports need, by the definitions they use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import address, values


#: Ranges that values are put in order by.
RANGES = 200


def ranked(df: DataFrame, column: str, at: dict[str, str], *by: str) -> DataFrame:
    """Order statistics by index: ``at`` names each and gives its index as SQL over n.

    Nothing is collected into arrays.
    """
    rows = counted(df, column, *by)
    here = lambda index: F.expr(f"cast({index} as bigint) >= _end - _c and cast({index} as bigint) < _end")
    return rows.groupBy(*by).agg(*(F.max(F.when(here(index), F.col("_v"))).alias(name) for name, index in at.items()))


def counted(df: DataFrame, column: str, *by: str) -> DataFrame:
    """(by..., _v, _c, _end, n): distinct values, their counts, the sum of counts up to them in order, and all rows.

    Values are counted first (that combines before the shuffle). The counts are summed up in order inside RANGES
    ranges of values, whose bounds are approximate percentiles (one small row), and over the ranges' own
    sums; so no task sees all values of a hot group. Null is no value.
    """
    rows = df.select(*by, F.col(column).alias("_v")).where("_v is not null")
    found = rows.agg(F.percentile_approx("_v", [k / RANGES for k in range(1, RANGES)])).first()[0] or []
    bounds = F.lit([float(x) for x in sorted(set(found))]).cast("array<double>")
    rows = rows.groupBy(*by, "_v").agg(F.count("*").alias("_c"))
    rows = rows.withColumn("_r", F.size(F.filter(bounds, lambda x: x <= F.col("_v").cast("double"))))
    keys = [*by, "_r"]
    sums = rows.groupBy(*keys).agg(F.sum("_c").alias("_s"))
    group = Window.partitionBy(*(by or (F.lit(0),)))
    before = group.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    # RANGES rows at most of each group
    sums = sums.select(*(F.col(k).alias(f"{k}_") for k in keys), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_b"), F.sum("_s").over(group).alias("n"))
    rows = rows.join(sums, [rows[k].eqNullSafe(sums[f"{k}_"]) for k in keys])
    return rows.select(*by, "_v", "_c", (F.col("_b") + F.sum("_c").over(Window.partitionBy(*keys).orderBy("_v"))).alias("_end"), "n")


#: Index rules over n values: clamped floor(p n), floor(p (n - 1)), and those of the ratio probe.
def clamped(p: float) -> str:
    return f"least(n - 1, floor({p} * n))"


def lower(p: float) -> str:
    return f"floor({p} * (n - 1))"


PROBE = {"median": "floor(n / 2)", "p10": "floor(n * 10 / 100)", "p90": "least(n - 1, floor(n * 90 / 100))"}


def ratio_interval(df: DataFrame, part: str, whole: str) -> DataFrame:
    """Ratio of sums, deviation of the rows' ratios about it (population), and its 95 % interval, not below 0."""
    total = df.agg((F.sum(values.double(part)) / F.sum(values.double(whole))).alias("ratio"))
    r = values.double(part) / values.double(whole)
    out = df.agg(F.count("*").alias("n"), F.sum(r).alias("s1"), F.sum(r * r).alias("s2")).withColumn("ratio", total.scalar())
    spread = F.sqrt(F.greatest(F.lit(0.0), (F.col("s2") - 2 * F.col("ratio") * F.col("s1") + F.col("n") * F.col("ratio") * F.col("ratio")) / F.col("n")))
    half = 1.96 * F.col("spread") / F.sqrt(F.col("n"))
    return out.withColumn("spread", spread).select(
        "n", "ratio", "spread", F.greatest(F.lit(0.0), F.col("ratio") - half).alias("low"), (F.col("ratio") + half).alias("high")
    )


def variation(column: str) -> Column:
    """Sample deviation over mean; 0 with fewer than two values or a mean of 0."""
    v = values.double(column)
    return F.when((F.count(v) < 2) | (F.avg(v) == 0), F.lit(0.0)).otherwise(F.stddev_samp(v) / F.avg(v))


def neighbour_correlation(cells: DataFrame, axis: str) -> DataFrame:
    """(n, corr) of finite values and their next ones along an axis; 0 with fewer than three pairs or no variance.

    A window over each line of the axis: no self-join.
    """
    others = [a for a in "xyz" if a != axis]
    line = Window.partitionBy(*others).orderBy(axis)
    rows = cells.select(axis, *others, "v").withColumn("_next", F.lead("v").over(line)).withColumn("_at", F.lead(axis).over(line))
    rows = rows.where((F.col("_at") == F.col(axis) + 1) & values.is_finite("v") & values.is_finite("_next"))
    a, b = values.double("v"), values.double("_next")
    flat = (F.count("*") < 3) | (F.var_pop(a) == 0) | (F.var_pop(b) == 0)
    return rows.agg(F.count("*").alias("n"), F.when(flat, F.lit(0.0)).otherwise(F.corr(a, b)).alias("corr"))


def fractions(cells: DataFrame) -> DataFrame:
    """Shares of zero, near-zero and non-finite values. Near zero: |v| below max(1e-30, |v| at 1 % of n * 1e-3)."""
    size = cells.select(F.abs(values.double("v")).alias("a"), values.value_class("v").alias("c"))
    first = ranked(size.where("c not in ('nan', 'inf')"), "a", {"p1": "floor(0.01 * n)"}).select(F.greatest(F.lit(1e-30), F.coalesce("p1", F.lit(0.0)) * 1e-3).alias("t"))
    share = lambda c: F.avg(c.cast("double"))
    return size.withColumn("near", (F.col("a") < first.scalar()) & ~F.col("c").isin("nan", "inf")).agg(
        F.count("*").alias("n"), share(F.col("c") == "zero").alias("zero"), share(F.col("near")).alias("near_zero"),
        share(F.col("c").isin("nan", "inf")).alias("non_finite"),
    )


def overview(cells: DataFrame) -> DataFrame:
    """Number, zero share in percent, extremes, mean and deviation of all values."""
    v = values.double("v")
    return cells.agg(F.count("*").alias("n"), (100.0 * F.count_if(v == 0) / F.count("*")).alias("zero_percent"), F.min(v).alias("low"), F.max(v).alias("high"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("deviation"))


def trimmed_mean(df: DataFrame, column: str) -> DataFrame:
    """Mean without the n/10 least and n/10 greatest values, from counted values: no task sorts all rows."""
    kept = F.expr("least(_end, n - n div 10) - greatest(_end - _c, n div 10)")
    rows = counted(df, column).withColumn("_k", kept).where("_k > 0")
    return rows.agg((F.sum(F.col("_v") * F.col("_k")) / F.sum("_k")).alias("mean"))


def bootstrap_mean(sample: DataFrame, column: str, level: float = 0.95, rounds: int = 1000, seed: int = 42) -> DataFrame:
    """(low, high): interval of the mean from resampling; the sample is a planner's, and is broadcast if Spark finds it small.

    Draw k of all rounds takes the value whose place is the hash of k. An empty sample gives nulls.
    """
    number = F.row_number().over(Window.orderBy(column)) - 1
    values_at = sample.where(F.col(column).isNotNull()).select(number.cast("long").alias("place"), values.double(column).alias("v"))
    size = values_at.count()
    draws = sample.sparkSession.range(rounds * size).select(address.idiv("id", max(size, 1)).alias("round"), address.mod(address.mixed("id", seed), max(size, 1)).alias("place"))
    means = draws.join(values_at, "place").groupBy("round").agg(F.avg("v").alias("mean"))
    return ranked(means, "mean", {"low": f"floor({1 - level} * (n - 1))", "high": f"floor({level} * (n - 1))"})
