"""Comparison of an original with a reconstruction, cell by cell, under an error policy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import address
from ..functions.values import ErrorPolicy
from ..meta import VolumeMeta


def pointwise(pairs: DataFrame, policy: ErrorPolicy, ref: str = "ref", got: str = "got") -> DataFrame:
    """The rows with abs_err, rel_err and passed."""
    return pairs.withColumns({"abs_err": policy.absolute(ref, got), "rel_err": policy.relative(ref, got), "passed": policy.passes(ref, got)})


def paired(original: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """(x, y, z, ref, got): cells of both by coordinate; a cell that one side lacks has a null there."""
    left = original.select("x", "y", "z", F.col("v").alias("ref"), F.lit(True).alias("_a"))
    right = rebuilt.select("x", "y", "z", F.col("v").alias("got"), F.lit(True).alias("_b"))
    rows = left.join(right, ["x", "y", "z"], "full_outer")
    return rows.select("x", "y", "z", "ref", "got", (F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("both"))


def summary(pairs: DataFrame, policy: ErrorPolicy, *by: str) -> DataFrame:
    """valid_count, violation_count, max_abs, max_rel and passed of each group, or of all rows.

    A cell without its partner is a violation. Infinite errors do not count towards the maxima.
    """
    rows = pointwise(pairs, policy)
    bad = ~F.coalesce(F.col("passed"), F.lit(False)) if "both" not in pairs.columns else ~F.col("both") | ~F.coalesce(F.col("passed"), F.lit(False))
    top = lambda c: F.max(F.when(F.col(c) < float("inf"), F.col(c)))
    return rows.groupBy(*by).agg(
        F.count("*").alias("valid_count"), F.count_if(bad).alias("violation_count"), F.coalesce(top("abs_err"), F.lit(0.0)).alias("max_abs"),
        F.coalesce(top("rel_err"), F.lit(0.0)).alias("max_rel"), (F.count_if(bad) == 0).alias("passed"),
    )


def by_leaf(meta: VolumeMeta, pairs: DataFrame, policy: ErrorPolicy) -> DataFrame:
    """The summary of each leaf."""
    rows = pairs.withColumns({"sb_id": address.block_id(meta), "morton": address.leaf_morton(meta)})
    return summary(rows, policy, "sb_id", "morton")


def sampled(pairs: DataFrame, meta: VolumeMeta, one_in: int, seed: int = 7) -> DataFrame:
    """About one cell in ``one_in``, chosen by a hash of its number, so that both sides choose alike."""
    cell = address.linear(meta)
    return pairs.where(F.pmod(cell * 2654435761 + seed, F.lit(1 << 20)) < (1 << 20) // one_in)


def same(a: DataFrame, b: DataFrame) -> bool:
    """Have two results the same rows, repeats counted?"""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
