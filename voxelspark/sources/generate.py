"""Synthetic volumes: uniform noise, a compressible pattern, smooth waves, analytic fixtures."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..functions import address
from ..meta import VolumeMeta
from ..operators.volume import Volume


def formula(spark: SparkSession, meta: VolumeMeta, value: Column) -> Volume:
    """A volume of a function of x, y, z."""
    x, y, z = address.delinear(meta, "id")
    rows = spark.range(meta.cells).select(x.alias("x"), y.alias("y"), z.alias("z"))
    return Volume(meta, voxels=rows.select("x", "y", "z", value.cast("float").alias("v")))


def uniform(spark: SparkSession, meta: VolumeMeta, seed: int = 42, low: float = 0.0, high: float = 1.0) -> Volume:
    """Noise that depends on seed and cell alone, so it does not change with the partitions."""
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), address.linear(meta)), 11).cast("double") / float(1 << 53)
    return formula(spark, meta, draw * (high - low) + low)


def smooth(spark: SparkSession, meta: VolumeMeta) -> Volume:
    return formula(spark, meta, F.sin(0.1 * F.col("x")) * F.cos(0.05 * F.col("y")) * F.sin(0.07 * F.col("z")))


def decimal(spark: SparkSession, meta: VolumeMeta, x: float = 10_000, y: float = 100, z: float = 1) -> Volume:
    """Values that tell their coordinates."""
    return formula(spark, meta, F.col("x") * float(x) + F.col("y") * float(y) + F.col("z") * float(z))


def blocky(spark: SparkSession, meta: VolumeMeta, seed: int = 42) -> Volume:
    """Few values in blocks of 8 x 8 x 32 cells, some blocks zero: compresses well.

    Fixed values: block sizes, factors 13, 7, 3 and 1, 3, 5, modulus 97, 1024 codes of 1/32.
    """
    bx, by, bz = address.idiv("x", 8), address.idiv("y", 8), address.idiv("z", 32)
    code = (bx * 13 + by * 7 + bz * 3 + seed).bitwiseAND(F.lit(1023))
    empty = F.pmod(bx + by * 3 + bz * 5 + seed, F.lit(97)) == 0
    return formula(spark, meta, F.when(empty, F.lit(0.0)).otherwise(code / F.lit(32.0)))
