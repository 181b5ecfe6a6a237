"""The chunk form of a volume: one row per leaf, and what planners want to know of leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import address, values
from ..meta import AXES, VolumeMeta


def pack(meta: VolumeMeta, cells: DataFrame) -> DataFrame:
    """(sb_id, morton, values, mask): leaves with values in place order, X fastest; cells outside the volume are zero.

    Bit i of the mask says that place i lies in the volume. Leaves of up to 64 cells.
    """
    n = meta.leaf[0] * meta.leaf[1] * meta.leaf[2]
    if n > 64:
        raise ValueError("a mask has 64 bits")
    rows = cells.select(address.block_id(meta).alias("sb_id"), address.leaf_morton(meta).alias("morton"), address.cell_in_leaf(meta).cast("int").alias("cell"), "v")
    # the place carries its value, so the order of collection does not matter
    by = rows.groupBy("sb_id", "morton").agg(
        F.map_from_entries(F.collect_list(F.struct("cell", "v"))).alias("at"), F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("cell"))).alias("mask")
    )
    filled = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda c: F.coalesce(F.element_at("at", c), F.lit(0.0).cast("float")))
    return by.select("sb_id", "morton", filled.alias("values"), "mask")


def unpack(meta: VolumeMeta, leaves: DataFrame, order: str = "zyx") -> DataFrame:
    """(x, y, z, v) of the leaves' cells that lie in the volume."""
    rows = leaves.select("sb_id", "morton", "mask", F.posexplode("values").alias("cell", "v"))
    rows = rows.where(F.expr("(shiftrightunsigned(mask, cell) & 1) = 1"))
    block, inner = address.block_coords(meta, "sb_id", order), address.unmorton("morton")
    fx, fy, _ = meta.leaf
    place = {"x": address.mod("cell", fx), "y": address.mod(address.idiv("cell", fx), fy), "z": address.idiv("cell", fx * fy)}
    coords = [
        (block[a] * meta.super_block[k] + inner[k] * meta.leaf[k] + place[a]).alias(a) for k, a in enumerate(AXES)
    ]
    return rows.select(*coords, "v")


def stats(meta: VolumeMeta, cells: DataFrame) -> DataFrame:
    """One row per leaf: number of cells, zeros, constant or not, extremes, tolerance exponent.

    The tolerance follows the least magnitude among normal values; a leaf without any has none.
    """
    v, normal = values.double("v"), values.value_class("v") == "normal"
    rows = cells.select(address.block_id(meta).alias("sb_id"), address.leaf_morton(meta).alias("morton"), "v")
    out = rows.groupBy("sb_id", "morton").agg(
        F.count("*").alias("cells"), F.count_if(v == 0).alias("zeros"), F.count_if(~normal & (v != 0)).alias("specials"),
        F.min(v).alias("low"), F.max(v).alias("high"), F.min(F.when(normal, F.abs(v))).alias("least"),
    )
    kind = (
        F.when(F.col("zeros") == F.col("cells"), "zero").when(F.col("specials") > 0, "special")
        .when(F.col("low") == F.col("high"), "constant").otherwise("mixed")
    )
    return out.withColumn("kind", kind).withColumn("exponent", values.tolerance_exponent("least"))


def edge_cells(spark, meta: VolumeMeta) -> DataFrame:
    """(lx, ly, lz, cells): leaves and how many of their cells lie in the volume, from the shape alone."""
    gx, gy, gz = meta.leaf_grid
    rows = spark.range(gx * gy * gz).select(
        address.mod("id", gx).alias("lx"), address.mod(address.idiv("id", gx), gy).alias("ly"), address.idiv("id", gx * gy).alias("lz")
    )
    inside = [address.valid_extent(meta, a, f"l{a}") for a in AXES]
    return rows.select("lx", "ly", "lz", (inside[0] * inside[1] * inside[2]).alias("cells"))


def tasks(meta: VolumeMeta, requests: DataFrame, spark) -> DataFrame:
    """(lx, ly, lz, targets): leaves that a batch of slices needs, each once, with how many requests want it.

    From the shape and the requests alone: each request touches one layer of leaves of its axis.
    """
    gx, gy, gz = meta.leaf_grid
    grid = spark.range(gx * gy * gz).select(
        address.mod("id", gx).alias("lx"), address.mod(address.idiv("id", gx), gy).alias("ly"), address.idiv("id", gx * gy).alias("lz")
    )
    layers = requests.select("axis", address.idiv("index", meta.leaf[0]).alias("layer")) if len(set(meta.leaf)) == 1 else None
    if layers is None:
        raise ValueError("leaves must be cubes")
    wanted = layers.groupBy("axis", "layer").agg(F.count("*").alias("n"))
    for a in AXES:
        mine = wanted.where(F.col("axis") == a).select(F.col("layer").alias(f"l{a}"), F.col("n").alias(f"n{a}"))
        grid = grid.join(mine, f"l{a}", "left")
    total = sum((F.coalesce(f"n{a}", F.lit(0)) for a in AXES), F.lit(0).cast("long"))
    return grid.select("lx", "ly", "lz", total.alias("targets")).where("targets > 0")


def record_offsets(records: DataFrame) -> DataFrame:
    """Records (sb_id, morton, size) with their offset inside the superblock: sizes before them in Morton order."""
    before = Window.partitionBy("sb_id").orderBy("morton").rowsBetween(Window.unboundedPreceding, -1)
    return records.withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0)).cast("long"))
