"""Volumes made from tables: dense cubes of embeddings and of events, whose last X plane holds what rows are left."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import address
from ..meta import VolumeMeta, ceil_div
from ..operators.volume import Volume

BLOCK, LEAF = (8, 8, 8), (4, 4, 4)
EMBED_Y, EMBED_Z = 25, 64
EVENT_Y, EVENT_Z = 20, 25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cube_embed(spark: SparkSession, sf_dir: str) -> Volume:
    """Embeddings as traces: 25 vectors make an X plane, their 64 elements are Z."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    traces = rows.select(address.idiv("vec_id", EMBED_Y).alias("x"), address.mod("vec_id", EMBED_Y).alias("y"), F.col("embedding").alias("values"))
    n = rows.count()  # from the files' footers
    return Volume(VolumeMeta(ceil_div(n, EMBED_Y), EMBED_Y, EMBED_Z, BLOCK, LEAF, n * EMBED_Z), traces=traces)


def cube_events(spark: SparkSession, sf_dir: str) -> Volume:
    """Events as voxels, 20 by 25 to an X plane; an axis of 25 leaves a leaf of one."""
    rows = table(spark, sf_dir, "events").select("event_id", "value")
    n = rows.count()
    meta = VolumeMeta(ceil_div(n, EVENT_Y * EVENT_Z), EVENT_Y, EVENT_Z, BLOCK, LEAF, n)
    x, y, z = address.delinear(meta, "event_id")
    return Volume(meta, voxels=rows.select(x.alias("x"), y.alias("y"), z.alias("z"), F.col("value").cast("float").alias("v")))
