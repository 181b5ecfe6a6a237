"""The three jobs in one call each: convert, benchmark, verify."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.values import ErrorPolicy
from .meta import AXES, VolumeMeta
from .operators import probe, scores, stats, verify
from .operators.replicas import Replica
from .operators.replicas import batch as replica_batch
from .operators.volume import Volume, read_volume
from .plans import formats
from .sources.rawvol import read_raw, restore

Reader = Callable[[DataFrame], DataFrame]


def convert(spark: SparkSession, raw: str, meta: VolumeMeta, out: str, replicas: tuple[str, ...] = (), mode: str = "errorifexists") -> Volume:
    """Ingest a raw file into a clustered table, with a copy clustered for each axis asked for.

    Every copy goes to its own folder; the base one is written last, so a table is whole where it is.
    """
    if raw.rstrip("/") == out.rstrip("/"):
        raise ValueError("input and output are the same")
    volume = read_raw(spark, raw, meta)
    for axis in replicas:
        volume.write(f"{out}/by_{axis}", by=axis, mode=mode)
    volume.write(f"{out}/base", mode=mode)
    return read_volume(spark, f"{out}/base", meta)


def open_converted(spark: SparkSession, out: str, meta: VolumeMeta, replicas: tuple[str, ...] = ()) -> tuple[Volume, list[Replica]]:
    """A converted volume and its copies."""
    return read_volume(spark, f"{out}/base", meta), [Replica(a, read_volume(spark, f"{out}/by_{a}", meta)) for a in replicas]


def reader(volume: Volume, replicas: list[Replica] | None = None) -> Reader:
    """The function from requests to cells: the plug-in point of ``benchmark``."""
    return (lambda r: replica_batch(volume, replicas, r)) if replicas else volume.batch


def benchmark(requests: DataFrame, read: Reader, stored_bytes: int, raw_bytes: int, repeats: int = 1, sink: str = "noop") -> DataFrame:
    """One row: seconds of the six groups, composite time, storage ratio and score.

    Each group is a job of its own; of several repeats the quickest counts.
    """
    spark, rows = requests.sparkSession, []
    for kind in ("random", "continuous"):
        for axis in AXES:
            mine = requests.where((F.col("axis") == axis) & (F.col("type") == kind))
            if mine.isEmpty():
                continue
            for k in range(repeats):
                began = time.perf_counter()
                read(mine).write.format(sink).mode("overwrite").save()
                rows.append((axis, kind, k, time.perf_counter() - began))
    runs = spark.createDataFrame(rows, "axis string, type string, iteration int, seconds double")
    ratio = F.lit(stored_bytes / raw_bytes)
    return scores.composite(scores.best_of(runs)).withColumns({"storage_ratio": ratio, "storage_score": scores.storage_score(ratio)})


def check(original: Volume, rebuilt: Volume, policy: ErrorPolicy | None = None) -> DataFrame:
    """One row: how the rebuilt volume compares with the original."""
    return verify.summary(verify.paired(original.cells(), rebuilt.cells()), policy or ErrorPolicy())


def plan(volume: Volume, budget: float = 1.5, threads: int = 8, leaves_wanted: int = 20_000) -> list[formats.Candidate]:
    """Format candidates, the recommended first, from samples of superblocks and of leaves."""
    block = stats.ratio_interval(probe.block_ratios(volume), "packed", "raw").first()
    cells = volume.meta.leaf[0] * volume.meta.leaf[1] * volume.meta.leaf[2]
    sizes = probe.leaf_probe(volume, leaves_wanted).select("size", F.lit(cells * 4).alias("raw"))
    leaf = stats.ratio_interval(sizes, "size", "raw").first()
    return formats.plan_format(*volume.meta.dims, block.ratio, block.high, leaf.ratio, leaf.high, threads, budget)


__all__ = ["benchmark", "check", "convert", "open_converted", "plan", "reader", "restore"]
