"""Raw volumes: headerless little-endian float32, Z fastest, read and written through Spark data source ``rawvol``.

Reading gives one partition for each run of X planes, as traces (x, y, values). Bounds on x and y, given as options,
leave out planes and the traces in them before anything is read; ``RawVolume`` gives them for each query. They are not
taken from pushed filters: Spark keeps a reader with the filters of one query for the next one that has none. Writing makes one file for each partition's run of cells;
``restore`` makes one file, whose tasks write at their places where the file system can do that.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import address
from ..meta import BYTES, VolumeMeta, ceil_div
from ..operators.volume import Volume

#: Bytes of a reading task, of a piece held in memory.
SLAB_BYTES, PIECE_BYTES = 64 << 20, 8 << 20
MAGIC_BYTES = 8
SCHEMA = "x long, y long, values array<float>"


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path and the path inside it; a path without a scheme is local."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = f"file://{path[5:]}"
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def check_size(path: str, meta: VolumeMeta) -> None:
    """A raw file has exactly the bytes of its shape, or of the cells that it holds."""
    store, inner = open_store(path)
    size = store.get_file_info(inner).size
    if size != meta.bytes:
        raise ValueError(f"{path} has {size} bytes; {meta.dims} with {meta.cells} cells needs {meta.bytes}")


@dataclass
class Planes(InputPartition):
    first: int
    count: int


class RawVolumeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.meta = VolumeMeta(*(int(options[k]) for k in ("nx", "ny", "nz")), held=int(options["held"]) if "held" in options else None)
        self.slab = int(options.get("slab_bytes", SLAB_BYTES))
        #: bounds of x and y, both ends included
        bound = lambda name, otherwise: int(options.get(name, otherwise))
        self.low = [max(0, bound("x_low", 0)), max(0, bound("y_low", 0))]
        self.high = [min(self.meta.nx - 1, bound("x_high", self.meta.nx)), min(self.meta.ny - 1, bound("y_high", self.meta.ny))]

    def partitions(self) -> list[InputPartition]:
        check_size(self.path, self.meta)
        step = max(1, self.slab // max(1, (self.high[1] + 1 - self.low[1]) * self.meta.nz * BYTES))
        return [Planes(x, min(step, self.high[0] + 1 - x)) for x in range(self.low[0], self.high[0] + 1, step)] or [Planes(0, 0)]

    def read(self, partition: Planes) -> Iterator[pa.RecordBatch]:
        store, inner = open_store(self.path)
        ny, nz = self.meta.ny, self.meta.nz
        rows = max(1, PIECE_BYTES // (nz * BYTES))
        first, last = self.low[1], self.high[1] + 1
        cells = self.meta.cells  # where they end early, so do the last plane's traces
        # whole planes are one run of traces, parts of planes a run each
        runs = [(partition.first, partition.first + partition.count)] if (first, last) == (0, ny) else [(x, x + 1) for x in range(partition.first, partition.first + partition.count)]
        with store.open_input_file(inner) as file:
            for x, past in runs:
                at, end = x * ny + first, min((past - 1) * ny + last, ceil_div(cells, nz))
                while at < end:
                    n = min(rows, end - at)
                    held = min(n * nz, cells - at * nz)
                    data = np.frombuffer(file.read_at(held * BYTES, at * nz * BYTES), "<f4")
                    if len(data) != held:
                        raise ValueError(f"{self.path} ends early")
                    trace = np.arange(at, at + n)
                    bounds = np.arange(n + 1, dtype=np.int32) * nz
                    bounds[n] = held
                    values = pa.ListArray.from_arrays(pa.array(bounds), pa.array(data))
                    yield pa.RecordBatch.from_arrays([pa.array(trace // ny), pa.array(trace % ny), values], names=["x", "y", "values"])
                    at += n


class RawVolumeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rawvol"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RawVolumeReader:
        return RawVolumeReader(dict(self.options))


@dataclass(frozen=True)
class RawVolume(Volume):
    """A volume of a raw file, whose queries read the planes and traces within their bounds only."""

    path: str = ""
    slab_bytes: int = SLAB_BYTES
    limits: tuple[tuple[str, int], ...] = ()

    def bounded(self, axis: str, low: int, high: int) -> Volume:
        if axis == "z":  # a trace is read as a whole
            return self
        limits = dict(self.limits)
        limits[f"{axis}_low"] = max(low, limits.get(f"{axis}_low", low))
        limits[f"{axis}_high"] = min(high, limits.get(f"{axis}_high", high))
        return _load(self.traces.sparkSession, self.path, self.meta, self.slab_bytes, limits)


def _load(spark: SparkSession, path: str, meta: VolumeMeta, slab_bytes: int, limits: dict[str, int]) -> RawVolume:
    reader = spark.read.format("rawvol").option("nx", meta.nx).option("ny", meta.ny).option("nz", meta.nz).option("slab_bytes", slab_bytes)
    if meta.held is not None:
        reader = reader.option("held", meta.held)
    return RawVolume(meta, traces=reader.options(**limits).load(path), path=path, slab_bytes=slab_bytes, limits=tuple(limits.items()))


def read_raw(spark: SparkSession, path: str, meta: VolumeMeta, slab_bytes: int = SLAB_BYTES) -> RawVolume:
    """A volume of a raw file."""
    spark.dataSource.register(RawVolumeSource)
    return _load(spark, path, meta, slab_bytes, {})


def write_raw(volume: Volume, folder: str, files: int = 8) -> list[str]:
    """Write the cells as raw pieces, in the order of their numbers; returns the pieces, first cells first.

    A piece is written under another name and moved when whole. Every cell must be there once: a gap or a
    repeat is an error. A volume that ends inside its last plane says so in its shape (``held``); its pieces end there.
    """
    meta = volume.meta
    step = -(-meta.cells // files)
    rows = volume.cells().select(address.linear(meta).alias("idx"), "v").withColumn("piece", address.idiv("idx", step))
    rows = rows.repartitionByRange(files, "idx").sortWithinPartitions("idx")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, base = open_store(folder)
        first, expected, out, own = None, None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            idx = batch.column(0).to_numpy()
            if first is None:
                first = expected = int(idx[0])
                store.create_dir(base, recursive=True)
                own = f"{base}/.{TaskContext.get().taskAttemptId()}-{first}"
                out = store.open_output_stream(own)
            if not np.array_equal(idx, np.arange(expected, expected + len(idx))):
                raise ValueError(f"cells are missing or repeated near {expected}")
            out.write(batch.column(1).to_numpy().astype("<f4").tobytes())
            expected += len(idx)
        if out is not None:
            out.close()
            last = f"{base}/{first:020d}.raw"
            store.move(own, last)
            yield pa.RecordBatch.from_pydict({"first": pa.array([first]), "cells": pa.array([expected - first]), "path": [f"{folder}/{first:020d}.raw"]})

    # put in order here: an orderBy would run the writing tasks a second time, for its sample of keys
    pieces = sorted(rows.select("idx", "v").mapInArrow(write, "first long, cells long, path string").collect())
    if sum(p.cells for p in pieces) != meta.cells or pieces[0].first or any(a.first + a.cells != b.first for a, b in zip(pieces, pieces[1:], strict=False)):
        raise ValueError("the pieces do not make the whole volume")
    return [p.path for p in pieces]


def restore(volume: Volume, path: str, files: int = 8, overwrite: bool = False) -> None:
    """Write a volume as one raw file; an existing file is kept unless asked, and none is left half written.

    On a mounted file system the pieces are put into the file at their places by as many tasks, so nothing passes
    through the driver; elsewhere, where a file has one writer, the driver joins them.
    """
    store, inner = open_store(path)
    if not overwrite and store.get_file_info(inner).type != fs.FileType.NotFound:
        raise FileExistsError(path)
    pieces = write_raw(volume, f"{path}.pieces", files)
    try:
        if isinstance(store, fs.LocalFileSystem):
            _join_at_places(volume, pieces, inner)
        else:
            with store.open_output_stream(f"{inner}.part") as out:
                for p in pieces:
                    with open_store(p)[0].open_input_stream(open_store(p)[1]) as piece:
                        while data := piece.read(PIECE_BYTES):
                            out.write(data)
        store.move(f"{inner}.part", inner)
    finally:
        store.delete_dir(open_store(f"{path}.pieces")[1])


def _join_at_places(volume: Volume, pieces: list[str], inner: str) -> None:
    """Copy each piece to its place in one file; a task that runs again writes the same bytes."""
    spark = (volume.voxels if volume.traces is None else volume.traces).sparkSession
    with open(f"{inner}.part", "wb") as out:
        out.truncate(volume.meta.bytes)

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                own = open_store(path)[1]
                with open(own, "rb") as piece, open(f"{inner}.part", "r+b") as out:
                    out.seek(int(own.rsplit("/", 1)[1].split(".")[0]) * BYTES)
                    while data := piece.read(PIECE_BYTES):
                        out.write(data)
            yield batch

    spark.createDataFrame([(p,) for p in pieces], "path string").repartition(len(pieces)).mapInArrow(copy, "path string").write.format("noop").mode("overwrite").save()


def detect(spark: SparkSession, path: str, known: dict[bytes, str]) -> DataFrame:
    """(path, format) of files by their first bytes; what is not known is ``unknown``. Files are listed, then MAGIC_BYTES of each read."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for p in batch.column(0).to_pylist():
                store, inner = open_store(p)
                with store.open_input_file(inner) as file:
                    head = file.read(MAGIC_BYTES)
                found.append(next((name for magic, name in known.items() if head.startswith(magic)), "unknown"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["path", "format"])

    # only names are listed: a file's content is not a row, which could not hold over 2 GB
    return spark.read.format("binaryFile").load(path).select("path").mapInArrow(look, "path string, format string")


def sizes(spark: SparkSession, path: str, meta: VolumeMeta) -> DataFrame:
    """(path, bytes, whole): does each raw file have the bytes of its shape, or of the cells that it holds?"""
    rows = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"))
    return rows.withColumn("whole", F.col("bytes") == meta.bytes)
