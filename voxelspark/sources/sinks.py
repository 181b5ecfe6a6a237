"""Sinks: slices as raw files, result tables as CSV, plans as JSON."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rawvol import open_store


def write_slices(batch: DataFrame, folder: str, prefix: str = "slice") -> DataFrame:
    """A batch (axis, type, seq, index, out_idx, v) as one raw file for each request, <prefix>_<axis>_<type>_<seq>.dat.

    Returns (path, cells). Requests are dealt out by hash and written in the order of out_idx; what a task
    holds is one piece of a slice.
    """
    rows = batch.select("axis", "type", "seq", "out_idx", "v").repartition("axis", "type", "seq").sortWithinPartitions("axis", "type", "seq", "out_idx")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        name, out, cells = None, None, 0
        done: list[tuple[str, int]] = []

        def close() -> None:
            if out is not None:
                out.close()
                store.move(f"{base}/.{name}", f"{base}/{name}")
                done.append((f"{folder}/{name}", cells))

        for b in batches:
            if not b.num_rows:
                continue
            store.create_dir(base, recursive=True)
            keys = list(zip(*(b.column(k).to_pylist() for k in range(3)), strict=True))
            start = 0
            for end in range(1, len(keys) + 1):
                if end < len(keys) and keys[end] == keys[start]:
                    continue
                axis, kind, seq = keys[start]
                own = f"{prefix}_{axis}_{kind}_{seq:03d}.dat"
                if own != name:
                    close()
                    name, cells = own, 0
                    out = store.open_output_stream(f"{base}/.{own}")
                out.write(b.column(4).slice(start, end - start).to_numpy().astype("<f4").tobytes())
                cells += end - start
                start = end
        close()
        if done:
            yield pa.RecordBatch.from_pydict({"path": [d[0] for d in done], "cells": pa.array([d[1] for d in done], pa.int64())})

    return rows.mapInArrow(write, "path string, cells long")


def write_metrics(metrics: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Rows of one wide table as metric,value lines in CSV with a header."""
    pairs = metrics.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("value")) for c in metrics.columns))).alias("m")).select("m.*")
    pairs.coalesce(1).write.mode(mode).csv(path, header=True)


def write_csv(table: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A result table; earlier results are not overwritten unless asked."""
    table.write.mode(mode).csv(path, header=True)


def as_json(table: DataFrame) -> DataFrame:
    """(json): each row as a JSON object."""
    return table.select(F.to_json(F.struct("*")).alias("json"))


def read_slices(spark, files: DataFrame) -> DataFrame:
    """(name, place, v) of slice files (path): the values of each, in order."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(batch.schema.get_field_index("path")).to_pylist():
                store, inner = open_store(path)
                with store.open_input_file(inner) as file:
                    at, size = 0, file.size()
                    while at < size:
                        data = np.frombuffer(file.read_at(min(4 << 20, size - at), at), "<f4")
                        place = np.arange(at // 4, at // 4 + len(data))
                        yield pa.RecordBatch.from_arrays([pa.array([inner.rsplit("/", 1)[1]] * len(data)), pa.array(place), pa.array(data)], names=["name", "place", "v"])
                        at += 4 * len(data)

    return files.select("path").mapInArrow(read, "name string, place long, v float")
