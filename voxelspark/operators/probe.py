"""Probes: how well samples of a volume compress, as whole superblocks and as planes of small blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import address
from ..meta import AXES, PLANE, VolumeMeta, ceil_div
from . import codec
from .volume import Volume

#: Compressed superblocks must save 5 % at least, else they count as raw. Depths of X at which planes are probed, in percent.
KEEP_BELOW, DEPTHS = 0.95, (0, 10, 25, 50, 75, 90, 100)


def slab_starts(meta: VolumeMeta, slabs: int) -> list[int]:
    """Superblock layers of X to be sampled, spread evenly."""
    layers = meta.grid[0]
    return sorted({min(layers - 1, k * layers // max(1, slabs)) for k in range(slabs)})


def probe_depths(meta: VolumeMeta) -> list[int]:
    """X planes at fixed shares of the depth."""
    return sorted({(meta.nx - 1) * d // 100 for d in DEPTHS})


def block_ratios(volume: Volume, slabs: int = 4, compression: str = "lz4_raw") -> DataFrame:
    """(sb_id, raw, packed, compressed): sizes of sampled superblocks, zero-padded at the edges, cells in place order.

    Rows come sorted by superblock, so a task holds one superblock at a time.
    """
    meta = volume.meta
    sx, sy, sz = meta.super_block
    cells = sx * sy * sz
    place = (address.mod("z", sz) * sy + address.mod("y", sy)) * sx + address.mod("x", sx)
    layer = address.block(meta, "x")
    rows = volume.cells().where(layer.isin(slab_starts(meta, slabs))).select(address.block_id(meta).alias("sb_id"), place.alias("cell"), "v")
    rows = rows.repartition("sb_id").sortWithinPartitions("sb_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, data, out = None, np.zeros(cells, "<f4"), []

        def close() -> None:
            raw = data.tobytes()
            size = len(pa.compress(raw, compression, asbytes=True))
            good = size < KEEP_BELOW * len(raw)
            out.append((current, len(raw), size if good else len(raw), good))

        for batch in batches:
            ids, at, v = (batch.column(k).to_numpy() for k in range(3))
            for sb in np.unique(ids).tolist():
                if sb != current:
                    if current is not None:
                        close()
                    current = sb
                    data[:] = 0
                data[at[ids == sb]] = v[ids == sb]
        if current is not None:
            close()
        if out:
            sb, raw, size, good = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(sb, pa.int64()), pa.array(raw, pa.int64()), pa.array(size, pa.int64()), pa.array(good)], names=["sb_id", "raw", "packed", "compressed"])

    return rows.mapInArrow(run, "sb_id long, raw long, packed long, compressed boolean")


def plane_leaves(volume: Volume, axis: str, index: int, side: int = 4) -> DataFrame:
    """A slice as square blocks (sb_id, morton, values, mask): block number, 0, values and mask as leaves have them."""
    a, b = PLANE[axis]
    wide = ceil_div(volume.meta.size(b), side)
    rows = volume.slice(axis, index)
    rows = rows.select((address.idiv(a, side) * wide + address.idiv(b, side)).alias("sb_id"), (address.mod(a, side) * side + address.mod(b, side)).cast("int").alias("cell"), "v")
    by = rows.groupBy("sb_id").agg(
        F.map_from_entries(F.collect_list(F.struct("cell", "v"))).alias("at"), F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("cell"))).alias("mask")
    )
    filled = F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda c: F.coalesce(F.element_at("at", c), F.lit(0.0).cast("float")))
    return by.select("sb_id", F.lit(0).cast("long").alias("morton"), filled.alias("values"), "mask")


def plane_probe(volume: Volume, axis: str = "x", side: int = 4) -> DataFrame:
    """(index, codec, blocks, bytes) of the probed planes of an axis."""
    size = volume.meta.size(axis)
    out = None
    for index in sorted({(size - 1) * d // 100 for d in DEPTHS}):
        one = codec.encode(plane_leaves(volume, axis, index, side)).groupBy("codec").agg(F.count("*").alias("blocks"), F.sum("size").alias("bytes"))
        one = one.select(F.lit(index).alias("index"), "codec", "blocks", "bytes")
        out = one if out is None else out.unionByName(one)
    return out


def leaf_probe(volume: Volume, wanted: int = 20_000, seed: int = 5) -> DataFrame:
    """About ``wanted`` leaves, chosen by a hash of their place so that every run chooses alike, and encoded."""
    from . import leaves

    gx, gy, gz = volume.meta.leaf_grid
    share = min(1.0, wanted / (gx * gy * gz))
    place = F.xxhash64(F.lit(seed), *(address.leaf(volume.meta, a) for a in AXES))
    cells = volume.cells() if share == 1.0 else volume.cells().where(F.pmod(place, F.lit(1_000_000)) < int(share * 1_000_000))
    return codec.encode(leaves.pack(volume.meta, cells))
