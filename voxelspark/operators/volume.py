"""Slices, lines, ranges, points and batches of a dense volume.

A volume is kept as voxels (x, y, z, v) or as traces (x, y, values), a trace being the run of Z values of a
raw file. Predicates go to the stored form, so a slice of X or Y reads the matching traces only, and a slice
of Z takes one element of each. A stored table carries leaf columns; their predicates prune its files.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import address
from ..meta import AXES, PLANE, VolumeMeta

#: Requests of a batch that are broadcast at most; more are joined by shuffle.
BROADCAST_REQUESTS = 100_000


@dataclass(frozen=True)
class Volume:
    """A dense volume: its shape and one of its two forms."""

    meta: VolumeMeta
    voxels: DataFrame | None = None
    traces: DataFrame | None = None

    def cells(self, *where: Column) -> DataFrame:
        """(x, y, z, v) of the cells that meet the predicates on x and y (and z, for voxels)."""
        if self.traces is None:
            df = self.voxels
            for w in where:
                df = df.where(w)
            return df.select("x", "y", "z", "v")
        df = self.traces
        for w in where:
            df = df.where(w)
        return df.select("x", "y", F.posexplode("values").alias("z", "v")).select("x", "y", F.col("z").cast("long").alias("z"), "v")

    def bounded(self, axis: str, low: int, high: int) -> Volume:
        """The volume for a query that needs an axis from ``low`` to ``high`` only; a source that can read less does.

        Whoever asks still filters: here nothing changes.
        """
        return self

    def _reaching(self, z: int) -> DataFrame:
        """The traces that have an element of z; only where a volume ends early its last trace can be short."""
        return self.traces if self.meta.cells % self.meta.nz == 0 else self.traces.where(F.size("values") > z)

    def _at(self, axis: str, index: int) -> DataFrame:
        """Cells with a coordinate fixed."""
        index = self.meta.check_index(axis, index)
        self = self.bounded(axis, index, index)
        if axis == "z" and self.traces is not None:
            return self._reaching(index).select("x", "y", F.lit(index).cast("long").alias("z"), F.element_at("values", index + 1).alias("v"))
        pruned = [F.col(f"{axis}_leaf") == index // self.meta.leaf[AXES.index(axis)]] if f"{axis}_leaf" in self._stored() else []
        return self.cells(*pruned, F.col(axis) == index)

    def _stored(self) -> list[str]:
        return (self.voxels if self.traces is None else self.traces).columns

    def slice(self, axis: str, index: int) -> DataFrame:
        """(a, b, v, out_idx) of a slice under its own coordinate names."""
        return self._at(axis, index).select(*PLANE[axis], "v", address.out_index(self.meta, axis).alias("out_idx"))

    def slice_range(self, axis: str, start: int, count: int) -> DataFrame:
        """Consecutive slices, all cells."""
        self.meta.check_index(axis, start)
        self.meta.check_index(axis, start + count - 1)
        if axis == "z" and self.traces is not None:
            part = F.slice("values", start + 1, count)
            return self.traces.select("x", "y", F.posexplode(part).alias("k", "v")).select("x", "y", (F.col("k") + start).cast("long").alias("z"), "v")
        self = self.bounded(axis, start, start + count - 1)
        f, pruned = self.meta.leaf[AXES.index(axis)], []
        if f"{axis}_leaf" in self._stored():
            pruned = [F.col(f"{axis}_leaf").between(start // f, (start + count - 1) // f)]
        return self.cells(*pruned, F.col(axis).between(start, start + count - 1))

    def line(self, axis: str, first: int, second: int) -> DataFrame:
        """(i, v) along an axis; the fixed coordinates are those of PLANE, in its order."""
        a, b = PLANE[axis]
        first, second = self.meta.check_index(a, first), self.meta.check_index(b, second)
        self = self.bounded(a, first, first).bounded(b, second, second)
        if self.traces is not None and b == "z":
            rows = self._reaching(second).where(F.col(a) == first).select(F.col(axis).alias("i"), F.element_at("values", second + 1).alias("v"))
            return rows.select(F.col("i").cast("long").alias("i"), "v")
        pruned = [F.col(f"{c}_leaf") == i // self.meta.leaf[AXES.index(c)] for c, i in ((a, first), (b, second)) if f"{c}_leaf" in self._stored()]
        return self.cells(*pruned, F.col(a) == first, F.col(b) == second).select(F.col(axis).cast("long").alias("i"), "v")

    def full(self) -> DataFrame:
        """(idx, v) of every cell, idx as in a raw file."""
        return self.cells().select(address.linear(self.meta).alias("idx"), "v")

    def points(self, samples: DataFrame) -> DataFrame:
        """Values at sampled coordinates (x, y, z); a coordinate outside has none."""
        return samples.join(self.cells(), ["x", "y", "z"], "left")

    def batch(self, requests: DataFrame) -> DataFrame:
        """(axis, type, seq, index, out_idx, v) of many slices: requests (axis, type, seq, index), repeats fan out.

        One equi-join for each axis, never an either-or join over all three. An index outside the volume
        is an error. One job looks at the requests first: whether they are few enough to broadcast, and
        which axes and indices they name; axes without requests are not read.
        """
        known = requests.select("axis", "index").limit(BROADCAST_REQUESTS + 1).collect()
        few = len(known) <= BROADCAST_REQUESTS
        parts = []
        for axis in AXES:
            named = [r["index"] for r in known if r["axis"] == axis]
            if few and not named and (parts or axis != AXES[-1]):
                continue
            wanted = sorted({k for k in named if k is not None}) if few else None
            mine = requests.where(F.col("axis") == axis)
            checked = F.when(address.inside(self.meta), F.col("index")).otherwise(F.raise_error(F.lit(f"{axis} index outside the volume")).cast("long"))
            mine = mine.select("axis", "type", "seq", checked.alias("index"))
            rows = self._wanted(axis, F.broadcast(mine) if few else mine, wanted)
            parts.append(rows.select("axis", "type", "seq", "index", address.out_index(self.meta, axis).alias("out_idx"), "v"))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _wanted(self, axis: str, side: DataFrame, wanted: list[int] | None) -> DataFrame:
        """Cells of an axis's requests with the request's columns; x, y, z, v stay.

        Traces of X and Y requests are joined before they are unfolded; a Z request takes its elements from
        each trace. From a stored table only the wanted leaves are read. ``wanted``: the distinct indices of
        few requests.
        """
        if wanted:
            self = self.bounded(axis, min(wanted), max(wanted))
        if self.traces is not None and axis != "z":
            rows = self.traces.join(side, self.traces[axis] == side["index"])
            return rows.select("*", F.posexplode("values").alias("_z", "v")).withColumn("z", F.col("_z").cast("long"))
        if wanted is None:
            cells = self.cells()
            return cells.join(side, cells[axis] == side["index"])
        if self.traces is not None:
            inside = [k for k in wanted if 0 <= k < self.meta.nz] or [0]
            asked = F.lit(inside).cast("array<int>")
            if self.meta.cells % self.meta.nz:
                asked = F.filter(asked, lambda k: k < F.size("values"))
            picked = F.transform(asked, lambda k: F.struct(k.cast("long").alias("z"), F.element_at("values", k + 1).alias("v")))
            cells = self.traces.select("x", "y", F.explode(picked).alias("c")).select("x", "y", "c.z", "c.v")
        else:
            leaves = sorted({k // self.meta.leaf[AXES.index(axis)] for k in wanted})
            cells = self.cells(*([F.col(f"{axis}_leaf").isin(leaves)] if f"{axis}_leaf" in self._stored() and leaves else []))
        return cells.join(side, cells[axis] == side["index"])

    def sampled_planes(self, planes: list[int], ranges: list[tuple[int, int]] | None = None) -> DataFrame:
        """Cells of some X planes, of some Z ranges [from, to) of them; without ranges the whole planes."""
        for x in planes:
            self.meta.check_index("x", x)
        for low, high in ranges or []:
            if not 0 <= low < high <= self.meta.nz:
                raise IndexError(f"z range [{low}, {high}) is not inside the volume")
        rows = (self.bounded("x", min(planes), max(planes)) if planes else self).cells(F.col("x").isin(planes))
        if not ranges:
            return rows
        inside = F.lit(False)
        for low, high in ranges:
            inside = inside | F.col("z").between(low, high - 1)
        return rows.where(inside)

    def cached(self) -> Volume:
        """The volume with its rows kept in memory, spilling to disk: for many batches over one region."""
        from pyspark import StorageLevel

        keep = lambda df: None if df is None else df.persist(StorageLevel.MEMORY_AND_DISK)
        return Volume(self.meta, keep(self.voxels), keep(self.traces))

    def stored(self) -> DataFrame:
        """The voxels with their leaf and block columns, as a table is written."""
        m = self.meta
        return self.cells().select(
            "x", "y", "z", "v", *(address.leaf(m, a).alias(f"{a}_leaf") for a in AXES), address.block_id(m).alias("sb_id"), address.leaf_morton(m).alias("morton")
        )

    def write(self, path: str, by: str = "x", mode: str = "errorifexists", files: int | None = None) -> None:
        """Write a table clustered for slices of an axis; an existing one is not overwritten unless asked.

        Rows go to ranges of the axis's leaf number and are sorted there, so row groups hold narrow ranges
        and filters on the leaf columns skip them. No range is bound to one task by a key.
        """
        keys = [f"{by}_leaf", "sb_id", "morton"]
        rows = self.stored()
        rows = rows.repartitionByRange(files, *keys) if files else rows.repartitionByRange(*keys)
        rows.sortWithinPartitions(*keys).write.mode(mode).parquet(path)


def read_volume(spark, path: str, meta: VolumeMeta) -> Volume:
    """A volume from a table that ``Volume.write`` made."""
    return Volume(meta, voxels=spark.read.parquet(path))
