"""Extents of a file: merging, windows with gap and size limits, read plans."""

from __future__ import annotations

import math
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Bytes of a file whose extents are put in order together: a file falls into many such ranges, so none is one task's.
RANGE = 1 << 28


def islands(extents: DataFrame, gap: int, *by: str, span: int = RANGE) -> DataFrame:
    """The extents with ``island``, the number of the run they belong to in their group, and its first offset ``start``.

    A run goes on while holes are ``gap`` bytes at most. Order is made inside ranges of ``span`` bytes; what ranges
    hand on (the furthest end, the number of runs begun) is a running total over one row for each range.
    """
    rows = extents.withColumn("_e", F.col("offset") + F.col("size") + gap).withColumn("_r", F.floor(F.col("offset") / span))
    keys = [*by, "_r"]
    before = Window.partitionBy(*by).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*keys).orderBy("offset", F.desc("_e"))
    ends = rows.groupBy(*keys).agg(F.max("_e").alias("_t"))
    ends = ends.select(*(F.col(k).alias(f"{k}_") for k in keys), F.max("_t").over(before).alias("_reached"))
    joined = rows.join(ends, [rows[k].eqNullSafe(ends[f"{k}_"]) for k in keys]).drop(*(f"{k}_" for k in keys))
    furthest = F.greatest(F.max("_e").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.col("_reached"))
    marked = joined.withColumn("_new", F.coalesce(F.col("offset") > furthest, F.lit(True)).cast("long"))
    begun = marked.groupBy(*keys).agg(F.sum("_new").alias("_c"), F.max(F.when(F.col("_new") == 1, F.col("offset"))).alias("_o"))
    begun = begun.select(*(F.col(k).alias(f"{k}_") for k in keys), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_done"), F.max("_o").over(before).alias("_last"))
    joined = marked.join(begun, [marked[k].eqNullSafe(begun[f"{k}_"]) for k in keys]).drop(*(f"{k}_" for k in keys))
    # a range, not rows: equal extents may come in another order here than above, and belong to one run
    upto = inside.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    # of runs in order the one that began last began furthest on
    return joined.withColumns({
        "island": F.col("_done") + F.sum("_new").over(upto),
        "start": F.coalesce(F.max(F.when(F.col("_new") == 1, F.col("offset"))).over(upto), F.col("_last")),
    }).drop("_e", "_r", "_new", "_reached", "_done", "_last")


def merge_with_gap(extents: DataFrame, gap: int, *by: str, span: int = RANGE) -> DataFrame:
    """(by..., offset, size): extents whose holes are ``gap`` bytes at most as one, in each group; holes are read along.

    Extents of one offset are folded before anything is put in order. An empty table gives an empty result.
    """
    rows = extents.groupBy(*by, "offset").agg(F.max("size").alias("size"))
    rows = islands(rows, gap, *by, span=span)
    return rows.groupBy(*by, "island").agg(F.min("offset").alias("offset"), (F.max(F.col("offset") + F.col("size")) - F.min("offset")).alias("size")).drop("island")


def merge_extents(extents: DataFrame, *by: str, span: int = RANGE) -> DataFrame:
    """(by..., offset, size): touching and overlapping extents as one, in each group."""
    return merge_with_gap(extents, 0, *by, span=span)


def fold_windows(blocks: Iterable[tuple[int, ...]], window: int, gap: int) -> list[tuple[int, int, int]]:
    """(offset, bytes, extents) of greedy windows over extents sorted by offset, each (offset, size) or (offset, size, times).

    The next extent joins while it starts inside the window, or no more than ``gap`` behind it and the
    window stays within ``window`` bytes. A first extent is taken whatever its size.
    """
    out: list[tuple[int, int, int]] = []
    start = end = count = 0
    for offset, size, *times in blocks:
        n = times[0] if times else 1  # a repeat always joins the first of its kind
        if count and (offset < end or (offset - end <= gap and offset + size - start <= window)):
            end, count = max(end, offset + size), count + n
            continue
        if count:
            out.append((start, end - start, count))
        start, end, count = offset, offset + size, n
    if count:
        out.append((start, end - start, count))
    return out


def build_windows(extents: DataFrame, window: int, gap: int, *by: str) -> DataFrame:
    """(by..., offset, size, extents): greedy read windows of each group.

    Exact duplicates are counted first. A hole of more than ``gap`` bytes always ends a window, so the runs between
    such holes are folded on their own, in as many tasks as there are; inside a run the rule is sequential.
    """
    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in extents.select(*by).schema)
    rows = islands(extents.groupBy(*by, "offset", "size").agg(F.count("*").alias("n")), gap, *by)

    def fold(key, t):
        t = t.sort_by([("offset", "ascending"), ("size", "descending")])
        made = fold_windows(zip(*(t.column(c).to_pylist() for c in ("offset", "size", "n")), strict=True), window, gap)
        own = [pa.array([k.as_py()] * len(made), k.type) for k in key[: len(by)]]
        return pa.table([*own, *(pa.array(c, pa.int64()) for c in zip(*made, strict=True))], names=[*by, "offset", "size", "extents"])

    return rows.groupBy(*by, "island").applyInArrow(fold, ", ".join(x for x in (keys, "offset long, size long, extents long") if x))


#: Windows of a long run that are cut by one task; a longer run is parted there before.
CUT = 16


def fitting_cuts(records: Iterable[tuple[int, int]], window: int) -> list[tuple[int, int, int]]:
    """(offset, bytes, records) of reads over records (offset, size) in order: a read ends before the first record
    that would carry it past ``window`` bytes. A record longer than that is read alone; every record is inside its read.
    """
    out: list[list[int]] = []
    for offset, size in records:
        end = offset + size
        if out and end <= out[-1][0] + window:
            out[-1][1], out[-1][2] = max(out[-1][1], end), out[-1][2] + 1
        else:
            out.append([offset, end, 1])
    return [(a, b - a, n) for a, b, n in out]


def distinct_records(requests: DataFrame) -> DataFrame:
    """Leaf requests (block, morton, is_plane, offset, size) without repeats of a leaf and without empty records."""
    one = F.min(F.struct("offset", "size")).alias("r")
    return requests.groupBy("block", "morton", "is_plane").agg(one).select("block", "morton", "is_plane", "r.offset", "r.size").where("size > 0")


def gap_limit(io_cost_us: float, bandwidth_mb_s: float, max_gap: int) -> int:
    """The longest hole that is cheaper to read than to skip with another call."""
    return max(0, min(max_gap, math.ceil(io_cost_us * bandwidth_mb_s) - 1))


def plan_reads(requests: DataFrame, io_cost_us: float = 50.0, bandwidth_mb_s: float = 2000.0, max_gap: int = 1 << 20, window: int = 64 << 20) -> DataFrame:
    """(offset, size, records): what to read for leaf requests (block, morton, is_plane, offset, size).

    Runs of records with cheap holes are one read, cut where a read would exceed ``window``. Every record lies in a
    read whole. Runs are cut in parallel, a run of over CUT windows in parts of that length.
    """
    rows = islands(distinct_records(requests).select("offset", "size", F.lit(0).alias("file")), gap_limit(io_cost_us, bandwidth_mb_s, max_gap), "file")
    rows = rows.withColumn("part", F.floor((F.col("offset") - F.col("start")) / (CUT * window)))

    def cut(t: pa.Table) -> pa.Table:
        t = t.sort_by([("offset", "ascending"), ("size", "ascending")])
        made = fitting_cuts(zip(*(t.column(c).to_pylist() for c in ("offset", "size")), strict=True), window)
        return pa.table([pa.array(c, pa.int64()) for c in zip(*made, strict=True)], names=["offset", "size", "records"])

    return rows.select("island", "part", "offset", "size").groupBy("island", "part").applyInArrow(cut, "offset long, size long, records long")


def plan_costs(requests: DataFrame, reads: DataFrame) -> DataFrame:
    """One row of what a plan costs: requests, leaves, repeats, bytes asked for, dropped and planned, calls, amplification."""
    kept = requests.groupBy("block", "morton", "is_plane").agg(F.min(F.struct("offset", "size")).alias("r"))
    total = lambda c, n: F.coalesce(F.sum(c), F.lit(0)).alias(n)
    asked = requests.agg(F.count("*").alias("logical"), total("size", "requested_bytes"))
    own = kept.agg(F.count("*").alias("leaves"), total("r.size", "kept_bytes"))
    planned = reads.agg(F.count("*").alias("calls"), total("size", "planned_bytes"))
    one = F.lit(1).alias("_")
    rows = asked.select("*", one).join(own.select("*", one), "_").join(planned.select("*", one), "_")
    return rows.select(
        "logical", "leaves", (F.col("logical") - F.col("leaves")).alias("duplicates"), "requested_bytes", (F.col("requested_bytes") - F.col("kept_bytes")).alias("eliminated_bytes"),
        "planned_bytes", "calls", F.when(F.col("requested_bytes") > 0, F.col("planned_bytes") / F.col("requested_bytes")).otherwise(1.0).alias("amplification"),
    )


def round_problems(rounds: DataFrame, length: int, *by: str) -> DataFrame:
    """(by..., problem, n): what is wrong with planned intervals (offset, size): empty, out of bounds, overlapping ones."""
    rows = islands(rounds.where("size > 0"), -1, *by)
    clash = rows.groupBy(*by, "island").agg((F.count("*") - 1).alias("n")).where("n > 0").groupBy(*by).agg(F.sum("n").alias("n"))
    count = lambda what, name: rounds.where(what).groupBy(*by).agg(F.count("*").alias("n")).select(*by, F.lit(name).alias("problem"), "n")
    found = count("size <= 0", "empty").unionByName(count(f"offset < 0 or offset + greatest(size, 0) > {length}", "out of bounds"))
    return found.unionByName(clash.select(*by, F.lit("overlap").alias("problem"), "n"))


def covers(extents: DataFrame, needed: DataFrame) -> DataFrame:
    """Needed extents that no extent contains: empty if a plan is complete. Both sides are one file's plan.

    Both are cut to aligned chunks and matched by chunk number, so this is an equi-join.
    """
    chunk = 1 << 20
    pieces = lambda df, n: df.select("offset", (F.col("offset") + F.col("size")).alias("end"), F.explode(F.sequence(F.floor(F.col("offset") / chunk), F.floor((F.col("offset") + F.greatest(F.col("size"), F.lit(1)) - 1) / chunk))).alias("c")).select(F.col("offset").alias(f"{n}o"), F.col("end").alias(f"{n}e"), "c")
    first = needed.select("offset", (F.col("offset") + F.col("size")).alias("end"), F.floor(F.col("offset") / chunk).alias("c")).distinct()
    hit = first.join(pieces(extents, "w"), "c").where("wo <= offset and end <= we").select("offset", "end").distinct()
    return first.select("offset", "end").join(hit, ["offset", "end"], "left_anti").select("offset", (F.col("end") - F.col("offset")).alias("size"))
