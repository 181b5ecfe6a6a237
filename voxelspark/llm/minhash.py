"""Near duplicates by an LSH forest over MinHash signatures, confirmed on the full shingle sets.

A tree is a sorted order of one slice of the signatures. Neighbours in an order that share a prefix are
candidates. The depth follows the region: rows pair up at the least depth at which their region is small,
and where it is crowded even at the full depth only the nearest ones do. The orders are numbered once and
read in blocks that overlap, so a crowded region spreads over tasks. What crowded regions leave is settled
exactly: rows of a region that are still in different components are compared all with all, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, chunks, components, discard, distinct_parts, in_blocks, mix, numbered, positional, shingles, stream, tables, tidied, tied, words_of_many, written

TREES, DEPTH, MIN_DEPTH = 20, 6, 3
#: Neighbours in an order that pair up, and as many in regions of more members than that.
REACH, CROWDED = 16, 3
WORDS = 5
#: A link: 100 * intersection >= SIMILARITY * union.
SIMILARITY = 75
#: Rows of an order that a task takes at once.
ORDER_BLOCK = 8192
#: Shingles of a block of rows that one task compares with another block; a row counts ROW at least, which bounds the rows.
BLOCK, ROW = 100_000, 200
_KEY = 1 + 4 * DEPTH


def _text_sets(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, distinct shingles of those rows, joined, and their numbers) for runs of rows."""
    texts = [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]
    for i, j in chunks(texts):
        yield i, j, *distinct_parts(*shingles(*words_of_many(texts[i:j]), WORDS))


def signatures(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, k1, k2, sig) per row: set size, 128-bit key of the set, TREES * DEPTH hashes.

    A text without words has n_shingles 0 and no signature.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = stream(0xF0E57, TREES * DEPTH) | U64(1)
        for batch in batches:
            for i, j, sets, n in _text_sets(batch.column(1)):
                full = n > 0
                start = (np.cumsum(n) - n)[full]
                sig = np.zeros((j - i, TREES * DEPTH), dtype=">u4")
                keys = np.zeros((2, j - i), dtype=U64)
                if len(start):
                    with np.errstate(over="ignore"):
                        for f, factor in enumerate(factors):
                            sig[full, f] = np.minimum.reduceat(sets * factor, start) >> U64(32)
                        keys[0, full] = np.add.reduceat(mix(sets), start)
                        keys[1, full] = np.add.reduceat(mix(sets ^ U64(0xA5A5A5A5)), start)
                raw = [x.tobytes() if ok else None for x, ok in zip(sig, full, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(n), pa.array(keys[0].view(np.int64)), pa.array(keys[1].view(np.int64)), pa.array(raw, pa.binary())],
                    names=["id", "n_shingles", "k1", "k2", "sig"],
                )

    return df.select(F.col(key).cast("long"), text).mapInArrow(tidied(sign), "id long, n_shingles long, k1 long, k2 long, sig binary")


def _pairs(keys: np.ndarray, ids: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Neighbour pairs of a run of an order whose second member is one of ``own``.

    A row's depth is the least one at which its region, the rows that share so many hashes with it, has REACH + 1
    members at most: these all pair up. Where it is crowded even at the full depth, and between its deeper
    regions, the CROWDED nearest rows pair up; crowded_links settles the others.
    """
    n = len(ids)
    levels = []
    for depth in range(MIN_DEPTH, DEPTH + 1):
        same = np.zeros(n, dtype=bool)  # row i shares its prefix with row i - 1
        same[1:] = (keys[1:, : 1 + 4 * depth] == keys[:-1, : 1 + 4 * depth]).all(axis=1)
        region = np.cumsum(~same)
        levels.append((region, np.bincount(region)[region] <= REACH + 1))
    out = [np.empty((2, 0), np.int64)]
    for d in range(1, min(REACH, n - 1) + 1):
        hit = levels[0][0][d:] == levels[0][0][:-d] if d <= CROWDED else np.zeros(n - d, dtype=bool)
        for region, small in levels:
            hit |= (region[d:] == region[:-d]) & small[d:]
        at = np.flatnonzero(hit & own[d:]) + d
        out.append(np.stack((ids[at - d], ids[at])))
    got = np.concatenate(out, axis=1)
    got = np.sort(got, axis=0)[:, got[0] != got[1]]
    return got[0], got[1]


def candidates(reps: DataFrame) -> DataFrame:
    """(a, b, trees): pairs of ids that are neighbours in some tree, a < b, with the number of trees.

    All trees are one sorted table, read in blocks of ORDER_BLOCK rows and the rows next to them, so no region
    is too large for a task.
    """
    rows = reps.select("id", F.posexplode(F.array(*[F.substring("sig", 4 * DEPTH * t + 1, 4 * DEPTH) for t in range(TREES)])).alias("t", "s"))
    rows = rows.select(F.concat(F.unhex(F.lpad(F.hex("t"), 2, "0")), F.col("s")).alias("key"), "id")

    def near(t: pa.Table) -> pa.Table:
        t = t.sort_by("_at").combine_chunks()
        keys = np.frombuffer(b"".join(t.column("key").to_pylist()), np.uint8).reshape(-1, _KEY)
        a, b = _pairs(keys, t.column("id").to_numpy(), np.array(t.column("_own").to_pylist()))
        return pa.table({"a": a, "b": b})

    # one row more than the reach, so that a block sees whether a region at its edge is crowded
    found = in_blocks(numbered(rows, "key", "id"), ORDER_BLOCK, REACH + 1).groupBy("_b").applyInArrow(tidied(near), "a long, b long")
    return found.groupBy("a", "b").agg(F.count("*").alias("trees"))


def shingle_sets(df: DataFrame, ids: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, set): sorted distinct shingles, as bytes, of the texts whose ids are asked for."""
    schema = "id long, set binary"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, sets, n in _text_sets(batch.column(1)):
                raw, at = [], 0
                for k in n.tolist():
                    raw.append(sets[at : at + k].tobytes())
                    at += k
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(raw, pa.binary())], names=["id", "set"])

    rows = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t"))
    # a shuffle join at every size: the ids are a share of the corpus
    return rows.join(ids.hint("merge"), "id", "left_semi").mapInArrow(tidied(pack), schema)


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left, right = sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), sets.select(F.col("id").alias("b"), F.col("set").alias("sb"))
    rows = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "sa", "sb")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
                small, large = sorted((len(x), len(y)))
                if 100 * small < SIMILARITY * large:
                    keep.append(False)
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= SIMILARITY * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(tidied(check), "a long, b long")


def _overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of a with each of b; exact, as floats hold whole numbers to 2 ** 24."""
    values, column = np.unique(np.concatenate((*a, *b)), return_inverse=True)
    split = sum(map(len, a))
    left, right = column[:split], column[split:]
    # only shingles of both sides count
    shared = (np.bincount(left, minlength=len(values)) > 0) & (np.bincount(right, minlength=len(values)) > 0)
    place = np.cumsum(shared) - 1
    rows = [np.repeat(np.arange(len(x)), [len(y) for y in x]) for x in (a, b)]
    sides = [(r[shared[c]], place[c[shared[c]]]) for r, c in zip(rows, (left, right), strict=True)]
    out, most = np.zeros((len(a), len(b)), np.float32), max(1, (1 << 22) // (len(a) + len(b)))
    sides = [(r[o], c[o]) for r, c in sides for o in (np.argsort(c, kind="stable"),)]
    for low in range(0, int(shared.sum()), most):
        tables = []
        for (r, c), x in zip(sides, (a, b), strict=True):
            i, j = np.searchsorted(c, (low, low + most))
            t = np.zeros((len(x), most), np.float32)
            t[r[i:j], c[i:j] - low] = 1
            tables.append(t)
        out += tables[0] @ tables[1].T
    return out


def crowded_links(reps: DataFrame, same: DataFrame, full: DataFrame) -> DataFrame:
    """(a, b): links between components within crowded regions, enough to tie all that are linked there.

    Every pair of rows that share a prefix in a region of more than REACH + 1 rows and are in different
    components is compared on the full sets. Regions of one component are done, so a group of copies that
    its neighbours have tied costs nothing here. The others are cut into blocks of BLOCK shingles, large
    components into blocks of their own, and pairs of blocks with more than one component go to tasks.
    """
    rows = reps.join(same.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("c"), F.greatest(F.col("n_shingles"), F.lit(ROW)).cast("long").alias("w"), "sig")
    cuts = F.array(*[F.concat(F.unhex(F.lit(f"{t:02x}")), F.substring("sig", 4 * DEPTH * t + 1, 4 * MIN_DEPTH)) for t in range(TREES)])
    rows = rows.select("id", "c", "w", F.explode(cuts).alias("r"))
    crowded = rows.groupBy("r").agg(F.count("*").alias("n"), F.min("c").alias("lo"), F.max("c").alias("hi")).where(f"n > {REACH + 1} and lo <> hi")
    rows = written(rows.join(crowded.select("r").hint("merge"), "r"))
    parts = rows.groupBy("r", "c").agg(F.sum("w").alias("cw"))
    parts = parts.join(parts.where(f"cw <= {BLOCK}").groupBy("r").agg(F.sum("cw").alias("rest")), "r", "left")
    number = lambda of, weight: F.pmod(F.xxhash64(of), F.greatest(F.lit(1), F.ceil(F.col(weight) / BLOCK)).cast("long"))
    # (component, number) for a large component, (null, number) for the others
    large = F.col("cw") > BLOCK
    placed = rows.join(parts, ["r", "c"]).select(
        "r", "id", "c", F.struct(F.when(large, F.col("c")).alias("of"), F.when(large, number("id", "cw")).otherwise(number("c", "rest")).alias("k")).alias("block")
    )
    placed = written(placed)
    blocks = written(placed.groupBy("r", "block").agg(F.min("c").alias("lo"), F.max("c").alias("hi")))
    x, y = (blocks.select("r", *(F.col(c).alias(f"{c}{s}") for c in ("block", "lo", "hi"))) for s in "xy")
    pairs = x.join(y, "r").where("blockx <= blocky and (lox <> hix or loy <> hiy or lox <> loy)").select("r", "blockx", "blocky")
    sides = F.when(F.col("blockx") == F.col("blocky"), F.array("blockx")).otherwise(F.array("blockx", "blocky"))
    pairs = pairs.select("r", F.xxhash64("r", "blockx", "blocky").alias("p"), F.posexplode(sides).alias("side", "block"))
    wanted = pairs.join(placed, ["r", "block"]).select("r", "p", "side", "id", "c").join(full, "id")

    def compare(t: pa.Table) -> pa.Table:
        side, ids, comps = (t.column(n).to_numpy() for n in ("side", "id", "c"))
        sets = [np.frombuffer(x, U64) for x in t.column("set").to_pylist()]
        n = np.array([len(x) for x in sets])
        first = np.flatnonzero(side == 0)
        second = np.flatnonzero(side == 1) if side.any() else first
        both = _overlaps([sets[i] for i in first], [sets[i] for i in second]).astype(np.int64)
        hit = 100 * both >= SIMILARITY * (n[first][:, None] + n[second][None, :] - both)
        hit &= comps[first][:, None] != comps[second][None, :]
        at: dict[int, int] = {}

        def root(c: int) -> int:
            while (up := at.get(c, c)) != c:
                at[c] = c = at.get(up, up)
            return c

        out = []
        for i, j in zip(*(x.tolist() for x in np.nonzero(hit)), strict=True):
            i, j = first[i], second[j]
            u, v = root(int(comps[i])), root(int(comps[j]))
            if u != v:  # links that tie nothing new stay away
                at[u] = v
                out.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
        return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})

    return wanted.select("r", "p", "side", "id", "c", "set").groupBy("r", "p").applyInArrow(tidied(compare), "a long, b long")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) per row.

    Rows whose sets are equal are one node before the forest is built, whatever their number, so groups of
    exact copies cost one row each. Each node's likeliest pair (found in most trees) is confirmed first;
    of the other pairs only those between different components remain to be confirmed, all of them. Last
    come the pairs of crowded regions that are no candidates, where they could still tie components.

    A text without words, or null, is linked with nothing. A null id takes no part: its component is null
    and it is kept. Rows that repeat an id are one node. An empty table gives an empty result.
    """
    before = set(tables())
    signed = written(signatures(df, key, text))
    stay = {*before, tables()[-1]}
    sets = ["n_shingles", "k1", "k2"]
    real = signed.where("n_shingles > 0 and id is not null")
    members = real.select("id", *sets)
    # written, so that joins by set read plain shuffles, which adaptive execution can split at a large group of copies
    groups = written(members.groupBy(*sets).agg(F.min("id").alias("rep")))
    reps = real.groupBy(*sets).agg(F.min("id").alias("id"), F.first("sig").alias("sig"))
    pairs = written(candidates(reps))
    ends = pairs.select(F.col("a").alias("id"), F.col("b").alias("o"), "trees").union(pairs.select("b", "a", "trees"))
    best = ends.groupBy("id").agg(F.max_by("o", F.struct("trees", -F.col("o"))).alias("o"))
    best = best.select(F.least("id", "o").alias("a"), F.greatest("id", "o").alias("b")).distinct()
    full = written(shingle_sets(df, ends.select("id").distinct(), key, text))
    same = components(written(confirm(best, full)))
    of = lambda c: same.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    apart = (
        pairs.join(best, ["a", "b"], "left_anti").join(of("a"), "a", "left").join(of("b"), "b", "left")
        .where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    )
    same = tied(same, written(confirm(apart, full)))
    linked = written(crowded_links(reps, same, full))
    # rows that repeat an id with another text are one node too: the id ties their sets together
    several = written(members.groupBy("id").agg(F.min("k1").alias("lo"), F.max("k1").alias("hi")).where("lo <> hi").select("id"))
    if not several.isEmpty():
        own = members.join(several, "id").join(groups, sets).select("id", "rep").distinct()
        least = own.groupBy("id").agg(F.min("rep").alias("a"))
        linked = linked.union(own.join(least, "id").select("a", F.col("rep").alias("b")))
    same = tied(same, linked)
    nodes = written(groups.join(same, F.col("rep") == F.col("node"), "left").select(*sets, F.coalesce("component", "rep").alias("_c")))
    # the result reads signatures and nodes only
    discard(df.sparkSession, [t for t in tables()[:-1] if t not in stay])
    out = signed.select("id", *sets).join(nodes, sets, "left").withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("_c")).otherwise(F.col("id")))
    out = out.withColumn("component_id", F.when(F.col("id").isNotNull(), F.col("component_id")))
    return out.select("id", "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_first(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of one document of each component, with the columns they came with."""
    rows, (key, text) = positional(df, key, text)
    # a shuffle join at every size: what goes is a share of the corpus
    gone = near_duplicates(rows, key, text).where("not kept").select(F.col("id").alias(key)).distinct().hint("merge")
    return rows.join(gone, key, "left_anti").select(*rows.columns).toDF(*df.columns)
