"""Exact removal of byte strings of 200 bytes that start anywhere else, by suffix arrays over shards.

Every window of LENGTH bytes names an anchor inside itself: its least hashed GRAM-byte string, the leftmost
of equals. Equal windows name equal anchors, so shards by anchor hash never part a pair, and text round
anchors that occur once need not be looked at again. A shard sorts the suffixes of its texts by
Larsson-Sadakane refinement (only groups still tied are sorted again, by the rank at twice the depth) and
takes common prefixes by Kasai's property. An anchor with more text than a block spans several suffix
arrays; these are merged by binary search of one's windows in the other's order. An anchor with more segments
than a shard may hold is dealt again by the bytes next to it, as often as it takes, and then goes the same way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BYTE, U64, chunks, discard, mix, positional, stream, tables, tidied, written

LENGTH = 200
GRAM = 32
REACH = LENGTH - GRAM + 1
#: Bytes of text under one suffix array.
BLOCK = 1 << 19
#: An anchor with more segments than this is dealt again by more of its bytes.
SHARD_SEGMENTS = 4096
_BITS = 20
_CAP = 640


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, number of windows, anchor hash, anchor's place from the start) of the runs of windows that name one place.

    ``data`` holds whole texts side by side that end at ``ends``; windows never cross an end. At most 2**20
    bytes at once.
    """
    none = np.empty(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none.view(U64), none
    with np.errstate(over="ignore"):
        h = _BYTE[data]
        for m, c in zip((1, 2, 4, 8, 16), stream(0xA9C, 5), strict=True):
            h = h[:-m] * (c | U64(1)) + h[m:]
        h = mix(h)
    low = U64((1 << _BITS) - 1)
    least = (h & ~low) | np.arange(len(h), dtype=U64)
    for s in (1, 2, 4, 8, 16, 32, 64):
        least = np.minimum(least[:-s], least[s:])
    place = (np.minimum(least[: len(least) - (REACH - 128)], least[REACH - 128 :]) & low).astype(np.int64)
    valid = np.ones(len(place), dtype=bool)
    for e in ends.tolist():
        valid[max(0, e - LENGTH + 1) : e] = False
    at = np.flatnonzero(valid)
    if not len(at):
        return none, none, none.view(U64), none
    new = np.concatenate(([True], (np.diff(at) != 1) | (np.diff(place[at]) != 0)))
    first = np.flatnonzero(new)
    return at[first], np.diff(np.concatenate((first, [len(at)]))), h[place[at[first]]], place[at[first]] - at[first]


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of the bytes in the order of their first ``depth`` bytes at least (ties: as they fall).

    Starts from eight-byte prefixes; a group of tied suffixes is sorted again by the ranks of the suffixes
    a depth further on, and groups of one are never touched again.
    """
    n = len(text)
    pad = np.concatenate((text, np.zeros(8, np.uint8))).astype(U64)
    key = np.zeros(n, U64)
    for k in range(8):
        key = (key << U64(8)) | pad[k : k + n]
    order = np.argsort(key, kind="stable").astype(np.int64)
    ordered = key[order]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    starts = np.flatnonzero(new)
    rank[order] = np.repeat(starts, np.diff(np.concatenate((starts, [n]))))
    tied = ~(new & np.concatenate((new[1:], [True])))
    slots = np.flatnonzero(tied)
    at = 8
    while at < depth and len(slots):
        members = order[slots]
        both = (rank[members] << 32) | (rank[np.minimum(members + at, n)] + 1)
        way = np.argsort(both, kind="stable")
        members, both = members[way], both[way]
        order[slots] = members
        new = np.concatenate(([True], both[1:] != both[:-1]))
        starts = np.flatnonzero(new)
        rank[members] = np.repeat(slots[starts], np.diff(np.concatenate((starts, [len(slots)]))))
        slots = slots[~(new & np.concatenate((new[1:], [True])))]
        at *= 2
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, forced: np.ndarray) -> np.ndarray:
    """lcp[i]: bytes that suffix order[i] shares with order[i - 1], exact up to _CAP at forced and irreducible places.

    Kasai's property: where the suffix one byte before has the neighbour one byte before, and these bytes
    agree, the prefix is one shorter than there. Only the other places, and those forced, are compared.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    place = np.arange(n)
    need = before < 1
    need[0] = True
    inside = ~need
    behind = place[inside] - 1
    need[inside] = (before[behind] != before[inside] - 1) | (text[behind] != text[before[inside] - 1])
    need[forced] = True
    roots = np.flatnonzero(need)
    known = np.zeros(n, np.int64)
    pad = np.concatenate((text, np.zeros(16, np.uint8)))
    words = np.lib.stride_tricks.as_strided(pad, shape=(n + 8, 8), strides=(1, 1))
    live = roots[before[roots] >= 0]
    a, b, got = live, before[live], np.zeros(len(live), np.int64)
    where = live
    while len(a):
        room = n - np.maximum(a, b)
        same = words[np.minimum(a, n)] == words[np.minimum(b, n)]
        step = np.minimum(np.where(same.all(axis=1), 8, same.argmin(axis=1)), np.maximum(room, 0))
        got = got + step
        known[where] = got
        on = (step == 8) & (got < _CAP)
        a, b, got, where = a[on] + 8, b[on] + 8, got[on], where[on]
    root = np.maximum.accumulate(np.where(need, place, 0))
    whole = known[root] - (place - root)
    return np.maximum(whole, 0)[order]


class Block:
    """Segments of one shard under one suffix array: which of their windows occur twice or more in it."""

    def __init__(self, segments: list[bytes], many: list[bool]):
        text = np.frombuffer(b"".join(segments), np.uint8)
        sizes = np.array([len(s) for s in segments])
        self.first = np.cumsum(sizes) - sizes
        self.windows = sizes - LENGTH + 1
        start = np.zeros(len(text), dtype=bool)
        self.owner = np.repeat(np.arange(len(segments)), self.windows)
        inside = np.arange(len(self.owner)) - np.repeat(np.cumsum(self.windows) - self.windows, self.windows)
        self.at = self.first[self.owner] + inside
        start[self.at] = True
        order = suffix_array(text, LENGTH)
        lcp = common_prefixes(text, order, self.first)
        is_window = start[order]
        rows = np.flatnonzero(is_window)
        twin = np.zeros(len(text), dtype=bool)
        if len(rows) > 1:
            # the least prefix on the way from one window to the next; suffixes that run out of their segment lie between
            shared = np.minimum.reduceat(lcp, rows + 1 if rows[-1] + 1 < len(lcp) else rows[:-1] + 1)[: len(rows) - 1]
            hit = shared >= LENGTH
            twin[order[rows[:-1][hit]]] = True
            twin[order[rows[1:][hit]]] = True
        self.found = twin[self.at] | np.array(many)[self.owner]
        self.text, self.sorted = text, order[rows]

    def merge(self, other: Block) -> None:
        """Mark the windows that both blocks have: binary search of the smaller's in the order of the larger's."""
        small, large = sorted((self, other), key=lambda b: len(b.sorted))
        take = lambda b: np.ascontiguousarray(np.lib.stride_tricks.as_strided(b.text, (len(b.text) - LENGTH + 1, LENGTH), (1, 1))[b.sorted]).view(f"S{LENGTH}").ravel()
        x, y = take(small), take(large)
        low, high = np.searchsorted(y, x, "left"), np.searchsorted(y, x, "right")
        both = np.flatnonzero(low < high)
        mark = np.zeros(len(small.text), dtype=bool)
        mark[small.sorted[both]] = True
        small.found |= mark[small.at]
        edge = np.zeros(len(y) + 1, np.int64)
        np.add.at(edge, low[both], 1)
        np.add.at(edge, high[both], -1)
        mark = np.zeros(len(large.text), dtype=bool)
        mark[large.sorted[np.cumsum(edge[:-1]) > 0]] = True
        large.found |= mark[large.at]

    def spans(self) -> Iterator[tuple[int, int, int]]:
        """(segment, from, to): bytes covered by found windows, counted from the segment's start."""
        hit = np.flatnonzero(self.found)
        if not len(hit):
            return
        owner, at = self.owner[hit], self.at[hit] - self.first[self.owner[hit]]
        new = np.concatenate(([True], (np.diff(owner) != 0) | (np.diff(at) > LENGTH)))
        begin = np.flatnonzero(new)
        last = np.concatenate((begin[1:], [len(hit)])) - 1
        yield from zip(owner[begin].tolist(), at[begin].tolist(), (at[last] + LENGTH).tolist(), strict=True)


def repeated_windows(groups: list[tuple[int, dict[int, list]]]) -> Iterator[tuple[int, int, int, int]]:
    """(anchor, segment key, from, to) for groups (anchor, {segment key: [bytes, seen twice]}).

    Small groups share blocks; a group of more than a block is cut into several, which are merged pairwise.
    """
    held: list[tuple[int, int, list]] = []
    size = 0

    def settle(rows: list[tuple[int, int, list]]) -> tuple[Block, list[tuple[int, int, list]]]:
        return Block([r[2][0] for r in rows], [r[2][1] for r in rows]), rows

    def tell(block: Block, rows: list[tuple[int, int, list]]) -> Iterator[tuple[int, int, int, int]]:
        for k, a, b in block.spans():
            yield rows[k][0], rows[k][1], a, b

    for anchor, segments in groups:
        rows = [(anchor, k, v) for k, v in segments.items()]
        own = sum(len(r[2][0]) for r in rows)
        if own > BLOCK:
            blocks, part, n = [], [], 0
            for r in rows:
                part.append(r)
                n += len(r[2][0])
                if n > BLOCK:
                    blocks.append(settle(part))
                    part, n = [], 0
            if part:
                blocks.append(settle(part))
            for i in range(len(blocks)):
                for j in range(i):
                    blocks[i][0].merge(blocks[j][0])
            for b in blocks:
                yield from tell(*b)
            continue
        if held and size + own > BLOCK:
            yield from tell(*settle(held))
            held, size = [], 0
        held += rows
        size += own
    if held:
        yield from tell(*settle(held))


def _anchor_rows(docs: DataFrame) -> DataFrame:
    """(k, r, at, n, h, a): runs of windows of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [b"" if t is None else t for t in batch.column(2).cast(pa.binary()).to_pylist()]
            k, r = batch.column(0), batch.column(1)
            for i, j in chunks(texts):
                whole = b"".join(texts[i:j])
                ends = np.cumsum([len(t) for t in texts[i:j]])
                step = (1 << _BITS) - LENGTH
                for low in range(0, max(1, len(whole)), step):  # more than one turn only for a long text alone
                    data = np.frombuffer(whole[low : low + step + LENGTH - 1], np.uint8)
                    at, n, h, a = anchors(data, ends - low if low + len(data) >= len(whole) else np.array([len(data)]))
                    if len(at):
                        owner = np.searchsorted(ends, at + low, "right")
                        base = np.concatenate(([0], ends))[owner]
                        own = pa.array(owner + i)
                        yield pa.RecordBatch.from_arrays(
                            [k.take(own), r.take(own), pa.array(at + low - base), pa.array(n.astype(np.int32)), pa.array(h.view(np.int64)), pa.array(a.astype(np.int16))],
                            names=["k", "r", "at", "n", "h", "a"],
                        )

    return docs.mapInArrow(tidied(run), "k long, r long, at long, n int, h long, a short")


def _segments(rows: DataFrame) -> DataFrame:
    """(h, s, a, k, r, at, seen, segment) for texts with their places.

    A task sends a segment's bytes once; the second time it says so without them, later times it only
    keeps where they were. (The memory of what was sent is emptied now and then; that costs bytes, no result.)
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[int, int], int] = {}
        schema = pa.schema([("h", pa.int64()), ("s", pa.int64()), ("a", pa.int16()), ("k", pa.int64()), ("r", pa.int64()), ("at", pa.int64()), ("seen", pa.int8()), ("segment", pa.binary())])
        for batch in batches:
            cols: list[list] = [[] for _ in schema]
            held = 0
            for k, r, text, places in zip(*(batch.column(c).to_pylist() for c in range(3)), batch.column(3), strict=True):
                text = text.encode() if isinstance(text, str) else text
                values = places.values
                for at, n, h, a in zip(*(values.field(f).to_pylist() for f in range(4)), strict=True):
                    segment = text[at : at + n + LENGTH - 1]
                    s = xxhash.xxh3_64_intdigest(segment)
                    s = s - (1 << 64) if s >> 63 else s
                    seen = min(2, known.get((h, s), 0))
                    known[h, s] = seen + 1
                    for c, v in zip(cols, (h, s, a, k, r, at, seen, None if seen else segment), strict=True):
                        c.append(v)
                    held += 0 if seen else len(segment)
                if held > 4 << 20 or len(cols[0]) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)
                    cols, held = [[] for _ in schema], 0
                if len(known) > 500_000:
                    known = {}
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)

    return rows.mapInArrow(tidied(cut), "h long, s long, a short, k long, r long, at long, seen byte, segment binary")


def _shard_spans(sent: DataFrame) -> DataFrame:
    """(h, s, from, to) of segments (h, s, twice, segment), by suffix arrays per shard; every h goes to one task."""
    schema = "h long, s long, from int, to int"

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups() -> Iterator[tuple[int, dict[int, list]]]:
            anchor, have = None, {}
            for batch in batches:
                for h, s, twice, segment in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                    if h != anchor:
                        if have:
                            yield anchor, have
                        anchor, have = h, {}
                    if s in have:
                        have[s][1] = True
                        have[s][0] = have[s][0] or segment
                    else:
                        have[s] = [segment, twice]
            if have:
                yield anchor, have

        out = []
        for row in repeated_windows(groups()):
            out.append(row)
            if len(out) >= 20_000:
                yield _frame(out)
                out = []
        if out:
            yield _frame(out)

    return sent.select("h", "s", "twice", "segment").repartition("h").sortWithinPartitions("h").mapInArrow(tidied(sort), schema)


def _frame(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    h, s, a, b = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(s, pa.int64()), pa.array(a, pa.int32()), pa.array(b, pa.int32())], names=["h", "s", "from", "to"])


def _divide(rest: int):
    """A pass that deals segments (h, s, a, l, twice, segment) again, each with the bytes on one side of what its group shares.

    Windows of a group share their anchor with ``l`` bytes before it, and all but ``rest`` bytes. Of the rest
    each window has half at least on one side; the half next to what is shared, on that side, joins it.
    So equal windows stay together, and the windows of a segment fall into two runs at most.
    """
    more = -(-rest // 2)
    schema = pa.schema([("h", pa.int64()), ("s", pa.int64()), ("a", pa.int16()), ("l", pa.int16()), ("twice", pa.bool_()), ("segment", pa.binary()), ("of", pa.int64()), ("part", pa.int64()), ("base", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in schema]
            for h, s, a, left, twice, segment in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                right, windows = LENGTH - GRAM - rest - left, len(segment) - LENGTH + 1
                # from this window on, no less lies behind the shared bytes than before them
                cut = min(max(-(-(2 * (a + GRAM + right) - LENGTH - (left + right + GRAM)) // 2), 0), windows)
                for low, high, back in ((0, cut, True), (cut, windows, False)):
                    if low < high:
                        at = a - left - more if back else a + GRAM + right
                        key = xxhash.xxh3_64_intdigest(b"%d %d %d " % (h, left, back) + segment[at : at + more]) - (1 << 63)
                        part = segment[low : high + LENGTH - 1]
                        for c, v in zip(cols, (key, xxhash.xxh3_64_intdigest(part) - (1 << 63), a - low, left + more * back, twice, part, h, s, low), strict=True):
                            c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)

    return run


def _spans(sent: DataFrame, rest: int = LENGTH - GRAM) -> DataFrame:
    """(h, s, from, to) of segments (h, s, a, l, twice, segment); crowded groups are dealt again until they are small.

    A group that shares whole windows has one segment only, so this ends; a segment many others contain is one row.
    """
    crowded = written(sent.groupBy("h").agg(F.count("*").alias("c")).where(F.col("c") > SHARD_SEGMENTS).select("h"))
    if not rest or crowded.isEmpty():
        return _shard_spans(sent)
    one = sent.join(crowded, "h").groupBy("h", "s").agg(*(F.first(c).alias(c) for c in ("a", "l")), (F.max("twice") | (F.count("*") > 1)).alias("twice"), F.max("segment").alias("segment"))
    parts = written(one.select("h", "s", "a", "l", "twice", "segment").mapInArrow(tidied(_divide(rest)), "h long, s long, a short, l short, twice boolean, segment binary, of long, part long, base int"))
    # a segment sent twice by a task stands there once without its bytes: all that is left here has them
    found = written(_spans(parts.select("h", "s", "a", "l", "twice", "segment"), rest - -(-rest // 2)))
    back = parts.select("h", "s", "of", "part", "base").join(found, ["h", "s"])
    back = back.select(F.col("of").alias("h"), F.col("part").alias("s"), (F.col("base") + F.col("from")).alias("from"), (F.col("base") + F.col("to")).alias("to"))
    return _shard_spans(sent.join(crowded, "h", "left_anti")).union(back)


def covered(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(k, r, spans): pieces [start, end) of repeated bytes of each text that has any; they may overlap.

    k and r stand for the row: its key and a hash of its text.
    """
    docs = df.select(F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("k"), F.xxhash64(F.col(text)).alias("r"), F.col(text).alias("t"))
    stay = set(tables())
    places = written(_anchor_rows(docs))
    # written, so that the join reads plain shuffles, which adaptive execution can split where an anchor is hot
    again = written(places.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h"))
    spots = places.join(again, "h").groupBy("k", "r").agg(F.collect_list(F.struct("at", "n", "h", "a")).alias("places"))
    cut = written(_segments(docs.join(spots, ["k", "r"]).select("k", "r", "t", "places")))
    stay.add(tables()[-1])
    spans = written(_spans(cut.where("seen < 2").select("h", "s", "a", F.lit(0).cast("short").alias("l"), F.lit(False).alias("twice"), "segment")))
    # segments and their spans are all that is read from here on
    discard(df.sparkSession, [t for t in tables()[:-1] if t not in stay])
    at = F.col("at")
    found = cut.select("h", "s", "k", "r", "at").join(spans, ["h", "s"]).select("k", "r", (at + F.col("from")).alias("a"), (at + F.col("to")).alias("b"))
    return found.groupBy("k", "r").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def _merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans or []):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _apply(df: DataFrame, key: str, text: str, schema: str, row) -> DataFrame:
    """Join the texts with their spans and make rows by ``row(kept bytes, size, merged spans)``."""
    found = covered(df, key, text)
    docs = df.withColumns({"_k": F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))), "_r": F.xxhash64(F.col(text))})
    joined = docs.join(found.select(F.col("k").alias("_k"), F.col("r").alias("_r"), F.col("spans").alias("_spans")), ["_k", "_r"], "left").drop("_k", "_r")
    place = joined.columns.index(text)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for t, spans in zip(batch.column(place).cast(pa.binary()).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                whole, cuts = t or b"", _merged(spans)
                parts, at = [], 0
                for a, b in cuts:
                    parts.append(whole[at:a])
                    at = b
                parts.append(whole[at:])
                made.append(row(t, b"".join(parts), cuts))
            yield from row.batches(batch, made)

    return joined.mapInArrow(tidied(make), schema)


class _Digest:
    def __call__(self, whole: bytes | None, kept: bytes, cuts: list[tuple[int, int]]) -> tuple:
        return len(whole or b""), len(whole or b"") - len(kept), len(cuts), hashlib.sha256(kept).hexdigest()

    def batches(self, batch: pa.RecordBatch, made: list[tuple]) -> Iterator[pa.RecordBatch]:
        n, removed, spans, sha = zip(*made, strict=True) if made else ((), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


class _Text:
    """The rows with their remaining text; bytes left of a character that was cut through go too."""

    def __init__(self, place: int):
        self.place = place

    def __call__(self, whole: bytes | None, kept: bytes, cuts: list[tuple[int, int]]) -> str | None:
        return None if whole is None else kept.decode(errors="ignore")

    def batches(self, batch: pa.RecordBatch, made: list[str | None]) -> Iterator[pa.RecordBatch]:
        columns = [batch.column(i) for i in range(batch.num_columns - 1)]
        columns[self.place] = pa.array(made, batch.schema.field(self.place).type)
        yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])


def digest(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row.

    A null text is empty; a text under 200 bytes loses nothing. Rows repeated as a whole lose everything
    that is 200 bytes or longer, like any copies. An empty table gives an empty result.
    """
    rows = df.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return _apply(rows, "doc_id", "text", "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", _Digest())


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows, all columns, with repeated bytes cut from the text."""
    rows, (key, text) = positional(df, key, text)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return _apply(rows, key, text, schema, _Text(rows.columns.index(text))).toDF(*df.columns)
