"""Benchmark decontamination: passages within a few edits of an item, anywhere in a text.

Candidates come from the CGK random-walk embedding, which maps edit distance to Hamming distance, and
repeated bit sampling on it: two strings walked by one random function agree in most places if few edits
part them. Item-sized windows of a text are embedded, at whatever byte they start; windows that cannot hold an
item by the gram lemma (an edit spoils GRAM grams at most, so a match keeps many of the item's grams, each near
its place) are left out before, which loses nothing. Every candidate is verified by its exact edit distance.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BYTE, U64, chunks, mix, positional, stream, tidied

#: Edits allowed per 100 bytes of the item's normalised text.
EDITS_PER_100 = 6
GRAM = 10
#: Sampled places of an embedding, and the recall to be reached by repetition where a place agrees this often.
SAMPLES, RECALL, AGREE = 4, 0.999, 0.65
#: Items that go through the corpus together, and their characters: the size of what is sent to every executor.
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 8 << 20
#: Items longer than this are embedded class by class; bytes of windows embedded side by side.
LONG, EMBED = 1000, 1 << 20
_TABLE = 22


def repetitions(samples: int = SAMPLES, recall: float = RECALL, agree: float = AGREE) -> int:
    """How often to sample so that a pair whose embeddings agree in this share of places is met with this recall."""
    return math.ceil(math.log(1 - recall) / math.log(1 - agree**samples))


def normal(text: str | None) -> bytes:
    """Lower case, runs of ASCII white space as one space, as UTF-8."""
    return b" ".join((text or "").lower().encode().split())


def edits_allowed(length: int) -> int:
    """Edits an item of this length may show: the share above, and so few that a match keeps a gram."""
    return max(0, min(length * EDITS_PER_100 // 100, (length - GRAM) // GRAM))


def grams(data: np.ndarray) -> np.ndarray:
    """Hashes of the strings of GRAM bytes."""
    with np.errstate(over="ignore"):
        h = [_BYTE[data]]
        factor = stream(0x96A, 4) | U64(1)
        for k, m in enumerate((1, 2, 4)):
            h.append(h[-1][:-m] * factor[k] + h[-1][m:])
        return mix(h[3][:-2] * factor[3] + h[1][8:]) if len(data) >= GRAM else np.empty(0, U64)


def distance_within(item: bytes, text: bytes, most: int) -> int | None:
    """The least edit distance of the item to any part of the text, if it is no more than ``most`` (bit vectors)."""
    m = len(item)
    where: dict[int, int] = {}
    for i, c in enumerate(item):
        where[c] = where.get(c, 0) | (1 << i)
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = full, 0, m, m
    for c in text:
        eq = where.get(c, 0)
        x = eq | down
        d0 = (((x & up) + up) ^ up) | x
        hp, hn = down | (~(d0 | up) & full), d0 & up
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        if score < best:
            best = score
        hp = (hp << 1) & full
        up, down = ((hn << 1) & full) | (~(d0 | hp) & full), d0 & hp
    return best if best <= most else None


class Index:
    """Items ready to be looked for: grams with their places, length classes, sampled embeddings.

    Items of under GRAM bytes have no gram and allow no edit: they are looked up as they stand.
    """

    def __init__(self, items: Sequence[tuple[int, str | None]], seed: int = 0xC6):
        found = [(i, normal(t)) for i, t in items]
        self.short: dict[bytes, list[int]] = {}
        for i, t in found:
            if 0 < len(t) < GRAM:
                self.short.setdefault(t, []).append(i)
        self.items = [(i, t) for i, t in found if len(t) >= GRAM]
        lengths = np.array([len(t) for _, t in self.items], dtype=np.int64)
        self.edits = np.array([edits_allowed(n) for n in lengths.tolist()], dtype=np.int64)
        self.kept = lengths - GRAM + 1 - GRAM * self.edits
        plain = [grams(np.frombuffer(t, np.uint8)) for _, t in self.items]
        self.own = [np.sort(g) for g in plain]
        self.repeats, self.seed = repetitions(), seed
        # classes of like lengths: (longest window, most edits, places sampled in each repetition)
        self.classes: list[tuple[int, int, np.ndarray]] = []
        rng = np.random.default_rng(seed)
        left = np.argsort(lengths, kind="stable")
        klass = np.zeros(len(lengths), np.int64)
        members: list[np.ndarray] = []
        while len(left):
            own = left[lengths[left] <= max(lengths[left[0]] * 1.15, lengths[left[0]] + 8)]
            left = left[len(own) :]
            klass[own] = len(self.classes)
            self.classes.append((int((lengths + self.edits)[own].max()), int(self.edits[own].max()), rng.integers(0, 2 * lengths[own[0]], (self.repeats, SAMPLES))))
            members.append(own)
        # classes that are embedded together: the short ones, each long one alone
        self.groups = [[c for c, x in enumerate(self.classes) if x[0] <= LONG], *([c] for c, x in enumerate(self.classes) if x[0] > LONG)]
        self.groups = [g for g in self.groups if g]
        self.keys: list[np.ndarray] = []
        self.owners: list[np.ndarray] = []
        for own, c in zip(members, range(len(members)), strict=True):
            data = np.frombuffer(b"".join(self.items[k][1] for k in own) + b"\0", np.uint8)
            ends = np.cumsum(lengths[own])
            got = [self.embed(data, ends - lengths[own], ends, r, [c])[c] for r in range(self.repeats)]
            joined = np.concatenate(got)
            order = np.argsort(joined, kind="stable")
            self.keys.append(joined[order])
            self.owners.append(np.tile(own, self.repeats)[order])
        self._places(plain, klass)

    def _places(self, plain: list[np.ndarray], klass: np.ndarray) -> None:
        """Where in its item each gram stands, by class, and how many a match keeps at least.

        Of the grams that occur once in an item a match keeps ``need`` or more, each at its place give or take
        the edits. An item that may keep none of them (it repeats itself) is looked for at every place instead.
        """
        self.need = np.full(len(self.classes), np.iinfo(np.int64).max)
        self.looped = np.zeros(len(self.classes), np.int64)
        gram, owner, offset, loops = [], [], [], []
        for k, g in enumerate(plain):
            values, first, count = np.unique(g, return_index=True, return_counts=True)
            once = first[count == 1]
            need, c = int(self.kept[k]) - (len(g) - len(once)), int(klass[k])
            if need >= 1:
                self.need[c] = min(self.need[c], need)
                gram.append(g[once])
                owner.append(np.full(len(once), c))
                offset.append(once)
            else:
                loops.append(values)
                least = int(self.kept[k])
                self.looped[c] = least if not self.looped[c] else min(self.looped[c], least)
        joined = [np.concatenate(x) if x else np.empty(0, t) for x, t in ((gram, U64), (owner, np.int64), (offset, np.int64))]
        order = np.lexsort(joined[::-1])
        joined = [x[order] for x in joined]
        new = np.ones(len(order), dtype=bool)  # items that share a gram at one place share its row
        new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in joined]) if len(order) else new[1:]
        self.gram, self.gram_class, self.gram_place = (x[new] for x in joined)
        self.loops = np.unique(np.concatenate(loops)) if loops else np.empty(0, U64)
        self.table = np.zeros(1 << _TABLE, dtype=bool)
        self.table[(self.gram >> U64(64 - _TABLE)).astype(np.int64)] = True
        self.table[(self.loops >> U64(64 - _TABLE)).astype(np.int64)] = True

    def _walk(self, repeat: int, low: int, high: int) -> np.ndarray:
        """Random bits of the steps low to high of a walk, by the byte that is read: hashed, so nothing is stored."""
        with np.errstate(over="ignore"):
            step = mix(np.arange(low, high, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(self.seed * 1_000_003 + repeat))
            return (mix(step[:, None] + np.arange(1, 257, dtype=U64) * U64(0xD1B54A32D192ED03)) >> U64(63)).astype(np.uint8)

    def embed(self, data: np.ndarray, at: np.ndarray, ends: np.ndarray, repeat: int, classes: Sequence[int]) -> dict[int, np.ndarray]:
        """Keys of the strings that start at ``at`` and end at ``ends`` under one walk, by class.

        A walk stays at a place or goes on by the random bit of the step and the byte; behind the end it reads
        zeros. Memory: EMBED bytes of windows side by side, whatever the length of the items.
        """
        want: dict[int, list[tuple[int, int]]] = {}
        for c in classes:
            for k, step in enumerate(self.classes[c][2][repeat].tolist()):
                want.setdefault(step, []).append((c, k))
        out = {c: np.full(len(at), np.uint64((c << 16) | repeat), U64) for c in classes}
        factors = stream(0xB17, SAMPLES) | U64(1)
        steps = max(want, default=-1) + 1
        width = steps + 1
        side = max(1, min(2048, EMBED // width))  # so many windows side by side stay in the cache
        for turn in range(0, len(at), side):
            own = slice(turn, turn + side)
            place = at[own, None] + np.arange(width, dtype=np.int64)
            block = np.where(place < ends[own, None], data[np.minimum(place, len(data) - 1)], 0).astype(np.uint8).ravel()
            here = np.arange(len(at[own]), dtype=np.int64) * width
            with np.errstate(over="ignore"):
                for low in range(0, steps, 1024):
                    walk = self._walk(repeat, low, min(steps, low + 1024))
                    for step in range(low, low + len(walk)):
                        byte = block.take(here)
                        for c, k in want.get(step, ()):
                            out[c][own] = mix(out[c][own] + (byte.astype(U64) + U64(1)) * factors[k])
                        here += walk[step - low].take(byte)
        return out

    def windows(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, place in it, class) of the windows that may hold an item, at whatever byte they start.

        ``data`` holds the texts from ``starts`` to ``ends``. A gram of an item says where the item would start.
        By the gram lemma a match has ``need`` such sayings that differ by its edits at most, so a place is left
        out only if fewer lie within twice the edits about it.
        """
        none = np.empty(0, np.int64)
        g = grams(data)
        p = np.flatnonzero(self.table[(g >> U64(64 - _TABLE)).astype(np.int64)]) if len(g) else none
        low, high = np.searchsorted(self.gram, g[p], "left"), np.searchsorted(self.gram, g[p], "right")
        n = high - low
        said = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum())) if len(p) else none
        place, c = np.repeat(p, n) - self.gram_place[said], self.gram_class[said]
        owner = np.repeat(np.searchsorted(ends, p, "right"), n)
        if len(said):
            group = owner * len(self.classes) + c
            key = (group << 32) + (place - starts[owner] + (1 << 30))
            key.sort()
            c = (key >> 32) % len(self.classes)
            reach = 2 * np.array([x[1] for x in self.classes])[c]
            votes = np.searchsorted(key, key + reach, "right") - np.searchsorted(key, key - reach, "left")
            key = np.unique(key[votes >= self.need[c]])
            owner, c = np.divmod(key >> 32, len(self.classes))
            place = np.maximum((key & ((1 << 32) - 1)) - (1 << 30), 0)
        else:
            owner = place = c = none
        if len(self.loops) and len(p):
            hit = np.zeros(len(g), dtype=bool)
            hit[p] = self.loops[np.minimum(np.searchsorted(self.loops, g[p]), len(self.loops) - 1)] == g[p]
            total = np.concatenate((np.zeros(1, np.int64), np.cumsum(hit)))
            every = np.arange(len(hit))
            for k in np.flatnonzero(self.looped).tolist():
                at = np.flatnonzero(total[np.minimum(every + self.classes[k][0], len(hit))] - total[every] >= self.looped[k])
                own = np.searchsorted(ends, at, "right")
                owner, place, c = (np.concatenate(x) for x in ((owner, own), (place, np.maximum(at - starts[own], 0)), (c, np.full(len(at), k))))
        return owner, place, c

    def search(self, texts: list[bytes]) -> list[list[int]]:
        """For each text, the ids of the items in it."""
        found: list[set[int]] = [set() for _ in texts]
        rows: list[np.ndarray] = []
        for i, j in chunks(texts, 1 << 18):
            ends = np.cumsum([len(t) + 1 for t in texts[i:j]])
            starts = ends - np.array([len(t) + 1 for t in texts[i:j]])
            owner, place, c = self.windows(np.frombuffer(b"\0".join(texts[i:j]) + b"\0", np.uint8), starts, ends)
            rows.append(np.stack((owner + i, place, c)))
        every = np.concatenate(rows, axis=1) if rows else np.empty((3, 0), np.int64)
        for group in self.groups:
            own = every[:2, np.isin(every[2], group)]
            if own.shape[1]:
                own = np.unique(own, axis=1)
                # texts with windows side by side, so that one walk takes all windows
                some, owner = np.unique(own[0], return_inverse=True)
                for k, items in zip(some.tolist(), self._verify([texts[k] for k in some.tolist()], owner, own[1], group), strict=True):
                    found[k] |= items
        if self.short:
            seek = self._automaton()
            for k, t in enumerate(texts):
                for _, ids in seek.iter(t.decode("latin-1")):
                    found[k].update(ids)
        return [sorted(x) for x in found]

    def _automaton(self) -> ahocorasick.Automaton:
        """Items of under GRAM bytes, byte by byte."""
        seek = ahocorasick.Automaton()
        for t, ids in self.short.items():
            seek.add_word(t.decode("latin-1"), ids)
        seek.make_automaton()
        return seek

    def _verify(self, texts: list[bytes], owner: np.ndarray, place: np.ndarray, group: Sequence[int]) -> list[set[int]]:
        """Embed the windows at these places of the texts; check by edit distance what meets an item."""
        found: list[set[int]] = [set() for _ in texts]
        data = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        starts = np.cumsum(sizes + 1) - sizes - 1
        hashes = grams(data)
        seen: set[tuple[int, int]] = set()

        def check(w: int, k: int) -> None:
            d, at = int(owner[w]), int(place[w])
            item, t = self.items[k]
            if item in found[d] or (w, k) in seen:
                return
            seen.add((w, k))
            most, base = int(self.edits[k]), int(starts[d])
            near, own = hashes[base + max(0, at - most) : base + at + len(t) + 2 * most - GRAM + 1], self.own[k]
            held = own[np.minimum(np.searchsorted(own, near), len(own) - 1)] == near
            if int(held.sum()) >= self.kept[k] and distance_within(t, texts[d][max(0, at - most) : at + len(t) + 2 * most], most) is not None:
                found[d].add(item)

        at, ends = starts[owner] + place, (starts + sizes)[owner]
        for r in range(self.repeats):
            for c, keys in self.embed(data, at, ends, r, group).items():
                low, high = np.searchsorted(self.keys[c], keys, "left"), np.searchsorted(self.keys[c], keys, "right")
                for w in np.flatnonzero(low < high).tolist():
                    for k in self.owners[c][low[w] : high[w]].tolist():
                        check(w, k)
        return found


def find_items(df: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", out: str = "items") -> DataFrame:
    """The rows, all columns, with an array column of the ids of items found in the text.

    Items go through the corpus in blocks of BLOCK_ITEMS or BLOCK_BYTES, one pass each over rows that stay where
    they are; a block's index is made once and broadcast, so what is sent is bounded. Nothing is shuffled. A null or
    empty text holds nothing, a null or empty item is nowhere; an item of under GRAM bytes is found as it
    stands, anywhere. Items that repeat an id are looked for each, equal ids are told once. A long text or item
    takes time and its own length in memory. An existing column of that name is replaced. Item ids must not be null.
    """
    df = df.drop(out) if out in df.columns else df
    names = df.columns
    df, (text,) = positional(df, text)
    columns, place = df.columns, df.columns.index(text)
    df = df.withColumn(out, F.array().cast("array<long>"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    context = df.sparkSession.sparkContext

    def finder(block: list[tuple[int, str | None]]):
        sent = context.broadcast(Index(block))

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for batch in batches:
                found = index.search([normal(t) for t in batch.column(place).to_pylist()])
                before = batch.column(len(columns)).to_pylist()
                new = pa.array([sorted({*a, *b}) for a, b in zip(before, found, strict=True)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(columns))), new], names=batch.schema.names)

        return tidied(find)

    block: list[tuple[int, str | None]] = []
    held = 0
    for row in items.select(F.col(item).cast("long"), item_text).where(F.col(item).isNotNull()).orderBy(item).toLocalIterator():
        block.append((row[0], row[1]))
        held += len(row[1] or "")
        if len(block) == BLOCK_ITEMS or held > BLOCK_BYTES:
            df, block, held = df.mapInArrow(finder(block), schema), [], 0
    df = df.mapInArrow(finder(block), schema) if block else df
    return df.toDF(*names, out)


def keep_clean(df: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The rows whose text holds no item, with the columns they came with; nulls and empties as in find_items."""
    rows, (text,) = positional(df, text)
    return find_items(rows, items, text).where(F.size("items") == 0).select(*rows.columns).toDF(*df.columns)
