"""SentencePiece encoding by sampling from the piece lattice, and lossless decoding.

A text's lattice falls apart where no piece can cross: before a run of spaces and round a line feed. Each
such unit is filtered forward once (the total weight of all segmentations up to each character) and sampled
backward for every place it stands at: the last piece first, by its share of the total. The draws depend on
the seed, the row's key, the unit's number and the step, so a row is segmented alike wherever it is run.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, mix, positional, tidied

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SEED = 17
#: Units remembered by a task are dropped beyond so many lattice nodes (about 100 bytes each), and at its end;
#: that costs time, no result.
MAX_NODES = 1_500_000
#: Bits of a hash by which strings that are no piece are passed over, for each length of piece.
SEEN = 17
#: Weight of a byte; longest unit that is filtered together with others and remembered.
RARE, SHORT = 1e-5, 40
#: Bytes of text that are encoded together, and new units filtered together: memory of a task, no result.
RUN, NEW_UNITS = 1 << 19, 5000
UNIT = re.compile(r"\n| *[^ \n]+| +")


@functools.lru_cache(maxsize=2)
def pieces(model: str) -> tuple[dict[str, tuple[int, float]], list[int], list[bytes]]:
    """Ordinary pieces (spaces for their marks) with id and weight; ids of the bytes; bytes of every id.

    The weight follows Zipf's law in the order of the ids, as the scores of a merge model are ranks.
    """
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    ordinary: dict[str, tuple[int, float]] = {}
    of_byte, spelled = [0] * 256, [b""] * sp.vocab_size()
    rank = 0
    for i in range(sp.vocab_size()):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            value = int(piece[1:-1], 16)
            of_byte[value], spelled[i] = i, bytes([value])
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            rank += 1
            text = piece.replace("▁", " ")
            if "\n" in text or " " in text.lstrip(" "):
                raise ValueError("a piece crosses the bounds at which texts are cut")
            ordinary[text], spelled[i] = (i, 1.0 / (rank + 2.7)), text.encode()
    return ordinary, of_byte, spelled


class _Grown:
    """A numpy array that grows at its end."""

    def __init__(self, kind):
        self.data, self.size = np.empty(1 << 16, kind), 0

    def extend(self, values: np.ndarray) -> None:
        need = self.size + len(values)
        if need > len(self.data):
            self.data = np.concatenate((self.data[: self.size], np.empty(max(need, 2 * self.size) - self.size, self.data.dtype)))
        self.data[self.size : need] = values
        self.size = need


class Lattice:
    """Edges of the units seen so far. A node's edges lie together, the longest piece first.

    ``first`` has a node's first edge (-1 where a unit starts); ``share`` the sum of the shares up to an
    edge, ``piece`` its id and ``back`` the node it comes from.
    """

    def __init__(self, model: str):
        self.ordinary, self.of_byte, _ = pieces(model)
        known = dict(self.ordinary)
        for c in map(chr, range(128)):  # one byte is one edge, like a piece
            known.setdefault(c, (self.of_byte[ord(c)], RARE))
        self.known = known
        self.longest = max(map(len, known))
        self.by_length = []
        for n in range(1, self.longest + 1):
            own = [(self._hash(np.array([[ord(c) for c in k]], np.uint64))[0], v) for k, v in known.items() if len(k) == n]
            own.sort()
            marks = np.array([h for h, _ in own], U64)
            seen = np.zeros(1 << SEEN, dtype=bool)
            seen[(marks >> U64(64 - SEEN)).astype(np.int64)] = True
            if len(np.unique(marks)) < len(marks):
                raise ValueError("two pieces share a hash")
            self.by_length.append((seen, marks, np.array([v[0] for _, v in own], np.int32), np.array([v[1] for _, v in own])))
        self.clear()

    @staticmethod
    def _hash(codes: np.ndarray) -> np.ndarray:
        """Hashes of rows of characters."""
        out = np.zeros(len(codes), U64)
        with np.errstate(over="ignore"):
            for k in range(codes.shape[1]):
                out = (out + codes[:, k] + U64(1)) * U64(0x9E3779B97F4A7C15)
            return mix(out)

    def clear(self) -> None:
        self.last: dict[str, int] = {}
        self.first, self.share, self.piece, self.back = _Grown(np.int32), _Grown(np.float32), _Grown(np.int32), _Grown(np.int32)

    def _store(self, node: np.ndarray, length: np.ndarray, weight: np.ndarray, piece: np.ndarray, back: np.ndarray, nodes: int) -> None:
        """Take edges into new nodes 0 to nodes - 1 (back counts from there too); nodes without edges start units.

        The longest piece of a node comes first.
        """
        base = self.first.size
        order = np.argsort(node * 64 - np.minimum(length, 63), kind="stable")
        node, weight, piece, back = node[order], weight[order], piece[order], back[order]
        number = np.bincount(node, minlength=nodes)
        begin = np.cumsum(number) - number
        share, some, total = weight.astype(np.float64), np.flatnonzero(number), np.zeros(nodes)
        rest = some
        for k in range(int(number.max(initial=0))):  # in this order whatever else is in the batch
            rest = rest[number[rest] > k]
            total[rest] += weight[begin[rest] + k]
            share[begin[rest] + k] = total[rest]
        share /= total[node]
        share[(begin + number - 1)[some]] = 2.0
        self.first.extend(np.where(number > 0, begin + self.share.size, -1))
        self.share.extend(share)
        self.piece.extend(piece)
        self.back.extend(back + base)

    def add(self, units: list[str]) -> list[int]:
        """Forward filtering of new units; returns their last nodes."""
        out = [-1] * len(units)
        plain = [k for k, u in enumerate(units) if len(u) <= SHORT and (u.isascii() or all(c in self.known for c in u))]
        if plain:
            sizes = np.array([len(units[k]) for k in plain])
            codes = np.frombuffer("".join(units[k] for k in plain).encode("utf-32-le"), np.uint32).astype(U64)
            start = np.cumsum(sizes) - sizes
            unit = np.repeat(np.arange(len(plain)), sizes)
            room = np.repeat(start + sizes, sizes) - np.arange(len(codes))  # characters from here to the unit's end
            alpha = np.zeros((len(plain), int(sizes.max()) + 1))
            alpha[:, 0] = 1.0
            found = []
            rolled = np.zeros(len(codes), U64)
            for n, (seen, marks, ids, weights) in enumerate(self.by_length, 1):
                at = np.flatnonzero(room >= n)
                if not len(at):
                    break
                with np.errstate(over="ignore"):
                    rolled[at] = (rolled[at] + codes[at + n - 1] + U64(1)) * U64(0x9E3779B97F4A7C15)
                    h = mix(rolled[at])
                may = seen[(h >> U64(64 - SEEN)).astype(np.int64)]
                at, h = at[may], h[may]
                where = np.minimum(np.searchsorted(marks, h), len(marks) - 1)
                same = marks[where] == h
                at, where = at[same], where[same]
                found.append((at, np.full(len(at), n), ids[where], weights[where]))
            at, n, piece, weight = (np.concatenate(x) for x in zip(*found, strict=True))
            begin = at - start[unit[at]]
            end, own = begin + n, unit[at]
            order = np.lexsort((n, end))
            cuts = np.searchsorted(end[order], np.arange(1, int(sizes.max()) + 2))
            for k in range(int(sizes.max())):  # all units a character further
                e = order[cuts[k] : cuts[k + 1]]
                alpha[:, k + 1] = np.bincount(own[e], alpha[own[e], begin[e]] * weight[e], len(plain))
            base = np.cumsum(sizes + 1) - (sizes + 1)
            offset = self.first.size
            self._store(base[own] + end, n, alpha[own, begin] * weight, piece, base[own] + begin, int((sizes + 1).sum()))
            for k, node in zip(plain, (base + sizes + offset).tolist(), strict=True):
                out[k] = node
        for k, u in enumerate(units):
            if out[k] < 0:
                out[k] = self._add_long(u)
        return out

    def _add_long(self, unit: str) -> int:
        """A unit that is long, or has characters without a piece: these go by their bytes, one after the other."""
        nodes, alpha, made = [0], [1.0], 1
        edges: list[tuple[int, int, float, int, int]] = []
        for end in range(1, len(unit) + 1):
            total, own = 0.0, []
            for begin in range(max(0, end - self.longest), end):
                got = self.known.get(unit[begin:end])
                if got:
                    weight = alpha[begin] * got[1]
                    total += weight
                    own.append((end - begin, weight, got[0], nodes[begin]))
            if unit[end - 1] not in self.known:
                weight, back = alpha[end - 1] * RARE, nodes[end - 1]
                raw = unit[end - 1].encode()
                for value in raw[:-1]:
                    edges.append((made, 1, 1.0, self.of_byte[value], back))
                    back, made = made, made + 1
                total += weight
                own.append((1, weight, self.of_byte[raw[-1]], back))
            edges += [(made, *e) for e in own]
            nodes.append(made)
            made += 1
            alpha.append(total)
            if total < 1e-200:  # only ratios of the latest weights matter
                low = max(0, len(alpha) - self.longest - 1)
                alpha[low:] = [a * 1e200 for a in alpha[low:]]
        node, length, weight, piece, back = (np.array(x) for x in zip(*edges, strict=True))
        offset = self.first.size
        self._store(node, length, weight, piece, back, made)
        return nodes[-1] + offset

    def sample(self, units: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece ids of all units in order, pieces of each unit); keys: a 64-bit state of each unit."""
        if self.first.size > MAX_NODES:
            self.clear()
        get = self.last.get
        node = np.fromiter((get(u, -1) for u in units), np.int64, len(units))
        missing = np.flatnonzero(node < 0)
        if len(missing):
            new = list(dict.fromkeys(units[k] for k in missing.tolist()))
            found: dict[str, int] = {}
            for low in range(0, len(new), NEW_UNITS):
                some = new[low : low + NEW_UNITS]
                found.update(zip(some, self.add(some), strict=True))
            node[missing] = np.fromiter((found[units[k]] for k in missing.tolist()), np.int64, len(missing))
            self.last.update((u, at) for u, at in found.items() if len(u) <= SHORT)
        first, share, piece, back = self.first.data, self.share.data, self.piece.data, self.back.data
        live, got, step = np.arange(len(units)), [], 0
        count = np.zeros(len(units), np.int64)
        while len(live):
            with np.errstate(over="ignore"):
                draw = (mix(keys[live] + U64(step) * U64(0x9E3779B97F4A7C15)) >> U64(11)) * (1.0 / (1 << 53))
            edge = first[node].astype(np.int64)
            late = np.flatnonzero(draw >= share[edge])
            while len(late):
                edge[late] += 1
                late = late[draw[late] >= share[edge[late]]]
            got.append((live, piece[edge]))
            count[live] += 1
            node = back[edge]
            on = first[node] >= 0
            live, node, step = live[on], node[on], step + 1
        ends = np.cumsum(count)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
        for k, (where, ids) in enumerate(got):
            out[ends[where] - 1 - k] = ids
        return out, count


@functools.lru_cache(maxsize=1)
def lattice(model: str) -> Lattice:
    """The lattice of this Python process. Its tables of pieces stay (some MB); a task clears the units it met."""
    return Lattice(model)


def _with(df: DataFrame, column: str, kind: str, make) -> DataFrame:
    """The rows with one more column (one of that name is replaced) made of whole batches."""
    df = df.drop(column) if column in df.columns else df
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"`{column}` {kind}"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        try:
            for batch in batches:
                for low, high in step.cuts(batch):
                    part = batch.slice(low, high - low)
                    yield pa.RecordBatch.from_arrays([*part.columns, step(part)], names=[*batch.schema.names, column])
        finally:
            step.close()

    return df.mapInArrow(tidied(run), schema)


class _Encode:
    def __init__(self, text: int, key: int, model: str, seed: int):
        self.text, self.key, self.seed, self.lattice = text, key, seed, lattice(model)

    def close(self) -> None:
        """A worker process outlives its task: what the task remembered must not stay with it."""
        self.lattice.clear()

    def cuts(self, batch: pa.RecordBatch) -> list[tuple[int, int]]:
        """Runs of rows of about RUN bytes of text."""
        out, low, held = [], 0, 0
        for k, n in enumerate(pc.binary_length(batch.column(self.text)).to_pylist()):
            if held > RUN:
                out.append((low, k))
                low, held = k, 0
            held += n or 0
        return [*out, (low, batch.num_rows)] if batch.num_rows else []

    def __call__(self, batch: pa.RecordBatch) -> pa.Array:
        texts = batch.column(self.text).to_pylist()
        key = batch.column(self.key).to_numpy(zero_copy_only=False).astype(np.int64).view(U64)
        # the mark that stands before a text is part of its first unit
        cut = [UNIT.findall(" " + t) if t else [] for t in texts]
        n = np.array([len(c) for c in cut], dtype=np.int64)
        number = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        with np.errstate(over="ignore"):
            states = mix(mix(np.repeat(key, n) + U64(self.seed)) + number.astype(U64) * U64(0xD1B54A32D192ED03))
        ids, count = self.lattice.sample([u for c in cut for u in c], states)
        ends = np.concatenate(([0], np.cumsum(count)))[np.concatenate(([0], np.cumsum(n)))]
        nulls = np.array([t is None for t in texts])
        offsets = pa.array(ends.astype(np.int32), pa.int32(), mask=np.concatenate((nulls, [False])))
        return pa.ListArray.from_arrays(offsets, pa.array(ids))


class _Decode:
    def __init__(self, ids: int, model: str):
        self.ids, self.spelled = ids, pa.array(pieces(model)[2], pa.large_binary())

    def close(self) -> None:
        pass

    def cuts(self, batch: pa.RecordBatch) -> list[tuple[int, int]]:
        return [(k, min(k + 1000, batch.num_rows)) for k in range(0, batch.num_rows, 1000)]

    def __call__(self, batch: pa.RecordBatch) -> pa.Array:
        column = batch.column(self.ids)
        spelled = self.spelled.take(column.flatten())
        # a row's text is the run of its pieces' bytes: the joined buffer, cut at the rows' ends
        ends = np.concatenate(([0], np.cumsum(np.nan_to_num(pc.list_value_length(column).to_numpy(zero_copy_only=False)).astype(np.int64))))
        at = np.frombuffer(spelled.buffers()[1], np.int64)[: len(spelled) + 1][ends] if len(spelled) else np.zeros(len(ends), np.int64)
        whole = np.frombuffer(spelled.buffers()[2] or b"", np.uint8)[: at[-1]]
        marks = np.diff(at) > 0  # the mark that stands before a text goes
        rest = np.delete(whole, at[:-1][marks])
        at = at - np.concatenate(([0], np.cumsum(marks)))
        texts = pa.LargeStringArray.from_buffers(len(column), pa.py_buffer(at), pa.py_buffer(rest)).cast(pa.string())
        return pc.if_else(column.is_valid(), texts, pa.scalar(None, pa.string()))


def encode(df: DataFrame, text: str = "text", key: str = "doc_id", out: str = "ids", model: str = MODEL, seed: int = SEED) -> DataFrame:
    """The rows, all columns, with the ids of a sampled segmentation of the whole text.

    Rows with equal keys and texts get equal ids. A null text has null ids, an empty one none; a null key
    draws like a key of its own. A column named ``out`` is replaced, all others stay whatever their names.
    A long text is filtered unit by unit. The model's file is opened on every executor by its path.
    """
    df = df.drop(out) if out in df.columns else df
    rows, (text_at, key_at) = positional(df, text, key)
    rows = rows.withColumn("key", F.xxhash64(F.col(key_at)))
    made = _with(rows, "ids", "array<int>", functools.partial(_Encode, rows.columns.index(text_at), len(df.columns), model, seed))
    return made.drop("key").toDF(*df.columns, out)


def decode(df: DataFrame, ids: str = "ids", out: str = "decoded", model: str = MODEL) -> DataFrame:
    """The rows, all columns, with the text that the ids spell: the encoded text, to the byte."""
    place = [c for c in df.columns if c != out]
    return _with(df, out, "string", functools.partial(_Decode, place.index(ids), model))


def _digests(model: str, seed: int):
    """Batches (doc_id, text, key) to the rows of round_trip."""
    names = ["doc_id", "n_bytes", "n_tokens", "ids_hash", "lossless"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _Encode(1, 2, model, seed), _Decode(0, model)
        try:
            for batch in batches:
                for low, high in encoder.cuts(batch):
                    part = batch.slice(low, high - low)
                    ids = encoder(part)
                    spelled = decoder(pa.RecordBatch.from_arrays([ids], names=["ids"]))
                    flat, ends = ids.values.to_numpy(), ids.offsets.to_numpy()
                    marks = [xxhash.xxh3_64_intdigest(flat[a:b].tobytes()) - (1 << 63) for a, b in zip(ends, ends[1:], strict=False)]
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), pc.binary_length(part.column(1)).cast(pa.int64()), pa.array(np.diff(ends).astype(np.int64)), pa.array(marks, pa.int64()), pc.equal(part.column(1), spelled)],
                        names=names,
                    )
        finally:
            encoder.close()

    return tidied(run)


def round_trip(df: DataFrame, key: str = "doc_id", text: str = "text", model: str = MODEL, seed: int = SEED) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, ids_hash, lossless) of every row, after encoding and decoding.

    Both steps of a batch run one after the other in one Python process, and only the digest leaves it.
    ids_hash is that of the ids as little-endian 32 bits; a null text counts as empty.
    """
    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.xxhash64(F.col(key)).alias("_key"))
    return rows.mapInArrow(_digests(model, seed), "doc_id long, n_bytes long, n_tokens long, ids_hash long, lossless boolean")
