"""Error-bounded coding of leaves: whole batches of leaves at once in numpy, verified before a form is chosen.

Forms are raw, all zero, one value, steps of a power of two (the tolerance), such steps with exceptions
kept exactly, and rounded mantissas. Every form is decoded and checked under the strict policy; the
smallest that passes wins if it saves 3 % at least, else the leaf stays raw.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.values import BOUND, INTERNAL_BOUND
from ..meta import VolumeMeta

RAW, ZERO, CONSTANT, STEPS, EXCEPTIONS, MANTISSA = range(6)
NAMES = ("raw", "zero", "constant", "steps", "exceptions", "mantissa")
#: Optional exceptions that are tried, exceptions of both kinds at most, mantissa bits, gain that a form must bring.
OPTIONAL, MOST_EXCEPTIONS, MANTISSA_BITS, LEAST_GAIN = (0, 1, 2, 4, 8, 16), 24, 10, 0.03
_HEAD = 7
_TINY = np.float32(1.1754944e-38)


def _inside(mask: np.ndarray, cells: int) -> np.ndarray:
    return (mask.astype(np.int64).view(np.uint64)[:, None] >> np.arange(cells, dtype=np.uint64)) & np.uint64(1) == 1


def passes(ref: np.ndarray, got: np.ndarray, bound: float = BOUND) -> np.ndarray:
    """The strict policy, element by element."""
    r, g = ref.astype(np.float64), got.astype(np.float64)
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        near = np.where(r == 0, g == 0, np.abs(g - r) < bound * np.abs(r))
    odd = ~np.isfinite(r) | ~np.isfinite(g)
    return np.where(odd, (np.isnan(r) & np.isnan(g)) | (r == g), near)


def _steps(values: np.ndarray, inside: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, ...]:
    """(exponent, least step, width, steps, decoded) with the cells in ``exact`` filled by the mean of the rest."""
    free = inside & ~exact
    v = values.astype(np.float64)
    size = np.where(free, np.abs(v), np.inf).min(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        exponent = np.where(np.isfinite(size), np.floor(np.log2(np.where(np.isfinite(size), size, 1.0) * INTERNAL_BOUND)), 0).astype(np.int64)
    exponent = np.clip(exponent, -1000, 1000)
    count = np.maximum(free.sum(axis=1), 1)
    mean = np.where(free, v, 0.0).sum(axis=1) / count
    filled = np.where(free, v, mean[:, None])
    steps = np.rint(np.ldexp(filled, (-exponent - 1)[:, None]))
    wide = np.abs(steps).max(axis=1) >= 2**31
    steps = np.where(wide[:, None], 0, steps).astype(np.int64)
    low = steps.min(axis=1)
    span = steps.max(axis=1) - low
    width = np.ceil(np.log2(span + 1.0)).astype(np.int64)
    decoded = np.ldexp(steps.astype(np.float64), (exponent + 1)[:, None]).astype(np.float32)
    return exponent, low, np.where(wide, 99, width), steps - low[:, None], decoded


def _bits(numbers: np.ndarray, width: int) -> np.ndarray:
    """Rows of numbers as rows of bytes, ``width`` bits each."""
    if not width:
        return np.empty((len(numbers), 0), np.uint8)
    bits = (numbers[:, :, None] >> np.arange(width)) & 1
    return np.packbits(bits.astype(np.uint8).reshape(len(numbers), numbers.shape[1] * width), axis=1, bitorder="little")


def _numbers(raw: np.ndarray, width: int, cells: int) -> np.ndarray:
    if not width:
        return np.zeros((len(raw), cells), np.int64)
    bits = np.unpackbits(raw, axis=1, count=cells * width, bitorder="little").reshape(len(raw), cells, width).astype(np.int64)
    return (bits << np.arange(width)).sum(axis=2)


def _rounded(values: np.ndarray) -> np.ndarray:
    """Float bits with the mantissa rounded to MANTISSA_BITS, shifted down."""
    drop = 23 - MANTISSA_BITS
    bits = values.view(np.uint32).astype(np.int64)
    return (bits + (1 << (drop - 1))) >> drop


def encode_leaves(values: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """(form of each leaf, payloads) for float32 rows of one leaf each and their masks."""
    n, cells = values.shape
    inside = _inside(mask, cells)
    with np.errstate(invalid="ignore"):
        special = inside & (~np.isfinite(values) | (np.abs(values) < _TINY))
    raw_size = cells * 4
    best, size = np.full(n, RAW), np.full(n, raw_size)
    chosen: dict[int, np.ndarray] = {}

    def offer(form: int, bytes_: np.ndarray, good: np.ndarray, slot: int) -> None:
        take = good & (bytes_ < size) & (bytes_ <= raw_size * (1 - LEAST_GAIN))
        best[take], size[take] = form, bytes_[take]
        chosen[slot] = take
        for k in chosen:
            if k != slot:
                chosen[k] = chosen[k] & ~take

    plain = np.where(inside, values, np.float32(0))
    offer(ZERO, np.zeros(n, int), (plain == 0).all(axis=1), -3)
    first = values[np.arange(n), inside.argmax(axis=1)]
    offer(CONSTANT, np.full(n, 4), ((values.view(np.uint32) == first.view(np.uint32)[:, None]) | ~inside).all(axis=1), -2)
    kept = {}
    order = np.argsort(np.where(inside & ~special, np.abs(values), np.inf), axis=1, kind="stable")
    for k in OPTIONAL:
        exact = special.copy()
        if k:
            np.put_along_axis(exact, order[:, :k], True, axis=1)
            exact &= inside
        number = exact.sum(axis=1)
        exponent, low, width, steps, decoded = _steps(values, inside, exact)
        good = (passes(values, decoded, INTERNAL_BOUND) | exact | ~inside).all(axis=1) & (width <= 32) & (number <= MOST_EXCEPTIONS) & (inside & ~exact).any(axis=1)
        packed = _HEAD + (cells * width + 7) // 8
        kept[k] = (exact, exponent, low, width, steps)
        if k == 0:
            offer(STEPS, packed, good & (number == 0), 0)
        offer(EXCEPTIONS, packed + 8 + 4 * number, good & (number > 0), k + 100)
    top = _rounded(values)
    shown = ((top << (23 - MANTISSA_BITS)) & 0xFFFFFFFF).astype(np.uint32).view(np.float32)
    offer(MANTISSA, np.full(n, (cells * (9 + MANTISSA_BITS) + 7) // 8), (passes(values, shown, INTERNAL_BOUND) | ~inside).all(axis=1) & ~special.any(axis=1), -1)

    payloads: list[bytes] = [b""] * n
    for k in np.flatnonzero(best == RAW).tolist():
        payloads[k] = values[k].tobytes()
    for k in np.flatnonzero(best == CONSTANT).tolist():
        payloads[k] = first[k].tobytes()
    rows = np.flatnonzero(best == MANTISSA)
    for k, b in zip(rows.tolist(), _bits(top[rows] & ((1 << (9 + MANTISSA_BITS)) - 1), 9 + MANTISSA_BITS), strict=True):
        payloads[k] = b.tobytes()
    for slot, take in chosen.items():
        if slot < 0:
            continue
        exact, exponent, low, width, steps = kept[slot - 100 if slot >= 100 else slot]
        for w in np.unique(width[take]).tolist():
            rows = np.flatnonzero(take & (width == w))
            for k, b in zip(rows.tolist(), _bits(steps[rows], w), strict=True):
                head = int(exponent[k]).to_bytes(2, "little", signed=True) + int(low[k]).to_bytes(4, "little", signed=True) + bytes([w])
                tail = b""
                if slot >= 100:
                    at = int((exact[k].astype(np.uint64) << np.arange(cells, dtype=np.uint64)).sum())
                    tail = at.to_bytes(8, "little") + values[k][exact[k]].tobytes()
                payloads[k] = head + b.tobytes() + tail
    return best, payloads


def decode_leaf(form: int, payload: bytes, mask: int, cells: int = 64) -> np.ndarray:
    """Values of a leaf; cells outside the volume are zero. A payload of a wrong length is an error."""
    inside = _inside(np.array([mask]), cells)[0]

    def need(ok: bool) -> None:
        if not ok:
            raise ValueError(f"damaged {NAMES[form] if 0 <= form < 6 else form} record of {len(payload)} bytes")

    need(form in range(6))
    if form == ZERO:
        need(not payload)
        out = np.zeros(cells, np.float32)
    elif form == CONSTANT:
        need(len(payload) == 4)
        out = np.full(cells, np.frombuffer(payload, np.float32)[0])
    elif form == RAW:
        need(len(payload) == 4 * cells)
        out = np.frombuffer(payload, np.float32).copy()
    elif form == MANTISSA:
        width = 9 + MANTISSA_BITS
        need(len(payload) == (cells * width + 7) // 8)
        got = _numbers(np.frombuffer(payload, np.uint8)[None], width, cells)[0]
        out = (got << (23 - MANTISSA_BITS)).astype(np.uint32).view(np.float32).copy()
    else:
        need(len(payload) >= _HEAD)
        exponent, low, width = int.from_bytes(payload[:2], "little", signed=True), int.from_bytes(payload[2:6], "little", signed=True), payload[6]
        end = _HEAD + (cells * width + 7) // 8
        need(width <= 32 and len(payload) >= end)
        got = _numbers(np.frombuffer(payload[_HEAD:end], np.uint8)[None], width, cells)[0] + low
        out = np.ldexp(got.astype(np.float64), exponent + 1).astype(np.float32)
        if form == STEPS:
            need(len(payload) == end)
        else:
            need(len(payload) >= end + 8)
            exact = _inside(np.array([int.from_bytes(payload[end : end + 8], "little", signed=True)]), cells)[0]
            need(len(payload) == end + 8 + 4 * int(exact.sum()))
            out[exact] = np.frombuffer(payload[end + 8 :], np.float32)
    return np.where(inside, out, np.float32(0))


def encode(leaves: DataFrame) -> DataFrame:
    """Leaves (sb_id, morton, values, mask) as records (sb_id, morton, mask, codec, size, payload)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(batch.num_rows, -1)
            form, payloads = encode_leaves(values, batch.column(3).to_numpy())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3), pa.array(form.astype(np.int8)), pa.array([len(p) for p in payloads], pa.int32()), pa.array(payloads, pa.binary())],
                names=["sb_id", "morton", "mask", "codec", "size", "payload"],
            )

    return leaves.select("sb_id", "morton", "values", "mask").mapInArrow(run, "sb_id long, morton long, mask long, codec byte, size int, payload binary")


def decode(records: DataFrame, cells: int = 64) -> DataFrame:
    """Records as leaves (sb_id, morton, values, mask)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [decode_leaf(f, p, m, cells) for f, p, m in zip(*(batch.column(k).to_pylist() for k in (3, 5, 2)), strict=True)]
            offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * cells)
            flat = pa.array(np.concatenate(rows) if rows else np.empty(0, np.float32), pa.float32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(offsets, flat), batch.column(2)], names=["sb_id", "morton", "values", "mask"])

    return records.select("sb_id", "morton", "mask", "codec", "size", "payload").mapInArrow(run, "sb_id long, morton long, values array<float>, mask long")


def write_encoded(meta: VolumeMeta, cells: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write a volume's records, clustered by superblock; nothing stays there if a cell would come back wrong.

    The records are written beside the path, decoded from there and compared with the cells; only then are
    they moved. The comparison is one full join by coordinate.
    """
    from ..functions.values import ErrorPolicy
    from . import leaves, verify

    spark = cells.sparkSession
    records = encode(leaves.pack(meta, cells))
    side = f"{path.rstrip('/')}.unverified"
    records.repartitionByRange("sb_id", "morton").sortWithinPartitions("sb_id", "morton").write.mode("overwrite").parquet(side)
    written = spark.read.parquet(side)
    back = leaves.unpack(meta, decode(written))
    found = verify.summary(verify.paired(cells, back), ErrorPolicy()).first()
    store = spark._jvm.org.apache.hadoop.fs.Path(side).getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        if not found.passed:
            raise ValueError(f"{found.violation_count} cells would break the error bound")
        written.write.mode(mode).parquet(path)
    finally:
        store.delete(spark._jvm.org.apache.hadoop.fs.Path(side), True)
