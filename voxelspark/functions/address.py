"""Address algebra as Column expressions: linear offsets, block numbers, Morton codes, masks, descriptors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..meta import AXES, PLANE, VolumeMeta

#: (shift, mask) steps that spread 21 bits to every third place. Fixed values of Morton codes.
SPREAD = (
    (32, 0x001F00000000FFFF),
    (16, 0x001F0000FF0000FF),
    (8, 0x100F00F00F00F00F),
    (4, 0x10C30C30C30C30C3),
    (2, 0x1249249249249249),
)
#: A record's descriptor has its codec above 13 bits of size.
SIZE_BITS, MAX_RECORD = 13, 8191


def long(c: Column | str | int) -> Column:
    c = F.lit(c) if isinstance(c, int) else F.col(c) if isinstance(c, str) else c
    return c.cast("long")


def idiv(a: Column | str, b: int) -> Column:
    """Whole division, in longs throughout."""
    return F.call_function("div", long(a), long(b))


def mod(a: Column | str, b: int) -> Column:
    return F.pmod(long(a), long(b))


def linear(meta: VolumeMeta, x="x", y="y", z="z") -> Column:
    """Cell number, Z fastest."""
    return (long(x) * meta.ny + long(y)) * meta.nz + long(z)


def linear_x_fastest(meta: VolumeMeta, x="x", y="y", z="z") -> Column:
    """Cell number of the old layout, X fastest."""
    return (long(z) * meta.ny + long(y)) * meta.nx + long(x)


def byte_offset(meta: VolumeMeta, x="x", y="y", z="z") -> Column:
    return linear(meta, x, y, z) * 4


def plane_offset(meta: VolumeMeta, x="x") -> Column:
    """First byte of an X plane in a raw file."""
    return long(x) * (meta.ny * meta.nz * 4)


def delinear(meta: VolumeMeta, cell="cell") -> tuple[Column, Column, Column]:
    """Coordinates of a cell number, Z fastest."""
    return idiv(cell, meta.ny * meta.nz), mod(idiv(cell, meta.nz), meta.ny), mod(cell, meta.nz)


def morton(x="x", y="y", z="z") -> Column:
    """Morton code of three coordinates of up to 21 bits, x lowest."""

    def spread(c) -> Column:
        out = long(c).bitwiseAND(F.lit(0x1FFFFF))
        for shift, mask in SPREAD:
            out = out.bitwiseOR(F.shiftleft(out, shift)).bitwiseAND(F.lit(mask))
        return out

    return spread(x).bitwiseOR(F.shiftleft(spread(y), 1)).bitwiseOR(F.shiftleft(spread(z), 2))


def unmorton(code="morton") -> tuple[Column, Column, Column]:
    """Coordinates of a Morton code."""

    def gather(c: Column) -> Column:
        out = c.bitwiseAND(F.lit(SPREAD[-1][1]))
        masks = [m for _, m in SPREAD[-2::-1]] + [0x1FFFFF]
        for (shift, _), mask in zip(SPREAD[::-1], masks, strict=True):
            out = out.bitwiseOR(F.shiftright(out, shift)).bitwiseAND(F.lit(mask))
        return out

    return tuple(gather(F.shiftright(long(code), k)) for k in range(3))


def block(meta: VolumeMeta, axis: str) -> Column:
    """Superblock coordinate along an axis."""
    return idiv(axis, meta.super_block[AXES.index(axis)])


def block_id(meta: VolumeMeta, order: str = "zyx") -> Column:
    """Number of the superblock a cell lies in; the first letter of the order is the slowest axis."""
    grid = dict(zip(AXES, meta.grid, strict=True))
    if sorted(order) != list(AXES):
        raise ValueError(f"unknown order {order!r}")
    out = block(meta, order[0])
    for a in order[1:]:
        out = out * grid[a] + block(meta, a)
    return out


def block_coords(meta: VolumeMeta, sb="sb_id", order: str = "zyx") -> dict[str, Column]:
    """Superblock coordinates of a superblock number."""
    grid, rest, out = dict(zip(AXES, meta.grid, strict=True)), long(sb), {}
    for a in reversed(order[1:]):
        out[a], rest = mod(rest, grid[a]), idiv(rest, grid[a])
    return out | {order[0]: rest}


def leaf(meta: VolumeMeta, axis: str) -> Column:
    """Leaf coordinate along an axis of the whole volume: the slab number of the axis."""
    return idiv(axis, meta.leaf[AXES.index(axis)])


def leaf_morton(meta: VolumeMeta) -> Column:
    """Morton code of a cell's leaf inside its superblock."""
    inside = [idiv(mod(a, s), f) for a, s, f in zip(AXES, meta.super_block, meta.leaf, strict=True)]
    return morton(*inside)


def cell_in_leaf(meta: VolumeMeta) -> Column:
    """Place of a cell in its leaf, X fastest."""
    x, y, z = (mod(a, f) for a, f in zip(AXES, meta.leaf, strict=True))
    return (z * meta.leaf[1] + y) * meta.leaf[0] + x


def out_index(meta: VolumeMeta, axis: str) -> Column:
    """Place of a cell in the slice of the axis."""
    a, b = PLANE[axis]
    return long(a) * meta.size(b) + long(b)


def valid_extent(meta: VolumeMeta, axis: str, leaf_number: Column | str) -> Column:
    """Cells of a leaf along an axis that lie in the volume."""
    f = meta.leaf[AXES.index(axis)]
    return F.least(F.lit(f).cast("long"), F.lit(meta.size(axis)).cast("long") - long(leaf_number) * f)


def descriptor(codec="codec", size="size") -> Column:
    """Codec and size of a record in one number; a size beyond 13 bits is an error."""
    fits = (long(size) >= 0) & (long(size) <= MAX_RECORD)
    packed = F.shiftleft(long(codec), SIZE_BITS).bitwiseOR(long(size))
    return F.when(fits, packed).otherwise(F.raise_error(F.lit("record size out of range")).cast("long"))


def descriptor_parts(number="descriptor") -> tuple[Column, Column]:
    return F.shiftright(long(number), SIZE_BITS), long(number).bitwiseAND(F.lit(MAX_RECORD))


def on_stride(axis: str, stride: int, count: int | None = None) -> Column:
    """Is a coordinate one of the planes 0, stride, 2 stride, ... (of which there are ``count``)?"""
    hit = mod(axis, stride) == 0
    return hit if count is None else hit & (idiv(axis, stride) < count)


#: Modulus and multipliers of ``mixed``; products stay inside 64 bits.
MIX_MODULUS, MIX_FACTORS = 1 << 31, (1597334677, 1103515245)


def mixed(number: Column | str, seed: int = 0) -> Column:
    """A number below 2 ** 31 that depends on a number and a seed and looks random; whole-number arithmetic only."""
    h = mod(mod(long(number) + seed * 1_000_003, MIX_MODULUS) * MIX_FACTORS[0], MIX_MODULUS)
    h = h.bitwiseXOR(F.shiftright(h, 15))
    h = mod(h * MIX_FACTORS[1], MIX_MODULUS)
    return h.bitwiseXOR(F.shiftright(h, 13))


def inside(meta: VolumeMeta, axis="axis", index="index") -> Column:
    """Is an index within its axis? Null for an unknown axis."""
    sizes = F.create_map(*(x for a in AXES for x in (F.lit(a), F.lit(meta.size(a)).cast("long"))))
    return (F.col(index) >= 0) & (F.col(index) < sizes[F.col(axis)])
