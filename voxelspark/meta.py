"""Shape of a volume and the arithmetic of its blocks."""

from __future__ import annotations

from dataclasses import dataclass

AXES = ("x", "y", "z")
#: The two axes that a slice of an axis spreads over, slow one first.
PLANE = {"x": ("y", "z"), "y": ("x", "z"), "z": ("x", "y")}
MAX_LEAVES, MAX_LEAF = 65_536, 255
BYTES = 4


def ceil_div(n: int, d: int) -> int:
    return -(-n // d)


def align_up(n: int, to: int = 4096) -> int:
    return ceil_div(n, to) * to


@dataclass(frozen=True)
class VolumeMeta:
    """Dimensions, superblock and leaf sizes of a dense float32 volume, Z fastest.

    ``held``: the cells of a volume that ends inside its last X plane, where it is not filled; otherwise there are all.
    """

    nx: int
    ny: int
    nz: int
    super_block: tuple[int, int, int] = (64, 64, 64)
    leaf: tuple[int, int, int] = (4, 4, 4)
    held: int | None = None

    def __post_init__(self):
        if min(self.dims) < 1:
            raise ValueError(f"dimensions must be positive: {self.dims}")
        if any(f < 1 or f > MAX_LEAF or s % f for s, f in zip(self.super_block, self.leaf, strict=True)):
            raise ValueError(f"a superblock {self.super_block} is not made of whole leaves {self.leaf}")
        if self.leaves_per_block > MAX_LEAVES:
            raise ValueError(f"more than {MAX_LEAVES} leaves in a superblock")
        whole = self.nx * self.ny * self.nz
        if self.held is not None and not whole - self.ny * self.nz < self.held <= whole:
            raise ValueError(f"{self.held} cells do not end in the last plane of {self.dims}")
        if self.bytes >= 1 << 63:
            raise OverflowError("the volume's size does not fit a long")

    @property
    def dims(self) -> tuple[int, int, int]:
        return self.nx, self.ny, self.nz

    @property
    def cells(self) -> int:
        return self.nx * self.ny * self.nz if self.held is None else self.held

    @property
    def bytes(self) -> int:
        return self.cells * BYTES

    @property
    def grid(self) -> tuple[int, int, int]:
        """Superblocks along each axis."""
        return tuple(ceil_div(n, s) for n, s in zip(self.dims, self.super_block, strict=True))

    @property
    def leaf_grid(self) -> tuple[int, int, int]:
        return tuple(ceil_div(n, f) for n, f in zip(self.dims, self.leaf, strict=True))

    @property
    def leaves_per_block(self) -> int:
        x, y, z = (s // f for s, f in zip(self.super_block, self.leaf, strict=True))
        return x * y * z

    def size(self, axis: str) -> int:
        return self.dims[AXES.index(axis)]

    def plane(self, axis: str) -> tuple[int, int]:
        """Shape of a slice of the axis."""
        return tuple(self.size(a) for a in PLANE[axis])

    def check_index(self, axis: str, index: int) -> int:
        """The index, if it lies in the volume."""
        if axis not in AXES:
            raise ValueError(f"unknown axis {axis!r}")
        if not 0 <= index < self.size(axis):
            raise IndexError(f"{axis} index {index} is not below {self.size(axis)}")
        return index
