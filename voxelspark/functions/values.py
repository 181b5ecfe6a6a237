"""Expressions on float values: classes, tolerances, pointwise error policies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITY = float("inf")
#: Smallest normal binary32, in double. Fixed value.
SMALLEST_NORMAL = 1.1754943508222875e-38
BOUND, INTERNAL_BOUND, ZERO_TOLERANCE, DIVISOR_FLOOR = 1e-3, 7.5e-4, 1e-6, 1e-12


def double(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def is_infinite(c: Column | str) -> Column:
    return F.abs(double(c)) == F.lit(INFINITY)


def is_finite(c: Column | str) -> Column:
    return ~F.isnan(double(c)) & ~is_infinite(c)


def value_class(c: Column | str) -> Column:
    """nan, inf, zero, subnormal or normal."""
    v = double(c)
    return (
        F.when(F.isnan(v), "nan").when(is_infinite(v), "inf").when(v == 0, "zero")
        .when(F.abs(v) < SMALLEST_NORMAL, "subnormal").otherwise("normal")
    )


def is_mandatory(c: Column | str) -> Column:
    """Values that a codec must keep as they are."""
    return value_class(c) != "normal"


def tolerance_exponent(least: Column | str, bound: float = INTERNAL_BOUND) -> Column:
    """floor(log2(bound * least)), exact at powers of two; null where nothing is above zero."""
    t = double(least) * F.lit(bound)
    near = F.floor(F.log2(t)).cast("int")
    down = F.when(F.pow(F.lit(2.0), near) > t, near - 1).otherwise(near)
    return F.when(t > 0, F.when(F.pow(F.lit(2.0), down + 1) <= t, down + 1).otherwise(down))


@dataclass(frozen=True)
class ErrorPolicy:
    """How a reconstructed value is judged.

    ``strict``: specials must match exactly and the relative error stay under the bound. ``legacy``: small
    references are judged by absolute error. ``tool``: the divisor has a floor, errors at the bound fail,
    NaN never fails. ``api``: as tool, but a zero reference is judged absolutely and only errors above fail.
    """

    name: str = "strict"
    bound: float = BOUND
    zero_tolerance: float = ZERO_TOLERANCE

    def absolute(self, ref: Column | str, got: Column | str) -> Column:
        return F.abs(double(got) - double(ref))

    def relative(self, ref: Column | str, got: Column | str) -> Column:
        r, e = double(ref), self.absolute(ref, got)
        if self.name == "tool":
            return e / F.greatest(F.abs(r), F.lit(DIVISOR_FLOOR))
        if self.name == "api":
            return F.when(r == 0, e).otherwise(e / F.when(r == 0, F.lit(1.0)).otherwise(F.abs(r)))
        safe = F.when(r == 0, F.lit(1.0)).otherwise(F.abs(r))
        zero = F.when(double(got) == 0, F.lit(0.0)).otherwise(F.lit(INFINITY))
        return F.when(r == 0, zero).otherwise(e / safe)

    def passes(self, ref: Column | str, got: Column | str) -> Column:
        r, g, rel = double(ref), double(got), self.relative(ref, got)
        if self.name == "tool":
            near = F.abs(r) <= self.zero_tolerance
            fails = F.when(near, self.absolute(ref, got) > self.zero_tolerance).otherwise(rel >= self.bound)
            return F.isnan(r) | F.isnan(g) | ~fails
        if self.name == "api":
            return F.isnan(r) | F.isnan(g) | ~(rel > self.bound)
        small = F.abs(r) <= self.zero_tolerance
        finite = rel < self.bound
        if self.name == "legacy":
            finite = F.when(small, self.absolute(ref, got) <= self.zero_tolerance).otherwise(finite)
        elif self.name != "strict":
            raise ValueError(f"unknown policy {self.name!r}")
        return (
            F.when(F.isnan(r) | F.isnan(g), F.isnan(r) & F.isnan(g))
            .when(is_infinite(r) | is_infinite(g), is_infinite(r) & (r == g))
            .otherwise(finite)
        )
