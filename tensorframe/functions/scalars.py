"""Scalar expressions of the operators."""

from __future__ import annotations

from math import prod

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-9


def saturating_subtract(a: Column, b: Column) -> Column:
    return F.greatest(a - b, F.lit(0).cast("bigint"))


def whole_divide(a: Column, b: Column) -> Column:
    """Quotient of unsigned numbers, without its fraction; null for a zero divisor."""
    return F.when(b != 0, F.floor(F.try_divide((a - F.try_mod(a, b)).cast("decimal(38,0)"), b))).cast("bigint")


def remainder(a: Column, b: Column) -> Column:
    """a - b * whole_divide(a, b); null for a zero divisor."""
    return F.try_mod(a, b)


def parse_unsigned(text: Column) -> Column:
    """Unsigned 64-bit number of a string; null where it is none."""
    n = F.try_to_number(text, F.lit("9" * 20))
    return F.when(text.rlike(r"^\+?[0-9]+$") & (n <= F.lit(str(2**64 - 1)).cast("decimal(20,0)")), n.cast("decimal(20,0)"))


def tolerant_add(a: Column, b: Column) -> Column:
    """a + b; null where operands of opposite sign cancel to less than EPSILON."""
    return F.when((a * b < 0) & (F.abs(a + b) < EPSILON), None).otherwise(a + b)


def tolerant_multiply(a: Column, b: Column) -> Column:
    """a * b; null below EPSILON."""
    return F.when(F.abs(a * b) < EPSILON, None).otherwise(a * b)


def wrap(x: Column, size: Column | int) -> Column:
    """Euclidean remainder."""
    return F.pmod(x, F.lit(size) if isinstance(size, int) else size)


def ceil_div(x: Column, n: int) -> Column:
    return F.floor((x + (n - 1)) / n).cast("bigint")


def relative_difference(a: Column, b: Column) -> Column:
    return F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1e-8))


def linear_index(columns: list[Column], shape: tuple[int, ...]) -> Column:
    """Row-major place of an index tuple."""
    out = F.lit(0).cast("bigint")
    for k, c in enumerate(columns):
        out = out + c * F.lit(prod(shape[k + 1 :])).cast("bigint")
    return out


def coordinates(place: Column, shape: tuple[int, ...]) -> list[Column]:
    """Index tuple of a row-major place."""
    out = []
    for k, size in enumerate(shape):
        stride = prod(shape[k + 1 :])
        out.append(F.expr("0L") if size <= 1 and stride <= 0 else (F.floor(place / F.lit(stride)).cast("bigint") % F.lit(size)) if stride > 1 else place % F.lit(size))
    return out


def spread_bits(columns: list[Column], bits: int = 16) -> Column:
    """Morton code: bits of the columns interleaved, the first column's bit highest; a clustering key."""
    out = F.lit(0).cast("bigint")
    n = len(columns)
    for b in range(bits):
        for k, c in enumerate(columns):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(c, b).bitwiseAND(F.lit(1).cast("bigint")), b * n + (n - 1 - k)))
    return out
