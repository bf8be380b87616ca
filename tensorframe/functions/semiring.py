"""Semirings: how values are multiplied and summed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

U32_MAX = 2**32 - 1
U64_MAX = 2**64 - 1


@dataclass(frozen=True)
class Semiring:
    name: str
    type: str
    multiply: Callable[[Column, Column], Column]
    add: Callable[[Column, Column], Column]
    total: Callable[[Column], Column]  # aggregate
    plain: bool = False  # the type's own arithmetic

    def lit(self, value) -> Column:
        return F.lit(value).cast(self.type)


class MixedSemirings(ValueError):
    """Operands whose arithmetics differ."""


def _saturating(name: str, kind: str, top: int) -> Semiring:
    most = F.lit(top).cast(kind) if top < 2**63 else F.lit(str(top)).cast(kind)
    clamp = lambda c: F.least(F.coalesce(c, most), most).cast(kind)
    # an overflow of the wide type gives null, hence the maximum; for values >= 0 the order of sums doesn't matter
    return Semiring(name, kind, lambda a, b: clamp(F.try_multiply(a, b)), lambda a, b: clamp(F.try_add(a, b)), lambda c: clamp(F.try_sum(c)))


def plain(name: str, kind: str) -> Semiring:
    return Semiring(name, kind, lambda a, b: a * b, lambda a, b: a + b, lambda c: F.sum(c).cast(kind), True)


def DOUBLE() -> Semiring:
    return plain("double", "double")


def LONG() -> Semiring:
    """64-bit integers; an overflow is an error."""
    return plain("long", "bigint")


def SAT_U32() -> Semiring:
    return _saturating("sat_u32", "bigint", U32_MAX)


def SAT_U64() -> Semiring:
    return _saturating("sat_u64", "decimal(20,0)", U64_MAX)


def BOOL() -> Semiring:
    """Patterns: 1 where there is any term."""
    return Semiring("bool", "bigint", lambda a, b: F.lit(1).cast("bigint"), lambda a, b: F.lit(1).cast("bigint"), lambda c: F.max(F.lit(1)).cast("bigint"))


def common(rings: list[Semiring | None], kinds: list[str]) -> Semiring:
    """The arithmetic of operands (None: their type's own): one that is not plain must be that of all."""
    special = {r.name: r for r in rings if r is not None and not r.plain}
    if special and (len(special) > 1 or any(r is None or r.plain for r in rings)):
        names = [kind if r is None else r.name for r, kind in zip(rings, kinds, strict=True)]
        raise MixedSemirings(f"operands of different arithmetic: {', '.join(names)}")
    if special:
        return next(iter(special.values()))
    distinct = set(kinds)
    return of_type(kinds[0]) if len(distinct) == 1 else DOUBLE() if distinct & {"float", "double"} else of_type(max(distinct, key=len))


def of_type(kind: str) -> Semiring:
    """Plain arithmetic on a column type; float sums are double."""
    return DOUBLE() if kind in ("float", "double") else LONG() if kind in ("bigint", "int", "smallint", "tinyint") else plain(kind, kind)
