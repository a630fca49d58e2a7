"""Boolean building blocks for packet predicates; constant parts fold in Catalyst."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def true() -> Column:
    return F.lit(True)


def false() -> Column:
    return F.lit(False)


def all_of(*parts: Column) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def any_of(*parts: Column) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def negated(part: Column) -> Column:
    return ~part


def equal(a: Column, b: Column) -> Column:
    return a == b


def unequal(a: Column, b: Column) -> Column:
    return a != b


def exclusive(a: Column, b: Column) -> Column:
    """Exclusive or of two predicates."""
    return a != b


def implies(a: Column, b: Column) -> Column:
    return ~a | b


def constant(value: int, bits: int) -> Column:
    """A bit-vector constant of the given width."""
    if not 0 <= value < 1 << bits:
        raise ValueError(f"{value} does not fit in {bits} bits")
    return F.lit(value).cast("long")


def same_packet(fields: list[str], one: str = "in_", other: str = "out_") -> Column:
    """Identity: every field of the packet before equals that of the packet after."""
    return all_of(*(F.col(one + f) == F.col(other + f) for f in fields))
