"""Closed value lists with an order, as rank expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values, least first.
SEVERITY = ("Info", "Low", "Medium", "High", "Critical")
CONFIDENCE = ("to verify", "likely", "strong static proof")
#: Most exposed first.
AUTH = ("unauthenticated", "authenticated", "admin")
OUTCOME = ("refuted", "inconclusive", "promoted")


def rank(value: Column, order: Sequence[str], missing: int | None = None) -> Column:
    """0-based place of a value in its list; `missing` for null and unknown ones."""
    at = F.array_position(F.array(*[F.lit(x) for x in order]), value).cast("int") - 1
    at = F.when(at >= 0, at)
    return at if missing is None else F.coalesce(at, F.lit(missing))


def rank_bit(value: Column, order: Sequence[str], first: int) -> Column:
    """The bit of a value's place, counted from bit `first`; 0 for null and unknown ones. Joined by `bit_or`, the bits of many lists take one integer."""
    bits = F.array(F.lit(0), *[F.lit(1 << i) for i in range(first, first + len(order))])
    return F.coalesce(F.get(bits, F.array_position(F.array(*[F.lit(x) for x in order]), value).cast("int")), F.lit(0))


def first_by_bits(bits: Column, order: Sequence[str], first: int, last: bool = False) -> Column:
    """The first of a list's values whose bit is set, or the last; null if there's none."""
    found = [F.when(bits.bitwiseAND(F.lit(1 << i)) != 0, x) for i, x in enumerate(order, first)]
    return F.coalesce(*(found[::-1] if last else found))


def unrank(at: Column, order: Sequence[str]) -> Column:
    return F.get(F.array(*[F.lit(x) for x in order]), at.cast("int"))
