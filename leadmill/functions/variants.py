"""Values inside parsed JSON (variants), taken only where they have the type that is asked for: nothing is coerced."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def at(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "variant")


def text_at(value: Column, path: str = "$") -> Column:
    """The string there, or null for what isn't a string."""
    x = at(value, path)
    return F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))


def integer_at(value: Column, path: str = "$") -> Column:
    """The whole number there as a long, however it's written (3, 3.0, 3e0), or null for what isn't one.

    Numbers are doubles, as in JSON's own language: beyond 2**53 they're rounded to one. Those beyond a long give null.
    """
    x = at(value, path)
    number = F.when(F.schema_of_variant(x).rlike("^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(x, "$", "double"))
    return F.when((F.abs(number) < 2.0**63) & (number == F.rint(number)), number).cast("long")


def list_at(value: Column, path: str = "$") -> Column:
    """The array there, or null for what isn't one."""
    return F.try_variant_get(value, path, "array<variant>")
