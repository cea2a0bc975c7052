"""Small expressions on strings, arrays and JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def truncated(value: Column, most: int) -> Column:
    """At most `most` code points; a longer value ends in an ellipsis. Null gives ''."""
    return F.when(value.isNull(), "").when(F.char_length(value) <= most, value).otherwise(F.concat(F.substring(value, 1, most - 1), F.lit("…")))


def decoded(content: Column) -> Column:
    """The text of a file's bytes: each longest bad sequence is a U+FFFD, as decoders write it, so that no file is refused."""
    return F.make_valid_utf8(content.cast("string"))


def padded(number: Column, width: int) -> Column:
    """Decimal digits, with leading zeros where there are fewer than `width`."""
    digits = number.cast("string")
    return F.when(F.char_length(digits) >= width, digits).otherwise(F.lpad(digits, width, "0"))


def in_name_order(value: Column, kind: T.DataType) -> Column:
    """The same value with all struct fields in the order of their names, so that to_json gives canonical text."""
    if isinstance(kind, T.StructType):
        return F.struct(*[in_name_order(value[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)])
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.ArrayType)):
        return F.transform(value, lambda x: in_name_order(x, kind.elementType))
    return value


def canonical(value: Column, kind: T.DataType) -> Column:
    """JSON text with sorted keys; null fields are absent."""
    return F.to_json(in_name_order(value, kind))


def distinct_by_text(arrays: Column, element: T.DataType) -> Column:
    """Distinct elements of an array, ordered by their canonical text (strings by themselves)."""
    if isinstance(element, T.StringType):
        return F.array_sort(F.array_distinct(arrays))
    keyed = F.transform(arrays, lambda x: F.struct(canonical(x, element).alias("k"), x.alias("v")))
    return F.transform(F.array_sort(F.array_distinct(keyed)), lambda x: x["v"])


def digest16(key: Column) -> Column:
    return F.substring(F.sha2(key, 256), 1, 16)
