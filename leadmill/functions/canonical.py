"""The canonical text of free-form JSON: keys sorted at every level, numbers and strings as ECMAScript writes them."""

from __future__ import annotations

import hashlib
import json
import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_LONE = re.compile("[\ud800-\udfff]")


def number_text(x: float) -> str:
    """A double as ECMAScript's JSON writes it: the shortest digits that give it back, with an exponent below 1e-6 and from 1e21 on; null if it isn't finite."""
    if not math.isfinite(x):
        return "null"
    if x == 0:
        return "0"
    mantissa, _, exponent = repr(abs(x)).partition("e")
    whole, _, rest = mantissa.partition(".")
    digits = (whole + rest).lstrip("0")
    point = len(whole) + int(exponent or 0) - (len(whole + rest) - len(digits))  # the value is 0.digits * 10**point
    digits = digits.rstrip("0")
    n = len(digits)
    if n <= point <= 21:
        text = digits + "0" * (point - n)
    elif 0 < point <= 21:
        text = digits[:point] + "." + digits[point:]
    elif -6 < point <= 0:
        text = "0." + "0" * -point + digits
    else:
        text = digits[0] + ("." + digits[1:] if n > 1 else "") + f"e{point - 1:+d}"
    return "-" + text if x < 0 else text


def string_text(s: str) -> str:
    return _LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", json.dumps(s, ensure_ascii=False))


def _written(value: object) -> str:
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(string_text(k) + ":" + _written(value[k]) for k in keys) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_written, value)) + "]"
    if isinstance(value, str):
        return string_text(value)
    if isinstance(value, float):
        return number_text(value)
    return {True: "true", False: "false", None: "null"}[value]


def _refused(name: str) -> None:
    raise ValueError(name)


def canonical_json(text: str | None) -> str | None:
    """The text's value with its keys sorted; of a repeated key the last counts, and all numbers are doubles. Null for what isn't JSON, or is nested too deeply to be read."""
    if text is None:
        return None
    try:
        return _written(json.loads(text, parse_int=float, parse_float=float, parse_constant=_refused))
    except (ValueError, RecursionError):
        return None


def json_digest(text: Column) -> Column:
    """The SHA-256 of the canonical text, in hex."""

    @F.pandas_udf("string")
    def digests(texts: pd.Series) -> pd.Series:
        found = [canonical_json(t) for t in texts]
        return pd.Series([None if t is None else hashlib.sha256(t.encode()).hexdigest() for t in found], dtype=object)

    return digests(text)
