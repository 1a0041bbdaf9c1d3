"""Canonical JSON: pretty form with sorted keys, and RFC 8785."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from veilgrid.sources.encodings import Refused
from veilgrid.sources.tables import load_json

_SAFE = 2**53


def pretty(text: str) -> str:
    """Sorted keys, two blanks of indent, integers of any size as they are."""
    return json.dumps(load_json(text), sort_keys=True, indent=2, ensure_ascii=False) + "\n"


def es_number(x) -> str:
    """A number as ECMAScript writes it."""
    if isinstance(x, int):
        if abs(x) > _SAFE:
            raise Refused("integer_too_large")
        return str(x)
    if not math.isfinite(x):
        raise Refused("not_a_number")
    if x == 0:
        return "0"
    sign, digits, exp = ("-" if x < 0 else ""), *_shortest(abs(x))
    n, k = len(digits), exp  # value = 0.digits * 10^exp
    if n <= k <= 21:
        return sign + digits + "0" * (k - n)
    if 0 < k <= 21:
        return sign + digits[:k] + "." + digits[k:]
    if -6 < k <= 0:
        return sign + "0." + "0" * -k + digits
    head, tail = digits[:1], digits[1:]
    return f"{sign}{head}{'.' * bool(tail)}{tail}e{k - 1:+d}"


def _shortest(x: float) -> tuple[str, int]:
    mantissa, _, exp = f"{x!r}".partition("e")
    whole, _, part = mantissa.partition(".")
    raw = whole + part
    point = len(whole) + int(exp or 0)
    lead = len(raw) - len(raw.lstrip("0"))
    return raw.strip("0"), point - lead


def _string(s: str) -> str:
    if any(0xD800 <= ord(c) < 0xE000 for c in s):
        raise Refused("lone_surrogate")
    return json.dumps(s, ensure_ascii=False)


def jcs(x) -> str:
    """RFC 8785: keys by UTF-16 code units, least escapes, ECMAScript numbers."""
    if x is None or isinstance(x, bool):
        return {None: "null", True: "true", False: "false"}[x]
    if isinstance(x, str):
        return _string(x)
    if isinstance(x, (int, float)):
        return es_number(x)
    if isinstance(x, list):
        return "[" + ",".join(map(jcs, x)) + "]"
    return "{" + ",".join(f"{_string(k)}:{jcs(x[k])}" for k in sorted(x, key=lambda k: k.encode("utf-16-be"))) + "}"


_OUT = StructType([StructField("text", StringType()), StructField("reason", StringType())])


def _udf(make):
    @F.pandas_udf(_OUT)
    def run(s: pd.Series) -> pd.DataFrame:
        rows = []
        for x in s:
            try:
                rows.append((None if x is None else make(x), None))
            except Refused as e:
                rows.append((None, e.code))
        return pd.DataFrame(rows, columns=["text", "reason"])

    return run


#: Column -> struct(text, reason): the canonical form, or why there is none.
json_pretty = _udf(pretty)
json_jcs = _udf(lambda text: jcs(load_json(text)))
