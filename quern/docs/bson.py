"""The total order of document values, as sort keys, and JSON text that keeps types apart."""

from __future__ import annotations

import datetime as dt
import json
import math
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Order of the kinds of values.
BRACKETS = {"null": 2, "number": 3, "string": 4, "document": 5, "array": 6, "objectid": 8, "bool": 9, "date": 10}

NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
DATES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def bracket_of(kind: T.DataType) -> str:
    """The bracket of a column's type."""
    if isinstance(kind, NUMBERS):
        return "number"
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    if isinstance(kind, (T.StructType, T.MapType)):
        return "document"
    if isinstance(kind, T.ArrayType):
        return "array"
    if isinstance(kind, T.BooleanType):
        return "bool"
    if isinstance(kind, DATES):
        return "date"
    if isinstance(kind, T.NullType):
        return "null"
    raise TypeError(f"documents don't hold {kind.simpleString()}")


def bracket_of_value(value: Any) -> str:
    """The bracket of a Python value."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, (int, float)):
        return "number"
    if isinstance(value, str):
        return "string"
    if isinstance(value, dict):
        return "document"
    if isinstance(value, (list, tuple)):
        return "array"
    if isinstance(value, (dt.datetime, dt.date)):
        return "date"
    raise TypeError(f"documents don't hold {type(value).__name__}")


def sort_key(value: Column, kind: T.DataType, descending: bool = False) -> Column:
    """A struct that orders as the values do; null and missing are lowest, an array sorts by its least
    element (its greatest, descending)."""
    if isinstance(kind, T.ArrayType):
        inner = kind.elementType
        keys = F.transform(value, lambda x: sort_key(x, inner))
        end = (F.array_max if descending else F.array_min)(keys)
        empty = sort_key(F.lit(None).cast(inner), inner)
        return F.when(value.isNull() | (F.size(value) == 0), empty).otherwise(end)
    bracket = BRACKETS[bracket_of(kind)]
    rank = F.when(value.isNull(), BRACKETS["null"]).otherwise(bracket)
    if bracket == BRACKETS["number"] and isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.struct(rank.alias("b"), (~F.isnan(value)).alias("n"), value.alias("v"))  # NaN is the lowest number
    return F.struct(rank.alias("b"), value.alias("v"))


def compare(a: Any, b: Any) -> int:
    """-1, 0 or 1 by the total order, for Python values."""
    ka, kb = bracket_of_value(a), bracket_of_value(b)
    if ka != kb:
        return -1 if BRACKETS[ka] < BRACKETS[kb] else 1
    if ka == "null":
        return 0
    if ka == "number":
        na, nb = (isinstance(x, float) and math.isnan(x) for x in (a, b))
        if na or nb:
            return nb - na if na != nb else 0
        return (a > b) - (a < b)  # Python compares int and float exactly
    if ka == "array":
        for x, y in zip(a, b, strict=False):
            if c := compare(x, y):
                return c
        return (len(a) > len(b)) - (len(a) < len(b))
    if ka == "document":
        for (kx, x), (ky, y) in zip(a.items(), b.items(), strict=False):
            if c := compare(x, y):
                return c
            if kx != ky:
                return -1 if kx < ky else 1
        return (len(a) > len(b)) - (len(a) < len(b))
    return (a > b) - (a < b)


def parse_extended(text: str) -> Any:
    """JSON with $oid, $date, $numberLong and $numberInt read as values."""
    return json.loads(text, object_hook=_extended)


def _extended(pairs: dict) -> Any:
    if len(pairs) == 1:
        (key, value), = pairs.items()
        if key == "$oid":
            return str(value)
        if key in ("$numberLong", "$numberInt"):
            return int(value)
        if key == "$date":
            return dt.datetime.fromtimestamp(value / 1000, dt.UTC).replace(tzinfo=None) if isinstance(value, (int, float)) else dt.datetime.fromisoformat(value.replace("Z", "+00:00")).astimezone(dt.UTC).replace(tzinfo=None)
    return pairs


def print_extended(value: Any) -> str:
    """The reverse of parse_extended."""

    def plain(v: Any) -> Any:
        if isinstance(v, dt.datetime):
            return {"$date": v.isoformat(timespec="milliseconds") + "Z"}
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items()}
        return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v

    return json.dumps(plain(value), ensure_ascii=False)
