"""Document filters as boolean columns.

A filter is two-valued: what can't be compared doesn't match. Documents have a known schema; a null
field counts as missing.
"""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.docs.bson import bracket_of, bracket_of_value
from quern.docs.paths import resolve

_COMPARE = {"$gt": "__gt__", "$gte": "__ge__", "$lt": "__lt__", "$lte": "__le__"}


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def compile_filter(query: dict[str, Any], schema: T.StructType, root: Column | None = None) -> Column:
    """The condition that documents match ``query``."""
    out = F.lit(True)
    for key, value in query.items():
        if key in ("$and", "$or", "$nor"):
            if not isinstance(value, list) or not value:
                raise ValueError(f"{key} takes a list that isn't empty")
            parts = [compile_filter(q, schema, root) for q in value]
            joined = parts[0]
            for p in parts[1:]:
                joined = joined & p if key == "$and" else joined | p
            out = out & (~joined if key == "$nor" else joined)
        elif key == "$expr":
            from quern.docs.expressions import compile_expression, truth

            out = out & _sure(truth(*compile_expression(value, schema, root)))
        elif key == "$comment":
            continue
        elif key.startswith("$"):
            raise ValueError(f"unknown operator {key}")
        else:
            out = out & _field(resolve(root, schema, key), value)
    return out


def _is_operators(value: Any) -> bool:
    return isinstance(value, dict) and bool(value) and all(k.startswith("$") for k in value)


def _field(found: tuple[Column, T.DataType] | None, value: Any) -> Column:
    if not _is_operators(value):
        return _equal(found, value)
    out = F.lit(True)
    for op, arg in value.items():
        if op == "$options":
            continue
        out = out & _operator(found, op, arg, value)
    return out


def _operator(found: tuple[Column, T.DataType] | None, op: str, arg: Any, whole: dict) -> Column:
    if op == "$eq":
        return _equal(found, arg)
    if op == "$ne":
        return ~_equal(found, arg)
    if op in ("$in", "$nin"):
        hit = F.lit(False)
        for v in arg:
            hit = hit | _equal(found, v)
        return hit if op == "$in" else ~hit
    if op in _COMPARE:
        if arg is None:
            return _equal(found, None) if op in ("$gte", "$lte") else F.lit(False)
        return _each(found, lambda c, k: _compare(c, k, op, arg))
    if op == "$exists":
        there = F.lit(False) if found is None else found[0].isNotNull()
        return there if arg else ~there
    if op == "$size":
        return F.lit(False) if found is None or not isinstance(found[1], T.ArrayType) else _sure(F.size(found[0]) == arg)
    if op == "$all":
        out = F.lit(bool(arg))
        for v in arg:
            out = out & _equal(found, v)
        return out
    if op == "$elemMatch":
        if found is None or not isinstance(found[1], T.ArrayType):
            return F.lit(False)
        inner = found[1].elementType
        if _is_operators(arg) and not any(k in ("$and", "$or", "$nor", "$expr") for k in arg):
            return _sure(F.exists(found[0], lambda x: _field((x, inner), arg)))
        if not isinstance(inner, T.StructType):
            return F.lit(False)
        return _sure(F.exists(found[0], lambda x: x.isNotNull() & compile_filter(arg, inner, x)))
    if op == "$not":
        return ~_field(found, arg)
    if op == "$regex":
        flags = "".join(dict.fromkeys(whole.get("$options", "")))
        if set(flags) - set("imsx"):
            raise ValueError(f"unknown $options {flags!r}")
        re.compile(arg)
        pattern = f"(?{flags}){arg}" if flags else arg
        return _each(found, lambda c, k: c.rlike(pattern) if bracket_of(k) == "string" else F.lit(False))
    raise ValueError(f"unknown operator {op}")


def _each(found: tuple[Column, T.DataType] | None, test) -> Column:
    """The test on the value, or on any element of an array."""
    if found is None:
        return F.lit(False)
    column, kind = found
    if isinstance(kind, T.ArrayType):
        return _sure(F.exists(column, lambda x: _sure(test(x, kind.elementType))))
    return _sure(test(column, kind))


def _equal(found: tuple[Column, T.DataType] | None, value: Any) -> Column:
    if value is None:
        if found is None:
            return F.lit(True)
        missing = found[0].isNull()
        return missing | _sure(F.exists(found[0], lambda x: x.isNull())) if isinstance(found[1], T.ArrayType) else missing
    if found is None:
        return F.lit(False)
    column, kind = found
    whole = _sure(_same(column, kind, value))
    return whole | _sure(F.exists(column, lambda x: _sure(_same(x, kind.elementType, value)))) if isinstance(kind, T.ArrayType) else whole


def _same(column: Column, kind: T.DataType, value: Any) -> Column:
    """Equality of one value with a constant, kinds and all."""
    if bracket_of(kind) != bracket_of_value(value):
        return F.lit(False)
    if isinstance(value, dict):
        if not isinstance(kind, T.StructType):
            return F.lit(False)
        names = [f.name for f in kind.fields]
        if any(k not in names for k in value):
            return F.lit(False)
        out = column.isNotNull()
        for f in kind.fields:
            part = column[f.name]
            out = out & (_sure(_same(part, f.dataType, value[f.name])) if value.get(f.name) is not None else part.isNull())
        return out
    if isinstance(value, (list, tuple)):
        inner = kind.elementType
        out = F.size(column) == len(value)
        for i, v in enumerate(value):
            x = F.get(column, F.lit(i))
            out = out & (x.isNull() if v is None else _sure(_same(x, inner, v)))
        return out
    if isinstance(value, float) and not isinstance(kind, (T.FloatType, T.DoubleType)):
        return column == int(value) if value == value and abs(value) < 2**63 and value == int(value) else F.lit(False)
    if isinstance(value, int) and not isinstance(value, bool) and isinstance(kind, (T.FloatType, T.DoubleType)):
        return column == F.lit(float(value)) if int(float(value)) == value else F.lit(False)
    return column == F.lit(value)


def _compare(column: Column, kind: T.DataType, op: str, value: Any) -> Column:
    if bracket_of(kind) != bracket_of_value(value) or isinstance(value, (dict, list)):
        return F.lit(False)
    return getattr(column, _COMPARE[op])(F.lit(value))
