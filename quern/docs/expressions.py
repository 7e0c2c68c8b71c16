"""Aggregation expressions as columns with their types. A null field counts as missing."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.docs.bson import BRACKETS, DATES, NUMBERS, bracket_of
from quern.docs.paths import resolve

Typed = tuple[Column, T.DataType]
_LONG, _DOUBLE, _STRING, _BOOL = T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType()


def _real(kind: T.DataType) -> bool:
    return isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType))


def _need(ok: bool, message: str) -> None:
    if not ok:
        raise TypeError(message)


def truth(column: Column, kind: T.DataType) -> Column:
    """0, null, missing and false are false."""
    if isinstance(kind, T.BooleanType):
        return F.coalesce(column, F.lit(False))
    if isinstance(kind, NUMBERS):
        return F.coalesce(column != 0, F.lit(False))
    return column.isNotNull()


def literal(value: Any) -> Typed:
    """A constant."""
    if isinstance(value, bool):
        return F.lit(value), _BOOL
    if isinstance(value, int):
        return F.lit(value).cast("bigint"), _LONG
    if isinstance(value, float):
        return F.lit(value), _DOUBLE
    if isinstance(value, str):
        return F.lit(value), _STRING
    if value is None:
        return F.lit(None), T.NullType()
    if isinstance(value, dict):
        parts = {k: literal(v) for k, v in value.items()}
        return F.struct(*[c.alias(k) for k, (c, _) in parts.items()]), T.StructType([T.StructField(k, t) for k, (_, t) in parts.items()])
    if isinstance(value, (list, tuple)):
        parts = [literal(v) for v in value]
        return F.array(*[c for c, _ in parts]), T.ArrayType(parts[0][1] if parts else T.NullType())
    import datetime as dt

    _need(isinstance(value, dt.datetime), f"no constant of type {type(value).__name__}")
    return F.lit(value).cast("timestamp_ntz"), T.TimestampNTZType()


def compile_expression(e: Any, schema: T.StructType, root: Column | None = None) -> Typed:
    """The column of an expression and its type."""
    if isinstance(e, str) and e.startswith("$$"):
        name, _, rest = e[2:].partition(".")
        _need(name in ("ROOT", "CURRENT"), f"unknown variable {e}")
        if rest:
            return compile_expression("$" + rest, schema, root)
        whole = root if root is not None else F.struct(*[F.col(f"`{f.name}`") for f in schema.fields])
        return whole, schema
    if isinstance(e, str) and e.startswith("$"):
        return resolve(root, schema, e[1:]) or (F.lit(None), T.NullType())
    if isinstance(e, list):
        parts = [compile_expression(x, schema, root) for x in e]
        return F.array(*[c for c, _ in parts]), T.ArrayType(parts[0][1] if parts else T.NullType())
    if not isinstance(e, dict):
        return literal(e)
    ops = [k for k in e if k.startswith("$")]
    if not ops:
        parts = {k: compile_expression(v, schema, root) for k, v in e.items()}
        return F.struct(*[c.alias(k) for k, (c, _) in parts.items()]), T.StructType([T.StructField(k, t) for k, (_, t) in parts.items()])
    if len(e) != 1:
        raise ValueError("an expression has one operator")
    (op, arg), = e.items()
    if op == "$literal":
        return literal(arg)
    if op == "$cond":
        names = arg if isinstance(arg, list) else [arg["if"], arg["then"], arg["else"]]
        test, yes, no = (compile_expression(x, schema, root) for x in names)
        kind = yes[1] if isinstance(no[1], T.NullType) else no[1] if isinstance(yes[1], T.NullType) else _wider(yes[1], no[1])
        return F.when(truth(*test), yes[0].cast(kind)).otherwise(no[0].cast(kind)), kind
    args = [compile_expression(x, schema, root) for x in (arg if isinstance(arg, list) and op != "$literal" else [arg])]
    make = _OPERATORS.get(op)
    if make is None:
        raise ValueError(f"unknown operator {op}")
    return make(args)


def _wider(a: T.DataType, b: T.DataType) -> T.DataType:
    if a == b:
        return a
    _need(isinstance(a, NUMBERS) and isinstance(b, NUMBERS), f"{a.simpleString()} and {b.simpleString()} in one place")
    return _DOUBLE if _real(a) or _real(b) else _LONG


def _numbers(args: list[Typed], op: str) -> None:
    for _, kind in args:
        _need(isinstance(kind, (*NUMBERS, T.NullType)), f"{op} takes numbers")


def _arithmetic(name: str, attempt):
    def make(args: list[Typed]) -> Typed:
        if name in ("$add", "$subtract") and any(isinstance(k, DATES) for _, k in args):
            return _dates(name, args)
        _numbers(args, name)
        kind = _DOUBLE if any(_real(k) for _, k in args) else _LONG
        out = args[0][0].cast(kind)
        wide = args[0][0].cast("double")
        for c, _ in args[1:]:
            out, wide = attempt(out, c.cast(kind)), attempt(wide, c.cast("double"))
        if kind is _LONG:  # a sum that leaves 64 bits goes on as a double; the type of a column is one, so it is cut back
            nothing = F.lit(False)
            for c, _ in args:
                nothing = nothing | c.isNull()
            return F.when(nothing, F.lit(None).cast("bigint")).otherwise(F.coalesce(out, F.try_divide(wide, F.lit(1.0)).try_cast("bigint"))), _LONG
        return out, kind

    return make


def _dates(name: str, args: list[Typed]) -> Typed:
    (a, ka), (b, kb) = args
    if name == "$subtract" and isinstance(ka, DATES) and isinstance(kb, DATES):
        return F.unix_millis(a.cast("timestamp")) - F.unix_millis(b.cast("timestamp")), _LONG
    if isinstance(kb, DATES):
        a, b = b, a
    ms = b.cast("bigint") * (1 if name == "$add" else -1)
    return F.timestamp_millis(F.unix_millis(a.cast("timestamp")) + ms).cast("timestamp_ntz"), T.TimestampNTZType()


def _divide(args: list[Typed]) -> Typed:
    _numbers(args, "$divide")
    (a, _), (b, _) = args
    return a.cast("double") / b.cast("double"), _DOUBLE  # zero is an error under ANSI


def _mod(args: list[Typed]) -> Typed:
    _numbers(args, "$mod")
    (a, ka), (b, kb) = args
    if _real(ka) or _real(kb):
        return F.when(b == 0, F.lit(float("nan"))).otherwise(a.cast("double") % F.when(b != 0, b.cast("double"))), _DOUBLE
    return a.cast("bigint") % b.cast("bigint"), _LONG


def _abs(args: list[Typed]) -> Typed:
    _numbers(args, "$abs")
    return F.abs(args[0][0]), args[0][1]


def order_of(a: Typed, b: Typed) -> Column:
    """-1, 0 or 1 by the total order of values; null is lowest and never gives null."""
    (x, kx), (y, ky) = a, b
    null = BRACKETS["null"]
    bx = F.when(x.isNull(), null).otherwise(null if isinstance(kx, T.NullType) else BRACKETS[bracket_of(kx)])
    by = F.when(y.isNull(), null).otherwise(null if isinstance(ky, T.NullType) else BRACKETS[bracket_of(ky)])
    out = F.when(bx < by, -1).when(bx > by, 1).when(bx == null, 0)
    if isinstance(kx, T.NullType) or isinstance(ky, T.NullType) or bracket_of(kx) != bracket_of(ky):
        return out.otherwise(0)
    if isinstance(kx, NUMBERS) and (_real(kx) != _real(ky)):
        whole, real = (x, y) if _real(ky) else (y, x)
        low = F.when(F.isnan(real), 1).when(real >= 2.0**63, -1).when(real < -(2.0**63), 1)
        floor = F.floor(F.when((real < 2.0**63) & (real >= -(2.0**63)), real))
        exact = low.when(whole.cast("bigint") < floor, -1).when(whole.cast("bigint") > floor, 1).when(real > floor, -1).otherwise(0)
        return out.otherwise(exact if _real(ky) else -exact)
    if _real(kx):  # NaN is lowest here, highest in Spark
        nx, ny = F.isnan(x), F.isnan(y)
        return out.when(nx & ny, 0).when(nx, -1).when(ny, 1).when(x < y, -1).when(x > y, 1).otherwise(0)
    return out.when(x < y, -1).when(x > y, 1).otherwise(0)


def _comparison(test):
    return lambda args: (test(order_of(args[0], args[1])), _BOOL)


def _logic(join, start: bool):
    def make(args: list[Typed]) -> Typed:
        out = F.lit(start)
        for a in args:
            out = join(out, truth(*a))
        return out, _BOOL

    return make


def _if_null(args: list[Typed]) -> Typed:
    _need(len(args) >= 2, "$ifNull takes two values at least")
    kind = args[0][1]
    for _, k in args[1:]:
        kind = k if isinstance(kind, T.NullType) else kind if isinstance(k, T.NullType) else _wider(kind, k)
    return F.coalesce(*[c.cast(kind) for c, _ in args]), kind


def _concat(args: list[Typed]) -> Typed:
    for _, k in args:
        _need(isinstance(k, (T.StringType, T.NullType)), "$concat takes strings")
    return F.concat(*[c.cast("string") for c, _ in args]), _STRING


def _case(function):
    def make(args: list[Typed]) -> Typed:
        _need(isinstance(args[0][1], (T.StringType, T.NullType)), "takes a string")
        return F.coalesce(function(args[0][0].cast("string")), F.lit("")), _STRING

    return make


def _size(args: list[Typed]) -> Typed:
    _need(isinstance(args[0][1], T.ArrayType), "$size takes an array")
    return F.when(args[0][0].isNull(), F.raise_error(F.lit("$size takes an array"))).otherwise(F.size(args[0][0])).cast("bigint"), _LONG


def _element(args: list[Typed]) -> Typed:
    _need(isinstance(args[0][1], T.ArrayType), "$arrayElemAt takes an array")
    index = args[1][0].cast("int")
    return F.try_element_at(args[0][0], F.when(index >= 0, index + 1).otherwise(index)), args[0][1].elementType


def _in(args: list[Typed]) -> Typed:
    _need(isinstance(args[1][1], T.ArrayType), "$in takes an array")
    inner = args[1][1].elementType
    return F.coalesce(F.exists(args[1][0], lambda x: order_of(args[0], (x, inner)) == 0), F.lit(False)), _BOOL


_OPERATORS = {
    "$add": _arithmetic("$add", F.try_add),
    "$multiply": _arithmetic("$multiply", F.try_multiply),
    "$subtract": _arithmetic("$subtract", F.try_subtract),
    "$divide": _divide,
    "$mod": _mod,
    "$abs": _abs,
    "$eq": _comparison(lambda c: c == 0),
    "$ne": _comparison(lambda c: c != 0),
    "$gt": _comparison(lambda c: c > 0),
    "$gte": _comparison(lambda c: c >= 0),
    "$lt": _comparison(lambda c: c < 0),
    "$lte": _comparison(lambda c: c <= 0),
    "$cmp": lambda args: (order_of(args[0], args[1]).cast("bigint"), _LONG),
    "$and": _logic(lambda a, b: a & b, True),
    "$or": _logic(lambda a, b: a | b, False),
    "$not": lambda args: (~truth(*args[0]), _BOOL),
    "$ifNull": _if_null,
    "$concat": _concat,
    "$toUpper": _case(F.upper),
    "$toLower": _case(F.lower),
    "$size": _size,
    "$arrayElemAt": _element,
    "$in": _in,
}
