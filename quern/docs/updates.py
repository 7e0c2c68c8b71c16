"""Update operators as column changes: every document that matches is rewritten in one projection."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.docs.expressions import literal
from quern.docs.filters import _equal, _is_operators, compile_filter
from quern.docs.paths import resolve

OPERATORS = ("$set", "$unset", "$inc", "$mul", "$min", "$max", "$rename", "$push", "$addToSet", "$pull", "$pop", "$setOnInsert", "$currentDate")


def check(update: dict[str, dict]) -> None:
    """Refuse unknown operators, changes of _id, and two changes of one path or of a path within another."""
    paths: list[str] = []
    for op, spec in update.items():
        if op not in OPERATORS:
            raise ValueError(f"unknown update operator {op}")
        paths += spec
        paths += spec.values() if op == "$rename" else []
    for i, p in enumerate(paths):
        if p == "_id" or p.startswith("_id."):
            raise ValueError("_id can't change")
        if any(p == q or p.startswith(q + ".") or q.startswith(p + ".") for q in paths[:i]):
            raise ValueError(f"conflict at {p}")


def _each(value: Any) -> list:
    return value["$each"] if isinstance(value, dict) and set(value) == {"$each"} else [value]


def _change(op: str, old: Column, kind: T.DataType | None, arg: Any, inserting: bool) -> Column:
    """The new value at a path; ``kind`` is None where the schema has no such path."""
    new, new_kind = literal(arg) if op in ("$set", "$inc", "$mul", "$min", "$max", "$setOnInsert") else (None, None)
    if op == "$set":
        return new.cast(kind) if kind else new
    if op == "$setOnInsert":
        return (new.cast(kind) if kind else new) if inserting else old
    if op == "$unset":
        return F.lit(None).cast(kind) if kind else F.lit(None)
    if op in ("$inc", "$mul"):
        start = F.coalesce(old, F.lit(0).cast(kind)) if kind else F.lit(0).cast(new_kind)
        made = start + new if op == "$inc" else start * new
        return made.cast(kind) if kind else made
    if op in ("$min", "$max"):
        if kind is None:
            return new
        return F.coalesce((F.least if op == "$min" else F.greatest)(old, new.cast(kind)), new.cast(kind))
    if op == "$currentDate":
        now = F.current_timestamp().cast("timestamp_ntz")
        return now.cast(kind) if kind else now
    if op in ("$push", "$addToSet"):
        values = _each(arg)
        inner = kind.elementType if kind else literal(values[0])[1]
        fresh = F.array(*[literal(v)[0].cast(inner) for v in values])
        base = F.coalesce(old, F.array().cast(T.ArrayType(inner))) if kind else F.array().cast(T.ArrayType(inner))
        return F.concat(base, fresh) if op == "$push" else F.concat(base, F.array_except(fresh, base))
    if kind is None:
        return old
    if op == "$pull":
        inner = kind.elementType
        if _is_operators(arg):
            from quern.docs.filters import _field

            return F.filter(old, lambda x: ~_field((x, inner), arg))
        if isinstance(arg, dict) and isinstance(inner, T.StructType):
            return F.filter(old, lambda x: ~compile_filter(arg, inner, x))
        return F.filter(old, lambda x: ~_equal((x, inner), arg))
    if op == "$pop":
        n = F.size(old)
        return F.when(n > 0, F.slice(old, 1 if arg > 0 else 2, n - 1)).otherwise(old)
    raise ValueError(op)


def _place(base: Column | None, kind: T.DataType | None, rest: list[str], value: Column) -> Column:
    """``base`` with a value at a nested path; parents that are missing are made."""
    if not rest:
        return value
    name, *more = rest
    if base is None or not isinstance(kind, T.StructType):
        return F.struct(_place(None, None, more, value).alias(name))
    f = next((f for f in kind.fields if f.name == name), None)
    inner = _place(base[name] if f else None, f.dataType if f else None, more, value)
    parts = [(inner if x.name == name else base[x.name]).alias(x.name) for x in kind.fields]
    return F.struct(*parts, *([] if f else [inner.alias(name)]))


def apply_update(docs: DataFrame, query: dict | Column, update: dict[str, dict], inserting: bool = False) -> DataFrame:
    """``docs`` with the update made on the documents that match ``query``; new fields are null elsewhere."""
    check(update)
    hit = compile_filter(query, docs.schema) if isinstance(query, dict) else query
    docs = docs.withColumn("__hit", hit)
    moves = dict(update.get("$rename", {}))
    for op, spec in update.items():
        for path, arg in spec.items() if op != "$rename" else ():
            docs = _set(docs, path, op, arg, inserting)
    for source, target in moves.items():
        found = resolve(None, docs.schema, source)
        if found is None:
            continue
        docs = _set_column(docs, target, F.when(found[0].isNotNull(), found[0]), resolve(None, docs.schema, target))
        docs = _set(docs, source, "$unset", "", inserting)
    return docs.drop("__hit")


def _set(docs: DataFrame, path: str, op: str, arg: Any, inserting: bool) -> DataFrame:
    found = resolve(None, docs.schema, path)
    if found is None and op in ("$unset", "$pull", "$pop"):
        return docs
    old = found[0] if found else F.lit(None)
    return _set_column(docs, path, _change(op, old, found[1] if found else None, arg, inserting), found)


def _set_column(docs: DataFrame, path: str, value: Column, found) -> DataFrame:
    top, *rest = path.split(".")
    base = F.col(f"`{top}`") if top in docs.columns else None
    made = _place(base, docs.schema[top].dataType if base is not None else None, rest, value)
    if base is None:
        return docs.withColumn(top, F.when(F.col("__hit"), made))
    old = base if found is not None or not rest else _place(base, docs.schema[top].dataType, rest, F.when(F.lit(False), value))
    return docs.withColumn(top, F.when(F.col("__hit"), made).otherwise(old))
