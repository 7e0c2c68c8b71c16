"""Dotted paths over struct and array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def field(schema: T.StructType, name: str) -> T.StructField | None:
    """A field by exact name."""
    return next((f for f in schema.fields if f.name == name), None)


def resolve(root: Column | None, schema: T.StructType, path: str) -> tuple[Column, T.DataType] | None:
    """The column and type at a path, or None if no document of this schema can have it.

    A name applied to an array of documents gives the array of that field of each; a number takes one
    element.
    """
    parts = path.split(".")
    f = field(schema, parts[0])
    if f is None:
        return None
    column, kind = (F.col(f"`{f.name}`") if root is None else root[f.name]), f.dataType
    return _descend(column, kind, parts[1:])


def _descend(column: Column, kind: T.DataType, parts: list[str]) -> tuple[Column, T.DataType] | None:
    for k, part in enumerate(parts):
        if isinstance(kind, T.StructType):
            f = field(kind, part)
            if f is None:
                return None
            column, kind = column[part], f.dataType
        elif isinstance(kind, T.ArrayType) and part.isdigit():
            column, kind = F.get(column, F.lit(int(part))), kind.elementType
        elif isinstance(kind, T.ArrayType):
            rest, inner = parts[k:], kind.elementType
            probe = _descend(F.lit(None).cast(inner), inner, rest)
            if probe is None:
                return None
            found = F.transform(column, lambda x: _descend(x, inner, rest)[0])
            if isinstance(probe[1], T.ArrayType):
                return F.flatten(F.filter(found, lambda x: x.isNotNull())), probe[1]
            return found, T.ArrayType(probe[1])
        elif isinstance(kind, T.MapType):
            column, kind = column[part], kind.valueType
        else:
            return None
    return column, kind
