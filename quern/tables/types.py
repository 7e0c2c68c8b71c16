"""Declared SQL types and their Spark types; date and time text."""

from __future__ import annotations

import re

from pyspark.sql import types as T

# Declared names by kind.
_INTEGER = "TINYINT SMALLINT INT INTEGER BIGINT INT8 INT16 INT32 INT64 UINT8 UINT16 UINT32 UINT64".split()
_DOUBLE = "FLOAT REAL DOUBLE FLOAT32 FLOAT64".split()
_DATETIME = "DATETIME TIMESTAMP DATE TIME".split()
_TEXT = "TEXT STRING VARCHAR CHAR CHARACTER".split()
_BINARY = "BYTEA BINARY".split()
_BOOLEAN = "BOOLEAN BOOL".split()
#: Characters of VARCHAR and CHAR without a number.
BARE_CAPACITY = 32
# Fixed values end.


def _split(declared: str) -> tuple[str, int | None]:
    m = re.fullmatch(r"\s*(\w+)(?:\s+PRECISION)?\s*(?:\(\s*(\d+)\s*(?:,\s*\d+\s*)?\))?\s*", declared, re.I)
    if not m:
        raise ValueError(f"unknown type {declared}")
    return m[1].upper(), int(m[2]) if m[2] else None


def spark_type(declared: str) -> T.DataType:
    """The Spark type of a declared one: every integer is 64 bits, all dates and times are one type."""
    name, _ = _split(declared)
    for names, kind in ((_INTEGER, T.LongType()), (_DOUBLE, T.DoubleType()), (_DATETIME, T.TimestampNTZType()), (_TEXT, T.StringType()), (_BINARY, T.BinaryType()), (_BOOLEAN, T.BooleanType())):
        if name in names:
            return kind
    if name in ("DECIMAL", "NUMERIC"):
        return T._parse_datatype_string(declared.strip().lower().replace("numeric", "decimal"))
    raise ValueError(f"unknown type {declared}")


def capacity(declared: str) -> int | None:
    """The most characters that a text column takes, or None."""
    name, n = _split(declared)
    return (n or BARE_CAPACITY) if name in ("VARCHAR", "CHAR", "CHARACTER") else None
