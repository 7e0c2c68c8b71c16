"""Column helpers where the engine's semantics differ from Spark's defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A character that no pattern holds: LIKE has no escape character here.
NO_ESCAPE = "\u0001"


def exact_eq(whole: Column, real: Column) -> Column:
    """bigint = double, exactly: 2^53 + 1 is not equal to 2^53 as a double."""
    inside = (real == F.floor(real)) & (real >= F.lit(-(2.0**63))) & (real < F.lit(2.0**63))
    return F.when(whole.isNull() | real.isNull(), F.lit(None).cast("boolean")).otherwise(inside & (F.when(inside, real).cast("bigint") == whole))


def exact_key(real: Column) -> Column:
    """The bigint that a double equals, or null: an equi-join key against a bigint column."""
    inside = (real == F.floor(real)) & (real >= F.lit(-(2.0**63))) & (real < F.lit(2.0**63))
    return F.when(inside, real).cast("bigint")


def int_div(a: Column, b: Column) -> Column:
    """Division of integers, truncating toward zero; an error for zero."""
    return F.when(b.isNotNull(), F.call_function("div", a, b))


def float_div(a: Column, b: Column) -> Column:
    """Division of doubles as IEEE has it: infinities and NaN instead of an error."""
    a, b = a.cast("double"), b.cast("double")
    zero = F.when(a.isNull(), F.lit(None).cast("double")).when((a == 0) | F.isnan(a), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(b == 0, zero).otherwise(a / F.when(b != 0, b))


def like(value: Column, pattern: str, ignore_case: bool = False) -> Column:
    """LIKE or ILIKE in which a backslash is an ordinary character."""
    if ignore_case:
        return F.ilike(value, F.lit(pattern), F.lit(NO_ESCAPE))
    return F.like(value, F.lit(pattern), F.lit(NO_ESCAPE))


def ordered(*keys: Column | str | tuple) -> list[Column]:
    """Sort keys with nulls last in both directions; a key is a column or (column, "desc"[, "first"])."""
    out = []
    for key in keys:
        column, *how = key if isinstance(key, tuple) else (key,)
        column = F.col(column) if isinstance(column, str) else column
        if "desc" in how:
            out.append(column.desc_nulls_first() if "first" in how else column.desc_nulls_last())
        else:
            out.append(column.asc_nulls_first() if "first" in how else column.asc_nulls_last())
    return out


def concat_all(*parts: Column) -> Column:
    """CONCAT: everything as text, null if any part is."""
    return F.concat(*[p.cast("string") for p in parts])
