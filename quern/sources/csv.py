"""CSV: schema inference from the first rows, and loads that count what they refuse."""

from __future__ import annotations

import csv as text_csv
import io
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE_ROWS = 100
_INT, _REAL = re.compile(r"[+-]?\d+"), re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?")
_DATE = r"\d{4}-\d{2}-\d{2}"
_WHEN = re.compile(rf"{_DATE}([ T]\d{{2}}:\d{{2}}:\d{{2}})?|\d{{2}}:\d{{2}}:\d{{2}}")


def _kind(cell: str) -> str:
    if _INT.fullmatch(cell) and -(1 << 63) <= int(cell) < 1 << 63:
        return "bigint"
    if _REAL.fullmatch(cell):
        return "double"
    if cell.lower() in ("true", "false"):
        return "boolean"
    return "timestamp_ntz" if _WHEN.fullmatch(cell) else "string"


def infer_schema(lines: list[str]) -> T.StructType:
    """A schema from a header line and up to 100 rows: integers widen to doubles, other mixes are text,
    a column with an empty cell is nullable."""
    rows = list(text_csv.reader(io.StringIO("\n".join(lines))))
    header, rows = rows[0], rows[1 : SAMPLE_ROWS + 1]
    fields = []
    for i, name in enumerate(header):
        cells = [r[i] if i < len(r) else "" for r in rows]
        kinds = {_kind(c) for c in cells if c != ""}
        kind = kinds.pop() if len(kinds) == 1 else "double" if kinds == {"bigint", "double"} else "string"
        fields.append(T.StructField(name.strip().lower(), T._parse_datatype_string(kind), "" in cells or not cells))
    return T.StructType(fields)


def _cell(text: Column, kind: T.DataType) -> tuple[Column, Column]:
    """The value of a cell, and whether it is bad; empty is null."""
    cell = F.when(text != "", text)
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
        full = F.when(cell.rlike(r"^\d{2}:"), F.concat(F.lit("1970-01-01 "), cell)).otherwise(cell)
        value = F.when(full.rlike(rf"^{_DATE}"), full).try_cast(kind)
    else:
        value = cell.try_cast(kind)
    return value, cell.isNotNull() & value.isNull()


def _rows(lines: DataFrame, n: int) -> DataFrame:
    """The cells of lines of text as c0, c1, ... and the number of cells."""
    names = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(n + 1)])
    parsed = F.from_csv("value", names.simpleString()[7:-1].replace(":", " "), {"mode": "PERMISSIVE", "escape": '"'})
    cells = lines.select(parsed.alias("r"), "value").filter(F.length(F.trim("value")) > 0)
    return cells.select("r.*")


def load_lines(lines: DataFrame, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Rows of text lines (column value, no header) by position: those that fit, and those that don't
    (their cells as text)."""
    return load_cells(_rows(lines, len(schema.fields)), schema)


def load_cells(cells: DataFrame, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """The same from cells c0, c1, ... as text, one column more than the schema has."""
    n = len(schema.fields)
    parts = [_cell(F.col(f"c{i}"), f.dataType) for i, f in enumerate(schema.fields)]
    bad = F.col(f"c{n}").isNotNull()
    for i, f in enumerate(schema.fields):
        bad = bad | parts[i][1] | (F.lit(not f.nullable) & parts[i][0].isNull())
    marked = cells.withColumn("bad", F.coalesce(bad, F.lit(False)))
    good = marked.filter(~F.col("bad")).select(*[v.alias(f.name) for (v, _), f in zip(parts, schema.fields, strict=True)])
    return good, marked.filter("bad").select(*[f"c{i}" for i in range(n)])


def _all_nullable(schema: T.StructType) -> T.StructType:
    """Rows after the sample may have empty cells too."""
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


def _cells(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The cells of files, each without its first row; quoted cells may hold line breaks."""
    names = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(n + 1)])
    return spark.read.schema(names).csv(path, header=True, multiLine=True, enforceSchema=True, escape='"', quote='"', mode="PERMISSIVE")


def copy_into(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """COPY INTO: the file's first row is skipped and cells are taken by position. Blank lines are no rows."""
    return load_cells(_cells(spark, path, len(schema.fields)), schema)


def create_as_copy(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """CREATE TABLE AS COPY: the schema comes from the header and the first rows."""
    head = [r.value for r in spark.read.text(path).limit(SAMPLE_ROWS + 1).collect()]
    return copy_into(spark, path, _all_nullable(infer_schema(head)))


def from_text(spark: SparkSession, text: str, schema: T.StructType | None = None) -> tuple[DataFrame, DataFrame]:
    """The same for CSV text in memory."""
    lines = text.splitlines()
    schema = schema or _all_nullable(infer_schema(lines))
    return load_lines(spark.createDataFrame([(x,) for x in lines[1:]], "value string"), schema)
