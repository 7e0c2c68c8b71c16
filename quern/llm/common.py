"""What several operators share: Arrow batches in and out, and columns that pass through."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: White space of all word and line contracts: space and \t \n \v \f \r.
SPACES = b" \t\n\x0b\x0c\r"


#: Tables that operators keep in a Python worker from task to task.
_KEPT: list[dict] = []


def keeps() -> dict:
    """An empty table that lasts while this worker runs tasks of the one operator that fills it."""
    _KEPT.append({})
    return _KEPT[-1]


def only(own: dict | None = None) -> None:
    """Empty the tables of all operators but this one."""
    if others := [x for x in _KEPT if x is not own and x]:
        for table in others:
            table.clear()
        gc.collect()


def give_back() -> None:
    """Return free memory to the system: a worker lives on between tasks, and what it holds counts as the executor's."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator], alone: bool = True) -> Callable[[Iterator[pa.RecordBatch]], Iterator]:
    """``run`` with free memory given back at the task's end; ``alone``: without other operators' tables beside it."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator:
        if alone:
            only()
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def text_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null is empty."""
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


def pieces(batch: pa.RecordBatch, text: str, max_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``max_bytes`` of text, one row at least."""
    at = total = 0
    lengths = batch.column(text).cast(pa.binary())
    for i, n in enumerate(pa.compute.binary_length(lengths).to_pylist()):
        total += n or 0
        if total >= max_bytes:
            yield batch.slice(at, i + 1 - at)
            at, total = i + 1, 0
    if at < batch.num_rows:
        yield batch.slice(at)


def with_columns(
    docs: DataFrame,
    add: list[tuple[str, str]],
    compute: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[pa.RecordBatch, dict[str, list | pa.Array]]]],
) -> DataFrame:
    """``docs`` with new columns worked out batch by batch in Python.

    ``compute`` maps batches to (batch, values by column); a column named as an existing one takes
    its place. All other columns pass through, whatever their names and types.
    """
    import pyspark.sql.pandas.types as arrow_types

    new = T.StructType([T.StructField(n, T._parse_datatype_string(t)) for n, t in add])
    names = {n for n, _ in add}
    old = [f for f in docs.schema.fields if f.name not in names]
    schema = T.StructType([*old, *new.fields])
    kinds = {f.name: arrow_types.to_arrow_type(f.dataType) for f in new.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, values in compute(batches):
            columns = [batch.column(f.name) for f in old]
            columns += [v.cast(kinds[n]) if isinstance(v := values[n], pa.Array) else pa.array(v, kinds[n]) for n in kinds]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return docs.mapInArrow(run, schema)
