"""Tables partitioned by RANGE or LIST of one column, as a directory per partition.

The partition's name is a column ``__part`` of the layout; filters on the source column are turned into
filters on it, so Spark prunes directories.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PART = "__part"


@dataclass
class RangePartitions:
    """Partitions by upper bounds (exclusive), in order; a bound of None is MAXVALUE. Nulls go to the first."""

    column: str
    bounds: list[tuple[str, Any]]

    def name_of(self) -> Column:
        c = F.col(self.column)
        out = F.when(c.isNull(), self.bounds[0][0])
        for name, bound in self.bounds:
            out = out.when(F.lit(True) if bound is None else c < F.lit(bound), name)
        return out

    def meeting(self, low: Any = None, high: Any = None) -> list[str]:
        """Partitions that can hold values in low <= x <= high."""
        found, before = [], None
        for name, bound in self.bounds:
            if (high is None or before is None or before <= high) and (low is None or bound is None or low < bound):
                found.append(name)
            before = bound
        return found


@dataclass
class ListPartitions:
    """Partitions by lists of values; ``default`` takes the rest, nulls too if no list has them."""

    column: str
    lists: dict[str, list]
    default: str | None = None

    def name_of(self) -> Column:
        c, out = F.col(self.column), F.when(F.lit(False), "")
        for name, values in self.lists.items():
            hit = c.isin([v for v in values if v is not None])
            out = out.when(hit | c.isNull() if None in values else hit, name)
        return out.otherwise(self.default) if self.default else out

    def meeting(self, values: list) -> list[str]:
        """Partitions that can hold any of the values."""
        where = {v: name for name, listed in self.lists.items() for v in listed}
        return sorted({where.get(v, self.default) for v in values} - {None})


@dataclass
class PartitionedTable:
    """A Parquet directory dealt by a scheme."""

    spark: SparkSession
    path: str
    scheme: RangePartitions | ListPartitions

    def write(self, frame: DataFrame, mode: str = "errorifexists") -> PartitionedTable:
        """Deal the rows; a row that no partition takes is an error."""
        name = F.coalesce(self.scheme.name_of(), F.raise_error(F.lit("a row fits no partition")))
        dealt = frame.withColumn(PART, name.cast("string"))
        dealt.write.partitionBy(PART).mode(mode).parquet(self.path)
        return self

    def read(self, parts: list[str] | None = None) -> DataFrame:
        """The rows, of some partitions only if given."""
        rows = self.spark.read.parquet(self.path)
        return (rows if parts is None else rows.filter(F.col(PART).isin(parts))).drop(PART)

    def between(self, low: Any = None, high: Any = None) -> DataFrame:
        """Rows with low <= column <= high, from the partitions that can have them (RANGE)."""
        c, rows = F.col(self.scheme.column), self.read(self.scheme.meeting(low, high))
        rows = rows if low is None else rows.filter(c >= F.lit(low))
        return rows if high is None else rows.filter(c <= F.lit(high))

    def among(self, values: list) -> DataFrame:
        """Rows with the column among the values (LIST)."""
        return self.read(self.scheme.meeting(values)).filter(F.col(self.scheme.column).isin(values))

    def matching(self, keys: DataFrame, key: str) -> DataFrame:
        """Rows whose column is among ``keys``: the keys' partitions prune at run time, then a semi join."""
        named = keys.select(F.col(key).alias(self.scheme.column)).distinct().withColumn(PART, self.scheme.name_of().cast("string"))
        return self.spark.read.parquet(self.path).join(named, [PART, self.scheme.column], "left_semi").drop(PART)

    def partitions(self) -> DataFrame:
        """A row per partition: its name and rows."""
        return self.spark.read.parquet(self.path).groupBy(F.col(PART).alias("partition")).agg(F.count(F.lit(1)).alias("rows"))
