"""SQL text in, DataFrames out: Spark SQL under the engine's settings, over tables by name."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession

from quern import dialect
from quern.operators.recursive import recursive_union
from quern.session import configure

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


class Engine:
    """A set of named tables and the statements over them."""

    def __init__(self, spark: SparkSession):
        self.spark = configure(spark)
        self.frames: dict[str, DataFrame] = {}

    def with_tables(self, folder: str, names: list[str] | None = None) -> Engine:
        """Register Parquet tables of a folder; they are read when a query names them."""
        self.folder, self.names = str(folder).rstrip("/"), names or TABLES
        return self

    def register(self, name: str, frame: DataFrame) -> Engine:
        """Register a DataFrame under a name."""
        self.frames[name.lower()] = frame
        return self

    def query(self, sql: str, *args, **named) -> DataFrame:
        """A SELECT in the engine's dialect; ``?``, ``$1`` and ``:name`` take arguments."""
        words = {w.lower() for w in _words(sql)}
        for name in getattr(self, "names", ()):
            if name in words and name not in self.frames:
                self.frames[name] = self.spark.read.parquet(f"{self.folder}/{PurePosixPath(name)}.parquet")
        for name, frame in self.frames.items():
            if name in words:
                frame.createOrReplaceTempView(name)
        return self._planned(dialect.bound(dialect.plain(sql), list(args), named))

    def _planned(self, sql: str) -> DataFrame:
        """Spark's plan; a recursive table with UNION (distinct) is worked out first."""
        found = dialect.recursive_tables(sql)
        if found is None:
            return dialect.planned(self.spark, sql)
        tables, rest = found
        for name, columns, body, parts in tables:
            if parts is None:
                frame = dialect.planned(self.spark, body)
                frame = frame.toDF(*columns) if columns else frame
            else:
                anchor = dialect.planned(self.spark, parts[0])
                anchor = anchor.toDF(*columns) if columns else anchor

                def step(fresh: DataFrame, name: str = name, text: str = parts[1]) -> DataFrame:
                    fresh.createOrReplaceTempView(name)
                    return dialect.planned(self.spark, text)

                frame = recursive_union(anchor, step)
            frame.createOrReplaceTempView(name)
        return dialect.planned(self.spark, rest)


def _words(sql: str) -> list[str]:
    import re

    return re.findall(r"\w+", re.sub(r"'(?:[^']|'')*'", " ", sql))
