"""WITH RECURSIVE ... UNION (distinct), which Spark's SQL lacks: semi-naive evaluation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.storage import materialize


def recursive_union(anchor: DataFrame, step: Callable[[DataFrame], DataFrame], max_rounds: int = 10_000) -> DataFrame:
    """All distinct rows that ``anchor`` and repeated ``step`` of the newest rows give; cycles end.

    Each round joins only the newest rows and writes only what is new to the shared folder, so lineage
    stays short and a lost executor costs a round at most.
    """
    fresh = seen = materialize(anchor.distinct(), "recursive")
    for _ in range(max_rounds):
        made = step(fresh).toDF(*anchor.columns)
        made = made.select(*[F.col(c).cast(anchor.schema[c].dataType).alias(c) for c in anchor.columns]).distinct()
        fresh = materialize(made.exceptAll(made.intersect(seen)), "recursive")  # null-safe, unlike an anti join
        if fresh.isEmpty():
            return seen
        seen = seen.unionByName(fresh)
    raise RuntimeError(f"the recursion did not end in {max_rounds} rounds")
