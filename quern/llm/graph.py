"""Connected components of a graph whose edges are a table, by repeated contraction.

Each round every node picks, among itself and its neighbours, the node of the smallest hash (a new
hash each round), the edges are redrawn between the picks, and edges within one pick go. A round
leaves a fraction of the nodes, whatever the shape of the graph, so long chains take few rounds as
well. Every round's tables are written to the shared folder; nothing comes to the driver but counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.storage import materialize


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """A row per node of ``edges`` (long columns a, b): node, label. Equal labels: connected.

    Repeated edges, edges in both directions and loops are allowed. The label is some node of the
    component, not its smallest.
    """
    edges = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-edges")
    both = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels = materialize(both.select("node", F.col("node").alias("label")), f"{name}-labels")
    edges = edges.filter("a <> b")
    for turn in range(1000):
        if edges.isEmpty():
            return labels
        order = lambda c, turn=turn: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("h"), F.col(c).alias("v"))
        seen = edges.select(F.col("a").alias("node"), order("b").alias("o")).union(edges.select("b", order("a")))
        picks = seen.groupBy("node").agg(F.min("o").alias("o"))
        picks = materialize(picks.select("node", F.least("o", order("node"))["v"].alias("pick")), f"{name}-picks")
        labels = labels.join(picks.withColumnRenamed("node", "label"), "label", "left")
        labels = materialize(labels.select("node", F.coalesce("pick", "label").alias("label")), f"{name}-labels")
        edges = edges.join(picks.select(F.col("node").alias("a"), F.col("pick").alias("pa")), "a")
        edges = edges.join(picks.select(F.col("node").alias("b"), F.col("pick").alias("pb")), "b").filter("pa <> pb")
        edges = materialize(edges.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), f"{name}-edges")
    raise RuntimeError("the components did not settle")
