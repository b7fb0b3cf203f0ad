"""Graph checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cyclic_nodes(edges: DataFrame) -> DataFrame:
    """(node, cyclic) of every node with an outgoing edge (a, b): whether a walk from it leads
    back to it.  Paths are doubled each round, so rounds are the logarithm of the longest
    walk; the graph is the policy's, of some hundred nodes."""
    spark = edges.sparkSession
    walks = edges.select("a", "b").distinct()
    size = -1
    while True:
        longer = walks.alias("x").join(walks.alias("y"), F.col("x.b") == F.col("y.a")).select(F.col("x.a").alias("a"), F.col("y.b").alias("b"))
        walks = walks.unionByName(longer).distinct()
        rows = walks.collect()  # the policy's own graph
        walks = spark.createDataFrame(rows, walks.schema)
        if len(rows) == size:
            return walks.groupBy(F.col("a").alias("node")).agg(F.bool_or(F.col("a") == F.col("b")).alias("cyclic"))
        size = len(rows)
