"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helicase.llm.common import staged


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of `edges` (a, b): nodes share a root if and only if edges connect them.

    In each round every node is merged into that neighbour (or itself) which comes first in an order drawn anew for the
    round, and edges between merged nodes remain; their number falls by a constant factor a round, for long chains too.
    Loops, repeated edges and an empty table are fine; nulls connect nothing.
    """
    edges = staged(edges.select("a", "b").filter("a is not null and b is not null").distinct(), "edges")
    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = staged(both(edges).select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node")), "labels")
    rest, turn = edges.filter("a <> b"), 0
    while not rest.isEmpty():
        turn += 1
        order = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("h"), F.col(c).alias("n"))  # noqa: E731, B023
        to = both(rest).groupBy("a").agg(F.least(F.min(order("b")), F.first(order("a"))).alias("m"))
        to = staged(to.select(F.col("a").alias("node"), F.col("m.n").alias("into")), "merges")
        step = lambda df, c: df.join(to.withColumnRenamed("node", c), c, "left").withColumn(c, F.coalesce("into", c)).drop("into")  # noqa: E731, B023
        labels = staged(step(labels, "root"), "labels")
        rest = staged(step(step(rest, "a"), "b").filter("a <> b").select("a", "b").distinct(), "edges")
    return labels.select("node", "root")
