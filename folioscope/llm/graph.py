"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.shared import fitted, saved

#: Edges that one task takes at least.
EDGES = 100_000


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the smallest node that it is connected with.

    Every round a node takes the least label of its neighbours and then its label's label, so that labels move twice as far
    each time; each round's labels are saved in the shared folder. No edges give no rows.
    """
    both = saved(edges.select("a", "b").where("a <> b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b")).distinct(), "edges")
    size = both.count()
    keep = lambda df: saved(fitted(df, size, EDGES), "labels")
    labels = keep(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("component")))
    while True:
        told = both.join(labels, both["b"] == labels["node"]).select(F.col("a").alias("node"), "component", F.lit(None).cast("long").alias("old"))
        hooked = told.unionByName(labels.withColumn("old", F.col("component"))).groupBy("node").agg(F.max("old").alias("old"), F.min("component").alias("component"))
        target = labels.select(F.col("node").alias("to"), F.col("component").alias("beyond"))
        fresh = keep(hooked.join(target, F.col("component") == F.col("to")).select("node", "old", F.least("component", "beyond").alias("component")))
        if fresh.where("old <> component").isEmpty():
            return fresh.select("node", "component")
        labels = fresh.select("node", "component")
