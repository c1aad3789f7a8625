"""Connected components of a link table by minimum labels and pointer jumping, in DataFrame joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import scratch


def components(links: DataFrame) -> DataFrame:
    """(id, component): each linked id with the smallest id that it reaches. links: (a, b), any order, repeats allowed."""
    both = scratch.materialize(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = scratch.materialize(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        hooked = labels.join(near, "id").select("id", "component", F.least("component", "near").alias("low"))
        # a label is itself an id with a label; following it halves the way to the smallest
        jump = labels.select(F.col("id").alias("low"), F.col("component").alias("lower"))
        moved = scratch.materialize(hooked.join(jump, "low").select("id", F.least("low", "lower").alias("component"), (F.least("low", "lower") < F.col("component")).alias("moved")), "labels")
        labels = moved.select("id", "component")
        if not moved.where("moved").limit(1).count():
            return labels
