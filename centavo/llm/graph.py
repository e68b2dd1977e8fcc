"""Connected components of a link table, by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stages


def components(links: DataFrame, held: Stages) -> DataFrame:
    """links: (a, b) of longs. Returns (id, component) for every id in a link; component is the smallest id reachable.

    Every round takes the least label of the neighbours and then the label of that label, so chains halve; labels only
    fall, and the rounds end when their sum stands still. No links: an empty table. The result is staged in held.
    """
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))).where("u != v").distinct()
    both = held(both, "both")
    labels = held(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("id"), F.least("u", "m").alias("component")), "labels")
    total = None
    while True:
        now = labels.agg(F.sum(F.col("component").cast("decimal(38,0)"))).collect()[0][0]
        if now == total or now is None:
            held.drop(both)
            return labels
        total = now
        near = both.join(labels.withColumnRenamed("id", "v"), "v").groupBy("u").agg(F.min("component").alias("m"))
        step = labels.join(near.withColumnRenamed("u", "id"), "id").select("id", F.least("component", "m").alias("component"))
        over = labels.select(F.col("id").alias("component"), F.col("component").alias("far"))
        last, labels = labels, held(step.join(over, "component", "left").select("id", F.least("component", "far").alias("component")), "labels")
        held.drop(last)
