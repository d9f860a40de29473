"""Connected components of a link table, by propagating least labels and
jumping along them.  Every round is written, so lineage stays short; nothing
but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in the links (a, b): the component is
    its smallest node.  Links may repeat, in either direction; null ends are left out."""
    links = links.select("a", "b").where("a is not null and b is not null and a != b")
    both = written(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = written(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "a").hint("merge"), "a").select(F.col("b").alias("node"), "label")
        least = written(labels.unionByName(near).groupBy("node").agg(F.min("label").alias("label")), "labels")
        onward = least.select(F.col("node").alias("label"), F.col("label").alias("further"))
        jumped = written(least.join(onward.hint("merge"), "label").select("node", F.col("further").alias("label")), "labels")
        moved = jumped.join(labels.select("node", F.col("label").alias("was")).hint("merge"), "node").where("label != was")
        labels, done = jumped, moved.isEmpty()
        if done:
            return labels.withColumnRenamed("label", "component")
