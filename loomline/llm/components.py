"""Connected components of a table of links, without collecting links or labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .scratch import materialize


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """links: (a, b) of the same type. Returns (node, component) of each linked node; component is the smallest node.

    Every round each node takes the smallest label among its own and its neighbours' and then the label of that
    label, so a chain of n nodes needs about log n rounds; labels are pre-aggregated before each shuffle. Null
    ends and loops are ignored; an empty table gives an empty result.
    """
    links = links.where("a is not null and b is not null and a <> b").select("a", "b")
    edges = materialize(links.union(links.select("b", "a")).distinct().toDF("node", "other"), f"{name}-edges")
    label = materialize(edges.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("component")), name)
    while True:
        # the other end's label, or this node's own
        near = edges.join(label.withColumnRenamed("node", "other"), "other").select("node", "component")
        least = near.union(label).groupBy("node").agg(F.min("component").alias("to"))
        jump = label.select(F.col("node").alias("to"), F.col("component").alias("further"))
        after = least.join(jump, "to", "left").select("node", F.least("to", F.coalesce("further", "to")).alias("component"))
        after = materialize(after, name)
        # equal sums of labels mean equal labels, as labels only fall
        old, new = (t.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0] for t in (label, after))
        label = after
        if old == new:
            return label
