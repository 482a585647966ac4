"""Connected components of a link table, without leaving the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.session import stored


def components(links: DataFrame, left: str = "x", right: str = "y") -> DataFrame:
    """``(node, root)`` for every node of a link; ``root`` is the smallest node it can reach.

    Each round gives a node the smallest label among its neighbours and itself, then the label of that
    label, so long chains shorten to half or less per round. A round reads and writes one row per node and
    link; only whether labels still changed comes to the driver. Nodes may be of any type that can be
    ordered. Links of a node with itself, repeated and reversed links change nothing; links with a null end
    are ignored; no links give no rows.
    """
    a, b = F.col(left).alias("node"), F.col(right).alias("other")
    links = links.where(F.col(left).isNotNull() & F.col(right).isNotNull())
    both = stored(
        links.select(a, b).union(links.select(F.col(right).alias("node"), F.col(left).alias("other"))).distinct(), "links"
    )
    first = both.groupBy("node").agg(F.min("other").alias("least"))
    labels = stored(first.select("node", F.least("node", "least").alias("root")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "root"), "other")
        least = near.groupBy("node").agg(F.min("root").alias("seen"))
        moved = labels.join(least, "node").select("node", F.least("root", "seen").alias("mid"), F.col("root").alias("was"))
        up = labels.select(F.col("node").alias("mid"), F.col("root").alias("up"))
        # Every label is a node, so the join finds the label's own label.
        after = stored(moved.join(up, "mid").select("node", F.least("mid", "up").alias("root"), "was"), "labels")
        labels = after.select("node", "root")
        if after.where(F.col("root") != F.col("was")).isEmpty():
            return labels
