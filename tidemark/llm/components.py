"""Connected components of a link table, with all state in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.util import stored


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links(a, b)``; ``root`` is the smallest node reachable.

    Each round takes, per node, the smallest label among its neighbours and itself (a map-side combined
    minimum, so a hub's links are never gathered), then follows the label's own label. Rounds are written to the
    shared folder; their number grows with the logarithm of the longest chain on usual inputs. Null ends are
    dropped, self links keep their node, repeated links change nothing, no links give no rows.
    """
    links = links.where("a is not null and b is not null").select("a", "b")
    both = stored(links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")))
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), F.col("root").alias("r")), "b")
            .groupBy("a")
            .agg(F.min("r").alias("r"))
        )
        hooked = labels.join(near.withColumnRenamed("a", "node"), "node").select(
            "node", F.col("root").alias("old"), F.least("root", "r").alias("mid")
        )
        jump = labels.select(F.col("node").alias("mid"), F.col("root").alias("far"))
        labels = stored(
            hooked.join(jump, "mid").select("node", F.least("mid", "far").alias("root"), (F.least("mid", "far") < F.col("old")).alias("moved"))
        )
        if labels.where("moved").limit(1).count() == 0:
            return labels.select("node", "root")
        labels = labels.select("node", "root")
