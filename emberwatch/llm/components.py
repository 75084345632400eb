"""Connected components of a link table, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.session import written

#: Rounds double the reach of a label; a longer path than 2^ROUNDS cannot exist in practice and raises.
ROUNDS = 64


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Per node of ``links``: node and ``component``, the smallest node it can reach.

    Every round a node takes the smallest label among its neighbours and then the label of that
    label, so labels travel along stars at once and along paths in doubling steps.  Both are
    aggregates that combine before the shuffle; each round is a written table.
    """
    both = links.select(F.col(a).alias("node"), F.col(b).alias("other")).union(links.select(F.col(b), F.col(a)))
    both = written(both.distinct(), "links")
    labels = written(both.groupBy("node").agg(F.least(F.min("node"), F.min("other")).alias("component")), "labels")
    for _ in range(ROUNDS):
        near = both.join(labels.select(F.col("node").alias("other"), F.col("component").alias("offer")), "other")
        near = near.groupBy("node").agg(F.min("offer").alias("offer"))
        hop = labels.join(near, "node").select("node", F.least("component", "offer").alias("component"))
        hop = written(hop, "labels")
        jump = hop.select(F.col("node").alias("component"), F.col("component").alias("further"))
        new = hop.join(jump, "component").select("node", F.least("component", "further").alias("component"))
        new = written(new, "labels")
        changed = new.join(labels.withColumnRenamed("component", "old"), "node").where("component != old").limit(1).count()
        labels = new
        if not changed:
            return labels
    raise RuntimeError("components did not settle")
