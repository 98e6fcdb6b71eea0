"""Connected components of a link table, by minimum labels with pointer jumping.

Each round takes, for every node, the least label among its neighbours and
then follows that label to the label's own label.  Rounds are written to the
shared folder, so lineage stays short and a lost executor costs one round.
Links never reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import dropped, stored


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, label) of every node of links(a, b), label being the least node of its component."""
    both = stored(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct())
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")))
    for _ in range(max_rounds):
        heard = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("n")).agg(F.min("label").alias("heard"))
        near = labels.join(heard, labels.node == heard.n).select("node", "label", F.least("label", "heard").alias("near"))
        own = labels.select(F.col("node").alias("near"), F.col("label").alias("far"))
        after = stored(near.join(own, "near").select("node", F.least("near", "far").alias("label"), (F.least("near", "far") < F.col("label")).alias("changed")))
        done = after.where("changed").limit(1).count() == 0
        dropped(links.sparkSession, labels)
        labels = after.select("node", "label")
        if done:
            dropped(links.sparkSession, both)
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
