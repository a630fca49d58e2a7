"""Connected components of an edge table, by alternating large-star and small-star rounds.

Every round is two aggregations and joins on node ids and is written to the
shared scratch folder.  A hub's minimum is pre-aggregated before the shuffle;
the join of a hub with its minimum is a plain equi-join that adaptive execution
can split.  Nothing but two totals per round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import saved


def _star(edges: DataFrame) -> DataFrame:
    """(node, other) for both directions -> each larger other linked to the node's minimum."""
    least = edges.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("least"))
    return edges.join(least, "node")


def components(edges: DataFrame) -> DataFrame:
    """(a, b) long -> (node, label) for every node in an edge; the label is the component's smallest node."""
    spark = edges.sparkSession
    current = saved(spark, edges.where("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("other")).distinct(), "components")
    seen = None
    while True:
        both = current.unionByName(current.select(F.col("other").alias("node"), F.col("node").alias("other")))
        large = _star(both).where("other > node").select(F.col("other").alias("node"), F.col("least").alias("other")).distinct()
        large = saved(spark, large, "components-large")
        small = _star(large).select(F.explode(F.array(F.struct("node", F.col("least").alias("other")), F.struct(F.col("other").alias("node"), F.col("least").alias("other")))).alias("e")).select("e.*").where("node <> other").distinct()
        current = saved(spark, small, "components-small")
        # once every node hangs on its component's minimum, both stars leave the table as it is
        wide = [F.col(c).cast("decimal(38,0)") for c in ("node", "other")] + [F.xxhash64("node", "other").cast("decimal(38,0)")]
        now = current.agg(F.count(F.lit(1)), *(F.sum(c) for c in wide)).first()  # wide enough for any number of ids
        if now == seen:
            break
        seen = now
    return current.select("node", F.col("other").alias("label")).unionByName(current.select(F.col("other").alias("node"), F.col("other").alias("label")).distinct())
