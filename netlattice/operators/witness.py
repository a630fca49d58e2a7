"""Counterexamples as the packets of every hop.

A closure keeps the smallest number of edges of each state.  A second pass walks
along states whose number falls by one each time; of several, the smallest is
taken, so a witness is the same in every run.  Only the states of the witnesses
asked for are visited, one round for each hop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlattice.sources.scratch import saved

PATH = ["subject", "hop", "node", "cls"]


def toward(fwd: DataFrame, known: DataFrame, starts: DataFrame) -> DataFrame:
    """(subject, hop, node, cls): the way of a packet to its target; ``hop`` counts from 0 at the start.

    ``fwd``: cls_in, src, dst, cls_out; ``known``: dst, cls, node, hop (edges to the
    target, the smallest); ``starts``: subject, dst (the target), node, cls.
    """
    spark = fwd.sparkSession
    left = saved(spark, known.groupBy("dst", "cls", "node").agg(F.min("hop").alias("left")), "witness-left")
    now = saved(spark, starts.join(left, ["dst", "cls", "node"]).select("subject", "dst", "node", "cls", "left"), "witness")
    out, hop = now.select("subject", F.lit(0).alias("hop"), "node", "cls"), 0
    steps = fwd.select(F.col("src").alias("node"), F.col("cls_in").alias("cls"), F.col("dst").alias("to"), F.col("cls_out").alias("as"))
    rest = left.select("dst", F.col("cls").alias("as"), F.col("node").alias("to"), F.col("left").alias("then"))
    while not now.isEmpty():
        hop += 1
        moves = now.join(steps, ["node", "cls"])
        ends = moves.where("left = 1 AND to = dst").withColumn("then", F.lit(0))
        on = moves.join(rest, ["dst", "as", "to"]).where("left > 1 AND then = left - 1")
        best = F.min(F.struct("to", "as")).alias("best")
        moved = ends.unionByName(on.select(ends.columns)).groupBy("subject", "dst", "then").agg(best)
        now = saved(spark, moved.select("subject", "dst", F.col("best.to").alias("node"), F.col("best.as").alias("cls"), F.col("then").alias("left")), "witness")
        out = out.unionByName(now.select("subject", F.lit(hop).alias("hop"), "node", "cls"))
        now = now.where("left > 0")
    return out


def round_trips(fwd: DataFrame, starts: DataFrame, bound: int) -> DataFrame:
    """(subject, hop, node, cls): a shortest way of each packet back to where it began, within ``bound`` edges.

    ``fwd``: cls, src, dst; ``starts``: subject (a node), cls.  Goes forward from the
    starts only, keeping the smallest number of edges of each state.
    """
    spark = fwd.sparkSession
    fwd = saved(spark, fwd.join(starts.select("cls").distinct(), "cls", "left_semi"), "trip-edges")
    steps = fwd.select("cls", F.col("src").alias("node"), F.col("dst").alias("to"))
    now = saved(spark, starts.select("subject", "cls", F.col("subject").alias("node"), F.lit(0).alias("hop")).distinct(), "trip")
    known, hop = now, 0
    while hop < bound and not now.isEmpty():
        hop += 1
        new = now.where("hop = 0 OR node <> subject").drop("hop").join(steps, ["cls", "node"]).select("subject", "cls", F.col("to").alias("node")).distinct()
        new = new.join(known.where("hop > 0"), ["subject", "cls", "node"], "left_anti")
        now = saved(spark, new.withColumn("hop", F.lit(hop)), "trip")
        known = known.unionByName(now)
    known = saved(spark, known, "trip-known")
    back = saved(spark, known.where("hop > 0 AND node = subject"), "trip-back")
    out = back
    while not (at := back.where("hop > 0")).isEmpty():
        earlier = known.select("subject", "cls", F.col("node").alias("from"), F.col("hop").alias("before"))
        into = fwd.select("cls", F.col("src").alias("from"), F.col("dst").alias("node"))
        came = at.join(into, ["cls", "node"]).join(earlier, ["subject", "cls", "from"]).where("before = hop - 1")
        back = saved(spark, came.groupBy("subject", "cls", "before").agg(F.min("from").alias("node")).select("subject", "cls", "node", F.col("before").alias("hop")), "trip-back")
        out = out.unionByName(back)
    return out.select(PATH)


def wanderings(fwd: DataFrame, starts: DataFrame, bound: int) -> DataFrame:
    """(subject, hop, node, cls): where packets go, by the smallest next hop, until they stop or come to a node again.

    ``fwd``: cls, src, dst; ``starts``: subject (a node), cls.  The last row is the node
    where a packet ends, or the first that it visits twice.
    """
    spark = fwd.sparkSession
    fwd = fwd.join(starts.select("cls").distinct(), "cls", "left_semi")
    steps = saved(spark, fwd.groupBy("cls", F.col("src").alias("node")).agg(F.min("dst").alias("to")), "wandering-edges")
    now = saved(spark, starts.select("subject", "cls", F.col("subject").alias("node"), F.array("subject").alias("seen")).distinct(), "wandering")
    out, hop = now.select("subject", F.lit(0).alias("hop"), "node", "cls"), 0
    while hop < bound and not now.isEmpty():
        hop += 1
        moved = now.join(steps, ["cls", "node"]).select("subject", "cls", F.col("to").alias("node"), "seen")
        moved = saved(spark, moved.withColumn("again", F.array_contains("seen", F.col("node"))), "wandering")
        out = out.unionByName(moved.select("subject", F.lit(hop).alias("hop"), "node", "cls"))
        now = moved.where("NOT again").select("subject", "cls", "node", F.array_append("seen", F.col("node")).alias("seen"))
    return out
