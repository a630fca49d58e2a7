"""Bounded recursion over forwarding relations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlattice.operators.closure import closure
from netlattice.operators.ways import ways
from netlattice.sources.scratch import freed, saved


def fixpoint(start: DataFrame, step: Callable[[DataFrame], DataFrame], keys: list[str], bound: int | None = None, hop: int = 0) -> DataFrame:
    """Semi-naive closure: rows of ``start`` and all that ``step`` derives, each key once, with its first ``hop``.

    A round joins only the rows that are new and is written to the shared scratch
    folder; what is known is compacted now and then.  ``bound``: largest hop.
    """
    spark = start.sparkSession
    known = frontier = saved(spark, start.select(*keys).distinct().withColumn("hop", F.lit(hop)), "frontier")
    rounds, parts = 0, [known]  # parts: the tables that ``known`` reads
    while bound is None or hop < bound:
        hop += 1
        rounds += 1
        new = step(frontier).select(*keys).distinct().join(known, keys, "left_anti").withColumn("hop", F.lit(hop))
        frontier = saved(spark, new, "frontier")
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
        parts.append(frontier)
        if rounds % 8 == 0:
            known = saved(spark, known, "known")
            freed(*parts[:-1])  # the last is still the frontier
            parts = [known]
    return known


Constraint = Callable[[DataFrame, int], DataFrame]


def walks(fwd: DataFrame, targets: DataFrame, bound: int, constraint: Constraint | None = None, change: bool = False, first_only: bool = False, selves: bool = False) -> DataFrame:
    """(dst, cls, node, hop): nodes with a walk of exactly ``hop`` edges to a target, for every hop up to ``bound``.

    Longer walks are not forgotten where shorter ones exist.  A packet that stays the
    same is followed inside its class; without a constraint the bound is else reached by doubling: what is known up to h edges, prolonged by the
    walks of exactly h edges, is known up to 2 h, so the rounds are its logarithm.
    ``constraint``: (edges, hop) -> the edges that may be the walk's ``hop``-th,
    counted from the target; then every hop is a round, unless packets stay the same.
    These can also be told with their shortest walk alone (``first_only``), or where
    they come back to the target (``selves``).  ``change``: ``fwd`` has
    cls_in, src, dst, cls_out, and packets change on the way.
    """
    spark = fwd.sparkSession
    into, out = ("cls_in", "cls_out") if change else ("cls", "cls")
    state = ["dst", "cls", "node"]

    def allowed(hop: int) -> DataFrame:
        return constraint(fwd, hop) if constraint else fwd

    def before(rows: DataFrame, edges: DataFrame) -> DataFrame:
        steps = edges.select(F.col("dst").alias("node"), F.col(out).alias("cls"), F.col("src").alias("_src"), F.col(into).alias("_cls"))
        return rows.join(steps, ["node", "cls"]).select("dst", F.col("_cls").alias("cls"), F.col("_src").alias("node"), "hop")

    if not change:
        same = lambda edges: edges.select(F.col("cls").alias("cls_in"), "src", "dst", F.col("cls").alias("cls_out"))
        at = (lambda hop: same(constraint(fwd, hop))) if constraint else None
        return closure(same(fwd), targets, bound, exact=True, selves=selves, allowed=at, first_only=first_only).select("dst", "cls", "node", "hop")
    first = allowed(1).join(targets, "dst").select("dst", F.col(into).alias("cls"), F.col("src").alias("node")).distinct()
    known = saved(spark, first.withColumn("hop", F.lit(1)), "walks")
    if constraint:
        last = known
        for hop in range(2, bound + 1):
            last = saved(spark, before(last, allowed(hop)).select(*state).distinct().withColumn("hop", F.lit(hop)), "walks")
            if last.isEmpty():
                break
            known = known.unionByName(last)
        return known
    power = saved(spark, fwd.select(*dict.fromkeys([into, "src", "dst", out])).distinct(), "walk-power")
    length = 1
    while length < bound:
        longer = before(known, power).withColumn("hop", F.col("hop") + length).where(F.col("hop") <= bound).distinct()
        known = known.unionByName(saved(spark, longer, "walks"))
        length *= 2
        if length < bound:
            second = power.select(F.col("src").alias("_mid"), F.col(into).alias("_cls"), F.col("dst").alias("_dst"), F.col(out).alias("_out"))
            joined = power.join(second, (F.col("dst") == F.col("_mid")) & (F.col(out) == F.col("_cls")))
            power = saved(spark, joined.select(F.col(into), "src", F.col("_dst").alias("dst"), *([F.col("_out").alias(out)] if change else [])).distinct(), "walk-power")
    return known


def constrained_loops(fwd: DataFrame, subjects: DataFrame, bound: int, constraint: Constraint) -> DataFrame:
    """(origin, cls, hop): subjects that a packet comes back to over edges that the constraint allows at each step."""
    found = walks(fwd, subjects.select(F.col("subject").alias("dst")), bound, constraint, first_only=True, selves=True)
    return found.select(F.col("dst").alias("origin"), "cls", "hop")


def fixed_hops(fwd: DataFrame, targets: DataFrame, depth: int = 3) -> DataFrame:
    """(dst, hop, fixed, cls_in, src): whether the packet is the same before and after the ``hop``-th last edge on every walk to ``dst``.

    ``fwd``: cls_in, src, dst, cls_out.  An edge that changes a class counts if what it
    makes can still get to the target in the edges that are left.  ``cls_in`` and
    ``src`` name the smallest change (null where all is fixed).
    """
    known = walks(fwd, targets, max(1, depth - 1), change=True)
    # a packet that has arrived has no edges left
    arrived = fwd.join(targets, "dst").select("dst", F.col("cls_out").alias("cls"), F.col("dst").alias("node"), F.lit(0).alias("hop")).distinct()
    after = known.unionByName(arrived).where(F.col("hop") < depth).select(F.col("dst").alias("goal"), F.col("node").alias("dst"), F.col("cls").alias("cls_out"), "hop")
    last = fwd.join(after, ["dst", "cls_out"])
    change = F.when(F.col("cls_in") != F.col("cls_out"), F.struct("cls_in", "src"))
    found = last.groupBy(F.col("goal").alias("dst"), (F.col("hop") + 1).alias("hop")).agg(F.min(change).alias("change"))
    return found.select("dst", "hop", F.col("change").isNull().alias("fixed"), "change.cls_in", "change.src")


def reach(fwd: DataFrame, targets: DataFrame, bound: int | None = None) -> DataFrame:
    """(dst, cls, node, hop): nodes with a walk of ``hop`` >= 1 edges to a target, shortest first; one packet all the way.

    ``fwd``: cls, src, dst; ``targets``: dst.  Goes backward from the targets.
    """
    same = fwd.select(F.col("cls").alias("cls_in"), "src", "dst", F.col("cls").alias("cls_out"))
    return closure(same, targets, bound).select("dst", "cls", "node", "hop")


def transformed_reach(fwd: DataFrame, targets: DataFrame, bound: int, family: Column | None = None) -> DataFrame:
    """(dst, arrival, cls, node, hop): as ``reach`` with packets that change.

    ``fwd``: cls_in, src, dst, cls_out: a packet of class cls_in at src may arrive at
    dst as cls_out.  ``arrival`` is the class in which the packet gets to the target.
    ``family``: of cls_in or cls_out, the same for all that a packet can become; then
    no round is a join.
    """
    if family is not None:
        return closure(fwd, targets, bound, family=family)
    edges = fwd.select(F.col("cls_in").alias("before_cls"), F.col("src").alias("before"), F.col("dst").alias("node"), F.col("cls_out").alias("cls"))
    first = fwd.join(targets, "dst").select("dst", F.col("cls_out").alias("arrival"), F.col("cls_in").alias("cls"), F.col("src").alias("node"))

    def back(frontier: DataFrame) -> DataFrame:
        return frontier.select("dst", "arrival", "cls", "node").join(edges, ["cls", "node"]).select("dst", "arrival", F.col("before_cls").alias("cls"), F.col("before").alias("node"))

    return fixpoint(first, back, ["dst", "arrival", "cls", "node"], bound, hop=1)


def loops(fwd: DataFrame, bound: int | None = None) -> DataFrame:
    """(origin, cls, hop): nodes on a closed walk of at most ``bound`` edges, with its shortest length; one packet."""
    same = fwd.select(F.col("cls").alias("cls_in"), "src", "dst", F.col("cls").alias("cls_out"))
    return closure(same, None, bound, selves=True).select(F.col("node").alias("origin"), "cls", "hop")


def structural(edges: DataFrame, bound: int | None = None) -> DataFrame:
    """(src, dst, hop): pairs joined by a walk, whatever the packet."""
    pairs = edges.select("src", "dst").distinct()
    after = pairs.select(F.col("src").alias("mid"), F.col("dst").alias("far"))

    def on(frontier: DataFrame) -> DataFrame:
        return frontier.join(after, frontier["dst"] == after["mid"]).select("src", F.col("far").alias("dst"))

    return fixpoint(pairs, on, ["src", "dst"], bound, hop=1)


def trace(fib: DataFrame, starts: DataFrame, max_hops: int = 30) -> DataFrame:
    """(start, address, hop, node, lo, width): the concrete way of an address, at each node by its longest prefix.

    ``fib``: node, lo, width, nh; ``starts``: start, address, and ``asked`` if the way
    is that of a whole prefix: then only prefixes at most so wide count.  Ties go to
    the smallest next hop.  Row ``hop`` names the node reached and the prefix that led there.
    Routes and addresses meet once, whatever the number of hops.
    """
    keys = ["start", "address", *(["asked"] if "asked" in starts.columns else [])]
    begun = starts.select(*keys, F.lit(0).alias("hop"), F.col("start").alias("node"), F.lit(None).cast("long").alias("lo"), F.lit(None).cast("int").alias("width"))
    asked = F.col("asked") if "asked" in keys else F.lit(32)
    found = ways(fib.select("node", "lo", "width", "nh"), starts.select("start", "address", asked.alias("asked")), max_hops)
    return begun.unionByName(found.select(*(F.col(k).cast(starts.schema[k].dataType).alias(k) for k in keys), "hop", "node", "lo", "width"))
