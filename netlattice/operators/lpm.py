"""Containment joins of addresses and prefixes as equi-joins, and longest-prefix match."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlattice.functions.ip import ALL, hosts, long, network
from netlattice.operators.atoms import cidrs, followed, numbered
from netlattice.sources.scratch import saved

#: Atoms of a piece that become rows at once.
RUN = 1 << 12


def under_prefixes(points: DataFrame, prefixes: DataFrame, at: str = "lo", on: list[str] | None = None) -> DataFrame:
    """Join ``points`` with the prefixes (lo, width) that contain ``at``; columns of prefixes get a ``p_`` in front.

    A range predicate would be a nested-loop join.  A prefix of width w contains
    an address exactly if they agree on the network of width w, so points are
    repeated for the widths that occur (at most 33) and joined by equality.
    ``on``: columns that must be equal too.
    """
    on = on or []
    widths = prefixes.select(F.col("width").alias("p_width")).distinct()
    renamed = prefixes.select(*(F.col(c) if c in on else F.col(c).alias(f"p_{c}") for c in prefixes.columns))
    keyed = points.join(F.broadcast(widths)).withColumn("p_lo", network(F.col(at), F.col("p_width")))
    return keyed.join(renamed, [*on, "p_width", "p_lo"])


def pieces(fib: DataFrame) -> DataFrame:
    """(node, lo, hi, nhs): a node's addresses cut where its longest prefix changes, with that prefix's next hops.

    Prefixes nest, so a prefix holds from its beginning, and at its end the one
    around it does; nothing else changes the match.  ``fib``: node, lo, width, nh.
    Prefixes meet those around them on node, width and network; default routes,
    which are around everything, are looked up by node alone.
    """
    routes = fib.groupBy("node", "lo", "width").agg(F.collect_set("nh").alias("nhs"))
    routes = saved(fib.sparkSession, routes.withColumn("hi", F.col("lo") + hosts(F.col("width"))), "routes")
    narrow = routes.where("width > 0")
    outer = narrow.select("node", F.col("width").alias("p_width"), F.col("lo").alias("p_lo"), F.col("hi").alias("p_hi"), F.col("nhs").alias("p_nhs"))
    widths = F.broadcast(narrow.select(F.col("width").alias("p_width")).distinct())
    keyed = narrow.select("node", "lo", "width").join(widths, F.col("p_width") < F.col("width")).withColumn("p_lo", network(F.col("lo"), F.col("p_width")))
    # a key is one prefix of one node, so the hash table of a partition is as small as its share of the routes
    around = keyed.join(outer.hint("shuffle_hash"), ["node", "p_width", "p_lo"])
    around = around.groupBy("node", "lo", "width").agg(F.max_by(F.struct("p_hi", "p_nhs"), "p_width").alias("outer"))
    defaults = routes.where("width = 0").select("node", F.col("nhs").alias("default"))
    ends = narrow.join(around, ["node", "lo", "width"], "left").join(defaults, "node", "left")
    # where the prefix around ends too, its own end says what follows
    ends = ends.where(F.col("outer").isNull() | (F.col("outer.p_hi") > F.col("hi")))
    ends = ends.select("node", F.col("hi").alias("x"), F.lit(-1).alias("width"), F.coalesce("outer.p_nhs", "default").alias("nhs"))
    events = routes.select("node", F.col("lo").alias("x"), "width", "nhs").unionByName(ends.where(F.col("x") < ALL))
    held = saved(fib.sparkSession, events.groupBy("node", "x").agg(F.max_by(F.struct("nhs"), "width")["nhs"].alias("nhs")), "held")
    cut = held.join(followed(held.select("node", "x"), keys=["node"]), ["node", "x"])
    return cut.where("nhs is not null").select("node", F.col("x").alias("lo"), F.coalesce("next", long(ALL)).alias("hi"), "nhs")


def forwarding(fib: DataFrame, atoms: DataFrame) -> DataFrame:
    """(cls, src, dst): for every atom and node the next hops of the longest matching prefixes.

    ``fib``: node, lo, width, nh; ``atoms``: lo, hi, cut at least at the ends of all
    prefixes.  ``cls`` is the atom's lo.  A node's pieces are stretches of the atoms'
    numbers, so they become rows without a join on an address.
    """
    spark = fib.sparkSession
    ends = atoms.select(F.col("lo").alias("x")).unionByName(spark.range(ALL, ALL + 1).toDF("x"))
    order = saved(spark, numbered(ends), "atom-order")
    held = pieces(fib).join(order.select(F.col("x").alias("lo"), F.col("number").alias("first")), "lo").join(order.select(F.col("x").alias("hi"), F.col("number").alias("after")), "hi")
    # in two steps, so that no array is longer than RUN, or the atoms divided by RUN
    runs = held.select("node", "nhs", "after", F.explode(F.sequence("first", F.col("after") - 1, F.lit(RUN))).alias("run"))
    rows = runs.select("node", "nhs", F.explode(F.sequence("run", F.least(F.col("after"), F.col("run") + RUN) - 1)).alias("number"))
    return rows.join(order, "number").select(F.col("x").alias("cls"), F.col("node").alias("src"), F.explode("nhs").alias("dst"))


def nearest_parents(prefixes: DataFrame) -> DataFrame:
    """(lo, width, parent_lo, parent_width) of every prefix that lies in another one; the narrowest counts."""
    distinct = prefixes.select("lo", "width").distinct()
    inside = under_prefixes(distinct, distinct).where(F.col("p_width") < F.col("width"))
    best = F.max_by(F.struct(F.col("p_lo").alias("lo"), F.col("p_width").alias("width")), "p_width")
    return inside.groupBy("lo", "width").agg(best.alias("parent")).select("lo", "width", F.col("parent.lo").alias("parent_lo"), F.col("parent.width").alias("parent_width"))


def hop_lists(fwd: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """(cls, hops, marks): what every node does with a class, as a sorted list, and its marks."""
    hops = fwd.groupBy("cls").agg(F.array_sort(F.collect_set(F.struct("src", "dst"))).alias("hops"))
    if extra is None:
        return hops.withColumn("marks", F.array().cast("array<string>"))
    marks = extra.groupBy("cls").agg(F.array_sort(F.collect_set("mark")).alias("marks"))
    return hops.join(marks, "cls", "left").withColumn("marks", F.coalesce("marks", F.array().cast("array<string>")))


def representatives(fwd: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """(hops, marks, rep): the smallest of the classes that every node forwards alike; combined before the shuffle."""
    return hop_lists(fwd, extra).groupBy("hops", "marks").agg(F.min("cls").alias("rep"))


def classes(fwd: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """(cls, rep): atoms that every node forwards alike share a representative, the smallest.

    ``extra`` (cls, mark) splits classes further, e.g. by a whitelist.  The whole
    sorted list of hops is compared, not a hash of it.  For single packets only.
    No group is held: classes meet their representative by a join, whose large
    side adaptive execution may split where many classes are alike.
    """
    lists = saved(fwd.sparkSession, hop_lists(fwd, extra), "hop-lists")
    reps = lists.groupBy("hops", "marks").agg(F.min("cls").alias("rep"))
    return lists.join(reps, ["hops", "marks"]).select("cls", "rep")


def in_ranges(points: DataFrame, ranges: DataFrame, at: str, keep: list[str]) -> DataFrame:
    """``points`` joined with the ranges [lo, hi) that hold ``at``, and the columns ``keep`` of the ranges.

    A range is taken apart into prefixes, which do not overlap, so the join is one
    of equality and each range meets a point once.
    """
    pieces = ranges.where("lo < hi").select(*keep, F.inline(cidrs(F.col("lo"), F.col("hi"))))
    found = under_prefixes(points, pieces, at=at)
    return found.select(*points.columns, *(F.col(f"p_{c}").alias(c) for c in keep))
