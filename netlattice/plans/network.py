"""Network-wide questions over routing tables: loops, loss, inconsistent forwarding, traces."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netlattice.functions.ip import hosts, ip_to_long, network
from netlattice.operators.atoms import atoms, followed
from netlattice.operators.graph import MERGED, NAT, RESOLVED, nat_edges, sinks_merged, spliced
from netlattice.operators.lpm import forwarding, in_ranges
from netlattice.operators.policy import csv_nat_relation
from netlattice.operators.reach import Constraint, constrained_loops, loops, reach, structural, trace, transformed_reach, walks
from netlattice.sources.scratch import saved
from netlattice.sources.sinks import with_witness
from netlattice.sources.tables import Manifest, read_fib, read_manifest, read_nat, read_pairs, read_resolver

LOOP_HOPS = 20  # bound of loop checks with packets that change


def not_listed(classes: DataFrame, whitelist: DataFrame | None) -> DataFrame:
    """(cls) outside the whitelist's ranges (lo, hi); atoms never straddle their ends."""
    if whitelist is None:
        return classes
    return classes.join(in_ranges(classes, whitelist.select("lo", "hi"), "cls", []).distinct(), "cls", "left_anti")


def asked_for(fwd: DataFrame, whitelist: DataFrame | None) -> DataFrame:
    """What a check looks at: every class that is not listed.

    A closure inside classes costs less than to find out which classes are alike.
    """
    if whitelist is None:
        return fwd
    asked = not_listed(fwd.select("cls").distinct(), whitelist)
    return saved(fwd.sparkSession, fwd.join(asked, "cls", "left_semi"), "asked")


def delivered_to(asked: DataFrame, goal: DataFrame, constraint: Constraint | None, bound: int | None) -> DataFrame:
    """(node, cls) with a walk to the goal, over the edges that the constraint allows at each step."""
    if constraint is None:
        return reach(asked, goal, bound).select("node", "cls")
    most = bound or asked.select("src").distinct().count()
    return walks(asked, goal, most, constraint).select("node", "cls").distinct()


def verdicts(subjects: DataFrame, bad: DataFrame, check: str) -> DataFrame:
    """(check, subject, verdict, witness_lo, witness): sat with the smallest violating class, or unsat."""
    worst = bad.groupBy("subject").agg(F.min("cls").alias("witness_lo"))
    found = subjects.distinct().join(worst, "subject", "left")
    verdict = F.when(F.col("witness_lo").isNotNull(), "sat").otherwise("unsat")
    return with_witness(found.select(F.lit(check).alias("check"), "subject", verdict.alias("verdict"), "witness_lo"))


def loop_verdicts(fwd: DataFrame, edges: DataFrame, subjects: DataFrame, whitelist: DataFrame | None = None, bound: int | None = None, constraint: Constraint | None = None) -> DataFrame:
    """Whether a packet can come back to a subject.  Subjects without any cycle in the graph get no verdict.

    ``constraint``: (edges, hop) -> the edges that may be a walk's ``hop``-th, counted from its end.
    """
    cyclic = structural(edges, bound).where("src = dst").select(F.col("src").alias("subject"))
    asked = asked_for(fwd, whitelist)
    if constraint is None:
        found = loops(asked, bound)
    else:
        found = constrained_loops(asked, subjects, bound or asked.select("src").distinct().count(), constraint)
    found = found.select(F.col("origin").alias("subject"), "cls")
    return verdicts(subjects.join(cyclic, "subject", "left_semi"), found.join(subjects, "subject", "left_semi"), "loop")


def loss_verdicts(fwd: DataFrame, edges: DataFrame, subjects: DataFrame, target, whitelist: DataFrame | None = None, disconnected: bool = False, universe: DataFrame | None = None, constraint: Constraint | None = None, bound: int | None = None) -> DataFrame:
    """Whether a packet from a subject can miss ``target``.

    Subjects without a way to it in the graph get no verdict, unless ``disconnected`` asks for them.
    ``universe`` (lo): all atoms, where some may be routed by nobody; such packets are lost everywhere.
    """
    spark = fwd.sparkSession
    goal = spark.range(1).select(F.lit(target).cast(fwd.schema["dst"].dataType).alias("dst"))
    if not disconnected:
        near = structural(edges).where(F.col("dst") == target).select(F.col("src").alias("subject"))
        subjects = subjects.join(near, "subject", "left_semi")
    asked = asked_for(fwd, whitelist)
    delivered = delivered_to(asked, goal, constraint, bound).select(F.col("node").alias("subject"), "cls")
    delivered = saved(spark, delivered.join(subjects, "subject", "left_semi"), "delivered")
    # the smallest class that is missing is the first of all, or follows one that is delivered
    order = saved(spark, followed(asked.select(F.col("cls").alias("x")).distinct()), "class-order")
    after = delivered.join(order, order["x"] == delivered["cls"]).where("next is not null").select("subject", F.col("next").alias("cls"))
    first = subjects.join(order.agg(F.min("x").alias("cls")).where("cls is not null"))
    bad = after.unionByName(first).join(delivered, ["subject", "cls"], "left_anti")
    if universe is not None:
        unrouted = universe.select(F.col("lo").alias("cls")).join(fwd.select("cls").distinct(), "cls", "left_anti")
        bad = bad.unionByName(subjects.join(not_listed(unrouted, whitelist).agg(F.min("cls").alias("cls")).where("cls is not null")))
    return verdicts(subjects, bad, "loss")


def transformed_loop_verdicts(fwd: DataFrame, edges: DataFrame, subjects: DataFrame, bound: int) -> DataFrame:
    """Whether a subject is met again, by whatever a packet (fwd: cls_in, src, dst, cls_out) has become within ``bound`` edges."""
    found = transformed_reach(fwd, subjects.select(F.col("subject").alias("dst")), bound)
    return again_verdicts(found.where("node = dst").select(F.col("dst").alias("subject"), "cls"), edges, subjects, bound)


def again_verdicts(bad: DataFrame, edges: DataFrame, subjects: DataFrame, bound: int) -> DataFrame:
    """Verdicts of loops with packets that change: ``bad`` (subject, cls) come back; subjects without a cycle in the graph get none."""
    cyclic = structural(edges, bound).where("src = dst").select(F.col("src").alias("subject"))
    return verdicts(subjects.join(cyclic, "subject", "left_semi"), bad, "transformed loop")


def consistency_verdicts(fwd: DataFrame, pairs: DataFrame, target, whitelist: DataFrame | None = None, constraint: Constraint | None = None, bound: int | None = None) -> DataFrame:
    """Whether some packet reaches ``target`` from one node of a pair (a, b, subject) only."""
    spark = fwd.sparkSession
    goal = spark.range(1).select(F.lit(target).cast(fwd.schema["dst"].dataType).alias("dst"))
    delivered = saved(spark, delivered_to(asked_for(fwd, whitelist), goal, constraint, bound), "delivered")

    def side(name: str) -> DataFrame:
        return pairs.join(delivered, pairs[name] == delivered["node"]).select("subject", "cls", F.lit(1 if name == "a" else 2).alias("side"))

    one = side("a").unionByName(side("b")).groupBy("subject", "cls").agg(F.bit_or("side").alias("sides")).where("sides < 3")
    return verdicts(pairs.select("subject"), one.select("subject", "cls"), "consistency")


class Network:
    """A network read from a manifest, its forwarding relation, and the checks over it."""

    def __init__(self, spark: SparkSession, manifest: Manifest, whitelist: DataFrame | None = None) -> None:
        self.spark, self.manifest, self.whitelist = spark, manifest, whitelist
        nodes = spark.createDataFrame([(n, i) for i, (n, _) in enumerate(manifest.nodes)], "node string, seq int")
        self.vertices_read, self.edges_read = spliced(read_fib(spark, manifest.nodes), nodes, read_resolver(spark, manifest.resolver))

    @classmethod
    def read(cls, spark: SparkSession, path: str, whitelist: DataFrame | None = None) -> Network:
        return cls(spark, read_manifest(spark, path), whitelist)

    @cached_property
    def graph(self) -> tuple[DataFrame, DataFrame]:
        """Vertices and edges with NAT edges added and sinks merged."""
        vertices, edges = self.vertices_read, self.edges_read.select("src", "dst", "lo", "width", "hi")
        none = [F.lit(None).cast(t).alias(n) for n, t in (("in_lo", "long"), ("in_width", "int"), ("out_lo", "long"), ("out_width", "int"))]
        edges = edges.select("*", *none)
        if self.manifest.nat:
            extra = nat_edges(read_nat(self.spark, self.manifest.nat), vertices)
            edges = edges.unionByName(extra.withColumn("hi", F.col("lo") + hosts(F.col("width"))))
        vertices, edges = sinks_merged(vertices, edges)
        return saved(self.spark, vertices, "vertices"), saved(self.spark, edges, "edges")

    @cached_property
    def atoms(self) -> DataFrame:
        _, edges = self.graph
        ranges = [edges.select("lo", "hi")]
        for side in ("in", "out"):
            lo, width = F.col(f"{side}_lo"), F.col(f"{side}_width")
            ranges.append(edges.where(lo.isNotNull() & (network(lo, width) == lo)).select(lo.alias("lo"), (lo + hosts(width)).alias("hi")))
        if self.whitelist is not None:
            ranges.append(self.whitelist.select("lo", "hi"))
        return saved(self.spark, atoms(*ranges), "atoms")

    @cached_property
    def fwd(self) -> DataFrame:
        """(cls, src, dst) for packets that stay as they are; edges with a NAT rule are not among them."""
        _, edges = self.graph
        plain = edges.where("in_lo is null").select("src", "dst").distinct()
        return saved(self.spark, self.routed.join(plain, ["src", "dst"], "left_semi"), "fwd")

    @cached_property
    def routed(self) -> DataFrame:
        """(cls, src, dst): where an address is routed, by longest prefix, on any edge."""
        _, edges = self.graph
        return saved(self.spark, forwarding(edges.select(F.col("src").alias("node"), "lo", "width", F.col("dst").alias("nh")), self.atoms), "routed")

    @cached_property
    def transformed(self) -> DataFrame:
        """(cls_in, src, dst, cls_out): the packet that arrives is the one that is routed (policies see it after the change)."""
        _, edges = self.graph
        same = self.fwd.select(F.col("cls").alias("cls_in"), "src", "dst", F.col("cls").alias("cls_out"))
        changed = csv_nat_relation(self.atoms, edges)
        routed = self.routed.select(F.col("cls").alias("cls_out"), "src", "dst")
        return saved(self.spark, same.unionByName(changed.join(routed, ["src", "dst", "cls_out"]).select("cls_in", "src", "dst", "cls_out")), "transformed")

    @cached_property
    def routers(self) -> DataFrame:
        vertices, _ = self.graph
        return vertices.where(F.col("flag").bitwiseAND(RESOLVED) != 0)

    def named(self, found: DataFrame) -> DataFrame:
        """Verdicts with router names for subjects."""
        names = self.routers.select(F.col("vid").alias("subject"), "name")
        return found.join(names, "subject").select("check", F.col("name").alias("subject"), "verdict", "witness_lo", "witness")

    def loops(self, max_hops: int | None = None, constraint: Constraint | None = None) -> DataFrame:
        subjects = self.routers.select(F.col("vid").alias("subject"))
        bound = None if max_hops is None else min(max_hops, self.graph[0].count()) + 1
        return self.named(loop_verdicts(self.single, self.graph[1], subjects, self.whitelist, bound, constraint))

    @property
    def single(self) -> DataFrame:
        """What a packet that never changes can follow: plain edges, and NAT edges as edges (their rule is not looked at)."""
        return self.routed

    def transformed_loops(self, max_hops: int = LOOP_HOPS) -> DataFrame:
        """As ``loops`` with packets that NAT changes: a router is met again, by whatever packet."""
        subjects = self.routers.select(F.col("vid").alias("subject"))
        return self.named(transformed_loop_verdicts(self.transformed, self.graph[1], subjects, max_hops + 1))

    def packet_loss(self, disconnected: bool = False, constraint: Constraint | None = None) -> DataFrame:
        subjects = self.routers.select(F.col("vid").alias("subject"))
        return self.named(loss_verdicts(self.single, self.graph[1], subjects, MERGED, self.whitelist, disconnected, self.atoms, constraint))

    def consistency(self, pairs: DataFrame | None = None, constraint: Constraint | None = None) -> DataFrame:
        """For pairs (name1, name2), by default those of the manifest; pairs with an unknown name get no verdict."""
        if pairs is None:
            pairs = read_pairs(self.spark, self.manifest.pairs)
        by_name = self.graph[0].where("name is not null").select("name", "vid")
        known = pairs.join(by_name.toDF("name1", "a"), "name1").join(by_name.toDF("name2", "b"), "name2")
        return consistency_verdicts(self.single, known.select("a", "b", F.concat_ws(" ", "name1", "name2").alias("subject")), MERGED, self.whitelist, constraint)

    def trace(self, start: str, prefix: str, max_hops: int = 30) -> DataFrame:
        """(hop, node, lo, width) of a prefix from a router on, over the tables as read; a route must hold all of it."""
        fib = self.edges_read.select(F.col("src").alias("node"), "lo", "width", F.col("dst").alias("nh"))
        address, _, width = prefix.partition("/")
        asked = [ip_to_long(F.lit(address)).alias("address"), F.lit(int(width or 32)).alias("asked")]
        return trace(fib, self.vertices_read.where(F.col("name") == start).select(F.col("vid").alias("start"), *asked), max_hops)

    def uses_nat(self) -> bool:
        return not self.graph[1].where(F.col("src") == NAT).isEmpty()
