"""All-pairs reachability and firewall bypass over network documents with policies on whole headers."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netlattice.operators.atoms import atoms
from netlattice.operators.boxes import Changes, in_share, reaching, sendable
from netlattice.operators.policy import FIELDS, WIDTHS
from netlattice.operators.reach import structural
from netlattice.operators.rules import Goal, Rules
from netlattice.sources.network_xml import NetworkTables, read_network
from netlattice.sources.scratch import saved

KEYS = ["router", "if_id"]
#: Atoms among which packets are looked for first.
FIRST = 1 << 11


class HeaderNetwork:
    """A network whose packets have several fields and may change on the way; sets of packets are boxes."""

    def __init__(self, spark: SparkSession, tables: NetworkTables, fields: list[str] = FIELDS, widths: list[int] = WIDTHS) -> None:
        self.spark, self.tables, self.fields, self.widths = spark, tables, fields, widths

    @classmethod
    def read(cls, spark: SparkSession, path: str, fields: list[str] = FIELDS, widths: list[int] = WIDTHS) -> HeaderNetwork:
        return cls(spark, read_network(spark, path), fields, widths)

    def ranges(self) -> DataFrame:
        """(field, lo, hi) of every constant."""
        t = self.tables
        dst = F.lit(0).alias("field")
        found = t.fib.select(dst, "lo", "hi").unionByName(t.acl.where("field is not null").select("field", "lo", "hi"))
        found = found.unionByName(t.nat.select(dst, F.col("in_lo").alias("lo"), F.col("in_hi").alias("hi"))).unionByName(t.nat.select(dst, F.col("out_lo").alias("lo"), F.col("out_hi").alias("hi")))
        return found.unionByName(t.setfield.where("op = 'set'").select("field", "lo", "hi"))

    @cached_property
    def atoms(self) -> DataFrame:
        """(lo, hi) of the routed field."""
        return saved(self.spark, atoms(self.ranges().where("field = 0 AND lo < hi")), "header-atoms")

    @cached_property
    def links(self) -> DataFrame:
        return self.leaving()

    def leaving(self, share: int = 1) -> DataFrame:
        """(router, if_id, nexthop, box): what leaves by an interface: routed there, and let through (after any change)."""
        t = self.tables
        sent = sendable(t.fib.select(*KEYS, "lo", "width"), t.acl, self.atoms, self.widths, share)
        return saved(self.spark, sent.join(t.interface, KEYS), "header-links")

    def changes(self, share: int = 1) -> Changes:
        return Changes(self.atoms.where(in_share("lo", share)), self.tables.nat, self.tables.setfield, self.widths)

    @cached_property
    def size(self) -> int:
        return self.tables.router.count()

    def reached(self, arriving: dict[int, tuple[int, int]] | None = None) -> DataFrame:
        """(dst, node, box, hop): as many edges as there are routers; ``arriving`` restricts packets where they arrive."""
        return reaching(self.links, self.changes(), self.tables.router.select(F.col("router").alias("dst")), self.size, arriving)

    @cached_property
    def connected(self) -> DataFrame:
        """(src, dst) joined by a walk in the graph, whatever the packet."""
        edges = self.tables.interface.select(F.col("router").alias("src"), F.col("nexthop").alias("dst"))
        return structural(edges, self.size).where("src <> dst").select("src", "dst")

    def all_pairs(self, arriving: dict[int, tuple[int, int]] | None = None, asked: DataFrame | None = None) -> DataFrame:
        """(src, dst, verdict) of every ordered pair with a way in the graph (and ``asked`` for): sat if some packet gets there.

        One packet is enough for a pair.  So packets of a share of the atoms are looked at
        first, and for pairs that none of these joins those of all atoms.
        """
        pairs = self.connected if asked is None else self.connected.join(asked, ["src", "dst"], "left_semi")
        pairs = unmet = saved(self.spark, pairs, "header-pairs")
        for share in dict.fromkeys([-(-self.atoms.count() // FIRST), 1]):
            links = self.links if share == 1 else self.leaving(share)
            boxes = reaching(links, self.changes(share), unmet.select("dst").distinct(), self.size, arriving, unmet)
            found = boxes.select(F.col("node").alias("src"), "dst").distinct()
            unmet = saved(self.spark, unmet.join(found, ["src", "dst"], "left_anti"), "header-pairs")
            if unmet.isEmpty():
                break
        return pairs.join(unmet.withColumn("hit", F.lit(False)), ["src", "dst"], "left").select("src", "dst", F.when(F.col("hit").isNull(), "sat").otherwise("unsat").alias("verdict"))

    def sizes(self) -> tuple[int, int]:
        """How many boxes the links have, and how many the product of all fields' atoms would give them."""
        product = self.atoms.count()
        for i, bits in enumerate(self.widths[1:], 1):
            ends = self.ranges().where((F.col("field") == i) & (F.col("lo") < F.col("hi"))).select(F.explode(F.array("lo", "hi")).alias("x"))
            product *= ends.where(f"x > 0 AND x < {1 << bits}").distinct().count() + 1
        return self.links.count(), product * self.tables.interface.count()


def with_tag_rules(tables: NetworkTables, firewalls: DataFrame, insiders: DataFrame, tag: int) -> NetworkTables:
    """Set-field rules on the firewalls' (router) interfaces to insiders (router): tag 1, fields before it unchanged."""
    spark = tables.setfield.sparkSession
    inside = tables.interface.join(firewalls, "router", "left_semi").join(insiders.select(F.col("router").alias("nexthop")), "nexthop", "left_semi")
    rows = [(i, "identical", 0, 0) for i in range(tag)] + [(tag, "set", 1, 2)]
    rules = spark.createDataFrame(rows, "field int, op string, lo long, hi long")
    added = inside.select("router", "if_id").crossJoin(F.broadcast(rules))
    return NetworkTables(tables.router, tables.interface, tables.fib, tables.acl, tables.nat, tables.setfield.unionByName(added.select(*tables.setfield.columns)))


def firewall_bypass(spark: SparkSession, path: str, firewall: str, outside: str, inside: str) -> DataFrame:
    """(src, dst, verdict): can a packet get from outside to an inside router without the firewall's tag?

    ``firewall`` and ``outside`` are names, ``inside`` begins those of inside routers.
    Roles are facts, the pairs in question the solutions of a rule.
    """
    return bypass(read_network(spark, path), F.when(F.col("name") == firewall, "firewall").when(F.col("name") == outside, "outside").when(F.col("name").startswith(inside), "inside"))


def bypass(tables: NetworkTables, role: Column, fields: list[str] = FIELDS, widths: list[int] = WIDTHS) -> DataFrame:
    """As ``firewall_bypass`` with roles of routers given as an expression of their columns; the last field is the tag."""
    rules = Rules()
    rules.fact("router", tables.router.select("router", role.alias("role")), ["router", "role"])
    rules.rule("asked", ["From", "To"], [Goal("router", "From", "'outside'"), Goal("router", "To", "'inside'")])
    firewalls = rules.query([Goal("router", "router", "'firewall'")])
    insiders = rules.query([Goal("router", "router", "'inside'")])
    tag = len(fields) - 1
    net = HeaderNetwork(tables.router.sparkSession, with_tag_rules(tables, firewalls, insiders, tag), fields, widths)
    return net.all_pairs({tag: (0, 1)}, rules.query([Goal("asked", "src", "dst")]))
