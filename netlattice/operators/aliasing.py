"""Which addresses belong to which router: inference, merging, duplicates, missing interfaces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlattice.functions.ip import hosts, network
from netlattice.operators.lpm import under_prefixes


def single_next_hops(fib: DataFrame) -> DataFrame:
    """(node, interface, nh) of interfaces over which exactly one gateway is reached.  ``fib``: node, interface, nh."""
    return fib.groupBy("node", "interface").agg(F.countDistinct("nh").alias("n"), F.min("nh").alias("nh")).where("n = 1").drop("n")


def point_to_point(links: DataFrame, next_hops: DataFrame) -> DataFrame:
    """(node, ip) inferred from links of two hosts.

    ``links``: node, lo (of a /30), peer (the one gateway behind it); ``next_hops``:
    node, nh.  If another router's next hop lies in a node's /30 and is not the
    node's own peer, the next hop is an address of the node, and the peer one of
    the other router.  The containment is an equality of /30 networks.
    """
    other = next_hops.select(F.col("node").alias("other"), "nh", (F.col("nh") - F.col("nh") % 4).alias("lo"))
    met = links.join(other, "lo").where("node <> other and nh <> peer")
    return met.select(F.explode(F.array(F.struct(F.col("node"), F.col("nh").alias("ip")), F.struct(F.col("other").alias("node"), F.col("peer").alias("ip")))).alias("x")).select("x.*").distinct()


def merged(owned: DataFrame) -> DataFrame:
    """(node, ips): a line per router with its addresses in order."""
    return owned.groupBy("node").agg(F.array_join(F.array_sort(F.collect_set("ip")), ",").alias("ips"))


def duplicates(owned: DataFrame) -> DataFrame:
    """(ip, n) of the addresses that several routers claim."""
    return owned.groupBy("ip").agg(F.countDistinct("node").alias("n")).where("n > 1")


def unambiguous(owned: DataFrame) -> DataFrame:
    """(node, ips) without addresses that several routers claim; routers left with none get an empty list."""
    bad = duplicates(owned).select("ip")
    clean = merged(owned.join(bad, "ip", "left_anti"))
    return owned.select("node").distinct().join(clean, "node", "left").select("node", F.coalesce("ips", F.lit("")).alias("ips"))


def equivalence_lists(pairs: DataFrame) -> DataFrame:
    """(label, members) from (label, member): all members, in order."""
    return pairs.groupBy("label").agg(F.array_join(F.array_sort(F.collect_list("member")), ",").alias("members"))


def interface_filled(routes: DataFrame, known: DataFrame) -> DataFrame:
    """Routes (id, gateway) with the interface of the first known prefix that contains the gateway.

    ``known``: lo, width, interface, line; by ``line`` the first of equal prefixes
    counts, then the first of those that contain.  Unmatched routes keep a null.
    """
    first = known.groupBy("lo", "width").agg(F.min_by("interface", "line").alias("interface"), F.min("line").alias("line"))
    # few files may hold many routes: what a task has to order for its ids is a share of them all
    routes = routes.repartition(int(routes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
    hit = under_prefixes(routes, first, at="gateway").groupBy("id").agg(F.min_by("p_interface", "p_line").alias("interface"))
    return routes.join(hit, "id", "left")


def in_prefix(address: str, lo: str, width: str):
    """Whether an address column lies in a prefix of any width."""
    return network(F.col(address), F.col(width)) == F.col(lo) - F.col(lo) % hosts(F.col(width))
