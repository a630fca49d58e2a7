"""From routing rows to a network graph: targets, identities, sinks, edges, NAT edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlattice.functions.ip import ip_to_long, prefix_text

RESOLVED, DESTINATION, SPECIAL = 1, 2, 4
#: Names of the special vertices; a sink other than ``#drop`` counts as delivered.
LOOPBACK, DROP, NAT, MERGED = "#loopback", "#drop", "#nat", "merged"


def kind(gateway: Column, interface: Column) -> Column:
    """loopback | drop | direct | gateway of a routing row."""
    own = interface.contains("loopback") | (interface == "lb1")
    return F.when(gateway != "DIRECT", "gateway").when(own, "loopback").when(interface == "drop", "drop").otherwise("direct")


def classified(fib: DataFrame) -> DataFrame:
    """Adds ``kind`` and the target's address (``target_ip``, ``target_width``; null for special vertices)."""
    k = kind(F.col("gateway"), F.col("interface"))
    rows = fib.withColumn("kind", k)
    ip = F.when(F.col("kind") == "gateway", ip_to_long(F.when(F.col("kind") == "gateway", F.col("gateway")))).when(F.col("kind") == "direct", F.col("lo"))
    width = F.when(F.col("kind") == "gateway", F.lit(32)).when(F.col("kind") == "direct", F.col("width"))
    return rows.withColumn("target_ip", ip).withColumn("target_width", width)


def self_prefixes(classified_fib: DataFrame) -> DataFrame:
    """(node, ip, width): a router is known by its last loopback row."""
    own = classified_fib.where("kind = 'loopback'")
    return own.groupBy("node").agg(F.max_by(F.struct("lo", "width"), "line").alias("own")).select("node", F.col("own.lo").alias("ip"), F.col("own.width").alias("width"))


def aliases(resolver: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ip, rep) and (name, rep) from rows (row, name, ips): addresses of one row are one host.

    The first address stands for the row; where an address or a name repeats, the last row wins.
    """
    flat = resolver.select("row", "name", F.col("ips")[0].alias("rep"), F.explode("ips").alias("ip"))
    by_ip = flat.groupBy("ip").agg(F.max_by("rep", "row").alias("rep"))
    by_name = resolver.where(F.size("ips") > 0).groupBy("name").agg(F.max_by(F.col("ips")[0], "row").alias("rep"))
    return by_ip, by_name


def keyed(df: DataFrame, by_ip: DataFrame, ip: str, width: str, out: str) -> DataFrame:
    """Adds the identity of the vertex at (ip, width): a host's representative, or the prefix itself."""
    known = by_ip.select(F.col("ip").alias("_ip"), F.col("rep").alias("_rep"))
    joined = df.join(known, (df[ip] == F.col("_ip")) & (df[width] == 32), "left")
    return joined.withColumn(out, prefix_text(F.coalesce("_rep", ip), F.col(width))).drop("_ip", "_rep")


def spliced(fib: DataFrame, nodes: DataFrame, resolver: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of all routers' tables, vertices with one identity being one.

    ``fib``: node, line, lo, width, hi, gateway, interface; ``nodes``: node, seq (all
    routers, also those without rows); ``resolver``: row, name, ips.  Vertices: vid,
    name, flag.  Edges: src, dst, lo, width, hi, interface, tag if ``fib`` has it.
    """
    by_ip, by_name = aliases(resolver)
    rows = classified(fib)
    own = nodes.join(self_prefixes(rows), "node", "left")
    own = keyed(own, by_ip, "ip", "width", "_by_prefix").join(by_name.withColumnRenamed("name", "node"), "node", "left")
    named = F.when(F.col("rep").isNotNull(), prefix_text(F.col("rep"), F.lit(32))).otherwise(F.concat(F.lit("name:"), F.col("node")))
    routers = own.select("node", "seq", F.coalesce("_by_prefix", named).alias("vid"))

    special = F.when(F.col("kind") == "loopback", LOOPBACK).when(F.col("kind") == "drop", DROP)
    targeted = keyed(rows, by_ip, "target_ip", "target_width", "_target").withColumn("dst", F.coalesce(special, "_target")).drop("_target")
    columns = [c for c in ("lo", "width", "hi", "interface", "tag", "kind") if c in targeted.columns]
    edges = targeted.join(routers.select("node", F.col("vid").alias("src")), "node").select("src", "dst", *columns)

    parts = routers.select("vid", F.struct("seq", F.col("node").alias("name")).alias("named"), F.lit(RESOLVED).alias("flag"))
    none = F.lit(None).cast(parts.schema["named"].dataType)
    hops = edges.select(F.col("dst").alias("vid"), none.alias("named"), F.when(F.col("kind") == "gateway", 0).otherwise(DESTINATION).bitwiseOR(F.when(F.col("dst").startswith("#"), SPECIAL).otherwise(0)).alias("flag"))
    specials = fib.sparkSession.createDataFrame([(LOOPBACK,), (DROP,), (NAT,)], "vid string").select("vid", none.alias("named"), F.lit(SPECIAL).alias("flag"))
    every = parts.unionByName(hops).unionByName(specials)
    # the last router's name stays where identities meet
    vertices = every.groupBy("vid").agg(F.max("named").alias("named"), F.bit_or("flag").alias("flag"))
    vertices = vertices.select("vid", F.coalesce("named.name", F.when(F.col("vid").startswith("#"), F.substring("vid", 2, 100))).alias("name"), "flag")
    return vertices, edges.drop("kind")


def nat_edges(nat: DataFrame, vertices: DataFrame) -> DataFrame:
    """Three edges per rule (src_router, src_ip, src_width, dst_ip, dst_width); unknown routers are left out.

    Into the network by the outer prefix (outbound), from the router to the
    translator by anything (inbound), and from the translator to nowhere by the
    inner prefix.  The first two carry the rule: (before, after) is (inner, outer)
    outbound and (outer, inner) inbound, on the destination address.
    """
    routers = vertices.where(F.col("flag").bitwiseAND(RESOLVED) != 0).select(F.col("name").alias("src_router"), F.col("vid").alias("router"))
    rules = nat.join(routers, "src_router")

    def edge(src: Column, dst: Column, ip: Column, width: Column, before: str | None, after: str | None) -> Column:
        rule = [F.col(f"{side}_{x}") if side else F.lit(None).cast("long" if x == "ip" else "int") for side in (before, after) for x in ("ip", "width")]
        return F.struct(src.alias("src"), dst.alias("dst"), ip.cast("long").alias("lo"), width.cast("int").alias("width"), *(c.alias(n) for c, n in zip(rule, ("in_lo", "in_width", "out_lo", "out_width"), strict=True)))

    three = F.array(
        edge(F.lit(NAT), F.col("router"), F.col("dst_ip"), F.col("dst_width"), "src", "dst"),
        edge(F.col("router"), F.lit(NAT), F.lit(0), F.lit(0), "dst", "src"),
        edge(F.lit(NAT), F.lit(DROP), F.col("src_ip"), F.col("src_width"), None, None),
    )
    return rules.select(F.explode(three).alias("e")).select("e.*")


def sinks_merged(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices without an edge out of them, but for ``#drop``, become the one vertex ``merged``."""
    sources = edges.select(F.col("src").alias("vid")).distinct()
    sink = vertices.join(sources, "vid", "left_anti").where(F.col("vid") != DROP).select(F.col("vid").alias("dst"), F.lit(True).alias("sink"))
    moved = edges.join(sink, "dst", "left").withColumn("dst", F.when(F.col("sink"), MERGED).otherwise(F.col("dst"))).drop("sink")
    kept = vertices.join(sink.select(F.col("dst").alias("vid")), "vid", "left_anti")
    flags = vertices.join(sink.select(F.col("dst").alias("vid")), "vid", "left_semi").agg(F.bit_or("flag").alias("flag"))
    merged = flags.where("flag is not null").select(F.lit(MERGED).alias("vid"), F.lit(MERGED).alias("name"), F.col("flag").bitwiseAND(~RESOLVED).alias("flag"))
    return kept.unionByName(merged), moved


def edges_merged(edges: DataFrame) -> DataFrame:
    """(src, dst, prefixes): parallel edges are one, with the prefixes of all in order."""
    prefix = F.struct("lo", "width")
    return edges.groupBy("src", "dst").agg(F.array_sort(F.collect_set(prefix)).alias("prefixes"))


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of an undirected graph (a, b); the label is the smallest node of the component.

    Labels spread by taking the smallest of all neighbours and then that label's own label, until none changes.
    """
    from netlattice.sources.scratch import saved

    spark = edges.sparkSession
    both = saved(spark, edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "neighbours")
    labels = saved(spark, both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        closer = labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = saved(spark, closer.join(jump, "label").select("node", F.least("label", "next").alias("label"), "old"), "labels")
        labels = new.select("node", "label")
        if new.where("label <> old").isEmpty():
            return labels
