"""Readers of canonical inputs: manifests, routing tables, NAT rules, resolvers, pair lists, whitelists."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netlattice.functions.ip import hosts, ip_to_long, network, prefix_ip, prefix_width


@dataclass
class Manifest:
    """A network description: routers with their table files, and optional files beside them."""

    nodes: list[tuple[str, str]]
    resolver: str | None = None
    nat: str | None = None
    pairs: str | None = None
    expected: tuple[int, int] | None = None
    folder: str = field(default="")


def whole_text(spark: SparkSession, path: str) -> str:
    rows = spark.read.text(path, wholetext=True).collect()
    return rows[0][0] if rows else ""


def read_manifest(spark: SparkSession, path: str) -> Manifest:
    """The manifest itself is small; the files it names are only listed."""
    root = ET.fromstring(whole_text(spark, path))
    folder = path.rpartition("/")[0]

    def file_of(tag: str) -> str | None:
        e = root.find(f"data/{tag}")
        return f"{folder}/{e.get('file')}" if e is not None else None

    result = root.find("test/result")
    expected = (int(result.get("sat")), int(result.get("unsat"))) if result is not None else None
    nodes = [(e.get("name"), f"{folder}/{e.get('file')}") for e in root.findall("data/node")]
    return Manifest(nodes, file_of("resolver"), file_of("nat"), file_of("pair-list"), expected, folder)


def lines_of(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(path, line, value) of the lines of files, numbered from 0, without comments (``%``) and empty lines.

    Files may be of any size: Spark reads them in splits, lines are numbered inside
    their split, and the splits before a split say where its numbers begin.
    """
    text = spark.read.option("lineSep", "\n").text(paths)
    rows = text.select(F.col("_metadata.file_name").alias("path"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "\r$", "").alias("value"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n")).select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy("file", "block").orderBy("at")) - 1
    numbered = rows.withColumn("place", place).join(base, ["file", "block"])
    return numbered.select("path", (F.col("base") + F.col("place")).cast("int").alias("line"), "value").where(~F.col("value").startswith("%") & (F.trim("value") != ""))


def prefixes_of(df: DataFrame, text: str) -> DataFrame:
    """Adds lo, width, hi of a textual prefix, host bits cleared."""
    ip, width = prefix_ip(F.col(text)), prefix_width(F.col(text))
    lo = network(ip, width)
    return df.withColumn("lo", lo).withColumn("width", width).withColumn("hi", lo + hosts(width))


def parsed_fib(lines: DataFrame) -> DataFrame:
    """(node, line, gateway, interface, tag, lo, width, hi) from (node, line, value) of 'dest,gateway,interface,tag'."""
    f = F.split(F.trim("value"), ",")
    rows = lines.select("node", "line", f[0].alias("dest"), f[1].alias("gateway"), F.coalesce(F.get(f, F.lit(2)), F.lit("")).alias("interface"), F.get(f, F.lit(3)).alias("tag"))
    return prefixes_of(rows, "dest").drop("dest")


def read_fib(spark: SparkSession, nodes: list[tuple[str, str]]) -> DataFrame:
    """Routing tables of several routers; several routers may share a file."""
    if not nodes:
        return parsed_fib(spark.createDataFrame([], "node string, line int, value string"))
    names = spark.createDataFrame([(n, p.rpartition("/")[2]) for n, p in nodes], "node string, path string")
    return parsed_fib(lines_of(spark, sorted({p for _, p in nodes})).join(F.broadcast(names), "path"))


def read_fib_list(spark: SparkSession, path: str) -> DataFrame:
    """Routing tables of the routers in a list of 'router,file'; files lie beside the list."""
    folder = path.rpartition("/")[0]
    f = F.split(F.trim("value"), ",")
    listed = lines_of(spark, path).select(f[0].alias("node"), f[1].alias("file")).collect()  # one row a router
    return read_fib(spark, [(r["node"], f"{folder}/{r['file'].strip()}") for r in listed])


def read_nat(spark: SparkSession, path: str) -> DataFrame:
    """(src_router, src_ip, src_width, dst_ip, dst_width) from 'router,inner prefix,outer prefix'."""
    f = F.split(F.trim("value"), ",")
    rows = lines_of(spark, path).select(f[0].alias("src_router"), f[1].alias("src"), f[2].alias("dst"))
    return rows.select("src_router", *(c for side in ("src", "dst") for c in (prefix_ip(F.col(side)).alias(f"{side}_ip"), prefix_width(F.col(side)).alias(f"{side}_width"))))


RESOLVER = "row int, name string, ips array<bigint>"


def read_resolver(spark: SparkSession, path: str | None) -> DataFrame:
    """(row, name, ips) from lines 'name,ip,ip,...' of any length."""
    if path is None:
        return spark.createDataFrame([], RESOLVER)
    f = F.split(F.trim("value"), ",")
    ips = F.transform(F.slice(f, 2, F.size(f)), ip_to_long)
    return lines_of(spark, path).select(F.col("line").alias("row"), f[0].alias("name"), ips.alias("ips"))


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    f = F.split(F.trim("value"), ",")
    return lines_of(spark, path).select(f[0].alias("name1"), f[1].alias("name2"))


def read_whitelist(spark: SparkSession, path: str) -> DataFrame:
    """(lo, hi) of one prefix a line; a prefix with host bits set excludes nothing."""
    rows = lines_of(spark, path).select(prefix_ip(F.trim("value")).alias("ip"), prefix_width(F.trim("value")).alias("width"))
    return rows.where(network(F.col("ip"), F.col("width")) == F.col("ip")).select(F.col("ip").alias("lo"), (F.col("ip") + hosts(F.col("width"))).alias("hi"))
