"""Reader of network documents: routers with interfaces, routes, access lists and transformations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netlattice.functions.ip import hosts, network, prefix_ip, prefix_width

_FIELD = "array<struct<_name:string,_id:string,_op:string,prefix:string,integer:struct<_value:bigint,_length:int>>>"
SCHEMA = (
    "_id int, _name string, interface array<struct<_id:int,_nexthop_id:int,fib:array<struct<_dest:string>>,"
    f"acl:array<struct<_action:string,field:{_FIELD}>>,"
    "`transformation-nat`:array<struct<_src:string,_dest:string>>,"
    f"`transformation-setfield`:array<struct<field:{_FIELD}>>>>"
)
#: Field numbers by name; others are given by id.
FIELD_IDS = {"dest": 0, "src": 1, "dst-port": 2, "src-port": 3}


@dataclass
class NetworkTables:
    router: DataFrame  # router, name
    interface: DataFrame  # router, if_id, nexthop
    fib: DataFrame  # router, if_id, lo, width, hi
    acl: DataFrame  # router, if_id, seq, action, field, lo, hi
    nat: DataFrame  # router, if_id, in_lo, in_hi, out_lo, out_hi
    setfield: DataFrame  # router, if_id, field, op, lo, hi


def _range(ip: Column, width: Column) -> tuple[Column, Column]:
    """Policy prefixes with host bits match nothing: an empty range."""
    ok = network(ip, width) == ip
    return F.when(ok, ip).otherwise(0).cast("long"), F.when(ok, ip + hosts(width)).otherwise(0).cast("long")


def _conditions(f: Column) -> tuple[Column, Column, Column]:
    """Field number and range [lo, hi) of a field element."""
    number = F.coalesce(*(F.when(f["_name"] == name, i) for name, i in FIELD_IDS.items()), f["_id"].cast("int"))
    plo, phi = _range(prefix_ip(F.trim(f["prefix"])), prefix_width(F.trim(f["prefix"])))
    value = f["integer"]["_value"]
    return number, F.coalesce(value, plo), F.coalesce(value + 1, phi)


def read_expected(spark: SparkSession, path: str) -> tuple[int, int] | None:
    """(sat, unsat) that a network document says its check should give; null if it says nothing."""
    found = spark.read.format("xml").schema("_sat int, _unsat int").option("rowTag", "result").load(path).first()
    return (found["_sat"], found["_unsat"]) if found else None


def read_network(spark: SparkSession, path: str) -> NetworkTables:
    raw = spark.read.format("xml").schema(SCHEMA).option("rowTag", "router").load(path)
    router = raw.select(F.col("_id").alias("router"), F.col("_name").alias("name"))
    rows = raw.select(F.col("_id").alias("router"), F.explode("interface").alias("i"))
    key = [F.col("router"), F.col("i._id").alias("if_id")]
    interface = rows.select(*key, F.col("i._nexthop_id").alias("nexthop"))

    dest = rows.select(*key, F.explode("i.fib").alias("f")).select("router", "if_id", F.col("f._dest").alias("dest"))
    ip, width = prefix_ip(F.col("dest")), prefix_width(F.col("dest"))
    fib = dest.select("router", "if_id", network(ip, width).alias("lo"), width.alias("width"), (network(ip, width) + hosts(width)).alias("hi"))

    acl = rows.select(*key, F.posexplode("i.acl").alias("seq", "a"))
    # conditions other than 'eq' are no conditions
    fields = acl.select("router", "if_id", "seq", F.when(F.col("a._action") == "accept", "accept").otherwise("deny").alias("action"), F.explode_outer(F.filter("a.field", lambda f: f["_op"] == "eq")).alias("f"))
    number, lo, hi = _conditions(F.col("f"))
    acl = fields.select("router", "if_id", "seq", "action", number.alias("field"), lo.alias("lo"), hi.alias("hi"))

    n = rows.select(*key, F.explode("i.transformation-nat").alias("n"))
    src_lo, src_hi = _range(prefix_ip(F.col("n._src")), prefix_width(F.col("n._src")))
    out_lo, out_hi = _range(prefix_ip(F.col("n._dest")), prefix_width(F.col("n._dest")))
    nat = n.select("router", "if_id", src_lo.alias("in_lo"), src_hi.alias("in_hi"), out_lo.alias("out_lo"), out_hi.alias("out_hi"))

    s = rows.select(*key, F.explode("i.transformation-setfield").alias("s")).select("router", "if_id", F.explode("s.field").alias("f"))
    number, lo, hi = _conditions(F.col("f"))
    setfield = s.select("router", "if_id", number.alias("field"), F.when(F.col("f._op") == "identical", "identical").otherwise("set").alias("op"), lo.alias("lo"), hi.alias("hi"))
    return NetworkTables(router, interface, fib, acl, nat, setfield)
