"""The queries read every part and line; their rows are compared with SQL in test_queries.py."""

import os

import pytest

from netlattice.plans import catalog as queries
from netlattice.plans import derived

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def test_all_parts_are_prefixes(spark):
    parts = spark.read.parquet(f"{SF_DIR}/part.parquet").count()
    assert queries.QUERIES["prefix_parse"](spark, SF_DIR).count() == parts


def test_all_lines_are_routes(spark):
    t = {n: spark.read.parquet(f"{SF_DIR}/{n}.parquet") for n in ("lineitem", "supplier", "orders", "customer")}
    joined = t["lineitem"].join(t["supplier"], t["lineitem"].l_suppkey == t["supplier"].s_suppkey).join(t["orders"], t["lineitem"].l_orderkey == t["orders"].o_orderkey).join(t["customer"], t["orders"].o_custkey == t["customer"].c_custkey).where("s_nationkey <> c_nationkey")
    wanted = joined.selectExpr("cast(s_nationkey as bigint) as node", "l_partkey as pk", "cast(c_nationkey as bigint) as nh").distinct()
    found = derived.ecmp(spark, SF_DIR).join(derived.prefixes(spark, SF_DIR), ["lo", "width"]).select("node", "pk", "nh")
    assert wanted.subtract(found).isEmpty()


def test_setfield_relation_has_all_classes(spark):
    found = queries.QUERIES["setfield_relation"](spark, SF_DIR)
    parts = spark.read.parquet(f"{SF_DIR}/part.parquet").count()
    assert found.where("router = 1").select("cls_in").distinct().count() == 5 * parts  # the port is set, the address kept
    assert found.where("router = 1").count() == 5 * parts


def test_setfield_pairs_without_identical_fields(spark):
    from netlattice.operators import policy

    made = spark.createDataFrame([("a", 1, 0, 80), ("b", 2, 0, 80), ("c", 2, 0, 81)], "cls string, dst_ip long, src_ip long, dst_port long")
    rules = spark.createDataFrame([(1, 0, 0, "set", 2, 3), (2, 0, 0, "identical", 0, 0), (2, 0, 2, "identical", 0, 0)], "router int, if_id int, field int, op string, lo long, hi long")
    found = policy.setfield_pairs(made, rules, ["router", "if_id"], ["dst_ip", "src_ip", "dst_port"])
    assert sorted((r.router, r.cls_in, r.cls_out) for r in found.collect()) == [(1, i, o) for i in "abc" for o in "bc"] + [(2, x, x) for x in "abc"]


def test_traces_start_at_every_prefix(spark):
    found = queries.QUERIES["traceroute"](spark, SF_DIR).where("hop = 0")
    assert found.count() == spark.read.parquet(f"{SF_DIR}/part.parquet").count()
