"""What shows on larger tables only: equal rows, many alike, long lists."""

import os

import pytest

from netlattice.plans import catalog as queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture
def twice(spark, tmp_path):
    """The test tables with every part twice."""
    for name in os.listdir(SF_DIR):
        if name != "part.parquet":
            os.symlink(f"{SF_DIR}/{name}", tmp_path / name)
    part = spark.read.parquet(f"{SF_DIR}/part.parquet")
    part.unionByName(part).write.parquet(str(tmp_path / "part.parquet"))
    return str(tmp_path)


def test_equal_starts_are_all_traced(spark, twice):
    found = queries.QUERIES["traceroute_prefix"](spark, twice)
    assert found.where("hop = 0").count() == spark.read.parquet(f"{twice}/part.parquet").count()
    assert found.where("hop = 1").groupBy("start", "address", "asked").count().where("count > 1").isEmpty()


def test_equal_rules_count_once(spark):
    from netlattice.operators import policy

    acl = spark.createDataFrame([(1, s, "deny" if s else "accept", 0, 0, 8) for s in range(50)] + [(1, 60, "deny", 0, 0, 8), (1, 60, "deny", 2, 1, 2), (1, 70, "deny", None, None, None)], "router int, seq int, action string, field int, lo long, hi long")
    assert sorted(r.seq for r in policy.first_alike(acl, ["router"]).collect()) == [0, 60, 60, 70]
    made = spark.createDataFrame([("a", 3, 0, 1), ("b", 9, 0, 1)], "cls string, dst_ip long, src_ip long, dst_port long")
    found = policy.acl_permits(made, acl, ["router"], ["dst_ip", "src_ip", "dst_port"])
    assert {tuple(r) for r in found.collect()} == {(1, "a", "accept"), (1, "b", "deny")}
