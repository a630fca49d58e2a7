"""Vendor dumps written for these tests, with the rows they stand for."""

from netlattice.sources import tables, vendor

CISCO = """show ip route
Gateway of last resort is 10.0.0.1 to network 0.0.0.0

     10.0.0.0/24 is subnetted, 2 subnets
O IA    10.1.2.0 [110/20] via 10.0.0.9, 1d02h, Serial0/0
                 [110/20] via 10.0.0.13, 1d02h, Serial0/1
C       10.1.3.0 is directly connected, Loopback0
     172.16.0.0/16 is variably subnetted, 2 subnets, 2 masks
O E2    172.16.4.0/22
           [110/1] via 10.0.0.9, 3w, Serial0/0
C       10.0.0.8/30 is directly connected, Serial0/0
S*   0.0.0.0/0 [1/0] via 10.0.0.10
"""


def lines(spark, text, path="a"):
    rows = [(path, i, x) for i, x in enumerate(text.splitlines()) if x.strip()]
    return spark.createDataFrame(rows, "path string, line int, value string")


def rows(found):
    return [(r["dest"], r["gateway"], r["interface"], r["tag"]) for r in found.orderBy("line").collect()]


def test_cisco(spark):
    assert rows(vendor.cisco(lines(spark, CISCO))) == [
        ("10.1.2.0/24", "10.0.0.9", "Serial0/0", "Oi"),
        ("10.1.2.0/24", "10.0.0.13", "Serial0/1", "Oi"),
        ("10.1.3.0/24", "DIRECT", "loopback0", "D"),
        ("172.16.4.0/22", "10.0.0.9", "Serial0/0", "O2"),
        ("10.0.0.8/30", "DIRECT", "Serial0/0", "D"),
        ("0.0.0.0/0", "10.0.0.10", "Serial0/0", "S"),
    ]


def test_foundry_layouts(spark):
    old = "1".ljust(7) + "10.1.0.0/16".ljust(20) + "10.0.0.1".ljust(16) + "ve 3".ljust(11) + "1".ljust(7) + "S"
    new = "1".ljust(7) + "10.2.0.0/16".ljust(20) + "10.0.0.2".ljust(16) + "ve 4".ljust(12) + "110/2".ljust(14) + "O2"
    mask = "1".ljust(8) + "10.3.0.0".ljust(16) + "255.255.0.0".ljust(15) + "0.0.0.0".ljust(16) + "v5".ljust(11) + "1".ljust(7) + "D"
    both = lines(spark, old, "o").unionByName(lines(spark, "Type Uptime\n" + new, "n")).unionByName(lines(spark, "NetMask\n" + mask, "m"))
    found = {r["path"]: (r["dest"], r["gateway"], r["interface"], r["tag"]) for r in vendor.foundry(both).collect()}
    assert found == {"o": ("10.1.0.0/16", "10.0.0.1", "ve 3", "S"), "n": ("10.2.0.0/16", "10.0.0.2", "ve 4", "O2"), "m": ("10.3.0.0/16", "DIRECT", "v5", "D")}


def test_junos(spark):
    text = """inet.0: 5 destinations
0.0.0.0/0          *[Static/5] 1w
                    > to 10.0.0.1 via ge-0/0/0.0
10.1.0.0/16        *[OSPF/10] 1d, metric 2
                    > to 10.0.0.2 via ge-0/0/1.0
                      to 10.0.0.3 via ge-0/0/2.0
10.9.0.1/32        *[Direct/0] 2w
                    > via lo0.0
10.9.0.2/32        *[Local/0] 2w
                      Local via ge-0/0/1.0
10.66.0.0/16       *[Static/5] 2w
                      Reject
224.0.0.5/32       *[OSPF/10] 2w
inet6.0: 3 destinations
10.77.0.0/16       *[Static/5] 2w
                      Reject
"""
    assert rows(vendor.junos(lines(spark, text))) == [
        ("0.0.0.0/0", "10.0.0.1", "ge-0/0/0.0", "S"),
        ("10.1.0.0/16", "10.0.0.2", "ge-0/0/1.0", "O"),
        ("10.1.0.0/16", "10.0.0.3", "ge-0/0/2.0", "O"),
        ("10.9.0.1/32", "DIRECT", "loopback0.0", "D"),
        ("10.9.0.2/32", "DIRECT", "loopback-ge-0/0/1.0", "DL"),
        ("10.66.0.0/16", "DIRECT", "drop", "S"),
    ]


def test_readers(spark, tmp_path):
    (tmp_path / "nat").write_text("%c\nr1,10.0.0.0/8,192.0.2.0/24\n")
    (tmp_path / "resolver").write_text("r1,10.0.0.1\nr2,10.0.0.2,10.0.0.3\n% no\n")
    (tmp_path / "white").write_text("10.0.0.0/8\n10.0.0.1/8\n")
    nat = tables.read_nat(spark, f"file://{tmp_path}/nat").collect()
    assert [tuple(r) for r in nat] == [("r1", 10 << 24, 8, 0xC0000200, 24)]
    assert sorted((r["name"], len(r["ips"])) for r in tables.read_resolver(spark, f"file://{tmp_path}/resolver").collect()) == [("r1", 1), ("r2", 2)]
    assert [tuple(r) for r in tables.read_whitelist(spark, f"file://{tmp_path}/white").collect()] == [(10 << 24, 11 << 24)]


def test_a_file_in_many_splits(spark, tmp_path):
    """Lines are numbered through, whatever splits the file is read in."""
    text = [f"10.{k % 200}.0.0/16,10.0.0.{k % 9},e{k % 3},O" if k % 7 else "% no route" for k in range(3000)]
    (tmp_path / "large.csv").write_text("\r\n".join(text) + "\n")
    (tmp_path / "other.csv").write_text("a\n\nb")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        found = tables.lines_of(spark, [f"file://{tmp_path}/large.csv", f"file://{tmp_path}/other.csv"])
        assert spark.read.text(f"file://{tmp_path}/large.csv").rdd.getNumPartitions() > 8
        rows_ = sorted(map(tuple, found.collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert rows_ == sorted([("large.csv", k, x) for k, x in enumerate(text) if not x.startswith("%")] + [("other.csv", 0, "a"), ("other.csv", 2, "b")])


def test_state_goes_over_the_borders_of_stretches(spark):
    from pyspark.sql import functions as F

    values = [(p, k, None if (k * 7 + len(p)) % 5 else f"{p}{k}") for p in ("a", "bb") for k in range(0, 60, 2)]
    df = spark.createDataFrame(values, "path string, line int, value string")
    expected, last = {}, {}
    for p, k, v in values:
        last[p] = v or last.get(p)
        expected[p, k] = last[p]
    for stretch in (1, 4, 7, 1000):
        found = vendor.fill_down(df, {"filled": F.col("value")}, stretch).collect()
        assert {(r["path"], r["line"]): r["filled"] for r in found} == expected
        sides = vendor.beside(df, {"line": "prev"}, {"value": "next"}, stretch).collect()
        by = {(p, k): v for p, k, v in values}
        assert {(r["path"], r["line"]): (r["prev"], r["next"]) for r in sides} == {(p, k): (k - 2 if k else None, by.get((p, k + 2))) for p, k in by}
