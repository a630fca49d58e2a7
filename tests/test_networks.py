"""Checks of whole networks against brute force over packets, and a few designed by hand."""

import pytest
from pyspark.sql import functions as F

from brute import Filtered, Routed, dotted
from netlattice.plans.headers import HeaderNetwork, firewall_bypass
from netlattice.plans.network import Network
from netlattice.sources.network_xml import read_expected
from netlattice.sources.sinks import against, trace_lines, verdict_counts
from netlattice.sources.tables import read_fib_list


def counts(found):
    return tuple(verdict_counts(found).first())


def worst(found):
    """subject -> witness (null: none)."""
    rows = found.collect()
    assert all((r["verdict"] == "sat") == (r["witness"] is not None) for r in rows)
    return {r["subject"]: r["witness"] for r in rows}


def told(expected):
    return {k: None if x is None else dotted(x) for k, x in expected.items()}


@pytest.fixture(params=[11, 24])
def case(request, spark, tmp_path):
    plain = Routed(request.param)
    listed = spark.createDataFrame(plain.listed, "lo long, hi long")
    return plain, Network.read(spark, plain.write(tmp_path), listed)


def test_checks_agree_with_brute_force(case):
    plain, net = case
    assert worst(net.loops()) == told(plain.loops())
    assert worst(net.loops(max_hops=1)) == told(plain.loops(2))
    assert worst(net.packet_loss()) == told(plain.losses())
    assert worst(net.consistency()) == told(plain.inconsistent())


def test_edge_constraints_agree_with_brute_force(spark, tmp_path):
    """At every second step from the end, half of the routers may not send."""
    plain = Routed(58)  # all that nobody routes is listed
    listed = spark.createDataFrame(plain.listed, "lo long, hi long")
    net = Network.read(spark, plain.write(tmp_path), listed)
    barred = {n for k, n in enumerate(plain.names) if k % 2}
    vids = [r["vid"] for r in net.routers.collect() if r["name"] in barred]
    may = lambda edges, hop: edges if hop % 2 else edges.where(~F.col("src").isin(vids))
    loops, losses = plain.constrained(lambda a, hop: hop % 2 or a not in barred)
    assert worst(net.loops(constraint=may)) == told(loops)
    assert worst(net.packet_loss(constraint=may)) == told(losses)


@pytest.mark.parametrize("seed", range(4))
def test_all_pairs_agree_with_brute_force(spark, tmp_path, seed):
    plain = Filtered(seed)
    (tmp_path / "net.xml").write_text(plain.document())
    found = HeaderNetwork.read(spark, f"file://{tmp_path}/net.xml").all_pairs().collect()
    assert {(r["src"], r["dst"]): r["verdict"] == "sat" for r in found} == plain.all_pairs()


def test_only_routers_on_a_way_back_are_judged(tmp_path, spark):
    """A feeder sends into a pair that loops; nothing ever comes back to it."""
    tables = {
        "feeder": "172.20.0.0/16,192.0.2.2,up,S\n192.0.2.1/32,DIRECT,loopback 0,D\n",
        "left": "172.20.0.0/16,192.0.2.3,east,O\n172.21.0.0/16,DIRECT,lan,D\n192.0.2.2/32,DIRECT,loopback 0,D\n",
        "right": "172.20.0.0/17,192.0.2.2,west,O\n192.0.2.3/32,DIRECT,loopback 0,D\n",
    }
    for name, text in tables.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "manifest.xml").write_text("<manifest><data>" + "".join(f'<node name="{n}" file="{n}"/>' for n in tables) + "</data></manifest>")
    found = Network.read(spark, f"file://{tmp_path}/manifest.xml").loops()
    assert counts(found) == (2, 0)
    assert {(r["subject"], r["witness"]) for r in found.collect()} == {("left", "172.20.0.0"), ("right", "172.20.0.0")}


def test_trace_and_nat_on_a_ring(tmp_path, spark):
    """Four routers in a ring pass a subnet on to the one that owns it; a translator turns outside traffic back into the ring."""
    own = {f"ring{k}": f"198.51.100.{k + 1}" for k in range(4)}
    for k, (name, address) in enumerate(own.items()):
        nxt = own[f"ring{(k + 1) % 4}"]
        rows = [f"{address}/32,DIRECT,loopback 9,D", f"100.64.0.0/12,{nxt},cw,O", f"100.64.{k}.0/24,DIRECT,lan,D"]
        (tmp_path / name).write_text("\n".join(rows) + "\n")
    (tmp_path / "nat").write_text("ring1,100.64.9.0/24,100.70.0.0/16\n")
    (tmp_path / "list").write_text("% router,file\nring0,ring0\nring2,ring2\n")
    nodes = "".join(f'<node name="{n}" file="{n}"/>' for n in own)
    (tmp_path / "manifest.xml").write_text(f'<manifest><data><nat file="nat"/>{nodes}</data><test><result sat="4" unsat="0"/></test></manifest>')
    net = Network.read(spark, f"file://{tmp_path}/manifest.xml")
    rows = net.trace("ring0", "100.64.3.128/25").orderBy("hop").collect()
    assert [r["node"] for r in rows] == [f"{own[f'ring{k}']}/32" for k in range(4)] + ["100.64.3.0/24"]
    lines = [r["line"] for r in trace_lines(net.trace("ring0", "100.64.3.128/25").withColumns({"start": F.lit(0), "address": F.lit(0)})).orderBy("hop").collect()]
    assert lines == [f"{own[f'ring{k}']}/32\t{'100.64.0.0/12' if k < 3 else '100.64.3.0/24'}" for k in range(4)] + ["100.64.3.0/24"]
    listed = read_fib_list(spark, f"file://{tmp_path}/list")
    assert sorted(r["node"] for r in listed.collect()) == ["ring0"] * 3 + ["ring2"] * 3
    # 100.64.9.0/24 belongs to nobody and goes round; translated packets of ring1 join it
    assert against(net.loops(), net.manifest.expected).first()["passed"]
    assert net.uses_nat() and counts(net.transformed_loops()) == (4, 0)


def router(i, name, *interfaces):
    return f'<router id="{i}" name="{name}">{"".join(interfaces)}</router>'


def interface(i, to, *fibs, more=""):
    return f'<interface id="{i}" nexthop_id="{to}">{"".join(f"<fib dest={chr(34)}{d}{chr(34)}/>" for d in fibs)}{more}</interface>'


def bypass_network(back: str) -> str:
    """The gate's way to two labs, and a management router beside it, which knows the second lab."""
    return "".join(
        [
            router(10, "lab-north"),
            router(11, "lab-south"),
            router(20, "gate", interface(1, 10, "172.30.1.0/24"), interface(2, 11, "172.30.2.0/24")),
            router(30, "wan", interface(1, 20, "172.30.0.0/16"), interface(2, 40, "198.51.100.0/24")),
            router(40, "management", interface(5, 11, "172.30.2.0/24", more=back)),
        ]
    )


@pytest.mark.parametrize(
    ("back", "expected"),
    [
        ("", (0, 2)),  # what goes to management is not routed on to a lab
        ('<transformation-nat src="198.51.100.0/24" dest="172.30.2.0/24"/><transformation-setfield><field id="1" op="identical"/></transformation-setfield>', (1, 1)),
    ],
)
def test_firewall_bypass(tmp_path, spark, back, expected):
    (tmp_path / "net.xml").write_text(f'<test><network>{bypass_network(back)}</network><result sat="{expected[0]}" unsat="{expected[1]}"/></test>')
    assert read_expected(spark, f"file://{tmp_path}/net.xml") == expected
    found = firewall_bypass(spark, f"file://{tmp_path}/net.xml", firewall="gate", outside="wan", inside="lab-")
    assert counts(found) == expected
    assert [r["dst"] for r in found.where("verdict = 'sat'").collect()] == ([11] if back else [])
