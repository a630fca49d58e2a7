"""Queries about walks: exact lengths, edge constraints, hops that never change a packet, and witnesses hop by hop."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netlattice.operators.reach import constrained_loops, transformed_reach, walks
from netlattice.operators.witness import round_trips, toward, wanderings
from netlattice.plans import queries as base
from netlattice.plans.derived import DELIVERED, duck_with
from netlattice.plans.registry import ORACLES, query
from netlattice.sources.scratch import saved

#: Edges of the longest walks that are told apart by their length.
EXACT = 6


def _goal(spark: SparkSession) -> DataFrame:
    return spark.range(DELIVERED, DELIVERED + 1).toDF("dst")


@query(base._with_recursive("SELECT cls, node, hop FROM reach", base._REACH % EXACT))
def reach_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every number of edges up to EXACT: who delivers a packet by a walk of exactly that many."""
    return walks(base._fwd(spark, sf_dir), _goal(spark), EXACT).select("cls", "node", "hop")


#: From the target back, odd edges may start at any router, even ones at routers of even number only.
_EVEN = f"even AS (SELECT cls, src AS node, 1 AS hop FROM fwd WHERE dst = {DELIVERED} UNION SELECT f.cls, f.src, r.hop + 1 FROM fwd f JOIN even r ON f.cls = r.cls AND f.dst = r.node WHERE r.hop < {EXACT} AND (r.hop % 2 = 0 OR f.src % 2 = 0))"


def alternating(edges: DataFrame, hop: int) -> DataFrame:
    return edges if hop % 2 else edges.where("src % 2 = 0")


@query(base._with_recursive("SELECT cls, node, min(hop) AS hop FROM even GROUP BY cls, node", _EVEN))
def reach_constrained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reachability under an edge constraint that depends on the step."""
    return walks(base._fwd(spark, sf_dir), _goal(spark), EXACT, alternating, first_only=True).select("cls", "node", "hop")


@query(base._with_recursive("SELECT origin, cls, min(hop) AS hop FROM even WHERE node = origin GROUP BY origin, cls",
       f"even AS (SELECT cls, dst AS origin, src AS node, 1 AS hop FROM fwd WHERE dst IN (SELECT n_nationkey FROM nation) UNION SELECT f.cls, r.origin, f.src, r.hop + 1 FROM fwd f JOIN even r ON f.cls = r.cls AND f.dst = r.node WHERE r.hop < {EXACT} AND (r.hop % 2 = 0 OR f.src % 2 = 0))"))
def loops_constrained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loops of at most EXACT edges under the same constraint."""
    return constrained_loops(base._fwd(spark, sf_dir), base._routers(spark, sf_dir), EXACT, alternating)


_FIXED = f"""late AS (SELECT dst AS goal, cls_out AS cls, dst AS node, 0 AS hop FROM changed WHERE dst IN (0, 5, 10, 15, 20, {DELIVERED})
  UNION SELECT l.goal, c.cls_in, c.src, l.hop + 1 FROM changed c JOIN late l ON c.dst = l.node AND c.cls_out = l.cls WHERE l.hop < 2),
last_ AS (SELECT l.goal, l.hop + 1 AS hop, c.cls_in, c.src, c.cls_in <> c.cls_out AS other FROM changed c JOIN late l ON c.dst = l.node AND c.cls_out = l.cls)"""


@query(base._with_recursive("SELECT goal AS dst, hop, NOT bool_or(other) AS fixed, min(CASE WHEN other THEN cls_in END) AS cls_in, arg_min(CASE WHEN other THEN src END, CASE WHEN other THEN (cls_in, src) END) AS src FROM last_ GROUP BY goal, hop", f"{base._CHANGED}, {_FIXED}"))
def must_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the last three edges before some targets: those that no walk changes the packet on, with NAT."""
    targets = spark.createDataFrame([(0,), (5,), (10,), (15,), (20,), (DELIVERED,)], "dst long")
    return base._shifted(spark, sf_dir).fixed_hops(targets)


# witnesses

_BAD_LOOP = f"SELECT subject, witness_lo AS cls FROM ({ORACLES['loop_check']}) v WHERE verdict = 'sat'"
_BAD_LOSS = f"SELECT subject, witness_lo AS cls FROM ({ORACLES['packet_loss']}) v WHERE verdict = 'sat'"


@query(duck_with("SELECT subject, hop, node, cls FROM back", recursive=True, bad=_BAD_LOOP,
    trip="SELECT subject, cls, subject AS node, 0 AS hop FROM bad UNION SELECT t.subject, t.cls, f.dst, t.hop + 1 FROM trip t JOIN fwd f ON f.cls = t.cls AND f.src = t.node WHERE t.hop < 30 AND (t.hop = 0 OR t.node <> t.subject)",
    near="SELECT subject, cls, node, min(hop) AS hop FROM trip WHERE hop > 0 GROUP BY subject, cls, node UNION ALL SELECT subject, cls, subject, 0 FROM bad",
    back="SELECT subject, cls, node, hop FROM near WHERE hop > 0 AND node = subject UNION ALL SELECT subject, cls, prev, h FROM (SELECT b.subject, b.cls, n.node AS prev, n.hop AS h, row_number() OVER (PARTITION BY b.subject, b.cls ORDER BY n.node) AS rn FROM back b JOIN fwd f ON f.cls = b.cls AND f.dst = b.node JOIN near n ON n.subject = b.subject AND n.cls = b.cls AND n.node = f.src AND n.hop = b.hop - 1) x WHERE rn = 1"))
def loop_witness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest looping packet of each router, hop by hop along a shortest way back."""
    fwd = base._fwd(spark, sf_dir)
    bad = saved(spark, base.loop_check(spark, sf_dir).where("verdict = 'sat'").select("subject", F.col("witness_lo").alias("cls")), "bad-loops")
    return round_trips(fwd, bad, 30)


@query(duck_with("SELECT subject, hop, node, cls FROM lost", recursive=True, bad=_BAD_LOSS,
    nxt="SELECT cls, src AS node, min(dst) AS goes FROM fwd GROUP BY cls, src",
    lost="SELECT subject, cls, subject AS node, 0 AS hop, [subject] AS seen, false AS again FROM bad UNION ALL SELECT l.subject, l.cls, n.goes, l.hop + 1, list_append(l.seen, n.goes), list_contains(l.seen, n.goes) FROM lost l JOIN nxt n ON n.cls = l.cls AND n.node = l.node WHERE NOT l.again AND l.hop < 30"))
def loss_witness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest lost packet of each router, hop by hop to where it ends or turns in a circle."""
    fwd = base._fwd(spark, sf_dir)
    bad = saved(spark, base.packet_loss(spark, sf_dir).where("verdict = 'sat'").select("subject", F.col("witness_lo").alias("cls")), "bad-losses")
    return wanderings(fwd, bad, 30)


@query(base._with_recursive("SELECT subject, hop, node, cls FROM path", f"""{base._TAGGED},
free AS (SELECT cls, node, target, min(hop) AS hop FROM tw WHERE arrival % 2 = 0 GROUP BY cls, node, target),
bad AS (SELECT node || ' ' || target AS subject, node, target, min(cls) AS cls FROM free WHERE node >= 15 AND node < 100 GROUP BY node, target),
path AS (SELECT b.subject, b.target, b.node, b.cls, f.hop AS remaining, 0 AS hop FROM bad b JOIN free f ON f.node = b.node AND f.target = b.target AND f.cls = b.cls
  UNION ALL SELECT subject, target, dst, cls_out, remaining - 1, hop + 1 FROM (
    SELECT p.subject, p.target, t.dst, t.cls_out, p.remaining, p.hop, row_number() OVER (PARTITION BY p.subject ORDER BY t.dst, t.cls_out) AS rn
    FROM path p JOIN tagged t ON t.src = p.node AND t.cls_in = p.cls LEFT JOIN free f ON f.node = t.dst AND f.cls = t.cls_out AND f.target = p.target
    WHERE p.remaining > 0 AND CASE WHEN p.remaining = 1 THEN t.dst = p.target AND t.cls_out % 2 = 0 ELSE f.hop = p.remaining - 1 END) x WHERE rn = 1)"""))  # fmt: skip
def bypass_witness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each pair of ``firewall_bypass`` the smallest packet that gets there without the tag, hop by hop; classes are address * 2 + tag."""
    tagged = base._tagged(spark, sf_dir)
    found = saved(spark, transformed_reach(tagged, spark.range(5).toDF("dst"), base._routers(spark, sf_dir).count(), F.expr("cls_in div 2")).where("arrival % 2 = 0"), "bypass-reach")
    bad = found.where("node >= 15 AND node < 100").groupBy("node", "dst").agg(F.min("cls").alias("cls"))
    untagged = tagged.where("NOT (dst < 5 AND cls_out % 2 = 1)")  # what arrives with the tag is no bypass
    starts = bad.select(F.concat_ws(" ", "node", "dst").alias("subject"), "dst", "node", "cls")
    return toward(untagged, found, starts)
