"""All-pairs reachability and firewall bypass over headers of five fields, on a network derived from suppliers and nations.

Routers are nations, interfaces lead to the nation of their number.  Suppliers
give routes, access rules and NAT rules, nations give set-field rules.  SQL
enumerates the product of all fields' atoms; the engine works on boxes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netlattice.plans.derived import duck, spark_sql
from netlattice.plans.headers import HeaderNetwork, bypass
from netlattice.plans.registry import query
from netlattice.sources.network_xml import NetworkTables

_SUP = """SELECT k, n, width, host, raw - raw % host AS lo FROM (
  SELECT CAST(s_suppkey AS BIGINT) AS k, CAST(s_nationkey AS INT) AS n, CAST(8 + s_suppkey % 13 AS INT) AS width,
         CAST(pow(2, 24 - s_suppkey % 13) AS BIGINT) AS host, (CAST(s_suppkey AS BIGINT) * 2654435761) % 4294967296 AS raw
  FROM {supplier}) t"""

_FIB = f"""SELECT DISTINCT n AS router, CAST((n + 1 + k % 3) % 25 AS INT) AS if_id, lo, width, lo + host AS hi FROM ({_SUP}) s
UNION ALL SELECT CAST(n_nationkey AS INT), CAST((n_nationkey * 5 + 1) % 25 AS INT), CAST(0 AS BIGINT), CAST(0 AS INT), CAST(4294967296 AS BIGINT)
FROM {{nation}} WHERE n_nationkey % 4 <> 0 AND n_nationkey <> 6"""

_RULE = "n AS router, CAST((n + 1 + k % 2) % 25 AS INT) AS if_id, CAST(k AS INT) AS seq, CASE WHEN k % 7 < 2 THEN 'accept' ELSE 'deny' END AS action"
#: Conditions on destination, port and source; one row each.
_ACL = f"""SELECT {_RULE}, 0 AS field, lo, lo + host AS hi FROM ({_SUP}) a WHERE k % 3 < 2 OR (k % 4 >= 2 AND k % 5 <> 0)
UNION ALL SELECT {_RULE}, 2, k % 3, k % 3 + 1 FROM ({_SUP}) b WHERE k % 4 < 2
UNION ALL SELECT {_RULE}, 1, CAST(2147483648 AS BIGINT), CAST(4294967296 AS BIGINT) FROM ({_SUP}) c WHERE k % 5 = 0"""

_NAT = f"""SELECT n AS router, CAST((n + 1) % 25 AS INT) AS if_id, lo AS in_lo, lo + host AS in_hi,
  (lo + 16777216) % 4294967296 AS out_lo, (lo + 16777216) % 4294967296 + host AS out_hi FROM ({_SUP}) s WHERE k % 10 = 3"""

_TO = "CAST(n_nationkey AS INT) AS router, CAST((n_nationkey + 2) % 25 AS INT) AS if_id"
#: Some set the tag and keep the rest, others set the port and keep the destination only.
_SET = " UNION ALL ".join(
    [f"SELECT {_TO}, {i} AS field, 'identical' AS op, CAST(0 AS BIGINT) AS lo, CAST(0 AS BIGINT) AS hi FROM {{nation}} WHERE n_nationkey % 5 = 2" for i in range(4)]
    + [f"SELECT {_TO}, 4, 'set', CAST(1 AS BIGINT), CAST(2 AS BIGINT) FROM {{nation}} WHERE n_nationkey % 5 = 2"]
    + [f"SELECT {_TO}, 0, 'identical', CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM {{nation}} WHERE n_nationkey % 5 = 3"]
    + [f"SELECT {_TO}, 2, 'set', CAST(1 AS BIGINT), CAST(2 AS BIGINT) FROM {{nation}} WHERE n_nationkey % 5 = 3"]
)
#: What a bypass check adds: interfaces of region 1 to region 3 set the tag and keep the rest.
_TAGGED = " UNION ALL ".join(
    f"SELECT f.router, f.if_id, {i} AS field, '{'set' if i == 4 else 'identical'}' AS op, CAST({int(i == 4)} AS BIGINT) AS lo, CAST({2 * int(i == 4)} AS BIGINT) AS hi FROM face f JOIN nation a ON a.n_nationkey = f.router AND a.n_regionkey = 1 JOIN nation b ON b.n_nationkey = f.if_id AND b.n_regionkey = 3"
    for i in range(5)
)


def network_tables(spark: SparkSession, sf_dir: str) -> NetworkTables:
    read = lambda text: spark_sql(spark, sf_dir, text)
    fib = read(_FIB)
    routers = read("SELECT CAST(n_nationkey AS INT) AS router, CAST(n_name AS STRING) AS name, CAST(n_regionkey AS INT) AS region FROM {nation}")
    faces = fib.select("router", "if_id").distinct().withColumn("nexthop", F.col("if_id"))
    there = lambda df: df.join(faces.select("router", "if_id"), ["router", "if_id"], "left_semi")
    return NetworkTables(routers, faces, fib, there(read(_ACL)), there(read(_NAT)), there(read(_SET)))


def _reach_sql(select: str, rules: str, arriving: str) -> str:
    """Classes are destination * 16 + source half * 8 + port * 2 + tag."""
    return f"""WITH RECURSIVE fib AS MATERIALIZED ({duck(_FIB)}),
face AS (SELECT DISTINCT router, if_id FROM fib),
acl AS (SELECT a.* FROM ({duck(_ACL)}) a JOIN face USING (router, if_id)),
nat AS (SELECT a.* FROM ({duck(_NAT)}) a JOIN face USING (router, if_id)),
setf AS (SELECT a.* FROM ({rules}) a JOIN face USING (router, if_id)),
cfg AS (SELECT router, if_id, bool_or(field = 0 AND op = 'identical') AS same0, bool_or(field = 1 AND op = 'identical') AS same1, bool_or(field = 2 AND op = 'identical') AS same2,
        bool_or(field = 4 AND op = 'identical') AS same4, bool_or(field = 2 AND op = 'set') AS port, bool_or(field = 4 AND op = 'set') AS tag FROM setf GROUP BY router, if_id),
a0 AS MATERIALIZED (SELECT DISTINCT x AS d FROM (SELECT lo AS x FROM fib UNION SELECT hi FROM fib UNION SELECT lo FROM acl WHERE field = 0 UNION SELECT hi FROM acl WHERE field = 0
       UNION SELECT in_lo FROM nat UNION SELECT in_hi FROM nat UNION SELECT out_lo FROM nat UNION SELECT out_hi FROM nat UNION SELECT 0) e WHERE x < 4294967296),
v AS (SELECT s, p, t FROM (VALUES (0), (1)) x(s), (VALUES (0), (1), (2), (3)) y(p), (VALUES (0), (1)) z(t)),
routed AS (SELECT DISTINCT router, if_id, d FROM (SELECT f.router, f.if_id, a0.d, rank() OVER (PARTITION BY f.router, a0.d ORDER BY f.width DESC) AS rk FROM a0 JOIN fib f ON a0.d >= f.lo AND a0.d < f.hi) q WHERE rk = 1),
met AS (SELECT r.router, r.if_id, r.d, v.s, v.p, v.t, a.seq, a.action FROM routed r JOIN v ON true JOIN acl a ON a.router = r.router AND a.if_id = r.if_id
        GROUP BY ALL HAVING bool_and(CASE a.field WHEN 0 THEN r.d >= a.lo AND r.d < a.hi WHEN 1 THEN v.s = 1 ELSE v.p = a.lo END)),
first_ AS (SELECT router, if_id, d, s, p, t, arg_min(action, seq) AS action FROM met GROUP BY ALL),
leaving AS MATERIALIZED (SELECT r.router, r.if_id, r.d, v.s, v.p, v.t FROM routed r JOIN v ON true LEFT JOIN first_ f ON f.router = r.router AND f.if_id = r.if_id AND f.d = r.d AND f.s = v.s AND f.p = v.p AND f.t = v.t
       WHERE coalesce(f.action, 'accept') = 'accept'),
kept AS (SELECT l.*, c.router IS NULL AND NOT EXISTS (SELECT 1 FROM nat n WHERE n.router = l.router AND n.if_id = l.if_id) AS plain, EXISTS (SELECT 1 FROM nat n WHERE n.router = l.router AND n.if_id = l.if_id) AS natted,
         coalesce(same0, false) AS same0, coalesce(same1, false) AS same1, coalesce(same2, false) AS same2, coalesce(same4, false) AS same4
         FROM leaving l LEFT JOIN cfg c ON c.router = l.router AND c.if_id = l.if_id WHERE NOT (coalesce(c.port, false) AND p <> 1) AND NOT (coalesce(c.tag, false) AND t <> 1)),
moved AS (SELECT k.*, d AS d_in FROM kept k WHERE NOT natted AND (plain OR same0)
          UNION ALL SELECT k.*, a0.d FROM kept k JOIN a0 ON true WHERE NOT natted AND NOT plain AND NOT same0
          UNION ALL SELECT k.*, a0.d FROM kept k JOIN nat n ON n.router = k.router AND n.if_id = k.if_id AND k.d >= n.out_lo AND k.d < n.out_hi JOIN a0 ON a0.d >= n.in_lo AND a0.d < n.in_hi WHERE NOT same0 OR a0.d = k.d),
step AS MATERIALIZED (SELECT DISTINCT m.router AS src, m.if_id AS dst, m.d_in * 16 + v.s * 8 + v.p * 2 + v.t AS cls_in, m.d * 16 + m.s * 8 + m.p * 2 + m.t AS cls_out, m.t
         FROM moved m JOIN v ON (NOT (plain OR same1) OR v.s = m.s) AND (NOT (plain OR same2) OR v.p = m.p) AND (NOT (plain OR same4) OR v.t = m.t)),
got AS (SELECT dst AS target, src AS node, cls_in AS cls FROM step WHERE {arriving} UNION SELECT g.target, s.src, s.cls_in FROM got g JOIN step s ON s.dst = g.node AND s.cls_out = g.cls),
way AS (SELECT router AS src, if_id AS dst FROM face UNION SELECT w.src, f.if_id FROM way w JOIN face f ON f.router = w.dst),
asked AS (SELECT w.src, w.dst, CASE WHEN EXISTS (SELECT 1 FROM (SELECT DISTINCT target, node FROM got) g WHERE g.target = w.dst AND g.node = w.src) THEN 'sat' ELSE 'unsat' END AS verdict FROM way w WHERE w.src <> w.dst)
{select}"""


@query(_reach_sql("SELECT src, dst, verdict FROM asked", duck(_SET), "true"))
def header_all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Can some packet of five fields get from one router to another, over routes, access lists, NAT and set-field rules?"""
    return HeaderNetwork(spark, network_tables(spark, sf_dir)).all_pairs()


@query(_reach_sql("SELECT src, dst, verdict FROM asked JOIN nation a ON a.n_nationkey = src AND a.n_regionkey = 2 JOIN nation b ON b.n_nationkey = dst AND b.n_regionkey = 3", f"{duck(_SET)} UNION ALL {_TAGGED}", "t = 0"))
def header_bypass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Can a packet get from region 2 to region 3 without the tag that the routers of region 1 set on the way in?"""
    role = F.when(F.col("region") == 1, "firewall").when(F.col("region") == 2, "outside").when(F.col("region") == 3, "inside")
    return bypass(network_tables(spark, sf_dir), role)
