"""A network derived from the star-schema tables, in SQL that Spark and DuckDB both read.

Routers are nations, destination prefixes come from part keys, next hops from
supplier and customer nations; 100 stands for delivered, 101 for dropped.
``{part}`` and the like are table references of the engine at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
DELIVERED, DROPPED = 100, 101

PFX = """SELECT pk, width, host, raw, raw - raw % host AS lo FROM (
  SELECT CAST(p_partkey AS BIGINT) AS pk, CAST(8 + p_size % 17 AS INT) AS width,
         CAST(pow(2, 24 - p_size % 17) AS BIGINT) AS host,
         (CAST(p_partkey AS BIGINT) * 2654435761) % 4294967296 AS raw
  FROM {part}) t"""

ROUTES = f"""SELECT node, lo, width, lo + host AS hi, nh FROM (
  SELECT CAST(s.s_nationkey AS BIGINT) AS node, p.lo, p.width, p.host, CAST(c.c_nationkey AS BIGINT) AS nh
  FROM {{lineitem}} l JOIN {{supplier}} s ON l.l_suppkey = s.s_suppkey
  JOIN {{orders}} o ON l.l_orderkey = o.o_orderkey JOIN {{customer}} c ON o.o_custkey = c.c_custkey
  JOIN ({PFX}) p ON l.l_partkey = p.pk
  WHERE s.s_nationkey <> c.c_nationkey
  UNION ALL SELECT pk % 25, lo, width, host, CAST({DELIVERED} AS BIGINT) FROM ({PFX}) p
  UNION ALL SELECT pk % 23, lo, width, host, CAST({DROPPED} AS BIGINT) FROM ({PFX}) p WHERE pk % 5 = 0
  UNION ALL SELECT CAST(n.n_nationkey AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS INT), CAST(4294967296 AS BIGINT),
    CASE WHEN n.n_nationkey = h.head THEN CAST({DELIVERED} AS BIGINT) ELSE CAST(h.head AS BIGINT) END
  FROM {{nation}} n JOIN (SELECT n_regionkey, MIN(n_nationkey) AS head FROM {{nation}} GROUP BY n_regionkey) h
    ON n.n_regionkey = h.n_regionkey) r"""

#: One next hop per node and prefix.
FIB = f"SELECT node, lo, width, hi, MAX(nh) AS nh FROM ({ROUTES}) r GROUP BY node, lo, width, hi"
#: All of them.
ECMP = f"SELECT DISTINCT node, lo, width, hi, nh FROM ({ROUTES}) r"

ATOMS = "SELECT lo, hi FROM (SELECT x AS lo, lead(x) OVER (ORDER BY x) AS hi FROM (SELECT lo AS x FROM fib UNION SELECT hi FROM fib UNION SELECT 0 UNION SELECT 4294967296) e) t WHERE hi IS NOT NULL"
#: What the checks ask about, in DuckDB: forwarding of each atom by longest prefix.
FWD = "SELECT DISTINCT cls, src, dst FROM (SELECT a.lo AS cls, f.node AS src, f.nh AS dst, rank() OVER (PARTITION BY f.node, a.lo ORDER BY f.width DESC) AS rk FROM atoms a JOIN fib f ON a.lo >= f.lo AND a.lo < f.hi) t WHERE rk = 1"


def spark_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return spark.sql(text.format(**{t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}))


def duck(text: str) -> str:
    return text.format(**{t: t for t in TABLES})


def duck_with(select: str, fib: str = FIB, recursive: bool = False, **more: str) -> str:
    """A DuckDB query over fib, atoms, fwd and further CTEs."""
    parts = {"fib": duck(fib), "atoms": ATOMS, "fwd": FWD} | more
    ctes = ", ".join(f"{n} AS MATERIALIZED ({q})" if n in ("fib", "atoms", "fwd") else f"{n} AS ({q})" for n, q in parts.items())
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes} {select}"


def fib(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark_sql(spark, sf_dir, FIB)


def ecmp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark_sql(spark, sf_dir, ECMP)


def prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark_sql(spark, sf_dir, PFX)
