"""Rules that call themselves twice or each other, cuts by clause order, and lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netlattice.operators.rules import Cut, Goal, Rules, joined_parts
from netlattice.plans import queries as base
from netlattice.plans.derived import spark_sql
from netlattice.plans.registry import query

_SHIPS = base._SHIPS


@query(f"WITH RECURSIVE way AS (SELECT a, b FROM ({_SHIPS}) x UNION SELECT w.a, y.b FROM way w JOIN ({_SHIPS}) y ON w.b = y.a) SELECT a AS \"A\", b AS \"B\" FROM way")
def rule_nonlinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A way is a shipment, or a way and another one."""
    rules = base._facts(spark, sf_dir)
    rules.rule("way", ["A", "B"], [Goal("ships", "A", "B")])
    rules.rule("way", ["A", "C"], [Goal("way", "A", "B"), Goal("way", "B", "C")])
    return rules.query([Goal("way", "A", "B")])


@query(f"WITH RECURSIVE way AS (SELECT a, b, 1 AS odd FROM ({_SHIPS}) x UNION SELECT w.a, y.b, 1 - w.odd FROM way w JOIN ({_SHIPS}) y ON w.b = y.a) SELECT a AS \"A\", b AS \"B\" FROM way WHERE odd = 0")
def rule_mutual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where goods get to in an even number of shipments."""
    rules = base._facts(spark, sf_dir)
    rules.rule("odd", ["A", "B"], [Goal("ships", "A", "B")])
    rules.rule("odd", ["A", "C"], [Goal("even", "A", "B"), Goal("ships", "B", "C")])
    rules.rule("even", ["A", "C"], [Goal("odd", "A", "B"), Goal("ships", "B", "C")])
    return rules.query([Goal("even", "A", "B")])


_OFFERS = "SELECT CAST(s_suppkey AS BIGINT) AS line, CAST(s_nationkey AS BIGINT) AS a, CAST((s_suppkey * 7 + s_nationkey) % 25 AS BIGINT) AS b FROM {supplier}"


@query(f"""WITH o AS ({_OFFERS.format(supplier="supplier")}),
near AS (SELECT o.* FROM o JOIN nation x ON x.n_nationkey = a JOIN nation y ON y.n_nationkey = b AND x.n_regionkey = y.n_regionkey)
SELECT a AS "A", arg_min(b, line) AS "B" FROM near GROUP BY a
UNION SELECT a, b FROM o JOIN nation y ON y.n_nationkey = b AND y.n_regionkey = 0 WHERE a NOT IN (SELECT a FROM near)""")
def rule_first_clause(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation's first offer within its region, in the order of the offers; nations without one take any of region 0."""
    rules = base._facts(spark, sf_dir)
    rules.fact("offer", spark_sql(spark, sf_dir, _OFFERS), ["a", "b"], order="line")
    rules.rule("choice", ["A", "B"], [Goal("offer", "A", "B"), Goal("nation", "A", "R"), Goal("nation", "B", "R"), Cut()])
    rules.rule("choice", ["A", "B"], [Goal("offer", "A", "B"), Goal("nation", "B", 0)])
    return rules.query([Goal("nation", "A", "_"), Goal("choice", "A", "B")])


_LISTS = "SELECT s_nationkey AS n, array_sort(collect_list(CAST(s_suppkey % 9 AS STRING))) AS l FROM {supplier} GROUP BY s_nationkey"
_ENDS = "SELECT DISTINCT l[k:] AS l FROM (SELECT list(CAST(s_suppkey % 9 AS VARCHAR) ORDER BY CAST(s_suppkey % 9 AS VARCHAR)) AS l FROM supplier GROUP BY s_nationkey) x, unnest(generate_series(1, len(l) + 1)) AS u(k)"


def _lists(spark: SparkSession, sf_dir: str) -> Rules:
    rules = Rules()
    rules.lists(spark_sql(spark, sf_dir, _LISTS), "l")
    return rules


@query(f"SELECT DISTINCT array_to_string(l[:k], ',') AS \"A\", array_to_string(l[k + 1:], ',') AS \"B\", array_to_string(l, ',') AS \"L\" FROM ({_ENDS}) e, unnest(generate_series(0, len(l))) AS u(k)")
def rule_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ways to part the nations' lists, and their ends, in two."""
    rules = Rules()
    rules.fact("joined", joined_parts(spark_sql(spark, sf_dir, _LISTS).select("l")), ["a", "b", "l"], once=True)
    return rules.query([Goal("joined", "A", "B", "L")])


@query(f"SELECT DISTINCT x AS \"X\", array_to_string(l, ',') AS \"L\" FROM ({_ENDS}) e, unnest(l) AS u(x)")
def rule_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lists(spark, sf_dir).query([Goal("element", "X", "L")]).select("X", F.array_join("L", ",").alias("L"))
