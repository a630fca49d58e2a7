"""Results as text: graphs, traces, verdict counts, counterexamples, canonical tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlattice.functions.ip import long_to_ip, prefix_text


def graph_lines(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(line) of a Graphviz digraph's statements: vertices with name and flag, edges with their prefixes."""
    nodes = vertices.select(F.format_string('"%s" [label="%s|%d"];', "vid", F.coalesce("name", "vid"), "flag").alias("line"))
    text = F.array_join(F.array_sort(F.collect_set(prefix_text(F.col("lo"), F.col("width")))), ",")
    arrows = edges.groupBy("src", "dst").agg(text.alias("label")).select(F.format_string('"%s" -> "%s" [label="%s"];', "src", "dst", "label").alias("line"))
    return nodes.unionByName(arrows)


def prefix_tree_lines(parents: DataFrame) -> DataFrame:
    """(line) of a prefix tree given as (lo, width, parent_lo, parent_width)."""
    return parents.select(F.format_string('"%s" -> "%s";', prefix_text(F.col("parent_lo"), F.col("parent_width")), prefix_text(F.col("lo"), F.col("width"))).alias("line"))


def write_graph(lines: DataFrame, path: str) -> None:
    """Statements between the braces; the files of the folder, in the order of their names, are the drawing."""
    whole = lines.sparkSession.createDataFrame([("0", "digraph G {"), ("2", "}")], "at string, line string")
    body = lines.select(F.lit("1").alias("at"), "line").unionByName(whole)
    body.orderBy("at", "line").select("line").write.text(path)


def trace_lines(trace: DataFrame) -> DataFrame:
    """(start, hop, line): node and the prefix that leads on, the last node alone."""
    w = F.lead(prefix_text(F.col("lo"), F.col("width")))
    from pyspark.sql import Window

    after = w.over(Window.partitionBy("start", "address").orderBy("hop"))
    return trace.select("start", "hop", F.concat_ws("\t", F.col("node").cast("string"), after).alias("line"))


def verdict_counts(verdicts: DataFrame) -> DataFrame:
    """(sat, unsat): subjects with and without a counterexample."""
    return verdicts.agg(F.count_if(F.col("verdict") == "sat").alias("sat"), F.count_if(F.col("verdict") == "unsat").alias("unsat"))


def against(verdicts: DataFrame, expected: tuple[int, int] | None) -> DataFrame:
    """(sat, unsat, expected_sat, expected_unsat, passed); ``passed`` is null where nothing is expected."""
    sat, unsat = expected or (None, None)
    found = verdict_counts(verdicts).withColumns({"expected_sat": F.lit(sat).cast("long"), "expected_unsat": F.lit(unsat).cast("long")})
    return found.withColumn("passed", (F.col("sat") == F.col("expected_sat")) & (F.col("unsat") == F.col("expected_unsat")))


def with_witness(verdicts: DataFrame, lo: str = "witness_lo") -> DataFrame:
    """Adds the counterexample's address in dotted form."""
    return verdicts.withColumn("witness", long_to_ip(F.col(lo)))


def canonical_lines(routes: DataFrame) -> DataFrame:
    """(path, line, value): 'dest,gateway,interface,tag'."""
    return routes.select("path", "line", F.concat_ws(",", "dest", "gateway", F.coalesce("interface", F.lit("")), F.coalesce("tag", F.lit(""))).alias("value"))
