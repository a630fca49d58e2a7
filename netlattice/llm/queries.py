"""One query per operator, applied with production parameters to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .chat import conversation_digests, format_conversations
from .conversation_trie import prefix_trie
from .decontaminate import decontaminate
from .divergence import divergence
from .exact_dedup import exact_dedup
from .html_wrapper import main_text
from .jaccard import link_components
from .language import identify
from .line_dedup import line_dedup
from .packing import pack
from .quality import quality
from .scratch import table
from .substring import substring_dedup
from .url_filter import url_filter

#: A dated list for op9, in the order of its log.
LIST_ENTRIES = [
    ("casino-win.example.com", "block", "2024-01-01"),
    ("cheap-pills.example.com", "block", "2024-01-15"),
    ("free-bets.example.com", "block", "2024-02-01"),
    ("ads-track.example.com", "block", "2024-02-10"),
    ("spam-farm.example.com", "block", "2024-03-01"),
    ("cheap-pills.example.com", "remove", "2024-05-01"),
    ("tionsh.example.net", "block", "2024-05-20"),
    ("tionsh.example.net/en", "allow", "2024-06-01"),
    ("tionsh.example.net", "remove", "2024-07-01"),
    ("cheap-pills.example.com", "block", "2024-08-01"),
    ("www.cheap-pills.example.com", "allow", "2024-09-01"),
    ("example.org", "block", "2024-11-01"),
    ("example.org", "remove", "2024-11-15"),
    ("free-bets.example.com", "allow", "2024-12-01"),
]


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages carry no fetch time; one a day of 2024, by page id, stands in for it."""
    day = F.date_add(F.to_date(F.lit("2024-01-01")), F.pmod(F.col("page_id"), F.lit(366)).cast("int"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url", day.alias("fetched_at"))
    rows = ", ".join(f"('{p}', '{a}', date '{d}')" for p, a, d in LIST_ENTRIES)
    entries = spark.sql(f"SELECT * FROM VALUES {rows} AS t(pattern, action, listed_at)")
    found = url_filter(pages, entries)
    return found.select("page_id", "url", F.col("fetched_at").cast("string").alias("fetched_at"), "pattern", "action", "kept")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(table(spark, sf_dir, "documents"))


def op11_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With one conversation more, whose texts are made of the template's own control strings."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return conversation_digests(format_conversations(rows.unionByName(more)))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, position, role, text): every conversation c, begun with the first crc32(c) % 9 turns of c - c % 5 in place of as many of its own.

    Every conversation has a row with a null position too, so that one left without turns is still there.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", text("role"), text("text"))
    in_turn = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumn("pos", F.row_number().over(in_turn))
    base = F.col("conv_id") - F.col("conv_id") % 5
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    convs = conversations.where("conv_id IS NOT NULL").select("conv_id").distinct().withColumns({"base": base, "h": taken})
    lent = rows.where("pos <= 8").select(F.col("conv_id").alias("base"), "pos", "role", "text")  # no more than 8 are ever taken
    begins = convs.join(lent, "base").where("pos <= h").select("conv_id", F.col("pos").alias("position"), "role", "text")
    given = begins.groupBy("conv_id").agg(F.max("position").alias("given"))
    rest = rows.where(F.col("pos") > taken).join(given, "conv_id", "left")
    rest = rest.select("conv_id", (F.coalesce("given", F.lit(0)) + F.col("pos") - taken).alias("position"), "role", "text")
    nothing = F.lit(None).cast("string")
    return begins.unionByName(rest).unionByName(convs.select("conv_id", F.lit(None).cast("long").alias("position"), nothing.alias("role"), nothing.alias("text")))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(table(spark, sf_dir, "conversations")))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_html_extraction, op2_packing, op3_line_dedup, op4_exact_dedup, op5_quality, op6_substring_dedup, op7_decontamination, op8_language, op9_url_filter, op10_jaccard_join, op11_chat_formatting, op12_conversation_trie, op13_source_divergence)}
