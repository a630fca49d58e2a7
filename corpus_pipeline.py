"""Corpus pipeline over ``documents``: what each stage drops is gone for the next one.

Quality rejects, exact copies, near copies (one document of each group stays)
and contaminated documents go; what is left is packed into sequences.  Every
stage takes (spark, docs, sf_dir) and all but the last return the columns of
their ``docs``, whatever these are called.  Rows are told apart by ``doc_id``;
where ids repeat, a stage's decision on an id holds for all its rows, but for
exact copies, of which one row stays even if they share an id (and of rows that
are the same in all columns, one).  A null id is an id like any other, larger than
all.  A null text counts as empty: it says nothing for or against quality, is an
exact copy of other empty texts, links with nothing, and packs as one end mark.
Texts of any length are read whole.  Ties go to the smallest id (exact and near
copies); scores that tie with the last one kept are kept.  An empty table of
documents, labels or benchmark items gives no rows, keeps all, or finds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netlattice.llm.decontaminate import decontaminate
from netlattice.llm.exact_dedup import exact_dedup
from netlattice.llm.jaccard import link_components
from netlattice.llm.packing import pack
from netlattice.llm.quality import quality
from netlattice.llm.scratch import saved, table


#: Kept ids that are broadcast at most; more meet their rows by a shuffle.
BROADCAST_IDS = 500_000


def _of(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is in ``kept`` (doc_id), with the columns of ``docs``."""
    names = saved(docs.sparkSession, kept.select(F.col("doc_id").alias("kept_id")).distinct(), "kept-ids")
    few = names.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(names) if few else names, docs["doc_id"].eqNullSafe(names["kept_id"]), "left_semi")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _of(docs, quality(docs, table(spark, sf_dir, "labels")).where("kept"))


def exact_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = _of(docs, exact_dedup(docs).where("kept"))
    # rows with one id survive here only if their texts differ, or if they are the same row again
    return kept.dropDuplicates() if docs.select("doc_id").distinct().count() < docs.count() else kept


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = link_components(docs)
    # a document without words is linked with nothing and names its own component
    return _of(docs, found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _of(docs, decontaminate(docs, table(spark, sf_dir, "benchmark")).where("not contaminated"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_deduplication),
    ("n-gram Jaccard join", near_deduplication),
    ("benchmark decontamination", benchmark_decontamination),
    ("packing", packing),
]
#: The classifier, the tokenizer and the packing cannot be written in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on ``documents`` of ``sf_dir``, each result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(spark, stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
