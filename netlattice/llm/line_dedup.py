"""Line deduplication with DataFrame functions only.

Every line's key (ASCII white space stripped at both ends, A-Z lowered) is
hashed to 128 bits.  The postings (hash, document, position) go to a shared
table; they are range-partitioned by (hash, document) and sorted within
partitions down to the position, so a frequent line spreads over as many
partitions as its documents need.  In the sorted stream of a partition a posting
is a first occurrence if the one before it is of another hash or document; first
occurrences and postings are added up per partition before they meet.  Keys
found in enough documents go back to their postings and each document gets a
sparse bitmap of the lines to drop: 64-bit words by word number, words that are
absent being kept whole.  Text is not part of any of that; it meets its bitmap
at the end.

A key with more than ``HOT_SHARE`` of all postings is dealt out over as many
salts as it has such shares; there are at most ``1 / HOT_SHARE`` such keys, which
is what bounds their broadcast.

Null or empty texts are one empty line; texts of any length are split whole.
Documents are told apart by id; rows repeated with one id count as one document,
and each gets the bitmap of its own text.  A null id is one document.  A key in
exactly ``min_docs`` documents goes.  An empty table gives no rows, and other
columns are not read.  The hash of 128 bits stands for the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import saved, width

MIN_DOCS, MIN_CHARS = 10, 1
#: Share of all postings that one task may get of one key.
HOT_SHARE = 1e-3
_SPACE = " \t\n\x0b\f\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    bare = F.btrim(line, F.lit(_SPACE))
    # lower() is the faster; on ASCII it does the same
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), text.alias("text"))


def keep_bitmaps(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, row, n_dropped, dropped map<int,bigint>) of the documents that lose lines.

    ``row`` is a hash of the text.  ``keep_first`` leaves the first occurrence of a frequent line.
    """
    spark = docs.sparkSession
    lines = _rows(docs, id_col, text_col).select("doc_id", "row", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keys = lines.select("doc_id", "row", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    postings = saved(spark, keys.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("2"), "key").alias("h2"), "doc_id", "row", "pos"), "line-postings")

    ranged = postings.select("h1", "h2", "doc_id", "pos").repartitionByRange(width(spark), "h1", "h2", "doc_id")
    # the ranges serve as the window's partitioning: one sort, no further exchange
    before = F.lag("pos").over(Window.partitionBy("h1", "h2", "doc_id").orderBy("pos"))
    streamed = ranged.withColumn("first", before.isNull())
    counts = [F.count_if("first").alias("n_docs"), F.count(F.lit(1)).alias("n_lines")]
    if keep_first:
        counts.append(F.min(F.when(F.col("first"), F.struct("doc_id", "pos"))).alias("first"))
    found = streamed.groupBy("h1", "h2").agg(*counts)
    share = F.lit(max(1.0, HOT_SHARE * postings.count()))
    frequent = found.where(F.col("n_docs") >= min_docs).withColumn("salts", F.ceil(F.col("n_lines") / share).cast("int"))
    frequent = saved(spark, frequent, "line-frequent")

    hot = F.broadcast(frequent.where("salts > 1").select("h1", "h2", F.col("salts").alias("parts")))
    salt = F.coalesce(F.pmod(F.xxhash64("doc_id", "pos"), F.col("parts")).cast("int"), F.lit(0))
    salted = postings.join(hot, ["h1", "h2"], "left").withColumn("salt", salt).drop("parts")
    copies = frequent.select("*", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    hit = salted.join(copies, ["h1", "h2", "salt"])
    if keep_first:
        hit = hit.where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("pos") == F.col("first.pos"))))
    word = F.shiftright("pos", 6).alias("word")
    bits = F.bit_or(F.expr("shiftleft(1L, pos & 63)")).alias("bits")
    words = hit.groupBy("doc_id", "row", word).agg(bits)
    return words.groupBy("doc_id", "row").agg(F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"), F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("dropped"))


def line_dedup(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_lines (before), n_dropped, kept (the text that stays)."""
    rows = _rows(docs, id_col, text_col)
    maps = keep_bitmaps(docs, min_docs, min_chars, keep_first, id_col, text_col)
    maps = maps.select(F.col("doc_id").alias("map_id"), F.col("row").alias("map_row"), "n_dropped", "dropped")
    both = rows.join(maps, (F.col("row") == F.col("map_row")) & F.col("doc_id").eqNullSafe(F.col("map_id")), "left")
    lines = F.split("text", "\n", -1)
    words_bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i.bitwiseAND(F.lit(63)))
    word = lambda i: F.coalesce(F.col("dropped")[F.shiftright(i, 6)], F.lit(0).cast("long"))
    stays = F.filter(lines, lambda _, i: word(i).bitwiseAND(words_bit(i)) == 0)
    kept = F.when(F.col("dropped").isNull(), F.col("text")).otherwise(F.concat_ws("\n", stays))
    n_lines = F.size(lines).cast("long")
    return both.select("doc_id", n_lines.alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))
