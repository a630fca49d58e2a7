"""URL filtering by a temporal list join, with DataFrame functions only.

A list is a log of dated entries (pattern, action, date).  A pattern is a host,
which covers its subdomains, or a host with a path prefix of whole segments.
The actions ``block`` and ``allow`` hold from their date until the pattern's
next entry; ``remove`` only ends the one before.  Entries thus become validity
intervals, kept as one sorted row per pattern.

A capture's candidate patterns are the suffixes of its host and the path
prefixes under its whole host, as long as the list's patterns are.  They are
equi-joined with the list, and the interval that holds at fetch time is picked
from the pattern's row (the as-of join).  Of the patterns active then, the
longest decides; a capture is dropped if that one blocks.

The list is broadcast only if its measured text is at most ``BROADCAST_CHARS``;
a longer list is joined by a shuffle in which captures are salted and the list's
rows repeated ``SALTS`` times, so that no host's captures meet in one task.

Null or malformed URLs match nothing and are kept, and so are captures without
a time.  Of entries of one pattern and time, the one whose action sorts last
counts; list rows with a null pattern or time do not.  Rows repeated in the
captures are each returned.  URLs of any length are read whole (path prefixes
only as deep as the list goes).  Without captures there are no rows, without a
list every capture is kept; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A host ends where the port, path, query or fragment begins, or the URL ends; nothing else may follow it.
HOST = r"^https?://(?:[^/?#]*@)?([^/?#@:\[\]\s]+)(?::[0-9]*)?(?:[/?#]|$)"
BROADCAST_CHARS = 8 << 20
SALTS = 32


def host_of(url: Column) -> Column:
    """The whole host, lowered, without user, port and final dots; empty if the URL is malformed."""
    return F.rtrim(F.regexp_extract(F.lower(url), HOST, 1), F.lit("."))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, spans array<struct<since,until,action>>) from (pattern, action, listed_at)."""
    parts = F.split(F.rtrim("pattern", F.lit("/")), "/", 2)
    pattern = F.when(F.size(parts) > 1, F.concat(F.lower(parts[0]), F.lit("/"), parts[1])).otherwise(F.lower(parts[0]))
    rows = entries.select(pattern.alias("pattern"), "action", "listed_at").where("pattern is not null and listed_at is not null")
    rows = rows.groupBy("pattern", "listed_at").agg(F.max("action").alias("action"))
    after = F.lead("listed_at").over(Window.partitionBy("pattern").orderBy("listed_at"))
    spans = rows.withColumn("until", after).where(F.col("action").isin("block", "allow"))
    return spans.groupBy("pattern").agg(F.array_sort(F.collect_list(F.struct(F.col("listed_at").alias("since"), "until", "action"))).alias("spans"))


def candidates(host: Column, path: Column, segments: int) -> Column:
    """Patterns that could cover a capture: each host suffix, then host + prefixes of up to ``segments`` path segments."""
    labels = F.split(host, "[.]")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    ends = F.filter(F.sequence(F.lit(0), F.least(F.lit(segments), F.size(parts))), lambda n: n > 0)
    prefixes = F.transform(ends, lambda n: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, 1, n), "/")))
    return F.when(host != "", F.array_distinct(F.concat(suffixes, prefixes))).otherwise(F.array().cast("array<string>"))


def url_filter(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_at", broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """One row per capture: its id, url, fetched_at, pattern and action that decided (null if none), kept."""
    listed = intervals(entries)
    chars, segments = entries.agg(F.coalesce(F.sum(F.length("pattern") + 32), F.lit(0)), F.coalesce(F.max(F.size(F.split("pattern", "/")) - 1), F.lit(0))).first()
    rows = captures.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(time_col).alias("fetched_at"))
    # a capture is told apart by what it holds; repeated ones share the decision and are counted
    keyed = rows.groupBy("id", "url", "fetched_at").agg(F.count(F.lit(1)).alias("copies"))
    found = keyed.select("*", F.explode_outer(candidates(host_of(F.col("url")), path_of(F.col("url")), segments)).alias("pattern"))
    if chars <= broadcast_chars:
        joined = found.join(F.broadcast(listed), "pattern", "left")
    else:
        salted = found.withColumn("salt", F.pmod(F.xxhash64("id", "url", "fetched_at"), F.lit(SALTS)).cast("int"))
        copies = listed.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        joined = salted.join(copies, ["pattern", "salt"], "left")
    at = F.col("fetched_at")
    holds = F.filter("spans", lambda s: (s["since"] <= at) & (s["until"].isNull() | (at < s["until"])))
    action = F.get(holds, F.lit(0))["action"]
    best = F.max(F.when(action.isNotNull(), F.struct(F.length("pattern").alias("n"), F.col("pattern"), action.alias("action"))))
    decided = joined.groupBy("id", "url", "fetched_at", "copies").agg(best.alias("best"))
    out = decided.select(F.explode(F.sequence(F.lit(1), F.col("copies"))), F.col("id").alias(id_col), F.col("url").alias(url_col), F.col("fetched_at").alias(time_col), F.col("best.pattern").alias("pattern"), F.col("best.action").alias("action"))
    return out.drop("col").withColumn("kept", ~F.col("action").eqNullSafe(F.lit("block")))
