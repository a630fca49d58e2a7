"""Exact deduplication by an extendible-hash index kept in shared files.

1. Every input task folds its own rows: texts equal after white-space
   normalisation become one *entry* (key = first 64 bits of SHA-256, text, the
   smallest id, the number of rows, the ids).  Entries go to a shared table.
   A group of copies of any size thus leaves at most a few entries per task.
2. The directory doubles until no slot holds more than ``BUCKET_BYTES`` of
   entries that another key bit could divide.  A bucket is the shortest key
   prefix that fits; the slots under it share it.  The directory is a shared
   file too, and its size follows the entries.
3. Owner tasks get whole buckets, numbered in the order of keys, so that a task
   owns a key range and no two buckets meet by chance.  They read them in key
   order and keep one chain per key: an entry joins the chain node whose *bytes*
   are equal, or adds a node.  Only one key's chain is in memory at a time, so a
   bucket that no bit divides (one key) is just read longer.
4. Decisions return to the rows through the entry number, not through the key,
   so no hot key is ever a join key.

Null texts equal the empty text.  Rows repeated with the same id and text are
members of one group and are each returned; among equal smallest ids the first
in the order of entry numbers stays.  Null ids come last when the row that stays
is chosen.  Texts of any length are compared whole.  An empty table gives no
rows, and other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import saved
from .words import only_caches, sliced

#: Bytes of text in a bucket; the directory splits one beyond it.
BUCKET_BYTES = 16 << 20
#: Directory slots that are broadcast at most; owner tasks at most, beyond which a task owns several buckets.
BROADCAST_SLOTS, MAX_TASKS = 500_000, 200_000
#: Bytes of distinct text that a task folds before it writes its entries out.
FOLD_BYTES = 16 << 20

ENTRY = "key long, digest binary, entry long, text binary, size long, first_id long, first_row long, first_at long, n long, ids array<long>"
OWNED = "entry long, keep_id long, keep_row long, group_size long"


def normalised(text: bytes | None) -> bytes:
    """Each run of ``[\\x20\\x09-\\x0D]`` becomes one space; runs at the ends too."""
    if not text:
        return b""
    body = b" ".join(text.split())
    space = b" \t\n\v\f\r"
    if not body:
        return b" "
    return (b" " if text[0] in space else b"") + body + (b" " if text[-1] in space else b"")


def _rank(doc_id: int | None) -> tuple[bool, int]:
    return (doc_id is None, doc_id or 0)


def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, made, row = TaskContext.get().partitionId() << 33, 0, TaskContext.get().partitionId() << 33
    only_caches()
    held: dict[bytes, list[list]] = {}
    size = 0

    def out() -> pa.RecordBatch:
        nodes = [(d, x) for d, chain in held.items() for x in chain]
        cols = [
            pa.array([struct.unpack(">q", d[:8])[0] for d, _ in nodes], pa.int64()),
            pa.array([d for d, _ in nodes], pa.binary()),
            pa.array(range(task + made, task + made + len(nodes)), pa.int64()),
            pa.array([x[0] for _, x in nodes], pa.binary()),
            pa.array([len(x[0]) + 100 for _, x in nodes], pa.int64()),
            pa.array([x[1] for _, x in nodes], pa.int64()),
            pa.array([x[2] for _, x in nodes], pa.int64()),
            pa.array([x[4] for _, x in nodes], pa.int64()),
            pa.array([len(x[3]) for _, x in nodes], pa.int64()),
            pa.array([x[3] for _, x in nodes], pa.list_(pa.int64())),
        ]
        return pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in ENTRY.split(", ")])

    for batch in sliced(batches):
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            body = normalised(text)
            chain = held.setdefault(hashlib.sha256(body).digest(), [])
            node = next((x for x in chain if x[0] == body), None)
            if node is None:
                chain.append([body, doc_id, row, [doc_id], 0])
                size += len(body) + 100
            else:
                if _rank(doc_id) < _rank(node[1]):
                    node[1], node[2], node[4] = doc_id, row, len(node[3])
                node[3].append(doc_id)
                size += 8
            row += 1
            if size > FOLD_BYTES:
                yield (done := out())
                made += done.num_rows
                held, size = {}, 0
    if held:
        yield out()


def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by key; one key's nodes [text, first id, its row, n, entries] are kept."""
    key, nodes, done = None, [], []

    def flush(rows: list) -> pa.RecordBatch:
        cols = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["entry", "keep_id", "keep_row", "group_size"])

    def decide() -> None:
        for node in nodes:
            done.extend((e, node[1], node[2], node[3]) for e in node[4])

    for batch in batches:
        for k, entry, text, first, row, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if k != key:
                decide()
                key, nodes = k, []
                if len(done) > 50_000:
                    yield flush(done)
                    done = []
            node = next((x for x in nodes if x[0] == text), None)
            if node is None:
                nodes.append([text, first, row, n, [entry]])
            else:
                if (*_rank(first), row) < (*_rank(node[1]), node[2]):
                    node[1], node[2] = first, row
                node[3] += n
                node[4].append(entry)
    decide()
    if done:
        yield flush(done)


def slot_of(key: Column, depth: int) -> Column:
    """The first ``depth`` bits of a key, as a number from 0."""
    if not depth:
        return F.lit(0).cast("long")
    return F.shiftright(key, 64 - depth) + (1 << (depth - 1))


def doubled(entries: DataFrame, capacity: int) -> int:
    """Depth of the directory: it doubles as long as a slot holds more than ``capacity`` and another bit can divide it."""
    depth = 0
    while depth < 62:
        slots = entries.groupBy(slot_of(F.col("key"), depth).alias("slot"))
        full = slots.agg(F.sum("size").alias("size"), F.min("key").alias("low"), F.max("key").alias("high")).where(F.col("size") > capacity)
        # slots of one key cannot be divided; of the others, the fullest tells how often to double at least
        most = full.where("low <> high").agg(F.max("size")).first()[0]
        if most is None:
            break
        depth += max(1, (-(-most // capacity) - 1).bit_length())
    return depth


def directory(entries: DataFrame, depth: int, capacity: int) -> DataFrame:
    """(slot, bucket) for the slots in use.

    A bucket is the shortest prefix of keys with at most ``capacity`` bytes, or a
    slot; all slots under it lead to it.  Buckets are numbered in the order of keys.
    """
    slots = entries.groupBy(slot_of(F.col("key"), depth).alias("slot")).agg(F.sum("size").alias("size"))
    above = slots.select("slot", "size", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("bits"))
    prefix = F.expr(f"shiftright(slot, {depth} - bits)").alias("prefix")
    sizes = above.groupBy("bits", prefix).agg(F.sum("size").alias("size"))
    fits = above.select("slot", "bits", prefix).join(sizes.where(F.col("size") <= capacity).drop("size"), ["bits", "prefix"])
    local = fits.groupBy("slot").agg(F.min("bits").alias("bits"))
    own = slots.select("slot").join(local, "slot", "left").select("slot", F.coalesce("bits", F.lit(depth)).alias("bits"))
    begins = own.select("slot", F.expr(f"shiftleft(shiftright(slot, {depth} - bits), {depth} - bits)").alias("begin"))
    # one row per bucket, which holds about half of ``capacity`` or more
    numbered = begins.select("begin").distinct().select("begin", (F.row_number().over(Window.orderBy("begin")) - 1).alias("bucket"))
    return begins.join(numbered, "begin").select("slot", "bucket")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, and ``entry``, the index entry it is part of."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    entries = saved(spark, rows.mapInArrow(fold, ENTRY), "dedup-index")

    depth = doubled(entries, BUCKET_BYTES)
    slots = saved(spark, directory(entries, depth, BUCKET_BYTES), "dedup-directory")
    n_slots, n_buckets = slots.agg(F.count(F.lit(1)), F.coalesce(F.max("bucket") + 1, F.lit(1))).first()
    each = -(-n_buckets // MAX_TASKS)
    owned = (
        entries.withColumn("slot", slot_of(F.col("key"), depth))
        .join(F.broadcast(slots) if n_slots <= BROADCAST_SLOTS else slots, "slot")
        .select(F.expr(f"cast(bucket div {each} as int)").alias("task"), "key", "entry", "text", "first_id", "first_row", "n")
        .repartitionById(-(-n_buckets // each), "task")  # a task owns a range of keys
        .sortWithinPartitions("key", "entry")
        .select("key", "entry", "text", "first_id", "first_row", "n")
        .mapInArrow(chain, OWNED)
    )
    members = entries.select("entry", "digest", "first_row", "first_at", "ids")
    joined = members.join(owned, "entry").select("*", F.posexplode("ids").alias("pos", "doc_id"))
    stays = (F.col("first_row") == F.col("keep_row")) & (F.col("pos") == F.col("first_at"))
    return joined.select("doc_id", "keep_id", "group_size", stays.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "entry")
