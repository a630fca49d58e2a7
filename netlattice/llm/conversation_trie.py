"""Prefix trie of conversations, as a Cartesian tree over the LCP array of the sorted conversations.

1. Every turn becomes a digest of 128 bits (role and text), a conversation the
   string of its turns' digests.  Conversations are range-partitioned and sorted
   by that string and their id, so any number of equal ones spreads over tasks.
2. A task reads its range as blocks of bounded size (``BLOCK``).
   LCP[i] is the number of turns that neighbours i - 1 and i share.  The nearest
   smaller values to the left and right of LCP[i] are the ends of the interval
   of conversations below one node of the tree; positions with equal LCP in one
   interval are one node.  Depths between a node and its parent are filled in.
   What a node reports comes from prefix sums at the two ends of its interval.
3. An interval that reaches an end of its block is one piece of a node.  One scan
   over the blocks (a row each: first and last conversation and the block's
   minimum) finds for each depth that is open at a border the nearest block to
   the left with a smaller minimum: there the node begins.  Pieces meet by that
   block and the depth, and add up.

A node is named by its smallest member and its depth: its last turn is the turn
of that number in that conversation.

Defined cases: turns are ordered by position, equal ones by role and text; a
null role or text is empty; rows without a conversation id belong to none and
are left out; a conversation whose rows have null positions only has no turns
and is a member of the root; repeated rows are repeated turns; a text of any
length is one turn; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import saved, width

#: Distinct conversations, their turns, and ids of equal ones, after which a block ends.
BLOCK = (20_000, 1_000_000, 65_536)
#: Hexadecimal digits of a turn's digest.
DIGITS = 32
#: Pieces whose names are broadcast at most; more meet the nodes by a shuffle.
BROADCAST_PIECES = 500_000

#: side: which ends of its block an interval reaches (F first, L last, B both, empty: none, so the node is complete).
NODE = "part int, sub int, side string, depth long, low long, convs long, children long, leaves long, saved long, before long, head boolean, ends string, chunk string, parent_side string, parent_low long"
SUMMARY = "first_key string, last_key string, least long, first_bytes array<long>"
BORDERS = "part int, sub int, border long, border_bytes long, tail_leaf int, open array<struct<lo: long, hi: long, part: int, sub: int>>"
MERGED = "o_part int, o_sub int, tail boolean, depth long, low long, convs long, children long, leaves long, saved long, ends string, part int, sub int, parent_side string"
NONE = hashlib.sha256(b"").hexdigest()


def names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def shared_turns(a: str, b: str) -> int:
    """How many turns two conversations have in common at their beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // DIGITS
    x, y = (np.frombuffer(s[:n].encode(), np.uint8) for s in (a, b))
    return int(np.argmax(x != y)) // DIGITS


def nearest_smaller(a: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For i in 1..n-1 of an array with a[0] = a[n] = -1: the nearest smaller values to the left and to the right, and the first position of an equal value in that interval."""
    n = len(a) - 1
    left, right, same, stack = [0] * n, [n] * n, list(range(n)), []
    for i in range(1, n):
        while stack and a[stack[-1]] > a[i]:
            right[stack.pop()] = i
        if stack and a[stack[-1]] == a[i]:
            left[i], same[i] = left[stack[-1]], same[stack[-1]]
        else:
            left[i] = stack[-1] if stack else 0
        stack.append(i)
    return np.array(left), np.array(right), np.array(same)


class Block:
    """Some distinct conversations that follow each other in the sorted order."""

    def __init__(self, part: int, sub: int, most: tuple[int, int, int]) -> None:
        self.part, self.sub, self.most = part, sub, most
        self.keys: list[str] = []
        self.sizes: list[np.ndarray] = []  # bytes of the turns
        self.ids: list[list[int]] = []
        self.turns = 0

    def full(self, key: str) -> bool:
        same = bool(self.keys) and self.keys[-1] == key
        convs, turns, ids = self.most
        return (not same and (len(self.keys) >= convs or self.turns >= turns)) or (same and len(self.ids[-1]) >= ids)

    def add(self, conv_id: int, key: str, sizes: np.ndarray) -> None:
        if self.keys and self.keys[-1] == key:
            self.ids[-1].append(conv_id)
            return
        if len(self.ids) > 1:  # neither the first nor the last any more: nothing can follow in another block
            self.ids[-1] = [self.ids[-1][0], len(self.ids[-1]), hashlib.sha256(",".join(map(str, self.ids[-1])).encode()).hexdigest()]
        self.keys.append(key)
        self.sizes.append(sizes)
        self.ids.append([conv_id])
        self.turns += len(sizes)

    def rows(self) -> pa.RecordBatch:
        n = len(self.keys)
        inner = lambda i: 0 < i < n - 1
        lengths = np.array([len(s) for s in self.sizes])
        low = np.array([x[0] for x in self.ids])
        weight = np.array([x[1] if inner(i) else len(x) for i, x in enumerate(self.ids)])
        lcp = [-1, *(shared_turns(a, b) for a, b in zip(self.keys, self.keys[1:], strict=False)), -1]
        left, right, same = nearest_smaller(lcp)
        a = np.array(lcp)
        # bytes of the first k turns of conversation i: total[at[i] + k]
        at = np.concatenate([[0], np.cumsum(lengths + 1)])
        total = np.concatenate([np.concatenate([[0], np.cumsum(s)]) for s in self.sizes]).astype(np.int64)
        whole = total[at[1:] - 1]
        new = whole - total[at[:-1] + np.maximum(a[:-1], 0)]
        leaf = np.append(a[1:-1] < lengths[:-1], False)
        sums = lambda x: np.concatenate([[0], np.cumsum(x)])
        convs, bytes_, fresh, leaves = sums(weight), sums(weight * whole), sums(new), sums(leaf)

        # nodes of the tree: one for each distinct interval, then one for each conversation
        inside = np.flatnonzero(same[1:] == np.arange(1, n)) + 1
        branches = np.bincount(same[1:][lengths[1:] > a[1:-1]], minlength=n) if n > 1 else np.zeros(1, dtype=np.int64)
        begin = np.concatenate([left[inside], np.arange(n)])
        end = np.concatenate([right[inside], np.arange(n) + 1])
        value = np.concatenate([a[inside], lengths])
        rest = np.concatenate([branches[inside], np.zeros(n, dtype=np.int64)])
        top = np.maximum(a[begin], a[end])
        above = np.where(a[begin] >= a[end], begin, end)  # the position whose interval is the parent's
        parent_begin, parent_end = left[np.minimum(above, n - 1)], right[np.minimum(above, n - 1)]
        least = lambda lo, hi: np.minimum.reduceat(np.append(low, low[-1]), np.stack([lo, hi], axis=1).ravel())[::2]
        node_low, parent_low = least(begin, end), least(parent_begin, parent_end)
        side = lambda lo, hi: np.select([(lo == 0) & (hi == n), lo == 0, hi == n], ["B", "F", "L"], "")
        node_side, parent_side = side(begin, end), side(parent_begin, parent_end)

        # every depth below the parent's
        k = np.repeat(np.arange(len(value)), value - top)
        depth = top[k] + 1 + np.arange(len(k)) - np.repeat(np.cumsum(value - top) - (value - top), value - top)
        lo, hi, last = begin[k], end[k], depth == value[k]
        before = total[at[lo] + np.maximum(depth - 1, 0)]
        w = convs[hi] - convs[lo]
        head = lengths[lo] > depth
        complete = node_side[k] == ""
        first_known = lo > 0  # then the node has no members before this block
        kept = bytes_[hi] - bytes_[lo] - w * before - (fresh[hi] - fresh[lo + 1]) - whole[lo] + np.where(first_known, before, 0)
        children = np.where(last, rest[k], 0) + np.where(first_known, head, False)
        ended = lengths[lo] == depth
        ends = [(self.ids[i][2] if e else NONE) if inner(i) else NONE if not e and c else None for i, e, c in zip(lo, ended, complete, strict=True)]
        chunk = [",".join(map(str, self.ids[i])) if e and not inner(i) else None for i, e in zip(lo, ended, strict=True)]
        chain = depth > top[k] + 1  # the parent has the same interval
        columns = [
            pa.array(np.full(len(k), self.part, np.int32)), pa.array(np.full(len(k), self.sub, np.int32)), pa.array(node_side[k].tolist(), pa.string()), pa.array(depth), pa.array(node_low[k]), pa.array(w), pa.array(children.astype(np.int64)),
            pa.array(leaves[hi] - leaves[lo]), pa.array(kept), pa.array(before), pa.array(head), pa.array(ends, pa.string()), pa.array(chunk, pa.string()),
            pa.array(np.where(chain, node_side[k], parent_side[k]).tolist(), pa.string()), pa.array(np.where(chain, node_low[k], parent_low[k])),
        ]
        empty = [pa.nulls(len(k), t) for t in (pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()))]
        nodes = pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, KINDS, strict=True)] + empty, names=names(NODE) + names(SUMMARY))
        own = [self.part, self.sub, None, None, low[0], lengths[-1], *[None] * 9, self.keys[0], self.keys[-1], int(a[1:-1].min(initial=lengths[0])), total[: lengths[0] + 1].tolist()]
        summary = pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(own, [*KINDS, pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64())], strict=True)], names=nodes.schema.names)
        return pa.Table.from_batches([nodes, summary]).combine_chunks().to_batches()[0]


KINDS = [{"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[c.split()[1]] for c in NODE.split(", ")]


def block_rows(batches: Iterator[pa.RecordBatch], most: tuple[int, int, int]) -> Iterator[pa.RecordBatch]:
    """Nodes and pieces of every block (of a summary row, ``side`` is null and ``convs`` the length of its last conversation)."""
    part = TaskContext.get().partitionId()
    block = Block(part, 0, most)
    for batch in batches:
        sizes = batch.column(2)
        for i, (conv_id, key) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            if block.full(key):
                yield block.rows()
                block = Block(part, block.sub + 1, most)
            block.add(conv_id, key, sizes[i].values.to_numpy())
    if block.keys:
        yield block.rows()


def borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the blocks in order: what each shares with its neighbours, and where the nodes that are open at its beginning begin."""
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64()), ("part", pa.int32()), ("sub", pa.int32())]))]
    before, stack = None, []  # stack: from the root down, (lo, hi, part, sub) of the depths open at the border

    def row(b: dict, after: int) -> pa.RecordBatch:
        values = [b["part"], b["sub"], b["border"], b["border_bytes"], int(after < b["length"]), b["open"]]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=["part", "sub", "border", "border_bytes", "tail_leaf", "open"])

    for batch in batches:
        for b in batch.to_pylist():
            border = shared_turns(before["last_key"], b["first_key"]) if before else -1
            if before:
                # the block before keeps what its minimum reaches, and begins the depths from there to the border
                reach = min(before["least"], before["border"])
                stack = [{**s, "hi": min(s["hi"], reach, border)} for s in stack if s["lo"] <= min(reach, border)]
                if reach < border:
                    stack.append({"lo": reach + 1, "hi": border, "part": before["part"], "sub": before["sub"]})
                yield row(before, border)
            b |= {"border": border, "border_bytes": b["first_bytes"][border] if border >= 0 else 0, "open": list(stack)}
            before = b
    if before:
        yield row(before, -1)


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up pieces that come in the order of node and block; equal conversations' ids are hashed as they come."""
    types = [{"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[c.split()[1]] for c in MERGED.split(", ")]
    now, digest, rows = None, None, []

    def done() -> None:
        now["ends"] = now["ends"] or (digest.hexdigest() if digest else NONE)
        rows.append(now)

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in zip(names(MERGED), types, strict=True)], names=names(MERGED))

    for given in batches:
        for p in given.to_pylist():
            if now and all(now[c] == p[c] for c in ("o_part", "o_sub", "tail", "depth")):
                now |= {c: now[c] + p[c] for c in ("convs", "children", "leaves", "saved")} | {"low": min(now["low"], p["low"]), "ends": now["ends"] or p["ends"]}
            else:
                if now:
                    done()
                now, digest = {c: p[c] for c in names(MERGED)}, None
            if p["chunk"] is not None:
                if digest:
                    digest.update(b",")
                digest = digest or hashlib.sha256()
                digest.update(p["chunk"].encode())
        if len(rows) >= 4096:
            yield batch()
            rows = []
    if now:
        done()
    if rows:
        yield batch()


def prefix_trie(turns: DataFrame, block: tuple[int, int, int] = BLOCK) -> DataFrame:
    """(conv_id, position, role, text) -> one row per distinct prefix of conversations.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens (bytes of last texts that all members but one share,
    over the subtree) and ends_sha256 (of the ids that end there).
    """
    spark, n = turns.sparkSession, width(turns.sparkSession)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    role, said = text("role"), text("text")
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, said), 256), 1, DIGITS)
    turn = F.when(F.col("position").isNotNull(), F.struct(F.col("position").cast("long").alias("position"), role.alias("role"), digest.alias("digest"), F.octet_length(said).cast("long").alias("bytes")))
    convs = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn"))
    convs = convs.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("t"))
    keys = saved(spark, convs.select("conv_id", F.array_join("t.digest", "").alias("key"), F.col("t.bytes").alias("sizes")), "trie-keys")

    order = ["key", "conv_id"]
    found = keys.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(lambda it: block_rows(it, block), f"{NODE}, {SUMMARY}")
    found = saved(spark, found, "trie-nodes")
    blocks = found.where("side IS NULL").select("part", "sub", F.col("convs").alias("length"), *names(SUMMARY))
    # one row per block goes through this one task
    border = blocks.repartition(1).sortWithinPartitions("part", "sub").mapInArrow(borders, BORDERS)
    border = saved(spark, border, "trie-borders")

    pieces = found.where("side <> ''").select(*names(NODE)).join(border, ["part", "sub"])
    first, last = F.col("side").isin("F", "B"), F.col("side").isin("L", "B")
    begun = first & (F.col("depth") <= F.col("border"))  # before this block
    owner = F.when(begun, F.filter("open", lambda s: F.col("depth").between(s["lo"], s["hi"]))[0])
    more = F.when(begun, (F.col("head") & (F.col("depth") == F.col("border"))).cast("long")).when(first, F.col("head").cast("long")).otherwise(F.lit(0))
    pieces = pieces.withColumns({
        "o_part": F.coalesce(owner["part"], "part"), "o_sub": F.coalesce(owner["sub"], "sub"), "tail": begun | last,
        "children": F.col("children") + more,
        "leaves": F.col("leaves") + F.when(last, F.col("tail_leaf")).otherwise(0),
        "saved": F.col("saved") + F.when(begun, F.col("border_bytes")).when(first, F.col("before")).otherwise(0),
    })
    pieces = saved(spark, pieces.drop("open"), "trie-pieces")
    key = ["o_part", "o_sub", "tail", "depth"]
    grouped = pieces.repartition(n, *key).sortWithinPartitions(*key, "part", "sub")
    whole = saved(spark, grouped.mapInArrow(merged, MERGED), "trie-merged")

    lows = pieces.select("part", "sub", "side", *key).join(whole.select(*key, "low"), key)
    lows = lows.select("part", "sub", F.col("side").alias("parent_side"), (F.col("depth") + 1).alias("depth"), F.col("low").alias("open_low"))
    lows = F.broadcast(lows) if pieces.count() <= BROADCAST_PIECES else lows
    columns = [F.col("low").alias("conv_id"), "depth", "parent_low", "convs", "children", "leaves", "saved", "ends"]
    closed = found.where("side = ''").select("part", "sub", "parent_side", "parent_low", *columns[:2], *columns[3:])
    opened = whole.select("part", "sub", "parent_side", F.lit(None).cast("long").alias("parent_low"), *columns[:2], *columns[3:])
    nodes = closed.unionByName(opened).join(lows, ["part", "sub", "parent_side", "depth"], "left")
    return nodes.select(
        "conv_id", "depth", F.coalesce("open_low", "parent_low").alias("parent_conv_id"), F.col("convs").alias("n_convs"),
        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"),
    )
