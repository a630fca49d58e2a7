"""Closures of walks inside families of classes, without a join a round.

Packets that never change stay in their class, and packets that change a little
(a tag) in a small family of classes.  What is true of a family follows from its
own edges, so one shuffle brings these together, and the rounds are operations on
arrays over some thousand families at once.  Memory is that of one stretch of edges,
or of one family (the edges of the network for a few classes).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Edges that are worked on at once, but for a family that has more.
EDGES = 1 << 16
#: Rows that are handed back at once.
ROWS = 1 << 16
NAMES = ["dst", "arrival", "cls", "node", "hop"]


def whole_families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows in order of their family -> tables that no family straddles."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < EDGES:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        family = codes(table["family"])[0]
        at = int(np.flatnonzero(family != family[-1])[-1]) + 1 if (family != family[-1]).any() else 0
        if at:
            yield table.slice(0, at)
        held = table.slice(at).to_batches()
        n = table.num_rows - at
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def codes(*columns: pa.ChunkedArray) -> tuple:
    """Numbers of the values, the same in all columns, and the values by number."""
    found = pa.chunked_array([c for column in columns for c in column.chunks], columns[0].type).combine_chunks().dictionary_encode()
    found = found if isinstance(found, pa.DictionaryArray) else found.chunk(0)
    numbers = found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return (*np.split(numbers, np.cumsum([len(c) for c in columns])[:-1]), found.dictionary)


def closed(batches: Iterator[pa.RecordBatch], bound: int | None, exact: bool, selves: bool, kinds: list[int] | None = None, first_only: bool = False) -> Iterator[pa.RecordBatch]:
    """Edges (family, cls_in, src, dst, cls_out, goal) -> NAMES: states with a walk whose last edge is a goal.

    Each state once with its first hop, or, if ``exact``, once for every number of edges.
    ``selves``: only states whose node is where the walk ends.  ``kinds``: edges have a
    column ``kind`` too, and those of the kind ``kinds[hop - 1]`` can be the ``hop``-th,
    counted from the target.  ``first_only``: walks are followed as ``exact`` says, but a
    state is told with its first hop alone.
    """
    for table in whole_families(batches):
        family, _ = codes(table["family"])
        src, dst, nodes = codes(table["src"], table["dst"])
        before, after, classes = codes(table["cls_in"], table["cls_out"])
        n, c = len(nodes), len(classes)
        keys, place = np.unique(np.concatenate([(family * c + before) * n + src, (family * c + after) * n + dst]), return_inverse=True)
        order = np.argsort(place[: len(src)], kind="stable")
        tail, head = place[: len(src)][order], place[len(src) :][order]
        goal = table["goal"].to_numpy()[order]
        kind = table["kind"].to_numpy()[order] if kinds else None
        begun = np.flatnonzero(np.diff(tail, prepend=-1))
        sources = tail[begun]
        node, of = keys % n, keys // (n * c)
        ends = np.unique(head[goal])  # states that are targets, numbered inside their family
        if not len(ends):
            continue
        begins = np.flatnonzero(np.diff(of[ends], prepend=-1))
        number = np.arange(len(ends)) - np.repeat(begins, np.diff(np.append(begins, len(ends))))
        start = np.zeros(int(of.max()) + 2, np.int64)
        start[of[ends][begins]] = begins  # where a family's targets begin
        for low in range(0, int(number.max()) + 1, 64):  # 64 targets of every family at once
            here = (number >= low) & (number < low + 64)
            bit = np.zeros(len(keys), np.uint64)
            bit[ends[here]] = np.uint64(1) << (number[here] - low).astype(np.uint64)
            known = np.zeros(len(keys), np.uint64)
            own = np.zeros(len(keys), np.uint64)
            if selves:  # targets at the same node
                at = of[ends] * n + node[ends]
                one = np.argsort(at, kind="stable")
                names, firsts = np.unique(at[one], return_index=True)
                joined = np.bitwise_or.reduceat(bit[ends[one]], firsts)
                mine = of * n + node
                found = np.minimum(np.searchsorted(names, mine), len(names) - 1)
                own = np.where(names[found] == mine, joined[found], np.uint64(0))
            moved, hop = np.where(goal, bit[head], np.uint64(0)), 0
            while bound is None or hop < bound:
                hop += 1
                new = np.zeros(len(keys), np.uint64)
                new[sources] = np.bitwise_or.reduceat(np.where(kind == kinds[hop - 1], moved, np.uint64(0)) if kinds else moved, begun)
                fresh = new if exact and not first_only else new & ~known
                known |= new
                if not exact:
                    new = fresh
                if not new.any():
                    break
                told = fresh & own if selves else fresh
                state = np.flatnonzero(told)
                for lo in range(0, len(state), ROWS // 16):
                    some = state[lo : lo + ROWS // 16]
                    row, place_ = np.nonzero(np.unpackbits(told[some].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
                    at = some[row]
                    end = ends[start[of[at]] + low + place_]
                    columns = [nodes.take(pa.array(node[end])), classes.take(pa.array(keys[end] // n % c)), classes.take(pa.array(keys[at] // n % c)), nodes.take(pa.array(node[at])), pa.array(np.full(len(at), hop, np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, names=NAMES)
                moved = new[head]


def closure(fwd: DataFrame, goal: DataFrame | None, bound: int | None, exact: bool = False, selves: bool = False, family: Column | None = None, allowed: Callable[[int], DataFrame] | None = None, first_only: bool = False) -> DataFrame:
    """(dst, arrival, cls, node, hop) of packets (cls_in, src, dst, cls_out) that get to the nodes ``goal`` (dst; None: to any).

    ``family``: what the classes have in common that a packet can be in on its way; by default its class, which stays.
    ``allowed``: hop -> the edges that can be the ``hop``-th, counted from the target; edges come once for each different
    answer, not for each hop.
    """
    kinds = None
    if allowed:
        answers: list[DataFrame] = []
        kinds = []
        for hop in range(1, bound + 1):
            here = allowed(hop)
            known = [i for i, other in enumerate(answers) if here.sameSemantics(other)]
            kinds.append(known[0] if known else len(answers))
            answers += [] if known else [here]
        fwd = reduce(DataFrame.unionByName, (df.withColumn("kind", F.lit(i)) for i, df in enumerate(answers)))
    extra = ["kind"] if allowed else []
    edges = fwd.select((F.col("cls_in") if family is None else family).alias("family"), "cls_in", "src", "dst", "cls_out", *extra)
    if goal is None:
        edges = edges.withColumn("goal", F.lit(True))
    else:
        marked = goal.select("dst").distinct().withColumn("goal", F.lit(True))
        edges = edges.join(marked, "dst", "left").withColumn("goal", F.coalesce("goal", F.lit(False)))
    edges = edges.select("family", "cls_in", "src", "dst", "cls_out", "goal", *extra).repartition("family").sortWithinPartitions("family")
    kind = {f.name: f.dataType.simpleString() for f in fwd.schema}
    schema = f"dst {kind['dst']}, arrival {kind['cls_out']}, cls {kind['cls_in']}, node {kind['src']}, hop int"
    return edges.mapInArrow(lambda it: closed(it, bound, exact, selves, kinds, first_only), schema)
