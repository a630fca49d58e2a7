"""Ways of addresses hop by hop, without a join a hop.

An address never changes on its way, so all that decides it are the routes that hold
it.  The address field is cut into stretches of about as many rows each; a route goes
to the stretches it has addresses in, and one shuffle brings them together with the
addresses that ask.  Hops are searches in sorted arrays then.  Memory is that of some
stretches, and no stretch is smaller than one address with the routes that hold it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlattice.operators.closure import whole_families

#: Rows of a stretch, and stretches at most; beyond, stretches have more rows.
ROWS = 1 << 13
STRETCHES = 1 << 12
#: Rows that are dealt at once.
DEALT = 1 << 16


def borders(rows: DataFrame) -> list[int]:
    """Where stretches begin, but for the first; each has about ``ROWS`` rows, or as many as hold an address if these are more.

    Borders say where work is done, not what comes of it.
    """
    share = F.when(~F.col("asks"), F.pow(F.lit(2.0), -F.col("width")))
    total, around = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(share), F.lit(0.0))).first()
    n = min(STRETCHES, int(total / max(ROWS, around)) + 1)
    return sorted({int(x) for x in rows.approxQuantile("lo", [i / n for i in range(1, n)], 1 / (4 * n))}) if n > 1 else []


def dealt(batches: Iterator[pa.RecordBatch], at: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (asks, node, lo, width, nh) -> one for every stretch that they have addresses in, with its number as ``family``."""
    for batch in batches:
        lo, width = batch["lo"].to_numpy(), batch["width"].to_numpy().astype(np.int64)
        size = np.where(batch["asks"].to_numpy(zero_copy_only=False), 1, np.int64(1) << (32 - np.minimum(width, 32)))
        first, last = np.searchsorted(at, lo, "right"), np.searchsorted(at, lo + size - 1, "right")
        after = np.cumsum(last - first + 1)  # places of a row's copies end here
        for begin in range(0, int(after[-1]) if len(after) else 0, DEALT):
            place = np.arange(begin, min(begin + DEALT, int(after[-1])))
            row = np.searchsorted(after, place, "right")
            family = last[row] - (after[row] - 1 - place)
            rows = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(family.astype(np.int32)), *rows.columns], names=["family", *rows.schema.names])


def firsts(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, each with its smallest value."""
    order = np.lexsort((value, key))
    key, value = key[order], value[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return key[first], value[first]


def walked(batches: Iterator[pa.RecordBatch], max_hops: int) -> Iterator[pa.RecordBatch]:
    """Rows of whole stretches -> (start, address, asked, hop, node, lo, width) of every hop but that of the start."""
    for table in whole_families(batches):
        asks = table["asks"].to_numpy()
        if not asks.any():
            continue
        both = pa.chunked_array([*table["node"].chunks, *table["nh"].chunks]).combine_chunks().dictionary_encode("encode")
        both = both if isinstance(both, pa.DictionaryArray) else both.chunk(0)
        # numbers of the nodes by their order, no node (null) last, so that the smallest number is the smallest next hop
        order = pc.array_sort_indices(both.dictionary, null_placement="at_end")
        nodes, place = both.dictionary.take(order), np.argsort(order.to_numpy())
        node, nh = np.split(place[both.indices.to_numpy()], 2)
        n, lo, width = len(nodes), table["lo"].to_numpy(), table["width"].to_numpy()
        routes = []
        for w in np.unique(width[~asks])[::-1]:  # widest first
            of = np.flatnonzero(~asks & (width == w))
            routes.append((w, *firsts(lo[of] * n + node[of], nh[of])))
        address, asked, start = lo[asks], width[asks], node[asks]
        open_, here = np.arange(len(address)), start
        for hop in range(1, max_hops + 1):
            next_, by = np.full(len(open_), -1), np.zeros(len(open_), np.int32)
            for w, key, to in routes:
                left = np.flatnonzero((next_ < 0) & (asked[open_] >= w))
                wanted = (address[open_[left]] >> (32 - int(w)) << (32 - int(w))) * n + here[left]
                found = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
                met = key[found] == wanted
                next_[left[met]], by[left[met]] = to[found[met]], w
            on = next_ >= 0
            open_, here, by = open_[on], next_[on], by[on]
            if not len(open_):
                break
            shift = 32 - by.astype(np.int64)
            columns = [nodes.take(pa.array(start[open_])), pa.array(address[open_]), pa.array(asked[open_]), pa.array(np.full(len(open_), hop, np.int32)), nodes.take(pa.array(here)), pa.array(address[open_] >> shift << shift), pa.array(by)]
            yield pa.RecordBatch.from_arrays(columns, names=["start", "address", "asked", "hop", "node", "lo", "width"])


def ways(fib: DataFrame, starts: DataFrame, max_hops: int) -> DataFrame:
    """(start, address, asked, hop, node, lo, width): see ``reach.trace``; no row for hop 0, equal starts once.

    ``fib``: node, lo, width, nh; ``starts``: start, address, asked.
    """
    kind = fib.select("node").union(fib.select("nh")).union(starts.select("start")).schema["node"].dataType
    node, nh = F.col("node").cast(kind).alias("node"), F.col("nh").cast(kind).alias("nh")
    span = [F.col("lo").cast("long").alias("lo"), F.col("width").cast("int").alias("width")]
    # a route with host bits holds nothing
    routes = fib.where("node is not null and width between 0 and 32 and lo % shiftleft(1L, 32 - width) = 0").select(F.lit(False).alias("asks"), node, *span, nh)
    asking = starts.distinct().select(F.lit(True).alias("asks"), F.col("start").cast(kind).alias("node"), F.col("address").cast("long").alias("lo"), F.col("asked").cast("int").alias("width"), F.lit(None).cast(kind).alias("nh"))
    rows = routes.unionByName(asking.where("node is not null and lo is not null and width is not null"))
    at = np.array(borders(rows), np.int64)
    name = kind.simpleString()
    cut = rows.mapInArrow(lambda it: dealt(it, at), f"family int, asks boolean, node {name}, lo long, width int, nh {name}")
    whole = cut.repartition("family").sortWithinPartitions("family")
    return whole.mapInArrow(lambda it: walked(it, max_hops), f"start {name}, address long, asked int, hop int, node {name}, lo long, width int")
