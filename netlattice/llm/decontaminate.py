"""Benchmark decontamination by winnowed fingerprints.

A text's words are hashed, its k-grams fingerprinted, and of every ``WINDOW``
consecutive k-grams the one with the smallest fingerprint is kept (winnowing).
With ``GRAM + WINDOW - 1 <= SPAN`` any shared run of ``SPAN`` words contains a
whole window on both sides, hence a kept fingerprint both sides agree on.  The
kept fingerprints of documents are looked up in those of the benchmark, and
each hit is extended along its diagonal by comparing words; runs of ``SPAN``
words or more are exactly the occurrences of the benchmark's windows.

An item shorter than ``SPAN`` words is one window: documents are scanned for
its fingerprint among all grams of that length (at most ``SPAN - 1`` lengths).

The benchmark goes to the executors in blocks of at most ``BLOCK_BYTES`` of
text, one after another, so what is broadcast is bounded: a larger benchmark is
a few more passes over the documents, whose hits are written and united per
document.

Null texts (of documents or items) have no words.  Rows repeated with the same
id are one document in the united result only when more than one block is
needed; then they are told apart by a row hash.  Repeated items count once per
item id.  Items without an id count as one item in n_items; having no
name, they do not enter items_sha256.  Exactly a twentieth of the words hit
contaminates.  Texts of any length are read whole; empty tables give no rows, or
no hits; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import saved
from .words import HASHES, gram_hashes, only_caches, sliced, sliding_min

SPAN, GRAM, WINDOW = 13, 5, 9
assert GRAM + WINDOW - 1 <= SPAN
#: Most benchmark text in one broadcast.
BLOCK_BYTES = 16 << 20
#: ASCII that is no letter or digit parts words; A-Z are lowered; bytes from 0x80 are word bytes.
FOLDED = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()

HITS = "doc_id long, row long, n_words long, spans array<struct<start:int,end:int>>, items array<string>"


def words_of(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lowering A-Z."""
    return text.translate(FOLDED).split() if text else []


def winnowed(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints kept and their positions."""
    grams = gram_hashes(words, GRAM)
    at = np.unique(sliding_min(grams, WINDOW))
    return grams[at], at


class Index:
    """Fingerprints of one block of items; built on the driver, at most ``BLOCK_BYTES`` of text."""

    def __init__(self, items: list[tuple[str | None, bytes]]) -> None:
        self.items = [(i, w) for i, t in items if (w := words_of(t))]
        self.places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.short: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for k, (_, words) in enumerate(self.items):
            hashes = HASHES.of(words)
            if len(words) < SPAN:
                self.short[len(words)][int(gram_hashes(hashes, len(words))[0])].append(k)
            else:
                for h, at in zip(*winnowed(hashes), strict=True):
                    self.places[int(h)].append((k, int(at)))
        self.prints = np.sort(np.array(list(self.places), dtype=np.uint64))
        self.short = {n: dict(x) for n, x in self.short.items()}
        self.short_prints = {n: np.sort(np.array(list(x), dtype=np.uint64)) for n, x in self.short.items()}

    def spans(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str | None]]:
        """Runs of document words inside occurring windows (merged) and the items that occur."""
        if not words or not self.items:
            return [], set()
        hashes = HASHES.of(words)
        found, items = [], set()
        if len(words) >= SPAN and len(self.prints):
            prints, places = winnowed(hashes)
            done: dict[tuple[int, int], int] = {}
            for p in np.flatnonzero(among(prints, self.prints)):
                at = int(places[p])
                for k, item_at in self.places[int(prints[p])]:
                    name, item = self.items[k]
                    if done.get((k, at - item_at), -1) > at:  # inside a run already extended
                        continue
                    lo, hi = 0, 0
                    while at - lo > 0 and item_at - lo > 0 and words[at - lo - 1] == item[item_at - lo - 1]:
                        lo += 1
                    while at + hi < len(words) and item_at + hi < len(item) and words[at + hi] == item[item_at + hi]:
                        hi += 1
                    done[k, at - item_at] = at + hi
                    if lo + hi >= SPAN:
                        found.append((at - lo, at + hi))
                        items.add(name)
        for n, prints in self.short_prints.items():
            grams = gram_hashes(hashes, n)
            for at in np.flatnonzero(among(grams, prints)).tolist():
                for k in self.short[n][int(grams[at])]:
                    if words[at : at + n] == self.items[k][1]:
                        found.append((at, at + n))
                        items.add(self.items[k][0])
        return merged(found), items


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array ``known``."""
    if not len(known):
        return np.zeros(len(values), dtype=bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def scan(batches: Iterator[pa.RecordBatch], index) -> Iterator[pa.RecordBatch]:
    only_caches(HASHES)
    index = index.value
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for batch in sliced(batches):
        n_words, spans, items = [], [], []
        for text in batch.column(2).to_pylist():
            words = words_of(text)
            found, names = index.spans(words)
            n_words.append(len(words))
            spans.append([{"start": lo, "end": hi} for lo, hi in found])
            items.append(sorted(names, key=lambda x: (x is None, x or "")))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(spans, spans_type), pa.array(items, pa.list_(pa.string()))],
            names=["doc_id", "row", "n_words", "spans", "items"],
        )


def joined_sha256(names: list[str]) -> str:
    return hashlib.sha256(",".join(names).encode()).hexdigest()


def n_blocks(benchmark: DataFrame, text_col: str) -> int:
    """Twice as many blocks as would do, for items are dealt out by hash; one if all fit."""
    total = benchmark.agg(F.sum(F.length(F.col(text_col).cast("binary")))).first()[0] or 0
    return 1 if total <= BLOCK_BYTES else -(-2 * total // BLOCK_BYTES)


def blocks(benchmark: DataFrame, item_col: str, text_col: str, n: int) -> Iterator[list[tuple[str | None, bytes]]]:
    """The benchmark in ``n`` blocks of at most ``BLOCK_BYTES``, about (one item at least), each fetched alone; empty ones are left out."""
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("binary").alias("text")).where("text is not null")
    for b in range(n):
        part = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b) if n > 1 else rows
        if items := [(r[0], bytes(r[1])) for r in part.toLocalIterator()]:
            yield items


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """One row per document: its words, the merged word spans that are hit, the items that occur."""
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("row"), F.col(text_col).cast("binary").alias("text"))
    n = n_blocks(benchmark, text_col)
    if n == 1:
        index = sc.broadcast(Index(next(blocks(benchmark, item_col, text_col, n), [])))
        return rows.mapInArrow(lambda it: scan(it, index), HITS)
    rows = rows.withColumn("row", F.xxhash64("text"))
    found, passes = None, 0
    for items in blocks(benchmark, item_col, text_col, n):  # one index at a time is out
        index = sc.broadcast(Index(items))
        part = saved(docs.sparkSession, rows.mapInArrow(lambda it, i=index: scan(it, i), HITS), "decontaminate-hits")
        index.destroy()
        found, passes = part if found is None else found.unionByName(part), passes + 1
    copies = F.count(F.lit(1)) / F.lit(passes)  # rows repeated with id and text
    united = found.groupBy("doc_id", "row").agg(F.first("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), copies.cast("int").alias("copies"))
    joined = F.aggregate(
        "spans",
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda acc, s: F.when((F.size(acc) > 0) & (s["start"] <= F.element_at(acc, -1)["end"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.element_at(acc, -1)["start"], F.greatest(F.element_at(acc, -1)["end"], s["end"]))).cast("array<struct<start:int,end:int>>"))).otherwise(F.concat(acc, F.array(s))),
    )
    return united.select("doc_id", "row", "n_words", joined.alias("spans"), "items", F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("copy")).drop("copy")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **columns: str) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated (a twentieth of its words are hit), spans."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    found = hits(docs, benchmark, **columns).withColumn("n_hit", n_hit)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        "spans",
    )
