"""Substring deduplication over compressed FM-indexes, one per shard.

A word goes if a window of ``SPAN`` words over it also starts in a document
with a smaller id.  Shards are cut by content, so that a window meets its equals
in one shard and no document is streamed against shards that cannot hold its
windows:

1. Documents are written once, bucketed by id; all later joins with their text
   are with that table and move only the other, small side.
2. Every ``GRAM``-gram that is the minimum of the grams of some window is a
   fingerprint; equal windows have equal fingerprints at equal offsets.
   Fingerprints that only one document has are left out.
3. A run of windows with one fingerprint is a *region*.  A region goes to the
   shard of its fingerprint: its words once per task, and every place it
   occurs at.  The shard indexes the distinct regions (BWT in a wavelet matrix);
   regions are streamed through backward search, and the least document in a
   window's interval of suffixes is the first that has the window.
4. Places are streamed against that, after the index is built: a shard's places
   are never held together.
5. Word intervals return to the documents, which are cut and hashed.

A passage may be in any share of the documents.  Fingerprints that alone would
fill a shard (``SHARD_ENTRIES``, and ``HOT_SHARE`` of all entries) count as shared
without being dealt, and their windows are regions of their own, dealt over all
shards by content.  Windows that would fill one get shards of their own, whose
places are salted.  There are at most ``1 / HOT_SHARE`` of either, which bounds
their broadcasts.  Parts of the documents and shards grow in number with the text, not
in size.

Blocks of places and fingerprints travel as packed arrays, a row per task and
shard, not as a row each.  Words are compared as bytes inside a shard; a region
is named by 128 bits of its words.

Null or short texts (below ``SPAN`` words) lose nothing; texts of any length are
read whole.  Of documents that share a window the smallest id keeps it; a
document's own repeats stay.  Rows repeated with one id are one document: they
do not remove each other's words, and each gets the intervals of its own text
(told apart by a hash).  A null id is larger than every other.  An empty table
gives no rows, and other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fm_index import SPAN, FmIndex
from .scratch import saved, scratch_root, width
from .words import MIX_A, ascii_words, gram_hashes, only_caches, scramble, sliding_min, word_hashes

GRAM = 5
WINDOW = SPAN - GRAM + 1
#: Packed entries that a task holds before it hands them on.
BLOCK = 400_000
#: Text whose windows are made at once, or one text if it is longer.
TOGETHER = 256 << 10
#: Fingerprint entries per shard, about.
SHARD_ENTRIES = 600_000
#: Text in one part of the documents.
PART_BYTES = 64 << 20
#: Share of the fingerprint entries, or of the windows, from which one is dealt out by itself.
HOT_SHARE = 1e-5
NULL_ID = (1 << 63) - 1

PRINT = np.dtype([("print", "<u8"), ("key", "<i8")])
PLACE = np.dtype([("region", "S16"), ("key", "<i8"), ("row", "<u8"), ("at", "<i4")])
SPAN_OF = np.dtype([("key", "<i8"), ("row", "<u8"), ("start", "<i4"), ("end", "<i4")])


def fingerprints(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window the position of its minimal gram, and all gram hashes."""
    grams = gram_hashes(hashes, GRAM)
    return sliding_min(grams, WINDOW), grams


def bucketed(spark, df: DataFrame, buckets: int) -> DataFrame:
    """``df`` written in ``buckets`` files by ``key``: joins on ``key`` shuffle only their other side."""
    name = f"netlattice_{uuid.uuid4().hex}"
    path = f"{scratch_root(spark)}/{name}"
    df.repartition(buckets, "key").write.option("compression", "zstd").option("path", path).bucketBy(buckets, "key").saveAsTable(name)
    written = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the catalog's entry only: the files are read until the session ends
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return written


def packed(kind: np.dtype, entries: np.ndarray, group: np.ndarray, names: tuple[str, str]) -> pa.RecordBatch:
    """A row per group: its number and its entries as bytes, compressed."""
    order = np.argsort(group, kind="stable")
    parts = [g for g in np.split(order, np.flatnonzero(np.diff(group[order])) + 1) if len(g)]
    # field after field, so that what repeats lies together
    blobs = [b"".join(np.ascontiguousarray(entries[g][f]).tobytes() for f in kind.names) for g in parts]
    return pa.RecordBatch.from_arrays([pa.array([int(group[g[0]]) for g in parts], pa.int32()), pa.array(blobs, pa.binary())], names=list(names))


def unpacked(kind: np.dtype, blob: bytes) -> np.ndarray:
    n = len(blob) // kind.itemsize
    out, at = np.empty(n, dtype=kind), 0
    for f in kind.names:
        size = kind[f].itemsize * n
        out[f] = np.frombuffer(blob, kind[f], count=n, offset=at)
        at += size
    return out


def distinct(entries: np.ndarray) -> np.ndarray:
    """Fingerprint entries in order of print and key, each once."""
    entries = entries[np.lexsort((entries["key"], entries["print"]))]
    new = (entries["print"][1:] != entries["print"][:-1]) | (entries["key"][1:] != entries["key"][:-1])
    return entries[np.concatenate([[True], new])]


def spread(key: np.ndarray, parts: int) -> np.ndarray:
    return (scramble(key.astype(np.int64).view(np.uint64)) % np.uint64(parts)).astype(np.int64)


def together(batch: pa.RecordBatch) -> Iterator[list[list]]:
    """The columns of a batch in parts of about ``TOGETHER`` bytes of text (second column), without null texts."""
    held, n = [], 0
    for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        if row[1] is None:
            continue
        held.append(row)
        n += len(row[1])
        if n >= TOGETHER:
            yield [list(c) for c in zip(*held, strict=True)]
            held, n = [], 0
    if held:
        yield [list(c) for c in zip(*held, strict=True)]


class Windows:
    """All windows of some texts: the word each begins with, its text's number and the word its minimal gram begins with."""

    def __init__(self, texts: list[bytes]) -> None:
        self.flat = b" ".join(texts)
        self.starts, self.ends, self.hashes = word_hashes(self.flat)
        offsets = np.cumsum([0] + [len(x) + 1 for x in texts])
        self.first = np.searchsorted(self.starts, offsets)  # word that a text begins with
        owner = np.repeat(np.arange(len(texts)), np.diff(self.first))
        best, self.grams = fingerprints(self.hashes)
        self.at = np.flatnonzero(owner[: len(best)] == owner[SPAN - 1 :][: len(best)])
        self.text, self.best = owner[self.at], best[self.at]


def prints_in(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """Fingerprint entries of a batch (key, text), many documents at a time; a print may repeat in a document."""
    for keys, texts in together(batch):
        windows = Windows(texts)
        new = np.flatnonzero(np.diff(windows.best, prepend=-1))
        entries = np.empty(len(new), dtype=PRINT)
        entries["print"], entries["key"] = windows.grams[windows.best[new]], np.array(keys, dtype=np.int64)[windows.text[new]]
        yield entries


def windows_in(batch: pa.RecordBatch, hot_prints: np.ndarray) -> Iterator[np.ndarray]:
    """Hashes of the windows with a hot fingerprint."""
    for _, texts in together(batch):
        windows = Windows(texts)
        yield gram_hashes(windows.hashes, SPAN)[windows.at[np.isin(windows.grams[windows.best], hot_prints)]]


def tallied(values: Callable[[pa.RecordBatch], Iterator[np.ndarray]]) -> Callable:
    """(key, text) -> (every, h, n): values common in a task's chunk, and a row with the number of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_caches()
        held, n = [], 0

        def out() -> pa.RecordBatch:
            found, counts = np.unique(np.concatenate(held), return_counts=True)
            common = counts >= max(2, HOT_SHARE * n / 4)
            found, counts = found[common].view(np.int64), counts[common]
            return pa.RecordBatch.from_arrays([pa.array([False] * len(found) + [True]), pa.array(np.append(found, 0)), pa.array(np.append(counts, n))], names=["every", "h", "n"])

        for batch in batches:
            for some in values(batch):
                held.append(some)
                n += len(some)
                if n >= 4_000_000:
                    yield out()
                    held, n = [], 0
        if n:
            yield out()

    return run


def hot(texts: DataFrame, values: Callable) -> dict[int, int]:
    """Values that would fill a shard, with their counts."""
    counts = saved(texts.sparkSession, texts.select("key", "text").mapInArrow(tallied(values), "every boolean, h long, n long").groupBy("every", "h").agg(F.sum("n").alias("n")), "substring-hot")
    total = (counts.where("every").first() or {"n": 0})["n"]
    rows = counts.where(~F.col("every") & (F.col("n") >= max(HOT_SHARE * total, SHARD_ENTRIES))).collect()  # 1 / HOT_SHARE at most
    return {r["h"] & 0xFFFFFFFFFFFFFFFF: r["n"] for r in rows}


def deal_prints(shards: int, hot_prints) -> Callable:
    """Fingerprints with the documents they are in, by fingerprint; hot ones only tell that a document has some, by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_caches()
        held, n = [], 0

        def out() -> pa.RecordBatch:
            entries = distinct(np.concatenate(held))
            is_hot = np.isin(entries["print"], hot_prints.value)
            marks = entries[is_hot]
            entries = np.concatenate([entries[~is_hot], marks[np.unique(marks["key"], return_index=True)[1]]])
            is_hot = np.isin(entries["print"], hot_prints.value)
            by = np.where(is_hot, entries["key"], entries["print"].view(np.int64))
            return packed(PRINT, entries, spread(by, shards), ("shard", "prints"))

        for batch in batches:
            for some in prints_in(batch):
                held.append(some)
                n += len(some)
                if n >= BLOCK:
                    yield out()
                    held, n = [], 0
        if n:
            yield out()

    return run


def shared_prints(parts: int, hot_prints) -> Callable:
    """Fingerprints of two documents or more, and hot ones, regrouped by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [unpacked(PRINT, x) for batch in batches for x in batch.column(1).to_pylist()]
        if not held:
            return
        entries = distinct(np.concatenate(held))
        new = np.concatenate([[True], entries["print"][1:] != entries["print"][:-1]])
        size = np.diff(np.concatenate([np.flatnonzero(new), [len(entries)]]))
        entries = entries[np.repeat(size > 1, size) | np.isin(entries["print"], hot_prints.value)]
        entries = entries[np.argsort(entries["key"], kind="stable")]
        for lo in range(0, len(entries), BLOCK):
            part = entries[lo : lo + BLOCK]
            yield packed(PRINT, part, spread(part["key"], parts), ("part", "prints"))

    return run


def by_key(kind: np.dtype) -> Callable:
    """Packed entries -> a row per key with its entries, packed.  A part of the documents at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [unpacked(kind, x) for batch in batches for x in batch.column(1).to_pylist()]
        if not held:
            return
        entries = np.concatenate(held)
        entries = entries[np.argsort(entries["key"], kind="stable")]
        edges = np.concatenate([[0], np.flatnonzero(np.diff(entries["key"])) + 1, [len(entries)]])
        for lo in range(0, len(edges) - 1, 5000):
            bounds = edges[lo : lo + 5001]
            blobs = [entries[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(entries["key"][bounds[:-1]]), pa.array(blobs, pa.binary())], names=["key", "entries"])

    return run


def in_text(prints: np.ndarray, text: np.ndarray) -> np.ndarray:
    """A hash of a fingerprint and the number of its text."""
    return scramble(prints + text.astype(np.uint64) * MIX_A)


def row_hash(text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(text)


def deal_regions(shards: int, hot_prints, own_shards) -> Callable:
    """Documents with their shared fingerprints -> (shard, kind 0: regions' words and smallest document | kind 1: places).

    ``own_shards``: hot window -> its shards.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_caches()
        regions: dict[tuple[int, bytes], list] = {}  # shard and name of a region -> [smallest key, words]
        places, n = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            by_shard: dict[int, list[tuple[bytes, int, bytes]]] = {}
            for (shard, region), (key, words) in regions.items():
                by_shard.setdefault(shard, []).append((region, key, words))
            names = ["shard", "kind", "head", "body"]
            rows = []
            for shard, found in by_shard.items():
                found.sort(key=lambda x: x[2])
                head = b"".join(x[0] for x in found) + np.array([x[1] for x in found], dtype="<i8").tobytes()
                rows.append((shard, 0, head, b"\n".join(x[2] for x in found)))
            entries = np.array(places, dtype=[("shard", "<i8"), *((f, PLACE[f]) for f in PLACE.names)])
            entries = entries[np.lexsort((entries["at"], entries["key"], entries["shard"]))]
            for part in np.split(entries, np.flatnonzero(np.diff(entries["shard"])) + 1):
                rows.append((int(part["shard"][0]), 1, b"", b"".join(np.ascontiguousarray(part[f]).tobytes() for f in PLACE.names)))
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        def placed(of: range, which: int, key: int, row: int, at: int, body: bytes) -> int:
            """The region is known in all shards ``of``, the place in one of them; returns about how many entries that makes."""
            region, made = xxhash.xxh3_128_digest(body), 1
            places.append((of[which], region, key, row, at))
            for shard in of:
                seen = regions.get((shard, region))
                if seen is None:
                    regions[shard, region] = [key, body]
                    made += len(body) // 16
                else:
                    seen[0] = min(key, seen[0])
            return made

        for batch in batches:
            for keys, texts, shared in together(batch):
                rows = [row_hash(x) for x in texts]
                found = Windows([b" ".join(ascii_words(x)) for x in texts])  # so that words lie one byte apart
                of_window = found.grams[found.best]
                starts = np.flatnonzero(np.concatenate([[True], (np.diff(of_window) != 0) | (np.diff(found.text) != 0)])[: len(of_window)])
                ends = np.append(starts[1:], len(of_window))
                print_of, text_of, at, size = of_window[starts], found.text[starts], found.at[starts], ends - starts
                hot_one = np.isin(print_of, hot_prints.value)
                # a pair taken for another makes a region that nothing else has
                known = [np.frombuffer(x, PRINT)["print"] for x in shared]
                pairs = in_text(np.concatenate(known), np.repeat(np.arange(len(known)), [len(x) for x in known]))
                hit = ~hot_one & np.isin(in_text(print_of, text_of), pairs)
                begin, end, local = found.starts[at], found.ends[at + size + SPAN - 2], at - found.first[text_of]
                shard = spread(print_of.view(np.int64), shards)
                for s, i, p, lo, hi in zip(*(x[hit].tolist() for x in (shard, text_of, local, begin, end)), strict=True):
                    n += placed(range(s, s + 1), 0, keys[i], rows[i], p, found.flat[lo:hi])
                if hot_one.any():
                    every = np.flatnonzero(np.repeat(hot_one, size))
                    at, text_of = found.at[every], found.text[every]
                    hashes = gram_hashes(found.hashes, SPAN)[at]
                    begin, end, local = found.starts[at], found.ends[at + SPAN - 1], at - found.first[text_of]
                    shard = spread(hashes.view(np.int64), shards)
                    for s, h, i, p, lo, hi in zip(*(x.tolist() for x in (shard, hashes, text_of, local, begin, end)), strict=True):
                        of = own_shards.value.get(h, range(s, s + 1))
                        n += placed(of, int(spread(np.array([keys[i]]), len(of))[0]), keys[i], rows[i], p, found.flat[lo:hi])
                if n >= BLOCK:
                    yield from out()
                    regions.clear()
                    places, n = [], 0
        if places:
            yield from out()

    return run


class Shard:
    """The distinct regions of one shard and, per window, the smallest document it occurs in."""

    def __init__(self, names: np.ndarray, keys: np.ndarray, bodies: list[bytes]) -> None:
        order = np.lexsort((keys, names))
        names, keys = names[order], keys[order]
        new = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
        self.names, least = names[new], keys[new]
        bodies = [bodies[order[i]] for i in new]
        n = np.array([b.count(b" ") + 1 for b in bodies])
        # words are told apart by their bytes; symbols are dense, 0 is left free
        flat, symbols = pd.factorize(np.array(b" ".join(bodies).split(b" "), dtype=object))
        sequences = np.split(flat + 1, np.cumsum(n)[:-1])
        index = FmIndex(sequences, len(symbols) + 1)
        self.windows = n - SPAN + 1
        lo, hi = (np.concatenate(x) for x in zip(*index.stream(sequences), strict=True))
        every, starts = index.least(lo, hi, least), np.cumsum(self.windows) - self.windows
        self.least = np.split(every, starts[1:])
        self.low, self.high = np.minimum.reduceat(every, starts), np.maximum.reduceat(every, starts)

    def spans(self, places: np.ndarray) -> np.ndarray:
        """Word intervals to remove at the given places."""
        at = np.searchsorted(self.names, places["region"])
        whole, some = self.high[at] < places["key"], self.low[at] < places["key"]
        out = np.empty(int(whole.sum()), dtype=SPAN_OF)
        for f in ("key", "row"):
            out[f] = places[f][whole]
        out["start"] = places["at"][whole]
        out["end"] = places["at"][whole] + self.windows[at[whole]] + SPAN - 1
        parts = []
        for i in np.flatnonzero(some & ~whole).tolist():
            p = places[i]
            for j in np.flatnonzero(self.least[at[i]] < p["key"]).tolist():
                parts.append((p["key"], p["row"], p["at"] + j, p["at"] + j + SPAN))
        return np.concatenate([out, np.array(parts, dtype=SPAN_OF)])


def search(parts: int) -> Callable:
    """Rows ordered by shard and kind: builds a shard's index from its regions, then streams its places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_caches()  # the index needs the room
        shard, regions, index = None, [], None
        found, n = [], 0

        def out() -> pa.RecordBatch:
            spans = np.concatenate(found)
            return packed(SPAN_OF, spans, spread(spans["key"], parts), ("part", "spans"))

        for batch in batches:
            for s, kind, head, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != shard:
                    shard, regions, index = s, [], None
                if kind == 0:
                    regions.append((head, body))
                    continue
                if index is None:
                    heads = [(np.frombuffer(h, "S16", len(h) // 24), np.frombuffer(h, "<i8", len(h) // 24, len(h) // 24 * 16)) for h, _ in regions]
                    index = Shard(np.concatenate([h[0] for h in heads]), np.concatenate([h[1] for h in heads]), [x for _, b in regions for x in b.split(b"\n")])
                    regions = []
                spans = index.spans(unpacked(PLACE, body))
                if len(spans):
                    found.append(spans)
                    n += len(spans)
                if n >= BLOCK:
                    yield out()
                    found, n = [], 0
        if found:
            yield out()

    return run


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, entries) -> doc_id, n_words, n_removed, kept."""
    only_caches()
    for batch in batches:
        rows = []
        for text, entries in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            words = ascii_words(text)
            removed = 0
            if entries:
                spans = np.frombuffer(entries, SPAN_OF)
                spans = spans[spans["row"] == row_hash(text or b"")]  # a row without text may share the key
                edge = np.bincount(spans["start"], minlength=len(words) + 1) - np.bincount(spans["end"], minlength=len(words) + 1)
                gone = np.cumsum(edge)[: len(words)] > 0
                removed = int(gone.sum())
                keep = [w for w, x in zip(words, gone.tolist(), strict=True) if not x]
            else:
                keep = words
            rows.append((len(words), removed, b" ".join(keep).decode("utf-8", "replace")))
        n, gone, kept = list(zip(*rows, strict=True)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept (words that stay, joined by one space)."""
    spark = docs.sparkSession
    doc_id = F.col(id_col).cast("long")
    rows = docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(NULL_ID)).alias("key"), F.col(text_col).cast("binary").alias("text"))
    n_rows, chars = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    parts = max(width(spark), chars // PART_BYTES + 1)
    texts = bucketed(spark, rows, parts)
    # a fingerprint is in as many documents as there are, at most, and a window in as many as its fingerprint
    prints = hot(texts, lambda batch: (some["print"] for some in prints_in(batch))) if n_rows >= SHARD_ENTRIES else {}
    prints = np.array(sorted(prints), dtype=np.uint64)
    windows = hot(texts, lambda batch: windows_in(batch, prints)) if len(prints) else {}
    shards = max(width(spark), chars // (28 * SHARD_ENTRIES) + 1)  # a fingerprint every 28 bytes of text, about
    hot_prints, own, n_shards = spark.sparkContext.broadcast(prints), {}, shards
    for h, n in windows.items():
        own[h] = range(n_shards, n_shards + n // SHARD_ENTRIES + 1)
        n_shards = own[h].stop
    own_shards = spark.sparkContext.broadcast(own)

    prints = texts.select("key", "text").mapInArrow(deal_prints(shards, hot_prints), "shard int, prints binary").repartitionById(shards, "shard")
    shared = prints.mapInArrow(shared_prints(parts, hot_prints), "part int, prints binary").repartitionById(parts, "part")
    shared = shared.mapInArrow(by_key(PRINT), "key long, entries binary")
    regions = texts.join(shared, "key").select("key", "text", "entries").mapInArrow(deal_regions(shards, hot_prints, own_shards), "shard int, kind int, head binary, body binary")
    regions = regions.repartitionById(n_shards, "shard").sortWithinPartitions("shard", "kind")
    spans = regions.mapInArrow(search(parts), "part int, spans binary").repartitionById(parts, "part")
    spans = spans.mapInArrow(by_key(SPAN_OF), "key long, entries binary")
    return texts.join(spans, "key", "left").select("doc_id", "text", "entries").mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")
