"""Exact Jaccard join of word-shingle sets in their metric space, up to connected components.

Jaccard distance is a metric, but documents make poor pivots for a whole corpus:
unrelated documents are all at distance 1 from all of them, so every region's
window would take in nearly every document (figures in the README).  The corpus
is therefore dealt by single shingles first, and pivots that are documents take
over where there is structure for them.

1. *Nodes.*  Equal sets are one node, so copies never meet.  A node keeps its
   first ``n - ceil(t n) + 1`` shingles in one global order (few frequent words
   first, shingles measured as frequent last): two sets within the radius share
   one of these, as the distances 1 - 1/|x| to one-shingle pivots and the triangle
   inequality have it.  So a passage that many documents share makes no region
   unless it is most of them.  A node also
   keeps a parity sketch; Hamming distances of sketches never exceed the
   symmetric difference of the sets, itself a metric.
2. *Regions.*  The nodes with one such shingle are a region.  Regions of up to
   ``SMALL`` nodes give pairs; larger ones are searched breadth first.  Pairs
   whose sketches are further apart than linked sets can be are dropped.  A
   region of more than ``CAP`` nodes is cut into chunks; each chunk's connected
   parts become balls (a representative and a radius), and balls join when the
   triangle inequality cannot keep them apart.
3. *Families*, the components of what is left, are joined exactly.  In a family
   documents are the pivots: a pivot takes the sets within the radius, and those
   in the window up to twice the radius are the boundary, compared again unless
   connected by then.  A family of up to ``FAMILY`` shingles is one task's work.
   In a larger one, rounds of pivots go to chunks of the family, and what
   remains unassigned or on a boundary gives the pivots of the next round.

No step holds more than a chunk and its pivots, and none skips a pair that the
bounds allow.  Shingles are told apart by 61-bit hashes.

Documents with an empty set (null or empty text) link with nothing.  Rows
repeated with one id are nodes by their sets like all others; null ids are
members that never name a component unless it has no other id.  Texts of any
length are read whole; a distance of exactly the radius links; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import saved, width
from .words import WordHashes, ascii_words, gram_hashes, only_caches, scramble, sliced

SHINGLE = 4
#: Two documents link when PERCENT or more of 100 parts of the union are shared.
PERCENT = 85
TOP_SHARE = 5e-5
#: Shingles with this share of all, 1 / COMMON_SHARE at most, come last in the global order.
COMMON_SHARE = 5e-6
#: Shingles with this share of all kept ones, hence at most 1 / HOT_SHARE, are regions that never meet in one task whole.
HOT_SHARE = 1e-5
#: Nodes of a region whose pairs are listed; nodes of a region, or balls, that one task compares.
SMALL, CAP = 8, 20_000
#: Shingles of a family, or of the pivots of a round, that one task gets.
FAMILY = 1_000_000
FIRST_PIVOTS = 16
#: Rows that are broadcast at most; a shuffle join is used beyond.
BROADCAST_ROWS = 200_000
#: Bits of a sketch; a set has one for each two of its shingles, about.
LEAST_BITS, MOST_BITS = 64, 8192
#: Entries that a task deals out, or a region task gets, at a time.
BLOCK = 400_000
LOW48 = np.uint64((1 << 48) - 1)


class FlaggedHashes(WordHashes):
    """Word hashes whose lowest bit tells a frequent word; ``common``: the frequent shingles, sorted."""

    most = 250_000

    def __init__(self, frequent: tuple[frozenset[int], np.ndarray]) -> None:
        self.top, self.common = frequent

    def __missing__(self, word: bytes) -> int:
        h = WordHashes().__missing__(word) & ~1
        self[word] = h = h | (h in self.top)
        return h


def lower_words(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lowered (``bytes.lower`` touches no other byte)."""
    return ascii_words(text.lower()) if text else []


def grams_of(h: np.ndarray, size: int) -> np.ndarray:
    """61-bit hashes of the runs of ``size`` words (one of all words if there are fewer), from hashes of words."""
    return gram_hashes(h & ~np.uint64(1), min(size, len(h))) >> np.uint64(3)


def shingles(words: list[bytes], hashes: FlaggedHashes, size: int = SHINGLE) -> np.ndarray:
    """The distinct shingles in global order: 3 bits that say how frequent, 61 bits of hash."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = hashes.of(words)
    k = min(size, len(words))
    grams = grams_of(h, size)
    frequent = (h & np.uint64(1)).astype(np.uint64)
    total = np.cumsum(np.concatenate([[np.uint64(0)], frequent]), dtype=np.uint64)
    rank = np.minimum(total[k:] - total[:-k], np.uint64(6))
    if len(hashes.common):
        at = np.minimum(np.searchsorted(hashes.common, grams), len(hashes.common) - 1)
        rank[hashes.common[at] == grams] = 7
    return np.unique((rank << np.uint64(61)) | grams)


def n_kept(n: int, percent: int) -> int:
    """Shingles of a set of ``n`` of which a set within the radius has one, in any order common to both."""
    return n - (percent * n + 99) // 100 + 1


def sketch_of(tokens: np.ndarray) -> bytes:
    """One bit for each class of shingles: whether the set has an odd number of them."""
    bits = LEAST_BITS
    while bits < min(MOST_BITS, 0.45 * len(tokens)):
        bits *= 2
    odd = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def folded(words: np.ndarray, to: int) -> np.ndarray:
    """Sketches (rows of 64-bit words) with fewer words; what they differ in does not grow."""
    while words.shape[-1] > to:
        half = words.shape[-1] // 2
        words = words[..., :half] ^ words[..., half:]
    return words


def key_of(tokens: np.ndarray) -> tuple[int, int]:
    a, b = np.frombuffer(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest(), "<i8")
    return int(a), int(b)


def packed48(values: np.ndarray) -> bytes:
    """The low 48 bits of each value."""
    return (values & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + ((values & LOW48) >> np.uint64(32)).astype("<u2").tobytes()


def unpacked48(blob: bytes) -> np.ndarray:
    n = len(blob) // 6
    return np.frombuffer(blob, "<u4", n).astype(np.uint64) | (np.frombuffer(blob, "<u2", n, 4 * n).astype(np.uint64) << np.uint64(32))


def tallied(shares: list[float], values: Callable[[pa.RecordBatch], Iterator[tuple]], chunk: int) -> Callable:
    """Batches -> (kind, h, n, total): counts of the values common in a task's chunk, and a row with the number of all; ``values`` gives an array of each kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_caches()
        held: list[list[np.ndarray]] = [[] for _ in shares]
        n = [0] * len(shares)

        def out(kind: int) -> pa.RecordBatch:
            found, counts = np.unique(np.concatenate(held[kind]), return_counts=True)
            common = counts >= max(2, shares[kind] * n[kind] / 4)
            many = int(common.sum())
            columns = [pa.array([kind] * (many + 1), pa.int32()), pa.array(np.concatenate([found[common].view(np.int64), [0]])), pa.array(np.concatenate([counts[common], [n[kind]]]).astype(np.int64)), pa.array([False] * many + [True])]
            held[kind], n[kind] = [], 0
            return pa.RecordBatch.from_arrays(columns, names=["kind", "h", "n", "total"])

        for batch in sliced(batches):
            for arrays in values(batch):
                for kind, some in enumerate(arrays):
                    held[kind].append(some)
                    n[kind] += len(some)
                    if n[kind] >= chunk:
                        yield out(kind)
        for kind in range(len(shares)):
            if n[kind]:
                yield out(kind)

    return run


def heavy(rows: DataFrame, shares: list[float], values: Callable, chunk: int, name: str) -> list[dict[int, int]]:
    """For each kind the values with at least its share of all (so 1 / share at most) and their counts, as tasks saw them."""
    counts = rows.mapInArrow(tallied(shares, values, chunk), "kind int, h long, n long, total boolean").groupBy("kind", "total", "h").agg(F.sum("n").alias("n"))
    counts = saved(rows.sparkSession, counts, name)
    totals = {r["kind"]: r["n"] for r in counts.where("total").collect()}
    found: list[dict[int, int]] = []
    for kind, share in enumerate(shares):
        some = counts.where(~F.col("total") & (F.col("kind") == kind) & (F.col("n") >= F.lit(share * totals.get(kind, 0))))
        found.append({r["h"] & 0xFFFFFFFFFFFFFFFF: r["n"] for r in some.select("h", "n").collect()})
    return found


def frequent(docs: DataFrame, size: int) -> tuple[frozenset[int], np.ndarray]:
    """Hashes (lowest bit clear) of the words with TOP_SHARE of all words at least, and the shingles with COMMON_SHARE of all, sorted."""

    hashes = WordHashes()
    hashes.most = FlaggedHashes.most

    def values(batch: pa.RecordBatch) -> Iterator[tuple]:
        for text in batch.column(0).to_pylist():
            if found := lower_words(text):
                h = hashes.of(found)
                yield h & ~np.uint64(1), grams_of(h, size)

    words, grams = heavy(docs.select("text"), [TOP_SHARE, COMMON_SHARE], values, 1_000_000, "jaccard-frequent")
    return frozenset(words), np.array(sorted(grams), dtype=np.uint64)


def hot_shingles(nodes: DataFrame) -> dict[int, int]:
    def kept(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for blob in batch.column(0).to_pylist():
            yield (unpacked48(blob),)

    return heavy(nodes.select("kept"), [HOT_SHARE], kept, 2_000_000, "jaccard-hot")[0]


def sketched(top, size: int, percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_caches()
        hashes = FlaggedHashes(top.value)
        for batch in sliced(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                tokens = shingles(lower_words(text), hashes, size)
                rows.append((len(tokens), *key_of(tokens), sketch_of(tokens), packed48(tokens[: n_kept(len(tokens), percent)]) if len(tokens) else b""))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n", "k1", "k2", "sketch", "kept"])

    return run


def sets_of(docs: DataFrame, wanted: DataFrame, top, size: int) -> DataFrame:
    """(family, node, tokens): the shingles, computed again, of the documents that ``wanted`` (node, first_id, k1, k2, family) names."""
    few = wanted.count() <= BROADCAST_ROWS
    rows = docs.join(F.broadcast(wanted) if few else wanted, docs["doc_id"].eqNullSafe(wanted["first_id"])).select("text", "k1", "k2", "node", "family")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_caches()
        hashes = FlaggedHashes(top.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                out = []
                for text, k1, k2, node, family in zip(*(c.to_pylist() for c in batch.slice(lo, 512).columns), strict=True):
                    tokens = shingles(lower_words(text), hashes, size)
                    if key_of(tokens) == (k1, k2):  # else another row with that id
                        out.append((family, node, tokens.astype("<u8").tobytes()))
                yield batch_of(out, SETS)

    return rows.mapInArrow(run, SETS)


SETS = "family long, node long, tokens binary"
KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}


def batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [pa.field(c.split()[0], KINDS[c.split()[1]]) for c in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=pa.schema(fields))


def spanning(pairs: np.ndarray) -> np.ndarray:
    """A spanning forest of the graph with these pairs (rows of two nodes)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    keep = []
    for a, b in np.unique(np.sort(pairs, axis=1), axis=0).tolist():
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            keep.append((a, b))
    return np.array(keep, dtype=np.int64).reshape(-1, 2)


def deal(buckets: int, hot) -> Callable:
    """(node, kept) -> entries of the shingles that are not hot, packed, a row per task's block and bucket."""
    schema = "bucket int, tokens binary, nodes binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, nodes, n = [], [], 0

        def out() -> pa.RecordBatch:
            token, node = np.concatenate(tokens), np.repeat(np.array(nodes, np.int64), [len(t) for t in tokens])
            cool = ~np.isin(token, hot.value)
            token, node = token[cool], node[cool]
            bucket = (scramble(token) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((node, bucket))
            groups = [g for g in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(g)]
            # nodes as differences, which compress
            return batch_of([(int(bucket[g[0]]), packed48(token[g]), np.diff(node[g], prepend=0).astype("<i8").tobytes()) for g in groups], schema)

        for batch in batches:
            for node, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tokens.append(unpacked48(blob))
                nodes.append(node)
                n += len(tokens[-1])
                if n >= BLOCK:
                    yield out()
                    tokens, nodes, n = [], [], 0
        if n:
            yield out()

    return run


MET = "region long, a long, b long"


def meet(small: int) -> Callable:
    """A bucket's entries -> pairs (-1, a, b) of its small regions, members (region, node, size) of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, nodes = [], []
        for batch in batches:
            for t, d in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                tokens.append(unpacked48(t))
                nodes.append(np.cumsum(np.frombuffer(d, "<i8")))
        if not tokens:
            return
        token, node = np.concatenate(tokens), np.concatenate(nodes)
        order = np.lexsort((node, token))
        token, node = token[order], node[order]
        starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        size = np.repeat(sizes := np.diff(np.concatenate([starts, [len(token)]])), sizes)
        pairs = [np.empty((0, 2), np.int64)]
        for step in range(1, small):
            i = np.flatnonzero((size[:-step] <= small) & (token[:-step] == token[step:]))
            pairs.append(np.stack([node[i], node[i + step]], axis=1))
        pairs = np.unique(np.sort(np.concatenate(pairs), axis=1), axis=0)
        pairs = pairs[pairs[:, 0] < pairs[:, 1]]
        large = size > small
        region = np.concatenate([np.full(len(pairs), -1), token[large].astype(np.int64)])
        a, b = np.concatenate([pairs[:, 0], node[large]]), np.concatenate([pairs[:, 1], size[large]])
        for lo in range(0, len(region), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + 100_000]) for x in (region, a, b)], names=["region", "a", "b"])

    return run


def hot_members(hot) -> Callable:
    """(node, kept) -> (region, node, size) of the hot shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sizes = hot.value
        for batch in batches:
            out = []
            for node, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                token = unpacked48(blob)
                at = np.minimum(np.searchsorted(known, token), max(0, len(known) - 1))
                out += [(t, node, s) for t, s in zip(token[hit].tolist(), sizes[at[hit]].tolist(), strict=True)] if len(known) and (hit := known[at] == token).any() else []
            yield batch_of(out, MET)

    return run


def close_pairs(percent: int) -> Callable:
    """(a, n_a, s_a, b, n_b, s_b) -> the pairs whose sizes and sketches allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, n, s, b, m, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if 100 * min(n, m) < percent * max(n, m):
                    continue
                s, t = np.frombuffer(s, "<u8"), np.frombuffer(t, "<u8")
                to = min(len(s), len(t))
                gap = int(np.bitwise_count(folded(s, to) ^ folded(t, to)).sum())
                if (100 + percent) * gap <= (100 - percent) * (n + m):
                    out.append((a, b))
            yield batch_of(out, "a long, b long")

    return run


class Balls:
    """Sets, or balls of sets, told by sketches: sizes from ``low`` to ``high``, all within ``radius`` of the sketch."""

    def __init__(self, low: list[int], high: list[int], radius: list[int], sketches: list[bytes], percent: int) -> None:
        order = np.argsort(low, kind="stable")
        self.order, self.percent = order, percent
        self.low, self.high, self.radius = (np.array(x, dtype=np.int64)[order] for x in (low, high, radius))
        self.widest = np.maximum.accumulate(self.high) if len(order) else self.high
        self.sketches = [np.frombuffer(sketches[i], "<u8") for i in order]
        widths = np.array([len(s) for s in self.sketches])
        self.at = {int(w): np.flatnonzero(widths == w) for w in np.unique(widths)}
        self.tables = {(w, w): np.stack([self.sketches[i] for i in at]) for w, at in self.at.items()}

    def gaps(self, x: int, w: int, some: slice, which: np.ndarray) -> np.ndarray:
        """Distances from ``x`` to those of width ``w`` at ``which`` of the slice."""
        to = min(w, len(self.sketches[x]))
        if (w, to) not in self.tables:
            self.tables[w, to] = folded(self.tables[w, w], to)
        return np.bitwise_count(self.tables[w, to][some][which] ^ folded(self.sketches[x], to)).sum(axis=1, dtype=np.int64)

    def parts(self) -> list[list[tuple[int, int]]]:
        """Connected parts of what the bounds allow, as breadth-first steps (from, to) by position; the first is (x, x)."""
        p, left, parts = self.percent, np.ones(len(self.low), dtype=bool), []
        for first in range(len(self.low)):
            if not left[first]:
                continue
            left[first] = False
            steps, queue = [(first, first)], [first]
            while queue:
                x = queue.pop()
                # sorted by low; who could reach down to x's sizes, and up
                begin = int(np.searchsorted(self.widest, -(-p * self.low[x] // 100)))
                end = int(np.searchsorted(self.low, 100 * self.high[x] // p, side="right"))
                for w, at in self.at.items():
                    some = slice(*np.searchsorted(at, (begin, end)).tolist())
                    open_ = np.flatnonzero(left[at[some]])
                    if not len(open_):
                        continue
                    y = at[some][open_]
                    gap = self.gaps(x, w, some, open_)
                    ok = (100 + p) * (gap - self.radius[x] - self.radius[y]) <= (100 - p) * (self.high[x] + self.high[y])
                    ok &= (100 * self.high[x] >= p * self.low[y]) & (100 * self.high[y] >= p * self.low[x])
                    left[y[ok]] = False
                    steps += [(x, j) for j in y[ok].tolist()]
                    queue += y[ok].tolist()
            parts.append(steps)
        return parts

    def ball(self, steps: list[tuple[int, int]]) -> tuple[int, int, int, int, bytes]:
        """(position, low, high, radius, sketch) of one ball around all of a part."""
        members = np.array([s[1] for s in steps])
        to = min(len(self.sketches[i]) for i in members)
        centre = folded(self.sketches[members[0]], to)
        reach = [int(np.bitwise_count(folded(self.sketches[i], to) ^ centre).sum()) + int(self.radius[i]) for i in members]
        return int(members[0]), int(self.low[members].min()), int(self.high[members].max()), max(reach), centre.tobytes()


REGION = "region long, a long, b long, low int, high int, radius int, sketch binary"


def by_group(keys: int, handle: Callable, schema: str) -> Callable:
    """Rows ordered by their first ``keys`` columns -> what ``handle`` makes of each group's (key, rows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, done = None, [], []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:keys] != key:
                    if held:
                        done.extend(handle(key, held))
                    key, held = row[:keys], []
                    if len(done) > 50_000:
                        yield batch_of(done, schema)
                        done = []
                held.append(row[keys:])
        if held:
            done.extend(handle(key, held))
        yield batch_of(done, schema)

    return run


def searched(percent: int) -> Callable:
    """Rows (region, chunk, chunks, node, n, sketch) -> edges (-1, a, b), and the balls of regions of several chunks."""

    def handle(key: tuple, rows: list) -> list[tuple]:
        (region, _, chunks), out = key, []
        node, n, sketches = zip(*rows, strict=True)
        balls = Balls(n, n, [0] * len(n), sketches, percent)
        name = [node[i] for i in balls.order]
        for steps in balls.parts():
            out += [(-1, name[x], name[y], 0, 0, 0, b"") for x, y in steps[1:]]
            if chunks > 1:
                at, *ball = balls.ball(steps)
                out.append((region, name[at], 0, *ball))
        return out

    return by_group(3, handle, REGION)


def joined_balls(percent: int) -> Callable:
    """Rows (region, one block, other block, node, low, high, radius, sketch) -> edges (a, b) between balls."""

    def handle(_: tuple, rows: list) -> list[tuple[int, int]]:
        node, *columns = zip(*rows, strict=True)
        balls = Balls(*columns, percent)
        return [(node[balls.order[x]], node[balls.order[y]]) for steps in balls.parts() for x, y in steps[1:]]

    return by_group(3, handle, "a long, b long")


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) -> a spanning forest of a task's edges, a block at a time."""
    held, n = [], 0

    def out() -> pa.RecordBatch:
        edges = spanning(np.concatenate(held))
        return pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], names=["a", "b"])

    for batch in batches:
        held.append(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1))
        n += batch.num_rows
        if n >= BLOCK:
            yield out()
            held, n = [], 0
    if n:
        yield out()


def candidate_edges(nodes: DataFrame, buckets: int, percent: int) -> DataFrame:
    """(a, b) whose components hold every link: pairs that share a region and that the bounds allow."""
    spark = nodes.sparkSession
    hot = hot_shingles(nodes)
    known = np.array(sorted(hot), dtype=np.uint64)
    hot_list = spark.sparkContext.broadcast(known)  # 1 / HOT_SHARE at most
    hot_sizes = spark.sparkContext.broadcast((known, np.array([hot[t] for t in known.tolist()], dtype=np.int64)))
    kept = nodes.select("node", "kept")
    met = saved(spark, kept.mapInArrow(deal(buckets, hot_list), "bucket int, tokens binary, nodes binary").repartitionById(buckets, "bucket").mapInArrow(meet(SMALL), MET), "jaccard-met")
    sketches = nodes.select("node", "n", "sketch")

    pairs = met.where("region < 0").select("a", "b").distinct()
    one, other = (sketches.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}")) for x in "ab")
    close = pairs.join(one, "a").join(other, "b").select("a", "n_a", "s_a", "b", "n_b", "s_b").mapInArrow(close_pairs(percent), "a long, b long")

    members = met.where("region >= 0").unionByName(kept.mapInArrow(hot_members(hot_sizes), MET))
    chunks = F.ceil(F.col("b") / CAP).cast("int").alias("chunks")
    members = members.select("region", F.col("a").alias("node"), chunks).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    members = members.join(sketches, "node").select("region", "chunk", "chunks", "node", "n", "sketch")
    found = saved(spark, members.repartition(buckets, "region", "chunk").sortWithinPartitions("region", "chunk").mapInArrow(searched(percent), REGION), "jaccard-regions")
    edges = close.unionByName(found.where("region < 0").select("a", "b"))

    balls = found.where("region >= 0")
    if not balls.isEmpty():  # some regions are in several chunks
        blocks = balls.groupBy("region").agg(F.ceil(F.count(F.lit(1)) / CAP).cast("int").alias("blocks"))
        rows = balls.join(blocks, "region").withColumn("block", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int"))
        rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
        rows = rows.select("region", F.least("block", "with").alias("x"), F.greatest("block", "with").alias("y"), "a", "low", "high", "radius", "sketch")
        edges = edges.unionByName(rows.repartition(buckets, "region", "x", "y").sortWithinPartitions("region", "x", "y").mapInArrow(joined_balls(percent), "a long, b long"))
    return edges.mapInArrow(forest, "a long, b long")


class Postings:
    """Sets by their shingles, for exact intersections with many sets at once."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.n = np.array([len(s) for s in sets], dtype=np.int64)
        self.tokens, token = np.unique(np.concatenate(sets), return_inverse=True)
        order = np.argsort(token, kind="stable")
        self.owner = np.repeat(np.arange(len(sets)), self.n)[order]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(token, minlength=len(self.tokens)))])

    def both(self, tokens: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of each set with ``tokens``."""
        at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        at = at[self.tokens[at] == tokens]
        lo, count = self.first[at], self.first[at + 1] - self.first[at]
        places = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        return np.bincount(self.owner[places], minlength=len(self.n))


def family_links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest (pairs of positions) of the links between the given sets, exactly.

    Pivots are taken until every set is within the radius of one.  If two sets
    link and have different pivots, each is within twice the radius of the
    other's pivot; such sets are compared with all, unless already connected.
    """
    postings = Postings(sets)
    n, m = postings.n, len(sets)
    parent = list(range(m))
    links: list[tuple[int, int]] = []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def compare(x: int) -> tuple[np.ndarray, np.ndarray]:
        """Links x with all within the radius; returns the sizes of intersection and union with each."""
        both = postings.both(sets[x])
        union = n + n[x] - both
        for y in np.flatnonzero(100 * both >= percent * union).tolist():
            a, b = root(x), root(y)
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((x, y))
        return both, union

    assigned, compared = np.zeros(m, dtype=bool), np.zeros(m, dtype=bool)
    boundary: list[tuple[int, np.ndarray]] = []
    for x in np.argsort(np.abs(n - np.median(n)), kind="stable").tolist():
        if assigned[x]:
            continue
        both, union = compare(x)
        compared[x] = True
        near = 100 * both >= percent * union
        assigned |= near
        ring = ~near & in_window(both, union, percent)
        if ring.any():
            boundary.append((x, np.flatnonzero(ring)))
    for pivot, ring in boundary:
        for y in ring.tolist():
            if not compared[y] and root(y) != root(pivot):
                compare(y)
                compared[y] = True
    return links


def in_window(both: np.ndarray, union: np.ndarray, percent: int) -> np.ndarray:
    """Within twice the radius."""
    return 100 * both >= (2 * percent - 100) * union


def labelled(nodes: list[int], links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(node, smallest node of its component) of the nodes in a link."""
    forest_of = spanning(np.array([(nodes[i], nodes[j]) for i, j in links], dtype=np.int64).reshape(-1, 2)).tolist()
    parent: dict[int, int] = {x: x for link in forest_of for x in link}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for i, j in forest_of:
        a, b = root(i), root(j)
        parent[max(a, b)] = min(a, b)
    return [(x, root(x)) for x in parent]


def clusters(percent: int) -> Callable:
    """Rows (family, node, tokens) -> (node, label) of the nodes that link with another."""

    def handle(_: tuple, rows: list) -> list[tuple[int, int]]:
        sets = {node: np.frombuffer(tokens, "<u8") for node, tokens in rows}
        nodes = sorted(sets)
        return labelled(nodes, family_links([sets[k] for k in nodes], percent)) if len(nodes) > 1 else []

    return by_group(1, handle, "node long, label long")


def against_pivots(percent: int) -> Callable:
    """Rows ordered by (family, chunk), pivots first -> (pivot, node, near) of sets within the radius or in the window.

    Only the pivots are held; the chunk's sets stream by.
    """
    schema = "pivot long, node long, near boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, names, sets, postings, done = None, [], [], None, []
        for batch in batches:
            for family, chunk, member, node, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (family, chunk) != key:
                    key, names, sets, postings = (family, chunk), [], [], None
                tokens = np.frombuffer(tokens, "<u8")
                if not member:
                    names.append(node)
                    sets.append(tokens)
                    continue
                if not sets:  # no pivot in this family this time
                    continue
                postings = postings or Postings(sets)
                both = postings.both(tokens)
                union = postings.n + len(tokens) - both
                for i in np.flatnonzero(in_window(both, union, percent)).tolist():
                    done.append((names[i], node, bool(100 * both[i] >= percent * union[i])))
                if len(done) > 50_000:
                    yield batch_of(done, schema)
                    done = []
        yield batch_of(done, schema)

    return run


def large_family_labels(sets: DataFrame, weights: DataFrame, buckets: int, percent: int) -> DataFrame:
    """(node, label) in families too large for one task, by rounds of pivots against chunks.

    A round's pivots are drawn from the nodes still to be settled and are compared
    with their whole family.  A node is settled once it was a pivot itself, or is
    within the radius of a pivot and connected with every pivot whose window it
    is in: a link that is left out then joins what is connected already.
    """
    spark = sets.sparkSession
    large = sets.join(weights, "family").withColumn("chunks", F.ceil(2 * F.col("weight") / FAMILY).cast("int"))
    large = saved(spark, large.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")).select("family", "chunk", "node", "tokens"), "jaccard-large-sets")
    chunks = large.select("family", "chunk").distinct()
    every = large.select("family", "node", F.floor(F.length("tokens") / 8).alias("n"))
    todo, done, found, quota = every, None, None, F.lit(float(FIRST_PIVOTS))
    turn = 0
    while True:
        left = todo.groupBy("family").agg(F.count(F.lit(1)).alias("left"), F.avg("n").alias("each"))
        draw = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(1 << 20)) < F.lit(1 << 20) * quota / F.col("left")
        pivots = saved(spark, todo.join(left, "family").where(draw).select("family", "node"), "jaccard-pivots")
        sets_of_pivots = large.join(pivots.select("node"), "node").select("family", "node", "tokens")
        rows = sets_of_pivots.join(chunks, "family").select("family", "chunk", F.lit(0).alias("member"), "node", "tokens")
        rows = rows.unionByName(large.select("family", "chunk", F.lit(1).alias("member"), "node", "tokens"))
        rows = rows.repartition(buckets, "family", "chunk").sortWithinPartitions("family", "chunk", "member")
        met = saved(spark, rows.mapInArrow(against_pivots(percent), "pivot long, node long, near boolean"), "jaccard-round")
        found = met if found is None else found.unionByName(met)
        done = pivots.select("node") if done is None else done.unionByName(pivots.select("node"))
        near = found.where("near")
        labels = saved(spark, components(near.select(F.col("pivot").alias("a"), F.col("node").alias("b"))), "jaccard-large-labels")
        apart = found.where("not near").join(labels.withColumnRenamed("label", "own"), "node")
        apart = apart.join(labels.select(F.col("node").alias("pivot"), F.col("label").alias("its")), "pivot", "left").where("its is null or own <> its").select("node")
        assigned = near.select("node").distinct()
        todo = every.join(assigned, "node", "left_anti").unionByName(every.join(apart.distinct(), "node", "left_semi"))
        todo = saved(spark, todo.join(done, "node", "left_anti").distinct(), "jaccard-todo")
        if todo.isEmpty():
            return labels
        turn += 1
        quota = F.greatest(F.lit(1.0), FAMILY / F.col("each"))


def link_components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest id reachable over links)."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    top = spark.sparkContext.broadcast(frequent(docs, size))  # bounded by the shares
    sketches = saved(spark, docs.mapInArrow(sketched(top, size, percent), "doc_id long, n int, k1 long, k2 long, sketch binary, kept binary"), "jaccard-sketches")
    entries = sketches.agg(F.sum(F.length("kept") / 6)).first()[0] or 0
    buckets = max(width(spark), int(entries // BLOCK) + 1)
    some = F.first(F.struct("n", "sketch", "kept")).alias("s")
    distinct = sketches.where("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("first_id"), some)
    nodes = saved(spark, distinct.select(F.monotonically_increasing_id().alias("node"), "first_id", "k1", "k2", "s.*"), "jaccard-nodes")

    families = components(candidate_edges(nodes, buckets, percent)).withColumnRenamed("label", "family")
    members = saved(spark, families.join(nodes.select("node", "first_id", "k1", "k2", "n"), "node"), "jaccard-members")
    sets = saved(spark, sets_of(docs, members.select("node", "first_id", "k1", "k2", "family"), top, size).dropDuplicates(["node"]), "jaccard-sets")
    weights = saved(spark, members.groupBy("family").agg(F.sum("n").alias("weight")).where(F.col("weight") > FAMILY), "jaccard-large")
    if weights.isEmpty():
        common, large = sets, None
    else:
        common, large = sets.join(weights, "family", "left_anti"), large_family_labels(sets, weights, buckets, percent)
    labels = common.repartition(buckets, "family").sortWithinPartitions("family").mapInArrow(clusters(percent), "node long, label long")
    labels = saved(spark, labels if large is None else labels.unionByName(large), "jaccard-labels")

    named = labels.join(nodes.select("node", "first_id"), "node")
    smallest = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    found = named.join(smallest, "label").select("node", "component_id")
    ids = nodes.select("k1", "k2", "node", "first_id").join(found, "node", "left").select("k1", "k2", F.coalesce("component_id", "first_id").alias("component_id"))
    out = sketches.select("doc_id", "n", "k1", "k2").join(ids, ["k1", "k2"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"))
