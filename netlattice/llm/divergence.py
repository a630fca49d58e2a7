"""Source divergence audit: how far the sources of a language are from each other, and in which terms.

Shares are integers: p = 1 + floor(10^9 (count + 1) / (N + V)) for a group or
language with N occurrences of the language's V kept terms, and a pair of
sources (p against q) costs f = floor((p - q)^2 / q) for every kept term.

Almost every count is zero, so no pair visits the vocabulary.  It starts at V
times the f of two zero counts and is corrected by the inverted index alone.
With z for a source's share of a zero count,

    sum f(p, q) = V f(zp, zq) + sum over p's postings [f(p, zq) - f(zp, zq)]
                              + sum over q's postings [f(zp, q) - f(zp, zq)]
                              + sum over shared terms [f(p, q) - f(p, zq) - f(zp, q) + f(zp, zq)]

The second and third sums need how often each count occurs in a source, not
its terms.  The last one is made where a term's postings meet: sources are
numbered within their language and cut into blocks of ``BLOCK``, a term's
postings go to every pair of blocks, so that no task holds more than two blocks
of one term, and the corrections of a batch are added up before they leave it.

Words are counted per batch before the shuffle; a hot source or a frequent word
is one key of (language, source, term) with a row per task at most.  Terms of a
group are ranked in a window whose limit Spark applies before the shuffle too.

Defined cases: a null text, language or source is the empty string; every row
is a document, also where rows or ids repeat; a text of any length is read
whole; ties in value are ranked by the item's bytes; an empty table gives no
rows; a language without kept terms has pairs of value 0 and no terms; other
columns are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import saved
from .words import sliced

#: A term counts in a language if so many of its documents have it.
LEAST_DOCS = 3
SCALE = 1_000_000_000
#: Terms reported per group.
TOP_TERMS = 200
#: Sources of one language that meet at once.
BLOCK = 256
#: Meetings of postings (both ways) that are worked on at once.
MEETINGS = 4_000_000
#: Distinct (group, term) that a task counts before it hands them on.
FLUSH_TERMS = 300_000
#: Groups whose totals are broadcast at most; more meet their rows by a shuffle.
BROADCAST_GROUPS = 200_000

#: Everything but ASCII letters and bytes of other characters becomes a blank, A-Z become small.
LETTERS = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))

COUNTS = "lang string, source string, term string, n long, docs long"
SHARED = "lang string, a int, b int, to_b long, to_a long"


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) per task; the empty term (which no text has) says that the group occurs."""
    names = [c.split()[0] for c in COUNTS.split(", ")]
    counts: dict[tuple[str, str], Counter] = defaultdict(Counter)
    docs: dict[tuple[str, str], Counter] = defaultdict(Counter)

    def emptied() -> Iterator[pa.RecordBatch]:
        for (lang, source), found in counts.items():
            seen = docs[lang, source]
            k = len(found) + 1
            terms = [b"", *found]
            columns = [pa.repeat(lang, k), pa.repeat(source, k), pa.array(terms, pa.binary()).cast(pa.string()), pa.array([0, *found.values()], pa.int64()), pa.array([seen[t] for t in terms], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=names)
        counts.clear()
        docs.clear()

    for batch in sliced(batches):
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
            words = text.translate(LETTERS).split()
            counts[lang, source].update(words)
            docs[lang, source].update(set(words))
        if sum(map(len, counts.values())) >= FLUSH_TERMS:
            yield from emptied()
    yield from emptied()


def share(n: Column | str, total: str = "total", kept: str = "kept_terms") -> Column:
    """p for n occurrences; in decimals, for counts of any size."""
    wide = lambda c: (F.col(c) if isinstance(c, str) else c).cast("decimal(20,0)")
    whole = F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (wide(n) + 1).cast("decimal(20,0)"), (wide(total) + wide(kept)).cast("decimal(20,0)"))
    return whole + 1


def cost(p: str | Column, q: str | Column) -> Column:
    p, q = (F.col(c) if isinstance(c, str) else c for c in (p, q))
    return F.call_function("div", (p - q) * (p - q), q)


def shared_corrections(batches: Iterator[pa.RecordBatch], block: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Rows of (lang, numbers, shares, shares of zero, across) -> corrections added up by (lang, a, b), a < b.

    A row has a term's postings in two blocks of sources (``across``) or in one;
    in the first case only pairs of one source from each count.
    """
    names = [c.split()[0] for c in SHARED.split(", ")]

    def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) ** 2 // q

    def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        met = np.cumsum(np.diff(batch.column(1).offsets.to_numpy()).astype(np.int64) ** 2)
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(met, (met[lo - 1] if lo else 0) + MEETINGS, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi

    for batch in (part for whole in batches for part in parts(whole)):
        langs = batch.column(0).dictionary_encode()
        lang = langs.indices.to_numpy()
        lists = [batch.column(k) for k in range(1, 4)]
        cuts = lists[0].offsets.to_numpy()
        across = batch.column(4).to_numpy(zero_copy_only=False)
        number, p, z = (x.values.to_numpy()[cuts[0] : cuts[-1]] for x in lists)
        row = np.repeat(np.arange(batch.num_rows), np.diff(cuts))
        keys, to_b, to_a = [], [], []
        for step in range(1, int(np.diff(cuts).max(initial=0))):  # each posting with the one `step` places on
            i = np.flatnonzero(row[:-step] == row[step:])
            if not len(i):
                break
            j = i + step
            swap = number[i] > number[j]
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            keep = ~across[row[i]] | (number[i] // block != number[j] // block)  # of two blocks, only what lies across
            i, j = i[keep], j[keep]
            keys.append(np.stack([lang[row[i]].astype(np.int64), number[i].astype(np.int64), number[j].astype(np.int64)]))
            to_b.append(f(p[i], p[j]) - f(p[i], z[j]) - f(z[i], p[j]) + f(z[i], z[j]))
            to_a.append(f(p[j], p[i]) - f(p[j], z[i]) - f(z[j], p[i]) + f(z[j], z[i]))
        if not keys or not sum(k.shape[1] for k in keys):
            continue
        keys = np.concatenate(keys, axis=1)
        order = np.lexsort(keys[::-1])
        keys = keys[:, order]
        starts = np.flatnonzero(np.concatenate([[True], (np.diff(keys, axis=1) != 0).any(axis=0)]))
        sums = [np.add.reduceat(np.concatenate(x)[order], starts) for x in (to_b, to_a)]
        yield pa.RecordBatch.from_arrays(
            [langs.dictionary.take(pa.array(keys[0, starts])), *(pa.array(keys[k, starts].astype(np.int32)) for k in (1, 2)), *map(pa.array, sums)], names=names
        )


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS, block: int = BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank): ``pair`` rows for every other source of the language, ``term`` rows for the terms a source has most too many of."""
    spark = docs.sparkSession
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    partial = docs.select(text("lang"), text("source"), text("text")).mapInArrow(counted, COUNTS)
    counts = partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    counts = counts.withColumns({"lang_n": F.sum("n").over(of_term), "lang_docs": F.sum("docs").over(of_term)})
    # the inverted index: postings of kept terms, and a row with the empty term for every group
    index = saved(spark, counts.where((F.col("term") == "") | (F.col("lang_docs") >= least_docs)).drop("docs", "lang_docs"), "divergence-index")
    kept = index.where("term <> ''")

    langs = kept.groupBy("lang", "term").agg(F.first("lang_n").alias("n")).groupBy("lang").agg(F.count(F.lit(1)).alias("kept_terms"), F.sum("n").alias("lang_total"))
    groups = index.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    numbered = groups.withColumn("number", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    zero = F.when(F.col("kept_terms") > 0, share(F.lit(0)))
    groups = saved(spark, numbered.join(langs, "lang", "left").na.fill(0, ["kept_terms", "lang_total"]).withColumn("zero", zero), "divergence-groups")
    few = groups.count() <= BROADCAST_GROUPS
    side = F.broadcast(groups) if few else groups

    postings = kept.join(side, ["lang", "source"]).withColumn("p", share("n"))
    # -- terms: what a group has too much of, against its language
    q = share("lang_n", "lang_total")
    terms = postings.withColumn("q", q).where("p > q").select("lang", "source", F.col("term").alias("item"), cost("p", "q").alias("value"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = terms.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_terms)

    # -- pairs: where postings of a term meet, per pair of blocks of sources
    own = (F.col("number") / block).cast("int")
    sources = groups.groupBy("lang").agg((F.max("number") / block).cast("int").alias("last_block"))
    met = postings.select("lang", "term", "number", "p", "zero", own.alias("own")).join(F.broadcast(sources) if few else sources, "lang")
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), "last_block"))).withColumns({"left": F.least("own", "other"), "right": F.greatest("own", "other")})
    met = met.groupBy("lang", "term", "left", "right").agg(F.collect_list(F.struct("number", "p", "zero")).alias("m")).where(F.size("m") > 1)
    met = met.select("lang", "m.number", "m.p", "m.zero", (F.col("left") != F.col("right")).alias("across"))
    shared = met.mapInArrow(lambda it: shared_corrections(it, block), SHARED).groupBy("lang", "a", "b").agg(F.sum("to_b").alias("to_b"), F.sum("to_a").alias("to_a"))
    both = F.array(F.struct(F.col("a").alias("number"), F.col("b").alias("item_number"), F.col("to_b").alias("v")), F.struct(F.col("b").alias("number"), F.col("a").alias("item_number"), F.col("to_a").alias("v")))
    shared = shared.select("lang", F.explode(both).alias("x")).select("lang", "x.*")

    # -- pairs: baseline, and postings against a zero count, by how often each count occurs in a source
    tally = saved(spark, postings.groupBy("lang", "number", "p", "zero").agg(F.count(F.lit(1)).alias("times")), "divergence-tally")
    one = groups.select("lang", "source", "number", "zero", "kept_terms")
    other = groups.select("lang", F.col("source").alias("item"), F.col("number").alias("item_number"), F.col("zero").alias("item_zero"))
    apart = F.col("number") != F.col("item_number")
    pairs = one.join(other, "lang").where(apart)
    base = pairs.select("lang", "number", "item_number", F.coalesce(F.col("kept_terms") * cost("zero", "item_zero"), F.lit(0)).alias("v"))
    against = tally.join(other, "lang").where(apart)
    nothing = cost("zero", "item_zero")
    forth = against.groupBy("lang", "number", "item_number").agg(F.sum(F.col("times") * (cost("p", "item_zero") - nothing)).alias("v"))
    nothing = cost("item_zero", "zero")
    back = against.groupBy(F.col("lang"), F.col("item_number").alias("number"), F.col("number").alias("item_number")).agg(F.sum(F.col("times") * (cost("item_zero", "p") - nothing)).alias("v"))
    values = base.unionByName(forth).unionByName(back).unionByName(shared).groupBy("lang", "number", "item_number").agg(F.sum("v").alias("value"))
    named = values.join(one.select("lang", "number", "source"), ["lang", "number"]).join(other.select("lang", "item_number", "item"), ["lang", "item_number"])
    named = named.select("lang", "source", "item", "value").withColumn("rank", F.row_number().over(best))
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))
    return columns(named, "pair").unionByName(columns(terms, "term"))
