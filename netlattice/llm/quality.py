"""Quality classifier by importance resampling of hashed n-gram models.

Generative models over hashed token 1- and 2-grams are counted: *raw* over every
document, *target* and *reject* over the documents labelled good and bad in a
bounded sample of labels (``FIT_LABELS``).  A document's log importance weight is the sum over
its features of ``log p_target - log p_raw``.  Gumbel noise, drawn from a hash of
the id, is added, and the ``k`` documents with the largest perturbed weight are
kept: sampling without replacement in proportion to the weights (temperature 1).
The noise settles what the weights leave open, short texts above all.

``k`` does not come from the weights but from how many documents of the corpus
are good: the mixing proportion of target and reject under which all documents
are likeliest, by expectation-maximisation over the exact histogram of their log
odds (in steps of ``ODDS_STEP``).  It does not depend on how many labels of each
kind there are.  Without bad labels every document is kept.

The k-th largest score is found by narrowing a histogram of all scores; only
bin counts come to the driver.  Documents that tie with the k-th are kept too.

Null or empty texts have no features, hence weight 0, like any text without
evidence; texts of any length are counted whole.  Without a label that is good
there is no target model: all weights are 0 and every document is kept.
Repeated rows get equal scores and share their fate; a null id draws the noise
of the empty string.  Labels repeated for one id count once, the lowest quality
winning; labels with a null id or quality do not count.  An empty table gives no
rows, and other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import saved
from .words import MIX_A, MIX_B, kept_cache, only_caches, sliced

#: Labels used at most, those with the smallest hash of their id; also the bound of the broadcast.
FIT_LABELS = 20_000
#: log2 of the number of feature buckets.
BUCKET_BITS = 14
#: Log odds beyond ODDS_END are as good as certain; within, they are counted in steps.
ODDS_END, ODDS_STEP = 40.0, 0.005
#: Weight of the raw model in the smoothing of the target model, in tokens per bucket.
SMOOTHING = 0.5

#: Tokens whose hashes one Python worker remembers.
CACHE_TOKENS = 250_000
TOKEN = re.compile(r"\w+|[^\w\s]+")
BUCKETS = 1 << BUCKET_BITS
SHIFT = np.uint64(64 - BUCKET_BITS)


class TokenHashes(dict):
    def __missing__(self, token: str) -> int:
        value = self[token] = xxhash.xxh64_intdigest(token)
        return value


_TOKENS = kept_cache(TokenHashes())


def features(text: str | None) -> np.ndarray:
    """Buckets of the tokens and token pairs; a token after itself is a feature of its own (bucket 0)."""
    if not text:
        return np.empty(0, dtype=np.int64)
    if len(_TOKENS) > CACHE_TOKENS:
        _TOKENS.clear()
    tokens = TOKEN.findall(text)
    h = np.fromiter(map(_TOKENS.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
    pairs = ((h[:-1] * MIX_A + h[1:]) * MIX_B) >> SHIFT
    pairs[h[:-1] == h[1:]] = 0
    return np.concatenate([h >> SHIFT, pairs]).astype(np.int64)


def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of this task's documents: all of them, those labelled good, those labelled bad."""
    only_caches(_TOKENS)
    raw, target, reject = (np.zeros(BUCKETS, dtype=np.int64) for _ in range(3))
    for batch in sliced(batches):
        for text, quality in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            found = np.bincount(features(text), minlength=BUCKETS)
            raw += found
            if quality is not None:
                (target if quality == 1 else reject)[:] += found
    at = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at, raw[at], target[at], reject[at])], names=["bucket", "raw", "target", "reject"])


def log_ratios(counts: list) -> np.ndarray:
    """Two rows by bucket: log of target over raw, and of target over reject; zeros where a model is missing."""
    raw, target, reject = np.zeros((3, BUCKETS))
    for bucket, *n in counts:
        raw[bucket], target[bucket], reject[bucket] = n
    out = np.zeros((2, BUCKETS))
    if target.sum():
        p = (raw + 0.001) / (raw + 0.001).sum()
        good, bad = (np.log((n + p * BUCKETS * SMOOTHING) / (n.sum() + BUCKETS * SMOOTHING)) for n in (target, reject))
        out[0] = good - np.log(p)
        if reject.sum():
            out[1] = good - bad
    return out


def weigh(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    only_caches(_TOKENS)
    ratios = model.value
    for batch in sliced(batches):
        sums = np.array([ratios[:, features(t)].sum(axis=1) for t in batch.column(1).to_pylist()]).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums[:, 0]), pa.array(sums[:, 1])], names=["doc_id", "log_weight", "log_odds"])


def good_share(weighed: DataFrame) -> float:
    """The share of documents from the target model in the likeliest mixture of target and reject."""
    odds = F.greatest(F.lit(-ODDS_END), F.least(F.lit(ODDS_END), F.col("log_odds")))
    rows = weighed.groupBy(F.round(odds / ODDS_STEP).cast("int").alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()  # 2 * ODDS_END / ODDS_STEP + 1 at most
    ratio, n = np.exp([r["step"] * ODDS_STEP for r in rows]), np.array([r["n"] for r in rows], dtype=float)
    share = 0.5
    for _ in range(200):
        now = float((n * share * ratio / (share * ratio + 1 - share)).sum() / n.sum())
        if abs(now - share) < 1e-9:
            break
        share = now
    return share


def kth_largest(scores: DataFrame, k: int, bins: int = 2048, exact_below: int = 4096) -> float:
    """The ``k``-th largest ``score`` (``k`` >= 1): zoom into the histogram bin that holds it."""
    lo, hi = scores.agg(F.min("score"), F.max("score")).first()
    above = 0  # scores over the current range
    while True:
        inside = scores.where(F.col("score").between(lo, hi))
        if lo == hi:
            return lo
        step = (hi - lo) / bins
        bin_no = F.least(F.floor((F.col("score") - lo) / step), F.lit(bins - 1)).cast("int")
        rows = sorted(inside.groupBy(bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi")).collect(), reverse=True)
        for row in rows:
            if above + row["n"] >= k:
                break
            above += row["n"]
        lo, hi = row["lo"], row["hi"]
        if row["n"] <= exact_below:
            held = sorted((r[0] for r in scores.where(F.col("score").between(lo, hi)).select("score").collect()), reverse=True)
            return held[k - above - 1]


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, log_weight, score (with the noise), kept."""
    spark = docs.sparkSession
    one_label = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = one_label.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_LABELS)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = rows.join(F.broadcast(saved(spark, sample, "quality-labels")), "doc_id", "left").select("doc_id", "text", "quality")

    counts = known.mapInArrow(count, "bucket long, raw long, target long, reject long").groupBy("bucket").agg(F.sum("raw"), F.sum("target"), F.sum("reject"))
    ratios = log_ratios(counts.collect())  # BUCKETS rows
    model = spark.sparkContext.broadcast(ratios)
    weighed = saved(spark, known.mapInArrow(lambda it: weigh(it, model), "doc_id long, log_weight double, log_odds double"), "quality-weights")

    unit = (F.pmod(F.xxhash64(F.lit("gumbel"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))
    scored = weighed.withColumn("score", F.col("log_weight") - F.log(-F.log(unit)))
    n = weighed.count()
    k = math.ceil(n * good_share(weighed)) if n and ratios[1].any() else n
    kept = F.col("score") >= F.lit(kth_largest(scored, k)) if 0 < k < n else F.lit(k > 0)
    return scored.select("doc_id", "log_weight", "score", kept.alias("kept"))
