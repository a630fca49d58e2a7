"""Language identification by multilingual mixture inference.

Every language is a multinomial over hashed byte trigrams, counted over all
training documents.  A document is a mixture of languages: expectation-
maximisation estimates the proportions from the trigrams' likelihoods, then the
likelihoods of the nested sets of its strongest languages are compared under a
penalty per language (half the log of the number of trigrams, times
``PENALTY``), and the set with the best penalised likelihood stays.  The
language with the largest proportion in that set is predicted; the proportion
is the score.

Sets are tried from one language on, until not even the likelihood of the best
language for each single trigram could pay for one more.

Null texts and texts without a letter are ``und`` with score 0, and so is
everything if there is nothing to learn from.  Training rows with a null text
or language are skipped; repeated rows count as often as they occur and are each
returned.  Of languages with equal proportions the first by name is predicted;
of equally good sets the smaller.  Texts of any length are read whole, an empty
table gives no rows, and other columns are not read.  More than ``MOST_LABELS``
distinct labels are an error, for the model is a broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import saved

BUCKET_BITS = 14
BUCKETS = 1 << BUCKET_BITS
SMOOTHING = 0.1
ROUNDS = 8
PENALTY = 2.0
#: Labels that a model may tell apart; its table, which is broadcast, has BUCKETS numbers for each.
MOST_LABELS = 1024
#: Count tables of languages a task keeps before it hands them on.
HELD = 256


def trigrams(text: bytes) -> np.ndarray:
    """Buckets of the byte trigrams of the text between two blanks, A-Z lowered."""
    b = np.frombuffer(b" " + text.lower() + b" ", dtype=np.uint8).astype(np.uint32)
    code = b[:-2] | (b[1:-1] << np.uint32(8)) | (b[2:] << np.uint32(16))
    return (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS)


def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, n in held.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at])], names=["lang", "bucket", "n"])

    for batch in batches:
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if lang not in held and len(held) >= HELD:
                yield from out()
                held = {}
            found = np.bincount(trigrams(text), minlength=BUCKETS)
            held[lang] = held[lang] + found if lang in held else found
    yield from out()


class Model:
    def __init__(self, rows: list) -> None:
        self.langs = sorted({r[0] for r in rows})
        counts = np.zeros((len(self.langs), BUCKETS))
        at = {lang: i for i, lang in enumerate(self.langs)}
        for lang, bucket, n in rows:
            counts[at[lang], bucket] = n
        smooth = counts + SMOOTHING
        self.p = smooth / smooth.sum(axis=1, keepdims=True)

    def mixture(self, p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
        """Proportions and log-likelihood after ``ROUNDS`` steps of EM; p: languages x trigrams."""
        share = np.full(len(p), 1 / len(p))
        total = n.sum()
        for _ in range(ROUNDS if len(p) > 1 else 0):
            share = share * (p @ (n / (share @ p))) / total
        return share, float(n @ np.log(share @ p))

    def predict(self, text: bytes) -> tuple[str, float]:
        found = np.bincount(trigrams(text), minlength=BUCKETS)
        at = np.flatnonzero(found)
        n, p = found[at].astype(float), self.p[:, at]
        share, _ = self.mixture(p, n)
        order = np.argsort(-share, kind="stable")
        price = PENALTY * np.log(n.sum() + 1) / 2
        best, chosen = -np.inf, (0, 1.0)
        most = float(n @ np.log(p.max(axis=0)))  # no mixture is likelier
        for size in range(1, len(order) + 1):
            if most - price * size <= best:  # nor is any larger set better
                break
            some, fit = self.mixture(p[order[:size]], n)
            if fit - price * size > best:
                top = int(np.argmax(some))
                best, chosen = fit - price * size, (int(order[top]), float(some[top]))
        return self.langs[chosen[0]], min(1.0, chosen[1])


def predict(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    model = model.value
    for batch in batches:
        langs, scores = [], []
        for text in batch.column(2).to_pylist():
            lang, score = "und", 0.0
            if model.langs and text and any(map(str.isalpha, text)):
                lang, score = model.predict(text.encode("utf-8", "surrogatepass"))
            langs.append(lang)
            scores.append(score)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the documents that are not held out, predict for all: doc_id, held_out, lang_pred, score."""
    spark = docs.sparkSession
    train = docs.where(~held_out(id_col) & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    rows = train.select(F.col(text_col).cast("binary").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counts = rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n"))
    counts = saved(spark, counts, "language-counts")
    if (labels := counts.select("lang").distinct().count()) > MOST_LABELS:
        raise ValueError(f"{labels} languages; a model holds {MOST_LABELS}")
    model = spark.sparkContext.broadcast(Model(counts.collect()))  # MOST_LABELS x BUCKETS at most
    every = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return every.mapInArrow(lambda it: predict(it, model), "doc_id long, held_out boolean, lang_pred string, score double")
