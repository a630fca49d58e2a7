"""Concatenate-and-cut packing with global offsets from two prefix-sum passes.

Pass 1 tokenizes every document once and writes its ids to a shared table with
the task's number and the document's start inside that task.  Pass 2 sums the
totals of the tasks (one row each), turns them into global offsets, and cuts
every document at the multiples of the sequence length.  A document that
crosses such a multiple leaves one boundary record (piece) on either side.  No
text or id is shuffled, and a re-run task writes the same rows.

Sequences are full but for the last, so padding is below one sequence.  Null or
empty texts are the end-of-document id alone; a text longer than a sequence goes
on in the next ones.  Documents come in the order of the table's tasks, so there
are no ties to break.  Rows repeated with one id are packed each, as they come;
ids may be null.  An empty table gives no rows, and other columns are not read.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .scratch import saved
from .words import kept_cache, only_caches

SEQUENCE = 4096
#: Tasks whose offsets are broadcast at most; more meet their rows by a shuffle.
BROADCAST_TASKS = 500_000
END_ID = 2
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: How that tokenizer parts white-space-free text (a fixed value of its file).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: White-space-free chunks whose ids one Python worker remembers.
CACHE_CHUNKS = 400_000

TOKENS = "doc_id long, task int, start_in_task long, ids binary, n long"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@functools.cache
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


def byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write bytes with: printable ones stand for themselves."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    return {b: chr(b) if b in plain else chr(256 + b - sum(p < b for p in plain)) for b in range(256)}


LETTERS = byte_letters()
#: Chunks of these characters are in NFC, hold no white space, and are lowered letter by letter.
SIMPLE = regex.compile("[!-~\u00a1-\u024f]+").fullmatch


class PieceIds(dict):
    """Part of a chunk that the tokenizer's own splitting leaves whole, in lower case -> its ids as bytes."""

    def __init__(self, model, kind: np.dtype) -> None:
        self.model, self.kind = model, kind

    def __missing__(self, piece: str) -> bytes:
        tokens = self.model.tokenize(piece.encode().decode("latin-1").translate(LETTERS))
        self[piece] = ids = np.array([t.id for t in tokens], self.kind).tobytes()
        return ids


class ChunkIds(dict):
    """chunk -> its ids as little-endian unsigned 16- or 32-bit bytes.

    The tokenizer drops white space and never joins across it, so a text's ids
    are those of its chunks between blanks and line ends, one after another.
    Where the tokenizer lower-cases and splits by ``SPLIT``, a new chunk of simple
    characters is split here and only its unknown parts are encoded.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = tokenizer(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.pieces = PieceIds(self.tokenizer.model, self.kind)
        rules = json.loads(self.tokenizer.to_str())
        split = [x["pattern"].get("Regex") for x in (rules["pre_tokenizer"] or {}).get("pretokenizers", []) if x["type"] == "Split"]
        lowers = [x["type"] for x in (rules["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        self.split = regex.compile(SPLIT).findall if lowers and split == [SPLIT] else None

    def __missing__(self, chunk: str) -> bytes:
        if not self.split or "<|" in chunk or not SIMPLE(chunk):
            ids = np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, self.kind).tobytes()
        else:
            low = chunk.lower()
            if low.isalpha():
                ids = self.pieces[low]
            elif low[:-1].isalpha() and low[-1] in ".,":
                ids = self.pieces[low[:-1]] + self.pieces[low[-1]]
            else:
                ids = b"".join(map(self.pieces.__getitem__, self.split(low)))
        self[chunk] = ids
        return ids

    def of(self, text: str) -> bytes:
        for cache in (self, self.pieces):
            if len(cache) > CACHE_CHUNKS:
                cache.clear()
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


@functools.cache
def chunk_ids(path: str) -> ChunkIds:
    cache = ChunkIds(path)
    kept_cache(cache.pieces)
    return kept_cache(cache)


def tokenized(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    cache, task, at = chunk_ids(path), TaskContext.get().partitionId(), 0
    only_caches(cache, cache.pieces)
    end = np.array([end_id], cache.kind).tobytes()
    for batch in batches:
        for lo in range(0, batch.num_rows, 1024):
            part = batch.slice(lo, 1024)
            ids = [(cache.of(t) if t else b"") + end for t in part.column(1).to_pylist()]
            n = np.array([len(x) // cache.kind.itemsize for x in ids], dtype=np.int64)
            starts = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [part.column(0).cast(pa.int64()), pa.array([task] * len(ids), pa.int32()), pa.array(starts), pa.array(ids, pa.binary()), pa.array(n)],
                names=["doc_id", "task", "start_in_task", "ids", "n"],
            )


def cut(batches: Iterator[pa.RecordBatch], kind: str, sequence: int) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in PIECES.split(", ")]
    for batch in batches:
        rows = []
        for doc_id, at, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            ids = np.frombuffer(ids, kind).astype("<u4")
            begin = 0
            while begin < len(ids):
                place = at + begin
                end = min(len(ids), begin + sequence - place % sequence)
                rows.append((doc_id, begin, end - begin, zlib.crc32(ids[begin:end].tobytes()), len(ids), place // sequence, place % sequence))
                begin = end
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 7)], names=names)


def pack(docs: DataFrame, sequence: int = SEQUENCE, tokenizer_path: str = TOKENIZER, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece; with ``with_ids`` the table of token ids and global starts instead."""
    spark = docs.sparkSession
    kind = "<u2" if tokenizer(tokenizer_path).get_vocab_size() <= 1 << 16 else "<u4"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    tokens = saved(spark, rows.mapInArrow(lambda it: tokenized(it, tokenizer_path, end_id), TOKENS), "packing-ids")
    # one row per task of the first pass
    totals = tokens.groupBy("task").agg(F.sum("n").alias("total"))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = saved(spark, totals.select("task", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base")), "packing-base")
    few = base.count() <= BROADCAST_TASKS
    placed = tokens.join(F.broadcast(base) if few else base, "task").select("doc_id", (F.col("base") + F.col("start_in_task")).alias("at"), "ids")
    if with_ids:
        return placed
    return placed.mapInArrow(lambda it: cut(it, kind, sequence), PIECES)
