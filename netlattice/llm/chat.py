"""Chat formatting with a loss mask that is aligned to the tokenizer's offsets.

A conversation is rendered as ``<s>`` and, for every turn,
``[INST]role[/INST]text</s>``.  The markers are special tokens of the
tokenizer, so no token reaches over the border of a turn.  A control string
inside a role or text gets a backslash after its first character (one more, if
it has some already), which can be taken back exactly.  The rendered text is
encoded once with offsets, and each trained turn finds its tokens by binary
search among the sorted token spans.

Rows meet by one shuffle on the conversation and are read in sorted order; a
conversation that is longer than ``SEGMENT_CHARS`` leaves several segments, cut
between turns (markers are borders of tokens, so ids are the same), and memory
is that of one segment.

Defined cases: a null role or text is empty; a null id is a conversation of its
own; turns come by number, null first, equal ones by role and text; repeated
rows are repeated turns; a text of any length stays whole; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import AddedToken, Tokenizer

from .scratch import width

BEGIN, OPEN, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
TRAINED = "assistant"
#: A segment ends with the turn that brings it to so many code points.
SEGMENT_CHARS = 1 << 18

#: Control strings, with any number of backslashes after the first character.
CONTROL = re.compile(r"(<)(\\*)(s>|/s>|\|endoftext\|>)|(\[)(\\*)(INST\]|/INST\])")
MARKS = re.compile("|".join(map(re.escape, (BEGIN, OPEN, CLOSE, END))))

FORMATTED = "conv_id long, segment int, n_turns int, text string, ids array<int>, begins array<int>, ends array<int>, loss_mask array<boolean>"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: (m[1] or m[4]) + "\\" + (m[2] or m[5] or "") + (m[3] or m[6]), text)


def unescape(text: str) -> str:
    """The inverse of ``escape``; a control string without a backslash cannot come from it and stays."""
    return CONTROL.sub(lambda m: (m[1] or m[4]) + (m[2] or m[5] or "")[1:] + (m[3] or m[6]), text)


@functools.cache
def tokenizer(path: str) -> Tokenizer:
    found = Tokenizer.from_file(path)
    found.add_special_tokens([AddedToken(x, special=True, normalized=False) for x in (BEGIN, END, OPEN, CLOSE)])
    return found


def render(turns: list[tuple[str, str]], first: bool, trained: str) -> tuple[str, list[tuple[int, int]]]:
    """The turns' text, and where in it the trained turns' texts are (in order)."""
    parts, spans = [BEGIN] if first else [], []
    at = len(BEGIN) if first else 0
    for role, text in turns:
        head, body = OPEN + escape(role) + CLOSE, escape(text)
        if role == trained:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def masked(begins: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens share a character with a span; all three are sorted."""
    mask = np.zeros(len(begins), dtype=bool)
    if spans:
        start, stop = np.array(spans).T
        for lo, hi in zip(np.searchsorted(ends, start, "right"), np.searchsorted(begins, stop, "left"), strict=True):
            mask[lo:hi] = True
    return mask


def segments(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int | None, int, list[tuple[str, str]]]]:
    """(conv_id, number of the segment, its turns) from rows in the order of conversation and turn."""
    of, number, turns, chars, any_row = None, 0, [], 0, False
    for batch in batches:
        for lo in range(0, batch.num_rows, 1024):
            for conv_id, role, text in zip(*(c.to_pylist() for c in batch.slice(lo, 1024).columns), strict=True):
                if any_row and (conv_id != of or chars >= most):
                    yield of, number, turns
                    number, turns, chars = (number + 1 if conv_id == of else 0), [], 0
                of, any_row = conv_id, True
                turns.append((role, text))
                chars += len(role) + len(text)
    if any_row:
        yield of, number, turns


def formatted(batches: Iterator[pa.RecordBatch], path: str, trained: str, most: int) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in FORMATTED.split(", ")]
    encoder = tokenizer(path)

    def batch(rows: list) -> pa.RecordBatch:
        plain = [pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True))[:4], (pa.int64(), pa.int32(), pa.int32(), pa.string()), strict=True)]
        cuts = pa.array(np.cumsum([0, *(len(r[4]) for r in rows)]), pa.int32())
        lists = [pa.ListArray.from_arrays(cuts, pa.array(np.concatenate([r[k] for r in rows]), t)) for k, t in ((4, pa.int32()), (5, pa.int32()), (6, pa.int32()), (7, pa.bool_()))]
        return pa.RecordBatch.from_arrays(plain + lists, names=names)

    rows, chars = [], 0
    for conv_id, number, turns in segments(batches, most):
        text, spans = render(turns, number == 0, trained)
        found = encoder.encode(text, add_special_tokens=False)
        begins, ends = np.array(found.offsets, dtype=np.int32).reshape(-1, 2).T
        rows.append((conv_id, number, len(turns), text, np.array(found.ids, dtype=np.int32), begins, ends, masked(begins, ends, spans)))
        chars += len(text)
        if chars >= most:
            yield batch(rows)
            rows, chars = [], 0
    if rows:
        yield batch(rows)


def format_conversations(conversations: DataFrame, trained: str = TRAINED, tokenizer_path: str = TOKENIZER, segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """One row per conversation (per segment of a long one): text, token ids, their offsets, and the loss mask.

    The segments of a conversation follow each other in one partition.
    """
    spark = conversations.sparkSession
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", text("role").alias("role"), text("text").alias("text"))
    rows = rows.repartition(width(spark), "conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    return rows.select("conv_id", "role", "text").mapInArrow(lambda it: formatted(it, tokenizer_path, trained, segment_chars), FORMATTED)


def turns_of(text: str) -> list[tuple[str, str]]:
    """The (role, text) that ``render`` wrote."""
    fields = MARKS.split(text.removeprefix(BEGIN))
    return [(unescape(role), unescape(said)) for role, said in zip(fields[1::3], fields[2::3], strict=True)]


def loss_texts(text: str, begins: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> Iterator[str]:
    """What runs of masked tokens cover, unescaped."""
    edges = np.flatnonzero(np.diff(mask, prepend=False, append=False))
    for lo, hi in zip(edges[::2], edges[1::2], strict=True):
        yield unescape(text[begins[lo] : ends[hi - 1]])


def read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of conversations, from the rows of ``format_conversations`` in their order alone."""
    names = [c.split()[0] for c in DIGESTS.split(", ")]
    open_row = None

    def closed(row: list) -> pa.RecordBatch:
        values = [row[0], row[1], row[2].hexdigest(), row[3], row[4].hexdigest(), row[5]]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)

    done: list[pa.RecordBatch] = []
    for batch in batches:
        lists = [batch.column(k) for k in range(4, 8)]
        for k in range(batch.num_rows):
            conv_id, segment, n_turns, text = (batch.column(c)[k].as_py() for c in range(4))
            _, begins, ends, mask = (np.asarray(c[k].values.to_numpy(zero_copy_only=False)) for c in lists)
            if segment == 0:
                if open_row:
                    done.append(closed(open_row))
                open_row = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            open_row[1] += n_turns
            open_row[5] += len(text)
            for role, said in turns_of(text):
                open_row[2].update(f"{role}\n{said}\n".encode())
            for said in loss_texts(text, begins, ends, mask):
                open_row[3] += len(said)
                open_row[4].update(said.encode())
        if done:
            yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
            done = []
    if open_row:
        done.append(closed(open_row))
        yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]


def conversation_digests(found: DataFrame) -> DataFrame:
    """One row per conversation, read back from the rows of ``format_conversations``."""
    return found.mapInArrow(read_back, DIGESTS)
