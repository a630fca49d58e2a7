"""Chat formatting, the conversation trie and the source audit against plain versions."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from netlattice.llm import chat, queries
from netlattice.llm.chat import conversation_digests, format_conversations
from netlattice.llm.conversation_trie import nearest_smaller, prefix_trie
from netlattice.llm.divergence import divergence

CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "<|endoftext|>", "<\\s>", "[\\\\/INST]", "<", "[", "\\", "/s>", "INST]", "<</s>>"]
#: Names that operators use inside, as extra columns of the input.
CLASH = "key string, position2 string, n string, number string, ids string, part string, sub string, side string"
EXTRA = ("x",) * 8


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def turn_order(row):
    conv_id, turn, role, text = row
    return (turn is not None, turn or 0, (role or "").encode(), (text or "").encode())


# -- chat formatting


@pytest.fixture(scope="module")
def chats():
    r = random.Random(3)
    out = []
    for c in [*range(30), None, -4]:
        for t in range(r.randint(1, 7)):
            text = "".join(r.choice([*CONTROLS, "häuser ", "word ", "  ", "\n", "😀", "\x00", "\x85", "'s "]) for _ in range(r.randint(0, 25)))
            out.append((c, r.choice([t, t, t, 0, None]), r.choice(["user", "assistant", "assistant", "system", None, "", "<s>[INST]"]), r.choice([text, text, text, None, ""])))
    out += [(7, 99, "assistant", "again"), (7, 99, "assistant", "again"), (8, 50, "assistant", "long </s> text " * 30_000)]
    return out


def chat_expected(rows):
    out, groups = [], defaultdict(list)
    for row in rows:
        groups[row[0]].append(row)
    for c, turns in groups.items():
        turns = [(role or "", text or "") for _, _, role, text in sorted(turns, key=turn_order)]
        loss = "".join(text for role, text in turns if role == "assistant")
        size = 3 + sum(17 + len(chat.escape(role)) + len(chat.escape(text)) for role, text in turns)
        out.append((c, len(turns), sha("".join(f"{role}\n{text}\n" for role, text in turns)), len(loss), sha(loss), size))
    return sorted(out, key=str)


@pytest.mark.parametrize("segment", [1 << 18, 100])
def test_chat_is_read_back(spark, chats, segment):
    r = random.Random(1)
    rows = spark.createDataFrame([(*row, *EXTRA) for row in r.sample(chats, len(chats))], f"conv_id long, turn long, role string, text string, {CLASH}").repartition(3)
    made = format_conversations(rows, segment_chars=segment)
    assert sorted((tuple(x) for x in conversation_digests(made).collect()), key=str) == chat_expected(chats)
    assert conversation_digests(format_conversations(rows.where("conv_id > 1000"))).count() == 0


def test_chat_segments_are_whole(spark, chats):
    """However a conversation is cut, its text and ids are the same, and masked tokens lie in trained turns alone."""
    rows = spark.createDataFrame(chats, "conv_id long, turn long, role string, text string")
    whole, cut = ({(r.conv_id, r.segment): r for r in format_conversations(rows, segment_chars=n).collect()} for n in (1 << 30, 60))
    assert {c: r.segment for (c, _), r in whole.items()} == dict.fromkeys({row[0] for row in chats}, 0) and len(cut) > len(whole)
    for (c, _), r in whole.items():
        parts = [cut[c, k] for k in range(sum(x == c for x, _ in cut))]
        assert "".join(p.text for p in parts) == r.text and [i for p in parts for i in p.ids] == r.ids
        assert [m for p in parts for m in p.loss_mask] == r.loss_mask
        covered = np.zeros(len(r.text), bool)
        for b, e in zip(r.begins, r.ends, strict=True):
            covered[b:e] = True
        assert covered.all()
        marks = {chat.tokenizer(chat.TOKENIZER).token_to_id(m) for m in (chat.BEGIN, chat.OPEN, chat.CLOSE, chat.END)}
        assert not any(m and i in marks for m, i in zip(r.loss_mask, r.ids, strict=True))


def test_escape_is_reversible():
    r = random.Random(5)
    for _ in range(3000):
        text = "".join(r.choice([*CONTROLS, "s", ">", "|", "a"]) for _ in range(r.randint(0, 9)))
        made = chat.escape(text)
        assert chat.unescape(made) == text and not any(c in made for c in CONTROLS[:5])
    assert chat.escape("plain < text [x] \\") == "plain < text [x] \\"


# -- conversation trie


def test_nearest_smaller():
    r = random.Random(2)
    for _ in range(300):
        a = [-1, *(r.randint(0, 3) for _ in range(r.randint(0, 9))), -1]
        left, right, same = nearest_smaller(a)
        for i in range(1, len(a) - 1):
            assert left[i] == max(j for j in range(i) if a[j] < a[i])
            assert right[i] == min(j for j in range(i + 1, len(a)) if a[j] < a[i])
            assert same[i] == min(j for j in range(left[i] + 1, i + 1) if a[j] == a[i])


def trie_expected(sequences):
    members = defaultdict(list)
    for c, s in sequences.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    out = []
    for k, ids in members.items():
        under = [x for x in members if x[: len(k)] == k]
        kids = [x for x in members if len(x) == len(k) + 1 and x[:-1] == k]
        leaves = sum(not any(len(y) == len(x) + 1 and y[:-1] == x for y in under) for x in under)
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in under if x)
        ends = ",".join(str(c) for c in sorted(c for c in ids if len(sequences[c]) == len(k)))
        out.append((min(ids), len(k), min(members[k[:-1]]) if k else None, len(ids), len(kids), leaves, saved, sha(ends)))
    return sorted(out, key=str)


def trie_rows(df):
    return sorted((tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str)


def conversations(seed, n, depth, letters):
    r = random.Random(seed)
    return {c: [(r.choice(["u", "a"]), r.choice(letters)) for _ in range(r.randint(0, depth))] for c in range(-3, n)}


@pytest.mark.parametrize("block", [(1, 1, 1), (2, 1000, 3), (5, 9, 2), (20_000, 1_000_000, 65_536)])
@pytest.mark.parametrize("letters", [["x"], ["x", "é", ""], ["p", "qq", "rrr", "ssss", "t\n"]])
def test_trie(spark, block, letters):
    made = conversations(len(letters), 70, 4, letters)
    made |= {100 + k: [("u", "x"), ("a", "x")] for k in range(40)}  # one hot conversation
    made |= {200 + k: [("u", "x")] * 30 + [("a", "y")] * k for k in range(4)}  # long ones
    rows = [(c, k, role, text) for c, s in made.items() for k, (role, text) in enumerate(s)] + [(c, None, None, None) for c in made]
    df = spark.createDataFrame([(*r, *EXTRA) for r in rows], f"conv_id long, position long, role string, text string, {CLASH}")
    assert trie_rows(prefix_trie(df, block)) == trie_expected(made)


def test_trie_defined_cases(spark):
    schema = "conv_id long, position long, role string, text string"
    assert trie_rows(prefix_trie(spark.createDataFrame([], schema))) == []
    assert trie_rows(prefix_trie(spark.createDataFrame([(4, None, None, None), (2, None, None, None), (None, 1, "u", "x")], schema))) == trie_expected({4: [], 2: []})
    same = [(1, 5, None, None), (2, 0, "", ""), (3, 0, "u", "x"), (3, 0, "u", "x"), (5, 1, "u", "x"), (5, 2, "u", "x"), (6, 0, "u", "z" * 100_000)]
    assert trie_rows(prefix_trie(spark.createDataFrame(same, schema))) == trie_expected({1: [("", "")], 2: [("", "")], 3: [("u", "x")] * 2, 5: [("u", "x")] * 2, 6: [("u", "z" * 100_000)]})


def test_rebuilt_conversations(spark, chats, tmp_path):
    """The registered query, with conversations whose first one is absent and turns that tie."""
    rows = [row for row in chats if row[0] not in (5, 10)] + [(c, t, "user", f"w{t}") for c in range(40, 60) for t in range(c % 7 + 1)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    own = defaultdict(list)
    for row in rows:
        if row[0] is not None:
            own[row[0]].append(row)
    own = {c: [(role or "", text or "") for _, _, role, text in sorted(found, key=turn_order)] for c, found in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        made[c] = own.get(base, [])[:h] + turns[h:]
    assert trie_rows(queries.op12_conversation_trie(spark, str(tmp_path))) == trie_expected(made)


# -- source divergence


def divergence_expected(rows):
    import re

    docs = [(lang or "", source or "", Counter(re.findall(rb"[a-z\x80-\xff]+", (text or "").encode().lower()))) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        here = [d for d in docs if d[0] == lang]
        seen = Counter(t for _, _, words in here for t in words)
        kept = [t for t, n in seen.items() if n >= 3]
        v = len(kept)

        def shares(some, kept=kept, v=v):
            n = {t: sum(d[2][t] for d in some) for t in kept}
            total = sum(n.values())
            return n, {t: 1 + 10**9 * (n[t] + 1) // (total + v) for t in kept}

        _, q = shares(here)
        groups = {s: shares([d for d in here if d[1] == s]) for s in {d[1] for d in here}}
        for s, (n, p) in groups.items():
            pair = [(sum((p[t] - x[t]) ** 2 // x[t] for t in kept), o.encode()) for o, (_, x) in groups.items() if o != s]
            term = [((p[t] - q[t]) ** 2 // q[t], t) for t in kept if n[t] and p[t] > q[t]]
            for part, found in (("pair", pair), ("term", term)):
                found = sorted(found, key=lambda x: (-x[0], x[1]))
                out += [(lang, s, part, i.decode(), value, k + 1) for k, (value, i) in enumerate(found) if part == "pair" or k < 200]
    return sorted(out)


@pytest.fixture(scope="module")
def audited():
    r = random.Random(9)
    words = [a + b for a in "KaLoMiNué" for b in ("ra", "so", "7ti", "vu", "-we", "Ä")] + ["the"] * 40
    out = [(r.choice(["en", "de", None, ""]), r.choice([f"s{k}" for k in range(11)] + ["hot"] * 9 + [None]), " ".join(r.choice(words) for _ in range(r.randint(0, 30)))) for _ in range(300)]
    out += [("xx", "a", "alone here"), ("xx", "b", None), ("yy", "only", "word word"), ("zz", "a", ""), ("zz", "b", "   "), ("en", "s1", "the " * 50_000)]
    out += [("tie", s, text) for s, text in (("a", "q w e"), ("b", "q w e"), ("c", "q w e"), ("c", "q w e"))]
    return out + [("en", "many", " ".join(f"t{a}{b}" for a in "abcdefghijklmnopqrst" for b in "abcdefghijklmnopqrst"))] * 3


@pytest.mark.parametrize("block", [256, 3])
def test_divergence(spark, audited, block):
    df = spark.createDataFrame([(*r, *EXTRA) for r in audited], f"lang string, source string, text string, {CLASH}").repartition(3)
    got = divergence(df, block=block)
    assert sorted(tuple(r) for r in got.select("lang", "source", "part", "item", "value", "rank").collect()) == divergence_expected(audited)
    assert divergence(df.where("lang = 'none'")).count() == 0


def test_divergence_without_kept_terms(spark):
    rows = [("en", "a", "x"), ("en", "b", None), ("en", "b", "y")]
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    assert sorted(tuple(r) for r in divergence(df).collect()) == divergence_expected(rows) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_corrections_are_bounded():
    """What works at once is bounded by meetings, not by rows."""
    from netlattice.llm import divergence as module

    rows = 50
    lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, 20 * rows + 1, 20), pa.int32()), x) for x in (pa.array(np.tile(np.arange(20, dtype=np.int32), rows)), pa.array(np.full(20 * rows, 7)), pa.array(np.full(20 * rows, 3)))]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * rows), *lists, pa.array([False] * rows)], names=["lang", "number", "p", "zero", "across"])
    whole = list(module.shared_corrections([batch]))
    before, module.MEETINGS = module.MEETINGS, 1000
    try:
        parts = list(module.shared_corrections([batch]))
    finally:
        module.MEETINGS = before
    total = lambda found: pa.Table.from_batches(found).group_by(["a", "b"]).aggregate([("to_b", "sum"), ("to_a", "sum")]).sort_by([("a", "ascending"), ("b", "ascending")])
    assert len(whole) == 1 and len(parts) == 25 and total(whole).equals(total(parts))
