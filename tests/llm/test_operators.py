"""Operators against brute force on small tables with the awkward cases in them."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from netlattice.llm import exact_dedup as dedup
from netlattice.llm.decontaminate import decontaminate
from netlattice.llm.exact_dedup import exact_dedup
from netlattice.llm.fm_index import SPAN, FmIndex
from netlattice.llm.html_wrapper import Reading, main_text, merge, parsed, shaped
from netlattice.llm.jaccard import family_links, link_components
from netlattice.llm.language import identify
from netlattice.llm.line_dedup import line_dedup
from netlattice.llm.packing import END_ID, SEQUENCE, TOKENIZER, ChunkIds, pack, tokenizer
from netlattice.llm.quality import quality
from netlattice.llm.substring import substring_dedup
from netlattice.llm.url_filter import url_filter
from tests_llm_helpers import SPACE, bench_words, jaccard_expected, split

#: Names that operators use inside, as extra columns of the input.
CLASH = "key string, row string, n string, entry string, entries string, shard string, node string, label string, text2 string"
WORDS = [a + b for a in ("ka", "lo", "mi", "nu", "Te", "é") for b in ("ra", "so", "ti", "vu", "we")]


def texts(seed=1):
    r = random.Random(seed)
    prose = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    passage, line = prose(40), "  Shared LINE of Boilerplate\t"
    base = prose(120)
    out = ["", None, " ", " \n\t ", "one", "one two three", passage, line.strip()]
    out += [f"{line}\n{prose(r.randint(1, 60))}\n{line.strip().lower()}\n" for _ in range(12)]
    out += [prose(r.randint(5, 40)) + " " + passage + " " + prose(10) for _ in range(6)]
    for _ in range(14):  # near copies
        words = base.split()
        for _ in range(r.randint(0, 6)):
            words[r.randrange(len(words))] = r.choice(WORDS)
        out.append(" ".join(words))
    out += [base, base.replace(" ", "\n"), base.replace(" ", "  "), base.upper(), base + " ", prose(20_000), "the " * 300, "\x0b\x0c", "a\x85b\xa0c", "<|endoftext|> x 😀 Σίσυφος ΣΑΣ"]
    return out


@pytest.fixture(scope="module")
def rows():
    made = [(i * 7 % 101, t) for i, t in enumerate(texts())]
    return made


@pytest.fixture(scope="module")
def docs(spark, rows):
    extra = ("x",) * 9
    return spark.createDataFrame([(*r, *extra) for r in rows], f"doc_id long, text string, {CLASH}").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("doc_id < -1")


def collected(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_exact_dedup(docs, rows, empty):
    groups = defaultdict(list)
    for i, t in rows:
        groups[SPACE.sub(" ", t or "")].append(i)
    expected = sorted((i, min(ids), len(ids), i == min(ids), sha(norm)) for norm, ids in groups.items() for i in ids)
    assert collected(exact_dedup(docs), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == expected
    assert exact_dedup(empty).count() == 0


def test_exact_dedup_of_repeated_rows_keeps_one(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a  b"), (None, "c"), (None, "c")], "doc_id long, text string")
    found = exact_dedup(docs).collect()
    assert sum(r["kept"] for r in found) == 2 and {r["group_size"] for r in found} == {3, 2}
    assert [r["doc_id"] for r in found if r["kept"] and r["group_size"] == 3] == [1]


def test_exact_dedup_compares_bytes(monkeypatch):
    """With a hash that always collides, chains still tell texts apart."""

    class Same:
        def __init__(self, _):
            pass

        def digest(self):
            return b"\0" * 32

    import pyarrow as pa

    monkeypatch.setattr(dedup.hashlib, "sha256", Same)
    monkeypatch.setattr(dedup, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": staticmethod(lambda: 0)}))}))
    batch = pa.RecordBatch.from_arrays([pa.array([3, 1, 2, 4]), pa.array([b"x", b"y", b"x", b"y"])], names=["doc_id", "text"])
    entries = list(dedup.fold(iter([batch])))[0].to_pylist()
    assert sorted((e["text"], e["first_id"], e["n"]) for e in entries) == [(b"x", 2, 2), (b"y", 1, 2)]


def test_directory_doubles_where_full(spark):
    key = lambda bits: int(bits.ljust(64, "0"), 2) - (1 << 63)  # noqa: E731  # in the order of unsigned numbers
    made = [("000", 10), ("001", 10), ("0011", 1), ("01", 1), ("1", 1), ("11", 9)]
    entries = spark.createDataFrame([(key(b), n) for b, n in made], "key long, size long")
    assert dedup.doubled(entries.where("size < 0"), 12) == 0
    depth = dedup.doubled(entries, 12)
    assert depth == 3  # 000 and 001 part at the third bit
    found = sorted(tuple(r) for r in dedup.directory(entries, depth, 12).collect())
    assert found == [(0, 0), (1, 1), (2, 2), (4, 3), (6, 3)]
    same = spark.createDataFrame([(5, 100), (5, 100)], "key long, size long")  # one key: no bit divides it
    assert dedup.doubled(same, 12) == 0


@pytest.mark.parametrize("capacity", [300, 1 << 24])
def test_exact_dedup_in_many_buckets(docs, rows, monkeypatch, capacity):
    monkeypatch.setattr(dedup, "BUCKET_BYTES", capacity)
    monkeypatch.setattr(dedup, "MAX_TASKS", 7)
    test_exact_dedup(docs, rows, docs.where("doc_id < -1"))


@pytest.mark.parametrize("share", [1e-3, 1.0])
def test_line_dedup(docs, rows, empty, monkeypatch, share):
    from netlattice.llm import line_dedup as module

    monkeypatch.setattr(module, "HOT_SHARE", share)  # a line in a tenth of the postings is dealt over many salts, or none is
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    seen = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            seen[key(line)].add(i)
    bad = {k for k, ids in seen.items() if k and len(ids) >= 10}
    assert bad
    expected = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in bad]
        expected.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    assert collected(line_dedup(docs), "doc_id", "n_lines", "n_dropped", "kept") == sorted(expected)
    assert line_dedup(empty).count() == 0


def test_line_dedup_keeps_first(spark):
    docs = spark.createDataFrame([(i, "x\nsame\nSAME") for i in range(4)], "doc_id long, text string")
    found = {r["doc_id"]: r["kept"] for r in line_dedup(docs, min_docs=3, keep_first=True).collect()}
    assert found == {0: "x\nsame", 1: "", 2: "", 3: ""}


def test_packing_is_a_round_trip(docs, rows, empty):
    found = pack(docs).collect()
    whole = tokenizer(TOKENIZER)
    pieces, filled = defaultdict(list), defaultdict(int)
    for r in found:
        pieces[r["doc_id"]].append(r)
        filled[r["sequence_id"]] += r["length"]
    for i, t in rows:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, END_ID]
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    full = [filled[k] for k in sorted(filled)]
    assert full[:-1] == [SEQUENCE] * (len(full) - 1) and 0 < full[-1] <= SEQUENCE
    by_sequence = defaultdict(list)
    for r in found:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in by_sequence.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))
    assert pack(empty).count() == 0


def test_chunk_ids_equal_the_tokenizer():
    r, ids, whole = random.Random(3), ChunkIds(TOKENIZER), tokenizer(TOKENIZER)
    letters = "abcXYZ'st.,!?12½²éÉßÖñİŞŒΣςσ́你好 \n\t\x85\xa0\x1c😀ǅ|<>"
    for _ in range(3000):
        text = "".join(r.choice(letters) for _ in range(r.randint(0, 25)))
        assert np.frombuffer(ids.of(text), ids.kind).tolist() == whole.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("entries", [2, 8, 600_000])
def test_substring_dedup(docs, rows, empty, monkeypatch, entries):
    from netlattice.llm import substring as module

    monkeypatch.setattr(module, "SHARD_ENTRIES", entries)  # from all that is shared hot to nothing
    tables = docs.sparkSession.catalog.listTables()
    first = {}
    for i, t in rows:
        w = split(t)
        for p in range(len(w) - SPAN + 1):
            g = tuple(w[p : p + SPAN])
            first[g] = min(i, first.get(g, i))
    expected = []
    for i, t in rows:
        w = split(t)
        gone = set()
        for p in range(len(w) - SPAN + 1):
            if first[tuple(w[p : p + SPAN])] < i:
                gone.update(range(p, p + SPAN))
        expected.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    assert collected(substring_dedup(docs), "doc_id", "n_words", "n_removed", "kept") == sorted(expected)
    assert substring_dedup(empty).count() == 0
    assert docs.sparkSession.catalog.listTables() == tables


def test_substring_dedup_of_repeated_ids(spark):
    same = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(5, same), (5, same), (5, "x y " + same), (None, same), (2, "other")], "doc_id long, text string")
    found = sorted((str(r["doc_id"]), r["n_removed"]) for r in substring_dedup(docs).collect())
    assert found == [("2", 0), ("5", 0), ("5", 0), ("5", 0), ("None", 20)]


def test_substring_dedup_of_null_texts_under_one_id(spark):
    same = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(5, same), (None, same), (None, None), (7, same), (7, None)], "doc_id long, text string")
    found = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"]) for r in substring_dedup(docs).collect())
    assert found == [("5", 20, 0), ("7", 0, 0), ("7", 20, 20), ("None", 0, 0), ("None", 20, 20)]


def test_fm_index_against_scanning():
    r = random.Random(1)
    for _ in range(40):
        some = [np.array([r.randint(1, 2) for _ in range(r.randint(SPAN, 40))]) for _ in range(6)]
        index = FmIndex(some, 4)
        value = np.array([r.randint(0, 100) for _ in some])
        asked = [np.array([r.randint(1, 2 + (k % 2)) for _ in range(60)]) for k in range(4)] + [np.concatenate(some[:3])] + some
        for s, (lo, hi) in zip(asked, index.stream(asked), strict=True):
            least = index.least(lo, hi, value)
            for i in range(len(s) - SPAN + 1):
                w = tuple(s[i : i + SPAN])
                hit = [value[k] for k, b in enumerate(some) for j in range(len(b) - SPAN + 1) if tuple(b[j : j + SPAN]) == w]
                assert hi[i] - lo[i] == len(hit)
                assert not hit or least[i] == min(hit)
        lo, hi = index.interval(some[0][:5])
        assert hi - lo == sum(tuple(b[j : j + 5]) == tuple(some[0][:5]) for b in some for j in range(len(b) - 4))


@pytest.mark.parametrize("block", [1 << 24, 400])
def test_decontamination(spark, docs, rows, empty, monkeypatch, block):
    from netlattice.llm import decontaminate as module

    monkeypatch.setattr(module, "BLOCK_BYTES", block)  # the small one: many passes, united
    by_id = dict(rows)
    items = [(1, by_id[rows[6][0]]), (2, "one two three"), (10, "Karasoti"), (3, None), (4, ""), (5, " ".join(WORDS)), (6, rows[30][1][:200]), (7, rows[6][1] + " tail"), (7, rows[6][1])]
    benchmark = spark.createDataFrame([(*x, "z") for x in items], "item_id long, text string, doc_id string")
    windows = defaultdict(set)
    for i, t in items:
        w = bench_words(t)
        n = min(SPAN, len(w))
        for p in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[p : p + n])].add(str(i))
    expected = []
    for i, t in rows:
        w, hit, names = bench_words(t), set(), set()
        for n in range(1, SPAN + 1):
            for p in range(len(w) - n + 1):
                if found := windows.get(tuple(w[p : p + n])):
                    hit.update(range(p, p + n))
                    names |= found
        expected.append((i, len(w), len(hit), len(names), sha(",".join(sorted(names))), bool(hit) and 20 * len(hit) >= len(w)))
    found = collected(decontaminate(docs, benchmark), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert found == sorted(expected)
    assert decontaminate(empty, benchmark).count() == 0
    assert not any(r["contaminated"] for r in decontaminate(docs, benchmark.where("item_id < 0")).collect())


#: As in production; regions in chunks whose balls meet, and families in rounds; hot shingles told apart from others.
JACCARD_SIZES = [{}, {"SMALL": 2, "CAP": 2, "FAMILY": 150, "FIRST_PIVOTS": 2, "HOT_SHARE": 1.0}, {"SMALL": 2, "CAP": 3, "FAMILY": 400, "HOT_SHARE": 0.002}, {"HOT_SHARE": 1.0}]


@pytest.mark.parametrize("sizes", JACCARD_SIZES)
def test_jaccard_join(docs, rows, empty, monkeypatch, sizes):
    from netlattice.llm import jaccard as module

    for name, value in sizes.items():
        monkeypatch.setattr(module, name, value)
    assert collected(link_components(docs), "doc_id", "n_shingles", "component_id") == jaccard_expected(rows)
    assert link_components(empty).count() == 0


def random_sets(r, n=60):
    base = [r.sample(range(1000), r.choice((3, 20, 60))) for _ in range(4)]
    out = []
    for _ in range(n):
        s = set(r.choice(base))
        for _ in range(r.randint(0, max(1, len(s) // 5))):
            s.discard(r.choice(sorted(s)))
            s.add(r.randrange(1000))
        out.append(np.array(sorted(s), dtype=np.uint64))
    return out


def components_of(n, links):
    label = list(range(n))
    for a, b in links:
        x, y = label[a], label[b]
        label = [min(x, y) if z in (x, y) else z for z in label]
    return label


def test_family_links_are_exact():
    r = random.Random(5)
    for _ in range(40):
        sets = random_sets(r)
        true = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(both := np.intersect1d(sets[a], sets[b])) >= 85 * (len(sets[a]) + len(sets[b]) - len(both))]
        assert components_of(len(sets), family_links(sets, 85)) == components_of(len(sets), true)


@pytest.mark.parametrize("chunk", [100, 7])
def test_bounds_lose_no_link(chunk):
    """Searching whole regions, or chunks of them whose balls then meet, leaves linked sets in one part."""
    from netlattice.llm.jaccard import Balls, sketch_of

    r = random.Random(6)
    for _ in range(20):
        sets = random_sets(r)
        sketches, sizes = [sketch_of(s) for s in sets], [len(s) for s in sets]
        edges, balls = [], []
        for lo in range(0, len(sets), chunk):
            some = slice(lo, lo + chunk)
            found = Balls(sizes[some], sizes[some], [0] * len(sizes[some]), sketches[some], 85)
            for steps in found.parts():
                edges += [(lo + int(found.order[x]), lo + int(found.order[y])) for x, y in steps]
                at, *ball = found.ball(steps)
                balls.append((lo + int(found.order[at]), *ball))
        names, *columns = zip(*balls)
        merged = Balls(*columns, 85)
        edges += [(names[merged.order[x]], names[merged.order[y]]) for steps in merged.parts() for x, y in steps]
        label = components_of(len(sets), edges)
        true = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(both := np.intersect1d(sets[a], sets[b])) >= 85 * (len(sets[a]) + len(sets[b]) - len(both))]
        assert all(label[a] == label[b] for a, b in true)
        assert len(set(label)) > 1


def test_language(spark, empty):
    r = random.Random(2)
    vocabulary = {"aa": ["the", "of", "and", "ing", "tion"], "bb": ["der", "und", "sch", "ung", "ein"], "cc": ["que", "les", "eau", "eux", "oi"]}
    made = []
    for i in range(240):
        lang = r.choice(sorted(vocabulary))
        words = [r.choice(vocabulary[lang]) for _ in range(r.randint(8, 60))]
        words += [r.choice(vocabulary["bb"]) for _ in range(len(words) // 4)]
        made.append((i, " ".join(words), lang, "q"))
    made += [(1000, None, "aa", "q"), (1001, "12 !? 3", "bb", "q"), (1002, "", None, "q"), (None, "the of and", "aa", "q")]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string, lang_pred string")
    found = {r["doc_id"]: r for r in identify(docs).collect()}
    assert len(found) == len(made)
    for i, _, _, _ in made[:240]:
        assert found[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
    held = [i for i, *_ in made[:240] if found[i]["held_out"]]
    assert np.mean([found[i]["lang_pred"] == made[i][2] for i in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in found.values())
    assert [found[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3
    assert identify(docs.where("false")).count() == 0
    assert {r["lang_pred"] for r in identify(docs.withColumn("lang", docs["lang"].substr(1, 0)).where("doc_id < 9")).collect()} <= {"", "und"}


@pytest.mark.parametrize("block", [16 << 20, 60])
def test_decontamination_by_items_without_id(spark, monkeypatch, block):
    from netlattice.llm import decontaminate as module

    monkeypatch.setattr(module, "BLOCK_BYTES", block)
    long = " ".join(f"w{i}" for i in range(15))
    docs = spark.createDataFrame([(1, f"a {long} b short item"), (2, "x short item y"), (3, "none of it"), (4, "named one"), (5, "named short item")], "doc_id long, text string")
    benchmark = spark.createDataFrame([(None, long), (None, "short item"), ("n", "named"), (None, None)], "item_id string, text string")
    found = collected(decontaminate(docs, benchmark), "doc_id", "n_hit", "n_items", "items_sha256", "contaminated")
    assert found == [(1, 17, 1, sha(""), True), (2, 2, 1, sha(""), True), (3, 0, 0, sha(""), False), (4, 1, 1, sha("n"), True), (5, 3, 2, sha("n"), True)]


def test_quality(spark, empty):
    r = random.Random(4)
    good = lambda: " ".join(r.choice(WORDS) for _ in range(r.randint(5, 60)))
    bad = lambda: " ".join(r.choice(WORDS) + r.choice(("###", "&&&", "%%%")) for _ in range(r.randint(5, 60)))
    made = [(i, good() if i % 6 else bad(), "e") for i in range(600)] + [(900, None, "e"), (901, "", "e"), (None, good(), "e")]
    docs = spark.createDataFrame(made, "doc_id long, text string, quality string")
    labels = spark.createDataFrame([(i, int(i % 6 > 0), 0) for i in range(0, 600, 2)] + [(0, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    found = {r["doc_id"]: r["kept"] for r in quality(docs, labels).collect()}
    assert len(found) == 603
    held = [i for i in range(1, 600, 2)]
    assert np.mean([found[i] for i in held if i % 6]) > 0.97
    assert np.mean([not found[i] for i in range(0, 600, 6)]) > 0.9
    assert found[900] and found[901]
    assert all(r["kept"] for r in quality(docs, labels.where("false")).collect())
    assert quality(docs.where("false"), labels).count() == 0


def test_quality_against_brute_force(spark, monkeypatch):
    """Weights, noise and the draw once more, plainly; labels beyond the fitting sample count for the share."""
    from netlattice.llm import quality as module

    monkeypatch.setattr(module, "FIT_LABELS", 100)
    r = random.Random(5)
    text = lambda i: " ".join(r.choice(WORDS) + ("###" if i % 5 == 0 else "") for _ in range(r.choice((1, 2, 5, 40))))
    made = [(i, text(i), "x") for i in range(400)] + [(400, None, "x"), (401, "", "x"), (402, "ka ra " * 30_000, "x"), (7, "ka ra", "x"), (None, "lo so", "x")]
    docs = spark.createDataFrame(made, "doc_id long, text string, score string")
    labels = [(i, int(i % 5 > 0)) for i in range(0, 400, 2)] + [(0, 0), (2, 1), (2, 0), (None, 1), (4, None)]
    found = module.quality(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    lowest = {}
    for i, q in labels:
        if i is not None and q is not None:
            lowest[i] = min(q, lowest.get(i, 1))
    order = spark.createDataFrame([(i,) for i in lowest], "doc_id long").selectExpr("doc_id", "xxhash64(doc_id) as h").orderBy("h", "doc_id").limit(100)
    fitted = {x["doc_id"] for x in order.collect()}
    raw, target, reject = np.zeros((3, module.BUCKETS))
    for i, t, _ in made:
        n = np.bincount(module.features(t), minlength=module.BUCKETS)
        raw += n
        if i in fitted:
            (target if lowest[i] else reject)[:] += n
    p = (raw + 0.001) / (raw + 0.001).sum()
    q, bad = ((x + p * module.BUCKETS * module.SMOOTHING) / (x.sum() + module.BUCKETS * module.SMOOTHING) for x in (target, reject))
    noise = {x["i"]: x["u"] for x in spark.createDataFrame([(i,) for i, _, _ in made], "i long").selectExpr("i", "(pmod(xxhash64('gumbel', coalesce(cast(i as string), '')), 4503599627370496) + 0.5) / 4503599627370496D as u").collect()}
    expected, odds = [], []
    for i, t, _ in made:
        odds.append(np.clip(np.log(q / bad)[module.features(t)].sum(), -40, 40))
        w = float(np.log(q / p)[module.features(t)].sum())
        expected.append((str(i), round(w, 6), round(w - np.log(-np.log(noise[i])), 6)))
    assert sorted((str(x["doc_id"]), round(x["log_weight"], 6), round(x["score"], 6)) for x in found) == sorted(expected)
    share = 0.5
    for _ in range(500):
        share = float(np.mean([share * np.exp(x) / (share * np.exp(x) + 1 - share) for x in odds]))
    k = sum(x["kept"] for x in found)
    assert abs(k - share * len(made)) < 2
    least = sorted((x["score"] for x in found), reverse=True)[k - 1]
    assert all(x["kept"] == (x["score"] >= least) for x in found) and 250 < k < 400
    by_weight = sorted((x["log_weight"] for x in found), reverse=True)[k - 1]
    assert any(x["kept"] != (x["log_weight"] >= by_weight) for x in found)  # the noise decides some


def test_quality_of_documents_it_was_not_fitted_on(spark):
    """Bad documents go whether or not their label was seen: half of the labels are held out."""
    r = random.Random(12)
    good = lambda: " ".join(r.choice(WORDS) for _ in range(r.randint(20, 60)))
    bad = lambda: " ".join(r.choice(WORDS) + r.choice(("###", "!!!", "$$$")) for _ in range(r.randint(20, 60)))
    made = [(i, bad() if i % 10 == 0 else good()) for i in range(1500)]
    seen = [(i, int(i % 10 > 0)) for i in range(1500) if zlib.crc32(str(i).encode()) % 2]
    kept = {x["doc_id"] for x in quality(spark.createDataFrame(made, "doc_id long, text string"), spark.createDataFrame(seen, "doc_id long, quality int")).where("kept").collect()}
    unseen = {i for i, _ in made} - {i for i, _ in seen}
    assert np.mean([i in kept for i in unseen if i % 10]) > 0.97
    assert np.mean([i in kept for i in unseen if i % 10 == 0]) < 0.1


def test_exact_bounds(spark):
    """Ten documents are enough for a line, 85 parts of 100 for a link, a twentieth of the words for contamination."""
    lines = [(i, "shared\nown" + str(i)) for i in range(10)] + [(10 + i, "nine\nown x" + str(i)) for i in range(9)]
    found = {x["doc_id"]: x["n_dropped"] for x in line_dedup(spark.createDataFrame(lines, "doc_id long, text string")).collect()}
    assert all(found[i] == 1 for i in range(10)) and all(found[i] == 0 for i in range(10, 19))
    words = [f"w{k}" for k in range(200)]
    # 85 of 100 shingles in common, and 84 of 100: the first set has them all
    sets = [(1, words[:103]), (2, words[:88]), (11, [f"v{w}" for w in words[:103]]), (12, [f"v{w}" for w in words[:87]])]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in sets] * 2, "doc_id long, text string")
    assert collected(link_components(docs), "doc_id", "component_id") == sorted([(1, 1), (2, 1), (11, 11), (12, 12)] * 2)
    item = " ".join(f"b{k}" for k in range(13))
    texts = [(i, " ".join([item, *(f"x{k}" for k in range(n))])) for i, n in ((1, 247), (2, 248))]
    found = decontaminate(spark.createDataFrame(texts * 2, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert collected(found, "doc_id", "n_words", "n_hit", "contaminated") == [(1, 260, 13, True)] * 2 + [(2, 261, 13, False)] * 2


PAGE = """<!DOCTYPE html><html><head><title>t {k}</title><style>p>a{{}}</style><script>if (a<b) document.write("</p>")</script></head><body>
<header><h1>Site</h1></header><nav><ul><li>Home<li>News {k}</ul></nav><div id="cookie-notice">We use cookies {k}</div>
{open}<h1>Caf&eacute; {k} &amp; co</h1><p>First <b>bo</b>ld <!-- no --> para {k}<br>line<p>Second&#33;  para<form>q<input></form><div class="ad">Buy {k}</div>
<ul><li>one<li>two {k}</ul>{close}<aside>side {k}</aside><section id="comments"><p>nice {k}</p></section><footer>&copy; f</footer></body></html>"""


@pytest.mark.parametrize(("opening", "closing"), [("<article>", "</article>"), ("<main>", "</main>"), ('<div class="post">', "</div>")])
def test_main_text(spark, opening, closing):
    made = [(k, f"https://Site{k % 2}.example/a/{k}", PAGE.format(k="long text " * k, open=opening, close=closing), "v") for k in range(8)]
    made += [(60, "https://frame.example/", '<div class="page with-sidebar"><article class="post ad-free">kept<article class="comment">no</article></article><div id="sidebar">s</div></div><div class="comments"><article>c</article></div>', "v")]
    made += [(50, None, "plain  text", "v"), (51, "https://site0.example/x", None, "v"), (52, "::", "", "v"), (53, "https://deep.example/", "<div>" * 5000 + "deep" + "<p>er", "v"), (54, "https://open.example/", '<article><p class="a>b c</article><p>', "v")]
    pages = spark.createDataFrame(made, "page_id long, url string, html string, wrapper string")
    found = {r["page_id"]: r for r in main_text(pages).collect()}
    for k in range(8):
        word = ("long text " * k).strip()
        text = " ".join(f"Café {word} & co First bold para {word} line Second! para one two {word}".split())
        assert found[k]["text"] == text and found[k]["n_chars"] == len(text)
    assert found[60]["text"] == "kept"
    assert [found[i]["text"] for i in (50, 51, 52, 53)] == ["plain text", "", "", "deep er"]
    assert collected(main_text(pages, broadcast_chars=0), "page_id", "text") == collected(main_text(pages), "page_id", "text")
    assert main_text(pages.where("false")).count() == 0


def test_nesting_has_no_bound(spark):
    deep = 3000
    made = [
        (1, "https://a.example/", "<div>" * deep + "<article>kept <nav>menu</nav>text</article>" + "</div>" * deep),
        (2, "https://b.example/", "<div><article>before" + "<div>" * deep + "in" + "</div>" * deep + "after</article></div>rest"),
        (3, "https://c.example/1", "<body>" + "<div>" * deep + "<nav>menu</nav>own one" + "</div>" * deep),
        (4, "https://c.example/2", "<body>" + "<div>" * (deep + 5) + "<aside>side</aside>own two" + "</div>" * deep),
        (5, "https://c.example/3", "<body>" + "<div>" * deep + "<form>q</form>own three" + "</div>" * deep),
    ]
    pages = spark.createDataFrame(made, "page_id long, url string, html string")
    expected = ["kept text", "before in after", "own one", "own two", "own three"]
    assert [x for _, x in collected(main_text(pages), "page_id", "text")] == expected
    wrapper = shaped(parsed(made[2][2]))
    again = type(wrapper).unpacked(wrapper.packed())
    assert again.packed() == wrapper.packed() and again.shape() == wrapper.shape()


def test_wrappers_have_optional_and_repeated_parts():
    pages = ["<dl><dt>a<dd>b<dt>c<dd>d</dl><p>x", "<h2>t</h2><dl><dt>a<dd>b</dl><p>y<p>z", "<dl><dt>a<dd>b<dt>c<dd>d<dt>e<dd>f</dl>"]
    wrapper, *rest = [shaped(parsed(p)) for p in pages]
    for other in rest:
        merge(wrapper, other)
    found = {n.key: (n.low, n.many) for n in wrapper.children}
    assert found["h2"] == (0, False) and found["p"] == (0, True) and found["dl"][0] == 1
    assert any(n.key.startswith("(dt") and n.many for d in wrapper.children if d.key == "dl" for n in d.children)


def hand_marked():
    """(host, html, main text) of pages marked by hand: what belongs to the article, page by page."""
    topics = ["ferns", "tides", "kilns", "moths", "looms", "gears", "reeds", "salts"]
    pages = []
    for k, topic in enumerate(topics):
        long = f"A long account of {topic}, number {k}, that no other page has. " * 3
        # furniture without telling names, inside the article
        pages.append(("bars.example", f'<body><div class="x1"><a href=/>Home</a> <a href=/n>News</a></div><article><h1>On {topic}</h1><div class="x2">Tell others: <a href=#>here</a> <a href=#>there</a></div><p>{long}</p><h2>Sources</h2><p>Own work on {topic}.</p></article><div class="x3">All rights kept</div></body>', f"On {topic} {long} Sources Own work on {topic}."))
        # teasers are articles, the text is not
        pages.append(("teasers.example", f'<body><div class="lead"><h1>Of {topic}</h1><p>{long}</p><p>{topic} again, at length. {long}</p></div><div class="more"><article><a href=/1>Old news one</a></article><article><a href=/2>Old news two</a></article></div></body>', f"Of {topic} {long} {topic} again, at length. {long}"))
        # neither article nor main; names only look like furniture
        pages.append(("plain.example", f'<body><ul class="x4"><li><a href=/a>a</a><li><a href=/b>b</a></ul><div class="entry"><h1>{topic} today</h1><div class="share-price"><p>Price of {topic}: {k}</p></div><p>{long}</p><section id="login-history"><p>{topic} history</p></section></div><div class="foot">Printed {k}</div></body>', f"{topic} today Price of {topic}: {k} {long} {topic} history"))
    return pages


def test_marked_pages(spark):
    marked = hand_marked()
    made = [(k, f"http://{host}/{k}", text, "q") for k, (host, text, _) in enumerate(marked)]
    pages = spark.createDataFrame(made + made[:3], "page_id long, url string, html string, text string")
    found = main_text(pages).collect()
    assert len(found) == len(made) + 3
    right = kept = wanted = 0
    for r in found:
        have, want = r["text"].split(), marked[r["page_id"]][2].split()
        common = sum((Counter(have) & Counter(want)).values())
        right, kept, wanted = right + common, kept + len(have), wanted + len(want)
    assert right / kept > 0.99 and right / wanted > 0.99  # precision and recall in words
    alone = Reading(None)  # without wrappers both fall
    assert any(alone.text(text) != found_text for (_, text, _), found_text in zip(marked, [r["text"] for r in sorted(found, key=lambda r: r["page_id"])], strict=False))
    for host in ("bars.example", "teasers.example"):
        assert all(alone.text(text) != " ".join(want.split()) for h, text, want in marked if h == host)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<article><div class="share-price">10</div><section id="login-history">log</section><ul class="menu-items"><li>x</ul></article>', "10 log x"),
        ("<article><header><h1>Title</h1></header><p>t</article><header>site</header>", "Title t"),
        ("<main><h1>Head</h1><article>inner</article><p>after</main><aside>no</aside>", "Head inner after"),
        ("x" * 3_000_000, "x" * 3_000_000),
        ("<article>" + "<p>long " * 50_000 + "</article>", " ".join(["long"] * 50_000)),
    ],
)
def test_whole_articles(page, text):
    assert Reading(None).text(page) == text


def accepts(wrapper, node):
    """Whether a wrapper (children with multiplicities) can produce a page's plain tree, by trying all ways."""

    def fits(parts, nodes):
        if not parts:
            return not nodes
        head, rest = parts[0], parts[1:]
        if isinstance(head, tuple):  # the same once more, if the last time took anything
            again, left = head
            return fits(rest, nodes) or len(nodes) < left and fits([again, *rest], nodes)
        if head.low == 0 and fits(rest, nodes):
            return True
        more = [(head, len(nodes)), *rest] if head.many else rest
        if head.key.startswith("("):
            return fits([*head.children, *more], nodes)
        return bool(nodes) and head.key == nodes[0].key and accepts(head, nodes[0]) and fits(more, nodes[1:])

    return fits(wrapper.children, node.children)


def plain_tree(element):
    """The page's own tree, nothing folded."""
    from netlattice.llm.html_wrapper import VOID, Node

    children = [Node("#") if isinstance(x, str) else Node(x.key) if x.dropped else plain_tree(x) for x in element.content if not (isinstance(x, str) and x.isspace()) and (isinstance(x, str) or x.tag not in VOID)]
    return Node(element.key, children)


def test_wrappers_accept_their_pages():
    r = random.Random(8)

    def block(depth):
        kind = r.choice(("p", "div", "ul", "h2", "b"))
        inside = f"t{r.randint(0, 9)}" if depth == 0 or kind in ("p", "h2", "b") else "".join(f"<li>i{r.randint(0, 9)}</li>" for _ in range(r.randint(1, 4))) if kind == "ul" else "".join(block(depth - 1) for _ in range(r.randint(1, 3)))
        return f"<{kind}>{inside}</{kind}>"

    for _ in range(150):
        pages = ["".join(block(2) for _ in range(r.randint(1, 5))) for _ in range(4)]
        wrapper, *rest = [shaped(parsed(p), k) for k, p in enumerate(pages)]
        for other in rest:
            merge(wrapper, other)
        for p in pages:
            assert accepts(wrapper, plain_tree(parsed(p))), (pages, wrapper.shape())


def test_long_child_lists_align():
    from netlattice.llm.html_wrapper import Node, matches

    r = random.Random(2)
    for n in (30, 1500):
        keys = [f"k{r.randrange(n * 2)}" for _ in range(n)]
        other = [k for k in keys if r.random() < 0.9]
        for x, y in ((keys, other), (["a", "b", "c"] * n, ["c", "a"] * n), (keys, keys[::-1])):
            pairs = matches([Node(k) for k in x], [Node(k) for k in y])
            assert all(x[i] == y[j] for i, j in pairs)
            assert all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:], strict=False))
        assert len(matches([Node(k) for k in keys], [Node(k) for k in other])) > 0.95 * len(other)


def test_url_filter(spark):
    import datetime as dt

    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
    log = [("bad.example", "block", day(10)), ("bad.example", "remove", day(20)), ("bad.example", "block", day(30)), ("ok.bad.example", "allow", day(0)), ("A.example/x/", "block", day(5)), ("deep.example/a/b/c/d/e/F", "block", day(0)), ("bad.example", "allow", day(10)), (None, "block", day(1))]
    entries = spark.createDataFrame(log, "pattern string, action string, listed_at date")
    urls = ["http://bad.example/", "https://www.bad.example:8080/q?x#y", "https://ok.bad.example/z", "http://a.example/x/y?z", "http://a.example/xy", "http://notbad.example/", None, "nonsense", "HTTP://u:p@BAD.example./", "http://deep.example/a/b/c/d/e/F/g", "http://deep.example/a/b/c/d/e/f", "http://bad.example%2eelse.com/x", "https://bad.exampleü.net/x", "http://me@bad.example:80", "http://bad.example:x/", "http://bad.example/" + "p/" * 20_000]
    made = [(k * 100 + n, u, day(n), "h") for k, u in enumerate(urls) for n in (0, 9, 10, 19, 20, 29, 30, 99)]
    made += [made[0], (9999, urls[0], None, "h")]
    captures = spark.createDataFrame(made, "page_id long, url string, fetched_at date, pattern string")
    best = {}
    for p, a, d in sorted(x for x in log if x[0]):
        p = p.rstrip("/").replace("A.", "a.")
        best[p, d] = max(a, best.get((p, d), a))

    def kept(url, at):
        m = re.match(r"(?i)https?://(?:[^/@]*@)?([^/?#@:]+)(?::\d+)?(?=[/?#]|$)([^?#]*)", url or "")
        if not m or at is None:
            return True
        host, path = m[1].rstrip(".").lower(), m[2]
        active = []
        for p in {p for p, _ in best}:
            held = [(d, a) for (q, d), a in best.items() if q == p and d <= at]
            if held and max(held)[1] != "remove" and (host == p or host.endswith("." + p) or (host + path + "/").startswith(p + "/")):
                active.append((len(p), max(held)[1]))
        return not active or max(active)[1] != "block"

    expected = sorted((i, kept(u, d)) for i, u, d, _ in made)
    assert collected(url_filter(captures, entries), "page_id", "kept") == expected
    assert collected(url_filter(captures, entries, broadcast_chars=0), "page_id", "kept") == expected
    assert url_filter(captures.where("false"), entries).count() == 0
    assert all(r["kept"] for r in url_filter(captures, entries.where("false")).collect())


def test_word_hashes_follow_the_words(monkeypatch):
    import random

    from netlattice.llm import words

    draw = random.Random(5)
    for size in (8, 1 << 17):
        monkeypatch.setattr(words, "HASH_BYTES", size)
        seen = {}
        for text in [b"", b" ", b"x", b"\t\n x", bytes(range(256)) * 3, b"long" * 200_000 + b" x"] + [bytes(draw.choices(b"ab\x00\xc3\xa9 \n\t\x0b\x1c\x1f", k=draw.randrange(300))) for _ in range(300)]:
            starts, ends, hashes = words.word_hashes(text)
            found = [text[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            assert found == words.ascii_words(text)
            for word, h in zip(found, hashes.tolist(), strict=True):
                assert seen.setdefault(word, h) == h
        assert len(set(seen.values())) == len(seen)
