"""The corpus pipeline, each stage held against brute force on its own input."""

import random
import subprocess
import sys
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest

from netlattice.llm.packing import END_ID, TOKENIZER, tokenizer
from tests_llm_helpers import SPACE, bench_words, jaccard_expected  # noqa: F401

ROOT = Path(__file__).resolve().parents[2]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(9)
    words = [a + b for a in ("ka", "lo", "mi", "nu", "te") for b in ("ra", "so", "ti", "vu", "we")]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(i, prose(20)) for i in range(3)]
    texts = [prose(r.randint(10, 90)) for _ in range(150)]
    texts += [" ".join(w + r.choice(("###", "$$$")) for w in prose(40).split()) for _ in range(30)]
    texts += [texts[k] for k in range(10)] + [texts[k].replace(" ", "\n ") for k in range(10, 15)]
    texts += [texts[20] + " " + prose(2) for _ in range(4)] + [items[0][1] + " " + prose(30), items[1][1]] + [None, "", " "]
    docs = [(i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)]
    labels = [(i, int(not 150 <= i < 180), 0) for i in range(0, 200, 2)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"file://{path}/benchmark.parquet")
    return f"file://{path}", dict((d[0], d[1]) for d in docs), items


def test_stages(spark, folder):
    import corpus_pipeline

    sf_dir, text, items = folder
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, [sorted(r["doc_id"] for r in docs.collect())]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.saved(spark, stage(spark, docs, sf_dir), "test")
        assert docs.columns == columns, name
        kept.append(sorted(r["doc_id"] for r in docs.collect()))
    every, good, exact, near, clean = kept
    assert np.mean([i in good for i in every if not 150 <= i < 180]) > 0.97
    assert np.mean([i in good for i in range(150, 180)]) < 0.1
    first = {}
    for i in good:
        first.setdefault(SPACE.sub(" ", text[i] or ""), i)
    assert exact == sorted(first.values())
    assert near == sorted({c for _, _, c in jaccard_expected([(i, text[i]) for i in exact])})
    windows = {tuple(w[p : p + 13]) for _, t in items for w in [bench_words(t)] for p in range(len(w) - 12)}

    def contaminated(i):
        w, hit = bench_words(text[i]), set()
        for p in range(len(w) - 12):
            if tuple(w[p : p + 13]) in windows:
                hit.update(range(p, p + 13))
        return bool(hit) and 20 * len(hit) >= len(w)

    assert clean == [i for i in near if not contaminated(i)] and len(clean) < len(near)
    pieces = defaultdict(int)
    for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect():
        pieces[r["doc_id"]] += r["length"]
        if r["length"] == r["doc_tokens"]:
            ids = [*tokenizer(TOKENIZER).encode(text[r["doc_id"]] or "", add_special_tokens=False).ids, END_ID]
            assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
    assert sorted(pieces) == clean
    assert corpus_pipeline.run(spark, sf_dir).count() >= len(clean)


def test_awkward_rows(spark, folder, tmp_path):
    """Repeated rows and ids, null ids, names that operators use, and a very long text go through all stages."""
    import corpus_pipeline

    sf_dir, text, _ = folder
    long = " ".join(f"ka{k % 977} lo{k % 1009}" for k in range(60_000))
    rows = [(i, t, "x", "y", "z", 1.0) for i, t in text.items() if i < 150]
    rows += [rows[3], rows[3], (5, "another text with the id five", "x", "y", "z", 1.0), (None, "a text without an id", "x", "y", "z", 1.0), (None, None, "x", "y", "z", 1.0), (900, long, "x", "y", "z", 1.0), (901, long, "x", "y", "z", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept_id string, kept string, key string, score double")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").write.parquet(f"file://{tmp_path}/{t}.parquet")
    where, columns = f"file://{tmp_path}", docs.columns
    docs = spark.read.parquet(f"{where}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.saved(spark, stage(spark, docs, where), "test")
        assert docs.columns == columns, name
        left = [(r["doc_id"], r["text"]) for r in docs.collect()]
        assert (None, "a text without an id") in left and (900, long) in left, name
        if name != "quality classifier":
            assert left.count((3, text[3])) == 1 and (901, long) not in left
            assert (5, "another text with the id five") in left and len(left) == len(set(left))
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, where).where("doc_id = 900").collect()
    assert sum(r["length"] for r in pieces) == pieces[0]["doc_tokens"] > 60_000
    assert corpus_pipeline.run(spark, where).where("doc_id IS NULL").count() >= 1


def test_empty_documents(spark, folder, tmp_path):
    import corpus_pipeline

    sf_dir, _, _ = folder
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").where("false").write.parquet(f"file://{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_library_does_not_need_these_operators():
    """The rest of the library neither imports this subpackage nor breaks without it."""
    for path in (ROOT / "netlattice").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "llm" not in path.read_text(), path
    code = "import sys; sys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e; assert not [q for q in e.queries() if q.startswith('op')]; assert 'lpm' in e.queries()"
    subprocess.run([sys.executable, "-c", code.replace("sys.modules['corpus_pipeline'] = None", "sys.meta_path.insert(0, type('F', (), {'find_spec': staticmethod(lambda n, *a: (_ for _ in ()).throw(ModuleNotFoundError(name=n)) if n == 'corpus_pipeline' else None)}))")], check=True, cwd=ROOT)
