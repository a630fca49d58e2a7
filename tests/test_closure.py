"""Closures inside families of classes against following every edge, in stretches of any size."""

import random

import pyarrow as pa
import pytest

from netlattice.operators import closure, reach


def brute(edges, goals, bound, exact):
    found, level = set(), {(e[3], e[4], e[1], e[2]) for e in edges if e[3] in goals}
    known, hop = set(), 0
    while level and hop < bound:
        hop += 1
        found |= {(d, a, c, n, hop) for d, a, c, n in level}
        known |= level
        level = {(d, a, e[1], e[2]) for d, a, c, n in level for e in edges if (e[4], e[3]) == (c, n)}
        level -= set() if exact else known
    return sorted(found)


@pytest.mark.parametrize("stretch", [1, 7, 50, 1 << 16])
@pytest.mark.parametrize("exact", [False, True])
def test_stretches_and_many_targets(monkeypatch, stretch, exact):
    monkeypatch.setattr(closure, "EDGES", stretch)
    dice = random.Random(stretch)
    edges = sorted({(f, 2 * f + dice.randrange(2), dice.randrange(90), dice.randrange(90), 2 * f + dice.randrange(2)) for f in range(5) for _ in range(150)})
    goals = set(range(0, 90, 1 if stretch == 7 else 9))  # more than 64 targets in a family, or few
    columns = list(zip(*edges, strict=True))
    table = pa.table({n: pa.array(c, pa.int64()) for n, c in zip(["family", "cls_in", "src", "dst", "cls_out"], columns, strict=True)} | {"goal": pa.array([d in goals for d in columns[3]])})
    batches = list(closure.closed(iter(table.to_batches(max_chunksize=11)), 4, exact, False))
    assert sorted(tuple(r[n] for n in closure.NAMES) for b in batches for r in b.to_pylist()) == brute(edges, goals, 4, exact)
    selves = list(closure.closed(iter(table.to_batches(max_chunksize=11)), 4, exact, True))
    assert sorted(tuple(r[n] for n in closure.NAMES) for b in selves for r in b.to_pylist()) == [x for x in brute(edges, goals, 4, exact) if x[0] == x[3]]


def test_no_join_a_round(spark):
    fwd = spark.createDataFrame([(c, i, (i + 1) % 9) for c in range(3) for i in range(9)], "cls long, src long, dst long")
    found = reach.loops(fwd)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in found.collect()} == {(i, c, 9) for c in range(3) for i in range(9)}
