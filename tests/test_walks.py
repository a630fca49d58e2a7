"""Walks, constraints, fixed hops and witnesses on random relations, against plain enumeration."""

import random

import pytest

from netlattice.operators.atoms import coalesced, numbered
from netlattice.operators.lpm import pieces
from netlattice.operators.reach import fixed_hops, transformed_reach, walks
from netlattice.operators.witness import round_trips, toward, wanderings

BOUND = 5


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def edges():
    r = random.Random(4)
    return sorted({(c, r.randrange(6), r.randrange(6)) for c in range(4) for _ in range(8)})


@pytest.fixture(scope="module")
def fwd(spark, edges):
    return spark.createDataFrame(edges, "cls long, src long, dst long").persist()


@pytest.fixture(scope="module")
def changing():
    r = random.Random(6)
    out = {(c, a, b, c) for c in range(4) for a, b in [(r.randrange(5), r.randrange(5)) for _ in range(6)]}
    return sorted(out | {(r.randrange(4), r.randrange(3), 4, r.randrange(4)) for _ in range(3)})


def exact(steps, target, bound, allowed=lambda edge, hop: True):
    """(cls, node, hop) of all walks of exactly that many edges; steps: (cls_in, src, dst, cls_out)."""
    now, out = {(c, target) for _, _, d, c in steps if d == target}, set()
    for hop in range(1, bound + 1):
        now = {(e[0], e[1]) for e in steps if (e[3], e[2]) in now and allowed(e, hop)}
        out |= {(c, n, hop) for c, n in now}
    return out


def test_exact_walks(spark, fwd, edges):
    plain = [(c, a, b, c) for c, a, b in edges]
    targets = spark.createDataFrame([(0,), (3,)], "dst long")
    expected = sorted((t, c, n, h) for t in (0, 3) for c, n, h in exact(plain, t, BOUND))
    assert rows(walks(fwd, targets, BOUND).select("dst", "cls", "node", "hop")) == expected
    allowed = lambda e, hop: hop % 2 or e[1] != 2
    found = walks(fwd, targets, BOUND, lambda df, hop: df if hop % 2 else df.where("src <> 2"))
    assert rows(found.select("dst", "cls", "node", "hop")) == sorted((t, c, n, h) for t in (0, 3) for c, n, h in exact(plain, t, BOUND, allowed))


def test_exact_walks_of_changing_packets(spark, changing):
    df = spark.createDataFrame(changing, "cls_in long, src long, dst long, cls_out long")
    targets = spark.createDataFrame([(4,)], "dst long")
    assert rows(walks(df, targets, BOUND, change=True).select("cls", "node", "hop")) == sorted(exact(changing, 4, BOUND))
    found = {r["hop"]: r for r in fixed_hops(df, targets, 3).collect()}
    for hop in (1, 2, 3):
        after = {(c, 4) for _, _, d, c in changing if d == 4} if hop == 1 else {(c, n) for c, n, h in exact(changing, 4, 3) if h == hop - 1}
        last = [e for e in changing if (e[3], e[2]) in after]
        if not last:
            assert hop not in found
            continue
        changes = sorted((e[0], e[1]) for e in last if e[0] != e[3])
        assert found[hop]["fixed"] == (not changes)
        assert (found[hop]["cls_in"], found[hop]["src"]) == (changes[0] if changes else (None, None))


def replayed(path, steps):
    """Whether each hop of a path (node, cls) is an edge; the packet may change where the edge says so."""
    return all(any((c, a, b, d) == (x[1], x[0], y[0], y[1]) for c, a, b, d in steps) for x, y in zip(path, path[1:], strict=False))


def paths(df):
    out = {}
    for subject, hop, node, cls in rows(df.select("subject", "hop", "node", "cls")):
        out.setdefault(subject, []).append((hop, node, cls))
    assert all([h for h, _, _ in p] == list(range(len(p))) for p in out.values())
    return {s: [(n, c) for _, n, c in p] for s, p in out.items()}


def test_witnesses_can_be_replayed(spark, fwd, edges, changing):
    plain = [(c, a, b, c) for c, a, b in edges]
    # shortest ways back
    starts = [(n, c) for n in range(6) for c in range(4) if any(e[:2] == (c, n) for e in edges)]
    for node in range(6):
        some = [(s, c) for s, c in starts if s == node][:1]
        if not some:
            continue
        found = paths(round_trips(fwd, spark.createDataFrame(some, "subject long, cls long"), 10))
        c = some[0][1]
        back = [h for k, n, h in exact([e for e in plain if e[0] == c], node, 10) if n == node]
        assert (node in found) == bool(back)
        if back:
            way = found[node]
            assert len(way) - 1 == min(back) and way[0][0] == way[-1][0] == node and replayed(way, plain)
    # to a target, with changes
    df = spark.createDataFrame(changing, "cls_in long, src long, dst long, cls_out long")
    known = transformed_reach(df, spark.createDataFrame([(4,)], "dst long"), 9)
    states = {(c, n): min(h for k, m, h in exact(changing, 4, 9) if (k, m) == (c, n)) for c, n, _ in exact(changing, 4, 9)}
    asked = spark.createDataFrame([(f"{c} {n}", 4, n, c) for c, n in states], "subject string, dst long, node long, cls long")
    found = paths(toward(df, known, asked))
    assert set(found) == {f"{c} {n}" for c, n in states}
    for (c, n), hops in states.items():
        way = found[f"{c} {n}"]
        assert len(way) - 1 == hops and way[0] == (n, c) and way[-1][0] == 4 and replayed(way, changing)
    # wherever the smallest next hop leads
    asked = spark.createDataFrame([(n, 1) for n in range(6)], "subject long, cls long")
    for node, way in paths(wanderings(fwd, asked, 20)).items():
        seen = [n for n, _ in way]
        nxt = lambda n: min((b for c, a, b in edges if (c, a) == (1, n)), default=None)
        assert seen[0] == node and all(nxt(a) == b for a, b in zip(seen, seen[1:], strict=False))
        assert len(set(seen[:-1])) == len(seen[:-1]) and (seen[-1] in seen[:-1] or nxt(seen[-1]) is None)


def test_pieces_are_the_longest_match(spark):
    """One node has all prefixes and a hot default, others few; host-wide prefixes and equal costs too."""
    r = random.Random(1)
    space = 1 << 32
    fib = {(r.choice([0, 0, 0, 1, 2]), w, r.randrange(1 << w) << (32 - w) if w else 0, r.randrange(3)) for w in [r.choice([0, 1, 2, 3, 4, 5, 31, 32]) for _ in range(150)]}
    df = spark.createDataFrame([(n, lo, w, h) for n, w, lo, h in fib], "node long, lo long, width int, nh long")
    found = [(n, lo, hi, sorted(h)) for n, lo, hi, h in rows(pieces(df))]
    ends = sorted({0, *(lo for _, _, lo, _ in fib), *(lo + (1 << 32 - w) for _, w, lo, _ in fib)} - {space})
    for node in range(3):
        for x in ends:
            met = [(w, h) for n, w, lo, h in fib if n == node and lo <= x < lo + (1 << 32 - w)]
            best = sorted(h for w, h in met if w == max(met)[0])
            assert [h for n, lo, hi, h in found if n == node and lo <= x < hi] == ([best] if best else [])


@pytest.mark.parametrize("stretch", [4, 1 << 16])
def test_ranges_are_joined_over_stretches(spark, stretch):
    r = random.Random(stretch)
    ranges = [("hot" if r.random() < 0.8 else "cold", lo, lo + r.choice([1, 2, 3, 17])) for lo in [r.randrange(200) for _ in range(80)]]
    expected = []
    for key in ("hot", "cold"):
        for lo, hi in sorted((lo, hi) for k, lo, hi in ranges if k == key):
            if expected and expected[-1][0] == key and lo <= expected[-1][2]:
                expected[-1][2] = max(expected[-1][2], hi)
            else:
                expected.append([key, lo, hi])
    df = spark.createDataFrame(ranges, "key string, lo long, hi long")
    assert rows(coalesced(df, ["key"], stretch).select("key", "lo", "hi")) == sorted(map(tuple, expected))
    points = sorted({lo for _, lo, _ in ranges})
    assert rows(numbered(spark.createDataFrame([(x,) for x in points], "x long"), stretch)) == [(x, k) for k, x in enumerate(points)]
