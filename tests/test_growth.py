"""Work that must not grow faster than the tables: fewer rows, rounds and steps for the same result."""

import random

from pyspark.sql import functions as F


def test_ranges_are_cut_without_steps(spark):
    from netlattice.operators.atoms import cidrs

    dice = random.Random(5)
    ranges = [(0, 1 << 32), (5, 5), (9, 3), (0, 1), ((1 << 32) - 1, 1 << 32), (1, (1 << 32) - 1)]
    ranges += [tuple(sorted((dice.randrange(1 << b), dice.randrange(1 << b)))) for b in (4, 10, 32) for _ in range(60)]

    def greedy(at, hi):
        out = []
        while at < hi:
            k = max(k for k in range(33) if at % (1 << k) == 0 and at + (1 << k) <= hi)
            out.append((at, 32 - k))
            at += 1 << k
        return out

    found = spark.createDataFrame(ranges, "lo long, hi long").select("lo", "hi", cidrs(F.col("lo"), F.col("hi")).alias("c"))
    assert "aggregate(" not in found._jdf.queryExecution().optimizedPlan().toString()
    for r in found.collect():
        assert [tuple(x) for x in r.c] == greedy(r.lo, r.hi)


def test_rules_with_one_box_are_one_row(spark):
    from netlattice.operators.boxes import rule_boxes

    acl = [(1, 2, s, "deny" if s % 2 else "accept", 2, s % 3, s % 3 + 1) for s in range(60)] + [(1, 2, 99, "deny", 1, 7, 7)]
    found = rule_boxes(spark.createDataFrame(acl, "router int, if_id int, seq int, action string, field int, lo long, hi long"), [32, 32, 16]).collect()
    assert sorted((r.seq, r.action, r.lo2, r.hi2) for r in found) == [(0, "accept", 0, 1), (1, "deny", 1, 2), (2, "accept", 2, 3)]


def _ring(spark, n=4):
    """Routers in a ring: each owns a prefix and sends all others on; the last owns none and gets no packet."""
    from netlattice.sources.network_xml import NetworkTables

    fib = [(r, (r + 1) % n, 0, 0, 1 << 32) for r in range(n - 1)] + [(r, r, r << 28, 4, (r + 1) << 28) for r in range(n)]
    deny = [(n - 2, n - 1, 1, "deny", 0, 0, 1 << 32)]
    frame = spark.createDataFrame
    return NetworkTables(
        frame([(r, f"r{r}") for r in range(n)], "router int, name string"), frame([(r, i, i) for r, i, *_ in fib], "router int, if_id int, nexthop int").distinct(),
        frame(fib, "router int, if_id int, lo long, width int, hi long"), frame(deny, "router int, if_id int, seq int, action string, field int, lo long, hi long"),
        frame([], "router int, if_id int, in_lo long, in_hi long, out_lo long, out_hi long"), frame([], "router int, if_id int, field int, op string, lo long, hi long"),
    )


def test_pairs_by_a_share_of_the_atoms(spark, monkeypatch):
    from netlattice.plans import headers

    tables = _ring(spark)
    whole = {tuple(r) for r in headers.HeaderNetwork(spark, tables).all_pairs().collect()}
    assert whole == {(a, b, "sat" if a < b < 3 else "unsat") for a in range(3) for b in range(4) if a < b}
    monkeypatch.setattr(headers, "FIRST", 2)  # a few atoms first, all of them for what is open then
    assert {tuple(r) for r in headers.HeaderNetwork(spark, tables).all_pairs().collect()} == whole


def test_a_target_is_done_once_its_pairs_are(spark):
    from netlattice.operators.boxes import reaching
    from netlattice.plans.headers import HeaderNetwork

    net = HeaderNetwork(spark, _ring(spark))
    targets, asked = spark.createDataFrame([(2,)], "dst int"), spark.createDataFrame([(1, 2)], "src int, dst int")
    found = reaching(net.links, net.changes(), targets, 4, asked=asked)
    assert {(r.node, r.hop) for r in found.select("node", "hop").distinct().collect() if r.node != 2} == {(1, 1)}


def test_lists_are_taken_apart_without_rounds(spark):
    from netlattice.operators.rules import Goal, Rules

    rules = Rules()
    data = [["b", "a", "b"], ["b"], [], ["b"], None]
    rules.lists(spark.createDataFrame([(x,) for x in data], "l array<string>"), "l")
    ends = [["b", "a", "b"], ["a", "b"], ["b"], []]
    parts = rules.query([Goal("parts", "A", "B", "L")])
    assert sorted(tuple(map(tuple, r)) for r in parts.collect()) == sorted((tuple(x[:k]), tuple(x[k:]), tuple(x)) for x in ends for k in range(len(x) + 1))
    assert sorted((r.X, tuple(r.L)) for r in rules.query([Goal("element", "X", "L")]).collect()) == sorted({(v, tuple(x)) for x in ends for v in x})
    assert "Aggregate" not in parts._jdf.queryExecution().optimizedPlan().toString()  # no rows are brought together


def test_parts_as_texts(spark):
    from netlattice.operators import rules

    data = [["b", "a", "b"], ["ü,é", "", "c"], ["ü", "é", "", "c"], ["", ""], [None, "a", None], [None], [], None, [str(i % 9) for i in range(600)]]
    lists = spark.createDataFrame([(x,) for x in data], "l array<string>")
    ends = [[e for e in x if e is not None][k:] for x in data if x is not None for k in range(len(x) + 1)]
    wanted = {(",".join(x[:k]), ",".join(x[k:]), ",".join(x)) for x in ends for k in range(len(x) + 1)}
    found = rules.joined_parts(lists)
    assert sorted(tuple(r) for r in found.collect()) == sorted(wanted)
    made = rules.Rules()
    made.fact("joined", rules.joined_parts(lists), ["a", "b", "l"], once=True)
    solved = made.query([rules.Goal("joined", "A", "B", "L")])
    top = solved._jdf.queryExecution().optimizedPlan().toString().split("Generate inline")[0]
    assert solved.columns == ["A", "B", "L"] and "array_join" not in top and "Aggregate" not in top  # a part is cut from its text


def test_constrained_walks_make_no_join(spark):
    from netlattice.operators import reach

    fwd = spark.createDataFrame([(c, i, (i + d) % 7) for c in range(3) for i in range(7) for d in (1, 1 + c)], "cls long, src long, dst long").distinct()
    only = lambda df, hop: df if hop % 2 else df.where("src % 2 = 0")
    edges = {tuple(r) for r in fwd.collect()}
    level, expected = {(d, c, d) for c, _, d in edges}, {}
    for hop in range(1, 6):
        level = {(dst, c, s) for dst, c, n in level for e, s, d in edges if (e, d) == (c, n) and (hop % 2 or s % 2 == 0)}
        for dst, c, n in level:
            if dst == n:
                expected.setdefault((dst, c), hop)
    found = reach.constrained_loops(fwd, spark.range(7).toDF("subject"), 5, only)
    assert {(r.origin, r.cls): r.hop for r in found.collect()} == expected and found.count() == len(expected)
    walked = reach.walks(fwd, spark.range(1).toDF("dst"), 5, only)
    assert walked._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 1  # the targets


def test_pairs_of_a_large_key_are_dealt(spark, monkeypatch):
    from netlattice.operators import pairs

    monkeypatch.setattr(pairs, "SIDE", 3)
    left = spark.createDataFrame([(0, i) for i in range(20)] + [(1, 5), (2, 6)], "k int, a int")
    right = spark.createDataFrame([(0, i) for i in range(10)] + [(1, 7), (3, 8)], "k int, b int")
    found = pairs.paired(left, right, ["k"])
    assert sorted((r.k, r.a, r.b) for r in found.collect()) == sorted([(0, a, b) for a in range(20) for b in range(10)] + [(1, 5, 7)])
    per_task = [len(p) for p in found.select("a").rdd.glom().collect()]
    assert max(per_task) < 100  # one key has 200 of 201 pairs


def test_pairs_meet_as_pieces(spark):
    from netlattice.operators.pairs import SIDE, paired

    left = spark.range(40).selectExpr("cast(id % 2 as int) k", "if(id < 3, null, id) a")
    right = spark.range(5000).selectExpr("cast(id % 2 as int) k", "if(id < 5, null, id) b")
    found = paired(left, right, ["k"])
    assert found.columns == ["k", "a", "b"] and found.count() == 40 * 2500 and found.where("b is null").count() == 20 * 5 and found.where("a is null").count() == 3 * 2500
    two = paired(left, right.selectExpr("k", "b", "b % 3 c"), ["k"])
    assert two.columns == ["k", "a", "b", "c"] and two.exceptAll(left.join(right.selectExpr("k", "b", "b % 3 c"), "k")).isEmpty()
    step = found._jdf.queryExecution().optimizedPlan()
    while step.nodeName() != "Join":
        assert step.nodeName() in ("Project", "Generate")  # pairs are made above the join
        step = step.children().head()
    met = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, step).count()
    assert met < 40 * 2500 / SIDE * 4


def test_nat_pairs_are_not_brought_together(spark):
    from netlattice.operators import policy

    made = spark.createDataFrame([(f"{d}/{q}", d, q) for d in range(0, 64, 4) for q in (0, 1)], "cls string, dst_ip long, dst_port long")
    nat = [(1, 0, 0, 32, 16, 48), (1, 0, 0, 16, 32, 64), (1, 0, 0, 16, 32, 64), (1, 0, 8, 12, 48, 64), (2, 0, 4, 8, 0, 4), (2, 0, 4, 8, 9, 9)]
    found = policy.nat_pairs(made, spark.createDataFrame(nat, "router int, if_id int, in_lo long, in_hi long, out_lo long, out_hi long"), ["router", "if_id"], ["dst_ip", "dst_port"])
    cls = [(r.cls, r.dst_ip) for r in made.collect()]
    expected = sorted({(r, i, a, b) for r, i, lo, hi, out, end in nat for a, x in cls if lo <= x < hi for b, y in cls if out <= y < end})
    assert sorted(tuple(r) for r in found.collect()) == expected
    assert not found._jdf.queryExecution().optimizedPlan().toString().lstrip().startswith("Aggregate")


def _walk(fib, start, address, asked, max_hops):
    """Hops of one address, by looking at every route."""
    out, at = [], start
    for hop in range(1, max_hops + 1):
        held = [(-w, nh is None, nh or 0, lo) for node, lo, w, nh in fib if node == at and w <= asked and address >> (32 - w) << (32 - w) == lo]
        if at is None or not held:
            break
        w, none, nh, lo = min(held)
        at = None if none else nh
        out.append((start, address, asked, hop, at, lo, -w))
    return out


def test_traces_take_no_job_a_hop(spark):
    from netlattice.operators.reach import trace

    fib = spark.createDataFrame([(0, 0, 0, 1), (1, 0, 0, 0)], "node long, lo long, width int, nh long")  # round and round
    starts = spark.createDataFrame([(0, 5), (0, 5), (1, 1 << 31), (7, 5)], "start long, address long")
    jobs = {}
    for hops in (2, 30):
        spark.sparkContext.setJobGroup(f"trace-{hops}", "")
        found = trace(fib, starts, hops).collect()
        jobs[hops] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"trace-{hops}"))
        assert len(found) == 4 + 2 * hops and max(r.hop for r in found) == hops
    spark.sparkContext.setJobGroup("other", "")
    assert jobs[2] == jobs[30]


def test_traces_over_many_stretches(spark, monkeypatch):
    from netlattice.operators import ways
    from netlattice.operators.reach import trace

    dice = random.Random(3)
    some = [dice.randrange(1 << 32) for _ in range(12)]  # addresses that many routes hold, so that lengths nest
    fib = [(n, dice.choice(some) >> (32 - w) << (32 - w), w, dice.randrange(7)) for n in range(6) for w in (0, 0, 1, 8, 8, 9, 23, 24, 24, 31, 32, 32) for _ in range(3) if n or w]
    fib += [(2, some[0] | 1, 8, 3), (3, some[1] >> 8 << 8, 24, None), (None, 0, 0, 1), (6, some[2], 32, None)]
    starts = [(dice.choice([0, 1, 2, 3, 4, 5, 6, 9]), a, w) for a in [*some, 0, (1 << 32) - 1, *(dice.randrange(1 << 32) for _ in range(40))] for w in (0, 8, 24, 32)]
    starts += [*starts[:3], (None, 5, 32), (1, None, 32), (1, 5, None)]
    monkeypatch.setattr(ways, "ROWS", 16)
    monkeypatch.setattr(ways, "STRETCHES", 9)
    table = spark.createDataFrame(fib, "node long, lo long, width int, nh long")
    asked = spark.createDataFrame(starts, "start long, address long, asked int")
    found = [tuple(r) for r in trace(table, asked, 6).collect()]
    wanted = [row for s in {s for s in starts if None not in s} for row in _walk(fib, *s, 6)]
    key = lambda row: [(x is None, x or 0) for x in row]
    assert sorted([r for r in found if r[3]], key=key) == sorted(wanted, key=key) and len(wanted) > 300
    assert sorted([r[:3] for r in found if not r[3]], key=key) == sorted(starts, key=key)
    plain = [tuple(r) for r in trace(table, asked.drop("asked").distinct(), 6).where("hop > 0").collect()]
    assert sorted(plain, key=key) == sorted((r[:2] + r[3:] for s in {s[:2] for s in starts if None not in s[:2]} for r in _walk(fib, *s, 32, 6)), key=key)
    names = spark.createDataFrame([(f"r{n}", lo, w, None if nh is None else f"r{nh}") for n, lo, w, nh in fib if n is not None], "node string, lo long, width int, nh string")
    texts = trace(names, asked.where("start is not null").selectExpr("concat('r', start) start", "address", "asked"), 6).where("hop > 0").collect()
    assert sorted([(int(r[0][1:]), *r[1:4], r[4] and int(r[4][1:]), *r[5:]) for r in texts], key=key) == sorted(wanted, key=key)


def test_wide_routes_are_dealt_bit_by_bit(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from netlattice.operators import ways

    monkeypatch.setattr(ways, "DEALT", 7)
    rows = pa.RecordBatch.from_pydict({"asks": [False, True, False, False], "node": [1, 2, 3, 4], "lo": [0, 30, 32, 8], "width": [0, 32, 27, 32], "nh": [5, None, 5, 5]})
    found = list(ways.dealt(iter([rows, rows.slice(0, 0)]), np.array([8, 16, 40, 1 << 20])))
    assert all(b.num_rows <= 7 for b in found)
    assert [(r["family"], r["node"]) for b in found for r in b.to_pylist()] == [(0, 1), (1, 1), (2, 1), (3, 1), (4, 1), (2, 2), (2, 3), (3, 3), (1, 4)]
