"""Rules: recursion, cuts, lists, foreign predicates and tests of terms."""

import itertools

import pytest
from pyspark.sql import functions as F

from netlattice.operators.rules import Atomic, Cons, Cut, Differ, Goal, Is, Nil, Numeric, Rules, Same, is_variable


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def rules(spark):
    r = Rules()
    r.fact("edge", spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "1")], "s string, t string"), ["s", "t"])
    return r


def test_recursion_ends_on_cycles(rules):
    rules.rule("path", ["A", "B"], [Goal("edge", "A", "B")])
    rules.rule("path", ["A", "C"], [Goal("edge", "A", "B"), Goal("path", "B", "C")])
    assert rows(rules.query([Goal("path", "A", "B")])) == sorted([(i, j) for i in "abc" for j in "abc"] + [("x", "1")])
    assert rows(rules.query([Goal("path", "'a'", "B"), Differ("B", "'a'")])) == [("b",), ("c",)]


def test_two_calls_in_a_rule(rules, spark):
    rules.rule("path", ["A", "B"], [Goal("edge", "A", "B")])
    rules.rule("path", ["A", "C"], [Goal("path", "A", "B"), Goal("path", "B", "C")])
    assert rows(rules.query([Goal("path", "A", "B")])) == sorted([(i, j) for i in "abc" for j in "abc"] + [("x", "1")])


def test_rules_that_call_each_other(spark):
    r = Rules()
    r.fact("next", spark.createDataFrame([(i, i + 1) for i in range(9)], "a int, b int"), ["a", "b"])
    r.fact("zero", spark.createDataFrame([(0,)], "a int"), ["a"])
    r.rule("even", ["N"], [Goal("zero", "N")])
    r.rule("even", ["N"], [Goal("next", "M", "N"), Goal("odd", "M")])
    r.rule("odd", ["N"], [Goal("next", "M", "N"), Goal("even", "M")])
    assert [n for (n,) in rows(r.query([Goal("even", "N")]))] == [0, 2, 4, 6, 8]
    assert [n for (n,) in rows(r.query([Goal("odd", "N"), Differ("N", 3)]))] == [1, 5, 7, 9]
    assert rows(r.query([Goal("odd", "N"), Goal("next", "N", "M"), Goal("even", "M")]).select("N", "M")) == [(n, n + 1) for n in (1, 3, 5, 7)]


def test_foreign_predicates_and_terms(rules, spark):
    rules.calls("upto", lambda n, _: spark.range(n).selectExpr("cast(id as int) as n", "cast(id * id as int) as square"))
    assert rows(rules.query([Goal("upto", 3, "S")])) == []  # the first column must equal the constant asked for
    assert rows(rules.query([Goal("edge", "A", "B"), Numeric("B")])) == [("x", "1")]
    assert len(rows(rules.query([Goal("edge", "A", "B"), Numeric("B", holds=False)]))) == 3
    assert rows(rules.query([Goal("edge", "A", "B"), Goal("edge", "C", "A"), Same("C", "B")])) == []


def test_lists(spark):
    data = [["a", "b", "c"], ["b"], [], ["c", "c"]]
    r = Rules()
    r.lists(spark.createDataFrame([(x,) for x in data], "l array<string>"), "l")
    r.rule("member", ["X", "L"], [Goal("cell", "L", "X", "_")])
    r.rule("member", ["X", "L"], [Goal("cell", "L", "_", "T"), Goal("member", "X", "T")])
    ends = {tuple(x[k:]) for x in data for k in range(len(x) + 1)}
    assert {(x, tuple(y)) for x, y in rows(r.query([Goal("member", "X", "L")]))} == {(x, end) for end in ends for x in end}
    r.rule("append", [Nil(), "L", "L"], [Goal("list", "L")])
    r.rule("append", [Cons("H", "A"), "B", "L"], [Goal("cell", "L", "H", "T"), Goal("append", "A", "B", "T")])
    found = {tuple(map(tuple, x)) for x in rows(r.query([Goal("append", "A", "B", "C")]))}
    assert found == {(end[:k], end[k:], end) for end in ends for k in range(len(end) + 1)}
    assert {tuple(x) for (x,) in rows(r.query([Goal("list", Cons("'c'", "T")), Goal("list", "T")]).select("T"))} == {(), ("c",)}
    assert rows(r.query([Goal("list", Cons("A", Cons("B", "_"))), Same("A", "B")])) == [("c", "c")]
    both = [Goal("cell", "L", "H", "_")]
    assert len(rows(r.query([*both, Atomic("H")]))) == 5 and rows(r.query([*both, Atomic("L")])) == []
    assert len(rows(r.query([*both, Atomic("L", holds=False)]))) == 5 and rows(r.query([*both, Atomic("H", holds=False)])) == []


# -- a small resolver: clauses in order, facts in order, cut


def bindings(goals, clauses, env, fresh=itertools.count()):
    """Solutions (dicts) in the order of a depth-first search; raises Done past a cut's last alternative."""
    if not goals:
        yield env
        return
    goal, rest = goals[0], goals[1:]
    if isinstance(goal, Cut):
        yield from bindings(rest, clauses, env)
        raise Done
    if isinstance(goal, Differ):
        if look(goal.a, env) != look(goal.b, env):
            yield from bindings(rest, clauses, env)
        return
    for head, body in clauses[goal.name]:
        n = next(fresh)
        name = lambda t, n=n: f"{t}#{n}" if is_variable(t) else t
        new = dict(env)
        if all(unify(a, name(h), new) for a, h in zip(goal.args, head, strict=True)):
            own = [Goal(g.name, *map(name, g.args)) if isinstance(g, Goal) else Differ(name(g.a), name(g.b)) if isinstance(g, Differ) else g for g in body]
            solutions, cut = bindings(own, clauses, new), False
            while not cut:
                try:
                    found = next(solutions)
                except StopIteration:
                    break
                except Done:  # of a cut in this clause: no other clause is tried
                    cut = True
                    continue
                yield from bindings(rest, clauses, found)
            if cut:
                return


class Done(Exception):
    pass


def look(t, env):
    while is_variable(t) and t in env:
        t = env[t]
    return t.strip("'") if isinstance(t, str) and not is_variable(t) else t


def unify(a, b, env):
    if "_" in (a, b):
        return True
    a, b = look(a, env), look(b, env)
    for x, y in ((a, b), (b, a)):
        if is_variable(x) and "#" in x or is_variable(x) and x[0].isupper():
            env[x] = y if not isinstance(y, str) or is_variable(y) else f"'{y}'"
            return True
    return a == b


def resolved(goals, clauses):
    out = []
    try:
        for env in bindings(goals, clauses, {}):
            out.append(env)
    except Done:
        pass
    names = sorted({t for g in goals if isinstance(g, Goal) for t in g.args if is_variable(t)})
    return sorted({tuple(look(n, e) for n in names) for e in out})


FACTS = {
    "likes": [("zoe", "tea"), ("zoe", "ale"), ("bob", "rum"), ("bob", "tea"), ("al", "ale")],
    "sold": [("tea", "shop"), ("ale", "pub"), ("ale", "shop"), ("rum", "dock")],
}
CLAUSES = {
    # the first drink each person likes and somebody sells; only for others, water
    "drinks": [(["P", "D"], [Goal("likes", "P", "D"), Goal("sold", "D", "_"), Cut()]), (["P", "'water'"], [Goal("person", "P")])],
    "goes": [(["P", "S"], [Goal("drinks", "P", "D"), Cut(), Goal("sold", "D", "S")])],
    "any": [(["X"], [Goal("sold", "X", "'pub'")]), (["X"], [Goal("likes", "_", "X")])],
    "choice": [(["P", "D"], [Goal("likes", "P", "D"), Differ("D", "'tea'"), Cut()]), (["P", "D"], [Goal("likes", "P", "D")])],
}
PEOPLE = ["al", "cy", "zoe", "bob"]


@pytest.mark.parametrize(
    "goals",
    [
        [Goal("likes", "P", "D"), Cut()],
        [Goal("likes", "P", "D"), Goal("sold", "D", "S"), Cut()],
        [Goal("likes", "P", "'ale'"), Cut(), Goal("sold", "'ale'", "S")],
        [Goal("any", "X"), Cut()],
        [Goal("drinks", "'zoe'", "D")],
        [Goal("drinks", "'cy'", "D")],
        [Goal("person", "P"), Goal("drinks", "P", "D")],
        [Goal("person", "P"), Goal("choice", "P", "D")],
        [Goal("goes", "P", "S")],
        [Goal("person", "P"), Goal("goes", "P", "S"), Cut()],
        [Goal("drinks", "P", "D")],
    ],
)
def test_cuts_follow_the_order_of_clauses(spark, goals):
    r = Rules()
    for name, facts in (FACTS | {"person": [(p,) for p in PEOPLE]}).items():
        columns = [f"v{i}" for i in range(len(facts[0]))]
        df = spark.createDataFrame([(*f, k) for k, f in enumerate(facts)], ", ".join(f"{c} string" for c in columns) + ", line int")
        r.fact(name, df, columns, order="line")
    for name, some in CLAUSES.items():
        for head, body in some:
            r.rule(name, head, body)
    clauses = CLAUSES | {n: [([f"'{v}'" for v in f], []) for f in facts] for n, facts in FACTS.items()} | {"person": [([f"'{p}'"], []) for p in PEOPLE]}
    found = r.query(goals)
    assert rows(found.select(*sorted(found.columns))) == resolved(goals, clauses)


def test_values_order_facts_without_numbers(spark):
    r = Rules()
    r.fact("n", spark.createDataFrame([(10,), (9,), (-3,)], "x int"), ["x"])
    assert rows(r.query([Goal("n", "X"), Is("Y", lambda x: F.abs(x), ("X",)), Cut()])) == [(-3, 3)]
