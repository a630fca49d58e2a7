"""Conjunctive rules over DataFrames: facts are tables, a rule is a view over goals.

    rules = Rules()
    rules.fact("router", routers, ["id", "role"])
    rules.rule("tagged", ["F", "I"], [Goal("router", "F", "'firewall'"), Goal("router", "I", "'internal'")])
    rules.query([Goal("tagged", "A", "B"), Differ("A", "B")])

Arguments that begin with a letter are variables, ``_`` is anonymous, and quoted
strings or numbers are constants.  Shared variables are equalities, so goals
become equi-joins; a goal that shares none is a product, as the rule says.
Solutions are sets.

Predicates may call themselves and each other, any number of times in a rule.
Those that do are derived together, round by round: each rule is joined once for
each of its recursive goals, with the rows of that goal that were new in the last
round and all that is known of the others, until a round brings nothing new.

Lists are arrays of strings.  ``Cons("H", "T")`` is a list by its first element and
the rest, ``Nil()`` the empty list.  In a goal they take a list apart, in a head they
build one.  ``lists`` makes the lists of a table and all their ends known as
``cell(list, head, tail)`` and ``list(list)``, so that rules which walk down a list
are equi-joins on lists; ``element(value, list)`` and ``parts(front, rest, list)`` need no walk.

A cut keeps the first solution so far, as a resolver that tries clauses in the order
of their declaration and facts in the order of their rows would find it; ``fact``
takes the column that says the order (values decide without one).  Solutions carry
that order as a text: clause numbers and row numbers, goal by goal.  A clause with
a cut is asked for the values that a goal brings along, so its cut keeps the first
solution for each of them, and for those later clauses are not tried.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netlattice.sources.scratch import saved

LIST = "array<string>"
#: Parts of a list that become rows at once.
RUN = 256
#: Ends of a list that one task makes.
STRETCH = 64
#: Column that carries the order of solutions.
ORDER = "_order"


@dataclass(frozen=True)
class Nil:
    """The empty list."""


@dataclass(frozen=True)
class Cons:
    """A list by its first element and the rest."""

    head: str | int
    tail: object


class Goal:
    def __init__(self, name: str, *args: str | int | Cons | Nil) -> None:
        self.name, self.args = name, args


@dataclass
class Differ:
    """Two terms that are not equal."""

    a: str | int
    b: str | int


@dataclass
class Same:
    """Two terms that are equal."""

    a: str | int
    b: str | int


@dataclass
class Is:
    """Binds a variable to a Column computed from bound ones."""

    variable: str
    value: Callable[..., Column]
    inputs: tuple[str, ...] = ()


@dataclass
class Numeric:
    """The term is a number (else: the test of its name)."""

    term: str
    holds: bool = True


@dataclass
class Atomic:
    """The term is bound to a single value, no list (else: to a list)."""

    term: str
    holds: bool = True


@dataclass
class Cut:
    """Only the first solution so far is pursued."""


def is_variable(term: object) -> bool:
    return isinstance(term, str) and term[:1].isalpha()


def value_of(term: object) -> Column:
    if is_variable(term):
        return F.col(term)
    if isinstance(term, Nil):
        return F.array().cast(LIST)
    if isinstance(term, Cons):
        return F.concat(F.array(value_of(term.head).cast("string")), value_of(term.tail))
    return F.lit(term.strip("'")) if isinstance(term, str) else F.lit(term)


def variables(term: object) -> list[str]:
    if isinstance(term, Cons):
        return [*variables(term.head), *variables(term.tail)]
    return [term] if is_variable(term) else []


def taken_apart(value: Column, term: object) -> tuple[list[Column], list[tuple[str, Column]]]:
    """Conditions on a value, and what its variables are bound to, if it is to be like ``term``."""
    if term == "_":
        return [], []
    if isinstance(term, Nil):
        return [F.size(value) == 0], []
    if isinstance(term, Cons):
        head = taken_apart(F.get(value, F.lit(0)), term.head)
        tail = taken_apart(F.slice(value, F.lit(2), F.greatest(F.size(value) - 1, F.lit(0))), term.tail)
        return [F.size(value) > 0, *head[0], *tail[0]], head[1] + tail[1]
    if is_variable(term):
        return [], [(term, value)]
    return [value == value_of(term)], []


def order_text(c: Column, kind: T.DataType) -> Column:
    """A text whose order is that of the values: numbers with their digits filled up."""
    if isinstance(kind, T.IntegralType):
        return F.lpad((c.cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("string"), 20, "0")
    return F.concat(c.cast("string"), F.lit("\x01"))


def joined_parts(lists: DataFrame) -> DataFrame:
    """(a, b, l): how the lists ``l`` and all their ends part in two, as texts with commas between elements; each once.

    A list becomes a text once.  Its ends, and the parts of these, are pieces of that
    text, so a part costs a copy of its bytes and no step for its elements.  Nulls are
    left out, as in ``array_join``.
    """
    spark = lists.sparkSession
    whole = lists.where("l IS NOT NULL").select(F.array_compact("l").alias("l")).distinct()
    # bytes of the first k elements with their commas, for every k
    upto = F.transform(F.sequence(F.lit(0), F.size("l")), lambda k: F.octet_length(F.array_join(F.slice("l", F.lit(1), k), ",")))
    whole = whole.select(F.array_join("l", ",").cast("binary").alias("t"), upto.alias("upto"), F.size("l").alias("n"))
    whole = whole.select("*", F.octet_length("t").alias("bytes"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # few lists have many ends: a task makes those of some stretches of the lists
    begun = whole.withColumn("first", F.explode(F.sequence(F.lit(0), "n", F.lit(STRETCH)))).repartition(parts)
    ends = begun.withColumn("i", F.explode(F.sequence("first", F.least("n", F.col("first") + STRETCH - 1))))

    def begins(k: Column) -> Column:  # where what follows the first k elements does
        return F.when(k == 0, 0).when(k < F.col("n"), F.get("upto", k) + 1).otherwise(F.col("bytes"))

    def cut(j: Column) -> Column:  # bytes in front and where the rest begins, as one number
        front = F.when(j == F.col("i"), 0).otherwise(F.get("upto", j) - begins(F.col("i")))
        return F.call_function("shiftleft", front.cast("long"), F.lit(32)) + (begins(j) - begins(F.col("i")))

    ends = ends.select(piece_of("t", begins(F.col("i"))).alias("l"), F.transform(F.sequence("i", "n"), cut).alias("cuts"))
    # lists of other elements may have the same text
    once = ends.groupBy("l").agg(F.array_distinct(F.flatten(F.collect_set("cuts"))).alias("cuts"))
    runs = F.transform(F.sequence(F.lit(1), F.size("cuts"), F.lit(RUN)), lambda k: F.slice("cuts", k, F.lit(RUN)))
    spread = once.select("l", F.explode(runs).alias("cuts")).repartition(parts)
    # as what a function makes of an array, rows come one by one; else all of a run are copied first, texts too
    both = lambda c: F.struct(F.call_function("shiftright", c, F.lit(32)).cast("int").alias("front"), c.bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("rest"))
    at = spread.select("l", F.inline(F.transform("cuts", both)))
    return at.select(F.substring("l", F.lit(1), F.col("front")).cast("string").alias("a"), piece_of("l", F.col("rest")).cast("string").alias("b"), F.col("l").cast("string").alias("l"))


def piece_of(binary: str, start: Column) -> Column:
    """What follows the first ``start`` bytes."""
    return F.substring(binary, start + 1, F.octet_length(binary))


class Rules:
    def __init__(self) -> None:
        #: Clauses of a predicate as they were declared: (table, columns, order column) or (head, goals).
        self.clauses: dict[str, list[tuple]] = {}
        self.foreign: dict[str, Callable[..., DataFrame]] = {}
        self.once: set[str] = set()  # facts that have no equal rows
        self.derived: dict[str, DataFrame] = {}  # what is known of predicates that are being derived
        self.new: tuple[str, int, DataFrame] | None = None  # a predicate, the place of one of its goals in a rule, and its new rows

    def fact(self, name: str, df: DataFrame, columns: list[str], order: str | None = None, once: bool = False) -> None:
        """Rows of ``df`` are facts of ``name``, arguments in the order of ``columns``; ``order``: the column that numbers them.

        ``once``: no two rows are the same, and none needs to be told from the others.
        """
        if once:
            self.once.add(name)
        self.clauses.setdefault(name, []).append((df, columns, order))

    def rule(self, name: str, head: list, goals: list) -> None:
        self.clauses.setdefault(name, []).append((head, goals))

    def calls(self, name: str, function: Callable[..., DataFrame]) -> None:
        """A predicate computed by a function of its constant arguments; its columns are positional."""
        self.foreign[name] = function

    def lists(self, df: DataFrame, column: str) -> None:
        """The lists of a column and all their ends become ``cell(list, head, tail)`` and ``list(list)``.

        What rules find by a round for each element is a row of the list at once: what it
        holds, ``element(value, list)``, and how it parts in two, ``parts(front, rest, list)``.
        """
        whole = df.select(F.col(column).cast(LIST).alias("l")).where("l IS NOT NULL").distinct()
        places = whole.select("l", F.explode(F.sequence(F.lit(1), F.size("l") + 1)).alias("k"))  # one end at a time
        ends = saved(df.sparkSession, places.select(F.slice("l", F.col("k"), F.size("l")).alias("l")).distinct(), "lists")
        self.fact("list", ends, ["l"])
        self.fact("cell", ends.where("size(l) > 0").select("l", F.col("l")[0].alias("h"), F.slice("l", F.lit(2), F.size("l")).alias("t")), ["l", "h", "t"])
        held = ends.select(F.explode(F.array_distinct("l")).alias("x"), "l")
        self.fact("element", held, ["x", "l"], once=True)
        spread = ends.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # few lists have many parts
        cut = spread.select("l", F.explode(F.sequence(F.lit(0), F.size("l"))).alias("k"))
        self.fact("parts", cut.select(F.slice("l", F.lit(1), F.col("k")).alias("a"), F.slice("l", F.col("k") + 1, F.size("l")).alias("b"), "l"), ["a", "b", "l"], once=True)

    # -- which predicates belong together

    def called(self, name: str) -> set[str]:
        return {g.name for c in self.clauses.get(name, []) if len(c) == 2 for g in c[1] if isinstance(g, Goal)}

    def reaches(self, name: str) -> set[str]:
        found, todo = set(), list(self.called(name))
        while todo:
            if (n := todo.pop()) not in found:
                found.add(n)
                todo += self.called(n)
        return found

    def circle(self, name: str) -> set[str]:
        """The predicates that ``name`` calls and that call it, itself included; empty if it is not recursive."""
        return {n for n in self.reaches(name) if name in self.reaches(n)}

    def cuts(self, name: str) -> bool:
        return any(len(c) == 2 and any(isinstance(g, Cut) for g in c[1]) for c in self.clauses.get(name, []))

    # -- relations

    def relation(self, goal: Goal, ordered: bool) -> DataFrame:
        """All facts and derived rows of a predicate, with columns c0, c1, ..., and their order if asked for."""
        name = goal.name
        if name not in self.derived and (circle := self.circle(name)):
            return self.valued(self.closure(sorted(circle))[name], ordered)
        if name in self.derived:
            return self.valued(self.derived[name], ordered)
        parts = [self.clause(name, k, ordered) for k in range(len(self.clauses.get(name, [])))]
        if name in self.foreign:
            df = self.foreign[name](*goal.args)
            parts.append(self.valued(df.toDF(*(f"c{i}" for i in range(len(df.columns)))), ordered))
        if not parts:
            raise KeyError(f"no facts or rules for {name}/{len(goal.args)}")
        return reduce(DataFrame.unionByName, parts)

    def valued(self, df: DataFrame, ordered: bool) -> DataFrame:
        """With the values as the order."""
        if not ordered:
            return df
        return df.withColumn(ORDER, F.concat(F.lit(""), *(F.coalesce(order_text(F.col(c), df.schema[c].dataType), F.lit("")) for c in df.columns)))

    def clause(self, name: str, k: int, ordered: bool, state: DataFrame | None = None) -> DataFrame:
        clause = self.clauses[name][k]
        number = F.lpad(F.lit(str(k)), 6, "0")
        if len(clause) == 3:
            df, columns, order = clause
            row = self.valued(df.select(*columns), True)[ORDER] if order is None else None
            made = df.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(columns)), *([order_text(F.col(order), df.schema[order].dataType).alias(ORDER)] if ordered and order else []))
            if ordered and row is not None:
                made = self.valued(made, True)
            return made.withColumn(ORDER, F.concat(number, ORDER)) if ordered else made
        head, goals = clause
        solved = self.solve(goals, ordered, state)
        return solved.select(*(value_of(x).alias(f"c{i}") for i, x in enumerate(head)), *([F.concat(number, ORDER).alias(ORDER)] if ordered else []))

    def closure(self, circle: list[str]) -> dict[str, DataFrame]:
        """All rows of predicates that call each other."""
        if any(self.cuts(n) for n in circle):
            raise ValueError(f"a cut in {', '.join(circle)}, which call each other: there is no first of solutions that are derived from one another")
        own = lambda c: len(c) == 2 and any(isinstance(g, Goal) and g.name in circle for g in c[1])
        known: dict[str, DataFrame] = {}
        new: dict[str, DataFrame] = {}
        for n in circle:
            parts = [self.clause(n, k, False) for k, c in enumerate(self.clauses[n]) if not own(c)]
            if parts:
                rows = reduce(DataFrame.unionByName, parts).distinct()
                new[n] = known[n] = saved(rows.sparkSession, rows, f"rule-{n}")
        rounds = 0
        while new:
            rounds += 1
            found: dict[str, list[DataFrame]] = {}
            before, self.derived = self.derived, self.derived | known
            try:
                for n in circle:
                    for k, c in enumerate(self.clauses[n]):
                        places = [i for i, g in enumerate(c[1]) if isinstance(g, Goal) and g.name in circle] if own(c) else []
                        if any(c[1][i].name not in known for i in places):
                            continue  # a goal without any row
                        for i in places:
                            if c[1][i].name in new:
                                self.new = (n, i, new[c[1][i].name])
                                found.setdefault(n, []).append(self.clause(n, k, False))
                                self.new = None
            finally:
                self.derived, self.new = before, None
            new = {}
            for n, parts in found.items():
                rows = reduce(DataFrame.unionByName, parts).distinct()
                if n in known:
                    same = reduce(lambda a, b: a & b, (rows[c].eqNullSafe(known[n][c]) for c in rows.columns))
                    rows = rows.join(known[n], same, "left_anti")
                rows = saved(rows.sparkSession, rows, f"rule-{n}")
                if not rows.isEmpty():
                    new[n] = rows
                    known[n] = known[n].unionByName(rows) if n in known else rows
                    if rounds % 8 == 0:
                        known[n] = saved(rows.sparkSession, known[n], f"rule-{n}")
        return known

    def answers(self, goal: Goal, state: DataFrame | None) -> DataFrame:
        """As ``relation`` for a predicate with cuts: for each of the values that the goal brings along, clause by clause."""
        bound = {f"c{i}": value_of(t) for i, t in enumerate(goal.args) if t != "_" and not isinstance(t, (Cons, Nil)) and (not is_variable(t) or state is not None and t in state.columns)}
        spark = self.session()
        asked = (state if state is not None else spark.range(1)).select(*(v.alias(c) for c, v in bound.items())).distinct() if bound else spark.range(1).select(F.lit(1).alias("c"))
        asked = saved(spark, asked, "asked")
        parts = []
        for k, clause in enumerate(self.clauses[goal.name]):
            if len(clause) == 3 or not any(isinstance(g, Cut) for g in clause[1]):
                rows = self.clause(goal.name, k, True)
                parts.append(rows.join(asked, list(bound), "left_semi") if bound else rows.join(asked.select(F.lit(1).alias("_one")).limit(1)).drop("_one"))
                continue
            head, goals = clause
            start, names = asked, []
            for c in bound:  # the head's variables begin with what is asked for
                term = head[int(c[1:])]
                if not is_variable(term):
                    start = start.where(F.col(c) == value_of(term))
                elif term in names:
                    start = start.where(F.col(c) == F.col(term))
                else:
                    start, names = start.withColumn(term, F.col(c)), [*names, term]
            at = max(i for i, g in enumerate(goals) if isinstance(g, Cut))
            begun = start.select(*names).distinct() if names else None
            first = self.solve(goals[:at], True, begun, alone=True) if names else self.solve(goals[:at], True)
            order = Window.partitionBy(*names).orderBy(ORDER) if names else None
            reached = first.withColumn("_first", F.row_number().over(order)).where("_first = 1").drop("_first") if names else first.orderBy(ORDER).limit(1)
            reached = saved(spark, reached, "cut")
            rest = self.solve(goals[at + 1 :], True, reached, alone=True)
            rows = rest.select(*(value_of(x).alias(f"c{i}") for i, x in enumerate(head)), F.concat(F.lpad(F.lit(str(k)), 6, "0"), ORDER).alias(ORDER))
            parts.append(rows.join(asked, list(bound), "left_semi") if bound else rows)
            if names:  # those that got past the cut try no other clause
                past = start.join(reached.select(*names).distinct(), names, "left_semi").select(asked.columns)
                asked = saved(spark, asked.join(past, asked.columns, "left_anti"), "asked")
            elif not reached.isEmpty():
                asked = saved(spark, asked.where("false"), "asked")
        return reduce(DataFrame.unionByName, parts)

    def session(self):
        return next(c[0] for some in self.clauses.values() for c in some if len(c) == 3).sparkSession

    # -- goals

    def query(self, goals: list) -> DataFrame:
        """Distinct solutions: one column per variable."""
        ordered = any(isinstance(g, Cut) for g in goals)
        return self.solve(goals, ordered).drop(ORDER)

    def solve(self, goals: list, ordered: bool, state: DataFrame | None = None, alone: bool = False) -> DataFrame:
        """Solutions of the goals, those of ``state`` carried on; each once, with its first order if asked for."""
        new = self.new
        if state is not None and ordered and ORDER not in state.columns:
            state = state.withColumn(ORDER, F.lit(""))
        for place, goal in enumerate(goals):
            if isinstance(goal, Goal):
                if new and place == new[1]:
                    df = new[2]
                elif self.cuts(goal.name):
                    df = self.answers(goal, state)
                    df = df if ordered else df.drop(ORDER)
                else:
                    self.new = None
                    df = self.relation(goal, ordered)
                    self.new = new
                state = self.met(state, df, goal, ordered)
                continue
            if state is None:
                raise ValueError("a test needs a goal before it")
            if isinstance(goal, Differ):
                state = state.where(value_of(goal.a) != value_of(goal.b))
            elif isinstance(goal, Same):
                state = state.where(value_of(goal.a) == value_of(goal.b))
            elif isinstance(goal, Numeric):
                number = F.expr(f"try_cast(`{goal.term}` as double)").isNotNull()
                state = state.where(number if goal.holds else ~number)
            elif isinstance(goal, Atomic):
                single = not isinstance(state.schema[goal.term].dataType, (T.ArrayType, T.StructType))
                state = state.where(F.col(goal.term).isNotNull()) if single == goal.holds else state.where(F.lit(False))
            elif isinstance(goal, Is):
                state = state.withColumn(goal.variable, goal.value(*(F.col(v) for v in goal.inputs)))
            elif isinstance(goal, Cut):
                state = state.orderBy(ORDER).limit(1)
        if not ordered:
            return state if len(goals) == 1 and self.plain(goals[0]) and len(state.columns) == len(goals[0].args) else state.distinct()
        names = [c for c in state.columns if c != ORDER]
        return state.groupBy(*names).agg(F.min(ORDER).alias(ORDER)) if names else state.groupBy().agg(F.min(ORDER).alias(ORDER)).where(F.col(ORDER).isNotNull())

    def plain(self, goal: object) -> bool:
        """Whether a goal's solutions are the rows of a table that has no equal ones."""
        if not isinstance(goal, Goal) or goal.name not in self.once or len(self.clauses[goal.name]) > 1 or goal.name in self.foreign:
            return False
        return all(map(is_variable, goal.args)) and len(set(goal.args)) == len(goal.args)

    def met(self, state: DataFrame | None, df: DataFrame, goal: Goal, ordered: bool) -> DataFrame:
        """The rows of a predicate that are like the goal's terms, joined with the solutions so far."""
        bound: dict[str, Column] = {}
        for i, term in enumerate(goal.args):
            tests, found = taken_apart(F.col(f"c{i}"), term)
            for test in tests:
                df = df.where(test)
            for name, value in found:
                if name in bound:
                    df = df.where(value == bound[name])
                else:
                    bound[name] = value
        names = [v.alias(n) for n, v in bound.items()]
        df = df.select(*names, F.col(ORDER).alias("_more")).groupBy(*bound).agg(F.min("_more").alias("_more")) if ordered and bound else df.select(*names, *([F.col(ORDER).alias("_more")] if ordered else []))
        if not ordered and not self.plain(goal):
            df = df.distinct()
        if state is None:
            return df.withColumnRenamed("_more", ORDER)
        shared = [n for n in bound if n in state.columns]
        both = state.join(df, shared) if shared else state.crossJoin(df)
        return both.withColumn(ORDER, F.concat(ORDER, "_more")).drop("_more") if ordered else both
