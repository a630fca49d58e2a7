"""Sets of packet headers as boxes: an atom of the routed field, and an interval of every other field.

A product of all fields' atoms grows with every constant of every rule.  Here
only the routed field is cut into atoms (one dimension); the other fields are cut
where a rule that holds for the atom cuts them, and nowhere else.  What an
interface lets through is a few boxes, and so is what any change of headers
makes of a box, backward: a field that stays keeps its interval, one that is set
or free becomes the whole field.

Columns of a box over fields 0, 1, ..: ``atom`` (the routed field's atom by its
lowest value, or ANY), and lo1, hi1, lo2, hi2, ..
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlattice.functions.ip import long
from netlattice.operators.lpm import forwarding, in_ranges
from netlattice.sources.scratch import freed, saved

#: In place of an atom: every value of the routed field.
ANY = -1
#: Rows whose boxes are made at once.
ROWS = 1 << 13
KEYS = ["router", "if_id"]

Box = tuple[tuple[int, int], ...]


def sides(widths: list[int]) -> list[str]:
    return [f"{end}{i}" for i in range(1, len(widths)) for end in ("lo", "hi")]


def whole(widths: list[int]) -> Box:
    return tuple((0, 1 << w) for w in widths[1:])


def let_through(rules: tuple[tuple[str, Box], ...], full: Box) -> list[Box]:
    """Disjoint boxes of what the first rule that holds accepts, or no rule holds for."""
    left, accepted = [full], []
    for action, rule in rules:
        rest = []
        for box in left:
            met = tuple((max(a, c), min(b, d)) for (a, b), (c, d) in zip(box, rule, strict=True))
            if any(lo >= hi for lo, hi in met):
                rest.append(box)
                continue
            if action == "accept":
                accepted.append(met)
            for i, ((a, b), (c, d)) in enumerate(zip(box, met, strict=True)):  # what lies beside, one field after the other
                rest += [met[:i] + ((lo, hi),) + box[i + 1 :] for lo, hi in ((a, c), (d, b)) if lo < hi]
        left = rest
    return accepted + left


def permitted_boxes(batches: Iterator[pa.RecordBatch], widths: list[int]) -> Iterator[pa.RecordBatch]:
    """Rows (router, if_id, atom, rules) -> rows with the boxes that the rules let through.

    ``rules`` is a text, so that a batch is worked on once for each of its different lists.
    """
    full = whole(widths)

    @lru_cache(maxsize=10_000)
    def boxes(text: str) -> np.ndarray:
        rules = sorted((int(seq), action, tuple(map(int, ends))) for seq, action, *ends in (r.split(",") for r in text.split(";") if r))
        found = let_through(tuple((action, tuple(zip(ends[::2], ends[1::2], strict=True))) for _, action, ends in rules), full)
        return np.array([[x for ends in box for x in ends] for box in found], np.int64).reshape(-1, 2 * len(full))

    names = ["router", "if_id", "atom", *sides(widths)]
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            coded = part.column(3).dictionary_encode()
            lists = [boxes(text) for text in coded.dictionary.to_pylist()]
            sizes = np.array([len(x) for x in lists], np.int64)
            begins = np.cumsum(sizes) - sizes
            kind = coded.indices.to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(part.num_rows), sizes[kind])  # each row once for every box of its list
            place = np.arange(len(row)) - np.repeat(np.cumsum(sizes[kind]) - sizes[kind], sizes[kind]) + begins[kind][row]
            ends = np.concatenate(lists)[place]
            kept = [part.column(k).take(pa.array(row)) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(ends[:, k]) for k in range(ends.shape[1]))], names=names)


def rule_boxes(acl: DataFrame, widths: list[int]) -> DataFrame:
    """(router, if_id, seq, action, lo0, hi0, lo1, ..): a rule's conditions as one range per field, the whole field where it has none.

    Of an interface's rules with the same box only the first is left, and none whose box is empty.
    """
    ends = []
    for i, w in enumerate(widths):
        here = F.col("field") == i
        ends += [F.coalesce(F.max(F.when(here, F.col("lo"))), long(0)).alias(f"lo{i}"), F.coalesce(F.min(F.when(here, F.col("hi"))), long(1 << w)).alias(f"hi{i}")]
    boxes = acl.groupBy(*KEYS, "seq", "action").agg(*ends).where(" AND ".join(f"lo{i} < hi{i}" for i in range(len(widths))))
    names = [f"{end}{i}" for i in range(len(widths)) for end in ("lo", "hi")]
    first = boxes.groupBy(*KEYS, *names).agg(F.min(F.struct("seq", "action")).alias("rule"))
    return first.select(*KEYS, "rule.seq", "rule.action", *names)


def sendable(fib: DataFrame, acl: DataFrame, atoms: DataFrame, widths: list[int], share: int = 1) -> DataFrame:
    """(router, if_id, box): what leaves by an interface, routed by longest match and let through by its access list.

    ``fib``: router, if_id, lo, width; ``acl``: router, if_id, seq, action, field, lo, hi;
    ``atoms``: lo, hi of the routed field.  Rules meet atoms by prefixes of their range
    in the routed field; those without one are a list of the interface, no row for each atom.
    ``share``: only one in so many atoms.
    """
    routed = forwarding(fib.select(F.col("router").alias("node"), "lo", "width", F.col("if_id").alias("nh")), atoms)
    routed = routed.select(F.col("src").alias("router"), F.col("dst").alias("if_id"), F.col("cls").alias("atom")).where(in_share("atom", share))
    rules = rule_boxes(acl, widths).withColumn("rule", F.concat_ws(",", "seq", "action", *sides(widths)))
    every = (F.col("lo0") == 0) & (F.col("hi0") == 1 << widths[0])
    narrow = rules.where(~every).withColumnsRenamed({"lo0": "lo", "hi0": "hi"})
    narrow = in_ranges(atoms.select(F.col("lo").alias("atom")).where(in_share("atom", share)), narrow, "atom", [*KEYS, "rule"])
    listed = lambda rows, keys, name: rows.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("rule")), ";").alias(name))
    schema = "router int, if_id int, atom long, " + ", ".join(f"{s} long" for s in sides(widths))
    rows = routed.join(listed(narrow, [*KEYS, "atom"], "some"), [*KEYS, "atom"], "left").join(listed(rules.where(every), KEYS, "always"), KEYS, "left")
    rows = rows.select(*(F.col(k).cast("int").alias(k) for k in KEYS), "atom", F.concat_ws(";", "some", "always").alias("rules"))
    return rows.mapInArrow(lambda it: permitted_boxes(it, widths), schema)


def in_share(atom: str, share: int) -> Column:
    """Whether an atom is among the one in ``share`` that are looked at."""
    return F.lit(True) if share == 1 else F.pmod(F.xxhash64(atom), F.lit(share)) == 0


class Changes:
    """What interfaces do to headers, applied backward to boxes that have left by them."""

    def __init__(self, atoms: DataFrame, nat: DataFrame, setfield: DataFrame, widths: list[int]) -> None:
        self.widths = widths
        fields = range(len(widths))
        has = lambda i, what: F.coalesce(F.max(F.when((F.col("field") == i) & (F.col("op") == "identical"), True)), F.lit(False)).alias(what)
        only = lambda i, c, f, w: F.coalesce(f(F.when((F.col("field") == i) & (F.col("op") != "identical"), F.col(c))), long(w))
        sets = setfield.groupBy(*KEYS).agg(
            F.lit(True).alias("set_"), *(has(i, f"same{i}") for i in fields),
            *(only(i, "lo", F.max, 0).alias(f"from{i}") for i in fields), *(only(i, "hi", F.min, 1 << w).alias(f"to{i}") for i, w in enumerate(widths)),
        )
        both = sets.join(nat.select(*KEYS).distinct().withColumn("nat_", F.lit(True)), KEYS, "full")
        fill = {f"same{i}": False for i in fields} | {f"from{i}": 0 for i in fields} | {f"to{i}": 1 << w for i, w in enumerate(widths)}
        self.config = both.na.fill(fill | {"set_": False, "nat_": False})
        points = atoms.select(F.col("lo").alias("atom"))
        rules = nat.select(*KEYS, "in_lo", "in_hi", "out_lo", "out_hi").distinct()
        pick = lambda side: in_ranges(points, rules.select(*KEYS, "in_lo", "in_hi", "out_lo", "out_hi", F.col(f"{side}_lo").alias("lo"), F.col(f"{side}_hi").alias("hi")), "atom", [*KEYS, "in_lo", "in_hi", "out_lo", "out_hi"])
        self.rule = [*KEYS, "in_lo", "in_hi", "out_lo", "out_hi"]
        self.before, self.after = pick("in"), pick("out")

    def undone(self, left: DataFrame, keys: list[str]) -> DataFrame:
        """Boxes before the change of the interface they left by; ``keys`` (which name it) are carried along.

        A rewritten address goes through its rule, so that no pair of atoms is made.
        """
        w = self.widths
        rows = left.join(self.config, KEYS, "left").withColumn("plain", F.col("set_").isNull())
        fits = reduce(lambda a, b: a & b, (F.greatest(f"lo{i}", f"from{i}") < F.least(f"hi{i}", f"to{i}") for i in range(1, len(w))), (F.col("atom") >= F.col("from0")) & (F.col("atom") < F.col("to0")))
        rows = rows.where(F.col("plain") | fits)

        def end(i: int, side: str) -> Column:
            kept, whole_ = F.greatest(f"lo{i}", f"from{i}") if side == "lo" else F.least(f"hi{i}", f"to{i}"), long(0 if side == "lo" else 1 << w[i])
            return F.when(F.col("plain"), F.col(f"{side}{i}")).when(F.col(f"same{i}"), kept).otherwise(whole_).alias(f"{side}{i}")

        ends = [end(i, side) for i in range(1, len(w)) for side in ("lo", "hi")]
        rows = rows.select(*dict.fromkeys([*keys, *KEYS]), "atom", *ends, "plain", F.coalesce("same0", F.lit(False)).alias("same"), F.coalesce("nat_", F.lit(False)).alias("nat"))
        box = [*keys, "atom", *sides(w)]
        stay = rows.where("plain OR (same AND NOT nat)").select(box)
        free = rows.where("NOT plain AND NOT same AND NOT nat").withColumn("atom", long(ANY)).select(box)
        natted = rows.where("nat").join(self.after, [*KEYS, "atom"])
        held = natted.where("same").join(self.before, [*self.rule, "atom"]).select(box)
        moved = natted.where("NOT same").drop("atom").select(*dict.fromkeys([*keys, *self.rule]), *sides(w)).distinct().join(self.before, self.rule).select(box)
        return stay.unionByName(free).unionByName(held).unionByName(moved).distinct()


def reaching(links: DataFrame, changes: Changes, targets: DataFrame, bound: int, arriving: dict[int, tuple[int, int]] | None = None, asked: DataFrame | None = None) -> DataFrame:
    """(dst, node, box, hop): packets at ``node`` that get to ``dst`` within ``bound`` edges, one row per box with its first hop.

    ``links``: router, if_id, nexthop, box (what leaves); ``targets``: dst;
    ``arriving``: ranges of fields that a packet must have where it arrives.  Goes
    backward; a box that lies in a known one is no news.  ``asked`` (src, dst): all that
    is wanted is whether there is a packet for these pairs, so a target is done once
    every ``src`` asked for has one.
    """
    spark, w = links.sparkSession, changes.widths
    ends = sides(w)
    first = links.join(targets, links["nexthop"] == targets["dst"])
    for i, (lo, hi) in (arriving or {}).items():
        if i == 0:
            first = first.where(F.col("atom").between(lo, hi - 1))
        else:
            first = first.withColumns({f"lo{i}": F.greatest(f"lo{i}", long(lo)), f"hi{i}": F.least(f"hi{i}", long(hi))}).where(f"lo{i} < hi{i}")
    state = ["dst", "node", "atom", *ends]

    def undone(left: DataFrame) -> DataFrame:
        return changes.undone(left, ["dst", "router"]).withColumnRenamed("router", "node").select(state).distinct()

    def unknown(new: DataFrame, known: DataFrame) -> DataFrame:
        old = known.select(*(F.col(c).alias(f"k_{c}") for c in state))
        inside = reduce(lambda a, b: a & b, ((F.col(f"lo{i}") >= F.col(f"k_lo{i}")) & (F.col(f"hi{i}") <= F.col(f"k_hi{i}")) for i in range(1, len(w))), F.lit(True))
        there = (F.col("dst") == F.col("k_dst")) & (F.col("node") == F.col("k_node")) & inside
        return new.join(old, there & (F.col("atom") == F.col("k_atom")), "left_anti").join(old.where(F.col("k_atom") == ANY), there, "left_anti")

    known = frontier = saved(spark, undone(first).withColumn("hop", F.lit(1)), "boxes")
    parts = [known]
    news = frontier
    for hop in range(2, bound + 1):
        if asked is not None:
            found = frontier.select(F.col("node").alias("src"), "dst").distinct()
            asked = saved(spark, asked.join(found, ["src", "dst"], "left_anti"), "asked-pairs")
            if asked.isEmpty():
                break
            news = frontier.join(asked.select("dst").distinct(), "dst", "left_semi")
        here = news.select(F.col("dst"), F.col("node").alias("nexthop"), F.col("atom").alias("f_atom"), *(F.col(e).alias(f"f_{e}") for e in ends))
        met = links.join(here.where(F.col("f_atom") != ANY).withColumnRenamed("f_atom", "atom"), ["nexthop", "atom"])
        met = met.unionByName(links.join(here.where(F.col("f_atom") == ANY).drop("f_atom"), "nexthop"))
        cut = met.select("dst", *KEYS, "atom", *(F.greatest(f"lo{i}", f"f_lo{i}").alias(f"lo{i}") if e == "lo" else F.least(f"hi{i}", f"f_hi{i}").alias(f"hi{i}") for i in range(1, len(w)) for e in ("lo", "hi")))
        cut = cut.where(" AND ".join(f"lo{i} < hi{i}" for i in range(1, len(w))) or "true")
        new = unknown(undone(cut), known).withColumn("hop", F.lit(hop))
        news = frontier = saved(spark, new, "boxes")
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
        parts.append(frontier)
        if hop % 8 == 0:
            known = saved(spark, known, "boxes-known")
            freed(*parts[:-1])
            parts = [known]
    return known
