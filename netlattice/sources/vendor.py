"""Vendor routing-table dumps to canonical rows (dest, gateway, interface, tag).

All functions take (path, line, value): numbered lines of whole files.  A file may
be of any size: what a line inherits from earlier ones, or needs of its neighbours,
is found inside stretches of ``STRETCH`` lines, and handed from stretch to stretch
by one row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netlattice.functions.ip import ip_to_long, netmask_to_width, prefix_ip, prefix_width
from netlattice.sources.scratch import saved

IP = r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"


#: Lines of a file that are one window.
STRETCH = 1 << 16


def stretched(lines: DataFrame, stretch: int) -> DataFrame:
    return lines.withColumn("_stretch", F.floor(F.col("line") / stretch).cast("int"))


def in_stretch() -> Window:
    return Window.partitionBy("path", "_stretch").orderBy("line")


def fill_down(lines: DataFrame, values: dict[str, Column], stretch: int | None = None) -> DataFrame:
    """Adds each value, or where it is null the last one above it in the file."""
    rows = stretched(lines.select("*", *(v.alias(n) for n, v in values.items())), stretch or STRETCH)
    last = rows.groupBy("path", "_stretch").agg(*(F.max_by(n, F.when(F.col(n).isNotNull(), F.col("line"))).alias(f"_last_{n}") for n in values))
    above = Window.partitionBy("path").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("path", "_stretch", *(F.last(f"_last_{n}", ignorenulls=True).over(above).alias(f"_carried_{n}") for n in values))
    here = in_stretch().rowsBetween(Window.unboundedPreceding, 0)
    own = rows.withColumns({n: F.last(n, ignorenulls=True).over(here) for n in values}).join(carried, ["path", "_stretch"])
    return own.withColumns({n: F.coalesce(n, f"_carried_{n}") for n in values}).drop("_stretch", *(f"_carried_{n}" for n in values))


def beside(lines: DataFrame, before: dict[str, str], after_: dict[str, str], stretch: int | None = None) -> DataFrame:
    """Adds columns of the line before and the line after: {column: its name here}."""
    rows = stretched(lines, stretch or STRETCH)
    first = [F.min_by(c, "line").alias(f"_first_{c}") for c in after_]
    last = [F.max_by(c, "line").alias(f"_last_{c}") for c in before]
    ends, by_stretch = rows.groupBy("path", "_stretch").agg(*first, *last), Window.partitionBy("path").orderBy("_stretch")
    ends = ends.select("path", "_stretch", *(F.lead(f"_first_{c}").over(by_stretch).alias(f"_beyond_{n}") for c, n in after_.items()), *(F.lag(f"_last_{c}").over(by_stretch).alias(f"_beyond_{n}") for c, n in before.items()))
    inner = {n: F.lag(c).over(in_stretch()) for c, n in before.items()} | {n: F.lead(c).over(in_stretch()) for c, n in after_.items()}
    edge = {n: F.lag("line").over(in_stretch()).isNull() for n in before.values()} | {n: F.lead("line").over(in_stretch()).isNull() for n in after_.values()}
    found = rows.withColumns(inner | {f"_edge_{n}": e for n, e in edge.items()}).join(ends, ["path", "_stretch"])
    return found.withColumns({n: F.when(F.col(f"_edge_{n}"), F.col(f"_beyond_{n}")).otherwise(F.col(n)) for n in inner}).drop("_stretch", *(f"{x}_{n}" for n in inner for x in ("_edge", "_beyond")))


#: Route codes as `show ip route` prints them, and their short forms; others keep theirs.
ROUTE_CODES = {"O IA": "Oi", "O E2": "O2", "C": "D"}
#: Protocols as `show route` prints them.
PROTOCOLS = {"OSPF": "O", "Direct": "D", "Static": "S", "Local": "DL"}


def mapped(value: Column, names: dict[str, str]) -> Column:
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return F.coalesce(table[value], value)


def words(line: Column) -> Column:
    """The line's words, without commas."""
    return F.filter(F.split(F.translate(line, ",", " "), "\\s+"), lambda w: w != "")


def after(tokens: Column, word: str) -> Column:
    """The word that follows the first ``word``; null if there is none."""
    at = F.array_position(tokens, word).cast("int")
    return F.when(at > 0, F.get(tokens, at))


def is_address(word: Column) -> Column:
    """A dotted address, with a width or without."""
    return F.coalesce(F.size(F.split(word, "[.]")) == 4, F.lit(False)) & F.coalesce(F.translate(word, "0123456789./", "") == "", F.lit(False))


def interface_name(name: Column) -> Column:
    return F.replace(name, F.lit("Loopback"), F.lit("loopback"))


def route_line(tokens: Column) -> dict[str, Column]:
    """What the words of a line of `show ip route` say: its code's words, address and width."""
    # the code stands before the address, or before the metric where the address is left out
    metric = F.filter(tokens, lambda w: w.startswith("[") & w.endswith("]"))
    address = F.get(F.filter(tokens, is_address), F.lit(0))
    first = F.get(tokens, F.lit(0))
    has_own = F.coalesce(F.array_position(tokens, address) < F.coalesce(F.nullif(F.array_position(tokens, F.get(metric, F.lit(0))), F.lit(0)), F.lit(1 << 30)), F.lit(False))
    own = F.when(has_own, address)
    before = F.array_position(tokens, F.coalesce(own, F.get(metric, F.lit(0)))).cast("int") - 1
    code = F.when(before > 0, F.slice(tokens, 1, before))
    return {"first": first, "code": code, "address": F.split(own, "/")[0], "width": F.get(F.split(own, "/"), F.lit(1)), "metric": F.get(metric, F.lit(0))}


def route_tag(code: Column) -> Column:
    """A route's code by ``ROUTE_CODES``, whole or word by word, joined by '|'; a star marks default candidates and is no code."""
    letters = words(F.translate(F.array_join(code, " "), "*", " "))
    whole = F.array_join(letters, " ")
    return F.when(whole.isin(*ROUTE_CODES), mapped(whole, ROUTE_CODES)).otherwise(F.array_join(F.transform(letters, lambda w: mapped(w, ROUTE_CODES)), "|"))


def joined_lines(lines: DataFrame) -> DataFrame:
    """Lines that were wrapped after the destination are put together: the next line, if it goes on with the metric, is appended."""
    tokens = words(F.col("value"))
    open_ = F.col("value").substr(1, 1) != " "
    ends = open_ & is_address(F.element_at(tokens, -1)) & ~F.array_contains(tokens, "via")
    goes_on = F.ltrim("value").startswith("[")
    marked = lines.select("*", F.coalesce(ends, F.lit(False)).alias("_ends"), goes_on.alias("_on"))
    marked = beside(saved(lines.sparkSession, marked, "marked-lines"), {"_ends": "_prev_ends"}, {"_on": "_next_on", "value": "_next"})
    whole = F.when(F.col("_ends") & F.col("_next_on"), F.concat(F.rtrim("value"), F.lit(" "), F.ltrim("_next"))).otherwise(F.col("value"))
    rest = F.coalesce(F.col("_prev_ends") & F.col("_on"), F.lit(False))
    return marked.where(~rest).withColumn("value", whole).drop("_ends", "_on", "_next_on", "_next", "_prev_ends")


def cisco(lines: DataFrame) -> DataFrame:
    """(path, line, dest, gateway, interface, tag) of a `show ip route` dump.

    Subnet headers give their width, and entries their code, address and width, to
    the lines after them that leave them out.  Static routes without an interface
    get that of the first connected prefix that holds their gateway.
    """
    rows = joined_lines(lines.where(~F.ltrim("value").startswith("--")))
    started = lines.where(F.col("value").startswith("Gateway")).groupBy("path").agg(F.max("line").alias("_start"))
    rows = rows.join(started, "path", "left").where(F.col("line") > F.coalesce("_start", F.lit(-1)))
    # words once for each line, all else from them
    said = route_line(F.col("_tokens"))
    rows = rows.select("path", "line", words(F.col("value")).alias("_tokens"))
    rows = rows.select("path", "line", "_tokens", *(c.alias(f"_{n}") for n, c in said.items()))
    tokens, own, code = F.col("_tokens"), F.col("_address"), F.col("_code")
    rest = F.size(tokens) - F.array_position(tokens, "via") - 1  # words after the gateway: age and interface, or none
    direct = F.array_contains(tokens, "directly") & F.array_contains(tokens, "connected") & own.isNotNull() & code.isNotNull()
    via = F.col("_metric").isNotNull() & F.array_contains(tokens, "via") & is_address(after(tokens, "via"))
    kind = F.when(direct, "direct").when(via & (rest >= 2), "via").when(via & (rest == 0) & own.isNotNull() & code.isNotNull(), "static")
    header = F.when(is_address(F.col("_first")) & (F.get(tokens, F.lit(1)) == "is") & (F.get(tokens, F.lit(2)) == "subnetted"), F.get(F.split("_first", "/"), F.lit(1)))
    rows = rows.select("*", kind.alias("kind"), header.alias("_header"))
    routed = F.col("kind").isNotNull()
    own_tag = F.when(routed & code.isNotNull(), route_tag(code))
    is_via = F.col("kind") == "via"
    parsed = rows.select(
        "path",
        "line",
        "kind",
        F.when(is_via, own).alias("_via_ip"),
        F.when(~is_via, own).alias("own_ip"),
        F.coalesce("_header", F.when(routed, F.col("_width"))).alias("_width"),
        own_tag.alias("own_tag"),
        F.when(F.col("kind") == "direct", "DIRECT").otherwise(after(tokens, "via")).alias("gateway"),
        interface_name(F.when(F.col("kind") != "static", F.element_at(tokens, -1))).alias("interface"),
    ).where("kind is not null OR _width is not null")
    parsed = saved(lines.sparkSession, parsed, "parsed-lines")
    parsed = fill_down(parsed, {"via_ip": F.col("_via_ip"), "width": F.col("_width"), "via_tag": F.when(is_via, F.col("own_tag"))}).where("kind is not null")
    parsed = parsed.withColumn("tag", F.when(is_via, F.col("via_tag")).otherwise(F.col("own_tag")))
    out = parsed.select("path", "line", F.concat(F.coalesce("own_ip", "via_ip"), F.lit("/"), F.col("width")).alias("dest"), "gateway", "interface", F.coalesce("tag", F.lit("")).alias("tag"))
    return with_interfaces(out)


def with_interfaces(routes: DataFrame) -> DataFrame:
    """Fills missing interfaces per file from the first known prefix that contains the gateway."""
    known = routes.where("interface is not null").select("path", prefix_ip(F.col("dest")).alias("lo"), prefix_width(F.col("dest")).alias("width"), "interface", "line")
    missing = routes.where("interface is null").select(F.struct("path", "line").alias("id"), "path", ip_to_long(F.col("gateway")).alias("gateway"))
    from netlattice.operators.lpm import under_prefixes

    first = known.groupBy("path", "lo", "width").agg(F.min_by("interface", "line").alias("interface"), F.min("line").alias("line"))
    missing = missing.repartition(int(missing.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")  # a task orders its share
    hit = under_prefixes(missing, first, at="gateway", on=["path"]).groupBy("id").agg(F.min_by("p_interface", "p_line").alias("filled"))
    return routes.join(hit.select("id.path", "id.line", "filled"), ["path", "line"], "left").select("path", "line", "dest", "gateway", F.coalesce("interface", "filled").alias("interface"), "tag")


def fixed(value: Column, start: int, length: int) -> Column:
    return F.trim(F.substring(value, start, length))


def foundry(lines: DataFrame) -> DataFrame:
    """(path, line, dest, gateway, interface, tag) of fixed-width dumps; the layout is told by a word anywhere in the file."""
    layout = lines.groupBy("path").agg(F.bool_or(F.col("value").contains("Uptime")).alias("_new"), F.bool_or(F.col("value").contains("NetMask")).alias("_mask"))
    rows = lines.where(F.col("value").rlike(IP)).join(layout, "path")
    v = F.col("value")
    # columns: start and length in the old and the new layout
    old = [(8, 19), (28, 16), (44, 11), (62, 5)]
    new = [(8, 20), (28, 16), (44, 12), (70, 5)]
    plain = [F.when(F.col("_new"), fixed(v, *n)).otherwise(fixed(v, *o)) for o, n in zip(old, new, strict=True)]
    # with netmask: widths 8 16 15 16 11 7 4
    address, mask, gateway, port, kind = (fixed(v, *x) for x in ((9, 16), (25, 15), (40, 16), (56, 11), (74, 4)))
    with_mask = F.col("_mask") & ~F.col("_new")
    gateway = F.replace(F.when(gateway.isin("0.0.0.0", "255.255.255.255"), F.lit("DIRECT")).otherwise(gateway), F.lit("*"), F.lit(""))
    dest = F.concat(address, F.lit("/"), netmask_to_width(F.when(with_mask, mask)).cast("string"))
    pairs = zip(("dest", "gateway", "interface", "tag"), (dest, gateway, port, kind), plain, strict=True)
    return rows.select("path", "line", *(F.when(with_mask, m).otherwise(p).alias(n) for n, m, p in pairs))


def junos(lines: DataFrame) -> DataFrame:
    """(path, line, dest, gateway, interface, tag) of a `show route` dump: the first table only, IPv4 without multicast.

    An entry's first line has the destination and the protocol in brackets; next
    hops follow, each with its words for gateway and interface.
    """
    tokens = words(F.col("value"))
    table = F.when(F.array_contains("t", "destinations"), F.get("t", F.lit(0)))  # "inet.0: 5 destinations"
    t, first = F.col("t"), F.get("t", F.lit(0))
    entry = is_address(first)
    bracket = F.get(F.filter(t, lambda w: F.instr(w, "[") > 0), F.lit(0))
    rows = saved(lines.sparkSession, lines.select("path", "line", tokens.alias("t")), "tokens")
    proto = F.substring_index(F.substring_index(bracket, "[", -1), "/", 1)
    rows = fill_down(rows, {"table": table, "dest": F.when(entry, first), "proto": F.when(entry, proto)})
    rows = rows.where((F.coalesce(F.col("table"), F.lit("inet.0:")) == "inet.0:") & ~F.col("dest").startswith("224."))
    to, via = after(t, "to"), after(t, "via")
    reject, local = F.array_contains(t, "Reject"), F.get(t, F.lit(0)) == "Local"
    named = F.when(via.startswith("lo"), F.concat(F.lit("loopback"), F.substring(via, 3, 100))).otherwise(via)
    interface = F.when(reject, "drop").when(local, F.concat(F.lit("loopback-"), via)).otherwise(named)
    gateway = F.when(to.isNotNull() & ~local & ~reject, to).otherwise(F.lit("DIRECT"))
    parsed = rows.select("path", "line", "dest", gateway.alias("gateway"), interface.alias("interface"), mapped(F.col("proto"), PROTOCOLS).alias("tag"))
    return parsed.where("dest is not null and interface is not null")


def interface_addresses(lines: DataFrame, local_only: bool = False) -> DataFrame:
    """(path, ips): a resolver line per interface dump, its distinct IPv4 addresses in order; ``local_only``: those after 'Local:'."""
    pattern = rf"Local: ({IP})" if local_only else rf"({IP})"
    ips = lines.select("path", F.explode(F.regexp_extract_all("value", F.lit(pattern), 1)).alias("ip"))
    return ips.groupBy("path").agg(F.array_join(F.array_sort(F.collect_set("ip")), ",").alias("ips"))
