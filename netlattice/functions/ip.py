"""IPv4 addresses and prefixes as Column expressions.

Addresses are LONG in [0, 2**32).  A prefix is (lo, width, hi): the half-open
range of its addresses; ``lo`` of a canonical prefix has no host bits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ALL = 1 << 32


def long(x: Column | int) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("long")


def ip_to_long(text: Column) -> Column:
    octets = F.split(text, "[.]")
    return reduce(lambda acc, i: acc * 256 + octets[i].cast("long"), range(1, 4), octets[0].cast("long"))


def long_to_ip(ip: Column) -> Column:
    """Dotted form; null for a null address."""
    octets = F.concat_ws(".", *(F.shiftrightunsigned(ip, by).bitwiseAND(F.lit(255)).cast("string") for by in (24, 16, 8, 0)))
    return F.when(ip.isNotNull(), octets)  # concat_ws skips nulls


def hosts(width: Column) -> Column:
    """Number of addresses under a prefix of that width."""
    return F.call_function("shiftleft", long(1), (F.lit(32) - width).cast("int"))


def mask(width: Column) -> Column:
    return long(ALL) - hosts(width)


def network(ip: Column, width: Column) -> Column:
    """The address without its host bits."""
    return ip - ip % hosts(width)


def prefix_ip(text: Column) -> Column:
    return ip_to_long(F.split(text, "/")[0])


def prefix_width(text: Column) -> Column:
    return F.split(text, "/")[1].cast("int")


def prefix_text(ip: Column, width: Column) -> Column:
    return F.concat(long_to_ip(ip), F.lit("/"), width.cast("string"))


def contains(ip: Column, width: Column, other_ip: Column, other_width: Column) -> Column:
    """Whether prefix (ip, width) covers (other_ip, other_width); host bits do not count."""
    return (width <= other_width) & (network(ip, width) == network(other_ip, width))


def matches(ip: Column, width: Column, address: Column) -> Column:
    """Predicate of a prefix on an address as policies use it: with host bits set it never holds."""
    return network(address, width) == ip


def netmask_to_width(mask_text: Column) -> Column:
    """Length of the prefix that a (contiguous) dotted mask stands for."""
    return F.length(F.rtrim(F.bin(ip_to_long(mask_text)), F.lit("0")))


def bit_length(x: Column) -> Column:
    return F.when(x == 0, 0).otherwise(F.length(F.bin(x)))


def trailing_zeros(x: Column) -> Column:
    """Zero bits below the lowest one; 32 for 0, the width of an address."""
    return F.when(x == 0, 32).otherwise(F.length(F.bin(x)) - F.length(F.rtrim(F.bin(x), F.lit("0"))))


def hex_ip_rewrite(line: Column) -> Column:
    """Every run of eight lower-case hex digits becomes the dotted form of the first such run."""
    first = F.regexp_extract(line, "([0-9a-f]{8})", 1)
    dotted = long_to_ip(F.conv(first, 16, 10).cast("long"))
    return F.when(first == "", line).otherwise(F.regexp_replace(line, F.lit("[0-9a-f]{8}"), dotted))
