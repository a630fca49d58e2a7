"""Elementary intervals (atoms) of an address field, and ranges rebuilt from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netlattice.functions.ip import ALL, long
from netlattice.sources.scratch import saved

#: Addresses per bucket when neighbours are looked up; 2**16 buckets cover the field.
STRETCH = 1 << 16


def endpoints(*ranges: DataFrame) -> DataFrame:
    """(x): all ``lo`` and ``hi`` of the given tables, with the ends of the field."""
    spark = ranges[0].sparkSession
    ends = spark.createDataFrame([(0,), (ALL,)], "x long")
    for r in ranges:
        ends = ends.unionByName(r.select(F.explode(F.array(long(F.col("lo")), long(F.col("hi")))).alias("x")))
    return ends.distinct()


def followed(x: DataFrame, stretch: int = STRETCH, keys: list[str] | None = None) -> DataFrame:
    """(keys, x, next): each distinct value of a key with the next larger one, null for the largest.

    Neighbours are found inside stretches of the values, which are windows of
    their own; only the first value of each stretch (at most ALL / STRETCH rows a
    key) passes through one task.
    """
    keys = keys or []
    cut = x.select(*keys, "x", F.floor(F.col("x") / stretch).cast("long").alias("stretch"))
    inner = F.lead("x").over(Window.partitionBy(*keys, "stretch").orderBy("x"))
    firsts = cut.groupBy(*keys, "stretch").agg(F.min("x").alias("first"))
    following = firsts.select(*keys, "stretch", F.lead("first").over(Window.partitionBy(*keys).orderBy("stretch")).alias("beyond"))
    return cut.withColumn("next", inner).join(following, [*keys, "stretch"]).select(*keys, "x", F.coalesce("next", "beyond").alias("next"))


def numbered(x: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """(x, number): distinct values with their place in the order, from 0; counted by stretches as in ``followed``."""
    cut = x.select("x", F.floor(F.col("x") / stretch).cast("long").alias("stretch"))
    before = Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    base = cut.groupBy("stretch").agg(F.count(F.lit(1)).alias("n")).select("stretch", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy("stretch").orderBy("x")) - 1
    return cut.withColumn("place", place).join(base, "stretch").select("x", (F.col("base") + F.col("place")).alias("number"))


def atoms(*ranges: DataFrame) -> DataFrame:
    """(lo, hi): the intervals between neighbouring endpoints."""
    return followed(endpoints(*ranges)).where("next is not null").select(F.col("x").alias("lo"), F.col("next").alias("hi"))


def coalesced(df: DataFrame, keys: list[str], stretch: int = STRETCH) -> DataFrame:
    """(keys, lo, hi): overlapping or adjacent ranges of one key become one.

    Islands are found inside stretches of ``lo``, so that a hot key spreads over
    tasks.  How far the stretches before reach, and how many islands they begin,
    are windows over one row for each key and stretch.
    """
    rows = df.select(*keys, "lo", "hi", F.floor(F.col("lo") / stretch).cast("long").alias("stretch"))
    at = Window.partitionBy(*keys, "stretch").orderBy("lo", "hi")
    earlier = Window.partitionBy(*keys).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    reached = rows.groupBy(*keys, "stretch").agg(F.max("hi").alias("far")).select(*keys, "stretch", F.max("far").over(earlier).alias("before"))
    reach = F.greatest(F.max("hi").over(at.rowsBetween(Window.unboundedPreceding, -1)), "before")
    new = F.when(reach.isNull() | (F.col("lo") > reach), 1).otherwise(0)
    begun = rows.join(reached, [*keys, "stretch"]).withColumn("new", new)
    begun = saved(df.sparkSession, begun.withColumn("inner", F.sum("new").over(at.rowsBetween(Window.unboundedPreceding, 0))), "islands")
    counts = begun.groupBy(*keys, "stretch").agg(F.sum("new").alias("n")).select(*keys, "stretch", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    islands = begun.join(counts, [*keys, "stretch"]).withColumn("island", F.col("base") + F.col("inner"))
    return islands.groupBy(*keys, "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("island")


def cidrs(lo: Column, hi: Column) -> Column:
    """array<struct<lo,width>>: the fewest prefixes that cover [lo, hi), in order.

    Of the blocks of one size that lie in the range, only the first and the last can be
    halves of a block that does not: the first if its number is odd, the last if its
    is even.  What is left are whole blocks of the next size.
    """
    left, right = lambda x, k: F.call_function("shiftleft", x, k), lambda x, k: F.call_function("shiftright", x, k)

    def block(number: Column, k: Column, there: Column) -> Column:
        return F.when(there, F.struct(left(number, k).alias("lo"), (F.lit(32) - k).alias("width")))

    def ends(k: Column) -> tuple[Column, Column]:
        return right(lo + left(long(1), k) - 1, k), right(hi, k)

    def first(k: Column) -> Column:
        at, after = ends(k)
        return block(at, k, (at < after) & (at % 2 == 1))

    def last(k: Column) -> Column:
        at, after = ends(k)
        return block(after - 1, k, (at < after) & (after % 2 == 1))

    up, down = F.sequence(F.lit(0), F.lit(32)), F.sequence(F.lit(32), F.lit(0), F.lit(-1))
    return F.filter(F.concat(F.transform(up, first), F.transform(down, last)), lambda b: b.isNotNull())
