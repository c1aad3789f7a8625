"""Exact percentiles of groups of any size, by selection over histograms of digits."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.places import any_larger, same
from lectern.sources.layout import stored

#: Values up to which a group is sorted as one array; bits of a digit of larger ones.
SMALL, DIGIT = 1 << 14, 16


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), value being computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def sortable(value: Column) -> Column:
    """A double as a long in the same order: its IEEE bits, counted down below zero. NaN comes last."""
    size = F.abs(value)
    power = lambda e: F.when(e >= -1022, F.pow(F.lit(2.0), e))
    # the logarithm may be off by one next to a power of two
    near = lambda g: F.greatest(g + (size >= power(g + 1)).cast("int") - (size < power(g)).cast("int"), F.lit(-1022))
    of = lambda e: F.shiftleft((e + 1022).cast("long"), 52) + (size / power(e) * F.lit(float(1 << 52))).cast("long")
    normal = _bound(F.greatest(F.floor(F.log2(size)), F.lit(-1022)).cast("int"), lambda g: _bound(near(g), of))
    bits = F.when(F.isnan(value), F.lit(2047 << 52 | 1)).when(size == float("inf"), F.lit(2047 << 52)).when(size == 0, F.lit(0)).otherwise(normal)
    return bits * F.when((value < 0) & ~F.isnan(value), -1).otherwise(1)


def _between(low: Column, high: Column, part: Column) -> Column:
    """Linear interpolation from the nearer end, as numpy does it."""
    return F.when(part >= 0.5, high - (high - low) * (1 - part)).otherwise(low + (high - low) * part)


def percentiles(rows: DataFrame, by: Sequence[str], value: str, share: float, name: str = "level", small: int = SMALL) -> DataFrame:
    """(by, level): the interpolated value at rank share * (n - 1) of each group, nulls aside; groups of nulls only are left out.

    A group of up to `small` values is one sorted array. In larger ones both neighbouring ranks are selected digit by
    digit: values are counted by their leading bits, the digit in which the rank falls is kept, and only values with
    the digits kept so far are counted on. A group is never in one task but as its counts of 2^DIGIT digits.
    """
    rows = rows.select(*by, F.col(value).cast("double").alias("_v")).where("_v is not null")
    at = F.lit(share) * (F.col("_n") - 1)
    low = F.floor(at)
    ends = lambda s: _between(F.get(s, low.cast("int")), F.get(s, F.least(low + 1, F.col("_n") - 1).cast("int")), at - low)
    arrays = lambda frame: frame.groupBy(*by).agg(F.sort_array(F.collect_list("_v")).alias("_s"), F.count("*").alias("_n")).where("_n > 0").select(*by, ends(F.col("_s")).alias(name))
    if not any_larger(rows, by, small):
        return arrays(rows)
    rows = stored(rows, "values")
    # of large groups there are 1 / `small` of the rows at most; sent to all, they leave the rows where they lie, where a
    # shuffle by group would bring each group into one task
    large = F.broadcast(stored(rows.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > small), "large-groups")).alias("r")
    out = arrays(rows.alias("l").join(large, same(by), "left_anti"))
    many = stored(rows.alias("l").join(large, same(by)).select(*[F.col(f"l.`{c}`") for c in by], "_v", sortable(F.col("_v")).alias("_bits")), "sortable")
    wanted = large.select(*by, "_n", F.explode(F.array(F.struct(F.lit("low").alias("side"), low.alias("rank")), F.struct(F.lit("high").alias("side"), F.least(low + 1, F.col("_n") - 1).alias("rank")))).alias("w")).select(*by, "_n", "w.side", "w.rank", F.lit(0).cast("long").alias("_prefix"))
    for shift in range(64 - DIGIT, -1, -DIGIT):
        # the values that have the digits kept so far, each once although both ranks may look among them
        if shift == 64 - DIGIT:
            inside = many.withColumn("_prefix", F.lit(0).cast("long"))
        else:
            there = F.broadcast(wanted.select(*by, "_prefix").distinct()).alias("r")
            inside = many.withColumn("_prefix", F.shiftright("_bits", shift + DIGIT)).alias("l").join(there, same([*by, "_prefix"])).select("l.*")
            many = inside = stored(inside, "sortable")
        digits = inside.groupBy(*by, "_prefix", F.shiftright("_bits", shift).alias("_next")).agg(F.count("*").alias("_c"), F.min("_v").alias("_least"))
        before = Window.partitionBy(*by, "_prefix").orderBy("_next").rowsBetween(Window.unboundedPreceding, -1)
        digits = digits.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0)))
        found = F.broadcast(wanted).alias("l").join(digits.alias("r"), same([*by, "_prefix"])).where("rank >= _before and rank < _before + _c")
        wanted = stored(found.select(*[F.col(f"l.`{c}`") for c in by], "_n", "side", (F.col("rank") - F.col("_before")).alias("rank"), F.col("_next").alias("_prefix"), F.col("r._least").alias("_least")), "digits")
    both = wanted.groupBy(*by, "_n").agg(F.max(F.when(F.col("side") == "low", F.col("_least"))).alias("_low"), F.max(F.when(F.col("side") == "high", F.col("_least"))).alias("_high"))
    return out.union(both.select(*by, _between(F.col("_low"), F.col("_high"), at - low).alias(name)))
