"""Sums over intervals of time, from running totals in cells of time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def span_sums(points: DataFrame, probes: DataFrame, keys: list[str], width: int, totals: list[str]) -> DataFrame:
    """(keys, lo, totals): for each row (keys, lo) of ``probes`` the totals of the points (keys, at, totals) with ``at`` in [lo, lo + width).

    Times are whole numbers, and a probe comes once.  A span is the end of a cell of its width and the beginning of the next, so it is the sum of a running total from the
    cell's end and one from the next cell's beginning: the work doesn't grow with what a span holds, and nothing is subtracted.  Null without a point.
    """

    def both_ways(at, cell, to, cell_to):
        """Places in the order from a cell's end, and in that from a cell's beginning."""
        entry = lambda place, cell, back: F.struct(cell.alias("_cell"), F.lit(back).alias("_back"), place.cast("long").alias("_place"))
        return F.explode(F.array(entry(-at, cell, True), entry(to, cell_to, False))).alias("_p")

    at, lo = F.col("at"), F.col("lo").cast("long").alias("lo")
    given = points.select(*keys, both_ways(at, F.floor(at / width), at, F.floor(at / width)), F.lit(None).cast("long").alias("lo"), *totals)
    kinds = dict(given.dtypes)
    asked = probes.select(*keys, both_ways(lo, F.floor(lo / width), lo + width - 1, F.floor(lo / width) + 1), lo, *(F.lit(None).cast(kinds[t]).alias(t) for t in totals))
    both = given.unionByName(asked).select(*keys, "_p.*", "lo", *totals)
    w = Window.partitionBy(*keys, "_cell", "_back").orderBy("_place", F.asc_nulls_first("lo")).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumns({t: F.sum(t).over(w) for t in totals}).filter("lo is not null")
    return seen.groupBy(*keys, "lo").agg(*(F.sum(t).alias(t) for t in totals))


def range_sum(left: DataFrame, right: DataFrame, key: str, time: str, at: str, value: str, before: int, after: int) -> DataFrame:
    """For each left row the sum of ``value`` over right rows with ``at`` in [time - before, time + after), else 0.

    Times are whole numbers; ``key`` is unique on the left.  Both sides are taken by their distinct times.
    """
    width = before + after
    sums = right.filter(F.col(at).isNotNull() & F.lit(width > 0)).groupBy(F.col(at).alias("at")).agg(F.sum(value).alias("cost"))
    lows = left.filter(F.col(time).isNotNull()).select((F.col(time) - before).alias("lo")).distinct()
    found = span_sums(sums, lows, [], max(1, width), ["cost"]).select((F.col("lo") + before).alias("_at"), "cost")
    return left.join(found, F.col(time) == F.col("_at"), "left").groupBy(key, time).agg(F.coalesce(F.sum("cost"), F.lit(0)).alias("cost"))
