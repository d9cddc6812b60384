"""Reshaping of time-ordered tables: shift, merge, inject, filter, chunk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import global_row_number

#: Source rows up to which the injected side is broadcast.
SHORT = 10_000


def shifted(df: DataFrame, baseline: Column, time: str = "daytime") -> DataFrame:
    """Times moved so that the earliest is at ``baseline``."""
    first = df.agg(F.min(time)).first()[0]  # one value
    return df.withColumn(time, F.col(time) + (baseline - F.lit(first)))


def ordered_merge(*sides: DataFrame, time: str = "daytime", seq: str = "seq", place: str | None = None) -> DataFrame:
    """All sides by time, the earlier side (A, B and so on) first in ties, each side in its own order; headers must be equal.

    With ``place`` rows aren't sorted but numbered in that column.
    """
    if any(s.columns != sides[0].columns for s in sides):
        raise ValueError("the sides' columns differ")
    both = None
    for i, s in enumerate(sides):
        named = s.withColumn("side", F.lit(chr(ord("A") + i)))
        both = named if both is None else both.unionByName(named)
    return global_row_number(both, [time, "side", seq], place) if place else both.orderBy(time, "side", seq)


def align_mix(first: DataFrame, *others: DataFrame, time: str = "daytime", seq: str = "seq", place: str | None = None) -> DataFrame:
    """The other sides moved so that each begins when the first does, then all merged."""
    start = F.lit(first.agg(F.min(time)).first()[0])  # one value
    return ordered_merge(first, *(shifted(o, start, time) for o in others), time=time, seq=seq, place=place)


def chunked(df: DataFrame, rows: int, order: list[str], time: str = "daytime", pattern: str = "yyyyMMddHHmmss") -> DataFrame:
    """Chunk number and file name of every row, ``rows`` rows a chunk in order."""
    if rows < 1:
        raise ValueError("chunks need a row at least")
    numbered = global_row_number(df, order).withColumn("chunk", ((F.col("rn") - 1) / rows).cast("long"))
    names = numbered.groupBy("chunk").agg(F.min(time).alias("_first")).select("chunk", F.concat(F.lpad(F.col("chunk").cast("string"), 5, "0"), F.lit("_"), F.date_format("_first", pattern), F.lit(".csv")).alias("file"))
    return numbered.join(names, "chunk")


def injected(target: DataFrame, source: DataFrame, order: list[str], time: str = "daytime") -> DataFrame:
    """After target row i comes source row ``i mod N`` at the target's time.

    The source is keyed by its number and joined on it, so both sides are dealt over the cluster; a short source, whose
    keys would be few and large, is broadcast.
    """
    rows = global_row_number(target, order, "i").withColumn("i", F.col("i") - 1)
    src = global_row_number(source, order, "k").withColumn("k", F.col("k") - 1)
    n = src.count()
    if not n:
        return rows.withColumn("ord", 2 * F.col("i")).drop("i")
    stamps = rows.select("i", F.col(time).alias("_t"), (F.col("i") % n).alias("k"))
    extra = stamps.join(F.broadcast(src) if n <= SHORT else src, "k").withColumn(time, F.col("_t")).withColumn("ord", 2 * F.col("i") + 1).drop("k", "i", "_t")
    return rows.withColumn("ord", 2 * F.col("i")).drop("i").unionByName(extra)


def time_range(df: DataFrame, start: Column, end: Column, closed: bool = False, time: str = "daytime") -> DataFrame:
    """Rows from ``start`` up to ``end``, which counts only if ``closed``; null times go."""
    t = F.col(time)
    return df.filter((t >= start) & ((t <= end) if closed else (t < end)))


def without_early_attacks(df: DataFrame, span: Column, time: str = "daytime", label: str = "label") -> DataFrame:
    """Rows but for labelled ones within ``span`` of the first time."""
    first = df.agg(F.min(time)).first()[0]
    return df.filter(~((F.col(time) < F.lit(first) + span) & (F.col(label) == 1)))
