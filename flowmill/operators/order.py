"""Row numbers and running values over the whole table, or over each key, without sorting either in one task.

Rows are sorted by ranges of all order columns, keys first, so a key or a time that has most rows is spread over many tasks; only one row
a task, or a task and key, is summed up in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def sorted_ranges(df: DataFrame, order: list[str]) -> DataFrame:
    """The rows as a written table with their range ``_part``, increasing with ``order``, and their place ``_k`` in it, from 0.

    Nulls come first.  Tied rows are in one order for all that reads the table.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(rows.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_k")), "ranges")


def global_row_number(df: DataFrame, order: list[str], name: str = "rn") -> DataFrame:
    """1-based row number by ``order``."""
    rows = sorted_ranges(df, order)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    before = rows.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return rows.join(before, "_part").withColumn(name, (F.col("_k") + F.col("_before") + 1).cast("long")).drop("_part", "_k", "_before")


def cadence(df: DataFrame, start: Column, interval_us: int, order: list[str], time_us: Column, keys: tuple[str, ...] = (), name: str = "bucket", before: str | None = None, first: str | None = None) -> DataFrame:
    """How often a clock has fired by each row of the table, or of each key: at most once a row, strictly after its time.

    With b boundaries strictly passed by row r (1-based), the clock has fired ``r + least(0, running min of b - r)`` times.
    ``before`` names a column for how often it had fired by the row before, ``first`` one for the row's number.
    """
    keys = list(keys)
    rows = sorted_ranges(df, [*keys, *order])
    inner = Window.partitionBy("_part", *keys).orderBy("_k")
    passed = F.greatest(F.lit(0), F.ceil((time_us - start) / F.lit(float(interval_us))) - 1)
    rows = rows.withColumn("_r", F.row_number().over(inner).cast("long")).withColumn("_d", passed - F.col("_r"))
    rows = rows.withColumn("_low", F.min("_d").over(inner.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_lower", F.min("_d").over(inner.rowsBetween(Window.unboundedPreceding, -1)))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range and key
    parts = rows.groupBy("_part", *keys).agg(F.count("*").alias("_n"), F.min("_d").alias("_least")).withColumn("_offset", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    parts = parts.withColumn("_below", F.min(F.col("_least") - F.col("_offset")).over(earlier)).drop("_n", "_least")
    parts = parts.withColumnsRenamed({c: f"_of{c}" for c in ("_part", *keys)})
    joined = rows.join(parts, [F.equal_null(F.col(c), F.col(f"_of{c}")) for c in ("_part", *keys)]).drop(*(f"_of{c}" for c in ("_part", *keys)))
    r = F.col("_r") + F.col("_offset")
    fired = lambda number, low: (number + F.least(F.lit(0), F.col(low) - F.col("_offset"), F.col("_below"))).cast("long")
    out = joined.withColumn(name, fired(r, "_low"))
    if before:
        out = out.withColumn(before, fired(r - 1, "_lower"))
    if first:
        out = out.withColumn(first, r)
    return out.drop("_part", "_k", "_r", "_d", "_low", "_lower", "_offset", "_below")


def with_previous(df: DataFrame, order: list[str], columns: dict[str, str], more: tuple[str, ...] = ()) -> DataFrame:
    """Adds the values that ``columns`` (new name to column) had in the row before, null in the first row.

    The first row of a range gets them from the last row of the range before.
    """
    rows = sorted_ranges(df, order)
    values = F.struct(*(F.col(c).alias(new) for new, c in columns.items()))
    last = rows.groupBy("_part").agg(F.max_by(values, "_k").alias("_last")).select("_part", F.lag("_last").over(Window.orderBy("_part")).alias("_edge"))  # a row for each range
    inside = F.lag(values).over(Window.partitionBy("_part").orderBy("_k"))
    both = rows.withColumn("_inside", inside).join(last, "_part").withColumn("_before", F.when(F.col("_k") == 0, F.col("_edge")).otherwise(F.col("_inside")))
    return both.select(*df.columns, *more, *(F.col(f"_before.{new}").alias(new) for new in columns))


def segments(df: DataFrame, order: list[str], columns: dict[str, str], begins: Column, name: str) -> DataFrame:
    """Numbers runs of rows in order: a row for which ``begins`` holds starts the next; it may use ``columns``' values of the row before."""
    marked = with_previous(df, order, columns, ("_part", "_k")).withColumn("_new", F.coalesce(begins, F.lit(True)).cast("int"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    before = marked.groupBy("_part").agg(F.sum("_new").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    inside = F.sum("_new").over(Window.partitionBy("_part").orderBy("_k").rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("_inside", inside).join(before, "_part").select(*df.columns, (F.col("_inside") + F.col("_offset")).alias(name))
