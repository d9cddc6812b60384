"""Event-time windows per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .order import with_previous
from .rangejoin import span_sums
from .stats import distances_of_counts


def looked_up(df: DataFrame, found: DataFrame, key: str, time_us: str) -> DataFrame:
    """``df`` with the other columns of ``found``, which has a row for each key, null among them, and time; rows without a time are left out."""
    found = found.withColumnsRenamed({key: "_key", time_us: "_time"})
    return df.join(found, F.equal_null(F.col(key), F.col("_key")) & (F.col(time_us) == F.col("_time"))).drop("_key", "_time")


def dual_window(df: DataFrame, key: str, time_us: str, current_us: int, past_us: int) -> DataFrame:
    """Rows in the current window and in the past window before it, as of each row; rows of one time see each other.

    Both are differences of the numbers of rows up to three times, whatever the windows hold.  A key's distinct times are counted in time cells, to
    which the rows of the cells before are added.
    """
    t, span = F.col(time_us), current_us + past_us
    times = df.filter(t.isNotNull()).groupBy(key, time_us).agg(F.count("*").alias("_n"))
    none = F.lit(0).cast("long")
    asked = [F.struct(at.alias("_at"), n.alias("_n"), F.lit(i).alias("_i")) for i, (at, n) in enumerate([(t, F.col("_n")), (t - current_us - 1, none), (t - span - 1, none)])]
    points = times.select(key, time_us, F.explode(F.array(*asked)).alias("_p")).select(key, time_us, "_p.*").withColumn("_cell", F.floor(F.col("_at") / max(1, current_us)))
    cells = points.groupBy(key, "_cell").agg(F.sum("_n").alias("_n"))
    earlier = Window.partitionBy(key).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)  # a row for each cell
    cells = cells.select(F.col(key).alias("_key"), F.col("_cell").alias("_of"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(key, "_cell").orderBy("_at", "_i").rowsBetween(Window.unboundedPreceding, 0)
    upto = points.withColumn("_upto", F.sum("_n").over(inside)).join(cells, F.equal_null(F.col(key), F.col("_key")) & (F.col("_cell") == F.col("_of")))
    a, b, c = (F.max(F.when(F.col("_i") == i, F.col("_upto") + F.col("_before"))) for i in range(3))
    return looked_up(df, upto.groupBy(key, time_us).agg((a - b).alias("cw"), (b - c).alias("pw")), key, time_us)


def warm(df: DataFrame, key: str, time_us: str, span_us: int) -> DataFrame:
    """Rows of a key from ``span_us`` after its first row on: before that, windows aren't full."""
    first = df.groupBy(F.col(key).alias("_key")).agg((F.min(time_us) + span_us).alias("_full"))
    return df.join(first, F.equal_null(F.col(key), F.col("_key"))).filter(F.col(time_us) >= F.col("_full")).drop("_key", "_full")


def trailing(df: DataFrame, key: str, time_us: str, span_us: int, value: str) -> DataFrame:
    """Number and mean of the rows in the last ``span_us`` of each row, from totals of each distinct time of a key."""
    times = df.filter(F.col(time_us).isNotNull()).groupBy(key, time_us).agg(F.count("*").alias("n"), F.count(value).alias("_m"), F.sum(value).alias("_s"))
    found = span_sums(times.withColumnRenamed(time_us, "at"), times.select(key, (F.col(time_us) - span_us).alias("lo")), [key], span_us + 1, ["n", "_m", "_s"])
    mean = F.round(F.when(F.col("_m") > 0, F.col("_s") / F.col("_m")), 6)
    return looked_up(df, found.select(key, (F.col("lo") + span_us).alias(time_us), "n", mean.alias("mean")), key, time_us)


def sliding_ends(df: DataFrame, time_us: str, size_us: int, step_us: int) -> DataFrame:
    """Ends of windows of ``size_us`` every ``step_us`` from the first full one to the last row, empty windows included."""
    ends = df.agg((F.min(time_us) + size_us).alias("a"), F.max(time_us).alias("b")).filter("a <= b")
    return ends.select(F.explode(F.sequence("a", "b", F.lit(step_us))).alias("end"))


def sliding_means(df: DataFrame, time_us: str, size_us: int, step_us: int, features: list[str], least: int) -> DataFrame:
    """(end, n, feature means) of every sliding window [end - size, end]; means are null below ``least`` rows.

    A row is put into the windows that hold it.
    """
    ends = sliding_ends(df, time_us, size_us, step_us)
    first = F.broadcast(df.agg((F.min(time_us) + size_us).alias("_a"), F.max(time_us).alias("_z")))  # one row
    t = F.col(time_us)
    lowest = F.greatest(F.col("_a"), F.col("_a") + F.ceil((t - F.col("_a")) / F.lit(float(step_us))) * step_us)
    highest = F.least(F.col("_z"), t + size_us)
    rows = df.join(first).filter(lowest <= highest).withColumn("end", F.explode(F.sequence(lowest.cast("long"), highest.cast("long"), F.lit(step_us))))
    found = rows.groupBy("end").agg(F.count("*").alias("n"), *(F.round(F.avg(f), 6).alias(f) for f in features))
    full = ends.join(found, "end", "left").na.fill(0, ["n"])
    return full.select("end", "n", *(F.when(F.col("n") >= least, F.col(f)).alias(f) for f in features))


def sliding_drift(df: DataFrame, time_us: str, size_us: int, step_us: int, feature: str, reference: DataFrame, least: int) -> DataFrame:
    """(end, n, ks, wasserstein, mean_shift) of a feature in each window [end - size, end] against all values of ``reference``.

    ``size_us`` is a multiple of ``step_us``.  Values are counted once for each pane, the open time between two ends or the instant of one, and panes' counts are
    added up to windows.  Windows below ``least`` rows, and those without a value of the feature, give nulls.
    """
    if size_us % step_us:
        raise ValueError("the size must be a multiple of the step")
    ends = sliding_ends(df, time_us, size_us, step_us).withColumn("_win", F.row_number().over(Window.orderBy("end")) - 1)  # a row for each window
    first = F.broadcast(df.agg(F.min(time_us).alias("_t")))  # one row
    offset = F.col(time_us) - F.col("_t")
    pane = 2 * F.floor(offset / step_us) + F.when(offset % step_us == 0, 0).otherwise(1)
    panes = df.join(first).groupBy(pane.alias("_pane"), F.col(feature).alias("_v")).agg(F.count("*").alias("_c"))
    span = 2 * (size_us // step_us)
    low, high = F.greatest(F.lit(0), F.ceil((F.col("_pane") - span) / 2)), F.floor(F.col("_pane") / 2)
    windows = panes.select(F.explode(F.sequence(low.cast("long"), high.cast("long"))).alias("_win"), "_v", "_c").groupBy("_win", "_v").agg(F.sum("_c").alias("_a"))
    totals = windows.groupBy("_win").agg(F.sum("_a").alias("n"), F.sum(F.when(F.col("_v").isNotNull(), F.col("_a"))).alias("_m"), F.sum(F.col("_v") * F.col("_a")).alias("_s"))
    known = reference.filter(F.col(feature).isNotNull()).groupBy(F.col(feature).alias("_v")).agg(F.count("*").alias("_b"))
    mean = F.broadcast(known.agg((F.sum(F.col("_v") * F.col("_b")) / F.sum("_b")).alias("_mean")))  # one row
    full = ends.join(totals, "_win", "left").na.fill(0, ["n"])
    judged = full.filter((F.col("n") >= least) & (F.col("_m") > 0)).select("_win")
    mine = windows.filter("_v is not null").join(judged, "_win").select("_win", "_v", "_a", F.lit(0).cast("long").alias("_b"))
    theirs = judged.join(known).select("_win", "_v", F.lit(0).cast("long").alias("_a"), "_b")  # the reference's distinct values for each window
    counts = mine.unionByName(theirs).groupBy("_win", "_v").agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    found = full.join(distances_of_counts(counts, ["_win"]), "_win", "left").join(mean)
    return found.select("end", "n", "ks", "wasserstein", F.when(F.col("ks").isNotNull(), F.round(F.col("_s") / F.col("_m") - F.col("_mean"), 6)).alias("mean_shift"))


def hopping(df: DataFrame, time: str, size: str, step: str, aggregates: list, keys: tuple[str, ...] = ()) -> DataFrame:
    """Aggregates over windows of ``size`` every ``step``; each row is put into the windows that hold it."""
    found = df.groupBy(F.window(time, size, step).alias("w"), *keys).agg(*aggregates)
    return found.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *(c for c in found.columns if c != "w"))


def order_violations(df: DataFrame, file: str, seq: str, time: str) -> DataFrame:
    """Rows earlier than the last row with a time before them: ``in_file`` in their file, ``over_files`` in the order of files and rows.

    A file is spread over as many tasks as its rows need; each gets the last row of the one before.  Null times are skipped.
    """
    seen = with_previous(df.filter(F.col(time).isNotNull()), [file, seq], {"_file": file, "_time": time})
    late = F.coalesce(F.col(time) < F.col("_time"), F.lit(False))
    marked = seen.withColumns({"in_file": late & F.equal_null(F.col(file), F.col("_file")), "over_files": late})
    return marked.filter("over_files").drop("_file", "_time")
