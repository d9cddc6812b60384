"""Profiles of flow tables: files, time spans, missing cells, frequencies, samples and comparisons of data sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def span_summary(df: DataFrame, time: str = "daytime", keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows, first and last time, of each file (as ``keys``) or of all."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.min(time).alias("first"), F.max(time).alias("last"))


def rows_per_file(df: DataFrame, file: str) -> DataFrame:
    """Number of files and least, mean and most rows of one."""
    n = df.groupBy(file).agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("files"), F.min("n").alias("least"), F.round(F.avg("n"), 6).alias("mean"), F.max("n").alias("most"))


def missing_cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, missing) of null and blank cells, in one pass."""
    cells = F.array(*(F.struct(F.lit(c).alias("column"), (F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "").cast("long").alias("m")) for c in columns))
    return df.select(F.explode(cells).alias("c")).groupBy("c.column").agg(F.sum("c.m").alias("missing"))


def frequencies(df: DataFrame, column: str) -> DataFrame:
    """(value, n, share, place) by falling count, then by value; distinct values only are sorted."""
    n = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))
    order = Window.orderBy(F.desc("n"), "value")
    return n.withColumns({"share": F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6), "place": F.row_number().over(order)})


def ordered_distinct(df: DataFrame, value: str, order: list[str]) -> DataFrame:
    """Distinct values with the place of their first occurrence, so sorting by ``first`` keeps their order."""
    return df.groupBy(value).agg(F.min(F.struct(*order)).alias("first"))


def downsample(df: DataFrame, most: int, key: str) -> DataFrame:
    """All rows up to ``most`` of them, else the ``most`` of least hash of ``key``: the same rows at every run."""
    return df.orderBy(F.md5(F.col(key).cast("string")), key).limit(most)


def training_counts(df: DataFrame, features: list[str], label: str = "label", keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows without nulls or NaN in the features, and their benign and malicious counts."""
    return without_nan(df, features).groupBy(*keys).agg(F.count("*").alias("flow_num"), F.count_if(F.col(label) == 0).alias("benign_count"), F.count_if(F.col(label) == 1).alias("malicious_count"))


def without_nan(df: DataFrame, columns: list[str]) -> DataFrame:
    good = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in columns]
    return df.filter(F.forall(F.array(*good), lambda x: x))


def dataset_pairs(df: DataFrame, name: str) -> DataFrame:
    """Ordered pairs (a, b) of the distinct names of data sets, of which there are few."""
    names = df.select(name).distinct()
    return names.select(F.col(name).alias("a")).join(names.select(F.col(name).alias("b")), F.col("a") != F.col("b"))


def aligned_kl(p: Column, q: Column) -> Column:
    """Aggregate: divergence of raw values taken as distributions; null unless all are positive."""
    both = F.sum(p * F.ln(p / q)) / F.sum(p) + F.ln(F.sum(q) / F.sum(p))
    return F.when((F.min(p) > 0) & (F.min(q) > 0), both)


def welch(df: DataFrame, value: str, side: str, keys: list[str]) -> DataFrame:
    """Welch's t and its degrees of freedom for the values with ``side`` true against those with it false."""
    part = lambda f, s: f(F.when(F.col(side) == s, F.col(value)))
    found = df.groupBy(*keys).agg(*(part(f, s).alias(f"_{n}{int(s)}") for s in (True, False) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))))
    a, b = F.col("_v1") / F.col("_n1"), F.col("_v0") / F.col("_n0")
    t = (F.col("_m1") - F.col("_m0")) / F.sqrt(a + b)
    freedom = (a + b) ** 2 / (a * a / (F.col("_n1") - 1) + b * b / (F.col("_n0") - 1))
    return found.select(*keys, F.round(t, 6).alias("t"), F.round(freedom, 4).alias("freedom"))


def importance(df: DataFrame, features: list[str], target: str, keys: list[str], axis: str) -> DataFrame:
    """Mean over ``axis`` of each feature's correlation with ``target`` within (keys, axis), null groups (constant columns) left out."""
    corr = lambda f: F.try_divide(F.covar_pop(f, target), F.stddev_pop(f) * F.stddev_pop(target))
    found = df.groupBy(*keys, axis).agg(*(corr(f).alias(f) for f in features))
    return found.groupBy(*keys).agg(*(F.round(F.avg(f), 6).alias(f) for f in features))
