"""Two-sample distances, histograms, profiles and correlations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import sorted_ranges


def cdf_distances(df: DataFrame, keys: list[str], value: str, side: str) -> DataFrame:
    """Kolmogorov-Smirnov and Wasserstein-1 distance of the values with ``side`` true and false, for each key.

    Values are counted first and dealt over ranges; a range's windows run over its distinct values, and each range gets
    the sums of those before it and the first value of the next.  A key with one side empty gives nulls.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count_if(F.col(side)).alias("_a"), F.count_if(~F.col(side)).alias("_b"))
    return distances_of_counts(counts, keys)


def distances_of_counts(counts: DataFrame, keys: list[str]) -> DataFrame:
    """The same from (keys, _v, _a, _b): each key's distinct values and how often either side has them."""
    counts = sorted_ranges(counts, [*keys, "_v"]).withColumnRenamed("_part", "_r")
    upto = Window.partitionBy(*keys, "_r").orderBy("_v")
    steps = Window.partitionBy(*keys).orderBy("_r")  # a row for each range
    before = steps.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    parts = counts.groupBy(*keys, "_r").agg(F.sum("_a").alias("_sa"), F.sum("_b").alias("_sb"), F.min("_v").alias("_first"))
    parts = parts.select(*keys, "_r", F.coalesce(F.sum("_sa").over(before), F.lit(0)).alias("_pa"), F.coalesce(F.sum("_sb").over(before), F.lit(0)).alias("_pb"), F.sum("_sa").over(whole).alias("_na"), F.sum("_sb").over(whole).alias("_nb"), F.lead("_first").over(steps).alias("_next"))
    placed = counts.join(parts, [*keys, "_r"])
    share = lambda c: (F.sum(f"_{c}").over(upto) + F.col(f"_p{c}")) / F.nullif(F.col(f"_n{c}"), F.lit(0))
    gaps = placed.select(*keys, F.abs(share("a") - share("b")).alias("_g"), (F.coalesce(F.lead("_v").over(upto), F.col("_next")) - F.col("_v")).alias("_w"))
    return gaps.groupBy(*keys).agg(F.round(F.max("_g"), 6).alias("ks"), F.round(F.sum(F.col("_g") * F.coalesce("_w", F.lit(0.0))), 6).alias("wasserstein"))


def histogram(df: DataFrame, value: str, bins: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, bin, lo, n, density) over the values' range, the last bin closed; empty bins are there, nulls left out."""
    rows = df.filter(F.col(value).isNotNull())
    ends = rows.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count("*").alias("_all"))
    ends = ends.filter("_hi is not null").withColumn("_step", (F.col("_hi") - F.col("_lo")) / bins)
    every = ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    both = rows.join(ends, list(keys)) if keys else rows.join(F.broadcast(ends))
    at = F.when(F.col("_step") > 0, F.least(F.floor((F.col(value) - F.col("_lo")) / F.col("_step")), F.lit(bins - 1))).otherwise(0).cast("int")
    found = both.groupBy(*keys, at.alias("bin")).agg(F.count("*").alias("n"))
    out = every.join(found, [*keys, "bin"], "left").na.fill(0, ["n"])
    density = F.when(F.col("_step") > 0, F.col("n") / (F.col("_all") * F.col("_step"))).otherwise(0.0)
    return out.select(*keys, "bin", F.round(F.col("_lo") + F.col("bin") * F.col("_step"), 6).alias("lo"), "n", F.round(density, 9).alias("density"))


def kernel_density(df: DataFrame, value: str, bandwidth: float, points: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, point, x, density): a Gaussian kernel density at ``points`` even places over the values' range.

    Values give their weight to the two places beside them, in proportion; places then meet places, so the work beyond one pass doesn't grow with the
    rows.  Nulls are left out; a key with one value only has its density at one place.
    """
    rows = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    ends = rows.groupBy(*keys).agg(F.min(value).cast("double").alias("_lo"), F.max(value).cast("double").alias("_hi"), F.count("*").alias("_n")).filter("_n > 0")
    ends = ends.withColumn("_step", (F.col("_hi") - F.col("_lo")) / (points - 1))
    both = rows.join(ends, list(keys)) if keys else rows.join(ends)
    at = F.when(F.col("_step") > 0, (F.col(value) - F.col("_lo")) / F.col("_step")).otherwise(0.0)
    low = F.least(F.floor(at), F.lit(points - 2))
    halves = F.explode(F.array(F.struct(low.alias("b"), (1 - (at - low)).alias("w")), F.struct((low + 1).alias("b"), (at - low).alias("w"))))
    bins = both.select(*keys, halves.alias("h")).groupBy(*keys, F.col("h.b").alias("_b")).agg(F.sum("h.w").alias("_w"))
    places = ends.withColumn("point", F.explode(F.sequence(F.lit(0), F.when(F.col("_step") > 0, points - 1).otherwise(0))))
    meet = places.join(bins, list(keys)) if keys else places.join(bins)  # at most points times points for each key
    far = (F.col("point") - F.col("_b")) * F.col("_step") / bandwidth
    found = meet.groupBy(*keys, "point", (F.col("_lo") + F.col("point") * F.col("_step")).alias("x"), "_n").agg(F.sum(F.col("_w") * F.exp(-far * far / 2)).alias("_s"))
    return found.select(*keys, "point", F.round("x", 6).alias("x"), F.round(F.col("_s") / (F.col("_n") * bandwidth * math.sqrt(2 * math.pi)), 9).alias("density"))


def histogram_kl(df: DataFrame, keys: list[str], value: str, side: str, bins: int = 50) -> DataFrame:
    """Kullback-Leibler divergence of histograms over the first sample's range, 1e-10 added to densities."""
    edges = df.filter(F.col(side)).groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    step = (F.col("_hi") - F.col("_lo")) / bins
    at = F.least(F.floor((F.col(value) - F.col("_lo")) / step), F.lit(bins - 1)).cast("int")
    rows = df.join(edges, keys).filter(F.col(value).between(F.col("_lo"), F.col("_hi")) & (F.col("_hi") > F.col("_lo")))
    counts = rows.groupBy(*keys, at.alias("_bin"), step.alias("_step")).agg(F.count_if(F.col(side)).alias("_a"), F.count_if(~F.col(side)).alias("_b"))
    full = edges.filter("_hi > _lo").select(*keys, step.alias("_step"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("_bin")).join(counts.drop("_step"), [*keys, "_bin"], "left").na.fill(0, ["_a", "_b"])
    w = Window.partitionBy(*keys)
    density = lambda c: F.col(c) / (F.sum(c).over(w) * F.col("_step")) + 1e-10
    both = full.withColumns({"_p": density("_a"), "_q": density("_b")})
    share = both.withColumns({"_p": F.col("_p") / F.sum("_p").over(w), "_q": F.col("_q") / F.sum("_q").over(w)})
    return share.groupBy(*keys).agg(F.round(F.sum(F.col("_p") * F.ln(F.col("_p") / F.col("_q"))), 6).alias("kl"))


def feature_stats(df: DataFrame, features: list[str]) -> DataFrame:
    """Observed, missing, least, largest, mean and population deviation of each feature, in one pass."""
    long = df.select(F.posexplode(F.array(*(F.col(f).cast("double") for f in features))).alias("_i", "_v"))
    name = F.get(F.array(*map(F.lit, features)), F.col("_i"))
    return long.groupBy(name.alias("feature")).agg(F.count("_v").alias("observed"), F.count_if(F.col("_v").isNull()).alias("missing"), F.round(F.min("_v"), 6).alias("least"), F.round(F.max("_v"), 6).alias("largest"), F.round(F.avg("_v"), 6).alias("mean"), F.round(F.stddev_pop("_v"), 6).alias("deviation"))


def time_counts(df: DataFrame, unit: str, time: str = "daytime") -> DataFrame:
    return df.groupBy(F.date_trunc(unit, time).cast("timestamp_ntz").alias("slot")).agg(F.count("*").alias("n"))


def gap_filled(df: DataFrame, unit_seconds: int, time: str, aggregates: list[Column], fills: dict[str, object]) -> DataFrame:
    """Aggregates for every time slot from the first to the last, empty slots included."""
    slot = F.floor(F.unix_seconds(F.col(time).cast("timestamp")) / unit_seconds).alias("slot")
    found = df.groupBy(slot).agg(*aggregates)
    ends = found.agg(F.min("slot").alias("a"), F.max("slot").alias("b")).filter("a is not null")
    return ends.select(F.explode(F.sequence("a", "b")).alias("slot")).join(found, "slot", "left").na.fill(fills)


def zscores(df: DataFrame, columns: list[str], partition: list[str]) -> DataFrame:
    """Population standard scores within a partition; a constant column gives 0."""
    w = Window.partitionBy(*partition)
    score = lambda c: F.when(F.stddev_pop(c).over(w) > 0, (F.col(c) - F.avg(c).over(w)) / F.stddev_pop(c).over(w)).otherwise(0.0)
    return df.withColumns({c: score(c) for c in columns})


def correlations(df: DataFrame, keys: list[str], pairs: list[tuple[str, str]]) -> DataFrame:
    return df.groupBy(*keys).agg(*(F.round(F.corr(a, b), 6).alias(f"{a}_{b}") for a, b in pairs))
