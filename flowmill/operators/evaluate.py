"""Confusion-matrix metrics for evaluation buckets, and min-max normalisation of a session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import guarded_ratio

EPSILON = 1e-7


def confusion(df: DataFrame, keys: list[str], label: str = "label", score: str = "score", more: list[Column] | None = None) -> DataFrame:
    """Counts, rates, accuracy, precision, F1, loss and benign rate of each group; undefined ratios are 0."""
    hit, y = F.col(score) >= 0.5, F.col(label)
    p = F.least(F.greatest(F.col(score), F.lit(EPSILON)), F.lit(1 - EPSILON))
    loss = F.avg(-(y * F.ln(p) + (1 - y) * F.ln(1 - p)))
    cells = {"tp": (y == 1) & hit, "fn": (y == 1) & ~hit, "fp": (y == 0) & hit, "tn": (y == 0) & ~hit}
    out = df.groupBy(*keys).agg(*(F.count_if(c).alias(k) for k, c in cells.items()), F.count("*").alias("flow_num"), F.round(loss, 6).alias("loss"), *(more or []))
    tp, fn, fp, tn, n = (F.col(c) for c in (*cells, "flow_num"))
    ratios = {"tp_rate": (tp, tp + fn), "fn_rate": (fn, tp + fn), "fp_rate": (fp, fp + tn), "tn_rate": (tn, fp + tn), "accuracy": (tp + tn, n), "precision": (tp, tp + fp), "f1_score": (2 * tp, 2 * tp + fp + fn), "benign_rate": (tn + fp, n)}
    return out.withColumns({k: F.round(guarded_ratio(a, b), 6) for k, (a, b) in ratios.items()})


def key_summary(key: str) -> Column:
    """The key of a bucket, or ``mixed:n`` for several."""
    n = F.countDistinct(key)
    return F.when(n == 1, F.min(key)).when(n > 1, F.concat(F.lit("mixed:"), n.cast("string"))).otherwise("none")


def min_max(df: DataFrame, columns: dict[str, str], partition: list[str]) -> DataFrame:
    """Columns scaled to 0 to 1 over a session of bounded many buckets; a constant column gives 0."""
    w = Window.partitionBy(*partition)
    scaled = lambda c: F.round(guarded_ratio(F.col(c) - F.min(c).over(w), F.max(c).over(w) - F.min(c).over(w)), 6)
    return df.withColumns({new: scaled(old) for old, new in columns.items()})
