"""A replay session's time range and clocks."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import cadence


@dataclass(frozen=True)
class Range:
    """Start and end of a session; ``moved`` is by how much the first row was later than the asked start."""

    start: datetime
    end: datetime

    @property
    def seconds(self) -> float:
        return (self.end - self.start).total_seconds()


def session_range(df: DataFrame, start: datetime, end: datetime, time: str = "daytime") -> Range:
    """The session's range: if the very first row is later than ``start``, start, end and all clocks move to it."""
    first = df.agg(F.min(time)).first()[0]  # one value
    late = max(first - start, start - start) if first is not None else start - start
    return Range(start + late, end + late)


def session_rows(df: DataFrame, found: Range, time: str = "daytime") -> DataFrame:
    """Rows of the session; the end is included."""
    return df.filter((F.col(time) >= F.lit(found.start)) & (F.col(time) <= F.lit(found.end)))


def clock(df: DataFrame, start_us: int, interval_us: int, order: list[str], time_us: str, name: str) -> DataFrame:
    """How often a session's clock has fired by each row: at most once a row, strictly after its time."""
    return cadence(df, F.lit(start_us), interval_us, order, F.col(time_us), name=name)


def midpoint(end: Column, interval: str) -> Column:
    """Middle of an evaluation bucket that ends at ``end``."""
    return end - F.expr(f"INTERVAL {interval}") / 2


def elapsed_hours(time: Column, start: Column) -> Column:
    return (F.unix_micros(time.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 3_600_000_000


def contract_problems(columns: list[str], features: list[str], keys: list[str], label: str = "label", time: str = "daytime") -> list[str]:
    """What is wrong with a session's columns: repeated, absent, or used as feature and as key or label."""
    twice = sorted({c for c in columns if columns.count(c) > 1})
    out = [f"repeated column {c}" for c in twice]
    out += [f"missing column {c}" for c in dict.fromkeys([*features, *keys, label, time]) if c not in columns]
    out += [f"repeated feature {c}" for c in sorted({c for c in features if features.count(c) > 1})]
    out += [f"feature {c} is a key, the label or the time" for c in features if c in {*keys, label, time}]
    return out


def feature_vector(columns: list[str]) -> Column:
    """Cells as numbers: booleans as 1 and 0; null cells and texts that aren't numbers are NaN."""
    from ..functions.scalars import coerced

    return F.array(*(F.coalesce(coerced(F.col(c).cast("string")), F.lit(float("nan"))) for c in columns))
