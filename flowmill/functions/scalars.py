"""Scalar expressions on flow columns."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DecimalType, DoubleType, MapType, StringType, StructType

#: Tokens read as booleans, trimmed and lower-cased (fixed values).
TRUE_WORDS, FALSE_WORDS = ("1", "true", "t", "yes", "y"), ("0", "false", "f", "no", "n")


def numeric(c: Column) -> Column:
    """Double, or null for what isn't a number."""
    return c.try_cast("double")


def boolean_like(c: Column) -> Column:
    word = F.lower(F.trim(c.cast("string")))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def coerced(c: Column) -> Column:
    """Number of a cell: booleans as 1 and 0, numbers as they are, else null."""
    return F.coalesce(boolean_like(c).cast("double"), numeric(c))


def label_of(c: Column) -> Column:
    """Label text to int, truncating as ``int(float(x))``."""
    return numeric(c).cast("int")


def parsed_time(c: Column) -> Column:
    """Lenient ``yyyy-MM-dd HH:mm:ss``: null where the text doesn't match."""
    return F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss"))


def wall_clock(epoch: Column, zone: str = "Asia/Tokyo") -> Column:
    """Epoch seconds to wall-clock text, whole seconds."""
    return F.date_format(F.from_utc_timestamp(F.timestamp_seconds(epoch), zone), "yyyy-MM-dd HH:mm:ss")


def label_key(*columns: Column) -> Column:
    """Values joined by a bar, ``default`` without columns."""
    return F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("")) for c in columns)) if columns else F.lit("default")


def safe_name(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), "[^A-Za-z0-9._-]+", "_")


def scaled_count(c: Column) -> Column:
    return F.log1p(c / 1000)


def scaled_duration(c: Column) -> Column:
    return F.log1p(c)


def port_bucket(c: Column) -> Column:
    """0 up to 1023, 0.5 up to 49151, else 1."""
    return F.when(c <= 1023, 0.0).when(c <= 49151, 0.5).otherwise(1.0)


def scaled_interval(c: Column) -> Column:
    return c / 60


def scaled_length(c: Column) -> Column:
    return c / 10000


def guarded_ratio(a: Column, b: Column) -> Column:
    """``a / b``, 0 where b is 0."""
    return F.when(b != 0, a / b).otherwise(0.0)


def inner_product(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)


def squared_distance(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: F.pow(a.cast("double") - b.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, v: s + v)


def ratio_text(count: Column, total: Column) -> Column:
    """``12.5% (1,234)``."""
    share = F.when(total > 0, count * 100.0 / total).otherwise(0.0)
    return F.concat(F.format_string("%4.1f", share), F.lit("% ("), F.format_number(count, 0), F.lit(")"))


def duration_text(seconds: Column) -> Column:
    """``2h 5m 3s``; leading parts that are 0 are left out, seconds stay."""
    h, m, s = (seconds / 3600).cast("long"), (seconds % 3600 / 60).cast("long"), (seconds % 60).cast("long")
    part = lambda x, unit: F.concat(x.cast("string"), F.lit(unit))
    return F.concat_ws(" ", F.when(h > 0, part(h, "h")), F.when((h > 0) | (m > 0), part(m, "m")), part(s, "s"))


def strict_time(c: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` text as a time; any other text raises an error."""
    return F.when(c.isNotNull(), F.coalesce(parsed_time(c), F.raise_error(F.concat(F.lit("not a time: "), c)).cast("timestamp")))


def json_text(c: Column) -> Column:
    return F.to_json(c)


def python_float(c: Column) -> Column:
    """A double as Python prints it: shortest digits, plain from 1e-4 to below 1e16, else with an exponent of two digits or more."""
    text = c.cast("string")
    part = lambda k: F.regexp_extract(text, r"^(-?)(\d)\.(\d+)E(-?)(\d+)$", k)
    sign, digits, power = part(1), F.concat(part(2), F.when(part(3) == "0", "").otherwise(part(3))), F.concat(part(4), part(5)).try_cast("int")
    whole = F.concat(F.rpad(digits, power + 1, "0"), F.lit("."), F.when(F.length(digits) > power + 1, F.substr(digits, power + 2)).otherwise("0"))
    whole = F.when(F.length(digits) > power + 1, F.concat(F.substr(digits, F.lit(1), power + 1), F.lit("."), F.substr(digits, power + 2))).otherwise(whole)
    mantissa = F.concat(part(2), F.when(part(3) == "0", "").otherwise(F.concat(F.lit("."), part(3))))
    small = F.concat(mantissa, F.lit("e"), F.when(part(4) == "-", "-").otherwise("+"), F.when(F.length(part(5)) < 2, F.lpad(part(5), 2, "0")).otherwise(part(5)))
    plain = F.when(power == -4, F.concat(F.lit("0.000"), digits)).when((power >= 7) & (power < 16), whole).otherwise(small)
    odd = F.when(text == "NaN", "nan").when(text == "Infinity", "inf").when(text == "-Infinity", "-inf")
    return F.coalesce(odd, F.when(text.contains("E"), F.concat(sign, plain)).otherwise(text))


@F.pandas_udf(StringType())
def python_json(raw: pd.Series) -> pd.Series:
    """JSON text of an array or object with Python's spaces and escapes."""
    return raw.map(lambda x: None if x is None else json.dumps(json.loads(x)))


def cell_text(raw: Column, kind: DataType) -> Column:
    """The text of a JSON value as a cell, as Python prints it; ``kind`` is the column's JSON type.

    Null is empty.  Whole numbers and strings stay, other numbers are printed as floats, booleans as True and False, arrays and objects as JSON.
    """
    if isinstance(kind, (ArrayType, MapType, StructType)):
        return F.coalesce(python_json(raw), F.lit(""))
    if isinstance(kind, (DoubleType, DecimalType)):
        raw = F.when(raw.rlike(r"^-?\d+$"), raw).otherwise(python_float(raw.try_cast("double")))
    if isinstance(kind, BooleanType):
        raw = F.initcap(raw)
    return F.coalesce(raw, F.lit(""))
