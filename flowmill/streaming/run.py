"""A whole session from its settings: rows of a folder, replay, evaluations, trainings, and the files that tell about them."""

from __future__ import annotations

import csv
import io
import json
import time
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import boolean_like, label_key, numeric, strict_time
from ..operators.evaluate import confusion, key_summary, min_max
from ..operators.order import cadence, global_row_number
from ..operators.session import contract_problems, session_range
from ..operators.validate import BOOLEAN, MAY_BE_BLANK
from ..session import written
from ..sources.files import _folder, leaf_files, read_leaf
from .replay import Settings, Windows, run_session

#: Columns of the evaluation and training files (fixed values).
EVALUATED = ("daytime", "label_key", "TP", "FN", "FP", "TN", "flow_num", "TP_rate", "FN_rate", "FP_rate", "TN_rate", "accuracy", "precision", "f1_score", "loss", "benign_rate", "nmr_fn_rate", "nmr_benign_rate")
TRAINED = ("daytime", "label_key", "window", "accuracy", "loss", "benign_count", "malicious_count", "flow_num")


@dataclass(frozen=True)
class Plan:
    """What a session reads and how it runs; times in seconds."""

    path: str
    start: datetime
    span: timedelta
    features: tuple[str, ...]
    keys: tuple[str, ...]
    evaluate: float
    replay: Settings
    label: str = "label"
    said: dict = field(default_factory=dict)


def plan(said: dict) -> Plan:
    """A plan from settings as a JSON object (the names of the settings are fixed values)."""
    schema, drift = said["FeatureSchema"], said.get("DriftDetection", {})
    mode, flows = said["RETRAINING_MODE"], schema.get("MODE", "zeek") == "zeek"
    windows = tuple(Windows(w["CURRENT_WIN_SIZE"], w["PAST_WIN_SIZE"], w["K"], w["THRESHOLD"], {0: "cosine", 1: "l2"}[w["METHOD_CODE"]]) for w in drift.get("WindowConfig", [])) or (Windows(),)
    features = tuple(schema["VECTOR_FEATURES" if flows else "LEGACY_FEATURES"])
    span = {k.lower(): v for k, v in said["TargetRange"].items()}
    interval = drift["DRIFT_DETECTION_UNIT_INTERVAL"] if mode == "dy" else said["RETRAINING_INTERVAL"]
    options = Settings(mode, said["MODEL_CODE"], float(interval), said.get("TrainingDefine", {}).get("EPOCHS", 1), windows=windows, ensemble=drift.get("ENSEMBLE_METHOD_CODE", 0), scaling=scales(features, flows))
    return Plan(said["DATASETS_DIR_PATH"], datetime.fromisoformat(said["SESSION_START_DATE"]), timedelta(**span), features, tuple(schema.get("LABEL_FEATURES", ())) if flows else (), float(said["EVALUATE_UNIT_INTERVAL"]), options, schema.get("LABEL_COLUMN", "label"), said)


def scales(features: tuple[str, ...], flows: bool) -> dict[str, str]:
    """How features are scaled before drift is tested."""
    if flows:
        return {f: "duration" if f == "duration" else "count" for f in features if f in MAY_BE_BLANK}
    ends = {"_count": "count", "most_port": "port", "_interval": "interval", "_length": "length"}
    return {f: kind for f in features for end, kind in ends.items() if f.endswith(end)}


def cell(name: str) -> Column:
    """A feature's number: blank counts are 0, flags 0 or 1; anything else that isn't a number is an error."""
    c = F.col(f"`{name}`")
    value = boolean_like(c).cast("double") if name in BOOLEAN else numeric(c)
    blank = F.lit(0.0) if name in MAY_BE_BLANK else F.raise_error(F.lit(f"no number in column {name}")).cast("double")
    wrong = F.raise_error(F.concat(F.lit(f"not a number in column {name}: "), c)).cast("double")
    return F.when(F.coalesce(c, F.lit("")) == "", blank).otherwise(F.coalesce(value, wrong))


def session_table(spark: SparkSession, p: Plan) -> tuple[DataFrame, datetime, datetime]:
    """(key, seq, us, t, label, features) of the session's rows in file order, its start and its end."""
    leaf_files(spark, p.path)
    rows = read_leaf(spark, p.path)
    if wrong := contract_problems([c for c in rows.columns if c not in ("file", "place")], list(p.features), list(p.keys), p.label):
        raise ValueError("; ".join(wrong))
    label = numeric(F.col(p.label)).cast("int")
    told = F.coalesce(label, F.raise_error(F.concat(F.lit("no label: "), F.coalesce(F.col(p.label), F.lit("")))).cast("int"))
    timed = global_row_number(rows, ["place"], "seq").withColumn("_t", strict_time(F.col("daytime")).cast("timestamp_ntz"))
    found = session_range(timed, p.start, p.start + p.span, "_t")
    inside = timed.filter((F.col("_t") >= F.lit(found.start)) & (F.col("_t") <= F.lit(found.end)))
    us = F.unix_micros(F.col("_t").cast("timestamp"))
    out = inside.select(label_key(*(F.col(f"`{k}`") for k in p.keys)).alias("key"), "seq", us.alias("us"), (us / 1_000_000).alias("t"), told.alias("label"), *(cell(f).alias(f) for f in p.features))
    return written(out, "session"), found.start, found.end


def evaluations(rows: DataFrame, start_us: int, interval: float) -> DataFrame:
    """Metrics of each evaluation of (key, seq, us, label, score), at the middle of its time; the last, which no row ends, isn't among them."""
    step = round(interval * 1_000_000)
    timed = written(cadence(rows, F.lit(start_us), step, ["us", "seq"], F.col("us")), "evaluated")
    last = timed.agg(F.max("bucket")).first()[0]  # one value
    found = confusion(timed.filter(F.col("bucket") < F.lit(last)), ["bucket"], more=[key_summary("key").alias("label_key")])
    middle = F.timestamp_micros(F.lit(start_us) + (F.col("bucket") + 1) * step - step // 2)
    named = found.withColumn("daytime", F.date_format(middle, "yyyy-MM-dd HH:mm:ss"))
    scaled = min_max(named, {"flow_num": "nmr_fn_rate", "benign_rate": "nmr_benign_rate"}, [])
    cells = {"TP": "tp", "FN": "fn", "FP": "fp", "TN": "tn", "TP_rate": "tp_rate", "FN_rate": "fn_rate", "FP_rate": "fp_rate", "TN_rate": "tn_rate"}
    return scaled.orderBy("bucket").select(*(F.col(cells.get(c, c)).alias(c) for c in EVALUATED))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, at = _folder(spark, path)
    out = fs.create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_csv(spark: SparkSession, path: str, columns: tuple[str, ...], rows: list) -> None:
    text = io.StringIO()
    csv.writer(text, lineterminator="\n").writerows([columns, *rows])
    write_text(spark, path, text.getvalue())


def run(spark: SparkSession, said: dict, out: str) -> str:
    """Run a session and write its evaluations, trainings, weights and settings to a new folder under ``out``; gives the folder.

    The evaluations and trainings, a row for each time and key, go through the driver.
    """
    p, began = plan(said), time.time()
    rows, start, end = session_table(spark, p)
    start_us = int((start - datetime(1970, 1, 1)).total_seconds() * 1_000_000)
    options = Settings(**{**p.replay.__dict__, "start": start_us / 1_000_000})
    scored, log = run_session(rows, list(p.features), options)
    decided = F.col("vote").cast("double") if options.mode == "dy" else F.col("score")
    joined = rows.select("seq", "us").join(scored.withColumn("score", decided), "seq")
    stamp = time.strftime("%Y%m%d%H%M%S", time.gmtime(began + 9 * 3600))
    folder = f"{out.rstrip('/')}/{stamp}_{p.path.rstrip('/').rsplit('/', 1)[-1]}_{options.mode}_{options.code}"
    write_csv(spark, f"{folder}/res_eval.csv", EVALUATED, [tuple(r) for r in evaluations(joined, start_us, p.evaluate).collect()])
    told = log.select(F.date_format(F.timestamp_micros("at_us"), "yyyy-MM-dd HH:mm:ss"), "key", "window", "accuracy", "loss", "benign", "malicious", "n").orderBy("at_us", "key", "window")
    write_csv(spark, f"{folder}/res_train.csv", TRAINED, [tuple(r) for r in told.collect()])
    log.select("key", "window", "at_us", "weights").write.parquet(f"{folder}/weights")
    last = rows.agg(F.max("us")).first()[0]
    ended = None if last is None else (datetime(1970, 1, 1) + timedelta(microseconds=last)).isoformat()
    write_text(spark, f"{folder}/settings_log.json", json.dumps({**said, "INIT_TIME": stamp, "SESSION_END_DAYTIME": ended, "ELAPSED_TIME": time.time() - began}, indent=2))
    return folder
