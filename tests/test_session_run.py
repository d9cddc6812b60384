"""A session from settings to its files."""

import csv
import json
import os
from datetime import datetime, timedelta

import pytest

from flowmill.streaming import run

HEAD = "daytime,label,conn_state,duration,orig_bytes,local_orig"
BEGIN = datetime(2023, 11, 15, 7, 0)


def settings(path, mode="st", **more):
    schema = {"MODE": "zeek", "LABEL_COLUMN": "label", "LABEL_FEATURES": ["conn_state"], "VECTOR_FEATURES": ["duration", "orig_bytes", "local_orig"]}
    drift = {"DRIFT_DETECTION_UNIT_INTERVAL": 60, "ENSEMBLE_METHOD_CODE": 0, "WindowConfig": [{"CURRENT_WIN_SIZE": 120, "PAST_WIN_SIZE": 300, "METHOD_CODE": 1, "K": 2, "THRESHOLD": 0.0001}]}
    return {"MODEL_CODE": 4, "FeatureSchema": schema, "DATASETS_DIR_PATH": path, "SESSION_START_DATE": "2023-11-15 07:00:00", "TargetRange": {"DAYS": 0, "HOURS": 1, "MINUTES": 0, "SECONDS": 0}, "RETRAINING_MODE": mode, "RETRAINING_INTERVAL": 600, "EVALUATE_UNIT_INTERVAL": 900, "TrainingDefine": {"EPOCHS": 2}, "DriftDetection": drift} | more


def dataset(tmp_path, first=0):
    os.makedirs(tmp_path / "set")
    rows = []
    for i in range(200):
        t = BEGIN + timedelta(seconds=first + 30 * i)
        rows.append(f"{t},{i % 2},{'SF' if i % 3 else 'S0'},{'' if i % 7 == 0 else i % 2 + 0.5},{i % 5},{'T' if i % 2 else 'F'}")
    (tmp_path / "set" / "00000.csv").write_text("\n".join([HEAD, *rows[:120]]) + "\n")
    (tmp_path / "set" / "00001.csv").write_text("\n".join([HEAD, *rows[120:]]) + "\n")
    return str(tmp_path / "set")


@pytest.mark.parametrize("mode", ["nt", "st", "dy"])
def test_files_of_a_session(spark, tmp_path, mode):
    folder = run.run(spark, settings(dataset(tmp_path), mode), str(tmp_path / "exp"))
    assert folder.endswith(f"_set_{mode}_4") and {"res_eval.csv", "res_train.csv", "settings_log.json", "weights"} <= set(os.listdir(folder))
    told = list(csv.DictReader(open(f"{folder}/res_eval.csv")))
    # an hour of rows every 30 seconds, evaluated by the first row after each quarter; the last quarter isn't ended by a row
    assert [r["daytime"] for r in told] == ["2023-11-15 07:07:30", "2023-11-15 07:22:30", "2023-11-15 07:37:30"]
    assert [int(r["flow_num"]) for r in told] == [31, 30, 30] and {r["label_key"] for r in told} == {"mixed:2"}
    assert all(sum(int(r[c]) for c in ("TP", "FN", "FP", "TN")) == int(r["flow_num"]) for r in told)
    trained = list(csv.DictReader(open(f"{folder}/res_train.csv")))
    assert spark.read.parquet(f"{folder}/weights").count() == len(trained)
    if mode == "st":
        assert [r["daytime"] for r in trained] == sorted(2 * [f"2023-11-15 07:{m}:30" for m in (10, 20, 30, 40, 50)]) and {r["label_key"] for r in trained} == {"SF", "S0"}
        assert sum(int(r["flow_num"]) for r in trained) == 101
    assert (mode == "nt") == (not trained)
    log = json.load(open(f"{folder}/settings_log.json"))
    assert log["SESSION_END_DAYTIME"] == "2023-11-15T08:00:00" and log["RETRAINING_MODE"] == mode


def test_range_and_contract(spark, tmp_path):
    path = dataset(tmp_path, first=300)
    rows, start, end = run.session_table(spark, run.plan(settings(path)))
    assert (start, end) == (BEGIN + timedelta(minutes=5), BEGIN + timedelta(minutes=65)) and rows.count() == 121  # all clocks moved to the first row
    rows, start, end = run.session_table(spark, run.plan(settings(path, SESSION_START_DATE="2023-11-15 07:10:10")))
    assert start == BEGIN + timedelta(minutes=10, seconds=10) and rows.first().t == (start + timedelta(seconds=20) - datetime(1970, 1, 1)).total_seconds()
    bad = settings(path)
    bad["FeatureSchema"]["VECTOR_FEATURES"] = ["duration", "absent", "label"]
    with pytest.raises(ValueError, match="missing column absent; feature label"):
        run.run(spark, bad, str(tmp_path / "exp"))
    (tmp_path / "set" / "00002.csv").write_text(f"{HEAD}\n{BEGIN + timedelta(hours=1)},1,SF,x,1,T\n")
    with pytest.raises(Exception, match="not a number in column duration: x"):
        run.session_table(spark, run.plan(settings(path)))
