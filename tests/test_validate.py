"""Folder checks: layout, headers, rows, times over files, exit code."""

import os

from flowmill.operators import validate
from flowmill.operators.flows import REQUIRED
from flowmill.operators.net import Network

HEAD = ",".join(REQUIRED)


def row(time, label="0", duration="1.5", local="T"):
    return f"{time},{label},SF,{duration},1,2,3,4,5,6,0,{local},F"


def folder(tmp_path, **texts):
    for name, text in texts.items():
        (tmp_path / name.replace("__", ".")).write_text(text)
    return str(tmp_path)


def test_valid_folder(spark, tmp_path):
    a = "\n".join([HEAD, row("2022-01-01 09:00:00"), row("2022-01-01 09:00:05", "1", "")]) + "\n"
    report = validate.check_folder(spark, folder(tmp_path, a__csv=a, b__csv=HEAD + "\n" + row("2022-01-01 09:01:00")))
    assert report.code == 0 and set(report.statuses.values()) == {"OK"} and report.text().endswith("passed")


def test_times_over_files(spark, tmp_path):
    report = validate.check_folder(spark, folder(tmp_path, a__csv=HEAD + "\n" + row("2022-01-01 09:00:05"), b__csv=HEAD + "\n" + row("2022-01-01 09:00:04")))
    assert report.code == 1 and report.statuses["time_order"] == "NG" and report.problems == [("time_order", "ERROR", "b.csv", 2, "daytime over files")]


def test_bad_folders(spark, tmp_path):
    assert validate.check_folder(spark, str(tmp_path / "none")).statuses["input_dir"] == "NG"
    os.makedirs(tmp_path / "e")
    empty = validate.check_folder(spark, str(tmp_path / "e"))
    assert empty.code == 1 and empty.statuses["csv_files"] == "NG" and empty.statuses["label_value"] == "NOT RUN"
    rows = [row("2022-01-01 09:00:00") + ",9", ",".join([""] * 13), row("2022-01-01 09:00:03", "2", "x"), row("noon"), row("2022-01-01 09:00:02", local="maybe")]
    report = validate.check_folder(spark, folder(tmp_path / "e", x__txt="a", a__csv=HEAD + "\n" + "\n".join(rows), b__csv="daytime,label\n1,2\n", c__csv=HEAD + "\n", d__csv=""))
    got = {(c, s, f) for c, s, f, *_ in report.problems}
    assert {("directory_layout", "ERROR", "x.txt"), ("row_structure", "ERROR", "a.csv"), ("label_value", "ERROR", "a.csv"), ("value_types", "ERROR", "a.csv"), ("daytime_format", "ERROR", "a.csv"), ("time_order", "ERROR", "a.csv"), ("required_columns", "ERROR", "b.csv"), ("row_structure", "ERROR", "c.csv"), ("header", "ERROR", "d.csv")} <= got
    assert sorted(r for c, _, f, r, _ in report.problems if c == "row_structure" and f == "a.csv") == [2, 3]


def test_statuses_rest_on_all_problems(spark, tmp_path):
    rows = [row("2023-05-01 09:00:00", "7"), row("2023-05-01 09:00:01", duration="x"), row("2023-05-01 09:00:00")]
    path = folder(tmp_path, a__csv=HEAD + "\n" + "\n".join(rows) + "\n")
    for shown in (0, 1, 1000):
        report = validate.check_folder(spark, path, shown=shown)
        assert {c: s for c, s in report.statuses.items() if s != "OK"} == {"label_value": "NG", "value_types": "NG", "time_order": "NG"}
        assert report.counts == {("label_value", "ERROR"): 1, ("value_types", "ERROR"): 1, ("time_order", "ERROR"): 2} and len(report.problems) == min(shown, 4)
    assert "and 3 more" in validate.check_folder(spark, path, shown=1).text()


def test_times_by_name_quotes_and_blocks(spark, tmp_path):
    head = "label,daytime," + ",".join(c for c in REQUIRED if c not in ("label", "daytime")) + ",note"
    rest = ",SF,1,1,2,3,4,5,6,0,T,F,"
    a = [head, '0,"2023-05-01 09:00:05"' + rest + '"two\nlines, ""quoted"""', "", "0,2023-05-01 09:00:01" + rest + "x", "0,2023-05-01 09:00:06" + rest.rstrip(",")]
    report = validate.check_folder(spark, folder(tmp_path, a__csv="\n".join(a) + "\n"))
    assert report.problems == [("time_order", "ERROR", "a.csv", 3, "daytime in its file"), ("time_order", "ERROR", "a.csv", 3, "daytime over files"), ("row_structure", "ERROR", "a.csv", 4, "cells and header differ in number")]
    assert report.summary.rows == 2 and report.summary.missing["note"] == 0


def test_long_files_in_blocks(spark, tmp_path):
    times = [f"2023-05-01 {i // 3600:02d}:{i // 60 % 60:02d}:{i % 60:02d}" for i in range(3000)]
    bad = {700, 1501, 2999}
    own = [row(times[i - 5] if i in bad else t, str(i % 2)) for i, t in enumerate(times)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        net = Network(benign=("172.20.4.0/24",), malicious=(), exception=())
        report = validate.check_folder(spark, folder(tmp_path, a__csv=HEAD + "\n" + "\n".join(own) + "\n", b__csv=HEAD + "\n" + row("2023-05-01 09:00:00", duration="") + "\n"), net=net, features=("conn_state",))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r for _, _, f, r, what in report.problems if what == "daytime in its file"] == [i + 2 for i in sorted(bad)]
    assert report.counts == {("time_order", "ERROR"): 6}
    s = report.summary
    assert (s.rows, s.rows_per_file, s.labels, s.values, s.missing["duration"]) == (3001, [3000, 1], {"0": 1501, "1": 1500}, {"conn_state": {"SF": 3001}}, 1)
    assert "conn_state=SF" in report.text() and "100.0% (3,001)" in report.text() and str(s.first) == "2023-05-01 00:00:00"


def test_tables_by_display_width():
    assert validate.width("aé漢") == 4 or validate.width("aé漢") == 5
    assert [validate.width(line.rstrip()) for line in validate.pair_table([("漢字", "1"), ("ab", "22"), ("abcd", "333")]).splitlines()][0] == len("abcd  1    ab    22")
