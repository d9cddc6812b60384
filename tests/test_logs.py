"""The log path, sinks and packet classes on small folders."""

import csv
import json
import os

import pytest
from pyspark.sql import functions as F

from flowmill.operators import net, session
from flowmill.sources import files

NET = net.Network(benign=("172.20.4.0/24",), malicious=("198.18.7.0/24",), exception=("172.20.4.250/32",))
BASE = 1700000000  # 2023-11-15 07:13:20 in Tokyo


def write_log(folder, rows, name="conn.log"):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w") as f:
        f.write("\n\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")


def record(ts, orig="198.18.7.33", resp="203.0.113.9", **more):
    return {"ts": ts, "id.orig_h": orig, "id.resp_h": resp, "conn_state": "SF"} | more


def lines(path):
    return {name: open(f"{path}/{name}").read().splitlines() for name in sorted(os.listdir(path)) if name.endswith(".csv")}


def table(path):
    return [r for name in sorted(os.listdir(path)) if name.endswith(".csv") for r in csv.DictReader(open(f"{path}/{name}"))]


def test_log_to_csv(spark, tmp_path):
    top, out = str(tmp_path / "batch"), str(tmp_path / "out")
    write_log(f"{top}/b", [record(BASE, duration=600.0), record(BASE + 1, duration=1, history=["a", 1])])
    write_log(f"{top}/a", [record(BASE + 5, duration="bad"), record(BASE + 3, "172.20.4.12", duration=""), record("x"), record(BASE, "172.20.4.250"), record(BASE, "192.0.2.1"), record(BASE, "")])
    done = files.log_to_csv(spark, top, out, NET, "conn.log, conn.log,", rows=2, check=False)
    names = ["00000_20231115071322.csv", "00001_20231115071325.csv"]
    assert done == {f"{out}/conn/batch": names}
    got = lines(f"{out}/conn/batch")
    assert list(got) == names and [x.split(",")[0] for own in got.values() for x in own[1:]] == ["2023-11-15 07:13:22", "2023-11-15 07:13:23", "2023-11-15 07:13:25", "2023-11-15 07:23:20"]
    assert [x.split(",")[1] for own in got.values() for x in own[1:]] == ["1", "0", "1", "1"]
    header = got[names[0]][0].split(",")
    assert header[:2] == ["daytime", "label"] and {"missed_bytes", "local_orig", "history"} <= set(header)
    files.log_to_csv(spark, f"{top}/b", out, NET, batch="batch", check=False)  # replaces
    assert list(lines(f"{out}/conn/batch")) == ["00000_20231115071322.csv"] and {x for x in os.listdir(f"{out}/conn") if x[0] != "."} == {"batch", "batch.manifest"}
    write_log(f"{top}/c", [record(BASE, "172.20.4.250")])
    with pytest.raises(ValueError):
        files.log_to_csv(spark, f"{top}/c", out, NET, batch="batch")
    assert list(lines(f"{out}/conn/batch")) == ["00000_20231115071322.csv"]  # the earlier output stays
    with pytest.raises(ValueError, match="contract"):
        files.log_to_csv(spark, f"{top}/b", str(tmp_path / "bad"), NET)
    for bad in (f"{top}/none", str(tmp_path / "out")):
        with pytest.raises(ValueError):
            files.log_folders(spark, bad, ["conn.log"])
    for setting in ("", " , ", "a/conn.log"):
        with pytest.raises(ValueError):
            files.target_logs(setting)
    assert files.first_time(files.read_logs(spark, top, "conn.log")[0]) == BASE


def test_a_folder_for_each_log_and_checked_rows(spark, tmp_path):
    good = {"orig_bytes": 1, "resp_bytes": 2, "orig_pkts": 3, "resp_pkts": 4, "orig_ip_bytes": 5, "resp_ip_bytes": 6, "missed_bytes": 0, "local_orig": True, "local_resp": False}
    write_log(str(tmp_path / "in"), [record(BASE + i, **good) for i in range(5)])
    write_log(str(tmp_path / "in"), [record(BASE, query="example.org", qtype=1)], "dns.log")
    done = files.log_to_csv(spark, str(tmp_path / "in"), str(tmp_path / "out"), NET, "dns.log,conn.log")
    assert list(done) == [f"{tmp_path}/out/dns/in", f"{tmp_path}/out/conn/in"]
    (dns,) = table(f"{tmp_path}/out/dns/in")
    assert "orig_bytes" not in dns and "duration" not in dns and dns["query"] == "example.org"
    assert {r["local_orig"] for r in table(f"{tmp_path}/out/conn/in")} == {"True"}


def test_cells_are_printed_as_python_does(spark, tmp_path):
    values = [123456789.5, 1e-5, 0.0001, 1.0, -2.5e-7, 1e16, 1e15, 123456789012345680.0, 0.001, 1e300, 5, 0.1 + 0.2, -0.0, 1234567.0, 12345678.0]
    rows = [record(BASE + i, duration=v if v < 1e9 else 2.0, odd=v, flag=i % 2 == 0, text=f"1.50e{i}", many=["é", {"a": [1, 2.5]}], whole=i) for i, v in enumerate(values)]
    write_log(str(tmp_path / "in"), [*rows, record(BASE - 5)])
    files.log_to_csv(spark, str(tmp_path / "in"), str(tmp_path / "out"), NET, check=False)
    got = {r["whole"]: r for r in table(f"{tmp_path}/out/conn/in")}
    for i, v in enumerate(values):
        r = got[str(i)]
        assert (r["odd"], r["duration"], r["flag"], r["text"], r["many"]) == (str(v), str(float(v if v < 1e9 else 2.0)), str(i % 2 == 0), f"1.50e{i}", json.dumps(["é", {"a": [1, 2.5]}])), v
    assert got[""]["duration"] == "0" and got[""]["odd"] == "" and got[""]["flag"] == ""


def test_ties_keep_folders_and_lines(spark, tmp_path):
    for folder in ("a", "a-b", "b"):
        write_log(f"{tmp_path}/in/{folder}", [record(BASE + 0.9 - (i % 10) / 20, uid=f"{folder}{i:04d}", pad="x" * 50) for i in range(400)])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")  # several blocks a file
    try:
        rows, _ = files.read_logs(spark, f"{tmp_path}/in", "conn.log")
        assert rows.select("place.path", "place.block").distinct().count() > 12
        files.log_to_csv(spark, f"{tmp_path}/in", str(tmp_path / "out"), NET, rows=100, check=False)
        assert [r["uid"] for r in table(f"{tmp_path}/out/conn/in")] == [f"{f}{i:04d}" for f in ("a", "a-b", "b") for i in range(400)]
        text = open(f"{tmp_path}/in/a-b/conn.log").read().splitlines()
        text[500] = '{"ts": 1, "cut'
        text[700] = "also bad"
        open(f"{tmp_path}/in/a-b/conn.log", "w").write("\n".join(text))
        with pytest.raises(ValueError, match="a-b/conn.log:501$"):
            files.read_logs(spark, f"{tmp_path}/in", "conn.log")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_rewrite_and_minute_names(spark, tmp_path):
    rows = [("a.csv", "2023-03-01 00:00:10", 1), ("a.csv", "2023-03-01 00:00:00", 0), ("c.csv", "2023-03-01 00:01:00", 1)]
    df = spark.createDataFrame(rows, "source string, daytime string, label int").withColumn("daytime", F.col("daytime").cast("timestamp_ntz"))
    base = F.lit("2024-02-01 09:03:59").cast("timestamp_ntz")
    assert files.rewrite_shifted(df, str(tmp_path / "x"), base, "source", ["daytime"]) == ["00000_20240201090359.csv", "00001_20240201090459.csv"]
    assert files.write_chunks(df.drop("source"), str(tmp_path / "y"), 2, ["daytime"], pattern="yyyyMMddHHmm") == ["00000_202303010000.csv", "00001_202303010001.csv"]
    with pytest.raises(ValueError):
        files.write_chunks(df.drop("source"), str(tmp_path / "y"), 2, ["daytime"])
    os.makedirs(tmp_path / "leaf")
    for name, text in (("a.csv", "daytime,label\n2023-03-01 00:00:10,1\n"), ("b.csv", "daytime,label\n"), ("c.csv", "daytime,label\n2023-03-01 00:00:00,0\n")):
        (tmp_path / "leaf" / name).write_text(text)
    read = files.read_leaf(spark, str(tmp_path / "leaf")).withColumn("daytime", F.col("daytime").cast("timestamp_ntz"))
    names = files.rewrite_shifted(read, str(tmp_path / "z"), base, "file", ["daytime"], names=files.leaf_files(spark, str(tmp_path / "leaf")))
    assert names == ["00000_20240201090409.csv", "00002_20240201090359.csv"]  # the file without rows is counted
    (tmp_path / "leaf" / "d.csv").write_text("daytime,other\n")
    with pytest.raises(Exception, match="(?i)header|schema"):
        files.read_leaf(spark, str(tmp_path / "leaf")).collect()
    os.makedirs(tmp_path / "none")
    with pytest.raises(ValueError):
        files.leaf_files(spark, str(tmp_path / "none"))


def test_a_failed_rename_leaves_the_old_output(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([("2023-03-01 00:00:10", 1)], "daytime string, label int").withColumn("daytime", F.col("daytime").cast("timestamp_ntz"))
    out = str(tmp_path / "out")
    files.write_chunks(df, out, 1, ["daytime"])
    whole, real = lines(out), files.move
    for failing in (1, 2, 3):  # the part, the old folder, the new folder
        calls = []

        def broken(fs, old, new, failing=failing, calls=calls):
            calls.append(1)
            if len(calls) == failing:
                raise OSError("no rename")
            real(fs, old, new)

        monkeypatch.setattr(files, "move", broken)
        with pytest.raises(OSError):
            files.write_chunks(df.withColumn("label", F.lit(5)), out, 1, ["daytime"], replace=True)
        assert lines(out) == whole
    monkeypatch.setattr(files, "move", real)
    files.write_chunks(df.withColumn("label", F.lit(5)), out, 1, ["daytime"], replace=True)
    assert lines(out) != whole


def test_existing_batches(spark, tmp_path):
    write_log(str(tmp_path / "in"), [record(BASE), record(BASE + 1)])
    run = lambda existing: files.log_to_csv(spark, str(tmp_path / "in"), str(tmp_path / "out"), NET, check=False, existing=existing)
    folder = str(tmp_path / "out/conn/in")
    first = run("abort")
    with pytest.raises(ValueError, match="isn't empty"):
        run("abort")
    write_log(str(tmp_path / "in"), [record(BASE + 50)])
    assert run("reuse") == first and len(table(folder)) == 2
    assert len(run("replace")[folder]) == 1 and len(table(folder)) == 1
    write_log(str(tmp_path / "in"), [record(BASE + 60)])
    os.remove(f"{folder}.manifest")  # as if the last write was killed before it
    assert run("reuse")[folder] == ["00000_20231115071420.csv"]
    open(f"{folder}/more.csv", "w").write("x")  # no longer what the manifest lists
    assert run("reuse")[folder] == ["00000_20231115071420.csv"] and len(lines(folder)) == 1
    with pytest.raises(ValueError):
        run("other")
    assert files.unique_folder(spark, folder) == f"{folder}_01" and files.unique_folder(spark, str(tmp_path / "new")) == str(tmp_path / "new")


def test_addresses(spark):
    cases = [("", "198.18.7.1", None), (None, "198.18.7.1", None), ("198.18.7.1", "203.0.113.9", 1), ("172.20.4.1", "203.0.113.9", 0), ("172.20.4.1", "172.20.4.2", None), ("0198.18.7.1", "203.0.113.9", None), ("198.18.7.1.", "203.0.113.9", None), ("198.18.7.256", "203.0.113.9", None), ("+198.18.7.1", "203.0.113.9", None)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a string, b string")
    got = {r.i: r.label for r in df.select("i", net.label(F.col("a"), F.col("b"), NET).alias("label")).collect()}
    assert got == {i: x for i, (_, _, x) in enumerate(cases)}
    pairs = [("198.18.7.1", "172.20.4.1", ("snd", 1, 5)), ("192.0.2.1", "198.18.7.1", ("rcv", 1, 6)), ("172.20.4.1", "192.0.2.1", ("snd", 0, 5)), ("192.0.2.1", "172.20.4.1", ("rcv", 0, 6)), ("172.20.4.1", "172.20.4.2", None), ("192.0.2.1", "192.0.2.2", None)]
    df = spark.createDataFrame([(i, a, b, 5, 6) for i, (a, b, _) in enumerate(pairs)], "i int, a string, b string, p int, q int")
    c = {r.i: r.c for r in df.select("i", net.packet_class(F.col("a"), F.col("b"), F.col("p"), F.col("q"), NET).alias("c")).collect()}
    assert {i: x and (x.direction, x.label, x.port) for i, x in c.items()} == {i: x for i, (_, _, x) in enumerate(pairs)}


def test_session_columns():
    assert session.contract_problems(["daytime", "label", "a"], ["a"], []) == []
    assert len(session.contract_problems(["daytime", "a", "a"], ["a", "a", "label", "z"], ["a"])) == 7
