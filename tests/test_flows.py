"""Queries against DuckDB, and the operators that SQL can't express against plain folds."""

import json
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from flowmill.functions import scalars
from flowmill.operators import drift, flows, net, order, reshape
from flowmill.plans import catalogue
from flowmill.sources import captures, files
from flowmill.streaming import replay

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(rows):
    show = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else f"{float(v):.5g}" if isinstance(v, (float, int)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(show(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = df.select(*columns).collect()
    sql = catalogue.ORACLE_SQL.get(name)
    if sql is None:
        assert got
        return
    cursor = duck.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = [tuple(dict(zip(names, r))[c] for c in columns) for r in cursor.fetchall()]
    assert canonical(got) == canonical(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_cadence_against_a_loop(spark):
    rng = random.Random(1)
    for _ in range(3):
        times, t = [], 0
        for _ in range(60):
            t += rng.choice([0, 1, 2, 25])
            times.append(t)
        df = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "seq long, us long")
        got = {r.seq: r.bucket for r in order.cadence(df, F.lit(times[0]), 5, ["us", "seq"], F.col("us")).collect()}
        following, fired = times[0] + 5, 0
        for i, t in enumerate(times):
            if t > following:
                following, fired = following + 5, fired + 1
            assert got[i] == fired


def test_labels(spark):
    own = net.Network(("172.20.4.0/24", "2001:db8::/32"), ("198.18.7.0/24", "bad/99"), ("172.20.4.200/32",))
    cases = [("198.18.7.10", "203.0.113.9", "emitted", 1), ("172.20.4.10", "203.0.113.9", "emitted", 0), ("203.0.113.9", "172.20.4.10", "emitted", 0), ("172.20.4.10", "172.20.4.20", "unlabeled", None), ("203.0.113.9", "192.0.2.1", "unlabeled", None), ("172.20.4.10", None, "unlabeled", None), ("172.20.4.200", "203.0.113.9", "excluded", 0), ("not-an-ip", "203.0.113.9", "unlabeled", None), ("2001:db8::5", "203.0.113.9", "emitted", 0), ("2001:db9::5", "203.0.113.9", "unlabeled", None), ("2001:db8::203.0.113.9", "203.0.113.9", "emitted", 0), ("2001:db8::1%eth0", "203.0.113.9", "emitted", 0), ("2001:db8::203.0.113.999", "203.0.113.9", "unlabeled", None), ("2001:db8::1%", "203.0.113.9", "unlabeled", None)]
    df = spark.createDataFrame([(a, b, "1", why, lab) for a, b, why, lab in cases], "a string, b string, ts string, why string, lab int")
    for r in df.select("*", net.reason(F.col("ts"), F.col("a"), F.col("b"), own).alias("got"), net.label(F.col("a"), F.col("b"), own).alias("label")).collect():
        assert r.got == r.why and (r.label == r.lab or r.why == "excluded")


def test_scalars(spark):
    df = spark.createDataFrame([("true", 1.0), ("0", 0.0), ("x", None), (" YES ", 1.0), ("2.5", 2.5)], "c string, want double")
    assert [r.got for r in df.select(scalars.coerced(F.col("c")).alias("got")).collect()] == [1.0, 0.0, None, 1.0, 2.5]
    assert df.select(scalars.wall_clock(F.lit(1700000001.9))).first()[0] == "2023-11-15 07:13:21"


def test_packet_flow_expiry(spark):
    rows = [("p", i, t, d, "tcp", 80, 10, 0) for i, (t, d) in enumerate([(0.0, "rcv"), (30.0, "rcv"), (60.0, "snd"), (61.0, "rcv"), (200.0, "rcv")])]
    df = spark.createDataFrame(rows, "pair string, seq long, ts double, direction string, protocol string, port int, length long, label int")
    got = sorted((r.start, r.n, r.rcv_max_interval, r.snd_min_length) for r in flows.packet_flows(df).collect())
    assert got == [(0.0, 3, 30.0, 10), (61.0, 1, 60.0, -10000)]
    assert flows.packet_flows(df, flush_open=True).count() == 3


def test_chunks_on_disk(spark, tmp_path):
    df = spark.createDataFrame([(f"2022-01-01 09:00:{i:02d}", i % 2) for i in range(7)], "t string, label int").select(F.col("t").cast("timestamp_ntz").alias("daytime"), "label")
    path = str(tmp_path / "out")
    names = files.write_chunks(df, path, 3, ["daytime"])
    assert spark.read.option("header", True).csv(path).count() == 7
    assert names == ["00000_20220101090000.csv", "00001_20220101090003.csv", "00002_20220101090006.csv"]
    with pytest.raises(ValueError):
        files.write_chunks(df, path, 3, ["daytime"])
    with pytest.raises(ValueError):
        reshape.chunked(df, 0, ["daytime"])


def test_sources(spark, tmp_path):
    (tmp_path / "conn.log").write_text("\n".join(json.dumps(x) for x in ({"ts": 1, "id.orig_h": "10.0.0.1"}, {"ts": 2, "id.orig_h": "10.0.0.2"})) + "\n\n")
    assert files.read_ndjson(spark, str(tmp_path / "conn.log"))[0].count() == 2
    frame = bytes(12) + b"\x08\x00" + bytes([0x45]) + bytes(8) + bytes([17]) + bytes(2) + bytes([1, 2, 3, 4]) + bytes([5, 6, 7, 8]) + b"\x00\x35\x01\xbb" + bytes(8)
    import struct

    (tmp_path / "a.pcap").write_bytes(b"\xd4\xc3\xb2\xa1" + bytes(20) + struct.pack("<IIII", 10, 500000, len(frame), len(frame)) + frame)
    rows = captures.read_captures(spark, str(tmp_path)).collect()
    assert [(r.ts, r.src, r.dst, r.protocol, r.src_port, r.dst_port) for r in rows] == [(10.5, "1.2.3.4", "5.6.7.8", "udp", 53, 443)]
    assert {r.extension for r in files.capture_extensions(spark, str(tmp_path)).collect()} == {None, ".pcap"}


def test_nearest_against_numpy(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(5, 4)), rng.normal(size=(40, 4))
    df = lambda x, at: spark.createDataFrame([(at + i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {(r.vec_id, r["rank"]): r.neighbour for r in drift.nearest(df(a, 0), df(b, 100), 3).collect()}
    far = ((a[:, None] - b[None]) ** 2).sum(2)
    assert got == {(i, k + 1): 100 + int(j) for i in range(5) for k, j in enumerate(np.argsort(far[i])[:3])}


def test_nearest_among_all_rows(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 4))
    x[200] = x[100]
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r.vec_id, r["rank"]): r.neighbour for r in entry.queries()["knn_l2_all"](spark, str(tmp_path)).collect()}
    far = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(far, np.inf)
    assert got == {(i, k + 1): int(j) for i in range(0, 500, 100) for k, j in enumerate(np.argsort(far[i], kind="stable")[:8])}
    assert got[100, 1] == 200 and got[200, 1] == 100


def test_training_cost_of_every_event(spark):
    rows = catalogue.flow_view(spark, SF).select("seq", F.floor(F.col("us") / 1_000_000).alias("s"), "label", "k").collect()
    got = {r.seq: (r.s, r.cost) for r in entry.queries()["training_cost_range_join"](spark, SF).collect()}
    assert set(got) == {r.seq for r in rows}
    for r in rows:
        assert got[r.seq] == (r.s, pytest.approx(sum(x.k or 0 for x in rows if x.label == 1 and r.s - 1800 <= x.s < r.s + 1800)))


def test_replay_modes(spark, tmp_path):
    rng = random.Random(2)
    rows = [("a", i, float(i * 10), i % 2, i % 2 + rng.random() / 4, rng.random()) for i in range(400)]
    df = spark.createDataFrame(rows, "key string, seq long, t double, label int, x double, y double")
    late = replay.replay(df, ["x", "y"], "st", interval=500.0, epochs=200, rate=0.01).filter("seq > 300").collect()
    assert sum((r.score >= 0.5) == (r.label == 1) for r in late) > 0.9 * len(late)
    assert not any(r.retrained for r in replay.replay(df, ["x", "y"], "nt").collect())
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    q = replay.replay_stream(stream, ["x", "y"], "st", interval=500.0, start=0.0).writeStream.format("memory").queryName("replayed").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    batch = {r.seq: r.score for r in replay.replay(df, ["x", "y"], "st", interval=500.0).collect()}
    assert {r.seq: pytest.approx(r.score) for r in spark.table("replayed").collect()} == batch
