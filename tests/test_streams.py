"""Streams against batches: the flow table a file at a time, and log lines into an index through killed batches."""

import json
import random

import pytest
from pyspark.sql import functions as F

from flowmill.operators import flows, net
from flowmill.streaming import flow_table, tail

NET = net.Network(benign=("172.20.4.0/24",), malicious=("198.18.7.0/24",))
PACKET = "seq long, ts double, src string, dst string, protocol string, src_port int, dst_port int, length long"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(key, before)


def packets(n=400):
    rng, t, out = random.Random(8), 1_700_000_000.0, []
    for i in range(n):
        t += rng.choice([0, 0.25, 1, 2, 7.5])
        inner, outer = rng.choice(["172.20.4.7", "172.20.4.8", "198.18.7.9"]), f"203.0.113.{rng.randint(1, 2)}"
        src, dst = rng.choice([(inner, outer), (outer, inner), ("192.0.2.1", "192.0.2.2")])
        out.append((i, t, src, dst, rng.choice(["tcp", "udp"]), rng.randint(1, 4), rng.randint(1, 4), rng.randint(40, 1500)))
    # at the end only packets that are not listed: they alone move time on
    return [*out, (n, t + 500, "192.0.2.1", "192.0.2.2", "tcp", 1, 1, 40)]


def test_flow_stream_equals_the_batch(rocks, tmp_path):
    spark, rows = rocks, packets()
    names = []
    for part in range(5):
        spark.createDataFrame(rows[part * 90 : (part + 1) * 90], PACKET).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(PACKET).parquet(str(tmp_path / "in"))
        q = flow_table.flow_stream(stream, NET).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        names.append(max((o["numRowsTotal"] for p in q.recentProgress for o in p["stateOperators"]), default=0))
    table = spark.createDataFrame(rows, PACKET)
    listed = flows.classified(table, NET)
    end = listed.limit(1).select("pair", F.lit(10**9).alias("seq"), F.lit(rows[-1][1]).alias("ts"), "direction", "protocol", "port", "length", "label").withColumn("pair", F.lit("end"))
    batch = flows.packet_flows(listed.unionByName(end)).filter("pair != 'end'")
    found = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(batch.columns).collect()))
    assert found == sorted(map(tuple, batch.collect())) and len(found) > 30
    assert max(names) <= 4 * 6  # a flow, a timer and its places for each of six pairs


def test_lines_reach_the_index_once(spark, tmp_path):
    kind, wanted, bad = "ts double, uid string, dataset string", [], 0
    sink = tail.IndexSink(str(tmp_path / "index"), "concat('logs-', coalesce(dataset, 'none'))")
    calls = {"n": 0}

    def fragile(batch, number):
        calls["n"] += 1
        if calls["n"] == 2:  # killed while it writes
            batch.withColumn("index", F.lit("half")).drop("valid").limit(1).write.partitionBy("index").parquet(f"{tmp_path}/index/_staged-{number}")
            raise RuntimeError("killed")
        sink(batch, number)
        if calls["n"] == 4:  # killed after the rename, before the batch is committed
            raise RuntimeError("killed")

    for part in range(4):
        rows = [{"ts": i, "uid": f"{part}-{i}", "dataset": "conn" if i % 3 else None} for i in range(25)]
        wanted += [r["uid"] for r in rows]
        bad += 1
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{part}.log").write_text("\n\n".join([*(json.dumps(r) for r in rows), '{"cut": '] ) + "\n")
        for _ in range(2):  # a killed query is started again
            q = tail.tail_ndjson(spark, str(tmp_path / "in"), kind, 1).writeStream.foreachBatch(fragile).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
            try:
                q.awaitTermination()
            except Exception as e:
                assert "killed" in str(e)
    assert calls["n"] == 6
    assert sorted(r.uid for r in tail.read_index(spark, str(tmp_path / "index")).collect()) == sorted(wanted)
    assert tail.read_index(spark, str(tmp_path / "index"), "_bad").count() == bad
    assert tail.read_index(spark, str(tmp_path / "index"), "logs-none").count() == 4 * 9
