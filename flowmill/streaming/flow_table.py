"""The flow table as a stream: packets come in order of time, flows leave when they are old."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.flows import PACKET_FLOW
from ..operators.net import Network, packet_class

NAMES = [c.split()[0] for c in PACKET_FLOW.split(", ")]


class Flow:
    """What is kept of an open flow: sums by direction and the counts of received ports, no packets."""

    def __init__(self, held: dict | None = None) -> None:
        self.held = held or {"start": None, "label": 0, "tcp": 0, "udp": 0, "ports": {}, "most": [0, 0], **{s: {"n": 0, "max": None, "min": None, "last": None, "wide": None, "narrow": None} for s in ("rcv", "snd")}}

    def add(self, ts: float, direction: str, protocol: str, port: int, length: int, label: int) -> None:
        h = self.held
        if h["start"] is None:
            h["start"], h["label"] = ts, label
        h["tcp"] += protocol == "tcp"
        h["udp"] += protocol != "tcp"
        side = h["rcv" if direction == "rcv" else "snd"]
        if side["n"]:
            gap = ts - side["last"]
            side["wide"] = gap if side["wide"] is None else max(side["wide"], gap)
            side["narrow"] = gap if side["narrow"] is None else min(side["narrow"], gap)
        side["max"] = length if side["n"] == 0 else max(side["max"], length)
        side["min"] = length if side["n"] == 0 else min(side["min"], length)
        side["n"], side["last"] = side["n"] + 1, ts
        if direction == "rcv":
            n = h["ports"][str(port)] = h["ports"].get(str(port), 0) + 1
            if n > h["most"][1]:  # the first port to reach the largest count
                h["most"] = [port, n]

    def row(self, pair: str) -> tuple:
        h = self.held
        out = {"pair": pair, "start": h["start"], "n": h["rcv"]["n"] + h["snd"]["n"], "tcp": h["tcp"], "udp": h["udp"], "most_port": h["most"][0], "port_count": len(h["ports"]), "label": h["label"]}
        for s in ("rcv", "snd"):
            own = h[s]
            out |= {f"n_{s}": own["n"], f"{s}_max_length": own["max"] if own["n"] else 0, f"{s}_min_length": own["min"] if own["n"] else -10000, f"{s}_max_interval": 60.0 if own["wide"] is None else own["wide"], f"{s}_min_interval": 60.0 if own["narrow"] is None else own["narrow"]}
        return tuple(out[c] for c in NAMES)


class FlowTable(StatefulProcessor):
    """One open flow a pair, with a timer at its largest age; a later packet of the pair or the stream's time closes it."""

    def __init__(self, timeout: float) -> None:
        self.timeout = timeout

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("flow", "held string")

    def timer(self, flow: Flow) -> int:
        return int((flow.held["start"] + self.timeout) * 1000) + 1

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        flow, out = Flow(json.loads(self.open.get()[0])) if self.open.exists() else None, []
        if flow:
            self.handle.deleteTimer(self.timer(flow))
        for pdf in [pd.concat(list(rows)).sort_values(["ts", "seq"], kind="stable")]:
            for ts, *packet in zip(*(pdf[c].tolist() for c in ("ts", "direction", "protocol", "port", "length", "label")), strict=True):
                if flow and ts - flow.held["start"] > self.timeout:
                    out.append(flow.row(key[0]))
                    flow = None
                flow = flow or Flow()
                flow.add(ts, *packet)
        self.open.update((json.dumps(flow.held),))
        self.handle.registerTimer(self.timer(flow))
        yield pd.DataFrame(out, columns=NAMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.open.get()
        self.open.clear()
        yield pd.DataFrame([Flow(json.loads(held[0])).row(key[0])], columns=NAMES)

    def close(self) -> None:
        pass


def flow_stream(packets: DataFrame, net: Network, timeout: float = 60.0) -> DataFrame:
    """Flows of a stream of packets (seq, ts, src, dst, protocol, src_port, dst_port, length) whose micro-batches come in order of time.

    All packets move the stream's time on, those between addresses that aren't listed too; a flow leaves once that time has passed its start by more
    than ``timeout``, to a millisecond or two.  The state has a row for each open flow.  Needs the RocksDB state store.
    """
    timed = packets.withColumn("time", F.timestamp_micros((F.col("ts") * 1_000_000).cast("long"))).withWatermark("time", "1 millisecond")
    told = timed.withColumn("_c", packet_class(F.col("src"), F.col("dst"), F.col("src_port"), F.col("dst_port"), net))
    rows = told.select(F.concat_ws("|", "_c.external", "_c.internal").alias("pair"), "seq", "ts", "_c.direction", "protocol", "_c.port", "length", "_c.label", "time")
    # a plain filter would be pushed below the watermark, which then wouldn't see the packets that go; this one, always against 0, isn't
    rows = rows.filter(F.length("pair") > F.floor(F.rand()))
    return rows.groupBy("pair").transformWithStateInPandas(FlowTable(timeout), outputStructType=PACKET_FLOW, outputMode="Append", timeMode="EventTime")

