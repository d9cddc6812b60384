"""Connection records to labelled flow rows, and packets to flows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import numeric, wall_clock
from .net import Network, packet_class, reason, verdict
from .order import segments

#: Columns that every flow row has (fixed values).
REQUIRED = ("daytime", "label", "conn_state", "duration", "orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts", "orig_ip_bytes", "resp_ip_bytes", "missed_bytes", "local_orig", "local_resp")


def labelled_flows(records: DataFrame, net: Network, zone: str = "Asia/Tokyo", padded: bool = True) -> DataFrame:
    """Flow rows of connection records: end time in the zone, duration or 0, label; with ``padded`` required columns are added.

    Records with a bad time, an excluded address or no label go; ``reason_counts`` tells how many.
    """
    orig, resp, ts = F.col("`id.orig_h`"), F.col("`id.resp_h`"), F.col("ts").cast("string")
    duration = F.coalesce(numeric(F.col("duration").cast("string")), F.lit(0.0)) if "duration" in records.columns else F.lit(0.0)
    if "duration" not in records.columns and not padded:
        return labelled_flows(records.withColumn("duration", F.lit(None).cast("string")), net, zone, False).drop("duration")
    told = records.withColumn("_v", verdict(ts, orig, resp, net)).filter("_v.reason = 'emitted'")
    out = told.withColumns({"daytime": wall_clock(numeric(ts) + duration, zone), "duration": duration, "label": F.col("_v.label")}).drop("ts", "_v")
    for name in REQUIRED if padded else ():
        if name not in out.columns:
            out = out.withColumn(name, F.lit(""))
    return out


def reason_counts(records: DataFrame, net: Network) -> DataFrame:
    why = reason(F.col("ts").cast("string"), F.col("`id.orig_h`"), F.col("`id.resp_h`"), net)
    return records.groupBy(why.alias("reason")).agg(F.count("*").alias("n"))


def classified(packets: DataFrame, net: Network) -> DataFrame:
    """Packets (path, seq, ts, src, dst, protocol, src_port, dst_port, length) with their pair, direction, port and label.

    Packets between addresses that aren't listed go.
    """
    told = packets.withColumn("_c", packet_class(F.col("src"), F.col("dst"), F.col("src_port"), F.col("dst_port"), net)).filter("_c is not null")
    return told.select(F.concat_ws("|", "_c.external", "_c.internal").alias("pair"), "seq", "ts", "_c.direction", "protocol", "_c.port", "length", "_c.label")


PACKET_FLOW = "pair string, start double, n long, n_rcv long, n_snd long, tcp long, udp long, most_port long, port_count long, rcv_max_length long, rcv_min_length long, snd_max_length long, snd_min_length long, rcv_max_interval double, rcv_min_interval double, snd_max_interval double, snd_min_interval double, label long"


def packet_flows(packets: DataFrame, timeout: float = 60.0, flush_open: bool = False) -> DataFrame:
    """Flows of packets (pair, seq, ts, direction, protocol, port, length, label) of unordered address pairs.

    A packet opens a new flow when its time is more than ``timeout`` after the flow's start; the flow is
    emitted if any later packet of the table is that late, or with ``flush_open``.  Empty lengths are
    -10000 and 0, missing intervals 60; the port is the first received one to reach the largest count.

    A gap above ``timeout`` always opens a flow, so pairs are cut at such gaps and their parts dealt over the cluster.
    Tasks stream sorted packets and hold one part's open flow.
    """
    last = packets.agg(F.max("ts")).first()[0]
    gap = (F.col("pair") != F.col("_pair")) | (F.col("ts") - F.col("_ts") > timeout)
    parts = segments(packets, ["pair", "ts", "seq"], {"_pair": "pair", "_ts": "ts"}, gap, "_segment")
    rows = parts.select("pair", F.col("_segment").alias("_part"), "ts", "seq", (F.col("direction") == "rcv").alias("rcv"), F.col("protocol"), F.col("port").cast("long"), F.col("length").cast("long"), F.col("label").cast("long"))
    dealt = rows.repartition("pair", "_part").sortWithinPartitions("pair", "_part", "ts", "seq")

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            starts = flow_starts(held, timeout)
            if len(starts) > 1:  # the last flow may go on in the next batch
                yield from summaries(held.slice(0, int(starts[-1])), starts[:-1], timeout, last, flush_open)
                held = held.slice(int(starts[-1]))
        if held is not None and held.num_rows:
            yield from summaries(held, flow_starts(held, timeout), timeout, last, flush_open)

    return dealt.mapInArrow(run, PACKET_FLOW)


def flow_starts(table: pa.Table, timeout: float) -> np.ndarray:
    """Rows that open a flow, in packets sorted by pair, part and time."""
    ts = table.column("ts").to_numpy()
    pair = table.column("pair").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    part = table.column("_part").to_numpy()
    edges = np.flatnonzero((np.diff(pair) != 0) | (np.diff(part) != 0)) + 1
    out = []
    for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(ts)], strict=True):
        own = ts[lo:hi]
        at = 0
        while at < hi - lo:
            out.append(lo + at)
            at += int(np.searchsorted(own[at:] - own[at], timeout, "right"))
    return np.array(out, np.int64)


def summaries(table: pa.Table, starts: np.ndarray, timeout: float, last: float, flush_open: bool):
    """The flows' summary rows; every array below has a value for each packet or for each flow."""
    ts = table.column("ts").to_numpy()
    rcv, port, length, label = (table.column(c).to_numpy() for c in ("rcv", "port", "length", "label"))
    protocol = table.column("protocol").to_numpy()
    sizes = np.diff(np.append(starts, len(ts)))
    flow = np.repeat(np.arange(len(starts)), sizes)
    count = lambda mask: np.bincount(flow[mask], minlength=len(starts))
    columns = {"start": ts[starts], "n": sizes, "n_rcv": count(rcv), "n_snd": count(~rcv), "tcp": count(protocol == "tcp"), "udp": count(protocol == "udp"), "label": label[starts]}
    for side, mask in (("rcv", rcv), ("snd", ~rcv)):
        top, low = np.full(len(starts), np.iinfo(np.int64).min), np.full(len(starts), np.iinfo(np.int64).max)
        np.maximum.at(top, flow[mask], length[mask])
        np.minimum.at(low, flow[mask], length[mask])
        has = columns[f"n_{side}"] > 0
        columns |= {f"{side}_max_length": np.where(has, top, 0), f"{side}_min_length": np.where(has, low, -10000)}
        own, gaps = flow[mask], np.diff(ts[mask])
        inner = own[1:] == own[:-1]
        wide, narrow = np.full(len(starts), -np.inf), np.full(len(starts), np.inf)
        np.maximum.at(wide, own[1:][inner], gaps[inner])
        np.minimum.at(narrow, own[1:][inner], gaps[inner])
        several = columns[f"n_{side}"] > 1
        columns |= {f"{side}_max_interval": np.where(several, wide, 60.0), f"{side}_min_interval": np.where(several, narrow, 60.0)}
    # how often a received port was seen before in its flow; the first to reach the largest count wins
    where = np.flatnonzero(rcv)
    order = np.lexsort((where, port[where], flow[where]))
    f, p = flow[where][order], port[where][order]
    new = np.concatenate([[True], (f[1:] != f[:-1]) | (p[1:] != p[:-1])]) if len(f) else np.zeros(0, bool)
    nth = np.arange(len(f)) - np.maximum.accumulate(np.where(new, np.arange(len(f)), 0)) + 1
    columns["port_count"] = np.bincount(f[new], minlength=len(starts))
    most = np.zeros(len(starts), np.int64)
    best = np.lexsort((where[order], -nth, f))
    heads = best[np.concatenate([[True], np.diff(f[best]) != 0])] if len(f) else best
    most[f[heads]] = p[heads]
    columns |= {"most_port": most, "pair": table.column("pair").take(pa.array(starts))}
    done = np.ones(len(starts), bool) if flush_open else last > ts[starts] + timeout
    names = [c.split()[0] for c in PACKET_FLOW.split(", ")]
    out = pa.table({c: columns[c] if c == "pair" else pa.array(columns[c], pa.float64() if c == "start" or c.endswith("interval") else pa.int64()) for c in names})
    yield from out.filter(pa.array(done)).combine_chunks().to_batches()
