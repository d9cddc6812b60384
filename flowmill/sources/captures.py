"""Packets of capture files, read by byte ranges.

A range looks for the first record that begins in it: a header that holds, followed by others that hold.  A payload can look
like records, so what a range found is checked: the record after the last one of a range must be the first of the next.  Ranges for which
that fails are walked again from the right place, so the packets are those of a read from the start, wherever files are cut.
"""

from __future__ import annotations

import os
import struct
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

#: First bytes of classic captures (fixed values): byte order and seconds of a fraction's unit.
CLASSIC = {b"\xd4\xc3\xb2\xa1": ("<", 1e-6), b"\xa1\xb2\xc3\xd4": (">", 1e-6), b"\x4d\x3c\xb2\xa1": ("<", 1e-9), b"\xa1\xb2\x3c\x4d": (">", 1e-9)}
#: Block types of the next-generation format (fixed values): section, interface, simple packet, enhanced packet.
SECTION, INTERFACE, SIMPLE, ENHANCED = 0x0A0D0D0A, 1, 3, 6
ENDINGS = (".pcap", ".pcapng", ".cap")
#: Bytes of a range; headers in a row that must hold; the largest record; bytes read behind a range to end its last record.
RANGE, CHAIN, LARGEST = 64 << 20, 4, 1 << 18
PACKET = "path string, seq long, ts double, src string, dst string, protocol string, src_port int, dst_port int, length int"


@dataclass(frozen=True)
class State:
    """How to read at a place: ``kind`` of file, byte order, and the time units of the section's interfaces.

    A walk that starts inside a section knows only the interfaces it meets; ``fresh`` tells that it met a section's begin.
    """

    kind: str
    order: str
    units: tuple[float, ...]
    fresh: bool = False

    def then(self, later: State) -> State:
        """The state after a walk from here that found ``later``."""
        return later if later.fresh else replace(self, units=(*self.units, *later.units))


def opening(head: bytes) -> tuple[State | None, int]:
    """The state at a file's first record and its place; None for other files."""
    if head[:4] in CLASSIC and len(head) >= 24:
        order, unit = CLASSIC[head[:4]]
        return State("classic", order, (unit,)), 24
    if head[:4] == b"\x0a\x0d\x0d\x0a" and len(head) >= 12:
        return State("blocks", "<" if head[8:12] == b"\x4d\x3c\x2b\x1a" else ">", ()), 0
    return None, 0


def record(data: bytes, at: int, state: State) -> int:
    """Bytes of the record or block at ``at`` by its header; 0 if the header can't be one or isn't there whole."""
    if state.kind == "classic":
        if at + 16 > len(data):
            return 0
        _, part, size, length = struct.unpack_from(f"{state.order}IIII", data, at)
        return 16 + size if part * state.units[0] < 1 and size <= length and size <= LARGEST else 0
    if at + 12 > len(data):
        return 0
    order = state.order
    if data[at : at + 4] == b"\x0a\x0d\x0d\x0a":
        order = "<" if data[at + 8 : at + 12] == b"\x4d\x3c\x2b\x1a" else ">"
    kind, size = struct.unpack_from(f"{order}II", data, at)
    if size < 12 or size % 4 or size > LARGEST + 4096 or kind & 0x7FFF0000 and kind != SECTION:
        return 0
    if at + size <= len(data) and struct.unpack_from(f"{order}I", data, at + size - 4)[0] != size:
        return 0
    return size


def first_record(data: bytes, begin: int, limit: int, state: State, end: int) -> int | None:
    """The first place from ``begin`` on, below ``limit``, at which records follow each other; ``end`` is where the file ends."""
    for at in range(begin, limit):
        place = at
        for _ in range(CHAIN):
            size = record(data, place, state)
            if not size or place + size > end:
                break
            place += size
            if place == end:
                return at
        else:
            return at
    return None


def walk(data: bytes, at: int, stop: int, state: State) -> tuple[list[tuple[int, int, int, float]], int, State]:
    """Packets (place of the frame, its bytes, the packet's bytes, time) of records that begin before ``stop``; the place after them; the state there.

    A record that isn't whole ends the walk.
    """
    out = []
    while at < stop:
        size = record(data, at, state)
        if not size or at + size > len(data):
            break
        if state.kind == "classic":
            sec, part, held, length = struct.unpack_from(f"{state.order}IIII", data, at)
            out.append((at + 16, held, length, sec + part * state.units[0]))
        elif data[at : at + 4] == b"\x0a\x0d\x0d\x0a":
            state = State("blocks", "<" if data[at + 8 : at + 12] == b"\x4d\x3c\x2b\x1a" else ">", (), True)
        else:
            kind = struct.unpack_from(f"{state.order}I", data, at)[0]
            if kind == INTERFACE:
                state = replace(state, units=(*state.units, time_unit(data, at + 16, at + size - 4, state.order)))
            elif kind == ENHANCED and size >= 32:
                face, high, low, held, length = struct.unpack_from(f"{state.order}IIIII", data, at + 8)
                unit = state.units[face] if face < len(state.units) else 1e-6
                out.append((at + 28, min(held, size - 32), length, (high << 32 | low) * unit))
            elif kind == SIMPLE and size >= 16:
                length = struct.unpack_from(f"{state.order}I", data, at + 8)[0]
                out.append((at + 12, min(length, size - 16), length, float("nan")))
        at += size
    return out, at, state


def time_unit(data: bytes, at: int, end: int, order: str) -> float:
    """An interface's time unit from its options: microseconds unless told."""
    while at + 4 <= end:
        code, size = struct.unpack_from(f"{order}HH", data, at)
        if code == 0:
            break
        if code == 9 and size == 1:
            value = data[at + 4]
            return 2.0 ** -(value & 127) if value & 128 else 10.0**-value
        at += 4 + size + -size % 4
    return 1e-6


def fields(data: bytes, packets: list[tuple[int, int, int, float]]) -> pd.DataFrame:
    """IPv4 TCP and UDP packets of Ethernet frames; ``seq`` is the place among all packets given."""
    raw = np.frombuffer(data, np.uint8)
    at, held, length = (np.array([p[k] for p in packets], np.int64) for k in range(3))
    ts = np.array([p[3] for p in packets], np.float64)
    seq = np.flatnonzero(held >= 38)
    byte = lambda k, rows: raw[at[rows] + k].astype(np.int64)
    seq = seq[(byte(12, seq) == 8) & (byte(13, seq) == 0) & np.isin(byte(23, seq), (6, 17))]
    head = 14 + 4 * (byte(14, seq) & 15)
    seq, head = seq[held[seq] >= head + 4], head[held[seq] >= head + 4]
    port = lambda k: raw[at[seq] + head + k].astype(np.int64) * 256 + raw[at[seq] + head + k + 1]
    address = lambda k: [".".join(map(str, x)) for x in np.stack([byte(k + i, seq) for i in range(4)], axis=1).tolist()] if len(seq) else []
    return pd.DataFrame({"seq": seq, "ts": ts[seq], "src": address(26), "dst": address(30), "protocol": np.where(byte(23, seq) == 6, "tcp", "udp"), "src_port": port(0), "dst_port": port(2), "length": length[seq]})


class File:
    """Ranges of a file by its path, local or of any store that Arrow opens."""

    def __init__(self, path: str) -> None:
        self.path = path
        if path.startswith("file:"):
            self.open = lambda: open("/" + path[5:].lstrip("/"), "rb")  # noqa: SIM115
        elif "://" in path:
            fs, name = pafs.FileSystem.from_uri(path)
            self.open = lambda: fs.open_input_file(name)
        else:
            self.open = lambda: open(path, "rb")  # noqa: SIM115

    def read(self, start: int, size: int) -> bytes:
        with self.open() as f:
            f.seek(start)
            return f.read(size)


def look(path: str, start: int, stop: int, size: int, forced: int | None, order: str | None) -> tuple[int, int, int, State] | None:
    """(first, next, packets, what a walk from first finds) of a range, None without records.

    The first record is looked for, unless its place is ``forced``; ``next`` is where the record after the range's last begins.
    """
    file = File(path)
    state, begin = opening(file.read(0, 32))
    if state is None:
        return None
    state = State(state.kind, order or state.order, ())
    forced = begin if start == 0 else forced
    base = start if forced is None else forced
    data = file.read(base, stop - base + 5 * LARGEST)
    first = first_record(data, 0, stop - base, replace(state, units=(1e-6,)), size - base) if forced is None else 0
    if first is None:
        return None
    packets, after, found = walk(data, first, stop - base, state if state.kind == "blocks" else opening(file.read(0, 32))[0])
    return first + base, after + base, len(packets), found


def index(spark: SparkSession, files: list[tuple[str, int]], step: int) -> list[tuple]:
    """(path, stop, first, state, seq) of every range in which records begin; a row for each range comes to the driver.

    Ranges that don't begin where the one before ends are walked again from there.  A record that can't be one ends its file.
    """
    parts = [(path, i, at, min(at + step, size), size) for path, size in files for i, at in enumerate(range(0, size, step))]
    kind = "path string, i int, first long, next long, n long, kind string, byte_order string, units array<double>, fresh boolean"

    def run(wanted):
        rows = spark.createDataFrame([(*p, f, o) for p, f, o in wanted], "path string, i int, start long, stop long, size long, forced long, byte_order string")

        def each(batches):
            for pdf in batches:
                out = []
                for r in pdf.itertuples():
                    if told := look(r.path, r.start, r.stop, r.size, None if pd.isna(r.forced) else int(r.forced), r.byte_order):
                        first, after, n, s = told
                        out.append((r.path, r.i, first, after, n, s.kind, s.order, list(s.units), s.fresh))
                yield pd.DataFrame(out, columns=[c.split()[0] for c in kind.split(", ")])

        return {(r.path, r.i): r for r in rows.repartition(max(1, len(wanted))).mapInPandas(each, kind).collect()}

    found, exact = run([(p, None, None) for p in parts]) if parts else {}, set()
    while True:
        again, out = [], []
        for path in dict.fromkeys(p[0] for p in parts):
            own = [p for p in parts if p[0] == path]
            if (path, 0) not in found:
                continue
            begun, _ = opening(File(path).read(0, 32))
            state, place, seq = replace(begun, units=begun.units if begun.kind == "classic" else ()), found[path, 0].first, 0
            for p in own:
                _, i, start, stop, _ = p
                if place >= stop:
                    continue
                r = found.get((path, i))
                if (path, i) not in exact and i and (r is None or r.first != place or state.order != begun.order):
                    again.append((p, place, state.order))  # the ranges behind it are judged once it is right
                    exact.add((path, i))
                    break
                if r is None:
                    break
                out.append((path, stop, place, state, seq))
                if state.kind == "blocks":
                    state = state.then(State(r.kind, r.byte_order, tuple(r.units), r.fresh))
                place, seq = r.next, seq + r.n
                if place < stop:
                    break
        if not again:
            return out
        for p, _, _ in again:
            found.pop((p[0], p[1]), None)
        found |= run(again)


def list_captures(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Paths and sizes of capture files under ``path``, by their endings in any case, sorted."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files, out = at.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(at, True), []
    while files.hasNext():
        f = files.next()
        name = f.getPath().toString()
        if os.path.splitext(name)[1].lower() in ENDINGS:
            out.append((name, f.getLen()))
    return sorted(out)


def read_captures(spark: SparkSession, path: str, step: int = RANGE, where: str | None = None) -> DataFrame:
    """(path, seq, ts, src, dst, protocol, src_port, dst_port, length) of IPv4 TCP and UDP packets of captures of both formats.

    Files are read in ranges of ``step`` bytes; ``seq`` is a packet's place among all of its file.  ``where`` is a condition on the columns.  A record
    that the file's end cuts is left out.
    """
    found = index(spark, list_captures(spark, path), step)
    rows = spark.createDataFrame([(p, stop, first, s.kind, s.order, list(s.units), seq) for p, stop, first, s, seq in found], "path string, stop long, first long, kind string, byte_order string, units array<double>, base long")

    def parse(batches):
        kinds = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "int": pa.int32()}
        schema = pa.schema([(name, kinds[t]) for name, t in (c.split() for c in PACKET.split(", "))])
        for r in (row for batch in batches for row in batch.to_pylist()):
            data = File(r["path"]).read(r["first"], r["stop"] - r["first"] + 5 * LARGEST)
            packets, _, _ = walk(data, 0, r["stop"] - r["first"], State(r["kind"], r["byte_order"], tuple(r["units"])))
            for lo in range(0, len(packets), 100_000):
                out = fields(data, packets[lo : lo + 100_000])
                columns = {"path": [r["path"]] * len(out), **{c: out[c].tolist() for c in out.columns}, "seq": (out["seq"] + r["base"] + lo).tolist()}
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)

    packets = rows.repartition(max(1, len(found))).mapInArrow(parse, PACKET)
    return packets.filter(where) if where else packets
