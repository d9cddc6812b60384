"""Captures cut at every offset against a read from the start; classes and flows of the packets read."""

import random
import struct

import pytest

from flowmill.operators import flows, net
from flowmill.sources import captures

NET = net.Network(benign=("172.20.4.0/24",), malicious=("198.18.7.0/24",))


def frame(rng, payload=b""):
    src, dst = rng.choice([(172, 20, 4, 7), (198, 18, 7, 9)]), (203, 0, 113, rng.randint(1, 3))
    src, dst = (src, dst) if rng.random() < 0.6 else (dst, src)
    head = bytes(12) + (b"\x08\x00" if rng.random() < 0.9 else b"\x86\xdd")
    return head + bytes([0x45]) + bytes(8) + bytes([rng.choice([6, 17, 1])]) + bytes(2) + bytes(src) + bytes(dst) + struct.pack(">HH", rng.randint(1, 65535), rng.randint(1, 65535)) + payload


def classic(rng, n, order="<", magic=b"\xd4\xc3\xb2\xa1", depth=1):
    out, t = magic + bytes(20), 1_700_000_000
    for i in range(n):
        # a payload that is a capture itself looks like records
        body = classic(rng, 6, order, magic, 0)[24:] if depth and i % 7 == 3 else bytes(rng.randrange(256) for _ in range(rng.randint(0, 60)))
        packet = frame(rng, body)
        t += rng.randint(0, 20)
        out += struct.pack(f"{order}IIII", t, rng.randint(0, 999_999), len(packet), len(packet) + rng.randint(0, 9)) + packet
    return out


def blocks(rng, n):
    def block(order, kind, body):
        body += bytes(-len(body) % 4)
        return struct.pack(f"{order}II", kind, len(body) + 12) + body + struct.pack(f"{order}I", len(body) + 12)

    out = b""
    for section in range(2):
        order = "<>"[section]
        out += block(order, captures.SECTION, struct.pack(f"{order}IHHq", 0x1A2B3C4D, 1, 0, -1))
        out += block(order, captures.INTERFACE, struct.pack(f"{order}HHI", 1, 0, 0))
        for i in range(n):
            if i == n // 2:  # a second interface with nanoseconds
                out += block(order, captures.INTERFACE, struct.pack(f"{order}HHI", 1, 0, 0) + struct.pack(f"{order}HHBxxxHH", 9, 1, 9, 0, 0))
            face = int(i > n // 2 and rng.random() < 0.5)
            packet, ticks = frame(rng, bytes(rng.randint(0, 40))), 1_700_000_000 * 10 ** (9 if face else 6) + i
            out += block(order, captures.ENHANCED, struct.pack(f"{order}IIIII", face, ticks >> 32, ticks & 0xFFFFFFFF, len(packet), len(packet)) + packet)
            if i % 5 == 0:
                out += block(order, 5, bytes(12))
    return out


def sequential(data):
    state, begin = captures.opening(data[:32])
    packets, _, _ = captures.walk(data, begin, len(data), state)
    return [tuple(r) for r in captures.fields(data, packets).itertuples(index=False)]


def read(spark, path, step):
    return [tuple(r)[1:] for r in captures.read_captures(spark, path, step).orderBy("path", "seq").collect()]


@pytest.mark.parametrize("kind", ["little", "big", "nano", "blocks"])
def test_cuts_at_every_offset(spark, tmp_path, kind, monkeypatch):
    rng = random.Random(kind)
    data = {"little": lambda: classic(rng, 12), "big": lambda: classic(rng, 12, ">", b"\xa1\xb2\xc3\xd4"), "nano": lambda: classic(rng, 12, "<", b"\x4d\x3c\xb2\xa1"), "blocks": lambda: blocks(rng, 8)}[kind]()
    path = tmp_path / "a.PCAP"
    path.write_bytes(data)
    wanted = sequential(data)
    assert len(wanted) > 5

    class Local:  # the index alone, without jobs
        class Frame:
            def __init__(self, rows, kind):
                self.rows, self.names = rows, [c.split()[0] for c in kind.split(", ")]

            def repartition(self, n):
                return self

            def mapInPandas(self, f, kind):
                import pandas as pd

                self.out = pd.concat(list(f(iter([pd.DataFrame(self.rows, columns=self.names)]))))
                return self

            def collect(self):
                return list(self.out.itertuples())

        def createDataFrame(self, rows, kind):
            return self.Frame(rows, kind)

    for step in range(30, len(data), 7):
        found = []
        for name, stop, first, state, base in captures.index(Local(), [(str(path), len(data))], step):
            part = captures.File(name).read(first, stop - first + 5 * captures.LARGEST)
            packets, _, _ = captures.walk(part, 0, stop - first, state)
            found += [(r[0] + base, *r[1:]) for r in captures.fields(part, packets).itertuples(index=False)]
        assert found == wanted, step
    assert read(spark, str(tmp_path), 101) == wanted


def test_damaged_and_other_files(spark, tmp_path):
    rng = random.Random(3)
    data = classic(rng, 30)
    (tmp_path / "cut.pcap").write_bytes(data[:-5])
    (tmp_path / "not.pcap").write_bytes(b"something else" * 9)
    (tmp_path / "none.pcapng").write_bytes(b"")
    (tmp_path / "a.txt").write_bytes(data)
    assert read(spark, str(tmp_path), 200) == sequential(data[:-5])
    assert captures.read_captures(spark, str(tmp_path), 200, "protocol = 'udp' AND dst_port < 1000").filter("protocol = 'tcp' OR dst_port >= 1000").count() == 0


def test_flows_of_packets_read(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(classic(random.Random(4), 200, depth=0))
    packets = flows.classified(captures.read_captures(spark, str(tmp_path), 3000), NET)
    rows = packets.collect()
    assert {r.direction for r in rows} == {"snd", "rcv"} and {r.label for r in rows} == {0, 1}
    found = flows.packet_flows(packets, flush_open=True).collect()
    assert sum(r.n for r in found) == len(rows) and {r.label for r in found} <= {0, 1}
