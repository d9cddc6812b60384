"""CIDR membership, labels and directions of flows, as native expressions."""

from __future__ import annotations

import ipaddress
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Network:
    benign: tuple[str, ...] = ()
    malicious: tuple[str, ...] = ()
    exception: tuple[str, ...] = ()


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ipv4_number(address: Column) -> Column:
    """Address text as a number, null unless it is a dotted IPv4 address without leading zeros."""
    numbers = F.transform(F.split(address, r"\.", -1), lambda p: let(p.try_cast("int"), lambda x: F.when(x.cast("string") == p, x)))
    whole = lambda x: (F.size(x) == 4) & F.forall(x, lambda v: v.between(0, 255))
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda acc, v: acc * 256 + v)
    return let(numbers, lambda x: F.when(whole(x), total(x)))


def ipv6_hex(address: Column) -> Column:
    """Address text as 32 hex digits, null unless it is an IPv6 address of hex groups, one ``::`` at most.

    A zone behind a percent sign is left out, and the last two groups may be a dotted IPv4 address.
    """
    bare = F.regexp_replace(F.lower(address), "%[^%]+$", "")
    dotted = F.regexp_extract(bare, r":([0-9.]+\.[0-9.]+)$", 1)
    tail = F.format_string("%x:%x", F.shiftright(ipv4_number(dotted), 16), ipv4_number(dotted).bitwiseAND(0xFFFF))
    text = F.when(dotted == "", bare).when(ipv4_number(dotted).isNotNull(), F.concat(F.regexp_replace(bare, r"[0-9.]+$", ""), tail))
    halves = F.split(text, "::", -1)
    groups = lambda x: F.filter(F.split(x, ":", -1), lambda g: g != "")
    left, right = groups(F.get(halves, 0)), F.coalesce(groups(F.get(halves, 1)), F.array().cast("array<string>"))
    missing = 8 - F.size(left) - F.size(right)
    short = F.size(halves) == 2
    ok = text.rlike("^[0-9a-f:]+$") & text.contains(":") & ~text.rlike(":::|^:[^:]|[^:]:$|[0-9a-f]{5}") & F.when(short, missing >= 1).otherwise((F.size(halves) == 1) & (missing == 0))
    whole = F.concat(left, F.array_repeat(F.lit("0"), F.when(short, F.greatest(missing, F.lit(0))).otherwise(0)), right)
    return F.when(ok, F.array_join(F.transform(whole, lambda g: F.lpad(g, 4, "0")), ""))


def ranges(networks: tuple[str, ...], version: int) -> list[tuple[int, int]]:
    """Disjoint first and last addresses of the networks of a version; texts that aren't networks are left out."""
    found = []
    for text in networks:
        try:
            net = ipaddress.ip_network(text, strict=False)
        except ValueError:
            continue
        if net.version == version:
            found.append(net)
    return [(int(n.network_address), int(n.broadcast_address)) for n in ipaddress.collapse_addresses(found)]


def within(v4: Column, v6: Column, networks: tuple[str, ...]) -> Column:
    """Whether a parsed address is in one of the networks; false for nulls and without networks."""
    hit = F.lit(False)
    for lo, hi in ranges(networks, 4):
        hit = hit | v4.between(lo, hi)
    for lo, hi in ranges(networks, 6):
        hit = hit | v6.between(f"{lo:032x}", f"{hi:032x}")
    return F.coalesce(hit, F.lit(False))


def parsed(address: Column) -> Column:
    """(text, v4, v6) of an address; an empty text counts as missing."""
    text = F.nullif(address, F.lit(""))
    return F.struct(text.alias("text"), ipv4_number(text).alias("v4"), F.when(text.contains(":"), ipv6_hex(text)).alias("v6"))


def in_any(address: Column, networks: tuple[str, ...]) -> Column:
    """Whether the address is in one of the networks; false for null, invalid addresses and no networks."""
    return let(parsed(address), lambda x: within(x["v4"], x["v6"], networks))


def flags(orig: Column, resp: Column, net: Network, body) -> Column:
    """``body`` of the flags of a pair of addresses, each address parsed and each network test made once."""

    def of(s: Column) -> Column:
        o, r = s["o"], s["r"]
        test = lambda x, kind: within(x["v4"], x["v6"], getattr(net, kind))
        own = [test(x, kind).alias(f"{side}_{kind}") for x, side in ((o, "orig"), (r, "resp")) for kind in ("benign", "malicious")]
        barred = test(o, "exception") | test(r, "exception")
        both = o["text"].isNotNull() & r["text"].isNotNull()
        return F.struct(both.alias("both"), (both & barred).alias("excluded"), *own)

    return let(F.struct(parsed(orig).alias("o"), parsed(resp).alias("r")), lambda s: let(of(s), body))


def _label(f: Column) -> Column:
    bad = f["orig_malicious"] | f["resp_malicious"]
    return F.when(f["both"] & bad, 1).when(f["both"] & (f["orig_benign"] != f["resp_benign"]), 0)


def excluded(orig: Column, resp: Column, net: Network) -> Column:
    return flags(orig, resp, net, lambda f: f["excluded"])


def label(orig: Column, resp: Column, net: Network) -> Column:
    """1 if either address is malicious, 0 if exactly one is benign, else null; null if one is missing or empty."""
    return flags(orig, resp, net, _label)


def verdict(ts: Column, orig: Column, resp: Column, net: Network) -> Column:
    """(reason, label): why a record is dropped, in the order of the checks, or ``emitted``."""

    def of(f: Column) -> Column:
        why = F.when(ts.try_cast("double").isNull(), "invalid_ts").when(f["excluded"], "excluded").when(_label(f).isNull(), "unlabeled").otherwise("emitted")
        return F.struct(why.alias("reason"), _label(f).alias("label"))

    return flags(orig, resp, net, of)


def reason(ts: Column, orig: Column, resp: Column, net: Network) -> Column:
    return verdict(ts, orig, resp, net)["reason"]


def direction(orig: Column, resp: Column, net: Network, local_orig: Column | None = None, local_resp: Column | None = None) -> Column:
    """outbound, inbound or unknown: malicious source, malicious destination, one benign side, local flags."""

    def of(f: Column) -> Column:
        a, b = f["orig_benign"], f["resp_benign"]
        out = F.when(f["orig_malicious"], "outbound").when(f["resp_malicious"], "inbound").when(a & ~b, "outbound").when(b & ~a, "inbound")
        if local_orig is not None and local_resp is not None:
            out = out.when(local_orig & ~local_resp, "outbound").when(local_resp & ~local_orig, "inbound")
        return out.otherwise("unknown")

    return flags(orig, resp, net, of)


def packet_class(src: Column, dst: Column, src_port: Column, dst_port: Column, net: Network) -> Column:
    """(external, internal, direction, port, label) of a packet, null if neither side is listed.

    The first that holds: the source is malicious (``snd``, 1), the destination is (``rcv``, 1), only the source is
    benign (``snd``, 0), only the destination is (``rcv``, 0).  The port is the listed side's.
    """

    def made(sent: bool, label: int) -> Column:
        outer, inner, port = (dst, src, src_port) if sent else (src, dst, dst_port)
        return F.struct(outer.alias("external"), inner.alias("internal"), F.lit("snd" if sent else "rcv").alias("direction"), port.alias("port"), F.lit(label).alias("label"))

    def of(f: Column) -> Column:
        a, b = f["orig_benign"], f["resp_benign"]
        return F.when(f["orig_malicious"], made(True, 1)).when(f["resp_malicious"], made(False, 1)).when(a & ~b, made(True, 0)).when(b & ~a, made(False, 0))

    return flags(src, dst, net, of)
