"""Suffix-array deduplication: bytes covered by a long enough string that also starts earlier go.

The longest-previous-factor array of a text tells, for each position, the longest match with an earlier
one; in suffix order it is given by the previous and the next smaller position.  Only factors of at least
``length`` bytes matter here, so the corpus is never sorted whole:

1. Every window of ``length`` bytes has an anchor, its leftmost least hash of ``GRAM`` bytes.  Equal
   windows have equal anchors at equal places, so equal strings meet at anchors with an equal gram.
2. Anchors are sorted by gram and by the content around them, which reaches as far as any window with that anchor.
   An anchor whose content occurred earlier has a previous factor as long as its content: a long copy
   and a large group of copies end here, in a streamed comparison of neighbours.  Contents are compared by two
   hashes, of 64 bits and modulo a prime, 95 bits together, and not byte by byte: their bytes would be shuffled five times.
   A slice keeps its own copies back, and spreads a gram with many contents over its contents, so that neither a
   common passage nor a large group of copies meets in one task.
3. The anchors left, the first of their content, may share part of it with others of the same gram.  Their
   suffixes are put in suffix order to depth ``length`` by their bytes; a suffix with a previous or next smaller
   position in its run of that order has an earlier factor of that length.  Groups are formed by the half window that
   all their windows share.  A group too large for one task is split further, by whole windows; among equal windows
   all but the smallest position have an earlier one, and that is an aggregation's minimum.
4. The covered intervals of a document are united and cut out.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BYTES, batch_of, byte_slices, cut, drop, mix
from .store import open_store, shard_bits, write_store

LENGTH, GRAM = 100, 40
#: Rows of a group of half windows beyond which it is split by whole windows; rows put in suffix order at once.
LARGE, BATCH = 5_000, 2_000
#: Contents of a gram in one slice from which the gram is spread over its contents; bytes of a slice.
HOT, SLICE = 4, 768 << 10
PRIME = (1 << 31) - 1
BASE = 0x9E3779B97F4A7C15 | 1
NOBODY = -(1 << 63)


def _doubled(first: int, n: int, modulus: int | None = None) -> np.ndarray:
    """Powers 0 to n - 1 of ``first``, modulo 2 to the 64 or ``modulus``."""
    out = np.ones(1, np.uint64)
    with np.errstate(over="ignore"):
        while len(out) < n:
            step = np.uint64(pow(first, len(out), modulus or 1 << 64))
            more = out * step
            out = np.concatenate([out, more % np.uint64(modulus) if modulus else more])
    return out


@lru_cache(maxsize=1)
def _tables(n: int) -> tuple[np.ndarray, ...]:
    return _doubled(BASE, n), _doubled(pow(BASE, -1, 1 << 64), n), _doubled(48271, n, PRIME), _doubled(pow(48271, -1, PRIME), n, PRIME)


class Hashes:
    """Hashes of any substring of a byte array, from running sums; ``checked`` adds those modulo a prime."""

    def __init__(self, data: np.ndarray, checked: bool = False) -> None:
        n = len(data)
        up, self.down, up_p, self.down_p = _tables(max(SLICE, 1 << n.bit_length()))
        self.sums = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(BYTES[data] * up[:n], out=self.sums[1:])
            if checked:
                self.sums_p = np.zeros(n + 1, np.uint64)
                np.cumsum((data + np.uint64(1)) * up_p[:n] % np.uint64(PRIME), out=self.sums_p[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[stop] - self.sums[start]) * self.down[start] + (stop - start).astype(np.uint64))

    def check(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return ((self.sums_p[stop] - self.sums_p[start]) % np.uint64(PRIME) * self.down_p[start] % np.uint64(PRIME)).astype(np.int32)


def anchors_of(data: np.ndarray, ends: np.ndarray, length: int, gram: int, hashes: Hashes) -> np.ndarray:
    """Anchor positions of all windows that lie within a document; ``ends`` are the documents' ends."""
    n = len(data) - gram + 1
    span = length - gram + 1
    if n < span:
        return np.zeros(0, np.int64)
    at = np.arange(n)
    bits = np.uint64(max(24, int(n).bit_length()))
    least = hashes.of(at, at + gram) >> bits << bits | at.astype(np.uint64)
    width = 1
    while 2 * width <= span:  # minima of 2, 4, 8 ... neighbours
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    chosen = (least & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    begin = np.concatenate([[0], ends[:-1]])
    size = ends - begin
    whole = size >= length
    inside = np.zeros(len(chosen) + 1, np.int32)
    np.add.at(inside, begin[whole], 1)
    np.add.at(inside, (ends - length + 1)[whole], -1)
    chosen = chosen[np.cumsum(inside[:-1]) > 0]
    return chosen[np.concatenate([[True], np.diff(chosen) != 0])] if len(chosen) else chosen


def flat_bytes(part: pa.RecordBatch, column: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column and the rows' ends."""
    values = [x or b"" for x in part.column(column).to_pylist()]
    return np.frombuffer(b"".join(values), np.uint8), np.cumsum([len(v) for v in values], dtype=np.int64)


#: What an anchor's row is: to be compared within its gram; a copy of another in its slice; of a gram spread over
#: its contents; a mark that this gram occurs elsewhere.
ALONE, COPY, SPREAD, MARK = range(4)


def anchor_table(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(gram, salt, content, check, doc, pos, row, kind) of every anchor; ``docs`` has doc long, data binary, row long."""
    reach = length - gram
    schema = pa.schema([("gram", pa.int64()), ("salt", pa.int32()), ("content", pa.int64()), ("check", pa.int32()), ("doc", pa.int64()), ("pos", pa.int32()), ("row", pa.int64()), ("kind", pa.int8())])

    def run(batches):
        for part in byte_slices(batches, budget=SLICE):
            data, ends = flat_bytes(part)
            hashes = Hashes(data, checked=True)
            at = anchors_of(data, ends, length, gram, hashes)
            if not len(at):
                continue
            owner = np.searchsorted(ends, at, "right")
            begin, end = (ends - np.diff(ends, prepend=0))[owner], ends[owner]
            left, right = np.minimum(at - begin, reach), np.minimum(end - at - gram, reach)
            with np.errstate(over="ignore"):
                content = mix(hashes.of(at - left, at + gram + right) + (left * 1024 + right).astype(np.uint64)).view(np.int64)
            check = hashes.check(at - left, at + gram + right)
            doc, row = (part.column(k).to_numpy(zero_copy_only=False)[owner] for k in (0, 2))
            key, pos = hashes.of(at, at + gram).view(np.int64), (at - begin).astype(np.int32)
            by = np.lexsort((pos, doc, check, content, key))
            key, content, check, doc, pos, row = key[by], content[by], check[by], doc[by], pos[by], row[by]
            new_key = np.concatenate([[True], key[1:] != key[:-1]])
            new = new_key | np.concatenate([[True], (content[1:] != content[:-1]) | (check[1:] != check[:-1])])
            first = np.flatnonzero(new)[np.cumsum(new) - 1]  # the least place of each content; rows that share it are first as well
            copy = (doc != doc[first]) | (pos != pos[first])
            group = np.cumsum(new_key) - 1
            hot = (np.bincount(group, weights=new) >= HOT)[group]
            kind = np.where(copy, COPY, np.where(hot, SPREAD, ALONE))
            salt = np.where(copy, mix(row.view(np.uint64) + pos.astype(np.uint64)).view(np.int64), np.where(hot, content, 0)).astype(np.int32)
            yield batch_of(schema, [key, salt, content, check, doc, pos, row, kind])
            marks = key[new_key & hot]
            if len(marks):
                zero = np.zeros(len(marks), np.int64)
                yield batch_of(schema, [marks, zero, zero, zero, zero, zero, zero, zero + MARK])

    return docs.mapInArrow(run, "gram long, salt int, content long, check int, doc long, pos int, row long, kind byte")


def first_anchors(anchors: DataFrame) -> DataFrame:
    """Anchors whose gram occurs twice or more: (row, pos, first), first telling those that may be the least place of their content.

    Rows that repeat an id may share that place: all of them are first.
    """
    by = Window.partitionBy("gram", "salt").orderBy("content", "check", "doc", "pos")
    near = anchors.withColumns({"_before": F.lag("gram").over(by), "_after": F.lead("gram").over(by)})
    shared = near.filter(f"kind != {MARK} and (kind != {ALONE} or _before is not null or _after is not null)")
    place = F.rank().over(Window.partitionBy("gram", "salt", "content", "check").orderBy("doc", "pos"))
    return shared.withColumn("_place", place).select("row", "pos", ((F.col("_place") == 1) & (F.col("kind") != COPY)).alias("first"))


def half_windows(docs: DataFrame, root: str, bits: int, length: int, gram: int, texts: bool = True) -> DataFrame:
    """Two rows for each stored anchor: (key, doc, pos, lo, hi, at, text, row), or the keys alone.

    Windows that start ``lo`` to ``hi`` bytes before the anchor share the bytes that ``key`` hashes; ``text``
    holds what these windows cover, with the anchor at byte ``at``.
    """
    reach = length - gram
    half = reach // 2
    fields = [("key", pa.int64()), ("doc", pa.int64()), ("pos", pa.int32()), ("lo", pa.int16()), ("hi", pa.int16()), ("at", pa.int16()), ("text", pa.binary()), ("row", pa.int64())]
    schema = pa.schema(fields if texts else fields[:1])

    def run(batches):
        store = open_store(root, bits)
        for part in byte_slices(batches, budget=SLICE):
            doc, row = (part.column(k).to_numpy(zero_copy_only=False) for k in (0, 2))
            order = np.argsort(row.view(np.uint64), kind="stable")
            found = [b""] * len(row)
            for i, x in zip(order.tolist(), store.payloads(row.view(np.uint64)[order]), strict=True):
                found[i] = x or b""
            columns: list[list] = [[] for _ in schema]
            for i, raw in enumerate(found):
                if not raw:
                    continue
                text = part.column(1)[i].as_py() or b""
                size = len(text)
                data = np.frombuffer(text, np.uint8)
                hashes = Hashes(data)
                at = np.frombuffer(raw, "<i4").astype(np.int64)
                for least, most in ((half, reach), (0, half - 1)):
                    # windows start at most ``hi`` bytes before the anchor and must end within the text
                    hi = np.minimum(most, at)
                    lo = np.maximum(least, at + length - size)
                    good = lo <= hi
                    p, l, h = at[good], lo[good], hi[good]
                    begin, stop = p - least, p + length - most
                    key = mix(hashes.of(np.maximum(begin, 0), np.minimum(stop, size)) + np.uint64(most))
                    columns[0].append(key.view(np.int64))
                    if not texts:
                        continue
                    for column, values in zip(columns[1:], (np.full(len(p), doc[i]), p, l, h, h), strict=False):
                        column.append(values)
                    columns[7].append(np.full(len(p), row[i]))
                    columns[6].append(np.array([text[a:b] for a, b in zip((p - h).tolist(), (p - l + length).tolist(), strict=True)], dtype=object))
            if columns[0]:
                yield batch_of(schema, [np.concatenate(c) for c in columns])

    return docs.mapInArrow(run, "key long" + ", doc long, pos int, lo short, hi short, at short, text binary, row long" * texts)


def covered_by_suffix_order(keys: np.ndarray, docs: np.ndarray, positions: np.ndarray, lo: np.ndarray, hi: np.ndarray, texts: list[bytes], length: int) -> np.ndarray:
    """Mask over (row, offset) suffixes whose longest previous factor reaches ``length``, as (row, start) pairs.

    Row r has suffixes at offsets 0 to hi[r] - lo[r] of its text, at document positions from positions[r] - hi[r] on.
    """
    counts = (hi - lo + 1).astype(np.int64)
    width = max(map(len, texts)) + 8
    table = np.zeros((len(texts), width), np.uint8)
    for i, t in enumerate(texts):
        table[i, : len(t)] = np.frombuffer(t, np.uint8)
    eights = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(table, 8, axis=1)).view(">u8")[..., 0].astype(np.uint64)
    row = np.repeat(np.arange(len(texts)), counts)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = positions[row] - hi[row] + offset
    # suffix order by eight bytes at a time; suffixes that stand alone are ordered and leave
    group = np.unique(keys, return_inverse=True)[1][row]
    live = np.arange(len(row))
    for depth in [*range(0, length - 8, 8), length - 8]:
        words = eights[row[live], offset[live] + depth]
        order = np.lexsort((words, group[live]))
        g, w = group[live][order], words[order]
        fresh = np.concatenate([[True], (g[1:] != g[:-1]) | (w[1:] != w[:-1])])
        rank = np.cumsum(fresh) - 1
        many = np.bincount(rank)[rank] > 1
        live = live[order][many]
        group[live] = rank[many]
        if not len(live):
            return np.zeros((0, 2), np.int64)
    found = live[has_smaller_position(group[live], docs[row[live]], start[live])]
    return np.stack([row[found], start[found]], axis=1)


def has_smaller_position(run: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For suffixes in suffix order, each in its run of those that agree to some depth: whether the previous or next smaller
    position (doc, start) lies in the same run, that is whether the longest previous factor reaches that depth."""
    order = np.lexsort((start, doc))
    new = np.concatenate([[True], (np.diff(doc[order]) != 0) | (np.diff(start[order]) != 0)])
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new)
    number = np.cumsum(np.concatenate([[True], run[1:] != run[:-1]]))
    step = len(order) + 2
    # least place so far, from either end; the shift by runs lets no other run be less
    ahead = np.minimum.accumulate(place - number * step)
    behind = np.minimum.accumulate((place + number * step)[::-1])[::-1]
    return (ahead < place - number * step) | (behind < place + number * step)


def window_covers(halves: DataFrame, keys: DataFrame, length: int, large: int) -> tuple[DataFrame, DataFrame]:
    """(row, start, stop) intervals of windows that an earlier one equals; ``keys`` are the keys of ``halves``.

    The second table is a written one that the first reads."""
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = cut(halves.join(sizes, "key"), "half-windows")
    buckets = max(1, -(-shared.filter(F.col("n") <= large).count() // large))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key", kind="stable", ignore_index=True)
        key = pdf["key"].to_numpy()
        heads = np.append(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])), len(key))
        parts, lo = [], 0
        while lo < len(key):  # whole groups, some thousands of rows at once
            hi = max(int(heads[np.searchsorted(heads, lo + BATCH, "right") - 1]), int(heads[np.searchsorted(heads, lo, "right")]))
            own = pdf.iloc[lo:hi]
            found = covered_by_suffix_order(key[lo:hi], own["doc"].to_numpy(), *(own[c].to_numpy(np.int64) for c in ("pos", "lo", "hi")), own["text"].tolist(), length)
            parts.append(pd.DataFrame({"row": own["row"].to_numpy()[found[:, 0]], "start": found[:, 1], "stop": found[:, 1] + length}))
            lo = hi
        return pd.concat(parts)

    small = shared.filter(F.col("n") <= large).withColumn("bucket", F.pmod("key", F.lit(buckets)))
    covered = small.groupBy("bucket").applyInPandas(run, "row long, start long, stop long")
    each = F.explode(F.transform(F.sequence(F.lit(0), F.col("hi").cast("int") - F.col("lo")), lambda o: F.struct((F.col("pos") - F.col("hi") + o).cast("long").alias("start"), o.alias("o"))))
    windows = shared.filter(F.col("n") > large).select("row", "doc", "text", each.alias("w")).select("row", "doc", "w.start", F.md5(F.substring("text", F.col("w.o") + 1, F.lit(length))).alias("window"))
    first = windows.groupBy("window").agg(F.min(F.struct("doc", "start")).alias("f"))
    late = windows.join(first, "window").filter("doc != f.doc or start != f.start")
    return covered.unionByName(late.select("row", "start", (F.col("start") + length).alias("stop"))), shared


def remove_repeats(df: DataFrame, length: int = LENGTH, gram: int = GRAM, large: int = LARGE, id_col: str = "doc_id", text_col: str = "text", payload_col: str | None = None, whole_chars: bool = False) -> DataFrame:
    """(id, n_bytes, kept, spans): the bytes left of each text and the maximal removed runs.

    Texts are UTF-8 (null: empty), ids whole numbers.  A byte goes if a string of ``length`` bytes that
    covers it also starts earlier: at a smaller id, or earlier in the same text.  Nothing is
    compared with what is left.  Null ids come before all others.  Rows that repeat an id share one place in the order;
    a string isn't earlier than itself at the same id and start.  Places and spans are kept by id and text, so
    different texts of one id (or of none) have their own.  With ``payload_col`` that column is carried along in
    place of the id.  With ``whole_chars`` a run shrinks to the characters it covers whole, so what is left is UTF-8.
    """
    carried = payload_col or id_col
    source = df.select(F.col(carried), F.coalesce(F.col(id_col).cast("long"), F.lit(NOBODY)).alias("doc"), F.coalesce(F.encode(F.col(text_col).cast("string"), "UTF-8"), F.lit(b"")).alias("data"))
    source = source.withColumn("_row", F.xxhash64("doc", "data"))
    docs = source.select("doc", "data", F.col("_row").alias("row"))
    reach = length - gram
    marked = cut(first_anchors(anchor_table(docs, length, gram)), "anchors")
    firsts = marked.filter("first").groupBy("row").agg(F.array_sort(F.collect_set("pos")).alias("places"))
    n = marked.select("row").distinct().count()
    bits = shard_bits(n, 50_000)
    root, _ = write_store(firsts.select(F.col("row").alias("key"), "places"), "anchors", bits, [], "places", "<i4")
    halves = [half_windows(docs, root, bits, length, gram, texts) for texts in (True, False)]
    covers, shared = window_covers(*halves, length, large)
    copies = marked.filter("not first").select("row", (F.col("pos") - reach).cast("long").alias("start"), (F.col("pos") + gram + reach).cast("long").alias("stop"))
    spans = copies.unionByName(covers).groupBy("row").agg(F.flatten(F.array_sort(F.collect_set(F.array("start", "stop")))).alias("spans"))
    held, _ = write_store(spans.select(F.col("row").alias("key"), "spans"), "covers", bits, [], "spans", "<i8")
    drop(marked, shared)
    kind = df.schema[carried].dataType.simpleString()

    def run(batches):
        store = open_store(held, bits)
        for part in byte_slices(batches, column=2):
            row = part.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            order = np.argsort(row, kind="stable")
            found: list = [None] * len(row)
            for i, x in zip(order.tolist(), store.payloads(row[order]), strict=True):
                found[i] = x
            kept, gone = [], []
            for i, raw in enumerate(found):
                data = part.column(2)[i].as_py()
                runs = united(np.frombuffer(raw, "<i8").reshape(-1, 2), len(data)) if raw else []
                if whole_chars:
                    runs = [x for x in (whole(data, *x) for x in runs) if x[0] < x[1]]
                at, pieces = 0, []
                for a, b in runs:
                    pieces.append(data[at:a])
                    at = b
                kept.append(b"".join(pieces) + data[at:] if runs else data)
                gone.append([{"start": a, "stop": b} for a, b in runs])
            schema = pa.schema([part.schema.field(0), ("n_bytes", pa.int64()), ("kept", pa.binary()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))])
            sizes = [len(x.as_py()) for x in part.column(2)]
            yield batch_of(schema, [part.column(0), sizes, kept, gone])

    return source.select(F.col(carried), "_row", "data").mapInArrow(run, f"`{carried}` {kind}, n_bytes long, kept binary, spans array<struct<start:long,stop:long>>")


def whole(data: bytes, start: int, stop: int) -> tuple[int, int]:
    """The characters that lie whole in a run of bytes."""
    while start < stop and data[start] & 0xC0 == 0x80:
        start += 1
    while start < stop < len(data) and data[stop] & 0xC0 == 0x80:
        stop -= 1
    return start, stop


def united(spans: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Maximal runs of the union of sorted intervals, within ``size`` bytes."""
    if not len(spans) or not size:
        return []
    start, stop = np.clip(spans[:, 0], 0, size), np.maximum.accumulate(np.clip(spans[:, 1], 0, size))
    new = np.concatenate([[True], start[1:] > stop[:-1]])
    lows = start[new]
    highs = stop[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(stop) - 1]])]
    return [(a, b) for a, b in zip(lows.tolist(), highs.tolist(), strict=True) if b > a]
