"""Best-fit packing of token sequences with certified bin counts.

Documents are cut into pieces of at most ``capacity`` tokens.  Pieces are dealt to partitions by hash
and each partition is packed by best-fit decreasing.  Dual feasible functions give a lower bound on the
bins of any packing of that partition; where the count meets the bound it is certified.  The same bound for
all pieces, from the histogram of their lengths, tells when no exchange can help.  Until then, partitions
with more bins than their tokens need put the pieces of bins that aren't full into a common pool,
which is dealt anew over half as many partitions and packed again, so that documents of different partitions
meet; a round is kept only if it saves bins, so the count never grows.  Rounds end when one saves nothing, nobody is
left to exchange with, or the bound is met.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, byte_slices, cut, drop
from .encode import store_words, stored_ids

PIECES_PER_PARTITION = 50_000


def piece_table(df: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) of every document's pieces.

    A document's ids are the tokenizer's without special tokens, then ``end_id``; null and empty texts
    hold the end id only (without one: no piece).  The distinct words of the corpus are encoded once.
    """
    kind = df.schema[id_col].dataType.simpleString()
    root, bits = store_words(df, tokenizer, text_col)

    def run(batches):
        schema = None
        for part in byte_slices(batches):
            flat, counts = stored_ids(root, bits, part.column(1))
            upto = np.cumsum(counts)
            if end_id is not None:
                flat = np.insert(flat, upto, end_id)
                counts = counts + 1
                upto = np.cumsum(counts)
            flat = flat.astype("<u4")
            pieces = -(-counts // capacity)
            row = np.repeat(np.arange(len(counts)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            length = np.minimum(counts[row] - start, capacity)
            at = (upto - counts)[row] + start
            raw = memoryview(flat.tobytes())
            cuts = list(zip((at * 4).tolist(), ((at + length) * 4).tolist(), strict=True))
            columns = [part.column(0).take(pa.array(row)), piece, start, length, [zlib.crc32(raw[a:b]) for a, b in cuts]]
            fields = [part.schema.field(0), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
            if ids:
                columns.append([flat[a // 4 : b // 4] for a, b in cuts])
                fields.append(("ids", pa.list_(pa.int64())))
            schema = schema or pa.schema(fields)
            yield batch_of(schema, columns)

    extra = ", ids array<long>" if ids else ""
    return df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long{extra}")


def lower_bound(lengths: np.ndarray, capacity: int, counts: np.ndarray | None = None) -> int:
    """The best lower bound on bins of three families of dual feasible functions.

    With ``counts``, ``lengths`` are distinct and stand for so many items each.
    """
    if not len(lengths):
        return 0
    sizes, counts = np.unique(lengths, return_counts=True) if counts is None else (lengths, counts)
    best = -(-int((sizes * counts).sum()) // capacity)
    for k in range(1, 12):  # rounding functions: (k+1)x if that is whole, else its floor, over k
        scaled = (k + 1) * sizes
        worth = np.where(scaled % capacity == 0, k * sizes, scaled // capacity * capacity)
        best = max(best, -(-int((worth * counts).sum()) // (k * capacity)))
    for low in np.unique(sizes[sizes * 2 <= capacity]).tolist() or [1]:  # large count whole, tiny count nothing
        worth = np.where(sizes > capacity - low, capacity, np.where(sizes < low, 0, sizes))
        best = max(best, -(-int((worth * counts).sum()) // capacity))
    halves = int(counts[sizes * 2 > capacity].sum()) + -(-int(counts[sizes * 2 == capacity].sum()) // 2)
    return max(best, halves)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item; open bins are kept by their room, found by a bit mask of rooms."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, opened = 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        above = mask >> need
        if above:
            room = need + (above & -above).bit_length() - 1
            own = by_room[room].pop()
            if not by_room[room]:
                mask &= ~(1 << room)
        else:
            own, room = opened, capacity
            opened += 1
        bins[i], offsets[i] = own, capacity - room
        room -= need
        if room:
            by_room[room].append(own)
            mask |= 1 << room
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = 2048, per_partition: int = PIECES_PER_PARTITION, keys: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Add ``sequence_id``, ``offset`` (gapless from 0) and ``certified`` to a table with a ``length`` column.

    ``certified`` tells whether the row's partition met its lower bound.  Lengths are 1 to ``capacity``;
    null, zero and larger lengths are refused.  ``keys`` only deal rows out; they may be null or repeat.  Columns
    of ``pieces`` that have one of the three names are replaced; any other name is kept as it is.
    """
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset", "certified")]
    rows = pieces.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.col("length").cast("long").alias("length"), F.xxhash64(*(F.col(f"`{k}`") for k in keys)).alias("deal"))
    rows = cut(rows, "pieces")
    total, bad = rows.agg(F.count("*"), F.count_if(F.col("length").isNull() | (F.col("length") < 1) | (F.col("length") > capacity))).first()
    if bad:
        raise ValueError(f"{bad} lengths aren't from 1 to {capacity}")
    own = ("row", "length", "deal")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    result = pa.schema([("block", pa.int32()), ("bin", pa.int64()), ("offset", pa.int64()), ("fill", pa.int64()), ("gap", pa.int64()), ("spare", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        lengths = table.column("length").to_numpy()
        bins, offsets = best_fit_decreasing(lengths, capacity)
        fill = np.bincount(bins, weights=lengths).astype(np.int64)
        gap, spare = len(fill) - lower_bound(lengths, capacity), len(fill) - -(-int(lengths.sum()) // capacity)
        values = (table.column("block"), bins, offsets, fill[bins], np.full(len(bins), gap), np.full(len(bins), spare))
        table = table.select(list(own))
        for field, x in zip(result, values, strict=True):
            table = table.append_column(field, x if isinstance(x, pa.ChunkedArray) else pa.array(x, field.type))
        return table

    def packed(pool: DataFrame, blocks: int, salt: int) -> DataFrame:
        dealt = pool.withColumn("block", F.pmod(F.xxhash64("deal", F.lit(salt)), F.lit(blocks)).cast("int"))
        return cut(dealt.groupBy("block").applyInArrow(run, f"{schema}, block int, bin long, offset long, fill long, gap long, spare long"), "packed")

    def bins_of(df: DataFrame) -> int:
        return df.filter("offset = 0").count()

    def numbered(df: DataFrame, at: int) -> DataFrame:
        number = F.lit(at << 58) + F.shiftleft(F.col("block").cast("long"), 32) + F.col("bin")
        return df.select("row.*", number.alias("sequence_id"), "offset", (F.col("gap") == 0).alias("certified"))

    now = packed(rows, max(1, -(-total // per_partition)), 0)
    sizes = sorted((r[0], r[1]) for r in rows.groupBy("length").count().collect())  # one row a length, at most capacity
    drop(rows)
    least = lower_bound(np.array([x for x, _ in sizes]), capacity, np.array([n for _, n in sizes]))
    used, done = bins_of(now), []
    while used > least:
        loose = (F.col("spare") > 0) & (F.col("fill") < capacity)
        partitions, n = now.agg(F.countDistinct(F.when(loose, F.col("block"))), F.count(F.when(loose, 1))).first()
        if partitions < 2:  # nobody to exchange with
            break
        pool = now.filter(loose)
        again = packed(pool.select(*own), max(1, min(-(-n // per_partition), partitions // 2)), len(done) + 1)
        saved = bins_of(pool) - bins_of(again)
        if saved <= 0:
            break
        used -= saved
        done.append(numbered(now.filter(~loose), len(done)))
        now = again
    out = numbered(now, len(done))
    for part in done:
        out = out.unionByName(part)
    return out
