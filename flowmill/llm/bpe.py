"""Byte-level BPE encoding and decoding.

The distinct pieces of the corpus are folded once, by Spark higher-order functions: a piece starts as
the ids of its bytes, and each step merges the adjacent pair of lowest rank, leftmost first, looked up
in a literal rank map (pairs of ids hashed to buckets of a constant array).  Pieces above ``LONG`` bytes are merged with a
heap of pairs instead, as a fold's work grows with the square of its length.  The folded pieces go to a
sorted hash store in the shared folder; workers map it, look up the distinct pieces of a slice of texts and
concatenate their ids.  Decoding concatenates the byte strings of the ids.  Pieces of ``SPLIT`` are found by
the classes of a slice's bytes in one numpy pass, those of any other pattern by its matches in each text.
"""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, byte_slices, cut, ragged_take
from .store import open_store, shard_bits, write_store

#: White space by Unicode's property, as a character class (fixed values).
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: The pattern whose pieces ``piece_starts`` finds.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Classes of characters; any other has 0.
LETTER, NUMBER, BLANK = 1, 2, 3
#: Bits of an id or rank in a packed number; no rank; pieces that a task folds.
BITS, NONE, PIECES = 17, 1 << 17, 50_000
#: Bytes of a piece up to which it is folded by higher-order functions, in steps that each go over the whole piece.
LONG = 256
SEED = 42  # of Spark's xxhash64


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def piece_pattern(pattern: str) -> regex.Pattern:
    """``pattern`` with its white-space classes spelled out, so that they mean Unicode's property."""
    return regex.compile(pattern.replace("[^\\s", f"[^{WHITE}").replace("\\s", f"[{WHITE}]").replace("\\S", f"[^{WHITE}]"))


@lru_cache(maxsize=2)
def _pattern(pattern: str) -> regex.Pattern:
    return piece_pattern(pattern)


def split_pieces(text: str, pattern: str) -> list[str]:
    return _pattern(pattern).findall(text)


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """The class of every code point."""
    classes, every = np.zeros(0x110000, np.uint8), "".join(map(chr, [*range(0xD800), *[0] * 0x800, *range(0xE000, 0x110000)]))
    for kind, chars in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, f"[{WHITE}]+")):
        for run in regex.finditer(chars, every):
            classes[run.start() : run.end()] = kind
    return classes


def byte_classes(data: np.ndarray) -> np.ndarray:
    """For each byte of valid UTF-8 the class of its character."""
    table = char_classes()
    classes = table[:256][data]
    for size, least, most in ((2, 0xC0, 0xDF), (3, 0xE0, 0xEF), (4, 0xF0, 0xF7)):
        at = np.flatnonzero((data >= least) & (data <= most))
        if len(at):
            code = (data[at] & (0x7F >> size)).astype(np.int32)
            for k in range(1, size):
                code = code << 6 | (data[at + k] & 0x3F)
            own = table[code]
            for k in range(size):
                classes[at + k] = own
    return classes


def piece_starts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The first bytes of all pieces of ``SPLIT`` in texts laid end to end; text i is ``data[bounds[i]:bounds[i + 1]]``.

    A piece starts where the class changes, but a single space belongs to what follows it.  Of several blanks
    before a word the last stands alone or, if it is a space, with the word.
    """
    n = len(data)
    first = np.zeros(n + 1, bool)
    first[bounds] = True  # and the end
    classes = byte_classes(data)
    blank = classes == BLANK
    start = first.copy()
    start[1:n] |= classes[1:] != classes[:-1]
    last = np.flatnonzero(blank[:-1] & ~blank[1:])  # last bytes of blanks before a word
    last = last[~first[last + 1]]
    start[last[data[last] == 0x20] + 1] = False
    wide = data[last] >= 0x80  # a blank of two bytes, or of three
    start[last - wide * np.where(data[last - 1] >= 0xC0, 1, 2)] = True
    quote = np.flatnonzero((data == 0x27) & start[:n])
    quote = quote[~first[quote + 1]]
    after = data[quote + 1]
    one = np.isin(after, np.frombuffer(b"stmd", np.uint8))
    pair = quote[~one & ~first[np.minimum(quote + 2, n)]]
    pair = pair[np.isin(data[pair + 1].astype(np.int32) << 8 | data[pair + 2], [int.from_bytes(x) for x in (b"re", b"ve", b"ll")])]
    for at, size in ((quote[one], 2), (pair, 3)):
        start[at + 1] = False
        start[at + size] = True
    return np.flatnonzero(start[:n])


def pieces_of(column: pa.Array, pattern: str) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]:
    """Codes of all pieces of a column of texts, the number of pieces of each text, the distinct pieces and the texts, both as UTF-8."""
    texts = pc.fill_null(column, "")
    texts.validate(full=True)
    raw = texts.cast(pa.binary())
    if pattern == SPLIT:
        bounds = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1] if len(raw) else np.zeros(1, np.int32)
        data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        starts = piece_starts(data, bounds)
        counts = np.diff(np.searchsorted(starts, bounds))
        ends = np.append(starts, len(data)).astype(np.int32)
        flat = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data)])
    else:
        parts = [split_pieces(t, pattern) for t in texts.to_pylist()]
        counts = np.array([len(p) for p in parts], np.int64)
        flat = pa.array([p.encode() for part in parts for p in part], pa.binary())
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), counts, coded.dictionary, raw


def distinct_pieces(df: DataFrame, pattern: str, text_col: str = "text") -> DataFrame:
    """The distinct pieces of all texts, as UTF-8."""

    def run(batches):
        for part in byte_slices(batches, column=0, budget=8 << 20):
            yield pa.RecordBatch.from_arrays([pieces_of(part.column(0), pattern)[2]], names=["word"])

    return df.select(F.col(text_col).cast("string")).mapInArrow(run, "word binary").distinct()


def prime_from(n: int) -> int:
    while any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def rank_literals(ranks: dict[bytes, int]) -> tuple[Column, Column, Column, int, int]:
    """The rank map as literal arrays: ids of the single bytes, displacements, and the hash table; and the sizes of both.

    The table is sized by the pairs of ids that merge.

    An entry is ``key << BITS | rank`` for the key of a pair of ids.  The keys of a bucket share the first
    displacement that puts all of them on free slots, so a lookup reads one displacement and one slot.
    """
    pairs = []
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            if (left := ranks.get(token[:i])) is not None and (right := ranks.get(token[i:])) is not None:
                pairs.append(((left << BITS | right) + 1, rank))
    width, depth = prime_from(len(pairs) * 17 // 12 + 101), prime_from(len(pairs) // 3 + 11)
    buckets: dict[int, list[tuple[int, int]]] = {}
    for key, rank in pairs:
        buckets.setdefault(bucket_of(key, depth), []).append((key, rank))
    slots, shifts = [0] * width, [0] * depth
    for b, own in sorted(buckets.items(), key=lambda x: -len(x[1])):
        for shift in range(width):
            places = [slot_of(key, shift, width) for key, _ in own]
            if len(set(places)) == len(own) and not any(slots[x] for x in places):
                break
        else:
            raise ValueError("the rank map doesn't fit its table")
        shifts[b] = shift
        for x, (key, rank) in zip(places, own, strict=True):
            slots[x] = key << BITS | rank
    numbers = lambda x: F.split(F.lit(",".join(map(str, x))), ",").cast("array<bigint>")
    return numbers([ranks[bytes([b])] for b in range(256)]), numbers(shifts), numbers(slots), width, depth


def bucket_of(key, depth: int):
    """For numbers and for columns, as the next one."""
    return key % 1000003 % depth


def slot_of(key, shift, width: int):
    return (key % width + shift * (key % (width - 22) + 1)) % width


def fold_pieces(words: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """(word, ids): a word that is a token has its id, any other is folded by ranked merges.

    Words are distinct, not null and not empty.
    """
    spark: SparkSession = words.sparkSession
    if max(ranks.values()) >= 1 << BITS or any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("the ranks must hold every byte and fit the packed entries")
    byte_ids, shifts, slots, width, depth = rank_literals(ranks)
    tokens = spark.createDataFrame([(bytearray(t), r) for t, r in ranks.items()], "word binary, id int")
    marked = words.join(F.broadcast(tokens), "word", "left")  # the vocabulary's size bounds this side
    whole = marked.filter("id is not null").select("word", F.array("id").alias("ids"))
    unknown = marked.filter("id is null").select("word")
    long = merge_long(unknown.filter(F.octet_length("word") > LONG), ranks)
    rest = unknown.filter(F.octet_length("word") <= LONG).withColumns({"_bytes": byte_ids, "_shifts": shifts, "_slots": slots})

    def key(left: Column, right: Column) -> Column:
        return F.shiftleft(left, BITS) + right + 1

    def part(pair: Column) -> Column:
        """A part of the piece as ``rank of its pair with the next << 20 | id``, from the key of the pair."""
        slot = F.get(F.col("_slots"), slot_of(pair, F.get(F.col("_shifts"), bucket_of(pair, depth).cast("int")), width).cast("int"))
        rank = F.least(slot.bitwiseXOR(F.shiftleft(pair, BITS)), F.lit(NONE).cast("long"))  # another key's entry differs above the rank
        return F.shiftleft(rank, 20) + F.shiftright(pair - 1, BITS)

    def alone(own: Column) -> Column:
        """Stands for the key of a part that has no next one."""
        return -own - 1

    def parts(keys: Column) -> Column:
        return F.transform(keys, lambda k: F.when(k < 0, -k - 1 + (NONE << 20)).otherwise(part(k)))

    def number(x: Column) -> Column:
        return x.bitwiseAND(F.lit((1 << 20) - 1))

    def merge(acc: Column, _: Column) -> Column:
        def at(x: Column) -> Column:
            best, p, n = x["best"], x["p"], F.size(acc)

            def changed(v: Column, i: Column) -> Column:
                own = F.when(p + 1 < n, key(best, number(F.get(acc, p + 1)))).otherwise(alone(best))
                keys = F.array(F.when(i == p - 2, key(number(v), best)).otherwise(own))
                return F.when((i == p - 1) | (i == p - 2), F.get(parts(keys), F.lit(0))).otherwise(v)

            return F.filter(F.transform(acc, changed), lambda v, i: i != p)

        def found(least: Column) -> Column:
            bound = F.transform(F.array(F.struct(F.shiftright(least, 20).alias("best"), F.array_position(acc, least).cast("int").alias("p"))), at)
            return F.when(least >= NONE << 20, acc).otherwise(F.get(bound, F.lit(0)))

        return F.get(F.transform(F.array(F.array_min(acc)), found), F.lit(0))

    chars = F.split(F.decode("word", "ISO-8859-1"), "")
    rest = rest.withColumn("_ids", F.transform(chars, lambda c: F.get(F.col("_bytes"), F.ascii(c))))
    ids, steps = F.col("_ids"), F.sequence(F.lit(1), F.size("_ids"))
    rest = rest.withColumn("_keys", F.transform(steps, lambda i: F.when(i < F.size(ids), key(F.get(ids, i - 1), F.get(ids, i))).otherwise(alone(F.get(ids, i - 1)))))
    folded = F.aggregate(steps, parts(F.col("_keys")), merge, lambda acc: F.transform(acc, lambda x: number(x).cast("int")))
    return whole.unionByName(rest.select("word", folded.alias("ids"))).unionByName(long)


def merge_long(words: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """(word, ids) of long words by a heap of pairs: a fold takes as many steps as a word has bytes, each over the whole word."""

    def run(batches):
        schema = pa.schema([("word", pa.binary()), ("ids", pa.list_(pa.int32()))])
        for batch in batches:
            for word in batch.column(0).to_pylist():
                yield batch_of(schema, [[word], [merged(word, ranks)]])

    return words.mapInArrow(run, "word binary, ids array<int>")


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word: the pair of least rank is merged, the leftmost of equals, until none has a rank."""
    size = len(word)
    following, before = list(range(1, size + 2)), list(range(-1, size))
    heap = [(rank, i, i + 1, i + 2) for i in range(size - 1) if (rank := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, middle, end = heapq.heappop(heap)
        if following[i] != middle or middle >= size or following[middle] != end:
            continue  # one of its parts was merged meanwhile
        following[i], following[middle] = end, -1
        if end < size:
            before[end] = i
        for left, right in ((before[i], i), (i, end)):
            if left >= 0 and right < size and (rank := ranks.get(word[left : following[right]])) is not None:
                heapq.heappush(heap, (rank, left, right, following[right]))
    out, at = [], 0
    while at < size:
        out.append(ranks[word[at : following[at]]])
        at = following[at]
    return out


def encode_bpe(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded): ids as little-endian unsigned 32-bit integers, decoded as the ids' bytes.

    Each match of ``pattern`` is encoded separately, without special tokens.  Null and empty texts give
    empty binaries.  A text whose ids don't decode to its bytes raises an error.
    """
    ranks = read_ranks(ranks_path)
    kind = df.schema[id_col].dataType.simpleString()
    words = cut(distinct_pieces(df, pattern, text_col), "pieces")
    n = words.count()
    dealt = words.repartition(max(1, -(-n // PIECES)))  # the fold is the work, so its tasks are sized by pieces
    folded = fold_pieces(dealt, ranks).select(F.xxhash64("word").alias("key"), "ids")
    bits = shard_bits(n)
    root, stored = write_store(folded, "bpe", bits, [], "ids", "<i4")
    if stored != n:
        raise ValueError("pieces were lost")

    def run(batches):
        table, schema = pa.array(token_bytes(ranks_path), pa.binary()), None
        for part in byte_slices(batches):
            codes, counts, pieces, texts = pieces_of(part.column(1), pattern)
            ids, sizes = piece_ids(root, bits, codes, pieces)
            upto = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
            decoded = table.take(pa.array(ids))
            at = np.concatenate([[0], np.cumsum(pc.binary_length(decoded).to_numpy(zero_copy_only=False), dtype=np.int64)])[upto]
            back = binaries(at, decoded.buffers()[2])
            if not back.equals(texts):
                raise ValueError("ids don't decode to their text")
            schema = schema or pa.schema([part.schema.field(0), ("ids", pa.binary()), ("decoded", pa.binary())])
            yield batch_of(schema, [part.column(0), binaries(upto * 4, pa.py_buffer(ids.astype("<u4"))), back])

    return df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, ids binary, decoded binary")


@lru_cache(maxsize=1)
def token_bytes(path: str) -> list[bytes]:
    ranks = read_ranks(path)
    table = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return table


def piece_ids(root: str, bits: int, codes: np.ndarray, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of pieces given by codes, in one array, and the number of ids of each."""
    keys = np.fromiter((xxhash.xxh64_intdigest(p, SEED) for p in pieces.to_numpy(zero_copy_only=False)), np.uint64, len(pieces))
    order = np.argsort(keys)
    ids, starts, sizes = open_store(root, bits).ragged(keys[order], "<i4")
    if (sizes < 0).any():
        raise KeyError("a piece isn't in the store")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    own = place[codes]
    return ids[ragged_take(starts[own], sizes[own])], sizes[own]


def binaries(ends: np.ndarray, data: pa.Buffer | None) -> pa.Array:
    """The byte strings between consecutive ``ends`` of ``data``."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), data or pa.py_buffer(b"")])


def decode_ids(df: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded) of little-endian unsigned 32-bit ids; null ids give null, unknown ids an error."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        pieces = token_bytes(ranks_path)
        for part in byte_slices(batches):
            schema = pa.schema([part.schema.field(0), ("decoded", pa.binary())])
            yield batch_of(schema, [part.column(0), [None if x is None else b"".join(pieces[i] for i in np.frombuffer(x, "<u4").tolist()) for x in part.column(1).to_pylist()]])

    return df.select(F.col(id_col), F.col(ids_col)).mapInArrow(run, f"`{id_col}` {kind}, decoded binary")
