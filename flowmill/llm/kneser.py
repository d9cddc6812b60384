"""Interpolated modified Kneser-Ney model of a given order: counted in Spark, stored as sorted hash arrays in the
shared folder, memory-mapped by the workers that score texts.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered, followed by one end token for each text.  The stores hold

* ``words``: hash of a word, its count, its continuation count (distinct words before it), and as a
  context its tokens and its successors seen once, twice and more often;
* a level for each order from two on: hash of its grams and their count.  Below the highest order the count is
  of distinct words before the gram (of occurrences, where the gram begins a text), and the level has
  the gram's statistics as a context as well.

A gram's hash is that of its first and its last words but one, so a level is counted from two hashes a gram.
Tasks send their partial counts to a shard as one packed row: sorted contexts with run lengths, last words, counts.  A
context's grams share shards; it is split over as many as its successors, at most the distinct words, may need.
Counts are summed in 64 bits and stored as narrow as a shard's largest count allows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, byte_slices, cut, drop, mix, shared_path, word_hashes, words_of
from .store import narrow, open_store, publish, publish_shards, shard_bits, shard_column, write_store

#: Hashes of the begin and end tokens: of bytes that no word has.
BEGIN, END = xxhash.xxh3_64_intdigest(b"\n<"), xxhash.xxh3_64_intdigest(b"\n>")
#: Statistics of a word: as a context, and the distinct words before it.
STATS = ("tokens", "n1", "n2", "n3", "continuations")
FLUSH, PAIRS_PER_SHARD = 2_000_000, 1_000_000


def hashed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of a column of texts, the words of each and then the end token; tokens of each text."""
    codes, counts, words = words_of(column)
    known = word_hashes(words)
    counts = counts + 1
    out = np.full(int(counts.sum()), END, np.uint64)
    inner = np.ones(len(out), bool)
    inner[np.cumsum(counts) - 1] = False
    out[inner] = known[codes]
    return out, counts


@dataclass(frozen=True)
class Shards:
    """Hashes grams; the high ``bits`` are a gram's shard: of its first words and ``split`` high bits of its last words' hash."""

    bits: int
    split: int

    def key(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            own = mix(mix(left) * np.uint64(3) + right)
            if not self.bits:
                return own
            part = right >> np.uint64(64 - self.split) if self.split else np.zeros(len(right), np.uint64)
            shard = mix(left + (part + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)
        return shard << np.uint64(64 - self.bits) | own >> np.uint64(self.bits)

    def of(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int32) if self.bits else np.zeros(len(keys), np.int32)


def grams(tokens: np.ndarray, counts: np.ndarray, order: int, shards: Shards) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each order from two on: (context, last, token, begins) of the grams that end at a token.

    A text's first gram of each order starts with the begin token and ``begins``; ``token`` is the place among all tokens.
    """
    at = np.arange(len(tokens)) - np.repeat(np.cumsum(counts) - counts, counts)
    context, last, place = before(tokens, counts), tokens, np.arange(len(tokens))
    out = [(context, last, place, at == 0)]
    for m in range(3, order + 1):
        keys = shards.key(context, last)
        inner = at[place] >= m - 2
        # the gram that ends one token before is the row before: a text's rows follow each other
        context, last, place = keys[np.flatnonzero(inner) - 1], keys[inner], place[inner]
        out.append((context, last, place, at[place] == m - 2))
    return out


def before(tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The token before each, the begin token at the start of a text."""
    out = np.empty_like(tokens)
    out[1:] = tokens[:-1]
    out[np.cumsum(counts) - counts] = BEGIN
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def count_tokens(train: DataFrame, text_col: str) -> DataFrame:
    """(key, n): counts of token hashes over all training texts."""

    def run(batches):
        schema = pa.schema([("key", pa.int64()), ("n", pa.int64())])
        kept, held = [], 0
        for part in byte_slices(batches, column=0):
            tokens, _ = hashed(part.column(0))
            keys, n = np.unique(tokens, return_counts=True)
            kept.append((keys, n))
            held += len(keys)
            if held > FLUSH:
                yield batch_of(schema, list(_summed(kept)))
                kept, held = [], 0
        if kept:
            yield batch_of(schema, list(_summed(kept)))

    return train.select(F.col(text_col).cast("string")).mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _summed(kept: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, where = np.unique(np.concatenate([k for k, _ in kept]), return_inverse=True)
    return signed(keys), np.bincount(where, weights=np.concatenate([n for _, n in kept])).astype(np.int64)


def count_grams(train: DataFrame, text_col: str, shards: Shards, order: int) -> DataFrame:
    """(shard, lefts, runs, rights, n, begins): partial counts of grams, summed over some millions of tokens at a time.

    A row packs all grams of a shard: distinct hashes of first words, the number of grams of each, hashes of last words
    and counts; ``begins`` has a bit for each gram that starts a text.
    """

    def run(batches):
        schema = pa.schema([("shard", pa.int32()), *((c, pa.binary()) for c in ("lefts", "runs", "rights", "n", "begins"))])
        kept, held = [], 0

        def flush():
            left, right, begins = (np.concatenate(x) for x in zip(*kept, strict=True))
            keys, first, n = np.unique(shards.key(left, right), return_index=True, return_counts=True)
            left, right, begins, shard = left[first], right[first], begins[first], shards.of(keys)
            by = np.lexsort((right, left, shard))
            left, right, begins, n, shard = left[by], right[by], begins[by], n[by].astype("<u4"), shard[by]
            new = np.concatenate([[True], (left[1:] != left[:-1]) | (shard[1:] != shard[:-1])])
            heads = np.flatnonzero(new)
            runs = np.diff(np.append(heads, len(left))).astype("<u4")
            cuts = np.append(np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])), len(shard))
            at = np.searchsorted(heads, cuts)
            for lo, hi, a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                packed = (left[heads[a:b]], runs[a:b], right[lo:hi], n[lo:hi], np.packbits(begins[lo:hi]))
                yield batch_of(schema, [shard[lo : lo + 1], *([x.tobytes()] for x in packed)])

        for part in byte_slices(batches, column=0):
            tokens, counts = hashed(part.column(0))
            left, right, _, begins = grams(tokens, counts, order, shards)[-1]
            kept.append((left, right, begins))
            held += len(tokens)
            if held > FLUSH:
                yield from flush()
                kept, held = [], 0
        if held:
            yield from flush()

    return train.select(F.col(text_col).cast("string")).mapInArrow(run, "shard int, lefts binary, runs binary, rights binary, n binary, begins binary")


def unpacked(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First words, last words, counts and begin marks of all packed rows of a shard."""
    columns = [[x.as_py() for x in rows.column(c)] for c in ("lefts", "runs", "rights", "n", "begins")]
    join = lambda parts, dtype: np.frombuffer(b"".join(parts), dtype)
    left = np.repeat(join(columns[0], np.uint64), join(columns[1], "<u4"))
    begins = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(n) // 4) for x, n in zip(columns[4], columns[3], strict=True)]
    return left, join(columns[2], np.uint64), join(columns[3], "<u4"), np.concatenate(begins).astype(bool)


@dataclass(frozen=True)
class Model:
    """Roots of the stores, corpus totals and discounts; small, so it travels with the tasks.

    ``levels`` has (root, shards, discounts) of the orders from two on.
    """

    words: str
    word_bits: int
    levels: tuple[tuple[str, Shards, tuple[float, float, float]], ...]
    tokens: int
    distinct: int
    pair_types: int
    word_discounts: tuple[float, float, float]
    word_types: tuple[int, int, int]


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Chen and Goodman's discounts from counts of counts; 0.5, 1 and 1.5 where those are too few."""
    if not (n1 and n2 and n3):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.0), k + 0.999) for k, d in enumerate(found))


def count_level(df: DataFrame, text_col: str, order: int, shards: Shards, above: DataFrame | None) -> tuple[tuple[str, Shards, tuple[float, float, float]], int, DataFrame]:
    """Write the store of an order's grams; gives the level, its number of grams and what they add to the level below.

    ``above`` has the statistics of these grams from the next order's, None at the highest.
    """
    root = shared_path(df.sparkSession, f"grams-{order}")
    out = pa.schema([("key", pa.int64()), *((c, pa.int64()) for c in STATS), ("total", pa.int32())])

    def write(rows: pa.Table, more: pa.Table | None = None) -> pa.Table:
        """Sum a shard's grams, publish them and return what they add to the statistics below."""
        left, right, partial, begins = unpacked(rows)
        keys, first, where = np.unique(shards.key(left, right), return_index=True, return_inverse=True)
        n = np.zeros(len(keys), np.int64)
        np.add.at(n, where, partial.astype(np.int64))
        left, right, begins = left[first], right[first], begins[first]
        number = rows.column("shard")[0].as_py()
        at = f"{root}/{number:05d}"
        if more is not None:
            own = np.searchsorted(keys, more.column("key").to_numpy().view(np.uint64))
            stats = {c: np.zeros(len(keys), np.int64) for c in STATS}
            for c in STATS:
                stats[c][own] = more.column(c).to_numpy()
            n = np.where(begins, n, stats["continuations"])
            for c in STATS[:-1]:
                publish(f"{at}.{c}.npy", narrow(stats[c]))
        publish(f"{at}.key.npy", keys)
        publish(f"{at}.n.npy", narrow(n))
        context, own = np.unique(left, return_inverse=True)
        sums = np.zeros(len(context), np.int64)
        np.add.at(sums, own, n)
        kinds = [np.bincount(own, weights=n == k if k < 3 else n > 2, minlength=len(context)).astype(np.int64) for k in (1, 2, 3)]
        word, times = np.unique(right, return_counts=True)
        zero = np.zeros
        parts = [
            [signed(context), sums, *kinds, zero(len(context), np.int64), zero(len(context), np.int32)],
            [signed(word), *[zero(len(word), np.int64)] * 4, times, zero(len(word), np.int32)],
            [[0], *([int((n == k).sum())] for k in (1, 2, 3, 4)), [len(n)], [1 + number]],
        ]
        return pa.Table.from_batches([batch_of(out, p) for p in parts])

    rows = count_grams(df, text_col, shards, order).groupBy("shard")
    kind = ", ".join(f"{f.name} {'int' if f.name == 'total' else 'long'}" for f in out)
    if above is None:
        done = rows.applyInArrow(lambda table: write(table), kind)
    else:
        done = rows.cogroup(above.withColumn("shard", shard_column(F.col("key"), shards.bits)).groupBy("shard")).applyInArrow(lambda a, b: write(a, b), kind)
    parts = cut(done, f"stats-{order}")
    totals = parts.filter("total > 0").select("total", *STATS).collect()  # one row a shard
    publish_shards(root, [r.total - 1 for r in totals])
    p1, p2, p3, p4, types = (sum(r[c] for r in totals) for c in STATS)
    stats = parts.filter("total = 0").groupBy("key").agg(*(F.sum(c).alias(c) for c in STATS))
    return (root, shards, discounts(p1, p2, p3, p4)), int(types), stats
def train(df: DataFrame, text_col: str = "text", order: int = 2) -> Model:
    """Count the texts of ``df`` (null: empty) up to ``order`` words and write the model's stores."""
    unigrams = cut(count_tokens(df, text_col), "unigrams")
    tokens, distinct = unigrams.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    shards = Shards(shard_bits(max(1, tokens // 2), PAIRS_PER_SHARD), shard_bits(distinct, 4 * PAIRS_PER_SHARD))
    levels, stats = [], None
    for m in range(order, 1, -1):
        level, types, stats = count_level(df, text_col, m, shards, stats)
        levels.insert(0, level)
    words = cut(unigrams.join(stats, "key", "full").na.fill(0), "words")
    w = words.agg(*(F.count_if(F.col("continuations") == k) for k in (1, 2, 3, 4)), F.count_if(F.col("continuations") > 2), F.count("*")).first()
    word_bits = shard_bits(w[5])
    root, _ = write_store(words, "words", word_bits, ["n", *STATS])
    drop(words, unigrams)
    return Model(root, word_bits, tuple(levels), int(tokens), int(distinct), types, discounts(w[0], w[1], w[2], w[3]), (int(w[0]), int(w[1]), int(w[4])))


def mixed(model_level: tuple, context: np.ndarray, last: np.ndarray, stats: list[np.ndarray], lower: np.ndarray) -> np.ndarray:
    """Probabilities of one order from those of the order below; ``stats`` are the contexts' tokens and n1 to n3."""
    root, shards, (e1, e2, e3) = model_level
    keys, where = np.unique(shards.key(context, last), return_inverse=True)
    _, (count,) = open_store(root, shards.bits).numbers(keys, ["n"])
    c = count[where]
    size, n1, n2, n3 = stats
    back = e1 * n1 + e2 * n2 + e3 * n3
    seen = np.maximum(c - np.select([c == 0, c == 1, c == 2], [0.0, e1, e2], e3), 0)
    return np.where(size > 0, (seen + back * lower) / np.maximum(size, 1), lower)


def probabilities(model: Model, tokens: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 probability of each token after those before it in its text, and its training count."""
    by_order = grams(tokens, counts, len(model.levels) + 1, model.levels[0][1])
    left = by_order[0][0]
    store = open_store(model.words, model.word_bits)
    distinct, own = np.unique(np.concatenate([left, tokens]), return_inverse=True)
    _, (n, *stats, cont) = store.numbers(distinct, ["n", *STATS])
    context, word = own[: len(left)], own[len(left) :]
    d1, d2, d3 = model.word_discounts
    a = cont[word]
    lower_mass = (d1 * model.word_types[0] + d2 * model.word_types[1] + d3 * model.word_types[2]) if model.pair_types else 1.0
    p = (np.maximum(a - np.select([a == 0, a == 1, a == 2], [0.0, d1, d2], d3), 0) + lower_mass / (model.distinct + 1)) / max(1, model.pair_types)
    p = mixed(model.levels[0], left, tokens, [x[context] for x in stats], p)
    for m, (first, last, place, _) in enumerate(by_order[1:], 1):
        root, shards, _ = model.levels[m - 1]
        keys, where = np.unique(first, return_inverse=True)
        _, found = open_store(root, shards.bits).numbers(keys, list(STATS[:-1]))
        p[place] = mixed(model.levels[m], first, last, [x[where] for x in found], p[place])
    return np.log10(p), n[word]


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, base_score, score, perplexity): log10 probabilities summed over tokens.

    Null and empty texts are scored on their end token.  ``base_score`` is the add-one unigram score.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        schema = None
        for part in byte_slices(batches):
            tokens, counts = hashed(part.column(1))
            logs, n = probabilities(model, tokens, counts)
            base = np.log10(n + 1) - math.log10(model.tokens + model.distinct + 1)
            at = np.cumsum(counts) - counts
            known, low, high = (np.add.reduceat(x, at) for x in ((n > 0).astype(np.int64), base, logs))
            schema = schema or pa.schema([part.schema.field(0), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("perplexity", pa.float64())])
            yield batch_of(schema, [part.column(0), counts, known, low, high, 10 ** np.minimum(-high / counts, 300.0)])

    return df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, n_known long, base_score double, score double, perplexity double")
