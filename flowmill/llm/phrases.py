r"""Collocations: phrases of two to five words ranked, for each language, by how much more often they occur than their parts.

Texts have A-Z lowered and are split into pieces at ``[.,;:!?\x0A-\x0D]``, pieces into words ``[^\x20\x09]+``.

1. Equal pieces of a language are counted once, with their multiplicity.
2. Words are counted as text.  Longer grams are counted level by level: a gram is sent only where both grams one word
   shorter are frequent, as a bitmap of fixed size says; a false hit of the bitmap costs work and changes nothing.  Tasks send
   packed partial counts to buckets of a hash; DuckDB sums a bucket, out of core beyond its memory.
3. Frequent grams get their texts by joins with the level below and the words.  Each cut of a candidate then asks for
   the counts of its two parts: requests and counts meet by the part's key in a shuffle, the answers by the candidate's.

A gram is known by two 64-bit hashes, of all words but the last and of the last, each with the language; texts are those of the words.
Counts are 64-bit, scores exact decimals.

Nulls: a null text is empty and a null language ``und``; repeated documents count again; no documents give no rows.
"""

from __future__ import annotations

import contextlib
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BATCH, batch_of, byte_slices, cut, drop, mix, shared_dir, word_hashes, words_of
from .store import _local

#: Tokens whose grams are summed before they are sent; grams of a packed row; tokens for each bucket.
FLUSH, PACK, BUCKET = 2_000_000, 8192, 4_000_000
#: Bits of a level's bitmap, 16 MB: what is broadcast has this size at any input.
BITS = 1 << 27
MEMORY = "256MB"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MARKS = r"[.,;:!?\x0A-\x0D]"


def distinct_pieces(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, piece, m): distinct pieces, their words joined by single spaces, and how often they occur."""
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang")
    parts = df.select(lang, F.explode(F.split(F.translate(F.col(text_col).cast("string"), UPPER, LOWER), MARKS)).alias("piece"))
    tidy = parts.select("lang", F.trim(F.regexp_replace("piece", "[ \\t]+", " ")).alias("piece")).filter("piece != ''")
    return cut(tidy.groupBy("lang", "piece").agg(F.count("*").alias("m")), "pieces")


def compose(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Key of a gram from that of all its words but the last and that of the last."""
    with np.errstate(over="ignore"):
        return mix(mix(left) * np.uint64(3) + right)


def keyed(langs: pa.Array, words: pa.Array) -> np.ndarray:
    """Keys of words of a language, elementwise."""
    coded, own = langs.dictionary_encode(), words.dictionary_encode()
    with np.errstate(over="ignore"):
        return mix(word_hashes(own.dictionary)[own.indices.to_numpy()] + word_hashes(coded.dictionary)[coded.indices.to_numpy()] * np.uint64(0x9E3779B97F4A7C15))


def tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all words of a batch (lang, piece, m), and the number of the piece of each."""
    codes, counts, words = words_of(batch.column("piece"))
    langs = batch.column("lang").dictionary_encode()
    piece = np.repeat(np.arange(len(counts)), counts)
    with np.errstate(over="ignore"):
        return mix(word_hashes(words)[codes] + (word_hashes(langs.dictionary)[langs.indices.to_numpy()] * np.uint64(0x9E3779B97F4A7C15))[piece]), piece


def count_words(pieces: DataFrame) -> DataFrame:
    """(lang, word, a) of all words."""
    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("a", pa.int64())])

    def run(batches):
        kept, held = [], 0
        for part in byte_slices(batches):
            codes, counts, words = words_of(part.column("piece"))
            langs = part.column("lang").dictionary_encode()
            m = part.column("m").to_numpy()
            piece = np.repeat(np.arange(len(counts)), counts)
            pair = langs.indices.to_numpy()[piece].astype(np.int64) * len(words) + codes
            order = np.argsort(pair, kind="stable")
            first = np.flatnonzero(np.diff(pair[order], prepend=-1))
            if len(first):
                sums, pair = np.add.reduceat(m[piece][order], first), pair[order][first]
                kept.append(pa.table([langs.dictionary.take(pa.array(pair // len(words))), words.take(pa.array(pair % len(words))), sums], schema=schema))
                held += len(sums)
            if held > FLUSH // 4:
                yield from summed(kept).to_batches(PACK)
                kept, held = [], 0
        if kept:
            yield from summed(kept).to_batches(PACK)

    def summed(kept):
        return pa.concat_tables(kept).group_by(["lang", "word"]).aggregate([("a", "sum")]).rename_columns(schema.names).cast(schema)

    return pieces.mapInArrow(run, "lang string, word string, a long").groupBy("lang", "word").agg(F.sum("a").alias("a"))


def bitmap(keys: DataFrame) -> np.ndarray:
    """A bit for each key, at its low bits; at most ``BITS / 64`` rows come to the driver."""
    slot = F.col("key").bitwiseAND(BITS - 1)
    found = keys.groupBy(F.shiftright(slot, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(key & {63} as int))")).alias("bits")).toArrow()
    out = np.zeros(BITS >> 6, np.int64)
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy()
    return out.view(np.uint64)


def marked(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = keys & np.uint64(BITS - 1)
    return (bits[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


PACKED = "bucket int, lefts binary, runs binary, rights binary, n binary"


def send_grams(pieces: DataFrame, size: int, frequent, bits: int) -> DataFrame:
    """Packed partial counts of grams of ``size`` words whose two shorter grams ``frequent`` (a broadcast bitmap) has.

    A row has grams of one of 2^bits buckets: keys of all words but the last with run lengths, keys of last words, counts.
    """
    schema = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("lefts", "runs", "rights", "n"))])

    def flush(kept):
        left, right, n = (np.concatenate(x) for x in zip(*kept, strict=True))
        keys = compose(left, right)
        order = np.argsort(keys)
        first = np.flatnonzero(np.concatenate([[True], np.diff(keys[order]) != 0]))
        n, left, right = np.add.reduceat(n[order], first), left[order][first], right[order][first]
        bucket = (keys[order][first] >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(n), np.int32)
        by = np.lexsort((left, bucket))
        left, right, n, bucket = left[by], right[by], n[by], bucket[by]
        edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
        for lo, end in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            for a in range(lo, end, PACK):
                own = slice(a, min(a + PACK, end))
                heads = np.flatnonzero(np.concatenate([[True], left[own][1:] != left[own][:-1]]))
                runs = np.diff(np.append(heads, own.stop - a)).astype("<u2")
                yield batch_of(schema, [bucket[a : a + 1], *([x.tobytes()] for x in (left[own][heads], runs, right[own], n[own].astype("<i8")))])

    def run(batches):
        kept, held = [], 0
        for part in byte_slices(batches):
            word, piece = tokens(part)
            key = word
            for k in range(1, size - 1):
                key = compose(key[:-1], word[k:])
            good = marked(frequent.value, key)
            at = np.flatnonzero(good[:-1] & good[1:])
            at = at[piece[at] == piece[at + size - 1]]
            if len(at):
                kept.append((key[at], word[at + size - 1], part.column("m").to_numpy()[piece[at]]))
                held += len(at)
            if held > FLUSH:
                yield from flush(kept)
                kept, held = [], 0
        if held:
            yield from flush(kept)

    return pieces.mapInArrow(run, PACKED)


def sum_buckets(packed: DataFrame, least: int) -> DataFrame:
    """(key, left, right, a) of the grams that occur ``least`` times or more: DuckDB sums one bucket at a time.

    It spills to the shared folder, where that is a mounted path; else a bucket stays in memory.
    """
    import duckdb

    scratch = _local(shared_dir(packed.sparkSession))
    flat = pa.schema([("l", pa.uint64()), ("r", pa.uint64()), ("n", pa.int64())])
    schema = pa.schema([(c, pa.int64()) for c in ("key", "left", "right", "a")])

    def opened(row: dict) -> pa.RecordBatch:
        left, right, n = np.frombuffer(row["lefts"], np.uint64), np.frombuffer(row["rights"], np.uint64), np.frombuffer(row["n"], "<i8")
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(left, np.frombuffer(row["runs"], "<u2"))), pa.array(right), pa.array(n)], schema=flat)

    def run(batches):
        rows = (row for batch in batches for at in range(batch.num_rows) for row in batch.slice(at, 1).to_pylist())
        row = next(rows, None)
        with contextlib.ExitStack() as stack:
            spill = stack.enter_context(tempfile.TemporaryDirectory(dir=scratch, prefix="flowmill-sums-")) if scratch and row else ""
            while row:

                def bucket():
                    nonlocal row
                    now = row["bucket"]
                    while row and row["bucket"] == now:
                        yield opened(row)
                        row = next(rows, None)

                with duckdb.connect(config={"memory_limit": MEMORY, "threads": 1, "temp_directory": spill}) as con:
                    grams = pa.RecordBatchReader.from_batches(flat, bucket())  # noqa: F841
                    found = con.sql(f"SELECT l, r, sum(n)::bigint AS a FROM grams GROUP BY l, r HAVING sum(n) >= {least}").to_arrow_table()
                left, right = (found.column(c).to_numpy() for c in ("l", "r"))
                if len(left):
                    yield batch_of(schema, [compose(left, right).view(np.int64), left.view(np.int64), right.view(np.int64), found.column("a").to_numpy()])

    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "key long, left long, right long, a long")


@contextlib.contextmanager
def small_batches(spark, rows: int):
    """Packed rows are large: fewer of them in an Arrow batch."""
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, rows)
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


def frequent_phrases(df: DataFrame, least: int = 100, longest: int = 5, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(phrases, words, totals): frequent phrases (lang, size, key, parts, phrase, a), frequent words (lang, key, word, a), words of each language."""
    spark = df.sparkSession
    pieces = distinct_pieces(df, text_col, lang_col)
    counted = cut(count_words(pieces), "words")
    totals = counted.groupBy("lang").agg(F.sum("a").alias("n"))
    buckets = max(1, -(-(counted.agg(F.sum("a")).first()[0] or 0) // BUCKET))
    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("a", pa.int64()), ("key", pa.int64())])

    def with_keys(batches):
        for b in batches:
            yield batch_of(schema, [*b.columns, keyed(b.column(0), b.column(1)).view(np.int64)])

    words = cut(counted.filter(F.col("a") >= least).mapInArrow(with_keys, "lang string, word string, a long, key long"), "frequent")
    level = words.select("lang", F.lit(1).alias("size"), "key", F.array("key").alias("parts"), F.col("word").alias("phrase"), "a")
    last = words.select(F.col("key").alias("right"), "word")
    levels = []
    for size in range(2, longest + 1):
        frequent = spark.sparkContext.broadcast(bitmap(level.select("key")))  # fixed size
        with small_batches(spark, 200):
            found = cut(sum_buckets(send_grams(pieces, size, frequent, (buckets - 1).bit_length()), least), f"grams-{size}")
        frequent.unpersist()
        shorter = level.select("lang", F.col("key").alias("left"), "parts", "phrase")
        level = found.join(shorter, "left").join(last, "right").select("lang", F.lit(size).alias("size"), "key", F.concat("parts", F.array("right")).alias("parts"), F.concat_ws(" ", "phrase", "word").alias("phrase"), "a")
        level = cut(level, f"phrases-{size}")
        drop(found)
        levels.append(level)
    drop(pieces)
    phrases = levels[0]
    for more in levels[1:]:
        phrases = phrases.unionByName(more)
    return phrases, words, totals


ASKED = "kind int, size int, key long, of_size int, of_key long, k int, a long"


def part_requests(phrases: DataFrame) -> DataFrame:
    """(kind, size, key, of_size, of_key, k, a): what each phrase asks of its parts or tells them.

    Kind 0 asks for the count of its first k words, kind 1 for that of the rest; kind 2 tells the two phrases one word shorter its own count ``a``.
    """
    schema = pa.schema([(c, pa.int32() if t == "int" else pa.int64()) for c, t in (x.split() for x in ASKED.split(", "))])

    def run(batches):
        for batch in batches:
            size = batch.column("size").to_numpy()
            out = []
            for n in np.unique(size).tolist():
                own = np.flatnonzero(size == n)
                parts = np.array(batch.column("parts").take(pa.array(own)).to_pylist(), np.int64).view(np.uint64)
                keys, counts = (batch.column(c).to_numpy()[own] for c in ("key", "a"))

                def part(lo, hi, parts=parts):
                    key = parts[:, lo]
                    for k in range(lo + 1, hi):
                        key = compose(key, parts[:, k])
                    return key.view(np.int64)

                asked = [(kind, hi - lo, part(lo, hi), k) for k in range(1, n) for kind, lo, hi in ((0, 0, k), (1, k, n))]
                asked += [(2, n - 1, part(lo, lo + n - 1), 0) for lo in (0, 1) if n > 2]
                out += [batch_of(schema, [np.full(len(own), kind), np.full(len(own), length), key, np.full(len(own), n), keys, np.full(len(own), k), counts]) for kind, length, key, k in asked]
            yield from out

    return phrases.select("size", "key", "parts", "a").mapInArrow(run, ASKED)


def collocations(df: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases.

    A phrase is left out if a longer one that has it inside occurs as often.
    """
    phrases, words, totals = frequent_phrases(df, least, longest, text_col, lang_col)
    asked = part_requests(phrases)
    counts = words.select(F.lit(1).alias("size"), "key", F.col("a").alias("f")).unionByName(phrases.select("size", "key", F.col("a").alias("f")))
    answers = asked.filter("kind < 2").drop("a").join(counts, ["size", "key"])
    cells = [F.max(F.when((F.col("k") == k) & (F.col("kind") == kind), F.col("f"))).alias(f"{side}{k}") for k in range(1, longest) for kind, side in ((0, "l"), (1, "r"))]
    parts = answers.groupBy(F.col("of_size").alias("size"), F.col("of_key").alias("key")).agg(*cells)
    longer = asked.filter("kind = 2").groupBy("size", "key").agg(F.max("a").alias("longer"))
    rows = phrases.drop("parts").join(parts, ["size", "key"]).join(longer, ["size", "key"], "left").filter("longer IS NULL OR longer < a").join(totals, "lang")
    cuts = [f"IF(l{k} IS NULL, NULL, struct((CAST(1000 * a AS DECIMAL(19, 0)) * CAST(n AS DECIMAL(19, 0))) DIV (CAST(l{k} AS DECIMAL(19, 0)) * CAST(r{k} AS DECIMAL(19, 0))) AS score, {k} AS k, l{k} AS l, r{k} AS r))" for k in range(1, longest)]
    best = rows.withColumn("best", F.array_min(F.array_compact(F.array(*map(F.expr, cuts)))))
    flat = best.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return flat.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations_sql() -> str:
    """DuckDB SQL of the ranked phrases."""
    return f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, '{UPPER}', '{LOWER}'), '{MARKS}')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda x: x <> '') AS ws FROM p),
g AS (SELECT lang, k, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS phrase FROM w, LATERAL unnest(range(1, 6)) AS x(k), LATERAL unnest(range(1, len(ws) - k + 2)) AS y(i)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100 OR k = 1),
t AS (SELECT lang, sum(a)::bigint AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k > 1 AND a >= 100),
s AS (SELECT c.lang, c.k, c.phrase, c.a, j, l.a AS l, r.a AS r, t.n, ((1000::hugeint * c.a * t.n) // (l.a::hugeint * r.a))::bigint AS score
  FROM (SELECT *, string_split(phrase, ' ') AS ws, unnest(range(1, k)) AS j FROM c) c JOIN t USING (lang)
  JOIN f l ON l.lang = c.lang AND l.k = c.j AND l.phrase = array_to_string(list_slice(ws, 1, j), ' ') JOIN f r ON r.lang = c.lang AND r.k = c.k - c.j AND r.phrase = array_to_string(list_slice(ws, j + 1, c.k), ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
kept AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = b.lang AND c.k > b.k AND c.a >= b.a AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept QUALIFY rank <= 2000
"""
