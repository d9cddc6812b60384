"""Language identification of mixed texts.

Script ranges narrow a text's candidates to the languages that were learned in its scripts.  Each word
gets a score for each language from hashed character n-grams; Viterbi over the words, with a penalty for
switching, labels spans of one language.  All texts of a slice are decoded together, one numpy step for
each word position.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import batched

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_of, byte_slices, texts_of

#: Bits of an n-gram's hash, lengths of n-grams, most sampled texts of a language, characters of a cached word.
HASH_BITS, SIZES, SAMPLE, PENALTY, CACHE = 16, (1, 2, 3, 4), 4000, 6.0, 200_000
#: First and last code point of script ranges (fixed values); all other letters are "other".
SCRIPTS = {
    "latin": ((0x41, 0x24F), (0x1E00, 0x1EFF)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F),),
    "armenian": ((0x530, 0x58F),),
    "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F)),
    "devanagari": ((0x900, 0x97F),),
    "thai": ((0xE00, 0xE7F),),
    "hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7AF)),
    "kana": ((0x3040, 0x30FF),),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF)),
}
WORD = re.compile(r"[^\W\d_]+")


def words_in(text: str) -> list[str]:
    """Runs of letters and other numerics that hold a letter; "½" and "②" alone are no words."""
    return [w for w in WORD.findall(text) if w.isalpha() or any(map(str.isalpha, w))]


def letters_of(word: str) -> int:
    return len(word) if word.isalpha() else sum(map(str.isalpha, word))


def script_counts(words: list[str]) -> dict[str, int]:
    """Letters of each script."""
    joined = "".join(words)
    if joined.isascii():
        return {"latin": len(joined)} if joined else {}
    letters = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    out, left = {}, len(letters)
    for name, ranges in SCRIPTS.items():
        n = int(sum(np.count_nonzero((letters >= a) & (letters <= b)) for a, b in ranges))
        if n:
            out[name] = n
            left -= n
    return out | ({"other": left} if left else {})


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of all words, each between marks, word by word; and the number of each word's."""
    marked = [f"\x02{w.lower()}\x03" for w in words]
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    points = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(points))  # characters from here to the word's end
    hashes, fits = np.zeros((len(points), len(SIZES)), np.uint32), np.zeros((len(points), len(SIZES)), bool)
    state = np.zeros(len(points), np.uint32)
    for n in range(1, max(SIZES) + 1):
        state[: len(points) - n + 1] = (state[: len(points) - n + 1] ^ points[n - 1 :]) * np.uint32(0x9E3779B1)
        state ^= state >> np.uint32(15)
        if n in SIZES:
            k = SIZES.index(n)
            hashes[:, k] = (state + np.uint32(n)) * np.uint32(0x85EBCA77) >> np.uint32(32 - HASH_BITS)
            fits[:, k] = left >= n
    return hashes[fits], np.maximum(sizes[:, None] + 1 - np.array(SIZES), 0).sum(axis=1)


def word_scores(model: Model, words: list[str]) -> np.ndarray:
    """Score of each word for each language: its n-grams' sum over the root of their number."""
    hashes, counts = grams(words)
    sums = np.add.reduceat(model.table[hashes], np.cumsum(counts) - counts, axis=0)
    return (sums / np.sqrt(counts)[:, None]).astype(np.float32)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # n-gram hash x language: log probability relative to the languages' mean
    scripts: dict[str, list[int]]  # languages learned in a script


def training_sample(df: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE) -> DataFrame:
    """At most ``sample`` labelled texts of each language, the first by a hash of text and id.

    A bounded sample of labelled rows, as a documented parameter; rows without text or label are left out.
    """
    rows = df.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h")).filter("text is not null and lang is not null")
    langs = rows.groupBy("lang").agg(F.count("*").alias("n"))
    # a threshold on the hash keeps about twice the sample before the exact cut, so no language's rows meet in one task
    share = langs.select("lang", (F.lit(2.0 * sample + 200) / F.col("n")).alias("share"))
    small = rows.join(F.broadcast(share), "lang").filter(F.pmod("h", F.lit(1 << 30)) < F.col("share") * (1 << 30))
    order = Window.partitionBy("lang").orderBy("h", "text")
    return small.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= sample).select("lang", "text")


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE) -> Model:
    """Fit the n-gram table; tasks count, the driver gets one bounded table of counts for each language."""
    size = 1 << HASH_BITS

    def count(batches):
        for pdf in batches:
            for lang, texts in pdf.groupby("lang")["text"]:
                table, scripts = np.zeros(size, np.int64), {}
                words = [w for t in texts for w in words_in(t)]
                for text in texts:
                    for k, v in script_counts(words_in(text)).items():
                        scripts[k] = scripts.get(k, 0) + v
                distinct, times = np.unique(np.array(words, dtype=object).astype(str), return_counts=True) if words else ([], [])
                if len(distinct):
                    hashes, sizes = grams(distinct.tolist())
                    table += np.bincount(hashes, np.repeat(times, sizes), size).astype(np.int64)
                yield pd.DataFrame({"lang": lang, "gram": np.flatnonzero(table), "n": table[table > 0], "script": None})
                yield pd.DataFrame({"lang": lang, "gram": -1, "n": list(scripts.values()), "script": list(scripts)})

    kind = "lang string, gram int, n long, script string"
    counts = training_sample(df, text_col, lang_col, id_col, sample).mapInPandas(count, kind).groupBy("lang", "gram", "script").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts["lang"].unique())
    table = np.full((size, max(1, len(languages))), 0.5)
    scripts: dict[str, list[int]] = {}
    for i, lang in enumerate(languages):
        own = counts[counts["lang"] == lang]
        hashed = own[own["gram"] >= 0]
        table[hashed["gram"].to_numpy(), i] += hashed["n"].to_numpy()
        letters = own[own["gram"] < 0]
        for script, n in zip(letters["script"], letters["n"], strict=True):
            if n >= 0.01 * letters["n"].sum():
                scripts.setdefault(script, []).append(i)
    table = np.log(table / table.sum(axis=0))
    return Model(languages, (table - table.mean(axis=1, keepdims=True)).astype(np.float32), scripts)


def viterbi(scores: np.ndarray, counts: np.ndarray, penalty: float) -> np.ndarray:
    """Best labels of concatenated sequences: ``scores`` is words x languages, ``counts`` words of each.

    Sequences are decoded side by side, longest first, so a step works on all that still have words.
    """
    order = np.argsort(-counts, kind="stable")
    begin, n = (np.cumsum(counts) - counts)[order], counts[order]
    labels = np.zeros(len(scores), np.int64)
    live = int(np.count_nonzero(n))
    best = np.zeros((live, scores.shape[1]), np.float64)
    back = np.zeros(scores.shape, bool)  # where the best way to a label came from the best other label
    came = np.zeros(len(scores), np.int64)
    for t in range(int(n[0]) if live else 0):
        live = int(np.searchsorted(-n, -t, "left"))
        at = begin[:live] + t
        own = best[:live]
        if t:
            top = own.argmax(axis=1)
            jump = own[np.arange(live), top] - penalty
            back[at] = jump[:, None] > own
            came[at] = top
            own = np.maximum(own, jump[:, None])
        best[:live] = own + scores[at]
    label = best.argmax(axis=1) if len(best) else np.zeros(0, np.int64)
    for t in range(int(n[0]) - 1 if len(best) else -1, -1, -1):
        live = int(np.searchsorted(-n, -t, "left"))
        at = begin[:live] + t
        labels[at] = label[:live]
        if t:
            label[:live] = np.where(back[at, label[:live]], came[at], label[:live])
    return labels


def identify(df: DataFrame, model: Model, penalty: float = PENALTY, id_col: str = "doc_id", text_col: str = "text", spans: bool = True) -> DataFrame:
    """(id, lang_pred, score[, spans]) of each row.

    ``lang_pred`` is the language with most letters over the labelled spans (ties: first by name) and
    ``score`` its share of them; spans are ``lang:first:end`` in code points, comma-joined.  Null texts
    and texts without a letter give ``und``, score 0 and no spans.  A letter is what ``str.isalpha`` says.  A very long text takes one numpy step a word.  A text in scripts that no language
    was learned in keeps all languages as candidates; without any language learned all are ``und``.
    """
    kind = df.schema[id_col].dataType.simpleString()
    names = np.array(model.languages, dtype=object)

    def run(batches):
        cache: dict[str, int] = {}
        rated = np.zeros((0, max(1, len(names))), np.float32)
        schema = None
        for part in byte_slices(batches):
            texts = texts_of(part)
            if len(cache) > CACHE:
                cache.clear()
                rated = rated[:0]
            found = [words_in(t) for t in texts]
            flat = [w for f in found for w in f]
            for new in batched(set(flat).difference(cache), 50_000):
                cache.update(zip(new, range(len(rated), len(rated) + len(new)), strict=True))
                rated = np.concatenate([rated, word_scores(model, list(new))])
            counts = np.array([len(f) for f in found], np.int64)
            codes = np.fromiter(map(cache.__getitem__, flat), np.int64, len(flat))
            scores = rated[codes].astype(np.float64)
            edges = np.concatenate([[0], np.cumsum(counts)])
            for i in range(len(texts)):
                if counts[i]:
                    allowed = sorted({x for s in script_counts(found[i]) for x in model.scripts.get(s, [])})
                    if allowed and len(allowed) < len(names):
                        barred = np.setdiff1d(np.arange(len(names)), allowed)
                        scores[edges[i] : edges[i + 1], barred] = -1e6
            letters = np.fromiter(map(letters_of, flat), np.int64, len(flat))
            labels = viterbi(scores, counts, penalty) if len(flat) and len(names) else np.zeros(len(flat), np.int64)
            owner = np.repeat(np.arange(len(texts)), counts)
            width = max(1, len(names))
            votes = np.bincount(owner * width + labels, weights=letters, minlength=len(texts) * width).reshape(-1, width)
            total = votes.sum(axis=1)
            top = votes.argmax(axis=1)
            known = (total > 0) & (len(names) > 0)
            langs = [names[k] if ok else "und" for k, ok in zip(top.tolist(), known.tolist(), strict=True)]
            share = np.where(known, votes[np.arange(len(texts)), top] / np.maximum(total, 1), 0.0)
            columns = [part.column(0), langs, share]
            fields = [part.schema.field(0), ("lang_pred", pa.string()), ("score", pa.float64())]
            if spans:
                columns.append([span_text(t, f, labels[a:b], model.languages) if ok else "" for t, f, a, b, ok in zip(texts, found, edges.tolist(), edges[1:].tolist(), known.tolist(), strict=False)])
                fields.append(("spans", pa.string()))
            schema = schema or pa.schema(fields)
            yield batch_of(schema, columns)

    return df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double" + ", spans string" * spans)


def span_text(text: str, words: list[str], labels: np.ndarray, languages: list[str]) -> str:
    if (labels == labels[0]).all() and words[0].isalpha() and words[-1].isalpha():
        return f"{languages[labels[0]]}:{text.index(words[0])}:{text.rindex(words[-1]) + len(words[-1])}"
    where = [(m.start(), m.end()) for m in WORD.finditer(text) if any(map(str.isalpha, m[0]))]
    cuts = [0, *(np.flatnonzero(np.diff(labels)) + 1).tolist(), len(labels)]
    return ",".join(f"{languages[labels[a]]}:{where[a][0]}:{where[b - 1][1]}" for a, b in zip(cuts, cuts[1:], strict=False))
