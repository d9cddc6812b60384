"""Whole-text encoding by a public tokenizer, one distinct chunk at a time.

Both pre-tokenizers in use never let a match cross the edges of the chunks below, so a text's ids are
the concatenation of its chunks' ids and a worker encodes each distinct chunk once.  The cache of a
worker is bounded; when full it starts anew.  Where white space only separates, ``store_words`` encodes each
distinct word of the corpus once and workers look ids up in the store.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import batch_of, byte_slices, cut, drop, ragged_take, word_hashes, words_of
from .store import open_store, shard_bits, write_store

#: An optional single space with the non-blank run after it, or blanks (Unicode white space).
CHUNK = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: White space to Python but not to Unicode: texts with these are encoded whole.
ODD = re.compile("[\x1c-\x1f]")
CACHE = 300_000


class ChunkEncoder:
    """Token spans of texts through cached chunks; ``spaced`` keeps white space in chunks, else it only separates.

    ``encode_chunks`` maps chunks to all their ids in one array, the number of ids of each, and optionally
    the first and end characters of their tokens.
    """

    def __init__(self, encode_chunks: Callable[[list[str]], tuple[np.ndarray, np.ndarray, np.ndarray | None]], spaced: bool) -> None:
        self.encode_chunks, self.spaced = encode_chunks, spaced
        self.reset()

    def reset(self) -> None:
        self.known: dict[str, int] = {}
        self.ends = np.zeros(1, np.int64)
        self.lengths = np.zeros(0, np.int32)  # characters of each chunk
        self.chars = np.zeros((0, 2), np.int32)  # first and end character of each token in its chunk

    def split(self, text: str) -> list[str]:
        if ODD.search(text):
            return [text]
        return CHUNK.findall(text) if self.spaced else text.split()

    def learn(self, chunks: set[str]) -> None:
        new = list(chunks)
        _, sizes, chars = self.encode_chunks(new)
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        self.lengths = np.concatenate([self.lengths, np.fromiter(map(len, new), np.int32, len(new))])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        if chars is not None:
            self.chars = np.concatenate([self.chars, chars])

    def codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cache numbers of all chunks, and the number of chunks of each text."""
        parts = [self.split(t) for t in texts]
        flat = [c for part in parts for c in part]
        if need := set(flat).difference(self.known):
            if self.known and len(self.known) + len(need) > CACHE:
                self.reset()
                need = set(flat)
            self.learn(need)
        return np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat)), np.array([len(p) for p in parts], np.int64)

    def spans(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and end character of every token in its text, and the number of tokens of each text."""
        codes, counts = self.codes(texts)
        sizes = (self.ends[1:] - self.ends[:-1])[codes]
        chars = self.lengths[codes].astype(np.int64)
        begin = np.cumsum(chars) - chars
        edges = np.concatenate([[0], np.cumsum(counts)])
        begin -= np.repeat(np.concatenate([begin, [0]])[edges[:-1]], counts)
        take, shift = ragged_take(self.ends[codes], sizes), np.repeat(begin, sizes)
        upto = np.concatenate([[0], np.cumsum(sizes)])
        return self.chars[take, 0] + shift, self.chars[take, 1] + shift, upto[edges[1:]] - upto[edges[:-1]]


@lru_cache(maxsize=2)
def encoder(path: str, spaced: bool, offsets: bool = False) -> ChunkEncoder:
    """A worker's encoder for a ``tokenizers`` file."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core already
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
    encode = tokenizer.encode_batch if offsets else tokenizer.encode_batch_fast

    def encode_chunks(chunks: list[str]):
        ids, sizes, chars = array("i"), array("i"), array("i")
        for i in range(0, len(chunks), 20_000):
            for e in encode(chunks[i : i + 20_000], add_special_tokens=False):
                ids.extend(own := e.ids)
                sizes.append(len(own))
                if offsets:
                    chars.extend(chain.from_iterable(e.offsets))
        return np.array(ids, np.int32), np.array(sizes, np.int64), np.array(chars, np.int32).reshape(-1, 2) if offsets else None

    return ChunkEncoder(encode_chunks, spaced)


def slice_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Codes, counts and distinct words of a column; texts with odd white space count as one word each."""
    texts = pc.fill_null(column, "")
    if not pc.any(pc.match_substring_regex(texts, ODD.pattern)).as_py():
        return words_of(texts, unicode=True)
    parts = [[t] if ODD.search(t) else t.split() for t in texts.to_pylist()]
    coded = pa.array([w for part in parts for w in part], pa.string()).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), np.array([len(p) for p in parts], np.int64), coded.dictionary


def store_words(df: DataFrame, tokenizer: str, text_col: str = "text") -> tuple[str, int]:
    """Encode the distinct words of all texts once; gives the root and the bits of the store of their ids.

    For tokenizers to which white space only separates.
    """

    def distinct(batches):
        for part in byte_slices(batches, column=0, budget=16 << 20):
            yield pa.RecordBatch.from_arrays([slice_words(part.column(0))[2]], names=["word"])

    def encoded(batches):
        coder, schema = encoder(tokenizer, False), pa.schema([("key", pa.int64()), ("ids", pa.binary())])
        for part in byte_slices(batches, column=0, budget=256 << 10):
            words = part.column(0)
            ids, sizes, _ = coder.encode_chunks(words.to_pylist())
            raw, ends = memoryview(ids.astype("<i4").tobytes()), (np.cumsum(sizes) * 4).tolist()
            yield batch_of(schema, [word_hashes(words).view(np.int64), [raw[a:b].tobytes() for a, b in zip([0, *ends], ends, strict=False)]])

    words = cut(df.select(F.col(text_col).cast("string")).mapInArrow(distinct, "word string").distinct(), "words")
    n = words.count()
    bits = shard_bits(n)
    root, stored = write_store(words.mapInArrow(encoded, "key long, ids binary"), "word-ids", bits, [], "ids")
    if stored != n:
        raise ValueError("words were lost")
    drop(words)
    return root, bits


def stored_ids(root: str, bits: int, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a column of texts in one array and the number of ids of each, from a store of words."""
    codes, counts, words = slice_words(column)
    keys = word_hashes(words)
    order = np.argsort(keys, kind="stable")
    ids, starts, sizes = open_store(root, bits).ragged(keys[order], "<i4")
    at = np.empty_like(order)
    at[order] = np.arange(len(order))
    codes = at[codes]
    if len(codes) and sizes[codes].min() < 0:
        raise KeyError("a word isn't in the store")
    upto = np.concatenate([[0], np.cumsum(sizes[codes])])
    edges = np.concatenate([[0], np.cumsum(counts)])
    return ids[ragged_take(starts[codes], sizes[codes])], upto[edges[1:]] - upto[edges[:-1]]
