"""Sorted hash arrays in the shared folder, written by Spark tasks and memory-mapped by workers.

A table of (key, values) rows is split by the high bits of its 64-bit key.  Each shard becomes one file
of sorted keys and one file for each numeric column; a ``payload`` column of bytes becomes an offset
file and a data file.  Tasks write under a temporary name and rename, so retried and speculative tasks
leave whole files.  The driver then writes the list of shards, so that a file that is missing later is an
error and not a shard without keys.  A worker maps a shard at first use; only the pages it touches are read.
Where the shared folder isn't a mounted file system, the worker copies the shard to a nameless temporary file.
"""

from __future__ import annotations

import io
import os
import shutil
import tempfile
import uuid
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ragged_take, shared_path

ROWS_PER_SHARD = 500_000


def _local(path: str) -> str | None:
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return path if "://" not in path else None


def publish(path: str, array: np.ndarray) -> None:
    if (here := _local(path)) is not None:
        os.makedirs(os.path.dirname(here), exist_ok=True)
        with open(part := f"{here}.{uuid.uuid4().hex}", "wb") as f:
            np.save(f, array)
        os.replace(part, here)
        return
    fs, at = pafs.FileSystem.from_uri(path)
    fs.create_dir(os.path.dirname(at), recursive=True)
    buffer = io.BytesIO()
    np.save(buffer, array)
    with fs.open_output_stream(part := f"{at}.{uuid.uuid4().hex}") as f:
        f.write(buffer.getbuffer())
    fs.move(part, at)


def mapped(path: str) -> np.ndarray:
    if (here := _local(path)) is not None:
        return np.load(here, mmap_mode="r")
    fs, at = pafs.FileSystem.from_uri(path)
    handle, copy = tempfile.mkstemp()
    with os.fdopen(handle, "wb") as f, fs.open_input_stream(at) as source:
        shutil.copyfileobj(source, f)
    array = np.load(copy, mmap_mode="r")
    os.unlink(copy)  # the mapping keeps the data until the worker ends
    return array


def narrow(values: np.ndarray) -> np.ndarray:
    """Counts in the smallest unsigned type that holds all of them."""
    top = int(values.max()) if len(values) else 0
    return values.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(t).max))


def publish_shards(root: str, shards: list[int]) -> None:
    publish(f"{root}/shards.npy", np.array(sorted(shards), np.int64))


def shard_bits(rows: int, per_shard: int = ROWS_PER_SHARD) -> int:
    bits = 0
    while rows > per_shard << bits:
        bits += 1
    return bits


def shard_column(key, bits: int):
    """The shard of a signed 64-bit key column: its high bits."""
    return F.shiftrightunsigned(key, 64 - bits).cast("int") if bits else F.lit(0)


def write_store(df: DataFrame, name: str, bits: int, columns: list[str], payload: str | None = None, payload_dtype: str | None = None) -> tuple[str, int]:
    """Store ``df`` by its column ``key`` (distinct longs); ``columns`` are counts, stored as narrow as they fit.

    ``payload`` is a binary column, or with ``payload_dtype`` an array column stored as that type.
    """
    root = shared_path(df.sparkSession, name)

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = pdf["key"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(keys, kind="stable")
        if (np.diff(keys[order]) == 0).any():
            raise ValueError("a key repeats, or two have one hash")
        at = f"{root}/{int(pdf['shard'].iloc[0]):05d}"
        publish(f"{at}.key.npy", keys[order])
        for column in columns:
            publish(f"{at}.{column}.npy", narrow(pdf[column].to_numpy(np.int64)[order]))
        if payload:
            values = pdf[payload].to_numpy()[order].tolist()
            if payload_dtype:
                values = [np.asarray(v, payload_dtype).tobytes() for v in values]
            ends = np.zeros(len(values) + 1, np.int64)
            np.cumsum([len(v) for v in values], out=ends[1:])
            publish(f"{at}.ends.npy", ends)
            publish(f"{at}.data.npy", np.frombuffer(b"".join(values), np.uint8))
        return pd.DataFrame({"shard": pdf["shard"].iloc[:1], "n": [len(pdf)]})

    rows = df.select("key", *columns, *([payload] if payload else [])).withColumn("shard", shard_column(F.col("key"), bits))
    written = rows.groupBy("shard").applyInPandas(write, "shard int, n long").collect()  # one row a shard
    publish_shards(root, [r.shard for r in written])
    return root, sum(r.n for r in written)


class Store:
    """Read side; open it through ``open_store`` so that a worker maps each file once."""

    def __init__(self, root: str, bits: int) -> None:
        self.root, self.bits, self.files = root, bits, {}
        self.shards = frozenset(mapped(f"{root}/shards.npy").tolist())

    def array(self, shard: int, name: str) -> np.ndarray | None:
        """A shard's array, None if no key falls into the shard; a lost file raises FileNotFoundError."""
        if shard not in self.shards:
            return None
        if (shard, name) not in self.files:
            self.files[shard, name] = mapped(f"{self.root}/{shard:05d}.{name}.npy")
        return self.files[shard, name]

    def _hits(self, keys: np.ndarray):
        """For sorted uint64 keys: (shard, positions among ``keys``, rows of the shard) of those found."""
        shards = (keys >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(keys), np.int64)
        cuts = np.flatnonzero(np.diff(shards)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(keys)], strict=True):
            if hi > lo and (own := self.array(int(shards[lo]), "key")) is not None:
                at = np.minimum(np.searchsorted(own, keys[lo:hi]), len(own) - 1)
                good = np.flatnonzero(own[at] == keys[lo:hi])
                yield int(shards[lo]), lo + good, at[good]

    def numbers(self, keys: np.ndarray, names: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Found mask and one array for each column, 0 where a key is missing."""
        found, out = np.zeros(len(keys), bool), [np.zeros(len(keys), np.float64) for _ in names]
        for shard, where, rows in self._hits(keys):
            found[where] = True
            for values, name in zip(out, names, strict=True):
                values[where] = self.array(shard, name)[rows]
        return found, out

    def payloads(self, keys: np.ndarray) -> list[bytes | None]:
        out: list[bytes | None] = [None] * len(keys)
        for shard, where, rows in self._hits(keys):
            ends, data = self.array(shard, "ends"), self.array(shard, "data")
            for i, lo, hi in zip(where.tolist(), ends[rows].tolist(), ends[rows + 1].tolist(), strict=True):
                out[i] = data[lo:hi].tobytes()
        return out

    def ragged(self, keys: np.ndarray, dtype: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Values of all payloads found in one array, and each key's start and length there; -1 if missing."""
        unit, parts, held = np.dtype(dtype).itemsize, [np.zeros(0, dtype)], 0
        starts, sizes = np.zeros(len(keys), np.int64), np.full(len(keys), -1, np.int64)
        for shard, where, rows in self._hits(keys):
            ends, data = self.array(shard, "ends"), self.array(shard, "data")
            low = ends[rows] // unit
            n = ends[rows + 1] // unit - low
            starts[where], sizes[where] = held + np.cumsum(n) - n, n
            parts.append(data.view(dtype)[ragged_take(low, n)])
            held += len(parts[-1])
        return np.concatenate(parts), starts, sizes


@lru_cache(maxsize=8)
def open_store(root: str, bits: int) -> Store:
    return Store(root, bits)
