"""Shared helpers: the cluster's shared folder, lineage cuts and bounded Arrow slices."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Whitespace of the word contracts (fixed values): space, \t, \n, \v, \f, \r.
BLANKS = " \t\n\x0b\x0c\r"
#: Rows of an Arrow batch while a table is written.
BATCH, ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only a local session may go without one, as in tests: its tasks and its driver are on one machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="flowmill-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/flowmill-{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and reread it: later steps survive lost executors.

    Meanwhile Arrow batches of whole texts have fewer rows, to bound what JVM and worker hold.
    """
    path, conf = shared_path(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(BATCH)
    conf.set(BATCH, min(int(before), ROWS) if int(before) > 0 else ROWS)
    try:
        df.write.parquet(path)
    finally:
        conf.set(BATCH, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` wrote, once everything derived from them is itself written."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._cut_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def byte_slices(batches: Iterable[pa.RecordBatch], column: int = 1, budget: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into slices whose values in ``column`` hold about ``budget`` bytes; at its end a task gives free memory back."""
    try:
        for batch in batches:
            size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
            ends, start = np.cumsum(size, dtype=np.int64), 0
            while start < batch.num_rows:
                base = int(ends[start - 1]) if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, base + budget, "right")))
                yield batch.slice(start, stop - start)
                start = stop
    finally:
        trim()


def trim() -> None:
    """Give freed memory back: an idle worker would hold what its last task needed."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def texts_of(batch: pa.RecordBatch, column: int = 1) -> list[str]:
    return [x or "" for x in batch.column(column).to_pylist()]


def words_of(column: pa.Array, unicode: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Codes of all words of a column of texts, the number of words of each text, and the distinct words.

    Words lie between the blanks above and have A-Z lowered; with ``unicode`` they lie between Unicode white
    space and keep their case.  Null texts have no words.
    """
    texts = pc.fill_null(column, "")
    parts = pc.utf8_split_whitespace(texts) if unicode else pc.ascii_split_whitespace(pc.ascii_lower(texts))
    counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = parts.flatten().dictionary_encode()
    codes, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    if (empty := pc.index(words, "").as_py()) >= 0:  # beside blanks at the ends of a text
        full = codes != empty
        counts = np.diff(np.concatenate([[0], np.cumsum(full)])[np.concatenate([[0], np.cumsum(counts)])])
        codes = codes[full]
    return codes, counts, words


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of distinct strings: sums of a random number for each byte times powers of an odd base, mixed."""
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]] if len(words) else np.zeros(0, np.uint8)
    ends = ends - ends[0] if len(words) else np.zeros(1, np.int64)
    sizes = np.diff(ends)
    place = np.arange(len(data)) - np.repeat(ends[:-1], sizes)
    with np.errstate(over="ignore"):
        powers = np.multiply.accumulate(np.full(int(sizes.max(initial=0)) + 1, np.uint64(0xD1342543DE82EF97)))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTES[data] * powers[place], dtype=np.uint64)])
        return mix(sums[ends[1:]] - sums[ends[:-1]] + sizes.astype(np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64), elementwise on uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ragged_take(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges ``[starts[i], starts[i] + lengths[i])``."""
    total = int(lengths.sum())
    firsts = np.cumsum(lengths) - lengths
    return np.repeat(starts - firsts, lengths) + np.arange(total, dtype=np.int64)


def batch_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) if not isinstance(c, pa.Array) else c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


#: A random number for each byte.
with np.errstate(over="ignore"):
    BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
