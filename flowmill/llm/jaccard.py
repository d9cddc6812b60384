"""N-gram Jaccard join: a size-aware heavy-light set similarity join on word shingles.

Texts are sets of distinct shingles; texts with equal sets are one set from the start.  Two sets link
when intersection over union reaches the threshold.

* Small (light) sets: at sizes up to a boundary linked sets differ in few elements, so each set lists
  the hashes of its fixed-size subsets, with up to ``depth`` elements left out; linked sets share one.
* Large (heavy) sets: inverted lists of the first elements of each set, rare ones first, are scanned.
  The order comes from a sketch of all shingle counts, sized by the corpus up to a fixed bound, so a passage in a
  third of the texts comes last.  Sizes and positions rule out most pairs of a list.
* The boundary and depth are those of least estimated cost, from the sizes' histogram and the sketch.

Lists aren't expanded to all pairs.  First every member may be compared with its list's first one, and sets
linked so form clusters; the first one has the least rare elements before the shared one, as the least edited copy has.  A set is compared with the first one that it shares most lists with, then, if they
aren't in one cluster by then, with the others.  Then only pairs of different clusters within a list are compared, list
members in blocks.  A pair is compared element by element unless the parities of its sets' cells, about a bit for each
element, show that too many differ.  Every pair that shares a list is compared, ruled out by a bound or in one cluster, so no link between
components is lost.

Shingles are compared as 64-bit hashes, and sets of equal hashes count as equal: among n distinct shingles, two
collide with a chance of about n squared over 2 to the 65.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_of, byte_slices, cut, drop, mix, word_hashes, words_of
from .components import connected_components
from .store import open_store, shard_bits, write_store

#: log2 of the sketch's cells, least and most; characters of text for each cell; rows that carry a task's sketch.
LEAST_BITS, MOST_BITS, CHARS_PER_CELL, CHUNKS = 16, 24, 256, 64
#: Cost of comparing two sets, in list entries; list members of a block; members of a task's group of comparisons.
COMPARE, BLOCK, GROUP = 20.0, 1000, 500
SEEN, NOBODY, SLICE = 300_000, -(1 << 63), 2 << 20
#: Least longs that hold the parities of a set's cells.
PARITY = 4


def shingles(column: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer than ``n`` words is one shingle."""
    codes, counts, words = words_of(column)
    flat = word_hashes(words)[codes]
    out, at = [], 0
    with np.errstate(over="ignore"):
        rolled = mix(flat)
        for k in range(1, n):
            rolled = mix(rolled[:-1] * np.uint64(3) + flat[k:]) if len(rolled) > 1 else rolled[:0]
        for size in counts.tolist():
            if size >= n:
                out.append(np.unique(rolled[at : at + size - n + 1]))
            elif size:
                h = mix(flat[at : at + 1] + np.uint64(size << 8))
                for k in range(1, size):
                    h = mix(h * np.uint64(5) + flat[at + k : at + k + 1])
                out.append(h)
            else:
                out.append(np.zeros(0, np.uint64))
            at += size
    return out


def set_id(hashes: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63)


@dataclass(frozen=True)
class Threshold:
    """Similarity ``num / den``."""

    num: int
    den: int

    def differing(self, a: int, b: int) -> int:
        """Most elements in one set only, of linked sets of these sizes; -1 if none link."""
        need = -(-self.num * (a + b) // (self.num + self.den))
        return a + b - 2 * need if need <= min(a, b) else -1

    def prefix(self, size: np.ndarray | int):
        return size - -(-self.num * size // self.den) + 1

    def boundary(self, depth: int) -> int:
        """Largest size up to which linked sets differ in at most ``depth`` elements."""
        b = 0
        while all(self.differing(a, b + 1) <= depth for a in range(1, b + 2)):
            b += 1
        return b

    def compatible(self, s1, p1, s2, p2) -> Column:
        """Whether sets of these sizes that first meet at these positions (-1: anywhere) can link."""
        need = F.ceil(self.num * (s1 + s2) / F.lit(float(self.num + self.den)) - 1e-9)
        return F.least(s1 - F.greatest(p1, F.lit(0)), s2 - F.greatest(p2, F.lit(0))) >= need


def sketch_bits(df: DataFrame, text_col: str) -> int:
    chars = df.agg(F.coalesce(F.sum(F.length(F.col(text_col).cast("string"))), F.lit(0))).first()[0]
    return min(MOST_BITS, max(LEAST_BITS, (chars // CHARS_PER_CELL).bit_length()))


def packed(counts: np.ndarray) -> bytes:
    return pa.compress(counts.tobytes(), "zstd", asbytes=True)


def set_table(df: DataFrame, n: int, id_col: str, text_col: str, key_col: str | None = None) -> tuple[DataFrame, np.ndarray]:
    """(doc, row_key, n_shingles, set_id) of each row, and the sketch of all shingle counts.

    The sketch only orders elements; a task's cell counts up to 255.
    """
    bits = sketch_bits(df, text_col)
    cells, part_cells = 1 << bits, (1 << bits) // CHUNKS
    schema = pa.schema([("doc", pa.int64()), ("row_key", pa.int64()), ("n_shingles", pa.int64()), ("set_id", pa.int64()), ("chunk", pa.int32()), ("counts", pa.binary())])

    def run(batches):
        sketch = np.zeros(cells, np.int32)
        for part in byte_slices(batches, budget=SLICE):
            sets = shingles(part.column(1), n)
            if sets:
                where, times = np.unique((np.concatenate(sets) >> np.uint64(64 - bits)).astype(np.int32), return_counts=True)
                sketch[where] += times.astype(np.int32)
            none = [None] * len(sets)
            yield batch_of(schema, [part.column(0), part.column(2), [len(s) for s in sets], [set_id(s) if len(s) else None for s in sets], none, none])
        if sketch.any():
            raw = [packed(np.minimum(x, 255).astype(np.uint8)) for x in sketch.reshape(CHUNKS, -1)]
            none = [None] * CHUNKS
            yield batch_of(schema, [none, none, none, none, list(range(CHUNKS)), raw])

    key = F.col(key_col) if key_col else F.lit(None)
    rows = df.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string"), key.cast("long").alias("row_key"))
    found = cut(rows.mapInArrow(run, "doc long, row_key long, n_shingles long, set_id long, chunk int, counts binary"), "sets")

    def added(dtype: str):
        def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(part_cells, np.int64)
            for batch in batches:
                for raw in batch.column("counts"):
                    total += np.frombuffer(pa.decompress(raw.as_buffer(), part_cells * np.dtype(dtype).itemsize, "zstd"), dtype)
            sums = packed(np.minimum(total, 1 << 30).astype("<i4"))
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([sums], pa.binary())], ["chunk", "counts"])

        return add

    salt = F.pmod(F.floor(F.spark_partition_id() / 16), F.lit(64)).alias("salt")  # sixteen partitions a group at first
    some = found.filter("chunk is not null").select("chunk", "counts", salt).groupBy("chunk", "salt").applyInArrow(added("u1"), "chunk int, counts binary")
    sketch = np.zeros(cells, np.int32)
    for row in some.groupBy("chunk").applyInArrow(added("<i4"), "chunk int, counts binary").toLocalIterator():  # a fixed number of rows
        own = pa.decompress(row.counts, part_cells * 4, "zstd", asbytes=True)
        sketch[row.chunk * part_cells : (row.chunk + 1) * part_cells] = np.frombuffer(own, "<i4")
    return found.filter("chunk is null").drop("chunk", "counts"), np.minimum(sketch, 0xFFFF).astype(np.uint16)


def chosen_boundary(sizes: dict[int, int], sketch: np.ndarray, threshold: Threshold, depths: int = 2) -> tuple[int, int]:
    """(boundary, depth) of least cost, both 0 if every set is better scanned.

    Enumerating costs one entry for each subset.  Scanning costs the prefix's entries, and for each the
    expected length of its list (from the sketch's second moment, less the mean of unrelated shingles in
    a cell) times the cost of a comparison.
    """
    total = max(1, int(sketch.sum(dtype=np.int64)))
    length = max(0.0, float((sketch.astype(np.float64) ** 2).sum()) / total - total / len(sketch) - 1)
    scan = lambda s: threshold.prefix(s) * (1 + COMPARE * min(length, 1e6))
    best = (sum(n * scan(s) for s, n in sizes.items()), 0, 0)
    for depth in range(1, depths + 1):
        b = threshold.boundary(depth)
        cost = sum(n * (sum(comb(s, d) for d in range(depth + 1)) if s <= b else scan(s)) for s, n in sizes.items())
        best = min(best, (cost, b, depth))
    return best[1], best[2]


def subset_keys(hashes: np.ndarray, depth: int) -> np.ndarray:
    """Hashes of the set and of its subsets with up to ``depth`` elements left out."""
    with np.errstate(over="ignore"):
        own = mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5))
        total = own.sum(dtype=np.uint64)
        keys = [total[None], total - own]
        if depth > 1:
            i, j = np.triu_indices(len(own), 1)
            keys.append(total - own[i] - own[j])
        return mix(np.concatenate(keys) + np.uint64(0x5EED))


def list_entries(df: DataFrame, n: int, threshold: Threshold, sketch: np.ndarray, boundary: int, depth: int, text_col: str) -> DataFrame:
    """(key, set_id, size, pos): a set's subset keys, or its first elements in the global order, once a task."""
    schema = pa.schema([("key", pa.int64()), ("set_id", pa.int64()), ("size", pa.int32()), ("pos", pa.int32())])
    shift = np.uint64(64 - (len(sketch).bit_length() - 1))

    def run(batches):
        seen = set()
        for part in byte_slices(batches, column=0, budget=SLICE):
            keys, ids, sizes, places = [], [], [], []
            for own in shingles(part.column(0), n):
                size = len(own)
                if not size or (name := set_id(own)) in seen:
                    continue
                if len(seen) > SEEN:
                    seen.clear()
                seen.add(name)
                light = size <= boundary
                if light:
                    k = subset_keys(own, depth)
                    keys.append(k)
                    places.append(np.full(len(k), -1))
                    ids.append(np.full(len(k), name))
                    sizes.append(np.full(len(k), size))
                if not light or threshold.differing(size, boundary + 1) >= 0:  # it may link with a large set
                    first = np.lexsort((own, sketch[(own >> shift).astype(np.int64)]))[: threshold.prefix(size)]
                    keys.append(mix(own[first] + np.uint64(0xF00D)))
                    places.append(np.arange(len(first)))
                    ids.append(np.full(len(first), name))
                    sizes.append(np.full(len(first), size))
            if keys:
                yield batch_of(schema, [np.concatenate(keys).view(np.int64), *(np.concatenate(x) for x in (ids, sizes, places))])

    return df.select(F.col(text_col).cast("string")).mapInArrow(run, "key long, set_id long, size int, pos int")


def parity(hashes: np.ndarray) -> np.ndarray:
    """Parity of the number of hashes in each cell, as longs; it bounds how much two sets differ.

    The cells are the low bits of the hashes; there are as many as elements, rounded up to a power of two.
    """
    cells = 1 << max((64 * PARITY - 1).bit_length(), (len(hashes) - 1).bit_length())
    odd = np.bincount((hashes & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def least_differing(x: Column, y: Column) -> Column:
    """Number of cells that differ; the longer one of two parities is folded if it has twice the cells, else nothing is known."""
    n = F.least(F.size(x), F.size(y))
    both = lambda a, b: F.zip_with(a, b, lambda u, v: u.bitwiseXOR(v))
    folded = lambda p: F.when(F.size(p) > n, both(F.slice(p, 1, n), F.slice(p, n + 1, n))).otherwise(p)
    found = F.aggregate(both(folded(x), folded(y)), F.lit(0), lambda total, v: total + F.bit_count(v))
    return F.when(F.greatest(F.size(x), F.size(y)) <= 2 * n, found).otherwise(0)


def held_sets(df: DataFrame, wanted: DataFrame, sets: DataFrame, n: int, id_col: str, text_col: str, whole: bool) -> DataFrame:
    """(set_id, hashes) or without ``whole`` (set_id, size, parity) of the sets in ``wanted`` (set_id), from the rows of each set's smallest id.

    A set is there once, or where that id repeats or is null, at most once a task.
    """
    docs = cut(wanted.join(sets, "set_id").select(F.coalesce("doc", F.lit(NOBODY)).alias("key")).distinct(), "needed")
    bits = shard_bits(docs.count())
    root, _ = write_store(docs, "needed", bits, [])
    drop(docs)
    more = [("hashes", pa.binary())] if whole else [("size", pa.int32()), ("parity", pa.list_(pa.int64()))]
    schema = pa.schema([("set_id", pa.int64()), *more])

    def fetch(batches):
        store, seen = open_store(root, bits), set()
        for part in byte_slices(batches, budget=SLICE):
            keys = part.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            order = np.argsort(keys, kind="stable")
            mine = np.sort(order[store.numbers(keys[order], [])[0]])
            own = {}
            for s in shingles(part.column(1).take(pa.array(mine)), n) if len(mine) else ():
                if len(s) and (name := set_id(s)) not in seen:
                    own[name] = s
            if len(seen) < SEEN:
                seen.update(own)
            if own:
                values = [[s.tobytes() for s in own.values()]] if whole else [[len(s) for s in own.values()], [parity(s) for s in own.values()]]
                yield batch_of(schema, [list(own), *values])

    rows = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NOBODY)).alias("doc"), F.col(text_col).cast("string"))
    kind = "hashes binary" if whole else "size int, parity array<long>"
    return cut(rows.mapInArrow(fetch, f"set_id long, {kind}"), "hashes")


def plausible(pairs: DataFrame, short: DataFrame, threshold: Threshold) -> DataFrame:
    """Those of ``pairs`` (a, b: set ids) that the sets' sizes and parities (``short``) don't rule out."""
    x, y = (short.select(*(F.col(c).alias(f"{side}{c}") for c in short.columns)) for side in "xy")
    need = F.ceil(threshold.num * (F.col("xsize") + F.col("ysize")) / F.lit(float(threshold.num + threshold.den)) - 1e-9)
    fits = (F.least("xsize", "ysize") >= need) & (least_differing(F.col("xparity"), F.col("yparity")) <= F.col("xsize") + F.col("ysize") - 2 * need)
    return pairs.join(x, F.col("a") == F.col("xset_id")).join(y, F.col("b") == F.col("yset_id")).filter(fits).select("a", "b")


def linked(pairs: DataFrame, held: DataFrame, threshold: Threshold) -> DataFrame:
    """Those of ``pairs`` (a, b: set ids, distinct) that link: b's set is sent for each pair, a's once a group of pairs."""
    groups = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("groups"))
    salted = pairs.join(groups, "a").withColumn("salt", F.pmod(F.xxhash64("b"), "groups").cast("int"))
    others = salted.select("a", "b", "salt").join(held.select(F.col("set_id").alias("b"), "hashes"), "b")
    salts = F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("salt")
    firsts = groups.select("a", salts).join(held.select(F.col("set_id").alias("a"), F.col("hashes").alias("first")), "a")
    firsts = firsts.select(F.col("a").alias("hub"), F.col("salt").alias("part"), "first")  # names and columns of its own for the cogroup

    def compare(first: pa.Table, rest: pa.Table) -> pa.Table:
        x = np.frombuffer(first.column("first")[0].as_py(), np.uint64)
        good = []
        for raw in rest.column("hashes"):
            y = np.frombuffer(raw.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            good.append(threshold.den * both >= threshold.num * (len(x) + len(y) - both))
        return rest.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return firsts.groupBy("hub", "part").cogroup(others.groupBy("a", "salt")).applyInArrow(compare, "a long, b long")


def clusters_of(links: DataFrame) -> DataFrame:
    return cut(connected_components(links), "clusters").withColumnsRenamed({"node": "set_id", "root": "cluster"})


def apart(pairs: DataFrame, cluster: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b, ...) whose sets aren't in one cluster."""
    of = lambda side: cluster.select(F.col("set_id").alias(side), F.col("cluster").alias(f"c{side}"))
    both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return both.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select(*pairs.columns)


def other_pairs(lists: DataFrame, cluster: DataFrame, threshold: Threshold) -> DataFrame:
    """(a, b) of sets in different clusters that share a list and may link; long lists meet block by block."""
    placed = lists.join(cluster, "set_id", "left").withColumn("cluster", F.coalesce("cluster", "set_id"))
    by = Window.partitionBy("key")
    open_lists = placed.withColumns({"lo": F.min("cluster").over(by), "hi": F.max("cluster").over(by), "n": F.count("*").over(by)}).filter("lo < hi")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = cut(open_lists.select("key", "set_id", "size", "pos", "cluster", blocks.alias("blocks"), F.pmod(F.xxhash64("set_id"), blocks).cast("int").alias("own")), "open")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    side = lambda p, here, there: rows.select("key", F.col("own").alias(here), every.alias(there), *(F.col(c).alias(p + c) for c in ("set_id", "size", "pos", "cluster")))
    meet = side("x", "i", "j").join(side("y", "j", "i"), ["key", "i", "j"])
    meet = meet.filter((F.col("xcluster") < F.col("ycluster")) & threshold.compatible(F.col("xsize"), F.col("xpos"), F.col("ysize"), F.col("ypos")))
    return meet.select(F.least("xset_id", "yset_id").alias("a"), F.greatest("xset_id", "yset_id").alias("b")).distinct()


def jaccard_components(df: DataFrame, n: int = 3, threshold: tuple[int, int] = (9, 10), id_col: str = "doc_id", text_col: str = "text", key_col: str | None = None) -> DataFrame:
    """(id, n_shingles, component_id, set_id, root, row_key) of each row.

    ``component_id`` is the smallest id reachable by links, the row's own included; rows without words
    are linked with nothing.  Ids are whole numbers; null ids are never the smallest, and a component of null ids
    only has a null id.  Rows of one set (equal or equal up to word order of no effect) are linked.  ``root`` is
    the smallest set id of the component, null without words; ``row_key`` is the column ``key_col``, a whole number.
    """
    t = Threshold(*threshold)
    table, sketch = set_table(df, n, id_col, text_col, key_col)
    full = table.filter("n_shingles > 0")
    sets = full.groupBy("set_id").agg(F.min("doc").alias("doc"))
    top = t.boundary(2)
    sizes = {r[0]: r[1] for r in full.filter(F.col("n_shingles") <= top).groupBy("n_shingles").agg(F.countDistinct("set_id")).collect()}
    boundary, depth = chosen_boundary(sizes, sketch, t)
    by = Window.partitionBy("key")
    entries = list_entries(df, n, t, sketch, boundary, depth, text_col)
    entries = entries.withColumns({"f": F.min(F.struct("pos", "set_id", "size")).over(by), "lo": F.min("set_id").over(by), "hi": F.max("set_id").over(by)})
    lists = cut(entries.filter("lo < hi").drop("lo", "hi").distinct(), "lists")

    wide = lists.filter("set_id != f.set_id").filter(t.compatible(F.col("size"), F.col("pos"), F.col("f.size"), F.col("f.pos")))
    stars = cut(wide.groupBy(F.col("f.set_id").alias("a"), F.col("set_id").alias("b")).agg(F.count("*").alias("n")), "stars")
    short = held_sets(df, lists.select("set_id").distinct(), sets, n, id_col, text_col, False)
    parities = short.dropDuplicates(["set_id"])

    def links_of(pairs: DataFrame) -> DataFrame:
        near = cut(plausible(pairs, parities, t), "near")
        wanted = near.select(F.col("a").alias("set_id")).union(near.select(F.col("b").alias("set_id"))).distinct()
        held = held_sets(df, wanted, sets, n, id_col, text_col, True)
        found = cut(linked(near, held, t), "links")
        drop(near, held)
        return found

    best = stars.groupBy("b").agg(F.max(F.struct("n", "a")).alias("m")).select("m.a", "b")
    links = links_of(best)
    cluster = clusters_of(links)
    links = links.unionByName(links_of(apart(stars.select("a", "b").join(best, ["a", "b"], "left_anti"), cluster)))
    cluster = clusters_of(links)
    compared = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    others = other_pairs(lists.drop("f"), cluster, t).join(compared, ["a", "b"], "left_anti")
    links = links.unionByName(links_of(others))
    drop(short, lists, stars)
    roots = clusters_of(links)

    smallest = roots.join(sets, "set_id").groupBy("cluster").agg(F.min("doc").alias("component"))
    named = roots.join(smallest, "cluster").select("set_id", "component", "cluster")
    of_sets = sets.join(named, "set_id", "left").select("set_id", F.coalesce("component", "doc").alias("component"), F.coalesce("cluster", "set_id").alias("root"))
    return table.join(of_sets, "set_id", "left").select(F.col("doc").alias(id_col), "n_shingles", F.coalesce("component", "doc").alias("component_id"), "set_id", "root", "row_key")
