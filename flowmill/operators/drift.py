"""Drift scores of a current window against a past window by nearest neighbours."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a block; rows of a leaf; values of a window that a task holds.
BLOCK, LEAF, HELD = 1000, 64, 4_000_000


def blocks(df: DataFrame, id_col: str, vector: str, side: str) -> DataFrame:
    """One row (ids, vectors) for each block of rows, as bytes of longs and doubles.

    Null vectors and those with a null element are left out; different lengths are an error.
    """
    schema = pa.schema([(f"{side}_ids", pa.binary()), (f"{side}_vectors", pa.binary())])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                held.append(batch.slice(start, BLOCK))
                n += held[-1].num_rows
                if n >= BLOCK:
                    yield block(held)
                    held, n = [], 0
        if n:
            yield block(held)

    def block(parts):
        ids = np.concatenate([p.column(0).to_numpy(zero_copy_only=False) for p in parts]).astype(np.int64)
        vectors = [v for p in parts for v in p.column(1).to_pylist()]
        if len({len(v) for v in vectors}) > 1:
            raise ValueError("vectors differ in length")
        table = np.array(vectors, np.float64)
        return pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary()), pa.array([table.tobytes()], pa.binary())], schema=schema)

    whole = F.col(vector).isNotNull() & F.forall(vector, lambda v: v.isNotNull())
    return df.filter(whole).select(F.col(id_col).cast("long"), F.col(vector)).mapInArrow(run, f"{side}_ids binary, {side}_vectors binary")


def nearest(current: DataFrame, past: DataFrame, k: int, metric: str = "l2", id_col: str = "vec_id", vector: str = "embedding", itself: bool = True) -> DataFrame:
    """(id, neighbour, score, rank): for each current row its k best past rows.

    ``l2`` is the squared distance, least first; ``cosine`` the cosine, largest first, null for zero
    vectors.  Vectors with a null element are left out, different lengths are an error.  Blocks of current rows meet blocks of past rows in the tasks; each pair of blocks gives its own k
    best of each current row, which are shuffled.  Null vectors are left out.  Without ``itself`` a row isn't its
    own neighbour, so the sides may overlap.
    """
    pairs = blocks(current.repartition(id_col), id_col, vector, "a").crossJoin(blocks(past, id_col, vector, "b"))
    schema = pa.schema([(id_col, pa.int64()), ("neighbour", pa.int64()), ("score", pa.float64())])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, table, names, others = (np.frombuffer(batch.column(c)[i].as_py(), kind) for c, kind in enumerate(("<i8", "<f8", "<i8", "<f8")))
                table, others = table.reshape(len(ids), -1), others.reshape(len(names), -1)
                if table.shape[1] != others.shape[1]:
                    raise ValueError("vectors differ in length")
                score = np.empty((len(ids), len(names)))
                if metric == "l2":
                    for j, x in enumerate(table):
                        score[j] = ((others - x) ** 2).sum(1)
                    order = score
                else:
                    with np.errstate(invalid="ignore", divide="ignore"):
                        score = table @ others.T / (np.linalg.norm(table, axis=1)[:, None] * np.linalg.norm(others, axis=1))
                    order = -score
                own = np.zeros(order.shape, bool) if itself else ids[:, None] == names
                top = np.lexsort((np.broadcast_to(names, order.shape), order, own), axis=1)[:, :k]
                left, right, best = np.repeat(ids, top.shape[1]), names[top].ravel(), np.take_along_axis(score, top, 1).ravel()
                good = ~np.take_along_axis(own, top, 1).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(x[good]) for x in (left, right, best)], schema=schema)

    found = pairs.mapInArrow(run, f"`{id_col}` long, neighbour long, score double")
    best = F.col("score") if metric == "l2" else F.desc("score")
    w = Window.partitionBy(id_col).orderBy(best, "neighbour")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def drift_score(current: DataFrame, past: DataFrame, k: int, theta: float, metric: str = "l2", **names: str) -> DataFrame:
    """One row (score, detected): mean over the k best of all current rows; detected above theta for
    distances and below it for cosines, never for NaN or with fewer than k rows on either side."""
    rows = nearest(current, past, k, metric, **names)
    score = rows.agg(F.round(F.avg("score"), 4).alias("score"), F.count("*").alias("_n"))
    enough = F.lit(current.limit(k).count() == k and past.limit(k).count() == k)
    hit = (F.col("score") > theta) if metric == "l2" else (F.col("score") < theta)
    return score.select("score", F.coalesce(enough & hit & ~F.isnan("score"), F.lit(False)).alias("detected"))


class Nearest:
    """Sum over the k best scores of current rows against past rows that come in pieces.

    Equal rows are scored once and counted by their number.  Both sides are halved along their widest axis into leaves; a current leaf meets
    past leaves from the nearest on, until the next one's box is farther than what its rows have already.  Scores are exact.
    """

    def __init__(self, current: np.ndarray, k: int, metric: str) -> None:
        self.k, self.metric, self.whole = k, metric, 0
        rows, self.times = distinct(self.vectors(current))
        self.n = len(current) * k
        self.unknown = np.isnan(rows).any(1)
        self.odd = np.isinf(rows).any(1) & ~self.unknown  # with an infinity: against all rows
        self.rows, self.best, self.weight = rows, np.full((len(rows), k), np.inf), np.zeros((len(rows), k), np.int64)
        fine = np.flatnonzero(~self.unknown & ~self.odd)
        self.leaves = [fine[x] for x in leaves(rows[fine])]

    def vectors(self, x: np.ndarray) -> np.ndarray:
        if self.metric == "l2":
            return x
        with np.errstate(invalid="ignore", divide="ignore"):
            return x / np.linalg.norm(x, axis=1, keepdims=True)

    def scores(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if self.metric == "cosine":
            return -(a @ b.T)
        found = np.zeros((len(a), len(b)))
        for x, y in zip(a.T, b.T, strict=True):
            found += (y - x[:, None]) ** 2
        return found

    def add(self, past: np.ndarray) -> None:
        rows, times = distinct(self.vectors(past))
        self.whole += int(times[~np.isnan(rows).any(1)].sum())
        for i in np.flatnonzero(self.odd):
            for lo in range(0, len(rows), BLOCK):
                with np.errstate(invalid="ignore"):
                    self.merge(np.array([i]), rows[lo : lo + BLOCK], times[lo : lo + BLOCK])
        fine = np.isfinite(rows).all(1)
        rows, times = rows[fine], times[fine]
        if not len(rows):
            return
        parts = leaves(rows)
        low, high = (np.stack([f(rows[p], axis=0) for p in parts]) for f in (np.min, np.max))
        for own in self.leaves:
            x = self.rows[own]
            gap = np.maximum(np.maximum(low - x.max(0), x.min(0) - high), 0)
            least = (gap**2).sum(1)  # no row of the leaf is nearer
            if self.metric == "cosine":
                least = least / 2 - 1 - 1e-9
            bound = self.bound(own)
            near = [int(least.argmin())]
            rest = None
            while True:
                near = [j for j in near if least[j] < bound]
                if near:
                    at = np.concatenate([parts[j] for j in near])
                    self.merge(own, rows[at], times[at])
                    bound = self.bound(own)
                if rest is None:
                    first, rest = int(least.argmin()), np.flatnonzero(least < bound)
                    rest = rest[rest != first]
                    rest, step = rest[np.argsort(least[rest], kind="stable")], 4
                if not len(rest) or least[rest[0]] >= bound:
                    break
                near, rest, step = rest[:step].tolist(), rest[step:], min(2 * step, 32)

    def bound(self, own: np.ndarray) -> float:
        """The largest k-th best score of the rows; infinite as long as one has fewer."""
        full = self.weight[own].cumsum(1) >= self.k
        return float(np.where(full.any(1), np.take_along_axis(self.best[own], full.argmax(1)[:, None], 1)[:, 0], np.inf).max())

    def merge(self, own: np.ndarray, rows: np.ndarray, times: np.ndarray) -> None:
        score = np.hstack([self.best[own], self.scores(self.rows[own], rows)])
        weight = np.hstack([self.weight[own], np.broadcast_to(times, (len(own), len(times)))])
        score = np.where(weight > 0, score, np.nan)  # empty places come last
        top = np.argpartition(score, self.k - 1, axis=1)[:, : self.k]
        top = np.take_along_axis(top, np.argsort(np.take_along_axis(score, top, 1), axis=1), 1)
        self.best[own], self.weight[own] = np.take_along_axis(score, top, 1), np.take_along_axis(weight, top, 1)

    def total(self) -> float:
        """Missing scores are those of past rows that are infinite or not numbers."""
        upto = np.minimum(self.weight.cumsum(1), self.k)
        taken = np.diff(upto, axis=1, prepend=0)
        with np.errstate(invalid="ignore", over="ignore"):
            sums = np.where(taken > 0, self.best * taken, 0).sum(1)
            sums = np.where(upto[:, -1] == self.k, sums, np.inf if self.whole >= self.k else np.nan)
            return float((np.where(self.unknown, np.nan, sums) * self.times).sum())


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and their numbers."""
    x = x[np.lexsort(x.T)]
    starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(x)), bool), (x[1:] != x[:-1]).any(1)]))
    return x[starts], np.diff(np.append(starts, len(x)))


def leaves(x: np.ndarray) -> list[np.ndarray]:
    """Places of the rows in leaves of at most ``LEAF``."""
    out, left = [], [np.arange(len(x))] if len(x) else []
    while left:
        own = left.pop()
        if len(own) <= LEAF:
            out.append(own)
            continue
        axis = (x[own].max(0) - x[own].min(0)).argmax()
        halves = np.argpartition(x[own, axis], len(own) // 2)
        left += [own[halves[: len(own) // 2]], own[halves[len(own) // 2 :]]]
    return out


def scores_of_windows(members: DataFrame, by: list[str], size: int, k: int, theta: float, metric: str) -> DataFrame:
    """(by, score, detected) of many pairs of windows at once, from rows (by, number, is_current, v of ``size`` values).

    The score is the mean over the k best of all current rows; windows with fewer than k rows on a side give none and aren't detected, nor is
    NaN.  A pair's current rows are held by one task up to ``HELD`` values, more are dealt over tasks; its past rows stream by in pieces as large.
    """
    limit = max(1, HELD // max(size, k))
    sizes = members.groupBy(*by).agg(F.count_if("is_current").alias("_a"), F.count_if(~F.col("is_current")).alias("_b")).filter((F.col("_a") >= k) & (F.col("_b") >= k))
    rows = members.join(F.broadcast(sizes.select(*by, F.ceil(F.col("_a") / limit).cast("int").alias("_blocks"))), by)  # a row for each pair of windows
    block = F.when(F.col("is_current"), F.array(F.pmod(F.xxhash64("number"), F.col("_blocks")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("_blocks") - 1))
    heads, n = [*by, "block"], len(by)
    dealt = rows.select(*by, F.explode(block).alias("block"), (~F.col("is_current")).alias("is_past"), "v")
    kinds = dict(dealt.dtypes)
    kind = ", ".join(f"`{c}` {kinds[c]}" for c in by) + ", total double, n long"

    def run(batches):
        now, schema, near, current, past = None, None, None, [], []

        def finish():
            if now is None or not current or not (near or past):
                return []
            found = near or Nearest(np.concatenate(current), k, metric)
            if past:
                found.add(np.concatenate(past))
            return [pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip([*now[:n], found.total(), found.n], schema, strict=True)], schema=schema)]

        for batch in batches:
            schema = schema or pa.schema([*(batch.schema.field(i) for i in range(n)), ("total", pa.float64()), ("n", pa.int64())])
            differs = np.zeros(max(0, batch.num_rows - 1), bool)
            for column in batch.columns[: n + 2] if batch.num_rows else ():
                differs |= pc.fill_null(pc.not_equal(column.slice(1), column.slice(0, batch.num_rows - 1)), True).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(differs) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                here = [batch.column(i)[lo].as_py() for i in range(n + 1)]
                if here != now:
                    yield from finish()
                    now, near, current, past = here, None, [], []
                own = batch.column(n + 2).slice(lo, hi - lo).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
                (past if batch.column(n + 1)[lo].as_py() else current).append(own)
                if current and past and sum(map(len, past)) >= limit:
                    near = near or Nearest(np.concatenate(current), k, metric)
                    near.add(np.concatenate(past))
                    past = []
        yield from finish()

    found = dealt.repartition(*heads).sortWithinPartitions(*heads, "is_past").mapInArrow(run, kind)
    score = F.sum("total") / F.sum("n") * (1 if metric == "l2" else -1)
    rows = found.groupBy(*by).agg(score.alias("score"))
    hit = (F.col("score") > theta) if metric == "l2" else (F.col("score") < theta)
    return rows.withColumn("detected", hit & ~F.isnan("score"))


def distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Squared distances of all pairs of rows, or negated cosines, which are NaN for zero vectors: the best are least."""
    if metric == "cosine":
        with np.errstate(invalid="ignore", divide="ignore"):
            a, b = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (a, b))
        return -(a @ b.T)
    return np.stack([((b - row) ** 2).sum(1) for row in a])


def inverted_index(df: DataFrame, cells: int, sample: int = 20_000, rounds: int = 10, id_col: str = "vec_id", vector: str = "embedding") -> np.ndarray:
    """Centres of at most ``cells`` cells, fitted by k-means on ``sample`` rows of least hash of their ids; every row is indexed by them later."""
    rows = df.filter(F.col(vector).isNotNull()).select(F.col(id_col).alias("i"), F.col(vector).cast("array<double>").alias("v"))
    taken = np.array([r.v for r in rows.orderBy(F.xxhash64("i"), "i").limit(sample).collect()], np.float64)  # a bounded sample
    if not len(taken):
        return np.zeros((0, 0))
    centres = np.unique(taken, axis=0)
    centres = centres[np.linspace(0, len(centres) - 1, min(cells, len(centres))).astype(int)]
    for _ in range(rounds):
        own = nearest_centres(taken, centres, 1)[:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, own, taken)
        n = np.bincount(own, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def nearest_centres(x: np.ndarray, centres: np.ndarray, probes: int) -> np.ndarray:
    far = (x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)
    return np.argsort(far, axis=1, kind="stable")[:, :probes]


def in_cells_of(df: DataFrame, centres: np.ndarray, probes: int, id_col: str, vector: str) -> DataFrame:
    """(cell, block, ids, v): rows packed by the ``probes`` cells nearest to them, large cells in blocks of about ``BLOCK`` rows."""
    schema = pa.schema([("id", pa.int64()), ("cell", pa.int32()), ("v", pa.list_(pa.float64()))])

    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                cells = nearest_centres(x, centres, probes)
                rows = np.repeat(np.arange(len(x)), cells.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(cells.ravel().astype(np.int32)), batch.column(1).take(pa.array(rows))], schema=schema)

    rows = df.filter(F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(assign, "id long, cell int, v array<double>")
    sizes = rows.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("_blocks"))
    dealt = rows.join(F.broadcast(sizes), "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("_blocks")))  # a row for each cell
    packed = dealt.groupBy("cell", "block").agg(F.collect_list(F.struct("id", "v")).alias("_rows"))
    return packed.select("cell", "block", F.col("_rows.id").alias("ids"), F.flatten("_rows.v").alias("v"))


def approximate_nearest(current: DataFrame, past: DataFrame, centres: np.ndarray, k: int, probes: int, id_col: str = "vec_id", vector: str = "embedding", itself: bool = True) -> DataFrame:
    """(id, neighbour, score, rank) by squared distance among the past rows of the ``probes`` cells nearest to each current row.

    Distances are exact; a neighbour in another cell is missed.  Vectors have the centres' length.
    """
    size = centres.shape[1]
    a = in_cells_of(current, centres, probes, id_col, vector).select("cell", F.col("ids").alias("a_ids"), F.col("v").alias("a"))
    b = in_cells_of(past, centres, 1, id_col, vector).select("cell", F.col("ids").alias("b_ids"), F.col("v").alias("b"))
    schema = pa.schema([(id_col, pa.int64()), ("neighbour", pa.int64()), ("score", pa.float64())])

    def run(batches):
        for row in (r for batch in batches for r in batch.to_pylist()):
            ids, names = np.array(row["a_ids"]), np.array(row["b_ids"])
            far = distances(np.array(row["a"]).reshape(-1, size), np.array(row["b"]).reshape(-1, size), "l2")
            far = far if itself else np.where(ids[:, None] == names, np.inf, far)
            top = np.lexsort((np.broadcast_to(names, far.shape), far), axis=1)[:, :k]
            best = np.take_along_axis(far, top, 1).ravel()
            good = np.isfinite(best)
            yield pa.RecordBatch.from_arrays([pa.array(x[good]) for x in (np.repeat(ids, top.shape[1]), names[top].ravel(), best)], schema=schema)

    found = a.join(b, "cell").select("a_ids", "a", "b_ids", "b").mapInArrow(run, f"`{id_col}` long, neighbour long, score double")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(id_col).orderBy("score", "neighbour"))).filter(F.col("rank") <= k)


def ensemble(votes: Column, code: int) -> Column:
    """0: the first model's vote, 1: the majority of binary votes."""
    return F.get(votes, 0) if code == 0 else (F.aggregate(votes, F.lit(0), lambda s, v: s + v) > F.size(votes) / 2).cast("int")
