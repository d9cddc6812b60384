"""Replay of flows through per-key classifiers that are retrained on a schedule or when drift is found.

When a model is retrained depends on times and on rows, never on scores.  So a batch replay first finds by closed forms how often each
clock has fired by every row, then trains each key's rounds in order, then scores all rows with the weights that
held before them.  No key is folded in one task.  At a row a model first predicts; only then may a clock fire, and what is
trained doesn't hold the row itself.  In a stream a key's rows are folded as they come.

* ``nt``: models are never trained.
* ``st``: one clock of the session retrains all keys on the rows since it last fired.
* ``dy``: each key's clock, first due when the longest windows are full, tests whether the current window is far from the
  past one; if so, the model is trained on the current window.  With several windows each has a model, and their votes decide.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import scalars
from ..operators.drift import ensemble, scores_of_windows
from ..operators.models import Adam, create
from ..operators.order import cadence
from ..session import written
from .fitting import fit_rounds, score_rounds

OUT = "key string, seq long, label int, score double, vote int, retrained boolean"
SCALES = {"count": scalars.scaled_count, "duration": scalars.scaled_duration, "port": scalars.port_bucket, "interval": scalars.scaled_interval, "length": scalars.scaled_length}
NUMPY_SCALES = {"count": lambda x: np.log1p(x / 1000), "duration": np.log1p, "port": lambda x: np.select([x <= 1023, x <= 49151], [0.0, 0.5], 1.0), "interval": lambda x: x / 60, "length": lambda x: x / 10000}


@dataclass(frozen=True)
class Windows:
    """A current window of ``current`` seconds and a past one of ``past`` before it; drift by the mean of the k best scores of each current row."""

    current: float = 600.0
    past: float = 3600.0
    k: int = 8
    theta: float = 0.025
    metric: str = "l2"


@dataclass(frozen=True)
class Settings:
    """How a session runs; times in seconds.  ``start`` is the session's start, by default that of its first row."""

    mode: str
    code: int = 4
    interval: float = 3600.0
    epochs: int = 20
    rate: float = 0.001
    steps: int = 1
    windows: tuple[Windows, ...] = (Windows(),)
    ensemble: int = 0
    scaling: dict[str, str] = field(default_factory=dict)
    start: float | None = None

    def __post_init__(self) -> None:
        if self.mode not in ("nt", "st", "dy"):
            raise ValueError("the mode must be nt, st or dy")
        if any(w.metric not in ("l2", "cosine") for w in self.windows) or self.ensemble not in (0, 1) or not self.windows:
            raise ValueError("windows need l2 or cosine, the ensemble is 0 or 1")

    @property
    def wait(self) -> float:
        return max(w.current + w.past for w in self.windows)


def settings(mode: str, given: dict) -> Settings:
    """Settings from keywords; those of a single window may be given among them."""
    own = {k: given.pop(k) for k in ("current", "past", "k", "theta", "metric") if k in given}
    return Settings(mode, **({"windows": (Windows(**own),)} if own else {}), **given)


def micros(seconds: float) -> int:
    return round(seconds * 1_000_000)


def replay(df: DataFrame, features: list[str], mode: str, **given) -> DataFrame:
    """(key, seq, label, score, vote, retrained) of every row of (key, seq, t seconds, label, features).

    ``score`` is the first window's model's; ``vote`` is the first model's decision or the majority's.  ``retrained`` marks the rows after which a
    clock fired (``st``) or drift was found (``dy``).  Rows without a time aren't part of a session.
    """
    return run_session(df, features, settings(mode, given))[0]


def run_session(df: DataFrame, features: list[str], s: Settings) -> tuple[DataFrame, DataFrame]:
    """The rows of ``replay``, and (key, window, at_us, n, benign, malicious, loss, accuracy, weights) of every training."""
    us = F.round(F.col("t") * 1_000_000).cast("long")
    rows = df.filter(F.col("t").isNotNull()).select(F.coalesce(F.col("key").cast("string"), F.lit("")).alias("key"), F.col("seq").cast("long").alias("seq"), us.alias("us"), F.col("label").cast("int").alias("label"), F.array(*(F.col(f).cast("double") for f in features)).alias("x"))
    start = micros(s.start) if s.start is not None else rows.agg(F.min("us")).first()[0] or 0  # one value
    rows = rows.filter(F.col("us") >= F.lit(start))
    if s.mode == "dy":
        return _dynamic(rows, features, s, start)
    if s.mode == "nt":
        timed = rows.select("*", F.lit(0).cast("long").alias("version"), F.lit(0).cast("long").alias("round"))
        fitted = None
    else:
        timed = written(cadence(rows, F.lit(start), micros(s.interval), ["us", "seq"], F.col("us"), name="round", before="version"), "clocked")
        last = timed.agg(F.max("round")).first()[0]  # rows after the clock last fired train nothing
        fitted = fit_rounds(timed.filter(F.col("round") < F.lit(last)), s.code, len(features), s.epochs, s.rate, s.steps)
    fired = F.col("round") > F.col("version")
    log = _log(fitted, timed.filter(fired).groupBy(F.col("version").alias("round")).agg(F.min("us").alias("at_us")), ["round"]) if fitted is not None else None
    scored = score_rounds(timed.select("key", "seq", "label", "version", "x", fired.alias("retrained")), fitted if fitted is not None else _untrained(df), s.code, len(features))
    return scored.select("key", "seq", "label", "score", (F.col("score") >= 0.5).cast("int").alias("vote"), "retrained"), log if log is not None else _log(_untrained(df), None, ["round"])


def _untrained(df: DataFrame) -> DataFrame:
    from .fitting import FITTED

    return df.sparkSession.createDataFrame([], FITTED)


def _log(fitted: DataFrame, times: DataFrame | None, by: list[str]) -> DataFrame:
    """The training log: a chain's name ends with its window's number after a line feed."""
    timed = fitted.withColumn("at_us", F.lit(None).cast("long")) if times is None else fitted.join(times, by)
    parts = F.split("key", "\n")
    return timed.select(parts[0].alias("key"), F.coalesce(F.get(parts, F.lit(1)).cast("int"), F.lit(0)).alias("window"), "at_us", "n", "benign", "malicious", "loss", "accuracy", "weights")


def scaled(x: Column, features: list[str], scaling: dict[str, str]) -> Column:
    """The vector that drift is tested on: features by their kind of scale, others as they are."""
    return F.array(*(SCALES[scaling[f]](x[i]) if f in scaling else x[i] for i, f in enumerate(features)))


def drift_checks(rows: DataFrame, features: list[str], s: Settings, start: int) -> tuple[DataFrame, DataFrame]:
    """Rows with the times their key's clock has fired, and every check: (key, check, window, seq, us, score, detected, previous).

    A check sees its windows as of the key's row before.  ``previous`` is that row's time, ``number`` the checked row's place in its key.
    """
    first = F.lit(start + micros(s.wait) - micros(s.interval))  # a clock is first due one interval after this
    timed = written(cadence(rows, first, micros(s.interval), ["us", "seq"], F.col("us"), keys=("key",), name="fired", before="version", first="number"), "clocked")
    before = timed.select("key", (F.col("number") + 1).alias("number"), F.col("us").alias("previous"))
    checks = timed.filter("fired > version").select("key", F.col("version").alias("check"), "seq", "us", "number").join(before, ["key", "number"])
    checks = written(checks.crossJoin(F.broadcast(_windows(rows, s))), "checks")  # a few windows
    # rows meet the checks that look back on them in cells of time as long as the longest windows
    span = F.col("current") + F.col("past")
    cell = micros(s.wait)
    low, high = F.floor((F.col("previous") - span) / cell), F.floor(F.col("previous") / cell)
    looks = checks.withColumn("cell", F.explode(F.sequence(low, high))).select("key", "check", "window", "current", "past", "previous", "cell", F.col("number").alias("until"))
    seen = timed.select("key", F.floor(F.col("us") / cell).alias("cell"), "number", "seq", "us", "label", "x").join(looks, ["key", "cell"])
    seen = seen.filter((F.col("number") < F.col("until")) & (F.col("us") >= F.col("previous") - span) & (F.col("us") <= F.col("previous")))
    seen = written(seen.select("key", "check", "window", "number", "seq", "label", "x", (F.col("us") >= F.col("previous") - F.col("current")).alias("is_current")), "windows")
    found = None
    for w in dict.fromkeys((w.k, w.theta, w.metric) for w in s.windows):
        own = [i for i, x in enumerate(s.windows) if (x.k, x.theta, x.metric) == w]
        members = seen.filter(F.col("window").isin(own)).select("key", "check", "window", "number", "is_current", scaled(F.col("x"), features, s.scaling).alias("v"))
        scores = scores_of_windows(members, ["key", "check", "window"], len(features), *w)
        found = scores if found is None else found.unionByName(scores)
    told = checks.drop("current", "past", "previous", "number").join(found, ["key", "check", "window"], "left").na.fill(False, ["detected"])
    return timed, told, seen


def _windows(rows: DataFrame, s: Settings) -> DataFrame:
    return rows.sparkSession.createDataFrame([(i, micros(w.current), micros(w.past)) for i, w in enumerate(s.windows)], "window int, current long, past long")


def _dynamic(rows: DataFrame, features: list[str], s: Settings, start: int) -> tuple[DataFrame, DataFrame]:
    timed, checks, seen = drift_checks(rows, features, s, start)
    checks = written(checks, "drift")
    hits = checks.filter("detected").select("key", "check", "window")
    chain = F.concat_ws("\n", "key", F.col("window").cast("string")).alias("key")
    sets = seen.filter("is_current").join(hits, ["key", "check", "window"]).select(chain, F.col("check").alias("round"), "seq", "label", "x")
    fitted = fit_rounds(sets, s.code, len(features), s.epochs, s.rate, s.steps)
    every = timed.select("key", "seq", "label", "version", "x", F.explode(F.array(*map(F.lit, range(len(s.windows))))).alias("window"))
    scored = score_rounds(every.select(chain, "seq", "label", "version", "x", "window", F.col("key").alias("of")), fitted, s.code, len(features))
    votes = scored.groupBy(F.col("of").alias("key"), "seq", "label").agg(F.sort_array(F.collect_list(F.struct("window", "score"))).alias("s"))  # a few windows
    decided = ensemble(F.transform("s", lambda x: (x["score"] >= 0.5).cast("int")), s.ensemble)
    marked = hits.select("key", "check").distinct().join(checks.select("key", "check", "seq").distinct(), ["key", "check"]).select("key", "seq", F.lit(True).alias("retrained"))
    out = votes.join(marked, ["key", "seq"], "left").select("key", "seq", "label", F.col("s")[0]["score"].alias("score"), decided.alias("vote"), F.coalesce("retrained", F.lit(False)).alias("retrained"))
    times = checks.filter("detected").select(chain, F.col("check").alias("round"), F.col("us").alias("at_us"))
    return out, _log(fitted, times, ["key", "round"])


class Fold:
    """A key's rows in order: its clock, windows and models.  ``start`` is the session's start in microseconds."""

    def __init__(self, s: Settings, features: list[str], start: int) -> None:
        self.s, self.features, self.model = s, features, create(s.code, len(features))
        self.adams = [Adam(self.model.start()) for _ in (s.windows if s.mode == "dy" else "1")]
        self.due = start + micros(s.wait if s.mode == "dy" else s.interval)
        self.current: list[deque] = [deque() for _ in s.windows]
        self.past: list[deque] = [deque() for _ in s.windows]

    def step(self, us: int, x: np.ndarray, y: int, seq: int) -> tuple[float, int, bool]:
        scores = [float(self.model.predict(a.weights, x[None, :])[0]) for a in self.adams]
        binary = [int(v >= 0.5) for v in scores]
        vote, trained = (binary[0] if self.s.ensemble == 0 else int(sum(binary) > len(binary) / 2)), False
        if self.s.mode != "nt" and us > self.due:
            if self.s.mode == "st":
                trained = True
                self.fit(0, self.current[0])
                self.current[0].clear()
            for i in range(len(self.s.windows)) if self.s.mode == "dy" else ():
                if self.drifted(i):
                    self.fit(i, self.current[i])
                    trained = True
            self.due += micros(self.s.interval)
        if self.s.mode == "st":
            self.current[0].append((us, seq, y, x))
        elif self.s.mode == "dy":
            for i, w in enumerate(self.s.windows):
                self.current[i].append((us, seq, y, x))
                while self.current[i][0][0] < us - micros(w.current):
                    self.past[i].append(self.current[i].popleft())
                while self.past[i] and self.past[i][0][0] < us - micros(w.current) - micros(w.past):
                    self.past[i].popleft()
        return scores[0], vote, trained

    def scaled(self, rows: deque) -> np.ndarray:
        out = np.array([r[3] for r in rows], np.float64)
        for j, f in enumerate(self.features):
            if f in self.s.scaling:
                out[:, j] = NUMPY_SCALES[self.s.scaling[f]](out[:, j])
        return out

    def drifted(self, i: int) -> bool:
        w = self.s.windows[i]
        if min(len(self.current[i]), len(self.past[i])) < w.k:
            return False
        a, b = self.scaled(self.current[i]), self.scaled(self.past[i])
        if w.metric == "cosine":
            with np.errstate(invalid="ignore", divide="ignore"):
                a, b = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (a, b))
            return bool(np.mean(-np.sort(-(a @ b.T), axis=1)[:, : w.k]) < w.theta)
        far = np.stack([((b - row) ** 2).sum(1) for row in a])
        return bool(np.mean(np.sort(far, axis=1)[:, : w.k]) > w.theta)

    def fit(self, i: int, rows: deque) -> None:
        from .fitting import step_of

        good = [r for r in rows if r[2] is not None and not np.isnan(r[3]).any()]
        if not good:
            return
        x, y, seq = np.array([r[3] for r in good]), np.array([r[2] for r in good], np.float64), np.array([r[1] for r in good], np.int64)
        for epoch in range(self.s.epochs):
            of = step_of(seq, epoch, self.s.steps)
            for step in range(self.s.steps):
                own = of == step
                if own.any():
                    self.adams[i].step(self.model.gradient(self.adams[i].weights, x[own], y[own])[1] / own.sum(), self.s.rate)


ROW = "us long, seq long, label int, x binary"


class Replayer(StatefulProcessor):
    """Keyed state: weights and clock as a value, rows of the windows as a list; a micro-batch of a key is folded in order of time.

    A list is rewritten only for keys with new rows; rows go when they leave the past window, so it holds no more than the windows do.
    """

    def __init__(self, s: Settings, features: list[str], start: int) -> None:
        self.s, self.features, self.start = s, features, start

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.clock = handle.getValueState("clock", "due long, weights binary, first binary, second binary, steps binary")
        self.rows = handle.getListState("rows", f"side int, window int, {ROW}")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fold = Fold(self.s, self.features, self.start)
        if self.clock.exists():
            due, *parts, steps = self.clock.get()
            fold.due = due
            weights, first, second = (np.frombuffer(p).reshape(len(fold.adams), -1) for p in parts)
            fold.adams = [Adam(w.copy(), a.copy(), b.copy(), int(n)) for w, a, b, n in zip(weights, first, second, np.frombuffer(steps, np.int64), strict=True)]
            for side, window, us, seq, label, x in self.rows.get():
                (fold.current if side else fold.past)[window].append((us, seq, label, np.frombuffer(x)))
        pdf = pd.concat(list(rows)).sort_values(["t", "seq"], kind="stable")
        labels = [None if pd.isna(y) else int(y) for y in pdf["label"]]
        out = [(seq, label, *fold.step(micros(t), x, label, seq)) for t, seq, label, x in zip(pdf["t"].tolist(), pdf["seq"].tolist(), labels, pdf[self.features].to_numpy(np.float64), strict=True)]
        joined = [np.stack([getattr(a, c) for a in fold.adams]).tobytes() for c in ("weights", "first", "second")]
        self.clock.update((fold.due, *joined, np.array([a.steps for a in fold.adams], np.int64).tobytes()))
        held = [(side, i, us, seq, label, x.tobytes()) for side, windows in ((0, fold.past), (1, fold.current)) for i, rows in enumerate(windows) for us, seq, label, x in rows]
        if held:
            self.rows.put(held)
        elif self.rows.exists():
            self.rows.clear()
        yield pd.DataFrame({"key": key[0], **{c: v for c, v in zip(("seq", "label", "score", "vote", "retrained"), zip(*out, strict=True), strict=True)}})

    def close(self) -> None:
        pass


def replay_stream(stream: DataFrame, features: list[str], mode: str, **given) -> DataFrame:
    """The same over a stream whose micro-batches come in order of time; ``start`` must be given.

    ``dy`` gives what the batch gives.  In ``st`` a key's clock moves on with the key's own rows only, as its state sees no others.  Needs the
    RocksDB state store.
    """
    s = settings(mode, given)
    if s.start is None:
        raise ValueError("a stream needs the session's start")
    rows = stream.filter(F.col("t").isNotNull() & (F.col("t") >= s.start)).select(F.coalesce(F.col("key").cast("string"), F.lit("")).alias("key"), "seq", "t", "label", *features)
    return rows.groupBy("key").transformWithStateInPandas(Replayer(s, features, micros(s.start)), outputStructType=OUT, outputMode="Append", timeMode="None")
