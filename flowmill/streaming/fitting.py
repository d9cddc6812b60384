"""Chains of models: each key's model is trained in rounds, every round going on from the weights of the one before.

A round of a key of up to ``TASK_ROWS`` rows is trained in one task, which streams through the rounds of its keys and holds one at a time.  A larger
round is spread over the cluster: for every step tasks give sums of gradients, which are added up for each key.
Both give the same steps of Adam, so sizes decide where a round is trained and not what comes out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.models import Adam, create
from ..session import written

#: Rows of a key's round that one task trains; rows of a scoring group.
TASK_ROWS, SLICE = 200_000, 100_000
FITTED = "key string, round long, n long, benign long, malicious long, loss double, accuracy double, weights binary"
SCHEMA = pa.schema([("key", pa.string()), *((c, pa.int64()) for c in ("round", "n", "benign", "malicious")), ("loss", pa.float64()), ("accuracy", pa.float64()), ("weights", pa.binary()), ("moments", pa.binary()), ("steps", pa.int64())])
TRAINED = f"{FITTED}, moments binary, steps long"


def matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def step_of(seq: np.ndarray, epoch: int, steps: int) -> np.ndarray:
    """The step of each row in an epoch."""
    with np.errstate(over="ignore"):
        mixed = (seq.astype(np.uint64) + np.uint64(epoch + 1) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(33)) % np.uint64(steps)


def sums(model, weights: np.ndarray, x: np.ndarray, y: np.ndarray) -> list:
    """Rows, malicious rows, hits, loss and gradient."""
    loss, gradient = model.gradient(weights, x, y)
    return [len(y), int((y == 1).sum()), int(((model.predict(weights, x) >= 0.5) == (y == 1)).sum()), loss, gradient]


def trained(key: str, number: int, told: list, adam: Adam) -> pa.RecordBatch:
    n, bad, hits, loss = told
    values = (key, number, n, n - bad, bad, loss / n, hits / n, adam.weights.tobytes(), np.stack([adam.first, adam.second]).tobytes(), adam.steps)
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, SCHEMA, strict=True)], schema=SCHEMA)


def adam_of(weights: bytes, moments: bytes, steps: int) -> Adam:
    first, second = np.frombuffer(moments).reshape(2, -1)
    return Adam(np.frombuffer(weights), first, second, steps)


def fit_rounds(sets: DataFrame, code: int, size: int, epochs: int, rate: float = 0.001, steps: int = 1) -> DataFrame:
    """Train on (key, round, seq, label, x) and return the written table (key, round, n, benign, malicious, loss, accuracy, weights).

    An epoch has ``steps`` steps of Adam; a row's step is a hash of its ``seq`` and the epoch.  Rows with a NaN or null are left out.  Loss
    and accuracy are those before the steps of the last epoch.
    """
    spark = sets.sparkSession
    clean = sets.filter(F.col("label").isNotNull() & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v)))
    rows = written(clean.select("key", F.col("round").cast("long").alias("round"), F.col("seq").cast("long").alias("seq"), F.col("label").cast("double").alias("label"), F.col("x").cast("array<double>").alias("x")), "training")
    large = written(rows.groupBy("key", "round").agg(F.count("*").alias("n")).filter(F.col("n") > TASK_ROWS).drop("n"), "large")
    rounds = sorted(r.round for r in large.select("round").distinct().collect())  # one for so many rows
    small = rows.join(F.broadcast(large), ["key", "round"], "left_anti") if rounds else rows  # a row for each TASK_ROWS rows
    done, last = None, -1
    for number in [*rounds, None]:
        own = small.filter((F.col("round") > last) & (F.col("round") <= number if number is not None else F.lit(True)))
        found = written(_fold(own, _latest(done), code, size, epochs, rate, steps), "fitted")
        done = found if done is None else done.unionByName(found)
        if number is not None:
            part = written(rows.filter(F.col("round") == number).join(F.broadcast(large), ["key", "round"]), "large-round")
            held = {r.key: adam_of(r.weights, r.moments, r.steps) for r in _latest(done).join(F.broadcast(large.filter(F.col("round") == number)), "key", "left_semi").collect()}  # a row for each large key
            batches = list(_spread(part, number, held, code, size, epochs, rate, steps))
            done = done.unionByName(spark.createDataFrame(pa.Table.from_batches(batches, SCHEMA)))
            last = number
    return done.drop("moments", "steps")


def _latest(done: DataFrame | None) -> DataFrame | None:
    if done is None:
        return None
    newest = done.groupBy("key").agg(F.max("round").alias("round"))
    return done.join(newest, ["key", "round"]).select("key", "weights", "moments", "steps")


def _fold(rows: DataFrame, before: DataFrame | None, code: int, size: int, epochs: int, rate: float, steps: int) -> DataFrame:
    """Train rounds of bounded size: a task goes through its keys' rounds in order, from the states that come as the first row of a key."""
    none = {"weights": "binary", "moments": "binary", "steps": "long"}
    both = rows.select("*", *(F.lit(None).cast(t).alias(c) for c, t in none.items()))
    if before is not None:
        both = both.unionByName(before.select("key", F.lit(-1).cast("long").alias("round"), F.lit(0).cast("long").alias("seq"), F.lit(None).cast("double").alias("label"), F.lit(None).cast("array<double>").alias("x"), *none))
    model = create(code, size)

    def run(batches):
        now, adam, held = None, None, []

        def finish():
            if not held:
                return
            x, y, seq = (np.concatenate(c) for c in zip(*held, strict=True))
            told = [0, 0, 0, 0.0]
            for epoch in range(epochs):
                of = step_of(seq, epoch, steps)
                for step in range(steps):
                    at = slice(None) if steps == 1 else np.flatnonzero(of == step)
                    if len(y[at]):
                        *own, gradient = sums(model, adam.weights, x[at], y[at])
                        adam.step(gradient / own[0], rate)
                        told = [a + b for a, b in zip(told, own, strict=True)] if epoch == epochs - 1 else told
            if told[0]:
                yield trained(now[0], now[1], told, adam)

        for batch in batches:
            keys, numbers = batch.column("key").to_pylist(), batch.column("round").to_numpy()
            cuts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1] or numbers[i] != numbers[i - 1]]
            for lo, hi in zip(cuts, [*cuts[1:], len(keys)], strict=True):
                here, part = (keys[lo], int(numbers[lo])), batch.slice(lo, hi - lo)
                if here != now:
                    yield from finish()
                    adam = adam if now and now[0] == here[0] else Adam(model.start())
                    now, held = here, []
                if here[1] < 0:
                    adam = adam_of(*(part.column(c)[0].as_py() for c in none))
                else:
                    held.append((matrix(part.column("x"), size), part.column("label").to_numpy(), part.column("seq").to_numpy()))
        yield from finish()

    return both.repartition("key").sortWithinPartitions("key", "round", "seq").mapInArrow(run, TRAINED)


def _spread(rows: DataFrame, number: int, adams: dict[str, Adam], code: int, size: int, epochs: int, rate: float, steps: int):
    """Train one large round of some keys: a job for each step, whose tasks sum gradients and whose result is a row for each key."""
    model, told = create(code, size), {}
    kind = "key string, n long, bad long, hits long, loss double, gradient binary"
    schema = pa.schema([("key", pa.string()), *((c, pa.int64()) for c in ("n", "bad", "hits")), ("loss", pa.float64()), ("gradient", pa.binary())])

    def made(found):
        return [pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((key, *own[:4], own[4].tobytes()), schema, strict=True)], schema=schema) for key, own in found.items()]

    for epoch in range(epochs):
        for step in range(steps):
            weights = {key: a.weights for key, a in adams.items()}

            def partial(batches, weights=weights, epoch=epoch, step=step):
                found: dict[str, list] = {}
                for batch in batches:
                    keys = np.array(batch.column("key").to_pylist(), object)
                    x, y, of = matrix(batch.column("x"), size), batch.column("label").to_numpy(), step_of(batch.column("seq").to_numpy(), epoch, steps)
                    for key in sorted(set(keys)):
                        at = np.flatnonzero((keys == key) & (of == step))
                        if len(at):
                            own = sums(model, weights[key] if key in weights else model.start(), x[at], y[at])
                            found[key] = [a + b for a, b in zip(found[key], own, strict=True)] if key in found else own
                yield from made(found)

            def total(parts):
                key, out = None, None
                for batch in parts:
                    for row in batch.to_pylist():
                        own = [row["n"], row["bad"], row["hits"], row["loss"], np.frombuffer(row["gradient"])]
                        key, out = row["key"], own if out is None else [a + b for a, b in zip(out, own, strict=True)]
                yield from made({key: out})

            for r in rows.mapInArrow(partial, kind).groupBy("key").applyInArrow(_iterated(total), kind).collect():  # a row for each large key
                adams.setdefault(r.key, Adam(model.start())).step(np.frombuffer(r.gradient) / r.n, rate)
                if epoch == epochs - 1:
                    told[r.key] = [a + b for a, b in zip(told.get(r.key, [0, 0, 0, 0.0]), (r.n, r.bad, r.hits, r.loss), strict=True)]
    for key, own in sorted(told.items()):
        yield trained(key, number, own, adams[key])


def _iterated(f):
    """``f`` with the annotations by which Spark tells that it takes a group batch by batch."""
    from collections.abc import Iterator

    f.__annotations__ = {"parts": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return f


def score_rounds(rows: DataFrame, fitted: DataFrame, code: int, size: int) -> DataFrame:
    """Adds ``score`` to rows (key, seq, version, x): by the key's last round below ``version``, or the untrained model.

    Rows of a key and version are dealt over groups of bounded size, each with its weights.
    """
    asked = rows.groupBy("key", "version").agg(F.count("*").alias("rows"))
    both = asked.select("key", "version", "rows", F.lit(None).cast("binary").alias("weights"), F.lit(1).alias("kind")).unionByName(fitted.select("key", (F.col("round") + 1).alias("version"), F.lit(None).cast("long").alias("rows"), "weights", F.lit(0).alias("kind")))
    upto = Window.partitionBy("key").orderBy("version", "kind").rowsBetween(Window.unboundedPreceding, 0)  # a row for each round
    known = both.withColumn("weights", F.last("weights", True).over(upto)).filter("kind = 1").select("key", "version", "weights", F.ceil(F.col("rows") / SLICE).cast("int").alias("slices"))
    known = written(known, "weights")
    dealt = rows.join(known.drop("weights"), ["key", "version"]).withColumn("slice", F.pmod(F.xxhash64("seq"), F.col("slices")).cast("int")).drop("slices")
    models = known.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")
    model, names = create(code, size), [c for c in dealt.columns if c not in ("x", "slice", "version")]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return left.select(names).append_column("score", pa.array([], pa.float64()))
        raw = right.column("weights")[0].as_py()
        w = np.frombuffer(raw) if raw is not None else model.start()
        return left.select(names).append_column("score", pa.array(model.predict(w, matrix(left.column("x").combine_chunks(), size)), pa.float64()))

    kind = ", ".join(f"`{c}` {t}" for c, t in dealt.dtypes if c in names)
    by = ["key", "version", "slice"]
    return dealt.groupBy(*by).cogroup(models.groupBy(*by)).applyInArrow(run, f"{kind}, score double")
