"""Replay sessions against a plain loop over their rows: one clock, drift windows, chains of models, streams and restarts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowmill.operators import drift, models
from flowmill.streaming import fitting, replay

KIND = "key string, seq long, t double, label int, x double, y double"
FEATURES = ["x", "y"]


def session(seed, n=240, keys=("a", "b", "hot")):
    """Rows with gaps, ties, shifting values and one key that has most rows."""
    rng, rows, t = random.Random(seed), [], 1000.0
    for i in range(n):
        t += rng.choice([0, 1, 3, 3, 8]) if rng.random() > 0.02 else 150
        key = "hot" if rng.random() < 0.6 else rng.choice(keys)
        shift = 3.0 * ((i // 60) % 2)
        x, y = rng.gauss(shift, 1), rng.gauss(0, 1)
        rows.append((key, i, t, int(x + y > 1), x, y))
    return rows


def loop(rows, s):
    """The reference order of effects, row by row: predict, then retrain on what came before, then keep the row."""
    fresh = lambda: models.Adam(models.create(s.code, 2).start())
    model, out = models.create(s.code, 2), {}
    start = min(r[2] for r in rows) if s.start is None else s.start
    rows = sorted((r for r in rows if r[2] >= start), key=lambda r: (r[2], r[1]))

    def fit(adam, own):
        if not own:
            return
        x, y, seq = np.array([r[4:6] for r in own]), np.array([r[3] for r in own], float), np.array([r[1] for r in own])
        for epoch in range(s.epochs):
            of = fitting.step_of(seq, epoch, s.steps)
            for step in range(s.steps):
                at = of == step
                if at.any():
                    adam.step(model.gradient(adam.weights, x[at], y[at])[1] / at.sum(), s.rate)

    if s.mode == "st":
        weights, held, due = {}, {}, start + s.interval
        for r in rows:
            score = float(model.predict(weights.setdefault(r[0], fresh()).weights, np.array([r[4:6]]))[0])
            fired = r[2] > due
            if fired:
                for key, own in held.items():
                    fit(weights[key], own)
                held, due = {}, due + s.interval
            held.setdefault(r[0], []).append(r)
            out[r[1]] = (score, int(score >= 0.5), fired)
        return out
    state = {}
    for r in rows:
        seen, adams, due = state.setdefault(r[0], ([], [fresh() for _ in s.windows], [start + s.wait]))
        scores = [float(model.predict(a.weights, np.array([r[4:6]]))[0]) for a in adams]
        hit = False
        if r[2] > due[0]:
            now = seen[-1][2] if seen else r[2]
            for a, w in zip(adams, s.windows, strict=True):
                cw = [q for q in seen if q[2] >= now - w.current]
                pw = [q for q in seen if now - w.current - w.past <= q[2] < now - w.current]
                if min(len(cw), len(pw)) >= w.k:
                    c, p = (np.array([q[4:6] for q in side]) for side in (cw, pw))
                    for j, f in enumerate(FEATURES):
                        if f in s.scaling:
                            c[:, j], p[:, j] = (replay.NUMPY_SCALES[s.scaling[f]](v[:, j]) for v in (c, p))
                    best = np.sort(drift.distances(c, p, w.metric), axis=1)[:, : w.k].mean()
                    if (best > w.theta) if w.metric == "l2" else (-best < w.theta):
                        fit(a, cw)
                        hit = True
            due[0] += s.interval
        seen.append(r)
        binary = [int(v >= 0.5) for v in scores]
        out[r[1]] = (scores[0], binary[0] if s.ensemble == 0 else int(sum(binary) > len(binary) / 2), hit)
    return out


def same(found, wanted):
    assert {r.seq for r in found} == set(wanted)
    for r in found:
        score, vote, retrained = wanted[r.seq]
        assert r.score == pytest.approx(score, rel=1e-7, abs=1e-9) and (r.vote, r.retrained) == (vote, retrained), r


@pytest.mark.parametrize(("seed", "code", "rows_a_task", "steps"), [(1, 4, 1000, 1), (2, 4, 12, 2), (3, 3, 1000, 2), (4, 0, 14, 1)])
def test_static_replay_equals_a_loop(spark, monkeypatch, seed, code, rows_a_task, steps):
    """With few rows a task, the hot key's rounds are trained by jobs over the cluster."""
    monkeypatch.setattr(fitting, "TASK_ROWS", rows_a_task)
    monkeypatch.setattr(fitting, "SLICE", 7)
    rows = session(seed)
    given = {"code": code, "interval": 60.0, "epochs": 2, "rate": 0.05, "steps": steps}
    wanted = loop(rows, replay.settings("st", dict(given)))
    table = spark.createDataFrame(rows, KIND).repartition(5)
    found, log = replay.run_session(table, FEATURES, replay.settings("st", dict(given)))
    same(found.collect(), wanted)
    told = log.collect()
    assert len(told) > 4 and all(r.n == r.benign + r.malicious for r in told) and len({r.at_us for r in told}) > 2
    assert any(v[2] for v in wanted.values())


WINDOWS = (replay.Windows(40.0, 90.0, 3, 2.0), replay.Windows(20.0, 60.0, 2, 0.4, "cosine"), replay.Windows(30.0, 30.0, 4, 3.0))


@pytest.mark.parametrize(("seed", "windows", "ensemble", "scaling"), [(1, WINDOWS[:1], 0, {}), (2, WINDOWS, 1, {"x": "interval"}), (3, WINDOWS[1:2], 0, {"y": "length"})])
def test_dynamic_replay_equals_a_loop(spark, monkeypatch, seed, windows, ensemble, scaling):
    monkeypatch.setattr(drift, "BLOCK", 7)
    rows = session(seed)
    given = {"interval": 15.0, "epochs": 3, "rate": 0.05, "windows": windows, "ensemble": ensemble, "scaling": scaling}
    wanted = loop(rows, replay.settings("dy", dict(given)))
    found = replay.replay(spark.createDataFrame(rows, KIND).repartition(5), FEATURES, "dy", **given).collect()
    same(found, wanted)
    assert sum(r.retrained for r in found) > 2


def test_dynamic_stream_equals_a_loop_after_a_restart(spark, tmp_path):
    rows = session(5)
    start = min(r[2] for r in rows)
    given = {"interval": 15.0, "epochs": 2, "rate": 0.05, "windows": WINDOWS[:2], "ensemble": 1, "start": start}
    wanted = loop(rows, replay.settings("dy", dict(given)))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for part in range(4):  # the query is stopped and started again after each file
            spark.createDataFrame(rows[part * 60 : (part + 1) * 60], KIND).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(KIND).parquet(str(tmp_path / "in"))
            q = replay.replay_stream(stream, FEATURES, "dy", **given).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
            q.awaitTermination()
        same(spark.read.parquet(str(tmp_path / "out")).collect(), wanted)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_empty_and_odd_sessions(spark):
    assert replay.replay(spark.createDataFrame([], KIND), FEATURES, "st").collect() == []
    assert replay.replay(spark.createDataFrame([], KIND), FEATURES, "dy").collect() == []
    rows = [(None, 1, 0.0, 1, 1.0, 2.0), ("k", 2, None, 1, 1.0, 2.0), ("k", 3, 5.0, None, 1.0, None), ("k", 4, 9.0, 0, 1.0, 1.0), ("k", 5, 9.0, 0, 1.0, 1.0)]
    found = {r.seq: (r.key, r.retrained) for r in replay.replay(spark.createDataFrame(rows, KIND).withColumn("extra", F.lit(1)), FEATURES, "st", interval=4.0).collect()}
    assert found == {1: ("", False), 3: ("k", True), 4: ("k", True), 5: ("k", False)}
    with pytest.raises(ValueError, match="mode"):
        replay.settings("xx", {})


@pytest.mark.parametrize("code", [0, 1, 2, 4, 5])
def test_gradients_equal_differences(code):
    rng = np.random.default_rng(code)
    model = models.create(code, 3)
    x, y, w = rng.normal(size=(6, 3)), np.array([0.0, 1, 1, 0, 1, 0]), None
    w = model.start() + rng.normal(0, 0.05, model.length)
    _, gradient = model.gradient(w, x, y)
    for i in rng.choice(model.length, min(25, model.length), replace=False):
        step = np.zeros_like(w)
        step[i] = 1e-6
        slope = (model.gradient(w + step, x, y)[0] - model.gradient(w - step, x, y)[0]) / 2e-6
        assert gradient[i] == pytest.approx(slope, rel=1e-3, abs=1e-6)
    parts = [model.gradient(w, x[a:b], y[a:b]) for a, b in ((0, 2), (2, 6))]
    assert np.allclose(parts[0][1] + parts[1][1], gradient)


def test_registry():
    with pytest.raises(ValueError, match="random forest"):
        models.create(6, 2)
    with pytest.raises(ValueError, match="isn't available"):
        models.create(9, 2)
    hinge = models.create(3, 1)
    assert hinge.gradient(np.array([0.5, 0.0]), np.array([[1.0], [1.0]]), np.array([0.0, 1.0]))[0] == 1.5
