"""Panes, densities and order over ranges on small tables with ties, nulls and hot values."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from flowmill.operators import drift, order, stats, windows


def test_density_against_direct_sums(spark):
    rng = np.random.default_rng(4)
    values = np.concatenate([rng.normal(0, 1, 300), rng.normal(6, 2, 200)])
    rows = [("a", float(v)) for v in values] + [("one", 2.0)] * 3 + [("none", None), ("a", None)]
    found = {(r.key, r.point): (r.x, r.density) for r in stats.kernel_density(spark.createDataFrame(rows, "key string, v double"), "v", 0.7, 400, ("key",)).collect()}
    assert {k for k, _ in found} == {"a", "one"} and found["one", 0] == (2.0, pytest.approx(1 / (0.7 * math.sqrt(2 * math.pi))))
    for p in range(400):
        x, density = found["a", p]
        assert density == pytest.approx(np.exp(-(((x - values) / 0.7) ** 2) / 2).sum() / (500 * 0.7 * math.sqrt(2 * math.pi)), abs=2e-4)


def test_sliding_drift_against_whole_windows(spark):
    rng = random.Random(6)
    rows = [(t, rng.choice([None, 1.0, 2.0, 2.0, rng.gauss(t / 500, 1)])) for t in sorted(rng.choice([0, 100, 250, rng.randint(0, 1500)]) for _ in range(300))]
    reference = [r for r in rows if r[0] < 400]
    df = spark.createDataFrame(rows, "us long, v double")
    found = {r.end: r for r in windows.sliding_drift(df, "us", 300, 50, "v", df.filter("us < 400"), 12).collect()}
    ends = list(range(rows[0][0] + 300, rows[-1][0] + 1, 50))
    assert sorted(found) == ends
    ref = np.array(sorted(v for _, v in reference if v is not None))
    for end in ends:
        own = [v for t, v in rows if end - 300 <= t <= end]
        r, have = found[end], np.array(sorted(v for v in own if v is not None))
        assert r.n == len(own)
        if len(own) < 12 or not len(have):
            assert (r.ks, r.wasserstein, r.mean_shift) == (None, None, None)
            continue
        v = np.unique(np.concatenate([ref, have]))
        gap = np.abs(np.searchsorted(have, v, "right") / len(have) - np.searchsorted(ref, v, "right") / len(ref))
        assert (r.ks, r.wasserstein, r.mean_shift) == (pytest.approx(gap.max(), abs=1e-6), pytest.approx((gap[:-1] * np.diff(v)).sum(), abs=1e-6), pytest.approx(have.mean() - ref.mean(), abs=1e-6))
    with pytest.raises(ValueError):
        windows.sliding_drift(df, "us", 300, 70, "v", df, 1)


def test_order_over_ranges(spark):
    """One value has most rows; ranges are small, so it is spread over several of them."""
    rng = random.Random(7)
    rows = [(rng.choice(["hot", "hot", "hot", None, "a"]), rng.choice([5, 5, 5, None, rng.randint(0, 9)]), i) for i in range(500)]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "file string, t int, seq int").repartition(3)
        assert order.sorted_ranges(df, ["file", "t", "seq"]).select("_part").distinct().count() > 3
        ordered = sorted(rows, key=lambda r: ((r[0] is not None, r[0] or ""), (r[1] is not None, r[1] or 0), r[2]))
        got = {r.seq: r.rn for r in order.global_row_number(df, ["file", "t", "seq"]).collect()}
        assert got == {r[2]: i + 1 for i, r in enumerate(ordered)}
        behind = {r.seq: (r.a, r.b) for r in order.with_previous(df, ["file", "t", "seq"], {"a": "seq", "b": "file"}).collect()}
        assert behind == {r[2]: (ordered[i - 1][2], ordered[i - 1][0]) if i else (None, None) for i, r in enumerate(ordered)}
        runs = {r.seq: r.run for r in order.segments(df, ["file", "t", "seq"], {"b": "t"}, ~F.equal_null("t", "b"), "run").collect()}
        number, wanted = 0, {}
        for i, r in enumerate(ordered):
            number += i == 0 or r[1] != ordered[i - 1][1]
            wanted[r[2]] = number
        # the first row has no row before it, so a null there starts nothing
        shift = 1 - runs[ordered[0][2]]
        assert {k: v + shift for k, v in runs.items()} == wanted
        late = {(r.seq, r.in_file) for r in windows.order_violations(df, "file", "seq", "t").collect()}
        timed, own, every = [], {}, None
        for f, t, s in sorted((r for r in rows if r[1] is not None), key=lambda r: ((r[0] is not None, r[0] or ""), r[2])):
            if every is not None and t < every:
                timed.append((s, f in own and t < own[f]))
            own[f], every = t, t
        assert late == set(timed)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.1"])
def test_recall_of_the_inverted_index(spark, folder):
    top = lambda name: {(r.vec_id, r.neighbour) for r in entry.queries()[name](spark, f"/root/testdata/{folder}").collect()}
    exact, found = top("knn_l2_all"), top("knn_ivf")
    assert len(exact & found) >= 0.9 * len(exact)


def test_every_row_is_indexed(spark, monkeypatch):
    monkeypatch.setattr(drift, "BLOCK", 16)
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(60, 3)), np.repeat([[9.0, 9.0, 9.0]], 200, axis=0)])  # one hot cell of equal rows
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "vec_id long, embedding array<double>").repartition(3)
    centres = drift.inverted_index(df, 7, sample=50)
    packed = drift.in_cells_of(df, centres, 1, "vec_id", "embedding").collect()
    assert sorted(i for r in packed for i in r.ids) == list(range(260)) and len(packed) > 14
    whole = {(r.vec_id, r["rank"]): r.neighbour for r in drift.approximate_nearest(df.filter("vec_id < 60"), df, centres, 4, len(centres), itself=False).collect()}
    far = ((x[:60, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(far, np.inf)
    assert whole == {(i, k + 1): int(j) for i in range(60) for k, j in enumerate(np.argsort(far[i], kind="stable")[:4])}  # all cells searched: exact
    assert drift.approximate_nearest(df.filter("vec_id < 0"), df, centres, 4, 2).count() == 0


def test_odd_vectors(spark):
    df = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    good = df([(1, [0.0, 1.0]), (2, [1.0, None]), (3, None), (4, [0.0, 2.0])])
    assert {(r.vec_id, r.neighbour) for r in drift.nearest(good, good, 3, itself=False).collect()} == {(1, 4), (4, 1)}
    for a, b in ((good, df([(9, [1.0])])), (df([(1, [1.0]), (2, [1.0, 2.0])]), good)):
        with pytest.raises(Exception, match="differ in length"):
            drift.nearest(a.coalesce(1), b, 1).collect()
    assert drift.nearest(df([]), good, 3).collect() == []


def windows_of(seed, metric):
    """Pairs of windows with equal rows, rows without a direction, infinities and, in one, a row that is no number."""
    rng, out = np.random.default_rng(seed), {}
    for name, odd in (("plain", False), ("infinite", np.inf), ("unknown", np.nan), ("few", False)):
        a, b = rng.normal(size=(90, 2)), rng.normal(size=(4 if name == "few" else 260, 2))
        a[:40], b[: len(b) // 2] = np.round(a[:40]), np.round(b[: len(b) // 2])
        if odd:
            b[3, 1] = odd
            a[-1, 0] = odd if metric == "l2" else 1.0
        out[name] = (a, b)
    return out


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("held", [4_000_000, 100])
def test_scores_of_windows_equal_brute_force(spark, monkeypatch, metric, held):
    """With few values a task, current rows are dealt and past rows come in pieces."""
    monkeypatch.setattr(drift, "HELD", held)
    wanted, rows = {}, []
    for name, (a, b) in windows_of(5, metric).items():
        with np.errstate(all="ignore"):
            best = np.sort(drift.distances(a, b, metric), axis=1)[:, :5].mean()
        wanted[name] = best if metric == "l2" else -best
        rows += [(name, i, i < len(a), [float(x) for x in v]) for i, v in enumerate(np.concatenate([a, b]))]
    df = spark.createDataFrame(rows, "w string, number long, is_current boolean, v array<double>").repartition(5)
    found = {r.w: (r.score, r.detected) for r in drift.scores_of_windows(df, ["w"], 2, 5, 0.01, metric).collect()}
    assert set(found) == {"plain", "infinite", "unknown"}
    for name, (score, detected) in found.items():
        assert score == pytest.approx(wanted[name], nan_ok=True)
        assert detected == (not np.isnan(score) and (score > 0.01 if metric == "l2" else score < 0.01))


def test_current_rows_meet_few_past_rows():
    rng = np.random.default_rng(2)
    a, b = rng.random((4000, 2)), rng.random((12000, 2))
    near, met = drift.Nearest(a, 8, "l2"), []
    scores = near.scores
    near.scores = lambda x, y: met.append(len(x) * len(y)) or scores(x, y)
    near.add(b)
    far = np.concatenate([np.sort(drift.distances(a[i : i + 500], b, "l2"), axis=1)[:, :8] for i in range(0, 4000, 500)])
    assert near.total() == pytest.approx(far.sum()) and sum(met) < len(a) * len(b) / 10
