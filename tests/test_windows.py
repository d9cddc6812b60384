"""Windows and range sums against plain loops, and plans whose work doesn't grow with what a window holds."""

import random
from fractions import Fraction

import pytest

from flowmill.operators import rangejoin, windows

KIND = "seq long, key string, us long, value double"


def rows_of(seed, n=600):
    """Ties, gaps, negative times, a null key, null values and null times; most rows are the hot key's."""
    rng, rows, t = random.Random(seed), [], -2000
    for i in range(n):
        t += rng.choice([0, 0, 1, 2, 9, 40]) if rng.random() > 0.02 else 700
        value = None if rng.random() < 0.1 else rng.randrange(20000) / 100
        rows.append((i, rng.choice(["hot", "hot", "hot", "a", None]), t if rng.random() > 0.02 else None, value))
    return rows


@pytest.mark.parametrize(("seed", "current", "past"), [(1, 30, 90), (2, 100, 100), (3, 64, 7), (4, 0, 5)])
def test_dual_windows_equal_a_loop(spark, seed, current, past):
    rows = rows_of(seed)
    known = [r for r in rows if r[2] is not None]
    wanted = {}
    for seq, key, us, _ in known:
        own = [r[2] for r in known if r[1] == key]
        wanted[seq] = (sum(us - current <= x <= us for x in own), sum(us - current - past <= x < us - current for x in own))
    counted = windows.dual_window(spark.createDataFrame(rows, KIND).repartition(4), "key", "us", current, past)
    assert {r.seq: (r.cw, r.pw) for r in counted.collect()} == wanted
    first = {k: min(r[2] for r in known if r[1] == k) for k in {r[1] for r in known}}
    warm = {r.seq for r in windows.warm(counted, "key", "us", 500).collect()}
    assert warm == {r[0] for r in known if r[2] >= first[r[1]] + 500} and None in {r[1] for r in known if r[0] in warm}


@pytest.mark.parametrize(("seed", "span"), [(1, 50), (2, 333), (3, 0)])
def test_trailing_means_equal_a_loop(spark, seed, span):
    rows = rows_of(seed)
    known = [r for r in rows if r[2] is not None]
    found = windows.trailing(spark.createDataFrame(rows, KIND).repartition(4), "key", "us", span, "value").collect()
    assert len(found) == len(known)
    for r in found:
        own = [x for x in known if x[1] == r.key and r.us - span <= x[2] <= r.us]
        values = [Fraction(round(x[3] * 100), 100) for x in own if x[3] is not None]
        assert r.n == len(own) and (r.mean is None) == (not values)
        assert not values or abs(r.mean - float(sum(values) / len(values))) <= 5.01e-7


def test_trailing_values_that_are_no_numbers_stay_in_their_windows(spark):
    rows = [(0, "a", 0, 1.0), (1, "a", 5, float("inf")), (2, "a", 11, 3.0), (3, "a", 22, float("nan")), (4, "a", 40, 1e305), (5, "a", 41, 2e305)]
    found = {r.seq: r.mean for r in windows.trailing(spark.createDataFrame(rows, KIND), "key", "us", 10, "value").collect()}
    assert found[0] == 1.0 and found[1] == found[2] == float("inf") and found[3] != found[3] and found[4] == 1e305 and found[5] == pytest.approx(1.5e305)


@pytest.mark.parametrize(("before", "after"), [(30, 30), (100, 7), (0, 1), (-5, 40), (3, -3)])
def test_range_sums_equal_a_loop(spark, before, after):
    rows = rows_of(before + 9)
    left = spark.createDataFrame(rows, KIND).select("seq", "us").repartition(3)
    right = spark.createDataFrame(rows, KIND).filter("key = 'hot'").selectExpr("us as at", "floor(value) as v")
    ticks = [(r[2], int(r[3])) for r in rows if r[1] == "hot" and r[2] is not None and r[3] is not None]
    found = {r.seq: r.cost for r in rangejoin.range_sum(left, right, "seq", "us", "at", "v", before, after).collect()}
    assert found == {r[0]: sum(v for at, v in ticks if r[2] is not None and r[2] - before <= at < r[2] + after) for r in rows}


def test_work_does_not_grow_with_what_a_window_holds(spark):
    """No frame is gone through anew for each row, and no row meets all rows of its span."""
    df = spark.createDataFrame(rows_of(1), KIND)
    plans = [windows.dual_window(df, "key", "us", 30, 90), windows.trailing(df, "key", "us", 30, "value"), rangejoin.range_sum(df.select("seq", "us"), df.selectExpr("us as at", "value"), "seq", "us", "at", "value", 30, 30)]
    for found in plans:
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "RangeFrame" not in plan and ">=" not in plan and "RowFrame, unboundedpreceding$(), " in plan
