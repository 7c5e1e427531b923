"""Statistics on known vectors."""

import math

import pytest
from pyspark.sql import functions as F

from fleetwatch.operators import stats


def _series(spark, values, closed=True):
    return spark.createDataFrame([("a", i, float(v), closed) for i, v in enumerate(values)],
                                 "agent_id string, day int, cost double, closed boolean")


def _card(spark, values, closed=True, **kw):
    return stats.ewma_card(_series(spark, values, closed), ["agent_id"], "day", "cost",
                           calibrated="closed", **kw).orderBy("day").collect()


def test_ewma_follows_the_recurrence(spark):
    values = [11 + (i * 7 % 5) / 2 for i in range(30)] + [42.0]
    mu = s2 = 0.0
    for i, (r, c) in enumerate(zip(_card(spark, values), values)):
        mu, s2 = (c, 0.0) if i == 0 else (0.15 * c + 0.85 * mu, None)
        if i:
            s2 = 0.10 * (c - mu) ** 2 + 0.90 * prev
        prev = s2
        assert r["mu"] == pytest.approx(mu) and r["sigma"] == pytest.approx(math.sqrt(s2))
        assert r["armed"] == (i >= 29)
    assert r["alarm"] and r["z"] == pytest.approx((42 - mu) / math.sqrt(s2))


def test_ewma_never_arms_uncalibrated(spark):
    rows = _card(spark, [12.0] * 40 + [42.0], closed=False)
    assert not any(r["armed"] or r["alarm"] for r in rows)


def test_ewma_warmup_floor_and_single_value(spark):
    assert [r["armed"] for r in _card(spark, [5.0], min_obs=0)] == [False]
    assert [r["armed"] for r in _card(spark, [5.0, 9.0], min_obs=0)] == [False, True]


def _mixes(p, q):
    keys = sorted({**p, **q})
    share = lambda d: [d.get(k, 0) / sum(d.values()) for k in keys]
    return share(p), share(q)


def _jsd(p, q):
    p, q = _mixes(p, q)
    side = lambda a: sum(x * math.log2(2 * x / (x + y)) for x, y in zip(*a) if x)
    return (side((p, q)) + side((q, p))) / 2


MIXES = [({"get": 7, "put": 2}, {"get": 14, "put": 4}), ({"get": 6, "put": 1}, {"put": 5, "del": 2}),
         ({"get": 31, "put": 9, "del": 4}, {"get": 12, "put": 21, "del": 2}), ({"get": 1}, {"put": 1}), ({"get": 0, "put": 3}, {"put": 8})]


@pytest.mark.parametrize("p, q", MIXES)
def test_jsd(spark, p, q):
    rows = [("x", k, p.get(k, 0), q.get(k, 0)) for k in {**p, **q}]
    r = stats.jsd(spark.createDataFrame(rows, "k string, c string, p long, q long"), ["k"], "c", "p", "q").first()
    want = _jsd(p, q)
    assert r["jsd"] == pytest.approx(want, abs=1e-4)  # shares are smoothed a little
    assert r["band"] == ("healthy" if want <= 0.20 else "watch" if want <= 0.40 else "alarm")


@pytest.mark.parametrize("p, q", [({}, {"get": 3}), ({"get": -2}, {"get": 3})])
def test_jsd_without_one_side(spark, p, q):
    rows = [("x", k, p.get(k, 0), q.get(k, 0)) for k in {**p, **q}]
    r = stats.jsd(spark.createDataFrame(rows, "k string, c string, p long, q long"), ["k"], "c", "p", "q").first()
    assert r["band"] == "warming_up" and r["jsd"] is None


def test_psi(spark):
    e, a = {"done": 71, "failed": 22, "open": 7}, {"done": 33, "failed": 51, "open": 16}
    df = spark.createDataFrame([("x", k, e[k], a[k]) for k in e] + [("y", "done", 0, 6), ("z", "done", 5, 5), ("z", "open", 5, 5)],
                               "k string, c string, e long, a long")
    got = {r["k"]: r for r in stats.psi(df, ["k"], "c", "e", "a").collect()}
    p, q = _mixes(e, a)
    assert got["x"]["psi"] == pytest.approx(sum((y - x) * math.log(y / x) for x, y in zip(p, q)), abs=1e-4) and got["x"]["large_shift"]
    assert got["y"]["psi"] is None and not got["y"]["large_shift"]
    assert got["z"]["psi"] == pytest.approx(0) and not got["z"]["large_shift"]


def _middle(values):
    v = sorted(values)
    return (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2


@pytest.mark.parametrize("values, x", [([3, 8, 5, 9, 4, 61], None), ([3, 8, 5, 9, 4], 17.0), ([3, 8, 5, 9, 4], -2.5), ([6, 6, 6, 6], None), ([2, 90], None)])
def test_mad(spark, values, x):
    r = stats.mad_z(_series(spark, values), ["agent_id"], "day", "cost", None if x is None else F.lit(x)).first()
    median = _middle(values)
    mad = _middle([abs(v - median) for v in values])
    if len(values) < 3 or mad == 0:
        assert r["robust_z"] is None and not r["alarm"]
    else:
        z = ((values[-1] if x is None else x) - median) * 0.6745 / mad
        assert r["robust_z"] == pytest.approx(z) and r["alarm"] == (abs(z) > 3)


@pytest.mark.parametrize("values, alarm", [([10.4, 11.9, 13.1, 12.2, 13.6, 14.5], True), ([10.0, 9.8, 10.3] * 9, False)])
def test_cusum(spark, values, alarm):
    rows = stats.cusum(_series(spark, values), ["agent_id"], "day", "cost", F.lit(10.0)).orderBy("day").collect()
    g = 0.0
    for r, v in zip(rows, values):
        g = max(0.0, g + v - 10 - 0.05)
        assert r["g"] == pytest.approx(g, abs=1e-9)
    assert any(r["alarm"] for r in rows) == alarm
