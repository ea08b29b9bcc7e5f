"""Calibration fits against plain restatements, and rule columns at their edges."""

import datetime as dt
import math

import numpy as np

from pitframe.operators import calibrate, signals


def rows(n=400, seed=3):
    r = np.random.default_rng(seed)
    p = np.round(r.uniform(0.02, 0.98, n), 2)
    y = (r.uniform(size=n) < p**1.5).astype(int)
    return [(f"s{i % 7}", float(a), int(b)) for i, (a, b) in enumerate(zip(p, y))]


def test_line_solves_its_equations(spark):
    data = rows()
    a, b = calibrate.logistic_line(spark.createDataFrame(data, "symbol string, p double, y int"))
    x = np.log([d[1] / (1 - d[1]) for d in data])
    off = np.array([d[2] for d in data]) - 1 / (1 + np.exp(-(a + b * x)))
    assert abs(off.sum()) < 1e-6 and abs((off * x).sum()) < 1e-6


def test_line_without_a_unique_fit(spark):
    df = spark.createDataFrame([("a", 0.5, 1), ("a", 0.5, 0)], "symbol string, p double, y int")
    assert all(math.isnan(v) for v in calibrate.logistic_line(df))
    assert all(math.isnan(v) for v in calibrate.logistic_line(df.limit(0)))


def test_isotonic_equals_pooling(spark):
    data = rows()
    df = spark.createDataFrame(data, "symbol string, p double, y int")
    got = {r["p"]: r["isotonic"] for r in calibrate.isotonic(df, calibrate.isotonic_steps(df)).collect()}
    at = sorted({d[1] for d in data})
    # max-min form of the least-squares rising fit
    tot = {v: (sum(d[2] for d in data if d[1] == v), sum(d[1] == v for d in data)) for v in at}
    s, w = np.cumsum([0] + [tot[v][0] for v in at]), np.cumsum([0] + [tot[v][1] for v in at])
    for k, v in enumerate(at):
        want = max(min((s[j + 1] - s[i]) / (w[j + 1] - w[i]) for j in range(k, len(at))) for i in range(k + 1))
        assert abs(got[v] - want) < 1e-9


def test_bootstrap_reruns_agree_and_hold_the_mean(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows(), "symbol string, p double, y int")
    one, two = (calibrate.bootstrap_delta(df, F.col("p") - F.col("y"), 200).collect() for _ in range(2))
    assert one == two and one[0]["q025"] < one[0]["delta"] < one[0]["q975"] and one[0]["symbols"] == 7


def test_short_histories_have_no_averages(spark):
    d = [("a", dt.date(2020, 1, 1) + dt.timedelta(days=i), 100.0 + i, 101.0 + i, 5.0) for i in range(6)]
    df = spark.createDataFrame(d, "symbol string, trade_date date, final double, high double, volume double")
    m = signals.moving(df)
    out = signals.trend_stock(signals.volume_regime(signals.trend_verdict(signals.bias_risk(m)))).orderBy("trade_date").collect()
    assert [r["ma5"] for r in out] == [None] * 4 + [102.0, 103.0] and all(r["ma60"] is None for r in out)
    assert {r["verdict"] for r in out} == {"NO_DATA"} and {r["volume_tier"] for r in out} == {"UNKNOWN"} and not any(r["is_trend"] for r in out)
    assert out[0]["risk"] == "UNKNOWN" and out[5]["risk"] == "NORMAL"
