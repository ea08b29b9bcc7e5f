"""Boundary cases on small rows, and models against plain restatements."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from pitframe import plans
from pitframe.operators import factors, infoquality, metrics, portfolio, walkforward

BARS = "symbol string, trade_date date, event_time timestamp_ntz, available_time timestamp_ntz, revision int, open double, high double, low double, close double, volume double, amount double"


def bar(day, close, revision=0, hours=8, symbol="a"):
    d = dt.date(2020, 1, 1) + dt.timedelta(days=day)
    t = dt.datetime(d.year, d.month, d.day)
    return (symbol, d, t + dt.timedelta(hours=7), t + dt.timedelta(hours=hours), revision, close, close + 1, close - 1, close, 10.0 + day, 1.0)


def brute(rows, lookback):
    """Naive as-of reading: for each own day the highest available revision of each day so far."""
    out = {}
    for symbol, day in {(r[0], r[1]) for r in rows}:
        at = dt.datetime(day.year, day.month, day.day) + dt.timedelta(hours=8)
        seen = {}
        for r in sorted((r for r in rows if r[0] == symbol and r[1] <= day and r[3] <= at), key=lambda r: r[4]):
            seen[r[1]] = r[8]
        closes = [seen[d] for d in sorted(seen)]
        if day in seen and len(closes) > lookback:
            out[symbol, day] = closes[-1] / closes[-1 - lookback] - 1
    return out


def test_late_revisions_take_the_exact_path(spark):
    rows = [bar(i, 100.0 + i % 7) for i in range(40)] + [bar(i, 50.0, symbol="b") for i in range(30)]
    rows += [bar(5, 300.0, 1, 10), bar(12, 200.0, 1, 8 + 24 * 6), bar(20, 150.0, 1, 32)]
    got = factors.compute_factors(spark.createDataFrame(rows, BARS), ["momentum", "trend"], 5).filter("momentum is not null").collect()
    want = brute(rows, 5)
    assert {(r["symbol"], r["trade_date"]) for r in got} == set(want)
    assert all(abs(r["momentum"] - want[r["symbol"], r["trade_date"]]) < 1e-8 for r in got)


def test_windowed_factors_equal_those_on_arrays(spark):
    df = spark.createDataFrame([bar(i, 100.0 + (i * 7) % 11) for i in range(40)] + [bar(9, 130.0, 1, 32)], BARS)
    names = list(factors.REGISTRY)
    fast = {r["trade_date"]: r for r in factors.compute_factors(df, names, 5).collect()}
    h = factors.histories(df, 5).filter(F.size("h") > 5)
    for r in h.select("trade_date", *[factors.REGISTRY[n](5).alias(n) for n in names]).collect():
        for n in names:
            assert abs(r[n] - fast[r["trade_date"]][n]) < 2e-6


def test_availability_is_inclusive_and_status_order(spark):
    t = lambda h: dt.datetime(2020, 1, 1, h)
    rows = [(t(1), t(5), False), (t(1), t(6), False), (t(3), t(2), False), (None, t(2), False), (t(1), t(5), True)]
    df = spark.createDataFrame(rows, "e timestamp_ntz, a timestamp_ntz, f boolean")
    got = [r[0] for r in df.select(infoquality.pit_status(F.col("e"), F.col("a"), F.lit(t(5)), F.col("f"))).collect()]
    assert got == ["ADMISSIBLE", "FUTURE", "INVALID_TIME", "MISSING_TIME", "FALLBACK"]


def test_logistic_windows_equal_one_by_one():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(3, 50, 2)), rng.integers(0, 2, (3, 50)).astype(float)
    w, b = walkforward.fit_windows(x, y, epochs=40)
    for k in range(3):
        wk, bk = np.zeros(2), 0.0
        for _ in range(40):
            e = 1 / (1 + np.exp(-(x[k] @ wk + bk))) - y[k]
            wk, bk = wk - 0.05 * x[k].T @ e / 50, bk - 0.05 * e.mean()
        assert np.allclose(wk, w[k]) and np.isclose(bk, b[k])
    assert list(walkforward.window_starts(272)) == [] and list(walkforward.window_starts(293)) == [0, 20]


def test_metrics_edges(spark):
    df = spark.createDataFrame([("v", 1.0, 1, 0.5, 0.1), ("v", 0.05, 0, 0.5, 0.0)], "variant string, p double, y int, baseline_p double, next_return double")
    rel = {r["bin"]: r for r in metrics.reliability(df, 10, "variant").collect()}
    assert len(rel) == 10 and rel[9]["n"] == 1 and rel[0]["n"] == 1 and rel[5]["n"] == 0
    z = metrics.zscore(spark.createDataFrame([("g", 1.0), ("g", 1.0)], "g string, x double"), "x", ["g"])
    assert [r["z"] for r in z.collect()] == [0.0, 0.0]


def test_cap_and_top_k(spark):
    df = spark.createDataFrame([(1, "i", 1), (1, "i", 2), (1, None, 3), (1, None, 4)], "d int, g string, o int")
    assert sorted(r["o"] for r in portfolio.cap_per_group(df, "d", "g", "o", 1).collect()) == [1, 3, 4]
    t = spark.createDataFrame([(1, 0.5, "b"), (1, 0.5, "a"), (1, 0.4, "c")], "d int, p double, s string")
    assert [r["s"] for r in portfolio.top_k(t, "d", "p", "s", 1).collect()] == ["a"]


def test_incremental_models_have_a_full_window(spark, sf):
    rows = {(r["variant"], r["period"]): r["n"] for r in plans.QUERIES["o9_incremental_models"](spark, sf).collect()}
    for v in {v for v, _ in rows}:
        assert rows[v, "full"] == rows.get((v, "discovery"), 0) + rows.get((v, "validation"), 0)


def test_reports_give_the_whole_matrix(spark, sf):
    pairs = lambda name: {(r["a"], r["b"]) for r in plans.QUERIES[name](spark, sf).select("a", "b").distinct().collect()}
    assert len(pairs("l7_pearson_matrix")) == len(pairs("l8_spearman_matrix")) == 6
