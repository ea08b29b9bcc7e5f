"""Findings of round 4 on time and disk."""

import random

import numpy as np
from conftest import SF
from pyspark.sql import functions as F
from test_pit import alerts_of, at

from pitframe import fixtures as fx
from pitframe.operators import metrics, pit, walkforward
from pitframe.streaming import jobs


def _windows(seed, scale=1.0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(5, 252, 4)) * np.array([0.08, 0.05, 0.2, 0.7]) * scale + np.array([0, 0, 1.3, 0])
    y = (rng.random((5, 252)) < 1 / (1 + np.exp(-x[:, :, 3] + 3 * x[:, :, 0]))).astype(float)
    return x, y


def test_long_descents_take_errors_at_few_epochs(monkeypatch):
    x, y = _windows(3)
    sets = [[0, 1, 2, 3], [2, 3], [0]]
    slow = []
    of = walkforward._descend
    monkeypatch.setattr(walkforward, "_descend", lambda x, *a: slow.append(len(x)) or of(x, *a))
    w, b = walkforward.fit_sets(x, y, sets)
    assert not slow
    for k, s in enumerate(sets):
        want, base = walkforward.fit_windows(x[:, :, s], y)
        assert np.allclose(w[k], want, rtol=0, atol=1e-13) and np.allclose(b[k], base, rtol=0, atol=1e-13)
        alone, c = walkforward.fit_sets(x[2:3], y[2:3], [s])
        assert (alone[0] == w[k][2:3]).all() and (c[0] == b[k][2:3]).all()


def test_windows_that_are_not_certain_go_epoch_by_epoch(monkeypatch):
    x, y = _windows(4)
    x[1] *= 6  # eigenvalues beyond the table
    x[3, 7, 2] = np.inf
    slow = []
    of = walkforward._descend
    monkeypatch.setattr(walkforward, "_descend", lambda x, *a: slow.append(len(x)) or of(x, *a))
    with np.errstate(all="ignore"):
        w, b = walkforward.fit_sets(x, y, [[0, 1, 2, 3]])
        want, base = walkforward.fit_windows(x, y)
    ok = [0, 1, 2, 4]
    assert slow == [2]
    assert np.allclose(w[0][ok], want[ok], rtol=1e-12, atol=1e-12) and np.allclose(b[0][ok], base[ok], rtol=1e-12, atol=1e-12)


def test_alerts_keep_the_state_of_many_symbols_in_a_few_buckets(spark, tmp_path):
    rng = random.Random(6)
    rows = [(f"s{rng.randrange(300)}", at(rng.randrange(0, 300), rng.randrange(24)), n, rng.choice(["BUY", "HOLD", "SELL"])) for n in range(1500)]
    rows.sort(key=lambda r: (r[1], r[2]))
    schema = "symbol string, decision_time timestamp, record_id long, action string"
    for k in range(3):
        spark.createDataFrame(rows[500 * k : 500 * k + 500], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    found = jobs.finished(jobs.action_alerts(feed, idle_days=20, buckets=8), "alerts", f"{tmp_path}/out", f"{tmp_path}/state")
    assert sorted(((r["symbol"], r["record_id"], r["action"], r["previous"], r["changes"]) for r in found.collect()), key=str) == alerts_of(rows, 20)
    kept = spark.read.format("statestore").load(f"{tmp_path}/state")
    assert 0 < kept.count() <= 8


def test_only_decisions_before_news_gather_common_days(spark, monkeypatch):
    late, index = fx.late_bars(spark, SF), fx.index_bars(spark, SF)
    asked = []
    of = pit.newest_seen
    monkeypatch.setattr(pit, "newest_seen", lambda days, keep: asked.append(days) or of(days, keep))
    monkeypatch.setattr(pit, "stored", lambda df, name: df.localCheckpoint())
    rows = lambda df: sorted(map(tuple, df.collect()))
    got = rows(pit.index_context(late)), rows(pit.relative_context(late, index))
    for days in asked:
        assert 0 < days.filter("asks").count() < 0.3 * days.count()
    monkeypatch.setattr(pit, "_asking", lambda d, of=pit._asking: of(d).withColumn("asks", F.col("before") == 20))
    whole = rows(pit.index_context(late)), rows(pit.relative_context(late, index))  # all gathered
    assert got == whole and all(got)


def test_ranks_deal_rows_once_a_column(spark, monkeypatch):
    written = []
    of = metrics.stored
    monkeypatch.setattr(metrics, "stored", lambda df, name: written.append(df) or of(df, name))
    rng = random.Random(2)
    rows = [(rng.choice([None, 0.5, rng.random()]), rng.randrange(5) / 4, n) for n in range(400)]
    got = metrics.ranks(spark.createDataFrame(rows, "a double, b double, n long"), ["a", "b"], ["n"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert len(written) == 2 and "rangepartitioning" not in plan and "hashpartitioning(n" not in plan and plan.count("Window") <= 2  # windows over one row a range
    for c in ("a", "b"):
        want = {r[2]: i + 1 for i, r in enumerate(sorted(rows, key=lambda r: (r["ab".index(c)] is not None, r["ab".index(c)] or 0.0, r[2])))}
        assert {r["n"]: r[f"r_{c}"] for r in got.collect()} == want
    sent = [x._jdf.queryExecution().optimizedPlan().toString() for x in written]
    assert all("row_number" not in p for p in sent)
