"""Point-in-time context, boundaries, policies, models and streams: boundary cases and plain restatements."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import BARS, bar

from pitframe.operators import boundary, calibrate, evidence, factors, metrics, models, pit, policy, portfolio, resample, scores, walkforward
from pitframe.sources import bars as sb
from pitframe.streaming import jobs

DAY = dt.date(2020, 1, 1)


def at(day, hours=8):
    return dt.datetime(2020, 1, 1) + dt.timedelta(days=day, hours=hours)


def test_pit_returns_read_what_was_available(spark):
    rows = [bar(i, 100.0 + i) for i in range(6)] + [bar(2, 200.0, 1, 10), bar(3, 300.0, 1, 8 + 48), bar(5, 0.0, 1, 8)]
    got = {r["trade_date"]: [(x["day"], round(x["r"], 9)) for x in r["r"]] for r in pit.pit_returns(spark.createDataFrame(rows, BARS), 2).collect()}
    day = lambda i: DAY + dt.timedelta(days=i)
    assert got[day(2)] == [(day(1), round(101 / 100 - 1, 9)), (day(2), round(102 / 101 - 1, 9))]  # 18:00 comes after the decision
    assert got[day(3)][-1] == (day(3), round(103 / 200 - 1, 9)) and got[day(5)] == [(day(4), round(104 / 300 - 1, 9))]  # the late revision, and a close of 0


def test_scheduled_industry_is_the_min_of_counts(spark):
    members = spark.createDataFrame([("a", "X", DAY, dt.datetime(2020, 1, 2, 8)), ("a", "Y", DAY + dt.timedelta(days=5), dt.datetime(2020, 1, 7, 8))], "symbol string, industry_code string, effective_from date, available_time timestamp_ntz")
    d = spark.createDataFrame([("a", DAY + dt.timedelta(days=i), at(i)) for i in (0, 1, 5, 6)], "symbol string, day date, at timestamp_ntz")
    x = d.join(pit.schedules(members), "symbol").select("day", pit.scheduled_industry(F.col("day"), F.col("at")).alias("now"), pit.historical_industry(F.col("day"), before=True).alias("before")).sort("day").collect()
    assert [(r["now"], r["before"]) for r in x] == [(None, None), ("X", "X"), ("X", "X"), ("Y", "Y")]


def test_industry_with_one_member_has_no_relative(spark):
    rows = [bar(i, 100.0 + i % 3, symbol=s) for i in range(30) for s in ("a", "b", "c")]
    member = lambda s, c: (s, c, dt.date(2019, 1, 1), dt.datetime(2019, 1, 2, 8))
    members = spark.createDataFrame([member("a", "X"), member("b", "X"), member("c", "Z")], "symbol string, industry_code string, effective_from date, available_time timestamp_ntz")
    got = pit.industry_relative(spark.createDataFrame(rows, BARS), members, lookback=20, first_look=22).collect()
    assert {r["symbol"] for r in got} == {"a", "b"} and all(abs(r["industry_relative_20"]) < 1e-6 for r in got)


def test_upsert_takes_the_last_write_and_rejects(spark):
    old = spark.createDataFrame([bar(0, 1.0), bar(1, 2.0)], BARS)
    new = spark.createDataFrame([bar(1, 5.0), bar(1, 6.0, 1)], BARS)
    assert {(r["trade_date"].day, r["revision"]): r["close"] for r in sb.upsert_bars(old, new).collect()} == {(1, 0): 1.0, (2, 0): 5.0, (2, 1): 6.0}
    with pytest.raises(Exception, match="available_time"):
        sb.upsert_bars(old, spark.createDataFrame([bar(1, 5.0, hours=2)], BARS)).collect()


def test_merge_writes_touched_months_only(spark, tmp_path):
    path = str(tmp_path / "bars")
    sb.write_bars(spark.createDataFrame([bar(i, 1.0) for i in (0, 10, 40, 70)], BARS), path)
    files = lambda: {str(p): p.stat().st_mtime_ns for p in (tmp_path / "bars").rglob("*.parquet")}
    before = files()
    new = spark.createDataFrame([bar(40, 5.0), bar(40, 7.0), bar(41, 2.0)], BARS).withColumn("seq", F.when(F.col("close") == 5.0, 2).otherwise(1))
    for _ in range(2):  # a replay changes nothing
        assert sb.merge_bars(spark, path, new, "seq") == ["2020-02"]
        assert {r["trade_date"]: r["close"] for r in sb.read_bars(spark, path).collect()} == {DAY + dt.timedelta(days=i): c for i, c in ((0, 1.0), (10, 1.0), (40, 5.0), (41, 2.0), (70, 1.0))}
    kept = {p: t for p, t in files().items() if "2020-02" not in p}
    assert kept == {p: t for p, t in before.items() if "2020-02" not in p}
    assert sb.merge_bars(spark, path, new.limit(0), "seq") == []
    sb.merge_bars(spark, path, new.drop("seq"))
    assert sb.read_bars(spark, path).filter("month(trade_date) = 2").agg(F.max("close")).first()[0] == 7.0  # equal keys: the larger value


def test_bars_round_trip_by_symbol(spark, tmp_path):
    df = spark.createDataFrame([bar(0, 1.0), bar(40, 2.0), bar(40, 3.0, symbol="b")], BARS)
    sb.write_bars(df, str(tmp_path))
    assert sorted(map(str, sb.read_bars(spark, str(tmp_path)).collect())) == sorted(map(str, df.collect()))
    assert [r["close"] for r in sb.read_bars(spark, str(tmp_path), ["b"]).collect()] == [3.0]


def test_guards_raise(spark):
    df = spark.createDataFrame([bar(0, 1.0)], BARS)
    assert boundary.assert_research_zone(df, "trade_date", "2020-01-02") is df and boundary.assert_not_beyond(df, "trade_date", "2020-01-01") is df
    for guard, day in ((boundary.assert_research_zone, "2020-01-01"), (boundary.assert_not_beyond, "2019-12-31")):
        with pytest.raises(ValueError):
            guard(df, "trade_date", day)


def test_stamp_rules(spark):
    rows = [(None, "2020-01-01T00:00:00Z"), ("2020-01-01T00:00:00", "2020-01-01T00:00:00Z"), ("soon", "2020-01-01T00:00:00Z"), ("2020-01-01T00:00:00+08:00", "2019-12-31T16:00:00Z"), ("2020-01-01T00:00:00Z", "2019-12-31T23:59:59Z")]
    got = [r[0] for r in spark.createDataFrame(rows, "e string, a string").select(sb.stamp_problem(F.col("e"), F.col("a"))).collect()]
    assert got == ["MISSING", "NAIVE", "MALFORMED", None, "BACKWARDS"]


def test_rolling_features_equal_numpy(spark):
    rng = np.random.default_rng(1)
    r = rng.normal(0, 0.02, 90)
    rows = spark.createDataFrame([("a", DAY + dt.timedelta(days=i), float(v)) for i, v in enumerate(r)], "symbol string, trade_date date, next_return double")
    got = {x["trade_date"]: x for x in policy.rolling_features(rows, "2020-02-01").collect()}
    pooled = np.clip(r[:31], *np.quantile(r[:31], [0.01, 0.99]))
    for i in range(90):
        x = got[DAY + dt.timedelta(days=i)]
        past = r[max(0, i - 60) : i]
        own = len(past) >= 10
        w = np.clip(past, *np.quantile(past, [0.01, 0.99])) if own else pooled
        curve = np.cumprod(1 + w)
        low = min(0, (curve / np.maximum.accumulate(np.r_[1.0, curve])[1:] - 1).min()) if own else 0.0
        want = (w[w > 0].mean(), w[w < 0].mean(), w.std(), w[w < 0].std(), low)
        assert np.allclose([x["upside"], x["downside"], x["risk"], x["downside_deviation"], x["max_drawdown"]], want)


def test_caps_ties_and_empty_days(spark):
    rows = [(s, DAY, p, 1, 0.01, p, p, 0.01, 0.1, ind, "BULL") for s, p, ind in (("a", 0.6, "X"), ("b", 0.6, "X"), ("c", 0.6, "X"), ("d", 0.6, None), ("e", 0.6, None), ("f", 0.6, None))]
    df = spark.createDataFrame(rows, "symbol string, trade_date date, p double, y int, next_return double, p_platt double, p_iso double, expected_return double, risk double, industry string, regime string")
    got = {}
    for r in policy.select(df).collect():
        got.setdefault(r["policy"], []).append(r["symbol"])
    assert sorted(got["hold_all"]) == ["a", "b", "d", "e", "f"] and sorted(got["topk_platt_k3"]) == ["a", "b"]
    assert policy.book_turnover(policy.select(df)).filter("turnover <> 0").count() == 0
    assert policy.select(df.limit(0)).count() == 0


def test_turnover_and_bootstrap(spark):
    rows = [("p", s, DAY + dt.timedelta(days=i), 0.01 * i, 1) for i, book in enumerate(("ab", "bc", "cd")) for s in book] + [("hold_all", s, DAY + dt.timedelta(days=i), 0.0, 0) for i in range(3) for s in "abcd"]
    df = spark.createDataFrame(rows, "policy string, symbol string, trade_date date, next_return double, y int")
    assert {r["policy"]: round(r["turnover"], 9) for r in policy.book_turnover(df).collect()} == {"p": 1.0, "hold_all": round(4 / 12, 9)}
    a, b = (policy.policy_bootstrap(df, rounds=20).collect() for _ in range(2))
    assert a == b and a[0]["hit_delta"] == 1.0


def test_bootstraps_equal_brute_force(spark):
    """Both bootstraps against resampled rows, with the operator's own draws."""
    rng = random.Random(9)
    rows = [(p, s, DAY + dt.timedelta(days=d), rng.uniform(-0.05, 0.05), rng.randrange(2)) for p, share in (("hold_all", 1), ("few", 0.15)) for s in "abcdef" for d in range(12) if rng.random() < share]
    df = spark.createDataFrame(rows, "policy string, symbol string, trade_date date, next_return double, y int")
    got = {r["policy"]: r for r in policy.policy_bootstrap(df, rounds=200).collect()}["few"]
    k = {}
    for r in resample.draws(df, rounds=200).collect():
        k.setdefault(r["round"], {})[r["symbol"]] = r["k"]
    assert set(k) == set(range(-1, 200)) and all(sum(x.values()) == 6 for x in k.values())
    deltas = {n: {"hit_delta": [], "coverage_delta": []} for n in ("point", "drawn")}
    for n, weights in k.items():
        few, every = ([r for r in rows if r[0] == p for _ in range(weights.get(r[1], 0))] for p in ("few", "hold_all"))
        to = deltas["point" if n < 0 else "drawn"]
        to["coverage_delta"].append(len(few) / len(every) - 1)
        if few:
            to["hit_delta"].append(np.mean([r[4] for r in few]) - np.mean([r[4] for r in every]))
    for c in ("hit_delta", "coverage_delta"):
        assert abs(got[c] - deltas["point"][c][0]) < 1e-8
        assert np.allclose([got[f"{c}_q025"], got[f"{c}_q975"]], np.quantile(deltas["drawn"][c], [0.025, 0.975]), atol=1e-8)
    x = spark.createDataFrame([(s, rng.randrange(1, 6), rng.uniform(-1, 1), rng.randrange(2)) for s in "abcdef" for _ in range(20)], "symbol string, q int, next_return double, y int")
    got, again = (resample.spread_bootstrap(x, rounds=200).first() for _ in range(2))
    all_rows, spreads = x.collect(), []
    for n in sorted(k):
        mean = lambda q: np.mean([r["next_return"] for r in all_rows if r["q"] == q for _ in range(k[n].get(r["symbol"], 0))])  # noqa: B023, E731
        spreads.append(mean(5) - mean(1))
    assert got == again and np.allclose([got["spread_return"], got["spread_return_q025"], got["spread_return_q975"]], [spreads[0], *np.quantile(spreads[1:], [0.025, 0.975])], atol=1e-8)


def test_forward_fit_equals_numpy_and_row_order(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(60, 2)), rng.integers(0, 2, 60)
    rows = [(float(a), float(b), int(c)) for (a, b), c in zip(x, y)]
    fit = lambda r: models.forward_fit(spark.createDataFrame(r + [(None, 1.0, 1)], "u double, v double, label int"), ["u", "v"], epochs=15)
    one, two = fit(rows), fit(rows[::-1])
    w, b = walkforward.fit_windows(x[None], y[None].astype(float), epochs=15)
    assert np.allclose([one[0], *one[1]], [b[0], *w[0]], atol=1e-9) and np.allclose([one[0], *one[1]], [two[0], *two[1]], atol=1e-12)


def test_walk_forward_fits_variants_of_a_symbol_together(spark):
    rng = np.random.default_rng(6)
    rows = spark.createDataFrame([("a", DAY + dt.timedelta(days=i), float(u), float(v), int(u + v > 0)) for i, (u, v) in enumerate(rng.normal(size=(300, 2)))], "symbol string, trade_date date, u double, v double, label int")
    both = walkforward.walk_forward_oos(rows, {"u": ("u",), "uv": ("u", "v")})
    one = walkforward.walk_forward_oos(rows, {"uv": ("u", "v")}).collect()
    assert both.filter("variant = 'uv'").collect() == one and both.count() == 2 * len(one) > 0


def test_quantiles_by_ranges_are_exact(spark):
    v = [float(i * 37 % 101) for i in range(101)] + [3.0] * 40
    r = metrics.exact_quantiles(spark.createDataFrame([(x,) for x in v], "x double").repartition(5), "x", [0.0, 0.2, 0.5, 0.99, 1.0]).first()
    assert np.allclose(list(r), np.quantile(v, [0.0, 0.2, 0.5, 0.99, 1.0]))


def test_isotonic_steps_are_found_at_their_edges(spark):
    steps = spark.createDataFrame([(float("-inf"), 0.2, 0.1), (0.2, 0.7, 0.4), (0.7, float("inf"), 0.9)], "lo double, hi double, value double")
    got = [r["isotonic"] for r in calibrate.isotonic(spark.createDataFrame([(p,) for p in (0.0, 0.2, 0.69, 0.7, 1.0)], "p double"), steps).sort("p").collect()]
    assert got == [0.1, 0.4, 0.4, 0.9, 0.9]


def test_constant_references_do_not_divide_by_zero(spark):
    df = spark.createDataFrame([(1.0,), (1.0,)], "x double")
    assert metrics.population_stability(df, df, "x").first()["psi"] == 0.0
    flat = spark.createDataFrame([bar(i, 5.0) for i in range(25)], BARS).withColumn("volume", F.lit(0.0))
    assert factors.compute_factors(flat, ["volume_ratio", "range_ratio"]).filter("volume_ratio is not null").count() == 0


def test_decorrelation_and_clusters(spark):
    df = spark.createDataFrame([(float(i), float(2 * i), float(i * i % 7)) for i in range(30)], "a double, b double, c double")
    assert metrics.decorrelate(df, ["a", "b", "c"]) == ["a", "c"] and metrics.decorrelate(df, ["b", "a"]) == ["b"]
    assert [r["members"] for r in metrics.correlation_clusters(df, ["a", "b", "c"]).collect()] == [["a", "b"], ["c"]]


def test_reverse_trace_and_empty_protection(spark):
    old = spark.createDataFrame([("a", "x", DAY, "by hand")], "ticker string, event_type string, event_date date, note string")
    assert not evidence.may_overwrite(old, old.limit(0)) and evidence.may_overwrite(old, old) and evidence.may_overwrite(old, old.limit(0), force=True)


def test_append_is_idempotent(spark):
    rows = spark.createDataFrame([(1, "r", "a"), (2, None, "b"), (2, None, "b")], "record_id long, run_id string, symbol string")
    first = portfolio.append_outcomes(rows.limit(0), rows)
    assert sorted(r["outcome"] for r in first.collect()) == ["already_exists", "created", "created"]
    assert {r["outcome"] for r in portfolio.append_outcomes(rows, rows).collect()} == {"already_exists"}


def test_streams_over_several_batches(spark):
    keys = spark.createDataFrame([(i % 7, i, str(i // 7 % 2)) for i in range(30)], "k long, seq long, hash string").withColumn("ts", F.timestamp_seconds(F.col("seq") * 3600))
    out = jobs.finished(jobs.ingest_attempts(jobs.table_stream(keys, "keys", 6, "seq"), ["k"], "hash", ["seq"]), "ingest")
    want = {i: "ACCEPTED" if i < 7 else "DUPLICATE" if i // 7 % 2 == 0 else "RAW_MUTATION_DETECTED" for i in range(30)}
    assert {r["seq"]: r["outcome"] for r in out.collect()} == want  # mutations in later batches are found
    assert jobs.finished(jobs.ledger_appends(jobs.table_stream(keys, "again", 6, "seq"), ["k"], "ts", "30 days"), "ledger").count() == 7


def alerts_of(rows, idle_days):
    want, last = [], {}
    for s, day, n, a in sorted(rows, key=lambda r: (r[1], r[2])):
        action, changes, at_ = last.get(s, (None, 0, None))
        if at_ is not None and (day - at_).total_seconds() > idle_days * 86400:
            action, changes = None, 0
        if action != a:
            changes += 1
            want.append((s, n, a, action, changes))
        last[s] = (a, changes, day)
    return sorted(want, key=str)


def test_alerts_go_on_from_their_checkpoint(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.choice("abcde"), at(rng.randrange(0, 400), rng.randrange(24)), n, rng.choice(["BUY", "HOLD", "SELL"])) for n in range(200)]
    rows.sort(key=lambda r: (r[1], r[2]))
    schema = "symbol string, decision_time timestamp, record_id long, action string"
    feed = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for k in range(4):  # two files, a run, two more, another run: as one run over all
        spark.createDataFrame(rows[50 * k : 50 * k + 50], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if k % 2:
            found = jobs.finished(jobs.action_alerts(feed(), idle_days=20), "alerts", f"{tmp_path}/out", f"{tmp_path}/state")
    got = sorted(((r["symbol"], r["record_id"], r["action"], r["previous"], r["changes"]) for r in found.collect()), key=str)
    assert got == alerts_of(rows, 20) and any(r[4] == 1 and r[1] > 20 for r in got)
    again = jobs.finished(jobs.action_alerts(feed(), idle_days=20), "alerts", f"{tmp_path}/out", f"{tmp_path}/state")
    assert again.count() == len(got)


def test_windows_close_once_and_late_rows_stay_out(spark):
    schema = "symbol string, ts timestamp, price double, hands long, side string, event_id long, batch int"
    rows = [("a", at(0, 1), 1.0, 5, "B", 1, 0), ("a", at(0, 5), 2.0, 5, "S", 2, 1), ("a", at(0, 6), 2.0, 5, "S", 3, 2), ("a", at(0, 1), 9.0, 7, "S", 4, 3), ("a", at(0, 5), 3.0, 1, "S", 5, 3), ("a", at(0, 9), 2.0, 5, "S", 6, 4)]
    found = jobs.finished(jobs.minute_bars(jobs.replay(spark.createDataFrame(rows, schema), "batch", "closing"), 60), "closing-bars")
    assert sorted((r["start"].hour, r["close"], r["volume"], r["n"]) for r in found.collect()) == [(1, 1.0, 5, 1), (5, 3.0, 6, 2), (6, 2.0, 5, 1)]


def test_windows_over_batches_and_late_rows(spark):
    schema = "symbol string, ts timestamp, price double, hands long, side string, event_id long"
    ticks = spark.createDataFrame([("a", at(0, 1), 1.0, 5, "B", 1), ("a", at(0, 2), 2.0, 5, "S", 2), ("a", at(0, 1), 3.0, 7, "S", 3)], schema)
    bars = jobs.latest(jobs.minute_bars(jobs.table_stream(ticks, "ticks", 3, "event_id"), 60), ["symbol", "start"], "bars")
    assert sorted((r["open"], r["close"], r["volume"]) for r in bars.collect()) == [(1.0, 3.0, 12), (2.0, 2.0, 5)]
    rows = [("a", at(9, i), 1.0, 1, "B", i) for i in range(5)] + [("a", at(0, 1), 1.0, 9, "B", 6), ("a", at(9, 6), 1.0, 1, "B", 7)]
    late = jobs.latest(jobs.minute_bars(jobs.table_stream(spark.createDataFrame(rows, schema), "late", 7, "event_id"), 60, late="1 hour"), ["symbol", "start"], "late-bars")
    assert late.filter(F.col("start") < at(5, 0)).count() == 0 and late.count() == 6  # beyond the watermark


def test_rule_edges(spark):
    f = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert f(scores.vwap_verdict(F.lit(10.0), F.lit(10.0))) == "AT" and f(scores.lexicon_score(F.lit("good good good bad"), ["good"], ["bad"])) == 1
    assert f(scores.sell_rule(F.lit(9.0), F.lit(9.0), F.lit(False), F.lit(False))) == "MUST_SELL" and f(scores.sell_rule(F.lit(9.0), F.lit(None).cast("double"), F.lit(False), F.lit(False))) == "NO_CARD"
    assert f(policy.decision_class(F.lit(0.9), F.lit(0.6), F.lit(True), F.lit(True))) == "PAPER_TEST" and f(policy.decision_class(F.lit(0.74), F.lit(0.9), F.lit(True), F.lit(True))) == "NO_ACTION"


def test_look_back_has_no_end(spark):
    """Forty days in a row that decisions cannot use: the newest usable ones are found before them."""
    hole = range(25, 65)
    late = {i: 24 * 200 for i in hole}
    rows = [bar(i, 100.0 + (i * 7) % 11, symbol="a", hours=late.get(i, 8)) for i in range(90)]
    df = spark.createDataFrame(rows, BARS)
    close = {DAY + dt.timedelta(days=i): 100.0 + (i * 7) % 11 for i in range(90)}
    got = {r["trade_date"]: r for r in pit.index_context(df).collect()}
    usable = [DAY + dt.timedelta(days=i) for i in range(90) if i not in hole]
    assert set(got) == set(usable[20:])
    for k, day in enumerate(usable[20:], 20):
        assert abs(got[day]["return_20"] - (close[day] / close[usable[k - 20]] - 1)) < 1e-8 and abs(got[day]["return_5"] - (close[day] / close[usable[k - 5]] - 1)) < 1e-8
    index = spark.createDataFrame([bar(i, 50.0 + i % 3, symbol="i") for i in range(90)], BARS)
    relative = {r["trade_date"]: r["relative_20"] for r in pit.relative_context(df, index).collect()}
    assert set(relative) == set(usable[20:])


def test_days_that_arrive_out_of_order_are_ranked_by_day(spark):
    rng = random.Random(5)
    rows, n = [], 80
    for i in range(n):
        for rev in range(rng.choice([1, 1, 2])):
            rows.append(bar(i, rng.choice([0.0, 90.0, 101.0, 110.0]) if rng.random() < 0.02 else 90.0 + rng.randrange(20), rev, symbol="a", hours=8 + rng.choice([0, 0, 0, 1, 30, 24 * 9, 24 * 40])))
    got = {r["trade_date"]: r["return_20"] for r in pit.index_context(spark.createDataFrame(rows, BARS)).collect()}
    fields = [f.split()[0] for f in BARS.split(", ")] if isinstance(BARS, str) else BARS.names
    recs = [dict(zip(fields, r)) for r in rows]
    for i in range(n):
        day = DAY + dt.timedelta(days=i)
        now = dt.datetime.combine(day, dt.time(8))
        seen = {}
        for r in recs:
            if r["available_time"] <= now and r["trade_date"] <= day and r["revision"] >= seen.get(r["trade_date"], (-1, 0))[0]:
                seen[r["trade_date"]] = (r["revision"], r["close"])
        closes = [seen[d][1] for d in sorted(seen)][-21:]
        fits = day in seen and len(closes) == 21 and min(closes) > 0
        assert (day in got) == fits and (not fits or abs(got[day] - (closes[-1] / closes[0] - 1)) < 1e-8)


def test_industry_looks_past_days_without_peers(spark):
    """The peers of 40 days come late; returns on both sides of them still make 20."""
    member = lambda s: (s, "X", dt.date(2019, 1, 1), dt.datetime(2019, 1, 2, 8))
    members = spark.createDataFrame([member("a"), member("b"), member("c")], "symbol string, industry_code string, effective_from date, available_time timestamp_ntz")
    hole = range(30, 70)
    rows = [bar(i, 100.0 + (i * s) % 7, symbol=name, hours=24 * 300 if i in hole and name != "a" else 8) for i in range(80) for s, name in ((3, "a"), (5, "b"), (4, "c"))]
    close = {(name, i): 100.0 + (i * s) % 7 for i in range(80) for s, name in ((3, "a"), (5, "b"), (4, "c"))}
    ret = lambda name, i: close[name, i] / close[name, i - 1] - 1
    for first in (30, 200):
        got = {(r["symbol"], r["trade_date"]): r for r in pit.industry_relative(spark.createDataFrame(rows, BARS), members, first_look=first).collect()}
        for i in (29, 75, 79):
            days = [j for j in range(1, i + 1) if j not in hole and j != hole.stop][-20:]
            mine = np.prod([1 + ret("a", j) for j in days])
            peers = np.prod([1 + (ret("b", j) + ret("c", j)) / 2 for j in days])
            assert abs(got["a", DAY + dt.timedelta(days=i)]["industry_relative_20"] - (mine - peers)) < 1e-6
