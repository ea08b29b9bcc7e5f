"""Findings of round 3: odd inputs and the shapes of plans at size."""

from pathlib import Path

import duckdb
import pytest
from conftest import SF
from test_oracle import TABLES, plain

from pitframe import plans


def same_as_sql(spark, name, folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    df = plans.QUERIES[name](spark, str(folder))
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    res = con.execute(plans.ORACLE[name])
    names = [d[0] for d in res.description]
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in res.fetchall()), key=str)
    assert got == want and got


def changed(folder: Path, **tables: str) -> Path:
    """The smallest tables with some of them replaced by what a SQL text makes of them."""
    for t in TABLES:
        if t in tables:
            duckdb.sql(tables[t].format(t=f"read_parquet('{SF}/{t}.parquet')")).write_parquet(str(folder / f"{t}.parquet"))
        else:
            (folder / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
    return folder


@pytest.mark.parametrize("name", ["i9_volume_price_signal", "i11_accumulation"])
def test_day_after_a_price_of_zero(spark, tmp_path, name):
    same_as_sql(spark, name, changed(tmp_path, events="select * replace (case when user_id % 3 = 0 and extract(day from ts) % 4 < 2 then 0 else value end as value) from {t}"))


def test_many_small_files_share_a_partition(tmp_path):
    from pitframe.sources import provider

    for i in range(600):
        (tmp_path / f"symbol={i:06d}").mkdir()
        (tmp_path / f"symbol={i:06d}" / "part.txt").write_text('{"a": 1}\n')
    files = provider.files_below(str(tmp_path))
    parts = provider.packed(files)
    assert [p for x in parts for p in x.paths] == [f[0] for f in files] and len(parts) == 200
    assert len(provider.packed(files * 500)) <= provider.PARTS
    assert len(provider.packed(files[:200])) == 200
    assert len(provider.packed([(str(i), "", 0, provider.PART_BYTES) for i in range(3)])) == 3


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]


def test_days_of_bars_are_dealt_once(spark):
    from pitframe import fixtures as fx
    from pitframe.operators import factors as fa
    from pitframe.operators import pit

    assert len(exchanges(fa._days(fx.late_bars(spark, SF)))) == 1
    days = pit.day_revisions(fx.late_bars(spark, SF)).selectExpr("symbol", "trade_date", "cast(trade_date as timestamp_ntz) as dt", "array_min(transform(revs, x -> x.available_time)) as arrival", "revs as item")
    assert len(exchanges(pit.newest_seen(days, 3))) == 1


def test_policies_are_capped_before_rows_multiply(spark):
    from pitframe.operators import policy as po

    rows = [(f"{s:02d}", f"2020-01-{d:02d}", ("a", "b", None)[s % 3], 0.4 + s / 100, 0.4 + s / 90, 0.5, 0.1 * s - 0.5, 0.2 + s / 50) for s in range(12) for d in (1, 2)]
    df = spark.createDataFrame(rows, "symbol string, trade_date string, industry string, p double, p_platt double, p_iso double, expected_return double, risk double")
    got = po.select(df)
    plan = got._jdf.queryExecution().executedPlan().toString().splitlines()
    assert not [x for x in plan if ("Sort [" in x or "Window [" in x) and "policy" in x]  # rows for each policy are not sorted
    held = [r for r in got.filter("policy = 'hold_all' and trade_date = '2020-01-01'").collect()]
    assert sorted(r["symbol"] for r in held) == ["00", "01", "02", "03", "04", "05", "08", "11"]  # two of a and b, all without an industry


def test_whole_quantiles_from_brackets(spark):
    import numpy as np
    from pitframe.operators import metrics as me

    xs = [float(x) for x in np.random.default_rng(4).integers(0, 60, 3000)] + [None] * 7
    df = spark.createDataFrame([(x, None if x is None else x * x / 7) for x in xs], "a double, b double").repartition(3)
    at, real = [0.0, 0.013, 0.25, 0.5, 0.987, 1.0], np.array([x for x in xs if x is not None])
    for accuracy in (4, 20000):  # a coarse sketch misses and is widened
        got = me.whole_quantiles(df, ["a", "b"], at, accuracy)
        assert np.allclose(got["a"], np.quantile(real, at), atol=1e-12) and np.allclose(got["b"], np.quantile(real * real / 7, at), atol=1e-9)
    assert me.whole_quantiles(df.filter("a < 0"), ["a"], at) == {"a": [None] * 6}


def test_draws_meet_sums_without_being_counted(spark):
    from pitframe.operators import resample

    sums = spark.createDataFrame([(s, float(i), i + 1) for i, s in enumerate("abcde")], "symbol string, t double, n int")
    x = resample.drawn(sums, 50)
    assert not [e for e in exchanges(x) if "round" in e]
    assert {r["round"]: r["count"] for r in x.groupBy("round").count().collect()} == {r: 5 for r in range(-1, 50)}
