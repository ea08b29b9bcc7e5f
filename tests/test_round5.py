"""Findings of round 3 on time: work that only the decisions before late news need, models fitted side by side."""

import numpy as np
from conftest import SF
from pyspark.sql import functions as F

from pitframe import fixtures as fx
from pitframe.operators import factors, pit, walkforward


def test_only_decisions_before_news_gather_days(spark, monkeypatch):
    kept = {}

    def keep(df, name, of=pit.stored):
        kept.setdefault(name, []).append(of(df, name))
        return kept[name][-1]

    monkeypatch.setattr(pit, "stored", keep)
    got = pit.industry_relative(fx.late_bars(spark, SF), fx.membership(spark, SF)).count()
    looked = kept["looked"][0]
    assert len(kept["return-days"]) == len(kept["peer-totals"]) == 1
    sent = looked.filter("size(sent) > 0").select(F.inline("sent")).select("at", "d.day")
    settled = looked.filter("enough").count()
    assert 0 < sent.count() < 10 * got and settled > 0.5 * got


def test_sets_of_features_are_fitted_side_by_side_and_apart_alike():
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=(3, 40, 4)), rng.integers(0, 2, (3, 40)).astype(float)
    sets = [[0, 1, 2, 3], [2], [3, 1]]
    w, b = walkforward.fit_sets(x, y, sets, epochs=30)
    for k, s in enumerate(sets):
        alone, base = walkforward.fit_windows(x[:, :, s], y, epochs=30)
        one, c = walkforward.fit_sets(x, y, [s], epochs=30)
        assert np.allclose(w[k], alone, atol=1e-12) and np.allclose(b[k], base, atol=1e-12)
        assert (w[k] == one[0]).all() and (b[k] == c[0]).all()


def test_late_symbols_gather_only_before_news(spark, monkeypatch):
    asked = []
    of = factors._gathered
    monkeypatch.setattr(factors, "_gathered", lambda days, *a: asked.append(days) or of(days, *a))
    late = fx.late_bars(spark, SF)
    names = ["momentum", "volatility", "close_to_low"]
    got = {(r[0], r[1]): r[2:] for r in factors.compute_factors(late, names, 5).collect()}
    asks, rows = asked[0].filter("asks").count(), asked[0].count()
    assert 0 < asks < 0.3 * rows
    h = factors.histories(late, 5, factors._late_symbols(late))
    whole = h.select("symbol", "trade_date", "close", *[F.when(F.size("h") > 5, factors.rnd(factors.REGISTRY[n](5), 6 if n == "volatility" else 9)) for n in names])
    want = {(r[0], r[1]): r[2:] for r in whole.collect()}
    assert len(want) > asks and all(got[k] == v for k, v in want.items())
