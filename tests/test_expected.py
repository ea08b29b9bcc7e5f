"""Completeness without the product, windows dealt in runs, and the pooled fit in blocks, against plain restatements."""

import datetime as dt
import random

import numpy as np
import pytest

from pitframe.operators import expected, models, walkforward

DAY = dt.date(2020, 1, 1)
PAIR = "entity string, day date"


def contract(spark, rng):
    days = [DAY + dt.timedelta(days=i) for i in range(12)]
    closed = set(rng.sample(days, 3))
    entities = [f"e{i}" for i in range(7)]
    pick = lambda k: [(rng.choice([*entities, "stranger", None]), rng.choice([*days, dt.date(2030, 1, 1), None])) for _ in range(k)]
    seen, absent = pick(50) + [("e0", d) for d in days], pick(12) + [("e6", d) for d in days]
    frames = spark.createDataFrame([(e,) for e in [*entities, "e1", None]], "entity string"), spark.createDataFrame([(d, d in closed) for d in [*days, days[0]]] + [(None, True)], "day date, closed boolean")
    return entities, days, closed, set(seen), set(absent), (*frames, spark.createDataFrame(seen + seen[:9], PAIR), spark.createDataFrame(absent, PAIR))


@pytest.mark.parametrize("seed", [1, 2])
def test_completeness_equals_set_arithmetic(spark, seed):
    entities, days, closed, seen, absent, frames = contract(spark, random.Random(seed))
    every = {(e, d) for e in entities for d in days}
    declared = (absent & every) | {(e, d) for e, d in every if d in closed}
    required = every - declared
    got = expected.completeness(*frames, "entity", "day").first().asDict()
    satisfied = required & seen
    gone = lambda i: len({p[i] for p in required} - {p[i] for p in satisfied})
    outside = {(e, d) for e, d in absent if e is not None and d is not None} - every
    assert got == {
        "pairs": len(every), "required": len(required), "satisfied": len(satisfied), "missing_pairs": len(required - satisfied), "coverage": round(len(satisfied) / len(required), 4),
        "missing_entitys": gone(0), "missing_days": gone(1), "out_of_scope": len(outside),
    }
    status = {(r["entity"], r["day"]): r["status"] for r in expected.classify_pairs(*frames, "entity", "day").collect()}
    assert status == {p: "OBSERVED" if p in seen else "EXPECTED_ABSENCE" if p in declared else "UNEXPECTED_MISSING" for p in every}
    listed = [(r["entity"], r["day"], r["i"], r["reference"]) for r in expected.declared_pairs(frames[0], frames[1], frames[3], "entity", "day").sort("i").collect()]
    assert listed == [(e, d, i, f"absences[{i}]") for i, (e, d) in enumerate(sorted(declared | outside))]


def test_completeness_of_nothing(spark):
    none = spark.createDataFrame([], PAIR)
    days = spark.createDataFrame([], "day date, closed boolean")
    got = expected.completeness(none.select("entity"), days, none, none, "entity", "day").first()
    assert got["pairs"] == got["required"] == got["missing_pairs"] == 0 and got["coverage"] == 1.0
    assert expected.classify_pairs(none.select("entity"), days, none, none, "entity", "day").count() == 0
    assert expected.declared_pairs(none.select("entity"), days, none, "entity", "day").count() == 0


def test_runs_of_windows_give_what_whole_symbols_give(spark):
    rng = np.random.default_rng(3)
    of = lambda s, n: [(s, DAY + dt.timedelta(days=i), float(u), int(u > 0.1)) for i, u in enumerate(rng.normal(size=n))]
    rows = spark.createDataFrame(of("long", 1200) + of("exact", 273) + of("short", 272), "symbol string, trade_date date, u double, label int")
    found = [sorted(map(tuple, walkforward.walk_forward_oos(rows, {"u": ("u",)}, run=k).collect())) for k in (1000, 7, 1)]
    assert found[0] == found[1] == found[2] and {r[1] for r in found[0]} == {"long", "exact"}
    assert len(found[0]) == 20 * (47 + 1)
    dealt = walkforward.window_runs(rows, 7).groupBy("symbol", "run").count()
    assert dealt.agg({"count": "max"}).first()[0] == 6 * 20 + 273 and dealt.filter("symbol = 'long'").count() == 9


def test_pooled_fit_does_not_depend_on_blocks(spark):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(400, 2)) * [1.0, 1e6], rng.integers(0, 2, 400)
    x[:, 1] = np.round(x[:, 1]) / 1e6
    odd = [(float("nan"), 1.0, 1), (float("inf"), 1.0, 0), (None, 1.0, 1), (1.0, 1.0, None)]
    rows = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y)] + odd, "u double, v double, label int")
    fits = [models.forward_fit(rows.repartition(k), ["u", "v"], epochs=12, sizes=s) for k, s in ((1, (400, 7)), (5, (64, 33)))]
    w, b = walkforward.fit_windows(x[None], y[None].astype(float), epochs=12)
    assert fits[0] == fits[1] and np.allclose([fits[0][0], *fits[0][1]], [b[0], *w[0]], atol=1e-10)
    assert models.forward_fit(rows.filter("false"), ["u", "v"], epochs=3) == (0.0, [0.0, 0.0])
    with pytest.raises(ValueError):
        models.forward_fit(rows, ["u"], epochs=1, sizes=(2**23, 2))
