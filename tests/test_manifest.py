"""Manifests against a plain reading, and the bound on isotonic steps."""

import datetime as dt
import hashlib
from math import floor

from pitframe.operators import calibrate
from pitframe.sources.bars import manifest


def test_manifest_is_the_sum_of_row_hashes(spark):
    rows = [("a", dt.datetime(2020, 1, 1, 7), 1, 1.25), ("b", None, None, -0.1), (None, dt.datetime(2020, 1, 2), 3, None), ("a", dt.datetime(2020, 1, 1, 7), 1, 1.25)]
    kind = "name string, at timestamp_ntz, `n.x` long, v double"
    said = lambda r: "|".join("~" if v is None else v.strftime("%Y-%m-%d %H:%M:%S") if isinstance(v, dt.datetime) else str(floor(v * 1e6 + 0.5)) if isinstance(v, float) else str(v) for v in r)
    want = str(sum(int(hashlib.md5(said(r).encode()).hexdigest()[:15], 16) for r in rows))
    assert manifest(spark.createDataFrame(rows, kind)).collect()[0] == (4, want)
    assert manifest(spark.createDataFrame(rows[::-1], kind).repartition(3)).first()["checksum"] == want
    assert manifest(spark.createDataFrame(rows[:3], kind)).first()["checksum"] != want
    assert manifest(spark.createDataFrame([], kind)).collect()[0] == (0, "0")


def test_isotonic_steps_reach_their_bound_and_no_more(spark):
    from fractions import Fraction

    steps = sorted({Fraction(k, d) for d in range(1, 13) for k in range(d + 1)})  # every rising fraction of few rows: the most steps that rows can have
    rows, p = [], 0.0
    for f in steps:
        p += 0.01
        rows += [(p, int(j < f.numerator)) for j in range(f.denominator)]
    got = calibrate.isotonic_steps(spark.createDataFrame(rows, "p double, y int"))
    assert got.count() == len(steps) <= 1.1 * len(rows) ** (2 / 3)
