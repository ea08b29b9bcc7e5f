"""Fitted calibration: Newton steps of one aggregate each, isotonic steps, and a bootstrap clustered by symbol."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored
from . import resample


def logit(p: Column, eps: float = 1e-12) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.ln(q / (1 - q))


def _sigmoid(eta: Column) -> Column:
    return 1 / (1 + F.exp(-F.least(F.greatest(eta, F.lit(-30.0)), F.lit(30.0))))


def logistic_line(preds: DataFrame, start: tuple[float, float] = (0.0, 0.0), p: str = "p", y: str = "y", steps: int = 50) -> tuple[float, float]:
    """Intercept and slope of y on logit(p). Only five sums a step reach the driver; (nan, nan) where no unique fit exists."""
    rows = preds.groupBy(logit(F.col(p)).alias("x")).agg(F.count("*").alias("n"), F.sum(F.col(y).cast("double")).alias("s")).persist()
    a, b = start
    try:
        for _ in range(steps):
            mu = _sigmoid(F.lit(a) + F.lit(b) * F.col("x"))
            w = F.greatest(mu * (1 - mu), F.lit(1e-9)) * F.col("n")
            off = F.col("s") - F.col("n") * mu
            g0, g1, h00, h01, h11 = rows.agg(F.sum(off), F.sum(off * F.col("x")), F.sum(w), F.sum(w * F.col("x")), F.sum(w * F.col("x") * F.col("x"))).first()
            det = (h00 or 0.0) * (h11 or 0.0) - (h01 or 0.0) ** 2
            if not det > 1e-12 * (h00 or 0.0) ** 2:
                return float("nan"), float("nan")
            da, db = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
            a, b = a + da, b + db
            if max(abs(da), abs(db)) < 1e-10:
                break
    finally:
        rows.unpersist()
    return a, b


def platt(fit_on: DataFrame, p: str = "p", y: str = "y") -> Column:
    """A column of ``p`` scaled by the line fitted on other rows."""
    a, b = logistic_line(fit_on, (0.0, 1.0), p, y)
    return _sigmoid(F.lit(a) + F.lit(b) * logit(F.col(p)))


def isotonic_steps(fit_on: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """(lo, hi, value): the rising step function fitted on the rows, rows of equal p being one point; the ends are open.

    Points are pooled within ranges of p first, on the executors; what is left of them ends on the driver. With outcomes 0 and 1 a step is a
    fraction whose denominator is its rows, the steps' fractions differ and their rows add up to all rows, so there are at most about
    0.9 x rows^(2/3) steps (21 MB for 10^9 rows): the size of what is sent to the tasks is bounded by that."""
    points = fit_on.groupBy(F.col(p).alias("p")).agg(F.avg(F.col(y).cast("double")).alias("label"), F.count("*").cast("double").alias("weight"))
    points = VectorAssembler(inputCols=["p"], outputCol="features").transform(points)
    model = IsotonicRegression(weightCol="weight").fit(points)
    steps: list[list[float]] = []
    for at, value in zip(model.boundaries, model.predictions):
        if not steps or value != steps[-1][1]:
            steps.append([float(at), float(value)])
    ends = [s[0] for s in steps[1:]] + [float("inf")]
    rows = [(float("-inf") if i == 0 else s[0], e, s[1]) for i, (s, e) in enumerate(zip(steps, ends))]
    return fit_on.sparkSession.createDataFrame(rows, "lo double, hi double, value double")


def isotonic(rows: DataFrame, steps: DataFrame, p: str = "p", out: str = "isotonic") -> DataFrame:
    """``rows`` with the step that holds each p: a search in one array of the steps, which are far fewer than rows."""
    ladder = F.broadcast(steps.agg(F.array_sort(F.collect_list(F.struct("lo", "value"))).alias("__steps")))  # one row
    x = rows.crossJoin(ladder)
    # halve the range until one step is left: 2^30 steps at most
    at = F.aggregate(
        F.sequence(F.lit(29), F.lit(0)), F.lit(-1), lambda a, k: F.when((a + F.pow(F.lit(2), k).cast("int") < F.size("__steps")) & (F.get("__steps", a + F.pow(F.lit(2), k).cast("int"))["lo"] <= F.col(p)), a + F.pow(F.lit(2), k).cast("int")).otherwise(a)
    )
    return x.withColumn(out, F.get("__steps", at)["value"]).drop("__steps")


def bootstrap_delta(preds: DataFrame, better: Column, rounds: int = resample.ROUNDS, seed: int = resample.SEED, by: str = "symbol") -> DataFrame:
    """Mean of ``better``, the number of symbols, and the mean's 2.5 and 97.5 % points when whole symbols are drawn again with replacement.

    Rows are summed by symbol first, so only those sums meet the draws; draws are hashes of their numbers, so reruns agree."""
    sums = preds.groupBy(F.col(by).alias("symbol")).agg(F.sum(better).alias("t"), F.count("*").alias("n"))
    g = stored(resample.drawn(sums, rounds, seed).groupBy("round").agg((F.sum("t") / F.sum("n")).alias("delta"), F.count("*").alias("symbols")), "rounds")
    ends = resample.interval(g, [], ["delta"]).select("delta", F.col("delta_q025").alias("q025"), F.col("delta_q975").alias("q975"))
    whole = g.filter("round < 0").agg(F.coalesce(F.max("symbols"), F.lit(0).cast("long")).alias("symbols"))
    return ends.crossJoin(whole).select("delta", "symbols", "q025", "q975")  # one row each
