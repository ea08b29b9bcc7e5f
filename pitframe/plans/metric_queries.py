"""Queries over prediction rows: metrics, calibration, drift, stability, normalisation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..fixtures import rnd
from ..operators import metrics as me
from ..sources.scratch import stored
from .registry import query

_LL = "-case when y = 1 then ln(least(greatest(p, 1e-15), 1 - 1e-15)) else ln(1 - least(greatest(p, 1e-15), 1 - 1e-15)) end"
BLOCK = f"""count(*) as n, rnd(avg(((p >= 0.5) = (y = 1))::int::double), 9) as accuracy, rnd(avg((p - y) * (p - y)), 9) as brier, rnd(avg({_LL}), 9) as log_loss, rnd(avg(p), 9) as mean_p,
rnd(avg(y::double), 9) as positive_rate, rnd(avg(((p >= 0.5) = (y = 1))::int::double) - avg(((baseline_p >= 0.5) = (y = 1))::int::double), 9) as accuracy_delta,
rnd(avg((p - y) * (p - y)) - avg((baseline_p - y) * (baseline_p - y)), 9) as brier_delta"""
FACTORS = ["momentum", "volatility", "trend", "volume_ratio"]
SPLIT = "1999-01-01"


def predicted(spark, sf):
    """The prediction rows as a table, for plans that read them more than once."""
    return stored(fx.predictions(spark, sf), "predictions")


@query("m7_metric_block", f"select variant, {BLOCK} from predictions group by variant", "predictions")
def m7(spark, sf):
    return fx.predictions(spark, sf).groupBy("variant").agg(*me.metric_block())


@query("m8_metric_tables", f"select variant, symbol, {BLOCK} from predictions group by rollup (variant, symbol)", "predictions")
def m8(spark, sf):
    return me.metric_tables(fx.predictions(spark, sf), "variant", "symbol")


@query("m2_yearly_folds", """
with y as (select distinct year(trade_date)::int as yr from predictions), r as (select yr, lag(yr, 1) over (order by yr) as t3, lag(yr, 2) over (order by yr) as t2, lag(yr, 3) over (order by yr) as t1 from y)
select yr as test_year, t1 as train_from, t3 as train_to from r where t1 is not null""", "predictions")
def m2(spark, sf):
    y = fx.predictions(spark, sf).select(F.year("trade_date").alias("yr")).distinct()
    w = Window.orderBy("yr")
    return y.select(F.col("yr").alias("test_year"), F.lag("yr", 3).over(w).alias("train_from"), F.lag("yr", 1).over(w).alias("train_to")).filter("train_from is not null")


@query("m13_prediction_vs_reality", "select variant, rnd(avg((p - y) * (p - y)), 9) as brier, rnd(avg(p - 0.5 - next_return), 9) as mean_error, rnd(avg(abs(p - 0.5 - next_return)), 9) as mean_abs_error from predictions group by variant", "predictions")
def m13(spark, sf):
    e = F.col("p") - 0.5 - F.col("next_return")
    return fx.predictions(spark, sf).groupBy("variant").agg(rnd(F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y")))).alias("brier"), rnd(F.avg(e)).alias("mean_error"), rnd(F.avg(F.abs(e))).alias("mean_abs_error"))


@query("c1_calibration_report", "select variant, least(floor(p * 10), 9)::int as bin, count(*) as n, rnd(avg(p), 9) as mean_p, rnd(avg(y), 9) as rate from predictions group by all", "predictions")
def c1(spark, sf):
    return me.binned(fx.predictions(spark, sf), 10).groupBy("variant", "bin").agg(F.count("*").alias("n"), rnd(F.avg("p")).alias("mean_p"), rnd(F.avg("y")).alias("rate"))


_REL = "count(*) as n, rnd(avg(p), 9) as mean_p, rnd(avg(y::double), 9) as rate, rnd(avg(p) - avg(y), 9) as difference, rnd(abs(avg(p) - avg(y)), 9) as abs_error, rnd(avg(next_return), 9) as mean_return"


@query("c2_reliability", f"""
with g as (select variant, least(floor(p * 20), 19)::int as bin, {_REL} from predictions group by all), e as (select variant, b::int as bin from (select distinct variant from predictions), range(20) r(b))
select e.variant, e.bin, coalesce(n, 0) as n, mean_p, rate, difference, abs_error, mean_return from e left join g on e.variant = g.variant and e.bin = g.bin""", "predictions")
def c2(spark, sf):
    return me.reliability(predicted(spark, sf), 20, "variant")


@query("c3_ece", "select variant, rnd(sum(n * e) / sum(n), 9) as ece from (select variant, least(floor(p * 20), 19) as b, count(*) as n, abs(avg(p) - avg(y)) as e from predictions group by all) group by variant", "predictions")
def c3(spark, sf):
    return me.expected_calibration_error(fx.predictions(spark, sf), 20, "variant")


_SLICES = """
t_ as (select trade_date, row_number() over (order by trade_date) - 1 as i, count(*) over () as n, max(trade_date) over () as last from (select distinct trade_date from predictions)),
n_ as (select trade_date, 'all' as slice from t_ union all select trade_date, 'third_' || (floor(i * 3 / n) + 1)::int from t_ union all select trade_date, 'recent' from t_ where last - trade_date < 730 union all select trade_date, 'year_' || year(trade_date) from t_)
"""


@query("o1_time_slices", f"with {_SLICES} select variant, slice, {BLOCK} from predictions join n_ using (trade_date) group by all", "predictions")
def o1(spark, sf):
    return me.time_slices(predicted(spark, sf)).groupBy("variant", "slice").agg(*me.metric_block())


@query("c7_audit_by_slice", f"with {_SLICES} select slice, rnd(avg((p - y) * (p - y)), 9) as brier, rnd(avg(p), 9) as mean_p, rnd(avg(y), 9) as rate from predictions join n_ using (trade_date) where variant = 'baseline' group by slice", "predictions")
def c7(spark, sf):
    x = me.time_slices(stored(fx.predictions(spark, sf).filter("variant = 'baseline'").select("trade_date", "p", "y"), "predictions"))
    return x.groupBy("slice").agg(rnd(F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y")))).alias("brier"), rnd(F.avg("p")).alias("mean_p"), rnd(F.avg("y")).alias("rate"))


@query("c8_bucket_stability", f"with {_SLICES} select slice, least(floor(p * 20), 19)::int as bin, count(*) as n, rnd(avg(p) - avg(y), 6) as difference from predictions join n_ using (trade_date) where variant = 'baseline' group by all", "predictions")
def c8(spark, sf):
    x = me.binned(me.time_slices(predicted(spark, sf).filter("variant = 'baseline'")), 20)
    return x.groupBy("slice", "bin").agg(F.count("*").alias("n"), rnd(F.avg("p") - F.avg("y"), 6).alias("difference"))


@query("c9_probability_diagnostics", """
select variant, rnd(avg(-(p * ln(p) + (1 - p) * ln(1 - p))), 9) as entropy, rnd(avg((p < 0.1)::int), 9) as low, rnd(avg((p > 0.9)::int), 9) as high, rnd(avg((p between 0.45 and 0.55)::int), 9) as middle from predictions group by variant""", "predictions")
def c9(spark, sf):
    p = F.col("p")
    share = lambda c: rnd(F.avg(c.cast("int")))
    return fx.predictions(spark, sf).groupBy("variant").agg(rnd(F.avg(-(p * F.ln(p) + (1 - p) * F.ln(1 - p)))).alias("entropy"), share(p < 0.1).alias("low"), share(p > 0.9).alias("high"), share(p.between(0.45, 0.55)).alias("middle"))


@query("c9_probability_histogram", """
with n as (select variant, least(floor(p * 10), 9)::int as bin, count(*) as n from predictions group by all), v as (select variant, count(*) as m from predictions group by variant)
select v.variant, b.b::int as bin, coalesce(n.n, 0) as n, rnd(coalesce(n.n, 0) / m::double, 9) as frequency from v cross join (select unnest(range(0, 10)) as b) b left join n on n.variant = v.variant and n.bin = b.b""", "predictions")
def c9_histogram(spark, sf):
    g = me.binned(fx.predictions(spark, sf), 10).groupBy("variant", "bin").agg(F.count("*").alias("n"))
    every = g.groupBy("variant").agg(F.sum("n").alias("m")).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(9))))
    return every.join(g, ["variant", "bin"], "left").fillna(0, ["n"]).select("variant", "bin", "n", rnd(F.col("n") / F.col("m")).alias("frequency"))


def _sides(spark, sf):
    p = fx.predictions(spark, sf).filter("variant = 'baseline'")
    return p.filter(F.col("trade_date") < SPLIT), p.filter(F.col("trade_date") >= SPLIT)


_SIDES = f"a as (select * from predictions where variant = 'baseline' and trade_date < '{SPLIT}'), b as (select * from predictions where variant = 'baseline' and trade_date >= '{SPLIT}')"


@query("c12_mean_shift", f"with {_SIDES}, s as (select abs((select avg(momentum) from b) - avg(momentum)) / stddev_pop(momentum) as x from a) select rnd(x, 6) as shift, x >= 2 as alarm from s", "predictions")
def c12(spark, sf):
    return me.mean_shift(*_sides(spark, sf), "momentum")


@query("c13_probability_shift", f"with {_SIDES} select rnd(abs((select avg(p) from b) - avg(p)), 9) as shift, abs((select avg(p) from b) - avg(p)) >= 0.1 as alarm from a", "predictions")
def c13(spark, sf):
    a, b = _sides(spark, sf)
    x = a.agg(F.avg("p").alias("m0")).crossJoin(b.agg(F.avg("p").alias("m1"))).select(F.abs(F.col("m1") - F.col("m0")).alias("s"))
    return x.select(rnd("s").alias("shift"), (F.col("s") >= 0.1).alias("alarm"))


@query("c14_psi", f"""
with {_SIDES}, e as (select min(p) as lo, max(p) as hi from a), n as (select unnest(range(1, 11)) as bin),
ca as (select greatest(1, least(10, ceil((p - lo) / (hi - lo) * 10)))::int as bin, count(*) as c from a, e group by 1), cb as (select greatest(1, least(10, ceil((p - lo) / (hi - lo) * 10)))::int as bin, count(*) as c from b, e group by 1),
x as (select greatest(coalesce(ca.c, 0) / (select count(*) from a), 1e-6) as pa, greatest(coalesce(cb.c, 0) / (select count(*) from b), 1e-6) as pb from n left join ca using (bin) left join cb using (bin))
select rnd(sum((pb - pa) * ln(pb / pa)), 6) as psi, rnd(sum((pb - pa) * ln(pb / pa)), 6) >= 0.2 as alarm from x""", "predictions")
def c14(spark, sf):
    return me.population_stability(*_sides(spark, sf), "p")


@query("o2_symbol_stability", f"""
with g as (select variant, symbol, avg((p - y) * (p - y)) - avg((baseline_p - y) * (baseline_p - y)) as d from predictions group by all)
select variant, count(*) as symbols, count(*) filter (d < 0) as improved, count(*) filter (d > 0) as degraded, rnd(avg(d), 9) as mean_delta, rnd(median(d), 9) as median_delta, rnd(quantile_cont(d, 0.1), 9) as q10, rnd(quantile_cont(d, 0.9), 9) as q90 from g group by variant""", "predictions")
def o2(spark, sf):
    d = F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))) - F.avg((F.col("baseline_p") - F.col("y")) * (F.col("baseline_p") - F.col("y")))
    g = fx.predictions(spark, sf).groupBy("variant", "symbol").agg(d.alias("d"))
    q = lambda x: rnd(F.percentile("d", F.lit(x)))
    return g.groupBy("variant").agg(F.count("*").alias("symbols"), F.count_if(F.col("d") < 0).alias("improved"), F.count_if(F.col("d") > 0).alias("degraded"), rnd(F.avg("d")).alias("mean_delta"), q(0.5).alias("median_delta"), q(0.1).alias("q10"), q(0.9).alias("q90"))


_Q = "1 + (momentum >= e1)::int + (momentum >= e2)::int + (momentum >= e3)::int + (momentum >= e4)::int as q"
_E = "quantile_cont(momentum, 0.2) as e1, quantile_cont(momentum, 0.4) as e2, quantile_cont(momentum, 0.6) as e3, quantile_cont(momentum, 0.8) as e4"


@query("o4_factor_quintiles", f"""
with p as (select * from predictions where variant = 'baseline'), e as (select {_E} from p), x as (select *, {_Q} from p, e)
select q, count(*) as n, rnd(avg(momentum), 9) as mean_factor, rnd(avg(y), 9) as up_rate, rnd(avg(next_return), 9) as mean_return from x group by q""", "predictions")
def o4(spark, sf):
    x = me.quintiles(fx.predictions(spark, sf).filter("variant = 'baseline'"), "momentum")
    return x.groupBy("q").agg(F.count("*").alias("n"), rnd(F.avg("momentum")).alias("mean_factor"), rnd(F.avg("y")).alias("up_rate"), rnd(F.avg("next_return")).alias("mean_return"))


@query("o5_discovery_quintile_spread", f"""
with p as (select * from predictions where variant = 'baseline'), e as (select {_E} from p where trade_date < '{SPLIT}'), x as (select *, {_Q} from p, e)
select symbol, count(*) as n, rnd(avg(next_return) filter (q = 5) - avg(next_return) filter (q = 1), 9) as spread from x group by symbol having count(*) >= 50""", "predictions")
def o5(spark, sf):
    p = fx.predictions(spark, sf).filter("variant = 'baseline'")
    x = me.quintiles(p, "momentum", p.filter(F.col("trade_date") < SPLIT))
    side = lambda k: F.avg(F.when(F.col("q") == k, F.col("next_return")))
    return x.groupBy("symbol").agg(F.count("*").alias("n"), rnd(side(5) - side(1)).alias("spread")).filter("n >= 50")


@query("o7_cost_sensitivity", """
with x as (select *, (p >= 0.5)::int as pos from predictions), m as (select *, abs(pos - lag(pos, 1, 0) over (partition by variant, symbol order by trade_date)) as moved from x)
select variant, symbol, rnd(sum(pos * next_return), 9) as gross, sum(moved)::bigint as turnover, rnd(sum(pos * next_return) - 0.001::double * sum(moved), 9) as net from m group by all""", "predictions")
def o7(spark, sf):
    return me.cost_sensitivity(fx.predictions(spark, sf))


@query("p1_performance_metrics", """
with x as (select symbol, trade_date, final, final / lag(final) over w - 1 as r, max(final) over (w rows unbounded preceding) as peak from settled window w as (partition by symbol order by trade_date))
select symbol, rnd(max_by(final, trade_date) / min_by(final, trade_date) - 1, 9) as total, rnd(stddev_pop(r) * sqrt(252), 6) as volatility, rnd(case when stddev_pop(r) > 0 then avg(r) / stddev_pop(r) * sqrt(252) end, 6) as sharpe,
rnd(min(final / peak - 1), 9) as max_drawdown, rnd(avg((r > 0)::int::double), 9) as win_rate from x group by symbol""", "settled")
def p1(spark, sf):
    f = fx.bars(spark, sf).groupBy("symbol", "trade_date").agg(F.max_by("close", "revision").alias("final"))
    return me.performance(f, "symbol", "trade_date", "final")


@query("l3_winsorize", """
with q as (select symbol, quantile_cont(momentum, 0.05) as lo, quantile_cont(momentum, 0.95) as hi from design group by symbol) select symbol, trade_date, rnd(least(greatest(momentum, lo), hi), 9) as w from design join q using (symbol)""", "design")
def l3(spark, sf):
    from ..operators.factors import design_rows

    return me.winsorize(design_rows(fx.bars(spark, sf)), "momentum", ["symbol"]).select("symbol", "trade_date", rnd("w").alias("w"))


@query("l4_zscore", """
with q as (select trade_date, avg(momentum) as m, stddev_pop(momentum) as s from design group by trade_date) select symbol, trade_date, rnd(case when s > 1e-12 then (momentum - m) / s else 0 end, 6) as z from design join q using (trade_date)""", "design")
def l4(spark, sf):
    from ..operators.factors import design_rows

    return me.zscore(design_rows(fx.bars(spark, sf)), "momentum", ["trade_date"]).select("symbol", "trade_date", rnd("z", 6).alias("z"))


@query("l7_pearson", "select 'momentum' as a, b, rnd(r, 6) as r from (select corr(momentum, volatility) as volatility, corr(momentum, trend) as trend, corr(momentum, volume_ratio) as volume_ratio from design) unpivot (r for b in (volatility, trend, volume_ratio))", "design")
def l7(spark, sf):
    from ..operators.factors import design_rows

    return me.correlations(design_rows(fx.bars(spark, sf)), FACTORS).filter("a = 'momentum'")


@query("l8_spearman", """
with r as (select symbol, row_number() over (partition by symbol order by momentum, trade_date) as a, row_number() over (partition by symbol order by trend, trade_date) as b from design) select symbol, rnd(corr(a, b), 6) as rho from r group by symbol""", "design")
def l8(spark, sf):
    from ..operators.factors import design_rows

    rank = lambda c: F.row_number().over(Window.partitionBy("symbol").orderBy(c, "trade_date"))
    x = design_rows(fx.bars(spark, sf)).select("symbol", rank("momentum").alias("a"), rank("trend").alias("b"))
    return x.groupBy("symbol").agg(rnd(F.corr("a", "b"), 6).alias("rho"))


_PAIRS = [(a, b) for i, a in enumerate(FACTORS) for b in FACTORS[i + 1 :]]


@query("l7_pearson_matrix", " union all ".join(f"select '{a}' as a, '{b}' as b, rnd(coalesce(corr({a}, {b}), 0), 6) as r from design" for a, b in _PAIRS), "design")
def l7_matrix(spark, sf):
    from ..operators.factors import design_rows

    return me.correlations(design_rows(fx.bars(spark, sf)), FACTORS)


_RANKS = ", ".join(f"row_number() over (partition by symbol order by {c}, trade_date) as {c}" for c in FACTORS)


@query("l8_spearman_matrix", f"with r as (select symbol, {_RANKS} from design) " + " union all ".join(f"select symbol, '{a}' as a, '{b}' as b, rnd(corr({a}, {b}), 6) as rho from r group by symbol" for a, b in _PAIRS), "design")
def l8_matrix(spark, sf):
    from ..operators.factors import design_rows

    rank = lambda c: F.row_number().over(Window.partitionBy("symbol").orderBy(c, "trade_date"))
    x = design_rows(fx.bars(spark, sf)).select("symbol", *[rank(c).alias(c) for c in FACTORS])
    g = x.groupBy("symbol").agg(*[rnd(F.corr(a, b), 6).alias(f"{a}|{b}") for a, b in _PAIRS])
    return g.select("symbol", F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("rho")) for a, b in _PAIRS])))


@query("l9_decorrelated_factors", "select symbol, trade_date, momentum, volatility, trend, volume_ratio from design", "design")
def l9(spark, sf):
    """The design rows' factors less those that correlate with an earlier one; none does here, l9_decorrelate has one that does."""
    from ..operators.factors import design_rows

    rows = design_rows(fx.bars(spark, sf))
    return rows.select("symbol", "trade_date", *me.decorrelate(rows, FACTORS))


_PROFILE = " union all ".join(
    f"select '{c}' as name, count({c}) as n, count(*) filter ({c} is null) as missing, rnd(avg({c}), 9) as mean, rnd(stddev_pop({c}), 6) as sd, rnd(min({c}), 9) as least, rnd(quantile_cont({c}, 0.25), 9) as q25, rnd(median({c}), 9) as median, rnd(quantile_cont({c}, 0.75), 9) as q75, rnd(max({c}), 9) as most from design"
    for c in FACTORS
)


@query("l11_profile", _PROFILE, "design")
def l11(spark, sf):
    from ..operators.factors import design_rows

    return me.profile(design_rows(fx.bars(spark, sf)), FACTORS)


@query("l12_bucket_report", """
with x as (select *, row_number() over (partition by symbol order by momentum, trade_date) - 1 as i, count(*) over (partition by symbol) as m from design), b as (select unnest(range(0, 5)) as b)
select symbol, b.b::int as b, count(*) as n, rnd(avg(momentum), 9) as mean, rnd(avg(label), 9) as rate from x join b on i >= b.b * m // 5 and i < (b.b + 1) * m // 5 group by all""", "design")
def l12(spark, sf):
    from ..operators.factors import design_rows

    return me.bucket_report(design_rows(fx.bars(spark, sf)), "momentum", "label", 5, "symbol")
