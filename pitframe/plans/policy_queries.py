"""Queries: expected return and risk, the eight policies, books, packets, signals, limits; stability by industry and regime."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..fixtures import rnd
from ..operators import calibrate as ca
from ..operators import factors as fa
from ..operators import metrics as me
from ..operators import pit
from ..operators import policy as po
from ..operators import portfolio as pf
from ..sources.scratch import stored
from .metric_queries import BLOCK, FACTORS
from .pit_queries import _REGIME, _SCHED
from .registry import query

SPLIT = "1995-06-01"
LINE = (0.02, 0.8)
STEPS = [(0.0, 0.46), (0.49, 0.495), (0.5, 0.505), (0.52, 0.54)]
_ISO = "case when p >= 0.52 then 0.54 when p >= 0.5 then 0.505 when p >= 0.49 then 0.495 else 0.46 end"

_F22 = f"""
f1_ as (select *, list(next_return) over (partition by symbol order by trade_date rows between 60 preceding and 1 preceding) as past from predictions where variant = 'baseline'),
f2_ as (select *, list_aggregate(past, 'quantile_cont', 0.01) as lo, list_aggregate(past, 'quantile_cont', 0.99) as hi from f1_),
f3_ as (select *, [least(greatest(v, lo), hi) for v in past] as w from f2_),
f4_ as (select *, [list_product([1 + v for v in w[1:k]]) for k in range(1, len(w) + 1)] as curve from f3_),
q_ as (select quantile_cont(next_return, 0.01) as a, quantile_cont(next_return, 0.99) as b from f1_ where trade_date < date '{SPLIT}'),
r_ as (select least(greatest(next_return, a), b) as r from f1_, q_ where trade_date < date '{SPLIT}'),
o_ as (select coalesce(avg(r) filter (r > 0), 0) as u0, coalesce(avg(r) filter (r < 0), 0) as d0, coalesce(stddev_pop(r), 0) as v0, coalesce(stddev_pop(r) filter (r < 0), 0) as e0 from r_),
feat as (select symbol, trade_date, p, y, next_return, len(coalesce(w, [])) >= 10 as own,
  case when len(coalesce(w, [])) >= 10 then coalesce(list_avg([v for v in w if v > 0]), 0) else u0 end as upside, case when len(coalesce(w, [])) >= 10 then coalesce(list_avg([v for v in w if v < 0]), 0) else d0 end as downside,
  case when len(coalesce(w, [])) >= 10 then list_stddev_pop(w) else v0 end as risk, case when len(coalesce(w, [])) >= 10 then coalesce(list_stddev_pop([v for v in w if v < 0]), 0) else e0 end as downside_deviation,
  case when len(coalesce(w, [])) >= 10 then least(0, list_min([curve[k] / greatest(1, list_max(curve[1:k])) - 1 for k in range(1, len(curve) + 1)])) else 0 end as max_drawdown from f4_, o_)"""


@query("f22_rolling_features", f"with {_F22} select symbol, trade_date, rnd(upside, 7) as upside, rnd(downside, 7) as downside, rnd(risk, 7) as risk, rnd(downside_deviation, 7) as downside_deviation, rnd(max_drawdown, 7) as max_drawdown from feat", "predictions")
def f22(spark, sf):
    f = po.rolling_features(fx.predictions(spark, sf).filter("variant = 'baseline'").select("symbol", "trade_date", "next_return"), SPLIT)
    return f.select("symbol", "trade_date", *[rnd(c, 7).alias(c) for c in ("upside", "downside", "risk", "downside_deviation", "max_drawdown")])


def _scored(spark, sf, platt=None, iso=None):
    """Prediction rows with calibrated scores, features, industry and regime."""
    keep = ["symbol", "trade_date", "p", "y", "next_return"]
    x = po.rolling_features(fx.predictions(spark, sf).filter("variant = 'baseline'").select(*keep), SPLIT)
    x = x.withColumn("p_platt", rnd(platt if platt is not None else po.line(F.col("p"), *LINE), 9)).withColumn("p_iso", po.step_of(F.col("p"), STEPS)) if iso is None else iso(x.withColumn("p_platt", platt))
    x = x.withColumn("risk", rnd("risk", 7)).withColumn("expected_return", rnd(po.expected_return(F.col("p_platt"), F.col("upside"), F.col("downside")), 7))
    plan = pit.schedules(fx.membership(spark, sf))
    x = x.join(F.broadcast(plan), "symbol", "left").withColumn("industry", pit.scheduled_industry(F.col("trade_date"), F.col("trade_date").cast("timestamp_ntz") + fx.hours(8))).drop("steps", "known")
    regime = pit.universe_regime(fx.late_bars(spark, sf)).select("trade_date", "regime")
    return x.join(F.broadcast(regime), "trade_date", "left").withColumn("regime", F.coalesce("regime", F.lit("NO_DATA")))


_SCORED = f"""{_F22}, {_SCHED}, {_REGIME},
s0_ as (select symbol, trade_date, p, y, next_return, upside, downside, rnd(risk, 7) as risk, rnd(1 / (1 + exp(-(0.02::double + 0.8::double * ln(p / (1 - p))))), 9) as p_platt, {_ISO}::double as p_iso from feat),
scored as (select s.*, rnd(p_platt * upside + (1 - p_platt) * downside, 7) as expected_return, h.industry_code as industry, coalesce(rg.regime, 'NO_DATA') as regime from s0_ s
  left join cnt c using (symbol, trade_date) left join sch h on h.symbol = s.symbol and h.pos = c.pos left join rg on rg.trade_date = s.trade_date)"""
_PICKED = """
k_ as (select *, row_number() over (partition by trade_date order by p_platt desc, symbol) as rk, quantile_cont(p_platt, 0.8) over (partition by trade_date) as q80, median(risk) over () as mid from scored),
t_ as (select 'hold_all' as policy, p as p_used, * from k_ union all select 'threshold_raw_p50', p, * from k_ where p >= 0.5 union all select 'threshold_platt_p50', p_platt, * from k_ where p_platt >= 0.5
  union all select 'threshold_iso_p50', p_iso, * from k_ where p_iso >= 0.5 union all select 'topk_platt_k3', p_platt, * from k_ where rk <= 3 union all select 'percentile_platt_p80', p_platt, * from k_ where p_platt >= q80
  union all select 'er_platt_0', p_platt, * from k_ where expected_return > 0 union all select 'er_platt_pos_risk', p_platt, * from k_ where expected_return > 0 and risk <= mid),
picked as (select * from (select *, row_number() over (partition by policy, trade_date, industry order by symbol) as nth from t_) where industry is null or nth <= 2)"""
_ALL = f"with {_SCORED}, {_PICKED}"
_NEED = "predictions membership near"


@query("p6_expected_return", f"with {_SCORED} select symbol, trade_date, expected_return, p_platt from scored", _NEED)
def p6(spark, sf):
    return _scored(spark, sf).select("symbol", "trade_date", "expected_return", "p_platt")


@query("p5_eight_policies", f"{_ALL} select policy, count(*) as n, count(distinct trade_date) as days, rnd(avg(next_return), 9) as gross, rnd(avg(p_used), 9) as mean_p from picked group by policy", _NEED)
def p5(spark, sf):
    s = po.select(stored(_scored(spark, sf), "scored"))
    return s.groupBy("policy").agg(F.count("*").alias("n"), F.count_distinct("trade_date").alias("days"), rnd(F.avg("next_return")).alias("gross"), rnd(F.avg("p_used")).alias("mean_p"))


@query("p5_fitted_policies")
def p5_fitted(spark, sf):
    """The eight policies with Platt's line and the isotonic steps fitted on the rows before the split, over the rows after it."""
    p = fx.predictions(spark, sf).filter("variant = 'baseline'")
    fit = p.filter(F.col("trade_date") < SPLIT)
    steps = ca.isotonic_steps(fit)
    rows = _scored(spark, sf, ca.platt(fit), lambda x: ca.isotonic(x, steps, out="p_iso")).filter(F.col("trade_date") >= SPLIT)
    rows = stored(rows, "scored")
    return po.portfolio_metrics(stored(po.select(rows), "selected"), rows)


@query("d9_cap_per_industry", f"with {_SCORED} select trade_date, industry, symbol from (select *, row_number() over (partition by trade_date, industry order by symbol) as nth from scored) where nth <= 2 or industry is null", _NEED)
def d9(spark, sf):
    return pf.cap_per_group(_scored(spark, sf), "trade_date", "industry", "symbol", po.CAP).select("trade_date", "industry", "symbol")


_TURN = """, n_ as (select *, row_number() over (partition by policy order by trade_date) as i from (select policy, trade_date, count(*) as n from picked group by all)), b_ as (select p.policy, p.symbol, n.i from picked p join n_ n using (policy, trade_date)),
st_ as (select a.policy, count(*) as stay from b_ a join b_ b on a.policy = b.policy and a.symbol = b.symbol and a.i = b.i + 1 group by a.policy),
to_ as (select policy, case when max(i) > 1 then (2 * sum(n) - max_by(n, i) - 2 * max(coalesce(stay, 0)))::double / sum(n) else 0 end as turnover from n_ left join st_ using (policy) group by policy)"""


@query("p8_portfolio_metrics", f"""{_ALL}{_TURN}, bk_ as (select policy, trade_date, avg(next_return) as r from picked group by all), c_ as (select *, product(1 + r) over (partition by policy order by trade_date rows between unbounded preceding and current row) as curve from bk_),
d_dd as (select policy, min(curve / greatest(1, peak) - 1) as dd from (select *, max(curve) over (partition by policy order by trade_date rows between unbounded preceding and current row) as peak from c_) group by policy),
g_ as (select policy, count(*) as n, avg(y::double) as hit_rate, avg((p_used - y) * (p_used - y)) as brier, avg(-case when y = 1 then ln(least(greatest(p_used, 1e-15), 1 - 1e-15)) else ln(1 - least(greatest(p_used, 1e-15), 1 - 1e-15)) end) as log_loss, avg(next_return) as gross,
  stddev_pop(next_return) as volatility, coalesce(avg(next_return) filter (next_return < 0), 0) as downside_return, coalesce(stddev_pop(next_return) filter (next_return < 0), 0) as downside_deviation from picked group by policy)
select policy, scenario, n, rnd(n::double / (select count(*) from scored), 9) as coverage, rnd(n::double / (select count(distinct trade_date) from scored), 6) as per_day, rnd(hit_rate, 9) as hit_rate, rnd(brier, 9) as brier, rnd(log_loss, 9) as log_loss, rnd(gross, 9) as gross, rnd(turnover, 9) as turnover,
rnd(gross - bp / 10000 * turnover, 9) as net, rnd(dd, 6) as max_drawdown, rnd(volatility, 7) as volatility, rnd(downside_return, 9) as downside_return, rnd(downside_deviation, 7) as downside_deviation
from g_ join d_dd using (policy) join to_ using (policy), (values ('zero', 0.0::double), ('low', 10.0::double), ('medium', 20.0::double)) v(scenario, bp)""", _NEED)
def p8(spark, sf):
    rows = stored(_scored(spark, sf), "scored")
    return po.portfolio_metrics(stored(po.select(rows), "selected"), rows)


@query("p9_stability", f"""{_ALL}, e_ as (select policy, unnest(['yearly', 'regime', 'industry', 'symbol']) as "table", unnest([cast(year(trade_date) as varchar), regime, industry, symbol]) as key, y, next_return from picked)
select policy, "table", key, count(*) as n, rnd(avg(y::double), 9) as hit_rate, rnd(avg(next_return), 9) as mean_return from e_ where key is not null group by all""", _NEED)
def p9(spark, sf):
    return po.stability(po.select(stored(_scored(spark, sf), "scored")))


_REASONS = "(values " + ", ".join(f"('{p.name}', '{p.reason}', '{'none' if p.rule == 'all' else {'p': 'raw', 'p_platt': 'platt', 'p_iso': 'isotonic'}[p.score]}')" for p in po.POLICIES) + ") m(policy, reason, method)"


@query("p10_packets", f"""{_ALL} select k.policy, symbol, trade_date, method as calibration_method, p as raw_probability, p_used as calibrated_probability, expected_return, risk as risk_score, rnd(expected_return - 0.001, 9) as cost_adjusted_expected_return, regime as market_regime, reason as selection_reason
from picked k join {_REASONS} using (policy)""", _NEED)
def p10(spark, sf):
    return po.packets(po.select(stored(_scored(spark, sf), "scored"))).withColumn("cost_adjusted_expected_return", rnd("cost_adjusted_expected_return")).drop("data_available_date")


@query("p12_validate_packets", f"""{_ALL}, v_ as (select case when symbol like '%9' then 'mystery' else k.policy end as policy, symbol, trade_date, method, p, case when symbol like '%3' then null else p_used end as p_used, case when symbol like '%5' then trade_date + 1 else trade_date end as avail from picked k join {_REASONS} using (policy))
select policy, symbol, trade_date, method as calibration_method, case when p_used is null then 'calibrated_probability' else '' end as missing_fields, case when avail <= trade_date then 'fresh' else 'stale' end as freshness,
concat_ws(',', case when p_used is null then 'missing_data' end, case when avail > trade_date then 'stale_data' end, case when method = 'none' then 'low_confidence' end, case when (p >= 0.5) <> (p_used >= 0.5) then 'contradictory_evidence' end, case when policy = 'mystery' then 'unknown_policy' end) as uncertainty,
substr(sha256(policy || '|' || symbol || '|' || cast(trade_date as varchar)), 1, 16) as report_id from v_""", _NEED)
def p12(spark, sf):
    p = po.packets(po.select(stored(_scored(spark, sf), "scored")))
    s = F.col("symbol")
    p = p.withColumn("policy", F.when(s.like("%9"), "mystery").otherwise(F.col("policy"))).withColumn("calibrated_probability", F.when(~s.like("%3"), F.col("calibrated_probability"))).withColumn("data_available_date", F.when(s.like("%5"), F.date_add("trade_date", 1)).otherwise(F.col("trade_date")))
    v = po.validate_packets(p)
    return v.select("policy", "symbol", "trade_date", "calibration_method", F.array_join("missing_fields", ",").alias("missing_fields"), "freshness", F.array_join("uncertainty", ",").alias("uncertainty"), "report_id")


_ENDS = ", ".join(f"rnd(max({c}) filter (round < 0), 9) as {c}, rnd(quantile_cont({c}, 0.025) filter (round >= 0), 9) as {c}_q025, rnd(quantile_cont({c}, 0.975) filter (round >= 0), 9) as {c}_q975" for c in ("net_delta", "hit_delta", "coverage_delta"))


@query("p11_policy_bootstrap", f"""{_ALL}, di as (select policy, trade_date, row_number() over (partition by policy order by trade_date) as i, count(*) over (partition by policy) as days from (select distinct policy, trade_date from picked)),
mv as (select policy, symbol, next_return, y, i, days, coalesce(lag(i) over u, -1) <> i - 1 as enters, i < days and coalesce(lead(i) over u, -1) <> i + 1 as leaves from picked join di using (policy, trade_date) window u as (partition by policy, symbol order by i)),
sy as (select policy, symbol, sum(next_return) as r, sum(y)::double as hits, count(*) as n, sum(enters::int + leaves::int) as moves from mv group by all),
nm as (select symbol, row_number() over (order by symbol) - 1 as nth, count(*) over () as c from (select distinct symbol from sy)),
dr as (select id % 1000 as round, ('0x' || substr(md5('20260929:' || id), 1, 8))::bigint % c as nth from (select any_value(c) as c from nm), unnest(range(1000 * c)) u(id)),
wt as (select round, symbol, count(*) as k from dr join nm using (nth) group by all union all select -1, symbol, 1 from nm),
rd as (select round, policy, sum(k * r) / sum(k * n) - {po.COSTS["low"]}::double / 10000 * sum(k * moves) / sum(k * n) as net, sum(k * hits) / sum(k * n) as hit, sum(k * n)::double as n from sy join wt using (symbol) group by all),
dl as (select b.round, o.policy, g.net - b.net as net_delta, g.hit - b.hit as hit_delta, coalesce(g.n, 0) / b.n - 1 as coverage_delta from rd b cross join (select distinct policy from sy where policy <> 'hold_all') o left join rd g on g.round = b.round and g.policy = o.policy where b.policy = 'hold_all')
select policy, {_ENDS} from dl group by policy""", _NEED)
def p11(spark, sf):
    return po.policy_bootstrap(stored(po.select(stored(_scored(spark, sf), "scored")), "selected"))


_SIG = "sg as (select symbol, trade_date, \"open\", \"close\", (extract(day from trade_date) + cast(symbol as integer)) % 3 = 0 as signal, extract(day from trade_date) % 11 = 0 as buy_blocked, extract(day from trade_date) % 13 = 0 as sell_blocked, extract(day from trade_date) % 17 = 0 as suspended from bars where revision = 0)"


def _signals(spark, sf):
    d, k = F.dayofmonth("trade_date"), F.col("symbol").cast("int")
    return fx.bars(spark, sf).filter("revision = 0").select("symbol", "trade_date", "open", "close", ((d + k) % 3 == 0).alias("signal"), (d % 11 == 0).alias("buy_blocked"), (d % 13 == 0).alias("sell_blocked"), (d % 17 == 0).alias("suspended"))


@query("p2_evaluate_signals", f"""
with {_SIG}, r as (select *, lead("close", 5) over (partition by symbol order by trade_date) / "close" - 1 as r from sg), x as (select *, product(1 + greatest(r, -1)) over (partition by symbol order by trade_date rows between unbounded preceding and current row) as curve from r where signal and r is not null),
k as (select *, max(curve) over (partition by symbol order by trade_date rows between unbounded preceding and current row) as peak from x)
select symbol, count(*) as n, rnd(avg((r > 0)::int::double), 9) as hit, rnd(avg(r), 9) as mean, rnd(quantile_cont(r, 0.5), 9) as median, rnd(case when stddev_samp(r) > 0 then avg(r) / stddev_samp(r) * sqrt(252) end, 6) as sharpe, rnd(min(curve / peak - 1), 7) as max_drawdown from k group by symbol""", "bars")
def p2(spark, sf):
    return po.evaluate_signals(_signals(spark, sf), 5)


@query("p3_signal_holding", f"""
with {_SIG}, n as (select *, lead("open") over w as no, lead("close") over w as nc, not coalesce(lead(suspended) over w, false) as free, coalesce(lead(buy_blocked) over w, false) as bb, coalesce(lead(sell_blocked) over w, false) as sb, row_number() over w as rn from sg window w as (partition by symbol order by trade_date)),
e as (select *, case when signal and free and not bb then 1 when not signal and free and not sb then 0 end as event from n), p as (select *, coalesce(last_value(event ignore nulls) over (partition by symbol order by trade_date rows between unbounded preceding and current row), 0) as position from e)
select symbol, trade_date, position, rnd(case when position = 1 then nc / no - 1 - case when rn = 1 then 0 else 0.0003::double end else 0 end, 9) as r from p where no is not null""", "bars")
def p3(spark, sf):
    return po.holding_returns(_signals(spark, sf))


@query("p14_decision_class", f"""with {_SCORED} select symbol, trade_date, case when 1 - least(1, risk * 20) < 0.75 or regime = 'BEAR' then 'NO_ACTION' when p_platt >= 0.5 then 'PAPER_TEST' else 'RESEARCH' end as decision_class from scored""", _NEED)
def p14(spark, sf):
    quality = 1 - F.least(F.lit(1.0), F.col("risk") * 20)
    return _scored(spark, sf).select("symbol", "trade_date", po.decision_class(quality, F.col("p_platt"), F.col("regime") != "BEAR", F.lit(True), 0.5).alias("decision_class"))


@query("p15_max_drawdown", 'select symbol, rnd(least(0, min("look" / peak - 1)), 9) as max_drawdown from (select symbol, look, max(look) over (partition by symbol order by trade_date rows between unbounded preceding and current row) as peak from settled) group by symbol', "settled")
def p15(spark, sf):
    return po.max_drawdown(fx.bars(spark, sf).filter("revision = 0"))


@query("p16_position_limits", """
with o as (select o_custkey as account, l_suppkey as stock, l_suppkey % 5 as sector, sum(l_quantity) as q, max(l_quantity) as big from lineitem join orders on l_orderkey = o_orderkey group by all),
s as (select *, q * 100 / sum(q) over (partition by account) as single, sum(q) over (partition by account, sector) * 100 / sum(q) over (partition by account) as sec, big * 100 / sum(q) over (partition by account) as trade from o)
select account, stock, rnd(single, 6) as single, rnd(sec, 6) as sector_pct, concat_ws(',', case when single > 20 then 'SINGLE' end, case when sec > 40 then 'SECTOR' end, case when trade > 50 then 'TRADE' end) as breaches from s""")
def p16(spark, sf):
    li, o = fx.table(spark, sf, "lineitem"), fx.table(spark, sf, "orders")
    x = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("account"), F.col("l_suppkey").alias("stock"), (F.col("l_suppkey") % 5).alias("sector")).agg(F.sum("l_quantity").alias("q"), F.max("l_quantity").alias("big"))
    whole = F.sum("q").over(Window.partitionBy("account"))
    x = x.withColumn("single", F.col("q") * 100 / whole).withColumn("sec", F.sum("q").over(Window.partitionBy("account", "sector")) * 100 / whole).withColumn("trade", F.col("big") * 100 / whole)
    return x.select("account", "stock", rnd("single", 6).alias("single"), rnd("sec", 6).alias("sector_pct"), F.array_join(po.position_breaches(F.col("single"), F.col("sec"), F.col("trade")), ",").alias("breaches"))


@query("o3_industry_stability", f"with {_SCHED} select variant, h.industry_code, {BLOCK} from predictions p join cnt c using (symbol, trade_date) join sch h on h.symbol = p.symbol and h.pos = c.pos group by all", "predictions membership")
def o3(spark, sf):
    plan = pit.schedules(fx.membership(spark, sf))
    p = fx.predictions(spark, sf).join(plan, "symbol").withColumn("industry_code", pit.scheduled_industry(F.col("trade_date"), F.col("trade_date").cast("timestamp_ntz") + fx.hours(8)))
    return p.filter("industry_code is not null").groupBy("variant", "industry_code").agg(*me.metric_block())


@query("o6_regime_metrics", f"with {_REGIME} select variant, regime, {BLOCK} from predictions join rg using (trade_date) where regime <> 'NO_DATA' group by all", "predictions near")
def o6(spark, sf):
    r = pit.universe_regime(fx.late_bars(spark, sf)).filter("regime <> 'NO_DATA'").select("trade_date", "regime")
    return fx.predictions(spark, sf).join(r, "trade_date").groupBy("variant", "regime").agg(*me.metric_block())


_PAIRS = [(a, b) for i, a in enumerate(FACTORS) for b in FACTORS[i + 1 :]]
_R = ", ".join(f"row_number() over (order by {f}, symbol, trade_date) as r_{f}" for f in FACTORS)


@query("o10_redundancy", "with d as (select *, " + _R + " from design), " + "u as (" + " union all ".join(f"select '{a}' as a, '{b}' as b, corr({a}, {b}) as pearson, corr(r_{a}, r_{b}) as spearman from d" for a, b in _PAIRS) + ") select a, b, rnd(pearson, 6) as pearson, rnd(spearman, 6) as spearman, abs(pearson) >= 0.85 as cluster_pair from u", "design")
def o10(spark, sf):
    d = fa.design_rows(fx.bars(spark, sf))
    return me.redundancy(d, FACTORS, ["symbol", "trade_date"])


@query("j11_align_predictions", """
with a as (select * from predictions where variant = 'baseline'), b as (select * from predictions where variant = 'shifted' and not (symbol like '%8' and extract(day from trade_date) = 5))
select coalesce(a.symbol, b.symbol) as symbol, count(*) as n, bool_and(a.y is not null and b.y is not null and a.y = b.y) as aligned, count(*) filter (a.y is null or b.y is null) as unmatched from a full join b on a.symbol = b.symbol and a.trade_date = b.trade_date group by 1""", "predictions")
def j11(spark, sf):
    p = fx.predictions(spark, sf)
    b = p.filter("variant = 'shifted'").filter(~(F.col("symbol").like("%8") & (F.dayofmonth("trade_date") == 5)))
    return me.align(p.filter("variant = 'baseline'"), b, ["symbol", "trade_date"])


@query("m9_evaluate_oos", """
with c as (select variant, symbol, trade_date, p, y, product(1 + case when p >= 0.5 then next_return else 0 end) over (partition by variant, symbol order by trade_date rows between unbounded preceding and current row) as equity from predictions),
e as (select *, max(equity) over (partition by variant, symbol order by trade_date rows between unbounded preceding and current row) as peak from c)
select variant, symbol, rnd(avg(((p >= 0.5) = (y = 1))::int::double), 9) as accuracy, rnd(avg((p - y) * (p - y)), 9) as brier, rnd(max_by(equity, trade_date) - 1, 6) as total, rnd(min(equity / greatest(1, peak) - 1), 6) as max_drawdown from e group by all""", "predictions")
def m9(spark, sf):
    return me.evaluate_oos(fx.predictions(spark, sf))


@query("p1_performance_full", """
with c as (select symbol, trade_date, look, look / lag(look) over w - 1 as r, max(look) over (w rows between unbounded preceding and current row) as peak from settled window w as (partition by symbol order by trade_date)),
g as (select symbol, max_by(look, trade_date) / min_by(look, trade_date) - 1 as total, count(r) / 252.0::double as years, stddev_pop(r) as sd, avg(r) as m, min(look / peak - 1) as dd, avg((r > 0)::int::double) filter (r is not null) as win, count(*) as n from c group by symbol),
a as (select *, case when years > 0 and total > -1 then pow(1 + total, 1 / years) - 1 end as annual from g)
select symbol, rnd(total, 9) as total, rnd(annual, 6) as annual, rnd(sd * sqrt(252), 6) as volatility, rnd(case when sd > 0 then m / sd * sqrt(252) end, 6) as sharpe, rnd(dd, 9) as max_drawdown, rnd(case when dd < 0 then annual / abs(dd) end, 6) as calmar, rnd(win, 9) as win_rate, n as observations from a""", "settled")
def p1(spark, sf):
    return me.performance_full(fx.bars(spark, sf).filter("revision = 0"), "symbol", "trade_date", "close")
