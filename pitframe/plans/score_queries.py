"""Queries: rule scores, levels, plans, advice; stress, sentiment and calendars; regimes and fundamental factors; ledger windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..fixtures import rnd
from ..operators import factors as fa
from ..operators import metrics as me
from ..operators import pit
from ..operators import portfolio as pf
from ..operators import scores as sc
from ..operators import signals as si
from .evidence_queries import _BOARD, _board
from .metric_queries import FACTORS
from .registry import query
from .signal_queries import _MOVED, _O, looks, moved

_TICKDAY = """
m3_ as (select symbol, time_bucket(interval 30 minute, ts) as start, arg_min(price, (ts, event_id)) as o, arg_max(price, (ts, event_id)) as c, sum(hands) as v from ticks group by all),
m4_ as (select *, cast(start as date) as day, row_number() over (partition by symbol, cast(start as date) order by start desc) as rn from m3_),
ms_ as (select symbol, day, sum(v) filter (c >= o)::double / sum(v) as up_share from m4_ where rn <= 5 group by all),
td_ as (select symbol, cast(ts as date) as day, rnd(sum(price * hands) / sum(hands), 6) as vwap, arg_max(price, (ts, event_id)) as last, sum(hands)::double as volume, coalesce(sum(hands) filter (side = 'B'), 0)::double as buy, coalesce(sum(hands) filter (side = 'S'), 0)::double as sell from ticks group by all),
tx_ as (select t.*, up_share, rnd((last / lag(last) over w - 1) * 100, 6) as pct, rnd(volume / avg(volume) over (w rows between 5 preceding and 1 preceding), 6) as ratio from td_ t join ms_ using (symbol, day) window w as (partition by symbol order by day))"""


def _tick_days(spark, sf):
    t = fx.ticks(spark, sf)
    order = F.struct("ts", "event_id")
    day = F.to_date("ts").alias("day")
    bars = t.groupBy("symbol", F.window("ts", "30 minutes").alias("w")).agg(F.min_by("price", order).alias("o"), F.max_by("price", order).alias("c"), F.sum("hands").alias("v")).select("symbol", F.to_date("w.start").alias("day"), F.col("w.start").alias("start"), "o", "c", "v")
    bars = bars.withColumn("rn", F.row_number().over(Window.partitionBy("symbol", "day").orderBy(F.desc("start")))).filter("rn <= 5")
    share = bars.groupBy("symbol", "day").agg((F.sum(F.when(F.col("c") >= F.col("o"), F.col("v"))).cast("double") / F.sum("v")).alias("up_share"))
    side = lambda s: F.coalesce(F.sum(F.when(F.col("side") == s, F.col("hands"))), F.lit(0)).cast("double")
    d = t.groupBy("symbol", day).agg(rnd(F.sum(F.col("price") * F.col("hands")) / F.sum("hands"), 6).alias("vwap"), F.max_by("price", order).alias("last"), F.sum("hands").cast("double").alias("volume"), side("B").alias("buy"), side("S").alias("sell"))
    w = Window.partitionBy("symbol").orderBy("day")
    prev = F.lag("last").over(w)
    pct = F.when(prev == 0, F.col("last") * float("inf")).otherwise(rnd((F.try_divide(F.col("last"), prev) - 1) * 100, 6))  # after a price of 0 the move is infinite or, from 0 to 0, not a number, as in SQL
    return d.join(share, ["symbol", "day"]).withColumn("pct", pct).withColumn("ratio", rnd(F.col("volume") / F.avg("volume").over(w.rowsBetween(-5, -1)), 6))


@query("i3_vwap_verdict", f"with {_TICKDAY} select symbol, day, vwap, last, case when last > vwap * 1.01::double then 'ABOVE_STRONG' when last > vwap then 'ABOVE' when last < vwap * 0.99::double then 'BELOW_WEAK' when last < vwap then 'BELOW' else 'AT' end as verdict from td_", "ticks")
def i3(spark, sf):
    return _tick_days(spark, sf).select("symbol", "day", "vwap", "last", sc.vwap_verdict(F.col("last"), F.col("vwap")).alias("verdict"))


@query("i5_breakdown_score", """
with a as (select *, count(*) over w5 as n, lag(final) over w as prev, max(high) over w5 as hi, avg(volume) over (w rows between 4 preceding and 1 preceding) as bv, count(*) filter (final < "open") over w5 as down_days, avg(final) over w5 < avg(final) over (w rows between 4 preceding and 3 preceding) as turned
  from looks window w as (partition by symbol order by trade_date), w5 as (partition by symbol order by trade_date rows 4 preceding)),
b as (select *, max((coalesce(final / prev - 1 < -0.095, false) or final / "open" - 1 < -0.095)::int) over (partition by symbol order by trade_date rows 4 preceding) = 1 as limit_down, rnd((final - hi) / hi * 100, 6) as drawdown, rnd(case when bv > 0 then volume / bv else 1 end, 6) as vol_ratio from a),
s as (select *, (drawdown < -5)::int + 2 * (drawdown < -10)::int + case when vol_ratio > 1.2 then 1 when vol_ratio < 0.8 then -1 else 0 end + (down_days >= 3)::int + turned::int + 5 * limit_down::int as score from b where n = 5)
select symbol, trade_date, drawdown, vol_ratio, down_days, turned, limit_down, score, case when score >= 4 or limit_down then 'BREAKDOWN' when score <= 1 then 'PULLBACK' else 'NEUTRAL' end as class from s""", "looks")
def i5(spark, sf):
    return sc.breakdown(looks(spark, sf))


@query("i7_recovery", """
with a as (select *, case when count(*) over w = 20 then min(low) over w end as low20 from looks window w as (partition by symbol order by trade_date rows 19 preceding)), r as (select *, rnd((final - low20) / low20 * 100, 2) as recovery_pct from a)
select symbol, trade_date, final, low20, recovery_pct, case when recovery_pct is null then null when recovery_pct < 5 then 0 when recovery_pct < 20 then 1 else 2 end as health, case when recovery_pct is null then 'NO_DATA' when recovery_pct < 0 then 'NEW_LOW' when recovery_pct < 5 then 'NOT_RECOVERED' when recovery_pct < 20 then 'RECOVERING' else 'RECOVERED' end as verdict from r""", "looks")
def i7(spark, sf):
    return sc.recovery(looks(spark, sf))


@query("i9_volume_price_signal", f"""with {_TICKDAY}, s as (select *, case when ratio is null or pct is null then 'UNKNOWN' when ratio > 2 and abs(pct) > 5 then 'PANIC' when ratio < 1.2 and abs(pct) < 4 then 'NORMAL' else 'MIXED' end as signal, case when up_share > 0.6 then 'BOUNCE' when up_share < 0.4 then 'SELLING' else 'NEUTRAL' end as minute_signal from tx_)
select symbol, day, signal, minute_signal, case when signal = 'UNKNOWN' then 'NONE' when signal = 'PANIC' and minute_signal = 'BOUNCE' then 'REDUCE_ON_BOUNCE' when signal = 'PANIC' then 'CLEAR' when minute_signal = 'BOUNCE' then 'HOLD' when minute_signal = 'SELLING' then 'HALVE' when signal = 'NORMAL' then 'WATCH' else 'NEED_MINUTES' end as action from s""", "ticks")
def i9(spark, sf):
    signal, minute, action = sc.volume_price_signal(F.col("ratio"), F.col("pct"), F.col("up_share"))
    return _tick_days(spark, sf).select("symbol", "day", signal.alias("signal"), minute.alias("minute_signal"), action.alias("action"))


_FLOW = "case when pct is null then 'NO_DATA' when pct > 5 and lr > 1.3 then 'INFLOW' when pct > 2 and lr > 1.1 then 'LEANING_IN' when pct < -5 and lr > 1.3 then 'OUTFLOW' when pct < -2 and lr > 1.1 then 'LEANING_OUT' when abs(pct) < 1 and lr < 0.8 then 'WAITING' else 'NEUTRAL' end"


@query("i10_flow_inference", f"with {_MOVED} select symbol, trade_date, {_FLOW} as flow from mv_", "looks")
def i10(spark, sf):
    return moved(spark, sf).select("symbol", "trade_date", sc.flow_inference(F.col("pct"), F.col("lr")).alias("flow"))


_ACC = """
ac_ as (select *, buy / volume as b, sell / volume as s, sum(case when pct > 0 then volume end) over w5 / sum(volume) over w5 as day_up, last >= 0.95 * max(last) over (partition by symbol order by day rows 19 preceding) as near_high from tx_ window w5 as (partition by symbol order by day rows 4 preceding)),
ad_ as (select *, greatest(-5, least(5, case when b > 0.6 then 2 when b > 0.52 then 1 when s > 0.6 then -2 when s > 0.52 then -1 else 0 end + case when up_share > 0.6 then 1 when up_share < 0.4 then -1 else 0 end + case when day_up > 0.6 then 1 when day_up < 0.4 then -1 else 0 end
  + (coalesce(ratio > 1.5, false) and not near_high)::int - (coalesce(ratio > 1.5, false) and near_high)::int)) as score from ac_)"""


@query("i11_accumulation", f"with {_TICKDAY}, {_ACC} select symbol, day, score, case when score >= 3 then 'ACCUMULATION_STRONG' when score >= 1 then 'ACCUMULATION' when score <= -3 then 'DISTRIBUTION_STRONG' when score <= -1 then 'DISTRIBUTION' else 'TURNOVER' end as verdict from ad_", "ticks")
def i11(spark, sf):
    w = Window.partitionBy("symbol").orderBy("day")
    w5 = w.rowsBetween(-4, 0)
    x = _tick_days(spark, sf).withColumn("day_up", F.sum(F.when(F.col("pct") > 0, F.col("volume"))).over(w5) / F.sum("volume").over(w5)).withColumn("near_high", F.col("last") >= 0.95 * F.max("last").over(w.rowsBetween(-19, 0)))
    score, verdict = sc.accumulation(F.col("buy") / F.col("volume"), F.col("sell") / F.col("volume"), F.col("up_share"), F.col("day_up"), F.col("ratio"), F.col("near_high"))
    return x.select("symbol", "day", score.alias("score"), verdict.alias("verdict"))


_REL = """
ip_ as (select trade_date, ("close" / lag("close") over (order by trade_date) - 1) * 100 as ipct from index_bars),
rs_ as (select v.symbol, v.trade_date, v.pct, m.industry_code, rnd(v.pct - ipct, 2) as vs_index, rnd(v.pct - sb.pct, 2) as vs_sector from mv_ v join ip_ using (trade_date) join membership m on m.symbol = v.symbol and m.effective_from <= v.trade_date and (m.effective_to is null or m.effective_to > v.trade_date)
  join sb on sb.name = m.industry_code and sb.trade_date = v.trade_date where v.pct is not null and ipct is not null)"""


def _relative(spark, sf):
    w = Window.orderBy("trade_date")
    i = fx.index_bars(spark, sf).select("trade_date", ((F.col("close") / F.lag("close").over(w) - 1) * 100).alias("ipct")).filter("ipct is not null")  # one row a day
    m = fx.membership(spark, sf).withColumnRenamed("symbol", "s").drop("available_time")
    v = moved(spark, sf).select("symbol", "trade_date", "pct").filter("pct is not null")
    held = (F.col("s") == F.col("symbol")) & (F.col("effective_from") <= F.col("trade_date")) & (F.col("effective_to").isNull() | (F.col("effective_to") > F.col("trade_date")))
    b = _board(spark, sf).select(F.col("name").alias("industry_code"), "trade_date", F.col("pct").alias("spct"))
    x = v.join(i, "trade_date").join(m, held).join(b, ["industry_code", "trade_date"])
    return x.select("symbol", "trade_date", "pct", "industry_code", rnd(F.col("pct") - F.col("ipct"), 2).alias("vs_index"), rnd(F.col("pct") - F.col("spct"), 2).alias("vs_sector"))


@query("i12_relative_strength", f"""with {_MOVED}, {_BOARD}, {_REL} select symbol, trade_date, vs_index, vs_sector, case when vs_index > 2 then 'MUCH_STRONGER' when vs_index > 0 then 'STRONGER' when vs_index < -2 then 'MUCH_WEAKER' else 'WEAKER' end as index_tier,
case when vs_sector > 2 then 'LEADS' when vs_sector > 0 then 'ABOVE' when vs_sector < -2 then 'LAGS' else 'BELOW' end as sector_tier from rs_""", "looks settled membership index_bars")
def i12(spark, sf):
    x = _relative(spark, sf)
    return x.select("symbol", "trade_date", "vs_index", "vs_sector", sc.relative_tier(F.col("vs_index"), ("MUCH_STRONGER", "STRONGER", "MUCH_WEAKER", "WEAKER")).alias("index_tier"), sc.relative_tier(F.col("vs_sector"), ("LEADS", "ABOVE", "LAGS", "BELOW")).alias("sector_tier"))


_BANDS = """
bd_ as (select symbol, trade_date, final, rnd(case when n20 = 20 then m + 2 * s end, 2) as boll_up, rnd(case when n20 = 20 then m - 2 * s end, 2) as boll_low, case when n60 = 60 then hi end as high60, case when n60 = 60 then lo end as low60 from (select *, count(*) over a as n20, avg(final) over a as m, stddev_pop(final) over a as s, count(*) over b as n60, max(high) over b as hi, min(low) over b as lo
  from looks window a as (partition by symbol order by trade_date rows 19 preceding), b as (partition by symbol order by trade_date rows 59 preceding))),
be_ as (select *, case when high60 > low60 then [rnd(high60 - (high60 - low60) * r, 2) for r in [0.236::double, 0.382::double, 0.5::double, 0.618::double, 0.786::double]] end as fib, greatest(10, pow(10, len(cast(floor(final)::bigint as varchar)) - 1)::int) as size from bd_)"""


@query("f21_bands", f"""with {_BANDS} select symbol, trade_date, boll_up, boll_low, high60, low60, array_to_string([cast(cast(floor(x * 100 + 0.5) as bigint) as varchar) for x in fib], ',') as fib,
array_to_string([cast(v as varchar) for v in [(floor(floor(final) / size) * size + k * size)::bigint for k in [-2, -1, 0, 1, 2]] if v > 0 and v <> floor(final)], ',') as round_numbers from be_""", "looks")
def f21(spark, sf):
    x = sc.bands(looks(spark, sf))
    return x.select("symbol", "trade_date", "boll_up", "boll_low", "high60", "low60", F.array_join(F.transform("fib", lambda v: F.floor(v * 100 + 0.5).cast("long").cast("string")), ",").alias("fib"), F.array_join(F.transform("round_numbers", lambda v: v.cast("string")), ",").alias("round_numbers"))


_CAND = ["ma5", "ma10", "ma20", "ma60", "boll_up", "boll_low", "high60", "low60"]
_LEVELS = f"""{_MOVED}, {_BANDS},
lv_ as (select v.symbol, v.trade_date, v.final, ma20, list_distinct(list_filter([{', '.join(f'floor({c} * 10 + 0.5) / 10' for c in _CAND)}], lambda x: x is not null)) as every from mv_ v join be_ b using (symbol, trade_date)),
ls_ as (select *, list_reverse_sort([x for x in every if x < final])[1:8] as support, list_sort([x for x in every if x > final])[1:8] as resistance from lv_)"""
_TEXT = "array_to_string([cast(cast(floor(x * 10 + 0.5) as bigint) as varchar) for x in {}], ',')"


def _leveled(spark, sf):
    b = sc.bands(looks(spark, sf)).select("symbol", "trade_date", "boll_up", "boll_low", "high60", "low60")
    return sc.levels(moved(spark, sf).join(b, ["symbol", "trade_date"]), _CAND)


@query("i13_levels", f"with {_LEVELS} select symbol, trade_date, {_TEXT.format('support')} as support, {_TEXT.format('resistance')} as resistance, rnd(ma20 * 0.98, 4) as stop from ls_", "looks")
def i13(spark, sf):
    said = lambda c: F.array_join(F.transform(c, lambda v: F.floor(v * 10 + 0.5).cast("long").cast("string")), ",").alias(c)
    return _leveled(spark, sf).select("symbol", "trade_date", said("support"), said("resistance"), rnd(F.col("ma20") * 0.98, 4).alias("stop"))


@query("i14_trade_plans", f"""with {_LEVELS}, p as (select *, support[1] as pullback_entry, rnd(resistance[1] * 1.005::double, 4) as breakout_entry, rnd(least(ma20 * 0.98::double, coalesce(support[1] * 0.98::double, ma20 * 0.98::double)), 4) as stop, rnd(coalesce(resistance[2], resistance[1] * 1.05::double), 4) as target from ls_ where ma20 is not null),
q as (select *, rnd(case when final > stop then (target - final) / (final - stop) end, 4) as reward_risk from p)
select symbol, trade_date, pullback_entry, breakout_entry, stop, target, reward_risk, coalesce(reward_risk < 1.5, true) as blocked from q""", "looks")
def i14(spark, sf):
    x = sc.trade_plan(_leveled(spark, sf).filter("ma20 is not null"), F.col("ma20") * 0.98)
    return x.select("symbol", "trade_date", "pullback_entry", "breakout_entry", "stop", "target", "reward_risk", "blocked")


_ADVICE = f"""{_MOVED}, rc_ as (select symbol, trade_date, rnd((final - low20) / low20 * 100, 2) as rec from (select *, case when count(*) over w = 20 then min(low) over w end as low20 from looks window w as (partition by symbol order by trade_date rows 19 preceding))),
pt_ as (select v.symbol, v.trade_date, v.final, v.pct, v.lr, v.ma20, rec, case when final > ma5 and ma5 > ma10 and ma10 > ma20 and ma20 > ma60 then 2 when final > ma20 and final > ma60 then 1 when final < ma5 and ma5 < ma10 and ma10 < ma20 then -2 else 0 end as tp,
  case when lr > 1.1 and pct > 0 then 1 when lr < 0.9 then -1 when pct < -3 and lr > 1.3 then -2 else 0 end as vp, case when rec is null then 0 when rec < 5 then 0 when rec < 20 then 1 else 2 end as rp, coalesce(pct < -3 and lr > 1.3, false) as dist from mv_ v join rc_ using (symbol, trade_date) where ma60 is not null),
av_ as (select *, greatest(1, least(10, 5 + tp + vp + rp - case when dist then 2 else 0 end)) as score from pt_),
aw_ as (select *, case when score >= 8 then 'BUY' when score >= 6 then 'HOLD_ADD' when score >= 4 then 'HOLD' when score >= 2 then 'REDUCE' else 'CLEAR' end as a0 from av_)"""


def _advised(spark, sf):
    r = sc.recovery(looks(spark, sf)).select("symbol", "trade_date", "recovery_pct", "health")
    x = moved(spark, sf).join(r, ["symbol", "trade_date"]).filter("ma60 is not null")
    p, m5, m10, m20, m60, lr, pct = (F.col(c) for c in ("final", "ma5", "ma10", "ma20", "ma60", "lr", "pct"))
    trend = F.when((p > m5) & (m5 > m10) & (m10 > m20) & (m20 > m60), 2).when((p > m20) & (p > m60), 1).when((p < m5) & (m5 < m10) & (m10 < m20), -2).otherwise(0)
    volume = F.when((lr > 1.1) & (pct > 0), 1).when(lr < 0.9, -1).when((pct < -3) & (lr > 1.3), -2).otherwise(0)
    distribution = F.coalesce((pct < -3) & (lr > 1.3), F.lit(False))
    score, action = sc.advice(trend + volume + F.coalesce("health", F.lit(0)) - sc.one(distribution, 2), distribution)
    return x.withColumn("score", score).withColumn("action", action)


@query("i15_advice", f"with {_ADVICE} select symbol, trade_date, score, case when dist and a0 in ('BUY', 'HOLD_ADD') then 'HOLD' else a0 end as action from aw_", "looks")
def i15(spark, sf):
    return _advised(spark, sf).select("symbol", "trade_date", "score", "action")


@query("i18_reversal", """
with f as (select payload_id, payload_id % 2 = 0 as a, payload_id % 3 = 0 as b, case when payload_id % 11 = 0 then null else payload_id % 4 < 2 end as c, payload_id % 5 < 2 as d, fallback as e, is_stale as g, data > 50 as h, payload_id % 7 < 3 as i, payload_id % 4 as shock from payloads),
s as (select payload_id, shock, 2 * a::int + 2 * b::int + 2 * coalesce(c, false)::int + 2 * d::int + coalesce(e, false)::int + coalesce(g, false)::int + 2 * coalesce(h, false)::int + i::int as score from f)
select payload_id, score, case when score >= t then 'HIGH' when score >= t - 2 then 'MEDIUM' else 'LOW' end as level from (select *, case when shock >= 2 then 10 else 7 end as t from s)""", "payloads")
def i18(spark, sf):
    i = F.col("payload_id")
    flags = {"extreme_sentiment": i % 2 == 0, "low_open_shrink": i % 3 == 0, "decline_narrowing": F.when(i % 11 != 0, i % 4 < 2), "weights_stable": i % 5 < 2, "etf_surge": F.col("fallback"), "northbound": F.col("is_stale"), "bottom_divergence": F.col("data") > 50, "vwap_break": i % 7 < 3}
    score, level = sc.reversal(i % 4)
    return fx.payloads(spark, sf).select("payload_id", *[v.alias(k) for k, v in flags.items()]).select("payload_id", score.alias("score"), level.alias("level"))


@query("i20_sell_rules", f"with {_MOVED} select symbol, trade_date, case when final <= ma20 * 0.98::double then 'MUST_SELL' when coalesce(pct < -5, false) then 'LOGIC_BROKEN' when extract(day from trade_date) % 9 = 0 then 'MARKET_RISK' when ma20 is null then 'NO_CARD' else 'PLAIN' end as rule from mv_", "looks")
def i20(spark, sf):
    rule = sc.sell_rule(F.col("final"), F.col("ma20") * 0.98, F.coalesce(F.col("pct") < -5, F.lit(False)), F.dayofmonth("trade_date") % 9 == 0)
    return moved(spark, sf).select("symbol", "trade_date", rule.alias("rule"))


_MACRO = "mc_ as (select payload_id, case when payload_id % 8 = 0 then null else (data - 50) / 20 end as usdjpy, (payload_id % 9 - 4) / 5.0::double as usdcny, 4.4::double + (payload_id % 10) / 10.0::double as y30, (payload_id % 7 - 3) / 1.5::double as gold, case when payload_id % 6 = 0 then null else (payload_id % 11 - 6)::double end as nikkei from payloads)"


def _macro(spark, sf):
    i = F.col("payload_id")
    return fx.payloads(spark, sf).select(
        "payload_id", "symbol", "warning", "note", F.when(i % 8 != 0, (F.col("data") - 50) / 20).alias("usdjpy"), ((i % 9 - 4) / 5.0).alias("usdcny"), (4.4 + (i % 10) / 10.0).alias("y30"), ((i % 7 - 3) / 1.5).alias("gold"), F.when(i % 6 != 0, (i % 11 - 6).cast("double")).alias("nikkei"),
    )


@query("i21_stress", f"""with {_MACRO}, s as (select payload_id, least(3, case when abs(usdjpy) > 1.5 then 2 when abs(usdjpy) > 0.8 then 1 else 0 end + (usdcny > 0.3)::int) as fx_carry, case when y30 > 5 then 2 when y30 > 4.7 then 1 else 0 end as usd_stress, (gold > 1)::int + coalesce(nikkei < -2, false)::int as cross_asset, case when usdjpy < -1.5 and nikkei < -2 then 2 else 0 end as pattern from mc_)
select *, case when fx_carry + usd_stress + cross_asset + pattern >= 6 then 3 when fx_carry + usd_stress + cross_asset + pattern >= 4 then 2 when fx_carry + usd_stress + cross_asset + pattern >= 2 then 1 else 0 end as level from s""", "payloads")
def i21(spark, sf):
    parts, level = sc.stress(*[F.col(c) for c in ("usdjpy", "usdcny", "y30", "gold", "nikkei")])
    return _macro(spark, sf).select("payload_id", *[p.alias(n) for p, n in zip(parts, ("fx_carry", "usd_stress", "cross_asset", "pattern"))], level.alias("level"))


@query("i22_macro_layers", """
with d as (select doc_id, lower(coalesce(text, '')) as notes, doc_id % 20 - 2 as meeting_in, 4.4::double + (doc_id % 10) / 10.0::double as y30, 4.0::double + (doc_id % 8) / 10.0::double as y10, (doc_id % 7 - 5)::double as a, (doc_id % 5 - 3)::double as b, case when doc_id % 3 = 0 then null else (doc_id % 11 - 4)::double end as c, doc_id % 4 - 1 as research from documents)
select doc_id, case when meeting_in between 0 and 3 then 2 when meeting_in between 4 and 14 then 1 else 0 end as meeting, least(3, case when y30 > 5 then 2 when y30 > 4.7 then 1 else 0 end + (y10 > 4.5)::int) as rates,
greatest(0, least(3, least(3, (len(notes) - len(replace(notes, 'the', ''))) // 3) + 2 * least(3, (len(notes) - len(replace(notes, 'ing', ''))) // 3) - 2 * least(3, (len(notes) - len(replace(notes, 'und', ''))) // 3))) as keywords,
least(2, (a < -2)::int + (b < -2)::int + coalesce(c < -2, false)::int) as region, greatest(0, least(2, research)) as research_score from d""")
def i22(spark, sf):
    i = F.col("doc_id")
    d = fx.table(spark, sf, "documents").select(
        "doc_id", F.col("text").alias("notes"), (i % 20 - 2).alias("meeting_in"), (4.4 + (i % 10) / 10.0).alias("y30"), (4.0 + (i % 8) / 10.0).alias("y10"), (i % 7 - 5).cast("double").alias("asia_a"), (i % 5 - 3).cast("double").alias("asia_b"), F.when(i % 3 != 0, (i % 11 - 4).cast("double")).alias("asia_c"), (i % 4 - 1).alias("research"),
    )
    return d.select("doc_id", *sc.macro_layers(d, {"the": 1, "ing": 2, "und": -2}))


@query("i23_shock_adjust", f"with {_MACRO} select payload_id, greatest(0, least(3, case when coalesce(nikkei > 1.5 and gold > 1.5, false) then payload_id % 4 - 1 when coalesce(nikkei < -1.5, false) then payload_id % 4 + 1 else payload_id % 4 end)) as shock from mc_", "payloads")
def i23(spark, sf):
    return _macro(spark, sf).select("payload_id", sc.shock_adjust(F.col("payload_id") % 4, F.col("nikkei"), F.col("gold")).alias("shock"))


GOOD, BAD = ["the", "tion", "ing"], ["und", "que", "ent"]


def _lex(words: list[str]) -> str:
    return f"({' or '.join(f"contains(t, '{w}')" for w in words)})::int + " + " + ".join(f"least(2, (len(t) - len(replace(t, '{w}', ''))) // {len(w)})" for w in words)


@query("i24_sentiment", f"""
with p as (select source, doc_id, coalesce(text, '') as t, row_number() over (partition by source, substr(text, 1, 50) order by doc_id) as rn from documents), s as (select source, greatest(-2, least(2, {_lex(GOOD)} - ({_lex(BAD)}))) as s from p where rn = 1),
g as (select source, count(*) as n, count(*) filter (s > 0) as pos, count(*) filter (s < 0) as neg, greatest(-100, least(100, trunc(sum(s) * 100.0::double / count(*))))::bigint as score from s group by source)
select *, case when score >= 40 then 'OVERHEATED' when score >= 15 then 'WARM' when score > -15 then 'NEUTRAL' when score > -40 then 'COOL' else 'FREEZING' end as label from g""")
def i24(spark, sf):
    return sc.sentiment(fx.table(spark, sf, "documents").select("source", "doc_id", "text"), "source", "text", "doc_id", GOOD, BAD)


@query("i25_calendar_risk", """
with d as (select distinct trade_date as day from bars), f as (select *, date_trunc('month', day)::date as m0, (date_trunc('month', day) + interval 1 month)::date as m1 from d),
t as (select *, m0 + ((5 - isodow(m0) + 7) % 7)::int + 14 as t0, m1 + ((5 - isodow(m1) + 7) % 7)::int + 14 as t1 from f),
h as (select *, (case when t0 >= day then t0 else t1 end) - day as to_third_friday, least(case when make_date(year(day), 10, 1) >= day then make_date(year(day), 10, 1) else make_date(year(day) + 1, 10, 1) end - day, case when make_date(year(day), 2, 10) >= day then make_date(year(day), 2, 10) else make_date(year(day) + 1, 2, 10) end - day, case when make_date(year(day), 1, 1) >= day then make_date(year(day), 1, 1) else make_date(year(day) + 1, 1, 1) end - day) as to_holiday from t)
select day, to_third_friday, to_holiday, extract(day from day) >= 26 as month_end, case when (to_third_friday <= 14)::int + (to_holiday <= 14)::int >= 2 then 'MEDIUM' when to_third_friday > 14 and to_holiday > 14 and extract(day from day) < 26 then 'LOW' else 'MEDIUM_LOW' end as level, day + case isodow(day) when 5 then 3 when 6 then 2 else 1 end as next_weekday from h""", "bars")
def i25(spark, sf):
    return sc.calendar_risk(fx.bars(spark, sf).select(F.col("trade_date").alias("day")).distinct()).withColumns({c: F.col(c).cast("long") for c in ("to_third_friday", "to_holiday")})


_SNAP = "sn_ as (select symbol, max(trade_date) as trade_date from mv_ group by symbol)"


@query("i26_daily_snapshot", f"with {_MOVED}, {_SNAP} select v.symbol, v.trade_date, final, ma5, ma10, ma20, ma60, lr, rnd((final / ma20 - 1) * 100, 2) as ma20_dist, case when v.symbol like '%5' then 'swing' else 'core' end as role, rnd(final * (1 + case when v.symbol like '%5' then -0.03::double else -0.05::double end), 2) as stop_loss from mv_ v join sn_ using (symbol, trade_date)", "looks")
def i26(spark, sf):
    m = moved(spark, sf)
    last = m.groupBy("symbol").agg(F.max_by(F.struct(*[c for c in m.columns if c != "symbol"]), "trade_date").alias("r")).select("symbol", "r.*")
    swing = F.col("symbol").like("%5")
    return last.select("symbol", "trade_date", "final", "ma5", "ma10", "ma20", "ma60", "lr", rnd((F.col("final") / F.col("ma20") - 1) * 100, 2).alias("ma20_dist"), F.when(swing, "swing").otherwise("core").alias("role"), rnd(F.col("final") * (1 + F.when(swing, -0.03).otherwise(-0.05)), 2).alias("stop_loss"))


@query("i27_pool_diagnosis", f"""with {_ADVICE}, {_SNAP} select a.symbol, a.trade_date, score, case when dist and a0 in ('BUY', 'HOLD_ADD') then 'HOLD' else a0 end as action, rec as recovery_pct, {_FLOW} as flow, concat_ws(',', case when t.symbol is null then 'NO_TICKS' end, case when lr is null then 'NO_VOLUME' end) as gaps
from aw_ a join sn_ using (symbol, trade_date) left join (select distinct symbol from ticks) t on t.symbol = a.symbol""", "looks ticks")
def i27(spark, sf):
    a = _advised(spark, sf)
    last = a.groupBy("symbol").agg(F.max_by(F.struct("trade_date", "score", "action", "recovery_pct", "pct", "lr"), "trade_date").alias("r")).select("symbol", "r.*")
    t = fx.ticks(spark, sf).select("symbol").distinct().withColumn("ticked", F.lit(True))
    gaps = F.array_join(F.array_compact(F.array(F.when(F.col("ticked").isNull(), "NO_TICKS"), F.when(F.col("lr").isNull(), "NO_VOLUME"))), ",")
    return last.join(t, "symbol", "left").select("symbol", "trade_date", "score", "action", "recovery_pct", sc.flow_inference(F.col("pct"), F.col("lr")).alias("flow"), gaps.alias("gaps"))


@query("f11_fundamental_pack", """
with f as (select p_partkey as k, case when p_partkey % 9 = 0 then null else p_size / 50.0::double end as roe, p_size / 60.0::double as roic, (p_partkey % 13) / 10.0::double as ocf, (p_partkey % 7) / 10.0::double as debt, (p_partkey % 100) / 100.0::double as pe, case when p_partkey % 5 = 0 then null else (p_partkey % 90) / 100.0::double end as pb from part)
select k, rnd(0.3 * roe + 0.3 * roic + 0.2 * ocf - 0.2 * debt, 9) as quality, rnd(-(pe + pb) / 2, 9) as valuation from f""")
def f11(spark, sf):
    k = F.col("p_partkey")
    f = fx.table(spark, sf, "part").select(k.alias("k"), F.when(k % 9 != 0, F.col("p_size") / 50.0).alias("roe"), (F.col("p_size") / 60.0).alias("roic"), ((k % 13) / 10.0).alias("ocf_to_profit"), ((k % 7) / 10.0).alias("debt_ratio"), ((k % 100) / 100.0).alias("pe_percentile"), F.when(k % 5 != 0, (k % 90) / 100.0).alias("pb_percentile"))
    return fa.fundamental(f).select("k", rnd("quality").alias("quality"), rnd("valuation").alias("valuation"))


_INPUTS = f"""{_BOARD},
br_ as (select trade_date, rnd((count(*) filter (r >= 0) - count(*) filter (r < 0))::double / count(*), 9) as breadth, rnd((count(*) filter (r * 100 >= 9.8) - count(*) filter (r * 100 <= -9.8))::double / count(*), 9) as limit_pressure from near where i = own_i and r is not null group by trade_date),
ds_ as (select trade_date, case when count(*) >= 2 then rnd(stddev_pop(pct), 6) end as dispersion from sb group by trade_date),
ix_ as (select trade_date, ("close" / lag("close") over (order by trade_date) - 1) * 100 as pct, case when count(*) over w = 20 then "close" > avg("close") over w end as above from index_bars window w as (order by trade_date rows 19 preceding)),
in_ as (select i.trade_date, rnd(case when above is not null then case when above then 1 else -1 end + greatest(-1, least(1, coalesce(pct, 0) / 3)) end, 9) as index_trend, breadth, limit_pressure, dispersion, case when extract(day from i.trade_date) % 4 = 0 then null else dispersion - 2 end as volatility_z from ix_ i left join br_ using (trade_date) left join ds_ using (trade_date))"""


def _inputs(spark, sf):
    w = Window.orderBy("trade_date")  # one row a day
    w20 = w.rowsBetween(-19, 0)
    i = fx.index_bars(spark, sf).select("trade_date", ((F.col("close") / F.lag("close").over(w) - 1) * 100).alias("pct"), F.when(F.count(F.lit(1)).over(w20) == 20, F.col("close") > F.avg("close").over(w20)).alias("above"))
    trend = F.when(F.col("above").isNotNull(), F.when(F.col("above"), 1).otherwise(-1) + F.greatest(F.lit(-1), F.least(F.lit(1), F.coalesce("pct", F.lit(0)) / 3)))
    b = pit.breadth(pit.own_returns(fx.late_bars(spark, sf)), F.col("r") * 100, "trade_date").select("trade_date", "breadth", "limit_pressure")
    n = F.count("*")
    d = _board(spark, sf).groupBy("trade_date").agg(F.when(n >= 2, rnd(F.stddev_pop("pct"), 6)).alias("dispersion"))
    x = i.select("trade_date", rnd(trend).alias("index_trend")).join(b, "trade_date", "left").join(d, "trade_date", "left")
    return x.withColumn("volatility_z", F.when(F.dayofmonth("trade_date") % 4 != 0, F.col("dispersion") - 2))


@query("f25_regime_inputs", f"with {_INPUTS} select *, concat_ws(',', case when index_trend is null then 'index_trend' end, case when breadth is null then 'breadth' end, case when volatility_z is null then 'volatility_z' end, case when dispersion is null then 'sector_dispersion' end, case when limit_pressure is null then 'limit_pressure' end, 'turnover_z', 'liquidity') as missing from in_", "settled membership index_bars near")
def f25(spark, sf):
    names = {"index_trend": "index_trend", "breadth": "breadth", "volatility_z": "volatility_z", "dispersion": "sector_dispersion", "limit_pressure": "limit_pressure"}
    gone = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(n)) for c, n in names.items()], F.lit("turnover_z"), F.lit("liquidity")))
    return _inputs(spark, sf).withColumn("missing", F.array_join(gone, ","))


@query("f26_classify_regime", f"""with {_INPUTS}, m as (select *, (index_trend is null)::int + (breadth is null)::int + (volatility_z is null)::int + (dispersion is null)::int + (limit_pressure is null)::int + 2 as missing from in_)
select trade_date, missing, case when missing >= 4 or volatility_z is null then 'UNKNOWN' when coalesce(volatility_z, 0) >= 2 then 'HIGH_VOL' when coalesce(index_trend, 0) >= 1 and coalesce(breadth, 0) >= 0.5 then 'TREND_UP' when coalesce(index_trend, 0) <= -1 and coalesce(breadth, 0) <= -0.5 then 'TREND_DOWN' else 'RANGE' end as regime,
case when missing >= 4 or volatility_z is null then 0 else rnd(1 - missing / 7.0::double, 4) end as confidence from m""", "settled membership index_bars near")
def f26(spark, sf):
    none = F.lit(None).cast("double")
    inputs = (F.col("index_trend"), F.col("breadth"), none, F.col("volatility_z"), F.col("dispersion"), F.col("limit_pressure"), none)
    missing = sum((c.isNull().cast("int") for c in inputs), F.lit(0))
    x = _inputs(spark, sf).select("trade_date", missing.alias("missing"), pf.regime(*inputs).alias("regime"))
    return x.withColumn("confidence", F.when(F.col("regime") == "UNKNOWN", 0.0).otherwise(rnd(1 - F.col("missing") / 7.0, 4)))


@query("l5_normalize_frame", """
with q as (select *, quantile_cont(momentum, 0.05) over (partition by trade_date) as a, quantile_cont(momentum, 0.95) over (partition by trade_date) as b from design), c as (select symbol, trade_date, least(greatest(momentum, a), b) as m from q)
select symbol, trade_date, rnd(case when stddev_pop(m) over w > 1e-12 then (m - avg(m) over w) / stddev_pop(m) over w else 0 end, 6) as momentum from c window w as (partition by trade_date)""", "design")
def l5(spark, sf):
    d = fa.design_rows(fx.bars(spark, sf)).select("symbol", "trade_date", "momentum")
    return me.normalize_frame(d, ["momentum"], ["trade_date"]).withColumn("momentum", rnd("momentum", 6))


@query("l6_train_scaler", """
with t as (select symbol, quantile_cont(momentum, 0.05) as lo, quantile_cont(momentum, 0.95) as hi from design where trade_date < date '1996-01-01' group by symbol), c as (select d.symbol, d.trade_date, least(greatest(momentum, lo), hi) as m, momentum as raw, lo, hi from design d join t using (symbol)),
s as (select symbol, avg(m) as mu, stddev_pop(m) as sd from c where trade_date < date '1996-01-01' group by symbol)
select symbol, trade_date, rnd(case when sd > 0 then (m - mu) / sd else 0 end, 6) as momentum, rnd(case when sd > 0 then (m - mu) / sd else 0 end * case when sd > 0 then (m - mu) / sd else 0 end, 5) as momentum_sq from c join s using (symbol) where trade_date >= date '1996-01-01'""", "design")
def l6(spark, sf):
    d = fa.design_rows(fx.bars(spark, sf)).select("symbol", "trade_date", "momentum")
    x = me.train_scaler(d.filter("trade_date < '1996-01-01'"), d.filter("trade_date >= '1996-01-01'"), ["momentum"], ["symbol"])
    return x.select("symbol", "trade_date", rnd("momentum", 6).alias("momentum"), rnd(F.col("momentum") * F.col("momentum"), 5).alias("momentum_sq"))


@query("g4_backfill_outcomes", """
with l as (select symbol, trade_date, look, lead(look, 1) over w as a1, lead(look, 3) over w as a3, lead(look, 5) over w as a5, lead(look, 10) over w as a10 from settled window w as (partition by symbol order by trade_date))
select symbol, trade_date, h as horizon, rnd(a / look - 1, 9) as realized_return from (select symbol, trade_date, look, unnest([1, 3, 5, 10]) as h, unnest([a1, a3, a5, a10]) as a from l where extract(day from trade_date) = 10) where a is not null""", "settled")
def g4(spark, sf):
    w = Window.partitionBy("symbol").orderBy("trade_date")
    each = F.array(*[F.struct(F.lit(h).alias("horizon"), F.lead("final", h).over(w).alias("ahead")) for h in (1, 3, 5, 10)])
    x = looks(spark, sf).withColumn("each", each).filter(F.dayofmonth("trade_date") == 10).select("symbol", "trade_date", "final", F.inline("each")).filter("ahead is not null")
    return x.select("symbol", "trade_date", "horizon", rnd(F.col("ahead") / F.col("final") - 1).alias("realized_return"))


@query("g9_review_windows", """
with w as (select symbol, trade_date as start_day, lead(trade_date, 5) over (partition by symbol order by trade_date) as end_day, case when extract(day from trade_date) = 3 then 0 else 5 end as horizon from looks)
select symbol, start_day, end_day, horizon, case when end_day is null then 'OPEN' when horizon <= 0 or end_day < start_day then 'INVALID' else 'OK' end as status from w""", "looks")
def g9(spark, sf):
    end = F.lead("trade_date", 5).over(Window.partitionBy("symbol").orderBy("trade_date"))
    x = looks(spark, sf).select("symbol", F.col("trade_date").alias("start_day"), end.alias("end_day"), F.when(F.dayofmonth("trade_date") == 3, 0).otherwise(5).alias("horizon"))
    return x.withColumn("status", F.when(F.col("end_day").isNull(), "OPEN").when((F.col("horizon") <= 0) | (F.col("end_day") < F.col("start_day")), "INVALID").otherwise("OK"))
