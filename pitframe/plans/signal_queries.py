"""Queries over rule columns of daily bars and over fitted calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..fixtures import rnd
from ..operators import calibrate as ca
from ..operators import metrics as me
from ..operators import signals as si
from ..sources.scratch import stored
from .metric_queries import BLOCK
from .registry import query

SPLIT = "1999-01-01"
_MEAN = lambda c, n, w: f"case when count(*) over ({w} rows {n - 1} preceding) = {n} then avg({c}) over ({w} rows {n - 1} preceding) end"
_O = "partition by symbol order by trade_date"
_MOVED = "mv_ as (select symbol, trade_date, final, high, volume, " + ", ".join(f"rnd({_MEAN('final', n, _O)}, 6) as ma{n}" for n in (5, 10, 20, 60)) + f""",
  rnd(volume / {_MEAN('volume', 20, _O)}, 6) as lr, rnd((final / lag(final) over ({_O}) - 1) * 100, 6) as pct from looks)"""


def looks(spark, sf):
    """One row a symbol and day as the day's own decision saw it, so that no rule over them looks ahead; the close is named final."""
    seen = F.col("available_time") <= F.col("trade_date").cast("timestamp_ntz") + fx.hours(8)
    x = fx.bars(spark, sf).filter(seen).groupBy("symbol", "trade_date").agg(F.max_by(F.struct("open", "high", "low", F.col("close").alias("final"), "volume", "amount"), "revision").alias("b"))
    return x.select("symbol", "trade_date", "b.*")


def moved(spark, sf):
    return si.moving(looks(spark, sf))


@query("f10_technical_pack", f"""
with s_ as (select *, greatest(final - lag(final) over o, 0) as up, greatest(lag(final) over o - final, 0) as down, row_number() over o as rn from looks window o as ({_O})),
t_ as (select *, avg(up) over (o rows 13 preceding) as u14, avg(down) over (o rows 13 preceding) as d14, lag(final, 5) over o as l5, lag(final, 20) over o as l20, lag(final, 60) over o as l60,
  {_MEAN('final', 5, _O)} as m5, {_MEAN('final', 20, _O)} as m20, {_MEAN('final', 60, _O)} as m60, {_MEAN('volume', 20, _O)} as v20, case when rn >= 20 then stddev_samp(volume) over (o rows 19 preceding) end as sd from s_ window o as ({_O}))
select symbol, trade_date, rnd(final / l5 - 1, 9) as ret_5, rnd(final / m5 - 1, 9) as ma_gap_5, rnd(final / l20 - 1, 9) as ret_20, rnd(final / m20 - 1, 9) as ma_gap_20, rnd(final / l60 - 1, 9) as ret_60, rnd(final / m60 - 1, 9) as ma_gap_60,
  rnd(case when sd > 0 then (volume - v20) / sd end, 6) as vol_z20, rnd(case when rn > 14 and d14 > 1e-9 then 100 - 100 / (1 + u14 / d14) end, 6) as rsi14 from t_""", "looks")
def f10(spark, sf):
    return si.technical(looks(spark, sf))


@query("f19_index_volatility_z", """
with r_ as (select * from (select trade_date, ("close" / lag("close") over (order by trade_date) - 1) * 100 as r from index_bars) where r is not null),
v_ as (select trade_date, case when row_number() over (order by trade_date) >= 20 then stddev_pop(r) over (order by trade_date rows 19 preceding) end as v from r_),
z_ as (select trade_date, v, avg(v) over b as m, stddev_pop(v) over b as s, count(v) over b as n from v_ window b as (order by trade_date rows between unbounded preceding and 1 preceding))
select trade_date, rnd(v, 6) as vol20, rnd(case when n >= 9 and s > 0 then (v - m) / s end, 4) as vol_z from z_""", "index_bars")
def f19(spark, sf):
    return si.volatility_z(fx.index_bars(spark, sf))


@query("f20_turnover_z", """
with d_ as (select trade_date, sum(amount) as amount from looks group by trade_date), z_ as (select *, avg(amount) over b as m, stddev_pop(amount) over b as s, count(amount) over b as n from d_ window b as (order by trade_date rows between 59 preceding and 1 preceding))
select trade_date, rnd(amount, 2) as amount, rnd(case when n >= 19 and s > 0 then (amount - m) / s end, 4) as turnover_z from z_""".replace("d_ as", "dd_ as").replace("from d_", "from dd_"), "looks")
def f20(spark, sf):
    return si.turnover_z(looks(spark, sf))


@query("i4_bias_risk", f"""
with {_MOVED}, b_ as (select *, rnd((final - ma5) / ma5 * 100, 2) as bias5, rnd((final - ma10) / ma10 * 100, 2) as bias10, rnd((final - ma20) / ma20 * 100, 2) as bias20, rnd((final - ma60) / ma60 * 100, 2) as bias60 from mv_)
select symbol, trade_date, bias5, bias10, bias20, bias60, case when bias5 is null then 'UNKNOWN' when greatest(bias5, bias10, bias20, bias60) > 40 then 'EXTREME_OVERHEAT'
  when coalesce(bias20, 0) > 25 or greatest(bias5, coalesce(bias10, 0)) > 30 then 'OVERHEAT' when greatest(bias5, coalesce(bias10, 0)) > 15 then 'WARM'
  when least(bias5, bias10, bias20, bias60) < -20 then 'EXTREME_OVERSOLD' when least(bias5, bias10, bias20, bias60) < -10 then 'OVERSOLD' else 'NORMAL' end as risk from b_""", "looks")
def i4(spark, sf):
    return si.bias_risk(moved(spark, sf)).select("symbol", "trade_date", "bias5", "bias10", "bias20", "bias60", "risk")


@query("i6_trend_verdict", f"""
with {_MOVED} select symbol, trade_date, case when ma60 is null then 'NO_DATA' when final > ma5 and ma5 > ma10 and ma10 > ma20 and ma20 > ma60 then 'BULL_STRONG'
  when final > ma20 and final > ma60 and ma5 > ma20 and final > ma5 then 'BULL' when final > ma20 and final > ma60 and final > ma5 then 'BULL_RESTING' when final > ma20 and final > ma60 and ma5 > ma20 then 'BULL_PULLBACK'
  when final < ma5 and ma5 < ma10 and ma10 < ma20 then 'BEAR' when final <= ma20 and final <= ma60 and ma5 < ma20 and ma20 < ma60 and final < ma5 then 'BEAR_STRONG' when abs(final - ma20) / ma20 < 0.02 then 'TANGLED' else 'MIXED' end as verdict from mv_""", "looks")
def i6(spark, sf):
    return si.trend_verdict(moved(spark, sf)).select("symbol", "trade_date", "verdict")


@query("i8_volume_regime", f"""
with {_MOVED} select symbol, trade_date, lr, pct, case when lr is null then 'UNKNOWN' when lr < 0.6 then 'FROZEN' when lr < 0.9 then 'DRY' when lr < 1.1 then 'EVEN' when lr < 1.5 then 'FULL' else 'FLOOD' end as volume_tier,
  case when pct > 3 and lr < 0.9 then 'RISE_ON_LOW_VOLUME' when pct < -3 and lr > 1.3 then 'FALL_ON_HIGH_VOLUME' when pct > 3 and lr > 1.3 then 'RISE_ON_HIGH_VOLUME' when pct > -1 and pct < 1 and lr > 1.5 then 'STALL_ON_HIGH_VOLUME' end as divergence from mv_""", "looks")
def i8(spark, sf):
    return si.volume_regime(moved(spark, sf)).select("symbol", "trade_date", "lr", "pct", "volume_tier", "divergence")


@query("i16_trend_stock", f"""
with {_MOVED}, x_ as (select *, lag(final, 1) over o as f1, lag(final, 2) over o as f2, lag(high, 1) over o as h1, lag(high, 2) over o as h2, lag(high, 3) over o as h3 from mv_ window o as ({_O}))
select symbol, trade_date, coalesce(final > ma5 and f1 > ma5 and f2 > ma5 and (high > h1)::int + (h1 > h2)::int + (h2 > h3)::int >= 2 and lr > 1.2, false) as is_trend from x_""", "looks")
def i16(spark, sf):
    return si.trend_stock(moved(spark, sf)).select("symbol", "trade_date", "is_trend")


_I = "order by trade_date"


@query("i17_index_weather", f"""
with x_ as (select trade_date, "close" as c, rnd({_MEAN('"close"', 5, _I)}, 6) as m5, rnd({_MEAN('"close"', 20, _I)}, 6) as m20, rnd({_MEAN('"close"', 60, _I)}, 6) as m60, rnd(("close" / lag("close", 19) over ({_I}) - 1) * 100, 9) as momo from index_bars),
s_ as (select trade_date, case when m60 is null then 0 else (m5 > m20)::int + (m20 > m60)::int + (c > m20)::int + case when momo > 3 then 2 when momo > 0 then 1 when momo < -5 then -2 when momo < -2 then -1 else 0 end end as trend_score from x_)
select trade_date, trend_score, case when trend_score >= 2 then 'SUNNY' when trend_score <= -3 then 'STORM' when trend_score <= -1 then 'RAIN' else 'CLOUDY' end as weather from s_""", "index_bars")
def i17(spark, sf):
    return si.index_weather(fx.index_bars(spark, sf))


@query("i19_ma20_rule", f"with {_MOVED} select symbol, trade_date, final, ma20, lr from mv_ where final < ma20 and lr > 1.2", "looks")
def i19(spark, sf):
    return si.ma20_breaks(moved(spark, sf)).select("symbol", "trade_date", "final", "ma20", "lr")


@query("i19_sector_catalyst", f"""
with {_MOVED}, s_ as (select mv_.symbol, mv_.trade_date, mv_.pct, max_by(industry_code, effective_from) as industry_code from mv_ join membership m on m.symbol = mv_.symbol and m.effective_from <= mv_.trade_date
  and m.available_time <= cast(mv_.trade_date as timestamp) + interval 8 hour where pct > 5 group by all)
select trade_date, industry_code, count(distinct symbol) as risers from s_ group by all having count(distinct symbol) >= 2""", "looks membership")
def i19_sector(spark, sf):
    at = F.col("trade_date").cast("timestamp_ntz") + fx.hours(8)
    up = moved(spark, sf).filter("pct > 5").select("symbol", "trade_date", "pct")
    placed = up.join(fx.membership(spark, sf), "symbol").filter((F.col("effective_from") <= F.col("trade_date")) & (F.col("available_time") <= at))
    placed = placed.groupBy("symbol", "trade_date", "pct").agg(F.max_by("industry_code", "effective_from").alias("industry_code"))
    return si.sector_catalysts(placed, "industry_code")


def _sides(spark, sf):
    p = stored(fx.predictions(spark, sf).filter("variant = 'baseline'").select("symbol", "trade_date", "p", "y", "baseline_p"), "predictions")  # fits read the rows several times
    return p.filter(F.col("trade_date") < SPLIT), p.filter(F.col("trade_date") >= SPLIT)


_P = f"""pr as materialized (select *, ln(q / (1 - q)) as x, case when trade_date < date '{SPLIT}' then 'discovery' else 'validation' end as slice from (select *, least(greatest(p, 1e-12), 1 - 1e-12) as q from predictions where variant = 'baseline'))"""


def _newton(slices: str, slope: float) -> str:
    """Newton's steps as a recursive query: nt has the line of each slice after i steps."""
    return f"""
xs as materialized (select slice, x, count(*) as n, sum(y)::double as s from pr group by all),
nt(slice, i, a, b, done) as (select unnest({slices}), 0, 0.0::double, {slope}::double, false
  union all select slice, i + 1, case when good then a + da else 'nan'::double end, case when good then b + db else 'nan'::double end, not good or greatest(abs(da), abs(db)) < 1e-10
  from (select *, det > 1e-12 * h00 * h00 as good, (h11 * g0 - h01 * g1) / det as da, (h00 * g1 - h01 * g0) / det as db
    from (select *, h00 * h11 - h01 * h01 as det
      from (select slice, i, a, b, sum(s - n * mu) as g0, sum((s - n * mu) * x) as g1, sum(v) as h00, sum(v * x) as h01, sum(v * x * x) as h11
        from (select nt.*, x, n, s, mu, greatest(mu * (1 - mu), 1e-9) * n as v from (select nt.*, x, n, s, 1 / (1 + exp(-least(greatest(a + b * x, -30), 30))) as mu from nt join xs using (slice) where i < 50 and not done) nt) group by slice, i, a, b))))"""


_LINE = f"""{_newton("['discovery']", 1.0)},
ln_ as (select a, b from nt order by i desc limit 1),
pl as (select symbol, trade_date, p, y, baseline_p, 1 / (1 + exp(-least(greatest(a + b * x, -30), 30))) as platt from pr, ln_ where slice = 'validation')"""
# the greatest convex minorant of the running sums: from each corner on to the point of least slope, the farthest of equals
_STEPS = """
pt as materialized (select row_number() over (order by p) as i, p, sum(n) over (order by p) as w, sum(u) over (order by p) as t from (select p, count(*)::double as n, sum(y)::double as u from pr where slice = 'discovery' group by p)),
cv(i, w, t, since, v) as (select 0::bigint, 0.0::double, 0.0::double, 0::bigint, null::double
  union all select e.i, e.w, e.t, e.since, e.v from (select min_by({'i': pt.i, 'w': pt.w, 't': pt.t, 'since': cv.i, 'v': (pt.t - cv.t) / (pt.w - cv.w)}, {'v': (pt.t - cv.t) / (pt.w - cv.w), 'o': -pt.i}) as e from cv join pt on pt.i > cv.i) where e is not null),
st as (select case when since = 0 then '-infinity'::double else pt.p end as lo, v from cv join pt on pt.i = cv.since + 1 where v is not null)"""


@query("c4_calibration_line", f"""
with recursive {_P}, {_newton("['discovery', 'validation']", 0.0)}
select slice, case when not isnan(a) then rnd(a, 7) end as intercept, case when not isnan(b) then rnd(b, 7) end as slope from (select slice, max_by(a, i) as a, max_by(b, i) as b from nt group by slice)""", "predictions")
def c4(spark, sf):
    """Intercept and slope of the discovery and validation rows, null where no unique line exists."""
    out = []
    for name, side in zip(("discovery", "validation"), _sides(spark, sf)):
        out.append((name, *ca.logistic_line(side)))
    x = spark.createDataFrame(out, "slice string, intercept double, slope double")
    return x.select("slice", *[F.when(~F.isnan(c), rnd(c, 7)).alias(c) for c in ("intercept", "slope")])


@query("c5_platt", f"with recursive {_P}, {_LINE} select symbol, trade_date, p, y, rnd(platt, 9) as platt from pl", "predictions")
def c5(spark, sf):
    fit_on, rows = _sides(spark, sf)
    return rows.select("symbol", "trade_date", "p", "y", rnd(ca.platt(fit_on)).alias("platt"))


@query("c6_isotonic", f"with recursive {_P}, {_STEPS} select symbol, trade_date, p, y, rnd(v, 9) as isotonic from (select * from pr where slice = 'validation') x asof join st on x.p >= st.lo", "predictions")
def c6(spark, sf):
    fit_on, rows = _sides(spark, sf)
    return ca.isotonic(rows, ca.isotonic_steps(fit_on)).select("symbol", "trade_date", "p", "y", rnd("isotonic").alias("isotonic"))


@query("c10_method_comparison", f"""
with recursive {_P}, {_LINE}, {_STEPS}, iv as (select x.*, st.v from pl x asof join st on x.p >= st.lo),
mt as (select y, baseline_p, unnest(['raw', 'platt', 'isotonic']) as method, unnest([p, platt, v]) as p from iv)
select method, {BLOCK} from mt group by method""", "predictions")
def c10(spark, sf):
    """The metric block of raw, Platt and isotonic probabilities on validation rows, each fitted on discovery rows."""
    fit_on, rows = _sides(spark, sf)
    x = ca.isotonic(rows.withColumn("platt", ca.platt(fit_on)), ca.isotonic_steps(fit_on))
    each = F.inline(F.array(*[F.struct(F.lit(n).alias("method"), F.col(c).alias("q")) for n, c in (("raw", "p"), ("platt", "platt"), ("isotonic", "isotonic"))]))
    return x.select("y", "baseline_p", each).groupBy("method").agg(*me.metric_block("q"))


@query("c11_bootstrap_delta", """
with sy as (select symbol, sum((baseline_p - y) * (baseline_p - y) - (p - y) * (p - y)) as s, count(*) as n from predictions where variant = 'baseline' group by symbol),
nm as (select symbol, s, n, row_number() over (order by symbol) - 1 as nth, count(*) over () as c from sy),
dr as (select id % 1000 as round, ('0x' || substr(md5('20260929:' || id), 1, 8))::bigint % c as nth from (select any_value(c) as c from nm), unnest(range(1000 * c)) u(id)),
rd as (select round, sum(s) / sum(n) as d from dr join nm using (nth) group by round)
select (select rnd(sum(s) / sum(n), 9) from nm) as delta, (select count(*) from nm) as symbols, rnd(quantile_cont(d, 0.025), 9) as q025, rnd(quantile_cont(d, 0.975), 9) as q975 from rd""", "predictions")
def c11(spark, sf):
    """Gain in squared error over the baseline rate, with its range over draws of symbols."""
    y = F.col("y").cast("double")
    gain = (F.col("baseline_p") - y) * (F.col("baseline_p") - y) - (F.col("p") - y) * (F.col("p") - y)
    return ca.bootstrap_delta(fx.predictions(spark, sf).filter("variant = 'baseline'"), gain)
