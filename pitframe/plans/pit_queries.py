"""Queries: point-in-time returns, index, relative and industry context, regimes, over bars with late revisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..fixtures import rnd
from ..operators import factors as fa
from ..operators import pit
from .registry import query


@query("f15_pit_returns", "select symbol, trade_date, day, rnd(r, 9) as r from near where r is not null and i > own_i - 4", "near")
def f15(spark, sf):
    r = pit.pit_returns(fx.late_bars(spark, sf), 4)
    return r.select("symbol", "trade_date", F.inline("r")).select("symbol", "trade_date", "day", rnd("r").alias("r"))


@query("f13_index_context", """
with s as (select *, row_number() over (partition by symbol, dt order by day desc) as k, max(i) over (partition by symbol, dt) as newest from pit),
t as (select symbol, trade_date, list("close" order by day) as c from s where k <= 21 and newest = own_i group by all having count(*) = 21 and min("close") > 0)
select symbol, trade_date, rnd(c[21] / c[16] - 1, 9) as return_5, rnd(c[21] / c[1] - 1, 9) as return_20, rnd(c[21] / (list_sum(c[2:21]) / 20) - 1, 9) as close_vs_sma20, rnd(list_stddev_pop([ln(c[x + 1] / c[x]) for x in range(1, 21)]) * sqrt(252), 6) as volatility_20 from t""", "pit")
def f13(spark, sf):
    """Over every symbol, so that late and missing days occur; an index is one more symbol."""
    return pit.index_context(fx.late_bars(spark, sf))


@query("f14_relative_context", """
with ix as (select trade_date, available_time, "close" from index_bars), p as (select p.symbol, p.trade_date, p.dt, p.day, p.i = p.own_i as own, p."close" as s, x."close" as i, row_number() over (partition by p.symbol, p.dt order by p.day desc) as k from pit p join ix x on x.trade_date = p.day and x.available_time <= p.dt),
t as (select symbol, trade_date, list(s order by day) as s, list(i order by day) as i from p where k <= 21 group by all having count(*) = 21 and bool_or(own) and min(s) > 0 and min(i) > 0)
select symbol, trade_date, rnd(s[21] / s[16] - i[21] / i[16], 9) as relative_5, rnd(s[21] / s[1] - i[21] / i[1], 9) as relative_20 from t""", "pit index_bars")
def f14(spark, sf):
    return pit.relative_context(fx.late_bars(spark, sf), fx.index_bars(spark, sf))


@query("j6_common_days", """
select p.symbol, p.trade_date, count(*) filter (p.i > p.own_i - 10) as common_10 from near p join index_bars x on x.trade_date = p.day and x.available_time <= p.dt group by p.symbol, p.trade_date, p.own_i having bool_or(p.i = p.own_i)""", "near index_bars")
def j6(spark, sf):
    h = pit.pit_history(fx.late_bars(spark, sf), 10).select("symbol", "trade_date", "dt", F.inline("h")).filter("close is not null")
    x = fx.index_bars(spark, sf).select(F.col("trade_date").alias("day"), "available_time")
    j = h.join(x, "day").filter("available_time <= dt")
    return j.groupBy("symbol", "trade_date").agg(F.count("*").alias("common_10"), F.bool_or(F.col("day") == F.col("trade_date")).alias("own")).filter("own").drop("own")


_SCHED = """
sch as (select symbol, industry_code, effective_from, row_number() over (partition by symbol order by effective_from) as pos from membership),
dec as (select distinct symbol, trade_date, cast(trade_date as timestamp) + interval 8 hour as dt from bars),
cnt as (select d.symbol, d.trade_date, d.dt, least(count(*) filter (m.effective_from <= d.trade_date), count(*) filter (m.available_time <= d.dt)) as pos from dec d join membership m using (symbol) group by all)"""


@query("j4_scheduled_industry", f"with {_SCHED} select c.symbol, c.trade_date, s.industry_code from cnt c join sch s on s.symbol = c.symbol and s.pos = c.pos", "bars membership")
def j4(spark, sf):
    d = fx.bars(spark, sf).select("symbol", "trade_date").distinct().join(pit.schedules(fx.membership(spark, sf)), "symbol")
    at = F.col("trade_date").cast("timestamp_ntz") + fx.hours(8)
    return d.select("symbol", "trade_date", pit.scheduled_industry(F.col("trade_date"), at).alias("industry_code")).filter("industry_code is not null")


@query("j5_historical_membership", """
with d as (select distinct symbol, trade_date from bars)
select d.symbol, d.trade_date, max_by(industry_code, effective_from) as on_or_before, max_by(industry_code, effective_from) filter (effective_from < trade_date) as before from d join membership m on m.symbol = d.symbol and m.effective_from <= d.trade_date group by all""", "bars membership")
def j5(spark, sf):
    d = fx.bars(spark, sf).select("symbol", "trade_date").distinct().join(pit.schedules(fx.membership(spark, sf)), "symbol")
    day = F.col("trade_date")
    return d.select("symbol", "trade_date", pit.historical_industry(day).alias("on_or_before"), pit.historical_industry(day, before=True).alias("before")).filter("on_or_before is not null")


@query("j3_ambiguous_industry", """
with m as (select * from membership union all select symbol, industry_code || 'X', effective_from, effective_to, available_time from membership where symbol like '%4'), d as (select distinct symbol, trade_date, cast(trade_date as timestamp) + interval 8 hour as dt from bars),
x as (select d.symbol, d.trade_date, industry_code, effective_from, max(effective_from) over (partition by d.symbol, d.trade_date) as newest from d join m on m.symbol = d.symbol and m.effective_from <= d.trade_date and m.available_time <= d.dt)
select symbol, trade_date, array_to_string(list_sort(list(distinct industry_code)), ',') as codes from x where effective_from = newest group by all having count(distinct industry_code) > 1""", "bars membership")
def j3(spark, sf):
    """The decisions at which the lookup fails: several codes with the same latest start."""
    m = fx.membership(spark, sf)
    m = m.unionByName(m.filter("symbol like '%4'").withColumn("industry_code", F.concat("industry_code", F.lit("X"))))
    d = fx.bars(spark, sf).select("symbol", "trade_date").distinct()
    j = d.join(m, "symbol").filter((F.col("effective_from") <= F.col("trade_date")) & (F.col("available_time") <= F.col("trade_date").cast("timestamp_ntz") + fx.hours(8)))
    newest = j.groupBy("symbol", "trade_date", "effective_from").agg(F.collect_set("industry_code").alias("codes")).groupBy("symbol", "trade_date").agg(F.max_by("codes", "effective_from").alias("codes"))
    return newest.filter("size(codes) > 1").select("symbol", "trade_date", F.array_join(F.sort_array("codes"), ",").alias("codes"))


@query("f16_industry_relative", f"""
with {_SCHED}, dy as (select *, row_number() over (partition by symbol order by trade_date) as i from (select distinct symbol, trade_date from late_bars)),
st as (select distinct d.symbol, d.trade_date, d.i, b.available_time as valid_from from dy d join dy e on e.symbol = d.symbol and e.i between d.i - 1 and d.i join late_bars b on b.symbol = e.symbol and b.trade_date = e.trade_date where d.i > 1),
sv as (select s.*, lead(valid_from) over (partition by symbol, i order by valid_from) as valid_to from st s),
rv as (select v.symbol, v.trade_date, valid_from, valid_to, max_by(b."close", b.revision) filter (b.trade_date = v.trade_date) / max_by(b."close", b.revision) filter (b.trade_date < v.trade_date) - 1 as r
  from sv v join dy e on e.symbol = v.symbol and e.i between v.i - 1 and v.i join late_bars b on b.symbol = e.symbol and b.trade_date = e.trade_date and b.available_time <= v.valid_from group by all having count(distinct b.trade_date) = 2),
pe as (select r.*, o.own_day, max_by(industry_code, effective_from) as code from rv r, (values (true), (false)) o(own_day), membership m where m.symbol = r.symbol and (m.effective_from < r.trade_date or (m.effective_from = r.trade_date and not o.own_day)) group by all),
mv as (select code, trade_date, own_day, stamp, sum(dr) as dr, sum(dn) as dn from (select code, trade_date, own_day, valid_from as stamp, r as dr, 1 as dn from pe union all select code, trade_date, own_day, valid_to, -r, -1 from pe where valid_to is not null) group by all),
cu as (select code, trade_date, own_day, stamp as from_, lead(stamp) over w as to_, sum(dr) over w as s, sum(dn) over w as n from mv window w as (partition by code, trade_date, own_day order by stamp)),
tg as (select p.symbol, p.trade_date, p.dt, p.day, p.r, s.industry_code as code, p.day = p.trade_date as own_day from pit p join pit o on o.symbol = p.symbol and o.dt = p.dt and o.i = o.own_i join cnt c on c.symbol = p.symbol and c.trade_date = p.trade_date join sch s on s.symbol = c.symbol and s.pos = c.pos where p.r is not null),
hc as (select r.symbol, r.trade_date, r.own_day, any_value(code) as code from pe r group by all),
pr as (select t.symbol, t.trade_date, t.code, t.day, t.r, (cu.s - case when hc.code = t.code then t.r else 0 end) / (cu.n - case when hc.code = t.code then 1 else 0 end) as peers
  from tg t join cu on cu.code = t.code and cu.trade_date = t.day and cu.own_day = t.own_day and cu.from_ <= t.dt and (cu.to_ is null or cu.to_ > t.dt) left join hc on hc.symbol = t.symbol and hc.trade_date = t.day and hc.own_day = t.own_day
  where cu.n - case when hc.code = t.code then 1 else 0 end > 0),
rk as (select *, row_number() over (partition by symbol, trade_date order by day desc) as k, count(*) over (partition by symbol, trade_date) as n from pr)
select symbol, trade_date, code, rnd((product(1 + r) filter (k <= 5)) - (product(1 + peers) filter (k <= 5)), 7) as industry_relative_5, rnd(product(1 + r) - product(1 + peers), 7) as industry_relative_20 from rk where k <= 20 and n >= 20 group by all""", "bars membership pit")
def f16(spark, sf):
    return pit.industry_relative(fx.late_bars(spark, sf), fx.membership(spark, sf))


@query("f23_pit_breadth", """
with p as (select trade_date, r * 100 as pct from near where i = own_i and r is not null)
select trade_date, count(*) as n, count(*) filter (pct >= 0) as up, count(*) filter (pct < 0) as down, count(*) filter (pct >= 9.8) as limit_up, count(*) filter (pct <= -9.8) as limit_down,
rnd((count(*) filter (pct >= 0) - count(*) filter (pct < 0))::double / count(*), 9) as breadth, rnd((count(*) filter (pct >= 9.8) - count(*) filter (pct <= -9.8))::double / count(*), 9) as limit_pressure from p group by trade_date""", "near")
def f23(spark, sf):
    return pit.breadth(pit.own_returns(fx.late_bars(spark, sf)), F.col("r") * 100, "trade_date")


_REGIME = """rg as (select trade_date, c, case when c is null then 'NO_DATA' when c > 0.03 then 'BULL' when c < -0.03 then 'BEAR' else 'NEUTRAL' end as regime
  from (select trade_date, product(1 + m) over (order by trade_date rows between 20 preceding and 1 preceding) - 1 as c from (select trade_date, avg(r) as m from near where i = own_i and r is not null group by trade_date)))"""


@query("f27_pit_regime", f"with {_REGIME} select trade_date, rnd(c, 7) as compounded, regime from rg", "near")
def f27(spark, sf):
    return pit.universe_regime(fx.late_bars(spark, sf))


@query("j7_attach_context", f"""
with {_REGIME}, c as (select symbol, trade_date, rnd("close" / lag("close", 20) over (partition by symbol order by trade_date) - 1, 9) as index_return_20 from index_bars)
select d.symbol, d.trade_date, d.momentum, c.index_return_20, rg.regime from design d join c on c.trade_date = d.trade_date and c.index_return_20 is not null join rg on rg.trade_date = d.trade_date""", "near design index_bars")
def j7(spark, sf):
    d = fa.design_rows(fx.bars(spark, sf)).select("symbol", "trade_date", "momentum")
    ctx = pit.index_context(fx.index_bars(spark, sf)).select("trade_date", F.col("return_20").alias("index_return_20"))
    return d.join(ctx, "trade_date").join(pit.universe_regime(fx.late_bars(spark, sf)).select("trade_date", "regime"), "trade_date")


@query("j8_merge_context", f"""
with {_REGIME}, c as (select trade_date, rnd("close" / lag("close", 20) over (order by trade_date) - 1, 9) as index_return_20 from index_bars)
select trade_date, (index_return_20 is not null)::int + (rg.c is not null)::int as factors, index_return_20, rnd(rg.c, 7) as compounded from (select * from c where index_return_20 is not null) c full join (select * from rg where c is not null) rg using (trade_date)""", "near index_bars")
def j8(spark, sf):
    a = pit.index_context(fx.index_bars(spark, sf)).select("trade_date", F.create_map(F.lit("index_return_20"), "return_20").alias("m"))
    b = pit.universe_regime(fx.late_bars(spark, sf)).filter("compounded is not null").select("trade_date", F.create_map(F.lit("compounded"), "compounded").alias("n"))
    none = F.create_map().cast("map<string,double>")
    x = a.join(b, "trade_date", "full").select("trade_date", F.map_concat(F.coalesce("m", none), F.coalesce("n", none)).alias("f"))
    return x.select("trade_date", F.size("f").cast("int").alias("factors"), F.col("f")["index_return_20"].alias("index_return_20"), F.col("f")["compounded"].alias("compounded"))
