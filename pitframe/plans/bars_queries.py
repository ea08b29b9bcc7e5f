"""Queries over bars: as-of reads, factors, labels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..fixtures import rnd
from ..operators import factors as fa
from .registry import query


@query("f17_design_rows", 'select symbol, trade_date, "close", momentum, volatility, trend, volume_ratio, next_return, label from design', "design")
def f17(spark, sf):
    return fa.design_rows(fx.bars(spark, sf))


@query("j1_asof_bars", """
with dec as (select symbol, max(trade_date) as last from bars group by symbol),
d as (select symbol, cast(last - 5 as timestamp) + interval 8 hour as decision_time from dec)
select d.symbol, d.decision_time, b.event_time, max(b.revision) as revision, max_by(b."close", b.revision) as "close"
from d join bars b on b.symbol = d.symbol and cast(b.event_time as date) <= cast(d.decision_time as date) and b.available_time <= d.decision_time group by all""", "bars")
def j1(spark, sf):
    b = fx.bars(spark, sf)
    d = b.groupBy("symbol").agg(F.max("trade_date").alias("last")).select("symbol", (F.date_sub("last", 5).cast("timestamp_ntz") + fx.hours(8)).alias("decision_time"))
    return fa.asof_bars(d, b).select("symbol", "decision_time", "event_time", "revision", "close")


@query("j1_asof_sweep", """
with d as (select distinct symbol, cast(trade_date as timestamp) + interval 8 hour as decision_time from late_bars)
select d.symbol, d.decision_time, b.event_time, max(b.revision) as revision, max_by(b."close", b.revision) as "close"
from d join late_bars b on b.symbol = d.symbol and cast(b.event_time as date) <= cast(d.decision_time as date) and cast(b.event_time as date) > cast(d.decision_time as date) - 60 and b.available_time <= d.decision_time group by all""", "late_bars")
def j1_sweep(spark, sf):
    """Every day of every symbol as a decision, with the last 60 days as it saw them."""
    b = fx.late_bars(spark, sf)
    d = b.select("symbol", (F.col("trade_date").cast("timestamp_ntz") + fx.hours(8)).alias("decision_time")).distinct()
    return fa.asof_recent(d, b).select("symbol", "decision_time", "event_time", "revision", "close")


_WIN = """
with w as (select *, lag(final, 20) over o as back, row_number() over o as rn, max(final) over (o rows between 19 preceding and 1 preceding) as hi19, min(final) over (o rows between 19 preceding and 1 preceding) as lo19,
  avg(case when true then (fh - low) / final end) over (o rows between 20 preceding and 1 preceding) as rr, avg(volume) over (o rows between 20 preceding and 1 preceding) as v20, sum(final) over (o rows between 19 preceding and 1 preceding) as s19
  from (select s.*, max_by(b.high, b.revision) as fh from settled s join bars b using (symbol, trade_date) group by all) window o as (partition by symbol order by trade_date))
"""


def _factor(name: str, sql: str) -> None:
    @query(f"f_{name}", _WIN + f'select symbol, trade_date, look as "close", case when rn > 20 then rnd({sql}, 9) end as {name} from w', "settled")
    def run(spark, sf):
        return fa.compute_factors(fx.bars(spark, sf), [name])


for _n, _s in {
    "momentum": "look / back - 1", "trend": "look / ((s19 + look) / 20) - 1", "volume_ratio": "case when v20 > 0 then volume / v20 - 1 end",
    "close_to_high": "look / greatest(hi19, look) - 1", "close_to_low": "look / least(lo19, look) - 1",
    "range_ratio": "case when rr > 0 then ((high - low) / look) / rr - 1 end", "close_location": "case when high - low > 0 then 2 * (look - low) / (high - low) - 1 end",
}.items():
    _factor(_n, _s)


@query("l2_horizon_labels", """
with f as (select symbol, trade_date, final from settled), h as (select unnest([1, 3, 5, 10]) as horizon),
l as (select symbol, trade_date, final, lead(final, 1) over w as a1, lead(final, 3) over w as a3, lead(final, 5) over w as a5, lead(final, 10) over w as a10 from f window w as (partition by symbol order by trade_date))
select symbol, trade_date, horizon, rnd(ahead / final - 1, 9) as ret, cast(ahead > final as integer) as label from (
select symbol, trade_date, final, horizon, case horizon when 1 then a1 when 3 then a3 when 5 then a5 else a10 end as ahead from l, h) where ahead is not null""", "settled")
def l2(spark, sf):
    b = fx.bars(spark, sf)
    f = b.groupBy("symbol", "trade_date").agg(F.max_by("close", "revision").alias("final"))
    w = Window.partitionBy("symbol").orderBy("trade_date")
    each = F.array(*[F.struct(F.lit(h).alias("horizon"), F.lead("final", h).over(w).alias("ahead")) for h in (1, 3, 5, 10)])
    x = f.withColumn("each", each).select("symbol", "trade_date", "final", F.inline("each")).filter("ahead is not null")
    return x.select("symbol", "trade_date", "horizon", rnd(F.col("ahead") / F.col("final") - 1, 9).alias("ret"), (F.col("ahead") > F.col("final")).cast("int").alias("label"))
