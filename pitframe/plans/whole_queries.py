"""Queries that give the whole output of operators whose first query gives a part: keys with units, reasons, slices, full packs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..fixtures import rnd
from ..operators import evidence as ev
from ..operators import factors as fa
from ..operators import infoquality as iq
from ..operators import metrics as me
from ..operators import pit, resample
from ..sources.scratch import stored
from .metric_queries import FACTORS
from .pit_queries import _REGIME
from .registry import query
from .signal_queries import _MEAN, _O, looks

AT = "1996-01-01 00:00:00"
_LL = "-case when y = 1 then ln(least(greatest(p, 1e-15), 1 - 1e-15)) else ln(1 - least(greatest(p, 1e-15), 1 - 1e-15)) end"


@query("f_volatility", "select symbol, trade_date, volatility from design", "design")
def f_volatility(spark, sf):
    return fa.design_rows(fx.bars(spark, sf)).select("symbol", "trade_date", "volatility")


# every day of these bars can be used from its own decision on, so the newest 21 usable days are the last 21
@query("f9_factor_registry", """
with sn as (select d.symbol, d.trade_date, e.i, max_by({'c': b."close", 'h': b.high, 'l': b.low, 'v': b.volume}, b.revision) as s from days_ d join days_ e on e.symbol = d.symbol and e.i between d.i - 20 and d.i
  join late_bars b on b.symbol = e.symbol and b.trade_date = e.trade_date and b.available_time <= d.dt group by all),
hs as (select symbol, trade_date, list(s order by i) as h from sn group by all),
cs as (select symbol, trade_date, len(h) = 21 as whole, h[len(h)].c as c, h[len(h)].h as hi, h[len(h)].l as lo, h[len(h)].v as vol, h[1].c as back, [x.c for x in h[2:]] as last, [ln(h[k].c / h[k - 1].c) for k in range(2, len(h) + 1)] as r, [x.v for x in h[1:20]] as v, [(x.h - x.l) / x.c for x in h[1:20]] as g from hs)
select symbol, trade_date, c as "close", case when whole then rnd(c / list_max(last) - 1, 9) end as close_to_high, case when whole then rnd(c / list_min(last) - 1, 9) end as close_to_low, case when whole and hi > lo then rnd(2 * (c - lo) / (hi - lo) - 1, 9) end as close_location,
case when whole then rnd(c / back - 1, 9) end as momentum, case when whole and list_avg(g) > 0 then rnd((hi - lo) / c / list_avg(g) - 1, 9) end as range_ratio, case when whole then rnd(c / list_avg(last) - 1, 9) end as trend,
case when whole then rnd(list_stddev_pop(r) * sqrt(252), 6) end as volatility, case when whole and list_avg(v) > 0 then rnd(vol / list_avg(v) - 1, 9) end as volume_ratio from cs""", "days")
def f9(spark, sf):
    """Every factor of the registry by name, over bars with late revisions, so that both paths run."""
    return fa.compute_factors(fx.late_bars(spark, sf), sorted(fa.REGISTRY))


@query("f15_late_factors", """
with h as (select symbol, trade_date, list("close" order by i) filter (i > own_i - 21 and "close" > 0) as c, bool_or(i = own_i) as own from pit group by all)
select symbol, trade_date, rnd(c[len(c)] / c[len(c) - 5] - 1, 9) as momentum_5, rnd(c[len(c)] / (list_sum(c[len(c) - 4:len(c)]) / 5) - 1, 9) as trend_5 from h where own and len(c) > 5""", "pit")
def f15_late(spark, sf):
    """Factors where revisions come late: the window path against a plain reading of what was available."""
    f = fa.compute_factors(fx.late_bars(spark, sf), ["momentum", "trend"], 5).filter("momentum is not null")
    return f.select("symbol", "trade_date", F.col("momentum").alias("momentum_5"), F.col("trend").alias("trend_5"))


@query("f18_moving_pack", "select symbol, trade_date, " + ", ".join(f"rnd({_MEAN('final', n, _O)}, 6) as ma{n}" for n in (5, 10, 20, 60)) + f""", rnd({_MEAN('volume', 20, _O)}, 4) as vol_ma20, rnd(volume / {_MEAN('volume', 20, _O)}, 6) as lr,
max(final) over ({_O} rows 19 preceding) as high20, min(final) over ({_O} rows 19 preceding) as low20, lag(final) over ({_O}) as prev_close, rnd((final / lag(final) over ({_O}) - 1) * 100, 6) as pct from looks""", "looks")
def f18(spark, sf):
    w = Window.partitionBy("symbol").orderBy("trade_date")
    full = lambda c, n: F.when(F.count(F.lit(1)).over(w.rowsBetween(1 - n, 0)) == n, F.avg(c).over(w.rowsBetween(1 - n, 0)))
    w20, prev = w.rowsBetween(-19, 0), F.lag("final").over(w)
    return looks(spark, sf).select(
        "symbol", "trade_date", *[rnd(full("final", n), 6).alias(f"ma{n}") for n in (5, 10, 20, 60)], rnd(full("volume", 20), 4).alias("vol_ma20"), rnd(F.try_divide(F.col("volume"), full("volume", 20)), 6).alias("lr"),
        F.max("final").over(w20).alias("high20"), F.min("final").over(w20).alias("low20"), prev.alias("prev_close"), rnd((F.col("final") / prev - 1) * 100, 6).alias("pct"),
    )


@query("c1_calibration_full", f"""
with b as (select variant, least(floor(p * 10), 9)::int as bin, count(*) as n, avg(p) as mean_p, avg(y::double) as rate from predictions group by all), s as (select variant, avg((p - y) * (p - y)) as brier, avg({_LL}) as log_loss from predictions group by variant)
select variant, bin, n, rnd(mean_p, 9) as mean_p, rnd(rate, 9) as rate, rnd(brier, 9) as brier, rnd(log_loss, 9) as log_loss from b join s using (variant)""", "predictions")
def c1(spark, sf):
    p, y = F.col("p"), F.col("y").cast("double")
    x = fx.predictions(spark, sf)
    s = x.groupBy("variant").agg(rnd(F.avg((p - y) * (p - y))).alias("brier"), rnd(F.avg(me.log_loss(p, y))).alias("log_loss"))
    b = me.binned(x, 10).groupBy("variant", "bin").agg(F.count("*").alias("n"), rnd(F.avg("p")).alias("mean_p"), rnd(F.avg(y)).alias("rate"))
    return b.join(F.broadcast(s), "variant")  # one row a variant


_QS = (0.05, 0.25, 0.5, 0.75, 0.95)


@query("l11_full_profile", " union all ".join(f"select '{f}' as factor, count({f}) as n, count(*) - count({f}) as missing, rnd(avg({f}), 7) as mean, rnd(stddev_pop({f}), 6) as std, min({f}) as min, " + ", ".join(f"rnd(quantile_cont({f}, {q}), 9) as q{int(q * 100):02d}" for q in _QS) + f", max({f}) as max from design" for f in FACTORS), "design")
def l11(spark, sf):
    d = stored(fa.design_rows(fx.bars(spark, sf)).select(*FACTORS), "design")
    found, out = me.whole_quantiles(d, list(FACTORS), list(_QS)), None
    for f in FACTORS:
        one = d.agg(F.lit(f).alias("factor"), F.count(f).alias("n"), (F.count("*") - F.count(f)).alias("missing"), rnd(F.avg(f), 7).alias("mean"), rnd(F.stddev_pop(f), 6).alias("std"), F.min(f).alias("min"), F.max(f).alias("max"))
        one = one.select("*", *[rnd(F.lit(v).cast("double")).alias(f"q{int(x * 100):02d}") for x, v in zip(_QS, found[f])])
        out = one if out is None else out.unionByName(one)
    return out


_UNITS = "iu as (select *, case when k % 4 = 0 then null else 'lot' end as unit, case when k % 3 = 0 then 'USD' end as currency from info)"


def _units(spark, sf):
    return fx.info(spark, sf).withColumn("unit", F.when(F.col("k") % 4 != 0, "lot")).withColumn("currency", F.when(F.col("k") % 3 == 0, "USD"))


@query("q3_conflicts_by_unit", f"with {_UNITS} select entity_id, entity_type, event_time, unit, currency, count(distinct source) as sources, count(distinct value) as \"values\" from iu group by all having count(distinct source) > 1 and count(distinct value) > 1", "info")
def q3(spark, sf):
    return iq.conflict_groups(_units(spark, sf), ("entity_id", "entity_type", "event_time", "unit", "currency"))


@query("q5_reconcile_by_unit", f"with {_UNITS} select entity_id, entity_type, event_time, unit, currency, string_agg(distinct source, ',' order by source) as sources, case when count(distinct source) < 2 then 'INSUFFICIENT_SOURCES' when max(value) - min(value) <= greatest(1.0, 0.1 * max(abs(value))) then 'CONSISTENT' else 'CONFLICT' end as status from iu group by all", "info")
def q5(spark, sf):
    keys = ("entity_id", "entity_type", "event_time", "unit", "currency")
    return iq.reconcile(_units(spark, sf), 1.0, 0.1, keys).select(*keys, "sources", "status")


_TXT = "tx as (select source, case k % 6 when 0 then 'someday' when 1 then strftime(event_time, '%Y-%m-%d') else strftime(event_time, '%Y-%m-%dT%H:%M:%S') end as e, case when k % 5 = 0 then strftime(available_time, '%Y-%m-%d') else strftime(available_time, '%Y-%m-%dT%H:%M:%S') end as a, strftime(ingested_at - case when k % 7 = 0 then interval 2 hour else interval 0 hour end, '%Y-%m-%dT%H:%M:%S') as g, k % 6 = 0 as bad, event_time, available_time, ingested_at - case when k % 7 = 0 then interval 2 hour else interval 0 hour end as ig from info)"


@query("q7_timestamp_text_issues", f"""with {_TXT}, i as (select source, unnest(list_filter([case when bad then 'event_time_malformed' end, case when e not like '%T%' then 'event_time_no_time_component' end, case when a not like '%T%' then 'available_time_no_time_component' end, case when ig < available_time then 'ingested_before_available' end,
case when not bad and available_time < event_time then 'available_before_event' end, case when not bad and event_time > timestamp '{AT}' then 'event_time_in_future' end, case when available_time > timestamp '{AT}' then 'available_time_in_future' end], lambda x: x is not null)) as issue from tx) select source, issue, count(*) as n from i group by all""", "info")
def q7(spark, sf):
    k = F.col("k")
    text = lambda c, p: F.date_format(c, p)
    long, short = "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd"
    i = fx.info(spark, sf)
    t = i.select(
        "source", F.when(k % 6 == 0, "someday").when(k % 6 == 1, text("event_time", short)).otherwise(text("event_time", long)).alias("event_time"), F.when(k % 5 == 0, text("available_time", short)).otherwise(text("available_time", long)).alias("available_time"),
        text(F.when(k % 7 == 0, F.col("ingested_at") - fx.hours(2)).otherwise(F.col("ingested_at")), long).alias("ingested_at"),
    )
    return t.select("source", F.explode(iq.text_stamp_issues(F.lit(AT).cast("timestamp_ntz"))).alias("issue")).groupBy("source", "issue").agg(F.count("*").alias("n"))


@query("q10_decisions_with_reasons", f"""
with a as (select *, case when k % 6 = 0 then null else available_time end as av, k % 9 = 0 as ph, case source when 'cn_stock_quote' then 400 when 'cn_index_daily' then 100 end as days from info),
f as (select *, case when days is null then 'missing_policy' when av is null then 'unknown' when epoch(timestamp '{AT}') - epoch(av) <= days * 86400 then 'fresh' else 'stale' end as fr from a),
r as (select *, concat_ws(',', case when ph then 'PROVENANCE_SOURCE_IS_PLACEHOLDER' end, case when av is null then 'AVAILABLE_TIME_UNRESOLVED' end, case when av is null then 'AVAILABLE_TIME_MISSING' end, case when av > timestamp '{AT}' or av < event_time then 'PIT_REJECTED' end, case when av < event_time then 'AVAILABLE_BEFORE_EVENT' end, case fr when 'stale' then 'SOURCE_STALE' when 'unknown' then 'FRESHNESS_UNKNOWN' when 'missing_policy' then 'FRESHNESS_MISSING_POLICY' end) as reasons from f)
select case when av is null then 'UNRESOLVED' when ph then 'REJECTED' when reasons <> '' then 'ADMISSIBLE_WITH_WARNING' else 'ADMISSIBLE' end as decision, reasons, count(*) as n from r group by all""", "info")
def q10(spark, sf):
    at, k = F.lit(AT).cast("timestamp_ntz"), F.col("k")
    days = F.when(F.col("source") == "cn_stock_quote", 400).when(F.col("source") == "cn_index_daily", 100)
    i = fx.info(spark, sf).withColumn("available_time", F.when(k % 6 != 0, F.col("available_time"))).withColumn("days", days).withColumn("source", F.when(k % 9 == 0, "Unknown").otherwise(F.col("source"))).withColumn("quality_status", F.lit("OK"))
    d = ev.record_decision(i, at, iq.freshness(F.col("available_time"), at, F.col("days")))
    return d.groupBy("decision", F.array_join("reasons", ",").alias("reasons")).agg(F.count("*").alias("n"))


_Q5 = "1 + (momentum >= e1)::int + (momentum >= e2)::int + (momentum >= e3)::int + (momentum >= e4)::int as q"


@query("o5_spread_by_slice", f"""
with p as (select * from predictions where variant = 'baseline'), e as (select quantile_cont(momentum, 0.2) as e1, quantile_cont(momentum, 0.4) as e2, quantile_cont(momentum, 0.6) as e3, quantile_cont(momentum, 0.8) as e4 from p where trade_date < '1995-06-01'), {_REGIME},
x as (select p.*, {_Q5}, rg.regime from p cross join e left join rg using (trade_date)), s as (select unnest([' all', case when trade_date < date '1995-06-01' then 'discovery' else 'validation' end, 'year_' || year(trade_date), 'regime_' || coalesce(regime, 'NO_DATA')]) as slice, q, y, next_return from x)
select trim(slice) as slice, count(*) as n, rnd(avg(next_return) filter (q = 5) - avg(next_return) filter (q = 1), 9) as spread, rnd(avg(y) filter (q = 5) - avg(y) filter (q = 1), 9) as up_spread from s group by slice""", "predictions near")
def o5(spark, sf):
    p = fx.predictions(spark, sf).filter("variant = 'baseline'")
    x = me.quintiles(p, "momentum", p.filter("trade_date < '1995-06-01'"))
    r = pit.universe_regime(fx.late_bars(spark, sf)).select("trade_date", "regime")
    x = x.join(r, "trade_date", "left")
    names = F.array(F.lit("all"), F.when(F.col("trade_date") < "1995-06-01", "discovery").otherwise("validation"), F.concat(F.lit("year_"), F.year("trade_date").cast("string")), F.concat(F.lit("regime_"), F.coalesce("regime", F.lit("NO_DATA"))))
    side = lambda c, k: F.avg(F.when(F.col("q") == k, F.col(c)))
    return x.withColumn("slice", F.explode(names)).groupBy("slice").agg(F.count("*").alias("n"), rnd(side("next_return", 5) - side("next_return", 1)).alias("spread"), rnd(side("y", 5) - side("y", 1)).alias("up_spread"))


@query("o5_spread_bootstrap", f"""
with p as (select * from predictions where variant = 'baseline'), e as (select quantile_cont(momentum, 0.2) as e1, quantile_cont(momentum, 0.4) as e2, quantile_cont(momentum, 0.6) as e3, quantile_cont(momentum, 0.8) as e4 from p where trade_date < '1995-06-01'),
x as (select p.*, {_Q5} from p cross join e), s as (select unnest(['all', case when trade_date < date '1995-06-01' then 'discovery' else 'validation' end]) as slice, symbol, q, y, next_return from x),
sy as (select slice, symbol, count(*) filter (q = 1) as n_low, coalesce(sum(y) filter (q = 1), 0)::double as up_low, coalesce(sum(next_return) filter (q = 1), 0) as ret_low, count(*) filter (q = 5) as n_high, coalesce(sum(y) filter (q = 5), 0)::double as up_high, coalesce(sum(next_return) filter (q = 5), 0) as ret_high from s group by all),
nm as (select symbol, row_number() over (order by symbol) - 1 as nth, count(*) over () as c from (select distinct symbol from sy)),
dr as (select id % 1000 as round, ('0x' || substr(md5('20260929:' || id), 1, 8))::bigint % c as nth from (select any_value(c) as c from nm), unnest(range(1000 * c)) u(id)),
w as (select round, symbol, count(*) as k from dr join nm using (nth) group by all union all select -1, symbol, 1 from nm),
g as (select slice, round, sum(k * up_high) / nullif(sum(k * n_high), 0) - sum(k * up_low) / nullif(sum(k * n_low), 0) as u, sum(k * ret_high) / nullif(sum(k * n_high), 0) - sum(k * ret_low) / nullif(sum(k * n_low), 0) as r from sy join w using (symbol) group by all)
select slice, rnd(max(u) filter (round < 0), 7) as spread_up, rnd(quantile_cont(u, 0.025) filter (round >= 0), 7) as spread_up_q025, rnd(quantile_cont(u, 0.975) filter (round >= 0), 7) as spread_up_q975,
rnd(max(r) filter (round < 0), 7) as spread_return, rnd(quantile_cont(r, 0.025) filter (round >= 0), 7) as spread_return_q025, rnd(quantile_cont(r, 0.975) filter (round >= 0), 7) as spread_return_q975 from g group by slice""", "predictions")
def o5_bootstrap(spark, sf):
    """The spread of whole, discovery and validation time, with intervals of 1,000 rounds over symbols."""
    p = fx.predictions(spark, sf).filter("variant = 'baseline'")
    x = me.quintiles(p, "momentum", p.filter("trade_date < '1995-06-01'"))
    slices = F.array(F.lit("all"), F.when(F.col("trade_date") < "1995-06-01", "discovery").otherwise("validation"))
    return resample.spread_bootstrap(x.withColumn("slice", F.explode(slices)), "slice", digits=7)


@query("a9_ingestion_ids", """
select source, source_id, revision, sha256(entity_id || '|' || cast(cast(floor(value * 100 + 0.5) as bigint) as varchar)) as payload_hash, sha256(source || '|' || source_id || '|' || revision || '|' || sha256(entity_id || '|' || cast(cast(floor(value * 100 + 0.5) as bigint) as varchar)) || '|v1') as ingestion_id from info""", "info")
def a9(spark, sf):
    return ev.identified(fx.info(spark, sf)).select("source", "source_id", "revision", "payload_hash", "ingestion_id")


@query("d1_canonical", """select source, source_id, revision, canonical from (select *, row_number() over (partition by source, source_id, revision order by canonical) as rn from (select *, entity_id || '|' || cast(cast(floor(value * 100 + 0.5) as bigint) as varchar) || '|' || strftime(available_time, '%Y-%m-%d %H:%M:%S') as canonical from info)) where rn = 1""", "info")
def d1(spark, sf):
    c = F.concat_ws("|", "entity_id", F.floor(F.col("value") * 100 + 0.5).cast("long").cast("string"), F.date_format("available_time", "yyyy-MM-dd HH:mm:ss"))
    return iq.smallest_text(fx.info(spark, sf).withColumn("canonical", c)).select("source", "source_id", "revision", "canonical")


_NAMED = [*FACTORS, "copy"]
_NEAR = " union all ".join(f"select '{a}|{b}' as k, rnd(abs(corr({a}, {b})), 6) as r from cd" for a in _NAMED for b in _NAMED)
_CORR = f"""cd as materialized (select momentum, volatility, trend, volume_ratio, momentum * 2 + 1 as "copy" from design), nr as materialized (select map_from_entries(list((k, r))) as m, {_NAMED} as names from ({_NEAR.replace('copy,', '"copy",').replace(', copy)', ', "copy")')}))"""


@query("l9_decorrelate", f"""
with recursive {_CORR}, kp(i, kept) as (select 0, []::varchar[] union all select i + 1, case when len([x for x in kept if coalesce(m[x || '|' || names[i + 1]], 0) >= 0.9]) = 0 then list_append(kept, names[i + 1]) else kept end from kp, nr where i < len(names))
select (unnest(range(len(kept))))::int as place, unnest(kept) as factor from kp, nr where i = len(names)""", "design")
def l9(spark, sf):
    """The factors that greedy decorrelation keeps, in order; a copy of one is among the candidates."""
    d = fa.design_rows(fx.bars(spark, sf)).withColumn("copy", F.col("momentum") * 2 + 1)
    kept = me.decorrelate(d, [*FACTORS, "copy"])
    return spark.createDataFrame([(i, f) for i, f in enumerate(kept)], "place int, factor string")


@query("l10_correlation_clusters", f"""
with recursive {_CORR}, gr(i, seen, cluster, own) as (select 0, []::varchar[], -1, null::varchar[] union all
  select i + 1, case when fresh then list_concat(seen, own) else seen end, cluster + fresh::int, case when fresh then own end from
  (select i, seen, cluster, not list_contains(seen, names[i + 1]) as fresh, [x for x in names if x = names[i + 1] or coalesce(m[names[i + 1] || '|' || x], 0) >= 0.85] as own from gr, nr where i < len(names)))
select cluster, array_to_string(own, ',') as members from gr where own is not null""", "design")
def l10(spark, sf):
    d = fa.design_rows(fx.bars(spark, sf)).withColumn("copy", F.col("momentum") * 2 + 1)
    return me.correlation_clusters(d, _NAMED).withColumn("members", F.array_join("members", ","))
