"""Queries over information records, the ledger, ticks and membership."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..fixtures import rnd
from ..operators import expected as ex
from ..operators import infoquality as iq
from .registry import query

AT = "1998-06-01"


def _at():
    return F.lit(AT).cast("timestamp_ntz")


_STATUS = f"case when k % 10 = 0 then 'FALLBACK' when event_time is null or available_time is null then 'MISSING_TIME' when available_time < event_time then 'INVALID_TIME' when available_time <= timestamp '{AT}' then 'ADMISSIBLE' else 'FUTURE' end"


def _status():
    return iq.pit_status(F.col("event_time"), F.col("available_time"), _at(), F.col("k") % 10 == 0)


@query("b1_pit_status", f"select source, source_id, revision, {_STATUS} as status from info", "info")
def b1(spark, sf):
    return fx.info(spark, sf).select("source", "source_id", "revision", _status().alias("status"))


@query("b2_admissible", f"select source, source_id, revision, value from info where available_time >= event_time and available_time <= timestamp '{AT}'", "info")
def b2(spark, sf):
    return fx.info(spark, sf).filter((F.col("available_time") >= F.col("event_time")) & (F.col("available_time") <= _at())).select("source", "source_id", "revision", "value")


@query("b4_in_window", 'select symbol, trade_date, revision, "close" from bars where trade_date between date \'1997-01-01\' and date \'1997-06-30\'', "bars")
def b4(spark, sf):
    return fx.bars(spark, sf).filter(F.col("trade_date").between("1997-01-01", "1997-06-30")).select("symbol", "trade_date", "revision", "close")


@query("b5_pit_summary", f"with s as (select source, {_STATUS} as status from info) select source, status, n, rnd(n::double / sum(n) over (partition by source), 9) as share from (select source, status, count(*) as n from s group by source, status)", "info")
def b5(spark, sf):
    g = fx.info(spark, sf).groupBy("source", _status().alias("status")).agg(F.count("*").alias("n"))
    return g.withColumn("share", rnd(F.col("n") / F.sum("n").over(Window.partitionBy("source"))))


@query("b6_gate_inputs", f"with s as (select entity_id, {_STATUS} as status from info) select entity_id, count(*) filter (status = 'ADMISSIBLE') as admitted, count(*) filter (status <> 'ADMISSIBLE') as rejected, bool_and(status = 'ADMISSIBLE') as ready from s group by entity_id", "info")
def b6(spark, sf):
    ok = F.col("status") == "ADMISSIBLE"
    return fx.info(spark, sf).select("entity_id", _status().alias("status")).groupBy("entity_id").agg(F.count_if(ok).alias("admitted"), F.count_if(~ok).alias("rejected"), F.bool_and(ok).alias("ready"))


@query("b8_leakage_audit", f"with s as (select *, {_STATUS} as status from info) select source, source_id, revision, status from s where status <> 'ADMISSIBLE'", "info")
def b8(spark, sf):
    return fx.info(spark, sf).select("source", "source_id", "revision", _status().alias("status")).filter("status <> 'ADMISSIBLE'")


@query("b18_in_session", "select symbol, count(*) as n from (select symbol, ts + interval 8 hour as lt from ticks) where isodow(lt) <= 5 and (hour(lt) * 60 + minute(lt) between 570 and 690 or hour(lt) * 60 + minute(lt) between 780 and 900) group by symbol", "ticks")
def b18(spark, sf):
    t = fx.ticks(spark, sf).withColumn("lt", F.col("ts") + fx.hours(8))
    m = F.hour("lt") * 60 + F.minute("lt")
    return t.filter((F.weekday("lt") < 5) & (m.between(570, 690) | m.between(780, 900))).groupBy("symbol").agg(F.count("*").alias("n"))


@query("a3_validate_records", "select source, source_id, revision, case when available_time < event_time then 'BACKWARDS' end as reason from info", "info")
def a3(spark, sf):
    return fx.info(spark, sf).select("source", "source_id", "revision", F.when(F.col("available_time") < F.col("event_time"), "BACKWARDS").alias("reason"))


@query("a7_universe", "select sha256(string_agg(symbol, ',' order by symbol)) as universe_id, count(*) as n from (select distinct symbol from bars)", "bars")
def a7(spark, sf):
    s = fx.bars(spark, sf).select("symbol").distinct()
    return s.agg(F.sha2(F.concat_ws(",", F.sort_array(F.collect_list("symbol"))), 256).alias("universe_id"), F.count("*").alias("n"))


_HASH = "sha256(entity_id || '|' || cast(cast(floor(value * 100 + 0.5) as bigint) as varchar))"


def _hashed(df):
    return df.withColumn("hash", F.sha2(F.concat_ws("|", "entity_id", F.floor(F.col("value") * 100 + 0.5).cast("long").cast("string")), 256))


@query("a9_payload_hash", f"select source, source_id, revision, {_HASH} as hash from info", "info")
def a9(spark, sf):
    return _hashed(fx.info(spark, sf)).select("source", "source_id", "revision", "hash")


_INGEST = f"""with h as (select *, {_HASH} as hash from info), s as (select source, source_id, revision, min(hash) as hash from h where available_time < timestamp '{AT}' group by all),
b as (select *, first(hash) over w as fst, row_number() over w as nth from h where available_time >= timestamp '{AT}' window w as (partition by source, source_id, revision order by hash)),
o as (select b.*, coalesce(s.hash, case when nth > 1 then fst end) as ag from b left join s using (source, source_id, revision)),
r as (select source, source_id, revision, hash, case when ag is null then 'ACCEPTED' when ag = hash then 'DUPLICATE' else 'RAW_MUTATION_DETECTED' end as outcome from o)"""


def _ingested(spark, sf):
    h = _hashed(fx.info(spark, sf))
    key = ["source", "source_id", "revision"]
    store = h.filter(F.col("available_time") < _at()).groupBy(*key).agg(F.min("hash").alias("hash"))
    return iq.ingest(store, h.filter(F.col("available_time") >= _at()), key, "hash", "hash")


@query("a8_ingest_raw", f"{_INGEST} select * from r", "info")
def a8(spark, sf):
    return _ingested(spark, sf).select("source", "source_id", "revision", "hash", "outcome")


@query("a10_ingestion_report", f"{_INGEST} select source, count(*) as attempted, count(*) filter (outcome = 'ACCEPTED') as accepted, count(*) filter (outcome = 'DUPLICATE') as duplicates, count(*) filter (outcome = 'RAW_MUTATION_DETECTED') as mutations from r group by source", "info")
def a10(spark, sf):
    n = lambda o, k: F.count_if(F.col("outcome") == o).alias(k)
    return _ingested(spark, sf).groupBy("source").agg(F.count("*").alias("attempted"), n("ACCEPTED", "accepted"), n("DUPLICATE", "duplicates"), n("RAW_MUTATION_DETECTED", "mutations"))


@query("a11_bars_to_info", "select 'daily_bar' as source, symbol || ':' || strftime(event_time, '%Y-%m-%d') as source_id, revision, available_time, \"close\" as value from bars", "bars")
def a11(spark, sf):
    return fx.bars(spark, sf).select(F.lit("daily_bar").alias("source"), F.concat_ws(":", "symbol", F.date_format("event_time", "yyyy-MM-dd")).alias("source_id"), "revision", "available_time", F.col("close").alias("value"))


@query("a19_normalize_symbol", "select distinct symbol || case when symbol like '6%' then '.SH' else '.SZ' end as vendor, lpad(regexp_replace('sz' || symbol, '[^0-9]', '', 'g'), 6, '0') as symbol from bars", "bars")
def a19(spark, sf):
    s = fx.bars(spark, sf).select("symbol").distinct()
    return s.select(F.concat("symbol", F.when(F.col("symbol").startswith("6"), ".SH").otherwise(".SZ")).alias("vendor"), F.lpad(F.regexp_replace(F.concat(F.lit("sz"), "symbol"), "[^0-9]", ""), 6, "0").alias("symbol"))


@query("d1_deduplicate", "select source, source_id, revision, entity_id, value from (select *, row_number() over (partition by source, source_id, revision order by available_time, entity_id, value) as rn from info) where rn = 1", "info")
def d1(spark, sf):
    return iq.deduplicate(fx.info(spark, sf)).select("source", "source_id", "revision", "entity_id", "value")


@query("j2_visible_revisions", f"select source, source_id, revision, entity_id, value from (select *, row_number() over (partition by source, source_id order by revision desc, available_time, entity_id, value) as rn from info where available_time <= timestamp '{AT}') where rn = 1", "info")
def j2(spark, sf):
    return iq.visible_revisions(fx.info(spark, sf), _at()).select("source", "source_id", "revision", "entity_id", "value")


@query("q3_conflict_groups", "select entity_id, entity_type, event_time, count(distinct source) as sources, count(distinct value) as \"values\" from info group by all having count(distinct source) > 1 and count(distinct value) > 1", "info")
def q3(spark, sf):
    return iq.conflict_groups(fx.info(spark, sf))


@query("q4_annotate_conflicts", "with c as (select entity_id, event_time from info group by all having count(distinct source) > 1 and count(distinct value) > 1) select source, source_id, revision, c.entity_id is not null as conflict from info i left join c on c.entity_id = i.entity_id and c.event_time is not distinct from i.event_time", "info")
def q4(spark, sf):
    i = fx.info(spark, sf)
    c = iq.conflict_groups(i).select(F.col("entity_id").alias("ce"), F.col("event_time").alias("ct"))
    return i.join(c, (F.col("entity_id") == F.col("ce")) & F.col("event_time").eqNullSafe(F.col("ct")), "left").select("source", "source_id", "revision", F.col("ce").isNotNull().alias("conflict"))


@query("q5_reconcile", "select entity_id, event_time, string_agg(distinct source, ',' order by source) as sources, case when count(distinct source) < 2 then 'INSUFFICIENT_SOURCES' when max(value) - min(value) <= greatest(1.0, 0.1 * max(abs(value))) then 'CONSISTENT' else 'CONFLICT' end as status from info group by all", "info")
def q5(spark, sf):
    return iq.reconcile(fx.info(spark, sf), 1.0, 0.1).select("entity_id", "event_time", "sources", "status")


@query("q7_timestamp_issues", f"select issue, count(*) as n from (select unnest([case when ingested_at < available_time then 'INGESTED_BEFORE_AVAILABLE' end, case when available_time < event_time then 'AVAILABLE_BEFORE_EVENT' end, case when available_time > timestamp '{AT}' then 'FUTURE' end]) as issue from info) where issue is not null group by issue", "info")
def q7(spark, sf):
    issues = iq.timestamp_issues(F.col("event_time"), F.col("available_time"), F.col("ingested_at"), _at())
    return fx.info(spark, sf).select(F.explode(issues).alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


@query("q8_revision_integrity", """with p as (select source, source_id, revision, count(distinct (value, entity_id)) as payloads, min(available_time) as t from info group by all),
x as (select *, revision - lag(revision) over w as gap, lag(t) over w as bef from p window w as (partition by source, source_id order by revision))
select source, source_id, count(*) filter (payloads > 1) as mutated, count(*) filter (gap > 1) as gaps, count(*) filter (t < bef) as regressions from x group by all""", "info")
def q8(spark, sf):
    return iq.revision_issues(fx.info(spark, sf))


@query("q2_freshness", f"with a as (select source, case source when 'cn_stock_quote' then 400 when 'cn_index_daily' then 100 end as days, available_time from info), s as (select source, case when days is null then 'missing_policy' when available_time is null then 'unknown' when epoch(timestamp '{AT}') - epoch(available_time) <= days * 86400 then 'fresh' else 'stale' end as status from a) select source, status, count(*) as n from s group by all", "info")
def q2(spark, sf):
    days = F.when(F.col("source") == "cn_stock_quote", 400).when(F.col("source") == "cn_index_daily", 100)
    return fx.info(spark, sf).groupBy("source", iq.freshness(F.col("available_time"), _at(), days).alias("status")).agg(F.count("*").alias("n"))


@query("q10_record_decision", f"""select source, source_id, revision, case when available_time < event_time then 'REJECTED' when available_time > timestamp '{AT}' then 'UNRESOLVED' when revision > 3 then 'ADMISSIBLE_WITH_WARNING' else 'ADMISSIBLE' end as decision from info""", "info")
def q10(spark, sf):
    d = F.when(F.col("available_time") < F.col("event_time"), "REJECTED").when(F.col("available_time") > _at(), "UNRESOLVED").when(F.col("revision") > 3, "ADMISSIBLE_WITH_WARNING").otherwise("ADMISSIBLE")
    return fx.info(spark, sf).select("source", "source_id", "revision", d.alias("decision"))


@query("d6_classify_pairs", """with e as (select s.symbol, d.m from (select distinct symbol from bars) s, (select distinct date_trunc('month', trade_date)::date as m from bars) d), a as (select distinct symbol, date_trunc('month', trade_date)::date as m from bars where volume > 30)
select e.symbol, e.m as month, case when a.symbol is not null then 'OBSERVED' when month(e.m) = 2 then 'EXPECTED_ABSENCE' else 'UNEXPECTED_MISSING' end as status from e left join a using (symbol, m)""", "bars")
def d6(spark, sf):
    b = fx.bars(spark, sf).select("symbol", F.trunc("trade_date", "month").alias("month"), "volume")
    days = b.select("month", (F.month("month") == 2).alias("closed"))
    return ex.classify_pairs(b, days, b.filter("volume > 30"), b.filter("false"), "symbol", "month")


@query("d12_coverage_start", "with c as (select symbol, min(effective_from) as start from membership group by symbol) select b.symbol, c.start, case when c.start is null then 'NO_COVERAGE' when c.start > b.first then 'PARTIAL_COVERAGE' else 'OK' end as status from (select symbol, min(trade_date) as first from bars group by symbol) b left join c using (symbol)", "bars membership")
def d12(spark, sf):
    c = fx.membership(spark, sf).groupBy("symbol").agg(F.min("effective_from").alias("start"))
    b = fx.bars(spark, sf).groupBy("symbol").agg(F.min("trade_date").alias("first"))
    s = F.when(F.col("start").isNull(), "NO_COVERAGE").when(F.col("start") > F.col("first"), "PARTIAL_COVERAGE").otherwise("OK")
    return b.join(c, "symbol", "left").select("symbol", "start", s.alias("status"))


@query("d13_interval_overlaps", "select symbol, effective_from, effective_to, coalesce(nf < effective_to or effective_to is null and nf is not null, false) as overlaps from (select *, lead(effective_from) over (partition by symbol order by effective_from) as nf from membership)", "membership")
def d13(spark, sf):
    nf = F.lead("effective_from").over(Window.partitionBy("symbol").orderBy("effective_from"))
    x = fx.membership(spark, sf).withColumn("nf", nf)
    return x.select("symbol", "effective_from", "effective_to", F.coalesce((F.col("nf") < F.col("effective_to")) | (F.col("effective_to").isNull() & F.col("nf").isNotNull()), F.lit(False)).alias("overlaps"))


@query("j10_universe_gap", "select distinct lpad(cast(c_custkey as varchar), 6, '0') as symbol from customer where lpad(cast(c_custkey as varchar), 6, '0') not in (select symbol from recommendations where action = 'BUY')", "recommendations")
def j10(spark, sf):
    c = fx.table(spark, sf, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 6, "0").alias("symbol")).distinct()
    return c.join(fx.recommendations(spark, sf).filter("action = 'BUY'"), "symbol", "left_anti")


@query("j13_ledger_view", "select r.record_id, r.symbol, r.action, o.r1, o.r10, v.verdict from recommendations r left join (select record_id, max(actual_return) filter (horizon = 1) as r1, max(actual_return) filter (horizon = 10) as r10 from outcomes group by record_id) o using (record_id) left join (select record_id, max_by(verdict, seq) as verdict from reviews group by record_id) v using (record_id)", "recommendations outcomes reviews")
def j13(spark, sf):
    at = lambda h: F.max(F.when(F.col("horizon") == h, F.col("actual_return"))).alias(f"r{h}")
    o = fx.outcomes(spark, sf).groupBy("record_id").agg(at(1), at(10))
    v = fx.reviews(spark, sf).groupBy("record_id").agg(F.max_by("verdict", "seq").alias("verdict"))
    return fx.recommendations(spark, sf).join(o, "record_id", "left").join(v, "record_id", "left").select("record_id", "symbol", "action", "r1", "r10", "verdict")


_SIGNED = "case action when 'BUY' then actual_return when 'SELL' then -actual_return when 'HOLD' then actual_return else 0 end"


def _judged(spark, sf):
    s = F.when(F.col("action").isin("BUY", "HOLD"), F.col("actual_return")).when(F.col("action") == "SELL", -F.col("actual_return")).otherwise(0.0)
    return fx.outcomes(spark, sf).join(fx.recommendations(spark, sf), "record_id").withColumn("signed", s)


@query("g3_outcome_stats", f"with x as (select horizon, actual_return, {_SIGNED} as s from outcomes join recommendations using (record_id)) select horizon, count(*) as samples, count(*) filter (s > 0) as correct, count(*) filter (s < 0) as incorrect, count(*) filter (s = 0) as unresolved, rnd(count(*) filter (s > 0)::double / count(*) filter (s <> 0), 9) as hit_rate, rnd(avg(actual_return), 9) as mean_return from x group by horizon", "recommendations outcomes")
def g3(spark, sf):
    s = F.col("signed")
    return _judged(spark, sf).groupBy("horizon").agg(F.count("*").alias("samples"), F.count_if(s > 0).alias("correct"), F.count_if(s < 0).alias("incorrect"), F.count_if(s == 0).alias("unresolved"), rnd(F.try_divide(F.count_if(s > 0), F.count_if(s != 0))).alias("hit_rate"), rnd(F.avg("actual_return")).alias("mean_return"))


@query("g5_review_outcome", f"select record_id, horizon, case when {_SIGNED} > 0 then 'CORRECT' when {_SIGNED} < 0 then 'INCORRECT' else 'UNRESOLVED' end as outcome from outcomes join recommendations using (record_id)", "recommendations outcomes")
def g5(spark, sf):
    s = F.col("signed")
    return _judged(spark, sf).select("record_id", "horizon", F.when(s > 0, "CORRECT").when(s < 0, "INCORRECT").otherwise("UNRESOLVED").alias("outcome"))


@query("g1_idempotent_append", "select r.record_id, r.symbol from recommendations r where r.record_id % 5 <> 0", "recommendations")
def g1(spark, sf):
    r = fx.recommendations(spark, sf)
    return r.join(r.filter("record_id % 5 = 0").select("record_id"), "record_id", "left_anti").select("record_id", "symbol")


@query("g2_filter_view", "select record_id, symbol, decision_time from recommendations where action = 'BUY' and decision_time >= timestamp '1997-01-01' and decision_time < timestamp '1998-01-01'", "recommendations")
def g2(spark, sf):
    t = lambda s: F.lit(s).cast("timestamp_ntz")
    return fx.recommendations(spark, sf).filter((F.col("action") == "BUY") & (F.col("decision_time") >= t("1997-01-01")) & (F.col("decision_time") < t("1998-01-01"))).select("record_id", "symbol", "decision_time")


@query("g6_due_horizons", "select record_id, h as horizon from recommendations, (values (1), (3), (5), (10)) x(h) where record_id % 4 <> 3 and decision_time + to_days(h) <= timestamp '2000-01-01'", "recommendations")
def g6(spark, sf):
    x = fx.recommendations(spark, sf).filter("record_id % 4 <> 3").select("record_id", "decision_time", F.explode(F.array(*map(F.lit, (1, 3, 5, 10)))).alias("horizon"))
    return x.filter(F.col("decision_time") + F.make_dt_interval(F.col("horizon")) <= F.lit("2000-01-01").cast("timestamp_ntz")).select("record_id", "horizon")


@query("g7_aggregate_outcomes", "select action, horizon, rnd(avg(actual_return), 9) as actual, rnd(avg(probability - 0.5), 9) as expected, rnd(avg(abs(actual_return - (probability - 0.5))), 9) as abs_error from outcomes join recommendations using (record_id) group by all", "recommendations outcomes")
def g7(spark, sf):
    e = F.col("probability") - 0.5
    return _judged(spark, sf).groupBy("action", "horizon").agg(rnd(F.avg("actual_return")).alias("actual"), rnd(F.avg(e)).alias("expected"), rnd(F.avg(F.abs(F.col("actual_return") - e))).alias("abs_error"))


@query("g8_record_validation", "select record_id, action in ('BUY', 'HOLD', 'SELL', 'NO_ACTION') and probability between 0 and 1 as valid from recommendations", "recommendations")
def g8(spark, sf):
    return fx.recommendations(spark, sf).select("record_id", (F.col("action").isin("BUY", "HOLD", "SELL", "NO_ACTION") & F.col("probability").between(0, 1)).alias("valid"))


@query("i1_vwap", "select symbol, cast(ts as date) as day, rnd(sum(price * hands) / sum(hands), 6) as vwap, sum(hands)::bigint as volume, coalesce(sum(hands) filter (side = 'B'), 0)::bigint as buy, coalesce(sum(hands) filter (side = 'S'), 0)::bigint as sell from ticks group by all", "ticks")
def i1(spark, sf):
    side = lambda s: F.coalesce(F.sum(F.when(F.col("side") == s, F.col("hands"))), F.lit(0)).cast("long")
    return fx.ticks(spark, sf).groupBy("symbol", F.to_date("ts").alias("day")).agg(rnd(F.try_divide(F.sum(F.col("price") * F.col("hands")), F.sum("hands")), 6).alias("vwap"), F.sum("hands").cast("long").alias("volume"), side("B").alias("buy"), side("S").alias("sell"))


@query("i2_minute_bars", "select symbol, time_bucket(interval 30 minute, ts) as start, arg_min(price, (ts, event_id)) as \"open\", max(price) as high, min(price) as low, arg_max(price, (ts, event_id)) as \"close\", sum(hands)::bigint as volume from ticks group by all", "ticks")
def i2(spark, sf):
    order = F.struct("ts", "event_id")
    t = fx.ticks(spark, sf).groupBy("symbol", F.window("ts", "30 minutes").alias("w"))
    return t.agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("hands").cast("long").alias("volume")).select("symbol", F.col("w.start").alias("start"), "open", "high", "low", "close", "volume")


SCALES = (1, 5, 15, 30, 60)


@query("i2_minute_bars_scales", " union all ".join(f"select {n} as minutes, symbol, time_bucket(interval {n} minute, ts) as start, arg_min(price, (ts, event_id)) as \"open\", max(price) as high, min(price) as low, arg_max(price, (ts, event_id)) as \"close\", sum(hands)::bigint as volume from ticks group by all" for n in SCALES), "ticks")
def i2_scales(spark, sf):
    order = F.struct("ts", "event_id")
    out = None
    for n in SCALES:
        t = fx.ticks(spark, sf).groupBy("symbol", F.window("ts", f"{n} minutes").alias("w"))
        bars = t.agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("hands").cast("long").alias("volume"))
        bars = bars.select(F.lit(n).alias("minutes"), "symbol", F.col("w.start").alias("start"), "open", "high", "low", "close", "volume")
        out = bars if out is None else out.unionByName(bars)
    return out


@query("i28_action_changes", "select * from (select record_id, symbol, action, lag(action) over w as previous, row_number() over w as cycle from recommendations window w as (partition by symbol order by decision_time, record_id)) where previous is null or previous <> action", "recommendations")
def i28(spark, sf):
    w = Window.partitionBy("symbol").orderBy("decision_time", "record_id")
    x = fx.recommendations(spark, sf).select("record_id", "symbol", "action", F.lag("action").over(w).alias("previous"), F.row_number().over(w).alias("cycle"))
    return x.filter("previous is null or previous <> action")


@query("f12_event_factor", "select lpad(cast(user_id as varchar), 6, '0') as symbol, rnd(sum(case event_type when 'purchase' then 1.0::double when 'error' then -1.0::double else 0.0::double end * (event_id % 10) / 10.0::double), 6) as event_factor from events group by 1")
def f12(spark, sf):
    e = fx.table(spark, sf, "events")
    weight = F.when(F.col("event_type") == "purchase", 1.0).when(F.col("event_type") == "error", -1.0).otherwise(0.0)
    return e.groupBy(F.lpad(F.col("user_id").cast("string"), 6, "0").alias("symbol")).agg(rnd(F.sum(weight * (F.col("event_id") % 10) / 10.0), 6).alias("event_factor"))


@query("f18_moving_averages", """with f as (select symbol, trade_date, final, volume from settled) select symbol, trade_date, rnd(avg(final) over (w rows 4 preceding), 6) as ma5, rnd(avg(final) over (w rows 19 preceding), 6) as ma20, rnd(volume / avg(volume) over (w rows 19 preceding), 6) as lr,
max(final) over (w rows 19 preceding) as high20, min(final) over (w rows 19 preceding) as low20, lag(final) over w as prev_close, rnd((final / lag(final) over w - 1) * 100, 6) as pct from f window w as (partition by symbol order by trade_date)""", "settled")
def f18(spark, sf):
    f = fx.bars(spark, sf).groupBy("symbol", "trade_date").agg(F.max_by("close", "revision").alias("final"), F.max_by("volume", "revision").alias("volume"))
    w = Window.partitionBy("symbol").orderBy("trade_date")
    r = lambda n: w.rowsBetween(-n + 1, 0)
    prev = F.lag("final").over(w)
    return f.select("symbol", "trade_date", rnd(F.avg("final").over(r(5)), 6).alias("ma5"), rnd(F.avg("final").over(r(20)), 6).alias("ma20"), rnd(F.try_divide(F.col("volume"), F.avg("volume").over(r(20))), 6).alias("lr"), F.max("final").over(r(20)).alias("high20"), F.min("final").over(r(20)).alias("low20"), prev.alias("prev_close"), rnd((F.col("final") / prev - 1) * 100, 6).alias("pct"))
