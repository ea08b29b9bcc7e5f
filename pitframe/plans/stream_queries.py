"""Queries that run a stream over the events to its end and return its result."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..fixtures import rnd
from ..streaming import jobs
from .registry import query


# Ticks come in five batches; every fiftieth comes a day late. A batch closes the windows that end before the newest tick of the batches before it, less ten
# minutes; in the batch after that, rows of closed windows are late. What the newest tick of all, less ten minutes, has passed is finished.
_FEED = """
came_ as (select *, ts + case when event_id % 50 = 0 then interval 26 hour else interval 0 hour end as came from ticks),
fed_ as (select *, least(4, (extract(day from came) - 1) // 6)::int as batch from came_),
newest_ as (select batch, max(ts) as newest from fed_ group by batch),
marks_ as (select batch, max(newest) over (order by batch rows between unbounded preceding and 2 preceding) - interval 10 minute as mark, (select max(ts) from fed_) - interval 10 minute as last from newest_),
fed as (select fed_.*, mark, last from fed_ join marks_ using (batch))"""


def _feed(spark, sf):
    """The ticks with their batch, and as a stream of these batches."""
    t = fx.ticks(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    came = F.when(F.col("event_id") % 50 == 0, F.col("ts") + F.expr("interval 26 hours")).otherwise(F.col("ts"))
    return t, jobs.replay(t.withColumn("batch", F.least(F.lit(4), F.floor((F.dayofmonth(came) - 1) / 6)).cast("int")), "batch", "tick-feed")


def _with_late(found, rows, keys):
    """Finished windows with the number of their rows that came too late: counted over all rows, less those taken."""
    return found.join(rows.groupBy(*keys).agg(F.count("*").alias("all")), keys).withColumn("late", F.col("all") - F.col("n")).drop("all", "n")


@query("s2_stream_minute_bars", f"""
with {_FEED}, w as (select *, time_bucket(interval 30 minute, ts) as start, coalesce(time_bucket(interval 30 minute, ts) + interval 30 minute <= mark, false) as gone from fed)
select symbol, start, arg_min(price, (ts, event_id)) filter (not gone) as "open", max(price) filter (not gone) as high, min(price) filter (not gone) as low, arg_max(price, (ts, event_id)) filter (not gone) as "close",
sum(hands) filter (not gone)::bigint as volume, count(*) filter (gone) as late from w where start + interval 30 minute <= last group by symbol, start having count(*) filter (not gone) > 0""", "ticks")
def s2(spark, sf):
    t, feed = _feed(spark, sf)
    found = jobs.finished(jobs.minute_bars(feed, 30), "minute-bars")
    return _with_late(found, t.select("symbol", F.window("ts", "30 minutes")["start"].alias("start")), ["symbol", "start"]).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("s3_stream_vwap", f"""
with {_FEED}, w as (select *, cast(ts as date) as day, coalesce(cast(ts as date) + interval 1 day <= mark, false) as gone from fed)
select symbol, day, rnd(sum(price * hands) filter (not gone) / sum(hands) filter (not gone), 6) as vwap, sum(hands) filter (not gone)::bigint as volume, coalesce(sum(hands) filter (side = 'B' and not gone), 0)::bigint as buy,
coalesce(sum(hands) filter (side = 'S' and not gone), 0)::bigint as sell, count(*) filter (gone) as late from w where day + interval 1 day <= last group by symbol, day having count(*) filter (not gone) > 0""", "ticks")
def s3(spark, sf):
    t, feed = _feed(spark, sf)
    found = jobs.finished(jobs.running_vwap(feed), "vwap")
    return _with_late(found, t.select("symbol", F.to_date("ts").alias("day")), ["symbol", "day"]).withColumn("vwap", rnd("vwap", 6))


@query("s4_stream_side_counts", f"""
with {_FEED}, b as (select unnest([time_bucket(interval 30 minute, ts), time_bucket(interval 30 minute, ts) - interval 30 minute]) as start, side, mark, last from fed), w as (select *, coalesce(start + interval 1 hour <= mark, false) as gone from b)
select start, count(*) filter (side = 'B' and not gone) as buys, count(*) filter (side = 'S' and not gone) as sells, count(*) filter (not gone) as taken, count(*) filter (gone) as late from w where start + interval 1 hour <= last group by start having count(*) filter (not gone) > 0""", "ticks")
def s4(spark, sf):
    t, feed = _feed(spark, sf)
    found = jobs.finished(jobs.side_counts(feed), "sides").withColumn("taken", F.col("n"))
    return _with_late(found, t.select(F.window("ts", "1 hour", "30 minutes")["start"].alias("start")), ["start"]).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("s1_stream_ingest", f"""
with {_FEED}, h as (select *, cast(hands % 3 as varchar) as hash, first(cast(hands % 3 as varchar)) over w as f, row_number() over w as nth from fed window w as (partition by symbol, side order by batch, event_id))
select event_id, symbol, side, hash, case when nth = 1 then 'ACCEPTED' when hash = f then 'DUPLICATE' else 'RAW_MUTATION_DETECTED' end as outcome from h""", "ticks")
def s1(spark, sf):
    """Every tick as an attempt to write the payload of its symbol and side, in five batches."""
    _, feed = _feed(spark, sf)
    rows = feed.select("event_id", "symbol", "side", (F.col("hands") % 3).cast("string").alias("hash"))
    return jobs.finished(jobs.ingest_attempts(rows, ["symbol", "side"], "hash", ["event_id"]), "ingest")


@query("s5_stream_late_revisions", "select symbol, trade_date, revision, date_diff('hour', cast(trade_date as timestamp) + interval 8 hour, available_time) as hours from late_bars where available_time > cast(trade_date as timestamp) + interval 8 hour and symbol in (select symbol from membership)", "late_bars membership")
def s5(spark, sf):
    stream = jobs.table_stream(fx.late_bars(spark, sf), "bars-feed", 4, "available_time")
    late = jobs.late_revisions(stream, fx.membership(spark, sf)).select("symbol", "trade_date", "revision", "hours")
    return jobs.latest(late, ["symbol", "trade_date", "revision"], "late", "append")


@query("s6_stream_ledger", "select record_id, any_value(symbol) as symbol from recommendations group by record_id", "recommendations")
def s6(spark, sf):
    """Every third record arrives twice, 400 days later, and so in another batch; keys are held for 500 days of event time."""
    r = fx.recommendations(spark, sf).select("record_id", "symbol", F.col("decision_time").cast("timestamp").alias("decision_time"))
    again = r.filter("record_id % 3 = 0").withColumn("decision_time", F.col("decision_time") + F.expr("interval 400 days"))
    feed = jobs.table_stream(r.unionByName(again), "ledger-feed", 4, "decision_time")
    return jobs.finished(jobs.ledger_appends(feed, ["record_id"], "decision_time", "500 days"), "ledger").select("record_id", "symbol")


@query("s7_stream_action_alerts", """
with g as (select *, decision_time - lag(decision_time) over w > interval 120 day as apart from recommendations window w as (partition by symbol order by decision_time, record_id)),
n as (select *, sum(coalesce(apart, false)::int) over (partition by symbol order by decision_time, record_id) as spell from g), l as (select *, lag(action) over (partition by symbol, spell order by decision_time, record_id) as previous from n)
select symbol, decision_time, record_id, action, previous, sum((previous is null or previous <> action)::int) over (partition by symbol, spell order by decision_time, record_id)::bigint as changes from l qualify previous is null or previous <> action""", "recommendations")
def s7(spark, sf):
    """Changes of action by symbol; one that has been silent for 120 days starts anew."""
    r = fx.recommendations(spark, sf).select("symbol", F.col("decision_time").cast("timestamp").alias("decision_time"), "record_id", "action")
    alerts = jobs.finished(jobs.action_alerts(jobs.table_stream(r, "action-feed", 4, "decision_time")), "alerts")
    return alerts.withColumn("decision_time", F.col("decision_time").cast("timestamp_ntz"))


@query("s4_stream_breadth", """
with t as (select symbol, ts, price, lag(price) over (partition by symbol order by ts, event_id) as prev from ticks), m as (select ts, (price / prev - 1) * 100 as pct from t where prev > 0), b as (select unnest([time_bucket(interval 30 minute, ts), time_bucket(interval 30 minute, ts) - interval 30 minute]) as start, pct from m)
select start, count(*) filter (pct >= 0) as up, count(*) filter (pct < 0) as down, count(*) filter (pct >= 9.8) as limit_up, count(*) filter (pct <= -9.8) as limit_down, count(*) as n from b group by start""", "ticks")
def s4_breadth(spark, sf):
    """Moves arrive with the price before them, as quotes do; the window slides by half an hour."""
    from pyspark.sql import Window

    t = fx.ticks(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")).withColumn("prev", F.lag("price").over(Window.partitionBy("symbol").orderBy("ts", "event_id")))
    quotes = t.filter("prev > 0").select("ts", ((F.col("price") / F.col("prev") - 1) * 100).alias("pct"))
    return jobs.latest(jobs.breadth(jobs.table_stream(quotes, "quote-feed", 4, "ts")), ["start"], "breadth").withColumn("start", F.col("start").cast("timestamp_ntz"))
