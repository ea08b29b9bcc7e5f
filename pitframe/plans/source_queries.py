"""Queries: reading, merging and normalising sources; admission of provider answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..fixtures import rnd
from ..operators import boundary as bo
from ..operators import infoquality as iq
from ..operators import metrics as me
from ..operators import portfolio as po
from ..sources import bars as sb
from ..sources import provider
from ..sources.scratch import new_path
from ..streaming import jobs
from .registry import query

SYMBOLS = ["000001", "000002", "000005"]
_IN = "('000001', '000002', '000005')"
AT = "1996-01-01 00:00:00"
CN_REGISTRY = "(values ('cn_stock_quote', 'intraday'), ('cn_index_daily', 'daily'), ('macro_pmi_cn', 'monthly')) g(source, policy)"


@query("a1_read_bars", f'select symbol, event_time, revision, "close", volume from bars where symbol in {_IN}', "bars")
def a1(spark, sf):
    path = new_path(spark, "bars")
    sb.write_bars(fx.bars(spark, sf), path)
    return sb.read_bars(spark, path, SYMBOLS).select("symbol", "event_time", "revision", "close", "volume")


@query("a2_upsert_bars", """
with n as (select *, 1 as turn from (select symbol, event_time, revision, rnd("close" * 1.02, 4) as "close" from bars where extract(day from trade_date) % 3 = 0 union all select symbol, event_time, 5, "close" from bars where revision = 1)),
u as (select * from n union all select symbol, event_time, revision, "close", 0 from bars)
select symbol, event_time, revision, max_by("close", turn) as "close" from u group by symbol, event_time, revision""", "bars")
def a2(spark, sf):
    b = fx.bars(spark, sf)
    changed = b.filter(F.dayofmonth("trade_date") % 3 == 0).withColumn("close", rnd(F.col("close") * 1.02, 4))
    return sb.upsert_bars(b, changed.unionByName(b.filter("revision = 1").withColumn("revision", F.lit(5)))).select("symbol", "event_time", "revision", "close")


_STAMPS = """
with t as (select source, source_id, revision, strftime(event_time, '%Y-%m-%dT%H:%M:%S+08:00') as event, case k % 5 when 0 then null when 1 then strftime(available_time, '%Y-%m-%dT%H:%M:%S') when 2 then 'soon' else strftime(available_time, '%Y-%m-%dT%H:%M:%S+08:00') end as available from info),
r as (select *, case when available is null then 'MISSING' when available = 'soon' then 'MALFORMED' when not regexp_matches(available, '[+-][0-9]{2}:[0-9]{2}$') then 'NAIVE' when available < event then 'BACKWARDS' end as reason from t)
"""


def _stamped(spark, sf):
    text = lambda c, tail: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss" + tail)
    kind = F.col("k") % 5
    available = F.when(kind == 1, text("available_time", "")).when(kind == 2, "soon").when(kind > 2, text("available_time", "'+08:00'"))
    t = fx.info(spark, sf).select("source", "source_id", "revision", text("event_time", "'+08:00'").alias("event"), available.alias("available"))
    return t.withColumn("reason", sb.stamp_problem(F.col("event"), F.col("available")))


@query("a3_reject_stamps", _STAMPS + "select source, source_id, revision, reason from r where reason is not null", "info")
def a3(spark, sf):
    return _stamped(spark, sf).filter("reason is not null").select("source", "source_id", "revision", "reason")


@query("a3_good_stamps", _STAMPS + "select source, source_id, revision, event, available from r where reason is null", "info")
def a3_good(spark, sf):
    return _stamped(spark, sf).filter("reason is null").drop("reason")


@query("a10_ingestion_status", _STAMPS + """, c as (select source, count(*) as attempted, count(*) filter (reason is null) as accepted, count(*) filter (reason is not null) as rejected, count(*) filter (reason = 'MALFORMED') as malformed from r group by source)
select s.source, coalesce(attempted, 0) as attempted, coalesce(accepted, 0) as accepted, coalesce(rejected, 0) as rejected, case when coalesce(attempted, 0) = 0 then 'EMPTY_SUCCESS' when malformed = attempted then 'PARSE_ERROR' when rejected > 0 then 'PARTIAL' else 'OK' end as status
from (values ('cn_stock_quote'), ('cn_index_daily'), ('company_announcement'), ('macro_pmi_cn')) s(source) left join c using (source)""", "info")
def a10(spark, sf):
    names = spark.createDataFrame([("cn_stock_quote",), ("cn_index_daily",), ("company_announcement",), ("macro_pmi_cn",)], "source string")
    bad = F.col("reason").isNotNull()
    c = _stamped(spark, sf).groupBy("source").agg(F.count("*").alias("attempted"), F.count_if(~bad).alias("accepted"), F.count_if(bad).alias("rejected"), F.count_if(F.col("reason") == "MALFORMED").alias("malformed"))
    x = names.join(c, "source", "left").fillna(0)
    status = F.when(F.col("attempted") == 0, "EMPTY_SUCCESS").when(F.col("malformed") == F.col("attempted"), "PARSE_ERROR").when(F.col("rejected") > 0, "PARTIAL").otherwise("OK")
    return x.select("source", "attempted", "accepted", "rejected", status.alias("status"))


@query("a2_merge_months", """
with old as (select symbol, event_time, revision, "close", 0 as turn, 0 as seq from bars where revision = 0),
new as (select symbol, event_time, revision, rnd("close" * (1 + seq / 100.0::double), 4) as "close", 1 as turn, seq from bars, (values (1), (2)) v(seq) where revision = 0 and extract(month from trade_date) = 3 and (seq = 1 or cast(symbol as integer) % 2 = 0)),
x as (select *, row_number() over (partition by symbol, event_time, revision order by turn desc, seq desc) as nth from (select * from old union all select * from new))
select symbol, event_time, revision, "close" from x where nth = 1""", "bars")
def a2_merge(spark, sf):
    """Bars of every March come again, some of them twice in one batch, and only the Marches are written."""
    path, b = new_path(spark, "bars"), fx.bars(spark, sf).filter("revision = 0")
    sb.write_bars(b, path)
    again = b.filter("month(trade_date) = 3").withColumn("seq", F.explode(F.array(F.lit(1), F.lit(2)))).filter("seq = 1 or cast(symbol as int) % 2 = 0")
    sb.merge_bars(spark, path, again.withColumn("close", rnd(F.col("close") * (1 + F.col("seq") / 100.0), 4)), "seq")
    return sb.read_bars(spark, path).select("symbol", "event_time", "revision", "close")


@query("a4_vendor_bars", """
select symbol, event_time, available_time, "close", volume, case when cast(symbol as integer) % 2 = 0 then amount end as amount, 'cn_stock' as asset_scope from bars where revision = 0""", "bars")
def a4(spark, sf):
    b = fx.bars(spark, sf).filter("revision = 0").withColumn("date", F.col("trade_date").cast("string")).withColumn("symbol", F.col("symbol").cast("int"))
    lots = b.filter("symbol % 2 = 1").withColumn("amount", F.col("volume") / 100)
    every = sb.normalize_vendor_bars(b.filter("symbol % 2 = 0"), "shares").unionByName(sb.normalize_vendor_bars(lots, "lots"))
    return every.select("symbol", "event_time", "available_time", "close", rnd("volume", 4).alias("volume"), "amount", "asset_scope")


@query("a5_index_bars", """select symbol, event_time, available_time, "close", 'cn_index' as asset_scope from index_bars""", "index_bars")
def a5(spark, sf):
    i = fx.index_bars(spark, sf)
    raw = i.select(F.col("symbol"), F.col("trade_date").alias("date"), *[F.col("close").alias(c) for c in ("open", "high", "low", "close")], F.lit(0.0).alias("volume"), F.lit(0.0).alias("amount"))
    return sb.normalize_vendor_bars(raw, "shares", "cn_index").select("symbol", "event_time", "available_time", "close", "asset_scope")


@query("a6_membership_csv", "select symbol, industry_code, effective_from, effective_to, available_time from membership", "membership")
def a6(spark, sf):
    path = new_path(spark, "membership")
    m = fx.membership(spark, sf).select(F.col("symbol"), "industry_code", "effective_from", "effective_to", F.date_format("available_time", "yyyy-MM-dd HH:mm:ss").alias("available_time"))
    m.write.option("header", True).csv(path)
    return sb.read_membership_csv(spark, path)


@query("a12_project_info", f"""
select i.source, source_id, revision, case when k % 6 = 0 then null else available_time end as available_time, case when k % 6 = 0 then 'UNRESOLVED' else 'VALID' end as quality_status, policy as freshness_policy_id
from info i left join {CN_REGISTRY} on g.source = i.source""", "info")
def a12(spark, sf):
    registry = spark.createDataFrame([("cn_stock_quote", "intraday"), ("cn_index_daily", "daily"), ("macro_pmi_cn", "monthly")], "source string, policy string")
    raw = fx.info(spark, sf).withColumn("available_time", F.when(F.col("k") % 6 != 0, F.col("available_time")))
    return iq.project_info(raw.withColumn("quality_status", F.lit("VALID")), registry).select("source", "source_id", "revision", "available_time", "quality_status", "freshness_policy_id")


@query("a13_source_projections", """
select case source when 'cn_stock_quote' then 'us_index_daily' else source end as source, source_id, revision, case source when 'company_announcement' then 'LISTED_COMPANY' else 'INDEX' end as entity_type,
case when source <> 'company_announcement' then value end as value, case when source <> 'company_announcement' then 'points' end as unit, case source when 'cn_stock_quote' then 'USD' end as currency, case source when 'company_announcement' then 'report ' || entity_id end as content from info
union all select 'macro_pmi_cn', source_id, revision, 'ECONOMY', value, 'index', null, null from info where k % 10 = 0""", "info")
def a13(spark, sf):
    i = fx.info(spark, sf).withColumn("payload", F.struct("source_id", "revision", F.col("value").alias("close"), "value", F.concat(F.lit("report "), "entity_id").alias("content")))
    pick = lambda kind, rows: iq.source_projection(rows, kind)
    parts = [pick("cn_index_daily", i.filter("source = 'cn_index_daily'")), pick("us_index_daily", i.filter("source = 'cn_stock_quote'")), pick("company_announcement", i.filter("source = 'company_announcement'")), pick("macro_pmi_cn", i.filter("k % 10 = 0"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("a14_minute_points", "select symbol, ts as event_time, event_id, 5 as scale, price as \"close\", hands as volume, date_trunc('day', ts) + interval 1 day as available_time from ticks", "ticks")
def a14(spark, sf):
    bar = F.struct(F.col("ts").alias("time"), F.col("event_id"), F.col("price").alias("close"), F.col("hands").alias("volume"))
    nested = fx.ticks(spark, sf).groupBy("symbol", F.date_trunc("day", F.col("ts")).alias("day")).agg(F.collect_list(bar).alias("klines"))
    payload = nested.select("symbol", F.lit(5).alias("scale"), (F.col("day").cast("timestamp_ntz") + fx.hours(24)).alias("fetched_at"), "klines")
    return payload.select("symbol", "scale", F.col("fetched_at").alias("available_time"), F.explode("klines").alias("b")).select("symbol", F.col("b.time").alias("event_time"), F.col("b.event_id").alias("event_id"), "scale", F.col("b.close").alias("close"), F.col("b.volume").alias("volume"), "available_time")


def _minute_payloads(spark, sf, folders=True):
    """What a provider answers for each symbol and day, as JSON files, below a folder for each symbol or packed."""
    bar = F.struct(F.col("ts").alias("time"), F.col("event_id"), F.col("price").alias("close"), F.col("hands").alias("volume"))
    days = fx.ticks(spark, sf).groupBy("symbol", F.to_date("ts").alias("day")).agg(F.collect_list(bar).alias("klines"))
    payloads = days.select("symbol", F.lit(5).alias("scale"), F.date_add("day", 1).cast("timestamp_ntz").alias("fetched_at"), "klines")
    return provider.write_payloads(payloads, new_path(spark, "minute-payloads"), folders)


_MINUTES = "select symbol, ts as event_time, event_id, 5 as scale, price as \"close\", hands as volume, date_trunc('day', ts) + interval 1 day as available_time from ticks"


@query("a14_minute_source", f"{_MINUTES} where cast(symbol as integer) % 5 = 1", "ticks")
def a14_source(spark, sf):
    """The minute points of some symbols through the data source, which opens only their files."""
    provider.register(spark)
    path = _minute_payloads(spark, sf)
    wanted = [r[0] for r in fx.ticks(spark, sf).select("symbol").distinct().filter(F.col("symbol").cast("int") % 5 == 1).collect()]  # a user's list of symbols
    return spark.read.format("provider").option("adapter", "minutes").option("path", path).load().filter(F.col("symbol").isin(wanted))


@query("a14_minute_stream", _MINUTES, "ticks")
def a14_stream(spark, sf):
    """The minute points of all symbols through the data source as a stream of files."""
    provider.register(spark)
    stream = spark.readStream.format("provider").option("adapter", "minutes").option("path", _minute_payloads(spark, sf, folders=False)).load()
    return jobs.finished(stream, "minute-points")


@query("a13_adapter_sources", """
select case source when 'cn_stock_quote' then 'us_index_daily' else source end as source, source_id, revision, case source when 'company_announcement' then 'LISTED_COMPANY' else 'INDEX' end as entity_type,
case when source <> 'company_announcement' then value end as value, case when source <> 'company_announcement' then 'points' end as unit, case source when 'cn_stock_quote' then 'USD' end as currency, case source when 'company_announcement' then 'report ' || entity_id end as content from info
union all select 'macro_pmi_cn', source_id, revision, 'ECONOMY', value, 'index', null, null from info where k % 10 = 0""", "info")
def a13_sources(spark, sf):
    """The four projections as adapters of the data source, each over its own payload files."""
    provider.register(spark)
    i = fx.info(spark, sf).withColumns({"close": F.col("value"), "content": F.concat(F.lit("report "), "entity_id")})
    out = None
    for name, rows in (("cn_index_daily", i.filter("source = 'cn_index_daily'")), ("us_index_daily", i.filter("source = 'cn_stock_quote'")), ("company_announcement", i.filter("source = 'company_announcement'")), ("macro_pmi_cn", i.filter("k % 10 = 0"))):
        path = provider.write_payloads(rows.select("source_id", "revision", "close", "value", "content"), new_path(spark, f"payloads-{name}"))
        read = spark.read.format("provider").option("adapter", name).option("path", path).load()
        out = read if out is None else out.unionByName(read)
    return out


@query("a15_latest_daily_points", """
select symbol, max(event_time) as event_time, max_by("close", event_time) as "close", make_timestamp((epoch(max(event_time))::bigint + 3600) * 1000000) as available_time from bars where revision = 0 group by symbol""", "bars")
def a15(spark, sf):
    saved = fx.bars(spark, sf).filter("revision = 0").groupBy("symbol").agg(F.max(F.struct("event_time", "close")).alias("latest"))
    saved = saved.withColumn("saved_at_unix", F.unix_seconds(F.col("latest.event_time").cast("timestamp")) + 3600)
    return saved.select("symbol", "latest.event_time", "latest.close", F.timestamp_seconds("saved_at_unix").cast("timestamp_ntz").alias("available_time"))


_NORM = """
n as (select payload_id, symbol, coalesce(source, 'legacy_unknown') as source, fetched_at, coalesce(available_time, fetched_at) as available_time, fallback or contains(lower(coalesce(source, 'legacy_unknown')), 'fallback') as fallback,
  list_filter([warning, note], lambda x: x is not null) as warnings, data from payloads)"""


@query("a16_normalize_payloads", f"with {_NORM} select payload_id, source, available_time, fallback, array_to_string(warnings, ',') as warnings from n", "payloads")
def a16(spark, sf):
    return bo.normalize_payloads(fx.payloads(spark, sf)).select("payload_id", "source", "available_time", "fallback", F.array_join("warnings", ",").alias("warnings"))


_CHANGES = """
ch as (select lpad(cast(s_suppkey as varchar), 6, '0') as symbol, d as start_date, lpad(cast((s_nationkey * 370000 + j * 10000 * (s_suppkey % 3)) % 1000000 as varchar), 6, '0') as industry_code
  from supplier, (values (0, date '1990-01-01'), (1, date '1995-05-01'), (2, date '1995-05-01'), (3, date '1998-01-01')) v(j, d)),
g as (select symbol, start_date, list_sort(list(distinct substr(industry_code, 1, 2) || '0000')) as codes from ch group by all)"""


def _changes(spark, sf):
    v = spark.createDataFrame([(0, "1990-01-01"), (1, "1995-05-01"), (2, "1995-05-01"), (3, "1998-01-01")], "j int, d string")
    s = fx.table(spark, sf, "supplier").crossJoin(F.broadcast(v))  # four rows
    code = F.lpad(((F.col("s_nationkey") * 370000 + F.col("j") * 10000 * (F.col("s_suppkey") % 3)) % 1000000).cast("string"), 6, "0")
    return s.select(F.col("s_suppkey").cast("string").alias("symbol"), F.col("d").cast("date").alias("start_date"), code.alias("industry_code"))


@query("a17_build_intervals", f"""with {_CHANGES}, o as (select symbol, start_date, codes[1] as code from g where len(codes) = 1)
select symbol, 'SW1:' || code as industry_code, start_date as effective_from, lead(start_date) over (partition by symbol order by start_date) as effective_to, cast(start_date as timestamp) + interval 32 hour as available_time from o""")
def a17(spark, sf):
    return sb.build_intervals(_changes(spark, sf))[0]


@query("a17_interval_conflicts", f"with {_CHANGES} select symbol, start_date, array_to_string(codes, ',') as codes from g where len(codes) > 1")
def a17_conflicts(spark, sf):
    return sb.build_intervals(_changes(spark, sf))[1].select("symbol", "start_date", F.array_join("codes", ",").alias("codes"))


_WHOLE = lambda c: f"cast(cast(floor({c} * 1e6 + 0.5) as bigint) as varchar)"


@query("a18_write_artifacts", f"""
with t as (select concat_ws('|', symbol, trade_date::varchar, strftime(event_time, '%Y-%m-%d %H:%M:%S'), strftime(available_time, '%Y-%m-%d %H:%M:%S'), revision::varchar, {', '.join(_WHOLE(c) for c in ('"open"', 'high', 'low', '"close"', 'volume', 'amount'))}) as s from bars)
select unnest(['computed', 'written']) as side, count(*) as rows, sum(('0x' || substr(md5(s), 1, 15))::bigint)::varchar as checksum from t""", "bars")
def a18(spark, sf):
    """The table is written and read again; the manifests of both are given side by side."""
    path, b = new_path(spark, "artifact"), fx.bars(spark, sf)
    b.write.parquet(path)
    said = lambda df, side: sb.manifest(df).withColumn("side", F.lit(side))
    return said(b, "computed").unionByName(said(spark.read.parquet(path), "written"))


@query("a19_symbol_forms", """
select form, lpad(regexp_replace(form, '[^0-9]', '', 'g'), 6, '0') as symbol, lpad(regexp_replace(form, '[^0-9]', '', 'g'), 6, '0') || case when lpad(regexp_replace(form, '[^0-9]', '', 'g'), 6, '0') like '6%' then '.SH' else '.SZ' end as vendor
from (select case s_suppkey % 4 when 0 then 'sh' || lpad(cast(s_suppkey + 600000 as varchar), 6, '0') when 1 then lpad(cast(s_suppkey as varchar), 6, '0') || '.SZ' when 2 then 'SZ' || lpad(cast(s_suppkey as varchar), 6, '0') else cast(s_suppkey as varchar) end as form from supplier)""")
def a19(spark, sf):
    k = F.col("s_suppkey")
    padded = F.lpad(k.cast("string"), 6, "0")
    form = F.when(k % 4 == 0, F.concat(F.lit("sh"), (k + 600000).cast("string"))).when(k % 4 == 1, F.concat(padded, F.lit(".SZ"))).when(k % 4 == 2, F.concat(F.lit("SZ"), padded)).otherwise(k.cast("string"))
    s = fx.table(spark, sf, "supplier").select(form.alias("form")).withColumn("symbol", sb.normalize_symbol(F.col("form")))
    return s.withColumn("vendor", sb.vendor_symbol(F.col("symbol")))


@query("b3_available_before", f"select symbol, count(*) as n, max(available_time) as newest from bars where available_time <= timestamp '{AT}' group by symbol", "bars")
def b3(spark, sf):
    return bo.available_before(fx.bars(spark, sf), F.lit(AT).cast("timestamp_ntz")).groupBy("symbol").agg(F.count("*").alias("n"), F.max("available_time").alias("newest"))


@query("b5_summarize_pit", """
with m as (select median(epoch(fetched_at)) as mid from payloads), s as (select coalesce(source, 'none') as source, case when fallback then 'FALLBACK' when available_time is null or fetched_at is null then 'MISSING_TIME' when epoch(available_time) <= mid then 'ADMISSIBLE' else 'FUTURE' end as status from payloads, m)
select source, count(*) filter (status = 'ADMISSIBLE') as admissible, count(*) filter (status = 'FUTURE') as future, count(*) filter (status = 'MISSING_TIME') as missing_time, count(*) filter (status = 'FALLBACK') as fallback,
rnd(count(*) filter (status = 'ADMISSIBLE')::double / count(*), 9) as admissible_ratio, count(*) filter (status = 'ADMISSIBLE') = count(*) as all_admissible from s group by source""", "payloads")
def b5(spark, sf):
    p = fx.payloads(spark, sf)
    seconds = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    mid = me.exact_quantiles(p.select(seconds("fetched_at").alias("at")), "at", [0.5]).toDF("mid")
    status = F.when(F.col("fallback"), "FALLBACK").when(F.col("available_time").isNull() | F.col("fetched_at").isNull(), "MISSING_TIME").when(seconds("available_time") <= F.col("mid"), "ADMISSIBLE").otherwise("FUTURE")
    s = p.crossJoin(F.broadcast(mid)).select(F.coalesce("source", F.lit("none")).alias("source"), status.alias("status"))  # one row
    return iq.summarize_status(s, "source")


@query("b7_gate_probability_inputs", """
with f as (select symbol, trade_date, unnest(['momentum', 'trend', 'volume_ratio']) as name, unnest([momentum, trend, volume_ratio]) as v, unnest([true, trade_date < date '1998-01-01', abs(volume_ratio) < 0.9]) as ok from design where not (symbol like '%7' and momentum > 0)),
g as (select symbol, count(*) filter (ok) as admitted, count(*) filter (not ok) as rejected, list(distinct name) filter (ok) as names from f group by symbol)
select symbol, admitted, rejected, array_to_string(list_sort(list_filter(['momentum', 'trend', 'volume_ratio'], lambda x: not list_contains(coalesce(names, []), x))), ',') as missing, rejected = 0 and admitted > 0 and len(list_filter(['momentum', 'trend', 'volume_ratio'], lambda x: not list_contains(coalesce(names, []), x))) = 0 as ready from g""", "design")
def b7(spark, sf):
    from ..operators import factors as fa

    d = fa.design_rows(fx.bars(spark, sf)).filter(~(F.col("symbol").endswith("7") & (F.col("momentum") > 0)))
    one = lambda n, ok: F.struct(F.lit(n).alias("name"), ok.alias("admissible"))
    each = F.explode(F.array(one("momentum", F.lit(True)), one("trend", F.col("trade_date") < "1998-01-01"), one("volume_ratio", F.abs("volume_ratio") < 0.9)))
    g = bo.gate_required(d.select("symbol", each.alias("f")).select("symbol", "f.*"), "symbol", ["momentum", "trend", "volume_ratio"])
    return g.withColumn("missing", F.array_join("missing", ","))


@query("b9_research_zone", "select symbol, count(*) as offending, min(trade_date) as first_day from bars where trade_date >= date '1998-06-01' group by symbol", "bars")
def b9(spark, sf):
    return bo.beyond_boundary(fx.bars(spark, sf), "trade_date", "1998-06-01").groupBy("symbol").agg(F.count("*").alias("offending"), F.min("trade_date").alias("first_day"))


@query("b10_split_admissible", f"""
with e as (select 'cn' as domain, event_time, available_time from bars union all select 'overseas', event_time, available_time from index_bars union all select 'macro', event_time, available_time from info where k % 2 = 0 union all select 'policy', event_time, available_time from info where k % 2 = 1)
select domain, available_time >= event_time and available_time <= timestamp '{AT}' as admitted, count(*) as n from e group by all""", "bars index_bars info")
def b10(spark, sf):
    stamps = lambda df: df.select("event_time", "available_time")
    i = fx.info(spark, sf)
    every = bo.split_admissible(F.lit(AT).cast("timestamp_ntz"), cn=stamps(fx.bars(spark, sf)), overseas=stamps(fx.index_bars(spark, sf)), macro=stamps(i.filter("k % 2 = 0")), policy=stamps(i.filter("k % 2 = 1")))
    return every.groupBy("domain", "admitted").agg(F.count("*").alias("n"))


@query("b11_select_asof", f"""select source, source_id, revision, entity_id, value from (select *, row_number() over (partition by source, source_id, revision order by entity_id, value, available_time) as rn from info
where available_time >= event_time and available_time <= timestamp '{AT}') where rn = 1""", "info")
def b11(spark, sf):
    return iq.select_asof(fx.info(spark, sf), AT, "2026-09-23").select("source", "source_id", "revision", "entity_id", "value")


@query("b12_provider_health", f"""with {_NORM}
select source, rnd(greatest(0, 1 - count(*) filter (data is null)::double / count(*)) * 0.5 + greatest(0, 1 - count(*) filter (fallback)::double / count(*)) * 0.3 + greatest(0, 1 - sum(len(warnings))::double / count(*)) * 0.2, 4) as score,
count(*) as n, rnd(count(*) filter (data is null)::double / count(*), 9) as missing_ratio, rnd(count(*) filter (fallback)::double / count(*), 9) as fallback_ratio, sum(len(warnings))::bigint as warning_count from n group by source""", "payloads")
def b12(spark, sf):
    return bo.provider_health(bo.normalize_payloads(fx.payloads(spark, sf)), "source")


@query("b13_quality_score", """
with q as (select symbol, avg(case when data is null then 1.0::double else 0.0::double end) as missing, avg(case when fallback then 1.0::double else 0.0::double end) as fb, avg(case when fetched_at is not null then 1.0::double else 0.0::double end) as ok,
  avg(epoch(now) - epoch(coalesce(fetched_at, now))) / 60 as minutes from payloads group by symbol)
select symbol, rnd(0.25 * greatest(0, least(1, 1 - minutes / 30.0)) + 0.2 * (1 - least(1, missing)) + 0.2 * 0.5 + 0.15 * (1 - fb) + 0.1 * 1 + 0.1 * greatest(0, least(1, ok)), 4) as score from q""", "payloads")
def b13(spark, sf):
    p = fx.payloads(spark, sf)
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    q = p.groupBy("symbol").agg(
        share(F.col("data").isNull()).alias("missing"), share(F.col("fallback")).alias("fb"), share(F.col("fetched_at").isNotNull()).alias("ok"),
        (F.avg(F.timestamp_diff("SECOND", F.coalesce("fetched_at", "now"), F.col("now"))) / 60).alias("minutes"),
    )
    return q.select("symbol", po.quality_score(F.col("minutes"), F.col("missing"), F.lit(0.5), F.col("fb"), F.lit(0.0), F.col("ok")).alias("score"))


@query("b14_payload_freshness", """
with a as (select *, greatest(0, epoch(now) - epoch(fetched_at))::bigint as age, fallback or contains(lower(coalesce(source, '')), 'fallback') as fb from payloads)
select payload_id, case when fetched_at is null then 'UNKNOWN' when fb then 'FALLBACK' when is_stale or age > 300 then 'STALE' else 'FRESH' end as status, case when fetched_at is not null then age end as age_seconds,
case when fetched_at is null then 'missing_fetched_at' when fb then 'fallback' when is_stale or age > 300 then 'ttl_expired' else 'within_ttl' end as reason from a""", "payloads")
def b14(spark, sf):
    f = bo.payload_freshness(fx.payloads(spark, sf))
    return f.withColumn("age_seconds", F.when(F.col("status") != "UNKNOWN", F.col("age_seconds")))


@query("b15_policy_events", """
with e as (select payload_id, case payload_id % 5 when 0 then 'geopolitical' when 1 then 'regulation' when 2 then 'rumour' when 3 then 'macro_release' end as event_type, case when payload_id % 7 = 0 then '' else 'title' end as title, source, case when payload_id % 2 = 0 then 'CONFIRMED' end as evidence_level from payloads)
select payload_id, event_type, case when event_type is null or event_type = 'rumour' then 'UNSUPPORTED_TYPE' when title = '' or source is null then 'MISSING_FIELD' when event_type = 'geopolitical' and evidence_level is null then 'EVIDENCE_LEVEL_REQUIRED' end as problem from e""", "payloads")
def b15(spark, sf):
    i = F.col("payload_id")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("geopolitical", "regulation", "rumour", "macro_release")], F.lit(None)), (i % 5 + 1).cast("int"))
    e = fx.payloads(spark, sf).select("payload_id", kind.alias("event_type"), F.when(i % 7 == 0, "").otherwise("title").alias("title"), "source", F.when(i % 2 == 0, "CONFIRMED").alias("evidence_level"))
    return e.select("payload_id", "event_type", bo.policy_event_problem().alias("problem"))


@query("b16_select_quotes", f"select symbol, count(*) as n from payloads where symbol in {_IN} group by symbol", "payloads")
def b16(spark, sf):
    return bo.select_quotes(fx.payloads(spark, sf).select(F.concat(F.lit("sz"), "symbol").alias("symbol")), ["000001.SZ", "2", "sz000005"]).groupBy("symbol").agg(F.count("*").alias("n"))


@query("b17_reject_beyond_end", "select symbol, max(trade_date) as newest, max(trade_date) > date '1998-11-15' as beyond from bars group by symbol", "bars")
def b17(spark, sf):
    return fx.bars(spark, sf).groupBy("symbol").agg(F.max("trade_date").alias("newest")).withColumn("beyond", F.col("newest") > F.lit("1998-11-15").cast("date"))
