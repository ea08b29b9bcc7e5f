"""Queries: provenance, health, research queries, evidence, completeness, calendars, sectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..fixtures import rnd
from ..operators import evidence as ev
from ..operators import expected as ex
from ..operators import factors as fa
from ..operators import infoquality as iq
from .registry import query

AT = "1996-01-01 00:00:00"
AS_OF = ("1994-06-01 00:00:00", AT)

_TAMPERED = "tp as (select case when k % 9 = 0 then 'Unknown' else source end as source, case when k % 8 = 0 then ' ' else source_id end as source_id, case when k % 7 = 0 then null else ingested_at end as ingested_at, case k % 5 when 0 then 'UNRESOLVED' when 1 then 'INVALID' else 'OK' end as quality_status, revision, k from info)"
_ISSUES = "list_filter([case when lower(source) = 'unknown' then 'source_is_placeholder' end, case when trim(source_id) = '' then 'missing_source_id' end, case when ingested_at is null then 'missing_ingested_at' end, case when quality_status = 'UNRESOLVED' then 'provenance_unresolved' end, case when quality_status = 'INVALID' then 'provenance_invalid' end], lambda x: x is not null)"


def _tampered(spark, sf):
    k = F.col("k")
    quality = F.when(k % 5 == 0, "UNRESOLVED").when(k % 5 == 1, "INVALID").otherwise("OK")
    i = fx.info(spark, sf).withColumn("source", F.when(k % 9 == 0, "Unknown").otherwise(F.col("source"))).withColumn("source_id", F.when(k % 8 == 0, " ").otherwise(F.col("source_id")))
    return i.withColumn("ingested_at", F.when(k % 7 != 0, F.col("ingested_at"))).withColumn("quality_status", quality).withColumn("issues", ev.provenance_issues())


@query("q1_provenance_issues", f"with {_TAMPERED}, s as (select *, {_ISSUES} as issues from tp) select issue, count(*) as n from (select unnest(issues) as issue from s) group by issue", "info")
def q1(spark, sf):
    return _tampered(spark, sf).select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


@query("q1_provenance_summary", f"with {_TAMPERED}, s as (select *, {_ISSUES} as issues from tp) select source, count(*) as n, count(*) filter (len(issues) > 0) as rejected from s group by source", "info")
def q1_summary(spark, sf):
    return _tampered(spark, sf).groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.size("issues") > 0).alias("rejected"))


_FEEDS = f"""
f as (select source || ':' || (k % 10) as feed, k % 10 as j, count(*) as n, count(*) filter (available_time < event_time) as bad, count(*) filter (available_time > timestamp '{AT}') as fresh, count(*) filter (available_time <= timestamp '{AT}') as stale from info group by all),
m as (select feed, case when j = 4 then 0 else n end as attempted, case when j in (4, 5, 6) then 0 when j = 8 then n else n - bad end as accepted, case when j in (4, 5, 6, 8) then 0 else bad end as rejected, case when j = 6 then n else 0 end as duplicates, case when j = 9 then 1 else 0 end as mutations,
  case when j = 3 then 5 else 0 end as errors, fresh, stale, case when j in (7, 8) then 0.5::double else 1.0::double end as coverage from f)"""


@query("q6_source_health", f"""with {_FEEDS}, h as (select *, attempted = 0 and accepted = 0 and errors = 0 as none_, accepted = 0 and errors > 0 as err, accepted = 0 and rejected = 0 and duplicates = 0 as emp, stale > fresh as st, coverage < 1 and accepted > 0 as pa from m)
select feed, case when none_ then 'UNRESOLVED' when err then 'ERROR' when emp then 'EMPTY' when st then 'STALE' when pa or errors > 0 or mutations > 0 or rejected > 0 then 'DEGRADED' else 'OK' end as health,
concat_ws(',', case when none_ then 'NO_ATTEMPTS' end, case when not none_ and err then 'ERRORS_ONLY' end, case when not none_ and not err and emp then 'ZERO_ROWS' end, case when not (none_ or err or emp) and errors > 0 then 'ERRORS' end, case when not (none_ or err or emp) and mutations > 0 then 'MUTATIONS' end, case when not (none_ or err or emp) and rejected > 0 then 'REJECTED_ROWS' end,
  case when not (none_ or err or emp) and st then 'MAJORITY_STALE' end, case when not (none_ or err or emp) and not st and pa then 'COVERAGE' end) as reasons from h""", "info")
def q6(spark, sf):
    k, at = F.col("j"), F.lit(AT).cast("timestamp_ntz")
    late = F.col("available_time") > at
    f = fx.info(spark, sf).withColumn("j", F.col("k") % 10).groupBy("source", "j").agg(F.count("*").alias("n"), F.count_if(F.col("available_time") < F.col("event_time")).alias("bad"), F.count_if(late).alias("fresh"), F.count_if(~late).alias("stale"))
    m = f.select(
        F.concat_ws(":", "source", F.col("j").cast("string")).alias("feed"), F.when(k == 4, 0).otherwise(F.col("n")).alias("attempted"), F.when(k.isin(4, 5, 6), 0).when(k == 8, F.col("n")).otherwise(F.col("n") - F.col("bad")).alias("accepted"),
        F.when(k.isin(4, 5, 6, 8), 0).otherwise(F.col("bad")).alias("rejected"), F.when(k == 6, F.col("n")).otherwise(0).alias("duplicates"), (k == 9).cast("int").alias("mutations"), F.when(k == 3, 5).otherwise(0).alias("errors"), "fresh", "stale", F.when(k.isin(7, 8), 0.5).otherwise(1.0).alias("coverage"),
    )
    return ev.source_health(m).select("feed", "health", F.array_join("reasons", ",").alias("reasons"))


@query("q9_quality_counts", f"""
with a as (select source, case when k % 6 = 0 then null else available_time end as av, case source when 'cn_stock_quote' then 400 when 'cn_index_daily' then 100 end as days from info),
s as (select case when av is null then 'AVAILABLE_TIME_MISSING' when av <= timestamp '{AT}' then 'PIT_ADMISSIBLE' else 'AVAILABLE_TIME_AFTER_DECISION' end as pit, case when days is null then 'MISSING_POLICY' when av is null then 'UNKNOWN' when epoch(timestamp '{AT}') - epoch(av) <= days * 86400 then 'FRESH' else 'STALE' end as fresh from a)
select 'pit' as dimension, pit as status, count(*) as n from s group by pit union all select 'freshness', fresh, count(*) from s group by fresh""", "info")
def q9(spark, sf):
    at = F.lit(AT).cast("timestamp_ntz")
    days = F.when(F.col("source") == "cn_stock_quote", 400).when(F.col("source") == "cn_index_daily", 100)
    av = F.when(F.col("k") % 6 != 0, F.col("available_time"))
    pit = F.when(av.isNull(), "AVAILABLE_TIME_MISSING").when(av <= at, "PIT_ADMISSIBLE").otherwise("AVAILABLE_TIME_AFTER_DECISION")
    each = F.array(F.struct(F.lit("pit").alias("dimension"), pit.alias("status")), F.struct(F.lit("freshness").alias("dimension"), F.upper(iq.freshness(av, at, days)).alias("status")))
    return fx.info(spark, sf).select(F.inline(each)).groupBy("dimension", "status").agg(F.count("*").alias("n"))


@query("q11_missingness", "select case when k % 7 = 0 then 'SOURCE_ERROR' when k % 6 = 0 then 'PARSE_FAILURE' when k % 5 = 0 then 'UNRESOLVED_AVAILABILITY' when k % 4 = 0 then 'SOURCE_EMPTY' when k % 3 = 0 then 'EXPECTED_ABSENCE' else 'UNEXPECTED_MISSING' end as class, source, count(*) as n from info group by all", "info")
def q11(spark, sf):
    is_ = lambda m: F.col("k") % m == 0
    return fx.info(spark, sf).groupBy(ev.missingness(is_(7), is_(6), is_(5), is_(4), is_(3)).alias("class"), "source").agg(F.count("*").alias("n"))


@query("q12_dimension_report", f"""
with {_TAMPERED}, l as (select source, source_id, count(distinct revision) as r, max(revision) - min(revision) + 1 as span from info group by all), c as (select count(*) as n from (select entity_id, event_time from info group by all having count(distinct source) > 1 and count(distinct value) > 1)),
m as (select 'provenance' as dimension, avg((len({_ISSUES}) > 0)::int::double) as metric from tp union all select 'timestamps', avg((available_time < event_time)::int::double) from info union all select 'ingestion', avg((ingested_at < available_time)::int::double) from info
  union all select 'revision_gaps', avg((r < span)::int::double) from l union all select 'duplicates', 1 - count(distinct (source, source_id, revision))::double / count(*) from info union all select 'conflicts', (select n from c)::double / count(*) from info
  union all select 'pit', avg((available_time > timestamp '{AT}')::int::double) from info union all select 'values', avg((value is null or value <= 0)::int::double) from info union all select 'sources', 1 - count(distinct source)::double / 3 from info)
select dimension, rnd(metric, 6) as metric, case when metric = 0 then 'PASS' when metric < 0.2 then 'WARN' else 'FAIL' end as status from m""", "info")
def q12(spark, sf):
    i, t = fx.info(spark, sf), _tampered(spark, sf)
    share = lambda c: F.avg(c.cast("int").cast("double"))
    lines = i.groupBy("source", "source_id").agg(F.count_distinct("revision").alias("r"), (F.max("revision") - F.min("revision") + 1).alias("span"))
    one = i.agg(
        share(F.col("available_time") < F.col("event_time")).alias("timestamps"), share(F.col("ingested_at") < F.col("available_time")).alias("ingestion"), share(F.col("available_time") > F.lit(AT).cast("timestamp_ntz")).alias("pit"),
        share(F.col("value").isNull() | (F.col("value") <= 0)).alias("values"), (1 - F.count_distinct("source") / 3).alias("sources"), (1 - F.count_distinct("source", "source_id", "revision") / F.count("*")).alias("duplicates"), F.count("*").alias("n"),
    )
    x = one.crossJoin(t.agg(share(F.size("issues") > 0).alias("provenance"))).crossJoin(lines.agg(share(F.col("r") < F.col("span")).alias("revision_gaps"))).crossJoin(iq.conflict_groups(i).agg(F.count("*").alias("groups")))
    x = x.withColumn("conflicts", F.col("groups") / F.col("n"))
    names = ("provenance", "timestamps", "ingestion", "revision_gaps", "duplicates", "conflicts", "pit", "values", "sources")
    m = x.select(F.inline(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("double").alias("metric")) for c in names])))
    return m.select("dimension", rnd("metric", 6).alias("metric"), F.when(F.col("metric") == 0, "PASS").when(F.col("metric") < 0.2, "WARN").otherwise("FAIL").alias("status"))


_Q = f"""
iv as (select source, source_id, revision, entity_id, entity_type, event_time, case when k % 6 = 0 then null else available_time end as available_time, value, k from info),
qs as (select distinct entity_id, as_of from info, (values (timestamp '{AS_OF[0]}'), (timestamp '{AS_OF[1]}')) v(as_of) where cast(entity_id as integer) % 3 = 0),
sc as (select iv.*, as_of, case when available_time is null then 'UNRESOLVED_AVAILABILITY' when available_time > as_of then 'NOT_YET_AVAILABLE' end as reason from iv join qs using (entity_id)),
vi as (select distinct entity_id, as_of, source, source_id, revision, available_time, event_time, value from sc where reason is null),
rk as (select *, row_number() over o as rn, first_value(revision) over o as br, first_value(available_time) over o as ba from vi window o as (partition by entity_id, as_of, source, source_id order by revision desc, available_time, value)),
tl as (select *, count(*) filter (rn > 1 and revision = br) over p as ties, count(*) filter (rn > 1 and revision = br and available_time = ba) over p as near from rk window p as (partition by entity_id, as_of, source, source_id)),
sel as (select *, rn = 1 as selected, case when rn = 1 then case when ties = 0 then 'HIGHEST_REVISION' when near = 0 then 'EARLIEST_ON_REVISION_TIE' else 'CANONICAL_TIEBREAK' end when revision < br then 'LOWER_REVISION' when available_time > ba then 'REVISION_TIE_NOT_EARLIEST' else 'CANONICAL_TIEBREAK' end as label from tl)"""


def _scoped(spark, sf):
    i = fx.info(spark, sf).withColumn("available_time", F.when(F.col("k") % 6 != 0, F.col("available_time")))
    at = F.explode(F.array(*[F.lit(a).cast("timestamp_ntz") for a in AS_OF])).alias("as_of")
    q = i.filter(F.col("entity_id").cast("int") % 3 == 0).select("entity_id").distinct().select("entity_id", F.lit("PART").alias("entity_type"), at)
    return ev.research_query(i, q)


def _resolved(spark, sf):
    return ev.selection(_scoped(spark, sf).filter("reason is null"), ["entity_id", "as_of"])


@query("q13_research_query", f"""with {_Q}, s as (select entity_id, as_of, count(*) filter (selected) as selected from sel group by all)
select entity_id, as_of, count(*) as in_scope, count(*) filter (reason is null) as visible, count(*) filter (reason = 'NOT_YET_AVAILABLE') as not_yet, count(*) filter (reason = 'UNRESOLVED_AVAILABILITY') as unresolved, (select count(*) from info) - count(*) as outside, coalesce(any_value(s.selected), 0) as selected from sc left join s using (entity_id, as_of) group by all""", "info")
def q13(spark, sf):
    x = _scoped(spark, sf)
    keys = ["entity_id", "as_of"]
    n = lambda r: F.count_if(F.col("reason").eqNullSafe(F.lit(r)))
    g = x.groupBy(*keys).agg(F.count("*").alias("in_scope"), F.count_if(F.col("reason").isNull()).alias("visible"), n("NOT_YET_AVAILABLE").alias("not_yet"), n("UNRESOLVED_AVAILABILITY").alias("unresolved"))
    whole = fx.info(spark, sf).agg(F.count("*").alias("total"))
    s = _resolved(spark, sf).filter("selected").groupBy(*keys).agg(F.count("*").alias("selected"))
    return g.crossJoin(F.broadcast(whole)).join(s, keys, "left").withColumn("outside", F.col("total") - F.col("in_scope")).drop("total").fillna(0, ["selected"])


@query("q14_selection_labels", f"with {_Q} select selected, label, count(*) as n from sel group by all", "info")
def q14(spark, sf):
    return _resolved(spark, sf).groupBy("selected", "label").agg(F.count("*").alias("n"))


_IDS = """
ids as (select *, sha256(source || '|' || source_id || '|' || revision || '|' || payload_hash || '|v1') as ingestion_id from (select *, sha256(entity_id || '|' || cast(cast(floor(value * 100 + 0.5) as bigint) as varchar)) as payload_hash from sel)),
evi as (select *, sha256(source || '|' || source_id || '|' || revision || '|' || strftime(event_time, '%Y-%m-%d %H:%M:%S') || '|' || strftime(available_time, '%Y-%m-%d %H:%M:%S') || '|v1|' || payload_hash || '|' || ingestion_id) as evidence_id from ids),
bu as (select entity_id, as_of, count(*) filter (selected) as n_evidence, count(*) filter (not selected) as n_candidates, coalesce(string_agg(evidence_id, ',' order by source, source_id, revision, evidence_id, label) filter (selected), '') as e, coalesce(string_agg(evidence_id, ',' order by source, source_id, revision, evidence_id, label) filter (not selected), '') as c from evi group by all),
ex as (select entity_id, as_of, count(*) as exclusions from sc where reason is not null group by all),
bn as (select coalesce(bu.entity_id, ex.entity_id) as entity_id, coalesce(bu.as_of, ex.as_of) as as_of, coalesce(n_evidence, 0) as n_evidence, coalesce(n_candidates, 0) as n_candidates, coalesce(exclusions, 0) as exclusions,
  sha256(coalesce(e, '') || '|' || coalesce(c, '') || '|' || coalesce(exclusions, 0)) as bundle_id from bu full join ex on bu.entity_id = ex.entity_id and bu.as_of = ex.as_of)"""


def _bundles(spark, sf):
    keys = ["entity_id", "as_of"]
    return ev.bundles(ev.identified(_resolved(spark, sf)), _scoped(spark, sf).filter("reason is not null"), keys)


@query("q15_evidence_bundles", f"with {_Q}, {_IDS} select entity_id, as_of, n_evidence, n_candidates, exclusions, bundle_id from bn", "info")
def q15(spark, sf):
    return _bundles(spark, sf).select("entity_id", "as_of", "n_evidence", "n_candidates", "exclusions", "bundle_id")


@query("q16_bundle_reload", f"with {_Q}, {_IDS} select cast(entity_id as integer) % 2 = 0 as tampered, case when cast(entity_id as integer) % 2 = 0 then 'HASH_MISMATCH' else 'OK' end as status, count(*) as n from bn group by all", "info")
def q16(spark, sf):
    """Bundles stored with their id, some with a changed count, recomputed and compared."""
    b = _bundles(spark, sf)
    bad = F.col("entity_id").cast("int") % 2 == 0
    stored = b.select("entity_id", "as_of", "evidence", "candidates", (F.col("exclusions") + bad.cast("int")).alias("exclusions"), "bundle_id")
    ids = lambda c: F.array_join(F.coalesce(F.transform(c, lambda v: v["evidence_id"]), F.array().cast("array<string>")), ",")
    again = F.sha2(F.concat_ws("|", ids("evidence"), ids("candidates"), F.col("exclusions").cast("string")), 256)
    return stored.groupBy(bad.alias("tampered"), F.when(again == F.col("bundle_id"), "OK").otherwise("HASH_MISMATCH").alias("status")).agg(F.count("*").alias("n"))


@query("j9_visible_raw", f"with {_Q} select i.source, count(*) as n, count(distinct (i.source_id, i.revision)) as keys from info i where exists (select 1 from sel s where s.selected and s.source = i.source and s.source_id = i.source_id and s.revision = i.revision and s.value = i.value) group by i.source", "info")
def j9(spark, sf):
    won = _resolved(spark, sf).filter("selected").select("source", "source_id", "revision", "value")
    return fx.info(spark, sf).join(won, ["source", "source_id", "revision", "value"], "left_semi").groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("source_id", "revision").alias("keys"))


@query("j12_reverse_trace", f"""with {_Q}, {_IDS}, rw as (select sha256(source || '|' || source_id || '|' || revision || '|' || payload_hash || '|v1') as ingestion_id, * from (select *, sha256(entity_id || '|' || cast(cast(floor(value * 100 + 0.5) as bigint) as varchar)) as payload_hash from iv where available_time is not null)),
ra as (select ingestion_id, payload_hash, k, revision + case when k % 7 = 2 then 1 else 0 end as revision, case when k % 7 = 3 then null else event_time end as event_time, available_time from rw where k % 7 <> 0 union all select ingestion_id, payload_hash, k, revision, event_time, available_time from rw where k % 7 = 1),
g as (select ingestion_id, payload_hash, count(*) as matches, bool_or(event_time is null) as broken, any_value(revision) as rr, any_value(event_time) as re, any_value(available_time) as ra from ra group by all)
select case when matches is null then 'NOT_FOUND' when broken then 'RAW_CORRUPTED' when matches > 1 then 'AMBIGUOUS' when rr <> e.revision or re <> e.event_time or g.ra <> e.available_time then 'IDENTITY_MISMATCH' else 'OK' end as trace, count(*) as n from evi e left join g using (ingestion_id, payload_hash) where selected group by 1""", "info")
def j12(spark, sf):
    e = ev.identified(_resolved(spark, sf)).filter("selected")
    k = F.col("k") % 7
    raw = ev.identified(fx.info(spark, sf).filter("k % 6 <> 0"))
    changed = raw.filter(k != 0).withColumn("revision", F.col("revision") + (k == 2).cast("int")).withColumn("event_time", F.when(k != 3, F.col("event_time")))
    return ev.reverse_trace(e, changed.unionByName(raw.filter(k == 1))).groupBy("trace").agg(F.count("*").alias("n"))


_TARGETS = f"""tg as (select symbol, as_of from (select distinct symbol from bars), (values (timestamp '{AS_OF[0]}'), (timestamp '{AS_OF[1]}')) v(as_of)),
run as (select t.symbol, t.as_of, max(d.trade_date) as day, max_by(d.momentum, d.trade_date) as momentum, max_by(d.trend, d.trade_date) as trend from tg t left join design d on d.symbol = t.symbol and cast(d.trade_date as timestamp) + interval 8 hour <= t.as_of and d.trade_date > cast(t.as_of as date) - 15 group by all)"""


def _targets(spark, sf):
    b = fx.bars(spark, sf)
    t = b.select("symbol").distinct().select("symbol", F.explode(F.array(*[F.lit(a).cast("timestamp_ntz") for a in AS_OF])).alias("as_of"))
    d = fa.design_rows(b).select("symbol", "trade_date", "momentum", "trend")
    near = (F.col("trade_date").cast("timestamp_ntz") + fx.hours(8) <= F.col("as_of")) & (F.col("trade_date") > F.date_sub(F.col("as_of").cast("date"), 15))
    j = t.join(d.withColumnRenamed("symbol", "s"), (F.col("s") == F.col("symbol")) & near, "left")
    return j.groupBy("symbol", "as_of").agg(F.max("trade_date").alias("day"), F.max_by("momentum", "trade_date").alias("momentum"), F.max_by("trend", "trade_date").alias("trend"))


@query("q17_research_batch", f"with {_TARGETS} select symbol, as_of, case when day is null then 'FAILED' else 'OK' end as status, day, case when day is null then null when momentum > 0 and trend > 0 then 'RESEARCH' when momentum > 0 then 'HOLD' else 'NO_ACTION' end as action from run", "bars design")
def q17(spark, sf):
    action = F.when(F.col("day").isNull(), None).when((F.col("momentum") > 0) & (F.col("trend") > 0), "RESEARCH").when(F.col("momentum") > 0, "HOLD").otherwise("NO_ACTION")
    return _targets(spark, sf).select("symbol", "as_of", F.when(F.col("day").isNull(), "FAILED").otherwise("OK").alias("status"), "day", action.alias("action"))


@query("q18_universe_validation", f"""with {_TARGETS}, u as (select distinct lpad(cast(s_suppkey + 1 as varchar), 6, '0') as symbol from supplier), o as (select distinct symbol from bars)
select (select count(*) from u) as expected, (select count(*) from u where symbol in (select symbol from o)) as observed, (select count(*) from u where symbol not in (select symbol from o)) as missing, count(*) as total, count(*) filter (day is not null) as ok, count(*) filter (day is null) as failed,
case when (select count(*) from u where symbol not in (select symbol from o)) > 0 then 'DATA_INCOMPLETE' else 'OK' end as status from run""", "bars design")
def q18(spark, sf):
    u = fx.table(spark, sf, "supplier").select(F.lpad((F.col("s_suppkey") + 1).cast("string"), 6, "0").alias("symbol")).distinct()
    o = fx.bars(spark, sf).select("symbol").distinct().withColumn("seen", F.lit(True))
    e = u.join(o, "symbol", "left").agg(F.count("*").alias("expected"), F.count("seen").alias("observed")).withColumn("missing", F.col("expected") - F.col("observed"))
    r = _targets(spark, sf).agg(F.count("*").alias("total"), F.count("day").alias("ok")).withColumn("failed", F.col("total") - F.col("ok"))
    return e.crossJoin(r).withColumn("status", F.when(F.col("missing") > 0, "DATA_INCOMPLETE").otherwise("OK"))


@query("q19_feature_sets", """
with f as (select symbol, trade_date, case when symbol like '%3' then ['momentum', 'trend'] when symbol like '%5' then ['momentum', 'volatility', 'trend', 'volume_ratio', 'mood'] else ['momentum', 'volatility', 'trend', 'volume_ratio'] end as names from design)
select array_to_string(list_filter(names, lambda x: not list_contains(['momentum', 'volatility', 'trend', 'volume_ratio'], x)), ',') as unknown, array_to_string(list_filter(['momentum', 'volatility', 'trend', 'volume_ratio'], lambda x: not list_contains(names, x)), ',') as missing, 'fs-' || substr(sha256(array_to_string(names, ',')), 1, 16) as set_id, count(*) as n from f group by all""", "design")
def q19(spark, sf):
    reg = F.array(*map(F.lit, ("momentum", "volatility", "trend", "volume_ratio")))
    s = F.col("symbol")
    names = F.when(s.like("%3"), F.array(F.lit("momentum"), F.lit("trend"))).when(s.like("%5"), F.concat(reg, F.array(F.lit("mood")))).otherwise(reg)
    d = fa.design_rows(fx.bars(spark, sf)).select(names.alias("names"))
    return d.groupBy(F.array_join(F.array_except("names", reg), ",").alias("unknown"), F.array_join(F.array_except(reg, "names"), ",").alias("missing"), F.concat(F.lit("fs-"), F.substring(F.sha2(F.array_join("names", ","), 256), 1, 16)).alias("set_id")).agg(F.count("*").alias("n"))


@query("q20_research_packets", """
with b as (select symbol, trade_date, look, row_number() over (partition by symbol order by trade_date desc) as rn from settled), q as (select symbol, max_by(data, now) filter (not fallback and data is not null) as quote, avg((data is null)::int::double) as gaps from payloads group by symbol)
select b.symbol, max(trade_date) as decision, count(*) as days, rnd(max_by(look, trade_date), 4) as last_close, rnd(any_value(quote), 4) as quote, rnd(any_value(gaps), 6) as missing_ratio from b left join q using (symbol) where rn <= 5 group by b.symbol""", "settled payloads")
def q20(spark, sf):
    first = fx.bars(spark, sf).filter("revision = 0").groupBy("symbol").agg(F.slice(F.sort_array(F.collect_list(F.struct("trade_date", "close")), False), 1, 5).alias("daily"))
    ok = ~F.col("fallback") & F.col("data").isNotNull()
    q = fx.payloads(spark, sf).groupBy("symbol").agg(F.max_by(F.when(ok, F.col("data")), F.when(ok, F.col("now"))).alias("quote"), F.avg(F.col("data").isNull().cast("double")).alias("missing_ratio"))
    p = first.join(q, "symbol", "left").select("symbol", F.struct("quote").alias("market"), F.struct("daily").alias("stock"), F.struct("missing_ratio").alias("data_quality"))
    return p.select("symbol", F.col("stock.daily")[0]["trade_date"].alias("decision"), F.size("stock.daily").cast("long").alias("days"), rnd(F.col("stock.daily")[0]["close"], 4).alias("last_close"), rnd("market.quote", 4).alias("quote"), rnd("data_quality.missing_ratio", 6).alias("missing_ratio"))


@query("d2_normalize_info", """
with r as (select * from info where source <> 'company_announcement' and available_time >= event_time), d as (select * from (select *, row_number() over (partition by source, source_id, revision order by available_time, entity_id, value) as rn from r) where rn = 1),
c as (select entity_id, entity_type, event_time from d group by all having count(distinct source) > 1 and count(distinct value) > 1)
select d.source, d.source_id, d.revision, d.value, c.entity_id is not null as conflict, row_number() over (partition by d.source order by d.event_time, d.source_id, d.revision) as place from d left join c on c.entity_id = d.entity_id and c.event_time = d.event_time""", "info")
def d2(spark, sf):
    reg = spark.createDataFrame([("cn_stock_quote",), ("cn_index_daily",)], "source string")
    r = fx.info(spark, sf).filter("available_time >= event_time").join(F.broadcast(reg), "source", "left_semi")
    d = iq.deduplicate(r)
    c = iq.conflict_groups(d).select("entity_id", "event_time", F.lit(True).alias("hit"))
    place = F.row_number().over(Window.partitionBy("source").orderBy("event_time", "source_id", "revision"))
    return d.join(c, ["entity_id", "event_time"], "left").select("source", "source_id", "revision", "value", F.coalesce("hit", F.lit(False)).alias("conflict"), place.cast("long").alias("place"))


_PAIRS = """pa as (select e.entity, d.day, month(d.day) = 2 as declared, a.entity is not null as observed from (select distinct symbol as entity from bars) e, (select distinct date_trunc('month', trade_date)::date as day from bars) d left join (select distinct symbol as entity, date_trunc('month', trade_date)::date as day from bars where volume > 30) a on a.entity = e.entity and a.day = d.day)"""


def _contract(spark, sf):
    """Entities, days (Februaries closed), observed pairs and no single absences."""
    b = fx.bars(spark, sf).select(F.col("symbol").alias("entity"), F.trunc("trade_date", "month").alias("day"), "volume")
    seen = b.filter("volume > 30").select("entity", "day")
    return b.select("entity"), b.select("day", (F.month("day") == 2).alias("closed")), seen, seen.filter("false")


@query("d5_completeness", f"""with {_PAIRS}, r as (select *, not declared as required, not declared and observed as satisfied from pa)
select count(*) as pairs, count(*) filter (required) as required, count(*) filter (satisfied) as satisfied, count(*) filter (required) - count(*) filter (satisfied) as missing_pairs, rnd(count(*) filter (satisfied)::double / count(*) filter (required), 4) as coverage,
(select count(*) from (select entity from r where required group by entity having not bool_or(satisfied))) as missing_entitys, (select count(*) from (select day from r where required group by day having not bool_or(satisfied))) as missing_days from r""", "bars")
def d5(spark, sf):
    return ex.completeness(*_contract(spark, sf), "entity", "day").drop("out_of_scope")


@query("d7_declared_absences", f"with {_PAIRS} select entity, day, row_number() over (order by entity, day) - 1 as i, 'absences[' || (row_number() over (order by entity, day) - 1) || ']' as reference from pa where declared", "bars")
def d7(spark, sf):
    entities, days, _, absent = _contract(spark, sf)
    return ex.declared_pairs(entities, days, absent, "entity", "day")


_OLD = "old as (select lpad(cast(user_id as varchar), 6, '0') as ticker, event_type, cast(ts as date) as event_date, case when event_id % 3 = 0 then 'source: feed' else 'by hand ' || event_id end as note from events where event_id % 2 = 0), new as (select lpad(cast(user_id as varchar), 6, '0') as ticker, event_type, cast(ts as date) as event_date, 'source: feed' as note from events where event_id % 5 = 0)"


def _calendar(spark, sf):
    e = fx.table(spark, sf, "events")
    i = F.col("event_id")
    base = [F.lpad(F.col("user_id").cast("string"), 6, "0").alias("ticker"), "event_type", F.to_date("ts").alias("event_date")]
    old = e.filter(i % 2 == 0).select(*base, F.when(i % 3 == 0, "source: feed").otherwise(F.concat(F.lit("by hand "), i.cast("string"))).alias("note"))
    return old, e.filter(i % 5 == 0).select(*base, F.lit("source: feed").alias("note"))


@query("d3_merge_events", f"with {_OLD}, a as (select *, 0 as turn from old where note not like '%source:%' union all select *, 1 from new) select ticker, event_type, event_date, note from (select *, row_number() over (partition by ticker, event_type, event_date order by turn, note) as rn from a) where rn = 1")
def d3(spark, sf):
    return ev.merge_events(*_calendar(spark, sf))


@query("d4_empty_protection", "select 'some' as incoming, true as overwrite union all select 'none', false")
def d4(spark, sf):
    old, new = _calendar(spark, sf)
    say = lambda name, rows: F.struct(F.lit(name).alias("incoming"), F.lit(ev.may_overwrite(old, rows)).alias("overwrite"))
    return spark.range(1).select(F.inline(F.array(say("some", new), say("none", new.filter("false")))))


@query("d10_last_valid_row", "select symbol, max_by(payload_id, payload_id) as payload_id, max_by(data, payload_id) as data, max_by(fetched_at, payload_id) as fetched_at from payloads where data is not null and fetched_at is not null group by symbol", "payloads")
def d10(spark, sf):
    p = fx.payloads(spark, sf).select("symbol", "payload_id", "data", "fetched_at")
    return ev.last_valid(p, "symbol", "payload_id", ["data", "fetched_at"])


_BOARD = """sb as (select m.industry_code as name, s.trade_date, avg((look / prev - 1) * 100) as pct, sum(amount) as flow from (select *, lag(final) over (partition by symbol order by trade_date) as prev from settled) s join membership m on m.symbol = s.symbol and m.effective_from <= s.trade_date and (m.effective_to is null or m.effective_to > s.trade_date) where prev is not null group by all)"""


def _board(spark, sf):
    d = fa._days(fx.bars(spark, sf)).select("symbol", "trade_date", F.col("look.close").alias("look"), F.col("look.amount").alias("amount"), F.lag("final.close").over(Window.partitionBy("symbol").orderBy("trade_date")).alias("prev")).filter("prev is not null")
    m = fx.membership(spark, sf).withColumnRenamed("symbol", "s")
    held = (F.col("s") == F.col("symbol")) & (F.col("effective_from") <= F.col("trade_date")) & (F.col("effective_to").isNull() | (F.col("effective_to") > F.col("trade_date")))
    return d.join(m, held).groupBy(F.col("industry_code").alias("name"), "trade_date").agg(F.avg((F.col("look") / F.col("prev") - 1) * 100).alias("pct"), F.sum("amount").alias("flow"))


@query("d11_rank_sectors", f"with {_BOARD}, r as (select *, row_number() over (partition by trade_date order by rnd(pct, 9) desc nulls last, name) as rank, count(*) over (partition by trade_date) as total from sb) select name, trade_date, rnd(pct, 7) as pct, rank, case when rank <= total * 0.2 then 'STRONG' when rank >= total * 0.8 then 'WEAK' else 'NEUTRAL' end as verdict from r", "settled membership")
def d11(spark, sf):
    day = Window.partitionBy("trade_date")
    r = _board(spark, sf).withColumn("rank", F.row_number().over(day.orderBy(F.desc_nulls_last(rnd("pct")), "name"))).withColumn("total", F.count("*").over(day))
    verdict = F.when(F.col("rank") <= F.col("total") * 0.2, "STRONG").when(F.col("rank") >= F.col("total") * 0.8, "WEAK").otherwise("NEUTRAL")
    return r.select("name", "trade_date", rnd("pct", 7).alias("pct"), F.col("rank").cast("long").alias("rank"), verdict.alias("verdict"))


@query("d15_top_bottom", f"with {_BOARD}, r as (select *, row_number() over (partition by trade_date order by rnd(flow, 2) desc, name) as a, row_number() over (partition by trade_date order by rnd(flow, 2), name desc) as b from sb) select name, trade_date, rnd(flow, 2) as flow, case when a <= 2 then 'TOP' else 'BOTTOM' end as side from r where a <= 2 or b <= 2", "settled membership")
def d15(spark, sf):
    day = Window.partitionBy("trade_date")
    x = _board(spark, sf).withColumn("flow", rnd("flow", 2))
    r = x.withColumn("a", F.row_number().over(day.orderBy(F.desc("flow"), "name"))).withColumn("b", F.row_number().over(day.orderBy("flow", F.desc("name"))))
    return r.filter("a <= 2 or b <= 2").select("name", "trade_date", "flow", F.when(F.col("a") <= 2, "TOP").otherwise("BOTTOM").alias("side"))


@query("f24_sector_dispersion", f"with {_BOARD} select trade_date, count(*) as sectors, case when count(*) >= 2 then rnd(stddev_pop(pct), 6) end as dispersion from sb group by trade_date", "settled membership")
def f24(spark, sf):
    n = F.count("*")
    return _board(spark, sf).groupBy("trade_date").agg(n.alias("sectors"), F.when(n >= 2, rnd(F.stddev_pop("pct"), 6)).alias("dispersion"))


@query("d14_gap_report", """
with z as (select * from bars where trade_date > date '1998-06-01' and revision = 0), d as (select count(distinct trade_date) as days from z)
select u.symbol, count(distinct z.trade_date) as observed, case when count(z.trade_date) = 0 then 'MISSING' when count(distinct z.trade_date) < 20 then 'INSUFFICIENT' when count(distinct z.trade_date) < 60 then 'PARTIAL' else 'READY' end as status, coalesce(bool_or(z.trade_date >= date '1998-11-01'), false) as contaminated
from (select distinct lpad(cast(s_suppkey + 2 as varchar), 6, '0') as symbol from supplier) u left join z on z.symbol = u.symbol group by u.symbol""", "bars")
def d14(spark, sf):
    u = fx.table(spark, sf, "supplier").select(F.lpad((F.col("s_suppkey") + 2).cast("string"), 6, "0").alias("symbol")).distinct()
    z = fx.bars(spark, sf).filter("revision = 0 and trade_date > '1998-06-01'").groupBy("symbol").agg(F.count_distinct("trade_date").alias("observed"), F.bool_or(F.col("trade_date") >= "1998-11-01").alias("contaminated"))
    n = F.coalesce("observed", F.lit(0))
    status = F.when(n == 0, "MISSING").when(n < 20, "INSUFFICIENT").when(n < 60, "PARTIAL").otherwise("READY")
    return u.join(z, "symbol", "left").select("symbol", n.alias("observed"), status.alias("status"), F.coalesce("contaminated", F.lit(False)).alias("contaminated"))


@query("j14_match_sector", """
with b as (select name, row_number() over (order by name) as place from (select distinct upper(p_type) as name from part)), w as (select distinct n_name as wanted from nation union all select 'BRASS' union all select 'STANDARD POLISHED TIN'),
m as (select wanted, case wanted when 'CHINA' then 'STEEL' else wanted end as mapped from w),
j as (select m.wanted, b.name, place, case when name = mapped then 1 when contains(name, mapped) or contains(mapped, name) then 2 when contains(name, substr(wanted, 1, 2)) then 3 when contains(name, right(wanted, 2)) then 4 end as rank from m left join b on name = mapped or contains(name, mapped) or contains(mapped, name) or contains(name, substr(wanted, 1, 2)) or contains(name, right(wanted, 2)))
select wanted, name, rank from (select *, row_number() over (partition by wanted order by rank nulls last, place) as rn from j) where rn = 1""")
def j14(spark, sf):
    names = fx.table(spark, sf, "part").select(F.upper("p_type").alias("name")).distinct()
    board = names.withColumn("place", F.row_number().over(Window.orderBy("name")))  # one row a sector
    wanted = fx.table(spark, sf, "nation").select(F.col("n_name").alias("wanted")).distinct().unionByName(spark.createDataFrame([("BRASS",), ("STANDARD POLISHED TIN",)], "wanted string"))
    return ev.match_sector(wanted, board, {"CHINA": "STEEL"})


_UNLOCKS = "un as (select lpad(cast(o_custkey as varchar), 6, '0') as symbol, cast(o_orderdate as date) as event_date, (o_orderkey % 60) / 10.0::double as pct from orders)"
_TODAY = "1996-03-01"


def _unlocks(spark, sf):
    return fx.table(spark, sf, "orders").select(F.lpad(F.col("o_custkey").cast("string"), 6, "0").alias("symbol"), F.to_date("o_orderdate").alias("event_date"), ((F.col("o_orderkey") % 60) / 10.0).alias("pct"))


@query("j15_events_in_horizon", f"with {_UNLOCKS} select symbol, event_date, pct, date_diff('day', date '{_TODAY}', event_date) as in_days from un where event_date between date '{_TODAY}' and date '{_TODAY}' + 30")
def j15(spark, sf):
    return ev.events_within(_unlocks(spark, sf), F.lit(_TODAY).cast("date"), 30).withColumn("in_days", F.col("in_days").cast("long"))


@query("j16_unlock_risk", f"""with {_UNLOCKS}, h as (select *, event_date - date '{_TODAY}' as d from un where event_date between date '{_TODAY}' and date '{_TODAY}' + 30), f as (select symbol, min({{'d': d, 'pct': pct}}) as f from h group by symbol)
select c.symbol, case when f.f is null then 'low' when f.f.d <= 14 and f.f.pct >= 3 then 'high' else 'medium' end as risk from (select distinct lpad(cast(c_custkey as varchar), 6, '0') as symbol from customer) c left join f using (symbol)""")
def j16(spark, sf):
    names = fx.table(spark, sf, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 6, "0").alias("symbol")).distinct()
    return ev.unlock_risk(names, ev.events_within(_unlocks(spark, sf), F.lit(_TODAY).cast("date"), 30))


@query("j17_quote_fallback", """
with l as (select symbol, max_by(case when payload_id % 3 = 0 then 0 else data end, payload_id) as price, max_by(case when payload_id % 2 = 0 then data end, payload_id) as prev_close from payloads where source = 'sina' group by symbol), i as (select symbol, max_by(price, event_id) as last_price from ticks where side <> 'N' group by symbol),
d as (select symbol, max_by(look, trade_date) as close from settled group by symbol), c as (select symbol from ticks union select symbol from settled)
select symbol, rnd(coalesce(case when l.price > 0 then l.price when prev_close > 0 then prev_close end, last_price, close), 6) as price, case when l.price > 0 then 'live' when prev_close > 0 then 'prev_close' when last_price is not null then 'intraday' when close is not null then 'daily' end as price_source from c left join l using (symbol) left join i using (symbol) left join d using (symbol)""", "payloads ticks settled")
def j17(spark, sf):
    p, t = fx.payloads(spark, sf).filter("source = 'sina'"), fx.ticks(spark, sf)
    i = F.col("payload_id")
    price, prev = F.when(i % 3 == 0, 0.0).otherwise(F.col("data")), F.when(i % 2 == 0, F.col("data"))
    by = lambda c: F.max_by(c, F.when(c.isNotNull(), i))
    live = p.groupBy("symbol").agg(by(price).alias("price"), by(prev).alias("prev_close"))
    intraday = t.filter("side <> 'N'").groupBy("symbol").agg(F.max_by("price", "event_id").alias("last_price"))
    b = fx.bars(spark, sf).filter("revision = 0")
    daily = b.groupBy("symbol").agg(F.max_by("close", "trade_date").alias("close"))
    codes = t.select("symbol").unionByName(b.select("symbol")).distinct()
    return ev.quote_with_fallback(codes, live, intraday, daily).withColumn("price", rnd("price", 6))


@query("j18_calendar_rows", f"""
with {_UNLOCKS}, pool as (select distinct lpad(cast(c_custkey as varchar), 6, '0') as symbol from customer where c_custkey % 2 = 0), u as (select un.*, date_diff('day', date '{_TODAY}', event_date) as in_days from un join pool using (symbol))
select symbol, event_date, 'earnings' as kind, case when in_days < 0 then 'completed' else 'upcoming' end as status, case when in_days between 0 and 7 then 'HIGH' else 'MEDIUM' end as impact from u where in_days between -60 and 44 and pct < 3
union all select symbol, event_date, 'unlock', 'upcoming', case when pct >= 5 then 'HIGH' when pct >= 3 then 'MEDIUM' end from u where in_days between 0 and 30 and pct >= 3""")
def j18(spark, sf):
    pool = fx.table(spark, sf, "customer").filter("c_custkey % 2 = 0").select(F.lpad(F.col("c_custkey").cast("string"), 6, "0").alias("symbol")).distinct()
    u = _unlocks(spark, sf).join(pool, "symbol", "left_semi").withColumn("in_days", F.datediff("event_date", F.lit(_TODAY).cast("date")))
    d = F.col("in_days")
    earnings = u.filter(d.between(-60, 44) & (F.col("pct") < 3)).select("symbol", "event_date", F.lit("earnings").alias("kind"), F.when(d < 0, "completed").otherwise("upcoming").alias("status"), F.when(d.between(0, 7), "HIGH").otherwise("MEDIUM").alias("impact"))
    unlock = u.filter(d.between(0, 30) & (F.col("pct") >= 3)).select("symbol", "event_date", F.lit("unlock").alias("kind"), F.lit("upcoming").alias("status"), F.when(F.col("pct") >= 5, "HIGH").otherwise("MEDIUM").alias("impact"))
    return earnings.unionByName(unlock)
