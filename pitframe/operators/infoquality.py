"""Admissibility, revisions, conflicts and quality of information records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fixtures import rnd

LINEAGE = ("source", "source_id")


def pit_status(event: Column, available: Column, decision: Column, fallback: Column) -> Column:
    """FALLBACK, MISSING_TIME, INVALID_TIME, ADMISSIBLE or FUTURE, by the first rule that holds; availability is inclusive."""
    missing = event.isNull() | available.isNull()
    return F.when(fallback, "FALLBACK").when(missing, "MISSING_TIME").when(available < event, "INVALID_TIME").when(available <= decision, "ADMISSIBLE").otherwise("FUTURE")


def deduplicate(info: DataFrame) -> DataFrame:
    """One row for each (source, source_id, revision): that of the smallest canonical text."""
    canonical = F.concat_ws("|", "entity_id", F.col("value").cast("string"), F.col("available_time").cast("string"))
    w = Window.partitionBy(*LINEAGE, "revision").orderBy("available_time", "entity_id", "value", canonical)
    return info.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def visible_revisions(info: DataFrame, at: Column) -> DataFrame:
    """For each lineage the highest revision available by ``at``; ties by the earliest availability, then the smallest record."""
    w = Window.partitionBy(*LINEAGE).orderBy(F.desc("revision"), "available_time", "entity_id", "value")
    return info.filter(F.col("available_time") <= at).withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def ingest(store: DataFrame, batch: DataFrame, key: list[str], hash_col: str, order: str) -> DataFrame:
    """``batch`` with outcome ACCEPTED, DUPLICATE or RAW_MUTATION_DETECTED, against the store and the earlier rows of the batch."""
    w = Window.partitionBy(*key).orderBy(order)
    b = batch.withColumn("first", F.first(hash_col).over(w)).withColumn("nth", F.row_number().over(w))
    s = store.select(*key, F.col(hash_col).alias("known"))
    x = b.join(s, key, "left").withColumn("against", F.coalesce("known", F.when(F.col("nth") > 1, F.col("first"))))
    out = F.when(F.col("against").isNull(), "ACCEPTED").when(F.col("against") == F.col(hash_col), "DUPLICATE").otherwise("RAW_MUTATION_DETECTED")
    return x.withColumn("outcome", out).drop("first", "nth", "known", "against")


def smallest_text(info: DataFrame) -> DataFrame:
    """One row for each (source, source_id, revision): that of the smallest text in ``canonical``."""
    w = Window.partitionBy(*LINEAGE, "revision").orderBy("canonical")
    return info.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def conflict_groups(info: DataFrame, keys: tuple[str, ...] = ("entity_id", "entity_type", "event_time")) -> DataFrame:
    """Entities and events (and units, where ``keys`` names them; null is a unit too) with two or more sources and two or more values."""
    g = info.groupBy(*keys).agg(F.count_distinct("source").alias("sources"), F.count_distinct("value").alias("values"))
    return g.filter("sources > 1 and values > 1")


def reconcile(info: DataFrame, absolute: float, relative: float, keys: tuple[str, ...] = ("entity_id", "event_time")) -> DataFrame:
    """CONSISTENT, CONFLICT or INSUFFICIENT_SOURCES by the range of the values against the tolerance."""
    g = info.groupBy(*keys).agg(F.count_distinct("source").alias("n"), (F.max("value") - F.min("value")).alias("spread"), F.max(F.abs("value")).alias("most"), F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"))
    tolerance = F.greatest(F.lit(absolute), F.lit(relative) * F.col("most"))
    return g.withColumn("status", F.when(F.col("n") < 2, "INSUFFICIENT_SOURCES").when(F.col("spread") <= tolerance, "CONSISTENT").otherwise("CONFLICT"))


def text_stamp_issues(now: Column) -> Column:
    """Issues of event_time, available_time and ingested_at as text: malformed, no time part, orders that cannot be, the future."""
    t = {c: F.try_to_timestamp(F.col(c)).cast("timestamp_ntz") for c in ("event_time", "available_time", "ingested_at")}
    said = [F.when(F.col(c).isNotNull() & (F.col(c) != "") & v.isNull(), f"{c}_malformed") for c, v in t.items()]
    said += [F.when((F.col(c) != "") & ~F.col(c).contains("T"), f"{c}_no_time_component") for c in t]
    said += [F.when(t["ingested_at"] < t["available_time"], "ingested_before_available"), F.when(t["available_time"] < t["event_time"], "available_before_event")]
    said += [F.when(t[c] > now, f"{c}_in_future") for c in ("event_time", "available_time")]
    return F.array_compact(F.array(*said))


def timestamp_issues(event: Column, available: Column, ingested: Column, now: Column) -> Column:
    return F.array_compact(F.array(F.when(ingested < available, "INGESTED_BEFORE_AVAILABLE"), F.when(available < event, "AVAILABLE_BEFORE_EVENT"), F.when(available > now, "FUTURE")))


def revision_issues(info: DataFrame) -> DataFrame:
    """For each lineage: revisions with several payloads, gaps of more than one, and availability that goes back."""
    per = info.groupBy(*LINEAGE, "revision").agg(F.count_distinct("value", "entity_id").alias("payloads"), F.min("available_time").alias("t"))
    w = Window.partitionBy(*LINEAGE).orderBy("revision")
    x = per.withColumn("gap", F.col("revision") - F.lag("revision").over(w)).withColumn("before", F.lag("t").over(w))
    return x.groupBy(*LINEAGE).agg(F.count_if(F.col("payloads") > 1).alias("mutated"), F.count_if(F.col("gap") > 1).alias("gaps"), F.count_if(F.col("t") < F.col("before")).alias("regressions"))


def freshness(available: Column, now: Column, days: Column) -> Column:
    age = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(available.cast("timestamp"))
    return F.when(days.isNull(), "missing_policy").when(available.isNull(), "unknown").when(age <= days * 86400, "fresh").otherwise("stale")


def project_info(raw: DataFrame, registry: DataFrame) -> DataFrame:
    """Raw records as information records: without availability they are UNRESOLVED, and each carries its source's freshness policy."""
    known = F.broadcast(registry.select("source", F.col("policy").alias("freshness_policy_id")))  # one row a registered source
    return raw.join(known, "source", "left").withColumn("quality_status", F.when(F.col("available_time").isNull(), "UNRESOLVED").otherwise(F.col("quality_status")))


#: Source -> entity type, payload field with the value, unit, currency, payload field with the text.
PROJECTIONS = {
    "cn_index_daily": ("INDEX", "close", "points", None, None),
    "company_announcement": ("LISTED_COMPANY", None, None, None, "content"),
    "macro_pmi_cn": ("ECONOMY", "value", "index", None, None),
    "us_index_daily": ("INDEX", "close", "points", "USD", None),
}


def source_projection(raw: DataFrame, source: str) -> DataFrame:
    """Payloads (struct ``payload``) of a source as information records."""
    entity, value, unit, currency, content = PROJECTIONS[source]
    field = lambda name, kind: F.col(f"payload.{name}") if name else F.lit(None).cast(kind)
    return raw.select(
        F.lit(source).alias("source"), "payload.source_id", "payload.revision", F.lit(entity).alias("entity_type"), field(value, "double").alias("value"),
        F.lit(unit).cast("string").alias("unit"), F.lit(currency).cast("string").alias("currency"), field(content, "string").alias("content"),
    )


def summarize_status(rows: DataFrame, *keys: str) -> DataFrame:
    """Counts of each admission status, the admissible share, and whether all are."""
    n = lambda s: F.count_if(F.col("status") == s)
    ok = n("ADMISSIBLE")
    return rows.groupBy(*keys).agg(
        ok.alias("admissible"), n("FUTURE").alias("future"), n("MISSING_TIME").alias("missing_time"), n("FALLBACK").alias("fallback"), rnd(ok / F.count("*")).alias("admissible_ratio"), (ok == F.count("*")).alias("all_admissible"),
    )


def select_asof(info: DataFrame, decision: str, holdout_start: str) -> DataFrame:
    """Admissible records at a decision, one for each key and revision; a decision in the holdout is an error."""
    if decision[:10] >= holdout_start:
        raise ValueError(f"decision {decision} lies in the holdout from {holdout_start}")
    seen = info.filter((F.col("available_time") >= F.col("event_time")) & (F.col("available_time") <= F.lit(decision).cast("timestamp_ntz")))
    w = Window.partitionBy("source", "source_id", "revision").orderBy("entity_id", "value", "available_time")
    return seen.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")
