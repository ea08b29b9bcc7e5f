"""Admission rules over provider answers, factor inputs and research dates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixtures import rnd

# The types that a policy event may have.
EVENT_TYPES = ("monetary_policy", "fiscal_policy", "industry_policy", "regulation", "trade_policy", "capital_market_rule", "geopolitical", "macro_release", "company_event", "other")


def available_before(log: DataFrame, decision: Column, symbol: str | None = None) -> DataFrame:
    seen = log.filter(F.col("available_time") <= decision)
    return seen if symbol is None else seen.filter(F.col("symbol") == symbol)


def is_fallback(flag: Column, source: Column) -> Column:
    return F.coalesce(flag, F.lit(False)) | F.coalesce(F.lower(source).contains("fallback"), F.lit(False))


def normalize_payloads(df: DataFrame) -> DataFrame:
    """Provider answers with source, availability (the fetch where none is declared), fallback, warnings as an array, and why one has no time."""
    warnings = F.array_compact(F.array("warning", "note"))
    source = F.coalesce("source", F.lit("legacy_unknown"))
    return df.select("payload_id", "symbol", source.alias("source"), "fetched_at", F.coalesce("available_time", "fetched_at").alias("available_time"), is_fallback(F.col("fallback"), source).alias("fallback"), warnings.alias("warnings"), "data")


def payload_freshness(df: DataFrame, ttl_seconds: int = 300) -> DataFrame:
    """status FALLBACK, STALE, FRESH or UNKNOWN (never fetched), and the age in seconds, not below 0."""
    age = F.greatest(F.lit(0), F.timestamp_diff("SECOND", F.col("fetched_at"), F.col("now")))
    fallback = is_fallback(F.col("fallback"), F.col("source"))
    stale = F.coalesce("is_stale", F.lit(False)) | (age > ttl_seconds)
    status = F.when(F.col("fetched_at").isNull(), "UNKNOWN").when(fallback, "FALLBACK").when(stale, "STALE").otherwise("FRESH")
    reason = F.when(F.col("fetched_at").isNull(), "missing_fetched_at").when(fallback, "fallback").when(stale, "ttl_expired").otherwise("within_ttl")
    return df.select("payload_id", status.alias("status"), age.alias("age_seconds"), reason.alias("reason"))


def provider_health(results: DataFrame, *keys: str) -> DataFrame:
    """Half for answers with data, 0.3 for answers that are no fallback, 0.2 for few warnings; and the ratios."""
    n = F.count("*")
    missing, fallback, warned = F.count_if(F.col("data").isNull()), F.count_if("fallback"), F.sum(F.size("warnings"))
    part = lambda x: F.greatest(F.lit(0.0), 1 - x / F.greatest(n, F.lit(1)))
    return results.groupBy(*keys).agg(
        rnd(part(missing) * 0.5 + part(fallback) * 0.3 + part(warned) * 0.2, 4).alias("score"), n.alias("n"), rnd(F.try_divide(missing, n)).alias("missing_ratio"),
        rnd(F.try_divide(fallback, n)).alias("fallback_ratio"), warned.alias("warning_count"),
    )


def gate_required(inputs: DataFrame, group: str, required: list[str]) -> DataFrame:
    """For each group of factor inputs (name, admissible): ready if none is rejected and every required name is there."""
    names = F.collect_set(F.when(F.col("admissible"), F.col("name")))
    gone = F.array_sort(F.array_except(F.array(*map(F.lit, required)), names))
    rejected = F.count_if(~F.coalesce("admissible", F.lit(False)))
    g = inputs.groupBy(group).agg(F.count_if("admissible").alias("admitted"), rejected.alias("rejected"), gone.alias("missing"))
    return g.withColumn("ready", (F.col("rejected") == 0) & (F.size("missing") == 0) & (F.col("admitted") > 0))


def beyond_boundary(df: DataFrame, day: str, start: str) -> DataFrame:
    """The rows that a research job may not read: days at or after the holdout's start."""
    return df.filter(F.col(day) >= F.lit(start).cast("date"))


def assert_research_zone(df: DataFrame, day: str, start: str) -> DataFrame:
    """``df``, or an error that names the first days at or after the holdout's start."""
    found = [str(r[0]) for r in beyond_boundary(df, day, start).select(day).distinct().sort(day).limit(5).collect()]
    if found:
        raise ValueError(f"holdout days from {start} reached a research job: {', '.join(found)}")
    return df


def assert_not_beyond(df: DataFrame, day: str, end: str) -> DataFrame:
    """``df``, or an error if its newest day lies after the requested end."""
    newest = df.agg(F.max(day)).first()[0]
    if newest is not None and str(newest)[:10] > end:
        raise ValueError(f"data reach {newest}, after the requested end {end}")
    return df


def split_admissible(decision: Column, **domains: DataFrame) -> DataFrame:
    """Records of all domains in one table with ``domain`` and ``admitted``."""
    parts = [df.withColumn("domain", F.lit(name)) for name, df in domains.items()]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    ok = F.col("event_time").isNotNull() & (F.col("available_time") >= F.col("event_time")) & (F.col("available_time") <= decision)
    return every.withColumn("admitted", F.coalesce(ok, F.lit(False)))


def policy_event_problem() -> Column:
    """Why a policy event (event_type, title, source, evidence_level) is refused; null for good ones."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return (
        F.when(~F.coalesce(F.col("event_type").isin(*EVENT_TYPES), F.lit(False)), "UNSUPPORTED_TYPE").when(blank("title") | blank("source"), "MISSING_FIELD")
        .when((F.col("event_type") == "geopolitical") & (F.coalesce("evidence_level", F.lit("UNVERIFIED")) == "UNVERIFIED"), "EVIDENCE_LEVEL_REQUIRED")
    )


def select_quotes(quotes: DataFrame, symbols: list[str]) -> DataFrame:
    """Quotes of the requested symbols in any spelling, of all if none is requested."""
    from ..sources.bars import normalize_symbol

    clean = quotes.withColumn("symbol", normalize_symbol(F.col("symbol")))
    if not symbols:
        return clean
    asked = quotes.sparkSession.createDataFrame([(s,) for s in symbols], "symbol string").select(normalize_symbol(F.col("symbol")).alias("symbol")).distinct()
    return clean.join(asked, "symbol", "left_semi")
