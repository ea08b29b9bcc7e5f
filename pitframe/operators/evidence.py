"""Provenance, source health, research queries with their selection labels, evidence bundles and traces back to raw records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


LINEAGE = ("source", "source_id")
# Names that stand for no source.
PLACEHOLDERS = ("unknown", "test", "placeholder", "n/a", "none", "")
STAMP = "yyyy-MM-dd HH:mm:ss"


def provenance_issues() -> Column:
    """Why a record's origin is not confirmed, as an array; empty for good ones."""
    blank = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    return F.array_compact(F.array(
        F.when(F.lower(F.trim(F.coalesce("source", F.lit("")))).isin(*PLACEHOLDERS), "source_is_placeholder"), F.when(blank("source_id"), "missing_source_id"), F.when(blank("ingested_at"), "missing_ingested_at"),
        F.when(F.col("quality_status") == "UNRESOLVED", "provenance_unresolved"), F.when(F.col("quality_status") == "INVALID", "provenance_invalid"),
    ))


def record_decision(info: DataFrame, decision: Column, freshness: Column) -> DataFrame:
    """``info`` with reasons and decision: UNRESOLVED without availability, REJECTED without a confirmed origin, a warning for any other reason."""
    av, event = F.col("available_time"), F.col("event_time")
    origin = F.transform(provenance_issues(), lambda x: F.concat(F.lit("PROVENANCE_"), F.upper(x)))
    rest = F.array_compact(F.array(
        F.when(av.isNull() | (F.col("quality_status") == "UNRESOLVED"), "AVAILABLE_TIME_UNRESOLVED"), F.when(av.isNull(), "AVAILABLE_TIME_MISSING"), F.when((av > decision) | (av < event), "PIT_REJECTED"),
        F.when(av < event, "AVAILABLE_BEFORE_EVENT"), F.when(F.col("ingested_at") < av, "INGESTED_BEFORE_AVAILABLE"),
        F.when(freshness == "stale", "SOURCE_STALE").when(freshness == "unknown", "FRESHNESS_UNKNOWN").when(freshness == "missing_policy", "FRESHNESS_MISSING_POLICY"),
    ))
    x = info.withColumn("__origin", origin).withColumn("reasons", F.concat("__origin", rest))
    out = F.when(av.isNull() | (F.col("quality_status") == "UNRESOLVED"), "UNRESOLVED").when(F.size("__origin") > 0, "REJECTED").when(F.size("reasons") > 0, "ADMISSIBLE_WITH_WARNING").otherwise("ADMISSIBLE")
    return x.withColumn("decision", out).drop("__origin")


def source_health(m: DataFrame) -> DataFrame:
    """``m`` (attempted, accepted, rejected, duplicates, mutations, errors, fresh, stale, coverage) with health and reasons.

    Branches in order: nothing observed, errors without an accepted row, no row at all (the documented meaning of EMPTY), then
    a stale majority before blemishes and missing coverage."""
    c = F.col
    none = (c("attempted") == 0) & (c("accepted") == 0) & (c("errors") == 0)
    error = (c("accepted") == 0) & (c("errors") > 0)
    empty = (c("accepted") == 0) & (c("rejected") == 0) & (c("duplicates") == 0)
    stale = (c("stale") > c("fresh")) & (c("fresh") + c("stale") > 0)
    partial = (c("coverage") < 1) & (c("accepted") > 0)
    blemish = (c("errors") > 0) | (c("mutations") > 0) | (c("rejected") > 0)
    health = F.when(none, "UNRESOLVED").when(error, "ERROR").when(empty, "EMPTY").when(stale, "STALE").when(partial | blemish, "DEGRADED").otherwise("OK")
    rest = ~(none | error | empty)
    reasons = F.array_compact(F.array(
        F.when(none, "NO_ATTEMPTS"), F.when(~none & error, "ERRORS_ONLY"), F.when(~none & ~error & empty, "ZERO_ROWS"), F.when(rest & (c("errors") > 0), "ERRORS"), F.when(rest & (c("mutations") > 0), "MUTATIONS"),
        F.when(rest & (c("rejected") > 0), "REJECTED_ROWS"), F.when(rest & stale, "MAJORITY_STALE"), F.when(rest & ~stale & partial, "COVERAGE"),
    ))
    return m.withColumn("health", health).withColumn("reasons", reasons)


def missingness(source_error: Column, parse_failure: Column, unresolved: Column, empty: Column, declared: Column) -> Column:
    """One class by priority: hard failures, then unresolved availability, an empty source, a declared absence, else unexpected."""
    return F.when(source_error, "SOURCE_ERROR").when(parse_failure, "PARSE_FAILURE").when(unresolved, "UNRESOLVED_AVAILABILITY").when(empty, "SOURCE_EMPTY").when(declared, "EXPECTED_ABSENCE").otherwise("UNEXPECTED_MISSING")


def research_query(info: DataFrame, queries: DataFrame) -> DataFrame:
    """In-scope records of a table of queries (entity_id, entity_type, as_of) with reason: null where visible, else why not.

    An equi-join on the entity: what lies outside every query's scope is never paired with it."""
    q = queries.withColumnRenamed("entity_type", "information_type")
    j = info.join(q, "entity_id").filter(F.col("entity_type") == F.col("information_type")).drop("information_type")
    return j.withColumn("reason", F.when(F.col("available_time").isNull(), "UNRESOLVED_AVAILABILITY").when(F.col("available_time") > F.col("as_of"), "NOT_YET_AVAILABLE"))


def selection(visible: DataFrame, scope: list[str]) -> DataFrame:
    """Visible records with ``selected`` and ``label``: how each lineage's record was chosen, or why a record was not.

    The highest revision wins, then the earliest availability, then the smallest record. Repeats of the winner are the winner."""
    identity = ["revision", "available_time", "entity_id", "value"]
    rows = visible.dropDuplicates([*scope, *LINEAGE, *identity])
    part = Window.partitionBy(*scope, *LINEAGE)
    order = part.orderBy(F.desc("revision"), "available_time", "entity_id", "value")
    x = rows.withColumn("rn", F.row_number().over(order)).withColumn("best", F.first(F.struct("revision", "available_time")).over(order))
    other = F.col("rn") > 1
    tied = other & (F.col("revision") == F.col("best.revision"))
    x = x.withColumn("ties", F.count_if(tied).over(part)).withColumn("close", F.count_if(tied & (F.col("available_time") == F.col("best.available_time"))).over(part))
    chosen = F.when(F.col("ties") == 0, "HIGHEST_REVISION").when(F.col("close") == 0, "EARLIEST_ON_REVISION_TIE").otherwise("CANONICAL_TIEBREAK")
    lost = F.when(F.col("revision") < F.col("best.revision"), "LOWER_REVISION").when(F.col("available_time") > F.col("best.available_time"), "REVISION_TIE_NOT_EARLIEST").otherwise("CANONICAL_TIEBREAK")
    return x.withColumn("selected", ~other).withColumn("label", F.when(other, lost).otherwise(chosen)).drop("rn", "best", "ties", "close")


def identified(info: DataFrame, adapter: str = "v1") -> DataFrame:
    """Records with payload hash, ingestion id and evidence id over their canonical text."""
    text = lambda c: F.date_format(c, STAMP)
    payload = F.sha2(F.concat_ws("|", "entity_id", F.floor(F.col("value") * 100 + 0.5).cast("long").cast("string")), 256)
    x = info.withColumn("payload_hash", payload)
    x = x.withColumn("ingestion_id", F.sha2(F.concat_ws("|", *LINEAGE, F.col("revision").cast("string"), "payload_hash", F.lit(adapter)), 256))
    return x.withColumn("evidence_id", F.sha2(F.concat_ws("|", *LINEAGE, F.col("revision").cast("string"), text("event_time"), text("available_time"), F.lit(adapter), "payload_hash", "ingestion_id"), 256))


def bundles(resolved: DataFrame, excluded: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each query: evidence and candidates nested, exclusions by reason, counts, and a hash over them.

    A bundle holds the records of one entity; that is the size of its arrays."""
    item = F.struct("source", "source_id", "revision", "evidence_id", "label")
    picked = lambda want: F.sort_array(F.collect_list(F.when(want, item)))
    e = resolved.groupBy(*keys).agg(picked(F.col("selected")).alias("evidence"), picked(~F.col("selected")).alias("candidates"))
    x = excluded.groupBy(*keys).agg(F.count("*").alias("exclusions"))
    b = e.join(x, keys, "full").withColumn("exclusions", F.coalesce("exclusions", F.lit(0)))
    ids = lambda c: F.array_join(F.transform(F.coalesce(c, F.array().cast(e.schema["evidence"].dataType)), lambda v: v["evidence_id"]), ",")
    size = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c))
    b = b.withColumn("n_evidence", size("evidence")).withColumn("n_candidates", size("candidates"))
    return b.withColumn("bundle_id", F.sha2(F.concat_ws("|", ids("evidence"), ids("candidates"), F.col("exclusions").cast("string")), 256))


def reverse_trace(evidence: DataFrame, raw: DataFrame) -> DataFrame:
    """``evidence`` with trace: NOT_FOUND, AMBIGUOUS, RAW_CORRUPTED, IDENTITY_MISMATCH or OK, by ingestion id and payload hash."""
    fields = [*LINEAGE, "revision", "event_time", "available_time"]
    first = F.first(F.struct(*fields)).alias("raw")
    g = raw.groupBy("ingestion_id", "payload_hash").agg(F.count("*").alias("matches"), F.bool_or(F.greatest(*[F.col(c).isNull() for c in fields])).alias("broken"), first)
    x = evidence.join(g, ["ingestion_id", "payload_hash"], "left")
    same = F.lit(True)
    for c in fields:
        same = same & F.col(c).eqNullSafe(F.col(f"raw.{c}"))
    trace = F.when(F.col("matches").isNull(), "NOT_FOUND").when(F.col("broken"), "RAW_CORRUPTED").when(F.col("matches") > 1, "AMBIGUOUS").when(~same, "IDENTITY_MISMATCH").otherwise("OK")
    return x.withColumn("trace", trace).drop("matches", "broken", "raw")


def merge_events(old: DataFrame, new: DataFrame) -> DataFrame:
    """Events (ticker, event_type, event_date, note): manual old ones stay, automatic old ones give way to the new; one row a key, old before new."""
    auto = F.coalesce(F.col("note").contains("source:"), F.lit(False))
    rows = old.filter(~auto).withColumn("turn", F.lit(0)).unionByName(new.withColumn("turn", F.lit(1)))
    w = Window.partitionBy("ticker", "event_type", "event_date").orderBy("turn", "note")
    return rows.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn", "turn")


def may_overwrite(old: DataFrame, new: DataFrame, force: bool = False) -> bool:
    """Whether the new set may replace the old: not if it is empty while the old one holds manual rows."""
    auto = F.coalesce(F.col("note").contains("source:"), F.lit(False))
    return force or not new.isEmpty() or old.filter(~auto).isEmpty()


def last_valid(df: DataFrame, by: str, order: str, keys: list[str]) -> DataFrame:
    """The latest row of each group whose key columns all have values."""
    rest = [c for c in df.columns if c != by]
    ok = df.na.drop(subset=keys)
    return ok.groupBy(by).agg(F.max_by(F.struct(*rest), order).alias("r")).select(by, "r.*")


def events_within(events: DataFrame, today: Column, days: int) -> DataFrame:
    """Calendar rows from today to ``days`` ahead, with in_days."""
    x = events.withColumn("in_days", F.datediff("event_date", today))
    return x.filter(F.col("in_days").between(0, days))


def unlock_risk(names: DataFrame, unlocks: DataFrame) -> DataFrame:
    """high: at least 3 % within 14 days by the first unlock ahead; medium: any ahead; low: none."""
    first = unlocks.groupBy("symbol").agg(F.min(F.struct("in_days", "pct")).alias("f"))
    high = (F.col("f.in_days") <= 14) & (F.col("f.pct") >= 3)
    return names.join(first, "symbol", "left").withColumn("risk", F.when(F.col("f").isNull(), "low").when(high, "high").otherwise("medium")).drop("f")


def match_sector(wanted: DataFrame, board: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Each wanted name with the board's sector it means: by alias or equal name, one name within the other, or a shared first or last two letters.

    The board has one row a sector and is broadcast below 10,000 of them; more would have to be matched by exact name alone."""
    if board.limit(10_001).count() > 10_000:
        raise ValueError("a sector board has at most 10,000 rows")
    alias = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    w = wanted.withColumn("mapped", F.coalesce(alias[F.col("wanted")], F.col("wanted")))
    n, m, o = F.col("name"), F.col("mapped"), F.col("wanted")
    rank = F.when(n == m, 1).when(n.contains(m) | m.contains(n), 2).when(n.contains(F.substring(o, 1, 2)), 3).when(n.contains(F.expr("right(wanted, 2)")), 4)
    j = w.join(F.broadcast(board), rank.isNotNull(), "left").withColumn("rank", rank)
    best = j.withColumn("rn", F.row_number().over(Window.partitionBy("wanted").orderBy(F.asc_nulls_last("rank"), "place"))).filter("rn = 1")
    return best.select("wanted", "name", "rank")


def quote_with_fallback(codes: DataFrame, live: DataFrame, intraday: DataFrame, daily: DataFrame) -> DataFrame:
    """price and the source it came from: the live quote (its previous close where the price is 0), the last trade of the day, the daily close."""
    x = codes.join(live, "symbol", "left").join(intraday, "symbol", "left").join(daily, "symbol", "left")
    quote = F.when(F.col("price") > 0, F.col("price")).otherwise(F.when(F.col("prev_close") > 0, F.col("prev_close")))
    source = F.when(F.col("price") > 0, "live").when(F.col("prev_close") > 0, "prev_close").when(F.col("last_price").isNotNull(), "intraday").when(F.col("close").isNotNull(), "daily")
    return x.select("symbol", F.coalesce(quote, "last_price", "close").alias("price"), source.alias("price_source"))
