"""Reading, checking and merging bars and memberships."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import stored

BAR_SCHEMA = "symbol string, trade_date date, event_time timestamp_ntz, available_time timestamp_ntz, revision int, open double, high double, low double, close double, volume double, amount double"
MEMBERSHIP_SCHEMA = "symbol string, industry_code string, effective_from date, effective_to date, available_time timestamp_ntz"
BAR_KEY = ("symbol", "event_time", "revision")
_OFFSET = r"(Z|[+-]\d{2}:?\d{2})$"


def write_bars(df: DataFrame, path: str) -> None:
    """Parquet by month, symbols together in each file, so that reads prune both ways; a later write replaces the months it has."""
    month = F.date_format("trade_date", "yyyy-MM")
    df.withColumn("month", month).repartition("month").sortWithinPartitions("symbol", "event_time").write.partitionBy("month").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def read_bars(spark: SparkSession, path: str, symbols: list[str] | None = None) -> DataFrame:
    """All revisions of a dataset of bars, of some symbols or of all."""
    df = spark.read.schema(BAR_SCHEMA + ", month string").parquet(path).drop("month")
    return df if symbols is None else df.filter(F.col("symbol").isin(symbols))


def upsert_bars(existing: DataFrame, incoming: DataFrame, batch: str | None = None) -> DataFrame:
    """One row for each symbol, event and revision, the last one written: any incoming one before the existing, later ``batch`` values before earlier,
    then the one available later, then the one of larger values (so that equal keys have one winner on every run).

    Incoming rows that the record rules reject (see ``stamp_problem``: no availability, or before the event) fail the write."""
    bad = F.col("available_time").isNull() | F.col("event_time").isNull() | (F.col("available_time") < F.col("event_time"))
    new = incoming.withColumn("__turn", F.lit(1)).withColumn("__ok", F.assert_true(~bad, F.lit("incoming bars need available_time at or after event_time")))
    old = existing.withColumn("__turn", F.lit(0)).withColumn("__ok", F.lit(None).cast("void"))
    rows = old.unionByName(new, allowMissingColumns=batch is not None)
    ties = ["available_time", *sorted(c for c in existing.columns if c not in (*BAR_KEY, "available_time"))]
    order = [F.desc("__turn")] + ([F.desc(batch)] if batch else []) + [F.desc(c) for c in ties]
    last = rows.withColumn("__nth", F.row_number().over(Window.partitionBy(*BAR_KEY).orderBy(*order)))
    return last.filter((F.col("__nth") == 1) & F.col("__ok").isNull()).drop("__nth", "__turn", "__ok")


def merge_bars(spark: SparkSession, path: str, incoming: DataFrame, batch: str | None = None) -> list[str]:
    """``upsert_bars`` into a dataset of ``write_bars`` in place: only the months that the incoming rows touch are read and written; returns them.

    The merged months are written apart first, since they are read from where they go. Merging the same rows again changes nothing."""
    incoming = incoming.withColumn("month", F.date_format("trade_date", "yyyy-MM"))
    months = sorted(r[0] for r in incoming.select("month").distinct().collect())  # one value a month
    if months:
        old = spark.read.schema(BAR_SCHEMA + ", month string").parquet(path).filter(F.col("month").isin(months)).drop("month")
        merged = stored(upsert_bars(old, incoming.drop("month"), batch).select(*old.columns), "merged-bars")
        write_bars(merged, path)
    return months


def stamp_problem(event: Column, available: Column) -> Column:
    """Why a record's stamps (text) are rejected: MISSING, MALFORMED, NAIVE (no offset) or BACKWARDS; null for good ones."""
    parsed = lambda c: F.try_to_timestamp(c)
    missing = event.isNull() | available.isNull()
    naive = ~event.rlike(_OFFSET) | ~available.rlike(_OFFSET)
    return (
        F.when(missing, "MISSING").when(parsed(event).isNull() | parsed(available).isNull(), "MALFORMED").when(naive, "NAIVE").when(parsed(available) < parsed(event), "BACKWARDS")
    )


def normalize_vendor_bars(df: DataFrame, vendor: str, asset_scope: str = "cn_stock") -> DataFrame:
    """Vendor rows in one schema. ``shares``: volume in shares and amount in money; ``lots``: amount is volume in lots of 100, money is unknown."""
    if vendor not in ("shares", "lots"):
        raise ValueError(f"unknown vendor schema: {vendor}")
    num = lambda c: F.try_to_number(c, F.lit("999999999999.9999")).cast("double") if dict(df.dtypes)[c] == "string" else F.col(c).cast("double")
    volume, amount = (num("volume"), num("amount")) if vendor == "shares" else (num("amount") * 100, F.lit(None).cast("double"))
    day = F.to_date("date")
    at = lambda h: day.cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(h))
    return df.select(
        F.lpad(F.col("symbol").cast("string"), 6, "0").alias("symbol"), day.alias("trade_date"), at(7).alias("event_time"), at(8).alias("available_time"), F.lit(0).alias("revision"),
        *[num(c).alias(c) for c in ("open", "high", "low", "close")], volume.alias("volume"), amount.alias("amount"), F.lit(asset_scope).alias("asset_scope"),
    )


def read_membership_csv(spark: SparkSession, path: str) -> DataFrame:
    """Industry intervals; symbols stay text with their zeros, an empty end is open. Missing columns fail."""
    wanted = [x.split()[0] for x in MEMBERSHIP_SCHEMA.split(", ")]
    raw = spark.read.option("header", True).csv(path)
    if gone := sorted(set(wanted) - set(raw.columns)):
        raise ValueError(f"membership file lacks columns: {gone}")
    types = dict(x.split() for x in MEMBERSHIP_SCHEMA.split(", "))
    clean = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    return raw.select(F.lpad(clean("symbol"), 6, "0").alias("symbol"), *[clean(c).cast(types[c]).alias(c) for c in wanted[1:]])


def build_intervals(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(intervals, conflicts) from classification changes (symbol, start_date, industry_code of six digits).

    The class is the first two digits; a start ends the interval before it and is known the day after at 16:00+08:00. A symbol and date with
    several classes is a conflict and gives no interval."""
    g = changes.groupBy(F.lpad("symbol", 6, "0").alias("symbol"), "start_date").agg(F.sort_array(F.collect_set(F.concat(F.substring("industry_code", 1, 2), F.lit("0000")))).alias("codes"))
    one = g.filter(F.size("codes") == 1)
    nxt = F.lead("start_date").over(Window.partitionBy("symbol").orderBy("start_date"))
    known = F.col("start_date").cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(32))
    intervals = one.select("symbol", F.concat(F.lit("SW1:"), F.col("codes")[0]).alias("industry_code"), F.col("start_date").alias("effective_from"), nxt.alias("effective_to"), known.alias("available_time"))
    return intervals, g.filter(F.size("codes") > 1)


def manifest(df: DataFrame, digits: int = 6) -> DataFrame:
    """One row that fixes the content of a table: rows, and an order-free sum of 60-bit row hashes that another engine can take again.

    A row's text joins its columns by ``|``, nulls as ``~``, times to the second, doubles as whole numbers of ``digits`` decimals."""
    def said(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        if kind in ("double", "float"):
            c = F.floor(c * float(10**digits) + 0.5)
        elif kind.startswith("timestamp"):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        return F.coalesce(c.cast("string"), F.lit("~"))

    text = F.concat_ws("|", *[said(*c) for c in df.dtypes])
    key = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(key), F.lit(0).cast("decimal(38,0)")).cast("string").alias("checksum"))


def normalize_symbol(c: Column) -> Column:
    """Six digits of 600000.SH, sz000001, 1 and the like; null where there is no digit."""
    digits = F.regexp_replace(F.lower(c), "[^0-9]", "")
    return F.when(digits != "", F.lpad(digits, 6, "0"))


def vendor_symbol(code: Column) -> Column:
    return F.concat(code, F.when(code.startswith("6"), ".SH").otherwise(".SZ"))
