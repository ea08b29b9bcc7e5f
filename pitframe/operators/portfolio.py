"""Order costs, risk flags, regimes, quality scores, policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fixtures import rnd


def order_costs(orders: DataFrame, *, lot: int = 100, slippage: float = 0.001, commission: float = 0.0003, stamp: float = 0.0005, transfer: float = 0.00001) -> DataFrame:
    """Adds block (reason or null), executed, exec_price, cost and net_cash to orders with side, shares, price, limit_up, limit_down, suspended."""
    sell = F.col("side") == "sell"
    block = F.when(F.col("suspended"), "SUSPENDED").when(~sell & F.col("limit_up"), "LIMIT_UP").when(sell & F.col("limit_down"), "LIMIT_DOWN").when(F.col("shares") < lot, "LOT_SIZE")
    x = orders.withColumn("block", block).withColumn("executed", F.when(F.col("block").isNull(), F.floor(F.col("shares") / lot) * lot).otherwise(0))
    x = x.withColumn("exec_price", F.when(F.col("executed") > 0, F.col("price") * F.when(sell, 1 - slippage).otherwise(1 + slippage)).otherwise(F.col("price")))
    notional = F.col("executed") * F.col("exec_price")
    fees = notional * commission + F.when(sell, notional * stamp).otherwise(0.0) + notional * transfer
    x = x.withColumn("cost", fees + F.col("executed") * F.abs(F.col("exec_price") - F.col("price")))
    return x.withColumn("net_cash", F.when(sell, notional - fees).otherwise(-(notional + fees)))


def risk_flags(quality: Column, volatility: Column, drawdown: Column, liquid: Column) -> Column:
    return F.array_compact(F.array(F.when(quality < 0.75, "LOW_DATA_QUALITY"), F.when(volatility > 0.06, "HIGH_VOLATILITY"), F.when(drawdown < -0.12, "HIGH_DRAWDOWN_RISK"), F.when(~liquid, "LOW_LIQUIDITY")))


def allowed(flags: Column) -> Column:
    return ~F.arrays_overlap(flags, F.array(F.lit("LOW_DATA_QUALITY"), F.lit("LOW_LIQUIDITY")))


def quality_score(freshness: Column, missing: Column, agreement: Column, fallback: Column, duplicate: Column, stamps: Column) -> Column:
    clamp = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    part = lambda x: 1 - F.least(x, F.lit(1.0))
    return rnd(0.25 * clamp(1 - freshness / 30.0) + 0.2 * part(missing) + 0.2 * agreement + 0.15 * (1 - fallback) + 0.1 * part(duplicate) + 0.1 * clamp(stamps), 4)


def regime(trend: Column, breadth: Column, turnover: Column, volatility: Column, dispersion: Column, pressure: Column, liquidity: Column) -> Column:
    """UNKNOWN where 4 or more inputs, or all of turnover, volatility and liquidity, are missing; else by the first rule that holds."""
    inputs = (trend, breadth, turnover, volatility, dispersion, pressure, liquidity)
    missing = sum(c.isNull().cast("int") for c in inputs)
    z = lambda c: F.coalesce(c, F.lit(0.0))
    unknown = (missing >= 4) | (turnover.isNull() & volatility.isNull() & liquidity.isNull())
    name = F.when(unknown, "UNKNOWN").when(z(volatility) >= 2, "HIGH_VOL").when((z(liquidity) <= -2) & (z(pressure) <= -1), "RISK_OFF")
    return name.when((z(trend) >= 1) & (z(breadth) >= 0.5), "TREND_UP").when((z(trend) <= -1) & (z(breadth) <= -0.5), "TREND_DOWN").otherwise("RANGE")


def top_k(df: DataFrame, by: str, score: str, tie: str, k: int) -> DataFrame:
    """The k best of each group, ties by the smaller ``tie``, with their rank."""
    w = Window.partitionBy(by).orderBy(F.desc(score), tie)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def cap_per_group(df: DataFrame, day: str, group: str, order: str, n: int) -> DataFrame:
    """The first n of each day and group; rows without a group are not capped."""
    w = Window.partitionBy(day, group).orderBy(order)
    return df.withColumn("nth", F.row_number().over(w)).filter(F.col(group).isNull() | (F.col("nth") <= n)).drop("nth")


def turnover(selected: DataFrame, day: str = "trade_date", member: str = "symbol") -> DataFrame:
    """Members entering or leaving between consecutive days that have a selection, over the sum of max(book, 1); one row."""
    days = selected.select(day).distinct().withColumn("i", F.row_number().over(Window.orderBy(day)))
    x = selected.join(days, day).select("i", member)
    stay = x.join(x.withColumn("i", F.col("i") + 1), ["i", member]).groupBy("i").agg(F.count("*").alias("stay"))
    size = x.groupBy("i").agg(F.count("*").alias("n"))
    prev = size.select((F.col("i") + 1).alias("i"), F.col("n").alias("before"))
    y = size.join(prev, "i").join(stay, "i", "left").fillna(0, ["stay"])
    return y.agg(rnd(F.coalesce(F.sum(F.col("n") + F.col("before") - 2 * F.col("stay")) / F.sum(F.greatest("n", F.lit(1))), F.lit(0.0))).alias("turnover"))


def append_outcomes(store: DataFrame, batch: DataFrame) -> DataFrame:
    """``batch`` (record_id, run_id, symbol) with outcome created or already_exists, against the store and the batch's own earlier rows.

    A row's identity is its run and record, or record and symbol where it has no run; the store knows its rows by both."""
    by_run = F.concat_ws(":", "run_id", F.col("record_id").cast("string"))
    plain = F.concat_ws("|", F.col("record_id").cast("string"), "symbol")
    known = store.select(by_run.alias("key")).unionByName(store.select(plain.alias("key"))).distinct().withColumn("known", F.lit(True))
    x = batch.withColumn("key", F.when(F.col("run_id").isNotNull(), by_run).otherwise(plain))
    x = x.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy("symbol"))).join(known, "key", "left")
    seen = (F.col("nth") > 1) | F.coalesce("known", F.lit(False))
    return x.select(*batch.columns, F.when(seen, "already_exists").otherwise("created").alias("outcome"))
