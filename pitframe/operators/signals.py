"""Rule columns over settled daily bars (symbol, trade_date, final, high, volume), for every symbol and day at once.

Rows with too little history hold null (or the name the rule gives to missing data); nothing looks past its own row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..fixtures import rnd

def _by() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("trade_date")


def _full(agg: Column, n: int, over: WindowSpec | None = None) -> Column:
    """An aggregate over the last ``n`` rows, null where there are fewer."""
    w = (over or _by()).rowsBetween(1 - n, 0)
    return F.when(F.count(F.lit(1)).over(w) == n, agg.over(w))


def technical(bars: DataFrame) -> DataFrame:
    """ret and ma_gap over 5, 20 and 60 rows, vol_z20 (sample deviation) and rsi14 (simple means; null without losses)."""
    c, v = F.col("final"), F.col("volume")
    step = c - F.lag("final").over(_by())
    x = bars.withColumn("__up", F.greatest(step, F.lit(0.0))).withColumn("__down", F.greatest(-step, F.lit(0.0)))
    x = x.withColumn("__rn", F.row_number().over(_by()))
    w14 = _by().rowsBetween(-13, 0)
    up, down = F.avg("__up").over(w14), F.avg("__down").over(w14)
    sd = _full(F.stddev_samp("volume"), 20)
    cols = []
    for n in (5, 20, 60):
        cols += [rnd(c / F.lag("final", n).over(_by()) - 1).alias(f"ret_{n}"), rnd(c / _full(F.avg("final"), n) - 1).alias(f"ma_gap_{n}")]
    z = F.when(sd > 0, (v - _full(F.avg("volume"), 20)) / sd)
    rsi = F.when((F.col("__rn") > 14) & (down > 1e-9), 100 - 100 / (1 + up / down))
    return x.select("symbol", "trade_date", *cols, rnd(z, 6).alias("vol_z20"), rnd(rsi, 6).alias("rsi14"))


def moving(bars: DataFrame) -> DataFrame:
    """With ma5, ma10, ma20, ma60, and lr = volume over its mean of 20 rows; pct is the move from the row before, in percent."""
    for n in (5, 10, 20, 60):
        bars = bars.withColumn(f"ma{n}", rnd(_full(F.avg("final"), n), 6))
    mean = _full(F.avg("volume"), 20)
    bars = bars.withColumn("lr", rnd(F.when(mean > 0, F.col("volume") / mean), 6))
    return bars.withColumn("pct", rnd((F.col("final") / F.lag("final").over(_by()) - 1) * 100, 6))


def bias_risk(moved: DataFrame) -> DataFrame:
    """Distance from each average in percent and the risk tier, over the averages that exist."""
    for n in (5, 10, 20, 60):
        moved = moved.withColumn(f"bias{n}", rnd((F.col("final") - F.col(f"ma{n}")) / F.col(f"ma{n}") * 100, 2))
    b = [F.col(f"bias{n}") for n in (5, 10, 20, 60)]
    most, least = F.greatest(*b), F.least(*b)
    short = F.greatest(F.coalesce(b[0], F.lit(0.0)), F.coalesce(b[1], F.lit(0.0)))
    risk = (
        F.when(most.isNull(), "UNKNOWN").when(most > 40, "EXTREME_OVERHEAT").when((F.coalesce(b[2], F.lit(0.0)) > 25) | (short > 30), "OVERHEAT")
        .when(short > 15, "WARM").when(least < -20, "EXTREME_OVERSOLD").when(least < -10, "OVERSOLD").otherwise("NORMAL")
    )
    return moved.withColumn("risk", risk)


def trend_verdict(moved: DataFrame) -> DataFrame:
    """Order of price and averages as one of nine verdicts."""
    p, m5, m10, m20, m60 = (F.col(c) for c in ("final", "ma5", "ma10", "ma20", "ma60"))
    over = (p > m20) & (p > m60)
    verdict = (
        F.when(m60.isNull(), "NO_DATA").when((p > m5) & (m5 > m10) & (m10 > m20) & (m20 > m60), "BULL_STRONG").when(over & (m5 > m20) & (p > m5), "BULL")
        .when(over & (p > m5), "BULL_RESTING").when(over & (m5 > m20), "BULL_PULLBACK").when((p < m5) & (m5 < m10) & (m10 < m20), "BEAR")
        .when((p <= m20) & (p <= m60) & (m5 < m20) & (m20 < m60) & (p < m5), "BEAR_STRONG").when(F.abs(p - m20) / m20 < 0.02, "TANGLED").otherwise("MIXED")
    )
    return moved.withColumn("verdict", verdict)


def volume_regime(moved: DataFrame) -> DataFrame:
    """Tier of the volume ratio, and the sign of price and volume moving apart or together."""
    lr, pct = F.col("lr"), F.col("pct")
    tier = F.when(lr.isNull(), "UNKNOWN").when(lr < 0.6, "FROZEN").when(lr < 0.9, "DRY").when(lr < 1.1, "EVEN").when(lr < 1.5, "FULL").otherwise("FLOOD")
    tag = F.when((pct > 3) & (lr < 0.9), "RISE_ON_LOW_VOLUME").when((pct < -3) & (lr > 1.3), "FALL_ON_HIGH_VOLUME").when((pct > 3) & (lr > 1.3), "RISE_ON_HIGH_VOLUME")
    return moved.withColumn("volume_tier", tier).withColumn("divergence", tag.when((pct > -1) & (pct < 1) & (lr > 1.5), "STALL_ON_HIGH_VOLUME"))


def trend_stock(moved: DataFrame) -> DataFrame:
    """Flag: the last three closes above today's ma5, two of three days with a higher high, lr above 1.2; needs 20 rows."""
    above = sum((F.lag("final", i).over(_by()) > F.col("ma5")).cast("int") for i in range(3))
    higher = sum((F.lag("high", i).over(_by()) > F.lag("high", i + 1).over(_by())).cast("int") for i in range(3))
    return moved.withColumn("is_trend", F.coalesce((above == 3) & (higher >= 2) & (F.col("lr") > 1.2), F.lit(False)))


def index_weather(index: DataFrame) -> DataFrame:
    """trend_score (-5..5, 0 below 60 rows) and weather of an index (trade_date, close); one row a day, so one window."""
    w = Window.orderBy("trade_date")
    mean = lambda n: rnd(_full(F.avg("close"), n, w), 6)
    x = index.select("trade_date", "close", mean(5).alias("m5"), mean(20).alias("m20"), mean(60).alias("m60"), rnd((F.col("close") / F.lag("close", 19).over(w) - 1) * 100).alias("momo"))
    one = lambda c: F.when(c, 1).otherwise(0)
    momo = F.when(F.col("momo") > 3, 2).when(F.col("momo") > 0, 1).when(F.col("momo") < -5, -2).when(F.col("momo") < -2, -1).otherwise(0)
    score = one(F.col("m5") > F.col("m20")) + one(F.col("m20") > F.col("m60")) + one(F.col("close") > F.col("m20")) + momo
    x = x.select("trade_date", F.when(F.col("m60").isNull(), 0).otherwise(score).cast("int").alias("trend_score"))
    s = F.col("trend_score")
    return x.withColumn("weather", F.when(s >= 2, "SUNNY").when(s <= -3, "STORM").when(s <= -1, "RAIN").otherwise("CLOUDY"))


def volatility_z(index: DataFrame) -> DataFrame:
    """20-day deviation of percent moves against all earlier ones (ten at least, today's included)."""
    w = Window.orderBy("trade_date")
    r = index.select("trade_date", ((F.col("close") / F.lag("close").over(w) - 1) * 100).alias("r")).filter("r is not null")
    v = r.withColumn("vol20", _full(F.stddev_pop("r"), 20, w))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    m, s, n = F.avg("vol20").over(before), F.stddev_pop("vol20").over(before), F.count("vol20").over(before)
    return v.select("trade_date", rnd("vol20", 6).alias("vol20"), rnd(F.when((n >= 9) & (s > 0), (F.col("vol20") - m) / s), 4).alias("vol_z"))


def turnover_z(bars: DataFrame) -> DataFrame:
    """The market's amount of a day against up to 59 days before (20 positive values at least)."""
    d = bars.groupBy("trade_date").agg(F.sum("amount").alias("amount"))
    before = Window.orderBy("trade_date").rowsBetween(-59, -1)
    known = F.when(F.col("amount") > 0, F.col("amount"))
    m, s, n = F.avg(known).over(before), F.stddev_pop(known).over(before), F.count(known).over(before)
    return d.select("trade_date", rnd("amount", 2).alias("amount"), rnd(F.when((n >= 19) & (s > 0), (F.col("amount") - m) / s), 4).alias("turnover_z"))


def ma20_breaks(moved: DataFrame) -> DataFrame:
    """Rows that close below ma20 on a volume ratio above 1.2."""
    return moved.filter((F.col("final") < F.col("ma20")) & (F.col("lr") > 1.2))


def sector_catalysts(rows: DataFrame, sector: str, rise: float = 5.0, names: int = 2) -> DataFrame:
    """(trade_date, sector, risers) where at least ``names`` symbols of a sector rose by more than ``rise`` percent that day; no sector counts as "?"."""
    risers = rows.filter(F.col("pct") > rise).withColumn(sector, F.coalesce(sector, F.lit("?")))
    return risers.groupBy("trade_date", sector).agg(F.count_distinct("symbol").alias("risers")).filter(F.col("risers") >= names)
