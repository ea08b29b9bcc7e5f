"""Rule scores over daily rows (symbol, trade_date, open, high, low, final, volume as each decision saw them) and minute bars.

The thresholds, weights and tiers below are fixed values of the rules. Missing inputs give null or the name the rule has for
missing data. Every rule is a column over the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fixtures import rnd
from .signals import _by, _full


def one(c: Column, points: int = 1) -> Column:
    return F.when(c, points).otherwise(0)


def vwap_verdict(last: Column, vwap: Column) -> Column:
    return F.when(last > vwap * 1.01, "ABOVE_STRONG").when(last > vwap, "ABOVE").when(last < vwap * 0.99, "BELOW_WEAK").when(last < vwap, "BELOW").otherwise("AT")


def breakdown(rows: DataFrame) -> DataFrame:
    """Pullback or breakdown over the last five rows: drawdown, volume ratio, down days, the turn of ma5, a limit fall."""
    w5 = _by().rowsBetween(-4, 0)
    x = rows.withColumn("__n", F.count(F.lit(1)).over(w5)).withColumn("__prev", F.lag("final").over(_by()))
    high = F.max("high").over(w5)
    before = F.avg("volume").over(_by().rowsBetween(-4, -1))
    fall = F.coalesce(F.col("final") / F.col("__prev") - 1 < -0.095, F.lit(False)) | (F.col("final") / F.col("open") - 1 < -0.095)
    x = x.select(
        "symbol", "trade_date", "__n", rnd((F.col("final") - high) / high * 100, 6).alias("drawdown"), rnd(F.when(before > 0, F.col("volume") / before).otherwise(1.0), 6).alias("vol_ratio"),
        F.count_if(F.col("final") < F.col("open")).over(w5).alias("down_days"), (F.avg("final").over(w5) < F.avg("final").over(_by().rowsBetween(-4, -3))).alias("turned"), (F.max(fall.cast("int")).over(w5) == 1).alias("limit_down"),
    ).filter("__n = 5")
    d, v = F.col("drawdown"), F.col("vol_ratio")
    score = one(d < -5) + one(d < -10, 2) + F.when(v > 1.2, 1).when(v < 0.8, -1).otherwise(0) + one(F.col("down_days") >= 3) + one(F.col("turned")) + one(F.col("limit_down"), 5)
    x = x.withColumn("score", score)
    return x.withColumn("class", F.when((F.col("score") >= 4) | F.col("limit_down"), "BREAKDOWN").when(F.col("score") <= 1, "PULLBACK").otherwise("NEUTRAL")).drop("__n")


def recovery(rows: DataFrame) -> DataFrame:
    """Distance from the low of 20 rows in percent, and its health score."""
    low = _full(F.min("low"), 20)
    x = rows.select("symbol", "trade_date", "final", low.alias("low20")).withColumn("recovery_pct", rnd((F.col("final") - F.col("low20")) / F.col("low20") * 100, 2))
    r = F.col("recovery_pct")
    return x.withColumn("health", F.when(r.isNull(), None).when(r < 5, 0).when(r < 20, 1).otherwise(2)).withColumn("verdict", F.when(r.isNull(), "NO_DATA").when(r < 0, "NEW_LOW").when(r < 5, "NOT_RECOVERED").when(r < 20, "RECOVERING").otherwise("RECOVERED"))


def volume_price_signal(ratio: Column, pct: Column, up_share: Column) -> tuple[Column, Column, Column]:
    """(signal, minute signal, action) of a day's volume ratio and move, then of the share of volume in rising minute bars."""
    move = F.abs(pct)
    signal = F.when(ratio.isNull() | pct.isNull(), "UNKNOWN").when((ratio > 2) & (move > 5), "PANIC").when((ratio < 1.2) & (move < 4), "NORMAL").otherwise("MIXED")
    minute = F.when(up_share > 0.6, "BOUNCE").when(up_share < 0.4, "SELLING").otherwise("NEUTRAL")
    action = (
        F.when(signal == "UNKNOWN", "NONE").when((signal == "PANIC") & (minute == "BOUNCE"), "REDUCE_ON_BOUNCE").when(signal == "PANIC", "CLEAR").when(minute == "BOUNCE", "HOLD")
        .when(minute == "SELLING", "HALVE").when(signal == "NORMAL", "WATCH").otherwise("NEED_MINUTES")
    )
    return signal, minute, action


def flow_inference(pct: Column, lr: Column) -> Column:
    return (
        F.when(pct.isNull(), "NO_DATA").when((pct > 5) & (lr > 1.3), "INFLOW").when((pct > 2) & (lr > 1.1), "LEANING_IN").when((pct < -5) & (lr > 1.3), "OUTFLOW")
        .when((pct < -2) & (lr > 1.1), "LEANING_OUT").when((F.abs(pct) < 1) & (lr < 0.8), "WAITING").otherwise("NEUTRAL")
    )


def accumulation(buy: Column, sell: Column, minute_up: Column, day_up: Column, activity: Column, near_high: Column) -> tuple[Column, Column]:
    """(score, verdict), -5 to 5: trade sides, minute volume, volume of rising days, activity, and busy trade near the top of the range."""
    sides = F.when(buy > 0.6, 2).when(buy > 0.52, 1).when(sell > 0.6, -2).when(sell > 0.52, -1).otherwise(0)
    share = lambda c: F.when(c > 0.6, 1).when(c < 0.4, -1).otherwise(0)
    busy = F.coalesce(activity > 1.5, F.lit(False))
    score = F.greatest(F.lit(-5), F.least(F.lit(5), sides + share(minute_up) + share(day_up) + one(busy & ~near_high) - one(busy & near_high)))
    verdict = F.when(score >= 3, "ACCUMULATION_STRONG").when(score >= 1, "ACCUMULATION").when(score <= -3, "DISTRIBUTION_STRONG").when(score <= -1, "DISTRIBUTION").otherwise("TURNOVER")
    return score, verdict


def relative_tier(excess: Column, names: tuple[str, str, str, str]) -> Column:
    """The name of an excess move in percent: above 2, above 0, below -2, else."""
    return F.when(excess > 2, names[0]).when(excess > 0, names[1]).when(excess < -2, names[2]).when(excess.isNotNull(), names[3])


def bands(rows: DataFrame) -> DataFrame:
    """Bollinger bands (20 rows, population deviation), the range of 60 rows, its Fibonacci levels and round numbers around the price."""
    mean, sd = _full(F.avg("final"), 20), _full(F.stddev_pop("final"), 20)
    x = rows.select("symbol", "trade_date", "final", rnd(mean + 2 * sd, 2).alias("boll_up"), rnd(mean - 2 * sd, 2).alias("boll_low"), _full(F.max("high"), 60).alias("high60"), _full(F.min("low"), 60).alias("low60"))
    span = F.col("high60") - F.col("low60")
    x = x.withColumn("fib", F.when(span > 0, F.array(*[rnd(F.col("high60") - span * r, 2) for r in (0.236, 0.382, 0.5, 0.618, 0.786)])))
    size = F.greatest(F.lit(10), F.pow(F.lit(10), F.length(F.floor("final").cast("string")) - 1).cast("int"))
    base = F.floor(F.floor("final") / size) * size
    return x.withColumn("round_numbers", F.filter(F.transform(F.array(*map(F.lit, (-2, -1, 0, 1, 2))), lambda k: (base + k * size).cast("long")), lambda v: (v > 0) & (v != F.floor("final"))))


def levels(rows: DataFrame, candidates: list[str], price: str = "final", nearest: int = 8) -> DataFrame:
    """support and resistance: the candidates below and above the price, one of those within 0.1 of each other, the nearest first."""
    every = F.array_distinct(F.array_compact(F.array(*[F.floor(F.col(c) * 10 + 0.5) / 10 for c in candidates])))
    below, above = F.filter(every, lambda v: v < F.col(price)), F.filter(every, lambda v: v > F.col(price))
    return rows.withColumn("support", F.slice(F.sort_array(below, False), 1, nearest)).withColumn("resistance", F.slice(F.sort_array(above), 1, nearest))


def trade_plan(rows: DataFrame, stop: Column, price: str = "final") -> DataFrame:
    """Pullback entry at the nearest support and breakout entry at the nearest resistance, with stop, target and reward for risk; blocked below 1.5."""
    s, r = F.get("support", F.lit(0)), F.get("resistance", F.lit(0))
    target = F.coalesce(F.get("resistance", F.lit(1)), r * 1.05)
    x = rows.withColumn("pullback_entry", s).withColumn("breakout_entry", rnd(r * 1.005, 4)).withColumn("stop", rnd(F.least(stop, F.coalesce(s * 0.98, stop)), 4)).withColumn("target", rnd(target, 4))
    risk, reward = F.col(price) - F.col("stop"), F.col("target") - F.col(price)
    x = x.withColumn("reward_risk", rnd(F.when(risk > 0, reward / risk), 4))
    return x.withColumn("blocked", F.coalesce(F.col("reward_risk") < 1.5, F.lit(True)))


def advice(points: Column, distribution: Column) -> tuple[Column, Column]:
    """(score, action): 5 and the points, within 1 and 10; where distribution is seen nothing above HOLD."""
    score = F.greatest(F.lit(1), F.least(F.lit(10), 5 + points))
    action = F.when(score >= 8, "BUY").when(score >= 6, "HOLD_ADD").when(score >= 4, "HOLD").when(score >= 2, "REDUCE").otherwise("CLEAR")
    return score, F.when(distribution & action.isin("BUY", "HOLD_ADD"), "HOLD").otherwise(action)


REVERSAL = {"extreme_sentiment": 2, "low_open_shrink": 2, "decline_narrowing": 2, "weights_stable": 2, "etf_surge": 1, "northbound": 1, "bottom_divergence": 2, "vwap_break": 1}


def reversal(shock: Column) -> tuple[Column, Column]:
    """(score, level) of the eight weighted flags; the threshold is 7, or 10 under a shock of 2 or more. A missing flag counts 0."""
    score = sum((one(F.coalesce(F.col(k), F.lit(False)), v) for k, v in REVERSAL.items()), F.lit(0))
    need = F.when(shock >= 2, 10).otherwise(7)
    return score, F.when(score >= need, "HIGH").when(score >= need - 2, "MEDIUM").otherwise("LOW")


def sell_rule(price: Column, stop: Column, invalid: Column, market: Column) -> Column:
    """must_sell at or below the stop; else the first reason that allows a sale; NO_CARD where no stop was set."""
    return F.when(price.isNull(), "NO_PRICE").when(price <= stop, "MUST_SELL").when(invalid, "LOGIC_BROKEN").when(market, "MARKET_RISK").when(stop.isNull(), "NO_CARD").otherwise("PLAIN")


def stress(usdjpy: Column, usdcny: Column, y30: Column, gold: Column, nikkei: Column) -> tuple[list[Column], Column]:
    """Four sub-scores of at most 3, and the radar level 0 to 3 of their sum; a missing input counts 0."""
    f = lambda c: F.coalesce(c, F.lit(False))
    fx_ = F.when(f(F.abs(usdjpy) > 1.5), 2).when(f(F.abs(usdjpy) > 0.8), 1).otherwise(0) + one(f(usdcny > 0.3))
    usd = F.when(f(y30 > 5), 2).when(f(y30 > 4.7), 1).otherwise(0)
    cross = one(f(gold > 1)) + one(f(nikkei < -2))
    pattern = one(f((usdjpy < -1.5) & (nikkei < -2)), 2)
    parts = [F.least(F.lit(3), c) for c in (fx_, usd, cross, pattern)]
    total = parts[0] + parts[1] + parts[2] + parts[3]
    return parts, F.when(total >= 6, 3).when(total >= 4, 2).when(total >= 2, 1).otherwise(0)


def shock_adjust(external: Column, hs: Column, cyb: Column) -> Column:
    up, down = F.coalesce((hs > 1.5) & (cyb > 1.5), F.lit(False)), F.coalesce(hs < -1.5, F.lit(False))
    return F.greatest(F.lit(0), F.least(F.lit(3), F.when(up, external - 1).when(down, external + 1).otherwise(external)))


def lexicon_score(text: Column, good: list[str], bad: list[str]) -> Column:
    """-2 to 2: one for any hit of a side, and up to two more for each of its words, good minus bad."""
    count = lambda w: F.least(F.lit(2), (F.length(text) - F.length(F.replace(text, F.lit(w), F.lit("")))) / len(w)).cast("int")
    side = lambda words: one(F.greatest(*[text.contains(w) for w in words], F.lit(False))) + sum((count(w) for w in words), F.lit(0))
    return F.greatest(F.lit(-2), F.least(F.lit(2), side(good) - side(bad)))


def sentiment(posts: DataFrame, key: str, text: str, order: str, good: list[str], bad: list[str]) -> DataFrame:
    """-100 to 100 and its label for each key, over posts whose first 50 characters are new there."""
    head = F.substring(text, 1, 50)
    w = Window.partitionBy(key, head).orderBy(order)
    p = posts.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").withColumn("__s", lexicon_score(F.coalesce(F.col(text), F.lit("")), good, bad))
    raw = F.sum("__s") * 100 / F.count("*")
    score = F.greatest(F.lit(-100), F.least(F.lit(100), F.when(raw < 0, F.ceil(raw)).otherwise(F.floor(raw))))
    g = p.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col("__s") > 0).alias("pos"), F.count_if(F.col("__s") < 0).alias("neg"), score.cast("long").alias("score"))
    s = F.col("score")
    return g.withColumn("label", F.when(s >= 40, "OVERHEATED").when(s >= 15, "WARM").when(s > -15, "NEUTRAL").when(s > -40, "COOL").otherwise("FREEZING"))


def calendar_risk(days: DataFrame, day: str = "day", ahead: int = 14) -> DataFrame:
    """For each day: days to the next third Friday, to the next of the three holidays, month end, and the level of risk."""
    d = F.col(day)
    friday = lambda m: F.date_add(F.next_day(F.date_sub(F.trunc(m, "month"), 1), "Friday"), 14)
    third = F.datediff(F.when(friday(d) >= d, friday(d)).otherwise(friday(F.add_months(d, 1))), d)
    until = lambda m, k: F.datediff(F.when(F.make_date(F.year(d), F.lit(m), F.lit(k)) >= d, F.make_date(F.year(d), F.lit(m), F.lit(k))).otherwise(F.make_date(F.year(d) + 1, F.lit(m), F.lit(k))), d)
    holiday = F.least(until(10, 1), until(2, 10), until(1, 1))
    x = days.withColumn("to_third_friday", third).withColumn("to_holiday", holiday).withColumn("month_end", F.dayofmonth(d) >= 26)
    medium = one(F.col("to_third_friday") <= ahead) + one(F.col("to_holiday") <= ahead)
    following = F.date_add(d, F.when(F.weekday(d) == 4, 3).when(F.weekday(d) == 5, 2).otherwise(1))
    return x.withColumn("level", F.when(medium >= 2, "MEDIUM").when((medium == 0) & ~F.col("month_end"), "LOW").otherwise("MEDIUM_LOW")).withColumn("next_weekday", following)


def macro_layers(events: DataFrame, keywords: dict[str, int]) -> list[Column]:
    """Layer scores of one row of macro inputs: meeting ahead, yields, keyword counts, regional falls, research weight."""
    f = lambda c: F.coalesce(c, F.lit(False))
    days = F.col("meeting_in")
    meeting = F.when(f(days.between(0, 3)), 2).when(f(days.between(4, 14)), 1).otherwise(0)
    rate = F.least(F.lit(3), F.when(f(F.col("y30") > 5), 2).when(f(F.col("y30") > 4.7), 1).otherwise(0) + one(f(F.col("y10") > 4.5)))
    text = F.lower(F.coalesce("notes", F.lit("")))
    hits = sum((F.lit(w) * F.least(F.lit(3), ((F.length(text) - F.length(F.replace(text, F.lit(k), F.lit("")))) / len(k)).cast("int")) for k, w in keywords.items()), F.lit(0))
    clamp = lambda c, most: F.greatest(F.lit(0), F.least(F.lit(most), c))
    region = F.least(F.lit(2), sum((one(f(F.col(c) < -2)) for c in ("asia_a", "asia_b", "asia_c")), F.lit(0)))
    return [meeting.alias("meeting"), rate.alias("rates"), clamp(hits, 3).alias("keywords"), region.alias("region"), clamp(F.coalesce("research", F.lit(0)), 2).alias("research_score")]
