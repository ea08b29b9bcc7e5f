"""As-of reads of bitemporal bars and the window factors over them.

A decision at 16:00+08:00 of a trading day sees, for every earlier or equal day, the highest revision available by then. On
most symbols every revision of a day is available by the symbol's next decision; there the history at a decision is the
settled closes of the days before and the first look at the day itself, which plain windows give. Symbols with later
revisions take the same windows where all news of the days that count came before the decision, and gathered revisions for
the other decisions only; both give the same history, and the factors of the latter are written on arrays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fixtures import rnd
from ..sources.scratch import stored

LOOKBACK = 20


def asof_bars(decisions: DataFrame, bars: DataFrame) -> DataFrame:
    """For each decision (symbol, decision_time): every bar of an event up to its day that was available, latest revision of each event."""
    d = decisions.select("symbol", "decision_time")
    j = d.join(bars, "symbol").filter((F.to_date("event_time") <= F.to_date("decision_time")) & (F.col("available_time") <= F.col("decision_time")))
    cols = [c for c in bars.columns if c != "symbol"]
    g = j.groupBy("symbol", "decision_time", F.col("event_time").alias("e")).agg(F.max_by(F.struct(*cols), "revision").alias("b"))
    return g.select("symbol", "decision_time", "b.*")


def asof_recent(decisions: DataFrame, bars: DataFrame, days: int = 60) -> DataFrame:
    """As ``asof_bars``, but only events of the last ``days`` calendar days up to the decision's, for many decisions a symbol.

    Events (their revisions as a short array) and decisions are swept together in the order of their days, with a frame of that many days: one
    shuffle by symbol, and work that grows with decisions x days asked for, not with decisions x history."""
    rest = [c for c in bars.columns if c not in ("symbol", "revision", "available_time")]
    number = lambda c: F.datediff(F.to_date(c), F.lit("1970-01-01"))
    revs = F.sort_array(F.collect_list(F.struct("revision", "available_time", F.struct(*rest).alias("rest")))).alias("revs")
    events = bars.filter("available_time is not null").groupBy("symbol", "event_time").agg(revs).select("symbol", number("event_time").alias("day"), "revs")
    asks = decisions.select("symbol", number("decision_time").alias("day"), F.lit(None).cast(events.schema["revs"].dataType).alias("revs"), "decision_time")
    w = Window.partitionBy("symbol").orderBy("day").rangeBetween(-days + 1, 0)
    x = events.withColumn("decision_time", F.lit(None).cast(decisions.schema["decision_time"].dataType)).unionByName(asks).withColumn("near", F.collect_list("revs").over(w)).filter("decision_time is not null")
    at = F.col("decision_time")

    def newest(revs: Column) -> Column:
        seen = F.filter(revs, lambda r: r["available_time"] <= at)
        return F.get(seen, F.size(seen) - 1)

    found = x.select("symbol", "decision_time", F.explode(F.transform("near", newest)).alias("b")).filter("b is not null")
    return found.select("symbol", "decision_time", "b.revision", "b.available_time", "b.rest.*")


def _days(bars: DataFrame) -> DataFrame:
    """One row for each symbol and day: looks (what its own decision sees), settled (highest revision), whether that is in time for the next decision."""
    decision = F.col("trade_date").cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(8))
    seen = F.col("available_time") <= decision
    row = F.struct("close", "high", "low", "volume", "amount")
    d = bars.groupBy("symbol", "trade_date").agg(F.max_by(F.when(seen, row), F.when(seen, F.col("revision"))).alias("look"), F.max_by(row, "revision").alias("final"), F.max("available_time").alias("last_news"))
    w = Window.partitionBy("symbol").orderBy("trade_date")
    d = d.withColumn("decision_time", decision).withColumn("next_decision", F.lead("decision_time").over(w))
    late = F.col("look").isNull() | (F.col("last_news") > F.coalesce("next_decision", "last_news"))
    return d.withColumn("late_symbol", F.max(late).over(Window.partitionBy("symbol")))


def _late_symbols(bars: DataFrame) -> DataFrame:
    """The symbols that ``_days`` marks, from stamps alone."""
    decision = F.col("trade_date").cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(8))
    looked = F.coalesce(F.max((F.col("available_time") <= decision) & F.col("revision").isNotNull()), F.lit(False))
    d = bars.groupBy("symbol", "trade_date").agg(looked.alias("looked"), F.max("available_time").alias("last_news")).withColumn("next_decision", F.lead(decision).over(Window.partitionBy("symbol").orderBy("trade_date")))
    return d.filter(~F.col("looked") | (F.col("last_news") > F.coalesce("next_decision", "last_news"))).select("symbol").distinct()


def _late_days(bars: DataFrame, late: DataFrame | None, lookback: int) -> DataFrame:
    """One row for each day of the symbols of ``late`` (all by default) with a price above 0: dt, revs (lowest revision first), look, final, and whether
    news of the ``lookback`` days before it came after its decision."""
    rev = F.struct("revision", "available_time", "close", "high", "low", "volume")
    d = (bars if late is None else bars.join(F.broadcast(late), "symbol", "left_semi")).filter("close > 0").groupBy("symbol", "trade_date").agg(F.sort_array(F.collect_list(rev)).alias("revs"), F.max("available_time").alias("last_news"))
    d = d.withColumn("dt", F.col("trade_date").cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(8)))
    seen = F.filter("revs", lambda r: r["available_time"] <= F.col("dt"))
    w = Window.partitionBy("symbol").orderBy("trade_date")
    stamped = F.exists("revs", lambda r: r["available_time"].isNull())
    news = F.coalesce(F.max("last_news").over(w.rowsBetween(-lookback, -1)) > F.col("dt"), F.lit(False)) | F.coalesce(F.max(stamped).over(w.rowsBetween(-lookback, -1)), F.lit(False))
    return d.select("symbol", "trade_date", "dt", "revs", F.get(seen, F.size(seen) - 1).alias("look"), F.element_at("revs", -1).alias("final"), news.alias("news"))


def histories(bars: DataFrame, lookback: int = LOOKBACK, late: DataFrame | None = None, slack: int = LOOKBACK) -> DataFrame:
    """symbol, trade_date, close, and h: the last lookback + 1 usable days at the decision, oldest first (close, high, low, volume), own day last.

    For the symbols of ``late`` (all by default). The revisions of a day are a short array; those of the last lookback + ``slack`` own days
    meet at each decision, and what was available then is picked there. So up to ``slack`` unusable days among them are made up for."""
    return _gathered(_late_days(bars, late, lookback).withColumn("asks", F.col("look").isNotNull()), lookback, slack)


def _gathered(days: DataFrame, lookback: int, slack: int) -> DataFrame:
    """``histories`` of the decisions that ask: each day sends what they see of it to those among the days after it, within the shuffle by symbol."""
    w = Window.partitionBy("symbol").orderBy("trade_date").rowsBetween(0, lookback + slack)
    fields = ("close", "high", "low", "volume")
    x = days.withColumn("to", F.collect_list(F.when(F.col("asks"), F.struct("trade_date", "dt"))).over(w)).withColumn("to", F.explode("to"))
    seen = F.filter("revs", lambda r: r["available_time"] <= F.col("to.dt"))
    x = x.select("symbol", F.col("trade_date").alias("day"), F.col("to.trade_date").alias("trade_date"), F.get(seen, F.size(seen) - 1).alias("r"))
    x = x.groupBy("symbol", "trade_date").agg(F.sort_array(F.collect_list(F.when(F.col("r").isNotNull(), F.struct("day", *[F.col("r")[c].alias(c) for c in fields])))).alias("h"))
    tail = F.slice("h", F.greatest(F.size("h") - lookback, F.lit(1)), F.lit(lookback + 1))
    return x.select("symbol", "trade_date", F.element_at("h", -1)["close"].alias("close"), F.transform(tail, lambda x: F.struct(*[x[c].alias(c) for c in fields])).alias("h"))


def _windowed(plain: DataFrame, n: int) -> tuple[DataFrame, dict[str, Column]]:
    """The same factors for days whose history is settled, by window sums: ``plain`` with helper columns, and a Column for each factor."""
    w = Window.partitionBy("symbol").orderBy("trade_date")
    kept = [c for c in ("ahead", "news") if c in plain.columns]
    past, prior = w.rowsBetween(-n + 1, -1), w.rowsBetween(-n, -1)
    x = plain.select(
        "symbol", "trade_date", F.col("look.close").alias("close"), F.col("final.close").alias("final"), F.col("look.high").alias("high"), F.col("look.low").alias("low"),
        F.col("look.volume").alias("volume"), F.col("final.volume").alias("fv"), ((F.col("final.high") - F.col("final.low")) / F.col("final.close")).alias("fr"), *kept,
    )
    x = x.withColumn("prev", F.lag("final").over(w)).withColumn("r", F.ln(F.col("final") / F.col("prev"))).withColumn("r0", F.ln(F.col("close") / F.col("prev")))
    x = x.select(
        "*", F.row_number().over(w).alias("rn"), F.lag("final", n).over(w).alias("back"), F.sum("final").over(past).alias("s"), F.max("final").over(past).alias("hi"),
        F.min("final").over(past).alias("lo"), F.sum("r").over(past).alias("r1"), F.sum(F.col("r") * F.col("r")).over(past).alias("r2"), F.avg("fv").over(prior).alias("mv"), F.avg("fr").over(prior).alias("mr"),
    )
    mean = (F.col("r1") + F.col("r0")) / n
    spread = F.col("high") - F.col("low")
    return x, {
        "momentum": F.col("close") / F.col("back") - 1,
        "volatility": F.sqrt(F.greatest((F.col("r2") + F.col("r0") * F.col("r0")) / n - mean * mean, F.lit(0.0))) * F.sqrt(F.lit(252.0)),
        "trend": F.col("close") / ((F.col("s") + F.col("close")) / n) - 1,
        "volume_ratio": F.when(F.col("mv") > 0, F.col("volume") / F.col("mv") - 1),
        "close_to_high": F.col("close") / F.greatest("hi", "close") - 1,
        "close_to_low": F.col("close") / F.least("lo", "close") - 1,
        "range_ratio": F.when(F.col("mr") > 0, spread / F.col("close") / F.col("mr") - 1),
        "close_location": F.when(spread > 0, 2 * (F.col("close") - F.col("low")) / spread - 1),
    }


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def _tail(c: str, n: int, skip: int = 0) -> Column:
    xs = F.transform(F.col("h"), lambda x: x[c])
    return F.slice(xs, F.greatest(F.size("h") - n - skip + 1, F.lit(1)), F.lit(n))


def _last(c: str) -> Column:
    return F.element_at("h", -1)[c]


def momentum(n: int = LOOKBACK) -> Column:
    return _last("close") / F.element_at("h", -1 - n)["close"] - 1


def volatility(n: int = LOOKBACK) -> Column:
    logs = F.transform(_tail("close", n + 1), F.ln)
    r = F.zip_with(F.slice(logs, F.lit(2), F.lit(n)), F.slice(logs, F.lit(1), F.lit(n)), lambda a, b: a - b)
    mean = _sum(r) / n
    return F.sqrt(F.aggregate(r, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n) * F.sqrt(F.lit(252.0))


def trend(n: int = LOOKBACK) -> Column:
    return _last("close") / (_sum(_tail("close", n)) / n) - 1


def volume_ratio(n: int = LOOKBACK) -> Column:
    mean = _sum(_tail("volume", n, 1)) / n
    return F.when(mean > 0, _last("volume") / mean - 1)


def close_to_high(n: int = LOOKBACK) -> Column:
    return _last("close") / F.array_max(_tail("close", n)) - 1


def close_to_low(n: int = LOOKBACK) -> Column:
    return _last("close") / F.array_min(_tail("close", n)) - 1


def range_ratio(n: int = LOOKBACK) -> Column:
    r = F.transform(F.col("h"), lambda x: (x["high"] - x["low"]) / x["close"])
    mean = _sum(F.slice(r, F.greatest(F.size("h") - n, F.lit(1)), F.lit(n))) / n
    return F.when(mean > 0, F.element_at(r, -1) / mean - 1)


def close_location(n: int = LOOKBACK) -> Column:
    spread = _last("high") - _last("low")
    return F.when(spread > 0, 2 * (_last("close") - _last("low")) / spread - 1)


#: Factor name -> builder of a Column over h.
REGISTRY: dict[str, Callable[[int], Column]] = {f.__name__: f for f in (momentum, volatility, trend, volume_ratio, close_to_high, close_to_low, range_ratio, close_location)}


def compute_factors(bars: DataFrame, names: list[str], lookback: int = LOOKBACK, horizon: int | None = None) -> DataFrame:
    """symbol, trade_date, close and a column for each named factor; null where the history is too short.

    With a ``horizon`` also ahead: the settled close of so many days later, as ``next_returns`` gives it, from the windows that run anyway."""
    if unknown := sorted(set(names) - set(REGISTRY)):
        raise ValueError(f"unknown factors: {unknown}")
    if lookback < 2:
        raise ValueError("lookback must be 2 or more")
    digits = lambda n: 6 if n == "volatility" else 9
    d, kept = _days(bars), []
    if horizon:
        d, kept = d.withColumn("ahead", F.lead("final.close", horizon).over(Window.partitionBy("symbol").orderBy("trade_date"))), ["ahead"]
    plain, columns = _windowed(d.filter("not late_symbol and final.close > 0 and look.close > 0"), lookback)
    clean = plain.select("symbol", "trade_date", "close", *[F.when(F.col("rn") > lookback, rnd(columns[n], digits(n))).alias(n) for n in names], *kept)
    late = _late_symbols(bars)
    days = stored(_late_days(bars, late, lookback), "late-days")
    quiet, more = _windowed(days, lookback)
    settled = quiet.filter("close is not null and (not news or rn <= {n})".format(n=lookback)).select("symbol", "trade_date", "close", *[F.when(F.col("rn") > lookback, rnd(more[n], digits(n))).alias(n) for n in names])
    h = _gathered(days.withColumn("asks", F.col("look").isNotNull() & F.col("news") & (F.row_number().over(Window.partitionBy("symbol").orderBy("trade_date")) > lookback)), lookback, LOOKBACK)
    slow = settled.unionByName(h.select("symbol", "trade_date", "close", *[F.when(F.size("h") > lookback, rnd(REGISTRY[n](lookback), digits(n))).alias(n) for n in names]))
    if horizon:
        slow = slow.join(next_returns(bars.join(F.broadcast(late), "symbol", "left_semi"), horizon).drop("final"), ["symbol", "trade_date"])
    return clean.unionByName(slow)


def next_returns(bars: DataFrame, horizon: int = 1) -> DataFrame:
    """symbol, trade_date, final: the settled close, and ahead: that of ``horizon`` days later. Labels are not gated by availability."""
    f = bars.groupBy("symbol", "trade_date").agg(F.max_by("close", "revision").alias("final"))
    return f.withColumn("ahead", F.lead("final", horizon).over(Window.partitionBy("symbol").orderBy("trade_date")))


def design_rows(bars: DataFrame, lookback: int = LOOKBACK, horizon: int = 1, more: tuple[str, ...] = ()) -> DataFrame:
    """The model's rows: four factors, next_return, label and the factors named by ``more``; rows with one of the four missing and each symbol's last days are dropped."""
    names = ["momentum", "volatility", "trend", "volume_ratio"]
    rows = compute_factors(bars, [*names, *more], lookback, horizon).na.drop(subset=names).filter("ahead is not null and close > 0")
    rows = rows.withColumn("next_return", rnd(F.col("ahead") / F.col("close") - 1, 9))
    return rows.select("symbol", "trade_date", "close", *names, "next_return", (F.col("next_return") > 0).cast("int").alias("label"), *more)


def fundamental(df: DataFrame) -> DataFrame:
    """quality and valuation of rows with ratios and percentiles; a column that is missing altogether counts as null."""
    c = lambda n: F.col(n).cast("double") if n in df.columns else F.lit(None).cast("double")
    quality = 0.3 * c("roe") + 0.3 * c("roic") + 0.2 * c("ocf_to_profit") - 0.2 * c("debt_ratio")
    return df.withColumn("quality", quality).withColumn("valuation", -(c("pe_percentile") + c("pb_percentile")) / 2)
