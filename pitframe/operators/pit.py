"""Point-in-time context: returns as a decision saw them, index and industry context, membership lookups.

A decision at 16:00+08:00 of day t sees of every own trading day the highest revision available by then. The revisions of a
day travel as a short array, the last days before a decision as a window of such arrays, so that what a decision saw is one
shuffle by symbol and JVM-side array functions: nothing is joined by range and no history is collected whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..fixtures import rnd
from ..sources.scratch import stored

def _decision(day: Column) -> Column:
    return day.cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(8))


def day_revisions(bars: DataFrame) -> DataFrame:
    """symbol, trade_date and revs: (revision, available_time, close) of the day, lowest revision first."""
    rev = F.struct("revision", "available_time", "close")
    return bars.filter("available_time is not null").groupBy("symbol", "trade_date").agg(F.sort_array(F.collect_list(rev)).alias("revs"))


def visible(revs: Column, at: Column) -> Column:
    """The close of the highest revision available at a time; null if there is none."""
    seen = F.filter(revs, lambda x: x["available_time"] <= at)
    return F.get(seen, F.size(seen) - 1)["close"]


def pit_history(bars: DataFrame, days: int) -> DataFrame:
    """symbol, trade_date, dt and h: (day, close) of the last ``days`` own trading days up to the decision as it saw them, oldest first."""
    w = Window.partitionBy("symbol").orderBy("trade_date").rowsBetween(-days + 1, 0)
    d = day_revisions(bars).withColumn("dt", _decision(F.col("trade_date"))).withColumn("last", F.collect_list(F.struct("trade_date", "revs")).over(w))
    dt = F.col("dt")
    return d.select("symbol", "trade_date", "dt", F.transform("last", lambda x: F.struct(x["trade_date"].alias("day"), visible(x["revs"], dt).alias("close"))).alias("h"))


def pit_returns(bars: DataFrame, days: int) -> DataFrame:
    """symbol, trade_date, dt and r: (day, r) of the last own days whose close and that of the own day before were seen and above 0."""
    h = pit_history(bars, days + 1)
    pairs = F.zip_with(F.slice("h", F.lit(2), F.lit(days)), F.slice("h", F.lit(1), F.greatest(F.size("h") - 1, F.lit(0))), lambda x, p: F.struct(x["day"].alias("day"), F.when((x["close"] > 0) & (p["close"] > 0), x["close"] / p["close"] - 1).alias("r")))
    return h.select("symbol", "trade_date", "dt", F.filter(pairs, lambda x: x["r"].isNotNull()).alias("r"))


def own_returns(bars: DataFrame) -> DataFrame:
    """symbol, trade_date, r: each day's return as that day's decision saw it; days it did not see are left out."""
    last = F.element_at("r", -1)
    x = pit_returns(bars, 1).filter(F.size("r") > 0)
    return x.select("symbol", "trade_date", last["r"].alias("r"))


def _product(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(1.0), lambda a, x: a * (1 + x)) - 1


def newest_seen(days: DataFrame, keep: int) -> DataFrame:
    """symbol, trade_date, dt and h: (day, item) of the newest ``keep`` days that each day's decision had seen, however far back, oldest first.

    ``days`` has symbol, trade_date, dt, arrival (when the day can first be seen), item and maybe asks (whether the day's decision is wanted). Days are put in the order of their arrival; one
    that is newer than all that came before it is a record. A day between the newest ``keep`` records and now came after the oldest of
    them, so the days since then are all that can count: a frame by the number of records. Each day stands in the frames of about ``keep`` decisions.
    """
    if "asks" in days.columns:  # a few decisions ask: only their symbols are looked at, and a day goes to those that may see it
        days = days.withColumn("any", F.max("asks").over(Window.partitionBy("symbol"))).filter("any").drop("any")
    each = F.array(F.lit(0), F.lit(1))
    few = "asks" in days.columns
    both = days.withColumn("asks", F.explode(F.when(F.col("asks"), each).otherwise(F.array(F.lit(0))) if few else each))  # each day as one that came and as one that asks
    came = F.col("asks") == 0
    both = both.select("symbol", F.when(came, F.greatest("arrival", "dt")).otherwise(F.col("dt")).alias("at"), "asks", F.col("trade_date").alias("day"), F.when(came, F.col("item")).alias("item"))
    order = Window.partitionBy("symbol").orderBy("at", "asks", "day")
    before = F.max(F.when(F.col("asks") == 0, F.col("day"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    record = (F.col("asks") == 0) & (before.isNull() | (F.col("day") > before))
    x = both.withColumn("record", record.cast("int")).withColumn("records", F.sum("record").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    by = Window.partitionBy("symbol").orderBy("records")
    if few:
        x = x.withColumn("to", F.collect_list(F.when(F.col("asks") == 1, F.struct(F.col("day"), F.col("at")))).over(by.rangeBetween(0, keep - 1))).filter("asks = 0")
        x = x.select("symbol", "day", "item", F.explode(F.filter("to", lambda t: t["at"] >= F.col("at"))).alias("to")).groupBy("symbol", F.col("to.day").alias("trade_date"), F.col("to.at").alias("dt"))
        x = x.agg(F.sort_array(F.collect_list(F.struct("day", "item"))).alias("h"))
        return x.withColumn("h", F.slice("h", F.greatest(F.size("h") - keep + 1, F.lit(1)), keep))
    x = x.withColumn("h", F.collect_list(F.when(F.col("asks") == 0, F.struct("day", "at", "item"))).over(by.rangeBetween(-(keep - 1), 0))).filter("asks = 1")
    seen = F.sort_array(F.transform(F.filter("h", lambda d: d["at"] <= F.col("at")), lambda d: F.struct(d["day"].alias("day"), d["item"].alias("item"))))
    return x.select("symbol", F.col("day").alias("trade_date"), F.col("at").alias("dt"), F.slice(seen, F.greatest(F.size(seen) - keep + 1, F.lit(1)), keep).alias("h"))


def _first(revs: str) -> Column:
    return F.array_min(F.transform(revs, lambda x: x["available_time"]))


def _newest(revs: str) -> Column:
    return F.array_max(F.transform(revs, lambda x: x["available_time"]))


def _past() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("trade_date").rowsBetween(-20, -1)


def _asking(days: DataFrame) -> DataFrame:
    """``days`` (symbol, trade_date, dt, arrival, news) with before, the number of days before up to 20, and asks: whether news of these came after a decision that sees its own day."""
    late = F.coalesce(F.max("news").over(_past()) > F.col("dt"), F.lit(False)) & (F.col("arrival") <= F.col("dt"))
    x = days.withColumns({"before": F.count("*").over(_past()), "asks": late})
    return x.withColumn("asks", F.col("asks") & (F.col("before") == 20))


def index_context(bars: DataFrame) -> DataFrame:
    """return_5, return_20, close_vs_sma20 and volatility_20 over the last 21 admitted closes; the decision's own day has to be admitted.

    Where all news of the 20 days before came by the decision, these are its days, as they are in the end: a plain window. The others gather what they saw."""
    dt = F.col("dt")
    d = day_revisions(bars).withColumn("dt", _decision(F.col("trade_date")))
    d = _asking(d.withColumns({"arrival": _first("revs"), "news": _newest("revs"), "look": visible(F.col("revs"), dt), "final": F.element_at("revs", -1)["close"]}))
    d = stored(d.withColumn("past", F.collect_list("final").over(_past())), "own-days")
    plain = d.filter("not asks and size(past) = 20 and before = 20 and arrival <= dt").select("symbol", "trade_date", F.concat("past", F.array("look")).alias("c"))
    days = d.select("symbol", "trade_date", "dt", "arrival", F.col("revs").alias("item"), "asks")
    h = newest_seen(days, 21).filter((F.size("h") == 21) & (F.element_at("h", -1)["day"] == F.col("trade_date")))
    x = plain.unionByName(h.select("symbol", "trade_date", F.transform("h", lambda d: visible(d["item"], dt)).alias("c"))).filter(F.forall("c", lambda v: v > 0))
    last = F.element_at("c", -1)
    x = x.withColumn("r", F.zip_with(F.slice("c", 2, 20), F.slice("c", 1, 20), lambda a, b: F.ln(a) - F.ln(b)))
    start = F.struct((F.aggregate("r", F.lit(0.0), lambda a, v: a + v) / 20).alias("mean"), F.lit(0.0).alias("s"))  # the mean once, not once a return
    spread = F.aggregate("r", start, lambda a, v: F.struct(a["mean"].alias("mean"), (a["s"] + (v - a["mean"]) * (v - a["mean"])).alias("s")), lambda a: a["s"])
    return x.select(
        "symbol", "trade_date", rnd(last / F.element_at("c", -6) - 1).alias("return_5"), rnd(last / F.col("c")[0] - 1).alias("return_20"),
        rnd(last / (F.aggregate(F.slice("c", 2, 20), F.lit(0.0), lambda a, v: a + v) / 20) - 1).alias("close_vs_sma20"),
        rnd(F.sqrt(spread / 20) * F.sqrt(F.lit(252.0)), 6).alias("volatility_20"),
    )


def relative_context(bars: DataFrame, index: DataFrame) -> DataFrame:
    """Stock minus index returns of 5 and 20 days over the last common days of which both closes were admitted; both have to be on the decision's day.

    Where all news of the 20 days before came by the decision, these are its days, as they are in the end: plain windows. The others gather what they saw."""
    i = day_revisions(index).select("trade_date", F.col("revs").alias("irevs"))  # one row a day
    d = day_revisions(bars).join(F.broadcast(i), "trade_date").withColumn("dt", _decision(F.col("trade_date")))
    dt, own = F.col("dt"), Window.partitionBy("symbol").orderBy("trade_date")
    ends = {f"{k}_{side}": v for side, r in (("s", "revs"), ("i", "irevs")) for k, v in (("look", visible(F.col(r), dt)), ("final", F.element_at(r, -1)["close"]))}
    d = _asking(d.withColumns(ends | {"arrival": F.greatest(_first("revs"), _first("irevs")), "news": F.greatest(_newest("revs"), _newest("irevs"))}))
    above = lambda k: F.coalesce((F.col(f"{k}_s") > 0) & (F.col(f"{k}_i") > 0), F.lit(False))
    d = d.withColumn("good", F.min(above("final")).over(_past()) & above("look"))
    d = d.withColumns({f"back_{side}_{n}": F.lag(f"final_{side}", n).over(own) for side in "si" for n in (5, 20)})
    d = stored(d, "common-days")
    quiet = d.filter("not asks and before = 20 and arrival <= dt and good")
    gone = lambda side, n: F.col(f"look_{side}") / F.col(f"back_{side}_{n}")
    plain = quiet.select("symbol", "trade_date", *[rnd(gone("s", n) - gone("i", n)).alias(f"relative_{n}") for n in (5, 20)])
    days = d.select("symbol", "trade_date", "dt", "arrival", F.struct("revs", "irevs").alias("item"), "asks")
    h = newest_seen(days, 21).filter((F.size("h") == 21) & (F.element_at("h", -1)["day"] == F.col("trade_date")))
    both = F.transform("h", lambda x: F.struct(visible(x["item"]["revs"], dt).alias("s"), visible(x["item"]["irevs"], dt).alias("i")))
    x = h.select("symbol", "trade_date", both.alias("b")).filter(F.forall("b", lambda v: (v["s"] > 0) & (v["i"] > 0)))
    ahead = lambda side, n: F.element_at("b", -1)[side] / F.element_at("b", -1 - n)[side]
    return plain.unionByName(x.select("symbol", "trade_date", *[rnd(ahead("s", n) - ahead("i", n)).alias(f"relative_{n}") for n in (5, 20)]))


def schedules(members: DataFrame) -> DataFrame:
    """symbol, steps (effective_from, industry_code; oldest first) and known (availability stamps in order): a few entries each."""
    return members.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("effective_from", "industry_code"))).alias("steps"), F.sort_array(F.collect_list("available_time")).alias("known"))


def scheduled_industry(day: Column, at: Column) -> Column:
    """The industry of a schedule row that a decision may use: the earlier of the last effective and the last known step; null if none."""
    effective = F.size(F.filter("steps", lambda s: s["effective_from"] <= day))
    return F.get("steps", F.least(effective, F.size(F.filter("known", lambda k: k <= at))) - 1)["industry_code"]


def historical_industry(day: Column, *, before: bool = False) -> Column:
    """The last step effective on or before a day, or strictly before it."""
    steps = F.filter("steps", (lambda s: s["effective_from"] < day) if before else (lambda s: s["effective_from"] <= day))
    return F.get(steps, F.size(steps) - 1)["industry_code"]


def _seen_on(at: Column) -> Column:
    """The first day whose decision sees what is available at a time."""
    return F.to_date(at + F.make_dt_interval(hours=F.lit(16)) - F.expr("interval 1 microsecond"))


def return_days(bars: DataFrame, plan: DataFrame) -> DataFrame:
    """symbol, day, asks, codes, later_code, same_code, rs, now, final and changed of each own day.

    asks: the industry that the day's decision may use, null if it saw no close. rs: (from, to: days of decisions; r) of the returns that the
    known closes of the day and the own day before gave. now, final: the return on the day itself and in the end. changed: the last day on which it changed."""
    d = day_revisions(bars).withColumn("prev", F.lag("revs").over(Window.partitionBy("symbol").orderBy("trade_date"))).join(plan, "symbol").withColumnRenamed("trade_date", "day")
    dt, day = _decision(F.col("day")), F.col("day")
    stamps = lambda c: F.transform(c, lambda x: x["available_time"])

    def version(at: Column, k: Column) -> Column:
        now, past, end = visible(F.col("revs"), at), visible(F.col("prev"), at), F.get("times", k + 1)
        to = F.when(end.isNotNull(), F.greatest(day, _seen_on(end)))
        return F.struct(F.greatest(day, _seen_on(at)).alias("from"), to.alias("to"), F.when((now > 0) & (past > 0), now / past - 1).alias("r"))

    d = d.withColumn("times", F.array_sort(F.array_union(stamps("revs"), stamps(F.coalesce("prev", F.slice("revs", 1, 0))))))
    rs = F.filter(F.transform("times", version), lambda v: v["r"].isNotNull() & (v["to"].isNull() | (v["from"] < v["to"])))
    # one revision of both days, as nearly everywhere: one return, from the later stamp on
    a, b = F.get("revs", F.lit(0)), F.get("prev", F.lit(0))
    only = F.struct(F.greatest(day, _seen_on(F.greatest(a["available_time"], b["available_time"]))).alias("from"), F.lit(None).cast("date").alias("to"), F.when((a["close"] > 0) & (b["close"] > 0), a["close"] / b["close"] - 1).alias("r"))
    rs = F.when((F.size("revs") == 1) & (F.size("prev") == 1), F.when((a["close"] > 0) & (b["close"] > 0), F.array(only)).otherwise(F.slice(rs, 1, 0))).otherwise(rs)
    d = d.select(
        "symbol", "day", F.when(visible(F.col("revs"), dt).isNotNull(), scheduled_industry(day, dt)).alias("asks"), F.array_distinct(F.transform("steps", lambda s: s["industry_code"])).alias("codes"),
        historical_industry(day).alias("later_code"), historical_industry(day, before=True).alias("same_code"), F.when(F.col("prev").isNotNull(), rs).otherwise(F.slice(rs, 1, 0)).alias("rs"),
    )
    first, last = F.get("rs", F.lit(0)), F.get("rs", F.size("rs") - 1)
    return d.withColumns({"now": F.when(first["from"] == day, first["r"]), "final": F.when(last["to"].isNull(), last["r"]), "changed": F.coalesce(last["to"], last["from"])})


def peer_totals(days: DataFrame) -> DataFrame:
    """For each industry and day: what its members' returns come to, as decisions of later days (members effective on the day) and of the day itself (effective before it) see them.

    later: (on: day of decision; s, n) running totals of returns and members. later_s, later_n: the last of them, since later_on. same_s, same_n: on the
    day itself. later_came, same_came: returns that ever counted. Returns are summed by the days between which they held first, so only a few rows an industry and day move on."""
    one = lambda c, later, same: F.struct(F.col(c).alias("code"), F.lit(later).alias("in_later"), F.lit(same).alias("in_same"))
    codes = F.when(F.col("later_code").eqNullSafe(F.col("same_code")), F.array(one("later_code", 1, 1))).otherwise(F.array(one("later_code", 1, 0), one("same_code", 0, 1)))
    v = days.select("day", "rs", F.inline(codes)).filter("code is not null").select("day", "code", "in_later", "in_same", F.inline("rs"))
    sums = {f"{k}_{w}": F.sum(F.col("r") * F.col(f"in_{w}") if k == "s" else F.col(f"in_{w}")) for w in ("later", "same") for k in "sn"}
    v = v.groupBy("code", "day", "from", "to").agg(*[c.alias(n) for n, c in sums.items()])
    moves = F.array(F.struct(F.col("from").alias("on"), F.lit(1).alias("sign")), F.struct(F.col("to").alias("on"), F.lit(-1).alias("sign")))
    m = v.select("*", F.inline(moves)).filter("on is not null").groupBy("code", "day", "on")
    m = m.agg(*[F.sum(F.col(n) * F.col("sign")).alias(n) for n in sums], *[F.sum(F.when(F.col("sign") > 0, F.col(f"n_{w}")).otherwise(0)).alias(f"{w}_came") for w in ("later", "same")], F.max("n_later").alias("any_later"))

    def run(moves: Column) -> Column:
        """Sums up to each day, in the order of days: few, since revisions arrive on few days."""
        add = lambda acc, m: F.concat(acc, F.array(F.struct(m["on"].alias("on"), (F.coalesce(F.get(acc, F.size(acc) - 1)["s"], F.lit(0.0)) + m["s"]).alias("s"), (F.coalesce(F.get(acc, F.size(acc) - 1)["n"], F.lit(0)) + m["n"]).cast("long").alias("n"))))
        return F.aggregate(F.sort_array(moves), F.array().cast("array<struct<on:date,s:double,n:bigint>>"), add)

    later = F.collect_list(F.when(F.col("any_later") > 0, F.struct("on", F.col("s_later").alias("s"), F.col("n_later").alias("n"))))
    today = lambda c: F.sum(F.when(F.col("on") == F.col("day"), F.col(c)))
    t = m.groupBy("code", "day").agg(later.alias("later"), today("s_same").alias("same_s"), today("n_same").alias("same_n"), F.sum("later_came").alias("later_came"), F.sum("same_came").alias("same_came"))
    t = t.withColumn("later", run(F.col("later")))
    last = F.get("later", F.size("later") - 1)
    return t.select("*", last["on"].alias("later_on"), last["s"].alias("later_s"), last["n"].alias("later_n"))


def peer_days(days: DataFrame, totals: DataFrame) -> DataFrame:
    """symbol, code, day, asks, and the returns and peer means of a symbol's days in each of its industries, ever: r, peers as they are in the end, own_r, own_peers on the day itself.

    settled: the first day from which decisions see r and peers; rs, later, in_later give what others see. Days that neither ask nor may have peers are left out."""
    mine = lambda c: F.coalesce(F.col(c) == F.col("code"), F.lit(False)).cast("int")
    x = days.withColumn("code", F.explode("codes")).withColumns({"in_later": mine("later_code"), "in_same": mine("same_code"), "asks": mine("asks") == 1}).join(totals, ["code", "day"], "left")
    could = F.coalesce((F.size("rs") > 0) & ((F.col("later_came") > F.col("in_later") * F.size("rs")) | (F.col("same_came") > F.col("in_same") * F.size("rs"))), F.lit(False))
    x = x.withColumn("could", could).filter("could or asks")

    def mean(side: str, r: str) -> Column:
        n = F.col(f"{side}_n") - F.col(f"in_{side}")
        return F.when(F.col("could") & (n > 0), (F.col(f"{side}_s") - F.col(f"in_{side}") * F.col(r)) / n)

    x = x.withColumns({"peers": mean("later", "final"), "own_peers": mean("same", "now")})
    both = lambda c, r, p: F.when(F.col(r).isNotNull() & F.col(p).isNotNull(), F.col(c))
    return x.select(
        "symbol", "code", "day", "asks", "could", both("final", "final", "peers").alias("r"), both("peers", "final", "peers").alias("peers"), both("now", "now", "own_peers").alias("own_r"),
        both("own_peers", "now", "own_peers").alias("own_peers"), F.when(F.col("could"), F.greatest("changed", "later_on")).alias("settled"), "rs", "later", "in_later",
    )


def industry_relative(bars: DataFrame, members: DataFrame, *, lookback: int = 20, first_look: int = 30) -> DataFrame:
    """Stock minus industry returns of 5 and ``lookback`` days, equal weights of peers without the stock, as decisions saw them.

    A return day before the decision counts peers of the industry effective on or before that day, the decision's own day those
    effective strictly before it. The newest ``lookback`` own days with a return and a peer count, however far back. Where all days that may count are
    settled by the decision, they are products over the last days that have both in the end. A day sends its state to the other decisions among those of the next
    ``first_look`` such days; decisions that find too few look at four times as many, until they have enough or no day is left.
    """
    plan = schedules(members)
    days = stored(return_days(bars, plan), "return-days")
    rows = peer_days(days, stored(peer_totals(days), "peer-totals"))
    spans, key = (5, lookback), ["symbol", "code"]
    day, valid = F.col("day"), F.col("r").isNotNull()
    own, by = Window.partitionBy(*key).orderBy("day"), Window.partitionBy(*key).orderBy("before")
    named = lambda r, p, n: rnd(r - 1 - (p - 1), 7).alias(f"industry_relative_{n}")
    out, look, open_ = None, max(first_look, lookback), None
    while True:
        x = rows if open_ is None else rows.join(open_.select(*key).distinct(), key, "left_semi").drop("asks").join(open_.withColumn("asks", F.lit(True)), [*key, "day"], "left").withColumn("asks", F.coalesce("asks", F.lit(False)))
        x = x.withColumns({"before": F.count("r").over(own.rowsBetween(Window.unboundedPreceding, -1)), "news": F.lag("settled").over(own)})
        x = x.withColumn("open", F.col("asks") & F.coalesce(F.max("news").over(by.rangeBetween(-lookback, 0)) > day, F.lit(False)))
        past = lambda c, n: F.coalesce(F.product(1 + F.col(c)).over(by.rangeBetween(-n, -1)), F.lit(1.0)) if n else F.lit(1.0)
        today = F.col("own_r").isNotNull()
        side = lambda c, n: F.when(today, past(c, n - 1) * (1 + F.col(f"own_{c}"))).otherwise(past(c, n))
        x = x.withColumns({f"{c}_{n}": side(c, n) for c in ("r", "peers") for n in spans} | {"asking": F.collect_list(F.when(F.col("open"), F.struct("day", "before"))).over(by.rangeBetween(0, look))})

        def judged(t: Column) -> Column:
            at = t["day"]
            r = F.get(F.filter("rs", lambda v: (v["from"] <= at) & (v["to"].isNull() | (v["to"] > at))), 0)["r"]
            seen = F.filter("later", lambda m: m["on"] <= at)
            total = F.get(seen, F.size(seen) - 1)
            n = total["n"] - F.col("in_later")
            then = F.struct(r.alias("r"), F.when(n > 0, (total["s"] - F.col("in_later") * r) / n).alias("peers"))
            state = F.when(at == day, F.struct(F.col("own_r").alias("r"), F.col("own_peers").alias("peers"))).when(F.col("settled") <= at, F.struct("r", "peers")).otherwise(then)
            return F.struct(at.alias("at"), t["before"].alias("before"), F.struct(day.alias("day"), state["r"].alias("r"), state["peers"].alias("peers")).alias("d"))

        has = lambda d: d["r"].isNotNull() & d["peers"].isNotNull()
        sent = F.filter(F.transform(F.filter("asking", lambda t: (t["day"] == day) | (F.col("could") & (t["day"] > day))), judged), lambda p: (p["at"] == day) | has(p["d"]))
        enough = F.col("asks") & ~F.col("open") & (F.col("before") + today.cast("int") >= lookback)
        x = x.select(*key, "day", enough.alias("enough"), *[named(F.col(f"r_{n}"), F.col(f"peers_{n}"), n) for n in spans], F.when(F.size("asking") > 0, sent).alias("sent"))
        x = stored(x.filter("enough or size(sent) > 0"), "looked")
        met = x.filter("size(sent) > 0").select(*key, F.inline("sent")).groupBy(*key, "at", "before").agg(F.sort_array(F.collect_list(F.when(has(F.col("d")), F.col("d")))).alias("h"))
        met = met.withColumnRenamed("at", "day")
        whole = lambda k, n: F.aggregate(F.slice("h", -n, n), F.lit(1.0), lambda a, d: a * (1 + d[k]))  # noqa: B023, E731
        found = x.filter("enough").drop("enough", "sent").unionByName(met.filter(F.size("h") >= lookback).select(*key, "day", *[named(whole("r", n), whole("peers", n), n) for n in spans]))
        out = found if out is None else out.unionByName(found)
        open_ = met.filter((F.size("h") < lookback) & (F.col("before") > look)).select(*key, "day")
        if not open_.limit(1).count():
            break
        open_, look = stored(open_, "open"), 4 * look
    return out.select("symbol", F.col("day").alias("trade_date"), "code", *[f"industry_relative_{n}" for n in spans])


def universe_regime(bars: DataFrame, window: int = 20, up: float = 0.03, down: float = -0.03) -> DataFrame:
    """The equal-weight return of each day as its decision saw it, compounded over ``window`` days through the day before, and its label."""
    d = own_returns(bars).groupBy("trade_date").agg(F.avg("r").alias("m"))  # one row a day from here on
    x = d.withColumn("c", F.product(1 + F.col("m")).over(Window.orderBy("trade_date").rowsBetween(-window, -1)) - 1)
    label = F.when(F.col("c").isNull(), "NO_DATA").when(F.col("c") > up, "BULL").when(F.col("c") < down, "BEAR").otherwise("NEUTRAL")
    return x.select("trade_date", rnd("c", 7).alias("compounded"), label.alias("regime"))


def breadth(rows: DataFrame, pct: Column, *keys: str) -> DataFrame:
    """Advancers (at least 0), decliners, limit moves of 9.8 % and their pressure, over the rows that have a change."""
    x = rows.withColumn("__pct", pct).filter("__pct is not null")
    n = F.count("*")
    p = F.col("__pct")
    up, down, high, low = F.count_if(p >= 0), F.count_if(p < 0), F.count_if(p >= 9.8), F.count_if(p <= -9.8)
    return x.groupBy(*keys).agg(n.alias("n"), up.alias("up"), down.alias("down"), high.alias("limit_up"), low.alias("limit_down"), rnd((up - down) / n).alias("breadth"), rnd((high - low) / n).alias("limit_pressure"))
