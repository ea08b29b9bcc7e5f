"""Views over the base tables in the shapes that the operators take: bars, memberships, information records, ticks, ledger events.

Each view exists twice, as DataFrame code and as DuckDB text; both round where doubles are summed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rnd(x: F.Column | str, n: int = 9) -> F.Column:
    """Half up on the binary value, the same in any engine; never minus zero."""
    x = F.col(x) if isinstance(x, str) else x
    return F.floor(x * float(10**n) + 0.5) / float(10**n)


def cents(name: str) -> F.Column:
    return F.floor(F.col(name) * 100 + 0.5)


def hours(n: int) -> F.Column:
    return F.make_dt_interval(hours=F.lit(n))


def _bars(spark: SparkSession, sf_dir: str, late: bool) -> DataFrame:
    """Lines are dealt by symbol once; days, revisions and what windows by symbol make of them stay where they are."""
    symbol, day = F.lpad(F.col("l_suppkey").cast("string"), 6, "0").alias("symbol"), F.to_date("l_shipdate").alias("trade_date")
    d = table(spark, sf_dir, "lineitem").select(symbol, F.col("l_suppkey").alias("k"), day, cents("l_extendedprice").alias("c"), "l_quantity").repartition("symbol").groupBy("symbol", "k", "trade_date")
    d = d.agg(rnd(90 + F.sum("c") / F.count("*") / 500000, 4).alias("px"), F.sum("l_quantity").alias("volume"), (F.sum("c") / 100).alias("amount"))
    dom = F.dayofmonth("trade_date")
    slow = (F.col("k") + dom) % 17 == 0
    revisions = [F.lit(0), F.when(slow | ((F.col("k") + dom) % 19 == 0), 1)] + ([F.when((F.col("symbol").cast("int") % 7 == 3) & (dom <= 4), 2)] if late else [])
    base, again, third = F.col("trade_date").cast("timestamp_ntz"), F.col("revision") == 1, F.col("revision") == 2
    b = d.select(
        "symbol", slow.alias("slow"), "trade_date", F.explode(F.array_compact(F.array(*revisions))).alias("revision"), F.col("px").alias("close"), "volume", "amount",
        rnd(F.col("px") * (1 + ((F.col("k") + dom) % 7) / 1000.0), 4).alias("high"), rnd(F.col("px") * (1 - ((F.col("k") + dom) % 5) / 1000.0), 4).alias("low"),
    )
    return b.select(
        "symbol", "trade_date", (base + hours(7)).alias("event_time"), F.when(third, base + hours(75)).when(again, F.when(F.col("slow"), base + hours(32)).otherwise(base + hours(10))).otherwise(base + hours(8)).alias("available_time"),
        "revision", rnd((F.col("high") + F.col("low")) / 2, 4).alias("open"), F.when(again, rnd(F.col("high") * 1.01, 4)).otherwise(F.col("high")).alias("high"), "low",
        F.when(third, rnd(F.col("close") * 1.03, 4)).when(again, rnd(F.col("close") * 1.01, 4)).otherwise(F.col("close")).alias("close"), "volume", "amount",
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bitemporal daily bars: symbol, trade_date, event_time, available_time, revision, open, high, low, close, volume, amount."""
    return _bars(spark, sf_dir, late=False)


def index_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An equal-weight index of revision-0 closes, with the clock of the bars."""
    d = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), F.to_date("l_shipdate").alias("trade_date"), cents("l_extendedprice").alias("c")).groupBy("k", "trade_date")
    d = d.agg(rnd(90 + F.sum("c") / F.count("*") / 500000, 4).alias("close"))  # as revision 0 of ``bars``
    b = d.groupBy("trade_date").agg(rnd(F.sum((F.col("close") * 10000 + 0.5).cast("long")) / F.count("*") / 10000, 6).alias("close"))
    base = F.col("trade_date").cast("timestamp_ntz")
    return b.select(F.lit("IDX000").alias("symbol"), "trade_date", (base + hours(7)).alias("event_time"), (base + hours(8)).alias("available_time"), F.lit(0).alias("revision"), "close")


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Industry intervals: symbol, industry_code, effective_from, effective_to (null: open), available_time."""
    s = table(spark, sf_dir, "supplier").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    sym = F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("symbol")
    code = lambda c: F.concat(F.lit("SW1:"), c.cast("string")).alias("industry_code")
    first = s.select(sym, code(F.col("n_regionkey")), F.lit("1990-01-01").cast("date").alias("effective_from"))
    later = s.filter("s_suppkey % 7 = 0").select(sym, code((F.col("n_regionkey") + 1) % 5), F.date_add(F.lit("1998-01-01").cast("date"), (F.col("s_suppkey") % 365).cast("int")).alias("effective_from"))
    every = first.unionByName(later)
    nxt = F.lead("effective_from").over(Window.partitionBy("symbol").orderBy("effective_from"))
    return every.withColumn("effective_to", nxt).withColumn("available_time", F.col("effective_from").cast("timestamp_ntz") + hours(32))


def info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Information records with revisions, from line items and their orders."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    source = F.when(F.col("l_returnflag") == "A", "cn_stock_quote").when(F.col("l_returnflag") == "N", "cn_index_daily").otherwise("company_announcement")
    return j.select(
        source.alias("source"), F.col("l_orderkey").cast("string").alias("source_id"), (F.col("l_linenumber") - 1).alias("revision"), F.col("l_partkey").cast("string").alias("entity_id"),
        F.lit("PART").alias("entity_type"), F.col("o_orderdate").cast("timestamp_ntz").alias("event_time"), F.col("l_shipdate").cast("timestamp_ntz").alias("available_time"),
        F.col("l_extendedprice").alias("value"), (F.col("l_shipdate").cast("timestamp_ntz") + hours(1)).alias("ingested_at"), F.col("l_suppkey").alias("k"),
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.when(F.col("event_type") == "purchase", "B").when(F.col("event_type") == "error", "S").otherwise("N")
    return table(spark, sf_dir, "events").select(F.lpad(F.col("user_id").cast("string"), 6, "0").alias("symbol"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("value").alias("price"), (F.col("event_id") % 97 + 1).alias("hands"), side.alias("side"), "event_id")


def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger rows: record_id, symbol, decision_time, action, probability."""
    o = table(spark, sf_dir, "orders")
    action = F.element_at(F.array(*map(F.lit, ("BUY", "HOLD", "SELL", "NO_ACTION"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return o.select(F.col("o_orderkey").alias("record_id"), F.lpad(F.col("o_custkey").cast("string"), 6, "0").alias("symbol"), F.col("o_orderdate").cast("timestamp_ntz").alias("decision_time"), action.alias("action"), ((F.col("o_orderkey") % 100) / 100.0).alias("probability"))


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_id, horizon, actual_return of horizons 1, 3, 5 and 10."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(F.array(*map(F.lit, (1, 3, 5, 10)))).alias("horizon"))
    return o.select(F.col("o_orderkey").alias("record_id"), "horizon", (((F.col("o_orderkey") * F.col("horizon")) % 41 - 20) / 1000.0).alias("actual_return"))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_id, seq, verdict: one review for each third record, two for each ninth."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_id"))
    one = o.filter("record_id % 3 = 0").select("record_id", (F.col("record_id") * 10 + 1).alias("seq"), F.lit("FIRST").alias("verdict"))
    two = o.filter("record_id % 9 = 0").select("record_id", (F.col("record_id") * 10 + 2).alias("seq"), F.lit("SECOND").alias("verdict"))
    return one.unionByName(two)


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of providers, with missing stamps, fallbacks, warnings and empty data among them."""
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    source = F.when(i % 4 == 0, "sina").when(i % 4 == 1, "sina_Fallback").when(i % 4 == 2, "tencent")
    ts = F.col("ts").cast("timestamp_ntz")
    return e.select(
        i.alias("payload_id"), F.lpad(F.col("user_id").cast("string"), 6, "0").alias("symbol"), source.alias("source"), F.when(i % 11 != 0, ts).alias("fetched_at"),
        F.when(i % 10 != 0, ts + F.make_dt_interval(mins=(i % 30).cast("int"))).alias("available_time"), (ts + F.make_dt_interval(secs=(i % 900).cast("int"))).alias("now"), (i % 13 == 0).alias("fallback"), (i % 7 == 0).alias("is_stale"),
        F.when(i % 5 == 0, "slow").alias("warning"), F.when(i % 6 == 0, "note").alias("note"), F.when(i % 9 != 0, F.col("value")).alias("data"),
    )


def late_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``bars`` with a second revision, three days after its day, of every seventh symbol's first days of a month: later than the next decision."""
    return _bars(spark, sf_dir, late=True)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """variant, symbol, trade_date, p, y, baseline_p, next_return and the four factors."""
    from .operators.factors import design_rows

    r = design_rows(bars(spark, sf_dir))
    base = F.avg(F.col("label").cast("double")).over(Window.partitionBy("symbol"))
    r = r.withColumn("baseline_p", rnd(base, 9))
    p = lambda k: rnd(1 / (1 + F.exp(-(k * F.col("momentum") - F.col("trend") + 0.1 * F.col("volume_ratio")))), 9)
    keep = ["symbol", "trade_date", F.col("label").alias("y"), "baseline_p", "next_return", "momentum", "volatility", "trend", "volume_ratio"]
    both = r.select(F.lit("baseline").alias("variant"), p(1.0).alias("p"), *keep)
    return both.unionByName(r.select(F.lit("shifted").alias("variant"), p(0.5).alias("p"), *keep))


# what each decision saw of its own days, and the returns between adjacent ones
_SEEN = """select d.symbol, d.dt, d.i as own_i, e.i, e.trade_date as day, max_by(b."close", b.revision) as c from days_ d join days_ e on e.symbol = d.symbol and e.i <= d.i
    join late_bars b on b.symbol = e.symbol and b.trade_date = e.trade_date and b.available_time <= d.dt group by all"""
_PIT = """select a.symbol, a.dt, cast(a.dt as date) as trade_date, a.own_i, a.i, a.day, a.c as "close", a.c / b.c - 1 as r from {seen} a left join {seen} b on b.symbol = a.symbol and b.own_i = a.own_i and b.i = a.i - 1 and b.c > 0 and a.c > 0"""

VIEWS: dict[str, tuple[str, str]] = {
    "bars": ("", """
d_ as (select l_suppkey as k, cast(l_shipdate as date) as td, extract(day from cast(l_shipdate as date)) as dom,
    rnd(90 + sum(cast(floor(l_extendedprice * 100 + 0.5) as bigint))::double / count(*) / 500000, 4) as px, sum(l_quantity) as vol, sum(cast(floor(l_extendedprice * 100 + 0.5) as bigint))::double / 100 as amount from lineitem group by 1, 2, 3),
b0_ as (select lpad(cast(k as varchar), 6, '0') as symbol, k, dom, td as trade_date, rnd(px*(1+((k+dom)%7)/1000.0), 4) as high,
    rnd(px*(1-((k+dom)%5)/1000.0), 4) as low, px as "close", vol as volume, amount from d_),
bars as (select symbol, trade_date, cast(trade_date as timestamp) + interval 7 hour as event_time, cast(trade_date as timestamp) + interval 8 hour as available_time,
    0 as revision, rnd((high+low)/2, 4) as "open", high, low, "close", volume, amount from b0_
  union all
  select symbol, trade_date, cast(trade_date as timestamp) + interval 7 hour,
    case when (k+dom)%17=0 then cast(trade_date as timestamp) + interval 32 hour else cast(trade_date as timestamp) + interval 10 hour end, 1,
    rnd((high+low)/2, 4), rnd(high*1.01, 4), low, rnd("close"*1.01, 4), volume, amount from b0_ where (k+dom)%17=0 or (k+dom)%19=0)"""),
    "index_bars": ("bars", """
index_bars as (select 'IDX000' as symbol, trade_date, cast(trade_date as timestamp) + interval 7 hour as event_time,
    cast(trade_date as timestamp) + interval 8 hour as available_time, 0 as revision, rnd(sum(cast(floor("close" * 10000 + 0.5) as bigint))::double / count(*) / 10000, 6) as "close" from bars where revision = 0 group by trade_date)"""),
    "membership": ("", """
m0_ as (select lpad(cast(s_suppkey as varchar), 6, '0') as symbol, 'SW1:' || n_regionkey as industry_code, date '1990-01-01' as effective_from from supplier join nation on s_nationkey = n_nationkey
  union all select lpad(cast(s_suppkey as varchar), 6, '0'), 'SW1:' || ((n_regionkey + 1) % 5), date '1998-01-01' + cast(s_suppkey % 365 as integer) from supplier join nation on s_nationkey = n_nationkey where s_suppkey % 7 = 0),
membership as (select *, lead(effective_from) over (partition by symbol order by effective_from) as effective_to, cast(effective_from as timestamp) + interval 32 hour as available_time from m0_)"""),
    "info": ("", """
info as (select case l_returnflag when 'A' then 'cn_stock_quote' when 'N' then 'cn_index_daily' else 'company_announcement' end as source, cast(l_orderkey as varchar) as source_id,
    l_linenumber - 1 as revision, cast(l_partkey as varchar) as entity_id, 'PART' as entity_type, o_orderdate as event_time, l_shipdate as available_time,
    l_extendedprice as value, l_shipdate + interval 1 hour as ingested_at, l_suppkey as k from lineitem join orders on l_orderkey = o_orderkey)"""),
    "ticks": ("", """
ticks as (select lpad(cast(user_id as varchar), 6, '0') as symbol, ts, value as price, event_id % 97 + 1 as hands,
    case event_type when 'purchase' then 'B' when 'error' then 'S' else 'N' end as side, event_id from events)"""),
    "recommendations": ("", """
recommendations as (select o_orderkey as record_id, lpad(cast(o_custkey as varchar), 6, '0') as symbol, o_orderdate as decision_time,
    ['BUY', 'HOLD', 'SELL', 'NO_ACTION'][cast(o_orderkey % 4 + 1 as integer)] as action, (o_orderkey % 100) / 100.0::double as probability from orders)"""),
    "outcomes": ("", """
outcomes as (select o_orderkey as record_id, horizon, ((o_orderkey * horizon) % 41 - 20) / 1000.0::double as actual_return from orders, (values (1), (3), (5), (10)) h(horizon))"""),
    "reviews": ("", """
reviews as (select o_orderkey as record_id, o_orderkey * 10 + 1 as seq, 'FIRST' as verdict from orders where o_orderkey % 3 = 0
  union all select o_orderkey, o_orderkey * 10 + 2, 'SECOND' from orders where o_orderkey % 9 = 0)"""),
    "payloads": ("", """
payloads as (select event_id as payload_id, lpad(cast(user_id as varchar), 6, '0') as symbol, case event_id % 4 when 0 then 'sina' when 1 then 'sina_Fallback' when 2 then 'tencent' end as source, case when event_id % 11 <> 0 then ts end as fetched_at,
    case when event_id % 10 <> 0 then ts + to_minutes(event_id % 30) end as available_time, ts + to_seconds(event_id % 900) as now, event_id % 13 = 0 as fallback, event_id % 7 = 0 as is_stale,
    case when event_id % 5 = 0 then 'slow' end as warning, case when event_id % 6 = 0 then 'note' end as note, case when event_id % 9 <> 0 then value end as data from events)"""),
    "late_bars": ("bars", """
late_bars as (select * from bars union all select symbol, trade_date, event_time, cast(trade_date as timestamp) + interval 75 hour, 2, "open", high, low, rnd("close" * 1.03, 4), volume, amount
    from bars where revision = 0 and cast(symbol as integer) % 7 = 3 and extract(day from trade_date) <= 4)"""),
    "days": ("late_bars", """
days_ as materialized (select symbol, trade_date, cast(trade_date as timestamp) + interval 8 hour as dt, row_number() over (partition by symbol order by trade_date) as i from (select distinct symbol, trade_date from late_bars))"""),
    "pit": ("days", f"""
seen_ as materialized ({_SEEN}),
pit as ({_PIT.format(seen="seen_")})"""),
    "near": ("days", f"""
near_ as materialized ({_SEEN.replace("e.i <= d.i", "e.i between d.i - 10 and d.i")}),
near as ({_PIT.format(seen="near_")})"""),
    "looks": ("bars", """
looks as (select symbol, trade_date, "open", high, low, "close" as final, volume, amount from bars where revision = 0)"""),
    "settled": ("bars", """
settled as (select a.symbol, a.trade_date, a."close" as look, a.high, a.low, a.volume, a.amount, max_by(b."close", b.revision) as final from bars a join bars b on a.symbol = b.symbol and a.trade_date = b.trade_date where a.revision = 0 group by all)"""),
    "design": ("settled", """
d1_ as (select *, lag(final, 20) over w as back, lag(final) over w as prev, ln(final / lag(final) over w) as r, row_number() over w as rn, lead(final) over w as nxt from settled window w as (partition by symbol order by trade_date)),
d2_ as (select *, ln(look / prev) as r0, sum(final) over (w rows between 19 preceding and 1 preceding) as s19, avg(volume) over (w rows between 20 preceding and 1 preceding) as v20,
    sum(r) over (w rows between 19 preceding and 1 preceding) as r19, list(r) over (w rows between 19 preceding and 1 preceding) as rs from d1_ window w as (partition by symbol order by trade_date)),
design as (select symbol, trade_date, look as "close", rnd(look / back - 1, 9) as momentum, rnd(list_aggregate(list_append(rs, r0), 'stddev_pop') * sqrt(252), 6) as volatility, rnd(look / ((s19 + look) / 20) - 1, 9) as trend,
    rnd(volume / v20 - 1, 9) as volume_ratio, rnd(nxt / look - 1, 9) as next_return, case when rnd(nxt / look - 1, 9) > 0 then 1 else 0 end as label from d2_ where rn > 20 and nxt is not null and v20 > 0)"""),
    "predictions": ("design", """
p0_ as (select *, rnd(avg(label) over (partition by symbol), 9) as baseline_p from design),
predictions as (select v.variant, symbol, trade_date, rnd(1 / (1 + exp(-(v.m * momentum - trend + 0.1::double * volume_ratio))), 9) as p, label as y, baseline_p, next_return, momentum, volatility, trend, volume_ratio
  from p0_, (values ('baseline', 1.0::double), ('shifted', 0.5::double)) v(variant, m))"""),
}


def with_views(sql: str, *names: str) -> str:
    """The SQL text with the named views, and those they read, set before it."""
    ordered: list[str] = []

    def need(name: str) -> None:
        for other in VIEWS[name][0].split():
            need(other)
        if name not in ordered:
            ordered.append(name)

    for n in names:
        need(n)
    text = sql.strip()
    if not ordered:
        return expand(text)
    head = ",".join(VIEWS[n][1] for n in ordered)
    for start in ("with recursive ", "with "):
        if text.lower().startswith(start):
            return expand(f"{start}{head},\n{text[len(start):]}")
    return expand(f"with {head}\n{text}")


def expand(sql: str) -> str:
    """SQL with each rnd(x, n) written out, as ``rnd`` above."""
    while (at := sql.find("rnd(")) >= 0:
        depth, comma, i = 1, None, at + 4
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            comma = i if sql[i] == "," and depth == 1 else comma
            i += 1
        scale = f"1e{int(sql[comma + 1 : i - 1])}"
        sql = f"{sql[:at]}(floor(({sql[at + 4 : comma]}) * {scale} + 0.5) / {scale}){sql[i:]}"
    return sql
