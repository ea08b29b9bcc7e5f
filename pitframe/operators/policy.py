"""Recommendation policies over scored rows: expected return and risk, selection under caps, books and their costs, packets."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fixtures import rnd
from ..sources.scratch import stored
from . import resample
from .calibrate import _sigmoid, logit
from .metrics import exact_quantiles, log_loss

# The study's window, winsor points, cap, costs in basis points of a unit traded.
HISTORY, LEAST_HISTORY, WINSOR, CAP = 60, 10, (0.01, 0.99), 2
COSTS = {"zero": 0.0, "low": 10.0, "medium": 20.0}


class Policy(NamedTuple):
    name: str
    rule: str
    score: str
    at: float | None = None
    reason: str = ""


# The eight policies of the study, and the reasons they give.
POLICIES = (
    Policy("hold_all", "all", "p", None, "baseline_hold_all"),
    Policy("threshold_raw_p50", "threshold", "p", 0.5, "raw_probability_ge_0.50"),
    Policy("threshold_platt_p50", "threshold", "p_platt", 0.5, "platt_probability_ge_0.50"),
    Policy("threshold_iso_p50", "threshold", "p_iso", 0.5, "isotonic_probability_ge_0.50"),
    Policy("topk_platt_k3", "top", "p_platt", 3, "top_3_platt_probability"),
    Policy("percentile_platt_p80", "percentile", "p_platt", 0.8, "platt_probability_ge_daily_p80"),
    Policy("er_platt_0", "return", "p_platt", 0.0, "expected_return_gt_0"),
    Policy("er_platt_pos_risk", "return_risk", "p_platt", 0.0, "expected_return_gt_0_and_volatility_le_daily_median"),
)


def rolling_features(rows: DataFrame, split: str) -> DataFrame:
    """``rows`` (symbol, trade_date, next_return) with upside, downside, volatility, downside_deviation and max_drawdown of up to 60
    earlier returns, winsorised at 1 and 99 %. With fewer than 10 they are those of all winsorised returns before ``split``.

    The rows are computed once: they are written with their own features, and the pool is taken from what was written."""
    w = Window.partitionBy("symbol").orderBy("trade_date").rowsBetween(-HISTORY, -1)
    x = rows.withColumn("past", F.collect_list("next_return").over(w))

    @F.pandas_udf("n int, u double, d double, v double, e double, dd double")
    def features(past: pd.Series) -> pd.DataFrame:
        """A block of rows at a time: returns side by side, padded on the right."""
        n = past.map(len).to_numpy()
        real = np.arange(HISTORY) < n[:, None]
        x = np.zeros(real.shape)
        x[real] = np.concatenate([np.asarray(p, float) for p in past])
        row, s = np.arange(len(n)), np.sort(np.where(real, x, np.inf), axis=1)

        def quantile(q: float) -> np.ndarray:
            place = np.maximum(n - 1, 0) * q
            low = np.floor(place).astype(int)
            a, b = (np.where(n > 0, s[row, k], 0.0) for k in (low, np.minimum(low + 1, np.maximum(n - 1, 0))))
            return a + (b - a) * (place - low)

        lo, hi = quantile(WINSOR[0]), quantile(WINSOR[1])
        w = np.where(real, np.minimum(np.maximum(x, lo[:, None]), hi[:, None]), 0.0)

        def moments(on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            k = np.maximum(on.sum(axis=1), 1)
            m = np.where(on, w, 0.0).sum(axis=1) / k
            return m, np.sqrt((np.where(on, w - m[:, None], 0.0) ** 2).sum(axis=1) / k)

        curve = np.cumprod(1 + w, axis=1)
        low = np.minimum((curve / np.maximum(np.maximum.accumulate(curve, axis=1), 1.0) - 1).min(axis=1), 0.0)
        (up, _), (down, off), (_, spread) = moments(w > 0), moments(w < 0), moments(real)
        return pd.DataFrame({"n": n, "u": up, "d": down, "v": spread, "e": off, "dd": low})

    x = stored(x.withColumn("own", features(F.col("past"))).drop("past"), "features")
    discovery = x.filter(F.col("trade_date") < split)
    ends = exact_quantiles(discovery, "next_return", list(WINSOR)).toDF("a", "b")
    r = F.least(F.greatest("next_return", "a"), F.col("b"))
    pool = discovery.crossJoin(F.broadcast(ends)).withColumn("r", r).agg(  # one row each
        F.coalesce(F.avg(F.when(F.col("r") > 0, F.col("r"))), F.lit(0.0)).alias("u0"), F.coalesce(F.avg(F.when(F.col("r") < 0, F.col("r"))), F.lit(0.0)).alias("d0"),
        F.coalesce(F.stddev_pop("r"), F.lit(0.0)).alias("v0"), F.coalesce(F.stddev_pop(F.when(F.col("r") < 0, F.col("r"))), F.lit(0.0)).alias("e0"),
    )
    own = F.col("own.n") >= LEAST_HISTORY
    pick = lambda mine, pooled: F.when(own, mine).otherwise(pooled)
    return x.crossJoin(F.broadcast(pool)).select(
        *rows.columns, pick(F.col("own.u"), F.col("u0")).alias("upside"), pick(F.col("own.d"), F.col("d0")).alias("downside"),
        pick(F.col("own.v"), F.col("v0")).alias("risk"), pick(F.col("own.e"), F.col("e0")).alias("downside_deviation"), pick(F.col("own.dd"), F.lit(0.0)).alias("max_drawdown"),
    )


def line(p: Column, a: float, b: float) -> Column:
    """p through a fitted line on its logit."""
    return _sigmoid(F.lit(a) + F.lit(b) * logit(p))


def step_of(p: Column, steps: list[tuple[float, float]]) -> Column:
    """The value of the last step (from, value) that p reaches; the first one below it."""
    out = F.lit(steps[0][1])
    for at, value in steps[1:]:
        out = F.when(p >= at, value).otherwise(out)
    return out


def expected_return(p: Column, upside: Column, downside: Column) -> Column:
    return p * upside + (1 - p) * downside


def select(rows: DataFrame, policies: tuple[Policy, ...] = POLICIES, cap: int = CAP, industry: str = "industry") -> DataFrame:
    """Rows once for each policy that takes them: symbol, trade_date, ``industry``, expected_return, risk and the policies' scores are read.

    Of each day and policy at most ``cap`` rows of an industry stay, in the order of symbols; rows without one are not capped.
    The risk filter is the median risk of all rows. Days are ranked in windows; a day has one row a symbol. Each policy's takes are numbered
    side by side on the plain rows, so rows travel once, by day, and only those that stay become a row for each policy.
    ``rows`` is read three times: store what is dear to compute."""
    day = Window.partitionBy("trade_date")
    middle = F.broadcast(exact_quantiles(rows, "risk", [0.5]).toDF("__middle"))  # one row
    x = rows.crossJoin(middle)
    for s in sorted({p.score for p in policies if p.rule == "top"}):
        x = x.withColumn(f"__rank_{s}", F.row_number().over(day.orderBy(F.desc(s), "symbol")))
    for p in policies:
        if p.rule == "percentile":
            x = x.withColumn(f"__cut_{p.name}", F.percentile(p.score, F.lit(p.at)).over(day))
    takes = []
    for p in policies:
        ok = {
            "all": lambda p=p: F.lit(True), "threshold": lambda p=p: F.col(p.score) >= p.at, "top": lambda p=p: F.col(f"__rank_{p.score}") <= p.at, "percentile": lambda p=p: F.col(p.score) >= F.col(f"__cut_{p.name}"),
            "return": lambda p=p: F.col("expected_return") > p.at, "return_risk": lambda p=p: (F.col("expected_return") > p.at) & (F.col("risk") <= F.col("__middle")),
        }[p.rule]()
        x = x.withColumn(f"__ok_{p.name}", F.coalesce(ok, F.lit(False)))
        takes.append((p, F.struct(F.lit(p.name).alias("policy"), F.col(p.score).cast("double").alias("p_used"))))
    before = Window.partitionBy("trade_date", industry).orderBy("symbol").rowsBetween(Window.unboundedPreceding, 0)
    x = x.select("*", *[F.sum(F.col(f"__ok_{p.name}").cast("int")).over(before).alias(f"__nth_{p.name}") for p in policies])
    stays = lambda p: F.col(f"__ok_{p.name}") & (F.col(industry).isNull() | (F.col(f"__nth_{p.name}") <= cap))
    return x.select(*rows.columns, F.inline(F.array_compact(F.array(*[F.when(stays(p), row) for p, row in takes]))))


def book_turnover(selected: DataFrame) -> DataFrame:
    """policy, turnover: members entering or leaving each day (the first day all enter) over the sum of book sizes; 0 with fewer than two days."""
    days = selected.select("policy", "trade_date").distinct()
    days = days.withColumn("i", F.row_number().over(Window.partitionBy("policy").orderBy("trade_date")))  # one row a policy and day
    x = selected.join(days, ["policy", "trade_date"]).select("policy", "i", "symbol")
    stay = x.join(x.withColumn("i", F.col("i") + 1), ["policy", "i", "symbol"]).groupBy("policy").agg(F.count("*").alias("stay"))
    size = x.groupBy("policy", "i").agg(F.count("*").alias("n"))
    last = size.groupBy("policy").agg(F.max("i").alias("days"), F.sum("n").alias("all"), F.max_by("n", "i").alias("last"))
    moved = 2 * F.col("all") - F.col("last") - 2 * F.coalesce("stay", F.lit(0))
    return last.join(stay, "policy", "left").select("policy", F.when(F.col("days") > 1, moved / F.col("all")).otherwise(0.0).alias("turnover"))


def portfolio_metrics(selected: DataFrame, every: DataFrame, costs: dict[str, float] = COSTS) -> DataFrame:
    """One row for each policy and cost scenario: size, coverage, hit rate, Brier, log-loss, gross and net return, turnover, drawdown of the daily book, downside."""
    r, down = F.col("next_return"), F.when(F.col("next_return") < 0, F.col("next_return"))
    y = F.col("y").cast("double")
    whole = every.agg(F.count("*").alias("rows"), F.count_distinct("trade_date").alias("days"))
    g = selected.groupBy("policy").agg(
        F.count("*").alias("n"), F.avg(y).alias("hit_rate"), F.avg((F.col("p_used") - y) * (F.col("p_used") - y)).alias("brier"), F.avg(log_loss(F.col("p_used"), y)).alias("log_loss"), F.avg(r).alias("gross"),
        F.stddev_pop(r).alias("volatility"), F.coalesce(F.avg(down), F.lit(0.0)).alias("downside_return"), F.coalesce(F.stddev_pop(down), F.lit(0.0)).alias("downside_deviation"),
    )
    w = Window.partitionBy("policy").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    book = selected.groupBy("policy", "trade_date").agg(F.avg(r).alias("r")).withColumn("curve", F.product(1 + F.col("r")).over(w))
    book = book.withColumn("peak", F.greatest(F.lit(1.0), F.max("curve").over(w))).groupBy("policy").agg(F.min(F.col("curve") / F.col("peak") - 1).alias("max_drawdown"))
    x = g.join(book, "policy").join(book_turnover(selected), "policy").crossJoin(F.broadcast(whole))
    x = x.withColumn("c", F.explode(F.array(*[F.struct(F.lit(k).alias("scenario"), F.lit(v / 10000).alias("rate")) for k, v in costs.items()])))
    return x.select(
        "policy", "c.scenario", "n", rnd(F.col("n") / F.col("rows")).alias("coverage"), rnd(F.col("n") / F.col("days"), 6).alias("per_day"), rnd("hit_rate").alias("hit_rate"), rnd("brier").alias("brier"), rnd("log_loss").alias("log_loss"),
        rnd("gross").alias("gross"), rnd("turnover").alias("turnover"), rnd(F.col("gross") - F.col("c.rate") * F.col("turnover")).alias("net"), rnd("max_drawdown", 6).alias("max_drawdown"),
        rnd("volatility", 7).alias("volatility"), rnd("downside_return").alias("downside_return"), rnd("downside_deviation", 7).alias("downside_deviation"),
    )


def stability(selected: DataFrame) -> DataFrame:
    """n, hit rate and mean return of each policy by year, regime, industry and symbol, in one pass."""
    tables = [("yearly", F.year("trade_date").cast("string")), ("regime", F.col("regime")), ("industry", F.col("industry")), ("symbol", F.col("symbol"))]
    each = F.array_compact(F.array(*[F.when(k.isNotNull(), F.struct(F.lit(n).alias("table"), k.alias("key"))) for n, k in tables]))
    return selected.withColumn("e", F.explode(each)).groupBy("policy", "e.table", "e.key").agg(F.count("*").alias("n"), rnd(F.avg(F.col("y").cast("double"))).alias("hit_rate"), rnd(F.avg("next_return")).alias("mean_return"))


def packets(selected: DataFrame, policies: tuple[Policy, ...] = POLICIES, cost_bp: float = COSTS["low"]) -> DataFrame:
    """The selected rows as recommendation packets, with the reason of their policy and the expected return after the cost of one unit."""
    reason = F.create_map(*[F.lit(x) for p in policies for x in (p.name, p.reason)])
    method = F.create_map(*[F.lit(x) for p in policies for x in (p.name, "none" if p.rule == "all" else {"p": "raw", "p_platt": "platt", "p_iso": "isotonic"}[p.score])])
    return selected.select(
        "policy", "symbol", "trade_date", method[F.col("policy")].alias("calibration_method"), F.col("p").alias("raw_probability"), F.col("p_used").alias("calibrated_probability"), "expected_return", F.col("risk").alias("risk_score"),
        (F.col("expected_return") - cost_bp / 10000).alias("cost_adjusted_expected_return"), F.col("regime").alias("market_regime"), reason[F.col("policy")].alias("selection_reason"), F.col("trade_date").alias("data_available_date"),
    )


REQUIRED = ("symbol", "trade_date", "policy", "calibration_method", "raw_probability", "calibrated_probability", "expected_return", "market_regime", "selection_reason")


def validate_packets(p: DataFrame, known: tuple[str, ...] = tuple(x.name for x in POLICIES)) -> DataFrame:
    """Packets with missing_fields, freshness, uncertainty (missing, stale, uncalibrated, contradictory, unknown policy) and a report id."""
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED]))
    fresh = F.when(F.col("data_available_date").isNull() | F.col("trade_date").isNull(), "missing").when(F.col("data_available_date") <= F.col("trade_date"), "fresh").otherwise("stale")
    up = lambda c: F.col(c) >= 0.5
    x = p.withColumn("missing_fields", missing).withColumn("freshness", fresh)
    doubts = F.array_compact(F.array(
        F.when(F.size("missing_fields") > 0, "missing_data"), F.when(F.col("freshness") == "stale", "stale_data"), F.when(F.col("calibration_method") == "none", "low_confidence"),
        F.when(up("raw_probability") != up("calibrated_probability"), "contradictory_evidence"), F.when(~F.coalesce(F.col("policy").isin(*known), F.lit(False)), "unknown_policy"),
    ))
    return x.withColumn("uncertainty", doubts).withColumn("report_id", F.substring(F.sha2(F.concat_ws("|", "policy", "symbol", F.col("trade_date").cast("string")), 256), 1, 16))


def policy_bootstrap(selected: DataFrame, base: str = "hold_all", rounds: int = resample.ROUNDS, seed: int = resample.SEED, cost_bp: float = COSTS["low"]) -> DataFrame:
    """Net return, hit rate and coverage of each policy minus those of ``base``, with 2.5 and 97.5 % points when whole symbols are drawn again.

    Row means come from sums by symbol. The turnover is taken again in each round: a symbol drawn k times weighs k in every book, so its
    moves are sums by policy and symbol too (days entered or left), and only those sums meet the draws. Coverage is the share of the drawn
    rows of ``base`` (which holds all) that a policy takes; a round in which a policy takes none has that coverage, but no return or hit rate."""
    days = selected.select("policy", "trade_date").distinct().withColumn("i", F.row_number().over(Window.partitionBy("policy").orderBy("trade_date")))
    x = selected.join(days, ["policy", "trade_date"])
    last = days.groupBy("policy").agg(F.max("i").alias("days"))
    w = Window.partitionBy("policy", "symbol").orderBy("i")
    enters = (F.coalesce(F.lag("i").over(w), F.lit(-1)) != F.col("i") - 1).cast("int")
    leaves = (F.coalesce(F.lead("i").over(w), F.lit(-1)) != F.col("i") + 1).cast("int")
    x = x.withColumn("moves", enters).withColumn("leaves", leaves).join(last, "policy")
    moved = F.col("moves") + F.when(F.col("i") < F.col("days"), F.col("leaves")).otherwise(0)
    sums = x.groupBy("policy", "symbol").agg(F.sum("next_return").alias("r"), F.sum(F.col("y").cast("double")).alias("hits"), F.count("*").alias("n"), F.sum(moved).alias("moves"))
    j = resample.drawn(sums, rounds, seed).groupBy("round", "policy")
    k = F.sum
    g = j.agg((k("r") / k("n") - cost_bp / 10000 * k("moves") / k("n")).alias("net"), (k("hits") / k("n")).alias("hit"), k("n").alias("n"))
    g = stored(g, "rounds")
    ref = g.filter(F.col("policy") == base).select("round", F.col("net").alias("net0"), F.col("hit").alias("hit0"), F.col("n").alias("n0"))
    others = days.filter(F.col("policy") != base).select("policy").distinct()  # a few policies, each in every round
    d = ref.crossJoin(F.broadcast(others)).join(g, ["round", "policy"], "left")
    share = F.coalesce(F.col("n"), F.lit(0)) / F.col("n0") - 1
    d = d.select("round", "policy", (F.col("net") - F.col("net0")).alias("net_delta"), (F.col("hit") - F.col("hit0")).alias("hit_delta"), share.alias("coverage_delta"))
    return resample.interval(d, ["policy"], ["net_delta", "hit_delta", "coverage_delta"])


def evaluate_signals(rows: DataFrame, horizon: int, *keys: str) -> DataFrame:
    """Forward returns of signalled rows (symbol, trade_date, close, signal): hit, mean, median, Sharpe by the sample deviation, drawdown of the compounded curve."""
    w = Window.partitionBy("symbol").orderBy("trade_date")
    x = rows.withColumn("r", F.lead("close", horizon).over(w) / F.col("close") - 1).filter("signal and r is not null")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("curve", F.product(1 + F.greatest("r", F.lit(-1.0))).over(run)).withColumn("peak", F.max("curve").over(run))
    sd = F.stddev_samp("r")
    return x.groupBy("symbol").agg(
        F.count("*").alias("n"), rnd(F.avg((F.col("r") > 0).cast("double"))).alias("hit"), rnd(F.avg("r")).alias("mean"), rnd(F.percentile("r", F.lit(0.5))).alias("median"),
        rnd(F.when(sd > 0, F.avg("r") / sd * F.sqrt(F.lit(252.0))), 6).alias("sharpe"), rnd(F.min(F.try_divide(F.col("curve"), F.col("peak")) - 1), 7).alias("max_drawdown"),
    )


def holding_returns(rows: DataFrame, fee: float = 0.0003) -> DataFrame:
    """Daily returns of a long-only position (symbol, trade_date, open, close, signal, buy_blocked, sell_blocked, suspended), holding one day at least.

    A signal opens the position at the next bar unless that is suspended or blocked for buying; its absence closes it unless the next
    bar is suspended or blocked for selling. While it is open the next bar's open-to-close return counts, less the fee from the second bar on."""
    w = Window.partitionBy("symbol").orderBy("trade_date")
    ahead = lambda c: F.lead(c).over(w)
    free = ~F.coalesce(ahead("suspended"), F.lit(False))
    enter = F.col("signal") & free & ~F.coalesce(ahead("buy_blocked"), F.lit(False))
    leave = ~F.col("signal") & free & ~F.coalesce(ahead("sell_blocked"), F.lit(False))
    x = rows.withColumn("event", F.when(enter, 1).when(leave, 0)).withColumn("first", F.row_number().over(w) == 1)
    x = x.withColumn("next_open", ahead("open")).withColumn("next_close", ahead("close")).withColumn("position", F.coalesce(F.last("event", True).over(w), F.lit(0)))
    x = x.filter("next_open is not null")
    r = F.when(F.col("position") == 1, F.col("next_close") / F.col("next_open") - 1 - F.when(F.col("first"), 0.0).otherwise(fee)).otherwise(0.0)
    return x.select("symbol", "trade_date", "position", rnd(r).alias("r"))


def decision_class(quality: Column, p_up: Column, allowed: Column, calibrated: Column, threshold: float = 0.6) -> Column:
    """NO_ACTION below quality 0.75 or where risk forbids it; PAPER_TEST for a calibrated probability at the threshold; else RESEARCH."""
    return F.when((quality < 0.75) | ~allowed, "NO_ACTION").when(calibrated & (p_up >= threshold), "PAPER_TEST").otherwise("RESEARCH")


# Limits in per cent of the book.
LIMITS = {"single": 20, "sector": 40, "trade": 50}


def position_breaches(single: Column, sector: Column, trade: Column) -> Column:
    return F.array_compact(F.array(*[F.when(c > LIMITS[n], n.upper()) for n, c in (("single", single), ("sector", sector), ("trade", trade))]))


def max_drawdown(rows: DataFrame, key: str = "symbol", order: str = "trade_date", value: str = "close") -> DataFrame:
    peak = F.max(value).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("__peak", peak).groupBy(key).agg(rnd(F.least(F.lit(0.0), F.min(F.try_divide(F.col(value), F.col("__peak")) - 1))).alias("max_drawdown"))
