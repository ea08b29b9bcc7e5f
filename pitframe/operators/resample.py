"""Clustered bootstrap: whole symbols are drawn again, and statistics are ratios of sums by symbol, so only those sums meet the draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fixtures import rnd
from ..sources.scratch import stored

ROUNDS, SEED = 1000, 20260929


def draws(sums: DataFrame, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """round, symbol and k: how often each round draws a symbol, from as many draws as there are symbols; round -1 takes each once.

    Draws are hashes of their numbers, so reruns agree."""
    return drawn(sums.select("symbol").distinct(), rounds, seed).groupBy("round", "symbol").agg(F.count("*").alias("k"))


def drawn(sums: DataFrame, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """The rows of ``sums`` once for each draw of their symbol, with its round; round -1 takes each once.

    The sums, a few rows a symbol, are computed once and numbered by symbol; draws are made where they meet them and need not be counted first."""
    sums = stored(sums, "sums")
    names = sums.select("symbol").distinct().withColumn("s", F.row_number().over(Window.orderBy("symbol")) - 1)  # one row a symbol
    numbered = stored(sums.join(names, "symbol"), "numbered")
    count = (numbered.agg(F.max("s")).first()[0] or 0) + 1
    draw = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), 1, 8), 16, 10).cast("long") % count).alias("s")
    picks = sums.sparkSession.range(rounds * count).select((F.col("id") % rounds).alias("round"), draw)
    return picks.join(numbered, "s").drop("s").unionByName(sums.withColumn("round", F.lit(-1).cast("long")))


def interval(rows: DataFrame, keys: list[str], values: list[str], digits: int = 9) -> DataFrame:
    """For each value its point (of round -1) and its 2.5 and 97.5 % points over the other rounds; a round without a value is left out."""
    drawn = F.col("round") >= 0
    q = lambda c, at: rnd(F.percentile(F.when(drawn, F.col(c)), F.lit(at)), digits).alias(f"{c}_q{str(at)[2:]}")
    point = lambda c: rnd(F.max(F.when(~drawn, F.col(c))), digits).alias(c)
    return rows.groupBy(*keys).agg(*[x for c in values for x in (point(c), q(c, 0.025), q(c, 0.975))])


def spread_sums(rows: DataFrame, *keys: str, low: int = 1, high: int = 5) -> DataFrame:
    """Rows, labels and returns of the lowest and highest quintile by symbol (and keys): columns n_low, up_low, ret_low, n_high, ..."""
    total = lambda q, name, c: F.sum(F.when(F.col("q") == q, c).otherwise(0)).alias(name)
    each: list[Column] = []
    for q, end in ((low, "low"), (high, "high")):
        each += [total(q, f"n_{end}", F.lit(1)), total(q, f"up_{end}", F.col("y").cast("double")), total(q, f"ret_{end}", F.col("next_return"))]
    return rows.groupBy(*keys, "symbol").agg(*each)


def spread_bootstrap(rows: DataFrame, *keys: str, rounds: int = ROUNDS, seed: int = SEED, digits: int = 9) -> DataFrame:
    """Highest less lowest quintile (column q) in share of ups and mean next return, with their 95 % intervals, for each group of ``keys``.

    A difference of ratios: sums by symbol, weighed by how often it is drawn, then divided. Groups share the draws."""
    sums = spread_sums(rows, *keys)
    j = drawn(sums, rounds, seed).groupBy(*keys, "round")
    ratio = lambda c, end: F.try_divide(F.sum(f"{c}_{end}"), F.sum(f"n_{end}"))
    g = j.agg((ratio("up", "high") - ratio("up", "low")).alias("spread_up"), (ratio("ret", "high") - ratio("ret", "low")).alias("spread_return"))
    return interval(g, list(keys), ["spread_up", "spread_return"], digits)
