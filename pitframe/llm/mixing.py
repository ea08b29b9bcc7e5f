"""Mixing sources to target weights, with DataFrame functions only.

Tokens (words) are summed for each source, the target of each source is its share of the mix, limited to ``cap``
times what the source holds, and the repetition rate is target / tokens. A document is taken floor(rate) times, and once
more by a draw with the probability of the rate's fraction, seeded by a hash of its id.

Draws of one source are made so that its taken words come near its target, however few or long its documents are: the
documents with more than 1 / ``LONG`` of the source's words (fewer than ``LONG`` of them) are drawn one after another,
the longest first, each with the probability (words still due) / (words still open), and all others with what that
quotient is in the end. The quotient stays the same in expectation at each step, so that every document keeps the rate's
fraction as its own probability (but where the quotient leaves 0 to 1), and what is left is the sampling error of the short ones.

Defined results: a null or empty text has size 0; a null source is a source of its own, the last in order; a
source without words has target 0 and rate 0; an empty table gives an empty result; rows with the same id and size share
one draw (a null id draws as the text ``null``); other columns pass through whatever their names are. The table of sources
has one row for each and meets in one task to be ordered; it is meant for up to some millions of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, col, packed, small_side, written

#: Sources are broadcast up to this many, each with fewer than LONG ids; beyond it the join shuffles and AQE splits hot sources.
BROADCAST_SOURCES = 10_000
LONG = 200


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(key: Column, seed: int) -> Column:
    """A number in [0, 1) fixed by key and seed."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """source, source_size, weight, target and rate for each source of ``sizes`` (source, size).

    Weights repeat over the sources in code-point order, null last. The mix has ``share`` times all words. With
    every target min(cap * size, level * weight), the level is the largest (rest of the mix) / (rest of the weights)
    after giving the first k sources, ordered by cap * size / weight, their caps: what reshaping the excess again
    and again ends at. Only one row for each source meets in these windows.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("nth", nth).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("nth") % len(weights) + 1))
    per = per.withColumn("most", F.col("source_size") * F.lit(float(cap)))
    whole = Window.partitionBy()
    before = Window.orderBy(F.col("most") / F.col("weight"), "nth").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    rest = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per = per.withColumn("level", left / rest).withColumn("level", F.max("level").over(whole))
    per = per.withColumn("target", F.least("most", F.col("level") * F.col("weight")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return per.select("source", "source_size", "weight", "target", rate.alias("rate"))


def mix_plan(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 17,
) -> DataFrame:
    """Every document as struct ``row`` with source_size, target, rate, size and ``copies``, how often the mix takes it."""
    key = F.coalesce(col(id_col).cast("string"), F.lit("null"))
    rows = docs.select(packed(docs).alias("row"), key.alias("key"), col(source_col).alias("source"), word_count(col(text_col)).alias("size"))
    per = written(source_targets(rows.select("source", "size"), weights, share, cap), "mix-sources")
    long = F.col("size") * LONG > F.col("source_size")
    of = lambda table: small_side(table, BROADCAST_SOURCES).withColumnRenamed("source", "of_source")
    same = F.col("source").eqNullSafe(F.col("of_source"))
    few = rows.select("key", "source", "size").join(of(per.select("source", "source_size")), same).filter(long)
    few = few.groupBy("source", "key", "size").agg(F.count("*").alias("n"))
    few = few.groupBy("source").agg(F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("minus"), draw(F.col("key"), seed).alias("u"), "key", "n"))).alias("few"))
    due = F.col("target") - F.floor("rate") * F.col("source_size")
    start = F.struct(due.alias("due"), F.col("source_size").cast("double").alias("open"), F.lit([]).cast("array<string>").alias("took"))

    def step(state: Column, x: Column) -> Column:
        size = (x["n"] * -x["minus"]).cast("double")
        took = x["u"] < state["due"] / state["open"]
        name = F.concat_ws(":", -x["minus"], x["key"])
        return F.struct(
            F.when(took, state["due"] - size).otherwise(state["due"]).alias("due"), (state["open"] - size).alias("open"),
            F.when(took, F.concat(state["took"], F.array(name))).otherwise(state["took"]).alias("took"),
        )

    per = per.join(few.withColumnRenamed("source", "of_source"), same, "left").drop("of_source")
    per = per.withColumn("end", F.aggregate(F.coalesce("few", F.lit([]).cast(few.schema["few"].dataType)), start, step))
    short_rate = F.when(F.col("end.open") > 0, F.col("end.due") / F.col("end.open")).otherwise(0.0)
    per = written(per.select("source", "source_size", "target", "rate", short_rate.alias("short_rate"), F.col("end.took").alias("took")), "mix-draws")
    taken = F.when(long, F.array_contains("took", F.concat_ws(":", "size", "key"))).otherwise(draw(F.col("key"), seed) < F.col("short_rate"))
    joined = rows.join(of(per), same, "left")
    return joined.select("row", "size", "source_size", "target", "rate", (F.floor("rate") + taken.cast("long")).alias("copies"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each document as many times as the plan takes it, columns as before."""
    taken = mix_plan(docs, **how).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
