"""Expected against observed (entity, day) pairs, without making entities x days.

A contract expects every entity on every day; days may be closed for all, and single pairs may be declared absent. Counts are
arithmetic over sums by entity and by day. Where single pairs are the result, an entity's observed and excused days are islands in the numbered
days, and only the gaps between them are filled. Rows with a null entity or day take no part; repeated rows count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..fixtures import rnd
from ..sources.scratch import stored
from .metrics import ranks


def _numbered(days: DataFrame, day: str) -> DataFrame:
    """Each day once, with closed and its place from 1 among all days and among those of its kind: one row a day."""
    d = days.filter(F.col(day).isNotNull()).groupBy(day).agg(F.bool_or("closed").alias("closed"))
    nth = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(day))
    return d.select(day, "closed", nth().alias("place"), nth("closed").alias("nth"))


def _marked(observed: DataFrame, absent: DataFrame, entity: str, day: str) -> DataFrame:
    """Every pair that is observed or declared absent, once, with seen and excused."""
    tag = lambda p, seen: p.select(entity, day, F.lit(seen).alias("seen"), F.lit(not seen).alias("excused"))
    both = tag(observed, True).unionByName(tag(absent, False)).filter(F.col(entity).isNotNull() & F.col(day).isNotNull())
    return both.groupBy(entity, day).agg(F.bool_or("seen").alias("seen"), F.bool_or("excused").alias("excused"))


def completeness(entities: DataFrame, days: DataFrame, observed: DataFrame, absent: DataFrame, entity: str, day: str) -> DataFrame:
    """One row: pairs, required, satisfied, missing_pairs, coverage (1 where nothing is required), missing_<entity>s and missing_<day>s
    (with something required and nothing satisfied), out_of_scope (declared pairs outside entities x days).

    ``days`` has a column closed; observed pairs outside the contract satisfy nothing."""
    e = entities.select(entity).filter(F.col(entity).isNotNull()).distinct()
    d = _numbered(days, day)
    known = e.withColumn("__e", F.lit(True))
    p = _marked(observed, absent, entity, day).join(known, entity, "left").join(d.select(day, "closed"), day, "left")
    p = stored(p.withColumn("inside", F.col("__e").isNotNull() & F.col("closed").isNotNull()).drop("__e"), "pairs")
    live = p.filter("inside and not closed")
    sums = [F.count_if("excused").alias("excused"), F.count_if(F.col("seen") & ~F.col("excused")).alias("satisfied")]
    left = lambda every, key: every.join(live.groupBy(key).agg(*sums), key, "left").fillna(0, ["excused", "satisfied"])
    sizes = F.broadcast(e.agg(F.count("*").alias("n_e")).crossJoin(d.agg(F.count("*").alias("n_d"), F.count_if(~F.col("closed")).alias("n_open"))))  # one row
    gone = lambda key, n: F.count_if((F.col("satisfied") == 0) & (F.col(n) > F.col("excused"))).alias(f"missing_{key}s")
    by_e = left(e, entity).crossJoin(sizes).agg(F.sum("excused").alias("excused"), F.sum("satisfied").alias("satisfied"), gone(entity, "n_open"))
    by_d = left(d.filter("not closed").select(day), day).crossJoin(sizes).agg(gone(day, "n_e"))
    t = by_e.crossJoin(by_d).crossJoin(sizes).crossJoin(p.agg(F.count_if(F.col("excused") & ~F.col("inside")).alias("out_of_scope")))  # one row each
    have = F.coalesce("satisfied", F.lit(0))
    need = F.col("n_e") * F.col("n_open") - F.coalesce("excused", F.lit(0))
    return t.select(
        (F.col("n_e") * F.col("n_d")).alias("pairs"), need.alias("required"), have.alias("satisfied"), (need - have).alias("missing_pairs"),
        rnd(F.coalesce(F.try_divide(have, need), F.lit(1.0)), 4).alias("coverage"), f"missing_{entity}s", f"missing_{day}s", "out_of_scope",
    )


def classify_pairs(entities: DataFrame, days: DataFrame, observed: DataFrame, absent: DataFrame, entity: str, day: str) -> DataFrame:
    """Every expected pair with status OBSERVED, EXPECTED_ABSENCE (declared, or the day is closed) or UNEXPECTED_MISSING.

    Each pair that is observed or declared fills the days up to the entity's next such pair; a start before the first day fills those ahead of it."""
    d = _numbered(days, day).select(day, "closed", "place")
    p = _marked(observed, absent, entity, day).join(d.select(day, "place"), day).select(entity, "place", "seen", "excused")
    start = entities.select(entity).filter(F.col(entity).isNotNull()).distinct().select(entity, F.lit(0).alias("place"), F.lit(False).alias("seen"), F.lit(False).alias("excused"))
    rows = start.unionByName(p.join(start.select(entity), entity, "left_semi"))
    last = F.broadcast(d.agg(F.coalesce(F.max("place"), F.lit(0)).alias("__last")))  # one row
    upto = F.coalesce(F.lead("place").over(Window.partitionBy(entity).orderBy("place")) - 1, F.col("__last"))
    x = rows.crossJoin(last).withColumn("__upto", upto).withColumn("__from", F.greatest("place", F.lit(1))).filter("__from <= __upto")
    x = x.withColumn("at", F.explode(F.sequence("__from", "__upto")))
    own = F.col("at") == F.col("place")
    x = x.select(entity, "at", (own & F.col("seen")).alias("seen"), (own & F.col("excused")).alias("excused")).join(d.withColumnRenamed("place", "at"), "at")
    return x.select(entity, day, F.when(F.col("seen"), "OBSERVED").when(F.col("excused") | F.col("closed"), "EXPECTED_ABSENCE").otherwise("UNEXPECTED_MISSING").alias("status"))


def declared_pairs(entities: DataFrame, days: DataFrame, absent: DataFrame, entity: str, day: str) -> DataFrame:
    """Every declared pair (single ones, and closed days of all entities) with its place i from 0 in the order of entity and day, and its reference.

    Places are counted by ranges of the order; no task holds all pairs."""
    shut = _numbered(days, day).filter("closed").select(day, "nth")
    n = F.broadcast(shut.agg(F.count("*").cast("int").alias("__n")))  # one row
    closed = entities.select(entity).filter(F.col(entity).isNotNull()).distinct().crossJoin(n).filter("__n > 0").select(entity, F.explode(F.sequence(F.lit(1), "__n")).alias("nth")).join(shut, "nth")
    every = closed.select(entity, day).unionByName(absent.select(entity, day).filter(F.col(entity).isNotNull() & F.col(day).isNotNull())).distinct()
    x = ranks(every, [entity], [day]).withColumn("i", F.col(f"r_{entity}").cast("long") - 1)
    return x.select(entity, day, "i", F.concat(F.lit("absences["), F.col("i").cast("string"), F.lit("]")).alias("reference"))
