"""Audit of how far the sources of a language drift apart in their words.

Every document becomes an exact sparse vector of term counts, as a count vectorizer makes them: ``vocabulary`` keeps, for each language, the terms in at
least ``min_df`` of its documents, with no limit on their number but the largest integer an index can be. Vocabulary and vectors are rows, not a model
held by the driver and sent to every task, since a vocabulary grows with the corpus. Vectors are added up by group (language, source) like a summarizer
does, with map-side combination, so only one row a term and group leaves a task, however hot a source is.

Pairs of sources are evaluated on the sparse sums: with ``p0`` the smoothed share of a term that a group lacks, the sum over all kept terms is

    sum over own terms of f(p, other's p0) + sum over the other's terms of f(own p0, q) + (V - own - other's) * f(own p0, other's p0)

and, for terms that both have, what the three parts say too much or too little. The first two need only the histogram of a group's counts.

Defined results: null text, lang and source are empty strings; repeated rows and ids count as often as they stand; a group without terms has all counts 0;
a language without kept terms has value 0 in each pair and no term rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, ship, written

ship(__name__)

INT_MAX = 2**31 - 1
_SCALE = 1_000_000_000
_ROWS = 512  # documents whose vectors a task holds at once
_TERM = re.compile(rb"[A-Za-z\x80-\xff]+")  # of UTF-8 bytes: letters A-Z in both cases and all beyond ASCII


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (whole.slice(i, _ROWS) for whole in batches for i in range(0, whole.num_rows, _ROWS)):
        found = [Counter(_TERM.findall(t.as_py().lower())) for t in batch.column("text")]
        terms = pa.array([list(c) for c in found], pa.list_(pa.binary()))
        counts = pa.array([list(c.values()) for c in found], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("source"), terms, counts], ["lang", "source", "terms", "counts"])


def document_vectors(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, terms, counts) for each row: the distinct terms of its whole text and how often each stands there."""
    named = lambda c, name: F.coalesce(col(c).cast("string"), F.lit("")).alias(name)
    rows = docs.select(named(lang_col, "lang"), named(source_col, "source"), named(text_col, "text").cast("binary").alias("text"))
    return rows.mapInArrow(_vectors, "lang string, source string, terms array<binary>, counts array<long>")


def group_sums(vectors: DataFrame) -> DataFrame:
    """(lang, source, term, count, docs): vectors added up by group, and in how many documents each term is."""
    each = vectors.select("lang", "source", F.explode(F.arrays_zip("terms", "counts")).alias("e")).select("lang", "source", F.col("e.terms").alias("term"), F.col("e.counts").alias("n"))
    return each.groupBy("lang", "source", "term").agg(F.sum("n").alias("count"), F.count("*").alias("docs")).withColumn("term", F.col("term").cast("string"))


def vocabulary(sums: DataFrame, min_df: int) -> DataFrame:
    """(lang, term, total) of the terms in at least ``min_df`` documents of the language."""
    return sums.groupBy("lang", "term").agg(F.sum("count").alias("total"), F.sum("docs").alias("df")).filter(F.col("df") >= min_df).drop("df")


def _share(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(scale * (count + 1) / (n + v)) in integers of up to 38 digits."""
    top = F.lit(_SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(19,0)")
    return (F.lit(1) + F.call_function("div", top, (n + v).cast("decimal(20,0)"))).cast("long")


def _drift(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def audit(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_df: int = 3, vocab_size: int = INT_MAX, top: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank): every other source of the language by drift, and the ``top`` terms that a group has in excess of its language.

    More than ``vocab_size`` kept terms in a language are an error, not a cut.
    """
    sums = written(group_sums(document_vectors(docs, text_col=text_col, lang_col=lang_col, source_col=source_col)), "sums")
    kept = written(sums.join(vocabulary(sums, min_df), ["lang", "term"]).select("lang", "source", "term", "count", "total"), "kept")
    of_lang = kept.select("lang", "term", "total").distinct().groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    of_lang = of_lang.withColumn("v", F.when(F.col("v") > vocab_size, F.raise_error(F.lit("more kept terms than vocab_size"))).otherwise(F.col("v")))
    of_group = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"), F.count("*").alias("own"))
    groups = docs.select(*[F.coalesce(col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"))]).distinct()
    groups = groups.join(of_lang, "lang", "left").join(of_group, ["lang", "source"], "left").na.fill(0, ["v", "lang_n", "n", "own"])
    groups = written(groups.withColumn("p0", F.when(F.col("v") > 0, _share(F.lit(0), F.col("n"), F.col("v"))).otherwise(1)), "groups")
    terms = kept.join(groups.select("lang", "source", "v", "n", "lang_n", "p0"), ["lang", "source"])
    terms = terms.select("lang", "source", "term", "p0", _share(F.col("count"), F.col("n"), F.col("v")).alias("p"), _share(F.col("total"), F.col("lang_n"), F.col("v")).alias("q"))
    terms = written(terms, "terms")

    excess = terms.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _drift(F.col("p"), F.col("q")).alias("value"))
    ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    excess = ranked(excess).filter(F.col("rank") <= top)

    levels = terms.groupBy("lang", "source", "p").agg(F.count("*").alias("times"))
    other = groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("other_p0"), F.col("own").alias("other_own"))
    pairs = groups.select("lang", "source", "v", "p0", "own").join(other, "lang").filter("source <> other")
    rest = pairs.select("lang", "source", "other", ((F.col("v") - F.col("own") - F.col("other_own")) * _drift(F.col("p0"), F.col("other_p0"))).alias("value"))
    facing = levels.join(pairs.select("lang", "source", "other", "p0", "other_p0"), ["lang", "source"])
    summed = lambda df, f: df.groupBy("lang", "source", "other").agg(F.sum(f).alias("value"))
    mine = summed(facing, F.col("times") * _drift(F.col("p"), F.col("other_p0")))
    turned = facing.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "times", "p", F.col("other_p0").alias("own_p0"))
    theirs = summed(turned, F.col("times") * _drift(F.col("own_p0"), F.col("p")))
    a = terms.select("lang", "term", "source", "p", "p0")
    both = a.join(terms.select("lang", "term", F.col("source").alias("other"), F.col("p").alias("r"), F.col("p0").alias("r0")), ["lang", "term"]).filter("source < other")

    def shift(p: str, p0: str, r: str, r0: str) -> Column:
        p, p0, r, r0 = map(F.col, (p, p0, r, r0))
        return F.sum(_drift(p, r) - _drift(p, r0) - _drift(p0, r) + _drift(p0, r0))

    both = both.groupBy("lang", "source", "other").agg(shift("p", "p0", "r", "r0").alias("there"), shift("r", "r0", "p", "p0").alias("back"))
    both = both.select("lang", F.inline(F.array(*[F.struct(F.col(x).alias("source"), F.col(y).alias("other"), F.col(v).alias("value")) for x, y, v in (("source", "other", "there"), ("other", "source", "back"))])))
    drift = summed(rest.unionByName(mine).unionByName(theirs).unionByName(both), F.col("value"))
    drift = ranked(drift.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value"))
    return drift.unionByName(excess)
