"""Toxicity by a classifier chain of linear models.

The categories are predicted one after another (here low quality, then toxic: the labelled ones), each by a logistic
regression on the words of the text and on the probabilities of the categories before it. While training, those
probabilities are out-of-fold: each comes from a model that did not see the row. Words are runs of letters and digits,
lower-cased; the vocabulary is the words that at least ``min_docs`` sampled documents hold, so no two words share a feature.

Training takes a bounded sample of the labelled rows (``sample_rows``, by a hash of the id, documented here as the
bound); it is the only side that is broadcast. Scoring is one pass over all documents, without a shuffle.

Defined results: a null text is an empty one; a label row with a null id or label teaches nothing; an id with several labels
counts as its largest; a category with one class only is predicted by its rate; without labels all probabilities are 0; rows
with equal text get equal results; other columns are carried along as ``row``.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, packed, written

WORDS = r"[^\p{L}\p{N}]+"


#: Besides whole words, their first letters in these lengths are features, for stems with endings not seen in training.
STEMS = (4, 6)


def tokens(text: Column) -> Column:
    words = F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), WORDS))
    stems = [F.array_distinct(F.transform(F.filter(words, lambda w: F.length(w) > n), lambda w: F.concat(F.substring(w, 1, n), F.lit("-")))) for n in STEMS]
    return F.concat(words, *stems)


class Chain:
    """Vocabulary, and for each category its name and model (a number where one class only was seen)."""

    def __init__(self, vectors: CountVectorizerModel | None, models: list[tuple[str, object]]):
        self.vectors, self.models = vectors, models

    def score(self, df: DataFrame) -> DataFrame:
        """``df`` (with ``tokens``) with column p_<category> for each category."""
        if self.vectors is None:
            return df.withColumns({f"p_{c}": F.lit(0.0) for c, _ in self.models})
        df = self.vectors.transform(df)
        names: list[str] = []
        for c, model in self.models:
            df = _predict(df, model, names, f"p_{c}")
            names.append(f"p_{c}")
        return df


def _predict(df: DataFrame, model, before: list[str], name: str) -> DataFrame:
    if isinstance(model, float):
        return df.withColumn(name, F.lit(model))
    df = VectorAssembler(inputCols=["words", *before], outputCol="x").transform(df)
    df = model.transform(df).withColumn(name, F.round(vector_to_array("probability")[1], 6))
    return df.drop("x", "raw", "probability", "prediction")


def _fit(df: DataFrame, before: list[str], category: str, regularisation: float):
    n, positive = df.agg(F.count("*"), F.sum(category)).first()
    if not n or positive in (None, 0, n):
        return float((positive or 0) / n) if n else 0.0
    df = VectorAssembler(inputCols=["words", *before], outputCol="x").transform(df)
    kind = LogisticRegression(featuresCol="x", labelCol=category, rawPredictionCol="raw", regParam=regularisation, elasticNetParam=0.1, maxIter=25, tol=1e-4)
    return kind.fit(df)


def train(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", categories: dict[str, Column] | None = None,
    sample_rows: int = 12_000, folds: int = 3, vocabulary: int = 20_000, min_docs: int = 5, regularisation: float = 0.002,
) -> Chain:
    categories = categories or {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")}
    names = list(categories)
    marks = labels.select(col(id_col).alias("id"), *[c.cast("double").alias(k) for k, c in categories.items()]).na.drop()
    marks = marks.groupBy("id").agg(*[F.max(k).alias(k) for k in names])
    n = marks.count()
    if not n:
        return Chain(None, [(k, 0.0) for k in names])
    some = marks.filter(F.pmod(F.xxhash64("id"), F.lit(2**30)) < min(1.0, sample_rows / n) * 2**30)
    texts = docs.select(col(id_col).alias("id"), col(text_col).alias("text")).join(F.broadcast(some.select("id")), "id")
    texts = texts.groupBy("id").agg(F.min("text").alias("text")).join(F.broadcast(some), "id")  # an id on several documents teaches its least text
    rows = written(texts.withColumn("tokens", tokens(F.col("text"))).drop("text").withColumn("fold", F.pmod(F.xxhash64(F.lit(11), "id"), F.lit(folds))), "labelled").cache()
    if not rows.count():
        return Chain(None, [(k, 0.0) for k in names])
    vectors = CountVectorizer(inputCol="tokens", outputCol="words", vocabSize=vocabulary, minDF=min(min_docs, rows.count()), binary=True).fit(rows)
    ready = written(vectors.transform(rows).drop("tokens"), "vectors").cache()
    models, before = [], []
    for k, c in enumerate(names):
        models.append((c, _fit(ready, before, c, regularisation)))
        if k + 1 < len(names):  # out-of-fold probabilities for the categories that follow
            unseen = None
            for f in range(folds):
                model = _fit(ready.filter(F.col("fold") != f), before, c, regularisation)
                part = _predict(ready.filter(F.col("fold") == f), model, before, f"p_{c}")
                unseen = part if unseen is None else unseen.unionByName(part)
            older, ready = ready, written(unseen, "unseen").cache()
            older.unpersist()
            before.append(f"p_{c}")
    rows.unpersist()
    ready.unpersist()
    return Chain(vectors, models)


def predict(docs: DataFrame, chain: Chain, *, text_col: str = "text") -> DataFrame:
    """Each document as struct ``row`` with p_<category> for each category."""
    ready = docs.select(packed(docs).alias("row"), tokens(col(text_col)).alias("tokens"))
    return chain.score(ready).select("row", *[f"p_{c}" for c, _ in chain.models])


def drop_toxic(docs: DataFrame, labels: DataFrame, *, least: float = 0.35, **how) -> DataFrame:
    """``docs`` without the documents whose probability of the last category, toxic, is ``least`` or more."""
    chain = train(docs, labels, **how)
    last = f"p_{chain.models[-1][0]}"
    return predict(docs, chain, text_col=how.get("text_col", "text")).filter(F.col(last) < least).select("row.*")
