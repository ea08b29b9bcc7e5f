"""Language identification with word-first backoff.

Training counts words by language over labelled texts (Spark counts; a sample of ``sample_rows`` distinct texts a language
as expected number, chosen by a hash of the text, each taught once however often it repeats) and character n-grams of
orders ``orders`` over those words. A text is scored by its words: a known word adds its log frequency in each language; an
unseen word backs off to its longest n-grams of which at least one is known, and adds their mean log frequency, weighed
by ``BACKOFF`` once for each order down to it, so that shorter evidence decides less. Languages are compared by the sum.

The model is bounded: ``words`` words and ``grams`` n-grams of each order for each language, the most frequent ones, ties by
code point; it is broadcast. Words beyond them are seldom and are scored by their n-grams.

Words are runs of letters (``str.isalpha``; signs for numbers such as superscripts are none), lower-cased. Defined results: a null text, or one without a
letter, is ``und`` with score 0; ties go to the first language in code-point order; rows with a null text or language teach
nothing; with nothing to learn from every row is ``und``; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, ship, written

ship(__name__)

_RUNS = re.compile(r"[^\W\d_]+")
_CACHE_WORDS, _CACHE_CHARS = 200_000, 10_000_000
BACKOFF = 0.4


def runs_of(text: str) -> list[str]:
    """Runs of letters, and of letters with number signs, which ``letters_of`` takes apart."""
    return _RUNS.findall(text.lower())


def letters_of(run: str) -> list[str]:
    return [run] if run.isalpha() else "".join(c if c.isalpha() else " " for c in run).split()


def words_of(text: str) -> Counter:
    total: Counter = Counter()
    for run, n in Counter(runs_of(text)).items():
        for w in letters_of(run):
            total[w] += n
    return total


def grams_of(word: str, n: int) -> list[str]:
    """n-grams of the whole word between marks."""
    padded = f"\u0002{word}\u0003"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for lang, texts in pdf.groupby("lang")["text"]:
            total: Counter = Counter()
            for t in texts:
                total.update(words_of(t))
            if total:
                yield pd.DataFrame({"lang": lang, "word": list(total), "n": list(total.values())})


def _count_grams(orders: tuple[int, ...]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            total: Counter = Counter()
            for lang, word, n in pdf.itertuples(index=False):
                for k in orders:
                    for g in grams_of(word, k):
                        total[lang, k, g] += n
            yield pd.DataFrame([(a, b, c, n) for (a, b, c), n in total.items()], columns=["lang", "k", "gram", "n"])

    return run


class Model:
    """Log frequencies by language of known words and n-grams."""

    def __init__(self, langs: list[str], words: dict, grams: dict[int, dict]):
        self.langs, self.words, self.grams = langs, words, grams

    def evidence(self, run: str) -> tuple[int, np.ndarray]:
        """How many words a run holds, and what they add to each language."""
        words = letters_of(run)
        return len(words), sum((self.words[w] if w in self.words else self._backoff(w) for w in words), np.zeros(len(self.langs)))

    def _backoff(self, w: str) -> np.ndarray:
        for step, (k, table) in enumerate(self.grams.items(), 1):
            hits = [table[g] for g in grams_of(w, k) if g in table]
            if hits:
                return np.mean(hits, axis=0, dtype=np.float64) * BACKOFF**step
        return np.zeros(len(self.langs))


class Scorer(dict):
    """Scores texts: runs to rows of one matrix, which also keeps unseen runs until they are many."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.start = model, True

    def _reset(self) -> None:
        self.clear()
        self.update({w: i for i, w in enumerate(self.model.words)})
        self.known, self.chars, self.start = len(self), 0, False
        self.rows = np.zeros((self.known + 4096, len(self.model.langs) + 1))  # the last column counts words
        if self.known:
            self.rows[: self.known, :-1] = list(self.model.words.values())
            self.rows[: self.known, -1] = 1

    def __missing__(self, run: str) -> int:
        i = self[run] = len(self)
        if i >= len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        n, logs = self.model.evidence(run)
        self.rows[i, :-1], self.rows[i, -1] = logs, n
        self.chars += len(run)
        return i

    def predict(self, text: str | None) -> tuple[str, float]:
        runs = runs_of(text or "")
        if not runs or not self.model.langs:
            return "und", 0.0
        if self.start or len(self) > self.known + _CACHE_WORDS or self.chars > _CACHE_CHARS:
            self._reset()
        at = np.fromiter(map(self.__getitem__, runs), np.int64, len(runs))
        total = self.rows.take(at, axis=0).sum(axis=0) if len(at) < 100_000 else np.bincount(at, minlength=len(self)) @ self.rows[: len(self)]
        if not total[-1]:
            return "und", 0.0
        total = total[:-1]
        p = np.exp(total - total.max())
        best = int(np.argmax(total))
        return self.model.langs[best], float(p[best] / p.sum())


def _tables(rows: pd.DataFrame, key: str, langs: list[str]) -> dict[str, np.ndarray]:
    """Smoothed log frequencies: an entry absent in a language counts a half."""
    if rows.empty:
        return {}
    at = {x: i for i, x in enumerate(langs)}
    keys = {k: i for i, k in enumerate(sorted(rows[key].unique()))}
    counts = np.zeros((len(keys), len(langs)))
    np.add.at(counts, (rows[key].map(keys).to_numpy(), rows["lang"].map(at).to_numpy()), rows["n"].to_numpy())
    logs = np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * len(keys))).astype(np.float32)
    return {k: logs[i] for k, i in keys.items()}


def train(labelled: DataFrame, *, text_col: str = "text", lang_col: str = "lang", sample_rows: int = 5000, words: int = 20_000, grams: int = 10_000, orders: tuple[int, ...] = (4, 3, 2, 1)) -> Model:
    rows = labelled.select(col(text_col).alias("text"), col(lang_col).alias("lang")).filter("text is not null and lang is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], {}, {})
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, sample_rows / n))]), F.col("lang"))
    sample = rows.filter(F.pmod(F.xxhash64("text"), F.lit(2**30)) < share * 2**30).dropDuplicates(["lang", "text"])
    counted = sample.mapInPandas(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counted = written(counted, "words")

    def most(df: DataFrame, by: list[str], key: str, k: int) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), key))
        return df.withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank")

    word_rows = most(counted, ["lang"], "word", words).toPandas()
    gram_rows = counted.mapInPandas(_count_grams(orders), "lang string, k int, gram string, n long").groupBy("lang", "k", "gram").agg(F.sum("n").alias("n"))
    gram_rows = most(gram_rows, ["lang", "k"], "gram", grams).toPandas()
    return Model(langs, _tables(word_rows, "word", langs), {k: _tables(gram_rows[gram_rows["k"] == k], "gram", langs) for k in orders})


def identify(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """Each document's other columns as struct ``row``, with lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.words, model.grams))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Scorer(Model(*shared.value))
        for pdf in batches:
            found = [m.predict(t) for t in pdf["text"]]
            yield pd.DataFrame({"row": pdf["row"], "lang_pred": [f[0] for f in found], "score": [f[1] for f in found]})

    rest = docs.select(F.struct(*[col(c) for c in docs.columns if c != text_col]).alias("row"), col(text_col).alias("text"))
    return rest.mapInPandas(run, T.StructType([rest.schema["row"]]).add("lang_pred", "string").add("score", "double"))
