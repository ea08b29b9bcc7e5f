"""Benchmark decontamination: a BM25 index of test items, searched with every training passage by block-max WAND.

Words are runs of letters, digits and underscores, lower-cased. The index holds, for each word, the BM25 impacts of
the items that have it, divided by the score of the item against itself, so that 1 means a passage with all words of an item.
Items stand in blocks, and each word keeps its largest impact in each block, in groups of blocks, and over all. Every document is
cut into overlapping passages, long enough that an item lies whole in one. A passage whose words' largest impacts together stay below
``threshold`` is skipped; of the others, the groups of blocks whose bound (the sum of the words' largest impacts there, taken for many
passages at once) stays below it, and of the rest the blocks. Only blocks whose own bound reaches it are opened, and every item
at or above the threshold is retrieved.
A retrieved item counts as leaked if its question and its answer are both there
around any of the passages it was retrieved for: at least ``overlap`` of the word trigrams of each occur there. Question and answer are the parts before and
after the last question mark or line break, or the first two thirds and the rest of the words.

The index is bounded: about ``index_items`` items of ``index_words`` words at a time are broadcast; more are taken in several passes over the
documents. Document frequencies, mean length and the longest item are those of all items, so rows and scores do not depend on the passes.

Defined results: null and empty texts and items match nothing; items of equal text each match; a document yields one row for
each leaked item (the best-scoring passage of those that hold it); a null id gives a null id; other columns are ignored.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cached_property
from itertools import chain, repeat
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, keyed, ship, written

ship(__name__)

_WORD = re.compile(r"\w+")
K1, B, BLOCK_ITEMS, STEP, PASSAGES = 1.2, 0.75, 4, 150_000, 512
GROUPS, GROUP_CELLS = 128, 1 << 24
CELLS = 1 << 24  # single-precision bounds that a task looks at together
_SCHEMA = "id long, item_id long, score double, question_overlap double, answer_overlap double"


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def trigrams(ws: list[str]) -> set[tuple[str, ...]]:
    n = min(3, len(ws))
    return {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} if ws else set()


def parts(text: str) -> tuple[list[str], list[str]]:
    """The words of the question and of the answer."""
    cut = max(text.rstrip().rfind("?"), text.rstrip().rfind("\n"))
    question, answer = words(text[: cut + 1]), words(text[cut + 1 :])
    if not question or len(answer) < 3:
        every = words(text)
        cut = -(-2 * len(every) // 3)
        question, answer = every[:cut], every[cut:]
    return question, answer


class Stats(NamedTuple):
    """Of all items of a benchmark that have words: how many, their words, the longest one's, and how many items hold each word."""

    n: int
    size: int
    longest: int
    df: dict[str, int]


class Index:
    def __init__(self, items: list[tuple[int, str]], stats: Stats | None = None):
        """``stats``: of the whole benchmark, with the words of ``items`` at least in ``df``; without it ``items`` are the whole."""
        self.items = [(i, t) for i, t in items if words(t)]
        counts = [Counter(words(t)) for _, t in self.items]
        sizes = [sum(c.values()) for c in counts]
        held = Counter(w for c in counts for w in c)  # of these items
        n, size, self.longest, df = stats or Stats(len(counts), sum(sizes), max(sizes, default=1), held)
        df = {w: df[w] for w in held}
        mean = size / max(1, n)
        self.place = {w: k for k, w in enumerate(sorted(df))}
        idf = {w: math.log(1 + (n - d + 0.5) / (d + 0.5)) for w, d in df.items()}
        entries = []
        for k, c in enumerate(counts):
            size = sum(c.values())
            impact = {w: idf[w] * f * (K1 + 1) / (f + K1 * (1 - B + B * size / mean)) for w, f in c.items()}
            whole = sum(impact.values())
            entries += [(self.place[w], k, x / whole) for w, x in impact.items()]
        entries.sort()
        word, self.item = np.array([e[0] for e in entries], np.int64), np.array([e[1] for e in entries], np.int64)
        self.impact = np.array([e[2] for e in entries], np.float64)
        self.blocks = -(-len(counts) // BLOCK_ITEMS) or 1
        self.keys, first = np.unique(word * self.blocks + self.item // BLOCK_ITEMS, return_index=True)  # a word in a block
        self.first = np.r_[first, len(entries)]
        self.bound = np.maximum.reduceat(self.impact, first) if len(entries) else np.zeros(0)
        self.per_group = -(-self.blocks // max(1, min(GROUPS, GROUP_CELLS // (len(df) + 1))))  # blocks in a group
        self.groups = np.zeros((len(df) + 1, -(-self.blocks // self.per_group)), np.float32)
        np.maximum.at(self.groups, (word, self.item // BLOCK_ITEMS // self.per_group), self.impact.astype(np.float32))
        self.most = self.groups.max(axis=1)

    @cached_property
    def qa(self) -> dict[int, tuple[set, set]]:
        return {}

    def question_answer(self, item: int) -> tuple[set, set]:
        if item not in self.qa:
            self.qa[item] = tuple(map(trigrams, parts(self.items[item][1])))
        return self.qa[item]

    def at(self, ws: np.ndarray, block) -> tuple[np.ndarray, np.ndarray]:
        """Where words stand in a block, and whether they do."""
        key = ws * self.blocks + block
        at = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
        return at, (self.keys[at] == key) & (ws < len(self.place))

    def candidates(self, passages: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """(passage, block) whose bounds reach the threshold; a row is a passage of distinct word places, rising, the number of words for none."""
        least = threshold - 1e-4  # groups are single precision
        passages = passages[:, : int((passages < len(self.place)).sum(axis=1).max(initial=0))]
        rows = np.flatnonzero(self.most[passages].sum(axis=1) >= least)
        step, found = max(1, CELLS // (passages.shape[1] * self.groups.shape[1] or 1)), []
        for i in range(0, len(rows), step):  # passages of a long item's width are many cells each
            p, group = np.nonzero(self.groups[passages[rows[i : i + step]]].sum(axis=1) >= least)
            found.append((rows[i + p], group))
        p, group = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
        if self.per_group == 1 or not len(p):
            return p, group
        block = (group[:, None] * self.per_group + np.arange(self.per_group)).ravel()
        p = np.repeat(p, self.per_group)[block < self.blocks]
        block = block[block < self.blocks]
        fit = np.zeros(len(p), bool)
        for i in range(0, len(p), 4096):
            at, held = self.at(passages[p[i : i + 4096]], block[i : i + 4096, None])
            fit[i : i + 4096] = np.where(held, self.bound[at], 0).sum(axis=1) >= least
        return p[fit], block[fit]

    def opened(self, passage: np.ndarray, block: int, threshold: float) -> list[tuple[int, float]]:
        """The items of a block at or above the threshold, for a passage's distinct words in order, so that sums are the same in any index."""
        at, held = self.at(passage, block)
        score: dict[int, float] = defaultdict(float)
        for x in at[held].tolist():
            for e in range(self.first[x], self.first[x + 1]):
                score[int(self.item[e])] += float(self.impact[e])
        return [(k, s) for k, s in score.items() if s >= threshold - 1e-9]


def _search(shared, threshold: float, overlap: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index: Index = pickle.loads(shared.value)  # with its class
        width = 2 * max(index.longest, 32)
        none = len(index.place)

        def find(docs: list[tuple]) -> list[tuple]:
            ids = np.fromiter(chain.from_iterable(map(index.place.get, ws, repeat(none)) for _, ws in docs), np.int32)
            starts, ends, owner, at = [], [], [], 0
            for d, (_, ws) in enumerate(docs):
                own = np.arange(0, max(1, len(ws) - width // 2), width // 2)
                starts.append(at + own)
                ends.append(np.minimum(at + own + width, at + len(ws)))
                owner.append(np.full(len(own), d))
                at += len(ws)
            begin = np.cumsum([0] + [len(ws) for _, ws in docs])
            starts, ends, owner = np.concatenate(starts), np.concatenate(ends), np.concatenate(owner)
            retrieved: dict[tuple[int, int], list[tuple[float, int]]] = defaultdict(list)
            for i in range(0, len(starts), PASSAGES):
                places = starts[i : i + PASSAGES, None] + np.arange(width)
                rows = np.where(places < ends[i : i + PASSAGES, None], ids[np.minimum(places, len(ids) - 1)], none)
                rows.sort(axis=1)
                rows[:, 1:][rows[:, 1:] == rows[:, :-1]] = none
                rows.sort(axis=1)  # none last
                for k, block in zip(*(x.tolist() for x in index.candidates(rows, threshold))):
                    for item, score in index.opened(rows[k], block, threshold):
                        retrieved[int(owner[i + k]), item].append((-score, int(starts[i + k] - begin[owner[i + k]])))
            out = []
            for (d, item), passages in retrieved.items():
                doc, ws = docs[d]
                question, answer = index.question_answer(item)
                for score, start in sorted(passages):
                    around = trigrams(ws[max(0, start - width) : start + 2 * width])
                    q, a = (len(x & around) / len(x) if x else 1.0 for x in (question, answer))
                    if q >= overlap and a >= overlap:
                        out.append((doc, index.items[item][0], round(-score, 9), q, a))
                        break
            return out

        for pdf in batches:
            found, docs, size = [], [], 0
            for doc, text in zip(pdf["id"], pdf["text"]):
                ws = words(text)
                if ws:
                    docs.append((doc, ws))
                    size += len(ws)
                if size >= STEP:
                    found += find(docs)
                    docs, size = [], 0
            if docs:
                found += find(docs)
            yield pd.DataFrame(found, columns=["id", "item_id", "score", "question_overlap", "answer_overlap"]).astype({"id": "Int64", "item_id": "Int64"})

    return run


def _item_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for each distinct word of an item, and one with a null word and the item's size."""
    for pdf in batches:
        rows: list[tuple[str | None, int]] = []
        for text in pdf["t"]:
            if ws := words(text):
                rows.append((None, len(ws)))
                rows += [(w, 1) for w in set(ws)]
        yield pd.DataFrame(rows, columns=["w", "size"])


def leaks(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    threshold: float = 0.6, overlap: float = 0.5, index_items: int = 16_384, index_words: int = 2_000_000,
) -> DataFrame:
    """id, item_id, score, question_overlap and answer_overlap of every leaked item in every document."""
    rows = docs.select(col(id_col).cast("long").alias("id"), col(text_col).alias("text")).filter("text is not null")
    items = benchmark.select(col(item_col).cast("long").alias("i"), col(item_text_col).alias("t")).filter("i is not null and t is not null").distinct()
    spaces = F.length("t") - F.length(F.translate("t", " \t\n", ""))
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(spaces + 1), F.lit(0))).first()
    passes = max(1, -(-n // index_items), -(-size // index_words))
    of = lambda part: part.mapInPandas(_item_words, "w string, size long")
    if passes > 1:
        whole = of(items).filter("w is null").agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("size"), F.lit(1))).first()
        df = written(of(items).filter("w is not null").groupBy("w").agg(F.count("*").alias("df")), "item-words")
    out = None
    for k in range(passes):
        chunk, stats = items, None
        if passes > 1:
            chunk = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(passes)) == k)
            stats = Stats(*whole, {r["w"]: r["df"] for r in df.join(of(chunk).select("w").distinct(), "w").collect()})
        index = Index(sorted((r["i"], r["t"]) for r in chunk.collect()), stats)
        shared = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(index))
        found = rows.mapInPandas(_search(shared, threshold, overlap), _SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out


def drop_leaked(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", **how) -> DataFrame:
    """``docs`` without the documents that hold a leaked item; a row with a null id stands for itself alone."""
    text_col = how.pop("text_col", "text")
    rows = keyed(docs, id_col)
    found = leaks(rows.select("key", col("row")[text_col].alias("text")), benchmark, id_col="key", text_col="text", **how).select(F.col("id").alias("key")).distinct()
    return rows.join(found, "key", "left_anti").select("row.*")
