"""Similarity join on word n-grams by vertical partitioning: the global n-gram order is cut into fragments and overlaps are counted fragment by fragment.

The global order is that of the n-grams' 64-bit hashes; every order is exact, and this one needs no counts of the corpus and gives each fragment about the
same share of every text. A document is the set of its distinct n-grams; documents with equal sets are one node, their links are certain.

Candidates. Sets of sizes a and b that link differ in at most (100 - percent) / (100 + percent) * (a + b) elements. Sizes fall into classes, each as wide as
a link can reach, so partners are in the same class or the next. Where at most k elements can differ, the order is cut into more than k fragments: then in
at least one of them both sets hold the same elements. The digest of a set's part in a fragment is a bucket key; no linking pair shares none. Parts of fewer
than two elements say little: where a set has no more of them than there are spare fragments, they make no key, otherwise they do, so nothing is lost.

Overlaps. Nodes connected by buckets are a family; its hub is the node with the most company. The family's sets are cut into fragments of about 256 elements,
each member's fragments meet the hub's fragments one by one, and the partial overlaps (and what one of both lacks) are summed for each pair of member and hub.
That decides every link with the hub exactly. Members that miss the hub are compared by their differences from it, as ``neardup.links_by_difference`` does:
exactly again, without making the pairs of a family. Nothing is capped, and a family of copies costs one row a member and fragment.

Defined results: null text, empty text and text without words have no n-grams and link with nothing; fewer words than ``width`` make one n-gram of the whole
sequence; rows with one id are one document whose links unite; a row without id links with nothing and keeps a null component; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, discard, grows, ship, written
from .neardup import _GOLD, _digest, _mix, _Words, components, links_by_difference, shingle_set, with_excess

ship(__name__)

PIECE = 256


class Cuts:
    """Classes of set sizes, and how many fragments a class is cut into."""

    def __init__(self, percent: int):
        self.percent, self.first, self.last = percent, [1], []

    def _more(self) -> None:
        self.last.append(self.first[-1] * 100 // self.percent)
        self.first.append(self.last[-1] + 1)

    def of_size(self, n: int) -> int:
        while not self.last or self.last[-1] < n:
            self._more()
        return int(np.searchsorted(self.last, n))

    def fragments(self, group: int) -> tuple[int, int]:
        """(fragments, spare ones) for pairs of the class and the one below; no fragments where only equal sets can link."""
        while len(self.last) <= group:
            self._more()
        k = 2 * self.last[group] * (100 - self.percent) // (100 + self.percent)
        spare = 1 + k // 50 if k >= 8 else 0
        return (k + 1 + spare, spare) if k else (0, 0)


def fragment_keys(s: np.ndarray, cuts: Cuts) -> np.ndarray:
    """The bucket keys of a sorted set: a digest of each of its fragments, for its own size class and the next."""
    keys, own = [], cuts.of_size(len(s))
    for group in (own, own + 1):
        m, spare = cuts.fragments(group)
        if not m:
            continue
        fragment = ((s >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        start = np.flatnonzero(np.r_[True, fragment[1:] != fragment[:-1]])
        label = np.uint64(group << 32) + fragment[start]
        digest = np.add.reduceat(_mix(s), start)
        thick = np.diff(np.r_[start, len(s)]) > 1
        if m - int(thick.sum()) <= spare:
            digest, label = digest[thick], label[thick]
        else:  # too many thin parts: they count too, the empty ones among them
            empty = np.setdiff1d(np.arange(m, dtype=np.uint64), fragment[start])
            digest, label = np.r_[digest, np.zeros(len(empty), np.uint64)], np.r_[label, np.uint64(group << 32) + empty]
        keys.append(_mix(digest + _mix(label * _GOLD + _GOLD)))
    return np.concatenate(keys) if keys else np.empty(0, np.uint64)


def _signatures(width: int, percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache, cuts = _Words(), Cuts(percent)
        np.seterr(over="ignore")
        for pdf in batches:
            sets = [shingle_set(text, width, cache) for text in pdf["text"]]
            digests = [_digest(s) for s in sets]
            keys = [fragment_keys(s, cuts).view(np.int64) if len(s) else np.empty(0, np.int64) for s in sets]
            yield pd.DataFrame({"id": pdf["id"], "n": [len(s) for s in sets], "set_a": [a for a, _ in digests], "set_b": [b for _, b in digests], "keys": keys})

    return run


def _pieces(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = _Words()
        np.seterr(over="ignore")
        for pdf in batches:
            node, family, is_hub, fragment, part = [], [], [], [], []
            for text, a, b, of_node, of_family, hub, cut in zip(*(pdf[c] for c in ("text", "set_a", "set_b", "node", "family", "hub", "cut"))):
                s = shingle_set(text, width, cache)
                if _digest(s) != (a, b):  # an id may stand on several texts
                    continue
                at = np.searchsorted(((s >> np.uint64(32)) * np.uint64(cut)) >> np.uint64(32), np.arange(cut + 1, dtype=np.uint64))
                part += [s[i:j].view(np.int64) for i, j in pairwise(at)]
                node += [of_node] * cut
                family += [of_family] * cut
                is_hub += [of_node == hub] * cut
                fragment += range(cut)
            yield pd.DataFrame({"node": node, "family": family, "is_hub": is_hub, "fragment": fragment, "part": part})

    return run


def hub_overlaps(pieces: DataFrame) -> DataFrame:
    """(family, hub, node, n, hub_n, diff): the overlap of each node with its family's hub, counted by fragment and summed by pair.

    ``pieces`` has node, family, is_hub, fragment and part; rows of repeated ids are the same and count once.
    """
    of_hub = pieces.filter("is_hub").select("family", F.col("node").alias("hub"), "fragment", F.col("part").alias("hub_part"))
    met = pieces.join(grows(of_hub), ["family", "fragment"])
    shared = F.size(F.array_intersect("part", "hub_part")).cast("long")
    lacks = F.concat(F.array_except("part", "hub_part"), F.array_except("hub_part", "part"))
    partial = F.struct("fragment", F.size("part").cast("long").alias("n"), F.size("hub_part").cast("long").alias("hub_n"), shared.alias("shared"), lacks.alias("lacks"))
    found = met.select("family", "hub", "node", partial.alias("partial")).groupBy("family", "hub", "node").agg(F.collect_set("partial").alias("partial"))
    total = lambda c: F.aggregate("partial", F.lit(0).cast("long"), lambda sum_, x: sum_ + x[c]).alias(c)
    return found.select("family", "hub", "node", total("n"), total("hub_n"), total("shared"), F.flatten(F.transform("partial", lambda x: x["lacks"])).alias("diff"))


def similar(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3, percent: int = 90) -> DataFrame:
    """(id, n_shingles, component) for each row: the links are all pairs with 100 * intersection >= percent * union."""
    rows = docs.select(col(id_col).cast("long").alias("id"), col(text_col).alias("text"))
    signed = rows.mapInPandas(_signatures(width, percent), "id long, n int, set_a long, set_b long, keys array<long>")
    sig = written(signed.withColumn("row", F.monotonically_increasing_id()), "signatures")  # row numbers hold from here on
    linked = sig.filter("n > 0 and id is not null").drop("keys")
    classes = linked.groupBy("set_a", "set_b").agg(F.min(F.struct("id", "row", "n")).alias("rep"), F.count("*").alias("rows"))
    classes = written(classes.select("set_a", "set_b", "rows", F.col("rep.id").alias("rep"), F.col("rep.row").alias("node"), F.col("rep.n").alias("n")), "classes")
    keyed = sig.select(F.col("row").alias("node"), F.explode("keys").alias("key"))  # of copies too: what has no company goes before classes are asked
    shared = written(keyed.groupBy("key").agg(F.count("*").alias("rows")).filter("rows > 1").select("key"), "shared")
    met = keyed.join(grows(shared), "key").join(classes.select("node"), "node", "left_semi")
    met = written(met, "met")
    shared = met.groupBy("key").agg(F.min("node").alias("first"), F.count("*").alias("company")).filter("company > 1")
    buckets = written(met.join(shared, "key"), "buckets")
    weights = buckets.groupBy("node").agg(F.sum("company").alias("weight"))
    families = components(buckets.filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct())
    families = written(families.withColumnsRenamed({"id": "node", "component": "family"}).join(weights, "node").join(classes, "node"), "families")
    hubs = families.groupBy("family").agg(F.max(F.struct("weight", "node"))["node"].alias("hub"), F.greatest(F.lit(2), F.ceil(F.max("n") / PIECE)).cast("int").alias("cut"))
    wanted = families.join(hubs, "family").select(F.col("rep").alias("id"), "node", "family", "hub", "set_a", "set_b", "cut")
    pieces = written(rows.join(grows(wanted), "id").mapInPandas(_pieces(width), "node long, family long, is_hub boolean, fragment int, part array<long>"), "pieces")
    nodes = with_excess(hub_overlaps(pieces), percent)
    discard(pieces, met)
    links = links_by_difference(nodes, buckets.join(weights, "node").select("node", "key", "weight"), percent)
    names = classes.select("node", "rep")
    edges = links.join(names.toDF("a", "rep_a"), "a").join(names.toDF("b", "rep_b"), "b").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    copies = linked.join(classes.filter("rows > 1").select("set_a", "set_b", "rep"), ["set_a", "set_b"]).filter("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    of = components(edges.filter("a <> b").unionByName(copies))
    discard(buckets)
    out = sig.select("id", F.col("n").cast("long").alias("n_shingles")).join(of.withColumnRenamed("id", "of_id"), F.col("id") == F.col("of_id"), "left")
    return out.select("id", "n_shingles", F.coalesce("component", "id").alias("component"))
