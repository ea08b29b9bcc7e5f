"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

Each document is the set of its distinct word shingles, as 64-bit hashes. Fast similarity sketching (Dahlgaard,
Knudsen, Thorup 2017) fills ``t`` coordinates in rounds: in round i < t every element falls into a hashed bin with
value (i, hash); in round t + j all elements fall into bin j; each coordinate keeps its smallest value, and the rounds
end when all are filled, so that small sets fill every coordinate too and agreeing coordinates estimate the Jaccard
similarity with concentration bounds. ``bands`` groups of coordinates are bucket keys: with 32 bands of 5, two sets of
similarity 0.8 share no bucket with a probability of 3e-6, and less above.

Documents with equal sets form classes first (their links are certain), so groups of copies cost one row each: a node.
Nodes that share a bucket, directly or through others, are a family. Its links are found without making its pairs:

1. the family's hub is the node with the most company in its buckets, so a central text of a group of near copies. Every
   member keeps its difference from the hub, the elements that one of both lacks, instead of its set: two members differ in
   as many elements as one of their two differences holds and the other does not, so that sizes and differences decide exactly
   whether they link. What links with the hub is one component.
2. the members left over are compared with the most central one left in each of their buckets: groups beside the hub's collapse.
3. a member left over and any other of the family can link only if their differences share a number of elements that their
   sizes give. So they must meet in a prefix of the differences, rarest elements first, at places that leave room for that
   number. The equi-join on family and element with that condition makes few rows, since edits are scattered where texts
   are shared; what it makes is verified.

So every pair of a family is verified, ruled out exactly, or already connected: nothing is capped. Joins are plain equi-joins
whose hot keys AQE can split; components run by pointer jumping over written tables, with fewer edges each round.

Defined results: null text, empty text and text without words have no shingles, link with nothing and stay; fewer words
than the shingle length make one shingle of the whole sequence; rows with the same id are one node whose links unite; a row
without id links with nothing and stays; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, discard, keyed, ship, written

ship(__name__)

BANDS, BAND_ROWS = 32, 5
_CACHE_WORDS = 400_000
_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer (that of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """Hashes of words, kept while they are few."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: str | None, width: int, cache: _Words) -> np.ndarray:
    """Sorted distinct hashes of the shingles; A-Z are lower-cased, words end at ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    width = min(width, len(h))
    acc = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        acc = _mix(acc * _GOLD + h[i : len(h) - width + 1 + i])
    return np.unique(acc)


def sketch(elements: np.ndarray, t: int) -> np.ndarray:
    """``t`` coordinates of a non-empty set; each holds its round and hash."""
    out, filled = np.zeros(t, np.uint64), np.zeros(t, bool)
    done, step = 0, max(1, min(t, int(1.4 * t * np.log(t) / len(elements)) + 1))
    while done < t and not filled.all():
        rounds = np.arange(done, min(t, done + step), dtype=np.uint64)
        h = _mix(elements[None, :] ^ _mix((rounds + np.uint64(1)) * _GOLD)[:, None])
        bins = ((h >> np.uint64(48)) * np.uint64(t)) >> np.uint64(16)  # of the upper bits
        keys = (bins << np.uint64(52)) | (rounds[:, None] << np.uint64(42)) | (h & np.uint64((1 << 42) - 1))
        keys = np.sort(keys, axis=None)
        b = (keys >> np.uint64(52)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
        first = first[~filled[b[first]]]
        out[b[first]] = keys[first] & np.uint64((1 << 52) - 1)
        filled[b[first]] = True
        done += step
    for j in np.flatnonzero(~filled):
        h = _mix(elements ^ _mix(np.uint64(t + int(j) + 1) * _GOLD)) & np.uint64((1 << 42) - 1)
        out[j] = (np.uint64(t + int(j)) << np.uint64(42)) | h.min()
    return out


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    parts = coordinates.reshape(BANDS, BAND_ROWS)
    acc = np.arange(BANDS, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(BAND_ROWS):
            acc = _mix(acc * _GOLD + parts[:, i])
    return acc.view(np.int64)


def _signatures(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = _Words()
        np.seterr(over="ignore")
        for pdf in batches:
            n, a, b, keys = [], [], [], []
            for text in pdf["text"]:
                s = shingle_set(text, width, cache)
                n.append(len(s))
                low, high = _digest(s)
                a.append(low)
                b.append(high)
                keys.append(band_keys(sketch(s, BANDS * BAND_ROWS)) if len(s) else None)
            yield pd.DataFrame({"id": pdf["id"], "n": n, "set_a": a, "set_b": b, "keys": keys})

    return run


def _digest(s: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(s.tobytes())
    return (d & (2**64 - 1)) - 2**63, (d >> 64) - 2**63


def _sets(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = _Words()
        np.seterr(over="ignore")
        for pdf in batches:
            sets = [shingle_set(t, width, cache) for t in pdf["text"]]
            own = np.array([_digest(s) == (a, b) for s, a, b in zip(sets, pdf["set_a"], pdf["set_b"])], bool)  # an id may stand on several texts
            yield pd.DataFrame({"node": pdf["node"][own], "family": pdf["family"][own], "s": [s.view(np.int64) for s, o in zip(sets, own) if o]})

    return run


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over ``edges`` (a, b), for every id in them.

    Each round every node points to its smallest neighbour below it, pointers jump until they reach a node without one, and
    edges are drawn between these ends only; rounds end when no edge is left. So the edges shrink from round to round.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    labels = edges.select(F.col("a").alias("id")).unionByName(edges.select(F.col("b").alias("id"))).distinct().withColumn("component", F.col("id"))
    labels = written(labels, "labels")
    while edges.limit(1).count():
        up = written(edges.groupBy("a").agg(F.min("b").alias("up")), "up")
        while True:
            above = up.select(F.col("a").alias("mid"), F.col("up").alias("top"))
            higher = written(up.join(above, up["up"] == above["mid"], "left").select("a", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved")), "up")
            discard(up)
            up = higher
            if not up.filter("moved").limit(1).count():
                break
        up = up.select("a", "up")
        to = up.withColumnsRenamed({"a": "component", "up": "to_component"})
        new = written(labels.join(to, "component", "left").select("id", F.coalesce("to_component", "component").alias("component")), "labels")
        ends = edges.join(up, "a").select("b", F.col("up").alias("end_a")).join(up.toDF("b", "end_b"), "b", "left").select("end_a", F.coalesce("end_b", "b").alias("end_b"))
        ends = ends.filter("end_a <> end_b").select(F.greatest("end_a", "end_b").alias("a"), F.least("end_a", "end_b").alias("b")).distinct()
        drawn = written(ends, "edges")
        discard(edges, labels, higher)
        edges, labels = drawn, new
    discard(edges)
    return labels


def hub_differences(sets: DataFrame, hubs: DataFrame, percent: int) -> DataFrame:
    """(family, hub, node, diff, excess, apart, least) for each node: the elements that one of it and its family's hub lacks.

    ``sets`` has node, family and s; ``hubs`` the family and its hub. With n elements and a difference of d from the hub, the
    excess is (100 + percent) * d - (100 - percent) * n. Two nodes link if and only if their excesses add up to (100 + percent)
    times twice the size of what their differences share, or less. The hub has no difference and the smallest excess of its family.
    """
    of_hub = sets.join(hubs.select(F.col("hub").alias("node"), "family"), ["node", "family"]).select("family", F.col("node").alias("hub"), F.col("s").alias("hub_s"))
    beside = sets.join(of_hub, "family")
    diff = F.concat(F.array_except("s", "hub_s"), F.array_except("hub_s", "s")).alias("diff")
    return with_excess(beside.select("family", "hub", "node", F.size("s").cast("long").alias("n"), F.size("hub_s").cast("long").alias("hub_n"), diff), percent)


def with_excess(beside: DataFrame, percent: int) -> DataFrame:
    """(family, hub, node, n, hub_n, diff) as the written table that ``links_by_difference`` takes."""
    more, less = 100 + percent, 100 - percent
    beside = beside.select("*", (F.size("diff").cast("long") * more - F.col("n") * less).alias("excess"))
    return written(beside.select("family", "hub", "node", "diff", "excess", (F.col("excess") > F.col("hub_n") * less).alias("apart"), (-F.col("hub_n") * less).alias("least")), "differences")


def links_by_difference(nodes: DataFrame, buckets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between nodes that give the components of all links within each family.

    ``nodes`` are the rows of ``with_excess``; ``buckets`` the node, key and weight of nodes with company.
    """
    more = 100 + percent
    links = nodes.filter("not apart and node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    sides = nodes.select("node", "diff", "excess")

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sides.toDF("a", "diff_a", "excess_a"), "a").join(sides.toDF("b", "diff_b", "excess_b"), "b")
        return both.filter(F.col("excess_a") + F.col("excess_b") <= F.size(F.array_intersect("diff_a", "diff_b")) * (2 * more)).select("a", "b")

    apart = nodes.filter("apart").select("node")
    left = buckets.join(apart, "node")
    middle = left.groupBy("key").agg(F.max(F.struct("weight", "node"))["node"].alias("a"))
    beside_middle = left.join(middle, "key").filter("a <> node").select("a", F.col("node").alias("b")).distinct()
    found = written(verified(beside_middle), "links")
    label = components(found).select(F.col("id").alias("node"), F.col("component"))
    spread = nodes.filter("apart").groupBy("family").agg(F.min("excess").alias("least_apart"))
    open_ = nodes.join(spread, "family").join(label, "node", "left")
    # what a link with the best partner, among all for those apart and among those apart for the others, has to share at least
    partner = F.when(F.col("apart"), F.col("least")).otherwise(F.col("least_apart"))
    share = F.greatest(F.lit(1), F.ceil((F.col("excess") + partner) / (2 * more)))
    home = F.when(F.col("apart"), F.coalesce("component", "node")).otherwise(F.col("hub"))
    open_ = written(open_.select("family", "node", "diff", "excess", "apart", share.alias("share"), home.alias("home")).filter(F.size("diff") >= F.col("share")), "open")
    parts = open_.select("family", "node", F.explode("diff").alias("x"))
    common = parts.groupBy("family", "x").agg(F.count("*").alias("df")).filter("df > 1")
    ranked = parts.join(common, ["family", "x"]).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "x"))).alias("ranked"))
    ranked = ranked.join(open_.drop("diff"), "node").withColumn("size", F.size("ranked")).filter("size >= share")
    place = F.posexplode(F.expr("slice(ranked, 1, cast(size - share + 1 as int))")).alias("place", "e")
    ahead = ranked.select("family", "node", "excess", "apart", "home", "size", place)
    ahead = written(ahead.select("family", "node", "excess", "apart", "home", (F.col("size") - F.col("place")).alias("room"), F.col("e.x").alias("x")), "prefixes")
    a, b = ahead.filter("apart").alias("a"), ahead.alias("b")
    meet = (F.col("a.family") == F.col("b.family")) & (F.col("a.x") == F.col("b.x")) & (F.col("a.home") != F.col("b.home")) & (~F.col("b.apart") | (F.col("a.node") < F.col("b.node")))
    meet = meet & (F.col("a.excess") + F.col("b.excess") <= F.least("a.room", "b.room") * (2 * more))
    rest = a.join(b, meet).select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct()
    return links.unionByName(found).unionByName(verified(rest))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component) for each row: the links are all pairs with 100 * intersection >= percent * union."""
    rows = docs.select(col(id_col).cast("long").alias("id"), col(text_col).alias("text"))
    sig = written(rows.mapInPandas(_signatures(shingle), "id long, n int, set_a long, set_b long, keys array<long>"), "signatures")
    linked = sig.filter("n > 0 and id is not null")
    classes = linked.groupBy("set_a", "set_b").agg(F.min("id").alias("rep"), F.count("*").alias("rows"), F.first("keys").alias("keys"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")  # node numbers hold from here on
    keyed = classes.select("node", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("node").alias("first"), F.count("*").alias("company")).filter("company > 1")
    buckets = written(keyed.join(shared, "key"), "buckets")  # only rows of buckets with company
    weights = buckets.groupBy("node").agg(F.sum("company").alias("weight"))
    families = components(buckets.filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")))
    families = written(families.withColumnsRenamed({"id": "node", "component": "family"}).join(weights, "node"), "families")
    hubs = families.groupBy("family").agg(F.max(F.struct("weight", "node"))["node"].alias("hub"))
    wanted = families.join(classes, "node").select(F.col("rep").alias("id"), "node", "family", "set_a", "set_b")
    sets = rows.join(wanted, "id").mapInPandas(_sets(shingle), "node long, family long, s array<long>")
    sets = written(sets.dropDuplicates(["node"]), "sets")
    links = links_by_difference(hub_differences(sets, hubs, percent), buckets.join(weights, "node").select("node", "key", "weight"), percent)
    # nodes back to ids: rows of one class, and rows with one id, are one
    names = classes.select("node", "rep")
    edges = links.join(names.toDF("a", "rep_a"), "a").join(names.toDF("b", "rep_b"), "b").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    with_rep = linked.join(classes.filter("rows > 1").select("set_a", "set_b", "rep"), ["set_a", "set_b"]).filter("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    of = components(edges.filter("a <> b").unionByName(with_rep))
    discard(sets, buckets)
    out = sig.select("id", F.col("n").cast("long").alias("n_shingles")).join(of.withColumnRenamed("id", "of_id"), F.col("id") == F.col("of_id"), "left")
    return out.select("id", "n_shingles", F.coalesce("component", "id").alias("component"))


def keep_first(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the rows whose id is not the smallest of its component; rows that repeat one id all stay.

    A row without id has a number of its own above all ids here, so a copy of a document with an id goes, and of copies without id one stays.
    """
    rows = keyed(docs, id_col)
    found = near_duplicates(rows.select("key", col("row")[text_col].alias("text")), id_col="key", text_col="text", shingle=shingle, percent=percent)
    gone = found.filter("id <> component").select(F.col("id").alias("key")).distinct()
    return rows.join(gone, "key", "left_anti").select("row.*")
