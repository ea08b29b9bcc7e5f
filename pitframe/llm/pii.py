r"""Personal data by weak supervision, with DataFrame functions only.

Candidates of four kinds (email, ip, card, phone) are matched in whole texts: the base patterns of the contract, and
wider ones (``name (at) host dot org``, IPv6, card numbers in other groupings, phone numbers without ``+``). Four
labelers vote on each candidate: the strict regex with its checks, a gazetteer (top-level domains, card prefixes,
calling codes, address ranges), the words of context before it, and its edges. Votes are counted over all documents;
expectation-maximisation on the counts (their number is bounded by the number of vote patterns, not by the data)
estimates how reliable each labeler is for each kind, and its posteriors train a naive Bayes classifier on features
of the span itself. A wider candidate becomes a span where the classifier's log-odds are positive and it overlaps no
base span of its kind; base spans always stay.

Positions are code points, end exclusive. Patterns use possessive quantifiers and look-behind so that long runs cost
linear time; they match what the plain patterns match.

Defined results: a null text is an empty one, without spans; equal rows get equal spans; an empty table trains nothing
and gives no rows; other columns are carried along by ``redact`` and ignored elsewhere.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, packed

KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]{1,63}+(?:(?:\x20?(?:\(dot\)|\[dot\])\x20?|\.)[A-Za-z0-9-]{1,63}+){1,6}+",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}+:){7}[0-9A-Fa-f]{1,4}+(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9]{4}(?:[./_\x20-]{1,2}+[0-9]{4}){3}(?![0-9])",
    "phone": r"(?<![0-9+)(.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![0-9-])",
}
#: A text without this holds no candidate of the kind.
NEEDS = {"email": r"@|[(\[]at[)\]]", "ip": r"[0-9A-Fa-f][.:][0-9A-Fa-f]", "card": r"[0-9]{4}|[0-9][\x20-][0-9]", "phone": r"\+[0-9]|[0-9][-.][0-9]{4}"}
GAZETTEER = {
    "email": r"(?i)(?:\.|dot[)\]]\x20?)(?:com|org|net|edu|gov|io|info|de|fr|es|uk|eu|it|nl|ch)$",
    "ip": r"^(?!0+\.|127\.|22[4-9]\.|2[34][0-9]\.|25[0-5]\.)[0-9A-Fa-f.:]+$",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[4-7]|6)",
    "phone": r"^(?:\+(?:1|33|34|44|49|39|31|41|43|32|7|86|81|91|55|52)|\(?[2-9])",
}
CUES = {
    "email": r"mail|contact|write|address|kontakt|correo|courriel",
    "ip": r"\bip\b|addr|host|server|from|node",
    "card": r"card|visa|credit|karte|carte|tarjeta|payment",
    "phone": r"phone|call|tel|fax|mobile|numéro|telefon|llam",
}
AGAINST = r"version|isbn|order|invoice|serial|part no|§"
_IP_OK = r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]|)(?:\.|$)){4}$"
_SPANS = "array<struct<s:int,e:int,m:string,l:string,r:string>>"


def _matches(text: Column, pattern: str, needs: str) -> Column:
    """Array of (s, e, m, l, r): start, end, match, up to 30 characters before it, the character after it."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    trio = F.arrays_zip(found.alias("m"), between.alias("p"), F.slice(between, F.lit(2), F.size(between)).alias("q"))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["p"])
        end = start + F.length(x["m"])
        one = F.struct(start.alias("s"), end.alias("e"), x["m"].alias("m"), F.lower(F.right(x["p"], F.lit(30))).alias("l"), F.substring(x["q"], 1, 1).alias("r"))
        return F.struct(F.coalesce(end, start).alias("at"), F.when(x["m"].isNotNull(), F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

    none = F.array().cast(_SPANS)
    walk = F.aggregate(trio, F.struct(F.lit(0).alias("at"), none.alias("out")), add, lambda acc: acc["out"])
    return F.when(text.rlike(needs), walk).otherwise(none)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _strict(kind: str, m: Column) -> Column:
    n = F.length(_digits(m))
    if kind == "ip":
        return m.rlike(_IP_OK)
    if kind == "card":
        return n.between(16, 19) & F.call_function("luhn_check", _digits(m))
    return n.between(8, 15) if kind == "phone" else F.lit(True)


def find_spans(df: DataFrame, text: Column) -> DataFrame:
    """``df`` with, for each kind, ``_base_<kind>`` (passing base matches) and ``_wide_<kind>`` (wider candidates apart from those)."""
    df = df.withColumn("_text", F.coalesce(text, F.lit("")))

    def base(kind: str) -> Column:
        return F.filter(_matches(F.col("_text"), BASE[kind], NEEDS[kind]), lambda x: _strict(kind, x["m"]))

    def wide(kind: str) -> Column:
        apart = lambda x: ~F.exists(F.col(f"_base_{kind}"), lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))
        return F.filter(_matches(F.col("_text"), WIDE[kind], NEEDS[kind]), apart)

    return df.withColumns({f"_base_{k}": base(k) for k in KINDS}).withColumns({f"_wide_{k}": wide(k) for k in KINDS})


def _votes(kind: str, x: Column, base: bool) -> list[Column]:
    """regex, gazetteer, context, edges: 1 for, 0 against, 2 no vote."""
    gaz = F.when((_digits(x["m"]) if kind == "card" else x["m"]).rlike(GAZETTEER[kind]), 1).otherwise(0)
    context = F.when(x["l"].rlike(AGAINST), 0).when(x["l"].rlike(CUES[kind]), 1).otherwise(2)
    edges = F.when(F.substring(x["l"], -1, 1).rlike("[A-Za-z0-9]") | x["r"].rlike("[A-Za-z0-9]"), 0).otherwise(1)
    return [F.lit(int(base)), gaz, context, edges]


def _features(x: Column) -> list[Column]:
    """Of the span itself: digits, separators, letters (each limited to a few values) and a checksum."""
    few = lambda pattern, most: F.least(F.length(F.regexp_replace(x["m"], pattern, "")), F.lit(most))
    return [few("[^0-9]", 20), few(r"[A-Za-z0-9]", 6), F.ceil(few("[^A-Za-z]", 24) / 4).cast("int"), F.when(F.call_function("luhn_check", _digits(x["m"])), 1).otherwise(0)]


N_VOTES, N_FEATURES, ROUNDS = 4, 4, 25


def _estimate(patterns: list[tuple[str, tuple[int, ...], tuple[int, ...], int]]) -> dict[str, tuple[float, list[dict[int, float]]]]:
    """For each kind a naive Bayes classifier (prior log-odds, log-odds by feature value) from counts of (votes, features)."""
    out = {}
    for kind in KINDS:
        own = [p for p in patterns if p[0] == kind]
        post = [(sum(v == 1 for v in votes) + 0.5) / (sum(v < 2 for v in votes) + 1) for _, votes, _, _ in own]
        for _ in range(ROUNDS):  # M step, then E step
            tables, prior = [], [1.0, 1.0]
            for (_, _, _, n), p in zip(own, post):
                prior[1] += n * p
                prior[0] += n * (1 - p)
            for i in range(N_VOTES):
                t = [[1.0] * 3, [1.0] * 3]
                for (_, votes, _, n), p in zip(own, post):
                    t[1][votes[i]] += n * p
                    t[0][votes[i]] += n * (1 - p)
                tables.append([[x / sum(side) for x in side] for side in t])
            for j, (_, votes, _, _) in enumerate(own):
                odds = math.log(prior[1] / prior[0]) + sum(math.log(t[1][v] / t[0][v]) for t, v in zip(tables, votes))
                post[j] = 1 / (1 + math.exp(-max(-40.0, min(40.0, odds))))
        yes, no = (1.0 + sum(n * p for (*_, n), p in zip(own, post))), (1.0 + sum(n * (1 - p) for (*_, n), p in zip(own, post)))
        weights = []
        for i in range(N_FEATURES):
            seen: dict[int, list[float]] = {}
            for (_, _, features, n), p in zip(own, post):
                at = seen.setdefault(features[i], [0.5, 0.5])
                at[1] += n * p
                at[0] += n * (1 - p)
            weights.append({v: math.log(b / yes) - math.log(a / no) for v, (a, b) in seen.items()})
        out[kind] = (math.log(yes / no), weights)
    return out


def train(docs: DataFrame, text_col: str = "text") -> dict[str, tuple[float, list[dict[int, float]]]]:
    """The span classifiers, from the votes on all candidates of all documents."""
    found = find_spans(docs.select(col(text_col).alias("t")), F.col("t"))

    def rows(kind: str, base: bool) -> Column:
        one = lambda x: F.struct(F.lit(kind).alias("kind"), F.array(*_votes(kind, x, base)).alias("votes"), F.array(*_features(x)).alias("features"))
        return F.transform(F.col(f"_{'base' if base else 'wide'}_{kind}"), one)

    every = found.select(F.explode(F.concat(*[rows(k, b) for k in KINDS for b in (True, False)])).alias("x"))
    counts = every.groupBy("x.kind", "x.votes", "x.features").count()
    return _estimate([(r["kind"], tuple(r["votes"]), tuple(r["features"]), r["count"]) for r in counts.collect()])


def _score(model: tuple[float, list[dict[int, float]]], x: Column) -> Column:
    prior, weights = model
    terms = [F.lit(prior)]
    for f, w in zip(_features(x), weights):
        if w:
            terms.append(F.coalesce(F.element_at(F.create_map(*[F.lit(v) for pair in sorted(w.items()) for v in pair]), f), F.lit(0.0)))
    return reduce(lambda a, b: a + b, terms)


def label_spans(docs: DataFrame, text_col: str = "text", model: dict | None = None) -> DataFrame:
    """Each document as struct ``row`` with ``base`` and ``spans``: arrays of (k, s, e), by kind as listed (k is its place), then start."""
    model = model or train(docs, text_col)
    found = find_spans(docs.select(packed(docs).alias("row")), F.col("row")[text_col])

    def plain(i: int, spans: Column) -> Column:
        return F.transform(spans, lambda x: F.struct(F.lit(i).alias("k"), x["s"].alias("s"), x["e"].alias("e")))

    def likely(kind: str) -> Column:
        return F.filter(F.col(f"_wide_{kind}"), lambda x: _score(model[kind], x) > 0)

    base = [plain(i, F.col(f"_base_{k}")) for i, k in enumerate(KINDS)]
    extra = [plain(i, likely(k)) for i, k in enumerate(KINDS)]
    return found.select("row", F.array_sort(F.concat(*base)).alias("base"), F.array_sort(F.concat(*base, *extra)).alias("spans"))


def spans_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"], x["e"])), ",")


def redact(docs: DataFrame, text_col: str = "text", model: dict | None = None) -> DataFrame:
    """``docs`` with each span replaced by its kind in square brackets; where spans overlap, the first stands for both."""
    labelled = label_spans(docs, text_col, model)
    text, names = F.col("row")[text_col], F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    ordered = F.array_sort(F.transform("spans", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"))))

    def add(acc: Column, x: Column) -> Column:
        apart = x["s"] >= acc["at"]
        put = F.concat(acc["out"], F.array(text.substr(acc["at"] + 1, x["s"] - acc["at"]), F.element_at(names, x["k"] + 1)))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(apart, put).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")), add, lambda acc: F.concat(F.array_join(acc["out"], ""), text.substr(acc["at"] + 1, F.length(text))))
    clean = F.when(F.size("spans") > 0, done).otherwise(text)
    return labelled.select(*[clean.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
