"""Main text of web pages by nearest-URL page differencing.

Pages of a host are ordered by URL path, and each is paired with the neighbour that shares more of its path (the one
before it at a tie). A page is cut into text lines at block tags; the lines of the pair are aligned by longest common
subsequence, and the lines that both share are deleted as template, whatever tags they stand in; ``n_shared`` counts them. What
is left, lines of the page's own and lines protected as text, is then sorted by tags. Inside an element that marks the article (article, main, or
a content container) a shared line goes too unless something speaks for text: at least ``PROSE_WORDS`` words, a sentence's end,
a heading, table cell, quotation, caption or preformatted text, a list of which not all is shared (lists side by side are one), or an article that shares
more than half of its words (a copy). Lines in elements that are never
article text (navigation, header, footer, aside, forms, scripts, adverts, notices, comments and so on, by tag, class
or id) and differ from page to page, so that no alignment finds them, go by those names. Where a page marks an article, lines outside it go as well.

A class, id or role names an element by its head ("main-navigation" is navigation, "content-sidebar-wrap" a wrap, "has-sidebar" says
nothing), and the header of an article is part of it. An article or main element inside a dropped wrapper counts where it is all the
page has: beside the open lines if the wrapper was dropped by a soft word or is a form, else if there is no other text.

Order and pairs are global: pages are dealt to shards of about ``shard_bytes`` by split points of (host, path), one partition a
shard, and the pages at the ends of a shard are given to the shards beside it as context, so the result does not depend on
how pages are partitioned, and a host with a third of all pages is spread over many shards. There are at most ``MOST_SHARDS``, which
then grow; a shard is streamed, and only two pages are held at a time.

Defined results: null or empty html gives an empty text; a null url is the host '' with path ''; a page without a
neighbour keeps its open lines, and so does a page all of whose open lines are shared; repeated pages each give a row;
an empty table gives no rows; other columns are ignored by ``extract``.
"""

from __future__ import annotations

import html as _html
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, ship, written

ship(__name__)

_RAW = "script|style|noscript|template|textarea|svg|iframe|title|select|object|canvas|video|audio"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_RAW})\b[^>]*+>.*?(?:</\1\s*+>|\Z)|<(/?)([a-z][a-z0-9:-]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+/?)>|<[!?/a-z][^<>]*+(?:>|(?=<)|\Z)",
    re.I | re.S,
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body br button caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html label legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_DROP_TAGS = frozenset("nav footer aside head menu button dialog label input fieldset".split())
_DROP_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs masthead "
    "header footer sidebar aside related recommended comment comments reply replies discussion disqus cookie cookies consent gdpr notice notices alert popup modal "
    "overlay newsletter subscribe signup login share sharing social widget form search toolbar pagination pager copyright legal hidden teaser teasers trending".split()
)
_HARD_WORDS = frozenset("ad ads advert advertisement sponsored comment comments reply replies cookie related teaser".split())
#: Words that say what a thing is for at the front of a name too ("related-posts"); names of what only holds it; and of what an element has or lacks.
_FRONT_WORDS = _HARD_WORDS | frozenset("advertising sponsor promo recommended cookies consent gdpr newsletter share sharing social breadcrumb breadcrumbs copyright disqus trending teasers".split())
_HOLDERS = frozenset("area bar block bottom box button buttons container content group holder inner item items left link links list menu outer panel placeholder right row section slot text top unit wrap wrapper".split())
_STATES = frozenset("has no not non with without".split())
_HIDDEN_WORDS = frozenset("hidden modal popup overlay".split())
_MAIN_WORDS = frozenset("article content main post entry story maincontent".split())
_CLOSES = {"p": {"p"}, "li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_CLOSES |= {t: {"p"} for t in ("div", "ul", "ol", "table", "section", "article", "h1", "h2", "h3", "h4", "blockquote", "footer", "header", "nav", "aside", "form", "pre", "main")}
_SCOPE = frozenset("article main div section nav aside footer header form table ul ol dl body td th blockquote".split())
_ATTR = re.compile(r"\b(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)

# SOFT is dropped, but an article inside is INNER; an article inside DROP is LAST
# TEXT and ITEM (of a list) are lines of an ARTICLE
OPEN, ARTICLE, DROP, SOFT, INNER, LAST, TEXT, ITEM = range(8)
PROSE_WORDS = 12
ALIGN_BITS = 1 << 28
MOST_SHARDS, SAMPLE = 100_000, 20
_TEXT_TAGS = frozenset("h1 h2 h3 h4 h5 h6 td th caption dt dd pre blockquote figcaption".split())
_SENTENCE = re.compile(r"[.!?\u2026\u3002\uff01\uff1f\u061f\u06d4\u0964][\"'\u201d\u2019\u00bb)\]]*\Z")


def _named(name: str) -> tuple[str | None, bool]:
    """The drop word that a class, id or role stands for, and whether it marks an article."""
    parts = [x for x in re.split(r"[^a-z0-9]+", name) if x]
    if not parts or parts[0] in _STATES:
        return None, False
    marked = not _MAIN_WORDS.isdisjoint(parts)
    if parts[0] in _FRONT_WORDS:
        return parts[0], False
    heads = parts[:]
    while not marked and len(heads) > 1 and (heads[-1] in _HOLDERS - _DROP_WORDS or heads[-1].isdigit()):
        heads.pop()
    if marked and heads[-1] == "header":
        return None, parts[0] in ("article", "entry", "post", "story")
    return (heads[-1], False) if heads[-1] in _DROP_WORDS else (None, marked)


def _zone(tag: str, attrs: str, zone: int) -> int:
    """The zone inside an element, from that around it."""
    if tag in _DROP_TAGS:
        return DROP
    within = {DROP: LAST, SOFT: INNER}.get(zone, zone if zone in (INNER, LAST) else ARTICLE)  # an article's zone here
    dropped = zone in (DROP, SOFT)
    names: list[str] = []
    if attrs:
        for name, value in _ATTR.findall(attrs):
            name, value = name.lower(), value.strip("\"'").lower()
            if name in ("class", "id", "role"):
                names += value.split()
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
                return DROP
    said = [_named(name) for name in names]
    words = {word for word, _ in said if word}
    if tag in ("article", "main"):
        return DROP if words & _HARD_WORDS else within
    if tag == "header" and zone in (OPEN, SOFT):
        return SOFT
    if tag not in ("body", "html") and words:
        if words & _HARD_WORDS & set(names):
            return DROP
        if words & (_HARD_WORDS | _HIDDEN_WORDS) or _MAIN_WORDS.isdisjoint(names):
            return DROP if zone in (DROP, LAST) else SOFT
        return zone
    if tag == "form":
        return DROP if zone in (DROP, LAST) else SOFT
    if any(marked for _, marked in said) and not dropped and tag in ("div", "section", "td"):
        return within
    if zone in (ARTICLE, ITEM) and tag in _TEXT_TAGS:
        return TEXT
    return ITEM if zone == ARTICLE and tag == "li" else zone


def lines(page: str | None) -> list[tuple[int, str]]:
    """(zone, text) of each line of a page, in order; empty lines are left out."""
    page = page or ""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []
    zone, at, buffer = OPEN, 0, []

    def flush() -> None:
        if buffer:
            text = " ".join(_html.unescape("".join(buffer)).split())
            if text:
                out.append((zone, text))
            buffer.clear()

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            buffer.append(page[at : m.start()])
        at = m.end()
        tag = m[3]
        if not tag:
            continue
        tag = tag.lower()
        block = tag in _BLOCK
        if block:
            flush()
        if m[2]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), -1)
            if depth >= 0:
                inside = stack[depth][1]
                if inside != (stack[-1][1] if stack else OPEN) or inside != (stack[depth - 1][1] if depth else OPEN):
                    flush()
                del stack[depth:]
                zone = stack[-1][1] if stack else OPEN
        elif tag not in _VOID:
            if closes := _CLOSES.get(tag):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in closes:
                        del stack[i:]
                        zone = stack[-1][1] if stack else OPEN
                        break
                    if stack[i][0] in _SCOPE:
                        break
            inner = _zone(tag, m[4], zone)
            if inner != zone:
                flush()
            if not m[4].endswith("/") or block:
                stack.append((tag, inner))
                zone = inner
    buffer.append(page[at:])
    flush()
    return out


def _rows(masks: list[int], width: int) -> Iterator[int]:
    """For each line of one text, the bits of the other's lines at which the longest common subsequence does not grow."""
    every = row = (1 << width) - 1
    for mask in masks:
        hit = row & mask
        row = ((row + hit) | (row - hit)) & every
        yield row


def _align(a: list[int], b: list[int], base: int, out: set[int]) -> None:
    """Adds to ``out`` the places in ``a`` (counted from ``base``) of a longest common subsequence of ``a`` and ``b``."""
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    masks = [where.get(x, 0) for x in a]
    if len(a) == 1 or len(a) * len(b) <= ALIGN_BITS:
        rows = list(_rows(masks, len(b)))
        i, j = len(a), len(b)
        while i and j:
            if rows[i - 1] >> (j - 1) & 1:
                j -= 1
            else:
                i -= 1
                if not i or rows[i - 1] >> (j - 1) & 1:
                    out.add(base + i)
                    j -= 1
        return
    # too large to keep all rows: find where the first half of a meets its part of b, and align the halves
    half, last = len(a) // 2, 0

    def lengths(masks: list[int]) -> np.ndarray:
        for last in _rows(masks, len(b)):
            pass
        bits = np.unpackbits(np.frombuffer(last.to_bytes(-(-len(b) // 8), "little"), np.uint8), bitorder="little")[: len(b)]
        return np.r_[0, np.cumsum(1 - bits.astype(np.int64))]

    back = {x: int(format(m, f"0{len(b)}b")[::-1], 2) for x, m in where.items()}
    met = int((lengths(masks[:half]) + lengths([back.get(x, 0) for x in reversed(a[half:])])[::-1]).argmax())
    if met:
        _align(a[:half], b[:met], base, out)
    if met < len(b):
        _align(a[half:], b[met:], base + half, out)


def common(a: list[str], b: list[str]) -> set[int]:
    """Places in ``a`` of a longest common subsequence of ``a`` and ``b``, in memory bounded by ALIGN_BITS and the texts."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    found = set(range(lo)) | set(range(len(a) - hi, len(a)))
    shared = {x: i for i, x in enumerate(set(a[lo : len(a) - hi]) & set(b[lo : len(b) - hi]))}
    own = [i for i in range(lo, len(a) - hi) if a[i] in shared]  # other lines are in no alignment
    places: set[int] = set()
    if own:
        _align([shared[a[i]] for i in own], [shared[x] for x in b[lo : len(b) - hi] if x in shared], 0, places)
    return found | {own[i] for i in places}


def _template(article: list[tuple[int, int, str]], shared: set[int]) -> set[int]:
    """Places of the shared lines of an article that nothing marks as text."""
    size = lambda rows: sum(len(t.split()) for _, _, t in rows)
    both = [x for x in article if x[0] in shared]
    if 2 * size(both) > size(article):
        return set()
    out: set[int] = set()
    for zone, group in groupby(article, key=lambda x: x[1]):
        rows = list(group)
        if zone == TEXT or (zone == ITEM and not all(i in shared for i, _, _ in rows)):
            continue
        out.update(i for i, _, t in rows if i in shared and len(t.split()) < PROSE_WORDS and not _SENTENCE.search(t))
    return out


def differenced(own: list[tuple[int, str]], other: list[tuple[int, str]] | None) -> tuple[list[tuple[int, str]], int]:
    """What is left of a page's lines without those its pair shares, and how many went."""
    shared = common([t for _, t in own], [t for _, t in other]) if other else set()
    if article := [(i, z, t) for i, (z, t) in enumerate(own) if z in (ARTICLE, TEXT, ITEM)]:
        shared -= {i for i, _, _ in article} - _template(article, shared)
    elif not any(z == INNER or (z == OPEN and i not in shared) for i, (z, _) in enumerate(own)):
        shared = {i for i in shared if own[i][0] != OPEN}  # a copy of the other page
    shared = {i for i in shared if own[i][0] not in (INNER, LAST)}
    return [x for i, x in enumerate(own) if i not in shared], len(shared)


def main_text(own: list[tuple[int, str]], other: list[tuple[int, str]] | None) -> str:
    return chosen(differenced(own, other)[0], any(z in (ARTICLE, TEXT, ITEM) for z, _ in own))


def chosen(left: list[tuple[int, str]], article: bool) -> str:
    """The text among the lines that differencing has left."""
    if article:
        return " ".join(t for z, t in left if z in (ARTICLE, TEXT, ITEM))
    return " ".join([t for z, t in left if z in (OPEN, INNER)] or [t for z, t in left if z == LAST])


def _prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come by shard and key; each is compared with the one before and the one after it."""
    before = now = None

    def done(before, now, after):
        near = [x for x in (before, after) if x and (x["shard"], x["host"]) == (now["shard"], now["host"])]
        best = max(near, key=lambda x: _prefix(x["path"], now["path"]), default=None)
        left, gone = differenced(now["lines"], best and best["lines"])
        return now["page_id"], now["url"], chosen(left, any(z in (ARTICLE, TEXT, ITEM) for z, _ in now["lines"])), gone

    for pdf in batches:
        out = []
        for page_id, url, page, host, path, shard, ctx in pdf[["page_id", "url", "html", "host", "path", "shard", "ctx"]].itertuples(index=False):
            row = {"page_id": page_id, "url": url, "host": host, "path": path, "shard": shard, "ctx": ctx, "lines": lines(page)}
            if now and not now["ctx"]:
                out.append(done(before, now, row))
            before, now = now, row
        yield pd.DataFrame(out, columns=["page_id", "url", "text", "n_shared"])
    if now and not now["ctx"]:
        yield pd.DataFrame([done(before, now, None)], columns=["page_id", "url", "text", "n_shared"])


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", shard_bytes: int = 8 << 20) -> DataFrame:
    """page_id, url, text and n_shared, the number of lines deleted because the paired page shares them, of every page."""
    url = F.coalesce(col(url_col), F.lit(""))
    p = pages.select(
        col(id_col).cast("long").alias("page_id"), col(url_col).alias("url"), F.coalesce(col(html_col), F.lit("")).alias("html"),
        F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)).alias("host"),
        F.regexp_extract(url, r"^(?:(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*)?([^?#]*)", 1).alias("path"),
    )
    number = F.lpad(F.hex(F.coalesce("page_id", F.lit(0)).bitwiseXOR(F.lit(-(2**63)))), 16, "0")
    p = p.withColumn("key", F.concat_ws("\u0001", "host", "path", number))
    keys = written(p.select("key", F.octet_length("html").cast("long").alias("bytes")), "keys")  # pages are read once more only
    n, size = keys.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    shards = max(1, min(-(-size // shard_bytes), MOST_SHARDS))
    some = sorted(keys.sample(min(1.0, SAMPLE * shards / max(n, 1)), seed=7).collect()) if shards > 1 else []
    share = sum(r["bytes"] for r in some) / shards
    splits, seen = [], 0
    for r in some:
        seen += r["bytes"]
        if seen >= share * (len(splits) + 1) and len(splits) < shards - 1:
            splits.append(r["key"])
    splits = sorted(set(splits))

    @F.pandas_udf("int")
    def shard_of(key: pd.Series) -> pd.Series:
        return key.map(lambda k: bisect_right(splits, k)).astype("int32")

    ends = keys.withColumn("shard", shard_of("key")).groupBy("shard").agg(F.min("key").alias("least"), F.max("key").alias("most"))
    ends = sorted((r["shard"], r["least"], r["most"]) for r in ends.collect())  # one row a shard
    beside: dict[str, list[int]] = {}
    for (a, _, most), (b, least, _) in zip(ends, ends[1:]):
        beside.setdefault(most, []).append(b)
        beside.setdefault(least, []).append(a)

    @F.pandas_udf("array<int>")
    def also(key: pd.Series) -> pd.Series:
        return key.map(lambda k: beside.get(k, []))

    # the page itself, and context for the shards beside its own if it is at an end
    places = F.concat(F.array(F.struct(shard_of("key").alias("to"), F.lit(False).alias("ctx"))), F.transform(also("key"), lambda s: F.struct(s.alias("to"), F.lit(True).alias("ctx"))))
    p = p.withColumn("place", F.explode(places)).select("page_id", "url", "html", "host", "path", "key", F.col("place.to").alias("shard"), F.col("place.ctx").alias("ctx"))
    dealt = p.repartitionById(len(splits) + 1, "shard").sortWithinPartitions("key", "html")
    return dealt.drop("key").mapInPandas(_extract, "page_id long, url string, text string, n_shared long")
