"""Repair of conversation structure by a grammar-compressed dynamic program.

A conversation is the sequence of its rows by turn. Each row becomes one symbol, its role's initial and what is wrong with it, and has to be kept, given
another role or deleted (empty turns may be put in) at the least cost, so that the role initials are those of an optional system turn and then pairs of user
and assistant. The states of that pattern (nothing, system, user, assistant) make a symbol a min-plus matrix of 4 x 4: least cost and, at equal cost, the
ASCII-least audit of edits that leads from one state to another. From one state the audit decides which turns come out, so no audit of the same rows and
cost is the beginning of another, and least audits may be put together from least ones.

Re-Pair makes the work shared: the rows of all conversations, in blocks of at most ``BLOCK`` rows, become strings of symbols; rounds over the distinct strings
count adjacent symbols with Spark and replace the most frequent pairs by rules, until nothing repeats or there are ``rules`` of them (more rules save work and
change no result). A task evaluates every rule bottom-up once, as the product of two matrices whose audits are ropes: the concatenation of two audits is one
node with a length and a hash, equal parts are skipped when two ropes are compared. Blocks are then products of a few rule matrices, kept for equal strings.

Rows are placed by a range sort over (conversation, turn, role, digest of the text), so one long conversation spreads over partitions; equal rows are counted
before the sort. Of one conversation only its symbols and its audit, a byte a row each, come together in a task; texts don't, apart from ``digests``, which
passes them as a stream.

Defined results: null role and text are one space; a null conversation is one of its own; null turns come first; rows of one turn are ordered by role, then by
SHA-256 of the text; equal rows are duplicates after the first; an empty table gives empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, ship, written

ship(__name__)

BLOCK_BITS, COPIES = 8, 64  # rows placed in a block; copies of one row that count as one of them
_SPACE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_NEXT = {_START: _USER, _SYSTEM: _USER, _USER: _ASSISTANT, _ASSISTANT: _USER}  # the turn that a new role or an inserted row makes
_ROLE = {_USER: "user", _ASSISTANT: "assistant"}


class Rope:
    """A string as the concatenation of two; knows its length and hash."""

    __slots__ = ("hash", "left", "length", "power", "right", "text")
    BASE, PRIME = 1_000_003, 2**61 - 1

    def __init__(self, text: str = "", left: Rope | None = None, right: Rope | None = None):
        self.text, self.left, self.right = text, left, right
        if left is None:
            self.length, self.hash, self.power = 1, ord(text), self.BASE
        else:
            self.length, self.power = left.length + right.length, left.power * right.power % self.PRIME
            self.hash = (left.hash * right.power + right.hash) % self.PRIME

    def __str__(self) -> str:
        out, stack = [], [self]
        while stack:
            x = stack.pop()
            if x.left is None:
                out.append(x.text)
            else:
                stack += (x.right, x.left)
        return "".join(out)


def join(a: Rope | None, b: Rope | None) -> Rope | None:
    return b if a is None else a if b is None else Rope(left=a, right=b)


def before(a: Rope | None, b: Rope | None) -> bool:
    """Whether ``a`` is less than ``b``; equal parts are skipped by their hashes."""
    x, y = [r for r in (a,) if r], [r for r in (b,) if r]
    while x and y:
        p, q = x.pop(), y.pop()
        if p is q or (p.length == q.length and p.hash == q.hash):
            continue
        if p.left is None and q.left is None:
            return p.text < q.text
        if p.left is not None and (q.left is None or p.length >= q.length):
            x += (p.right, p.left)
            y.append(q)
        else:
            y += (q.right, q.left)
            x.append(p)
    return bool(y)


Matrix = list  # 4 x 4 of (cost, rope) or None


def least(a: tuple | None, b: tuple | None) -> tuple | None:
    if a is None or b is None:
        return a or b
    return b if b[0] < a[0] or (b[0] == a[0] and before(b[1], a[1])) else a


def times(a: Matrix, b: Matrix) -> Matrix:
    out = []
    for row in a:
        new = [None] * 4
        for k, first in enumerate(row):
            if first is not None:
                for j, second in enumerate(b[k]):
                    if second is not None and (new[j] is None or first[0] + second[0] <= new[j][0]):
                        new[j] = least(new[j], (first[0] + second[0], join(first[1], second[1])))
        out.append(new)
    return out


def insertions() -> Matrix:
    """Any number of inserted turns, none among them."""
    out, letter = [], Rope("I")
    for i in range(4):
        row, at, cost, rope = [None] * 4, i, 0, None
        while row[at] is None:
            row[at] = (cost, rope)
            at, cost, rope = _NEXT[at], cost + INSERT, join(rope, letter)
        out.append(row)
    return out


def of_symbol(symbol: str) -> Matrix:
    """One row with the insertions before it; capital letters are truncated rows, D one that has to go."""
    letters = {x: Rope(x) for x in "KRD"}
    extra = TRUNCATED if symbol.isupper() else 0
    step = []
    for i in range(4):
        row: list = [None] * 4
        row[i] = (DELETE, letters["D"])
        if symbol != "D":
            makes = {"s": _SYSTEM, "u": _USER, "a": _ASSISTANT}.get(symbol.lower())
            if (makes == _SYSTEM and i == _START) or (makes is not None and _NEXT[i] == makes):
                row[makes] = least(row[makes], (KEEP + extra, letters["K"]))
            row[_NEXT[i]] = least(row[_NEXT[i]], (REROLE + extra, letters["R"]))
        step.append(row)
    return times(insertions(), step)


class Grammar:
    """Rules of pairs, each with its matrix, and the matrices of the strings seen lately."""

    def __init__(self, rules: list[tuple[str, str]], keep: int = 20_000):
        self.rules, self.keep, self.seen = rules, keep, {}
        self.matrix = {x: of_symbol(x) for x in "suaoSUAOD"}
        for pair, name in rules:
            self.matrix[name] = times(self.matrix[pair[0]], self.matrix[pair[1]])

    def product(self, parts: list[Matrix]) -> Matrix:
        """The product in order, by halves, so that ropes stay shallow."""
        while len(parts) > 1:
            parts = [times(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0]

    def of_block(self, symbols: str) -> Matrix:
        found = self.seen.get(symbols)
        if found is None:
            packed = symbols
            for pair, name in self.rules:
                packed = packed.replace(pair, name)
            if len(self.seen) >= self.keep:
                self.seen.clear()
            self.seen[symbols] = found = self.product([self.matrix[x] for x in packed])
        return found

    def repair(self, blocks: list[str]) -> tuple[int, str]:
        """(cost, audit) of the cheapest repair of a conversation."""
        ends = times(self.product([self.of_block(b) for b in blocks]), insertions())[_START]
        cost, rope = least(ends[_START], ends[_ASSISTANT])
        return cost, "" if rope is None else str(rope)


def re_pair(strings: DataFrame, rules: int = 64, at_once: int = 16) -> list[tuple[str, str]]:
    """Rules (pair, new symbol) for the distinct ``symbols`` with their ``weight``, the most frequent first; pairs of one round cannot overlap."""
    found: list[tuple[str, str]] = []
    now = strings
    while len(found) < rules:
        letters = F.split("symbols", "")
        pair = F.transform(F.slice(letters, 1, F.greatest(F.size(letters) - 1, F.lit(0))), lambda x, i: F.concat(x, F.get(letters, i + 1)))
        counted = now.select("weight", F.explode(pair).alias("pair")).groupBy("pair").agg(F.sum("weight").alias("n")).filter("n > 1")
        chosen: list[str] = []
        for r in counted.orderBy(F.desc("n"), "pair").limit(at_once).collect():
            a, b = r["pair"]
            lefts, rights = {x[0] for x in chosen}, {x[1] for x in chosen}
            if a in rights or b in lefts or (a == b and (a in lefts or b in rights)) or len(found) + len(chosen) >= rules:
                continue
            chosen.append(r["pair"])
        if not chosen:
            break
        packed = F.col("symbols")
        for p in chosen:
            found.append((p, chr(0x4E00 + len(found))))
            packed = F.replace(packed, F.lit(p), F.lit(found[-1][1]))
        now = written(now.select(packed.alias("symbols"), "weight"), "packed")
    return found


class Repair(NamedTuple):
    """``report``: conv, gaps, blank, duplicate, truncated, illegal, cost, audit. ``turns``: conv, at, k, role, text, in the order of at and k."""

    report: DataFrame
    turns: DataFrame


def damage(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text) with the faults that CRC-32 of ``conversation:turn`` deals: lost, emptied, cut, repeated rows, and rows given to the user."""
    spaced = lambda c: F.coalesce(col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(spaced(conv_col), F.lit(":"), spaced(turn_col)).cast("binary")) % 20
    text = F.when(code == 1, "").when(code == 2, F.regexp_replace(spaced(text_col), "[.!?]", "")).otherwise(spaced(text_col))
    role = F.when(code == 4, "user").otherwise(spaced(role_col))
    rows = turns.filter(code != 0).select(col(conv_col).alias("conv_id"), col(turn_col).alias("turn"), role.alias("role"), text.alias("text"), F.when(code == 3, 2).otherwise(1).alias("__times"))
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(1), "__times"))).drop("col")


def _pairs_of(initials: Column) -> Column:
    """How many adjacent initials are su, ua or au."""
    found = F.lit(0)
    for p in ("su", "ua", "au"):
        found = found + (F.length(initials) - F.length(F.replace(initials, F.lit(p), F.lit("")))) / 2
    return found.cast("long")


def _fold(rules: list[tuple[str, str]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grammar, names = Grammar(rules), ["conv", "block", "start", "part", "cost", "illegal", "audit"]
        blocks: list[tuple[int, str]] = []
        conv, illegal, last = None, 0, ""

        def done() -> Iterator[list]:
            cost, audit = grammar.repair([s for _, s in blocks])
            at, state = 0, _START
            for i, (block, symbols) in enumerate(blocks):
                begin, rows, start = at, 0, state
                while rows < len(symbols) or (i == len(blocks) - 1 and at < len(audit)):
                    state = after(state, audit[at], symbols[rows] if rows < len(symbols) else "")
                    rows += audit[at] != "I"
                    at += 1
                end = i == len(blocks) - 1
                yield [conv, block, start, audit[begin:at], cost if end else -1, illegal if end else -1, audit if end else ""]

        for pdf in batches:
            out: list[list] = []
            for of, block, symbols, first, end, wrong in zip(*(pdf[c] for c in ("conv", "block", "symbols", "first", "last", "illegal"))):
                if blocks and of != conv:
                    out += done()
                    blocks, illegal, last = [], 0, ""
                illegal += wrong + (bool(last) and last + first not in ("su", "ua", "au"))
                blocks.append((block, symbols))
                conv, last = of, end
            yield pd.DataFrame(out, columns=names)
        if blocks:
            yield pd.DataFrame(list(done()), columns=names)

    return run


def after(state: int, edit: str, symbol: str) -> int:
    """The state after an edit of a row with this symbol."""
    if edit == "D":
        return state
    if edit == "K":
        return {"s": _SYSTEM, "u": _USER, "a": _ASSISTANT}[symbol.lower()]
    return _NEXT[state]


def _outcome(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The turns that come out of a block: its row (``at``), place beside it, new role if any, whether the row's text stays."""
    for pdf in batches:
        out = []
        for conv, ats, symbols, start, part in zip(*(pdf[c] for c in ("conv", "ats", "symbols", "start", "part"))):
            state, row, k = start, 0, 0
            for edit in part:
                state, at = after(state, edit, symbols[row] if row < len(symbols) else ""), ats[min(row, len(ats) - 1)]
                if edit == "I":
                    out.append((conv, at, k if row < len(symbols) else k + len(part), _ROLE[state], False))
                elif edit != "D":
                    out.append((conv, at, k, _ROLE[state] if edit == "R" else None, True))
                row, k = (row, k + 1) if edit == "I" else (row + 1, 0)
        yield pd.DataFrame(out, columns=["conv", "at", "k", "role", "stays"])


def repair(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", rules: int = 64) -> Repair:
    """The cheapest repair of every conversation that has rows; ``conv`` is its id as a string."""
    spaced = lambda c: F.coalesce(col(c).cast("string"), F.lit(" "))
    rows = turns.select(col(conv_col).cast("string").alias("conv"), col(turn_col).cast("long").alias("turn"), spaced(role_col).alias("role"), spaced(text_col).alias("text"))
    same = rows.groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("n")).withColumn("digest", F.sha2("text", 256))
    when = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    firsts = same.groupBy("conv", "role", "digest").agg(F.min(when).alias("first")).toDF("of_conv", "of_role", "of_digest", "first")
    met = same.join(firsts, F.col("conv").eqNullSafe(F.col("of_conv")) & (F.col("role") == F.col("of_role")) & (F.col("digest") == F.col("of_digest")))
    met = met.select("conv", "turn", "role", "text", "digest", "n", F.col("first.turn").eqNullSafe(F.col("turn")).alias("first"), F.explode(F.expr(f"sequence(0, (n - 1) div {COPIES})")).alias("part"))
    met = met.withColumns({"n": F.least(F.lit(COPIES), F.col("n") - F.col("part") * COPIES), "first": F.col("first") & (F.col("part") == 0)})
    order = [F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest"), F.asc("part")]
    shown = F.rtrim("text", F.lit(_SPACE))
    initial = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("o")
    placed = met.withColumns({"blank": shown == "", "cut": ~F.substring(shown, -1, 1).isin(".", "!", "?"), "initial": initial})
    placed = placed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    symbol = F.when(F.col("blank") | ~F.col("first"), "D").when(F.col("cut"), F.upper("initial")).otherwise(F.col("initial"))
    placed = written(placed.select("conv", "turn", "role", F.when(F.col("first"), F.col("text")).alias("text"), "n", "first", "blank", "cut", "initial", symbol.alias("symbol"), "at"), "placed")

    row = F.sort_array(F.collect_list(F.struct("at", "symbol", "initial", "n"))).alias("rows")
    blocks = placed.groupBy("conv", F.shiftright("at", BLOCK_BITS).alias("block")).agg(row)
    symbols = F.array_join(F.transform("rows", lambda r: F.concat(r["symbol"], F.repeat(F.lit("D"), (r["n"] - 1).cast("int")))), "")
    initials = F.array_join(F.transform("rows", lambda r: r["initial"]), "")
    ats = F.flatten(F.transform("rows", lambda r: F.array_repeat(r["at"], r["n"].cast("int"))))
    blocks = blocks.select("conv", "block", symbols.alias("symbols"), initials.alias("initials"), ats.alias("ats"))
    blocks = written(blocks.select("*", (F.length("symbols") - 1 - _pairs_of(F.col("initials"))).alias("illegal")), "blocks")
    grammar = re_pair(blocks.groupBy("symbols").agg(F.count("*").alias("weight")), rules)
    line = blocks.select("conv", "block", "symbols", F.substring("initials", 1, 1).alias("first"), F.substring("initials", -1, 1).alias("last"), "illegal")
    line = line.repartition("conv").sortWithinPartitions("conv", "block")
    folded = written(line.mapInPandas(_fold(grammar), "conv string, block long, start int, part string, cost long, illegal long, audit string"), "folded")

    kept = F.col("first") & ~F.col("blank")
    faults = placed.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).alias("gaps"), F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(~F.col("blank"), F.col("n") - F.col("first").cast("int")).otherwise(0)).alias("duplicate"), F.sum((kept & F.col("cut")).cast("long")).alias("truncated"),
    )
    ends = folded.filter("cost >= 0").select(F.col("conv").alias("of"), "illegal", "cost", "audit")
    report = faults.join(ends, F.col("conv").eqNullSafe(F.col("of"))).drop("of")

    parts = folded.select(F.col("conv").alias("of"), F.col("block").alias("of_block"), "start", "part")
    known = blocks.join(parts, F.col("conv").eqNullSafe(F.col("of")) & (F.col("block") == F.col("of_block"))).select("conv", "ats", "symbols", "start", "part")
    came = written(known.mapInPandas(_outcome, "conv string, at long, k int, role string, stays boolean"), "outcome")
    stay = came.filter("stays").select("at", "k", F.col("role").alias("new_role")).join(placed.select("at", "conv", "role", "text"), "at").select("conv", "at", "k", F.coalesce("new_role", "role").alias("role"), "text")
    return Repair(report, stay.unionByName(came.filter("not stays").select("conv", "at", "k", "role", F.lit("").alias("text"))))


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    conv, running = None, None
    for pdf in batches:
        out = []
        for of, role, text in zip(pdf["conv"], pdf["role"], pdf["text"]):
            if running is not None and of == conv:
                running.update(b"\n")
            else:
                if running is not None:
                    out.append((conv, running.hexdigest()))
                conv, running = of, hashlib.sha256()
            running.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
        yield pd.DataFrame(out, columns=["conv", "sha256"])
    if running is not None:
        yield pd.DataFrame([(conv, running.hexdigest())], columns=["conv", "sha256"])


def digests(turns: DataFrame) -> DataFrame:
    """(conv, sha256) of the lines ``role:text`` of each conversation, whose rows pass as a stream."""
    return turns.repartition("conv").sortWithinPartitions("conv", "at", "k").mapInPandas(_hashed, "conv string, sha256 string")
