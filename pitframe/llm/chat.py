r"""Chat formatting in budgeted windows, with DataFrame functions only.

A conversation's turns are dealt to windows by the prefix sums of their tokens: those sums fall into cells of half the
budget, a window takes the turns that start in a cell, and a turn longer than half the budget is a window of its own, so that
spans end at turns and the new turns of a window keep within the budget or are that one turn. Every later window starts with
the system turn (if the first turn is one; at most its first ``system`` tokens are repeated) and repeats the turns of earlier
windows that start at most ``history`` tokens before it. Both are context on top of the budget, so a window holds at most
``budget`` (or one longer turn) + ``history`` + ``system`` tokens. The loss mask covers the texts of the assistant turns that
are new in the window, so that over all windows each assistant text is a target exactly once.

Template: ``<|turn|>role<|text|>text<|end|>``. In roles and texts a backslash goes after the bracket of every
control string (``<|``, ``<s>``, ``</s>``, ``[INST]``, ``[/INST]``, ``<<SYS>>``, ``<</SYS>>``), also where
backslashes stand there already; taking one away again restores the text exactly.

Prefix sums come in two steps, within blocks of ``BLOCK`` turn numbers and over the sums of the blocks, so that one
very long conversation is shared out. Only ``read_back``, for checks of the output, gathers a conversation in one row.

Defined results: null text and null role are empty; a null conversation id is a conversation; rows with equal turn
numbers go by role, then text, and repeated rows stay; a null turn comes first; no rows give no windows; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
BLOCK = 256
_CONTROL = r"(?=\||/?s>|/?INST\]|/?SYS>>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[]\\*+)" + _CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*+)" + _CONTROL, "$1$2")


def tokens(text: Column) -> Column:
    """A turn's cost: a quarter of its code points, rounded up, and 4 for its marks."""
    return (F.ceil(F.length(text) / 4) + 4).cast("long")


def _turns(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """c, o (place in order of the turn), role, text, cost, before (tokens of earlier turns)."""
    t = rows.select(col(conv).alias("c"), col(turn).cast("long").alias("turn"), F.coalesce(col(role), F.lit("")).alias("role"), F.coalesce(col(text), F.lit("")).alias("text"))
    t = t.withColumn("cost", tokens(F.col("text"))).withColumn("block", F.floor(F.coalesce("turn", F.lit(-1)) / BLOCK))
    inner = Window.partitionBy("c", "block").orderBy("turn", "role", "text")
    t = t.withColumns({"at": F.row_number().over(inner), "within": F.sum("cost").over(inner.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cost")})
    sums = t.groupBy("c", "block").agg(F.sum("cost").alias("cost"), F.count("*").alias("n"))
    outer = Window.partitionBy("c").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("c").alias("c2"), F.col("block").alias("b2"), F.coalesce(F.sum("cost").over(outer), F.lit(0)).alias("earlier"), F.coalesce(F.sum("n").over(outer), F.lit(0)).alias("earlier_n"))
    t = t.join(sums, F.col("c").eqNullSafe(F.col("c2")) & (F.col("block") == F.col("b2")))
    return t.select("c", (F.col("earlier_n") + F.col("at")).alias("o"), "role", "text", "cost", (F.col("earlier") + F.col("within")).alias("before"))


def chat_windows(
    rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    budget: int = 1024, history: int = 128, system: int = 256,
) -> DataFrame:
    """One row for each window: conv, win, formatted, context_turns (turns that are repeated, at its head) and
    loss (array of start, end: code points of ``formatted`` under the loss mask, end exclusive)."""
    half = max(budget // 2, 1)
    t = _turns(rows, conv_col, turn_col, role_col, text_col)
    t = t.withColumn("win", 2 * F.floor(F.col("before") / half) + (F.col("cost") > half).cast("long"))
    is_system = (F.col("o") == 1) & (F.col("role") == "system")
    starts = t.groupBy("c", "win").agg(F.min("before").alias("start"))
    near = t.select("*", F.explode(F.sequence(F.col("win") + 1, F.greatest(F.col("win") + 1, 2 * F.floor((F.col("before") + history) / half) + 1))).alias("w2"))
    near = near.join(starts.select(F.col("c").alias("c2"), F.col("win").alias("w3"), "start"), F.col("c").eqNullSafe(F.col("c2")) & (F.col("w2") == F.col("w3")))
    near = near.filter((F.col("start") - F.col("before") <= history) & ~is_system)
    first = t.filter(is_system).select(F.col("c").alias("c2"), F.col("win").alias("own"), "o", "role", F.substring("text", 1, 4 * system).alias("text"))
    keep = starts.select("c", "win").join(first, F.col("c").eqNullSafe(F.col("c2")) & (F.col("win") > F.col("own")))
    parts = ["c", "w", "o", "role", "text", "new"]
    every = t.select("c", F.col("win").alias("w"), "o", "role", "text", F.lit(True).alias("new"))
    every = every.unionByName(near.select("c", F.col("w2").alias("w"), "o", "role", "text", F.lit(False).alias("new")).select(parts))
    every = every.unionByName(keep.select("c", F.col("win").alias("w"), "o", "role", "text", F.lit(False).alias("new")).select(parts))
    head, body = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT)), escape(F.col("text"))
    every = every.select("c", "w", F.struct("o", F.concat(head, body, F.lit(END)).alias("f"), F.length(head).alias("h"), F.length(body).alias("n"), "new", (F.col("new") & (F.col("role") == "assistant")).alias("target")).alias("t"))
    wins = every.groupBy("c", "w").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def add(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["h"]
        span = F.struct(begin.alias("start"), (begin + x["n"]).alias("end"))
        return F.struct((acc["at"] + F.length(x["f"])).alias("at"), F.when(x["target"], F.concat(acc["loss"], F.array(span))).otherwise(acc["loss"]).alias("loss"))

    loss = F.aggregate("ts", F.struct(F.lit(0).alias("at"), empty.alias("loss")), add, lambda acc: acc["loss"])
    return wins.select(
        F.col("c").alias("conv"), F.col("w").alias("win"), F.array_join(F.transform("ts", lambda x: x["f"]), "").alias("formatted"),
        F.size(F.filter("ts", lambda x: ~x["new"])).alias("context_turns"), loss.alias("loss"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """conv, n_turns, turns (role, newline, text, newline for every turn), loss_text and formatted_chars, from the windows alone."""
    pieces = F.slice(F.split("formatted", r"<\|turn\|>", -1), F.col("context_turns") + 2, F.greatest(F.size(F.split("formatted", r"<\|turn\|>", -1)), F.lit(1)))

    def turn(x: Column) -> Column:
        role = F.substring_index(x, TEXT, 1)
        text = F.substring(x, F.length(role) + len(TEXT) + 1, F.length(x) - F.length(role) - len(TEXT) - len(END))
        return F.concat(unescape(role), F.lit("\n"), unescape(text), F.lit("\n"))

    w = windows.select("conv", "win", F.transform(pieces, turn).alias("turns"), F.transform("loss", lambda s: unescape(F.col("formatted").substr(s["start"] + 1, s["end"] - s["start"]))).alias("targets"), F.length("formatted").alias("chars"))
    w = w.select("conv", F.struct("win", F.array_join("turns", "").alias("turns"), F.array_join("targets", "").alias("targets")).alias("w"), F.size("turns").alias("n"), "chars")
    per = w.groupBy("conv").agg(F.array_sort(F.collect_list("w")).alias("ws"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    return per.select("conv", "n_turns", F.array_join(F.col("ws.turns"), "").alias("turns"), F.array_join(F.col("ws.targets"), "").alias("loss_text"), "formatted_chars")
