"""Chat formatting in budgeted windows.

A conversation becomes one or more windows, each a formatted text with the spans under the
loss mask. Prefix sums of the turns' tokens choose turn-aligned spans of new turns; every
window keeps the leading system turn, repeats as much of the turns before as the history allowance holds,
and masks what it repeats, so each assistant turn is a target exactly once. The history gives way where the system turn and the
first new turn need the room, so no window exceeds the budget but one: a turn is never cut, and one that exceeds the budget with the
system turn has a window with that turn alone.

The template puts ``<|start|>role``, a line break, the text and ``<|end|>`` with a line break around every turn. Inside
texts and roles a backslash stands before every backslash and inside every ``<|``, so control strings
cannot occur there, and taking it out again gives the text back.

Defined results: null texts and roles are empty; null ids are one conversation. Turns are in order of turn
(null first), then role and text; repeated rows are turns of their own. Other columns play no part.
A conversation is put together in one row, as its output is; conversations must fit in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rollcall.llm.common import hex_digest, let, places
from rollcall.llm.packing import text_tokens

START, END, BREAK = "<|start|>", "<|end|>\n", "<|break|>"
BUDGET, HISTORY = 1024, 256
TURN_TOKENS = 6  # what the template adds to a turn
TARGET = "assistant"

_TURN = "struct<turn:bigint,role:string,text:string,tokens:int>"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def role_line(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit(BREAK))


def role_of(line: Column) -> Column:
    return unescaped(F.replace(line, F.lit(BREAK), F.lit("\n")))


def window_starts(turns: Column, system: Column, budget: int, history: int) -> Column:
    """Array of (first, last, back): each window's new turns, and the first turn that it repeats; places from 1 after the system turn."""
    rest = F.slice(turns, system + 1, F.size(turns))
    sums = F.aggregate(
        rest,
        F.array(F.lit(0).cast("long")),
        lambda acc, t: F.concat(acc, F.array(F.element_at(acc, -1) + t["tokens"])),
    )
    fixed = F.when(system > 0, turns[0]["tokens"]).otherwise(F.lit(0))
    zero = F.struct(F.lit(1).alias("next"), F.array().cast("array<struct<first:int,last:int,back:int>>").alias("out"))

    def from_sums(sums: Column) -> Column:
        total = F.size(sums) - 1

        def window(first: Column) -> Column:
            # sums[i] is what turns 1..i take; the history is the longest run of turns before the first that fits its own
            # allowance, and the budget beside the system turn and the first new turn. There is none where that turn does not fit itself.
            back = F.size(F.filter(sums, lambda s: (sums[first - 1] - s > history) | (sums[first] - s + fixed > budget))) + 1

            def last_of(back: Column) -> Column:
                fit = F.size(F.filter(sums, lambda s: s - sums[back - 1] + fixed <= budget)) - 1
                return F.struct(first.alias("first"), F.least(total, F.greatest(first, fit)).alias("last"), back.alias("back"))

            return let(F.least(back, first), last_of)

        def step(acc: Column, i: Column) -> Column:
            made = let(window(i), lambda w: F.struct((w["last"] + 1).alias("next"), F.concat(acc["out"], F.array(w)).alias("out")))
            return F.when(i == acc["next"], made).otherwise(acc)

        out = F.aggregate(places(total), zero, step)["out"]
        # A conversation of a system turn alone still has its window.
        none = F.array(F.struct(F.lit(1).alias("first"), F.lit(0).alias("last"), F.lit(1).alias("back")))
        return F.when(total > 0, out).otherwise(none)

    return let(sums, from_sums)


def _rendered(turns: Column, system: Column, w: Column) -> Column:
    """The window's text, its loss spans, and how many of its turns are repeated."""
    head = F.slice(turns, 1, system)
    body = F.slice(turns, system + w["back"], w["last"] - w["back"] + 1)
    repeated = system * F.when(w["first"] > 1, 1).otherwise(0) + w["first"] - w["back"]
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"), F.array().cast("array<string>").alias("parts"))
    # Turns to repeat come first in a window, after the system turn, which is one itself from the second window on.
    marked = F.transform(
        F.concat(head, body),
        lambda t, i: F.struct(
            t["role"].alias("role"),
            role_line(t["role"]).alias("line"),
            escaped(t["text"]).alias("text"),
            (F.when(i < system, w["first"] == 1).otherwise(i - system >= w["first"] - w["back"])).alias("new"),
        ),
    )

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + len(START) + F.length(t["line"]) + 1
        end = start + F.length(t["text"])
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        whole = F.concat(F.lit(START), t["line"], F.lit("\n"), t["text"], F.lit(END))
        return F.struct(
            (end + len(END)).alias("at"),
            F.when(t["new"] & (t["role"] == TARGET), F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"),
            F.concat(acc["parts"], F.array(whole)).alias("parts"),
        )

    return let(
        F.aggregate(marked, zero, step),
        lambda d: F.struct(F.array_join(d["parts"], "").alias("text"), d["spans"].alias("loss"), repeated.alias("repeated"), system.alias("system"), w["first"].alias("first")),
    )


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """(conv_id, window, text, loss, repeated, system): formatted windows, loss spans in code points, and how many of the first turns are repeated."""
    rows = conversations.select(
        F.col("conv_id").cast("long"),
        F.struct(
            F.col("turn").cast("long"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
            (text_tokens(F.col("text")) + TURN_TOKENS).cast("int").alias("tokens"),
        ).alias("t"),
    )
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).cast(f"array<{_TURN}>").alias("turns"))
    system = F.when(F.col("turns")[0]["role"] == "system", 1).otherwise(0)
    cut = let(
        F.col("turns"),
        lambda turns: F.transform(window_starts(turns, system, budget, history), lambda w: _rendered(turns, system, w)),
    )
    return whole.select("conv_id", F.posexplode(cut).alias("window", "w")).select(
        "conv_id", "window", "w.text", "w.loss", "w.repeated", "w.system"
    )


def turns_of(text: Column) -> Column:
    """The turns of a formatted text as (role, text)."""
    pieces = let(F.split(text, r"<\|end\|>\n"), lambda x: F.slice(x, 1, F.size(x) - 1))

    def one(piece: Column) -> Column:
        inner = F.substring(piece, F.lit(len(START) + 1), F.length(piece))
        at = F.locate("\n", inner)
        return F.struct(
            role_of(F.substring(inner, F.lit(1), at - 1)).alias("role"), unescaped(F.substring(inner, at + 1, F.length(inner))).alias("text")
        )

    return F.transform(pieces, one)


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from its windows alone: the turns, what is under the loss mask, and the formatted length."""
    said = let(
        turns_of(F.col("text")),
        # The system turn is repeated first, then the history.
        lambda turns: F.slice(turns, F.col("repeated") + 1, F.size(turns)),
    )
    lost = F.transform("loss", lambda s: unescaped(F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"])))
    each = formatted.select(
        "conv_id",
        F.struct(
            "window",
            F.array_join(F.transform(said, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"),
            F.size(said).cast("long").alias("n"),
            F.array_join(lost, "").alias("loss"),
            F.length("text").cast("long").alias("chars"),
        ).alias("w"),
    )
    whole = each.groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("ws"))
    joined = lambda name: F.array_join(F.transform("ws", lambda w: w[name]), "")
    total = lambda name: F.aggregate("ws", F.lit(0).cast("long"), lambda a, w: a + w[name])
    return whole.select(
        "conv_id",
        total("n").alias("n_turns"),
        hex_digest(joined("turns")).alias("turns_sha256"),
        F.length(joined("loss")).cast("long").alias("loss_chars"),
        hex_digest(joined("loss")).alias("loss_sha256"),
        total("chars").alias("formatted_chars"),
    )
