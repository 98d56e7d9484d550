"""Preference formatting: one prompt per pair of conversations, and two masked completions.

The prompt is the longest common prefix of turns (equal role and text); it is rendered once. What
follows in either conversation is its completion, with the spans of assistant turns that a loss may
see. One grouping by pair, built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The rendering of a turn (fixed format): marks, role, text.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _rendered(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit("\n"), turn["text"], F.lit(CLOSE + "\n"))


def _text(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _rendered), "")


def _mask(turns: Column, trained: str) -> Column:
    """[(start, stop)] in code points of the rendered completion: text and closing mark of each trained turn."""
    empty = F.array().cast("array<struct<start:int,stop:int>>")

    def step(state: Column, turn: Column) -> Column:
        begin = state["at"] + len(OPEN) + 1 + F.char_length(turn["role"])
        stop = begin + F.char_length(turn["text"]) + len(CLOSE)
        span = F.struct(begin.alias("start"), stop.alias("stop"))
        spans = F.when(turn["role"] == trained, F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct((stop + 1).alias("at"), spans.alias("spans"))

    return F.aggregate(turns, F.struct(F.lit(0).alias("at"), empty.alias("spans")), step, lambda s: s["spans"])


def preference_pairs(turns: DataFrame, *, pair_col: str = "pair_id", chosen_col: str = "chosen", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained: str = "assistant") -> DataFrame:
    """One row per pair: pair_id, prompt, prompt_turns, chosen, rejected, chosen_mask, rejected_mask, usable.

    ``chosen_col`` is true on the turns of the chosen conversation. ``usable`` is false where a side is
    missing, or where neither completion has a trained turn (equal conversations).

    Defined cases: turns go by (turn, role, text), so ties are fixed and a null turn number comes first;
    a null role is "unknown", a null text is empty; turns with a null pair or side belong to no pair;
    marks inside a text are broken by a backslash; an empty table gives an empty result; other columns
    are ignored. A pair is one group: its size is that of two conversations.
    """
    clean = F.regexp_replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), r"<\|(im_start|im_end)\|>", r"<\\|$1|>")
    role = F.coalesce(F.col(role_col).cast("string"), F.lit("unknown"))
    flat = turns.select(F.col(pair_col).alias("pair_id"), F.col(chosen_col).alias("side"), F.struct(F.col(turn_col).cast("long").alias("turn"), role.alias("role"), clean.alias("text")).alias("t"))
    side = lambda yes: F.sort_array(F.collect_list(F.when(F.col("side") == yes, F.col("t"))))
    both = flat.filter("pair_id is not null and side is not null").groupBy("pair_id").agg(side(True).alias("c"), side(False).alias("r"))
    same = F.zip_with("c", "r", lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    differs = F.array_position(same, False)
    both = both.withColumn("k", F.when(differs > 0, differs - 1).otherwise(F.size("c")).cast("int"))
    rest = lambda x: F.slice(x, F.col("k") + 1, F.greatest(F.size(x) - F.col("k"), F.lit(0)))
    both = both.select("pair_id", F.slice("c", F.lit(1), F.col("k")).alias("p"), F.col("k").alias("prompt_turns"), rest("c").alias("c_rest"), rest("r").alias("r_rest"), ((F.size("c") > 0) & (F.size("r") > 0)).alias("full"))
    out = both.select(
        "pair_id", _text(F.col("p")).alias("prompt"), "prompt_turns", _text(F.col("c_rest")).alias("chosen"), _text(F.col("r_rest")).alias("rejected"),
        _mask(F.col("c_rest"), trained).alias("chosen_mask"), _mask(F.col("r_rest"), trained).alias("rejected_mask"), "full",
    )
    return out.withColumn("usable", F.col("full") & ((F.size("chosen_mask") > 0) | (F.size("rejected_mask") > 0))).drop("full")
