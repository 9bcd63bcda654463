"""Preference formatting of chosen / rejected conversations.

Both conversations of a pair are put in order, their longest common prefix of turns (same role, same
text) is found and rendered once as the prompt; what follows in each is its completion.  A completion
comes with the spans to train on, in its own characters (code points, end exclusive): the text and end
marker of its assistant turns; headers and other roles are masked.

One shuffle groups a pair's turns, everything else is array functions on its row; a pair's conversations
are one output row by definition, so a pair is the unit that has to fit a task.

Defined results: null role or text counts as empty; turns are ordered by (turn, role, text), null turns
first, repeated rows are repeated turns; rows without pair id or with another side are left out; a pair
without one side has an empty prompt and an empty completion on that side; equal conversations are all
prompt; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick

#: Fixed values of the template: <|role|> newline text <|end|> newline.
OPEN, CLOSE, END, BREAK = "<|", "|>", "<|end|>", "\n"
TRAINED_ROLE = "assistant"


def _header(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(CLOSE + BREAK))


def _rendered(turn: Column) -> Column:
    return F.concat(_header(turn), turn["text"], F.lit(END + BREAK))


def _joined(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _rendered), "")


def _trained_spans(turns: Column) -> Column:
    """Spans of assistant texts with their end markers in the joined rendering of ``turns``."""
    none = F.array().cast("array<struct<start:int,end:int>>")

    def step(acc: Column, turn: Column) -> Column:
        stop = acc["at"] + F.length(_rendered(turn))
        span = F.struct((acc["at"] + F.length(_header(turn))).alias("start"), (stop - len(BREAK)).alias("end"))
        return F.struct(stop.alias("at"), F.when(turn["role"] == TRAINED_ROLE, F.concat(acc["spans"], F.array(span)))
                        .otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])


def format_preferences(turns: DataFrame, pair_col: str = "pair_id", side_col: str = "side", turn_col: str = "turn",
                       role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per pair: pair_id, prompt_turns, prompt, chosen, rejected, chosen_spans, rejected_spans."""
    rows = pick(turns, pair_id=pair_col, side=side_col, turn=turn_col, role=role_col, text=text_col)
    turn = F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                    F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sides = [F.sort_array(F.collect_list(F.when(F.col("side") == side, turn))).alias(f"all_{side}") for side in ("chosen", "rejected")]
    pairs = rows.where(F.col("pair_id").isNotNull() & F.col("side").isin("chosen", "rejected")).groupBy("pair_id").agg(*sides)
    same = F.zip_with("all_chosen", "all_rejected", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    parted = F.array_position(same, False)
    pairs = pairs.withColumn("prompt_turns", F.when(parted == 0, F.size("all_chosen")).otherwise(parted - 1).cast("int"))
    rest = {side: F.slice(f"all_{side}", F.col("prompt_turns") + 1, F.greatest(F.size(f"all_{side}") - F.col("prompt_turns"), F.lit(0)))
            for side in ("chosen", "rejected")}
    return pairs.select(
        "pair_id", F.col("prompt_turns").cast("bigint").alias("prompt_turns"),
        _joined(F.slice("all_chosen", F.lit(1), F.col("prompt_turns"))).alias("prompt"),
        _joined(rest["chosen"]).alias("chosen"), _joined(rest["rejected"]).alias("rejected"),
        _trained_spans(rest["chosen"]).alias("chosen_spans"), _trained_spans(rest["rejected"]).alias("rejected_spans"))


def swapped_answer_pairs(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn",
                         role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Preference pairs from plain conversations, one per conversation, as ``format_preferences`` reads
    them: chosen is the conversation; rejected has, in place of its last answer and what follows, the
    last answer of its partner (the id that differs in the lowest bit), or none if that has no answer."""
    rows = pick(conversations, pair_id=id_col, turn=turn_col, role=role_col, text=text_col).where(F.col("pair_id").isNotNull())
    answer = F.when(F.col("role") == TRAINED_ROLE, F.struct("turn", "text"))
    last = rows.groupBy("pair_id").agg(F.max(answer).alias("answer"), F.max("turn").alias("last_turn"))
    chosen = rows.select("pair_id", F.lit("chosen").alias("side"), "turn", "role", "text")
    kept = (rows.join(last.select("pair_id", F.col("answer.turn").alias("cut")), "pair_id")
            .where(F.col("cut").isNull() | F.coalesce(F.col("turn") < F.col("cut"), F.lit(True)))
            .select("pair_id", F.lit("rejected").alias("side"), "turn", "role", "text"))
    other = last.where(F.col("answer").isNotNull()).select(F.col("pair_id").bitwiseXOR(F.lit(1)).alias("pair_id"), F.col("answer.text").alias("text"))
    swapped = last.join(other, "pair_id").select(
        "pair_id", F.lit("rejected").alias("side"), F.coalesce(F.col("answer.turn"), F.col("last_turn") + 1).alias("turn"),
        F.lit(TRAINED_ROLE).alias("role"), "text")
    return chosen.unionByName(kept).unionByName(swapped)
