"""Chat formatting: preference pairs as one prompt and two masked completions, in DataFrame functions only.

Method. The turns of a pair meet in one aggregation (the only shuffle). The longest common prefix of
turns, equal in role and text, is rendered once as the prompt; the rest of either side becomes a list of
segments with a loss mask, which is set only on what assistant turns say. ``prompt`` followed by a
completion is exactly that conversation's rendering.

Edge cases. A null role is ``user``, a null text is empty; markers inside a text are broken up by a
space, so that no text can open a turn. Turns of equal number are ordered by role and text, and repeated
rows are turns of their own; a null turn number comes first. If a side is missing it is an empty
conversation (``status`` is ``unpaired``); if both are equal, the prompt is all there is
(``identical``). Without a pair id there is no conversation: each distinct turn is unpaired by itself, so
such rows never gather in one group. Texts and conversations of any length are rendered whole. No rows give
no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _segments(turns: Column) -> Column:
    """Per turn: head and tail without loss, the words with loss if an assistant says them."""
    return F.flatten(
        F.transform(
            turns,
            lambda t: F.array(
                F.struct(F.concat(F.lit(OPEN), t["role"], F.lit("\n")).alias("text"), F.lit(False).alias("loss")),
                F.struct(F.concat(t["text"], F.lit(CLOSE)).alias("text"), (t["role"] == "assistant").alias("loss")),
                F.struct(F.lit("\n").alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )


def _render(segments: str | Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def _sides(turns: DataFrame, pair: Column, rejected: Column) -> DataFrame:
    """``pair_id`` and the turns of both sides, in order (``_c``, ``_d``)."""
    rows = turns.select(
        pair.alias("pair_id"),
        F.coalesce(rejected, F.lit(False)).alias("_r"),
        F.struct(
            F.col("turn"),
            F.replace(F.coalesce("role", F.lit("user")), F.lit("<|"), F.lit("< |")).alias("role"),
            F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"),
        ).alias("_turn"),
    )
    alone = F.when(F.col("pair_id").isNull(), F.xxhash64("_turn", "_r"))
    side = lambda c, name: F.sort_array(F.collect_list(F.when(c, F.col("_turn")))).alias(name)
    return rows.groupBy("pair_id", alone.alias("_alone")).agg(side(~F.col("_r"), "_c"), side(F.col("_r"), "_d")).drop("_alone")


def _from(turns: Column, start: Column) -> Column:
    return F.slice(turns, start + 1, F.greatest(F.size(turns) - start, F.lit(0)))


def _formatted(sides: DataFrame) -> DataFrame:
    same = F.zip_with("_c", "_d", lambda x, y: x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]))
    at = F.array_position(same, False)
    df = sides.withColumn("_k", F.when(at == 0, F.size("_c")).otherwise((at - 1).cast("int")))
    return df.select(
        "pair_id",
        F.when((F.size("_c") == 0) | (F.size("_d") == 0), "unpaired").when((F.col("_k") == F.size("_c")) & (F.col("_k") == F.size("_d")), "identical").otherwise("pair").alias("status"),
        F.col("_k").cast("bigint").alias("n_prefix_turns"),
        _render(_segments(F.slice("_c", F.lit(1), F.col("_k")))).alias("prompt"),
        _segments(_from(F.col("_c"), F.col("_k"))).alias("chosen"),
        _segments(_from(F.col("_d"), F.col("_k"))).alias("rejected"),
    )


def format_preferences(turns: DataFrame, pair: Column, rejected: Column) -> DataFrame:
    """One row per pair from a table of turns (``turn``, ``role``, ``text``).

    ``pair`` and ``rejected`` are columns of ``turns``: the pair's id and whether the row belongs to
    the rejected side. Returns ``pair_id, status, n_prefix_turns, prompt, chosen, rejected`` where the
    last two are ``array<struct<text, loss>>``.
    """
    return _formatted(_sides(turns, pair, rejected))


def format_swapped(conversations: DataFrame) -> DataFrame:
    """A pair for each conversation (``conv_id``, ``turn``, ``role``, ``text``) of a table that has no rejected sides.

    Conversations 2p and 2p + 1 are neighbours, below zero as above. Chosen is a conversation as it is; rejected is the same up to its last
    assistant turn (all of it, if there is none), and then what its neighbour says from its own last assistant turn on.
    Neighbours meet once, in one aggregation. ``pair_id`` is the conversation's id; the format is that of :func:`format_preferences`.
    """
    sides = _sides(conversations, F.shiftright(F.col("conv_id").cast("long"), 1), F.col("conv_id") % 2 != 0)

    def answer(turns: str) -> Column:
        at = F.array_max(F.transform(turns, lambda t, i: F.when(t["role"] == "assistant", i)))
        return F.coalesce(at, F.size(turns))

    def pair(mine: str, other: str, odd: int) -> Column:
        turned = F.concat(F.slice(mine, F.lit(1), answer(mine)), _from(F.col(other), answer(other)))
        return F.struct((F.col("pair_id") * 2 + odd).alias("pair_id"), F.col(mine).alias("_c"), turned.alias("_d"))

    both = sides.select(F.explode(F.array(pair("_c", "_d", 0), pair("_d", "_c", 1))).alias("p")).select("p.*")
    return _formatted(both.where(F.size("_c") > 0))


def digests(pairs: DataFrame) -> DataFrame:
    """The texts of a formatted pair and its masks as run lengths (``0:17 1:120 ...``)."""
    mask = lambda c: F.array_join(F.transform(c, lambda s: F.concat(s["loss"].cast("int").cast("string"), F.lit(":"), F.length(s["text"]).cast("string"))), " ")
    return pairs.select("pair_id", "status", "n_prefix_turns", "prompt", _render("chosen").alias("chosen"), mask("chosen").alias("chosen_mask"), _render("rejected").alias("rejected"), mask("rejected").alias("rejected_mask"))
