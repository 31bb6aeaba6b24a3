"""Preference formatting of chat conversations, with built-in functions alone.

A chosen and a rejected conversation share a prefix of equal turns. It is rendered once, as
the prompt; what follows in either is a completion, with the spans that a loss should see (the
assistant's text and the mark that ends it; everything else is masked).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TURN = "struct<role:string,text:string>"
#: A turn is rendered as "<|role|>\ntext<|end|>\n".
END = "<|end|>"


#: Conversations whose numbers agree but for so many low bits look for each other's answers.
NEIGHBOUR_BITS = 6


def conversations_of(turns: DataFrame, *keys: str) -> DataFrame:
    """conv_id, ``keys`` and turns: the turns (conv_id, turn, role, text) of each conversation in order.

    Ties of turn are ordered by role, then text, nulls first; rows without conv_id belong to none and are left out.
    A conversation is one record, so it is held in one row, as its rendering is.
    """
    return (turns.where("conv_id IS NOT NULL").groupBy(*keys, "conv_id")
            .agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
            .select(*keys, "conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns")))


def answer_pairs(turns: DataFrame) -> DataFrame:
    """pair_id, chosen, rejected: each conversation, up to its last answer, against itself gone astray.

    The rejected one leaves at one of the assistant turns (the one numbered conv_id modulo their number, from 0) and ends there, with
    the last answer of the next conversation that has one, among those whose numbers agree but for the low ``NEIGHBOUR_BITS`` bits; after the
    last of these comes the first. Only a conversation without assistant turn, or alone with one among its neighbours, gives no pair.
    All rows of neighbours are dealt to one task together, once: conversations, and who is next, need no other shuffle.
    """
    near = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text").withColumn("near", F.shiftright("conv_id", NEIGHBOUR_BITS)).repartition("near")
    at = F.filter(F.transform("turns", lambda x, i: F.when(x["role"] == "assistant", i)), lambda i: i.isNotNull())
    c = conversations_of(near, "near").withColumn("at", at).where(F.size("at") > 0).withColumn("last", F.element_at("at", -1))
    c = c.withColumn("answer", F.struct(F.lit("assistant").alias("role"), F.element_at("turns", F.col("last") + 1)["text"].alias("text")))
    by = Window.partitionBy("near").orderBy("conv_id")
    c = c.withColumn("other", F.coalesce(F.lead("answer").over(by), F.first("answer").over(by))).withColumn("n", F.count("*").over(Window.partitionBy("near"))).where("n > 1")
    leaves = F.element_at("at", (F.pmod("conv_id", F.size("at")) + 1).cast("int"))
    return c.select(F.col("conv_id").alias("pair_id"), F.slice("turns", F.lit(1), F.col("last") + 1).alias("chosen"), F.concat(F.slice("turns", F.lit(1), leaves), F.array("other")).alias("rejected"))


def _head(x):
    return F.concat(F.lit("<|"), F.coalesce(x["role"], F.lit("")), F.lit("|>\n"))


def _body(x):
    return F.concat(F.coalesce(x["text"], F.lit("")), F.lit(END))


def render(turns) -> F.Column:
    return F.array_join(F.transform(turns, lambda x: F.concat(_head(x), _body(x), F.lit("\n"))), "")


def common_turns(a, b) -> F.Column:
    """Number of leading turns of equal role and text; null equals null."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]))
    first = F.array_position(same, F.lit(False))
    return F.when(first == 0, n).otherwise(first - 1).cast("int")


def loss_spans(turns) -> F.Column:
    """[start, end) of each assistant turn's text and end mark, in characters of the rendering."""
    kind = "struct<at:int,spans:array<struct<start:int,end:int>>>"

    def step(acc, x):
        start = acc["at"] + F.length(_head(x))
        end = start + F.length(_body(x))
        spans = F.when(x["role"] == "assistant", F.concat(acc["spans"], F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(acc["spans"])
        return F.struct((end + 1).alias("at"), spans.alias("spans")).cast(kind)

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")).cast(kind)
    return F.aggregate(turns, zero, step)["spans"]


def preferences(pairs: DataFrame) -> DataFrame:
    """One row per row of ``pairs`` (pair_id, chosen, rejected): the prompt and both masked completions.

    chosen and rejected are arrays of (role, text); a null array counts as one without turns. Null roles and texts
    render as nothing. If one conversation is a prefix of the other its completion is empty. Columns: pair_id, n_common, prompt, chosen,
    chosen_spans, rejected, rejected_spans. Other columns are ignored.
    """
    none = F.array().cast(f"array<{TURN}>")
    p = pairs.select("pair_id", F.coalesce(F.col("chosen").cast(f"array<{TURN}>"), none).alias("a"), F.coalesce(F.col("rejected").cast(f"array<{TURN}>"), none).alias("b"))
    p = p.withColumn("n_common", common_turns(F.col("a"), F.col("b")))
    rest = lambda c: F.slice(c, F.col("n_common") + 1, F.greatest(F.size(c) - F.col("n_common"), F.lit(0)))
    p = p.select("pair_id", "n_common", F.slice("a", F.lit(1), F.col("n_common")).alias("p"), rest("a").alias("a"), rest("b").alias("b"))
    return p.select("pair_id", "n_common", render("p").alias("prompt"), render("a").alias("chosen"), loss_spans("a").alias("chosen_spans"),
                    render("b").alias("rejected"), loss_spans("b").alias("rejected_spans"))


def preference_report(turns: DataFrame) -> DataFrame:
    """The preferences of ``answer_pairs``, spans as text "start-end,..." so that any engine can compare them."""
    said = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ",")
    p = preferences(answer_pairs(turns))
    return p.select("pair_id", "n_common", "prompt", "chosen", said("chosen_spans").alias("chosen_spans"), "rejected", said("rejected_spans").alias("rejected_spans"))
