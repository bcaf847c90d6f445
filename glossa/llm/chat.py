"""Chat formatting: collapse of cumulative snapshots, and rendering.

A chat service logs a conversation again and again as it grows. Each turn gets
a rolling hash of all turns up to it; a conversation whose last hash is met in
a longer one is a snapshot of it and goes. What is left is rendered.

Numbering, hashing and the anti-join work on digests of the turns. Texts are
looked at again only where turns of one number must be told apart, and for the
conversations that stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glossa.llm.shared import Workspace
from glossa.operators.joins import with_ordinal

#: Turns that a window or a rendered row holds at most, whatever the conversation's length.
BLOCK = 256

#: What tells the turns of a table apart: a null number comes before all others.
_TURN = ["conv_id", "known", "turn", "t1", "t2"]


def digested(turns: DataFrame) -> DataFrame:
    """conv_id, known and turn (the number, 0 if it is not known), role, text, t1, t2: turns with a 128-bit digest of what was said."""
    t = turns.filter("conv_id is not null").select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    t = t.withColumn("known", F.col("turn").isNotNull().cast("int")).withColumn("turn", F.coalesce("turn", F.lit(0)))
    return t.select("conv_id", "known", "turn", "role", "text", F.xxhash64("role", "text").alias("t1"), F.xxhash64(F.lit("second"), "text", "role").alias("t2"))


def numbered(said: DataFrame, work: Workspace) -> DataFrame:
    """Digested turns -> their _TURN columns, k from 1 within the conversation, and n, its number of turns.

    Equal rows are one turn. Turns of one number follow their role, then text.
    The order is one range sort over all turns, so a conversation of any length
    is spread over tasks.
    """
    each = work.table(said.select(*_TURN).distinct(), "turns")
    number = _TURN[:3]
    ties = each.groupBy(*number).agg(F.count("*").alias("size")).filter("size > 1").drop("size")
    tied = with_ordinal(said.join(ties, number).distinct(), [*number, "role", "text"], "tie").select(*_TURN, "tie")
    order = each.join(tied, _TURN, "left").withColumn("tie", F.coalesce("tie", F.lit(0)))
    order = with_ordinal(order, [*number, "tie"], "ord").drop("tie")
    # written: the join's shuffles are then its own, and a conversation with most of all turns is split
    span = work.table(order.groupBy("conv_id").agg(F.min("ord").alias("first"), F.count("*").alias("n")), "span")
    return order.join(span, "conv_id").select(*_TURN, (F.col("ord") - F.col("first") + 1).alias("k"), "n")


def rolled(turns: DataFrame) -> DataFrame:
    """(conv_id, t1, t2, k, n) -> conv_id, k, n, p1, p2: the 128-bit hash of turns 1..k.

    It is the exclusive or of the turns' own hashes, each of which covers the
    turn's number: summed up within blocks of BLOCK turns, then over the blocks.
    """
    t = turns.select("conv_id", "k", "n", F.floor((F.col("k") - 1) / BLOCK).alias("block"), F.xxhash64(F.lit(1), "k", "t1", "t2").alias("h1"), F.xxhash64(F.lit("second"), "t2", "t1", "k").alias("h2"))
    inside = W.partitionBy("conv_id", "block").orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    t = t.select("conv_id", "block", "k", "n", *[F.bit_xor(h).over(inside).alias(h) for h in ("h1", "h2")])
    # what a full block hands on to those after it; only conversations of several blocks have such
    ends = t.filter(f"k % {BLOCK} = 0 and k < n")
    before = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, 0)
    base = ends.select("conv_id", (F.col("block") + 1).alias("block"), *[F.bit_xor(h).over(before).alias(f"base{h[1]}") for h in ("h1", "h2")])
    t = t.join(base, ["conv_id", "block"], "left")
    return t.select("conv_id", "k", "n", *[F.col(f"h{i}").bitwiseXOR(F.coalesce(F.col(f"base{i}"), F.lit(0))).alias(f"p{i}") for i in "12"])


def maximal(prefixes: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies of conversations that no longer one begins with; of equal ones the least conv_id."""
    kinds = prefixes.filter("k = n").groupBy("n", "p1", "p2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    # prefixes that go on: of a whole conversation only those before its last turn
    longer = prefixes.filter("k < n").groupBy(F.col("k").alias("n"), "p1", "p2").agg(F.lit(1).alias("goes_on"))
    return kinds.join(longer, ["n", "p1", "p2"], "left_anti").select("conv_id", F.col("n").alias("n_turns"), "n_copies")


def collapse_and_render(turns: DataFrame, opening: str = "<|%s|>\n", closing: str = "<|end|>\n") -> DataFrame:
    """(conv_id, turn, role, text) -> conv_id, n_turns, n_copies, part, rendered.

    Turns follow their number, then role and text; equal rows are one turn, and
    rows without a conv_id are left out. A null turn comes first; a null role
    or text is as an empty one. Of equal conversations the least conv_id stands
    for all n_copies. A conversation of more than BLOCK turns is rendered in
    parts 0, 1, ... of BLOCK turns, whose texts in this order are the whole;
    other columns are ignored; an empty table gives none. Turns and prefixes are
    told apart by 128-bit hashes of role and text.
    """
    work = Workspace(turns.sparkSession, "chat")
    said = digested(turns)
    order = work.table(numbered(said, work), "numbered")
    kept = work.table(maximal(work.table(rolled(order), "prefixes")), "maximal")
    places = order.join(kept, "conv_id").select(*_TURN, "k", "n_turns", "n_copies", F.floor((F.col("k") - 1) / BLOCK).alias("part"))
    piece = F.concat(F.format_string(opening, "role"), F.col("text"), F.lit("\n" + closing))
    # a turn that is there several times gives equal pieces, which a set holds once
    pieces = said.select(*_TURN, piece.alias("piece")).join(places, _TURN).select("conv_id", "n_turns", "n_copies", "part", F.struct("k", "piece").alias("turn"))
    # dealt by part, not only by conversation: a long one is spread over tasks
    whole = pieces.groupBy("conv_id", "part").agg(F.max("n_turns").alias("n_turns"), F.max("n_copies").alias("n_copies"), F.sort_array(F.collect_set("turn")).alias("turns"))
    return whole.select("conv_id", "n_turns", "n_copies", "part", F.array_join(F.transform("turns", lambda x: x["piece"]), "").alias("rendered"))
