"""Chat formatting: logged snapshots collapse into the longest conversation, which is rendered.

A log that stores a conversation after every turn holds each conversation many times,
each a turn-prefix of the next.  The hash of a prefix combines the hashes of its turns,
each salted with its place, so it rolls forward turn by turn and a prefix of a longer
conversation carries the hash of the shorter one.  Anti-joins on (length, hash) leave
the maximal conversations; of equal ones the smallest id stays.

Defined results
---------------
* Rows equal in id, turn, role and text are one logged row and count once.
* Turns are ordered by turn, role, text, nulls first; their places are 1, 2, ...
* A null role or text differs from an empty one when snapshots are compared, and is
  rendered as empty.  Rows with a null id form one conversation.
* Template markers inside a text are broken by a space, so a text cannot open a turn.
* A conversation is rendered in parts of ``TURNS_PER_PART`` turns, in order; put one
  after another they are the whole.  Ordinary conversations have one part.
* An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadline.functions.ordered import sliced, with_row_number
from threadline.llm.common import named, same
from threadline.session import cut_lineage

TURNS_PER_PART = 256
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _turn_hash(seed: int) -> Column:
    parts = [F.lit(seed), F.col("place")]
    for name in ("role", "text"):
        parts += [F.col(name).isNull(), F.coalesce(F.col(name), F.lit(""))]
    return F.xxhash64(*parts)


def turn_prefixes(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, role, text, own_x, own_y, x, y): each turn, its hash, and the hash of the prefix it ends.

    Long conversations are cut into slices; a slice passes one hash on to the next.
    """
    columns = ["conv_id", "turn", "role", "text"]
    turns = conversations.select(*[named(c) for c in columns]).distinct()
    turns = with_row_number(turns, ["conv_id"], ["turn", "role", "text"], "place")
    turns = turns.select("conv_id", "place", "role", "text", _turn_hash(1).alias("own_x"), _turn_hash(2).alias("own_y"))
    parts = sliced(turns, ["conv_id"], ["place"])
    group = ["conv_id", "_slice"]
    local = Window.partitionBy(*group).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    totals = parts.groupBy(*group).agg(F.bit_xor("own_x").alias("slice_x"), F.bit_xor("own_y").alias("slice_y"))
    earlier = Window.partitionBy("conv_id").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *group, *[F.coalesce(F.bit_xor(f"slice_{c}").over(earlier), F.lit(0)).alias(f"from_{c}") for c in "xy"]
    )
    rolled = parts.select("*", *[F.bit_xor(f"own_{c}").over(local).alias(f"local_{c}") for c in "xy"])
    joined = rolled.alias("r").join(carried.alias("c"), same("r", "c", group))
    return joined.select(
        "r.conv_id", "r.place", "r.role", "r.text", "r.own_x", "r.own_y",
        *[F.col(f"r.local_{c}").bitwiseXOR(F.col(f"c.from_{c}")).alias(c) for c in "xy"],
    )


def maximal_conversations(prefixes: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies) of the conversations that no other one continues."""
    key = ["place", "x", "y"]
    last = prefixes.groupBy("conv_id").agg(F.max(F.struct(*key)).alias("last"))
    distinct = last.groupBy(*[F.col(f"last.{c}").alias(c) for c in key]).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies")
    )
    # A turn after the first shows that the prefix before it goes on.
    continued = prefixes.filter("place > 1").select(
        (F.col("place") - 1).alias("place"), F.col("x").bitwiseXOR(F.col("own_x")).alias("x"),
        F.col("y").bitwiseXOR(F.col("own_y")).alias("y"),
    )
    kept = distinct.join(continued.distinct(), key, "left_anti")
    return kept.select("conv_id", F.col("place").alias("n_turns"), "n_copies")


def _plain(column: Column) -> Column:
    return F.replace(F.coalesce(column, F.lit("")), F.lit("<|"), F.lit("< |"))


def render(turns: DataFrame, turns_per_part: int = TURNS_PER_PART) -> DataFrame:
    """(conv_id, part, text) of (conv_id, place, role, text) rows."""
    piece = F.concat(F.lit(OPEN), _plain(F.col("role")), F.lit("\n"), _plain(F.col("text")), F.lit(CLOSE + "\n"))
    part = F.floor((F.col("place") - 1) / turns_per_part).cast("int")
    pieces = turns.select("conv_id", part.alias("part"), F.struct("place", piece.alias("piece")).alias("p"))
    # At most turns_per_part rows meet in a group.
    grouped = pieces.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    return grouped.select("conv_id", "part", F.array_join(F.col("ps.piece"), "").alias("text"))


def format_chats(conversations: DataFrame, turns_per_part: int = TURNS_PER_PART) -> DataFrame:
    """(conv_id, part, n_turns, n_copies, text): the maximal conversations, rendered."""
    prefixes = cut_lineage(turn_prefixes(conversations))
    kept = cut_lineage(maximal_conversations(prefixes))
    turns = prefixes.alias("t").join(kept.alias("k"), same("t", "k", ["conv_id"]), "left_semi")
    texts = render(turns.select("conv_id", "place", "role", "text"), turns_per_part)
    joined = texts.alias("t").join(kept.alias("k"), same("t", "k", ["conv_id"]))
    return joined.select("t.conv_id", "t.part", "k.n_turns", "k.n_copies", "t.text")
