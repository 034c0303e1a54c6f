"""Chat formatting: logged conversations that only begin longer ones are dropped before rendering.

A log often holds snapshots of one conversation, each a little longer. The hash of the first k turns is the
exclusive-or of one 128-bit hash per (turn, role, text), of two halves with a number each before these columns: Spark hashes a column with the hash
of the ones before it as its seed, so turns that collide in one half need not in the other. So it rolls along a conversation and adds up over blocks of
turns: even a conversation with very many turns is never gathered in one task. A conversation goes if its last hash
is an inner prefix hash of another one (an anti-join of hashes alone) or if a conversation with the same turns and a
smaller ``conv_id`` exists.

Turns are told apart by their number. Nulls and odd rows: repeated rows count once; a null role or text differs from
an empty one and renders as empty; a null turn number comes first; rows with a null ``conv_id`` form one conversation;
turns that share a number are rendered by role, then text; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartolith.session import cut_lineage

#: Turn numbers of one block.
BLOCK = 256
TEMPLATE = ("<|", "|>\n", "\n<|end|>\n")


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, a, b, last): rolling hashes up to each turn number, and whether it is the last one."""
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.coalesce(F.col("turn").cast("bigint"), F.lit(-1).cast("bigint")).alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    marked = rows.select("conv_id", "turn", *(F.xxhash64(F.lit(k), "turn", F.coalesce("role", F.lit("\u0001")), F.coalesce("text", F.lit("\u0001"))).alias(c) for k, c in enumerate("ab"))).distinct()
    # One row per turn number; its block's hash is the base of the blocks after it.
    both = [F.expr(f"bit_xor({c})").alias(c) for c in "ab"]
    each = cut_lineage(marked.groupBy("conv_id", "turn").agg(*both).withColumn("block", F.floor(F.col("turn") / BLOCK)), "turn-hashes")
    blocks = each.groupBy("conv_id", "block").agg(*both, F.max("turn").alias("top"))
    along = Window.partitionBy("conv_id").orderBy("block")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    base = blocks.select(
        "conv_id", "block", *(F.coalesce(F.expr(f"bit_xor({c})").over(before), F.lit(0)).alias(f"before_{c}") for c in "ab"),
        F.when(F.lead("block").over(along).isNull(), F.col("top")).alias("end"),
    )
    base = cut_lineage(base, "turn-bases")
    inside = Window.partitionBy("conv_id", "block").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    rolled = each.select("conv_id", "block", "turn", *(F.expr(f"bit_xor({c})").over(inside).alias(c) for c in "ab"))
    return rolled.join(base, rolled.conv_id.eqNullSafe(base.conv_id) & (rolled.block == base.block)).select(
        rolled.conv_id, "turn", *(F.col(c).bitwiseXOR(F.col(f"before_{c}")).alias(c) for c in "ab"), F.col("turn").eqNullSafe(F.col("end")).alias("last")
    )


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, copies) of the conversations that stay: no longer one begins with them; of equal ones, the first."""
    rolled = cut_lineage(prefixes(turns), "turn-prefixes")
    inner = rolled.where(~F.col("last")).select("a", "b").distinct()
    whole = rolled.where("last").groupBy("a", "b").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies"))
    return whole.join(inner, ["a", "b"], "left_anti").select("conv_id", "copies")


def render(turns: DataFrame) -> DataFrame:
    """One row per turn of the conversations that stay: conv_id, turn, role and the turn as chat text.

    The texts of a conversation, joined by turn, are its rendering; they are not gathered in a row, as a conversation
    has no bound.
    """
    kept = cut_lineage(maximal(turns).select(F.col("conv_id").alias("kept_conv"), "copies"), "conversations")
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    head, middle, tail = TEMPLATE
    body = F.concat(F.lit(head), F.coalesce("role", F.lit("")), F.lit(middle), F.coalesce("text", F.lit("")), F.lit(tail))
    return rows.join(kept, rows.conv_id.eqNullSafe(kept.kept_conv)).select("conv_id", "turn", "role", "copies", body.alias("rendered"), "text").distinct().drop("text")
