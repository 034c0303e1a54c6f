"""Running values and neighbours in an order, without putting a whole group in one task.

A plain window sends all rows of a key to one task. Here a group is cut into blocks that
follow the order (days of a clock, stretches of a file): values run inside each block,
one summary row per block runs over the blocks, and the two are added. The only sizes
that matter are the rows of one block and the number of blocks of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def running_by_block(
    df: DataFrame,
    keys: list[str],
    block: str,
    order: str,
    values: dict[str, tuple[str, Column, bool]],
) -> DataFrame:
    """Running sums or maxima per key.

    ``values`` maps a new column to (``"sum"`` or ``"max"``, expression, exclude the row
    itself). ``block`` must not decrease along ``order``; ``order`` is unique per key.
    """
    fold = {"sum": F.sum, "max": F.max}
    inputs = {f"_in_{n}": e for n, (_, e, _) in values.items()}
    rows = df.withColumns(inputs)
    blocks = rows.groupBy(*keys, block).agg(
        *[fold[k](f"_in_{n}").alias(f"_blk_{n}") for n, (k, _, _) in values.items()]
    )
    earlier = W.partitionBy(*keys).orderBy(block).rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select(
        *keys, block, *[fold[k](f"_blk_{n}").over(earlier).alias(f"_pre_{n}") for n, (k, _, _) in values.items()]
    )
    out = rows.join(blocks, [*keys, block])
    for name, (kind, _, exclusive) in values.items():
        frame = W.partitionBy(*keys, block).orderBy(order)
        frame = frame.rowsBetween(W.unboundedPreceding, -1 if exclusive else 0)
        own, pre = fold[kind](f"_in_{name}").over(frame), F.col(f"_pre_{name}")
        if kind == "sum":
            zero = F.lit(0)
            out = out.withColumn(name, F.coalesce(own, zero) + F.coalesce(pre, zero))
        else:
            out = out.withColumn(name, F.greatest(own, pre))
    return out.drop(*[f"_in_{n}" for n in values], *[f"_pre_{n}" for n in values])


def next_in_block(df: DataFrame, keys: list[str], block: str, order: str, value: str, name: str) -> DataFrame:
    """Value of the next row of a key, also across block borders.

    The first value of each block is the successor of the last row of the block before.
    """
    firsts = df.groupBy(*keys, block).agg(F.min_by(F.struct(F.col(value).alias("v")), F.col(order)).alias("_first"))
    onward = W.partitionBy(*keys).orderBy(block)
    firsts = firsts.select(*keys, block, F.lead("_first").over(onward).alias("_next_first"))
    inside = W.partitionBy(*keys, block).orderBy(order)
    own = F.lead(F.struct(F.col(value).alias("v"))).over(inside)
    out = df.withColumn("_own_next", own).join(firsts, [*keys, block], "left")
    return out.withColumn(name, F.coalesce("_own_next", "_next_first")["v"]).drop("_own_next", "_next_first")
