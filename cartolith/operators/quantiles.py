"""Exact quantiles per key, also for keys that hold a large part of all rows.

Spark's exact ``percentile`` keeps the distinct values of a key in one task. Here equal values are counted first (a
map-side aggregate), and the wanted ranks are found by radix narrowing on the ordered bits of the double: counts per
leading 24 bits tell in which block a rank lies, only such blocks are cut further by the next 20 bits, and the last
20 bits order the values of the blocks left. A running count never goes over more blocks than those bits can tell
apart, wherever values cluster and however far an outlier lies. There is one path for every size, and the result is bit
for bit that of ``percentile``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Low bits that are left out at each level of the narrowing.
LEVELS = (40, 20)
MANTISSA, BIAS, LEAST_POWER = 52, 1023, -1022


def ordered_bits(value: Column) -> Column:
    """A bigint in the order of the finite doubles: their bits, negated for negative ones; zero for both zeros.

    The bits come from exact steps: scaling by a power of two rounds nothing.
    """
    size = F.abs(value)
    power = F.greatest(F.floor(F.log2(size)), F.lit(LEAST_POWER))
    # The logarithm may round up to the next power, or down from it.
    power = F.when(size < F.pow(F.lit(2.0), power), power - 1).when(size >= F.pow(F.lit(2.0), power) * 2, power + 1).otherwise(power)
    power = F.greatest(power, F.lit(LEAST_POWER))
    scaled = size / F.pow(F.lit(2.0), power) * float(1 << MANTISSA)  # an integer below 2**53; the leading one only from 2**LEAST_POWER on
    bits = (power - LEAST_POWER) * (1 << MANTISSA) + scaled.cast("bigint")
    return F.when(size == 0, F.lit(0)).otherwise(F.when(value < 0, -bits).otherwise(bits)).cast("bigint")


def exact_quantiles(df: DataFrame, keys: list[str], value: str, fractions: dict[str, float]) -> DataFrame:
    """One row per key with a column per fraction; linear interpolation between ranks.

    Nulls don't count. A value that is not finite stops the job by name.
    """
    v = F.col(value).cast("double")
    finite = F.when(F.isnan(v) | (F.abs(v) == float("inf")), F.raise_error(F.lit(f"{value} is not finite"))).otherwise(v)
    counts = df.where(F.col(value).isNotNull()).select(*keys, finite.alias("_v")).groupBy(*keys, "_v").agg(F.count("*").alias("_n"))
    # The bits are never null here, and said so: else a test for nulls with all their steps goes down to every input row.
    bits = F.coalesce(ordered_bits(F.col("_v")), F.lit(0).cast("bigint"))
    inside = counts.withColumns({"_k": bits, "_in": F.lit(0).cast("bigint"), "_before": F.lit(0).cast("bigint")})
    sized: list[str] = []
    for low in LEVELS:
        group = [*keys, "_in", "_before", *sized]
        inside = inside.withColumn("_b", F.shiftright("_k", low))
        blocks = inside.groupBy(*group, "_b").agg(F.sum("_n").alias("_m"))
        earlier = F.sum("_m").over(W.partitionBy(*group).orderBy("_b").rowsBetween(W.unboundedPreceding, -1))
        if not sized:
            blocks = blocks.withColumn("_size", F.sum("_m").over(W.partitionBy(*group)))
        blocks = blocks.withColumn("_upto", F.col("_before") + F.coalesce(earlier, F.lit(0)))
        ranks = [f(F.lit(q) * (F.col("_size") - 1)) for q in fractions.values() for f in (F.floor, F.ceil)]
        held = [(r >= F.col("_upto")) & (r < F.col("_upto") + F.col("_m")) for r in ranks]
        blocks = blocks.where(F.exists(F.array(*held), lambda x: x)).select(*keys, "_b", "_upto", "_size")
        inside = inside.select(*keys, "_v", "_n", "_k", "_b").join(blocks, [*keys, "_b"])
        inside = inside.select(*keys, "_v", "_n", "_k", F.col("_b").alias("_in"), F.col("_upto").alias("_before"), "_size")
        sized = ["_size"]
    upto = F.col("_before") + F.sum("_n").over(W.partitionBy(*keys, "_in").orderBy("_k"))
    found = inside.withColumn("_end", upto).withColumn("_start", F.col("_end") - F.col("_n"))

    def pick(q: float):
        at = F.lit(q) * (F.col("_size") - 1)
        held = lambda r: F.max(F.when((r >= F.col("_start")) & (r < F.col("_end")), F.col("_v")))
        low, high, spot = held(F.floor(at)), held(F.ceil(at)), F.max(at)
        between = (F.ceil(spot) - spot) * low + (spot - F.floor(spot)) * high
        return F.when((F.floor(spot) == F.ceil(spot)) | (low == high), low).otherwise(between)

    return found.groupBy(*keys).agg(*[pick(q).alias(n) for n, q in fractions.items()])
