"""Small helpers of the operators in this folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartolith.session import cut_lineage


def free_name(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` bears it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def filter_by_id(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs`` whose ``doc_id`` is (left_semi) or isn't (left_anti) in ``ids`` (doc_id); null equals null."""
    key = free_name(docs, "wanted_id")
    return docs.join(ids.select(F.col("doc_id").alias(key)), F.col("doc_id").cast("bigint").eqNullSafe(F.col(key)), how)


def ranked(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows``, stored, with their rank from 0 in ``order``: parts by range, then counts of the parts before."""
    keys = [F.col(c).asc_nulls_first() for c in order]
    place = F.monotonically_increasing_id()  # 2**33 times the part, plus the place in it
    stored = cut_lineage(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("place", place), name)
    part = F.shiftright("place", 33)
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each part
    starts = stored.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    return stored.join(starts, part == F.col("part")).withColumn("rank", F.col("before") + inside).drop("place", "part", "before")
