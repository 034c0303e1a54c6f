"""Radio range-test logs.

Order is the order of physical lines. A file is read in blocks of bytes by many tasks; a line's number is its
place in its block plus the lines of the blocks before. A file whose header is not the known one is refused as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith import constants as K
from cartolith.functions._c import first_code
from cartolith.operators.ordered import running_by_block


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, raw) with line numbers from 1. Spark's readers skip files of no bytes, so they give no row.

    Lines end in a line feed, a carriage return or both; the end of the last one is no further line.
    """
    rows = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), F.col("value").alias("raw"),
    )
    lines = running_by_block(rows, ["file"], "block", "at", {"line_no": ("sum", F.lit(1), False)})
    return lines.select("file", F.col("line_no").cast("bigint").alias("line_no"), "raw")


def split_lines(files: DataFrame) -> DataFrame:
    """Lines of whole file texts (columns file, value)."""
    text = F.regexp_replace("value", r"\r\n?", "\n")
    lines = F.posexplode(F.split(text, "\n", -1)).alias("at", "raw")
    return files.select("file", lines).select("file", (F.col("at") + 1).cast("bigint").alias("line_no"), "raw")


def split_files(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines of readable files without blanks and header, refused files).

    Each kept line knows the number of its file's last line with text.
    """
    text = lines.where(F.trim("raw") != "")
    head = lines.groupBy("file").agg(
        F.max(F.when(F.col("line_no") == 1, F.trim("raw"))).alias("head"),
        F.max(F.when(F.trim("raw") != "", F.col("line_no"))).alias("last_line"),
    )
    code = first_code(
        (F.col("last_line").isNull(), "FILE_EMPTY"),
        (~F.col("head").eqNullSafe(F.lit(K.RANGETEST_HEADER)), "UNKNOWN_HEADER"),
    )
    judged = head.withColumn("code", code)
    good = judged.where(F.col("code").isNull()).select("file", "last_line")
    kept = text.where(F.col("line_no") > 1).join(good, "file")
    return kept, judged.where(F.col("code").isNotNull()).select("file", "code")
