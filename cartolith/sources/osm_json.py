"""OpenStreetMap way answers in JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith import constants as K

ANSWER = (
    "elements array<struct<type:string,id:bigint,tags:map<string,string>,"
    "geometry:array<struct<lat:double,lon:double>>>>"
)


def read_ways(spark: SparkSession, path: str, cap: int = K.ELEMENT_CAP) -> tuple[DataFrame, DataFrame]:
    """(ways, refused files). An answer as long as the request's cap was cut off."""
    docs = spark.read.schema(ANSWER).option("multiLine", True).json(path)
    docs = docs.withColumn("file", F.col("_metadata.file_path"))
    n = F.coalesce(F.size("elements"), F.lit(0))
    refused = docs.where(n >= cap).select("file", n.alias("elements"), F.lit("ELEMENT_CAP").alias("code"))
    ways = docs.where(n < cap).select("file", F.explode("elements").alias("e")).select("file", "e.*")
    return ways, refused


def read_way_count(spark: SparkSession, path: str) -> DataFrame:
    """Way count of count-only answers, null where the answer holds none."""
    schema = "elements array<struct<tags:map<string,string>>>"
    docs = spark.read.schema(schema).option("multiLine", True).json(path)
    first = F.get("elements", F.lit(0))["tags"]
    text = F.regexp_extract(F.coalesce(F.try_element_at(first, F.lit("ways")), F.lit("")), r"^\s*(-?[0-9]+)", 1)
    return docs.select(F.col("_metadata.file_path").alias("file"), F.nullif(text, F.lit("")).try_cast("bigint").alias("ways"))
