"""Event sources: one JSON event per line, in batch or as a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith.functions._c import once

EVENT = (
    "id string, pubkey string, kind bigint, created_at double, content string, sig string, "
    "tags array<array<string>>"
)


def parse_events(lines: DataFrame, value: str = "value", keep: list[str] | None = None) -> DataFrame:
    """Text rows with a parsed ``event`` struct (null where the text is no JSON object).

    A number, object or list where a text belongs is no text: such a field is null, and so are
    ``tags`` that hold anything but lists of texts.
    """
    both = F.struct(F.from_json(F.col(value), EVENT, {"mode": "PERMISSIVE"}).alias("plain"), F.try_parse_json(F.col(value)).alias("typed"))
    rows = lines.select(*(keep or []), once(both).alias("_json"))
    plain, typed = F.col("_json.plain"), F.col("_json.typed")
    kind = lambda n: F.schema_of_variant(F.try_variant_get(typed, f"$.{n}", "variant"))
    fields = {name: F.when(kind(name) == "STRING", plain[name]) for name in ("id", "pubkey", "content", "sig")}
    lists = kind("tags").isin("ARRAY<ARRAY<STRING>>", "ARRAY<ARRAY<VOID>>", "ARRAY<VOID>")
    fields["tags"] = F.when(lists, plain["tags"])
    parsed = F.struct(*[fields.get(n, plain[n]).alias(n) for n in ("id", "pubkey", "kind", "created_at", "content", "sig", "tags")])
    return rows.select(*(keep or []), once(F.when(plain.isNotNull(), parsed)).alias("event"))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Batch read of newline-delimited events."""
    return parse_events(spark.read.text(path))


def stream_events(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Stream of newline-delimited events arriving as files."""
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return parse_events(reader.text(path))


def event_columns(parsed: DataFrame) -> DataFrame:
    """Well-shaped events as flat columns."""
    from cartolith.functions.events import shape_code

    good = parsed.where(shape_code("event").isNull()).select("event.*")
    return good.withColumn("created_at", F.col("created_at").cast("bigint"))


def read_characters(spark: SparkSession, path: str) -> DataFrame:
    """Name to content hash from manifest documents, one document per file."""
    return characters(spark.read.text(path, wholetext=True)).orderBy("name")


def characters(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Manifest entries of documents in ``value``; entries with a bad hash are left out."""
    entry = "map<string,struct<sha256:string,size:bigint,frames:array<string>>>"
    rows = docs.select(*(keep or []), F.explode(F.from_json("value", entry)).alias("name", "e"))
    hexa = lambda x: x.rlike("^[0-9a-f]{64}$")
    frames = F.when(F.coalesce(F.forall("e.frames", hexa), F.lit(False)), F.col("e.frames"))
    rows = rows.where(F.coalesce(hexa(F.col("e.sha256")), F.lit(False)))
    return rows.select(*(keep or []), "name", "e.sha256", F.coalesce("e.size", F.lit(0)).alias("size"), frames.alias("frames"))


DELIVERY = (
    "region string, m_per_px double, width_px double, height_px double, "
    "source struct<id:string,name:string,license:string,attribution:string>, warnings array<string>, notes array<string>"
)


def read_deliveries(spark: SparkSession, path: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """(delivery metadata, rejects): every provenance field is required."""
    docs = spark.read.schema(DELIVERY).option("multiLine", multi_line).json(path)
    docs = docs.withColumn("file", F.col("_metadata.file_path"))
    required = ["m_per_px", "width_px", "height_px", "source.id", "source.name", "source.license", "source.attribution"]
    missing = F.array_compact(F.array(*[F.when(F.col(n).isNull(), n) for n in required]))
    docs = docs.withColumn("missing", missing)
    return docs.where(F.size("missing") == 0).drop("missing"), docs.where(F.size("missing") > 0)
