"""GeoJSON and JSON sources and sinks.

Features are written one per line, so a survey of any size is written by many tasks and
read back without one process holding the collection. A collection in one JSON document is cut
at its opening braces by the text source, so its blocks are read by many tasks; which braces
begin a feature follows from running counts of quotes and braces (:func:`feature_texts`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith.operators.ordered import running_by_block
from cartolith.session import cut_lineage

POLYGON = (
    "type string, geometry struct<type:string,coordinates:array<array<array<double>>>>, "
    "properties struct<tile:string,covered:boolean,status:string,source:string,m_per_px:double,"
    "detail:double,kb_per_mp:double,verdict:string>"
)
HEADER = "region string, zoom int, cells bigint, covered bigint, uncovered bigint, gaps bigint, sea bigint"


def write_survey(cells: DataFrame, head: DataFrame, path: str) -> None:
    """Write a survey: ``features`` (one per line) and ``header`` under one folder."""
    from cartolith.operators.coverage import cell_feature

    cells.select(cell_feature().alias("f")).select("f.*").write.json(f"{path}/features")
    head.write.json(f"{path}/header")


def read_survey(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(features, header) of a written survey."""
    features = spark.read.schema(POLYGON).json(f"{path}/features")
    return features, spark.read.schema(HEADER).json(f"{path}/header")


def feature_texts(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of every element of the ``features`` array of JSON documents, one document per file.

    A piece is the text between two opening braces. Quotes before it tell if it starts inside a string, braces before it how
    deep it lies; the last key or array opened at the level of the collection tells if an element belongs to ``features``.
    All three run inside blocks of a file first and over the blocks then, on rows without text. A text may end in what
    follows its feature, up to the next brace; JSON functions stop at the end of the first value.
    """
    rows = spark.read.option("lineSep", "{").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), "value",
    )
    bare = F.regexp_replace("value", r"(?s)\\.", "")  # without escaped characters
    runs = F.split(bare, '"', -1)

    def closing(start):
        """Closing braces outside strings, for a piece that starts outside (0) or inside (1) of one."""
        outside = F.array_join(F.filter(runs, lambda _, i: i % 2 == start), "")
        return F.length(outside) - F.length(F.translate(outside, "}", ""))

    pieces = cut_lineage(rows.select(
        "file", "block", "at", "value", (F.size(runs) - 1).alias("quotes"), closing(0).alias("out"), closing(1).alias("in"),
        bare.rlike(r"[:\[]\s*$").alias("opens"), bare.rlike(r'"features"\s*:\s*\[\s*$').alias("listed"),
    ), "json-pieces")

    key, by = ["file", "block", "at"], (["file"], "block", "at")
    thin = running_by_block(pieces.drop("value"), *by, {
        "quoted": ("sum", F.col("quotes"), True), "earlier": ("sum", F.lit(1), True),
    })
    brace = (F.col("earlier") > 0) & (F.col("quoted") % 2 == 0)  # no brace stands before the first piece
    step = brace.cast("int") - F.when(F.col("quoted") % 2 == 0, F.col("out")).otherwise(F.col("in"))
    thin = cut_lineage(thin.select(
        *key, brace.alias("brace"), step.alias("step"), (F.col("opens") & ((F.col("quoted") + F.col("quotes")) % 2 == 0)).alias("opens"), "listed",
    ), "json-steps")
    thin = running_by_block(thin, *by, {"depth": ("sum", F.col("step"), True)})
    opened = F.when(F.col("opens") & (F.col("depth") + F.col("step") == 1), F.struct("block", "at", "listed"))
    thin = cut_lineage(thin.select(*key, (F.col("brace") & (F.col("depth") == 1)).alias("starts"), opened.alias("opened")), "json-depths")
    thin = running_by_block(thin, *by, {"no": ("sum", F.col("starts").cast("int"), False), "under": ("max", F.col("opened"), True)})
    thin = thin.select(*key, "no", (F.col("starts") & F.coalesce(F.col("under.listed"), F.lit(False))).alias("feature"))
    whole = pieces.select(*key, "value").join(thin.where("no > 0"), key).groupBy("file", "no").agg(
        F.max("feature").alias("feature"), F.expr("listagg(value, '{') WITHIN GROUP (ORDER BY block, at)").alias("text")
    )
    return whole.where("feature").select("file", F.concat(F.lit("{"), "text").alias("text"))


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    """Features of FeatureCollection documents, one document per file, with its path."""
    return feature_texts(spark, path).select("file", F.from_json("text", POLYGON).alias("f")).select("file", "f.*")


def survey_stats(features: DataFrame) -> DataFrame:
    """Counts per survey file; ``features`` carries a ``file`` column."""
    state = lambda s: F.count_if(F.col("properties.status") == s)
    return features.groupBy("file").agg(
        F.count("*").alias("cells"), state("covered").alias("covered"), state("gap").alias("gaps"),
        state("sea").alias("sea"),
    )


def read_features(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Features as a variant column ``f``: of whole documents, or with ``lines`` one per line; both are read by many tasks."""
    texts = spark.read.text(path) if lines else feature_texts(spark, path).select(F.col("text").alias("value"))
    return texts.select(F.parse_json("value").alias("f"))


def read_countries(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Country polygons; a Polygon is read as a MultiPolygon of one."""
    # Two property spellings differ only in case, so properties are read from a variant.
    rows = read_features(spark, path, lines)
    kind = F.variant_get("f", "$.geometry.type", "string")
    one = F.try_variant_get("f", "$.geometry.coordinates", "array<array<array<double>>>")
    many = F.try_variant_get("f", "$.geometry.coordinates", "array<array<array<array<double>>>>")
    polygons = F.when(kind == "Polygon", F.array(one)).otherwise(many)
    point = lambda p: F.struct(F.get(p, F.lit(0)).alias("lon"), F.get(p, F.lit(1)).alias("lat"))
    shaped = F.transform(polygons, lambda poly: F.transform(poly, lambda ring: F.transform(ring, point)))
    name = F.coalesce(
        F.try_variant_get("f", "$.properties.NAME", "string"), F.try_variant_get("f", "$.properties.name", "string"), F.lit("?")
    )
    return rows.select(name.alias("name"), shaped.alias("polygons")).where(F.col("polygons").isNotNull())


def country_rings(countries: DataFrame) -> DataFrame:
    """One row per polygon of a country, in the form the point-in-polygon join takes."""
    return countries.select("name", F.explode("polygons").alias("rings"))


def read_city_parts(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Measured building parts: outer rings with the height between roof and ground."""
    return city_parts(read_features(spark, path, lines))


def city_parts(features: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Rings and heights from building-part features (variant column ``f``)."""
    from cartolith.functions.osm import part_height

    kind = F.try_variant_get("f", "$.geometry.type", "string")
    one = F.try_variant_get("f", "$.geometry.coordinates", "array<array<array<double>>>")
    many = F.try_variant_get("f", "$.geometry.coordinates", "array<array<array<array<double>>>>")
    outer = F.when(kind == "Polygon", F.array(F.get(one, F.lit(0)))).when(
        kind == "MultiPolygon", F.transform(many, lambda p: F.get(p, F.lit(0)))
    )
    top = F.try_variant_get("f", "$.properties.O_KOTE", "double")
    ground = F.try_variant_get("f", "$.properties.T_KOTE", "double")
    rows = features.select(*(keep or []), part_height(top, ground).alias("height_m"), F.explode(outer).alias("r"))
    point = lambda p: F.struct(F.get(p, F.lit(0)).alias("lon"), F.get(p, F.lit(1)).alias("lat"))
    return rows.where(F.col("height_m").isNotNull() & (F.size("r") >= 3)).select(
        *(keep or []), F.transform("r", point).alias("ring"), "height_m"
    )
