"""Source qualification, surveys, fallbacks and baked layers."""

from __future__ import annotations

from pyspark.sql import Observation
from pyspark.sql import functions as F

from cartolith.functions import boxes, gates, tiles
from cartolith.operators import coverage
from cartolith.session import cut_lineage, work_dir
from cartolith.sources import geojson
from cartolith.workloads import duck
from cartolith.workloads.registry import query

BOX = boxes.EDGES

_GATE = "(ok AND m_per_px <= 0.30 AND detail >= 1.35 AND density >= 120000)"
_VERDICT = """CASE WHEN detail < 1.35 OR density < 120000 THEN 'no coverage here — placeholder/upsampled'
 WHEN m_per_px <= 0.30 THEN 'architectural resolution' WHEN m_per_px <= 1.0 THEN 'site-plan resolution' ELSE 'context only' END"""


@query("c13_imagery_gates", f"SELECT doc_id, {_GATE} AS usable FROM v_probe", "v_probe")
def _(v):
    return v.v_probe.select("doc_id", gates.imagery_usable("ok", "m_per_px", "detail", "density").alias("usable"))


@query("b51_verdict_bands", f"SELECT doc_id, {_VERDICT} AS verdict FROM v_probe", "v_probe")
def _(v):
    return v.v_probe.select("doc_id", gates.imagery_verdict("m_per_px", "detail", "density").alias("verdict"))


@query("e17_payload_density", """
SELECT doc_id, round(n_chars / CASE WHEN (doc_id % 5) * 256 * 256 / 1e6 = 0 THEN 1e-9 ELSE (doc_id % 5) * 256 * 256 / 1e6 END / 1e3, 0) AS density_k FROM documents""")
def _(v):
    width = (F.col("doc_id") % 5) * 256
    return v.documents.select("doc_id", F.round(gates.bytes_per_megapixel("n_chars", width, F.lit(256)) / 1e3, 0).alias("density_k"))


_SURVEY = f"""judged AS (SELECT *, {_GATE} AS covered FROM v_probe),
best AS (SELECT cell, arg_min(doc_id, (NOT covered)::INT * 10 + rank) AS doc_id FROM judged GROUP BY cell),
cells AS (SELECT j.*, CASE WHEN ok THEN {_VERDICT} ELSE 'unreachable' END AS verdict, CASE WHEN covered THEN 'covered' WHEN elevation_m IS NULL THEN 'unknown' WHEN elevation_m <= 0.5 THEN 'sea' ELSE 'gap' END AS status,
  55 + j.cell % 18 AS x, 29 + j.cell // 18 AS y FROM best b JOIN judged j ON j.doc_id = b.doc_id),
boxed AS (SELECT *, x / 128e0 * 360e0 - 180e0 AS west, (x + 1) / 128e0 * 360e0 - 180e0 AS east, degrees(atan(sinh(pi() * (1e0 - 2e0 * (y + 1) / 128e0)))) AS south,
  degrees(atan(sinh(pi() * (1e0 - 2e0 * y / 128e0)))) AS north FROM cells)"""


def _cells(v):
    best = coverage.survey(v.v_probe, ["cell"])
    rows = best.withColumns({
        "z": F.lit(7).cast("bigint"), "x": 55 + F.col("cell") % 18, "y": 29 + F.floor(F.col("cell") / 18),
    })
    box = tiles.tile_box("z", "x", "y")
    return rows.withColumns({n: box[n] for n in BOX})


@query("d12_first_usable", f"WITH {_SURVEY} SELECT cell, source_id, covered, verdict, status FROM cells", "v_probe")
def _(v):
    return _cells(v).select("cell", "source_id", "covered", "verdict", "status")


@query("e02_survey_summary", f"""
WITH {_SURVEY}, s AS (SELECT count(*) AS cells, count(*) FILTER (covered) AS covered, count(*) FILTER (status = 'gap') AS gaps, count(*) FILTER (status = 'sea') AS sea,
  count(*) FILTER (status = 'unknown') AS unknown, sum({duck.flat_area()}) AS t, sum(CASE WHEN covered THEN {duck.flat_area()} ELSE 0 END) AS c FROM boxed)
SELECT cells, covered, gaps, sea, unknown, covered + gaps AS land_cells, round(100e0 * covered / (covered + gaps), 1) AS land_percent,
  round(100e0 * covered / cells, 1) AS percent, CAST(round(c) AS BIGINT) AS covered_km2, CAST(round(t) AS BIGINT) AS total_km2 FROM s""", "v_probe")
def _(v):
    return coverage.summarise(_cells(v))


@query("e03_cells_by_source", f"WITH {_SURVEY} SELECT source_id, count(*) AS n FROM cells WHERE covered GROUP BY source_id", "v_probe")
def _(v):
    return coverage.by_source(_cells(v))


@query("e03_roll_up", f"""
WITH {_SURVEY} SELECT status, src AS source_id, CAST(grouping_id(status, src) AS BIGINT) AS level, count(*) AS n FROM (SELECT status, CASE WHEN covered THEN source_id END AS src FROM cells) c
GROUP BY GROUPING SETS ((status), (src), ())""", "v_probe")
def _(v):
    return coverage.roll_up(_cells(v))


@query("e04_survey_header", f"""
WITH {_SURVEY} SELECT 'fixture' AS region, 7 AS zoom, count(*) AS cells, count(*) FILTER (covered) AS covered, count(*) FILTER (NOT covered) AS uncovered,
  count(*) FILTER (status = 'gap') AS gaps, count(*) FILTER (status = 'sea') AS sea FROM cells""", "v_probe")
def _(v):
    return coverage.header(_cells(v), "fixture", 7)


def _written(v):
    """The survey written as GeoJSON and read back."""
    path = work_dir(v.spark, "survey")
    cells = _cells(v)
    geojson.write_survey(cells, coverage.header(cells, "fixture", 7), path)
    return geojson.read_survey(v.spark, path)


@query("a05_survey_geojson", f"""
WITH {_SURVEY} SELECT concat('7/', x, '/', y) AS tile, covered, status, source_id AS source, round(m_per_px, 3) AS m_per_px, round(detail, 2) AS detail,
  round(density / 1000) AS kb_per_mp, verdict, round(west, 6) AS west, round(north, 6) AS north FROM boxed""", "v_probe")
def _(v):
    f = _written(v)[0]
    corner = F.col("geometry.coordinates")[0]
    return f.select(
        "properties.*", F.round(corner[0][0], 6).alias("west"), F.round(corner[2][1], 6).alias("north")
    )


@query("a19_bake_gaps", f"""
WITH {_SURVEY} SELECT concat('7/', x, '/', y) AS tile, floor(west * 1e4 + 0.5e0) / 1e4 AS west, floor(south * 1e4 + 0.5e0) / 1e4 AS south FROM boxed WHERE status = 'gap'""", "v_probe")
def _(v):
    baked = coverage.bake_gaps(_written(v)[0])
    corner = F.col("geometry.coordinates")[0][0]
    return baked.select(F.col("properties.tile").alias("tile"), corner[0].alias("west"), corner[1].alias("south"))


@query("e32_stats_per_file", f"""
WITH {_SURVEY} SELECT concat('survey-', CAST(x % 3 AS VARCHAR)) AS file, count(*) AS cells, count(*) FILTER (status = 'covered') AS covered,
  count(*) FILTER (status = 'gap') AS gaps, count(*) FILTER (status = 'sea') AS sea FROM boxed GROUP BY 1""", "v_probe")
def _(v):
    """Counts per written survey; each takes every third column of tiles."""
    path, cells = work_dir(v.spark, "surveys"), _cells(v)
    for k in range(3):
        part = cells.where(F.col("x") % 3 == k)
        geojson.write_survey(part, coverage.header(part, "fixture", 7), f"{path}/survey-{k}")
    features = v.spark.read.schema(geojson.POLYGON).json(f"{path}/*/features")
    return geojson.survey_stats(features.withColumn("file", F.regexp_extract(F.col("_metadata.file_path"), "(survey-[0-9]+)/features", 1)))


@query("j05_observed_counts", f"""
WITH {_SURVEY} SELECT count(*) AS cells, count(*) FILTER (covered) AS covered, count(*) FILTER (status = 'gap') AS gaps FROM boxed""", "v_probe")
def _(v):
    """Counts gathered while the survey is written, with no pass of their own."""
    seen = Observation("survey")
    cut_lineage(coverage.observe_cells(_cells(v), seen), "observed")
    names = ("cells", "covered", "gaps")
    return v.spark.createDataFrame([tuple(seen.get[n] for n in names)], "cells bigint, covered bigint, gaps bigint")


@query("a06_countries", "SELECT name, CAST(len(ring) AS BIGINT) AS n_points, round(ring[1].lon, 6) AS lon, round(ring[1].lat, 6) AS lat FROM v_polys", "v_polys")
def _(v):
    """Polygons written as one GeoJSON feature a line and read back as countries."""
    shape = F.array(F.transform("ring", lambda p: F.array(p["lon"], p["lat"])))
    geometry = F.struct(F.lit("Polygon").alias("type"), shape.alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(F.col("name").alias("NAME")).alias("properties"))
    path = work_dir(v.spark, "country-lines")
    v.v_polys.select(F.to_json(feature).alias("value")).write.text(path)
    ring = F.col("rings")[0]
    rows = geojson.country_rings(geojson.read_countries(v.spark, path, lines=True))
    return rows.select("name", F.size(ring).cast("bigint").alias("n_points"), F.round(ring[0]["lon"], 6).alias("lon"), F.round(ring[0]["lat"], 6).alias("lat"))


_COUNTRY = f"""WITH {_SURVEY}, land AS (SELECT (west + east) / 2e0 AS lon, (south + north) / 2e0 AS lat, status = 'gap' AS gap FROM boxed WHERE status IN ('covered', 'gap')),
edges AS (SELECT name, i, ring[i].lon * 2e0 AS xi, ring[i].lat AS yi, ring[CASE WHEN i = 1 THEN 6 ELSE i - 1 END].lon * 2e0 AS xj, ring[CASE WHEN i = 1 THEN 6 ELSE i - 1 END].lat AS yj
  FROM v_polys, (SELECT unnest(range(1, 7)) AS i) s),
hit AS (SELECT lon, lat, gap, name FROM land JOIN edges ON (yi > lat) <> (yj > lat) AND lon < (xj - xi) * (lat - yi) / (yj - yi) + xi GROUP BY ALL HAVING count(*) % 2 = 1)"""


def _countries(v):
    """Stretched view polygons stand in for countries."""
    wide = F.transform("ring", lambda p: F.struct((p["lon"] * 2.0).alias("lon"), p["lat"].alias("lat")))
    return v.v_polys.select("name", F.array(wide).alias("rings"))


@query("e05_country_gap_share", _COUNTRY + " SELECT name, count(*) AS land_cells, round(avg(gap::INT), 6) AS gap_share FROM hit GROUP BY name HAVING avg(gap::INT) >= 0.5", "v_probe v_polys")
def _(v):
    out = coverage.country_gaps(_cells(v), _countries(v))
    return out.withColumn("gap_share", F.round("gap_share", 6))


@query("a20_country_layer", _COUNTRY + """ SELECT h.name, land_cells, floor(gap_share * 100 + 0.5e0) / 100 AS gap_share, floor(ring[1].lon * 2e0 * 100 + 0.5e0) / 100 AS first_lon
FROM (SELECT name, count(*) AS land_cells, avg(gap::INT) AS gap_share FROM hit GROUP BY name HAVING avg(gap::INT) >= 0.5) h JOIN v_polys p ON p.name = h.name""", "v_probe v_polys")
def _(v):
    """Majority-gap countries with their shortened outline, written and read back."""
    share = coverage.country_gaps(_cells(v), _countries(v))
    r2 = lambda x: F.floor(x * 100.0 + 0.5) / 100.0
    outline = F.transform(F.col("rings")[0], lambda p: F.array(r2(p["lon"]), r2(p["lat"])))
    layer = share.join(_countries(v), "name").select("name", "land_cells", r2(F.col("gap_share")).alias("gap_share"), outline.alias("ring"))
    path = work_dir(v.spark, "countries")
    layer.write.json(path)
    read = v.spark.read.schema("name string, land_cells bigint, gap_share double, ring array<array<double>>").json(path)
    return read.select("name", "land_cells", "gap_share", F.col("ring")[0][0].alias("first_lon"))


_ATTEMPTS = "att AS (SELECT cell, rank, source_id, CASE WHEN NOT ok THEN 'TimeoutError' WHEN m_per_px > 0.35 THEN 'too coarse' END AS error FROM v_probe)"


@query("d13_first_success", f"""
WITH {_ATTEMPTS} SELECT cell, arg_min(source_id, rank) FILTER (error IS NULL) AS source_id,
  CASE WHEN count(*) FILTER (error IS NULL) = 0 THEN string_agg(concat(source_id, ': ', error), '; ' ORDER BY rank) END AS failures FROM att GROUP BY cell""", "v_probe")
def _(v):
    error = F.when(~F.col("ok"), "TimeoutError").when(F.col("m_per_px") > 0.35, "too coarse")
    attempts = v.v_probe.select("cell", "rank", "source_id", error.alias("error"))
    return coverage.first_success(attempts, "cell")


@query("d14_city_override", """
SELECT l_orderkey AS request, l_partkey AS part, 'measured' AS origin FROM lineitem WHERE l_returnflag = 'R' AND l_discount > 0.08
UNION ALL SELECT l_orderkey, l_partkey, 'mapped' FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_discount > 0.08)""")
def _(v):
    part = v.lineitem.select(F.col("l_orderkey").alias("request"), F.col("l_partkey").alias("part"), "l_returnflag", "l_discount")
    measured = part.where("l_returnflag = 'R' AND l_discount > 0.08").select("request", "part", F.lit("measured").alias("origin"))
    return coverage.city_override(measured, part.select("request", "part", F.lit("mapped").alias("origin")), "request")


_EVIDENCE = """ev AS (SELECT CASE WHEN d.lang = 'en' THEN 'basemap' ELSE 'imagery' END AS role, d.source AS candidate, CAST(substr(d.source, 4) AS BIGINT) AS rank, d.n_chars,
  l.quality, l.toxic FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
f AS (SELECT role, candidate, unnest(list_filter([CASE WHEN quality = 0 THEN 'sample_http_status' END, CASE WHEN toxic = 1 THEN 'contract.license' END,
  CASE WHEN n_chars > 9000 THEN 'sample_max_response_bytes' END], lambda x: x IS NOT NULL)) AS code FROM ev),
cand AS (SELECT e.role, e.candidate, e.rank, coalesce(string_agg(DISTINCT f.code, ',' ORDER BY f.code), '') AS failed FROM (SELECT DISTINCT role, candidate, rank FROM ev) e
  LEFT JOIN f ON f.role = e.role AND f.candidate = e.candidate GROUP BY e.role, e.candidate, e.rank)"""


def _evidence(v):
    rows = v.documents.join(v.labels, "doc_id")
    failed = F.array_compact(F.array(
        F.when(F.col("quality") == 0, "sample_http_status"), F.when(F.col("toxic") == 1, "contract.license"),
        F.when(F.col("n_chars") > 9000, "sample_max_response_bytes"),
    ))
    return rows.select(
        F.when(F.col("lang") == "en", "basemap").otherwise("imagery").alias("role"), F.col("source").alias("candidate"),
        F.substring("source", 4, 9).cast("bigint").alias("rank"), F.lit(True).alias("expect_live"), failed.alias("failed"),
    )


@query("e26_candidate_status", f"WITH {_EVIDENCE} SELECT role, candidate, failed, CASE WHEN failed = '' THEN 'live-verified' ELSE 'blocked' END AS status FROM cand", "")
def _(v):
    out = coverage.evaluate_candidates(_evidence(v))
    return out.select("role", "candidate", F.array_join("failed_fields", ",").alias("failed"), "status")


@query("e26_role_winner", f"""
WITH {_EVIDENCE} SELECT role, arg_min(candidate, rank) FILTER (failed = '') AS winner, CASE WHEN count(*) FILTER (failed = '') > 0 THEN 'live-verified' ELSE 'blocked' END AS status FROM cand GROUP BY role""", "")
def _(v):
    return coverage.role_winners(coverage.evaluate_candidates(_evidence(v))).select("role", "winner", "status")


@query("h05_failure_union", f"""
WITH {_EVIDENCE} SELECT candidate, string_agg(DISTINCT code, ',' ORDER BY code) AS failed FROM (SELECT candidate, code FROM f UNION ALL SELECT candidate, 'known' FROM ev WHERE rank > 15) u GROUP BY candidate""", "")
def _(v):
    known = F.when(F.col("rank") > 15, F.array(F.lit("known"))).otherwise(F.array().cast("array<string>"))
    rows = _evidence(v).withColumn("failed", F.array_union("failed", known))
    codes = rows.select("candidate", F.explode("failed").alias("f"))
    return codes.groupBy("candidate").agg(F.array_join(F.array_sort(F.collect_set("f")), ",").alias("failed"))


_REGISTRY_RULES = [
    ("license IS NULL OR trim(license) = ''", "LICENCE_MISSING"),
    ("regexp_matches(coalesce(license, ''), '(?i)\\b(various|multiple|see\\s+website|tbd|unknown)\\b')", "COMPOSITE_LICENCE_UNRESOLVED:vague"),
    ("sigma <= 0", "VERTICAL_UNCERTAINTY_UNDECLARED"),
    ("dense IS NOT NULL AND (dense < 8 OR dense > maxz)", "SOURCE_MALFORMED:dense"),
    ("8 > maxz", "SOURCE_MALFORMED:zoom"),
    ("tmpl NOT LIKE '%{y}%'", "SOURCE_MALFORMED:template"),
    ("delivery = 'direct' AND origin IS NULL", "SOURCE_MALFORMED:origin"),
    ("delivery = 'transcoded' AND origin IS NOT NULL", "SOURCE_MALFORMED:origin"),
]
_RULE_SQL = ", ".join(f"CASE WHEN {t} THEN '{k}' END" for t, k in _REGISTRY_RULES)
_SUPPLIER_SOURCES = """SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'various terms' ELSE 'CC-BY-4.0' END AS license, c_acctbal AS sigma,
 CASE WHEN c_custkey % 3 = 0 THEN CAST(c_nationkey AS BIGINT) END AS dense, CAST(6 + c_custkey % 9 AS BIGINT) AS maxz,
 CASE WHEN c_custkey % 4 = 0 THEN '/{z}/{x}.png' ELSE '/{z}/{x}/{y}.png' END AS tmpl, CASE WHEN c_custkey % 2 = 0 THEN 'direct' ELSE 'transcoded' END AS delivery,
 CASE WHEN c_custkey % 7 < 4 THEN 'https://h' END AS origin FROM customer"""


@query("c15_registry_rules", f"SELECT id, array_to_string(list_filter([{_RULE_SQL}], lambda x: x IS NOT NULL), ',') AS problems FROM ({_SUPPLIER_SOURCES}) s")
def _(v):
    k = F.col("c_custkey")
    none = F.lit(None)
    fields = {
        "license": F.when(k % 5 == 0, "").when(k % 5 == 1, "various terms").otherwise("CC-BY-4.0"), "attribution": F.col("c_name"),
        "source_count": none.cast("int"), "family_total": none.cast("int"), "family_count": none.cast("int"),
        "distinct_terms": none.cast("int"), "terms_by_name": none.cast("int"), "manifest_sha256": none.cast("string"),
        "manifest_url": none.cast("string"), "sigma_m": F.col("c_acctbal"), "dense_max_zoom": F.when(k % 3 == 0, F.col("c_nationkey")),
        "min_zoom": F.lit(8), "max_zoom": 6 + k % 9, "resolution_m": F.lit(1.0),
        "path_template": F.when(k % 4 == 0, "/{z}/{x}.png").otherwise("/{z}/{x}/{y}.png"),
        "delivery": F.when(k % 2 == 0, "direct").otherwise("transcoded"), "origin": F.when(k % 7 < 4, "https://h"),
    }
    return v.customer.select(k.alias("id"), F.array_join(gates.registry_problems(fields), ",").alias("problems"))


@query("e22_licence_census", """
SELECT s_nationkey AS source, count(*) AS families, CAST(sum(s_suppkey % 5 + 1) AS BIGINT) AS counted, sum(s_suppkey % 5 + 1) = 12 AS adds_up FROM supplier GROUP BY s_nationkey""")
def _(v):
    """Licence families of a composite source must add up to its declared source count."""
    rows = v.supplier.select(F.col("s_nationkey").alias("source"), (F.col("s_suppkey") % 5 + 1).alias("n"))
    out = rows.groupBy("source").agg(F.count("*").alias("families"), F.sum("n").alias("counted"))
    return out.withColumn("adds_up", F.col("counted") == 12)
