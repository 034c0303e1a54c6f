"""Blob store, work queue, merges, manifests and reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartolith import constants as K
from cartolith.functions import boxes, gates
from cartolith.operators import corpus, generate
from cartolith.plans.estimate import estimate
from cartolith.workloads import duck
from cartolith.workloads.registry import query
from cartolith.workloads.views import tile_x, tile_y

BOX = boxes.EDGES


# --- storage ------------------------------------------------------------------------------


@query("a11_new_blobs", """
SELECT sha256, min(doc_id) AS doc_id, substr(sha256, 1, 2) AS shard, concat(substr(sha256, 1, 2), '/', substr(sha256, 3, 2), '/', sha256) AS path
FROM v_blobs WHERE sha256 NOT IN (SELECT b.sha256 FROM v_blobs b JOIN labels l ON l.doc_id = b.doc_id) GROUP BY sha256""", "v_blobs")
def _(v):
    stored = v.v_blobs.join(v.labels, "doc_id").select("sha256")
    fresh = corpus.new_blobs(v.v_blobs, stored, key=["doc_id"])
    return fresh.select("sha256", "doc_id", corpus.shard().alias("shard"), corpus.blob_path().alias("path"))


@query("a12_stored_by_hash", """
SELECT doc_id, sha256, size FROM v_blobs WHERE sha256 IN (SELECT b.sha256 FROM v_blobs b JOIN labels l ON l.doc_id = b.doc_id WHERE toxic = 1)""", "v_blobs")
def _(v):
    wanted = v.v_blobs.join(v.labels.where("toxic = 1"), "doc_id").select("sha256")
    return corpus.stored_by_hash(v.v_blobs, wanted).select("doc_id", "sha256", "size")


@query("a21_cache_lookup", """
WITH c AS (SELECT DISTINCT substr(sha256(text), 1, 16) AS k FROM documents WHERE lang = 'en')
SELECT doc_id, substr(sha256(text), 1, 16) AS cache_key, k IS NOT NULL AS hit FROM documents LEFT JOIN c ON k = substr(sha256(text), 1, 16)""")
def _(v):
    cache = v.documents.where("lang = 'en'").select(corpus.cache_key("text").alias("cache_key")).distinct()
    return corpus.cache_lookup(v.documents, cache, "text").select("doc_id", "cache_key", "hit")


@query("b56_request_key", """
SELECT request_id, substr(sha256(printf('%s|%.6f,%.6f,%.6f,%.6f|%.3f', lod, west, south, east, north, target)), 1, 16) AS k FROM v_requests""", "v_requests")
def _(v):
    return v.v_requests.select("request_id", corpus.request_key("lod", BOX, "target").alias("k"))


@query("e27_dedup_ratio", """
SELECT owner, count(*) AS n, count(DISTINCT sha256) AS n_distinct, round(count(*) / count(DISTINCT sha256), 6) AS ratio FROM v_blobs GROUP BY owner""", "v_blobs")
def _(v):
    out = corpus.dedup_ratio(v.v_blobs, ["owner"])
    return out.withColumn("ratio", F.round("ratio", 6))


# --- index merges ----------------------------------------------------------------------------


@query("k01_upsert", """
WITH up AS (SELECT sha256, max(doc_id) AS doc_id FROM v_blobs b WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY sha256),
cur AS (SELECT sha256, min(doc_id) AS doc_id FROM v_blobs GROUP BY sha256)
SELECT cur.sha256, CASE WHEN up.sha256 IS NULL THEN cb.owner ELSE concat('new-', ub.owner) END AS owner,
       CASE WHEN up.sha256 IS NULL THEN cur.doc_id ELSE up.doc_id END AS doc_id
FROM cur JOIN v_blobs cb ON cb.doc_id = cur.doc_id LEFT JOIN up ON up.sha256 = cur.sha256 LEFT JOIN v_blobs ub ON ub.doc_id = up.doc_id""", "v_blobs")
def _(v):
    cols = ["sha256", "owner", "doc_id"]
    current = corpus.latest(v.v_blobs.select(*cols), ["sha256"], [-F.col("doc_id")])
    batch = v.v_blobs.join(v.labels.where("quality = 1"), "doc_id").select(
        "sha256", F.concat(F.lit("new-"), "owner").alias("owner"), "doc_id"
    )
    return corpus.upsert(current, batch, ["sha256"], [F.col("doc_id")])


_DELETE = """
req AS (SELECT l.doc_id, CASE WHEN toxic = 1 THEN 'zz' ELSE b.sha256 END AS sha256, CASE WHEN quality = 1 THEN b.owner ELSE 'src0' END AS pubkey
        FROM labels l JOIN v_blobs b ON b.doc_id = l.doc_id),
idx AS (SELECT sha256, min(owner) AS owner FROM v_blobs WHERE size > 500 GROUP BY sha256),
res AS (SELECT r.doc_id, r.sha256, CASE WHEN NOT regexp_full_match(r.sha256, '[0-9a-f]{64}') THEN 'BAD_HASH' WHEN i.sha256 IS NULL THEN 'NOT_FOUND'
        WHEN i.owner <> r.pubkey THEN 'NOT_OWNER' ELSE 'DELETED' END AS outcome FROM req r LEFT JOIN idx i ON i.sha256 = r.sha256)"""


def _deletes(v):
    asked = v.labels.join(v.v_blobs, "doc_id").select(
        "doc_id", F.when(F.col("toxic") == 1, "zz").otherwise(F.col("sha256")).alias("sha256"),
        F.when(F.col("quality") == 1, F.col("owner")).otherwise("src0").alias("pubkey"),
    )
    index = v.v_blobs.where("size > 500").groupBy("sha256").agg(F.min("owner").alias("owner"))
    return corpus.delete_blobs(index, asked)


@query("k02_delete_outcomes", f"WITH {_DELETE} SELECT doc_id, outcome FROM res", "v_blobs")
def _(v):
    return _deletes(v)[1].select("doc_id", "outcome")


@query("k02_index_after_delete", f"WITH {_DELETE} SELECT sha256, owner FROM idx WHERE sha256 NOT IN (SELECT sha256 FROM res WHERE outcome = 'DELETED')", "v_blobs")
def _(v):
    return _deletes(v)[0].select("sha256", "owner")


@query("g02_newest_of_owner", "SELECT id, uploaded_at FROM v_boxes WHERE owner = 149 ORDER BY uploaded_at DESC, sha256 LIMIT 500", "v_boxes")
def _(v):
    return corpus.newest_of_owner(v.v_boxes, 149).select("id", "uploaded_at")


_BOUND = f"""SELECT id, uploaded_at, size, media_type, sha256, w, s, e, n, tz, tx, ty FROM (SELECT *,
  CASE WHEN owner % 3 > 0 THEN west END AS w, CASE WHEN owner % 3 > 0 THEN south END AS s, CASE WHEN owner % 3 > 0 THEN east END AS e,
  CASE WHEN owner % 3 > 0 THEN north END AS n, CASE WHEN owner % 3 = 0 AND owner % 2 = 0 THEN 12 END AS tz,
  CASE WHEN owner % 3 = 0 AND owner % 2 = 0 THEN {tile_x('west', '12')} END AS tx,
  CASE WHEN owner % 3 = 0 AND owner % 2 = 0 THEN {tile_y('south', '12')} END AS ty FROM v_boxes) b"""


def _uploads(v):
    """Uploads that name a box, a tile or no place at all."""
    from cartolith.functions import tiles

    named = F.col("owner") % 3 > 0
    tiled = ~named & (F.col("owner") % 2 == 0)
    at = tiles.tile_for_point("south", "west", 12)
    rows = v.v_boxes.withColumns({
        "tile_z": F.when(tiled, F.lit(12).cast("bigint")), "tile_x": F.when(tiled, at["x"]), "tile_y": F.when(tiled, at["y"]),
    })
    return rows.withColumns({n: F.when(named, F.col(n)) for n in BOX})


@query("k08_bind_upload", f"""
WITH b AS ({_BOUND}), full_box AS (SELECT *, coalesce(w, tx / 4096e0 * 360e0 - 180e0) AS bw, coalesce(e, (tx + 1) / 4096e0 * 360e0 - 180e0) AS be,
  coalesce(s, degrees(atan(sinh(pi() * (1e0 - 2e0 * (ty + 1) / 4096e0))))) AS bs, coalesce(n, degrees(atan(sinh(pi() * (1e0 - 2e0 * ty / 4096e0))))) AS bn FROM b)
SELECT id, round(bw, 6) AS west, round(bs, 6) AS south, round(be, 6) AS east, round(bn, 6) AS north,
  CASE WHEN bw IS NOT NULL THEN coalesce(tz, 14) END AS tile_z,
  coalesce(tx, CASE WHEN bw IS NOT NULL THEN {tile_x('((bw + be) / 2e0)', '14')} END) AS tile_x,
  coalesce(ty, CASE WHEN bw IS NOT NULL THEN {tile_y('((bs + bn) / 2e0)', '14')} END) AS tile_y FROM full_box""", "v_boxes")
def _(v):
    out = corpus.bind_upload(_uploads(v))
    return out.select("id", *[F.round(n, 6).alias(n) for n in BOX], "tile_z", "tile_x", "tile_y")


@query("b49_descriptor", f"""
WITH b AS ({_BOUND}) SELECT sha256, size, media_type AS type, uploaded_at AS uploaded, concat('https://host/', sha256) AS url,
  w IS NOT NULL OR tz IS NOT NULL AS has_geo, tz IS NOT NULL OR w IS NOT NULL AS has_tile FROM b""", "v_boxes")
def _(v):
    rows = corpus.bind_upload(_uploads(v)).select(corpus.descriptor("https://host/").alias("d"))
    return rows.select(
        "d.sha256", "d.size", "d.type", "d.uploaded", "d.url",
        F.col("d.geo").isNotNull().alias("has_geo"), F.col("d.tile").isNotNull().alias("has_tile"),
    )


@query("k06_ingest_records", """
SELECT sha256, bytes AS size, CASE kind WHEN 'dem' THEN 'image/png' WHEN 'ortho' THEN 'image/jpeg' ELSE 'application/vnd.feature-tile' END AS media_type,
  concat('crawler:', region, ':', kind) AS owner, updated_at AS uploaded_at, round(x / 8192e0 * 360e0 - 180e0, 6) AS west,
  round(degrees(atan(sinh(pi() * (1e0 - 2e0 * (y % 8192) / 8192e0)))), 6) AS north, z AS tile_z, x AS tile_x, y % 8192 AS tile_y
FROM v_items WHERE status = 'done'""", "v_items")
def _(v):
    done = v.v_items.where("status = 'done'").withColumn("y", F.col("y") % 8192).withColumnRenamed("bytes", "size")
    out = corpus.ingest_records(done, F.col("updated_at"))
    return out.select(
        "sha256", "size", "media_type", "owner", "uploaded_at", F.round("west", 6).alias("west"),
        F.round("north", 6).alias("north"), "tile_z", "tile_x", "tile_y",
    )


# --- queue --------------------------------------------------------------------------------------


def _wanted(v):
    """All kinds of every tile that failed for some kind."""
    tiles_of = v.v_items.where("status = 'failed'").select("region", "z", "x", "y").distinct()
    return generate.with_literals(tiles_of, "kind", tuple(K.KIND_PRIORITY))


_WANTED = """wanted AS (SELECT DISTINCT region, k.kind, z, x, y FROM v_items i, (VALUES ('dem'), ('ortho'), ('features')) k(kind) WHERE i.status = 'failed')"""


@query("k03_seed", f"""
WITH {_WANTED} SELECT region, kind, z, x, y, status, attempts FROM v_items UNION ALL
SELECT region, kind, z, x, y, 'pending', 0 FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM v_items i WHERE i.region = w.region AND i.kind = w.kind
 AND i.z = w.z AND i.x = w.x AND i.y = w.y)""", "v_items")
def _(v):
    return corpus.seed(v.v_items, _wanted(v)).select(*corpus.ITEM_KEY, "status", "attempts")


@query("k03_reseed", f"""
WITH {_WANTED} SELECT coalesce(i.region, w.region) AS region, coalesce(i.kind, w.kind) AS kind, coalesce(i.z, w.z) AS z, coalesce(i.x, w.x) AS x,
  coalesce(i.y, w.y) AS y, CASE WHEN w.region IS NULL THEN i.status ELSE 'pending' END AS status,
  CASE WHEN w.region IS NULL THEN i.attempts ELSE 0 END AS attempts, CASE WHEN w.region IS NULL THEN i.last_error END AS last_error, i.sha256
FROM v_items i FULL OUTER JOIN wanted w ON i.region = w.region AND i.kind = w.kind AND i.z = w.z AND i.x = w.x AND i.y = w.y""", "v_items")
def _(v):
    out = corpus.reseed(v.v_items, _wanted(v))
    return out.select(*corpus.ITEM_KEY, "status", "attempts", "last_error", "sha256")


@query("d19_seed_anti_join", f"""
WITH {_WANTED} SELECT w.* FROM wanted w LEFT JOIN v_items i USING (region, kind, z, x, y) WHERE i.status IS NULL""", "v_items")
def _(v):
    return _wanted(v).join(v.v_items, corpus.ITEM_KEY, "left_anti").select(*corpus.ITEM_KEY)


@query("h06_legacy_rows", """
SELECT region, kind, z, x, y, status FROM v_items UNION ALL
SELECT CASE s_suppkey % 4 WHEN 0 THEN 'madeira' ELSE 'vienna' END, 'features', 13, s_suppkey, s_nationkey, 'done' FROM supplier s
WHERE NOT EXISTS (SELECT 1 FROM v_items i WHERE i.region = CASE s.s_suppkey % 4 WHEN 0 THEN 'madeira' ELSE 'vienna' END AND i.kind = 'features'
 AND i.z = 13 AND i.x = s.s_suppkey AND i.y = s.s_nationkey)""", "v_items")
def _(v):
    """Rows of a table without kinds join the queue as features, existing keys win."""
    legacy = v.supplier.select(
        F.when(F.col("s_suppkey") % 4 == 0, "madeira").otherwise("vienna").alias("region"), F.lit("features").alias("kind"),
        F.lit(13).cast("bigint").alias("z"), F.col("s_suppkey").alias("x"), F.col("s_nationkey").cast("bigint").alias("y"),
        F.lit("done").alias("status"),
    )
    fresh = legacy.join(v.v_items, corpus.ITEM_KEY, "left_anti")
    return v.v_items.select(*corpus.ITEM_KEY, "status").unionByName(fresh)


@query("l06_work_items", f"""
WITH t AS (SELECT view_id, x0 + unnest(range(CAST(x1 - x0 + 1 AS BIGINT))) AS x, y0, y1 FROM (SELECT view_id, {tile_x('west', '9')} AS x0,
  {tile_x('east', '9')} AS x1, {tile_y('north', '9')} AS y0, {tile_y('south', '9')} AS y1 FROM v_views) a),
u AS (SELECT view_id, x, y0 + unnest(range(CAST(y1 - y0 + 1 AS BIGINT))) AS y FROM t)
SELECT concat('view-', CAST(view_id AS VARCHAR)) AS region, kind, 9 AS z, x, y FROM u, (VALUES ('dem'), ('ortho'), ('features')) k(kind)""", "v_views")
def _(v):
    regions = v.v_views.withColumn("region", F.concat(F.lit("view-"), F.col("view_id").cast("string")))
    return generate.work_items(regions, zooms=(9,))


@query("d15_cells_by_candidates", """
SELECT view_id, candidate, zoom FROM v_views, (VALUES ('a'), ('b'), ('c')) c(candidate), (VALUES (12), (13), (14)) z(zoom)""", "v_views")
def _(v):
    rows = generate.with_literals(v.v_views.select("view_id"), "candidate", ("a", "b", "c"))
    return generate.with_literals(rows, "zoom", (12, 13, 14))


_RESULTS = """results AS (SELECT region, kind, z, x, y, CASE WHEN attempts % 2 = 0 THEN repeat('Timeout ', 80) END AS err, sha256('r' || x) AS sha,
  x + y AS bytes, x % 9 AS buildings, 1800000000 AS at FROM v_items WHERE status = 'pending')"""


@query("k04_apply_results", f"""
WITH {_RESULTS} SELECT i.region, i.kind, i.z, i.x, i.y, CASE WHEN r.region IS NULL THEN i.status WHEN err IS NULL THEN 'done' ELSE 'failed' END AS status,
  i.attempts + CASE WHEN r.region IS NULL THEN 0 ELSE 1 END AS attempts,
  CASE WHEN r.region IS NULL THEN i.last_error WHEN err IS NOT NULL THEN substr(err, 1, 500) END AS last_error,
  CASE WHEN r.region IS NOT NULL AND err IS NULL THEN r.sha ELSE i.sha256 END AS sha256,
  CASE WHEN r.region IS NOT NULL AND err IS NULL THEN r.bytes ELSE i.bytes END AS bytes,
  CASE WHEN r.region IS NOT NULL THEN r.at ELSE i.updated_at END AS updated_at
FROM v_items i LEFT JOIN results r ON i.region = r.region AND i.kind = r.kind AND i.z = r.z AND i.x = r.x AND i.y = r.y""", "v_items")
def _(v):
    results = v.v_items.where("status = 'pending'").select(
        *corpus.ITEM_KEY, F.when(F.col("attempts") % 2 == 0, F.repeat(F.lit("Timeout "), F.lit(80))).alias("r_error"),
        F.sha2(F.concat(F.lit("r"), F.col("x").cast("string")), 256).alias("r_sha256"),
        (F.col("x") + F.col("y")).alias("r_bytes"), (F.col("x") % 9).alias("r_buildings"),
        F.lit(1800000000).cast("bigint").alias("r_at"),
    )
    out = corpus.apply_results(v.v_items, results)
    return out.select(*corpus.ITEM_KEY, "status", "attempts", "last_error", "sha256", "bytes", "updated_at")


@query("k05_item_result", """
SELECT status, sha256, bytes, updated_at FROM v_items WHERE region = 'europe' AND kind = 'dem' AND z = 13 AND x = 1616 AND y = 5979""", "v_items")
def _(v):
    return corpus.item_result(v.v_items, "europe", "dem", 13, 1616, 5979)


_DUE = "status IN ('pending', 'failed') AND attempts < 4"


@query("g01_claim", f"""
SELECT region, kind, z, x, y FROM v_items WHERE region = 'madeira' AND {_DUE}
ORDER BY CASE kind WHEN 'dem' THEN 0 WHEN 'ortho' THEN 1 ELSE 2 END, attempts, y, x LIMIT 200""", "v_items")
def _(v):
    return corpus.claim(v.v_items, "madeira", 200)


@query("g01_claim_kind", f"""
SELECT region, kind, z, x, y FROM v_items WHERE region = 'europe' AND kind = 'ortho' AND {_DUE} ORDER BY attempts, y, x LIMIT 50""", "v_items")
def _(v):
    return corpus.claim(v.v_items, "europe", 50, kind="ortho")


@query("e01_progress", """
SELECT region, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'done') AS done,
  count(*) AS total, count(*) FILTER (attempts >= 4) AS exhausted FROM v_items GROUP BY region""", "v_items")
def _(v):
    return corpus.progress(v.v_items)


@query("f12_completion_over_time", """
SELECT region, updated_at, n, CAST(sum(n) OVER (PARTITION BY region ORDER BY updated_at) AS BIGINT) AS done_so_far
FROM (SELECT region, updated_at, count(*) AS n FROM v_items WHERE status = 'done' GROUP BY region, updated_at) t""", "v_items")
def _(v):
    return corpus.completion_over_time(v.v_items)


@query("c17_unknown_kinds", """
SELECT region, array_to_string(list_sort(list_filter(kinds, lambda k: NOT list_contains(['dem', 'ortho', 'features'], k))), ',') AS unknown
FROM (SELECT region, list(DISTINCT CASE WHEN attempts = 5 THEN concat(kind, '-old') ELSE kind END) AS kinds FROM v_items GROUP BY region) t""", "v_items")
def _(v):
    name = F.when(F.col("attempts") == 5, F.concat("kind", F.lit("-old"))).otherwise(F.col("kind"))
    asked = v.v_items.select("region", name.alias("k")).groupBy("region").agg(F.collect_set("k").alias("kinds"))
    return asked.select("region", F.array_join(gates.unknown_kinds("kinds"), ",").alias("unknown"))


@query("h03_kind_difference", """
SELECT CAST(z AS BIGINT) AS z, array_to_string(list_sort(list_filter(kinds, lambda k: NOT list_contains(['dem', 'ortho', 'features'], k))), ',') AS unknown
FROM (SELECT attempts AS z, list(DISTINCT CASE WHEN status = 'done' THEN kind ELSE concat('x-', kind) END) AS kinds FROM v_items GROUP BY attempts) t""", "v_items")
def _(v):
    name = F.when(F.col("status") == "done", F.col("kind")).otherwise(F.concat(F.lit("x-"), "kind"))
    asked = v.v_items.groupBy(F.col("attempts").alias("z")).agg(F.collect_set(name).alias("kinds"))
    return asked.select("z", F.array_join(gates.unknown_kinds("kinds"), ",").alias("unknown"))


@query("c22_ingest_guards", """
SELECT region, kind, x, y, CASE WHEN kind <> 'features' AND size > 4000000 THEN 'raster tile exceeded the approved size bound'
  WHEN kind <> 'features' AND size = 0 THEN 'raster tile was empty' WHEN kind = 'features' AND elements >= 20000 THEN 'element cap reached, tile is incomplete' END AS error
FROM (SELECT region, kind, x, y, attempts * 900000 AS size, y * 2 AS elements FROM v_items) t""", "v_items")
def _(v):
    error = gates.ingest_error("kind", F.col("attempts") * 900000, F.col("y") * 2)
    return v.v_items.select("region", "kind", "x", "y", error.alias("error"))


# --- manifests, announcements, reconciliation --------------------------------------------------------

_MEDIA = "CASE kind WHEN 'dem' THEN 'image/png' WHEN 'ortho' THEN 'image/jpeg' ELSE 'application/vnd.feature-tile' END"
_MATCH = f"""planned AS (SELECT DISTINCT y AS request_id, z, x, y, {_MEDIA} AS media_type FROM v_items),
have AS (SELECT z, x, y, media_type, min(sha256) AS sha256, min_by(bytes, sha256) AS size FROM (SELECT *, {_MEDIA} AS media_type FROM v_items WHERE status = 'done') d
  GROUP BY z, x, y, media_type),
m AS (SELECT p.*, h.sha256, h.size FROM planned p LEFT JOIN have h ON p.z = h.z AND p.x = h.x AND p.y = h.y AND p.media_type = h.media_type),
agg AS (SELECT request_id, count(*) AS tiles, count(sha256) AS found, CAST(sum(size) AS BIGINT) AS total_bytes FROM m GROUP BY request_id)"""


def _matched(v):
    media = F.when(F.col("kind") == "dem", "image/png").when(F.col("kind") == "ortho", "image/jpeg").otherwise(
        K.MEDIA_TYPES["features"]
    )
    items = v.v_items.withColumn("media_type", media)
    planned = items.select(F.col("y").alias("request_id"), "z", "x", "y", "media_type").distinct()
    stored = items.where("status = 'done'").select("z", "x", "y", "media_type", "sha256", F.col("bytes").alias("size"))
    return corpus.match_tiles(planned, stored)


@query("d09_manifest_tiles", f"WITH {_MATCH} SELECT request_id, x, media_type, sha256 FROM m", "v_items")
def _(v):
    return _matched(v).select("request_id", "x", "media_type", "sha256")


@query("d09_refused_requests", f"WITH {_MATCH} SELECT request_id, tiles - found AS missing FROM agg WHERE tiles > found", "v_items")
def _(v):
    return corpus.manifests(_matched(v))[1]


@query("e19_manifest_totals", f"WITH {_MATCH} SELECT request_id, tiles, total_bytes FROM agg WHERE tiles = found", "v_items")
def _(v):
    return corpus.manifests(_matched(v))[0]


_RECONCILE = """announced AS (SELECT DISTINCT CASE WHEN toxic = 1 THEN sha256(concat('bad', CAST(l.doc_id AS VARCHAR))) ELSE b.sha256 END AS sha256
  FROM labels l JOIN v_blobs b ON b.doc_id = l.doc_id),
stored AS (SELECT sha256, bool_and(sha256(CASE WHEN size < 400 THEN '' ELSE content END) = sha256) AS same FROM v_blobs WHERE owner <> 'src3' GROUP BY sha256)"""


@query("d11_reconcile", f"""
WITH {_RECONCILE} SELECT coalesce(a.sha256, s.sha256) AS sha256, CASE WHEN a.sha256 IS NULL THEN 'orphan' WHEN s.sha256 IS NULL THEN 'missing'
  WHEN NOT same THEN 'mismatch' ELSE 'ok' END AS status FROM announced a FULL OUTER JOIN stored s ON a.sha256 = s.sha256""", "v_blobs")
def _(v):
    said = v.labels.join(v.v_blobs, "doc_id").select(
        F.when(F.col("toxic") == 1, F.sha2(F.concat(F.lit("bad"), F.col("doc_id").cast("string")), 256))
        .otherwise(F.col("sha256")).alias("sha256")
    )
    kept = v.v_blobs.where("owner <> 'src3'").withColumn(
        "content", F.when(F.col("size") < 400, F.lit("")).otherwise(F.col("content"))
    )
    return corpus.reconcile(said, kept)


# --- placements ---------------------------------------------------------------------------------------

_PLACED = """cur AS (SELECT c_custkey AS seq, CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS pubkey, concat('n', CAST(c_custkey % 200 AS VARCHAR)) AS name, 'old' AS message FROM customer),
bat AS (SELECT s_suppkey AS seq, CASE s_nationkey % 2 WHEN 0 THEN 'BUILDING' ELSE 'MACHINERY' END AS pubkey, concat('n', CAST(s_suppkey AS VARCHAR)) AS name,
        nullif(substr(trim(concat('  ', repeat(s_name, 20))), 1, 280), '') AS message FROM supplier)"""


@query("k07_replace_placements", f"""
WITH {_PLACED} SELECT seq, pubkey, name, message FROM cur WHERE NOT EXISTS (SELECT 1 FROM bat WHERE bat.pubkey = cur.pubkey AND bat.name = cur.name)
UNION ALL SELECT seq, pubkey, name, message FROM bat""")
def _(v):
    current = v.customer.select(
        F.col("c_custkey").alias("seq"), F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("pubkey"),
        F.concat(F.lit("n"), (F.col("c_custkey") % 200).cast("string")).alias("name"), F.lit("old").alias("message"),
    )
    batch = v.supplier.select(
        F.col("s_suppkey").alias("seq"),
        F.when(F.col("s_nationkey") % 2 == 0, "BUILDING").otherwise("MACHINERY").alias("pubkey"),
        F.concat(F.lit("n"), F.col("s_suppkey").cast("string")).alias("name"),
        F.concat(F.lit("  "), F.repeat("s_name", F.lit(20))).alias("message"),
    )
    return corpus.replace_placements(current, batch)


@query("a09_placements_in_view", """
SELECT request_id, lod AS name, west AS lon, south AS lat FROM v_requests WHERE west BETWEEN 0 AND 8 AND south BETWEEN 40 AND 48""", "v_requests")
def _(v):
    placed = v.v_requests.select("request_id", F.col("lod").alias("name"), F.col("west").alias("lon"), F.col("south").alias("lat"))
    return placed.where(boxes.contains_point((0.0, 40.0, 8.0, 48.0), "lon", "lat"))


@query("d17_name_to_hash", """
SELECT c_custkey, sha AS sha256, CASE WHEN sha IS NULL THEN 'unknown character' END AS refusal FROM (SELECT c_custkey, concat('NATION_', CAST(c_nationkey + CASE WHEN c_acctbal < 0 THEN 50 ELSE 0 END AS VARCHAR)) AS n FROM customer) c
LEFT JOIN (SELECT n_name, sha256(n_name) AS sha FROM nation) m ON m.n_name = c.n""")
def _(v):
    """Names resolved against a manifest; a missing name is a refusal row."""
    manifest = v.nation.select(F.col("n_name").alias("name"), F.sha2("n_name", 256).alias("sha256"))
    number = F.col("c_nationkey") + F.when(F.col("c_acctbal") < 0, 50).otherwise(0)
    asked = v.customer.select("c_custkey", F.concat(F.lit("NATION_"), number.cast("string")).alias("name"))
    found = asked.join(manifest, "name", "left")
    return found.select("c_custkey", "sha256", F.when(F.col("sha256").isNull(), "unknown character").alias("refusal"))


# --- estimate --------------------------------------------------------------------------------------------

_PARTS = """parts AS (SELECT CAST(n_regionkey AS VARCHAR) AS plan, w.*, CASE WHEN view_id % 3 = 0 THEN -1e0 ELSE (1 + view_id % 4) / 4e0 END AS fraction,
  20000e0 + 1000e0 * view_id AS land FROM v_views w JOIN nation ON n_nationkey = view_id)"""


@query("e06_plan_estimate", f"""
WITH {_PARTS}, r AS (SELECT plan, zoom, land, (abs({tile_x('east', 'zoom')} - {tile_x('west', 'zoom')}) + 1) * (abs({tile_y('south', 'zoom')} - {tile_y('north', 'zoom')}) + 1) AS n,
  CASE WHEN fraction < 0 THEN least(1e0, land / {duck.sphere_area()}) ELSE fraction END AS f FROM parts, (VALUES (12), (13), (14)) z(zoom)),
g AS (SELECT plan, zoom, CAST(sum(n) AS BIGINT) AS tiles_bbox, sum(n * f) AS d, sum(land) AS land FROM r GROUP BY plan, zoom),
h AS (SELECT *, land * 43014e0 / pow(40075.017e0 * cos(radians(32.75e0)) / 8192e0, 2) * pow(3.86e0, zoom - 13) AS dl, d * 43014e0 * pow(0.965e0, zoom - 13) AS dh FROM g)
SELECT plan, zoom, tiles_bbox, CAST(floor(d) AS BIGINT) AS tiles_distinct, round(dl / 1e6, 4) AS dem_low_mb, round(dh / 1e6, 4) AS dem_high_mb,
  round((dl + d * 139699e0 * 0.02e0) / 1e6, 4) AS total_low_mb, round((dh + d * 139699e0 * 0.1e0) / 1e6, 4) AS total_high_mb, dh + d * 139699e0 * 0.1e0 <= 40e9 AS passes_gate FROM h""", "v_views")
def _(v):
    parts = v.v_views.join(v.nation, F.col("n_nationkey") == F.col("view_id")).select(
        F.col("n_regionkey").cast("string").alias("plan"), *BOX,
        F.when(F.col("view_id") % 3 == 0, -1.0).otherwise((1 + F.col("view_id") % 4) / 4.0).alias("distinct_fraction"),
        (20000.0 + 1000.0 * F.col("view_id")).alias("land_km2"),
    )
    out = estimate(parts)
    mb = lambda n: F.round(F.col(n) / 1e6, 4).alias(f"{n}_mb")
    return out.select(
        "plan", "zoom", "tiles_bbox", "tiles_distinct", mb("dem_low"), mb("dem_high"), mb("total_low"), mb("total_high"), "passes_gate"
    )
