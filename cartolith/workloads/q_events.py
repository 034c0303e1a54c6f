"""Event grammar, builders, identity, filters and feed state."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartolith import constants as K
from cartolith.functions import boxes, events, geohash, grammar, numbers, tiles
from cartolith.functions._c import once
from cartolith.operators import corpus, feed
from cartolith.plans import announce
from cartolith.session import cut_lineage
from cartolith.workloads import duck
from cartolith.workloads.registry import query

BOX = boxes.EDGES

# --- grammar ---------------------------------------------------------------------------


@query("b70_dataset", """
SELECT c_custkey, CASE WHEN length(dataset) > 64 OR NOT regexp_full_match(dataset, '[a-z0-9]([a-z0-9._-]*[a-z0-9])?') THEN 'DATASET_GRAMMAR' END AS code FROM v_lens""", "v_lens")
def _(v):
    return v.v_lens.select("c_custkey", grammar.dataset_code("dataset").alias("code"))


@query("b71_hex64", "SELECT c_custkey, CASE WHEN length(hash) <> 64 OR hash <> lower(hash) THEN 'HEX64' END AS code FROM v_lens", "v_lens")
def _(v):
    return v.v_lens.select("c_custkey", grammar.hex64_code("hash").alias("code"))


@query("b72_text", "SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN 'TEXT_EMPTY' END AS code FROM v_lens", "v_lens")
def _(v):
    return v.v_lens.select("c_custkey", grammar.text_code("title").alias("code"))


@query("b73_mime", "SELECT c_custkey, CASE WHEN c_custkey % 4 IN (1, 2) THEN 'MIME_GRAMMAR' END AS code FROM v_lens", "v_lens")
def _(v):
    return v.v_lens.select("c_custkey", grammar.mime_code("mime").alias("code"))


@query("b74_url", "SELECT c_custkey, CASE WHEN c_custkey % 5 IN (1, 2, 3) THEN 'URL_GRAMMAR' END AS code FROM v_lens", "v_lens")
def _(v):
    return v.v_lens.select("c_custkey", grammar.url_code("url").alias("code"))


@query("b75_size", "SELECT c_custkey, CASE WHEN c_acctbal < 1 OR c_acctbal <> floor(c_acctbal) THEN 'SIZE_RANGE' END AS code FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN round(c_acctbal) ELSE c_acctbal END AS c_acctbal FROM v_lens) l", "v_lens")
def _(v):
    size = F.when(F.col("c_custkey") % 2 == 0, F.round("c_acctbal")).otherwise(F.col("c_acctbal"))
    return v.v_lens.select("c_custkey", grammar.size_code(size).alias("code"))


@query("b76_datetime", """
SELECT c_custkey, CASE c_custkey % 6 WHEN 1 THEN 'DATETIME_CALENDAR' WHEN 2 THEN 'DATETIME_CALENDAR' WHEN 3 THEN 'DATETIME_GRAMMAR' WHEN 5 THEN 'DATETIME_REQUIRED' END AS code FROM v_lens""", "v_lens")
def _(v):
    return v.v_lens.select("c_custkey", grammar.datetime_code("datetime").alias("code"))


@query("b77_created_at", "SELECT c_custkey, CASE WHEN t < 0 OR t > 2147483647 THEN 'CREATED_AT_RANGE' END AS code FROM (SELECT c_custkey, CAST(round(c_acctbal) AS BIGINT) * 500000 AS t FROM v_lens) l", "v_lens")
def _(v):
    return v.v_lens.select("c_custkey", grammar.created_at_code(F.round("c_acctbal").cast("bigint") * 500000).alias("code"))


_BAG = """CASE event_type WHEN 'error' THEN '[1]' WHEN 'signup' THEN '{"bad key":1}' WHEN 'click' THEN '{"n":1e300}' WHEN 'view' THEN NULL ELSE props END"""


@query("b79_properties", f"SELECT event_id, CASE event_type WHEN 'error' THEN 'PROPERTY_KEY_GRAMMAR' WHEN 'signup' THEN 'PROPERTY_KEY_GRAMMAR' WHEN 'click' THEN 'PROPERTY_NUMBER_RANGE' END AS code FROM events")
def _(v):
    return v.events.selectExpr("event_id", f"{_BAG} AS bag").select("event_id", numbers.properties_code("bag").alias("code"))


@query("b80_scalar_strings", "SELECT event_id, CASE WHEN event_type IN ('error', 'click') THEN 'STRING_NOT_SCALAR' END AS code FROM events")
def _(v):
    kind = F.col("event_type")
    text = (
        F.when(kind == "error", F.lit(r'{"a":"\ud800"}')).when(kind == "click", F.lit(r'{"a":"\udc00\ud83d"}'))
        .when(kind == "view", F.lit(r'{"a":"😀"}')).when(kind == "signup", F.lit(r'{"a":"\\ud800"}')).otherwise(F.col("props"))
    )
    return v.events.select("event_id", grammar.scalar_code(text).alias("code"))


@query("b18_canonical_number", """
SELECT o_orderkey, CASE WHEN contains(t, '.') THEN rtrim(rtrim(t, '0'), '.') ELSE t END AS text FROM (SELECT o_orderkey, CAST(o_totalprice / (1 + o_orderkey % 7) AS VARCHAR) AS t FROM orders) o""")
def _(v):
    value = F.col("o_totalprice") / (1 + F.col("o_orderkey") % 7)
    return v.orders.select("o_orderkey", numbers.canonical_number(value).alias("text"))


@query("b19_canonical_json", """SELECT event_id, concat('{"a":[', CAST(event_id AS VARCHAR), ',true],', substr(replace(props, ' ', ''), 2)) AS text FROM events""")
def _(v):
    """Sorted keys, no spaces, canonical numbers."""
    source = F.concat(F.substring(F.col("props"), F.lit(1), F.length("props") - 1), F.lit(', "a" : [ '), F.col("event_id").cast("string"), F.lit(".0, true ] }"))
    return v.events.select("event_id", numbers.canonical_json(source).alias("text"))


# --- addresses and tags ------------------------------------------------------------------------


@query("b36_item_address", """
WITH a AS (SELECT event_id, CASE WHEN z + event_id % 5 * 3 <= 22 AND event_id % 4 > 0 THEN concat('dem:', CAST(z + event_id % 5 * 3 AS VARCHAR), '/', CAST(x AS VARCHAR), '/', CAST(y AS VARCHAR)) END AS address, z, x, y FROM v_tiles)
SELECT event_id, address, CASE WHEN event_id % 3 > 0 THEN CAST(string_split(string_split(address, ':')[2], '/')[2] AS BIGINT) END AS x FROM a""", "v_tiles")
def _(v):
    e = F.col("event_id")
    rows = v.v_tiles.withColumn("zz", F.col("z") + e % 5 * 3).withColumn("name", F.when(e % 4 > 0, "dem").otherwise("De:m"))
    rows = rows.withColumn("address", events.item_address("name", "zz", "x", "y"))
    asked = F.when(e % 3 > 0, F.col("address")).otherwise(F.concat("address", F.lit("/0")))
    return rows.select("event_id", "address", events.parse_item_address(asked)["x"].alias("x"))


@query("b37_collection_address", "SELECT c_custkey, concat('30550:', hash, ':', dataset) AS address FROM v_lens", "v_lens")
def _(v):
    return v.v_lens.select("c_custkey", events.collection_address("hash", "dataset").alias("address"))


def _flat(tags):
    return F.array_join(F.transform(tags, lambda t: F.array_join(t, "|")), ";")


@query("b38_collection_event", f"""
WITH {duck.canon('v_boxes', 'id', ['west', 'south', 'east', 'north'])}
SELECT b.id, CASE WHEN owner % 4 = 0 THEN 'TEXT_EMPTY' WHEN owner % 7 = 0 THEN 'MIME_GRAMMAR' END AS code, CASE WHEN owner % 4 > 0 AND owner % 7 > 0 THEN
 concat('d|dem;title|T', CAST(owner AS VARCHAR), ';bbox|', west_t, '|', south_t, '|', east_t, '|', north_t, ';m|', media_type, ';license|CC0;source|s;server|https://h') END AS tags
FROM v_boxes b JOIN canon c ON c.id = b.id""", "v_boxes")
def _(v):
    title = F.when(F.col("owner") % 4 == 0, " ").otherwise(F.concat(F.lit("T"), F.col("owner").cast("string")))
    mime = F.when(F.col("owner") % 7 == 0, "png").otherwise(F.col("media_type"))
    row = events.collection_event(F.lit("dem"), title, BOX, mime, F.lit("CC0"), F.lit("s"), F.lit("https://h"), "uploaded_at")
    return v.v_boxes.select("id", row.alias("r")).select("id", F.col("r.code").alias("code"), _flat(F.col("r.event.tags")).alias("tags"))


_TILE_EDGES = """tb AS (SELECT event_id, z, x, y, x / pow(2e0, z) * 360e0 - 180e0 AS west, (x + 1) / pow(2e0, z) * 360e0 - 180e0 AS east,
 degrees(atan(sinh(pi() * (1e0 - 2e0 * (y + 1) / pow(2e0, z))))) AS south, degrees(atan(sinh(pi() * (1e0 - 2e0 * y / pow(2e0, z))))) AS north,
 (x + 0.5e0) / pow(2e0, z) * 360e0 - 180e0 AS lon, degrees(atan(sinh(pi() * (1e0 - 2e0 * (y + 0.5e0) / pow(2e0, z))))) AS lat FROM v_tiles)"""


@query("b39_item_event", f"""
WITH {_TILE_EDGES}, {duck.canon('tb', 'event_id', ['west', 'east'])}
SELECT tb.event_id, {duck.gh('lat', 'lon', 4)} AS g, concat('dem:', CAST(z AS VARCHAR), '/', CAST(x AS VARCHAR), '/', CAST(y AS VARCHAR)) AS d, west_t AS west, east_t AS east, CAST(event_id + 1 AS VARCHAR) AS size
FROM tb JOIN canon USING (event_id)""", "v_tiles")
def _(v):
    sha = F.sha2(F.col("event_id").cast("string"), 256)
    rows = events.with_item_event(
        v.v_tiles, "r", F.lit("dem"), sha, "z", "x", "y", sha, F.concat(F.lit("https://h/"), sha), F.lit("image/png"), F.col("event_id") + 1,
        F.lit("2024-01-01T00:00:00Z"), F.lit(1700000000),
    )
    e = F.col("r.event")
    edge = F.split(F.regexp_extract(e["content"], r'\[([^\]]*)\]', 1), ",")
    return rows.select(
        "event_id", events.tag_value(e["tags"], "g").alias("g"), events.tag_value(e["tags"], "d").alias("d"),
        edge[0].alias("west"), edge[2].alias("east"), events.tag_value(e["tags"], "size").alias("size"),
    )


@query("b40_announcement", f"""
WITH {duck.canon('v_boxes', 'id', ['west', 'south', 'east', 'north'])}, g AS (SELECT id, {duck.gh('((south + north) / 2e0)', '((west + east) / 2e0)', 6)} AS h FROM v_boxes)
SELECT b.id, concat('x|', sha256, ';url|https://h/', sha256, ';m|', media_type, ';size|', CAST(size AS VARCHAR), ';bbox|', west_t, '|', south_t, '|', east_t, '|', north_t, ';',
 array_to_string(list_transform(range(1, 7), lambda n: concat('g|', substr(h, 1, CAST(n AS INT)))), ';')) AS tags FROM v_boxes b JOIN canon c ON c.id = b.id JOIN g ON g.id = b.id""", "v_boxes")
def _(v):
    rows = v.v_boxes.withColumn("cell", boxes.centre_hash(*BOX, 6))
    tags = events.announcement_tags("sha256", F.concat(F.lit("https://h/"), "sha256"), "media_type", "size", BOX, "cell")
    return rows.select("id", _flat(tags).alias("tags"))


_LADDER = "array_to_string(list_transform(range(1, 7), lambda n: concat('g|', substr(h, 1, CAST(n AS INT)))), ';')"
_PT = "printf('%.6f,%.6f,%.6f,%.6f', lon, lat, lon, lat)"


@query("b41_social_events", f"""
WITH f AS (SELECT *, {duck.gh('lat', 'lon', 6)} AS h, {duck.gh('lat', 'lon', 8)} AS h8 FROM v_feed)
SELECT event_id, concat('d|net;name|', name, ';x|', id, ';bbox|', {_PT}, ';t|here;', {_LADDER}) AS presence,
 concat('x|', id, ';url|u;m|model/gltf-binary;size|7;bbox|', {_PT}, ';heading|', printf('%.1f', slot * 0.3e0), ';t|avatar;name|', name, ';', {_LADDER}) AS placement,
 concat('d|meet-', CAST(created_at AS VARCHAR), '-', h8, ';title|', content, ';start|', CAST(created_at AS VARCHAR), ';location|', name, ';bbox|', {_PT}, ';t|meet;', {_LADDER}) AS meetup,
 printf('exploring %.4f, %.4f', lat, lon) AS message FROM f""", "v_feed")
def _(v):
    rows = v.v_feed.withColumn("cell", geohash.encode("lat", "lon", 8))
    return rows.select(
        "event_id", _flat(events.presence_tags("net", "id", "name", "lon", "lat", "cell", "here")).alias("presence"),
        _flat(events.placement_tags("id", F.lit("u"), F.lit(7), "name", "lon", "lat", "cell", F.col("slot") * 0.3, "avatar")).alias("placement"),
        _flat(events.meetup_tags("meet", "content", "created_at", "name", "lon", "lat", "cell", "meet")).alias("meetup"),
        events.presence_message(F.lit("  "), "lat", "lon").alias("message"),
    )


def _tagged(v, *extra):
    """Signed-looking feed rows: honest ids, except that errors carry a foreign one."""
    tag = events.tag
    pos = F.format_string("%.6f,%.6f", "lon", "lat")
    tags = F.array(
        tag("name", F.when(F.col("slot") > 0, F.col("name")).otherwise("")), tag("x", F.col("id")), tag("bbox", pos),
        tag("title", F.col("content")), tag("start", F.col("created_at").cast("string")),
        *[tag("g", F.substring("cell", 1, p)) for p in (3, 6, 4)], *extra,
    )
    rows = v.v_feed.withColumn("cell", once(geohash.encode("lat", "lon", 6)))
    rows = rows.withColumn("tags", once(tags)).withColumn("sig", F.lit("ab"))
    true_id = events.event_id("pubkey", "created_at", "kind", "tags", "content")
    return rows.withColumn("id", F.when(F.col("content") == "error", F.col("id")).otherwise(true_id))


def _stored(v):
    """The tagged feed as a stored event table, which is how a feed is read."""
    parts = max(6, -(-v.events.count() // 500_000))
    return cut_lineage(_tagged(v.spread("events", parts)), "feed-table")


_SERIAL = f"""ser AS (SELECT *, concat('[0,"', pubkey, '",', CAST(created_at AS VARCHAR), ',', CAST(kind AS VARCHAR), ',[["name","', CASE WHEN slot > 0 THEN name ELSE '' END, '"],["x","', id, '"],["bbox","', printf('%.6f,%.6f', lon, lat),
 '"],["title","', content, '"],["start","', CAST(created_at AS VARCHAR), '"],["g","', substr(h, 1, 3), '"],["g","', h, '"],["g","', substr(h, 1, 4), '"]],"', content, '"]') AS text FROM (SELECT *, {duck.gh('lat', 'lon', 6)} AS h FROM v_feed) f),
good AS (SELECT *, sha256(text) AS true_id FROM ser WHERE content <> 'error')"""


@query("b42_event_id", f"WITH {_SERIAL} SELECT event_id, sha256(text) AS id FROM ser", "v_feed")
def _(v):
    return _tagged(v).select("event_id", events.event_id("pubkey", "created_at", "kind", "tags", "content").alias("id"))


@query("c12_integrity", "SELECT content, count(*) FILTER (content <> 'error') AS kept, count(*) FILTER (content = 'error') AS tampered FROM v_feed GROUP BY content", "v_feed")
def _(v):
    good, bad = feed.split_integrity(_stored(v))
    rows = good.select("content", F.lit(1).alias("g")).unionByName(bad.select("content", F.lit(0).alias("g")))
    return rows.groupBy("content").agg(F.count_if(F.col("g") == 1).alias("kept"), F.count_if(F.col("g") == 0).alias("tampered"))


@query("b43_tag_values", f"""
SELECT event_id, CASE WHEN slot > 0 THEN name ELSE '' END AS name, concat(substr(h, 1, 3), ' ', h, ' ', substr(h, 1, 4)) AS cells FROM (SELECT *, {duck.gh('lat', 'lon', 6)} AS h FROM v_feed) f""", "v_feed")
def _(v):
    return _tagged(v).select("event_id", events.tag_value("tags", "name").alias("name"), F.array_join(events.tag_values("tags", "g"), " ").alias("cells"))


@query("f10_deepest_cell", f"SELECT event_id, {duck.gh('lat', 'lon', 6)} AS cell FROM v_feed", "v_feed")
def _(v):
    return _tagged(v).select("event_id", geohash.deepest(events.tag_values("tags", "g")).alias("cell"))


@query("b44_footprint_from_tags", """
SELECT id, CASE WHEN id % 4 = 0 THEN west END AS west, CASE WHEN id % 4 = 0 THEN north END AS north FROM v_boxes""", "v_boxes")
def _(v):
    text = lambda n: F.col(n).cast("string")
    k = F.col("id") % 4
    five = F.array(F.lit("bbox"), text("west"), text("south"), F.when(k == 1, F.lit("x")).otherwise(text("east")),
                   F.when(k == 2, text("south")).otherwise(text("north")))
    tag = F.when(k == 3, F.slice(five, 1, 4)).otherwise(five)
    box = events.footprint_from_tags(F.array(F.array(F.lit("m"), F.lit("x")), tag))
    return v.v_boxes.select("id", box["west"].alias("west"), box["north"].alias("north"))


@query("b45_presence_row", """
SELECT event_id, name, id AS sha256, round(lon, 6) AS lon, round(lat, 6) AS lat, content AS message, created_at FROM v_feed WHERE slot > 0 AND kind = 30315""", "v_feed")
def _(v):
    rows = _stored(v).where("kind = 30315").withColumn("p", events.presence("pubkey", "created_at", "content", "tags"))
    return rows.where("p IS NOT NULL").select("event_id", "p.name", "p.sha256", F.round("p.lon", 6).alias("lon"), F.round("p.lat", 6).alias("lat"), "p.message", "p.created_at")


@query("b46_meetup_label", "SELECT event_id, concat('📅 ', content, ' ', strftime(make_timestamp(created_at * 1000000), '%H:%M')) AS label FROM v_feed", "v_feed")
def _(v):
    return _tagged(v).select("event_id", events.meetup_label("tags").alias("label"))


@query("b47_rfc3339", "SELECT event_id, strftime(make_timestamp(epoch * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS text FROM v_points", "v_points")
def _(v):
    return v.v_points.select("event_id", events.rfc3339("epoch").alias("text"))


@query("a08_event_shape", """
SELECT event_id, CASE event_type WHEN 'error' THEN 'ID' WHEN 'click' THEN 'TAGS' WHEN 'signup' THEN 'KIND' END AS code FROM events""")
def _(v):
    """Events read from JSON text with a fixed schema; malformed ones carry a code."""
    from cartolith.sources.feeds import parse_events

    kind = F.col("event_type")
    doc = F.concat(
        F.lit('{"id":"'), F.when(kind == "error", "").otherwise("aa"), F.lit('","pubkey":"bb","kind":'), F.when(kind == "signup", '"x"').otherwise("1"),
        F.lit(',"created_at":'), F.col("event_id").cast("string"), F.lit(',"content":"","sig":"cc","tags":'),
        F.when(kind == "click", F.lit("[[null]]")).otherwise(F.lit('[["g","u"],[]]')), F.lit("}"),
    )
    parsed = parse_events(v.events.select("event_id", doc.alias("value")), keep=["event_id"])
    return parsed.select("event_id", events.shape_code("event").alias("code"))


# --- filters --------------------------------------------------------------------------------------

_ITEM_FEED = """SELECT event_id, sha2_id AS id, pubkey, CASE WHEN content = 'view' THEN 30550 ELSE 30551 END AS kind, created_at, d FROM f"""
_FEED_SQL = """f AS (SELECT e.event_id, e.id AS sha2_id, e.pubkey, e.content, e.created_at, concat('dem:', CAST(t.z AS VARCHAR), '/', CAST(t.x // 32 AS VARCHAR), '/', CAST(t.y // 32 AS VARCHAR)) AS d
 FROM v_feed e JOIN v_tiles t ON t.event_id = e.event_id), it AS (SELECT event_id, sha2_id AS id, pubkey, CASE WHEN content = 'view' THEN 30550 ELSE 30551 END AS kind, created_at, d FROM f)"""


def _item_feed(v):
    t = v.v_tiles.select("event_id", F.concat_ws("/", F.concat(F.lit("dem:"), F.col("z").cast("string")), F.floor(F.col("x") / 32).cast("string"), F.floor(F.col("y") / 32).cast("string")).alias("d"))
    kind = F.when(F.col("content") == "view", K.KIND_COLLECTION).otherwise(K.KIND_ITEM)
    return v.v_feed.join(t, "event_id").select("event_id", "id", "pubkey", kind.alias("kind"), "created_at", "d")


@query("c06_catalog", f"WITH {_FEED_SQL} SELECT event_id FROM it WHERE kind = 30550 ORDER BY created_at DESC, id LIMIT 500", "v_feed v_tiles")
def _(v):
    return feed.catalog(_item_feed(v)).select("event_id")


@query("c06_exact_tile", f"WITH {_FEED_SQL} SELECT event_id FROM it WHERE kind = 30551 AND d = 'dem:11/31/19' ORDER BY created_at DESC, id LIMIT 500", "v_feed v_tiles")
def _(v):
    return feed.exact_tile(_item_feed(v), "dem:11/31/19").select("event_id")


@query("g05_per_author_limit", f"WITH {_FEED_SQL} SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY pubkey ORDER BY created_at DESC, id) AS rn FROM it) x WHERE rn <= 3", "v_feed v_tiles")
def _(v):
    return feed.newest_per(_item_feed(v), ["pubkey"], 3).select("event_id")


_COVER = f"(({duck.lon_ix('east', 4)} - {duck.lon_ix('west', 4)} + 1) * ({duck.lat_iy('north', 4)} - {duck.lat_iy('south', 4)} + 1))"
_SIZED = "(SELECT view_id, west, south, west + (east - west) * (1 + view_id % 3) / 2e0 AS east, north FROM v_views)"


def _sized(v):
    return v.v_views.select("view_id", "west", "south", (F.col("west") + (F.col("east") - F.col("west")) * (1 + F.col("view_id") % 3) / 2.0).alias("east"), "north")


def _nearby(v, **options):
    name = F.when(F.col("event_id") % 3 == 0, "dem").otherwise("ortho")
    tags = F.array(F.array(F.lit("a"), events.collection_address(F.lit("aa"), name)))
    spots = v.v_points.select("event_id", geohash.encode("lat", "lon", 4).alias("g"), tags.alias("tags"))
    return feed.nearby(_sized(v), _item_feed(v).join(spots, "event_id"), "g", **options)


_NEARBY = f"""{_FEED_SQL}, near AS (SELECT w.view_id, it.event_id, row_number() OVER (PARTITION BY w.view_id ORDER BY it.created_at DESC, it.id) AS rn
 FROM (SELECT *, {_COVER} AS n FROM {_SIZED} s) w JOIN v_points p ON {duck.lon_ix('p.lon', 4)} BETWEEN {duck.lon_ix('w.west', 4)} AND {duck.lon_ix('w.east', 4)}
 AND {duck.lat_iy('p.lat', 4)} BETWEEN {duck.lat_iy('w.south', 4)} AND {duck.lat_iy('w.north', 4)} JOIN it ON it.event_id = p.event_id WHERE n <= 128 AND it.kind = 30551 """


@query("c06_nearby", f"""
SELECT w.view_id, p.event_id FROM (SELECT *, {_COVER} AS n FROM {_SIZED} s) w JOIN v_points p ON {duck.lon_ix('p.lon', 4)} BETWEEN {duck.lon_ix('w.west', 4)} AND {duck.lon_ix('w.east', 4)}
 AND {duck.lat_iy('p.lat', 4)} BETWEEN {duck.lat_iy('w.south', 4)} AND {duck.lat_iy('w.north', 4)} WHERE n <= 128""", "v_views v_points")
def _(v):
    """Every event of every view, by cell."""
    return _nearby(v, kind=None, limit=None)[0].select("view_id", "event_id")


@query("c06_nearby_collection", f"WITH {_NEARBY} AND it.event_id % 3 = 0) SELECT view_id, event_id FROM near WHERE rn <= 7", "v_views v_points v_feed v_tiles")
def _(v):
    """The seven newest items per view of one collection."""
    return _nearby(v, collection=f"{K.KIND_COLLECTION}:aa:dem", limit=7)[0].select("view_id", "event_id")


@query("c06_nearby_too_wide", f"SELECT view_id, CAST(n AS BIGINT) AS cells FROM (SELECT *, {_COVER} AS n FROM {_SIZED} s) w WHERE n > 128", "v_views")
def _(v):
    return _nearby(v)[1].select("view_id", "cells")


@query("c07_cell_filter", f"SELECT event_id FROM v_feed WHERE kind = 1063 AND {duck.gh('lat', 'lon', 3)} = {duck.gh('48.2e0', '11.5e0', 3)}", "v_feed")
def _(v):
    return feed.cell_filter(_stored(v), F.lit(48.2), F.lit(11.5), 3).select("event_id")


@query("c07_box_filter", f"""
SELECT w.view_id, p.event_id FROM v_views w JOIN v_feed p ON {duck.lon_ix('p.lon', 3)} BETWEEN {duck.lon_ix('w.west', 3)} AND {duck.lon_ix('w.east', 3)}
 AND {duck.lat_iy('p.lat', 3)} BETWEEN {duck.lat_iy('w.south', 3)} AND {duck.lat_iy('w.north', 3)} WHERE p.kind = 1063""", "v_views v_feed")
def _(v):
    return feed.box_filter(v.v_views, _stored(v), 3)[0].select("view_id", "event_id")


@query("c08_write_gate", "SELECT event_id, CASE WHEN user_id = 8 THEN 'accept' ELSE 'reject' END AS action FROM v_feed", "v_feed")
def _(v):
    import hashlib

    allowed = hashlib.sha256(b"author-8").hexdigest().upper()
    return feed.write_gate(v.v_feed, allowed).select("event_id", "action")


_NOW = 1706000000


@query("c10_fresh_notes", f"""
WITH {_SERIAL} SELECT event_id, kind FROM good WHERE kind IN (1, 1063, 31923) AND created_at >= {_NOW} - 172800""", "v_feed")
def _(v):
    table = _stored(v)
    rows = feed.fresh_notes(table.where("content <> 'error'"), _NOW)
    return rows.join(table.select("id", "event_id", "kind"), "id").select("event_id", "kind")


#: West, south, east and north of a view; no position lies on an edge.
_VIEW = (-5.0000003, -20.0000003, 200.0000003, 60.0000003)
_SPOT = f"""SELECT *, ({duck.lon_ix('lon', 6)} + 0.5e0) * 360e0 / 32768 - 180e0 AS spot_lon, ({duck.lat_iy('lat', 6)} + 0.5e0) * 180e0 / 32768 - 90e0 AS spot_lat FROM good"""
_SEEN = "{lat} BETWEEN -20.0000003 AND 60.0000003 AND ({lon} >= -5.0000003 OR {lon} <= -159.9999997)"


@query("c10_notes_in_view", f"""
WITH {_SERIAL} SELECT event_id, kind FROM ({_SPOT}) s WHERE kind IN (1, 1063, 31923) AND created_at >= {_NOW} - 172800 AND {_SEEN.format(lon='spot_lon', lat='spot_lat')}""", "v_feed")
def _(v):
    """Fresh notes in a view that crosses the 180th meridian."""
    table = _stored(v)
    rows = feed.fresh_notes(table.where("content <> 'error'"), _NOW, _VIEW)
    return rows.join(table.select("id", "event_id", "kind"), "id").select("event_id", "kind")


@query("g04_notes_newest_first", f"""
WITH {_SERIAL} SELECT event_id, CASE WHEN kind = 31923 THEN concat('📅 ', content, ' ', strftime(make_timestamp(created_at * 1000000), '%H:%M')) ELSE content END AS content
FROM good WHERE kind IN (1, 1063, 31923) AND created_at >= {_NOW} - 172800 ORDER BY created_at DESC, true_id LIMIT 100""", "v_feed")
def _(v):
    table = _stored(v)
    page = feed.newest(feed.fresh_notes(table.where("content <> 'error'"), _NOW), 100)
    return page.join(table.select("id", "event_id"), "id").select("event_id", "content")


# --- state -----------------------------------------------------------------------------------------


@query("f06_head_of_address", """
SELECT kind, pubkey, slot, event_id FROM (SELECT *, row_number() OVER (PARTITION BY kind, pubkey, slot ORDER BY created_at DESC, id) AS rn FROM v_feed) f WHERE rn = 1""", "v_feed")
def _(v):
    return feed.heads(v.v_feed, ["kind", "pubkey", "slot"]).select("kind", "pubkey", "slot", "event_id")


_TOPICS = _SERIAL.replace("""substr(h, 1, 4), '"]],"'""", """substr(h, 1, 4), '"],["t","', CASE WHEN slot > 0 OR created_at % 2 = 0 THEN 'here' ELSE 'elsewhere' END, '"]],"'""").replace(
    "SELECT *, sha256(text) AS true_id", "SELECT *, created_at % 2 = 0 AS owner_topic, sha256(text) AS true_id")


@query("f07_newest_status", f"""
WITH {_TOPICS} SELECT pubkey, name, message, created_at FROM (SELECT pubkey, name, slot, content AS message, created_at, row_number() OVER (PARTITION BY pubkey ORDER BY created_at DESC, true_id) AS rn FROM good WHERE kind = 30315 AND (slot > 0 OR owner_topic)) f WHERE rn = 1 AND slot > 0""", "v_feed")
def _(v):
    """A newer status without the topic does not hide a presence."""
    topic = events.tag("t", F.when((F.col("slot") > 0) | (F.col("created_at") % 2 == 0), "here").otherwise("elsewhere"))
    statuses = cut_lineage(_tagged(v, topic).where(F.col("kind") == 30315), "status-table")
    good, _bad = feed.split_integrity(feed.on_topic(statuses, "here"))
    return feed.newest_presences(good).select("pubkey", "name", "message", "created_at")


@query("f07_presences_in_view", f"""
WITH {_SERIAL} SELECT pubkey, name, created_at FROM (SELECT *, row_number() OVER (PARTITION BY pubkey ORDER BY created_at DESC, true_id) AS rn FROM good WHERE kind = 30315) f
WHERE rn = 1 AND slot > 0 AND {_SEEN.format(lon='lon', lat='lat')}""", "v_feed")
def _(v):
    """Authors whose newest status lies in the view."""
    good, _bad = feed.split_integrity(_tagged(v).where(F.col("kind") == 30315))
    return feed.newest_presences(good, view=_VIEW).select("pubkey", "name", "created_at")


@query("f08_publish_clock", """
SELECT event_id, CAST(rn + max(created_at - rn) OVER (PARTITION BY pubkey, slot ORDER BY rn) AS BIGINT) AS published FROM
(SELECT *, row_number() OVER (PARTITION BY pubkey, slot ORDER BY created_at, id) AS rn FROM v_feed) f""", "v_feed")
def _(v):
    asked = v.v_feed.select("event_id", "pubkey", "slot", "id", F.col("created_at").alias("now"))
    out = feed.publish_clock(asked, ["pubkey", "slot"])
    return out.select("event_id", F.col("created_at").alias("published"))


@query("h01_union_relays", "SELECT id, min(kind) AS kind FROM v_feed WHERE kind <> 7 OR slot > 0 GROUP BY id", "v_feed")
def _(v):
    """Two relays with overlapping answers, one row per id."""
    a, b = v.v_feed.where("kind <> 7"), v.v_feed.where("slot > 0")
    return feed.union_relays(a, b).select("id", "kind")


@query("c23_catalog_completeness", """
SELECT id, CASE WHEN owner % 3 = 0 THEN 'bbox,license' WHEN owner % 3 = 1 THEN 'm' ELSE '' END AS missing FROM v_boxes""", "v_boxes")
def _(v):
    t = events.tag
    full = F.array(t("bbox", "1"), t("license", "x"), t("server", "s"), t("m", "a/b"))
    k = F.col("owner") % 3
    tags = F.when(k == 0, F.slice(full, 3, 2)).when(k == 1, F.concat(full, F.array(t("m", "c/d")))).otherwise(full)
    out = feed.catalog_problems(v.v_boxes.select("id", tags.alias("tags")))
    return out.select("id", F.array_join("missing", ",").alias("missing"))


@query("d10_announce_done", """
SELECT region, kind, x, y % 8192 AS y, CASE WHEN x < 8192 THEN concat(kind, ':13/', CAST(x AS VARCHAR), '/', CAST(y % 8192 AS VARCHAR)) END AS d,
 CASE WHEN x < 8192 THEN strftime(make_timestamp(updated_at * 1000000), '%Y-%m-%dT%H:%M:%SZ') END AS acquired,
 CASE region WHEN 'madeira' THEN '-17.32' WHEN 'south-tyrol' THEN '10.38' WHEN 'vienna' THEN '16.18' ELSE '-25' END AS west
FROM v_items WHERE status = 'done' AND sha256 IS NOT NULL AND kind <> 'ortho'""", "v_items")
def _(v):
    """Announcements of finished tiles; a column past the last one of zoom 13 (8191) is no tile and has no item event."""
    ready, _refused = corpus.announceable(v.v_items.withColumn("y", F.col("y") % 8192))
    out = announce.assemble(ready, "https://h/", "ab" * 32, 1800000000).where("kind <> 'ortho'")
    item, coll = F.col("item.event"), F.col("collection.event")
    return out.select(
        "region", "kind", "x", "y", events.tag_value(item["tags"], "d").alias("d"),
        F.get_json_object(item["content"], "$.datetime").alias("acquired"), events.tag_value(coll["tags"], "bbox").alias("west"),
    )


@query("d10_refused", "SELECT region, count(*) AS n FROM v_items WHERE status <> 'done' OR sha256 IS NULL GROUP BY region", "v_items")
def _(v):
    return corpus.announceable(v.v_items)[1].groupBy("region").agg(F.count("*").alias("n"))


assert tiles is not None
