"""Readers and sinks on small hand-made files, and the streaming jobs."""

from __future__ import annotations

import json
import random
import shutil
import struct
import zlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cartolith.operators import corpus, features, spatial
from cartolith.sources import feeds, geojson, images, osm_json, radio_logs
from cartolith.streaming import feeds as live


def _png(width, height, pixels):
    def chunk(kind, data):
        body = kind + data
        return struct.pack(">I", len(data)) + body + struct.pack(">I", zlib.crc32(body))

    raw = b"".join(b"\x00" + b"".join(bytes(pixels(x, y)) for x in range(width)) for y in range(height))
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_elevation_tiles_from_png(spark, tmp_path):
    place = tmp_path / "9" / "270"
    place.mkdir(parents=True)
    (place / "180.png").write_bytes(_png(4, 4, lambda x, y: (128, x + 10 * y, 64)))
    tiles = images.read_tiles(spark, str(tmp_path))
    row = tiles.first()
    assert (row["z"], row["x"], row["y"], row["width"]) == (9, 270, 180, 4)
    assert images.centre_elevation(tiles).first()["elevation_m"] == 128 * 256 + 22 + 64 / 256 - 32768
    px = {(r["row_no"], r["col_no"]): r["h"] for r in images.tile_pixels(tiles).collect()}
    assert px[(3, 1)] == 31 + 0.25


def test_sharp_pictures_score_higher(spark):
    rnd = random.Random(1)
    noise = bytes(rnd.randrange(256) for _ in range(64 * 64))
    flat = bytes(min(255, (i % 64) * 2 + i // 128) for i in range(64 * 64))
    df = spark.createDataFrame([("noise", bytearray(noise)), ("flat", bytearray(flat)), ("tiny", bytearray(b"x" * 64))], "n string, data binary")
    side = F.when(F.col("n") == "tiny", 8).otherwise(64)
    got = {r["n"]: r["d"] for r in df.select("n", images.image_detail(side, side, F.lit(1), "data").alias("d")).collect()}
    assert got["noise"] > 1.35 > got["flat"] and got["tiny"] == 0.0


def test_osm_answers(spark, tmp_path):
    pts = [{"lat": 1.0, "lon": 2.0}, {"lat": 1.0, "lon": 2.1}, {"lat": 1.1, "lon": 2.1}]
    els = [
        {"type": "way", "id": 1, "tags": {"building": "yes", "highway": "primary", "height": "12m"}, "geometry": pts},
        {"type": "way", "id": 2, "tags": {"highway": "motorway_link"}, "geometry": pts[:2]},
        {"type": "way", "id": 3, "tags": {"highway": "raceway", "landuse": "forest"}, "geometry": pts},
        {"type": "way", "id": 4, "tags": {"waterway": "river", "natural": "water"}, "geometry": pts},
        {"type": "way", "id": 5, "tags": {"leisure": "grass"}, "geometry": pts}, {"type": "node", "id": 6},
    ]
    (tmp_path / "a.json").write_text(json.dumps({"elements": els}))
    ways, refused = osm_json.read_ways(spark, str(tmp_path))
    full = {(r["id"], r["layer"], r["class"], r["height_m"]) for r in features.layers(ways).collect()}
    assert full == {(1, "building", None, 12.0), (2, "road", "motorway", None), (4, "waterway", "river", None), (5, "landuse", "grass", None)}
    tile = {(r["id"], r["layer"], r["class"]) for r in features.layers(ways, "tile").collect()}
    assert tile == {(1, "building", None), (2, "road", "motorway"), (4, "landuse", "water")}
    assert refused.count() == 0 and osm_json.read_ways(spark, str(tmp_path), cap=6)[1].count() == 1
    (tmp_path / "n").mkdir()
    (tmp_path / "n" / "c.json").write_text('{"elements":[{"tags":{"ways":"42"}}]}')
    assert osm_json.read_way_count(spark, str(tmp_path / "n")).first()["ways"] == 42


def test_geojson_readers(spark, tmp_path):
    square = [[[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]]
    world = {"features": [
        {"properties": {"NAME": "One"}, "geometry": {"type": "Polygon", "coordinates": square}},
        {"properties": {"name": "Two"}, "geometry": {"type": "MultiPolygon", "coordinates": [square, [[[9, 9], [10, 9], [10, 10.5], [9, 9]]]]}},
    ]}
    (tmp_path / "w.json").write_text(json.dumps(world))
    countries = geojson.read_countries(spark, str(tmp_path / "w.json"))
    assert {(r["name"], len(r["polygons"])) for r in countries.collect()} == {("One", 1), ("Two", 2)}
    pts = spark.createDataFrame([(1.0, 1.0), (9.8, 9.5)], "lon double, lat double")
    hits = spatial.points_in_polygons(pts, geojson.country_rings(countries))
    assert sorted((r["name"], r["lon"]) for r in hits.collect()) == [("One", 1.0), ("Two", 1.0), ("Two", 9.8)]

    parts = {"features": [
        {"properties": {"O_KOTE": 46.7, "T_KOTE": 33.9}, "geometry": {"type": "Polygon", "coordinates": square}},
        {"properties": {"O_KOTE": 34.2, "T_KOTE": 33.9}, "geometry": {"type": "Polygon", "coordinates": square}},
        {"properties": {"O_KOTE": 50, "T_KOTE": 40}, "geometry": {"type": "MultiPolygon", "coordinates": [square, square]}},
        {"properties": {"O_KOTE": 50}, "geometry": {"type": "Polygon", "coordinates": square}},
    ]}
    (tmp_path / "p.json").write_text(json.dumps(parts))
    got = sorted(round(r["height_m"], 6) for r in geojson.read_city_parts(spark, str(tmp_path / "p.json")).collect())
    assert got == [10.0, 10.0, 12.8]

    cell = {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": square}, "properties": {"tile": "7/1/2", "status": "gap"}}
    (tmp_path / "s.json").write_text(json.dumps({"type": "FeatureCollection", "features": [cell, cell]}))
    stats = geojson.survey_stats(geojson.read_collection(spark, str(tmp_path / "s.json"))).first()
    assert (stats["cells"], stats["gaps"], stats["covered"]) == (2, 2, 0)


def _small_splits(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)


@pytest.mark.parametrize("size", [64, 1 << 27])
@pytest.mark.parametrize("indent", [None, 1])
def test_one_document_is_read_in_blocks(spark, tmp_path, size, indent):
    odd = ['{', '}', '"', "\\", '\\"}{', '"features":[', ', {"a": [', "\\\\", "é{漢", '": [{', ""]
    features = [
        {"type": "Feature", "properties": {"NAME": odd[k % len(odd)] + odd[k // 3 % len(odd)], "k": k, odd[k % 7] + "x": [{"in": [{}]}, "}"]},
         "geometry": {"type": "Polygon", "coordinates": [[[k, 0], [4, 0], [4, 4]]]}} for k in range(60)
    ]
    head = {"type": "FeatureCollection", "links": [{"href": "{"}, {"href": '"features":['}], "crs": {"type": "name", "properties": {"features": [{"k": -1}]}}}
    documents = {
        "a": {**head, "features": features}, "b": {"features": features[:3], **head}, "c": {"features": []}, "d": head,
        "e": {"features": [{"features": [{"k": -2}]}, {}]},
    }
    for name, document in documents.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(document, indent=indent, ensure_ascii=False))
    (tmp_path / "empty.json").write_text("")
    _small_splits(spark, size)
    try:
        texts = geojson.feature_texts(spark, str(tmp_path))
        got = texts.select(F.regexp_extract("file", "([a-z]+).json$", 1).alias("name"), F.to_json(F.parse_json("text")).alias("f")).collect()
        scanned = spark.read.option("lineSep", "{").text(str(tmp_path)).rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    plain = lambda f: json.dumps(f, sort_keys=True)
    want = sorted((name, plain(f)) for name, document in documents.items() for f in document.get("features", []))
    assert sorted((r["name"], plain(json.loads(r["f"]))) for r in got) == want
    assert size > 64 or scanned > 100


def test_log_is_read_in_blocks(spark, tmp_path):
    lines = [f"line {k} " + "x" * (k % 37) if k % 5 else "" for k in range(400)]
    (tmp_path / "a.csv").write_bytes("\r\n".join(lines).encode())
    (tmp_path / "b.csv").write_bytes(("\n".join(lines[:50]) + "\n").encode())
    (tmp_path / "c.csv").write_bytes(b"one\rtwo\rthree")
    (tmp_path / "d.csv").write_bytes(b"")
    _small_splits(spark, 100)
    try:
        rows = radio_logs.read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = {}
    for r in rows:
        got.setdefault(r["file"][-5], []).append((r["line_no"], r["raw"]))
    want = {"a": lines, "b": lines[:50], "c": ["one", "two", "three"]}
    assert {k: sorted(v) for k, v in got.items()} == {k: list(enumerate(v, 1)) for k, v in want.items()}


def test_manifests(spark, tmp_path):
    good = "ab" * 32
    (tmp_path / "c.json").write_text(json.dumps({"zed": {"sha256": good, "size": 3}, "amy": {"sha256": good, "frames": [good]}, "bad": {"sha256": "x"}}))
    rows = feeds.read_characters(spark, str(tmp_path / "c.json")).collect()
    assert [(r["name"], r["size"], r["frames"]) for r in rows] == [("amy", 0, [good]), ("zed", 3, None)]
    ok = {"m_per_px": 0.5, "width_px": 2, "height_px": 2, "source": {"id": "a", "name": "b", "license": "c", "attribution": "d"}}
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "1.json").write_text(json.dumps(ok))
    (tmp_path / "d" / "2.json").write_text(json.dumps({**ok, "source": {"id": "a"}}))
    kept, refused = feeds.read_deliveries(spark, str(tmp_path / "d"))
    assert kept.count() == 1 and refused.first()["missing"] == ["source.name", "source.license", "source.attribution"]


def _events(n):
    import hashlib

    rows = []
    for i in range(n):
        who = "hot" if i % 3 else f"p{i % 4}"
        row = [who, 1000 + i // 5, 30315, [["name", f"n{i}"], ["x", "s"], ["bbox", "10,20"]], f"m{i}"]
        text = json.dumps([0, *row], separators=(",", ":"), ensure_ascii=False)
        rows.append(dict(zip(("pubkey", "created_at", "kind", "tags", "content"), row), id=hashlib.sha256(text.encode()).hexdigest(), sig="s"))
    rows.append({**rows[0], "created_at": 99_999})  # forged: newer, but not its own hash
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_live_heads_do_not_depend_on_arrival(spark, tmp_path, seed):
    rows = _events(60)
    shuffled = rows[:]
    random.Random(seed).shuffle(shuffled)
    source = tmp_path / "in"
    source.mkdir()
    for i in range(4):
        part = shuffled[i::4]
        (source / f"{i}.json").write_text("\n".join(json.dumps(r) for r in part) + "\nnot json\n{}\n")
    (source / "again.json").write_text("\n".join(json.dumps(r) for r in shuffled[0::4]))
    stream = feeds.event_columns(feeds.stream_events(spark, str(source), 1))
    sink, checkpoint = str(tmp_path / "out"), str(tmp_path / "ck")
    each = lambda batch, n: live.write_batch(batch, sink, n)
    live.run_available(live.live_presences(stream), checkpoint, each, "update")
    heads = live.read_latest(spark, sink, ["pubkey"])
    got = {r["pubkey"]: r["id"] for r in heads.collect()}
    want = {}
    for r in rows[:-1]:
        best = want.get(r["pubkey"])
        if best is None or (-r["created_at"], r["id"]) < (-best["created_at"], best["id"]):
            want[r["pubkey"]] = r
    assert got == {k: r["id"] for k, r in want.items()}
    assert {r["lon"] for r in live.presences(heads).collect()} == {10.0}
    # A second run finds nothing new and changes nothing.
    live.run_available(live.live_presences(stream), checkpoint, each, "update")
    assert {r["pubkey"]: r["id"] for r in live.read_latest(spark, sink, ["pubkey"]).collect()} == got


def _clock_run(spark, root):
    schema = "k string, id string, now bigint"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    live.run_available(live.live_clock(stream, ["k"]), f"{root}/progress", lambda batch, n: live.write_batch(batch, f"{root}/out", n))
    return {r["id"]: (r["created_at"], r["code"], r["batch_id"]) for r in live.read_batches(spark, f"{root}/out").collect()}


def test_clock_continues_over_batches_and_restarts(spark, tmp_path):
    """The first address keeps its clock over batches, a restart and a lost earlier output."""
    root, schema = str(tmp_path), "k string, id string, now bigint"
    add = lambda *rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
    add(("a", "1", 100), ("a", "2", 100), ("a", "3", None), (None, "n", 5), (None, "m", 5))
    first = _clock_run(spark, root)
    assert sorted(first[i][0] for i in "12") == [100, 101] and first["3"][0] is None and first["3"][1] is not None
    assert sorted(first[i][0] for i in "nm") == [5, 6]
    add(("a", "4", 50), ("b", "5", 7), (None, "o", 1))
    shutil.rmtree(f"{root}/out/batch_id=0")  # what was published before is not read again
    then = _clock_run(spark, root)
    assert [then[i][0] for i in "45o"] == [102, 7, 7] and "1" not in then
    add(("a", "6", 2147483647), ("b", "7", 9))
    add(("a", "8", 3), ("b", "9", 9))
    last = _clock_run(spark, root)
    assert last["6"][:2] == (2147483647, None) and last["8"][:2] == (None, "CREATED_AT_RANGE")
    assert sorted(last[i][0] for i in "79") == [9, 10]


def test_clock_is_the_loop_in_order_of_arrival():
    rnd = random.Random(4)
    rows = [(rnd.choice([5, 5, 6, 90, 200_000, 2147483647]) if k % 9 else None) for k in range(400)]
    clock, at = live.PublishClock("now"), [None]

    class Last:
        exists, get, update = (lambda s: at[0] is not None), (lambda s: (at[0],)), (lambda s, v: at.__setitem__(0, v[0]))

    clock.last, got, want, last = Last(), [], [], None
    for a in range(0, 400, 37):
        part = rows[a : a + 37]
        frame = pd.DataFrame({"now": pd.array(part, "Int64"), "created_at": pd.array([None] * len(part), "Int64"), "code": [None if x is not None else "BAD" for x in part]})
        for out in clock.handleInputRows(("a",), iter([frame[:20], frame[20:]]), None):
            got += [(None if pd.isna(t) else int(t), c) for t, c in zip(out["created_at"], out["code"])]
    for now in rows:
        if now is None:
            want.append((None, "BAD"))
            continue
        t = now if last is None else max(now, last + 1)
        want.append((t, None) if t <= 2147483647 else (None, "CREATED_AT_RANGE"))
        last = t if t <= 2147483647 else last
    assert got == want


def test_ingest_goes_on_without_reading_the_store(spark, tmp_path):
    schema = "region string, kind string, z bigint, x bigint, y bigint, content binary, n_elements bigint, buildings bigint, roads bigint, landuse bigint, at bigint"
    rows = [("madeira", "dem", 13, 1, 1, b"sea", 0, 0, 0, 0, 5), ("madeira", "dem", 13, 1, 2, b"sea", 0, 0, 0, 0, 5),
            ("madeira", "features", 13, 1, 1, b"cut", 20000, 1, 1, 1, 5), ("madeira", "ortho", 13, 1, 1, b"", 0, 0, 0, 0, 5)]
    root = str(tmp_path)

    def take(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
        live.ingest(stream, f"{root}/store", f"{root}/progress")

    take(*rows)
    blobs = lambda: sorted(bytes(r["content"]) for r in live.read_batches(spark, f"{root}/store/blobs").collect())
    assert blobs() == [b"sea"]
    shutil.rmtree(f"{root}/store/blobs/batch_id=0")  # only the state knows the first content now
    take(("azores", "dem", 13, 2, 1, b"sea", 0, 0, 0, 0, 6), ("azores", "dem", 13, 2, 2, b"land", 0, 0, 0, 0, 6), ("azores", "dem", 13, 2, 3, None, 0, 0, 0, 0, 6))
    assert blobs() == [b"land"]
    results = live.read_latest(spark, f"{root}/store/results", corpus.ITEM_KEY)
    assert {(r["kind"], r["r_error"]) for r in results.where("region = 'madeira'").collect()} == {
        ("dem", None), ("features", "element cap reached, tile is incomplete"), ("ortho", "raster tile was empty")}
    items = corpus.seed(spark.createDataFrame([], "region string, kind string, z bigint, x bigint, y bigint, status string, attempts bigint, last_error string, sha256 string, bytes bigint, buildings bigint, roads bigint, landuse bigint, updated_at bigint"), results)
    state = corpus.progress(corpus.apply_results(items, results)).where("region = 'madeira'").first()
    assert (state["done"], state["failed"], state["total"]) == (2, 2, 4)
    assert live.read_latest(spark, f"{root}/store/index", ["sha256"]).count() == 2
