"""Operators against brute force, hot groups included."""

from __future__ import annotations

import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cartolith import constants as K
from cartolith.functions import boxes, tiles
from cartolith.operators import corpus, coverage, feed, fieldlog, raster, spatial
from cartolith.operators.ordered import next_in_block, running_by_block
from cartolith.operators.quantiles import LEVELS, exact_quantiles, ordered_bits
from cartolith.sources import feature_tiles, radio_logs

rnd = random.Random(7)


def _random_boxes(n):
    out = []
    for i in range(n):
        size = rnd.choice([0.0, 1e-4, 0.01, 0.3, 2.0, 40.0, 170.0])
        if i % 3 == 0:  # a third of all boxes in one small place
            w, s = 11.3 + rnd.random() / 100, 46.5 + rnd.random() / 100
        else:
            w, s = rnd.uniform(-180, 180 - size), rnd.uniform(-90, max(-90, 90 - size))
        out.append((i, w, s, min(180.0, w + size), min(90.0, s + size * 0.5)))
    out += [(n, -180.0, -90.0, 180.0, 90.0), (n + 1, 0.0, 0.0, 10.0, 10.0), (n + 2, 10.0, 0.0, 20.0, 10.0)]
    return out


@pytest.mark.parametrize("closed", [False, True])
def test_box_join_equals_brute_force(spark, closed):
    a, b = _random_boxes(150), _random_boxes(90)
    cols = "{0}id int, {0}w double, {0}s double, {0}e double, {0}n double"
    left = spark.createDataFrame(a, cols.format("a"))
    right = spark.createDataFrame(b, cols.format("b"))
    got = spatial.box_join(left, right, ("aw", "as", "ae", "an"), ("bw", "bs", "be", "bn"), closed=closed).select("aid", "bid")
    pairs = sorted((r["aid"], r["bid"]) for r in got.collect())
    if closed:
        want = [(x[0], y[0]) for x in a for y in b if x[1] <= y[3] and x[3] >= y[1] and x[2] <= y[4] and x[4] >= y[2]]
    else:
        want = [(x[0], y[0]) for x in a for y in b if x[1] < y[3] and x[3] > y[1] and x[2] < y[4] and x[4] > y[2]]
    assert pairs == sorted(want)


def test_point_in_polygon_with_hole(spark):
    ring = lambda pts: [{"lon": float(x), "lat": float(y)} for x, y in pts]
    shape = [("p", [ring([(0, 0), (10, 0), (10, 10), (0, 10)]), ring([(4, 4), (6, 4), (6, 6), (4, 6)])])]
    shapes = spark.createDataFrame(shape, "name string, rings array<array<struct<lon:double,lat:double>>>")
    pts = spark.createDataFrame([(1, 5.0, 5.0), (2, 1.0, 1.0), (3, 11.0, 5.0)], "id int, lon double, lat double")
    assert [r["id"] for r in spatial.points_in_polygons(pts, shapes).collect()] == [2]


def _plain_inside(rings, lon, lat):
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[-1:] + ring[:-1]):
            if (y1 > lat) != (y2 > lat) and lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1:
                odd = not odd
    return odd


def test_polygon_cover_equals_the_test_of_every_edge(spark):
    shape = lambda cx, cy, r, n: [(cx + r * rnd.uniform(0.3, 1) * math.cos(2 * math.pi * k / n), cy + r * rnd.uniform(0.3, 1) * math.sin(2 * math.pi * k / n)) for k in range(n)]
    box = lambda w, s, e, n: [(w, s), (e, s), (e, n), (w, n)]
    tangled = [(rnd.uniform(-40, 40), rnd.uniform(-40, 40)) for _ in range(60)]
    shapes = [
        [shape(0.0, 0.0, 30.0, 400)], [shape(10.0, 5.0, 20.0, 7), shape(10.0, 5.0, 4.0, 90)], [tangled], [box(-45.0, -22.5, 0.0, 22.5)],
        [box(0.0, 0.0, 11.25, 11.25), box(5.625, 0.0, 11.25, 5.625)], [shape(3.0, 3.0, 1e-7, 12)], [[(1.0, 1.0)]], [[(-30.0, 7.0), (30.0, 7.0)]],
        [box(-179.0, -89.0, 179.0, 89.0)], [[]], [], [box(-45.0, -22.5, 0.0, 22.5)], [[(0.0, -40.0), (0.0, 40.0), (1e-12, 40.0), (1e-12, -40.0)]],
        [[(20 * math.cos(k * math.pi / 500), 20 * math.sin(k * math.pi / 500)) for k in range(1000)]],
    ]
    points = [(rnd.uniform(-45, 45), rnd.uniform(-45, 45)) for _ in range(1500)] + [p for s in shapes[:8] for ring in s for p in ring[:40]]
    points += [(x * 5.625, y * 5.625) for x in range(-8, 9) for y in range(-8, 9)] + [(3.0 + rnd.uniform(-1e-7, 1e-7), 3.0 + rnd.uniform(-1e-7, 1e-7)) for _ in range(200)]
    points += [(x, rnd.choice(tangled)[1]) for x, _ in tangled] + [(5e-13, 2.0), (180.0, 90.0), (500.0, 0.0)]
    table = spark.createDataFrame(
        [(k, [[{"lon": x, "lat": y} for x, y in ring] for ring in rings]) for k, rings in enumerate(shapes)]
        + [(90, None), (91, [None]), (92, [[{"lon": None, "lat": 1.0}, {"lon": 1.0, "lat": 1.0}]])],
        "shape int, rings array<array<struct<lon:double,lat:double>>>",
    )
    rows = spark.createDataFrame([(k, *p) for k, p in enumerate(points)] + [(-1, None, 1.0), (-2, 1.0, None)], "id int, lon double, lat double")
    got = spatial.points_in_polygons(rows, table)
    assert got.columns == ["id", "lon", "lat", "shape", "rings"]
    want = sorted((k, n) for k, p in enumerate(points) for n, rings in enumerate(shapes) if _plain_inside(rings, *p))
    assert sorted((r["id"], r["shape"]) for r in got.select("id", "shape").collect()) == want and len(want) > 3000
    keyed = table.where("shape = 13").withColumn("_poly", F.lit("a"))
    cells = spatial.polygon_cover(spatial._leveled(keyed, "rings")).select(F.size("_edges").alias("n")).collect()
    assert sum(r["n"] == 0 for r in cells) > 500 and max(r["n"] for r in cells) < 40
    assert spatial.points_in_polygons(rows, table.limit(0)).count() == 0


def test_quantiles_equal_percentile_bit_for_bit(spark):
    rows = [("hot", rnd.choice([1e6, rnd.gauss(0, 1), 3.0])) for _ in range(3000)] + [(f"k{i % 7}", float(i)) for i in range(100)]
    rows += [("near", 1000 + rnd.random() / 1000) for _ in range(500)] + [("huge", x) for x in (-1.7e308, 1.7e308, 5e-324, 0.0, -0.0, None)]
    rows += [("one", 4.0), ("same", 2.5), ("same", 2.5), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    fractions = {f"q{k}": k / 100 for k in range(0, 101, 2)}
    want = df.where("v IS NOT NULL").groupBy("k").agg(*[F.percentile("v", F.lit(q)).alias(n) for n, q in fractions.items()])
    assert sorted(map(tuple, exact_quantiles(df, ["k"], "v", fractions).collect())) == sorted(map(tuple, want.collect()))
    with pytest.raises(Exception, match="v is not finite"):
        exact_quantiles(spark.createDataFrame([("a", 1.0), ("a", float("inf"))], "k string, v double"), ["k"], "v", {"m": 0.5}).collect()


def test_ordered_bits_are_those_of_the_double(spark):
    values = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, 1.0, 0.9999999999999999, -1.0, 8.0, 7.999999999999999]
    values += [math.ldexp(1, e) * f for e in range(-1074, 1023, 7) for f in (1, 1.5, -1)] + [rnd.gauss(0, 1) * 10 ** rnd.randint(-300, 300) for _ in range(2000)]
    values += [math.nextafter(2.0**e, d) for e in range(-1020, 1023, 5) for d in (0, math.inf)]
    bits = lambda v: struct.unpack("<q", struct.pack("<d", abs(v)))[0] * (1 if v > 0 else -1)
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r.k for r in df.select(ordered_bits(F.col("v")).alias("k")).collect()] == [bits(v) for v in values]


def test_quantiles_cut_a_dense_cluster_beside_an_outlier(spark):
    """20,000 values within a thousandth, half of all in a millionth, and one value far off."""
    values = [1000 + rnd.random() / 1000 for _ in range(10_000)] + [1000 + rnd.random() / 1_000_000 for _ in range(10_000)] + [1e300, -7.0]
    df = spark.createDataFrame([("a", v) for v in values], "k string, v double")
    fractions = {"lo": 0.02, "mid": 0.5, "hi": 0.98, "top": 1.0}
    want = df.groupBy("k").agg(*[F.percentile("v", F.lit(q)).alias(n) for n, q in fractions.items()])
    assert exact_quantiles(df, ["k"], "v", fractions).collect() == want.collect()
    cut = df.groupBy(F.shiftright(ordered_bits(F.col("v")), LEVELS[-1])).count()
    assert cut.count() > 5000 and cut.agg(F.max("count")).first()[0] < 2500


def test_outcomes_of_one_key_count_as_attempts_once(spark):
    items = spark.createDataFrame([("r", "dem", 1, 2, 3, "pending", 0, None, None, None, 0)], "region string, kind string, z bigint, x bigint, y bigint, status string, attempts int, last_error string, sha256 string, bytes bigint, updated_at bigint")
    results = spark.createDataFrame(
        [("r", "dem", 1, 2, 3, "late", None, None, 5), ("r", "dem", 1, 2, 3, None, "ab", 7, 9), ("r", "dem", 1, 2, 3, "x", None, None, 8)],
        "region string, kind string, z bigint, x bigint, y bigint, r_error string, r_sha256 string, r_bytes bigint, r_at bigint",
    )
    (row,) = corpus.apply_results(items, results).collect()
    assert (row.status, row.attempts, row.sha256, row.updated_at) == ("done", 3, "ab", 9)


def test_event_texts_must_be_texts(spark):
    from cartolith.sources import feeds

    good = '{"id":"a","pubkey":"b","kind":1,"created_at":5,"content":"c","sig":"d","tags":[["g","u"],[]]}'
    odd = [good.replace('"c"', "7"), good.replace('"a"', "12"), good.replace('"b"', '{"x":1}'), good.replace('"u"', "5")]
    lines = spark.createDataFrame([(x,) for x in [good, *odd]], "value string")
    assert feeds.event_columns(feeds.parse_events(lines)).count() == 1


def test_topic_is_tested_before_the_newest_status(spark):
    from cartolith.operators import feed

    rows = [("p", 100, "1", [["t", "here"]]), ("p", 200, "2", [["t", "there"]])]
    df = spark.createDataFrame(rows, "pubkey string, created_at bigint, id string, tags array<array<string>>")
    assert [r.id for r in feed.heads(feed.on_topic(df, "here"), ["pubkey"]).collect()] == ["1"]


def test_running_values_and_neighbours_by_block(spark):
    rows = [("hot" if i % 3 else f"k{i % 5}", i, rnd.randrange(50)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, t bigint, v bigint").withColumn("blk", F.floor(F.col("t") / 16))
    w = W.partitionBy("k").orderBy("t")
    plain = df.withColumns({
        "s": F.sum("v").over(w.rowsBetween(W.unboundedPreceding, 0)), "m": F.max("v").over(w.rowsBetween(W.unboundedPreceding, 0)),
        "nx": F.lead("v").over(w),
    })
    mine = running_by_block(df, ["k"], "blk", "t", {"s": ("sum", F.col("v"), False), "m": ("max", F.col("v"), False)})
    mine = next_in_block(mine, ["k"], "blk", "t", "v", "nx")
    cols = ["k", "t", "s", "m", "nx"]
    assert sorted(map(tuple, plain.select(cols).collect()), key=str) == sorted(map(tuple, mine.select(cols).collect()), key=str)


def test_publish_clock_is_the_loop(spark):
    rows = [("a" if i % 3 else "b", f"{i * 7919 % 10007:05x}", rnd.choice([5, 5, 6, 200_000, 2147483647])) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, id string, now bigint")
    last = spark.createDataFrame([("a", 90)], "k string, last bigint")
    got = {r["id"]: (r["created_at"], r["code"]) for r in feed.publish_clock(df, ["k"], last=last).collect()}
    state = {"a": 90}
    for k, id_, now in sorted(rows, key=lambda r: (r[2], r[1])):
        at = max(now, state[k] + 1) if k in state else now
        state[k] = at
        assert got[id_] == ((None, "CREATED_AT_RANGE") if at > 2147483647 else (at, None))


def test_head_ties_and_forgery(spark):
    rows = [("p", 5, "z", 1), ("p", 5, "b", 2), ("p", 4, "a", 3), ("q", 9, "c", 4)]
    df = spark.createDataFrame(rows, "pubkey string, created_at bigint, id string, n int")
    assert {(r["pubkey"], r["n"]) for r in feed.heads(df, ["pubkey"]).collect()} == {("p", 2), ("q", 4)}


def test_nearby_takes_items_of_a_collection_once_per_view(spark):
    views = spark.createDataFrame([(1, 9.0, 47.0, 9.4, 47.3), (2, -60.0, -60.0, 60.0, 60.0)], "view_id int, west double, south double, east double, north double")
    cells = [feed.geohash.encode(F.lit(47.1), F.lit(lon), 4) for lon in (9.1, 9.39)]
    here, there = spark.range(1).select(*[x.alias(f"c{k}") for k, x in enumerate(cells)]).first()
    mine, other = [["a", "30550:p:dem"]], [["a", "30550:p:ortho"]]
    rows = [("a", 30551, 5, here, mine), ("a", 30551, 5, there, mine), ("b", 30551, 9, here, other), ("c", 30550, 8, here, mine), ("d", 30551, 5, here, mine), ("e", 30551, 7, "zzzz", mine), ("f", 30551, 4, here, mine)]
    tagged = spark.createDataFrame(rows, "id string, kind int, created_at bigint, g string, tags array<array<string>>")
    ids = lambda **o: sorted(r.id for r in feed.nearby(views, tagged, "g", **o)[0].collect())
    assert ids() == ["a", "b", "d", "f"] and ids(limit=2) == ["a", "b"]
    assert ids(collection="30550:p:dem") == ["a", "d", "f"] and ids(collection="30550:p:dem", limit=1) == ["a"]
    assert [r.view_id for r in feed.nearby(views, tagged, "g")[1].collect()] == [2]


def test_storage_inventory_is_the_listing(spark, tmp_path):
    blobs = spark.createDataFrame([(f"{k % 5:02x}{k:062x}", bytes(k)) for k in range(300)], "sha256 string, content binary")
    corpus.write_blobs(blobs, str(tmp_path / "s"))
    want = {}
    for f in (tmp_path / "s").rglob("*.parquet"):
        n, size = want.get(f.parent.name[6:], (0, 0))
        want[f.parent.name[6:]] = (n + 1, size + f.stat().st_size)
    assert {r.shard: (r.files, r.file_bytes) for r in corpus.storage_inventory(spark, str(tmp_path / "s")).collect()} == want


def test_write_gate_fails_closed(spark):
    df = spark.createDataFrame([("AA",), ("bb",), (None,)], "pubkey string")
    actions = lambda allowed: [r["action"] for r in feed.write_gate(df, allowed).collect()]
    assert actions(None) == actions("") == ["reject"] * 3
    assert actions(" aa ") == ["accept", "reject", "reject"]


def test_replaying_a_batch_changes_nothing(spark):
    now = spark.createDataFrame([("s1", "a", 1), ("s2", "b", 2)], "sha256 string, owner string, at int")
    batch = spark.createDataFrame([("s2", "c", 3), ("s2", "d", 4), ("s3", "e", 1)], "sha256 string, owner string, at int")
    once = corpus.upsert(now, batch, ["sha256"], [F.col("at")])
    twice = corpus.upsert(once, batch, ["sha256"], [F.col("at")])
    want = [("s1", "a", 1), ("s2", "d", 4), ("s3", "e", 1)]
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == want


def test_fallback_is_the_first_candidate_tried(spark):
    rows = [(1, 0, False, "x"), (1, 1, False, "y"), (2, 0, False, "x"), (2, 1, True, "y"), (2, 2, True, "z")]
    df = spark.createDataFrame(rows, "cell int, rank int, ok boolean, src string")
    best = coverage.first_usable(df, ["cell"], "ok", "rank")
    assert {(r["cell"], r["src"]) for r in best.collect()} == {(1, "x"), (2, "y")}
    status = spark.createDataFrame([(True, None), (False, None), (False, 0.5), (False, 0.6)], "c boolean, h double")
    assert [r["s"] for r in status.select(coverage.cell_status("c", "h").alias("s")).collect()] == ["covered", "unknown", "sea", "gap"]


def _grid(spark, h, n=12):
    return spark.createDataFrame([("g", r, c, float(h(r, c))) for r in range(n) for c in range(n)], "source string, row_no bigint, col_no bigint, h double")


def test_planes_are_smooth(spark):
    plane = _grid(spark, lambda r, c: 100 + 2 * c - 3 * r)
    assert raster.roughness(plane).first()["roughness"] == pytest.approx(0, abs=1e-9)
    assert raster.linear_fraction(plane).first()["linear"] == 1.0
    assert raster.linear_fraction(_grid(spark, lambda r, c: 7)).first()["linear"] == 1.0
    slope = raster.slopes(plane, "source", F.lit(1.0), F.lit(1.0)).select("dhdx", "dhdz").distinct().collect()
    assert [(round(r[0], 9), round(r[1], 9)) for r in slope] == [(2.0, -3.0)]


def test_detail_score_matches_numpy(spark):
    values = np.random.default_rng(3).normal(size=(12, 12)).cumsum(axis=0)
    grid = _grid(spark, lambda r, c: values[r, c])

    def rough(a):
        return np.sqrt((np.mean((a[:, :-2] - 2 * a[:, 1:-1] + a[:, 2:]) ** 2) + np.mean((a[:-2] - 2 * a[1:-1] + a[2:]) ** 2)) / 2)

    small = values[::2, ::2]
    at = np.linspace(0, 5, 12)
    lo = np.floor(at).astype(int)
    hi, f = np.minimum(lo + 1, 5), at - np.floor(at)
    rows = small[lo] * (1 - f)[:, None] + small[hi] * f[:, None]
    back = rows[:, lo] * (1 - f) + rows[:, hi] * f
    assert raster.detail_score(grid).first()["detail"] == pytest.approx(rough(values) / rough(back))


def test_bad_samples_become_the_median(spark):
    df = spark.createDataFrame([("g", 0, i, h) for i, h in enumerate([1.0, 2.0, 3.0, -9999.0, float("nan")])], "source string, row_no int, col_no int, h double")
    filled, share = raster.clean(df)
    assert sorted(r["h"] for r in filled.collect()) == [1.0, 2.0, 2.0, 2.0, 3.0] and share.first()["nodata"] == pytest.approx(0.4)
    dead = spark.createDataFrame([("g", 0, 0, -9999.0)], "source string, row_no int, col_no int, h double")
    filled, share = raster.clean(dead)
    assert filled.first()["h"] == 0.0 and share.first()["nodata"] == 1.0


# --- feature tiles: bytes pinned by the published golden tile -----------------------------------

GOLDEN = (
    "325446540efa2100001b17000000100204b406b406c60200009803c502007f03b426d827ea03"
    "50f501be043202030300b41680205280208e050207801000a4018040020400e62cb4068010a4"
    "01f501f411e50ca30103049a03e62c9a13a4019903dc0e"
)


def test_golden_feature_tile(spark):
    blob = spark.createDataFrame([(bytearray.fromhex(GOLDEN),), (bytearray(b"junk"),)], "content binary")
    rows = feature_tiles.decode(blob)
    good = rows.where("error IS NULL")
    assert rows.where("error IS NOT NULL").count() == 1
    assert {(r["layer"], r["n"]) for r in good.groupBy("layer").agg(F.count("*").alias("n")).collect()} == {("building", 2), ("road", 2), ("landuse", 2)}
    assert sorted(r["height_m"] for r in good.where("layer = 'building'").collect()) == [5.0, 12.7]
    blobs = feature_tiles.encode(good)
    row = blobs.first()
    assert (row["z"], row["x"], row["y"]) == (14, 8698, 5915) and bytes(row["content"]).hex() == GOLDEN
    asked = spark.createDataFrame([(14, 8698, 5915), (14, 1, 2)], "z bigint, x bigint, y bigint")
    both = {(r["x"], r["y"]): bytes(r["content"]) for r in feature_tiles.encode(good, answered=asked).collect()}
    assert both[8698, 5915].hex() == GOLDEN and both[1, 2].hex().endswith("000000") and len(both) == 2
    many = good.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(4000)))).drop("copy")  # beyond the cap of an answer
    assert feature_tiles.decode(feature_tiles.encode(many)).count() == 24_000


def _varint(value):
    out = []
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes(out + [value])


def _plain_blob(buildings, roads):
    """Bytes of a tile with ``buildings`` (steps, height) and ``roads`` (class byte, steps)."""
    zigzag = lambda steps: b"".join(_varint(2 * d if d >= 0 else -2 * d - 1) for step in steps for d in step)
    out = bytes.fromhex(GOLDEN)[:15] + _varint(len(buildings))
    out += b"".join(_varint(len(s)) + zigzag(s) + _varint(h) for s, h in buildings) + _varint(len(roads))
    return out + b"".join(_varint(len(s)) + bytes([c]) + zigzag(s) for c, s in roads) + b"\0"


def test_scan_of_random_and_broken_tiles(spark, monkeypatch):
    steps = lambda n: [(rnd.choice([0, -1, 70, rnd.randint(-5000, 5000)]), rnd.randint(-200, 200)) for _ in range(n)]
    tiles = {}
    for k in range(40):
        tiles[f"t{k}"] = ([(steps(rnd.randint(0, 9)), rnd.randint(0, 70000)) for _ in range(rnd.randint(0, 5))], [(rnd.choice([0, 3, 127, 128, 255]), steps(rnd.randint(0, 200))) for _ in range(rnd.randint(0, 5))])
    rows = [(bytearray(_plain_blob(*t)), name) for name, t in tiles.items()]
    golden = bytes.fromhex(GOLDEN)
    broken = {f"cut{n}": golden[:n] for n in range(len(golden))} | {"null": None, "magic": b"x" + golden[1:], "extent": golden[:14] + b"\x11" + golden[15:], "long": golden[:15] + b"\xff" * 6 + b"\x01"}
    rows += [(None if b is None else bytearray(b), name) for name, b in broken.items()]
    out = feature_tiles.decode(spark.createDataFrame(rows, "content binary, name string"), keep=("name",)).collect()
    errors = {r["name"]: r["error"] for r in out if r["error"]}
    assert set(errors) == set(broken) and all(e in ("truncated", "not a feature tile", "unsupported extent", "varint overflow") for e in errors.values())
    assert (errors["magic"], errors["extent"], errors["long"], errors["cut20"]) == ("not a feature tile", "unsupported extent", "varint overflow", "truncated")
    got = {(r["name"], r["layer"], r["seq"]): r for r in out if not r["error"]}
    assert len(got) == sum(len(b) + len(r) for b, r in tiles.values())
    span = 360.0 / 2**14
    for name, (buildings, roads) in tiles.items():
        for layer, own in (("building", [s for s, _ in buildings]), ("road", [s for _, s in roads])):
            for seq, moves in enumerate(own):
                lons, x = [], 0
                for dx, _ in moves:
                    x += dx
                    lons.append(8698 * span - 180 + x / 4096 * span)
                assert np.allclose([p["lon"] for p in got[name, layer, seq]["line"]], lons, atol=1e-9)
        assert [got[name, "building", k]["height_m"] for k in range(len(buildings))] == [h / 10 for _, h in buildings]


def test_hot_tile_is_built_in_parts(spark):
    """A tile with most of all features: parts in order of ``seq`` give the bytes of a plain writer."""
    span, north = 360.0 / 2**14, spark.range(1).select(tiles.tile_box(F.lit(14), F.lit(8698), F.lit(5915)).alias("b")).first()["b"]["north"]
    moves = [rnd.randint(0, 4096) for _ in range(900)]
    seqs = rnd.sample(range(-10**12, 10**12), 900)
    rows = [(14, 8698, 5915, "road", s, "motorway", [(8698 * span - 180 + d / 4096 * span, north)]) for s, d in zip(seqs, moves)]
    rows += [(14, 8698 + k % 2, 5916, "building", k, None, [(0.0, 0.0)]) for k in range(6)]
    df = spark.createDataFrame(rows, "z bigint, x bigint, y bigint, layer string, seq bigint, class string, line array<struct<lon:double,lat:double>>")
    df = df.repartition(5).withColumn("height_m", F.lit(3.0))
    whole, cut = ({(r["x"], r["y"]): bytes(r["content"]) for r in feature_tiles.encode(df, block=b).collect()} for b in (65_536, 50))
    plain = _plain_blob([], [(K.ROAD_CLASSES.index("motorway"), [(d, 0)]) for _, d in sorted(zip(seqs, moves))])
    assert whole == cut and len(cut) == 3 and cut[8698, 5915] == plain


# --- radio logs -----------------------------------------------------------------------------------------

HEAD = "time,from,sender name,sender lat,sender long,rx lat,rx long,rx elevation,rx snr,distance,hop limit,payload,rx rssi"
ROW = '09:00:0{i},{who},{name},47.100000,9.500000,47.101000,9.501000,812,11.250000,812.000000,{hop},"{pay}"'


def _row(i, pay, who="631724152", name="Beacon A", hop="0"):
    return ROW.format(i=i, who=who, name=name, hop=hop, pay=pay)


def test_rssi_returns_to_its_row(spark, monkeypatch):
    text = "\r\n".join([HEAD, _row(1, "seq 1"), f"-91,{_row(2, 'seq 2')}", "", f"-88,{_row(3, 'seq 5', '999888777')}", "-97,", ""])
    cut = "\n".join([HEAD, f"-70,{_row(1, 'seq 1', name='A, hilltop')}", f"-91,{_row(2, 'hello', hop='x')}"])
    files = spark.createDataFrame([("a", text), ("b", cut), ("c", "what\n1"), ("d", "")], "file string, value string")
    monkeypatch.setattr(fieldlog, "LINES_PER_BLOCK", 2)
    kept, refused = radio_logs.split_files(radio_logs.split_lines(files))
    assert {(r["file"], r["code"]) for r in refused.collect()} == {("c", "UNKNOWN_HEADER"), ("d", "FILE_EMPTY")}
    records, rejections = fieldlog.repair(kept)
    got = [(r["file"], r["seq"], r["rx_rssi_dbm"], r["sender_name"]) for r in records.orderBy("file", "line").collect()]
    assert got == [("a", 1, -91, "Beacon A"), ("a", 2, -88, "Beacon A"), ("a", 5, -97, "Beacon A"), ("b", 1, -91, "A, hilltop")]
    reasons = {r["reason"] for r in rejections.where("file = 'b'").collect()}
    assert reasons == {"leading RSSI with no preceding row — file starts mid-stream", "row has a non-numeric value in a numeric field"}


def test_window_outcomes(spark):
    def packets(win, a, b, hop=0):
        return [(win, "A", s, hop) for s in a] + [(win, "B", s, hop) for s in b]

    rows = packets(1, [1, 2], [1]) + packets(2, [2, 2, 99], []) + packets(3, [], [4]) + packets(4, [1], [1], hop=1) + packets(5, [1], [1])
    rec = spark.createDataFrame(rows, "window_id int, sender string, seq bigint, hop_limit int")
    win = [(i, "A", "B", 1, 4, 1, 4, i != 5, True) for i in range(1, 7)] + [(7, "A", "A", 1, 4, 1, 4, True, True), (8, "A", "B", 4, 1, 1, 4, True, True)]
    names = "window_id int, beacon_a string, beacon_b string, lo_a int, hi_a int, lo_b int, hi_b int, loopback_open boolean, loopback_close boolean"
    out = {r["window_id"]: r for r in fieldlog.window_reports(rec, spark.createDataFrame(win, names)).collect()}
    assert (out[1]["outcome"], out[1]["prr_a"], out[1]["prr_b"]) == ("continuous", 0.5, 0.25)
    assert (out[2]["outcome"], out[2]["received_a"], out[2]["out_a"], out[2]["prr_a"], out[2]["bracket_hi_dbm"]) == ("interval-censored", 1, 1, 0.25, -118)
    assert [out[i]["outcome"] for i in (3, 4, 5, 6)] == ["integrity-fault", "left-censored", "void", "left-censored"]
    assert (out[7]["code"], out[8]["code"]) == ("SAME_BEACON", "EMPTY_RANGE")


def test_box_centre_and_overlap_edges(spark):
    df = spark.createDataFrame([(0.0, 0.0, 1.0, 1.0)], "west double, south double, east double, north double")
    touch = [F.lit(v) for v in (1.0, 0.0, 2.0, 1.0)]
    row = df.select(boxes.overlaps(boxes.EDGES, touch).alias("o"), boxes.contains_point(boxes.EDGES, F.lit(1.0), F.lit(1.0)).alias("p")).first()
    assert (row["o"], row["p"]) == (False, True)


def test_observed_survey_counts(spark):
    from pyspark.sql import Observation

    seen = Observation("survey")
    cells = spark.createDataFrame([(True, "covered"), (False, "gap"), (False, "sea")], "covered boolean, status string")
    coverage.observe_cells(cells, seen).collect()
    assert seen.get == {"cells": 3, "covered": 1, "gaps": 1}


def test_sql_covers(spark):
    from cartolith import sql
    from cartolith.functions import geohash

    sql.register(spark)
    assert spark.sql("SELECT * FROM tile_cover(10.38D, 46.21D, 12.48D, 47.10D, 10)").count() == 35
    for p in (1, 4, 7):
        got = spark.sql(f"SELECT cell FROM geohash_cover(11.0D, 46.0D, 11.0D, 46.0D, {p})").first()["cell"]
        assert got == spark.range(1).select(geohash.encode(F.lit(46.0), F.lit(11.0), p)).first()[0]
