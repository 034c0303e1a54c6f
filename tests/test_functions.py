"""Known values of the column functions."""

from __future__ import annotations

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cartolith.functions import boxes, events, geohash, grammar, numbers, osm, tiles
from cartolith.operators import generate
from cartolith.plans import delivery
from cartolith.plans.estimate import PLAN_SCHEMA, PLANS, estimate


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_geohash_vector(spark):
    assert one(spark, geohash.encode(F.lit(57.64911), F.lit(10.40744), 11)) == "u4pruydqqvj"
    # Closer to the edge than the sum with the origin can tell: still the western cell.
    assert one(spark, geohash.encode(F.lit(0.0), F.lit(-1e-17), 1)) == "e"
    assert one(spark, geohash.decode(F.lit("u4ai"))) is None
    grid = one(spark, geohash.grid_size(F.lit(4)))
    assert (grid["lon_cells"], grid["lat_cells"]) == (1024, 1024)


@pytest.mark.parametrize("box,n", [
    ((-25.0, 34.0, 45.0, 72.0), 43_617), ((-180.0, -90.0, 180.0, 90.0), 1_048_576),
    ((-180.0, -85.05112878, 180.0, 85.05112878), 991_232),
])
def test_cover_sizes(spark, box, n):
    assert one(spark, geohash.cover_count(*[F.lit(v) for v in box], 4)) == n


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.floats(-90, 90), st.floats(-180, 180)), min_size=20, max_size=40))
def test_geohash_matches_bisection(spark, points):
    def bisect(lat, lon, precision=7):
        lo, hi, out = [-180.0, -90.0], [180.0, 90.0], ""
        value, axis = 0, 0
        for i in range(5 * precision):
            mid = (lo[axis] + hi[axis]) / 2
            bit = (lon, lat)[axis] >= mid
            (lo if bit else hi)[axis] = mid
            value = value * 2 + bit
            axis = 1 - axis
            if i % 5 == 4:
                out, value = out + "0123456789bcdefghjkmnpqrstuvwxyz"[value], 0
        return out

    df = spark.createDataFrame(points, "lat double, lon double").withColumn("g", geohash.encode("lat", "lon", 7))
    rows = df.withColumn("p", geohash.decode("g")).withColumn("g2", geohash.encode("p.lat", "p.lon", 7)).collect()
    for r in rows:
        assert r["g"] == bisect(r["lat"], r["lon"])
        assert r["g2"] == r["g"]


def test_canonical_coordinates(spark):
    cases = {
        0.0078125: "0.007812", 0.0234375: "0.023438", 0.0390625: "0.039062", 0.0546875: "0.054688", 8.6e-5: "0.000086",
        -0.0: "0", 412.0: "412", -1e-9: "0", 100.5: "100.5", 0.19606250000000003: "0.196063", 0.1960625: "0.196062",
    }
    df = spark.createDataFrame([(k,) for k in cases], "v double").select("v", numbers.canonical_coordinate("v").alias("t"))
    assert {r["v"]: r["t"] for r in df.collect()} == cases


def test_canonical_numbers_and_json(spark):
    cases = {1e-5: "0.00001", 2e23: "2" + "0" * 23, 412.0: "412", -0.0: "0", 0.1: "0.1", 8.6e-5: "0.000086"}
    df = spark.createDataFrame([(k,) for k in cases], "v double").select("v", numbers.canonical_number("v").alias("t"))
    assert {r["v"]: r["t"] for r in df.collect()} == cases
    bags = {
        '{"b": 1.0, "a": [true, null, "é"]}': ('{"a":[true,null,"é"],"b":1}', None), "null": ("{}", None),
        '{"x":9007199254740992}': (None, "PROPERTY_NUMBER_RANGE"), '{"x":1e999}': (None, "NUMBER_NOT_FINITE"),
        '{"é":1}': (None, "PROPERTY_KEY_GRAMMAR"), '{"x":"\\ud800"}': (None, "STRING_NOT_SCALAR"), "[]": (None, "PROPERTY_KEY_GRAMMAR"),
    }
    rows = spark.createDataFrame([(k,) for k in bags], "t string").select("t", numbers.properties("t").alias("p")).collect()
    assert {r["t"]: (r["p"]["text"], r["p"]["code"]) for r in rows} == bags


def test_addresses(spark):
    df = spark.createDataFrame([("terrain:22/4194303/4194303",), ("terrain:23/0/0",), ("a:b:1/0/0",), ("terrain:1/01/0",)], "d string")
    got = [r["p"] for r in df.select(events.parse_item_address("d").alias("p")).collect()]
    assert tuple(got[0]) == ("terrain", 22, 4194303, 4194303) and got[1:] == [None, None, None]


def test_first_broken_rule_wins(spark):
    def code(*box):
        return one(spark, boxes.viewport_code(*[F.lit(v) for v in box]))

    assert code(200.0, 0.0, 100.0, 10.0) == "BBOX_OUT_OF_RANGE"
    assert code(20.0, 10.0, 10.0, 0.0) == "BBOX_ANTIMERIDIAN"
    assert code(10.0, 10.0, 20.0, 0.0) == "BBOX_INVERTED"
    assert code(float("nan"), 0.0, 200.0, 0.0) == "BBOX_NOT_FINITE"
    assert one(spark, boxes.extent_code(*[F.lit(v) for v in (0.0, 0.0, 1e-7, 1.0)])) == "BBOX_DEGENERATE"


def test_views_over_the_seam(spark):
    views = [(170.0, -10.0, -170.0, 10.0), (170.0, -10.0, 190.0, 10.0), (-200.0, 0.0, 200.0, 1.0), (0.0, 5.0, 1.0, 4.0)]
    df = spark.createDataFrame(views, "west double, south double, east double, north double")
    got = [[tuple(b) for b in r["s"]] for r in df.select(boxes.view_segments(*boxes.EDGES).alias("s")).collect()]
    assert got[0] == got[1] == [(170.0, -10.0, 180.0, 10.0), (-180.0, -10.0, -170.0, 10.0)]
    assert got[2] == [(-180.0, 0.0, 180.0, 1.0)] and got[3] == []


def test_grammar_edges(spark):
    nbsp = "x "
    df = spark.createDataFrame([("a",), (nbsp,), ("﻿x",), ("x\n",)], "t string").select(grammar.text_code("t").alias("c"))
    assert [r["c"] for r in df.collect()] == [None, "TEXT_EMPTY", "TEXT_EMPTY", "TEXT_EMPTY"]
    df = spark.createDataFrame([("a" * 64,), ("a" * 65,), ("a\n",), ("a-",)], "t string").select(grammar.dataset_code("t").alias("c"))
    assert [r["c"] for r in df.collect()] == [None, "DATASET_GRAMMAR", "DATASET_GRAMMAR", "DATASET_GRAMMAR"]
    arabic = "٢٠٢٤-01-01T00:00:00Z"
    df = spark.createDataFrame([("2000-02-29T00:00:00Z",), ("1900-02-29T00:00:00Z",), (arabic,)], "t string")
    assert [r["c"] for r in df.select(grammar.datetime_code("t").alias("c")).collect()] == [None, "DATETIME_CALENDAR", "DATETIME_GRAMMAR"]


def test_event_id_escapes(spark):
    import hashlib
    import json

    text = 'q"b\\s\n\t\u0001\u001f é   /'
    row = (text, [["t", text], []])
    df = spark.createDataFrame([row], "content string, tags array<array<string>>")
    got = df.select(events.event_id(F.lit("ab"), F.lit(7), F.lit(1), "tags", "content").alias("id")).first()["id"]
    want = json.dumps([0, "ab", 7, 1, row[1], text], separators=(",", ":"), ensure_ascii=False)
    assert got == hashlib.sha256(want.encode()).hexdigest()


def test_heights_from_tags(spark):
    rows = [("12m", None, 12.0), ("x", "3", 9.0), ("", "", 6.0), ("900", None, 400.0), ("0", "2.5", 7.5), (".5", None, 0.5)]
    df = spark.createDataFrame(rows, "h string, l string, want double").select("want", osm.building_height("h", "l").alias("got"))
    assert all(r["want"] == r["got"] for r in df.collect())
    parts = spark.createDataFrame([(46.7, 33.9), (34.2, 33.9), (500.0, 33.9)], "a double, b double")
    assert [r["h"] and round(r["h"], 6) for r in parts.select(osm.part_height("a", "b").alias("h")).collect()] == [12.8, None, None]


def test_zoom_choices(spark):
    box = [F.lit(v) for v in (10.38, 46.21, 12.48, 47.10)]
    assert one(spark, tiles.count_tiles(*box, 10)) == 35
    assert one(spark, tiles.count_tiles(*box, 12)) == 360
    z = one(spark, tiles.budget_zoom(*box, F.lit(13), 0, 16))
    assert one(spark, tiles.count_tiles(*box, z)) <= 16 < one(spark, tiles.count_tiles(*box, z + 1))
    assert one(spark, tiles.elevation_from_rgb(F.lit(0), F.lit(0), F.lit(0))) == -32768.0
    europe = spark.createDataFrame([(-25.0, 34.0, 32.0, 71.5)], "west double, south double, east double, north double")
    assert generate.box_tiles(europe, 7).count() == 525
    assert generate.box_tiles(europe, 7, spread=4).count() == 525


def test_price_table(spark):
    table = [(1.0, 2.0, 1, 1, 1_013), (1.0, 0.5, 1, 1, 1_092), (1.0, 0.25, 1, 1, 1_344), (25.0, 0.25, 13, 6, 15_624), (120.0, 0.25, 64, 16, 64_512)]
    from cartolith.functions import gates

    df = spark.createDataFrame(table, "km2 double, m double, dem int, feat int, want bigint")
    units = gates.work_units(gates.texture_megapixels("km2", "m"), "dem", "feat")
    assert all(r["want"] == r["got"] for r in df.select("want", gates.price(units).alias("got")).collect())
    assert delivery.price_range() == (1_000, 64_512)
    assert delivery.capability_tag("t") == ["cap", "tool:t", "1000-64512", "sats"]


def test_overstated_resolution_is_priced_as_delivered(spark):
    req = [(-7.6, 33.1249, -7.552, 33.1649, "standard", True, 0.1), (-16.92, 32.645, -16.908, 32.653, "standard", True, None)]
    df = spark.createDataFrame(req, "west double, south double, east double, north double, lod string, texture boolean, target double")
    far, near = delivery.quotes(df).orderBy("west", ascending=False).collect()
    assert far["downgraded"] and far["m_per_px"] == pytest.approx(2.0, abs=0.05)
    assert near["texture_region"] == "madeira" and not near["downgraded"] and near["m_per_px"] == pytest.approx(0.5, abs=1e-3)


def test_plan_estimates(spark):
    rows = {(r["plan"], r["zoom"]): r for r in estimate(spark.createDataFrame(list(PLANS), PLAN_SCHEMA)).collect()}
    assert rows[("v1", 13)]["passes_gate"] and not rows[("europe", 14)]["passes_gate"]
    assert rows[("v1", 12)]["tiles_bbox"] == 168 + 360
    assert math.isclose(one(spark, tiles.dem_bytes_per_tile(F.lit(14))), 43_014 * 3.86 / 4)
