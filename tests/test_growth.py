"""Steps that were slow or large on big tables: same rows as the plain form, and the plan that keeps them small."""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import functions as F

from cartolith.operators import corpus
from cartolith.operators.quantiles import exact_quantiles
from cartolith.sources import feature_tiles
from cartolith.streaming import feeds as live
from cartolith.workloads import views


def _plan(df, kind="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


def test_index_rows_are_worked_out_for_the_chosen_payloads_only(spark):
    rnd = random.Random(3)
    rows = [
        (rnd.choice(["madeira", "vienna"]), rnd.choice(["dem", "ortho", "features"]), 13, rnd.randrange(8100, 8110), rnd.randrange(4000, 4010),
         bytes([rnd.randrange(6)]), rnd.choice([1, 20_000]), 1, 0, 0, rnd.choice([None, 5, 5, 6]))
        for _ in range(400)
    ]
    names = "region string, kind string, z bigint, x bigint, y bigint, content binary, n_elements bigint, buildings bigint, roads bigint, landuse bigint, at bigint"
    judged = live.judged_payloads(spark.createDataFrame(rows, names)).drop("content")
    good = judged.where("r_error IS NULL")
    order = [F.col("uploaded_at"), F.col("owner"), F.col("tile_x"), F.col("tile_y")]
    want = corpus.latest(corpus.ingest_records(good, F.col("at")), ["sha256"], order)
    # The kind of a tile tells owner and media type, so rows that tie in the order are equal.
    got = live.index_batch(good)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect())) and got.count() > 3
    plan = _plan(got)
    assert plan.index("geohash") < plan.index("Aggregate") and "geohash" not in plan[plan.index("Aggregate"):]
    sorts = [line for line in _plan(live.outcome_batch(judged), "executedPlan").splitlines() if " Sort [" in line]
    assert sorts and all("Sort [y#" in line for line in sorts)


def test_quantiles_cut_bits_of_counted_values_only(spark):
    frame = spark.createDataFrame([(k, float(x)) for k in range(3) for x in (-2, 0, 0, 1, 5)], "k int, x double").repartition(2)
    out = exact_quantiles(frame, ["k"], "x", {"m": 0.5, "q": 0.9})
    filters = [line for line in _plan(out).splitlines() if "Filter" in line]
    assert filters and not any("LOG2" in line.upper() for line in filters)
    assert [tuple(r) for r in out.orderBy("k").collect()] == [(k, 0.0, 3.4000000000000004) for k in range(3)]


def test_items_are_grouped_in_tasks_that_grow_in_number(spark, monkeypatch):
    monkeypatch.setattr(views, "ROWS_PER_TASK", 500)
    v = views.Inputs(spark, "/root/testdata/sf0.001")
    n = v.lineitem.count()
    parts = v.parts("lineitem")
    assert parts == -(-n // 500) > 10
    plan = _plan(v.v_items, "executedPlan")
    assert plan.count("Exchange") == 1 and f", {parts})" in plan


def test_a_large_tile_is_written_and_scanned_in_parts(spark):
    """One tile with all features: written along the order, scanned by sections that are dealt to tasks."""
    at = lambda k: F.struct((8698.0 * 360 / 2**14 - 180 + (F.col("id") * k % 4000) / 4096 * 360 / 2**14).alias("lon"), F.lit(45.0).alias("lat"))
    rows = spark.range(20_000).select(
        *[F.lit(n).cast("bigint").alias(k) for k, n in (("z", 14), ("x", 8698), ("y", 5915))], F.lit("road").alias("layer"), (-F.col("id")).alias("seq"),
        F.lit("motorway").alias("class"), F.lit(None).cast("double").alias("height_m"), F.array(at(7), at(11), at(13)).alias("line"),
    )
    blobs = feature_tiles.encode(rows, block=1_000)
    plan = _plan(blobs, "executedPlan")
    assert "rangepartitioning" in plan and "PERCENTILE" not in plan.upper()
    out = feature_tiles.decode(blobs)
    scans = _plan(out, "executedPlan").split("MapInArrow")
    assert len(scans) == 3 and "Exchange" in scans[1]
    sections = feature_tiles._sections(bytes(blobs.first()["content"]))
    assert len(sections) > 1 and [s[4] for s in sections] == [sum(s[5] for s in sections[:k]) for k in range(len(sections))]
    got = {r["seq"]: [round((p["lon"] + 180 - 8698 * 360 / 2**14) * 4096 / 360 * 2**14) for p in r["line"]] for r in out.collect()}
    assert got == {k: [(19_999 - k) * m % 4000 for m in (7, 11, 13)] for k in range(20_000)}


def test_sections_of_any_size_give_the_same_features(monkeypatch):
    """Class bytes of 128 and more look like the beginning of a number, also at the end of a section."""
    rnd = random.Random(5)
    roads = b"".join(bytes([n, rnd.choice([0, 3, 127, 128, 255])]) + bytes(rnd.randrange(128) for _ in range(2 * n)) for n in (rnd.choice([0, 0, 1, 3]) for _ in range(90)))
    homes = b"".join(bytes([n]) + b"\x81\x01" * 2 * n + bytes([rnd.randrange(128)]) for n in (rnd.choice([0, 2]) for _ in range(90)))
    blob = bytes.fromhex("325446540efa2100001b1700000010") + bytes([90]) + homes + bytes([90]) + roads + b"\0"
    batch = pa.RecordBatch.from_arrays([pa.array([blob, b"junk", blob]), pa.array(["a", "b", "c"])], ["content", "name"])

    def scan():
        sections = list(feature_tiles._section_batches(iter([batch])))
        return sum(s.num_rows for s in sections), [r for f in feature_tiles._feature_batches(iter(sections)) for r in f.to_pylist()]

    n, want = scan()
    assert n == 5 and len(want) == 361 and [r["name"] for r in want if r["error"]] == ["b"]
    for size in (1, 7, 64):
        monkeypatch.setattr(feature_tiles, "_SECTION", size)
        monkeypatch.setattr(feature_tiles, "_AT_ONCE", 3 * size)
        n, got = scan()
        assert n > 10 and sorted(map(str, got)) == sorted(map(str, want))


def test_vertices_and_lines_are_grouped_in_one_shuffle(spark):
    assert _plan(views.Inputs(spark, "/root/testdata/sf0.001").v_lines, "executedPlan").count("Exchange") == 1
