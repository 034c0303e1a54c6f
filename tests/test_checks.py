"""Registered queries against their check SQL (a spread of them; ``check.py`` runs all)."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from check import TABLES, normal

SF_DIR = "/root/testdata/sf0.001"
SPREAD = (
    "b01_tile_for_point b07_geohash b17_canonical_coordinate d02_views_over_footprints d01_point_in_polygon g08_ladder_coverage "
    "a11_new_blobs k03_reseed k04_apply_results d09_refused_requests d11_reconcile e01_progress f12_completion_over_time "
    "e02_survey_summary a19_bake_gaps c14_elevation_gates d06_resample_bilinear a02_way_layers e25_building_bodies a13_scan_feature_tiles "
    "b42_event_id f07_newest_status f08_publish_clock c06_nearby a07_log_records e08_window_outcomes d04_source_chain d21_quotes "
    "i04_live_heads i06_ingest"
).split()
NAMES = sorted(entry_points.oracle_sql()) if os.environ.get("CHECK_ALL") else SPREAD


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_check(spark, duck, name):
    got = entry_points.queries()[name](spark, SF_DIR).toPandas()
    want = duck.execute(entry_points.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


def test_every_query_is_registered_once():
    queries, checks = entry_points.queries(), entry_points.oracle_sql()
    assert set(checks) <= set(queries) and len(queries) > 150


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
