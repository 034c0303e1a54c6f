from __future__ import annotations

import random

from pyspark.sql import functions as F

from cartolith import constants as K
from cartolith.operators import feed
from cartolith.sources import feeds
from cartolith.streaming import feeds as live
from cartolith.workloads import q_streams


def test_an_event_is_parsed_once(spark):
    lines = spark.createDataFrame([('{"id":"a","pubkey":"b","kind":1,"created_at":5,"content":"c","sig":"d","tags":[["g","u"]]}',), ("x",)], "value string")
    good, _bad = feed.split_integrity(feeds.event_columns(feeds.parse_events(lines)))
    plan = good._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1 and plan.count("try_parse_json(") + plan.count("tryParseJson") <= 1
    assert [r["id"] for r in feeds.event_columns(feeds.parse_events(lines)).collect()] == ["a"]


def test_files_of_a_stream_grow_in_number(spark):
    assert q_streams._arrivals(spark.range(10)) == (6, 2)
    assert q_streams._arrivals(spark.range(36_000_000)) == (72, 24)


def test_clock_of_many_addresses_is_the_loop_in_few_groups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(live, "CLOCK_GROUPS", 3)
    rnd, root = random.Random(7), str(tmp_path)
    names = [f"a{i}" for i in range(40)] + [None]
    want, last, n = {}, {}, 0
    for _ in range(3):
        rows = []
        for _ in range(300):
            k, now = rnd.choice(names), rnd.choice([5, 5, 6, 90, K.MAX_CREATED_AT, None])
            rows.append((k, n, now))
            if now is not None:
                at = max(now, last[k] + 1) if k in last else now
                want[n] = (at, None) if at <= K.MAX_CREATED_AT else (None, "CREATED_AT_RANGE")
                last[k] = at if at <= K.MAX_CREATED_AT else last[k]
            n += 1
        spark.createDataFrame(rows, "k string, id bigint, now bigint").coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema("k string, id bigint, now bigint").parquet(f"{root}/in")
        clock = live.live_clock(stream, ["k"])
        live.run_available(clock, f"{root}/progress", lambda batch, i: live.write_batch(batch, f"{root}/out", i))
    out = live.read_batches(spark, f"{root}/out").collect()
    got = {r["id"]: (r["created_at"], r["code"]) for r in out if r["now"] is not None}
    # Rows of one batch arrive in the order of their file.
    assert len(out) == n and got == want


def test_nearby_gives_every_match_without_a_page(spark):
    views = spark.createDataFrame([(1, 10.0, 45.0, 10.5, 45.5)], "view_id bigint, west double, south double, east double, north double")
    cell = feed.geohash.encode(F.lit(45.2), F.lit(10.2), 4)
    rows = spark.range(700).select(F.col("id").cast("string").alias("id"), F.lit(K.KIND_COLLECTION).alias("kind"), F.col("id").alias("created_at"), cell.alias("g"))
    assert feed.nearby(views, rows, "g", kind=None, limit=None)[0].count() == 700
    assert feed.nearby(views, rows, "g")[0].count() == 0


def test_announcements_of_columns_past_the_zoom_agree_with_the_sql(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry
    import check

    spark.sql("""SELECT id AS l_orderkey, 8190 + id AS l_partkey, 0L AS l_suppkey, 2 AS l_linenumber, 'A' AS l_returnflag, 3.0D AS l_quantity,
        10.0D AS l_extendedprice, timestamp_ntz'2024-01-01 00:00:00' AS l_shipdate FROM range(4)""").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.execute(entry.oracle_sql()["d10_announce_done"]).df()
    got = entry.queries()["d10_announce_done"](spark, str(tmp_path)).toPandas()
    assert len(got) == 4 and got["d"].isna().sum() == 2
    assert check.normal(got) == check.normal(want)
