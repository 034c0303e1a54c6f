"""Streaming jobs run to the end of the data they are given.

Each query writes the derived feed as several files and lets a file stream take them a few
at a time, so state really is carried between micro-batches.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cartolith.functions import events
from cartolith.operators import corpus, feed
from cartolith.session import work_dir
from cartolith.sources import feeds
from cartolith.streaming import feeds as live
from cartolith.workloads.q_events import _SERIAL, _tagged
from cartolith.workloads.registry import query

#: The files arrive in three batches, two files each or more: a file holds at most so many rows of the table behind it.
_FILES, _BATCHES, _ROWS_PER_FILE = 6, 3, 500_000


def _arrivals(table) -> tuple[int, int]:
    """Number of files and files a batch; the files grow in number and not in size."""
    files = max(_FILES, -(-table.count() // _ROWS_PER_FILE))
    return files, -(-files // _BATCHES)


def _feed_stream(v):
    """The feed as event lines in files, read as a stream of well-shaped events."""
    path = work_dir(v.spark, "feed")
    line = F.to_json(F.struct("id", "pubkey", "kind", "created_at", "content", "sig", "tags"))
    files, per_batch = _arrivals(v.events)
    rows = _tagged(v.spread("events", files), events.tag("d", F.col("slot").cast("string")))
    rows.select(line.alias("value")).write.text(path)
    return feeds.event_columns(feeds.stream_events(v.spark, path, per_batch))


def _run(v, stream, mode, each=None):
    path = work_dir(v.spark, "sink")
    sink = each(path) if each else (lambda batch, n: live.write_batch(batch, path, n))
    live.run_available(stream, work_dir(v.spark, "progress"), sink, mode)
    return path


_DSER = _SERIAL.replace("""substr(h, 1, 4), '"]],"'""", """substr(h, 1, 4), '"],["d","', CAST(slot AS VARCHAR), '"]],"'""")


@query("i01_live_presences", f"""
WITH {_DSER} SELECT pubkey, name, message, created_at FROM (SELECT pubkey, name, slot, content AS message, created_at, row_number() OVER (PARTITION BY pubkey ORDER BY created_at DESC, true_id) AS rn FROM good WHERE kind = 30315) f WHERE rn = 1 AND slot > 0""", "v_feed")
def _(v):
    path = _run(v, live.live_presences(_feed_stream(v)), "update")
    heads = live.read_latest(v.spark, path, ["pubkey"])
    return live.presences(heads).select("pubkey", "name", "message", "created_at")


_NOW = 1706659200


@query("i02_live_notes", f"WITH {_DSER} SELECT kind, pubkey, created_at FROM good WHERE kind IN (1, 1063, 31923) AND created_at >= {_NOW} - 172800", "v_feed")
def _(v):
    path = _run(v, live.live_notes(_feed_stream(v)), "append")
    notes = live.read_batches(v.spark, path)
    fresh = feed.fresh_notes(notes, _NOW).select("id")
    return notes.join(fresh, "id", "left_semi").select("kind", "pubkey", "created_at")


@query("i03_write_gate", "SELECT action, count(*) AS n FROM (SELECT CASE WHEN user_id = 8 THEN 'accept' ELSE 'reject' END AS action FROM v_feed) f GROUP BY action", "v_feed")
def _(v):
    import hashlib

    allowed = hashlib.sha256(b"author-8").hexdigest()
    path = _run(v, _feed_stream(v), "append", lambda p: live.gate_batch(allowed, p))
    both = live.read_batches(v.spark, f"{path}/accepted").unionByName(live.read_batches(v.spark, f"{path}/rejected"))
    return both.groupBy("action").agg(F.count("*").alias("n"))


@query("i04_live_heads", f"""
WITH {_DSER} SELECT kind, pubkey, slot AS d, true_id AS id FROM (SELECT kind, pubkey, slot, true_id, row_number() OVER (PARTITION BY kind, pubkey, slot ORDER BY created_at DESC, true_id) AS rn FROM good) f WHERE rn = 1""", "v_feed")
def _(v):
    stream = _feed_stream(v).withColumn("d", events.tag_value("tags", "d"))
    path = _run(v, live.live_heads(stream, ["kind", "pubkey", "d"]), "update")
    heads = live.read_latest(v.spark, path, ["kind", "pubkey", "d"])
    return heads.select("kind", "pubkey", F.col("d").cast("bigint").alias("d"), "id")


@query("i05_publish_clock", """
SELECT sha256(concat('author-', user_id)) AS pubkey, kind, count(*) AS n, count(*) AS times, min(created_at) AS earliest, true AS in_time
FROM v_feed GROUP BY ALL""", "v_feed")
def _(v):
    """Requests, distinct publish times and the earliest request of each address; no time is before its request."""
    stream = _feed_stream(v).select("pubkey", "kind", "id", F.col("created_at").alias("now"))
    path = _run(v, live.live_clock(stream, ["pubkey", "kind"]), "append")
    in_time = F.bool_and(F.col("created_at") >= F.col("now")) & (F.min("created_at") >= F.min("now"))
    return live.read_batches(v.spark, path).groupBy("pubkey", "kind").agg(
        F.count("*").alias("n"), F.count_distinct("created_at").alias("times"), F.min("now").alias("earliest"), in_time.alias("in_time")
    )


_ITEM_SCHEMA = "region string, kind string, z bigint, x bigint, y bigint, status string, attempts bigint"


def _payload_stream(v):
    path = work_dir(v.spark, "payloads")
    rows = v.v_items.select(
        *corpus.ITEM_KEY, F.concat_ws("/", F.col("x") % 100, F.col("y") % 40).cast("binary").alias("content"),
        F.when(F.col("attempts") == 5, 20000).otherwise(F.col("attempts")).cast("bigint").alias("n_elements"),
        F.col("attempts").alias("buildings"), F.lit(0).cast("bigint").alias("roads"), F.lit(0).cast("bigint").alias("landuse"),
        F.col("updated_at").alias("at"),
    )
    files, per_batch = _arrivals(v.lineitem)
    # Dealt by key: rows dealt in turn would be sorted first.
    rows.repartition(files, "x", "y").write.parquet(path)
    return v.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", per_batch).parquet(path)


@query("i06_ingest", """
WITH p AS (SELECT *, sha256(concat(CAST(x % 100 AS VARCHAR), '/', CAST(y % 40 AS VARCHAR))) AS sha, kind = 'features' AND attempts = 5 AS bad FROM v_items)
SELECT 'results' AS part, count(*) AS n, count(*) FILTER (bad) AS failed FROM p UNION ALL SELECT 'blobs', count(DISTINCT sha) FILTER (NOT bad), 0 FROM p UNION ALL SELECT 'index', count(DISTINCT sha) FILTER (NOT bad), 0 FROM p""", "v_items")
def _(v):
    """Outcomes per item, distinct stored contents and index rows after a bounded ingest."""
    path = work_dir(v.spark, "store")
    live.ingest(_payload_stream(v), path, work_dir(v.spark, "progress"))
    read = lambda name: live.read_batches(v.spark, f"{path}/{name}")
    results = read("results").agg(F.count("*").alias("n"), F.count("r_error").alias("failed")).select(F.lit("results").alias("part"), "n", "failed")
    blobs = read("blobs").agg(F.count("*").alias("n")).select(F.lit("blobs").alias("part"), "n", F.lit(0).cast("bigint").alias("failed"))
    index = live.read_latest(v.spark, f"{path}/index", ["sha256"]).agg(F.count("*").alias("n"))
    return results.unionByName(blobs).unionByName(index.select(F.lit("index").alias("part"), "n", F.lit(0).cast("bigint").alias("failed")))


@query("i07_live_progress", """
SELECT region, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'done') AS done,
  count(*) AS total, count(*) FILTER (attempts >= 4) AS exhausted FROM v_items GROUP BY region""", "v_items")
def _(v):
    path = work_dir(v.spark, "items")
    files, per_batch = _arrivals(v.lineitem)
    v.v_items.select(*corpus.ITEM_KEY, "status", "attempts").repartition(files).write.parquet(path)
    stream = v.spark.readStream.schema(_ITEM_SCHEMA).option("maxFilesPerTrigger", per_batch).parquet(path)
    sink = _run(v, live.live_progress(stream), "complete")
    return live.read_latest(v.spark, sink, ["region"])
