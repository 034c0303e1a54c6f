"""Structured Streaming jobs on event feeds and tile payloads.

"Newest wins" is an aggregate (smallest of (-created_at, id)), so live state is a native
streaming aggregation: it is combined on the map side before the shuffle and kept in the
state store, with no Python worker and no state per event. Arrival order does not matter.

Sinks write one folder per micro-batch and overwrite it on a replay, so a restarted query
leaves the same table.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from cartolith import constants as K
from cartolith.functions import gates, grammar
from cartolith.operators import corpus, feed


# --- sinks ----------------------------------------------------------------------------


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Write one micro-batch under its own folder; a replay replaces it."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def start_table(spark: SparkSession, path: str, schema) -> None:
    """Create an empty table that batches are added to; an existing one is kept."""
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{path}/batch_id=-1")


def read_batches(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows if before is None else rows.where(F.col("batch_id") < before)


def read_latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Last written version per key of an update-mode sink."""
    return corpus.latest(read_batches(spark, path), keys, [F.col("batch_id")]).drop("batch_id")


def run_available(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None],
                  mode: str = "append") -> None:
    """Process everything that has arrived, then stop; a later call continues from there."""
    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
        .foreachBatch(each).trigger(availableNow=True).start()
    )
    query.awaitTermination()


# --- live state --------------------------------------------------------------------------


def live_heads(events: DataFrame, keys: list[str]) -> DataFrame:
    """Current event per key; run in update mode. Integrity is tested before state."""
    good, _ = feed.split_integrity(events)
    return feed.heads(good, keys)


def live_presences(events: DataFrame, topic: str | None = None) -> DataFrame:
    """Newest status event of the topic per author; turn rows into presences with :func:`presences`."""
    return live_heads(feed.on_topic(events.where(F.col("kind") == K.KIND_STATUS), topic), ["pubkey"])


def presences(heads: DataFrame, view: tuple | None = None) -> DataFrame:
    return feed.newest_presences(heads, view=view)


def live_notes(events: DataFrame, now: int | None = None, tolerance_s: int = 900) -> DataFrame:
    """Notes of the shown kinds, one row per id within the 48 hours a note stays fresh.

    Notes dated more than ``tolerance_s`` after ``now`` (the batch's time by default) are refused
    before the watermark, which would otherwise follow them and drop every honest note.
    """
    latest = F.unix_timestamp(F.current_timestamp()) if now is None else F.lit(now)
    timely = events.where(F.col("kind").isin(*K.NOTE_KINDS) & (F.col("created_at") <= latest + tolerance_s))
    good, _ = feed.split_integrity(timely)
    timed = good.withColumn("at", F.timestamp_seconds("created_at")).withWatermark("at", "48 hours")
    return timed.dropDuplicatesWithinWatermark(["id"])


def gate_batch(allowed: str | None, path: str) -> Callable[[DataFrame, int], None]:
    """Sink that splits a line stream into accepted and rejected rows."""

    def each(batch: DataFrame, batch_id: int) -> None:
        judged = feed.write_gate(batch, allowed).persist()
        write_batch(judged.where("action = 'accept'"), f"{path}/accepted", batch_id)
        write_batch(judged.where("action = 'reject'"), f"{path}/rejected", batch_id)
        judged.unpersist()

    return each


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class PublishClock(StatefulProcessor):
    """Gives each request of an address max(now, last time + 1); the state of an address is its last time.

    One call to Python an address; :func:`live_clock` takes the addresses of a group together.
    """

    def __init__(self, now: str):
        self.now = now

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at bigint")

    def handleInputRows(self, key, rows, timerValues):
        last = self.last.get()[0] if self.last.exists() else None
        for part in rows:
            good = part["code"].isna().to_numpy()
            wanted = part.loc[good, self.now].to_numpy("int64")
            steps = np.arange(len(wanted))
            # Times rise by one at least, so each less its place is a running maximum.
            ahead = wanted - steps if last is None else np.maximum(wanted - steps, last + 1)
            at = np.maximum.accumulate(ahead) + steps
            fits = at <= K.MAX_CREATED_AT
            if fits.any():
                last = int(at[fits].max())
            times, codes = part[self.now].astype("Int64"), part["code"].astype(object)
            times[:] = pd.NA
            times[good] = pd.array(np.where(fits, at, -1), "Int64")
            codes[good] = np.where(fits, None, "CREATED_AT_RANGE")
            yield part.assign(created_at=times.where(times >= 0, pd.NA), code=codes.where(codes.notna(), None))
        if last is not None:
            self.last.update((last,))

    def close(self) -> None:
        pass


#: Addresses are dealt to so many groups; the state of a group is the last time of each of its addresses.
CLOCK_GROUPS = 1024


def _clock(now: str):
    """Gives each request of an address max(now, last time + 1), for all addresses of a group together."""

    def tick(key, parts, state):
        last = dict(zip(*state.get)) if state.exists else {}
        for part in parts:
            good = part["code"].isna().to_numpy()
            number, names = pd.factorize(part["_address"].to_numpy()[good])
            # Requests by address, in their order of arrival, and their places there.
            order = np.argsort(number, kind="stable")
            who = number[order]
            place = np.arange(len(who)) - np.searchsorted(who, who)
            earliest = np.array([last.get(n, -1) + 1 for n in names], "int64")[who]
            # Times rise by one at least, so each less its place is a running maximum.
            ahead = np.maximum(part[now].to_numpy()[good].astype("int64")[order] - place, earliest)
            at = pd.Series(ahead).groupby(who).cummax().to_numpy("int64") + place
            fits = at <= K.MAX_CREATED_AT
            last.update(zip(names[who[fits]], at[fits].tolist()))
            times, codes = np.full(len(part), None, object), part["code"].to_numpy(object, copy=True)
            rows = np.flatnonzero(good)[order]
            times[rows] = np.where(fits, at.astype(object), None)
            codes[rows] = np.where(fits, None, "CREATED_AT_RANGE")
            kept = {n: part[n].to_numpy() for n in part.columns if n not in ("created_at", "code", "_address", "_group")}
            yield pd.DataFrame({**kept, "created_at": times, "code": codes})
        if last:
            state.update((list(last), list(last.values())))

    return tick


def live_clock(requests: DataFrame, keys: list[str], now: str = "now") -> DataFrame:
    """Publish times of a stream of requests, in their order of arrival; run in append mode.

    Adds ``created_at`` and ``code`` (a time that is no time, or the clock at its end; such a request gets no time and
    moves no clock). Addresses are dealt by hash to ``CLOCK_GROUPS`` groups, and a batch reads and writes the state of the
    groups that its requests meet, on disk; nothing that was published is read. So the calls to Python do not grow with the
    number of addresses. The requests of a group pass one task in small parts; how many a batch holds is up to the
    stream's trigger.
    """
    requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    coded = requests.withColumn("code", grammar.created_at_code(F.col(now)))
    fields = StructType([*requests.schema.fields, StructField("created_at", LongType()), StructField("code", StringType())])
    address = F.to_json(F.struct(*keys))
    coded = coded.select(
        *requests.columns, F.lit(None).cast("bigint").alias("created_at"), "code", address.alias("_address"),
        F.pmod(F.xxhash64(address), F.lit(CLOCK_GROUPS)).alias("_group"),
    )
    return coded.groupBy("_group").applyInPandasWithState(
        _clock(now), fields, "addresses array<string>, times array<bigint>", "append", "NoTimeout"
    )


# --- ingest ----------------------------------------------------------------------------------

BLOBS = "sha256 string, content binary"
INDEX = (
    "sha256 string, size bigint, media_type string, owner string, uploaded_at bigint, west double, south double, "
    "east double, north double, tile_z bigint, tile_x bigint, tile_y bigint, geohash string"
)
RESULTS = (
    "region string, kind string, z bigint, x bigint, y bigint, r_error string, r_sha256 string, r_bytes bigint, "
    "r_buildings bigint, r_roads bigint, r_landuse bigint, r_at bigint"
)


def judged_payloads(payloads: DataFrame, cap: int = K.ELEMENT_CAP) -> DataFrame:
    """Payloads (region, kind, z, x, y, content, n_elements, buildings, roads, landuse, at) with size, r_error and sha256."""
    rows = payloads.withColumn("size", F.octet_length("content").cast("bigint"))
    rows = rows.withColumn("r_error", gates.ingest_error("kind", "size", "n_elements", cap))
    return rows.withColumn("sha256", corpus.content_key("content"))


def new_contents(payloads: DataFrame, cap: int = K.ELEMENT_CAP) -> DataFrame:
    """Contents (sha256, content) not seen before in the stream; run in append mode.

    Only hashes stay in the state store, on disk: a batch looks its own hashes up, and no earlier content is read.
    """
    payloads.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    good = judged_payloads(payloads, cap).where(F.col("r_error").isNull())
    return good.select("sha256", F.col("content").cast("binary").alias("content")).dropDuplicates(["sha256"])


#: Item keys as a sort meets them: the first column tells most rows apart (a sort on region or kind first compares whole rows).
_SORTED_KEY = ["y", "x", "z", "kind", "region"]


def index_batch(good: DataFrame) -> DataFrame:
    """Newest index row per content of a batch; media type, footprint and geohash are worked out for the chosen rows only."""
    order = [F.col("at"), corpus.crawl_owner(), F.col("x"), F.col("y")]
    chosen = corpus.latest(good.select("sha256", "size", *corpus.ITEM_KEY, "at"), ["sha256"], order)
    return corpus.ingest_records(chosen, F.col("at"))


def outcome_batch(rows: DataFrame) -> DataFrame:
    """Newest outcome per item of a batch."""
    done = F.col("r_error").isNull()
    outcome = rows.select(
        *corpus.ITEM_KEY, "r_error", F.when(done, F.col("sha256")).alias("r_sha256"), F.when(done, F.col("size")).alias("r_bytes"),
        *[F.col(n).alias(f"r_{n}") for n in ("buildings", "roads", "landuse")], F.col("at").alias("r_at"),
    )
    return corpus.latest(outcome, _SORTED_KEY, [F.col("r_at")])


def record_batch(path: str, cap: int = K.ELEMENT_CAP) -> Callable[[DataFrame, int], None]:
    """Sink for the index rows and the outcomes of a batch of payloads; contents are hashed where they are read and stay there.

    Each of the two writes reads and hashes the batch; for small contents that costs less than keeping its rows in between.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        rows = judged_payloads(batch, cap).drop("content")
        write_batch(index_batch(rows.where(F.col("r_error").isNull())), f"{path}/index", batch_id)
        write_batch(outcome_batch(rows), f"{path}/results", batch_id)

    return each


def ingest(payloads: DataFrame, path: str, progress: str, cap: int = K.ELEMENT_CAP) -> None:
    """Take in all payloads that have arrived: guards, content-addressed store, index, outcomes.

    Two queries over the same stream, each with its own progress under ``progress``: contents by the hashes in its
    state, records without state. A later call goes on from there, and a replayed batch replaces its folder.
    """
    for name, schema in (("blobs", BLOBS), ("index", INDEX), ("results", RESULTS)):
        start_table(payloads.sparkSession, f"{path}/{name}", schema)
    run_available(new_contents(payloads, cap), f"{progress}/contents", lambda batch, n: write_batch(batch, f"{path}/blobs", n))
    run_available(payloads, f"{progress}/records", record_batch(path, cap))


def live_progress(items: DataFrame) -> DataFrame:
    """Progress counts of a stream of item rows; run in complete mode."""
    return corpus.progress(items)
