"""The tile corpus: content-addressed blobs, work queue, merges and reconciliation.

Tables are plain DataFrames. A merge is an anti-join plus a union: the large stored side
is only scanned, and the small batch is what moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolith import constants as K
from cartolith.functions import boxes, grammar, tiles
from cartolith.functions._c import c, first_code
from cartolith.operators.ordered import running_by_block

ITEM_KEY = ["region", "kind", "z", "x", "y"]
ITEM_STATE = {
    "status": "string", "attempts": "bigint", "last_error": "string", "sha256": "string",
    "bytes": "bigint", "buildings": "bigint", "roads": "bigint", "landuse": "bigint",
    "updated_at": "bigint",
}


# --- content-addressed storage -----------------------------------------------------------


def content_key(content) -> Column:
    return F.sha2(c(content).cast("binary"), 256)


def new_blobs(payloads: DataFrame, stored: DataFrame, content: str = "content", first_by: str = "uploaded_at",
              key: list[str] | None = None):
    """Payloads whose bytes are not stored yet, one row per hash (the earliest).

    ``key`` names columns that tell the payloads apart. With it the choice is made on hashes and
    keys alone, and no bytes pass through an aggregate or a sort; without it they must.
    """
    hashed = payloads.drop("sha256").withColumn("sha256", content_key(content))
    if key:
        named = hashed.select("sha256", F.struct(first_by, *key).alias("_first"))
        chosen = named.join(stored.select("sha256"), "sha256", "left_anti").groupBy("sha256").agg(F.min("_first").alias("_first"))
        return hashed.join(chosen.select("sha256", *[F.col(f"_first.{n}").alias(n) for n in key]), ["sha256", *key], "left_semi")
    fresh = hashed.join(stored.select("sha256"), "sha256", "left_anti")
    others = [F.col(n) for n in fresh.columns if n != "sha256"]
    kept = fresh.groupBy("sha256").agg(F.min_by(F.struct(*others), F.col(first_by)).alias("_row"))
    return kept.select("sha256", "_row.*")


def shard(sha256="sha256") -> Column:
    """Folder of a blob: the first two letters of its hash."""
    return F.substring(c(sha256), 1, 2)


def blob_path(sha256="sha256") -> Column:
    return F.concat_ws("/", F.substring(c(sha256), 1, 2), F.substring(c(sha256), 3, 2), c(sha256))


def write_blobs(blobs: DataFrame, path: str) -> None:
    """Append blobs to the store, one folder per hash prefix."""
    spread = blobs.withColumn("shard", shard()).repartition("shard", F.substring("sha256", 3, 1))
    spread.write.mode("append").partitionBy("shard").parquet(path)


def storage_inventory(spark, path: str) -> DataFrame:
    """(shard, files, file_bytes) of a blob store, listed without reading contents."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path", "length")
    named = files.groupBy(F.regexp_extract("path", "shard=([^/]+)", 1).alias("shard"))
    return named.agg(F.count("*").alias("files"), F.sum("length").alias("file_bytes"))


def stored_by_hash(store: DataFrame, wanted: DataFrame) -> DataFrame:
    """Stored rows of the wanted hashes; only the hash column of ``wanted`` moves."""
    return store.join(wanted.select("sha256").distinct(), "sha256", "left_semi")


def cache_key(text) -> Column:
    """Sixteen letters of the hash of a query text."""
    return F.substring(F.sha2(c(text), 256), 1, 16)


def cache_lookup(requests: DataFrame, cache: DataFrame, text: str) -> DataFrame:
    """Requests with their cached answer; ``hit`` is false where an upstream fetch is due."""
    keyed = requests.withColumn("cache_key", cache_key(text))
    known = cache.withColumn("hit", F.lit(True))
    return keyed.join(known, "cache_key", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def request_key(region, box, target) -> Column:
    """Cache key of a texture request: region, rounded box and target."""
    w, s, e, n = (c(v) for v in box)
    text = F.format_string("%s|%.6f,%.6f,%.6f,%.6f|%.3f", c(region), w, s, e, n, c(target))
    return F.substring(F.sha2(text, 256), 1, 16)


# --- blob index -----------------------------------------------------------------------------


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Last row per key, as a map-side aggregate."""
    rest = [F.col(n) for n in df.columns if n not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)


def upsert(current: DataFrame, batch: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Current rows with the batch's rows in place of those with the same key.

    Applying the same batch twice gives the same table.
    """
    newest = latest(batch, keys, order)
    kept = current.join(newest.select(*keys), keys, "left_anti")
    return kept.unionByName(newest, allowMissingColumns=True)


def delete_blobs(index: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(remaining index, outcome per request): only its owner may delete a blob."""
    owners = index.select("sha256", F.col("owner").alias("_owner"), F.lit(True).alias("_found"))
    outcome = requests.join(owners, "sha256", "left").withColumn(
        "outcome",
        F.coalesce(
            first_code(
                (grammar.hex64_code("sha256").isNotNull(), "BAD_HASH"),
                (F.col("_found").isNull(), "NOT_FOUND"),
                (~F.col("_owner").eqNullSafe(F.col("pubkey")), "NOT_OWNER"),
            ),
            F.lit("DELETED"),
        ),
    ).drop("_owner", "_found")
    gone = outcome.where(F.col("outcome") == "DELETED").select("sha256")
    return index.join(gone, "sha256", "left_anti"), outcome


def descriptor(base_url: str) -> Column:
    """Blob descriptor; the geo and tile parts are null where the blob has none."""
    geo = F.struct(*[F.col(n) for n in boxes.EDGES], F.col("geohash"))
    tile = F.struct(F.col("tile_z").alias("z"), F.col("tile_x").alias("x"), F.col("tile_y").alias("y"))
    return F.struct(
        F.col("sha256"), F.col("size"), F.col("media_type").alias("type"), F.col("uploaded_at").alias("uploaded"),
        F.concat(F.lit(base_url.rstrip("/") + "/"), F.col("sha256")).alias("url"),
        F.when(F.col("west").isNotNull(), geo).alias("geo"),
        F.when(F.col("tile_z").isNotNull(), tile).alias("tile"),
    )


def bind_upload(uploads: DataFrame) -> DataFrame:
    """Complete an upload's place: a tile gives its box, a box the z14 tile of its centre."""
    tile_box = tiles.tile_box("tile_z", "tile_x", "tile_y")
    has_tile = F.col("tile_z").isNotNull()
    out = uploads.withColumns({n: F.coalesce(F.col(n), F.when(has_tile, tile_box[n])) for n in boxes.EDGES})
    mid = boxes.centre(*boxes.EDGES)
    at = tiles.tile_for_point(mid["lat"], mid["lon"], 14)
    place = F.col("west").isNotNull()
    return out.withColumns({
        "tile_z": F.coalesce("tile_z", F.when(place, F.lit(14).cast("bigint"))),
        "tile_x": F.coalesce("tile_x", F.when(place, at["x"])),
        "tile_y": F.coalesce("tile_y", F.when(place, at["y"])),
        "geohash": F.when(place, boxes.centre_hash(*boxes.EDGES)),
    })


def crawl_owner() -> Column:
    """Owner of the blobs that a crawl of a region and kind stores."""
    return F.concat_ws(":", F.lit("crawler"), "region", "kind")


def ingest_records(payloads: DataFrame, now) -> DataFrame:
    """Index rows of crawled payloads: owner, media type and footprint from the tile."""
    media = None
    for kind, value in K.MEDIA_TYPES.items():
        test = F.col("kind") == kind
        media = F.when(test, value) if media is None else media.when(test, value)
    box = tiles.tile_box("z", "x", "y")
    return payloads.select(
        "sha256", "size", media.alias("media_type"),
        crawl_owner().alias("owner"), c(now).alias("uploaded_at"),
        *[box[n].alias(n) for n in boxes.EDGES],
        F.col("z").alias("tile_z"), F.col("x").alias("tile_x"), F.col("y").alias("tile_y"),
    ).withColumn("geohash", boxes.centre_hash(*boxes.EDGES))


def newest_of_owner(index: DataFrame, owner, limit: int = K.PAGE_LIMIT) -> DataFrame:
    return index.where(F.col("owner") == owner).orderBy(F.col("uploaded_at").desc(), "sha256").limit(limit)


def dedup_ratio(index: DataFrame, keys: list[str], approximate: bool = False) -> DataFrame:
    """Rows against distinct contents."""
    distinct = F.approx_count_distinct("sha256") if approximate else F.count_distinct("sha256")
    out = index.groupBy(*keys).agg(F.count("*").alias("n"), distinct.alias("n_distinct"))
    return out.withColumn("ratio", F.col("n") / F.col("n_distinct"))


# --- work queue --------------------------------------------------------------------------------


def _blank(df: DataFrame) -> DataFrame:
    """Key rows with the state of a new item."""
    state = {n: F.lit(None).cast(t) for n, t in ITEM_STATE.items()}
    state |= {"status": F.lit("pending"), "attempts": F.lit(0).cast("bigint")}
    return df.select(*ITEM_KEY).distinct().withColumns(state)


def seed(items: DataFrame, wanted: DataFrame) -> DataFrame:
    """Add wanted items that are not in the queue; existing rows stay as they are."""
    fresh = _blank(wanted).join(items.select(*ITEM_KEY), ITEM_KEY, "left_anti")
    return items.unionByName(fresh, allowMissingColumns=True).select(*items.columns)


def reseed(items: DataFrame, wanted: DataFrame) -> DataFrame:
    """Targeted seed: existing rows are put back to pending, missing ones are added.

    One outer join on the key does both.
    """
    mark = wanted.select(*ITEM_KEY).distinct().withColumn("_again", F.lit(True))
    joined = items.join(mark, ITEM_KEY, "full_outer")
    again = F.col("_again").isNotNull()
    out = joined.withColumns({
        "status": F.when(again, "pending").otherwise(F.col("status")),
        "attempts": F.when(again, F.lit(0).cast("bigint")).otherwise(F.col("attempts")),
        "last_error": F.when(~again, F.col("last_error")),
    })
    return out.select(*items.columns)


def claim(items: DataFrame, region: str, limit: int, kind: str | None = None, tile=None) -> DataFrame:
    """Next items to work on; Spark keeps only ``limit`` rows per task before the merge."""
    due = items.where(
        (F.col("region") == region) & F.col("status").isin("pending", "failed") & (F.col("attempts") < K.MAX_ATTEMPTS)
    )
    if kind:
        due = due.where(F.col("kind") == kind)
    if tile:
        z, x, y = tile
        due = due.where((F.col("z") == z) & (F.col("x") == x) & (F.col("y") == y))
    first = F.when(F.col("kind") == "dem", 0).when(F.col("kind") == "ortho", 1).otherwise(2)
    return due.orderBy(first, "attempts", "y", "x").limit(limit).select(*ITEM_KEY)


def item_result(items: DataFrame, region, kind, z, x, y) -> DataFrame:
    """State of one item."""
    hit = items.where(
        (F.col("region") == region) & (F.col("kind") == kind) & (F.col("z") == z) & (F.col("x") == x) & (F.col("y") == y)
    )
    return hit.select("status", "sha256", "bytes", "updated_at")


def apply_results(items: DataFrame, results: DataFrame) -> DataFrame:
    """Mark items done or failed from a table of outcomes.

    ``results``: item key, ``r_error`` (null when done), ``r_sha256``, ``r_bytes``,
    ``r_buildings``, ``r_roads``, ``r_landuse``, ``r_at``. Of several outcomes
    of a key the last one counts (a success before a failure of the same time), and each is an attempt.
    """
    rest = [F.col(n) for n in results.columns if n not in ITEM_KEY]
    order = F.struct("r_at", F.col("r_error").isNull(), "r_sha256")
    last = results.groupBy(*ITEM_KEY).agg(F.max_by(F.struct(*rest), order).alias("_r"), F.count("*").alias("_hit"))
    joined = items.join(last.select(*ITEM_KEY, "_r.*", "_hit"), ITEM_KEY, "left")
    hit = F.col("_hit").isNotNull()
    failed = hit & F.col("r_error").isNotNull()
    done = hit & F.col("r_error").isNull()
    count = lambda n: F.when(done, F.coalesce(F.col(f"r_{n}"), F.lit(0))).otherwise(F.col(n))
    out = joined.withColumns({
        "status": F.when(done, "done").when(failed, "failed").otherwise(F.col("status")),
        "attempts": (F.col("attempts") + F.coalesce("_hit", F.lit(0))).cast(items.schema["attempts"].dataType),
        "last_error": F.when(failed, F.substring("r_error", 1, K.MAX_ERROR_CHARS)).when(~done, F.col("last_error")),
        "sha256": F.when(done, F.col("r_sha256")).otherwise(F.col("sha256")),
        "bytes": F.when(done, F.col("r_bytes")).otherwise(F.col("bytes")),
        "updated_at": F.when(hit, F.col("r_at")).otherwise(F.col("updated_at")),
        **{n: count(n) for n in ("buildings", "roads", "landuse") if n in items.columns},
    })
    return out.select(*items.columns)


def progress(items: DataFrame, keys=("region",)) -> DataFrame:
    """Items per status, in total and out of attempts."""
    one = lambda s: F.count_if(F.col("status") == s).alias(s)
    return items.groupBy(*keys).agg(
        one("pending"), one("failed"), one("done"), F.count("*").alias("total"),
        F.count_if(F.col("attempts") >= K.MAX_ATTEMPTS).alias("exhausted"),
    )


def completion_over_time(items: DataFrame) -> DataFrame:
    """Finished items per region up to each second.

    Counting per second first bounds a day to 86,400 rows, so neither a busy region nor
    a busy day needs one task for its items.
    """
    done = items.where(F.col("status") == "done").groupBy("region", "updated_at").agg(F.count("*").alias("n"))
    by_day = done.withColumn("_day", F.floor(F.col("updated_at") / 86_400))
    out = running_by_block(by_day, ["region"], "_day", "updated_at", {"done_so_far": ("sum", F.col("n"), False)})
    return out.drop("_day")


# --- manifests, announcements, reconciliation --------------------------------------------------------


def match_tiles(planned: DataFrame, blobs: DataFrame) -> DataFrame:
    """Planned tiles with the stored blob of the right media type (lowest hash), or none."""
    key = ["z", "x", "y", "media_type"]
    best = blobs.groupBy(*key).agg(F.min(F.struct("sha256", "size")).alias("_b"))
    out = planned.join(best, key, "left")
    return out.withColumns({"sha256": F.col("_b.sha256"), "size": F.col("_b.size")}).drop("_b")


def manifests(matched: DataFrame, request: str = "request_id") -> tuple[DataFrame, DataFrame]:
    """(complete manifests with totals, refused requests): one hole fails the request."""
    totals = matched.groupBy(request).agg(
        F.count("*").alias("tiles"), F.count("sha256").alias("found"),
        F.sum("size").alias("total_bytes"),
    )
    complete = F.col("tiles") == F.col("found")
    refused = totals.where(~complete).select(request, (F.col("tiles") - F.col("found")).alias("missing"))
    return totals.where(complete).select(request, "tiles", "total_bytes"), refused


def announceable(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(finished items, refused rows): only stored bytes are announced."""
    ready = (F.col("status") == "done") & F.col("sha256").isNotNull()
    ready = F.coalesce(ready, F.lit(False))
    return items.where(ready), items.where(~ready).withColumn("code", F.lit("TILE_NOT_DONE"))


def reconcile(announced: DataFrame, stored: DataFrame, content: str = "content") -> DataFrame:
    """Every announced or stored hash with ok, missing, mismatch or orphan."""
    want = announced.select("sha256").distinct().withColumn("_announced", F.lit(True))
    have = stored.select("sha256", (content_key(content) == F.col("sha256")).alias("_same"))
    have = have.groupBy("sha256").agg(F.bool_and("_same").alias("_same"))
    both = want.join(have, "sha256", "full_outer")
    status = (
        F.when(F.col("_announced").isNull(), "orphan").when(F.col("_same").isNull(), "missing")
        .when(~F.col("_same"), "mismatch").otherwise("ok")
    )
    return both.select("sha256", status.alias("status"))


# --- placements ------------------------------------------------------------------------------------------


def replace_placements(current: DataFrame, batch: DataFrame) -> DataFrame:
    """A publisher replaces only their own placement of a name; ownerless rows stay."""
    batch = batch.withColumn(
        "message", F.nullif(F.substring(F.trim(F.col("message")), 1, 280), F.lit(""))
    )
    newest = latest(batch, ["pubkey", "name"], [F.col("seq")])
    kept = current.join(
        newest.select("pubkey", "name"), ["pubkey", "name"], "left_anti"
    )
    return kept.unionByName(newest, allowMissingColumns=True)
