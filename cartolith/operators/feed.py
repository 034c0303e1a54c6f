"""Batch operators on event feeds: filters, integrity, heads and publish clocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cartolith import constants as K
from cartolith.functions import boxes, events, geohash, grammar
from cartolith.functions._c import c, first_code, once
from cartolith.operators import generate, spatial
from cartolith.operators.ordered import running_by_block


# --- viewport covers ------------------------------------------------------------------


def ladder_coverage(views: DataFrame, max_cells: int = K.MAX_LADDER_CELLS) -> DataFrame:
    """Finest announced precision whose whole cover fits the cell budget, per view.

    Counts come first, from index arithmetic; only the chosen precision's cells are built.
    The coarsest precision is taken even when it overflows, and ``complete`` says so.
    """
    rows = views.withColumn("segments", boxes.view_segments(*boxes.EDGES))

    def total(p):
        return F.aggregate(
            "segments", F.lit(0).cast("bigint"),
            lambda acc, b: acc + geohash.cover_count(b["west"], b["south"], b["east"], b["north"], p),
        )

    ladder = sorted(K.SOCIAL_PRECISIONS)
    rows = rows.withColumns({f"_n{p}": total(p) for p in ladder})
    chosen = F.coalesce(*[F.when(F.col(f"_n{p}") <= max_cells, p) for p in reversed(ladder[1:])], F.lit(ladder[0]))
    rows = rows.withColumn("precision_no", chosen)

    def cells(p):
        return F.flatten(
            F.transform(
                "segments", lambda b: geohash.cover_array(b["west"], b["south"], b["east"], b["north"], p)
            )
        )

    def pick(make):
        chain = None
        for p in ladder:
            test = F.col("precision_no") == p
            chain = F.when(test, make(p)) if chain is None else chain.when(test, make(p))
        return chain

    rows = rows.withColumn("required_cells", pick(lambda p: F.col(f"_n{p}")))
    usable = F.size("segments") > 0
    rows = rows.withColumns({
        "cells": F.slice(pick(cells), 1, max_cells),
        "complete": usable & (F.col("required_cells") <= max_cells),
    })
    return rows.drop(*[f"_n{p}" for p in ladder])


def nearby(views: DataFrame, tagged: DataFrame, cell: str, collection: str | None = None, limit: int | None = K.PAGE_LIMIT,
           max_cells: int = K.MAX_COVER_CELLS, view: str = "view_id", kind: int | None = K.KIND_ITEM):
    """(matches, too-wide views): the newest items of each view whose cover fits one filter.

    ``tagged`` holds events with ``kind``, ``created_at``, ``id`` and their cell, once per cell they are tagged with; only
    events of ``kind`` count (None: all), with ``collection`` (an address) only those that name it among their ``a`` tags
    (``tags``). ``limit`` is the page of a view: the newest ones, lowest id among equals; None gives every match.
    """
    n = geohash.cover_count(*boxes.EDGES, K.EVENT_PRECISION)
    narrow = views.where(n <= max_cells)
    wide = views.where(n > max_cells).withColumn("cells", n)
    items = tagged if kind is None else tagged.where(F.col("kind") == kind)
    if collection is not None:
        items = items.where(F.array_contains(events.tag_values("tags", "a"), collection))
    found = spatial.cover_join(narrow, items, K.EVENT_PRECISION, cell)
    # An event tagged with several cells of a view counts once on its page.
    found = found.dropDuplicates([view, "id"])
    return found if limit is None else newest_per(found, [view], limit), wide


# --- relay filters -----------------------------------------------------------------------


def newest(df: DataFrame, limit: int = K.PAGE_LIMIT) -> DataFrame:
    """First page of a feed, newest first, lowest id among equals."""
    return df.orderBy(F.col("created_at").desc(), F.col("id")).limit(limit)


def catalog(feed: DataFrame, authors=None, limit: int = K.PAGE_LIMIT) -> DataFrame:
    """Collection events, optionally of some authors."""
    rows = feed.where(F.col("kind") == K.KIND_COLLECTION)
    if authors is not None:
        rows = rows.where(F.col("pubkey").isin(*authors))
    return newest(rows, limit)


def exact_tile(feed: DataFrame, address: str, authors=None, per_author: int | None = None,
               limit: int = K.PAGE_LIMIT) -> DataFrame:
    """Item events of one address; ``per_author`` keeps one publisher from hiding others."""
    rows = feed.where((F.col("kind") == K.KIND_ITEM) & (F.col("d") == address))
    if authors is not None:
        rows = rows.where(F.col("pubkey").isin(*authors))
    if per_author is not None:
        return newest_per(rows, ["pubkey"], per_author)
    return newest(rows, limit)


def newest_per(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Newest ``k`` rows per key. Spark limits each task's rows per key before the
    shuffle, so a key that holds a third of all rows moves at most k rows per task."""
    order = W.partitionBy(*keys).orderBy(F.col("created_at").desc(), F.col("id"))
    return df.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= k).drop("_rn")


# --- integrity ------------------------------------------------------------------------------


def split_shape(feed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(well-shaped events, rejects with a code)."""
    row = F.struct(*[F.col(n) for n in ("id", "pubkey", "kind", "created_at", "content", "sig", "tags")])
    coded = feed.withColumn("_e", row).withColumn("code", events.shape_code("_e")).drop("_e")
    return coded.where(F.col("code").isNull()).drop("code"), coded.where(F.col("code").isNotNull())


def split_integrity(feed: DataFrame, sig_ok: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(events whose id is the hash of their content, tampered rows).

    Applied before any newest-wins step, so a forged time can never win. ``sig_ok`` names
    a column that carries the outcome of a signature check made elsewhere.
    """
    good = F.coalesce(
        events.event_id("pubkey", "created_at", "kind", "tags", "content") == F.col("id"), F.lit(False)
    )
    if sig_ok is not None:
        good = good & F.coalesce(F.col(sig_ok), F.lit(False))
    marked = feed.withColumn("_good", good)
    return marked.where("_good").drop("_good"), marked.where("NOT _good").drop("_good")


def write_gate(feed: DataFrame, allowed: str | None, pubkey: str = "pubkey") -> DataFrame:
    """Accept or reject per row: only the named author may write, nobody when unset."""
    allowed = (allowed or "").strip().lower()
    accepted = F.coalesce(F.lower(F.col(pubkey)) == allowed, F.lit(False)) & F.lit(bool(allowed))
    return feed.withColumns({
        "action": F.when(accepted, "accept").otherwise("reject"),
        "msg": F.when(~accepted, "blocked: only the corpus publisher may write here"),
    })


# --- state -------------------------------------------------------------------------------------


def heads(feed: DataFrame, keys: list[str]) -> DataFrame:
    """Current event per key: highest created_at, then lowest id.

    A map-side aggregate: every task sends one row per key, so a busy author or address
    costs no more than a quiet one.
    """
    order = F.struct((-F.col("created_at")).alias("age"), F.col("id"))
    rest = [F.col(n) for n in feed.columns if n not in keys]
    best = feed.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_head"))
    return best.select(*keys, "_head.*")


def on_topic(feed: DataFrame, topic: str | None) -> DataFrame:
    """Events that carry ``topic`` among their ``t`` tags; all events for no topic."""
    if topic is None:
        return feed
    return feed.where(F.coalesce(F.array_contains(events.tag_values("tags", "t"), topic), F.lit(False)))


def in_view(rows: DataFrame, view: tuple | None) -> DataFrame:
    """Rows whose ``lon`` and ``lat`` lie in a view (west, south, east, north); all rows for no view.

    The view may cross the 180th meridian.
    """
    if view is None:
        return rows
    return rows.where(boxes.in_segments(boxes.view_segments(*[F.lit(float(edge)) for edge in view]), "lon", "lat"))


def newest_presences(feed: DataFrame, topic: str | None = None, view: tuple | None = None) -> DataFrame:
    """Newest status per author among those of the topic, then its presence fields where it has them.

    The topic is tested before the newest one is taken, so another status of the author hides
    nothing. The view is tested after: an author who has left it isn't shown at an older place.
    """
    status = heads(on_topic(feed.where(F.col("kind") == K.KIND_STATUS), topic), ["pubkey"])
    rows = status.withColumn("_p", once(events.presence("pubkey", "created_at", "content", "tags")))
    return in_view(rows.where(F.col("_p").isNotNull()).select("_p.*"), view)


def fresh_notes(feed: DataFrame, now: int, view: tuple | None = None) -> DataFrame:
    """Notes of the shown kinds from the last 48 hours, one row per id, with a position (in ``view``)."""
    rows = feed.where(F.col("kind").isin(*K.NOTE_KINDS) & (F.col("created_at") >= now - K.NOTE_MAX_AGE_S))
    rows = rows.dropDuplicates(["id"])
    spot = geohash.decode(geohash.deepest(events.tag_values("tags", "g")))
    text = F.when(F.col("kind") == K.KIND_MEETUP, events.meetup_label("tags")).otherwise(F.col("content"))
    rows = rows.withColumn("_spot", once(spot)).where(F.col("_spot").isNotNull())
    return in_view(rows.select(
        "id", "pubkey", text.alias("content"), F.col("_spot.lon").alias("lon"),
        F.col("_spot.lat").alias("lat"), "created_at",
    ), view)


def union_relays(*answers: DataFrame) -> DataFrame:
    """Answers of several relays as one feed, one row per event id."""
    out = answers[0]
    for other in answers[1:]:
        out = out.unionByName(other)
    return out.dropDuplicates(["id"])


def publish_clock(requests: DataFrame, keys: list[str], now: str = "now", order: str = "id",
                  last: DataFrame | None = None) -> DataFrame:
    """Publish time of each request: max(now, previous + 1) within an address.

    Requests are taken by (now, order). Requests of the same second differ only in their
    rank, so the running maximum is over distinct seconds (bounded per day) and a hot
    address never sits in one task; ranks inside a second are cut by the first two letters
    of ``order``. ``last`` holds the last published time per address (column ``last``).
    ``code`` marks an overflow.
    """
    if dict(requests.dtypes)[order] != "string":
        raise ValueError(f"{order} must be text: parts and ranks of a second are ordered alike only then")
    rows = requests.withColumn("_p", F.substring(F.col(order).cast("string"), 1, 2))
    per_part = rows.groupBy(*keys, now, "_p").agg(F.count("*").alias("_n"))
    inside = W.partitionBy(*keys, now).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    parts = per_part.withColumn("_before", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    seconds = per_part.groupBy(*keys, now).agg(F.sum("_n").alias("_count"))

    # start(second) = rows before + max over seconds so far of (second - rows before).
    day = F.floor(F.col(now) / 86_400)
    counted = running_by_block(
        seconds.withColumn("_day", day), keys, "_day", now,
        {"_rows_before": ("sum", F.col("_count"), True)},
    )
    lead = F.col(now) - F.col("_rows_before")
    led = running_by_block(
        counted.withColumn("_lead", lead), keys, "_day", now, {"_ahead": ("max", F.col("_lead"), False)}
    )
    if last is not None:
        led = led.join(last, keys, "left").withColumn("_ahead", F.greatest("_ahead", F.col("last") + 1)).drop("last")
    starts = led.select(*keys, now, (F.col("_rows_before") + F.col("_ahead")).alias("_start"))

    rank = W.partitionBy(*keys, now, "_p").orderBy(F.col(order))
    out = rows.withColumn("_rn", F.row_number().over(rank))
    out = out.join(parts.select(*keys, now, "_p", "_before"), [*keys, now, "_p"]).join(starts, [*keys, now])
    at = F.col("_start") + F.col("_before") + F.col("_rn") - 1
    code = F.coalesce(
        grammar.created_at_code(F.col(now)), first_code((at > K.MAX_CREATED_AT, "CREATED_AT_RANGE"))
    )
    out = out.withColumns({"code": code, "created_at": F.when(code.isNull(), at)})
    return out.select(*requests.columns, "created_at", "code")


def catalog_problems(collections: DataFrame) -> DataFrame:
    """Collections that do not carry exactly one bbox, license, server and m tag."""

    def count(name: str) -> Column:
        return F.size(F.filter("tags", lambda t: F.get(t, F.lit(0)) == name))

    wrong = F.array_compact(F.array(*[F.when(count(n) != 1, n) for n in ("bbox", "license", "server", "m")]))
    return collections.withColumn("missing", wrong)


def crowded_cells(feed: DataFrame, cell: str, limit: int = K.PAGE_LIMIT) -> DataFrame:
    """Cells with more events than one page holds."""
    return feed.groupBy(cell).agg(F.count("*").alias("n")).where(F.col("n") > limit)


def cell_filter(feed: DataFrame, lat, lon, precision: int = 4) -> DataFrame:
    """Announcements tagged with the cell of one point."""
    cell = geohash.encode(c(lat), c(lon), precision)
    return feed.where((F.col("kind") == K.KIND_FILE) & F.array_contains(events.tag_values("tags", "g"), cell))


def box_filter(views: DataFrame, feed: DataFrame, precision: int = 4, max_cells: int = K.MAX_COVER_CELLS):
    """(matches, too-wide views) of announcements tagged with any cell of a box."""
    n = geohash.cover_count(*boxes.EDGES, precision)
    cells = generate.box_cells(views.where(n <= max_cells), precision, spread=0).select("view_id", F.col("cell").alias("_wanted"))
    tagged = feed.where(F.col("kind") == K.KIND_FILE).withColumn(
        "_cell", F.explode(F.array_distinct(events.tag_values("tags", "g")))
    )
    tagged = tagged.where(F.length("_cell") == precision)
    return tagged.join(cells, F.col("_cell") == F.col("_wanted")).drop("_cell", "_wanted"), views.where(n > max_cells)
