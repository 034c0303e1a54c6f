"""Event rows: addresses, tags, builders and identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolith import constants as K
from cartolith.functions import boxes, geohash, grammar, numbers, tiles
from cartolith.functions._c import c, first_code, long


# --- addresses --------------------------------------------------------------------
def item_address(dataset, z, x, y) -> Column:
    """``dataset:z/x/y``, null when the dataset or the tile is not valid."""
    text = F.concat_ws(":", c(dataset), tiles.tile_key(z, x, y))
    ok = grammar.dataset_code(dataset).isNull() & tiles.tile_code(z, x, y).isNull()
    return F.when(ok, text)


def parse_item_address(value) -> Column:
    """Dataset and tile of an item address, null unless it is exactly well-formed."""
    pattern = (
        r"^([a-z0-9](?:[a-z0-9._\-]{0,62}[a-z0-9])?):"
        r"(0|[1-9][0-9]*)/(0|[1-9][0-9]*)/(0|[1-9][0-9]*)\z"
    )
    v = c(value)

    def number(group):
        return F.nullif(F.regexp_extract(v, pattern, group), F.lit("")).try_cast("bigint")

    z, x, y = number(2), number(3), number(4)
    parsed = F.struct(
        F.regexp_extract(v, pattern, 1).alias("dataset"), z.alias("z"), x.alias("x"), y.alias("y")
    )
    return F.when(grammar.matches(v, pattern) & tiles.tile_code(z, x, y).isNull(), parsed)


def collection_address(pubkey, dataset) -> Column:
    return F.concat_ws(":", F.lit(str(K.KIND_COLLECTION)), c(pubkey), c(dataset))


def rfc3339(epoch_seconds) -> Column:
    """UTC text of an instant, whatever the session zone is."""
    at = F.to_utc_timestamp(
        F.timestamp_seconds(long(epoch_seconds)), F.lit("UTC")
    )
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


# --- tags ---------------------------------------------------------------------------
def tag(*values) -> Column:
    return F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values])


def tag_value(tags, name: str) -> Column:
    """Second element of the first tag with a name."""
    first = F.try_element_at(F.filter(c(tags), lambda t: F.get(t, F.lit(0)) == name), F.lit(1))
    return F.get(first, F.lit(1))


def tag_values(tags, name: str) -> Column:
    """Second elements of every tag with a name and at least two elements."""
    named = F.filter(c(tags), lambda t: (F.size(t) >= 2) & (F.get(t, F.lit(0)) == name))
    return F.transform(named, lambda t: F.get(t, F.lit(1)))


def footprint_from_tags(tags) -> Column:
    """Box of the first five-element bbox tag, null when it is not a footprint."""
    found = F.try_element_at(
        F.filter(c(tags), lambda t: (F.size(t) == 5) & (F.get(t, F.lit(0)) == "bbox")), F.lit(1)
    )
    edge = [F.get(found, F.lit(i)).try_cast("double") for i in range(1, 5)]
    box = F.struct(*[v.alias(n) for v, n in zip(edge, boxes.EDGES)])
    return F.when(boxes.footprint_ok(*edge), box)


def position_from_tags(tags) -> Column:
    """Presence position: ``lon,lat``, or four parts that form one point."""
    parts = F.split(tag_value(tags, "bbox"), ",", -1)
    number = [F.get(parts, F.lit(i)).try_cast("double") for i in range(4)]
    two = F.size(parts) == 2
    four = (F.size(parts) == 4) & (number[0] == number[2]) & (number[1] == number[3])
    inside = number[0].between(-180, 180) & number[1].between(-90, 90)
    point = F.struct(
        number[0].alias("lon"), number[1].alias("lat"),
        F.when(two, F.lit(2)).otherwise(F.lit(4)).alias("parts"),
    )
    return F.when((two | four) & inside, point)


def presence(pubkey, created_at, content, tags) -> Column:
    """Presence fields of a status event, null when name, hash or position is missing."""
    name = F.nullif(tag_value(tags, "name"), F.lit(""))
    sha = F.nullif(tag_value(tags, "x"), F.lit(""))
    at = position_from_tags(tags)
    row = F.struct(
        c(pubkey).alias("pubkey"), name.alias("name"), sha.alias("sha256"),
        at["lon"].alias("lon"), at["lat"].alias("lat"), at["parts"].alias("parts"),
        c(content).alias("message"), c(created_at).alias("created_at"),
    )
    return F.when(name.isNotNull() & sha.isNotNull() & at.isNotNull(), row)


def meetup_label(tags) -> Column:
    """Calendar mark, title or location, and the start time in the session zone."""
    title = F.coalesce(
        F.nullif(tag_value(tags, "title"), F.lit("")),
        F.nullif(tag_value(tags, "location"), F.lit("")),
        F.lit("meetup"),
    )
    starts = tag_value(tags, "start").try_cast("double")
    clock = F.date_format(F.timestamp_seconds(starts.cast("bigint")), "HH:mm")
    head = F.concat(F.lit("\U0001f4c5 "), title)
    return F.when(F.coalesce(starts > 0, F.lit(False)), F.concat(head, F.lit(" "), clock)).otherwise(head)


# --- builders --------------------------------------------------------------------------
def collection_event(dataset, title, box, mime, licence, source, server, created_at, description=""):
    """Collection event row; ``code`` names the first broken field, in emission order."""
    edge = [c(v) for v in box]
    code = F.coalesce(
        grammar.created_at_code(created_at), grammar.dataset_code(dataset),
        grammar.text_code(title), boxes.extent_code(*edge), grammar.mime_code(mime),
        grammar.text_code(licence), grammar.text_code(source), grammar.text_code(server),
    )
    tags = F.array(
        tag("d", c(dataset)), tag("title", c(title)),
        tag("bbox", *[numbers.canonical_coordinate(v) for v in edge]),
        tag("m", c(mime)), tag("license", c(licence)), tag("source", c(source)),
        tag("server", c(server)),
    )
    body = c(description) if isinstance(description, Column) else F.lit(description)
    event = F.struct(
        F.lit(K.KIND_COLLECTION).alias("kind"), long(created_at).alias("created_at"),
        tags.alias("tags"), F.coalesce(body, F.lit("")).alias("content"),
    )
    return F.struct(code.alias("code"), F.when(code.isNull(), event).alias("event"))


def with_item_event(df: DataFrame, name: str, dataset, pubkey, z, x, y, sha256, url, mime, size, datetime,
                    created_at, properties=None) -> DataFrame:
    """Adds the item event of each row as struct (code, event) under ``name``.

    The box and the cell are derived from the tile. ``properties`` is JSON text; without it
    the bag is empty and no Python worker runs.
    """
    code = F.coalesce(
        grammar.created_at_code(created_at), grammar.dataset_code(dataset),
        tiles.tile_code(z, x, y), grammar.hex64_code(pubkey), grammar.hex64_code(sha256),
        grammar.url_code(url), grammar.mime_code(mime), grammar.size_code(size),
        grammar.datetime_code(datetime),
    )
    bag = F.lit("{}")
    if properties is not None:
        df = df.withColumn("_bag", numbers.properties(c(properties)))
        code, bag = F.coalesce(code, F.col("_bag.code")), F.col("_bag.text")
    mid = tiles.tile_centre(z, x, y)
    df = df.withColumns({
        "_code": code, "_box": tiles.tile_box(z, x, y),
        "_cell": geohash.encode(mid["lat"], mid["lon"], K.EVENT_PRECISION), "_key": tiles.tile_key(z, x, y),
    })
    corner = [numbers.canonical_coordinate(F.col(f"_box.{n}")) for n in boxes.EDGES]
    content = F.concat(
        F.lit('{"bbox":['), F.concat_ws(",", *corner), F.lit('],"datetime":"'), c(datetime),
        F.lit('","properties":'), bag, F.lit("}"),
    )
    tags = F.array(
        tag("d", F.concat_ws(":", c(dataset), F.col("_key"))), tag("g", F.col("_cell")),
        tag("a", collection_address(pubkey, dataset)), tag("x", c(sha256)), tag("url", c(url)), tag("m", c(mime)),
        tag("size", long(size).cast("string")),
    )
    event = F.struct(
        F.lit(K.KIND_ITEM).alias("kind"), long(created_at).alias("created_at"),
        tags.alias("tags"), content.alias("content"),
    )
    out = df.withColumn(name, F.struct(F.col("_code").alias("code"), F.when(F.col("_code").isNull(), event).alias("event")))
    return out.drop("_code", "_box", "_cell", "_key", "_bag")


def _ladder(cell, precisions=K.SOCIAL_PRECISIONS) -> list[Column]:
    """Cell tags, one per precision, cut from the deepest cell.

    ``cell`` should be a column of its own: it is read once per precision.
    """
    return [tag("g", F.substring(c(cell), 1, p)) for p in sorted(set(precisions))]


def announcement_tags(sha256, url, media_type, size, box, cell, precisions=K.SOCIAL_PRECISIONS) -> Column:
    """Tags of a file announcement; ``cell`` is the cell of the box centre."""
    return F.array(
        tag("x", c(sha256)), tag("url", c(url)), tag("m", c(media_type)),
        tag("size", long(size).cast("string")),
        tag("bbox", *[numbers.canonical_coordinate(v) for v in box]),
        *_ladder(cell, precisions),
    )


def _point_text(lon, lat) -> Column:
    return F.format_string("%.6f,%.6f,%.6f,%.6f", c(lon), c(lat), c(lon), c(lat))


def placement_tags(sha256, url, size, name, lon, lat, cell, heading, topic: str) -> Column:
    return F.array(
        tag("x", c(sha256)), tag("url", c(url)), tag("m", "model/gltf-binary"),
        tag("size", long(size).cast("string")), tag("bbox", _point_text(lon, lat)),
        tag("heading", F.format_string("%.1f", c(heading))), tag("t", topic), tag("name", c(name)),
        *_ladder(cell),
    )


def presence_tags(dataset: str, sha256, name, lon, lat, cell, topic: str) -> Column:
    return F.array(
        tag("d", dataset), tag("name", c(name)), tag("x", c(sha256)),
        tag("bbox", _point_text(lon, lat)), tag("t", topic), *_ladder(cell),
    )


def meetup_tags(prefix: str, title, starts, location, lon, lat, cell, topic: str) -> Column:
    """Tags of a meetup; ``cell`` has at least eight letters."""
    name = F.substring(F.trim(c(title)), 1, 120)
    where = F.coalesce(F.nullif(F.substring(F.trim(c(location)), 1, 160), F.lit("")), name)
    when = long(starts).cast("string")
    return F.array(
        tag("d", F.concat_ws("-", F.lit(prefix), when, F.substring(c(cell), 1, 8))),
        tag("title", name), tag("start", when), tag("location", where),
        tag("bbox", _point_text(lon, lat)), tag("t", topic), *_ladder(cell),
    )


def presence_message(message, lat, lon) -> Column:
    said = F.nullif(F.substring(F.trim(c(message)), 1, 280), F.lit(""))
    return F.coalesce(said, F.format_string("exploring %.4f, %.4f", c(lat), c(lon)))


# --- identity ------------------------------------------------------------------------------
_SHORT = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}
_CONTROLS = [_SHORT.get(n, f"\\u{n:04x}") for n in range(32)]


def json_string(value) -> Column:
    """A JSON string literal with the minimal escapes (quote, backslash, controls).

    Only texts that hold such a character are taken apart.
    """
    v = c(value)
    controls = F.array(*[F.lit(e) for e in _CONTROLS])

    def escape(ch):
        return (
            F.when(ch == '"', '\\"').when(ch == "\\", "\\\\")
            .when((ch != "") & (F.ascii(ch) < 32), F.get(controls, F.ascii(ch))).otherwise(ch)
        )

    taken_apart = F.array_join(F.transform(F.split(v, ""), escape), "")
    return F.concat(F.lit('"'), F.when(v.rlike(r'[\x00-\x1f"\\]'), taken_apart).otherwise(v), F.lit('"'))


def serialised(pubkey, created_at, kind, tags, content) -> Column:
    """Compact array text an event id is the hash of."""
    tag_text = F.transform(
        c(tags),
        lambda t: F.concat(
            F.lit("["), F.array_join(F.transform(t, lambda v: json_string(v)), ","), F.lit("]")
        ),
    )
    return F.concat(
        F.lit("[0,"), json_string(pubkey), F.lit(","), long(created_at).cast("string"), F.lit(","),
        long(kind).cast("string"), F.lit(",["), F.array_join(tag_text, ","), F.lit("],"),
        json_string(content), F.lit("]"),
    )


def event_id(pubkey, created_at, kind, tags, content) -> Column:
    return F.sha2(serialised(pubkey, created_at, kind, tags, content), 256)


def shape_code(event) -> Column:
    """Null for a well-shaped event struct, else which part is missing."""
    e = c(event)

    def absent(name):
        return F.coalesce(e[name], F.lit("")) == ""

    tags_ok = F.coalesce(
        F.forall(e["tags"], lambda t: t.isNotNull() & F.forall(t, lambda v: v.isNotNull())),
        F.lit(False),
    )
    return first_code(
        (e.isNull(), "EVENT"),
        (absent("id"), "ID"), (absent("pubkey"), "PUBKEY"), (e["kind"].isNull(), "KIND"),
        (e["created_at"].isNull(), "CREATED_AT"), (e["content"].isNull(), "CONTENT"),
        (absent("sig"), "SIG"), (~tags_ok, "TAGS"),
    )
