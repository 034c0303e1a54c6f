"""Derived inputs: the geodata shapes computed from the given star-schema tables.

Each view is one SQL text rendered for two dialects, so the Spark query and its check
query start from the same rows. Every view reads whole tables.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


class Spark:
    """Spark spelling of the few functions the two dialects name differently."""

    def sha(self, e):
        return f"sha2({e}, 256)"

    def epoch(self, ts):
        return f"CAST(floor(unix_micros(CAST({ts} AS TIMESTAMP)) / 1e6) AS BIGINT)"

    def points(self, lon, lat, order):
        return (
            f"transform(sort_array(collect_list(named_struct('s', {order}, 'lon', {lon}, 'lat', {lat}))), "
            "p -> named_struct('lon', p.lon, 'lat', p.lat))"
        )

    def grid(self):
        return "SELECT vec_id, label, i, v FROM {embeddings} LATERAL VIEW posexplode(embedding) t AS i, v"

    def ring(self, pairs):
        items = ", ".join(f"named_struct('lon', {a}, 'lat', {b})" for a, b in pairs)
        return f"array({items})"

    def table(self, name):
        return "{" + name + "}"


class Duck(Spark):
    """DuckDB spelling."""

    def sha(self, e):
        return f"sha256({e})"

    def epoch(self, ts):
        return f"CAST(floor(epoch_us({ts}) / 1e6) AS BIGINT)"

    def points(self, lon, lat, order):
        return f"list({{'lon': {lon}, 'lat': {lat}}} ORDER BY {order})"

    def grid(self):
        return (
            "SELECT vec_id, label, unnest(range(len(embedding))) AS i, unnest(embedding) AS v FROM embeddings"
        )

    def ring(self, pairs):
        items = ", ".join(f"{{'lon': {a}, 'lat': {b}}}" for a, b in pairs)
        return f"[{items}]"

    def table(self, name):
        return name


def idiv(a, b) -> str:
    return f"CAST(floor({a} / CAST({b} AS DOUBLE)) AS BIGINT)"


def tile_x(lon, z) -> str:
    return (
        f"CAST(least(greatest(floor(({lon} + 180e0) / 360e0 * pow(2e0, {z})), 0e0), "
        f"pow(2e0, {z}) - 1e0) AS BIGINT)"
    )


def tile_y(lat, z) -> str:
    clamped = f"greatest(-85.05112878e0, least(85.05112878e0, {lat}))"
    return (
        f"CAST(least(greatest(floor((1e0 - asinh(tan(radians({clamped}))) / pi()) / 2e0 * pow(2e0, {z})), 0e0), "
        f"pow(2e0, {z}) - 1e0) AS BIGINT)"
    )


def build(d) -> dict[str, tuple[tuple[str, ...], str]]:
    """Name -> (views it reads, SELECT text) for a dialect."""
    t = d.table
    return {
        "v_points": ((), f"""
            SELECT event_id, user_id, event_type, value,
                   -25e0 + ((event_id * 7919) % 57000) / 1e3 AS lon,
                   34e0 + ((event_id * 104729) % 37500) / 1e3 AS lat,
                   {d.epoch('ts')} AS epoch
            FROM {t('events')}"""),
        "v_tiles": (("v_points",), f"""
            SELECT event_id, lon, lat, CAST(10 + event_id % 5 AS BIGINT) AS z,
                   {tile_x('lon', '(10 + event_id % 5)')} AS x,
                   {tile_y('lat', '(10 + event_id % 5)')} AS y
            FROM {t('v_points')}"""),
        "v_boxes": ((), f"""
            SELECT id, owner, uploaded_at, size, lod, west, south,
                   west + (1 + id % 20) / 20e0 AS east, south + (1 + id % 10) / 20e0 AS north,
                   {d.sha("CAST(id AS STRING)")} AS sha256,
                   CASE WHEN id % 3 = 0 THEN 'image/png' WHEN id % 3 = 1 THEN 'image/jpeg'
                        ELSE 'application/vnd.feature-tile' END AS media_type
            FROM (SELECT o_orderkey AS id, o_custkey AS owner, o_orderpriority AS lod,
                         {d.epoch('o_orderdate')} AS uploaded_at,
                         CAST(round(o_totalprice) AS BIGINT) AS size,
                         -25e0 + ((o_orderkey * 7919) % 56000) / 1e3 AS west,
                         34e0 + ((o_orderkey * 104729) % 36500) / 1e3 AS south
                  FROM {t('orders')}) b"""),
        "v_views": ((), f"""
            SELECT CAST(n_nationkey AS BIGINT) AS view_id, n_name AS name,
                   -25e0 + n_nationkey * 2 AS west, 34e0 + n_nationkey AS south,
                   -25e0 + n_nationkey * 2 + 3e0 AS east, 34e0 + n_nationkey + 2e0 AS north
            FROM {t('nation')}"""),
        "v_wide_views": ((), f"""
            SELECT CAST(n_nationkey AS BIGINT) AS view_id,
                   150e0 + n_nationkey * 2 AS west, 34e0 + n_nationkey AS south,
                   150e0 + n_nationkey * 2 + 15e0 AS east, 34e0 + n_nationkey + 2e0 AS north
            FROM {t('nation')}"""),
        "v_polys": (("v_views",), f"""
            SELECT view_id AS poly_id, name,
                   {d.ring([('west', 'south + 0.3e0'), ('west + 1.4e0', 'south'), ('east', 'south + 0.7e0'),
                            ('east - 0.9e0', 'south + 1.1e0'), ('east - 0.2e0', 'north'), ('west + 0.5e0', 'north - 0.1e0')])}
                   AS ring
            FROM {t('v_views')}"""),
        "v_items": ((), f"""
            SELECT CASE l_suppkey % 4 WHEN 0 THEN 'madeira' WHEN 1 THEN 'south-tyrol'
                        WHEN 2 THEN 'vienna' ELSE 'europe' END AS region,
                   CASE l_linenumber % 3 WHEN 0 THEN 'dem' WHEN 1 THEN 'ortho' ELSE 'features' END AS kind,
                   CAST(13 AS BIGINT) AS z, l_partkey AS x, l_orderkey AS y,
                   CASE min(l_returnflag) WHEN 'A' THEN 'done' WHEN 'N' THEN 'pending' ELSE 'failed' END AS status,
                   CAST(max(l_quantity) AS BIGINT) % 6 AS attempts,
                   CASE WHEN min(l_returnflag) = 'R' THEN 'TimeoutError: upstream' END AS last_error,
                   CASE WHEN min(l_returnflag) = 'A' THEN
                        {d.sha("concat(CAST(l_partkey % 50 AS STRING), '/', CAST(l_orderkey % 40 AS STRING))")} END AS sha256,
                   CASE WHEN min(l_returnflag) = 'A' THEN CAST(round(max(l_extendedprice)) AS BIGINT) END AS bytes,
                   {d.epoch('max(l_shipdate)')} AS updated_at
            FROM {t('lineitem')}
            GROUP BY l_suppkey % 4, l_linenumber % 3, l_partkey, l_orderkey"""),
        "v_blobs": ((), f"""
            SELECT doc_id, text AS content, {d.sha('text')} AS sha256, source AS owner, n_chars AS size,
                   CAST(1700000000 + doc_id AS BIGINT) AS uploaded_at
            FROM {t('documents')}"""),
        "v_probe": ((), f"""
            SELECT doc_id, {idiv('doc_id', 3)} AS cell, doc_id % 3 AS rank,
                   concat('source-', CAST(doc_id % 3 AS STRING)) AS source_id,
                   quality = 1 AS ok,
                   0.1e0 + (n_chars % 4) / 10e0 AS m_per_px,
                   1.2e0 + (n_chars % 60) / 100e0 AS detail,
                   100000e0 + n_chars * 50 AS density,
                   CASE WHEN doc_id % 11 = 0 THEN NULL ELSE (doc_id % 7) - 1e0 END AS elevation_m
            FROM (SELECT l.doc_id, l.quality, d.n_chars FROM {t('labels')} l JOIN {t('documents')} d ON l.doc_id = d.doc_id) j"""),
        "v_grid": ((), f"""
            SELECT vec_id AS source, CAST(label AS BIGINT) AS label, {idiv('i', 8)} AS row_no,
                   CAST(i % 8 AS BIGINT) AS col_no,
                   250e0 + 40e0 * CAST(v AS DOUBLE) AS h,
                   251e0 + 40e0 * CAST(v AS DOUBLE) + label AS surface_h,
                   CASE WHEN (vec_id * 64 + i) % 37 = 0 THEN -9999e0 ELSE 250e0 + 40e0 * CAST(v AS DOUBLE) END AS raw_h
            FROM ({d.grid()}) g"""),
        "v_vertices": ((), f"""
            SELECT l_orderkey AS feature, CAST(l_linenumber AS BIGINT) AS seq,
                   min(l_suppkey) AS supp, min(l_partkey) AS part, min(l_quantity) AS qty
            FROM {t('lineitem')} GROUP BY l_orderkey, l_linenumber"""),
        "v_lines": (("v_vertices",), f"""
            SELECT feature, max(supp) % 9 AS class_no, CAST(count(*) AS BIGINT) AS n,
                   {d.points('16.2e0 + (feature % 100) / 1e3 + part % 97 / 1e5',
                             '48.1e0 + (feature % 90) / 1e3 + qty / 1e5', 'seq')} AS line
            FROM {t('v_vertices')} GROUP BY feature"""),
        "v_feed": (("v_points",), f"""
            SELECT event_id, {d.sha("CAST(event_id AS STRING)")} AS id,
                   {d.sha("concat('author-', CAST(user_id AS STRING))")} AS pubkey, user_id,
                   CASE event_type WHEN 'view' THEN 30315 WHEN 'signup' THEN 1 WHEN 'click' THEN 1063
                        WHEN 'purchase' THEN 31923 ELSE 7 END AS kind,
                   epoch - epoch % 3600 AS created_at, event_type AS content,
                   concat('name-', CAST(user_id % 20 AS STRING)) AS name, lon, lat,
                   {idiv('value', 50)} AS slot
            FROM {t('v_points')}"""),
        "v_packets": (("v_points",), f"""
            SELECT event_id, {idiv('user_id', 2)} AS window_id, user_id % 2 AS beacon, event_id % 40 AS seq,
                   CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS hop_limit,
                   event_type = 'error' AS junk, -60 - event_id % 60 AS rssi
            FROM {t('v_points')}"""),
        "v_log": (("v_packets",), f"""
            SELECT {idiv('event_id', 40)} AS file, event_id % 40 + 2 AS line_no,
                   concat(CASE WHEN event_id % 40 = 0 THEN '' ELSE concat(CAST(-60 - (event_id - 1) % 60 AS STRING), ',') END,
                          '09:00:01,', CAST(631724152 + beacon AS STRING), ',Beacon ',
                          CASE WHEN event_id % 13 = 0 THEN 'A, hilltop' ELSE 'A' END,
                          ',47.1,9.5,47.101,9.501,', CASE WHEN event_id % 29 = 0 THEN 'high' ELSE '812' END,
                          ',11.25,812.0,', CAST(hop_limit AS STRING), ',',
                          CASE WHEN event_id % 31 = 0 THEN 'unquoted'
                               WHEN junk THEN '"hello"' ELSE concat('"seq ', CAST(seq AS STRING), '"') END) AS raw
            FROM {t('v_packets')}
            UNION ALL
            SELECT {idiv('event_id', 40)}, CAST(42 AS BIGINT), concat(CAST(-60 - event_id % 60 AS STRING), ',')
            FROM {t('v_packets')} WHERE event_id % 40 = 39
            UNION ALL
            SELECT {idiv('event_id', 40)}, CAST(1 AS BIGINT),
                   'time,from,sender name,sender lat,sender long,rx lat,rx long,rx elevation,rx snr,distance,hop limit,payload,rx rssi'
            FROM {t('v_packets')} WHERE event_id % 40 = 0"""),
        "v_ways": ((), f"""
            SELECT p_partkey AS way_id, p_type, p_brand, CAST(p_size AS BIGINT) AS p_size,
                   CASE p_partkey % 5 WHEN 0 THEN CAST(p_size AS STRING) WHEN 1 THEN concat(CAST(p_size AS STRING), 'm')
                        WHEN 2 THEN 'x' WHEN 3 THEN '' END AS height,
                   CASE WHEN p_partkey % 4 = 0 THEN CAST(p_size % 12 AS STRING) END AS levels,
                   CASE WHEN p_partkey % 3 = 0 THEN 'yes' END AS building,
                   CASE p_size % 9 WHEN 0 THEN 'motorway_link' WHEN 1 THEN 'footway' WHEN 2 THEN 'primary'
                        WHEN 3 THEN 'unclassified' WHEN 4 THEN 'raceway' WHEN 5 THEN 'service' END AS highway,
                   CASE p_size % 6 WHEN 0 THEN 'river' WHEN 1 THEN 'dam' WHEN 2 THEN 'ditch' END AS waterway,
                   CASE p_size % 7 WHEN 0 THEN 'wood' WHEN 1 THEN 'retail' WHEN 2 THEN 'nothing' WHEN 3 THEN 'meadow' END AS landuse,
                   CASE p_partkey % 6 WHEN 0 THEN 'scree' WHEN 1 THEN 'water' WHEN 2 THEN 'peak' END AS natural_tag,
                   CASE p_partkey % 8 WHEN 0 THEN 'grass' END AS leisure,
                   16.2e0 + (p_partkey % 200) / 1e3 AS lon, 48.1e0 + (p_partkey % 170) / 1e3 AS lat
            FROM {t('part')}"""),
        "v_requests": ((), f"""
            SELECT o_orderkey AS request_id, -25e0 + ((o_orderkey * 7919) % 56000) / 1e3 AS west,
                   34e0 + ((o_orderkey * 104729) % 36500) / 1e3 AS south,
                   -25e0 + ((o_orderkey * 7919) % 56000) / 1e3 + (1 + o_orderkey % 29) / 1e2 AS east,
                   34e0 + ((o_orderkey * 104729) % 36500) / 1e3 + (1 + o_orderkey % 23) / 1e2 AS north,
                   CASE o_orderpriority WHEN '1-URGENT' THEN 'detail' WHEN '2-HIGH' THEN 'standard'
                        WHEN '3-MEDIUM' THEN 'overview' WHEN '4-NOT SPECIFIED' THEN 'standard' ELSE 'extreme' END AS lod,
                   o_orderstatus <> 'P' AS texture,
                   CASE o_orderkey % 4 WHEN 0 THEN 0.1e0 WHEN 1 THEN 0.5e0 WHEN 2 THEN 2e0 ELSE 20e0 END AS target
            FROM {t('orders')}"""),
        "v_lens": ((), f"""
            SELECT c_custkey, c_mktsegment, c_name, c_acctbal,
                   CASE c_custkey % 4 WHEN 0 THEN lower(c_mktsegment) WHEN 1 THEN c_mktsegment
                        WHEN 2 THEN concat(lower(c_mktsegment), '-', CAST(c_custkey AS STRING)) ELSE '-dem.' END AS dataset,
                   CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN concat(' ', c_name) ELSE '' END AS title,
                   CASE c_custkey % 3 WHEN 0 THEN {d.sha('c_name')} WHEN 1 THEN upper({d.sha('c_name')}) ELSE c_name END AS hash,
                   CASE c_custkey % 4 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/png; q=1' WHEN 2 THEN 'Image/png'
                        ELSE 'application/vnd.x+json' END AS mime,
                   CASE c_custkey % 5 WHEN 0 THEN concat('https://h/', c_name) WHEN 1 THEN 'ftp://h/x' WHEN 2 THEN 'http://'
                        WHEN 3 THEN 'https://h/a b' ELSE 'http://h' END AS url,
                   CASE c_custkey % 6 WHEN 0 THEN '2024-02-29T10:00:00Z' WHEN 1 THEN '2025-02-29T10:00:00Z'
                        WHEN 2 THEN '2024-01-01T23:59:60Z' WHEN 3 THEN '2024-1-1T00:00:00Z'
                        WHEN 4 THEN '2024-12-31T23:59:59.123456789Z' END AS datetime
            FROM {t('customer')}"""),
    }


_SPARK, _DUCK = build(Spark()), build(Duck())

#: Views that group a table by these keys and more, and the rows of such a table that one task takes, about.
DEALT = {"v_items": ("lineitem", ("l_orderkey", "l_partkey")), "v_vertices": ("lineitem", ("l_orderkey",))}
ROWS_PER_TASK = 500_000


class Inputs:
    """Lazy DataFrames of the given tables and of the derived views."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")
        self._cache: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or (name not in TABLES and name not in _SPARK):
            raise AttributeError(name)
        if name not in self._cache:
            self._cache[name] = (
                self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
                if name in TABLES
                else self._derive(name)
            )
        return self._cache[name]

    def spread(self, table: str, parts: int) -> Inputs:
        """The same inputs with ``table`` dealt to ``parts`` tasks: a compact file is one task, whatever its rows cost."""
        dealt = Inputs(self.spark, self.sf_dir)
        dealt._cache[table] = getattr(self, table).repartition(parts)
        return dealt

    def parts(self, table: str) -> int:
        """Tasks that ``table`` is dealt to: they grow in number with its rows, and not in size."""
        return max(self.spark.sparkContext.defaultParallelism, -(-getattr(self, table).count() // ROWS_PER_TASK))

    def _derive(self, name: str) -> DataFrame:
        reads, text = _SPARK[name]
        used = {t: getattr(self, t) for t in (*TABLES, *reads) if "{" + t + "}" in text}
        if name in DEALT:
            # Groups of nearly one row each: dealt by these keys, they are sorted once and need no shuffle of their own.
            table, keys = DEALT[name]
            used[table] = used[table].repartition(self.parts(table), *keys)
        return self.spark.sql(text, **used)


def with_views(*names: str) -> str:
    """``WITH`` clause defining the named views and what they read, for the check engine."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for read in _DUCK[name][0]:
            visit(read)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    return "WITH " + ",\n".join(f"{n} AS ({_DUCK[n][1]})" for n in ordered) + "\n"
