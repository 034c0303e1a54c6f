"""Radio logs, observation windows and field sheets."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartolith.functions import gates
from cartolith.operators import fieldlog
from cartolith.sources import radio_logs
from cartolith.workloads.registry import query


def _kept(v):
    return radio_logs.split_files(v.v_log)[0]


_PARSED = """lines AS (SELECT * FROM v_log WHERE line_no > 1), lastl AS (SELECT file, max(line_no) AS last_line FROM v_log GROUP BY file),
led AS (SELECT l.*, last_line, regexp_extract(raw, '^(-?[0-9]+),', 1) AS lead_txt, regexp_full_match(raw, '-?[0-9]+,?') AND l.line_no = last_line AS dangling FROM lines l JOIN lastl ON lastl.file = l.file),
sh AS (SELECT *, lead(TRY_CAST(nullif(lead_txt, '') AS BIGINT)) OVER (PARTITION BY file ORDER BY line_no) AS rssi FROM led),
body AS (SELECT *, CASE WHEN lead_txt <> '' THEN substr(raw, length(lead_txt) + 2) ELSE raw END AS b FROM sh WHERE NOT dangling),
cells AS (SELECT *, regexp_full_match(b, '.*,".*"') AS quoted, string_split(regexp_extract(b, '^(.*),"(.*)"$', 1), ',') AS c, regexp_extract(b, '^(.*),"(.*)"$', 2) AS payload FROM body),
rec AS (SELECT *, CASE WHEN NOT quoted THEN 'row does not end in a quoted payload' WHEN len(c) < 11 THEN 'row has fewer fields than the rangetest layout'
 WHEN TRY_CAST(c[len(c) - 3] AS DOUBLE) IS NULL THEN 'row has a non-numeric value in a numeric field' END AS reason FROM cells)"""


@query("a07_log_records", f"""
WITH {_PARSED} SELECT file, line_no AS line, c[2] AS sender, array_to_string(c[3:len(c) - 8], ',') AS sender_name, TRY_CAST(c[len(c) - 3] AS DOUBLE) AS rx_elevation_m, TRY_CAST(c[len(c)] AS BIGINT) AS hop_limit,
 TRY_CAST(nullif(regexp_extract(payload, '^seq ([0-9]+)$', 1), '') AS BIGINT) AS seq, rssi AS rx_rssi_dbm FROM rec WHERE reason IS NULL""", "v_log")
def _(v):
    rec, _rej = fieldlog.repair(_kept(v))
    return rec.select("file", "line", "sender", "sender_name", "rx_elevation_m", F.col("hop_limit").cast("bigint").alias("hop_limit"), "seq", "rx_rssi_dbm")


@query("b64_log_rejections", f"WITH {_PARSED} SELECT file, line_no AS line, reason FROM rec WHERE reason IS NOT NULL", "v_log")
def _(v):
    return fieldlog.repair(_kept(v))[1].select("file", "line", "reason")


@query("f01_shifted_rssi", f"WITH {_PARSED} SELECT file, count(rssi) AS n, CAST(sum(rssi) AS BIGINT) AS total FROM rec WHERE reason IS NULL GROUP BY file", "v_log")
def _(v):
    rec, _rej = fieldlog.repair(_kept(v))
    return rec.groupBy("file").agg(F.count("rx_rssi_dbm").alias("n"), F.sum("rx_rssi_dbm").alias("total"))


def _packets(v):
    return v.v_packets.select(
        "event_id", "window_id", (F.lit(631724152) + F.col("beacon")).cast("string").alias("sender"),
        F.when(~F.col("junk"), F.col("seq")).alias("seq"), "hop_limit", "rssi",
    )


@query("c09_link_gate", """
SELECT event_id, CASE WHEN hop_limit <> 0 THEN concat('hop limit ', CAST(hop_limit AS VARCHAR), ' — relayed packet, RSSI describes the last hop only') WHEN junk THEN 'payload is not a range-test sequence packet' END AS reason FROM v_packets""", "v_packets")
def _(v):
    return _packets(v).select("event_id", fieldlog.link_reason("hop_limit", "seq").alias("reason"))


_WIN = """win AS (SELECT CAST(n AS BIGINT) AS window_id, CAST(1 AS BIGINT) AS lo_a, CAST(CASE WHEN n % 10 = 7 THEN 0 ELSE 20 END AS BIGINT) AS hi_a, CAST(21 + n % 30 AS BIGINT) AS lo_b, CAST(39 + n % 30 AS BIGINT) AS hi_b,
 n % 10 = 8 AS same, n % 6 > 0 AS lopen, n % 11 > 0 AS lclose FROM (SELECT DISTINCT c_custkey AS n FROM customer) c)"""
_HEARD = f"""{_WIN}, seen AS (SELECT DISTINCT window_id, beacon, seq FROM v_packets WHERE hop_limit = 0 AND NOT junk),
h AS (SELECT s.window_id, CASE WHEN s.beacon = 0 THEN 'a' ELSE 'b' END AS beacon, s.seq, CASE WHEN s.beacon = 0 THEN s.seq BETWEEN lo_a AND hi_a ELSE s.seq BETWEEN lo_b AND hi_b END AS in_range
 FROM seen s JOIN win w ON w.window_id = s.window_id WHERE s.beacon = 0 OR NOT same)"""


def _windows(v):
    n = F.col("c_custkey")
    return v.customer.select(
        n.alias("window_id"), F.lit("631724152").alias("beacon_a"), F.when(n % 10 == 8, "631724152").otherwise("631724153").alias("beacon_b"),
        F.lit(1).cast("bigint").alias("lo_a"), F.when(n % 10 == 7, 0).otherwise(20).cast("bigint").alias("hi_a"), (21 + n % 30).alias("lo_b"),
        (39 + n % 30).alias("hi_b"), (n % 6 > 0).alias("loopback_open"), (n % 11 > 0).alias("loopback_close"),
    )


@query("e07_beacon_sequences", f"WITH {_HEARD} SELECT window_id, beacon, seq, in_range FROM h", "v_packets")
def _(v):
    return fieldlog.heard(_packets(v), _windows(v))


@query("g07_sorted_sequences", f"WITH {_HEARD} SELECT window_id, beacon, string_agg(CAST(seq AS VARCHAR), ' ' ORDER BY seq) AS received FROM h WHERE in_range GROUP BY window_id, beacon", "v_packets")
def _(v):
    """Received numbers in order; in-range numbers are bounded by the expected range."""
    inside = fieldlog.heard(_packets(v), _windows(v)).where("in_range")
    listed = inside.groupBy("window_id", "beacon").agg(F.array_sort(F.collect_set("seq")).alias("s"))
    return listed.select("window_id", "beacon", F.array_join(F.col("s").cast("array<string>"), " ").alias("received"))


@query("e08_window_outcomes", f"""
WITH {_HEARD}, n AS (SELECT window_id, count(*) FILTER (beacon = 'a' AND in_range) AS ra, count(*) FILTER (beacon = 'b' AND in_range) AS rb, count(*) FILTER (beacon = 'a' AND NOT in_range) AS oa FROM h GROUP BY window_id),
j AS (SELECT w.*, coalesce(ra, 0) AS ra, coalesce(rb, 0) AS rb, coalesce(oa, 0) AS oa FROM win w LEFT JOIN n ON n.window_id = w.window_id),
o AS (SELECT *, CASE WHEN hi_a < lo_a THEN 'EMPTY_RANGE' WHEN same THEN 'SAME_BEACON' END AS code FROM j),
r AS (SELECT *, CASE WHEN code IS NOT NULL THEN NULL WHEN NOT (lopen AND lclose) THEN 'void' WHEN rb > 0 AND ra = 0 THEN 'integrity-fault' WHEN ra > 0 AND rb > 0 THEN 'continuous' WHEN ra > 0 THEN 'interval-censored' ELSE 'left-censored' END AS outcome FROM o)
SELECT window_id, code, outcome, ra AS received_a, oa AS out_a, rb AS received_b, round(CASE WHEN hi_a - lo_a + 1 <> 0 THEN ra / (hi_a - lo_a + 1) END, 6) AS prr_a, round(rb / (hi_b - lo_b + 1), 6) AS prr_b,
 CASE outcome WHEN 'interval-censored' THEN -118 WHEN 'left-censored' THEN -131 END AS bracket_hi_dbm FROM r""", "v_packets")
def _(v):
    out = fieldlog.window_reports(_packets(v), _windows(v))
    return out.select(
        "window_id", "code", "outcome", "received_a", "out_a", "received_b", F.round("prr_a", 6).alias("prr_a"),
        F.round("prr_b", 6).alias("prr_b"), "bracket_hi_dbm",
    )


@query("c20_site_visits", """
SELECT c_custkey, array_to_string(list_filter([CASE WHEN c_custkey % 3 = 0 THEN 'site_id is required' END, CASE WHEN c_custkey % 5 = 0 THEN 'window_start_utc is not a valid ISO-8601 time' END,
 CASE WHEN c_custkey % 5 > 0 AND c_custkey % 4 = 1 THEN 'window_end_utc must be after window_start_utc' END, CASE WHEN c_nationkey < 1 THEN 'station_marks must be a positive integer' END,
 CASE WHEN c_acctbal / 50 < 0 OR c_acctbal / 50 > 90 THEN 'antenna_tilt must be between 0 and 90 degrees' END, CASE WHEN c_mktsegment IN ('MACHINERY', 'BUILDING') THEN 'wind is not a known value' END], lambda x: x IS NOT NULL), '|') AS problems FROM customer""")
def _(v):
    k = F.col("c_custkey")
    ok = lambda x: F.lit(x)
    sheet = {
        "site_id": F.when(k % 3 == 0, " ").otherwise("s"), "operator_id": ok("o"), "date": ok("2026-01-01"), "node_serial": ok("n"),
        "antenna_serial": ok("a"), "config_hash": ok("c"), "window_start_utc": F.when(k % 5 == 0, "soon").otherwise("2026-01-01T10:00:00Z"),
        "window_end_utc": F.when(k % 4 == 1, "2026-01-01T09:00:00Z").otherwise("2026-01-01T11:00:00Z"), "station_marks": F.col("c_nationkey"),
        "pole_mark_m": ok(2.0), "antenna_tilt_deg": F.col("c_acctbal") / 50, "gnss_lat": ok(47.0), "gnss_lon": ok(9.0), "gnss_acc_m": ok(1.0),
        "gnss_scatter_m": ok(0.5), "leaf_state": ok("bare"), "precip": ok("dry"),
        "wind": F.when(F.col("c_mktsegment").isin("MACHINERY", "BUILDING"), "gale").otherwise("calm"), "pole_foot": ok("soil"), "photo_count": ok(6),
    }
    return v.customer.select("c_custkey", F.array_join(gates.site_visit_problems(sheet), "|").alias("problems"))
