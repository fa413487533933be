"""Checked queries: sinks, stored tables, maintenance and live pipelines
(A3-A12, G1-G5, S1-S5). Each writes to a fresh folder and reads it back."""

from __future__ import annotations

import dataclasses as dc

from pyspark.sql import functions as F

from netloom.catalog.detect import TUNING, _KNOWN, _UNUSUAL, _beacon_sql, _partly_known
from netloom.catalog.flows import FLOW_COLUMNS, FLOWS_SQL
from netloom.catalog.packets import _MARKED, ids_lines, packet_lines, parsed
from netloom.catalog.registry import query
from netloom.catalog.views import (
    LOCAL_IPS, NETWORKS, PRIVATE_SQL, SEMI_SQL, TRUSTED_SQL, with_views,
)
from netloom.config import AnomalyConfig, BeaconConfig, ExfilConfig
from netloom.functions.predicates import ConnectionFilter
from netloom.operators import maintenance as M
from netloom.operators.baseline import observations
from netloom.operators.detectors import Context
from netloom.operators.trust import after, matching_networks
from netloom.plans.connections import connection_text_key, texts_cached
from netloom.schemas import CONNECTIONS, evolve_schema
from netloom.session import fresh_path
from netloom.sinks import exports as X, tables as T
from netloom.sources.captures import capture_inventory, list_captures
from netloom.sources.ids import stream_ids_lines
from netloom.sources.networks import parse_networks
from netloom.streaming import live


def _read_csv(s, path: str):
    return s.spark.read.option("header", True).csv(path)


@query("a03_packets_csv", with_views("packets", _MARKED + """
    SELECT CAST(frame_number AS VARCHAR) AS packet_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS absolute_timestamp, src_ip, dst_ip, CAST(src_port AS VARCHAR) AS src_port, CAST(dst_port AS VARCHAR) AS dst_port,
      transport AS transport_protocol, protocol AS application_protocol, nullif(tcp_flags, '') AS tcp_flags, direction, CAST(packet_length AS VARCHAR) AS packet_length, info FROM parsed"""))
def a03(s):
    path = fresh_path(s.spark, "packets")
    X.write_packets_csv(parsed(s), path)
    return _read_csv(s, path).drop("relative_time")


@query("a04_connections_csv", with_views("connections", """
    SELECT CAST(id AS VARCHAR) AS "Connection_ID", src_ip AS "Source_IP", dst_ip AS "Destination_IP", CAST(dst_port AS VARCHAR) AS "Destination_Port", CAST(total_packets AS VARCHAR) AS "Total_Packets",
      CAST(total_bytes AS VARCHAR) AS "Total_Bytes", strftime(start_time, '%Y-%m-%d %H:%M:%S.%g') AS "Start_Time", nullif(tag_text, '') AS "Tags", nullif(severity, '') AS "Severity"
    FROM (SELECT * FROM connections WHERE session_id = 2 ORDER BY total_bytes DESC, id LIMIT 500) c"""))
def a04(s):
    path = fresh_path(s.spark, "connections")
    X.export_connections_csv(s.connections, path, session_id=2, limit=500)
    return _read_csv(s, path).select(
        "Connection_ID", "Source_IP", "Destination_IP", "Destination_Port", "Total_Packets", "Total_Bytes",
        "Start_Time", "Tags", "Severity",
    )


@query("a05_filtered_csv", with_views("connections", """
    SELECT CAST(id AS VARCHAR) AS "ID", src_ip AS "Source IP", dst_ip AS "Destination IP", CAST(dst_port AS VARCHAR) AS "Destination Port", protocol AS "Protocol", CAST(total_bytes AS VARCHAR) AS "Bytes", nullif(tag_text, '') AS "Tags"
    FROM (SELECT * FROM connections WHERE dst_ip LIKE '%2606%' OR protocol ILIKE '%2606%' ORDER BY id DESC LIMIT 10000) c"""))
def a05(s):
    path = fresh_path(s.spark, "filtered")
    X.export_filtered_csv(s.connections, path, ConnectionFilter(search="2606"))
    return _read_csv(s, path).select("ID", "Source IP", "Destination IP", "Destination Port", "Protocol", "Bytes", "Tags")


def _stored(s):
    """A folder with flows, alerts, sessions and protocol statistics."""
    root = fresh_path(s.spark, "tables")
    T.write_connections(s.connections, root)
    T.append_alerts(s.alerts, root)
    T.replace_table(s.sessions, root, "sessions")
    T.refresh_protocol_stats(s.spark, root)
    return root


def _flows_by_session(df):
    return df.groupBy("session_id").agg(
        F.count("*").alias("flows"), F.sum("total_packets").alias("packets"), F.sum("total_bytes").alias("bytes")
    )


_BY_SESSION = "SELECT session_id, count(*) AS flows, CAST(sum(total_packets) AS BIGINT) AS packets, CAST(sum(total_bytes) AS BIGINT) AS bytes FROM {0} GROUP BY session_id"


@query("a06_write_connections", with_views("connections", "WITH x AS (SELECT * FROM connections WHERE session_id <> 2 OR protocol = 'DNS') " + _BY_SESSION.format("x")))
def a06(s):
    """Session 2 is written again with a smaller snapshot, which replaces it."""
    root = fresh_path(s.spark, "tables")
    T.write_connections(s.connections, root)
    T.write_connections(s.connections.filter("session_id = 2 AND protocol = 'DNS'"), root)
    return _flows_by_session(T.read_table(s.spark, root, "connections"))


@query("a06_empty_snapshot", with_views("connections", "WITH x AS (SELECT * FROM connections WHERE session_id <> 2) " + _BY_SESSION.format("x")))
def a06_empty(s):
    """Session 2 is written again without a flow."""
    root = fresh_path(s.spark, "tables")
    T.write_connections(s.connections, root)
    T.write_connections(s.connections.filter("session_id = 2 AND protocol = 'none'"), root, session_id=2)
    return _flows_by_session(T.read_table(s.spark, root, "connections"))


@query("a07_append_alerts", with_views("alerts", """
    SELECT severity, severity_num, action, session_id, count(*) AS n FROM (SELECT CASE WHEN b = 1 THEN 'LOW' ELSE severity END AS severity, CASE WHEN b = 1 THEN 3 ELSE severity_num END AS severity_num, action, session_id
      FROM alerts, (VALUES (0), (1)) t(b)) x GROUP BY ALL"""))
def a07(s):
    """Appended twice, the second time without level and action."""
    root = fresh_path(s.spark, "tables")
    T.append_alerts(s.alerts, root)
    T.append_alerts(s.alerts.drop("severity", "severity_num", "action"), root)
    stored = T.read_table(s.spark, root, "alerts")
    return stored.groupBy("severity", "severity_num", "action", "session_id").agg(F.count("*").alias("n"))


@query("a08_sessions", with_views("packets", """
    SELECT session_id AS id, count(*) AS total_packets, CAST(sum(packet_length) AS BIGINT) AS total_bytes, TIMESTAMP '2024-02-01 00:00:00' AS end_time, 'completed' AS status FROM packets GROUP BY 1
    UNION ALL SELECT max(session_id) + 1, 0, 0, NULL, 'active' FROM packets"""))
def a08(s):
    """Every session is closed with its packet totals; a new one is started."""
    opened = s.sessions.select(
        F.col("id"), F.col("start_time"), F.lit(None).cast("timestamp_ntz").alias("end_time"),
        F.lit(0).cast("bigint").alias("total_packets"), F.lit(0).cast("bigint").alias("total_bytes"),
        "interface", "pcap_file", F.lit("active").alias("status"),
    )
    done = s.packets.groupBy(F.col("session_id").alias("id")).agg(
        F.count("*").alias("packets"), F.sum("packet_length").alias("bytes")
    )
    closed = M.end_session(opened, done, "2024-02-01 00:00:00")
    table = M.start_session(closed, "2024-02-02 00:00:00", "eth0")
    return table.select("id", "total_packets", "total_bytes", "end_time", "status")


@query("a09_protocol_stats_upsert", with_views("connections packets", """
    WITH o AS (SELECT protocol, sum(total_packets) AS n, sum(total_bytes) AS b FROM connections WHERE protocol <> 'SSH' GROUP BY 1), c AS (SELECT protocol, count(*) AS n FROM packets GROUP BY 1)
    SELECT coalesce(o.protocol, c.protocol) AS protocol, CAST(coalesce(c.n, o.n) AS BIGINT) AS packet_count, CAST(coalesce(o.b, 0) AS BIGINT) AS total_bytes FROM o FULL JOIN c ON o.protocol = c.protocol"""))
def a09(s):
    old = M.protocol_stats_from(s.plain_connections.filter("protocol <> 'SSH'"))
    new = s.packets.groupBy("protocol").agg(F.count("*").alias("packet_count"))
    return M.upsert_protocol_stats(old, new, "2024-02-01 00:00:00").drop("last_seen")


# entries with inline comments, a host address, a malformed line and nested networks
_NETWORK_FILE = """
# [TRUSTED] first section
142.250.0.0/15    # inline comment
2404:6800::/32
not-a-network
142.250.1.2
# [SEMI-TRUSTED]
104.16.2.9/12
64:ff9b::/96
"""


@query("a10_load_networks", with_views("connections", """
    SELECT cidr, tier, count(*) AS flows FROM connections JOIN (VALUES ('142.250.0.0/15', 'trusted', '142.250.%'), ('2404:6800::/32', 'trusted', '2404:6800:%'), ('142.250.1.2/32', 'trusted', '142.250.1.2'),
      ('104.16.0.0/12', 'semi_trusted', '104.16.%'), ('64:ff9b::/96', 'semi_trusted', '64:ff9b::%')) n(cidr, tier, pattern) ON dst_ip LIKE pattern GROUP BY cidr, tier"""))
def a10(s):
    """Flows per network of a parsed network file."""
    networks = parse_networks(_NETWORK_FILE)
    per_ip = s.plain_connections.groupBy("dst_ip").agg(F.count("*").alias("n"))
    held = per_ip.select(F.explode(matching_networks(after("dst_ip", "n"), networks)).alias("net"), "n")
    return held.groupBy("net.cidr", "net.tier").agg(F.sum("n").alias("flows"))


@query("a11_capture_inventory", with_views("sessions packets", """
    SELECT split_part(pcap_file, '/', 2) AS name, id AS session_id, CASE WHEN b >= 1000000 THEN printf('%.1f MB', b / 1e6) WHEN b >= 1000 THEN printf('%.1f KB', b / 1e3) ELSE b || ' B' END AS size_display, b AS size
    FROM (SELECT s.*, (SELECT CAST(sum(length(CAST(frame_number AS VARCHAR)) + 1) AS BIGINT) FROM packets p WHERE p.session_id = s.id) AS b FROM sessions s) x"""))
def a11(s):
    """One capture file per session, holding its frame numbers."""
    folder = fresh_path(s.spark, "captures")
    frames = s.packets.select("session_id", F.col("frame_number").cast("string").alias("value"))
    frames.repartition("session_id").write.partitionBy("session_id").text(folder)
    files = list_captures(s.spark, folder, "*.txt")
    # part files are named by Spark; the folder tells the session
    listed = s.spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder)
    named = listed.groupBy("session_id").agg(F.sum("length").alias("size")).select(
        F.concat(F.lit("capture_"), F.col("session_id").cast("string"), F.lit(".pcapng")).alias("name"), "size"
    )
    assert files.columns == named.columns
    return capture_inventory(named, s.sessions)


@query("a12_schema_evolution", with_views("connections", "SELECT id, dst_ip, '' AS tags, '' AS severity, session_id FROM connections"))
def a12(s):
    old = s.plain_connections.drop("end_time")
    new = evolve_schema(old)
    assert new.columns == CONNECTIONS.fieldNames()
    return new.select("id", "dst_ip", F.array_join("tags", ",").alias("tags"), "severity", "session_id")


def _counts(s, root):
    """Rows per table and session, whatever is left."""
    read = lambda name: T.read_table(s.spark, root, name)
    rows = read("sessions").select(F.lit("sessions").alias("name"), F.col("id").alias("session_id"))
    for name in ("connections", "alerts"):
        rows = rows.unionByName(read(name).select(F.lit(name).alias("name"), "session_id"))
    rows = rows.groupBy("name", "session_id").agg(F.count("*").alias("n"))
    stats = read("protocol_stats").agg(F.count("*").alias("n"), F.coalesce(F.sum("total_bytes"), F.lit(0)).alias("b"))
    return rows.unionByName(stats.select(F.lit("stats").alias("name"), F.col("n").cast("int").alias("session_id"), F.col("b").alias("n")))


def _counts_sql(flows: str, other: str = "true", stats: str | None = None) -> str:
    return with_views("connections alerts sessions", f"""
    SELECT 'connections' AS name, session_id, count(*) AS n FROM connections WHERE {flows} GROUP BY 2 UNION ALL SELECT 'alerts', session_id, count(*) FROM alerts WHERE {other} GROUP BY 2
    UNION ALL SELECT 'sessions', id, 1 FROM sessions WHERE {other.replace('session_id', 'id')}
    UNION ALL SELECT 'stats', CAST(count(DISTINCT protocol) AS INT), CAST(coalesce(sum(total_bytes), 0) AS BIGINT) FROM connections WHERE {stats or flows}""")


@query("g01_delete_session", _counts_sql("session_id <> 3", "session_id <> 3", "true"))
def g01(s):
    root = _stored(s)
    assert T.delete_session(s.spark, root, 3) and not T.delete_session(s.spark, root, 99)
    return _counts(s, root)


@query("g02_clear_all", with_views("sessions", "SELECT count(*) AS deleted, 0 AS remaining FROM sessions"))
def g02(s):
    root = _stored(s)
    deleted = T.clear_all(s.spark, root)
    left = T.read_table(s.spark, root, "connections").select("session_id")
    left = left.unionByName(T.read_table(s.spark, root, "alerts").select("session_id"))
    return left.agg(F.lit(deleted).cast("bigint").alias("deleted"), F.count("*").cast("int").alias("remaining"))


@query("g03_clear_session_flows", _counts_sql("session_id <> 2"))
def g03(s):
    root = _stored(s)
    T.clear_session_flows(s.spark, root, 2)
    return _counts(s, root)


@query("g04_age_out", _counts_sql("start_time >= TIMESTAMP '1996-06-15 12:00:00' - INTERVAL 30 DAY", "true", "true"))
def g04(s):
    root = _stored(s)
    T.delete_older(s.spark, root, "1996-06-15 12:00:00", 30)
    return _counts(s, root)


@query("g05_delete_by_date", _counts_sql("CAST(start_time AS DATE) <> DATE '1996-03-12'"))
def g05(s):
    root = _stored(s)
    T.delete_date(s.spark, root, "1996-03-12")
    return _counts(s, root)


@query("d09_stored_baseline", with_views("connections", """
    WITH obs AS (SELECT session_id, dst_ip, CAST(sum(total_bytes) AS DOUBLE) AS b, min(start_time) AS seen FROM connections GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY dst_ip ORDER BY session_id) AS n FROM obs)
    SELECT dst_ip AS ip, min(seen) AS first_seen, CAST(count(*) AS INT) AS session_count, round(CASE WHEN count(*) = 1 THEN max(b) ELSE avg(b) FILTER (n > 1) END, 2) AS total_bytes_avg FROM r GROUP BY dst_ip"""))
def d09_stored(s):
    """A baseline table that takes all sessions but the last two at once, and those one by one."""
    root, flows = fresh_path(s.spark, "tables"), s.plain_connections
    last = flows.agg(F.max("session_id")).first()[0]
    T.extend_known_destinations(observations(flows.filter(F.col("session_id") <= last - 2)), root)
    for session in (last - 1, last):
        T.update_known_destinations(flows.filter(F.col("session_id") == session), root)
    known = T.read_table(s.spark, root, "known_destinations")
    return known.withColumn("total_bytes_avg", F.round("total_bytes_avg", 2))


@query("h01_stored_reputation", with_views("reputation connections", """
    WITH c AS (SELECT dst_ip AS ip, CAST(count(*) % 101 AS INT) AS score FROM connections WHERE dst_ip LIKE '2%' GROUP BY dst_ip)
    SELECT coalesce(c.ip, r.ip) AS ip, coalesce(c.score, r.abuse_score) AS abuse_score, CASE WHEN c.ip IS NULL THEN r.country ELSE 'DE' END AS country, CASE WHEN c.ip IS NULL THEN r.isp ELSE 'x' END AS isp,
           coalesce(c.score, r.abuse_score) > 50 AS is_malicious, CASE WHEN c.ip IS NULL THEN r.last_checked ELSE TIMESTAMP '2024-02-01 00:00:00' END AS last_checked FROM reputation r FULL JOIN c ON c.ip = r.ip"""))
def h01_stored(s):
    """All columns of a reputation table after two rounds of checks."""
    root = fresh_path(s.spark, "tables")
    T.store_reputation(s.reputation.drop("is_malicious"), root)
    checked = s.plain_connections.filter(F.col("dst_ip").startswith("2")).groupBy(F.col("dst_ip").alias("ip")).agg(
        (F.count("*") % 101).cast("int").alias("abuse_score")
    )
    checked = checked.withColumns({"country": F.lit("DE"), "isp": F.lit("x"), "last_checked": F.lit("2024-02-01").cast("timestamp_ntz")})
    T.store_reputation(checked, root)
    return T.read_table(s.spark, root, "reputation")


@query("f28_stored_texts", with_views("connections", """
    WITH c AS (SELECT 'conn|' || src_ip || '|' || dst_ip || '|' || protocol || '|' || id AS cache_key, session_id FROM connections)
    SELECT cache_key, CASE WHEN session_id = 3 THEN 'new' WHEN session_id < 3 THEN 'old' END AS explanation FROM c"""))
def f28_stored(s):
    """Texts of sessions up to 3, those of session 3 replaced later."""
    root, key = fresh_path(s.spark, "tables"), connection_text_key()
    for text, day, sessions in (("old", "2024-01-01", "session_id <= 3"), ("new", "2024-01-02", "session_id = 3")):
        T.store_texts(s.plain_connections.filter(sessions).select(
            key.alias("cache_key"), F.lit(text).alias("explanation"), F.lit(day).cast("timestamp_ntz").alias("created_at")
        ), root)
    return texts_cached(s.plain_connections, T.read_table(s.spark, root, "texts"), key).select("cache_key", "explanation")


@query("s01_live_flows", with_views("packets", """
    SELECT session_id, count(*) AS packets, CAST(sum(packet_length) AS BIGINT) AS bytes FROM packets GROUP BY session_id"""))
def s01(s):
    """Flow sums of the stream equal the packet sums; repeated frames count once."""
    return _live_clean(s).groupBy("session_id").agg(
        F.sum("total_packets").alias("packets"), F.sum("total_bytes").alias("bytes")
    )


def _clean_lines(s):
    """Undamaged lines of the packet view, every fourth one twice."""
    lines = packet_lines(s, damaged=False)
    again = lines.filter(F.xxhash64("value") % 4 == 0)
    return lines.unionByName(again)


def _live_clean(s):
    root, source = fresh_path(s.spark, "live"), fresh_path(s.spark, "lines")
    _clean_lines(s).repartition("value").write.partitionBy("session_id").text(source)
    raw = s.spark.readStream.schema("value STRING, session_id INT").option("maxFilesPerTrigger", 8).text(source)
    batches = []
    packets = live.live_packets(raw, LOCAL_IPS, "60 days")
    live.start_flows(packets, root, lambda df, number: batches.append(number), once=True).awaitTermination()
    assert batches  # S5: the callback saw every batch
    return live.current_flows(s.spark, root)


@query("s02_live_snapshot", with_views("packets", FLOWS_SQL.replace("FROM packets)", "FROM (SELECT * EXCLUDE (ts), date_trunc('millisecond', ts) AS ts FROM packets) m)") + f"SELECT {', '.join(c for c in FLOW_COLUMNS)} FROM folded"))
def s02(s):
    """The snapshot of the stream equals the batch flows."""
    return _live_clean(s).select(*FLOW_COLUMNS)


_DOMAINS_SQL = """
    w AS (SELECT session_id, frame_number, string_split(info, ' ') AS w FROM packets WHERE protocol = 'DNS' AND info LIKE '%response%'),
    wa AS (SELECT w[8] AS ip, w[6] AS domain, session_id, frame_number FROM w UNION ALL SELECT w[10], w[6], session_id, frame_number FROM w),
    names AS (SELECT ip, domain FROM (SELECT ip, domain, row_number() OVER (PARTITION BY ip ORDER BY session_id DESC, frame_number DESC, domain DESC) AS n FROM wa) x WHERE n = 1)"""
# thresholds scaled to the packet view, so that each tag is raised
_LIVE_TUNING = dc.replace(
    TUNING, beaconing=BeaconConfig(min_connections=6, cv_threshold=1.2),
    data_exfil=ExfilConfig(threshold_medium_bytes=30_000, threshold_high_bytes=60_000),
    traffic_anomaly=AnomalyConfig(multiplier=1.2, min_absolute_bytes=20_000, min_average_bytes=10),
)


def _live_sql() -> str:
    source = """SELECT folded.* REPLACE (folded.session_id || '/' || src_ip AS src_ip), coalesce(domain, dst_ip) AS dst_key,
        CAST(folded.session_id AS BIGINT) * 1099511627776 + first_frame AS id
      FROM folded LEFT JOIN names ON names.session_id = folded.session_id AND ip = dst_ip"""
    beacon = _beacon_sql(source, "dst_key", 6, 1.2).removeprefix("RECURSIVE WITH ")
    head, _, _ = beacon.rpartition("SELECT DISTINCT f.src_ip")
    private, trusted, semi = (x.format("f.dst_ip") for x in (PRIVATE_SQL, TRUSTED_SQL, SEMI_SQL))
    names = _DOMAINS_SQL.replace("SELECT ip, domain FROM", "SELECT session_id, ip, domain FROM").replace(
        "PARTITION BY ip ORDER BY session_id DESC, ", "PARTITION BY session_id, ip ORDER BY ").replace("SELECT ip, domain, row", "SELECT session_id, ip, domain, row")
    return f"""RECURSIVE {FLOWS_SQL.strip()}, {names}, {head.rstrip()},
    bp AS (SELECT src_ip, dst_key FROM v WHERE v.cv < 1.2 AND v.mean >= 1),
    {_KNOWN.replace('r AS', 'ro AS').replace('FROM r ', 'FROM ro ')},
    pt AS (SELECT ip, session_count, mean / 100000 AS mean FROM known WHERE ip NOT LIKE '%1'),
    xt AS (SELECT session_id, dst_ip, sum(total_bytes) FILTER (direction = 'OUTGOING') AS ob, bool_or({_UNUSUAL}) FILTER (direction = 'OUTGOING') AS ou, sum(total_bytes) AS b, bool_or({_UNUSUAL}) AS u
           FROM f WHERE NOT {private} AND NOT {trusted} GROUP BY session_id, dst_ip),
    xv AS (SELECT f.session_id, f.dst_ip, CASE WHEN {semi} THEN CASE WHEN ob >= 4500000000 THEN CASE WHEN ou THEN 'HIGH' ELSE 'MEDIUM' END END WHEN ob >= 60000 THEN 'HIGH' WHEN ob >= 30000 THEN 'MEDIUM' END AS sev FROM xt f),
    ov AS (SELECT f.session_id, f.dst_ip FROM xt f JOIN pt ON ip = f.dst_ip WHERE b >= 20000 AND NOT ({semi} AND b < 60000000 AND NOT u) AND session_count >= 2 AND mean >= 10 AND b / mean >= 1.2),
    hits AS (
      SELECT f.*, 'beaconing' AS tag, 'HIGH' AS severity FROM f JOIN bp USING (src_ip, dst_key)
      UNION ALL SELECT f.*, 'data_exfil', sev FROM f JOIN xv USING (session_id, dst_ip) WHERE sev IS NOT NULL AND direction = 'OUTGOING'
      UNION ALL SELECT f.*, 'new_dest', 'LOW' FROM f WHERE NOT {private} AND NOT {trusted} AND dst_ip NOT IN (SELECT ip FROM pt) AND dst_port NOT IN (443, 80) AND NOT ({semi} AND total_bytes < 60000000 AND NOT {_UNUSUAL})
      UNION ALL SELECT f.*, 'traffic_anomaly', 'MEDIUM' FROM f JOIN ov USING (session_id, dst_ip))
    SELECT session_id, tag, dst_key AS dst_display, arg_min(dst_ip, id) AS dst_ip, 
      CASE tag WHEN 'data_exfil' THEN 'HIGH' WHEN 'new_dest' THEN 'LOW' ELSE 'MEDIUM' END AS severity,
      CASE tag WHEN 'data_exfil' THEN 1 WHEN 'new_dest' THEN 3 ELSE 2 END AS severity_num, 0 AS batch_id FROM hits GROUP BY session_id, tag, dst_key"""


@query("s03_live_detection", with_views("packets connections", _live_sql()))
def s03(s):
    """The stream stores, detects and observes; a batch that is run again raises and adds nothing."""
    root, source = fresh_path(s.spark, "live"), fresh_path(s.spark, "lines")
    _clean_lines(s).repartition("value").write.partitionBy("session_id").text(source)
    raw = s.spark.readStream.schema("value STRING, session_id INT").text(source)
    known = _partly_known(s).withColumn("total_bytes_avg", F.col("total_bytes_avg") / 100000)
    ctx = Context(known, NETWORKS, "2026-06-01", _LIVE_TUNING)
    live.start_flows(live.live_packets(raw, LOCAL_IPS, "60 days"), root, once=True, ctx=ctx, as_of="2024-02-01 00:00:00").awaitTermination()
    live.detect_now(s.spark, root, ctx, 0, as_of="2024-02-01 00:00:00")
    logged = s.spark.read.parquet(f"{root}/behaviour_alerts")
    return logged.select("session_id", "tag", "dst_display", "dst_ip", "severity", "severity_num", "batch_id")


@query("s03_live_baseline", with_views("packets", FLOWS_SQL.strip() + """
    , obs AS (SELECT session_id, dst_ip, CAST(sum(total_bytes) AS DOUBLE) AS b, min(start_time) AS seen FROM folded WHERE dst_ip <> '' GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY dst_ip ORDER BY session_id) AS n FROM obs)
    SELECT dst_ip AS ip, CAST(count(*) AS INT) AS session_count, round(CASE WHEN count(*) = 1 THEN max(b) ELSE avg(b) FILTER (n > 1) END, 2) AS total_bytes_avg FROM r GROUP BY dst_ip"""))
def s03_baseline(s):
    """The baseline that the stream leaves equals that of its sessions, however they were cut into batches."""
    root, source = fresh_path(s.spark, "live"), fresh_path(s.spark, "lines")
    _clean_lines(s).repartition(12, "value").write.partitionBy("session_id").text(source)
    raw = s.spark.readStream.schema("value STRING, session_id INT").option("maxFilesPerTrigger", 24).text(source)
    known = s.spark.createDataFrame([], T.LASTING["known_destinations"])
    ctx = Context(known, NETWORKS, "2026-06-01", _LIVE_TUNING)
    live.start_flows(live.live_packets(raw, LOCAL_IPS, "60 days"), root, once=True, ctx=ctx).awaitTermination()
    found = live.current_baseline(s.spark, root, known)
    return found.select("ip", "session_count", F.round("total_bytes_avg", 2).alias("total_bytes_avg"))


@query("s04_live_ids_alerts", with_views("alerts", """
    WITH p AS (SELECT * REPLACE (CASE WHEN id % 11 = 0 THEN 3 ELSE severity_num END AS severity_num, CASE WHEN id % 13 = 0 THEN 'Unknown' ELSE signature END AS signature) FROM alerts WHERE id % 7 <> 0 AND id % 19 <> 0),
    l AS (SELECT *, CASE severity_num WHEN 1 THEN 'CRITICAL' WHEN 2 THEN 'HIGH' WHEN 3 THEN 'MEDIUM' ELSE 'LOW' END AS s, signature LIKE '%BRUTE-FORCE SSH%' OR signature LIKE '%MALWARE%' OR signature LIKE '%EXPLOIT%' AS safe FROM p),
    r AS (SELECT *, CASE WHEN safe THEN s WHEN signature LIKE '%ET SCAN%' THEN 'HIGH' WHEN signature LIKE '%SURICATA%' OR signature LIKE '%ET FILE_SHARING%' THEN 'MEDIUM' WHEN signature LIKE '%ET INFO%' OR signature LIKE '%ET POLICY%' OR signature LIKE '%ET DNS%' THEN 'LOW' ELSE s END AS sev FROM l)
    SELECT timestamp, signature, src_ip, dst_ip, sev AS severity, CASE WHEN safe THEN severity_num WHEN sev IN ('HIGH', 'CRITICAL') THEN 1 WHEN sev = 'MEDIUM' THEN 2 ELSE 3 END AS severity_num FROM r"""))
def s04(s):
    root, source = fresh_path(s.spark, "live"), fresh_path(s.spark, "events")
    ids_lines(s).write.text(source)
    live.start_ids_alerts(stream_ids_lines(s.spark, source), root, 1, once=True).awaitTermination()
    return s.spark.read.parquet(f"{root}/ids_alerts").select(
        "timestamp", "signature", "src_ip", "dst_ip", "severity", "severity_num"
    )


@query("s05_batch_callbacks", with_views("packets", "SELECT transport, count(*) AS packets FROM packets GROUP BY transport"))
def s05(s):
    """The callback of each batch keeps its own counts, merged afterwards."""
    root, source = fresh_path(s.spark, "live"), fresh_path(s.spark, "lines")
    counts = fresh_path(s.spark, "counts")
    _clean_lines(s).repartition("value").write.partitionBy("session_id").text(source)
    raw = s.spark.readStream.schema("value STRING, session_id INT").option("maxFilesPerTrigger", 8).text(source)

    def count(batch, number):
        per = batch.groupBy("transport").agg(F.count("*").alias("n"))
        per.write.mode("overwrite").parquet(f"{counts}/batch_id={number}")

    live.start_flows(live.live_packets(raw, LOCAL_IPS, "60 days"), root, count, once=True).awaitTermination()
    return s.spark.read.parquet(counts).groupBy("transport").agg(F.sum("n").alias("packets"))
