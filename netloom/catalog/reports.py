"""Checked queries: the report surface (F1-F30, E10, H, P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from netloom.catalog.registry import query
from netloom.catalog.views import with_views
from netloom.functions.predicates import AlertFilter, ConnectionFilter
from netloom.plans import alerts as A, connections as C, sessions as S

_RESULT = """id, src_ip, dst_ip, src_port, dst_port, protocol, direction, start_time, end_time, duration,
  total_packets, total_bytes, state, tag_text AS tags, severity"""


def _bytes(x: str) -> str:
    return (
        f"CASE WHEN {x} >= 1000000000 THEN printf('%.1f GB', {x} / 1e9) WHEN {x} >= 1000000 THEN printf('%.1f MB', {x} / 1e6) "
        f"WHEN {x} >= 1000 THEN printf('%.1f KB', {x} / 1e3) ELSE CAST({x} AS VARCHAR) || ' B' END"
    )


@query("f01_sessions_with_alerts", with_views("sessions alerts", """
    SELECT id, start_time, end_time, total_packets, total_bytes, interface, pcap_file,
           (SELECT count(*) FROM alerts a WHERE a.session_id = s.id) AS alert_count FROM sessions s"""))
def f01(s):
    return S.sessions_with_alerts(s.sessions, s.alerts)


def _stats_sql(where: str) -> str:
    return f"""
    SELECT 'protocol' AS section, protocol AS name, CAST(sum(total_packets) AS BIGINT) AS packets, CAST(sum(total_bytes) AS BIGINT) AS bytes, count(*) AS flows FROM connections {where} GROUP BY protocol
    UNION ALL SELECT 'direction', direction, CAST(sum(total_packets) AS BIGINT), CAST(sum(total_bytes) AS BIGINT), count(*) FROM connections {where} GROUP BY direction
    UNION ALL SELECT 'total', '', CAST(sum(total_packets) AS BIGINT), CAST(sum(total_bytes) AS BIGINT), count(*) FROM connections {where}"""


@query("f02_session_stats", with_views("connections", _stats_sql("WHERE session_id = 3")))
def f02(s):
    return S.session_stats(s.plain_connections, s.sessions, 3)


@query("f03_latest_session", with_views("sessions", "SELECT id FROM sessions ORDER BY id DESC LIMIT 1"))
def f03(s):
    return S.latest_session(s.sessions)


@query("f04_cumulative_stats", with_views("connections sessions", _stats_sql("") + """
    UNION ALL SELECT 'sessions', '', 0, 0, count(*) FROM sessions"""))
def f04(s):
    return S.traffic_stats(s.plain_connections, s.sessions)


@query("f05_totals", with_views("connections alerts", """
    SELECT CAST(sum(total_packets) AS BIGINT) AS packets, count(*) AS connections, (SELECT count(*) FROM alerts) AS alerts FROM connections"""))
def f05(s):
    return S.totals(s.plain_connections, s.alerts)


@query("f06_protocol_stats", with_views("connections", """
    SELECT protocol, CAST(sum(total_packets) AS BIGINT) AS packet_count, CAST(sum(total_bytes) AS BIGINT) AS total_bytes FROM connections GROUP BY protocol"""))
def f06(s):
    from netloom.operators.maintenance import protocol_stats_from

    return S.protocol_stats(protocol_stats_from(s.plain_connections))


@query("f07_top_connections", with_views("connections", f"SELECT {_RESULT} FROM connections ORDER BY total_bytes DESC, id LIMIT 50"))
def f07(s):
    return C.top_connections(s.connections)


@query("f07_top_by_duration", with_views("connections", f"SELECT {_RESULT} FROM connections WHERE session_id = 2 ORDER BY duration DESC, id LIMIT 20"))
def f07b(s):
    return C.top_connections(s.connections, 20, "duration", 2)


def _search_sql(where: str) -> str:
    return with_views("connections", f"SELECT {_RESULT} FROM connections WHERE {where} ORDER BY total_bytes DESC, id LIMIT 100")


@query("f08_search_ip", _search_sql("'142.250.1.2' IN (src_ip, dst_ip)"))
def f08(s):
    return C.search_by_ip(s.connections, "142.250.1.2")


@query("f09_search_protocol", _search_sql("lower(protocol) = 'udp' OR lower(transport) = 'udp'"))
def f09(s):
    return C.search_by_protocol(s.connections, "udp")


@query("f10_search_port", _search_sql("3306 IN (src_port, dst_port) AND session_id = 2"))
def f10(s):
    return C.search_by_port(s.connections, 3306, session_id=2)


@query("f11_search_tag", _search_sql("tag_text ILIKE '%Dest%'"))
def f11(s):
    return C.search_by_tag(s.connections, "Dest")


_TALKERS = """
    SELECT ip, count(*) AS connections, CAST(sum(p) AS BIGINT) AS total_packets, CAST(sum(b) AS BIGINT) AS total_bytes
    FROM (SELECT src_ip AS ip, total_packets AS p, total_bytes AS b FROM {t} UNION ALL SELECT dst_ip, total_packets, total_bytes FROM {t}) u
    GROUP BY ip ORDER BY total_bytes DESC, ip LIMIT 10"""


@query("f12_top_talkers", with_views("connections", _TALKERS.format(t="connections")))
def f12(s):
    return S.top_talkers(s.plain_connections)


@query("f13_tag_summary", with_views("connections", """
    SELECT 'tag' AS section, trim(t) AS name, count(*) AS count FROM (SELECT unnest(string_split(tag_text, ',')) AS t FROM connections WHERE tag_text <> '') x GROUP BY 2
    UNION ALL SELECT 'severity', severity, count(*) FROM connections WHERE tag_text <> '' AND severity <> '' GROUP BY 2
    UNION ALL SELECT 'total', '', count(*) FROM connections WHERE tag_text <> ''"""))
def f13(s):
    return S.tag_summary(s.connections)


@query("f14_recent_alerts", with_views("alerts", """
    SELECT id, timestamp, severity, signature, category, src_ip, dst_ip, dst_port, proto FROM alerts WHERE session_id = 2 ORDER BY id DESC LIMIT 100"""))
def f14(s):
    return A.recent_alerts(s.alerts, session_id=2)


@query("f15_threat_summary", with_views("alerts", """
    SELECT 'total' AS section, '' AS name, count(*) AS count FROM alerts
    UNION ALL SELECT 'severity', severity, count(*) FROM alerts GROUP BY severity
    UNION ALL SELECT * FROM (SELECT 'source', src_ip, count(*) FROM alerts GROUP BY src_ip ORDER BY count(*) DESC, src_ip LIMIT 10)
    UNION ALL SELECT * FROM (SELECT 'signature', signature, count(*) FROM alerts GROUP BY signature ORDER BY count(*) DESC, signature LIMIT 10)"""))
def f15(s):
    return A.threat_summary(s.alerts)


@query("f16_reputation_lookup", with_views("reputation", "SELECT ip, abuse_score, country, isp, is_malicious, last_checked FROM reputation WHERE ip = '104.16.2.1'"))
def f16(s):
    from netloom.operators.reputation import lookup_reputation

    return lookup_reputation(s.reputation, "104.16.2.1")


@query("f17_hourly_series", with_views("packets alerts", """
    WITH h AS (SELECT date_trunc('hour', ts) AS bucket, count(*) AS packets, CAST(sum(packet_length) AS BIGINT) AS bytes FROM packets WHERE session_id = 2 GROUP BY 1 ORDER BY 1 DESC LIMIT 12),
    a AS (SELECT date_trunc('hour', timestamp) AS bucket, count(*) AS n FROM alerts WHERE session_id = 2 GROUP BY 1 ORDER BY 1 DESC LIMIT 12)
    SELECT 'packets' AS series, bucket, packets AS value FROM h UNION ALL SELECT 'bytes', bucket, bytes FROM h UNION ALL SELECT 'alerts', bucket, n FROM a"""))
def f17(s):
    """One-packet flows give every hour of the session a point."""
    flows = s.packets.select(
        "session_id", F.col("ts").alias("start_time"), F.lit(1).cast("bigint").alias("total_packets"),
        F.col("packet_length").alias("total_bytes"),
    )
    return S.hourly_series(flows, s.alerts, 2)


@query("f18_session_series", with_views("connections", """
    WITH s AS (SELECT session_id * 100 + dst_port % 7 AS id, CAST(sum(total_packets) AS BIGINT) AS packets, CAST(sum(total_bytes) AS BIGINT) AS bytes FROM connections GROUP BY 1)
    SELECT id, packets, bytes, row_number() OVER (ORDER BY id) AS sessions FROM s ORDER BY id DESC LIMIT 12"""))
def f18(s):
    many = s.plain_connections.groupBy((F.col("session_id") * 100 + F.col("dst_port") % 7).alias("id")).agg(
        F.sum("total_packets").alias("total_packets"), F.sum("total_bytes").alias("total_bytes")
    )
    return S.session_series(many)


@query("f19_protocol_shares", with_views("connections", f"""
    WITH p AS (SELECT protocol AS name, CAST(sum(total_packets) AS BIGINT) AS packets, CAST(sum(total_bytes) AS BIGINT) AS b FROM connections GROUP BY 1)
    SELECT name, packets, CAST(printf('%.1f', CAST(packets AS DOUBLE) / (SELECT sum(packets) FROM p) * 100) AS DOUBLE) AS pct,
           CASE WHEN packets >= 1000000 THEN printf('%.2fM', packets / 1e6) WHEN packets >= 1000 THEN printf('%.1fK', packets / 1e3) ELSE CAST(packets AS VARCHAR) END AS packets_display,
           {_bytes('b')} AS bytes_display FROM p"""))
def f19(s):
    return S.protocol_shares(s.plain_connections)


_ALERT_SHOWN = """id, timestamp, CASE severity_num WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity, signature, category,
    src_ip, dst_ip, src_port, dst_port, proto, action, src_ip || ' → ' || dst_ip || ':' || dst_port AS meta"""
_WHERE = AlertFilter(severity="medium", search="et ", date_from="2024-01-03", date_to="2024-01-20")


@query("f20_alert_page", with_views("alerts", f"""
    SELECT {_ALERT_SHOWN} FROM alerts
    WHERE severity_num = 2 AND (src_ip ILIKE '%et %' OR dst_ip ILIKE '%et %' OR signature ILIKE '%et %' OR category ILIKE '%et %')
      AND timestamp >= TIMESTAMP '2024-01-03 00:00:00' AND timestamp <= TIMESTAMP '2024-01-20 23:59:59'
    ORDER BY id DESC LIMIT 20 OFFSET 20"""))
def f20(s):
    return A.alert_page(s.alerts, _WHERE, page=2, per_page=20)


@query("f20_alert_page_counts", with_views("alerts", """
    WITH m AS (SELECT * FROM alerts WHERE signature ILIKE '%et %'
               AND timestamp BETWEEN TIMESTAMP '2024-01-03 00:00:00' AND TIMESTAMP '2024-01-20 23:59:59')
    SELECT (SELECT count(*) FROM m WHERE severity_num = 2) AS total_count,
           CAST(greatest(1, ceil((SELECT count(*) FROM m WHERE severity_num = 2) / 20.0)) AS BIGINT) AS total_pages,
           count(*) FILTER (severity_num = 1) AS high_count, count(*) FILTER (severity_num = 2) AS medium_count, count(*) FILTER (severity_num = 3) AS low_count FROM m"""))
def f20b(s):
    return A.alert_page_counts(s.alerts, _WHERE, per_page=20)


@query("f20_alert_protocols", with_views("alerts", "SELECT proto AS protocol FROM alerts WHERE coalesce(proto, '') <> '' GROUP BY proto"))
def f20c(s):
    return C.distinct_protocols(s.alerts, "proto")


@query("f21_grouped_alerts", with_views("alerts", """
    SELECT signature, CASE severity_num WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity,
           arg_max(category, id) AS category, arg_max(proto, id) AS proto, count(*) AS count,
           min(timestamp) AS first_seen, max(timestamp) AS last_seen,
           array_to_string(list_slice(list_sort(list(DISTINCT src_ip)), 1, 5), ',') AS src_ips,
           array_to_string(list_slice(list_sort(list(DISTINCT dst_ip)), 1, 5), ',') AS dst_ips, max(id) AS last_id
    FROM alerts GROUP BY signature, severity_num ORDER BY max(id) DESC LIMIT 10"""))
def f21(s):
    page = A.grouped_alerts(s.alerts, per_page=10)
    return page.withColumns({c: F.array_join(c, ",") for c in ("src_ips", "dst_ips")})


@query("f21_grouped_alert_counts", with_views("alerts", """
    SELECT count(*) AS total_count, CAST(greatest(1, ceil(count(*) / 10.0)) AS BIGINT) AS total_pages
    FROM (SELECT DISTINCT signature, severity_num FROM alerts) g"""))
def f21b(s):
    return A.grouped_alert_counts(s.alerts, per_page=10)


_FLOWS = ConnectionFilter(search="142.250", protocol="HTTP", tag="new", date_from="1995-03-01", date_to="1998-06-30 12:00")


@query("f22_connection_page", with_views("connections", f"""
    SELECT id, src_ip || ':' || src_port AS src, dst_ip || ':' || dst_port AS dst, src_ip, dst_ip, src_port, dst_port, protocol, transport,
           direction, total_packets AS packets, {_bytes('total_bytes')} AS bytes, total_bytes AS raw_bytes, tag_text AS tags, start_time AS time, end_time,
           CAST(printf('%.2f', duration) AS DOUBLE) AS duration, state, severity, session_id
    FROM connections WHERE (src_ip LIKE '%142.250%' OR dst_ip LIKE '%142.250%') AND protocol = 'HTTP' AND tag_text LIKE '%new%'
      AND start_time >= TIMESTAMP '1995-03-01' AND start_time < TIMESTAMP '1998-06-30 12:00:00'
    ORDER BY id DESC LIMIT 50"""))
def f22(s):
    return C.connection_page(s.connections, _FLOWS)


@query("f22_connection_page_counts", with_views("connections", """
    SELECT count(*) AS total_count, CAST(greatest(1, ceil(count(*) / 50.0)) AS BIGINT) AS total_pages FROM connections
    WHERE dst_ip LIKE '%142.250%' AND protocol = 'HTTP' AND tag_text LIKE '%new%' AND start_time >= TIMESTAMP '1995-03-01' AND start_time < TIMESTAMP '1998-06-30 12:00:00'"""))
def f22b(s):
    return C.connection_page_counts(s.connections, _FLOWS)


@query("f23_distinct_protocols", with_views("connections", "SELECT protocol FROM connections GROUP BY protocol"))
def f23(s):
    return C.distinct_protocols(s.plain_connections)


@query("f23_distinct_tags", with_views("connections", "SELECT DISTINCT trim(t) AS tag FROM (SELECT unnest(string_split(tag_text, ',')) AS t FROM connections) x WHERE trim(t) <> ''"))
def f23b(s):
    return C.distinct_tags(s.connections)


# flows of the packet view, whose addresses also occur in the alerts
_PACKET_FLOWS = """
    WITH g AS (SELECT min(frame_number) AS id, arg_min(src_ip, frame_number) AS src_ip, arg_min(dst_ip, frame_number) AS dst_ip, protocol,
                      arg_min(ts, frame_number) AS start_time, CAST(sum(packet_length) AS BIGINT) AS total_bytes, count(*) AS total_packets, session_id
               FROM packets GROUP BY session_id, least(src_ip, dst_ip), greatest(src_ip, dst_ip), protocol)"""


def _packet_flows(s):
    from netloom.operators.flows import build_flows

    return build_flows(s.packets).withColumn("id", F.col("first_frame"))


@query("f24_related_alerts", with_views("packets alerts", _PACKET_FLOWS + """
    SELECT id, alert_id, timestamp, severity, signature, category, proto, action FROM (
      SELECT g.id, a.id AS alert_id, a.timestamp, a.severity, a.signature, a.category, a.proto, a.action,
             row_number() OVER (PARTITION BY g.id ORDER BY a.timestamp DESC, a.id DESC) AS n
      FROM g JOIN alerts a ON (a.src_ip = g.src_ip AND a.dst_ip = g.dst_ip) OR (a.src_ip = g.dst_ip AND a.dst_ip = g.src_ip)) x WHERE n <= 20"""))
def f24a(s):
    return C.related_alerts(_packet_flows(s), s.alerts)


@query("f24_sibling_connections", with_views("packets", _PACKET_FLOWS + f"""
    SELECT id, dst_ip, other_id, other_src, protocol, time, packets, bytes FROM (
      SELECT g.id, g.dst_ip, o.id AS other_id, o.src_ip AS other_src, o.protocol, o.start_time AS time, o.total_packets AS packets, {_bytes('o.total_bytes')} AS bytes,
             row_number() OVER (PARTITION BY g.id ORDER BY o.start_time DESC, o.id DESC) AS n
      FROM g JOIN g o ON g.dst_ip = o.dst_ip AND g.id <> o.id) x WHERE n <= 10"""))
def f24b(s):
    flows = _packet_flows(s)
    return C.sibling_connections(flows, flows)


@query("f24_connection_details", with_views("connections reputation", f"""
    WITH obs AS (SELECT session_id, dst_ip, sum(total_bytes) AS b FROM connections WHERE session_id <= 4 GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY dst_ip ORDER BY session_id) AS n FROM obs),
    known AS (SELECT dst_ip, CAST(count(*) AS INT) AS session_count, CASE WHEN count(*) = 1 THEN max(b) ELSE avg(b) FILTER (n > 1) END AS mean FROM r GROUP BY dst_ip)
    SELECT c.id, c.src_ip, c.dst_ip, {_bytes('c.total_bytes')} AS bytes, CAST(printf('%.2f', duration) AS DOUBLE) AS duration,
           CASE WHEN duration > 0 THEN {_bytes("CAST(floor(CAST(printf('%.1f', total_bytes / duration) AS DOUBLE)) AS BIGINT)")} ELSE '0 B' END || '/s' AS data_rate,
           CASE WHEN duration > 0 THEN CAST(printf('%.1f', total_packets / duration) AS DOUBLE) ELSE 0 END AS packets_per_sec,
           rs.abuse_score AS src_abuse_score, rd.abuse_score AS dst_abuse_score, k.session_count, {_bytes('CAST(floor(k.mean) AS BIGINT)')} AS avg_bytes
    FROM connections c LEFT JOIN reputation rs ON rs.ip = c.src_ip LEFT JOIN reputation rd ON rd.ip = c.dst_ip LEFT JOIN known k ON k.dst_ip = c.dst_ip
    WHERE c.session_id = 5"""))
def f24c(s):
    from netloom.operators.baseline import baseline

    flows = s.plain_connections
    known = baseline(flows.filter("session_id <= 4"))
    return C.connection_details(flows.filter("session_id = 5"), s.reputation, known)


@query("f25_latest_alert", with_views("alerts", """
    SELECT id, timestamp, CASE severity_num WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity, signature AS title, src_ip || ' → ' || dst_ip AS meta
    FROM alerts WHERE id = (SELECT max(id) FROM alerts)"""))
def f25(s):
    return A.latest_alert(s.alerts)


@query("f26_session_overview", with_views("sessions alerts connections", f"""
    SELECT id, start_time, end_time, total_packets AS packets, {_bytes('total_bytes')} AS bytes_display, interface,
           'capture_' || id || '.pcapng' AS pcap_file, status,
           (SELECT count(*) FROM alerts a WHERE a.session_id = s.id) AS alerts,
           (SELECT count(*) FROM connections c WHERE c.session_id = s.id) AS connections FROM sessions s"""))
def f26(s):
    return S.session_overview(s.sessions, s.alerts, s.plain_connections)


@query("f27_session_exists", with_views("sessions", "SELECT id, interface, start_time FROM sessions WHERE id = 3"))
def f27(s):
    return S.session_exists(s.sessions, 3)


@query("f28_texts_missing", with_views("alerts", """
    SELECT DISTINCT signature || '|' || src_ip || '|' || dst_ip || '|' || src_port || '|' || dst_port AS cache_key FROM alerts a
    WHERE NOT EXISTS (SELECT 1 FROM alerts b WHERE b.session_id = 1 AND b.signature = a.signature AND b.src_ip = a.src_ip AND b.dst_ip = a.dst_ip AND b.src_port = a.src_port AND b.dst_port = a.dst_port)"""))
def f28(s):
    """Texts exist for everything seen in session 1."""
    key = C.alert_text_key()
    cache = s.alerts.filter("session_id = 1").select(key.alias("cache_key")).distinct()
    return C.texts_missing(s.alerts, cache, key)


@query("f28_texts_cached", with_views("connections", """
    WITH c AS (SELECT 'conn|' || src_ip || '|' || dst_ip || '|' || protocol || '|' || id AS cache_key, session_id FROM connections)
    SELECT cache_key, CASE WHEN session_id <= 3 THEN 'text of ' || cache_key END AS explanation FROM c"""))
def f28b(s):
    key = C.connection_text_key()
    cache = s.plain_connections.filter("session_id <= 3").select(key.alias("cache_key"))
    cache = cache.withColumn("explanation", F.concat(F.lit("text of "), F.col("cache_key")))
    return C.texts_cached(s.plain_connections, cache, key).select("cache_key", "explanation")


@query("f29_alert_context", with_views("packets alerts", _PACKET_FLOWS + """
    , m AS (SELECT g.id, a.id AS alert_id, '[' || a.severity || '] ' || substr(a.signature, 1, 60) AS t, row_number() OVER (PARTITION BY g.id ORDER BY a.id DESC) AS n
       FROM g JOIN alerts a ON a.src_ip IN (g.src_ip, g.dst_ip) OR a.dst_ip IN (g.src_ip, g.dst_ip))
    SELECT id, CAST(count(*) AS INT) AS alert_count, string_agg(t, '; ' ORDER BY alert_id DESC) AS alerts FROM m WHERE n <= 3 GROUP BY id"""))
def f29(s):
    return C.alert_context(_packet_flows(s), s.alerts)


@query("f30_capture_summary", with_views("packets", """
    WITH x AS (SELECT session_id, 'total' AS kind, '' AS name, packet_length AS b FROM packets UNION ALL SELECT session_id, 'transport', transport, packet_length FROM packets
       UNION ALL SELECT session_id, 'protocol', protocol, packet_length FROM packets UNION ALL SELECT session_id, 'direction', direction, packet_length FROM packets)
    SELECT session_id, kind, name, count(*) AS packets, CAST(sum(b) AS BIGINT) AS bytes, CAST(sum(b) // count(*) AS BIGINT) AS mean_size,
           CAST(printf('%.1f', CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM packets p WHERE p.session_id = x.session_id) * 100) AS DOUBLE) AS share
    FROM x GROUP BY session_id, kind, name"""))
def f30(s):
    from netloom.operators.flows import running_counters

    return S.capture_summary(running_counters(s.packets))
