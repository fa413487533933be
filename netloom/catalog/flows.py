"""Checked queries: flows and packet streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from netloom.catalog.registry import query
from netloom.catalog.views import with_views
from netloom.operators import flows as O
from netloom.operators.rebuild import build_tls_flows, rebuild

# flows by window functions, a different form from the aggregate under test
FLOWS_SQL = """
WITH keyed AS (
  SELECT *, CASE WHEN src_ip || ':' || src_port <= dst_ip || ':' || dst_port
                 THEN src_ip || ':' || src_port || '|' || dst_ip || ':' || dst_port
                 ELSE dst_ip || ':' || dst_port || '|' || src_ip || ':' || src_port END AS ends
  FROM packets),
numbered AS (
  SELECT *, row_number() OVER f AS n, row_number() OVER (PARTITION BY session_id, ends, protocol ORDER BY frame_number DESC) AS back,
         last_value(CASE tcp_flags WHEN 'SYN' THEN 'SYN_SENT' WHEN 'SYN, ACK' THEN 'ESTABLISHED' WHEN 'FIN, ACK' THEN 'FIN' WHEN 'RST' THEN 'RST' END IGNORE NULLS)
           OVER (PARTITION BY session_id, ends, protocol ORDER BY frame_number ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS st
  FROM keyed WINDOW f AS (PARTITION BY session_id, ends, protocol ORDER BY frame_number)),
folded AS (
  SELECT session_id, ends, protocol, max(CASE WHEN n = 1 THEN src_ip END) AS src_ip, max(CASE WHEN n = 1 THEN dst_ip END) AS dst_ip,
         max(CASE WHEN n = 1 THEN src_port END) AS src_port, max(CASE WHEN n = 1 THEN dst_port END) AS dst_port,
         max(CASE WHEN n = 1 THEN transport END) AS transport, max(CASE WHEN n = 1 THEN direction END) AS direction,
         max(CASE WHEN n = 1 THEN ts END) AS start_time, max(CASE WHEN back = 1 THEN ts END) AS end_time,
         count(*) AS total_packets, CAST(sum(packet_length) AS BIGINT) AS total_bytes,
         coalesce(max(st), 'ACTIVE') AS state, min(frame_number) AS first_frame
  FROM numbered GROUP BY session_id, ends, protocol)
"""
FLOW_COLUMNS = (
    "session_id", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "transport", "direction",
    "start_time", "end_time", "total_packets", "total_bytes", "state", "first_frame",
)
_SHOWN = ", ".join(FLOW_COLUMNS)


@query(
    "c1_frame_dedup",
    with_views("packets", """
    SELECT session_id, count(*) AS frames, CAST(sum(packet_length) AS BIGINT) AS bytes FROM packets GROUP BY session_id"""),
)
def c1(s):
    """Every third frame is delivered again with other bytes; the first stays."""
    first = s.packets.withColumn("arrival", F.lit(0))
    again = s.packets.filter("frame_number % 3 = 0").withColumn("arrival", F.lit(1))
    again = again.withColumn("packet_length", F.col("packet_length") + 1)
    kept = O.dedup_frames(first.unionByName(again), arrival="arrival")
    return kept.groupBy("session_id").agg(
        F.count("*").alias("frames"), F.sum("packet_length").alias("bytes")
    )


@query("c2_flow_aggregation", with_views("packets", FLOWS_SQL + f"""
    SELECT {_SHOWN}, epoch_us(end_time) - epoch_us(start_time) AS duration_us FROM folded"""))
def c2(s):
    flows = O.build_flows(s.packets)
    return flows.select(*FLOW_COLUMNS, F.round(F.col("duration") * 1000000).cast("bigint").alias("duration_us"))


@query("c3_flow_state", with_views("packets", FLOWS_SQL + "SELECT state, count(*) AS flows FROM folded GROUP BY state"))
def c3(s):
    return O.build_flows(s.packets).groupBy("state").agg(F.count("*").alias("flows"))


@query("c5_running_counters", with_views("packets", """
    SELECT session_id, 'total' AS kind, '' AS name, count(*) AS packets, CAST(sum(packet_length) AS BIGINT) AS bytes FROM packets GROUP BY 1
    UNION ALL SELECT session_id, 'transport', transport, count(*), CAST(sum(packet_length) AS BIGINT) FROM packets GROUP BY 1, 3
    UNION ALL SELECT session_id, 'protocol', protocol, count(*), CAST(sum(packet_length) AS BIGINT) FROM packets GROUP BY 1, 3
    UNION ALL SELECT session_id, 'direction', direction, count(*), CAST(sum(packet_length) AS BIGINT) FROM packets GROUP BY 1, 3"""))
def c5(s):
    return O.running_counters(s.packets)


_FEED = """
    SELECT frame_number AS num, CAST(printf('%.3f', relative_time) AS DOUBLE) AS time, protocol AS proto,
           CASE WHEN strpos(src_ip, ':') > 0 AND length(src_ip) > 20 THEN substr(src_ip, 1, 17) || '...' ELSE src_ip END || ':' || src_port AS src,
           CASE WHEN strpos(dst_ip, ':') > 0 AND length(dst_ip) > 20 THEN substr(dst_ip, 1, 17) || '...' ELSE dst_ip END || ':' || dst_port AS dst,
           packet_length AS length, direction,
           CASE WHEN length(info) > 80 THEN substr(info, 1, 77) || '...' ELSE info END AS info
    FROM packets WHERE session_id = (SELECT max(session_id) FROM packets) AND src_port NOT IN (8000, 5173) AND dst_port NOT IN (8000, 5173)
    """


@query("c6_recent_packets", with_views("packets", _FEED + "ORDER BY frame_number DESC LIMIT 50"))
def c6(s):
    return O.recent_packets(s.packets)


@query("c6_recent_packets_after", with_views("packets", f"""
    WITH last AS ({_FEED} ORDER BY frame_number DESC LIMIT 500) SELECT * FROM last WHERE num > (SELECT min(num) + 100 FROM last)"""))
def c6_after(s):
    """The rows after a cursor, within the buffer of the latest session."""
    start = O.recent_packets(s.packets, limit=500).agg(F.min("num")).first()[0]
    return O.recent_packets(s.packets, after=start + 100)


@query("c7_packets_per_second", with_views("packets", """
    WITH c AS (SELECT session_id, CAST(floor(epoch_us(ts) / 1e6) AS BIGINT) AS second, count(*) AS n FROM packets GROUP BY 1, 2),
    t AS (SELECT a.session_id, a.second, (SELECT CAST(sum(n) AS BIGINT) FROM c b WHERE b.session_id = a.session_id AND b.second <= a.second) AS packets FROM c a)
    SELECT a.session_id, a.second, a.packets,
           CAST(coalesce(floor((a.packets - min(b.packets)) / nullif(a.second - min(b.second), 0)), 0) AS BIGINT) AS pps
    FROM t a JOIN t b ON a.session_id = b.session_id AND b.second BETWEEN a.second - 5 AND a.second
    GROUP BY a.session_id, a.second, a.packets"""))
def c7(s):
    return O.packets_per_second(s.packets)


# packets under their final label, by a running maximum over each pair
RELABELLED_SQL = """
WITH e AS (SELECT *, CASE WHEN src_ip || ':' || src_port <= dst_ip || ':' || dst_port THEN src_ip || src_port || dst_ip || dst_port ELSE dst_ip || dst_port || src_ip || src_port END AS pair,
           CASE supported_version WHEN '' THEN 0 WHEN '0x0304' THEN 4 ELSE 3 END AS code FROM packets),
relabelled AS (SELECT * REPLACE (CASE WHEN protocol NOT LIKE 'TLS%' THEN protocol ELSE
      CASE max(code) OVER (PARTITION BY session_id, pair, protocol LIKE 'TLS%' ORDER BY frame_number) WHEN 4 THEN 'TLSv1.3' WHEN 3 THEN 'TLSv1.2' ELSE protocol END END AS protocol) FROM e),
"""
_TLS_FLOWS_SQL = RELABELLED_SQL + FLOWS_SQL.strip().removeprefix("WITH ").replace("FROM packets)", "FROM relabelled)")


@query("c2_tls_flows", with_views("packets", _TLS_FLOWS_SQL + f" SELECT {_SHOWN} FROM folded"))
def c2_tls(s):
    """B6 and C2 together, without moving the packets to their pair."""
    return build_tls_flows(s.packets).select(*FLOW_COLUMNS)


@query("c8_full_rebuild", with_views("packets", _TLS_FLOWS_SQL + f" SELECT {_SHOWN} FROM folded"))
def c8(s):
    """Every packet is delivered twice."""
    flows, _ = rebuild(s.packets.unionByName(s.packets))
    return flows.select(*FLOW_COLUMNS)


@query("c8_rebuilt_counters", with_views("packets", RELABELLED_SQL.rstrip().rstrip(",") + """
    SELECT session_id, 'total' AS kind, '' AS name, count(*) AS packets, CAST(sum(packet_length) AS BIGINT) AS bytes FROM relabelled GROUP BY 1
    UNION ALL SELECT session_id, 'transport', transport, count(*), CAST(sum(packet_length) AS BIGINT) FROM relabelled GROUP BY 1, 3
    UNION ALL SELECT session_id, 'protocol', protocol, count(*), CAST(sum(packet_length) AS BIGINT) FROM relabelled GROUP BY 1, 3
    UNION ALL SELECT session_id, 'direction', direction, count(*), CAST(sum(packet_length) AS BIGINT) FROM relabelled GROUP BY 1, 3"""))
def c8_counters(s):
    _, counters = rebuild(s.packets.unionByName(s.packets))
    return counters


@query("c9_live_override", with_views("packets connections", """
    SELECT CAST((SELECT sum(total_packets) FROM connections WHERE session_id <> 2) + (SELECT count(*) FROM packets WHERE session_id = 2) AS BIGINT) AS total_packets,
           CAST((SELECT sum(total_bytes) FROM connections WHERE session_id <> 2) + (SELECT sum(packet_length) FROM packets WHERE session_id = 2) AS BIGINT) AS total_bytes"""))
def c9(s):
    """The counters of live session 2 come from its packets."""
    flows = s.plain_connections
    sums = [F.sum("total_packets").alias("total_packets"), F.sum("total_bytes").alias("total_bytes")]
    live = s.packets.filter("session_id = 2").groupBy("session_id").agg(
        F.count("*").alias("live_packets"), F.sum("packet_length").alias("live_bytes")
    )
    return O.override_totals(flows.agg(*sums), flows.groupBy("session_id").agg(*sums), live)
