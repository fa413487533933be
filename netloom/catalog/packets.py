"""Checked queries: packet parsing and expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from netloom.catalog.registry import query
from netloom.catalog.views import LOCAL_IPS, NETWORKS, TRUSTED_SQL, SEMI_SQL, with_views
from netloom.functions import address, codes, fmt, packet as P, predicates as Q
from netloom.operators.dns import ip_domains
from netloom.operators.tls import propagate_tls
from netloom.sources.ids import parse_ids_lines
from netloom.session import fresh_path
from netloom.sources.packets import read_packets

# what is done to the packets before they are written as lines
_MARKED = """
WITH raw AS (SELECT *, k % 17 = 0 AS mac, frame_number % 41 = 0 AS bad_len, frame_number % 43 = 0 AS bad_num,
                    frame_number % 47 = 0 AS short, frame_number % 53 = 0 AS bad_port, protocol = 'SSH' AND k % 13 = 0 AS unk FROM packets),
parsed AS (
  SELECT session_id, CASE WHEN bad_num THEN 0 ELSE frame_number END AS frame_number, date_trunc('millisecond', ts) AS ts, relative_time,
         CASE WHEN mac THEN 'aa:bb:cc:00:00:0' || (k % 10) ELSE src_ip END AS src_ip, CASE WHEN mac THEN 'aa:bb:cc:00:00:ff' ELSE dst_ip END AS dst_ip,
         CASE WHEN bad_port THEN NULL ELSE src_port END AS src_port, dst_port, transport,
         CASE WHEN unk THEN 'TCP' WHEN protocol = 'TLSv1.2' AND supported_version = '0x0304' THEN 'TLSv1.3' ELSE protocol END AS protocol,
         CASE tcp_flags WHEN 'SYN, ACK' THEN 'ACK, SYN' WHEN 'PSH, ACK' THEN 'ACK, PSH' WHEN 'FIN, ACK' THEN 'ACK, FIN' ELSE tcp_flags END AS tcp_flags,
         CASE WHEN NOT mac AND dst_ip LIKE '10.0.0.%' THEN 'INCOMING' ELSE 'OUTGOING' END AS direction,
         CASE WHEN bad_len THEN 0 ELSE packet_length END AS packet_length,
         CASE WHEN unk THEN '[TCP segment of a reassembled PDU]' ELSE info END AS info
  FROM raw WHERE NOT short)
"""


def packet_lines(s, damaged: bool = True) -> DataFrame:
    """The packet view written as dissected lines, some of them damaged."""
    c = F.col
    p = s.packets

    def every(n: int, column: str = "frame_number"):
        return (c(column) % n == 0) if damaged else F.lit(False)

    mac = every(17, "k")
    us = F.unix_micros(c("ts").cast("timestamp"))
    epoch = F.format_string("%d.%06d000", F.floor(us / 1000000), F.pmod(us, F.lit(1000000)))
    letters = (
        F.when(c("tcp_flags") == "SYN", "··········S·").when(c("tcp_flags") == "SYN, ACK", "·······A··S·")
        .when(c("tcp_flags") == "ACK", "·······A····").when(c("tcp_flags") == "PSH, ACK", "·······AP···")
        .when(c("tcp_flags") == "FIN, ACK", "·······A···F").when(c("tcp_flags") == "RST", "·········R··").otherwise("")
    )
    versions = c("supported_version") if damaged else F.lit("")
    tls = (c("protocol") == "TLSv1.2") & (versions != "")
    unknown = (c("protocol") == "SSH") & every(13, "k")

    def ip(column: str, six: bool):
        return F.when(~mac & (c(column).contains(":") == six), c(column)).otherwise("")

    def port(column: str, transport: str):
        shown = c(column).cast("string")
        if column == "src_port":
            shown = F.when(every(53), "http").otherwise(shown)
        return F.when(c("transport") == transport, shown).otherwise("")

    fields = [
        F.when(every(43), "x").otherwise(c("frame_number").cast("string")), epoch,
        c("relative_time").cast("string"), ip("src_ip", False), ip("src_ip", True), ip("dst_ip", False), ip("dst_ip", True),
        port("src_port", "TCP"), port("src_port", "UDP"), port("dst_port", "TCP"), port("dst_port", "UDP"),
        F.when(tls, "TLSv1").otherwise(c("protocol")),
        F.when(every(41), "abc").otherwise(c("packet_length").cast("string")), letters,
        versions, F.concat(F.lit("aa:bb:cc:00:00:0"), (c("k") % 10).cast("string")), F.lit("aa:bb:cc:00:00:ff"),
        F.when(unknown, "Ignored Unknown Record").otherwise(c("info")),
    ]
    kept = F.slice(F.array(*fields), 1, F.when(every(47), 9).otherwise(len(fields)))
    line = F.concat_ws("\t", kept)
    return p.select("session_id", line.alias("value"))


def parsed(s) -> DataFrame:
    """The lines as text files, one folder per session, read back as packets."""
    path = fresh_path(s.spark, "lines")
    packet_lines(s).repartition("value").write.partitionBy("session_id").text(path)
    return read_packets(s.spark, path, local_ips=LOCAL_IPS)


def _parsed(name: str, columns: str):
    """A query on the parsed lines that shows some of their columns."""
    sql = with_views("packets", _MARKED + f"SELECT {columns} FROM parsed")
    shown = [c.strip() for c in columns.split(",")]

    @query(name, sql)
    def run(s):
        df = parsed(s)
        flags = P.flags_text(F.col("tcp_flags"))
        return df.withColumn("tcp_flags", flags).select(*shown)

    return run


_parsed("a01_read_packets", "session_id, frame_number, ts, relative_time, src_ip, dst_ip, src_port, dst_port, transport, protocol, tcp_flags, direction, packet_length, info")
_parsed("b01_address_selection", "frame_number, src_ip, dst_ip")
_parsed("b02_port_selection", "frame_number, src_port, dst_port")
_parsed("b03_safe_casts", "frame_number, relative_time, packet_length")
_parsed("b04_epoch_timestamp", "frame_number, ts")
_parsed("b05_tls_label", "frame_number, protocol")
_parsed("b07_two_tier_protocol", "frame_number, transport, protocol")
_parsed("b08_flag_letters", "frame_number, tcp_flags")
_parsed("b10_direction", "frame_number, direction, src_ip, dst_ip")
_parsed("b12_info_normalised", "frame_number, protocol, info")


@query("a02_read_ids_events", with_views("alerts", """
    SELECT timestamp, CASE severity_num WHEN 1 THEN 'CRITICAL' WHEN 2 THEN 'HIGH' WHEN 3 THEN 'MEDIUM' ELSE 'LOW' END AS severity, severity_num, signature, signature_id, category, src_ip, dst_ip, 0 AS src_port, dst_port, proto, action
    FROM (SELECT * REPLACE (CASE WHEN id % 11 = 0 THEN 3 ELSE severity_num END AS severity_num, CASE WHEN id % 13 = 0 THEN 'Unknown' ELSE signature END AS signature)
          FROM alerts WHERE id % 7 <> 0 AND id % 19 <> 0) a"""))
def a02(s):
    return parse_ids_lines(ids_lines(s))


def ids_lines(s) -> DataFrame:
    """Alerts written as engine events: some other types, some unreadable, some bare."""
    c = F.col
    body = F.struct(
        F.when(c("id") % 11 != 0, c("severity_num")).alias("severity"),
        F.when(c("id") % 13 != 0, c("signature")).alias("signature"), "signature_id", "category", "action",
    )
    event = F.to_json(
        F.struct(
            F.concat(F.date_format(c("timestamp").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+0000")).alias("timestamp"),
            F.when(c("id") % 7 == 0, "flow").otherwise("alert").alias("event_type"),
            "src_ip", c("dst_ip").alias("dest_ip"), c("dst_port").alias("dest_port"), "proto", body.alias("alert"),
        )
    )
    return s.alerts.select(F.when(c("id") % 19 == 0, F.substring(event, 1, 40)).otherwise(event).alias("value"))


@query("b06_tls_propagation", with_views("packets", """
    WITH e AS (SELECT *, CASE WHEN src_ip || ':' || src_port <= dst_ip || ':' || dst_port THEN src_ip || src_port || dst_ip || dst_port ELSE dst_ip || dst_port || src_ip || src_port END AS ends,
               CASE supported_version WHEN '' THEN 0 WHEN '0x0304' THEN 4 ELSE 3 END AS code FROM packets)
    SELECT session_id, frame_number, CASE WHEN protocol NOT LIKE 'TLS%' THEN protocol ELSE
      CASE max(code) OVER (PARTITION BY session_id, ends, protocol LIKE 'TLS%' ORDER BY frame_number) WHEN 4 THEN 'TLSv1.3' WHEN 3 THEN 'TLSv1.2' ELSE protocol END END AS protocol FROM e"""))
def b06(s):
    return propagate_tls(s.packets).select("session_id", "frame_number", "protocol")


@query("b09_flag_bits", with_views("packets", """
    SELECT frame_number, array_to_string(list_filter([CASE WHEN b % 2 = 1 THEN 'FIN' END, CASE WHEN b // 2 % 2 = 1 THEN 'SYN' END, CASE WHEN b // 4 % 2 = 1 THEN 'RST' END,
      CASE WHEN b // 8 % 2 = 1 THEN 'PSH' END, CASE WHEN b // 16 % 2 = 1 THEN 'ACK' END, CASE WHEN b // 32 % 2 = 1 THEN 'URG' END, CASE WHEN b // 128 % 2 = 1 THEN 'ECE' END,
      CASE WHEN b // 64 % 2 = 1 THEN 'CWR' END], lambda x: x IS NOT NULL), ', ') AS flags FROM (SELECT frame_number, CAST(frame_number * 7 % 256 AS INT) AS b FROM packets) x"""))
def b09(s):
    bits = (F.col("frame_number") * 7 % 256).cast("int")
    return s.packets.select("frame_number", P.flags_text(P.flags_from_bits(bits)).alias("flags"))


@query("b11_direction_private_aware", with_views("packets", """
    SELECT frame_number, CASE WHEN src_ip IN ('10.0.0.1', '10.0.0.2') THEN 'OUTGOING' WHEN dst_ip IN ('10.0.0.1', '10.0.0.2') THEN 'INCOMING'
             WHEN src_ip LIKE '10.%' OR src_ip LIKE '192.168.%' THEN 'OUTGOING' ELSE 'INCOMING' END AS direction,
           CASE k % 4 WHEN 1 THEN CASE WHEN dst_ip IN ('10.0.0.1', '10.0.0.2') THEN 'INCOMING' ELSE 'OUTGOING' END
             WHEN 2 THEN CASE WHEN src_ip IN ('10.0.0.1', '10.0.0.2') THEN 'OUTGOING' ELSE 'INCOMING' END ELSE 'OUTGOING' END AS arp_direction FROM packets"""))
def b11(s):
    src, dst, local = F.col("src_ip"), F.col("dst_ip"), LOCAL_IPS[:2]
    return s.packets.select(
        "frame_number", P.direction_private_aware(src, dst, local).alias("direction"),
        P.direction_arp(F.col("k") % 4, src, dst, local).alias("arp_direction"),
    )


_IPS = ["10.1.2.3", "192.168.0.9", "172.16.5.5", "172.31.0.1", "172.200.1.1", "172.32.0.1", "127.0.0.1", "169.254.3.3", "0.0.0.0", "::1", "fe80::1", "fd00::2", "ff02::1", "8.8.8.8", "2606:4700::1", ""]
_IP_LIST = "[" + ", ".join(f"'{ip}'" for ip in _IPS) + "]"


@query("b13_private_addresses", with_views("packets", f"""
    SELECT ip, count(*) AS n, bool_or(ip IN ('', '10.1.2.3', '192.168.0.9', '172.16.5.5', '172.31.0.1', '127.0.0.1', '169.254.3.3', '0.0.0.0', '::1', 'fe80::1', 'fd00::2', 'ff02::1')) AS detector,
           bool_or(ip IN ('10.1.2.3', '192.168.0.9', '172.16.5.5', '172.31.0.1', 'fe80::1', 'fd00::2')) AS capture,
           bool_or(ip IN ('', '10.1.2.3', '192.168.0.9', '172.16.5.5', '172.31.0.1', '172.200.1.1', '172.32.0.1', '127.0.0.1', '169.254.3.3', '0.0.0.0', '::1', 'fe80::1', 'fd00::2')) AS reputation,
           bool_or(ip IN ('10.1.2.3', '192.168.0.9', '172.16.5.5', '127.0.0.1', '169.254.3.3', '0.0.0.0', '::1', 'fe80::1', 'fd00::2')) AS lookup
    FROM (SELECT list_extract({_IP_LIST}, k % 16 + 1) AS ip FROM packets) x GROUP BY ip"""))
def b13(s):
    ip = F.get(F.array(*map(F.lit, _IPS)), F.col("k") % 16)
    rows = s.packets.select(ip.alias("ip")).groupBy("ip").agg(F.count("*").alias("n"))
    return rows.select("*", *[address.is_private(F.col("ip"), v).alias(v) for v in address.PRIVATE_PATTERNS])


@query("b14_network_membership", with_views("connections", f"""
    SELECT dst_ip, {TRUSTED_SQL.format('dst_ip')} AS trusted, {SEMI_SQL.format('dst_ip')} AS semi_trusted FROM connections GROUP BY dst_ip"""))
def b14(s):
    ip = F.col("dst_ip")
    return s.plain_connections.select(ip).distinct().select(
        ip, address.in_networks(ip, NETWORKS.trusted).alias("trusted"),
        address.in_networks(ip, NETWORKS.semi_trusted).alias("semi_trusted"),
    )


@query("b15_ipv6_scope", with_views("packets", f"""
    SELECT ip, count(*) AS n, any_value(CASE ip WHEN 'fe80::1' THEN 'Link-Local' WHEN 'ff02::1' THEN 'Multicast-Link' WHEN 'fd00::2' THEN 'Unique-Local' WHEN '::1' THEN 'Loopback'
      WHEN '2606:4700::1' THEN 'Global-Unicast' ELSE 'Other' END) AS scope FROM (SELECT list_extract({_IP_LIST}, k % 16 + 1) AS ip FROM packets) x GROUP BY ip"""))
def b15(s):
    ip = F.get(F.array(*map(F.lit, _IPS)), F.col("k") % 16)
    rows = s.packets.select(ip.alias("ip")).groupBy("ip").agg(F.count("*").alias("n"))
    return rows.withColumn("scope", address.ipv6_scope(F.col("ip")))


def _rules_sql(rules) -> str:
    return ", ".join(f"({i}, '{n}', {a}, {b})" for i, (n, a, b) in enumerate(rules))


@query("b16_service_names", with_views("packets", f"""
    WITH p AS (SELECT frame_number, transport, CAST(frame_number * 97 % 10007 AS INT) AS a, CAST(k * 17 % 601 AS INT) AS b FROM packets),
    t(rank, name, lo, hi) AS (VALUES {_rules_sql(codes.TCP_SERVICES)}), u(rank, name, lo, hi) AS (VALUES {_rules_sql(codes.UDP_SERVICES)})
    SELECT frame_number, CASE transport WHEN 'TCP' THEN coalesce((SELECT arg_min(name, rank) FROM t WHERE a BETWEEN lo AND hi OR b BETWEEN lo AND hi), 'TCP')
             ELSE coalesce((SELECT arg_min(name, rank) FROM u WHERE a BETWEEN lo AND hi OR b BETWEEN lo AND hi), 'UDP') END AS service,
           CASE b WHEN 22 THEN 'SSH' WHEN 53 THEN 'DNS' WHEN 80 THEN 'HTTP' WHEN 443 THEN 'HTTPS/TLS' ELSE 'port ' || b END AS label FROM p"""))
def b16(s):
    a, b = (F.col("frame_number") * 97 % 10007).cast("int"), (F.col("k") * 17 % 601).cast("int")
    return s.packets.select(
        "frame_number", codes.service_name(F.col("transport"), a, b).alias("service"), codes.port_label(b).alias("label")
    )


def _map_sql(table: dict, code: str) -> str:
    return f"CASE {code} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in table.items()) + " END"


@query("b17_code_labels", with_views("packets", f"""
    SELECT k, count(*) AS n, coalesce({_map_sql(codes.DNS_QTYPES, 'k')}, CAST(k AS VARCHAR)) AS qtype, {_map_sql(codes.TLS_VERSIONS, '768 + k % 6')} AS tls_version,
           {_map_sql(codes.TLS_HANDSHAKES, 'k')} AS handshake, coalesce({_map_sql(codes.ICMP_TYPES, 'k')}, 'ICMP Type ' || k) AS icmp,
           {_map_sql(codes.ICMPV6_TYPES, 'k + 100')} AS icmpv6,
           CASE WHEN k % 9 = 0 THEN 'QUIC: Protected Payload' WHEN k * 37 % 256 >= 192 AND k * 37 % 64 < 16 OR k * 37 % 256 BETWEEN 128 AND 143 THEN 'QUIC: Initial'
             WHEN k * 37 % 256 >= 128 THEN 'QUIC: ' || list_extract(['Initial', '0-RTT', 'Handshake', 'Retry'], k * 37 % 64 // 16 + 1)
             WHEN k * 37 % 256 >= 64 THEN 'QUIC: Protected Payload (' || k || ' bytes)' ELSE 'QUIC: Encrypted Data (' || k || ' bytes)' END AS quic
    FROM packets GROUP BY k"""))
def b17(s):
    k = F.col("k")
    byte = F.when(k % 9 != 0, k * 37 % 256)
    return s.packets.groupBy("k").agg(F.count("*").alias("n")).select(
        "k", "n", codes.dns_query_type(k).alias("qtype"), codes.tls_version_name(k % 6 + 768).alias("tls_version"),
        codes.tls_handshake_name(k).alias("handshake"), codes.icmp_name(k).alias("icmp"),
        codes.icmpv6_name(k + 100).alias("icmpv6"),
        codes.quic_packet_type(byte, F.when(k % 9 != 0, k).otherwise(1)).alias("quic"),
    )


@query("b18_dns_answers", with_views("packets", """
    WITH r AS (SELECT session_id, frame_number, string_split(info, ' ') AS w FROM packets WHERE protocol = 'DNS' AND info LIKE '%response%'),
    a AS (SELECT w[8] AS ip, w[6] AS domain, session_id, frame_number FROM r UNION ALL SELECT w[10], w[6], session_id, frame_number FROM r)
    SELECT ip, domain FROM (SELECT ip, domain, row_number() OVER (PARTITION BY ip ORDER BY session_id DESC, frame_number DESC, domain DESC) AS n FROM a) x WHERE n = 1"""))
def b18(s):
    return ip_domains(s.packets)


@query("b20_pdu_segments", with_views("segments", """
    SELECT session_id, frame_number FROM segments WHERE payload_len > 0 AND tcp_flags NOT LIKE '%PSH%' AND tcp_flags NOT LIKE '%SYN%' AND tcp_flags NOT LIKE '%FIN%'"""))
def b20(s):
    return s.segments.filter(P.is_pdu_segment(F.col("payload_len"), F.col("tcp_flags"))).select("session_id", "frame_number")


@query("b21_share_of_total", with_views("connections", """
    SELECT state, count(*) AS n, CAST(printf('%.1f', count(*) / CAST((SELECT count(*) FROM connections) AS DOUBLE) * 100) AS DOUBLE) AS pct FROM connections GROUP BY state"""))
def b21(s):
    from pyspark.sql import Window as W

    rows = s.plain_connections.groupBy("state").agg(F.count("*").alias("n"))
    return rows.withColumn("pct", fmt.share_of_total(F.col("n"), F.sum("n").over(W.partitionBy())))


@query("b22_rates", with_views("connections", """
    SELECT id, CASE WHEN duration > 0 THEN CAST(printf('%.1f', total_bytes / duration) AS DOUBLE) ELSE 0 END AS bytes_per_sec,
      CASE WHEN duration > 0 THEN CAST(printf('%.1f', total_packets / duration) AS DOUBLE) ELSE 0 END AS packets_per_sec, total_bytes // total_packets AS mean_size FROM connections"""))
def b22(s):
    b, p, d = F.col("total_bytes"), F.col("total_packets"), F.col("duration")
    return s.plain_connections.select(
        "id", fmt.per_second(b, d).alias("bytes_per_sec"), fmt.per_second(p, d).alias("packets_per_sec"), fmt.mean_size(b, p).alias("mean_size")
    )


@query("b23_display_text", with_views("connections", """
    SELECT id, CASE WHEN b >= 1000000000 THEN printf('%.1f GB', b / 1e9) WHEN b >= 1000000 THEN printf('%.1f MB', b / 1e6) WHEN b >= 1000 THEN printf('%.1f KB', b / 1e3) ELSE b || ' B' END AS si,
      CASE WHEN b < 1024 THEN printf('%.2f B', b / 1.0) WHEN b < 1048576 THEN printf('%.2f KB', b / 1024.0) WHEN b < 1073741824 THEN printf('%.2f MB', b / 1048576.0) ELSE printf('%.2f GB', b / 1073741824.0) END AS binary_text,
      CASE WHEN b >= 1000000 THEN printf('%.2fM', b / 1e6) WHEN b >= 1000 THEN printf('%.1fK', b / 1e3) ELSE CAST(b AS VARCHAR) END AS short,
      CASE WHEN d = 0 THEN '-' WHEN d < 1 THEN printf('%.0fms', d * 1000) WHEN d < 60 THEN printf('%.1fs', d) WHEN d < 3600 THEN CAST(floor(d / 60) AS INT) || 'm ' || CAST(floor(d % 60) AS INT) || 's'
        ELSE CAST(floor(d / 3600) AS INT) || 'h ' || CAST(floor(d % 3600 / 60) AS INT) || 'm' END AS duration_text,
      CASE WHEN e >= 3600 THEN e // 3600 || 'h ' || e % 3600 // 60 || 'm ' || e % 60 || 's' WHEN e >= 60 THEN e // 60 || 'm ' || e % 60 || 's' ELSE e || 's' END AS elapsed
    FROM (SELECT id, CASE WHEN id % 5 = 0 THEN total_packets WHEN id % 5 = 1 THEN total_packets * 997 ELSE total_bytes END AS b,
                 CAST(total_packets * (CASE WHEN id % 3 = 0 THEN 0 WHEN id % 3 = 1 THEN 1 ELSE 211 END) AS DOUBLE) / 4 AS d, total_packets * (id % 211) AS e FROM connections) x"""))
def b23(s):
    n, i = F.col("total_packets"), F.col("id")
    b = F.when(i % 5 == 0, n).when(i % 5 == 1, n * 997).otherwise(F.col("total_bytes"))
    d = (n * F.when(i % 3 == 0, 0).when(i % 3 == 1, 1).otherwise(211)).cast("double") / 4
    return s.plain_connections.select("id", b.alias("b"), d.alias("d"), (n * (i % 211)).alias("e")).select(
        "id", fmt.bytes_si_text(F.col("b")).alias("si"), fmt.bytes_binary_text(F.col("b")).alias("binary_text"),
        F.concat(*fmt.count_short(F.col("b"))).alias("short"), fmt.duration_short(F.col("d")).alias("duration_text"),
        fmt.duration_long(F.col("e")).alias("elapsed"),
    )


@query("b24_endpoint_text", with_views("connections", """
    SELECT id, CASE WHEN id % 4 = 0 THEN dst_ip ELSE dst_ip || ':' || dst_port END AS dst, CASE WHEN length(dst_ip || '/' || protocol) > 16 THEN substr(dst_ip || '/' || protocol, 1, 13) || '...' ELSE dst_ip || '/' || protocol END AS short FROM connections"""))
def b24(s):
    port = F.when(F.col("id") % 4 == 0, F.lit(0)).otherwise(F.col("dst_port"))
    return s.plain_connections.select(
        "id", fmt.endpoint(F.col("dst_ip"), port).alias("dst"), fmt.cut(F.concat_ws("/", "dst_ip", "protocol"), 16).alias("short")
    )


def _count(name: str, sql: str, build, view: str = "connections"):
    @query(name, with_views(view, f"SELECT count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM {view} WHERE {sql}"))
    def run(s):
        table = s.connections if view == "connections" else s.alerts
        return build(table).agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


_count("p01_session_scope", "session_id = 4", lambda t: Q.in_session(t, 4))
_count("p02_either_side", "src_port = 40007 OR dst_port = 40007", lambda t: t.filter(Q.either_side("src_port", "dst_port", 40007)))
_count("p03_substring", "lower(dst_ip) LIKE '%:4_00%'", lambda t: t.filter(Q.contains_text(F.col("dst_ip"), ":4_00")))
_count("p04_date_range", "start_time >= TIMESTAMP '1996-02-01' AND start_time < TIMESTAMP '1996-03-02'", lambda t: t.filter(Q.not_before("start_time", "1996-02-01") & Q.not_after("start_time", "1996-03-01")))
_count("p05_severity_names", "severity_num = 1", lambda t: t.filter(Q.AlertFilter(severity="high").level()), "alerts")
_count(
    "p06_filter_conjunction", "protocol = 'SSH' AND 22 IN (src_port, dst_port) AND dst_ip LIKE '%2606%' AND session_id = 2 AND tag_text LIKE '%beacon%'",
    lambda t: t.filter(Q.all_of(Q.ConnectionFilter(search="2606", protocol="SSH", port=22, tag="beacon", session_id=2).conditions())),
)


@query("p07_own_traffic", with_views("packets", "SELECT count(*) AS n, CAST(sum(frame_number) AS BIGINT) AS frames FROM packets WHERE k % 10 NOT IN (0, 1, 2)"))
def p07(s):
    k = F.col("k") % 10
    marked = s.packets.withColumns(
        {
            "src_port": F.when(k == 0, 8000).otherwise(F.col("src_port")),
            "dst_port": F.when(k == 1, 5173).otherwise(F.col("dst_port")),
            "dst_ip": F.when(k == 2, "").otherwise(F.col("dst_ip")),
        }
    )
    return marked.filter(Q.shown_in_feed()).agg(F.count("*").alias("n"), F.sum("frame_number").alias("frames"))


@query("p08_multicast_skip", with_views("packets", "SELECT key, count(*) AS n FROM (SELECT list_extract(['ff02::1', '224.0.0.1', '239.1.1.1', 'ffmpeg.example', '8.8.8.8'], k % 5 + 1) AS key FROM packets) x WHERE key IN ('ffmpeg.example', '8.8.8.8') GROUP BY key"))
def p08(s):
    key = F.get(F.array(*map(F.lit, ["ff02::1", "224.0.0.1", "239.1.1.1", "ffmpeg.example", "8.8.8.8"])), F.col("k") % 5)
    rows = s.packets.select(key.alias("key")).filter(~address.is_multicast_key(F.col("key")))
    return rows.groupBy("key").agg(F.count("*").alias("n"))
