"""Checked queries: detectors, baseline and tags."""

from __future__ import annotations

import dataclasses as dc

from pyspark.sql import functions as F

from netloom.catalog.registry import query
from netloom.catalog.views import NETWORKS, PRIVATE_SQL, SEMI_SQL, TRUSTED_SQL, with_views
from netloom.config import BeaconConfig, ExfilConfig, AnomalyConfig, SemiTrustedConfig, Tuning
from netloom.operators import baseline as B, detectors as D
from netloom.operators.beacons import beacon_pairs
from netloom.operators.trust import is_unusual, trust_tier

# thresholds scaled to the given tables
TUNING = Tuning(
    beaconing=BeaconConfig(min_connections=20, cv_threshold=1.05),
    data_exfil=ExfilConfig(threshold_medium_bytes=4_000_000_000, threshold_high_bytes=5_000_000_000),
    semi_trusted=SemiTrustedConfig(exfil_always_alert_bytes=4_500_000_000, suppress_max_bytes=60_000_000),
    traffic_anomaly=AnomalyConfig(multiplier=1.2),
)
AS_OF = "2026-06-01"
_UNUSUAL = "upper(protocol) NOT IN ('TCP', 'UDP', 'TLSV1.2', 'TLSV1.3', 'QUIC', 'HTTP', 'HTTPS', 'DNS')"
_PRIV = PRIVATE_SQL.format("dst_ip")
_TRUST, _SEMI = TRUSTED_SQL.format("dst_ip"), SEMI_SQL.format("dst_ip")
_MB = "printf('%.1f MB', {0} / 1048576.0)"


def history(s):
    return B.baseline(s.plain_connections.filter("session_id <= 4"))


def current(s):
    return s.plain_connections.filter("session_id > 4")


# greedy kept starts by jumping to the next start more than a second later
def _beacon_sql(source: str, key: str, least: int, cv: float) -> str:
    return f"""RECURSIVE WITH f AS ({source}),
    g AS (SELECT src_ip, dst_key, count(*) AS n, arg_min(dst_ip, id) AS first_ip, bool_or({_UNUSUAL}) AS unusual, bool_and(dst_port IN (443, 80)) AS safe FROM f GROUP BY src_ip, dst_key),
    c AS (SELECT * FROM g WHERE n >= {least} AND NOT {TRUSTED_SQL.format('first_ip')} AND NOT ({SEMI_SQL.format('first_ip')} AND NOT unusual AND safe)),
    st AS (SELECT DISTINCT f.src_ip, f.dst_key, epoch_us(f.start_time) AS t0 FROM f JOIN c USING (src_ip, dst_key)),
    nx AS (SELECT src_ip, dst_key, t0, min(t0) OVER (PARTITION BY src_ip, dst_key ORDER BY t0 RANGE BETWEEN 1000001 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM st),
    kept AS (SELECT src_ip, dst_key, min(t0) AS t0 FROM st GROUP BY src_ip, dst_key
             UNION ALL SELECT nx.src_ip, nx.dst_key, nx.nxt FROM kept k JOIN nx ON nx.src_ip = k.src_ip AND nx.dst_key = k.dst_key AND nx.t0 = k.t0 WHERE nx.nxt IS NOT NULL),
    iv AS (SELECT src_ip, dst_key, (t0 - lag(t0) OVER (PARTITION BY src_ip, dst_key ORDER BY t0)) / 1e6 AS gap FROM kept),
    v AS (SELECT src_ip, dst_key, count(*) AS kept, avg(gap) AS mean, stddev_samp(gap) / avg(gap) AS cv FROM iv GROUP BY src_ip, dst_key HAVING count(*) >= {least})
    SELECT DISTINCT f.src_ip, f.dst_ip, f.dst_key, v.kept, round(v.mean * (v.kept - 1), 3) AS span, round(v.cv, 6) AS cv, 'high' AS severity FROM f JOIN v USING (src_ip, dst_key) WHERE v.cv < {cv} AND v.mean >= 1"""


def _shown(df):
    return df.select(
        "src_ip", "dst_ip", "dst_key", "kept", F.round(F.col("mean") * (F.col("kept") - 1), 3).alias("span"), F.round("cv", 6).alias("cv"),
        F.lit("high").alias("severity"),
    )


@query("d01_beaconing", with_views("connections", _beacon_sql("SELECT *, dst_ip AS dst_key FROM connections", "dst_ip", 20, 1.05)))
def d01(s):
    return _shown(beacon_pairs(s.plain_connections, NETWORKS, TUNING))


_BURST = dc.replace(TUNING, beaconing=BeaconConfig(min_connections=8, cv_threshold=0.9))
_DOMAIN = "concat('host', CAST(length(dst_ip) AS VARCHAR(9)), '.example.com')"


@query("d01_beaconing_bursts", with_views("connections", _beacon_sql(
    f"""SELECT id, src_ip, dst_ip, dst_port, protocol, CASE WHEN dst_ip LIKE '203.%' THEN {_DOMAIN} ELSE dst_ip END AS dst_key,
        CASE WHEN total_packets % 17 <> 0 THEN TIMESTAMP '2024-01-01' + to_microseconds(CAST(id * 7919 % 4800000 AS BIGINT) * 1000) END AS start_time FROM connections""",
    "dst_key", 8, 0.9)))
def d01_bursts(s):
    """Starts within 80 minutes, many less than a second apart; names group addresses."""
    micros = (F.col("id") * 7919 % 4800000) * 1000
    base = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    start = F.when(F.col("total_packets") % 17 != 0, base + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (micros / 1e6).cast("decimal(18,6)")))
    flows = s.plain_connections.withColumn("start_time", start)
    names = flows.filter(F.col("dst_ip").startswith("203.")).select(F.col("dst_ip").alias("ip")).distinct()
    names = names.withColumn("domain", F.concat(F.lit("host"), F.length("ip").cast("string"), F.lit(".example.com")))
    return _shown(beacon_pairs(flows, NETWORKS, _BURST, names))


@query("d01_beaconing_flows", with_views("connections", _beacon_sql("SELECT *, dst_ip AS dst_key FROM connections", "dst_ip", 20, 1.05).replace(
    "SELECT DISTINCT f.src_ip, f.dst_ip, f.dst_key, v.kept, round(v.mean * (v.kept - 1), 3) AS span, round(v.cv, 6) AS cv, 'high' AS severity FROM",
    "SELECT f.id, 'beaconing' AS tag, 'high' AS severity, v.kept || ' connections to ' || f.dst_key || ', interval ~' || printf('%.1f', v.mean) || 's (CV=' || printf('%.3f', v.cv) || ')' AS reason FROM")))
def d01_flows(s):
    return D.detect_beaconing(s.plain_connections, NETWORKS, TUNING, scope=())


_EXFIL = f"""
    WITH t AS (SELECT dst_ip, sum(total_bytes) AS b, bool_or({_UNUSUAL}) AS u FROM connections WHERE direction = 'OUTGOING' AND NOT {_PRIV} AND NOT {_TRUST} GROUP BY dst_ip),
    v AS (SELECT dst_ip, CASE WHEN {_SEMI} THEN CASE WHEN b >= 4500000000 THEN CASE WHEN u THEN 'high' ELSE 'medium' END END WHEN b >= 5000000000 THEN 'high' WHEN b >= 4000000000 THEN 'medium' END AS severity,
                 {_MB.format('b')} || ' uploaded to ' || dst_ip || CASE WHEN {_SEMI} THEN ' (semi-trusted)' ELSE '' END AS reason FROM t)"""


@query("d02_data_exfil", with_views("connections", _EXFIL + """
    SELECT id, 'data_exfil' AS tag, v.severity, reason FROM connections c JOIN v USING (dst_ip) WHERE v.severity IS NOT NULL AND direction = 'OUTGOING'"""))
def d02(s):
    return D.detect_data_exfil(s.plain_connections, NETWORKS, TUNING, scope=())


_PER_SESSION = dc.replace(
    TUNING, beaconing=BeaconConfig(min_connections=8, cv_threshold=0.9),
    data_exfil=ExfilConfig(threshold_medium_bytes=600_000_000, threshold_high_bytes=800_000_000),
)


@query("d01_beaconing_per_session", with_views("connections", _beacon_sql(
    "SELECT * REPLACE (session_id || '/' || src_ip AS src_ip), dst_ip AS dst_key FROM connections", "dst_ip", 8, 0.9)))
def d01_sessions(s):
    """Every session judged on its own, in one pass."""
    found = beacon_pairs(s.plain_connections, NETWORKS, _PER_SESSION, scope=("session_id",))
    whole = F.concat_ws("/", F.col("session_id").cast("string"), "src_ip")
    return _shown(found.withColumn("src_ip", whole))


@query("d02_data_exfil_per_session", with_views("connections", _EXFIL
    .replace("SELECT dst_ip, sum", "SELECT session_id, dst_ip, sum").replace("GROUP BY dst_ip)", "GROUP BY session_id, dst_ip)")
    .replace("(SELECT dst_ip, CASE", "(SELECT session_id, dst_ip, CASE").replace("5000000000", "800000000").replace("4000000000", "600000000") + """
    SELECT id, 'data_exfil' AS tag, v.severity, reason FROM connections c JOIN v USING (session_id, dst_ip) WHERE v.severity IS NOT NULL AND direction = 'OUTGOING'"""))
def d02_sessions(s):
    return D.detect_data_exfil(s.plain_connections, NETWORKS, _PER_SESSION)


_NEW = f"""id, 'new_dest' AS tag, '{{sev}}' AS severity, 'First connection to ' || dst_ip AS reason FROM connections c
    WHERE session_id > 4 AND NOT {_PRIV} AND NOT {_TRUST} AND dst_ip NOT IN (SELECT dst_ip FROM connections WHERE session_id <= 4 AND dst_ip NOT LIKE '%1')
      AND NOT ({_SEMI} AND total_bytes < 60000000 AND NOT {_UNUSUAL})"""


def _partly_known(s):
    return history(s).filter(~F.col("ip").endswith("1"))


@query("d03_new_destination", with_views("connections", "SELECT " + _NEW.format(sev="low") + " AND dst_port NOT IN (443, 80)"))
def d03(s):
    return D.detect_new_destination(current(s), _partly_known(s), NETWORKS, AS_OF, TUNING)


@query("d05_new_destination_learning", with_views("connections", "SELECT " + _NEW.format(sev="info")))
def d05(s):
    """Within 30 days of deployment findings are informational."""
    return D.detect_new_destination(current(s), _partly_known(s), NETWORKS, "2026-03-15", TUNING)


_KNOWN = """obs AS (SELECT session_id, dst_ip, CAST(sum(total_bytes) AS DOUBLE) AS b, min(start_time) AS seen FROM connections WHERE session_id <= 4 GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY dst_ip ORDER BY session_id) AS n FROM obs),
    known AS (SELECT dst_ip AS ip, min(seen) AS first_seen, CAST(count(*) AS INT) AS session_count, CASE WHEN count(*) = 1 THEN max(b) ELSE avg(b) FILTER (n > 1) END AS mean FROM r GROUP BY dst_ip)"""
_ODD = f"""
    WITH {_KNOWN}, t AS (SELECT dst_ip, sum(total_bytes) AS b, bool_or({_UNUSUAL}) AS u FROM connections WHERE session_id > 4 AND NOT {_PRIV} AND NOT {_TRUST} GROUP BY dst_ip),
    v AS (SELECT dst_ip, dst_ip || ': ' || {_MB.format('b')} || ' this session vs ' || {_MB.format('mean')} || ' average (' || printf('%.1f', b / mean) || '×)' AS reason
          FROM t JOIN known ON ip = dst_ip WHERE b >= 10485760 AND NOT ({_SEMI} AND b < 60000000 AND NOT u) AND session_count >= 2 AND mean >= 1024 AND b / mean >= 1.2)"""


@query("d04_traffic_anomaly", with_views("connections", _ODD + """
    SELECT id, 'traffic_anomaly' AS tag, 'medium' AS severity, reason FROM connections JOIN v USING (dst_ip) WHERE session_id > 4"""))
def d04(s):
    return D.detect_traffic_anomaly(current(s), history(s), NETWORKS, TUNING, scope=())


_ODD_SESSIONS = (_ODD.replace("t AS (SELECT dst_ip, sum", "t AS (SELECT session_id, dst_ip, sum")
    .replace("GROUP BY dst_ip),\n    v AS (SELECT dst_ip, dst_ip", "GROUP BY session_id, dst_ip),\n    v AS (SELECT session_id, dst_ip, dst_ip"))


@query("d04_traffic_anomaly_per_session", with_views("connections", _ODD_SESSIONS + """
    SELECT id, 'traffic_anomaly' AS tag, 'medium' AS severity, reason FROM connections JOIN v USING (session_id, dst_ip) WHERE session_id > 4"""))
def d04_sessions(s):
    """The default: every session on its own."""
    return D.detect_traffic_anomaly(current(s), history(s), NETWORKS, TUNING)


@query("d06_trust_tiers", with_views("connections", f"""
    SELECT dst_ip, CASE WHEN {_TRUST} THEN 'trusted' WHEN {_SEMI} THEN 'semi_trusted' END AS tier FROM connections GROUP BY dst_ip"""))
def d06(s):
    return s.plain_connections.select("dst_ip").distinct().withColumn("tier", trust_tier(F.col("dst_ip"), NETWORKS))


@query("d07_unusual_protocol", with_views("connections", f"SELECT protocol, count(*) AS flows FROM connections WHERE {_UNUSUAL} GROUP BY protocol"))
def d07(s):
    flows = s.plain_connections.filter(is_unusual(F.col("protocol"), SemiTrustedConfig()))
    return flows.groupBy("protocol").agg(F.count("*").alias("flows"))


_CUR = "SELECT *, dst_ip AS dst_key FROM connections WHERE session_id > 4"
_TAG_TUNING = dc.replace(TUNING, beaconing=BeaconConfig(min_connections=20, cv_threshold=1.05), data_exfil=ExfilConfig(threshold_medium_bytes=1_000_000_000, threshold_high_bytes=1_300_000_000))


def _tag_sql() -> str:
    beacon = _beacon_sql(_CUR, "dst_ip", 20, 1.05).removeprefix("RECURSIVE WITH ")
    head, _, _ = beacon.rpartition("SELECT DISTINCT f.src_ip")
    return f"""RECURSIVE WITH {head.rstrip()},
    bp AS (SELECT src_ip, dst_key AS dst_ip FROM v WHERE v.cv < 1.05 AND v.mean >= 1),
    {_KNOWN.replace('r AS', 'ro AS').replace('FROM r ', 'FROM ro ')},
    pt AS (SELECT ip FROM known WHERE ip NOT LIKE '%1'),
    xt AS (SELECT dst_ip, sum(total_bytes) FILTER (direction = 'OUTGOING') AS ob, bool_or({_UNUSUAL}) FILTER (direction = 'OUTGOING') AS ou, sum(total_bytes) AS b, bool_or({_UNUSUAL}) AS u
           FROM f WHERE NOT {_PRIV} AND NOT {_TRUST} GROUP BY dst_ip),
    xv AS (SELECT dst_ip, CASE WHEN {_SEMI} THEN CASE WHEN ob >= 4500000000 THEN CASE WHEN ou THEN 'high' ELSE 'medium' END END WHEN ob >= 1300000000 THEN 'high' WHEN ob >= 1000000000 THEN 'medium' END AS sev FROM xt),
    ov AS (SELECT dst_ip FROM xt JOIN known ON ip = dst_ip WHERE ip NOT LIKE '%1' AND b >= 10485760 AND NOT ({_SEMI} AND b < 60000000 AND NOT u) AND session_count >= 2 AND mean >= 1024 AND b / mean >= 1.2),
    m AS (SELECT f.*, bp.src_ip IS NOT NULL AS t1, CASE WHEN direction = 'OUTGOING' THEN xv.sev END AS t2,
            xt.dst_ip IS NOT NULL AND f.dst_ip NOT IN (SELECT ip FROM pt) AND NOT (({SEMI_SQL.format('f.dst_ip')}) AND total_bytes < 60000000 AND NOT {_UNUSUAL}) AND dst_port NOT IN (443, 80) AS t3,
            ov.dst_ip IS NOT NULL AS t4
          FROM f LEFT JOIN bp ON bp.src_ip = f.src_ip AND bp.dst_ip = f.dst_ip LEFT JOIN xv ON xv.dst_ip = f.dst_ip LEFT JOIN xt ON xt.dst_ip = f.dst_ip LEFT JOIN ov ON ov.dst_ip = f.dst_ip)
    SELECT id, concat_ws(',', CASE WHEN t1 THEN 'beaconing' END, CASE WHEN t2 IS NOT NULL THEN 'data_exfil' END, CASE WHEN t3 THEN 'new_dest' END, CASE WHEN t4 THEN 'traffic_anomaly' END) AS tags,
           CASE WHEN t1 OR t2 = 'high' THEN 'high' WHEN t2 = 'medium' OR t4 THEN 'medium' WHEN t3 THEN 'low' ELSE '' END AS severity FROM m"""


def tagged(s):
    ctx = D.Context(_partly_known(s), NETWORKS, AS_OF, _TAG_TUNING, scope=())
    return D.tag_flows(current(s), ctx)


@query("d08_tag_assembly", with_views("connections", _tag_sql()))
def d08(s):
    return tagged(s).select("id", F.array_join("tags", ",").alias("tags"), "severity")


_ALL_KNOWN = _KNOWN.replace(" WHERE session_id <= 4", "")


@query("d09_baseline", with_views("connections", f"WITH {_ALL_KNOWN} SELECT ip, first_seen, session_count, round(mean, 2) AS total_bytes_avg FROM known"))
def d09(s):
    return B.baseline(s.plain_connections).withColumn("total_bytes_avg", F.round("total_bytes_avg", 2))


@query("d09_baseline_incremental", with_views("connections", f"WITH {_ALL_KNOWN} SELECT ip, first_seen, session_count, round(mean, 2) AS total_bytes_avg FROM known"))
def d09_incremental(s):
    """All sessions up to the second last at once, then the last two one by one."""
    flows = s.plain_connections
    last = flows.agg(F.max("session_id")).first()[0]
    known = B.baseline(flows.filter(F.col("session_id") <= last - 2))
    for session in (last - 1, last):
        known = B.update_baseline(known, flows.filter(F.col("session_id") == session))
    return known.withColumn("total_bytes_avg", F.round("total_bytes_avg", 2))


@query("d10_known_destinations", with_views("connections", "SELECT DISTINCT dst_ip AS ip FROM connections WHERE session_id > 4 AND dst_ip IN (SELECT dst_ip FROM connections WHERE session_id <= 4) AND dst_ip NOT LIKE '%1'"))
def d10(s):
    return B.known_among(current(s).select(F.col("dst_ip").alias("ip")), _partly_known(s))


@query("d11_baseline_means", with_views("connections", f"WITH {_ALL_KNOWN} SELECT ip, round(mean, 2) AS total_bytes_avg FROM known WHERE session_count >= 2"))
def d11(s):
    return B.destination_means(B.baseline(s.plain_connections)).withColumn("total_bytes_avg", F.round("total_bytes_avg", 2))
