"""Checked queries: alert rules and reputation."""

from __future__ import annotations

from pyspark.sql import functions as F

from netloom.catalog.detect import _tag_sql, tagged
from netloom.catalog.registry import query
from netloom.catalog.views import PRIVATE_SQL, with_views
from netloom.operators import alerts as E, reputation as H
from netloom.sources.networks import RateLimit, SuppressRule

_FINDINGS = _tag_sql().rpartition("SELECT id, concat_ws")[0].rstrip() + """,
    fx AS (SELECT *, unnest(list_filter([CASE WHEN t1 THEN 'beaconing' END, CASE WHEN t2 IS NOT NULL THEN 'data_exfil' END, CASE WHEN t3 THEN 'new_dest' END, CASE WHEN t4 THEN 'traffic_anomaly' END], lambda x: x IS NOT NULL)) AS tag FROM m),
    al AS (SELECT * FROM fx QUALIFY row_number() OVER (PARTITION BY session_id, dst_ip, tag ORDER BY id) = 1)"""


@query("e01_tags_to_alerts", with_views("connections", _FINDINGS + """
    SELECT session_id, tag, dst_ip, src_ip, src_port, dst_port, protocol AS proto, 'Behavioral: ' || tag AS category,
           CASE tag WHEN 'beaconing' THEN 'HIGH' WHEN 'data_exfil' THEN upper(t2) WHEN 'new_dest' THEN 'LOW' ELSE 'MEDIUM' END AS severity,
           CASE tag WHEN 'beaconing' THEN 'BEHAVIOR Beaconing Detected — ' WHEN 'data_exfil' THEN 'BEHAVIOR Data Exfiltration — ' WHEN 'new_dest' THEN 'BEHAVIOR New Destination — ' ELSE 'BEHAVIOR Traffic Anomaly — ' END AS title FROM al"""))
def e01(s):
    alerts = E.alerts_from_tags(tagged(s))
    title = F.regexp_extract("signature", "^(.* — )", 1)
    return alerts.select(
        "session_id", "tag", "dst_ip", "src_ip", "src_port", "dst_port", "proto", "category", "severity", title.alias("title")
    )


@query("e02_behaviour_remap", with_views("connections", _FINDINGS + """
    SELECT session_id, tag, dst_ip, CASE tag WHEN 'data_exfil' THEN 'HIGH' WHEN 'new_dest' THEN 'LOW' ELSE 'MEDIUM' END AS severity,
           CASE tag WHEN 'data_exfil' THEN 1 WHEN 'new_dest' THEN 3 ELSE 2 END AS severity_num FROM al"""))
def e02(s):
    return E.behaviour_alerts(tagged(s)).select("session_id", "tag", "dst_ip", "severity", "severity_num")


_SAFE = "(signature ILIKE '%BRUTE-FORCE SSH%' OR signature ILIKE '%MALWARE%' OR signature ILIKE '%EXPLOIT%' OR signature ILIKE '%LATERAL%' OR signature ILIKE '%C2%')"
# without a sensor word only the public rule sets' own prefixes count
_REMAP = """CASE WHEN signature LIKE '%ET SCAN%' THEN 'HIGH' WHEN signature LIKE '%SURICATA%' OR signature LIKE '%ET FILE_SHARING%' THEN 'MEDIUM'
    WHEN signature LIKE '%ET INFO%' OR signature LIKE '%ET POLICY%' OR signature LIKE '%ET DNS%' THEN 'LOW' ELSE severity END"""


@query("e03_signature_remap", with_views("alerts", f"SELECT id, {_REMAP} AS remapped FROM alerts"))
def e03(s):
    return s.alerts.select("id", E.remapped_signature().alias("remapped"))


_SENSOR = E.AlertRules(sensor="BEHAVIOR", signatures=(("{sensor}BEACONING", "HIGH"), *E.AlertRules().signatures))


@query("e03_signature_remap_sensor", with_views("alerts", f"SELECT id, CASE WHEN signature LIKE '%BEHAVIOR Beaconing%' THEN 'HIGH' ELSE {_REMAP} END AS remapped FROM alerts"))
def e03_sensor(s):
    """A local rule set's own signatures, which begin with its word."""
    return s.alerts.select("id", E.remapped_signature(_SENSOR).alias("remapped"))


@query("e04_protected_alerts", with_views("alerts", f"SELECT id FROM alerts WHERE {_SAFE} OR signature_id = 2027760 OR (src_ip = '10.0.0.1' AND dst_ip = '142.250.1.1' AND dst_port = 22)"))
def e04(s):
    rules = E.AlertRules(protected_ids=(2027760,), protected_pairs=(("10.0.0.1", "142.250.1.1", 22),))
    return s.alerts.filter(E.is_protected(rules)).select("id")


@query("e05_suppression", with_views("alerts", f"""
    SELECT id, CASE WHEN {_SAFE} THEN severity ELSE r END AS severity, CASE WHEN {_SAFE} THEN severity_num ELSE CASE r WHEN 'HIGH' THEN 1 WHEN 'CRITICAL' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END END AS severity_num
    FROM (SELECT *, {_REMAP} AS r FROM alerts) a WHERE {_SAFE} OR signature NOT LIKE '%ET POLICY%'"""))
def e05(s):
    """Policy alerts are dropped, the rest remapped, protected ones untouched."""
    base = E.AlertRules()
    rules = E.AlertRules(signatures=(("ET_POLICY", "SUPPRESS"), *base.signatures))
    return E.apply_ids_rules(s.alerts, rules).select("id", "severity", "severity_num")


def _cascade(alias: str) -> str:
    """The rules one after the other, as a row of updates would do."""
    value = f"{alias}"
    for severity, _, pattern in E.RECLASSIFICATION:
        value = f"CASE WHEN signature ILIKE '{pattern}' THEN '{severity}' ELSE {value} END"
    return value


@query("e06_reclassification", with_views("alerts", f"""
    SELECT id, s AS severity, CASE WHEN s = 'LOW' THEN 3 WHEN s = 'MEDIUM' THEN 2 ELSE 1 END AS severity_num FROM (SELECT id, {_cascade('severity')} AS s FROM alerts) a"""))
def e06(s):
    return E.reclassify(s.alerts).select("id", "severity", "severity_num")


_SUPPRESS = (
    SuppressRule(2027790, "by_dst", "142.250.0.0/15"), SuppressRule(0, "by_dst", "104.16.0.0/12"),
    SuppressRule(2027801, "by_src", "10.0.0.0/30"),
)


@query("e07_suppress_by_network", with_views("alerts", """
    SELECT id FROM alerts WHERE NOT (signature_id = 2027790 AND dst_ip LIKE '142.250.%') AND NOT dst_ip LIKE '104.16.%' AND NOT (signature_id = 2027801 AND src_ip IN ('10.0.0.1', '10.0.0.2', '10.0.0.3'))"""))
def e07(s):
    return E.suppress_by_network(s.alerts, _SUPPRESS).select("id")


_LIMITS = tuple(RateLimit(2027750 + k, "by_src" if k % 2 else "by_dst", 1 + k % 3, 86400) for k in range(60))


@query("e08_rate_limit", with_views("alerts", """
    SELECT id FROM (SELECT id, signature_id - 2027750 AS k, row_number() OVER (PARTITION BY signature_id, CASE WHEN signature_id % 2 = 1 THEN src_ip ELSE dst_ip END, epoch_us(timestamp) // 86400000000 ORDER BY timestamp, id) AS n FROM alerts) a
    WHERE k >= 60 OR n <= 1 + k % 3"""))
def e08(s):
    return E.limit_rate(s.alerts, _LIMITS).select("id")


@query("e09_ids_severity", with_views("alerts", "SELECT severity_num AS number, severity, count(*) AS n FROM alerts GROUP BY 1, 2 UNION ALL SELECT severity_num + 4, 'LOW', count(*) FROM alerts GROUP BY 1"))
def e09(s):
    number = F.explode(F.array(F.col("severity_num"), F.col("severity_num") + 4))
    rows = s.alerts.select(number.alias("number")).groupBy("number").agg(F.count("*").alias("n"))
    return rows.withColumn("severity", E.ids_severity(F.col("number")))


@query("e10_severity_counts", with_views("alerts", """
    SELECT count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'MEDIUM') AS medium, count(*) FILTER (severity = 'LOW') AS low FROM alerts"""))
def e10(s):
    return E.severity_counts(s.alerts)


@query("h01_reputation_upsert", with_views("reputation connections", """
    WITH c AS (SELECT dst_ip AS ip, CAST(count(*) % 101 AS INT) AS score FROM connections WHERE dst_ip LIKE '2%' GROUP BY dst_ip)
    SELECT coalesce(c.ip, r.ip) AS ip, coalesce(c.score, r.abuse_score) AS abuse_score, coalesce(c.score, r.abuse_score) > 50 AS is_malicious,
           CASE WHEN c.ip IS NULL THEN r.last_checked ELSE TIMESTAMP '2024-02-01 00:00:00' END AS last_checked FROM reputation r FULL JOIN c ON c.ip = r.ip"""))
def h01(s):
    checked = s.plain_connections.filter(F.col("dst_ip").startswith("2")).groupBy(F.col("dst_ip").alias("ip")).agg(
        (F.count("*") % 101).cast("int").alias("abuse_score")
    )
    checked = checked.withColumns(
        {"country": F.lit("DE"), "isp": F.lit("x"), "last_checked": F.lit("2024-02-01").cast("timestamp_ntz")}
    )
    return H.upsert_reputation(s.reputation, checked).select("ip", "abuse_score", "is_malicious", "last_checked")


@query("h02_ips_to_check", with_views("packets reputation", f"""
    SELECT ip FROM (SELECT src_ip AS ip FROM packets UNION SELECT dst_ip FROM packets) p WHERE NOT {PRIVATE_SQL.format('ip')} AND ip NOT IN (SELECT ip FROM reputation WHERE abuse_score % 2 = 0)"""))
def h02(s):
    return H.ips_to_check(s.packets, s.reputation.filter("abuse_score % 2 = 0"))


@query("h03_verdicts", with_views("reputation", """
    SELECT ip, CASE WHEN ip LIKE '192.168.%' THEN 'PRIVATE' WHEN abuse_score > 50 THEN 'MALICIOUS' WHEN abuse_score > 20 THEN 'SUSPICIOUS' ELSE 'CLEAN' END AS verdict,
      CASE WHEN abuse_score >= 75 THEN 'MALICIOUS' WHEN abuse_score >= 50 THEN 'SUSPICIOUS' WHEN abuse_score >= 25 THEN 'LOW RISK' ELSE 'CLEAN' END AS report FROM reputation"""))
def h03(s):
    score = F.col("abuse_score")
    return s.reputation.select("ip", H.verdict(F.col("ip"), score).alias("verdict"), H.verdict_report(score).alias("report"))


@query("h04_cache_validity", with_views("alerts", "SELECT id FROM alerts WHERE timestamp > TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 300 SECOND"))
def h04(s):
    checked = s.alerts.withColumn("last_checked", F.col("timestamp"))
    return H.still_valid(checked, "2024-01-15 12:00:00").select("id")


@query("h05_flow_enrichment", with_views("packets reputation", """
    SELECT frame_number, s.abuse_score AS src_abuse_score, d.abuse_score AS dst_abuse_score, s.is_malicious AS src_is_malicious, d.is_malicious AS dst_is_malicious
    FROM packets p LEFT JOIN reputation s ON s.ip = p.src_ip LEFT JOIN reputation d ON d.ip = p.dst_ip"""))
def h05(s):
    return H.enrich(s.packets, s.reputation).select(
        "frame_number", "src_abuse_score", "dst_abuse_score", "src_is_malicious", "dst_is_malicious"
    )
