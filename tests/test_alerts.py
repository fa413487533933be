import pytest
from pyspark.sql import functions as F

from netloom.operators import alerts as E, reputation as H
from netloom.sources.ids import parse_ids_lines, read_ids_events
from netloom.sources.networks import DEFAULT_LIMITS, DEFAULT_SUPPRESS, RateLimit

SCHEMA = (
    "id bigint, timestamp timestamp_ntz, severity string, severity_num int, signature string, "
    "signature_id bigint, src_ip string, dst_ip string, src_port int, dst_port int"
)


def alerts(spark, signatures, **other):
    rows = []
    for i, sig in enumerate(signatures):
        row = dict(id=i, timestamp=None, severity="MEDIUM", severity_num=3, signature=sig, signature_id=1,
                   src_ip="10.0.0.1", dst_ip="8.8.8.8", src_port=1, dst_port=22)
        row.update(other)
        rows.append(tuple(row.values()))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("signature", ["ET_SCAN x", "ET SCAN x", "et-scan x"])
def test_separators_and_case_do_not_matter(spark, signature):
    row = E.apply_ids_rules(alerts(spark, [signature])).first()
    assert (row.severity, row.severity_num) == ("HIGH", 1)


def test_protected_alerts_survive_suppression(spark):
    rules = E.AlertRules(signatures=(("ET", "SUPPRESS"),))
    kept = E.apply_ids_rules(alerts(spark, ["ET MALWARE x", "ET other", "plain"]), rules).collect()
    assert [(r.signature, r.severity, r.severity_num) for r in kept] == [("ET MALWARE x", "MEDIUM", 3), ("plain", "MEDIUM", 2)]


def test_protected_pair_and_id(spark):
    pair = alerts(spark, ["x"], src_ip="10.9.8.7", dst_ip="10.9.8.6")
    rules = E.AlertRules(protected_pairs=(("10.9.8.7", "10.9.8.6", 22),))
    assert pair.filter(E.is_protected()).count() == 0
    assert pair.filter(E.is_protected(rules)).count() == 1
    assert pair.withColumn("dst_port", F.lit(23)).filter(E.is_protected(rules)).count() == 0
    assert alerts(spark, ["x"], signature_id=2001219).filter(E.is_protected()).count() == 1
    assert alerts(spark, ["seen via abc2::1"]).filter(E.is_protected()).count() == 1  # plain substring


def test_vendor_signatures_keep_their_level_without_a_sensor(spark):
    names = ["ET INFO Possible Port Scanner User-Agent", "ET POLICY Brute Force Tool Download", "GPL SCAN x", "xx brute_force y"]
    got = [r[0] for r in alerts(spark, names).select(E.remapped_signature()).collect()]
    assert got == ["LOW", "LOW", "MEDIUM", "MEDIUM"]


def test_event_times_with_offsets(spark):
    from netloom.sources.ids import event_time

    texts = ["2024-01-01T10:00:00.000000+0530", "2024-01-01T10:00:00-0800", "2024-01-01T10:00:00.5Z", "2024-01-01T10:00:00",
             "2024-01-01 10:00:00.123456+01:00", "2024-01-01", "nonsense", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [str(r[0]) for r in df.orderBy("i").select(event_time(F.col("t"))).collect()]
    assert got == ["2024-01-01 04:30:00", "2024-01-01 18:00:00", "2024-01-01 10:00:00.500000", "2024-01-01 10:00:00",
                   "2024-01-01 09:00:00.123456", "2024-01-01 00:00:00", "None", "None"]


def test_rate_limit_takes_large_ids(spark):
    df = alerts(spark, ["a", "a", "b"], signature_id=5_000_000_000).withColumn("timestamp", F.lit("2024-01-01").cast("timestamp_ntz"))
    assert E.limit_rate(df, [RateLimit(5_000_000_000, "by_src", 1, 60)]).count() == 1


def test_sensor_word(spark):
    rules = E.AlertRules(sensor="SENSOR")
    df = alerts(spark, ["SENSOR BRUTE-FORCE x", "other BRUTE-FORCE x"])
    got = [r[0] for r in df.select(E.remapped_signature(rules)).collect()]
    assert got == ["HIGH", "MEDIUM"]


def test_reclassification_is_idempotent_and_later_rules_win(spark):
    df = alerts(spark, ["ET INFO New Destination", "SURICATA GNU/Linux APT", "xx BRUTE y FORCE", "none"])
    once = E.reclassify(df)
    got = [(r.severity, r.severity_num) for r in once.collect()]
    assert got == [("LOW", 3), ("LOW", 3), ("HIGH", 1), ("MEDIUM", 2)]
    assert [tuple(r) for r in E.reclassify(once).collect()] == [tuple(r) for r in once.collect()]


def test_default_suppress_rules(spark):
    df = alerts(spark, ["a"], signature_id=2027865, dst_ip="104.16.9.9").unionByName(
        alerts(spark, ["b"], dst_ip="64:ff9b::808:808")
    ).unionByName(alerts(spark, ["c"], dst_ip="104.16.9.9"))
    assert [r.signature for r in E.suppress_by_network(df, DEFAULT_SUPPRESS).collect()] == ["c"]


def test_rate_limit(spark):
    rows = [(i, f"2024-01-01 00:00:{s:02d}", "10.0.0.1" if i % 2 else "10.0.0.2") for i, s in enumerate([1, 2, 3, 4, 5, 6])]
    df = alerts(spark, ["x"] * 6, signature_id=7)
    times = spark.createDataFrame(rows, "id bigint, t string, who string")
    df = df.join(times, "id").withColumn("timestamp", F.col("t").cast("timestamp_ntz")).withColumn("src_ip", F.col("who"))
    kept = E.limit_rate(df, [RateLimit(7, "by_src", 1, 60)])
    assert sorted(r.id for r in kept.collect()) == [0, 1]
    assert E.limit_rate(df, [RateLimit(7, "by_dst", 2, 5)]).count() == 4  # windows 0-5 and 5-10
    assert E.limit_rate(df, DEFAULT_LIMITS).count() == 6


def test_event_lines(spark, tmp_path):
    lines = [
        '{"timestamp": "2024-01-01T10:00:00.5+0000", "event_type": "alert", "src_ip": "1.1.1.1", "dest_ip": "2.2.2.2", "alert": {"severity": 2, "signature": "S"}}',
        '{"event_type": "alert", "alert": {"signature_id": 5}}', '{"event_type": "flow", "alert": {"severity": 1}}',
        '{"event_type": "alert", "alert": {}}', '{"event_type": "alert"}', "not json", "",
    ]
    path = tmp_path / "eve.json"
    path.write_text("\n".join(lines))
    for df in (read_ids_events(spark, str(path)), parse_ids_lines(spark.read.text(str(path)))):
        rows = df.collect()
        assert [(r.severity, r.severity_num, r.signature, r.signature_id, r.src_port, r.action) for r in rows] == [
            ("HIGH", 2, "S", 0, 0, "allowed"), ("MEDIUM", 3, "Unknown", 5, 0, "allowed"),
        ]
        assert str(rows[0].timestamp) == "2024-01-01 10:00:00.500000"


def test_rule_files(tmp_path):
    pytest.importorskip("yaml")
    remap, protect = tmp_path / "r.yaml", tmp_path / "p.yaml"
    remap.write_text("behavioral:\n  new_dest: {severity: SUPPRESS}\nsuricata:\n  ET_X: {severity: LOW}\n")
    protect.write_text("protected_sids:\n  - {sid: 5}\nprotected_categories:\n  - {match_signature: ABC}\nprotected_ip_pairs:\n  - {source: a, destination: b}\n")
    rules = E.load_rules(str(remap), str(protect))
    assert rules.behaviour == (("new_dest", "SUPPRESS"),) and rules.signatures == (("ET_X", "LOW"),)
    assert rules.protected_ids == (5,) and rules.protected_pairs == (("a", "b", None),) and rules.protected_keywords == ("ABC",)


def test_reputation_takes_the_newest_check(spark):
    schema = "ip string, abuse_score int, country string, isp string, is_malicious boolean, last_checked timestamp_ntz"
    old = spark.createDataFrame([("1.1.1.1", 90, "A", "x", True, None), ("2.2.2.2", 10, "B", "y", False, None)], schema)
    new = spark.createDataFrame([("1.1.1.1", 50, "C", "z", None, None)], schema)
    got = {r.ip: (r.abuse_score, r.is_malicious) for r in H.upsert_reputation(old, new).collect()}
    assert got == {"1.1.1.1": (50, False), "2.2.2.2": (10, False)}
