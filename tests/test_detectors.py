import dataclasses as dc

import pytest
from pyspark.sql import functions as F

from helpers import flow, flows, known
from netloom.config import Tuning, load_tuning, tuning_from_dict
from netloom.operators import baseline as B, detectors as D
from netloom.operators.alerts import alerts_from_tags, behaviour_alerts
from netloom.sources.networks import Networks

NETS = Networks()
MB = 1024 * 1024
LATER = "2026-06-01"


def severities(df):
    return {r.id: r.severity for r in df.collect()}


@pytest.mark.parametrize(
    "dst,size,protocol,direction,severity",
    [
        ("203.0.113.1", 209715199, "TCP", "OUTGOING", None), ("203.0.113.1", 209715200, "TCP", "OUTGOING", "medium"),
        ("203.0.113.1", 524288000, "TCP", "OUTGOING", "high"), ("203.0.113.1", 524288000, "TCP", "INCOMING", None),
        ("104.16.2.1", 52428800, "TCP", "OUTGOING", "medium"), ("104.16.2.1", 52428800, "GRE", "OUTGOING", "high"),
        ("104.16.2.1", 52428799, "GRE", "OUTGOING", None), ("142.250.1.1", 10**12, "TCP", "OUTGOING", None),
        ("10.9.9.9", 10**12, "TCP", "OUTGOING", None),
    ],
)
def test_exfil_bounds(spark, dst, size, protocol, direction, severity):
    rows = [flow(1, dst=dst, total_bytes=size - 1, protocol=protocol, direction=direction), flow(2, dst=dst, total_bytes=1, direction=direction)]
    got = severities(D.detect_data_exfil(flows(spark, rows), NETS))
    assert got == ({} if severity is None else {1: severity, 2: severity})


def test_exfil_reason(spark):
    row = D.detect_data_exfil(flows(spark, [flow(1, dst="104.16.2.1", total_bytes=60 * MB)]), NETS).first()
    assert row.reason == "60.0 MB uploaded to 104.16.2.1 (semi-trusted)" and row.tag == "data_exfil"


@pytest.mark.parametrize(
    "count,mean,size,found",
    [(1, 2.0 * MB, 12 * MB, 0), (2, 1023.0, 12 * MB, 0), (2, 4.0 * MB, int(19.96 * MB), 0), (2, 4.0 * MB, 20 * MB, 1), (2, 1.0 * MB, 9 * MB, 0)],
)
def test_anomaly_bounds(spark, count, mean, size, found):
    base = known(spark, [("203.0.113.1", None, count, mean)])
    got = D.detect_traffic_anomaly(flows(spark, [flow(1, dst="203.0.113.1", total_bytes=size)]), base, NETS)
    assert got.count() == found


def test_anomaly_reason(spark):
    base = known(spark, [("203.0.113.1", None, 3, 4.0 * MB)])
    row = D.detect_traffic_anomaly(flows(spark, [flow(1, dst="203.0.113.1", total_bytes=20 * MB)]), base, NETS).first()
    assert row.reason == "203.0.113.1: 20.0 MB this session vs 4.0 MB average (5.0×)"


def test_new_destinations(spark):
    rows = [
        flow(1, dst="203.0.113.1", dst_port=22), flow(2, dst="203.0.113.1", dst_port=443), flow(3, dst="203.0.113.2", dst_port=22),
        flow(4, dst="142.250.1.1", dst_port=22), flow(5, dst="104.16.2.1", dst_port=22), flow(6, dst="104.16.2.1", dst_port=22, protocol="SSH"),
        flow(7, dst="104.16.2.1", dst_port=22, total_bytes=11 * MB), flow(8, dst="10.0.0.9", dst_port=22), flow(9, dst="203.0.113.3", dst_port=None),
    ]
    base = known(spark, [("203.0.113.2", None, 1, 5.0)])
    df = flows(spark, rows)
    late = D.detect_new_destination(df, base, NETS, LATER)
    assert severities(late) == {1: "low", 6: "low", 7: "low", 9: "low"}
    early = D.detect_new_destination(df, base, NETS, "2026-03-05")
    assert severities(early) == dict.fromkeys([1, 2, 6, 7, 9], "info")


def test_learning_period():
    t = Tuning()
    assert t.learning("2026-03-30") and not t.learning("2026-03-31")
    for text in ("", "yesterday", None):
        general = dc.replace(t.general, deployment_date=text)
        assert dc.replace(t, general=general).learning("2030-01-01")


def test_tuning_file(tmp_path):
    pytest.importorskip("yaml")
    path = tmp_path / "t.yaml"
    path.write_text("beaconing:\n  min_connections: 7\n  unknown: 1\nsemi_trusted:\n  beaconing_safe_ports: [443]\n")
    t = load_tuning(str(path))
    assert t.beaconing.min_connections == 7 and t.semi_trusted.beaconing_safe_ports == (443,)
    assert load_tuning(str(tmp_path / "none")) == Tuning() == tuning_from_dict({})


def test_tags_in_order_with_highest_severity(spark):
    rows = [flow(i, at=i * 60.0, dst_port=22, total_bytes=30 * MB) for i in range(20)] + [flow(50, dst="10.0.0.7")]
    tagged = D.tag_flows(flows(spark, rows), D.Context(known(spark), NETS, LATER))
    by_id = {r.id: r for r in tagged.collect()}
    assert by_id[3].tags == ["beaconing", "data_exfil", "new_dest"] and by_id[3].severity == "high"
    assert by_id[50].tags == [] and by_id[50].severity == ""
    alerts = alerts_from_tags(tagged).collect()
    assert sorted(a.tag for a in alerts) == ["beaconing", "data_exfil", "new_dest"]
    assert {a.src_port for a in alerts} == {40000}
    remapped = {a.tag: (a.severity, a.severity_num) for a in behaviour_alerts(tagged).collect()}
    assert remapped == {"beaconing": ("MEDIUM", 2), "data_exfil": ("HIGH", 1), "new_dest": ("LOW", 3)}


def test_info_ranks_below_low(spark):
    rows = [("a", [("x", "info", ""), ("y", "low", "")]), ("b", [("x", "info", "")]), ("c", [("x", "info", ""), ("y", "info", "")])]
    df = spark.createDataFrame(rows, "k string, findings array<struct<tag string, severity string, reason string>>")
    got = {r.k: r.severity for r in D.assemble(df).collect()}
    assert got == {"a": "low", "b": "info", "c": "info"}


def test_detectors_agree_with_assembled_tags(spark):
    rows = [flow(i, dst=f"203.0.113.{i % 5}", at=i * 7.0, dst_port=22 + i % 3, total_bytes=(i % 9) * 9 * MB) for i in range(150)]
    df = flows(spark, rows)
    base = known(spark, [("203.0.113.1", None, 3, 2.0 * MB), ("203.0.113.2", None, 1, 1.0)])
    parts = [
        D.detect_beaconing(df, NETS), D.detect_data_exfil(df, NETS), D.detect_new_destination(df, base, NETS, LATER),
        D.detect_traffic_anomaly(df, base, NETS),
    ]
    single = {(r.id, r.tag, r.severity, r.reason) for p in parts for r in p.collect()}
    tagged = D.tag_flows(df, D.Context(base, NETS, LATER)).select("id", F.explode("findings").alias("f"))
    assert {(r.id, r.f.tag, r.f.severity, r.f.reason) for r in tagged.collect()} == single and len(single) > 150


def test_rolling_mean(spark):
    sizes = [100, 10, 20, 60]
    means, table = [], known(spark)
    for session, size in enumerate(sizes, 1):
        df = flows(spark, [flow(session, session_id=session, dst="10.1.1.1", total_bytes=size)])
        table = B.update_baseline(table, df)
        means.append(table.first().total_bytes_avg)
    assert means == [100, 10, 15, 30]
    whole = flows(spark, [flow(i, session_id=i, dst="10.1.1.1", total_bytes=s) for i, s in enumerate(sizes, 1)])
    assert B.baseline(whole).first().total_bytes_avg == 30
    assert B.baseline(whole, include_first=True).first().total_bytes_avg == 47.5
