import pytest

from helpers import T0, F, flow, flows, packet, packets
from netloom.functions.predicates import ConnectionFilter
from netloom.operators.flows import build_flows, dedup_frames
from netloom.operators.tls import propagate_tls
from netloom.plans import connections as C, sessions as S
from netloom.sinks import exports as X, tables as T
from netloom.sources.captures import capture_inventory, capture_totals, list_captures
from netloom.sources.packets import read_packets
from netloom.streaming import live


def line(n, src="10.0.0.1", sport="1000", dst="8.8.8.8", dport="443", proto="TCP", version="", info="", flags="·······A····"):
    fields = [str(n), f"{1704067200 + n}.123456789", str(float(n)), src, "", dst, "", sport, "", dport, "", proto, "100", flags, version, "m1", "m2", info]
    return "\t".join(fields)


def test_read_packets(spark, tmp_path):
    text = [line(1, info="a\tb"), "short\tline", line(2, src="", dst="", sport="", dport="", proto=" "), line(3, sport="x"), line(4, dst="10.0.0.1", src="8.8.8.8")]
    (tmp_path / "p.txt").write_text("\n".join(text))
    rows = {r.frame_number: r for r in read_packets(spark, str(tmp_path), 1, ["10.0.0.1"]).collect()}
    assert set(rows) == {1, 2, 3, 4}
    assert rows[1].info == "a\tb" and str(rows[1].ts) == "2024-01-01 00:00:01.123000" and rows[1].direction == "OUTGOING"
    assert (rows[2].src_ip, rows[2].protocol, rows[2].transport) == ("m1", "UNKNOWN", "UNKNOWN")
    assert rows[3].src_port is None and rows[4].direction == "INCOMING"


def test_snapshot_replaces_only_its_session(spark, tmp_path):
    root = str(tmp_path)
    T.write_connections(flows(spark, [flow(1), flow(2, session_id=2)]), root)
    T.write_connections(flows(spark, [flow(3), flow(4)]), root)
    assert {r.id for r in T.read_table(spark, root, "connections").collect()} == {2, 3, 4}
    with pytest.raises(Exception, match="session_id is required"):
        T.write_connections(flows(spark, [flow(1, session_id=None)]), root)
    T.write_connections(flows(spark, []), root, session_id=1)
    assert {r.id for r in T.read_table(spark, root, "connections").collect()} == {2}


def test_missing_tables_are_empty(spark, tmp_path):
    assert T.read_table(spark, str(tmp_path), "alerts").count() == 0
    assert not T.delete_session(spark, str(tmp_path), 1)


def test_age_out_rewrites_only_touched_sessions(spark, tmp_path):
    root = str(tmp_path)
    rows = [flow(1, at=0), flow(2, at=40 * 86400), flow(3, session_id=2, at=0), flow(4, session_id=3, at=40 * 86400), flow(5, session_id=1, at=None)]
    T.write_connections(flows(spark, rows), root)
    before = {p.name for p in (tmp_path / "connections" / "session_id=3").glob("*.parquet")}
    assert T.delete_older(spark, root, "2024-02-01", 30) == 2
    assert {r.id for r in T.read_table(spark, root, "connections").collect()} == {2, 4, 5}
    assert {p.name for p in (tmp_path / "connections" / "session_id=3").glob("*.parquet")} == before
    assert T.delete_date(spark, root, "2024-02-10") == 2 and T.delete_date(spark, root, "2020-01-01") == 0
    stats = T.read_table(spark, root, "protocol_stats").collect()
    assert [(r.protocol, r.packet_count) for r in stats] == [("TCP", 1)]


def test_csv_headers(spark, tmp_path):
    df = flows(spark, [flow(1, total_bytes=5), flow(2, total_bytes=9)])
    X.export_connections_csv(df, str(tmp_path / "a"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "a").glob("*.csv")))
    assert text.startswith("Connection_ID,Source_IP,Destination_IP,Source_Port") and text.index("\n2,") < text.index("\n1,")
    titled = X.packet_rows(packets(spark, [packet(1)]).withColumn("relative_time", F.lit(0.0)), titled=True)
    assert titled.columns[0] == "Packet_ID" and titled.columns[-1] == "Info" and len(titled.columns) == 13
    X.export_filtered_csv(df, str(tmp_path / "b"), ConnectionFilter(port=40000))
    assert next((tmp_path / "b").glob("*.csv")).read_text().splitlines()[0] == "ID,Source IP,Source Port,Destination IP,Destination Port,Protocol,Direction,Packets,Bytes,State,Tags,Timestamp"


def test_capture_files(spark, tmp_path):
    (tmp_path / "a.pcapng").write_bytes(b"x" * 1500)
    (tmp_path / "b.pcapng").write_bytes(b"x")
    (tmp_path / "c.txt").write_bytes(b"x")
    files = list_captures(spark, str(tmp_path))
    owners = spark.createDataFrame([(4, "data/a.pcapng"), (5, None)], "id int, pcap_file string")
    rows = {r.name: (r.size, r.size_display, r.session_id) for r in capture_inventory(files, owners).collect()}
    assert rows == {"a.pcapng": (1500, "1.5 KB", 4), "b.pcapng": (1, "1 B", None)}
    assert capture_totals(files).first().pcap_total_size == 1501


def test_reports_on_empty_tables(spark):
    none = flows(spark, []).withColumns({"tags": F.array().cast("array<string>"), "severity": F.lit("")})
    alerts = spark.createDataFrame([], "id bigint, session_id int, timestamp timestamp_ntz")
    assert [tuple(r) for r in S.traffic_stats(none).collect()] == [("total", "", 0, 0, 0)]
    assert tuple(S.totals(none, alerts).first()) == (0, 0, 0)
    assert {(r.series, r.value) for r in S.hourly_series(none, alerts, 1).collect()} == {("packets", 0), ("bytes", 0), ("alerts", 0)}
    assert tuple(C.connection_page_counts(none).first()) == (0, 1)


def test_talkers_count_both_ends(spark):
    df = flows(spark, [flow(i, dst=f"203.0.113.{i % 4}", total_bytes=i) for i in range(50)])
    rows = S.top_talkers(df, limit=100).collect()
    assert sum(r.total_bytes for r in rows) == 2 * sum(range(50))


def test_wildcards_and_backslash_in_search(spark):
    df = flows(spark, [flow(1, protocol="a\\b"), flow(2, protocol="a_b"), flow(3, protocol="axb")])
    ids = lambda text: {r.id for r in df.filter(__import__("netloom.functions.predicates", fromlist=["x"]).contains_text(F.col("protocol"), text)).collect()}
    assert ids("\\") == {1} and ids("A_B") == {1, 2, 3} and ids("ax") == {3}


def test_siblings_exclude_the_flow_itself(spark):
    df = flows(spark, [flow(i, at=float(i)) for i in range(15)])
    rows = C.sibling_connections(df, df).collect()
    of = lambda i: sorted((r.other_id for r in rows if r.id == i), reverse=True)
    assert of(14) == list(range(13, 3, -1)) and of(0) == list(range(14, 4, -1))


def stream_lines(spark, folder, per_trigger=2):
    raw = spark.readStream.option("maxFilesPerTrigger", per_trigger).text(folder)
    return raw.withColumn("session_id", F.lit(1))


def test_stream_equals_batch(spark, tmp_path):
    source, root = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    lines = []
    for n in range(1, 241):
        back = n % 3 == 0
        ends = dict(src="8.8.8.8", sport="443", dst="10.0.0.1", dport=str(1000 + n % 7)) if back else dict(sport=str(1000 + n % 7))
        version = "0x0304" if n == 25 else "0x0303" if n in (8, 9) else ""
        flags = "··········S·" if n < 8 else "·······A··S·" if n < 15 else "·······A···F" if n > 230 else "·······A····"
        lines.append(line(n, proto="TLSv1.2" if n % 2 else "TCP", version=version, flags=flags, **ends))
    for part in range(6):
        chunk = lines[part * 40 : part * 40 + 40]
        (source / f"{part}.txt").write_text("\n".join(chunk + chunk[:5]))
    seen = []
    packets_ = live.live_packets(stream_lines(spark, str(source)), ["10.0.0.1"], "60 days")
    live.start_flows(packets_, root, lambda df, n: seen.append((n, df.count())), once=True).awaitTermination()
    batch = build_flows(propagate_tls(dedup_frames(read_packets(spark, str(source), 1, ["10.0.0.1"]))))
    streamed = live.current_flows(spark, root)
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect()))
    assert sum(n for _, n in seen) == 240 and len(seen) >= 3
    assert {r.protocol for r in streamed.collect()} == {"TCP", "TLSv1.2", "TLSv1.3"}


def test_retried_batch_counts_once(spark, tmp_path):
    root = str(tmp_path)
    write = live.flow_writer(root)
    df = packets(spark, [packet(1), packet(2)])
    write(df, 0)
    write(df, 0)
    write(packets(spark, [packet(3)]), 1)
    assert live.current_flows(spark, root).first().total_packets == 3


def test_detection_raises_each_alert_once(spark, tmp_path):
    from netloom.operators.detectors import Context
    from netloom.sources.networks import Networks

    root = str(tmp_path)
    write = live.flow_writer(root)
    none = spark.createDataFrame([], "ip string, first_seen timestamp_ntz, session_count int, total_bytes_avg double")
    ctx = Context(none, Networks(), "2026-06-01")
    for batch in (0, 1, 2):
        dst = "203.0.113.5" if batch < 2 else "203.0.113.6"
        write(packets(spark, [packet(batch, dst=dst, dport=22, sport=1000 + batch)]), batch)
        live.detect_now(spark, root, ctx, batch, as_of="2024-01-01")
        live.detect_now(spark, root, ctx, batch, as_of="2024-01-01")  # a retry
    got = spark.read.parquet(f"{root}/behaviour_alerts")
    assert {(r.batch_id, r.dst_ip, r.tag) for r in got.collect()} == {(0, "203.0.113.5", "new_dest"), (2, "203.0.113.6", "new_dest")}


def test_feed_cursor_and_own_traffic(spark):
    from netloom.operators.flows import recent_packets

    rows = [packet(n, dst="2606:4700:0000:0000:0000::1", info="x" * 100) for n in range(1, 9)] + [packet(9, sport=8000), packet(10, dst="")]
    df = packets(spark, rows).withColumn("relative_time", F.lit(1.23456))
    got = recent_packets(df, after=6).collect()
    assert [r.num for r in got] == [8, 7] and got[0].time == 1.235
    assert got[0].dst == "2606:4700:0000:00...:443" and len(got[0].info) == 80
    assert [r.num for r in recent_packets(df, limit=3).collect()] == [8, 7, 6]


def test_alert_cursor_and_unknown_level(spark):
    from netloom.functions.predicates import AlertFilter
    from netloom.plans import alerts as A

    df = spark.createDataFrame(
        [(i, None, 1 + i % 3, "s", "a", "b", 1) for i in range(9)],
        "id bigint, timestamp timestamp_ntz, severity_num int, signature string, src_ip string, dst_ip string, session_id int",
    )
    assert A.latest_alert(df).first().id == 8
    assert A.latest_alert(df, after=7).count() == 1 and A.latest_alert(df, after=8).count() == 0
    counts = A.alert_page_counts(df, AlertFilter(severity="weird"), per_page=4).first()
    assert (counts.total_count, counts.total_pages, counts.high_count) == (9, 3, 3)
    assert A.alert_page_counts(df, AlertFilter(severity="low"), per_page=4).first().total_count == 3


def test_deep_pages_are_sorted_by_the_cluster(spark):
    df = flows(spark, [flow(i) for i in range(30)])
    page = C.connection_page(df.withColumns({"tags": F.array().cast("array<string>"), "severity": F.lit("")}), page=3, per_page=10)
    assert [r.id for r in page.collect()] == list(range(9, -1, -1))
    deep = C.page_slice(df.orderBy(F.desc("id")), 3, 100_000)
    assert "TakeOrderedAndProject" not in deep._jdf.queryExecution().executedPlan().toString()


def test_each_flush_stores_the_snapshot_and_detects(spark, tmp_path):
    from netloom.operators.detectors import Context
    from netloom.schemas import KNOWN_DESTINATIONS
    from netloom.sources.networks import Networks

    source, root = tmp_path / "in", str(tmp_path / "live")
    source.mkdir()
    for part in range(2):  # the same flow goes on in the second file, another one begins
        rows = [line(part * 10 + n, dst="203.0.113.9", dport="22") for n in range(1, 6)]
        rows += [line(part * 10 + 6, sport="1001", dst=f"203.0.113.{20 + part}", dport="22")]
        (source / f"{part}.txt").write_text("\n".join(rows))
    known = spark.createDataFrame([], KNOWN_DESTINATIONS)
    ctx = Context(known, Networks(), "2026-06-01")
    lines = live.live_packets(stream_lines(spark, str(source), 1), ["10.0.0.1"], "60 days")
    live.start_flows(lines, root, once=True, ctx=ctx, as_of="2024-01-01").awaitTermination()
    kept = T.read_table(spark, root, "connections").select("dst_ip", "total_packets").collect()
    assert sorted(map(tuple, kept)) == sorted(
        map(tuple, live.current_flows(spark, root).select("dst_ip", "total_packets").collect())
    )
    logged = [(r.dst_ip, r.tag) for r in spark.read.parquet(f"{root}/behaviour_alerts").collect()]
    assert len(logged) == len(set(logged)) and {t for _, t in logged} >= {"new_dest"}
    assert {d for d, _ in logged} == {"203.0.113.9", "203.0.113.20", "203.0.113.21"}


def test_baseline_of_the_stream_is_a_ledger(spark, tmp_path):
    """Cumulative rows per batch and session: a retry changes nothing, and a batch is judged by the baseline
    that batches before it have left."""
    from netloom.operators.baseline import baseline
    from netloom.operators.detectors import Context
    from netloom.sources.networks import Networks

    root = str(tmp_path)
    write = live.flow_writer(root)
    known = spark.createDataFrame([("203.0.113.5", T0, 2, 50.0)], "ip string, first_seen timestamp_ntz, session_count int, total_bytes_avg double")
    ctx = Context(known, Networks(), "2026-06-01")

    def batch(number, rows):
        write(packets(spark, rows), number)
        live.detect_now(spark, root, ctx, number, as_of="2024-01-01")
        live.observe_batch(spark, root, number)

    def left(before=None):
        rows = live.current_baseline(spark, root, known, before).collect()
        return {r.ip: (r.session_count, r.total_bytes_avg) for r in rows}

    one = [packet(1, dst="203.0.113.5", packet_length=100), packet(2, dst="203.0.113.6", dport=22, packet_length=10)]
    batch(0, one)
    assert left(0) == {"203.0.113.5": (2, 50.0)}
    assert left() == {"203.0.113.5": (3, 75.0), "203.0.113.6": (1, 10.0)}
    more = [packet(3, dst="203.0.113.5", packet_length=60), packet(4, dst="203.0.113.6", dport=22, packet_length=20)]
    batch(1, more)
    batch(1, more)  # a retry
    assert left() == {"203.0.113.5": (3, 105.0), "203.0.113.6": (1, 30.0)} and left(1)["203.0.113.6"] == (1, 10.0)
    other = [packet(1, session_id=2, dst="203.0.113.6", dport=22, packet_length=70), packet(2, session_id=3, dst="203.0.113.6", dport=22, packet_length=90)]
    batch(2, other)
    assert left()["203.0.113.6"] == (3, 80.0)
    raised = {(r.batch_id, r.session_id, r.dst_ip) for r in spark.read.parquet(f"{root}/behaviour_alerts").where("tag = 'new_dest'").collect()}
    assert raised == {(0, 1, "203.0.113.6")}
    none = known.limit(0)
    whole = baseline(live.current_flows(spark, root)).collect()
    streamed = live.current_baseline(spark, root, none).collect()
    assert {(r.ip, r.session_count, r.total_bytes_avg) for r in whole} == {(r.ip, r.session_count, r.total_bytes_avg) for r in streamed}


def test_names_count_in_their_session(spark):
    from netloom.operators.dns import named

    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "session_id int, dst_ip string")
    names = spark.createDataFrame([(1, "a", "x"), (2, "a", "y")], "session_id int, ip string, domain string")
    assert sorted((r.session_id, r.domain) for r in named(rows, names).collect()) == [(1, "x"), (2, "y"), (3, None)]
    assert {r.domain for r in named(rows.select("dst_ip"), names).collect()} == {"y", None}
    assert {r.domain for r in named(rows, names.where("session_id = 1").drop("session_id")).collect()} == {"x", None}
