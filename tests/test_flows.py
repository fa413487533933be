import random
from datetime import timedelta

from pyspark.sql import functions as F

from helpers import T0, operators, packet, packets
from netloom.operators.dns import ip_domains
from netloom.operators.flows import build_flows, dedup_frames, packets_per_second, running_counters
from netloom.operators.tls import propagate_tls


def test_both_directions_are_one_flow(spark):
    rows = [
        packet(1, tcp_flags="SYN"),
        packet(2, "8.8.8.8", 443, "10.0.0.1", 1000, tcp_flags="ACK, SYN", direction="INCOMING"),
        packet(3, tcp_flags="PSH, ACK"),
    ]
    flow = build_flows(packets(spark, rows)).collect()
    assert len(flow) == 1
    f = flow[0]
    assert (f.src_ip, f.dst_port, f.direction, f.total_packets, f.state) == ("10.0.0.1", 443, "OUTGOING", 3, "ESTABLISHED")
    assert f.duration == 2.0 and f.first_frame == 1


def test_labels_split_flows_unless_joined_by_transport(spark):
    df = packets(spark, [packet(1), packet(2, protocol="TLSv1.3")])
    assert build_flows(df).count() == 2
    assert build_flows(df, key="transport").count() == 1


def test_missing_port_counts_as_no_ports(spark):
    rows = [
        packet(1, sport=None, dport=None, transport="ICMP", protocol="ICMP"),
        packet(2, "8.8.8.8", None, "10.0.0.1", None, transport="ICMP", protocol="ICMP"),
        packet(3, sport=5, dport=0, transport="ICMP", protocol="ICMP"),
    ]
    f = build_flows(packets(spark, rows)).collect()
    assert len(f) == 1 and f[0].src_port is None and f[0].transport == "ICMP"


def test_row_order_does_not_matter(spark):
    rng = random.Random(5)
    rows = []
    for n in range(300):
        a, b = ("10.0.0.1", rng.randint(1, 3)), ("8.8.8.8", rng.randint(1, 3))
        (s, sp), (d, dp) = (a, b) if rng.random() < 0.5 else (b, a)
        rows.append(packet(n, s, sp, d, dp, tcp_flags=rng.choice(["SYN", "ACK", "ACK, FIN", "RST", ""])))
    expected = sorted(map(tuple, build_flows(packets(spark, rows)).collect()))
    rng.shuffle(rows)
    again = build_flows(packets(spark, rows).repartition(7))
    assert sorted(map(tuple, again.collect())) == expected
    assert sum(r[11] for r in expected) == 300


def test_dedup_keeps_first_arrival_and_is_stable(spark):
    rows = [packet(1, packet_length=9), packet(1, packet_length=5), packet(2), packet(1, packet_length=7)]
    df = packets(spark, rows)
    assert {r.frame_number: r.packet_length for r in dedup_frames(df).collect()} == {1: 5, 2: 100}
    arrived = df.withColumn("arrival", F.when(F.col("packet_length") == 9, 0).otherwise(1))
    kept = {r.frame_number: r.packet_length for r in dedup_frames(arrived, "arrival").collect()}
    assert kept == {1: 9, 2: 100}


def test_tls_upgrade(spark):
    tls = dict(protocol="TLSv1.2")
    rows = [
        packet(1, **tls, supported_version="0x0303"), packet(2, **tls),
        packet(3, **tls, supported_version="0x0304,0x0303"), packet(4, **tls, supported_version="0x0303"),
        packet(5, "8.8.8.8", 443, "10.0.0.1", 1000, **tls), packet(6), packet(7, sport=1, **tls),
    ]
    out = {r.frame_number: r.protocol for r in propagate_tls(packets(spark, rows)).collect()}
    assert out == {1: "TLSv1.2", 2: "TLSv1.2", 3: "TLSv1.3", 4: "TLSv1.3", 5: "TLSv1.3", 6: "TCP", 7: "TLSv1.2"}


def test_dns_answers(spark):
    text = "Standard query response 0x12 {} example.com {}"
    rows = [
        packet(1, protocol="DNS", info=text.format("A", "A 1.2.3.4 A 5.6.7.8")),
        packet(2, protocol="DNS", info=text.format("AAAA", "AAAA 2606:4700::1 CNAME x.net")),
        packet(3, protocol="DNS", info="Standard query response 0x13 A other.org A 5.6.7.8"),
        packet(4, protocol="DNS", info="Standard query 0x14 A nothing.org A 9.9.9.9"),
        packet(5, protocol="DNS", info="Standard query response 0x15 A 7.7.7.7"),
        packet(6, protocol="TCP", info="response A no.dns A 6.6.6.6"),
    ]
    got = {r.ip: r.domain for r in ip_domains(packets(spark, rows)).collect()}
    assert got == {"1.2.3.4": "example.com", "5.6.7.8": "other.org", "2606:4700::1": "example.com"}


def test_rate_counts_samples_of_five_seconds(spark):
    rows = [packet(n, ts=T0 + timedelta(seconds=s)) for n, s in enumerate([0, 0, 1, 1, 1, 2, 10, 11])]
    got = {r.second - 1704067200: r.pps for r in packets_per_second(packets(spark, rows)).collect()}
    assert got == {0: 0, 1: 3, 2: 2, 10: 0, 11: 1}


def test_counters_agree(spark):
    rows = [packet(n, transport="UDP" if n % 3 else "TCP", protocol="DNS" if n % 2 else "TCP") for n in range(30)]
    got = running_counters(packets(spark, rows)).collect()
    for kind in ("total", "transport", "protocol", "direction"):
        assert sum(r.packets for r in got if r.kind == kind) == 30


def test_tls_flows_equal_relabelling_every_packet(spark):
    from netloom.operators.flows import build_flows as fold
    from netloom.operators.rebuild import build_tls_flows, rebuild

    rng = random.Random(9)
    rows = []
    for n in range(600):
        pair = rng.randint(0, 25)
        ends = [("10.0.0.1", 1000 + pair), ("8.8.8.8", 443)]
        if pair == 1:
            ends[0] = ("10.0.0.1", None)
        if pair == 2:
            ends[0] = ("10.0.0.1", 0)
        (s, sp), (d, dp) = ends if rng.random() < 0.6 else ends[::-1]
        label = rng.choice(["TLSv1.2", "TLSv1.2", "TLSv1.3", "SSLv3", "TCP"])
        version = rng.choice([""] * 12 + ["0x0303", "0x0304", "0x0304,0x0303", "0x0302"])
        rows.append(packet(n, s, sp, d, dp, protocol=label, supported_version=version, tcp_flags=rng.choice(["SYN", "ACK", "RST"])))
    df = packets(spark, rows)
    expected = sorted(map(str, fold(propagate_tls(df)).collect()))
    assert sorted(map(str, build_tls_flows(df).collect())) == expected
    flows, counters = rebuild(df.unionByName(df))
    assert sorted(map(str, flows.collect())) == expected
    again = running_counters(propagate_tls(df)).collect()
    assert sorted(map(str, counters.select(*again[0].__fields__).collect())) == sorted(map(str, again))


def test_many_repeated_frames_are_moved_once(spark, monkeypatch):
    """Beyond a small table of repeated numbers no join moves the rows; the result is the same, also for null keys."""
    from netloom.operators import flows as O

    rows = [packet(n, packet_length=n % 7 + k) for n in range(40) for k in range(3)]
    rows += [packet(1, frame_number=None), packet(1, frame_number=None), packet(1, session_id=None), packet(50)]
    df = packets(spark, rows).withColumn("arrival", -F.col("packet_length"))
    for arrival in (None, "arrival"):
        few = O.dedup_frames(df, arrival)
        with monkeypatch.context() as m:
            m.setattr(O, "FEW_REPEATED", 10)
            many, count = O.dedup_and_count(df, arrival)
        assert count == len(rows) and "Join" in operators(few) and "Join" not in operators(many)
        assert sorted(map(str, many.select(*few.columns).collect())) == sorted(map(str, few.collect()))


def test_rebuild_shuffles_packets_in_tasks_of_bounded_size(spark, monkeypatch):
    from netloom.operators import rebuild as R

    seen, store = {}, R.stored
    monkeypatch.setattr(R, "TASK_ROWS", 10)
    monkeypatch.setattr(R, "stored", lambda df, label: seen.update({label: spark.conf.get("spark.sql.shuffle.partitions")}) or store(df, label))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    R.rebuild(packets(spark, [packet(n) for n in range(100)] * 2))
    assert seen["packets"] == "21" and spark.conf.get("spark.sql.shuffle.partitions") == before
