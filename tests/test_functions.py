import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from helpers import value
from netloom.functions import address as A, codes, fmt, packet as P
from netloom.functions.rounding import exact_round, fixed_text
from netloom.sources.networks import (
    DEFAULT_TRUSTED, load_networks, load_thresholds, parse_networks, parse_thresholds,
)


def expected_key(text):
    try:
        ip = ipaddress.ip_address(text)
    except ValueError:
        return None
    return f"{ip.version}{int(ip):0{8 if ip.version == 4 else 32}x}"


def test_address_keys_equal_ipaddress(spark):
    rng = random.Random(7)
    texts = [
        "::", "1::", "::1", "64:ff9b::1.2.3.4", "::ffff:10.0.0.1", "fe80::1%eth0", "1:2:3:4:5:6:7::",
        "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8::", "1::2::3", ":::", ":1", "1:", "12345::", "g::", "1:2",
        "aa:bb:cc:00:00:01", "N/A", "", "1.2.3", "1.2.3.4.5", "256.1.1.1", "01.2.3.4", "1.2.3.04",
        "::1.2.3", "::300.1.1.1", "1.2.3.4::", "2404:6800:4009::200e", "ABCD::EF",
    ]
    texts += [str(ipaddress.IPv4Address(rng.getrandbits(32))) for _ in range(300)]
    for _ in range(600):
        bits = rng.getrandbits(128)
        for group in range(8):
            if rng.random() < 0.4:
                bits &= ~(0xFFFF << (16 * group))
        ip = ipaddress.IPv6Address(bits)
        texts += [str(ip), ip.exploded]
    df = spark.createDataFrame([(t,) for t in texts], "ip string")
    got = {r.ip: r.key for r in df.select("ip", A.address_key(F.col("ip")).alias("key")).collect()}
    wrong = {t: (got[t], expected_key(t)) for t in texts if got[t] != expected_key(t)}
    # a scoped address counts by its address part
    wrong.pop("fe80::1%eth0", None)
    assert not wrong


def test_network_membership_equals_ipaddress(spark):
    rng = random.Random(3)
    nets = [ipaddress.ip_network(c) for c in DEFAULT_TRUSTED]
    ips = ["::ffff:10.0.0.1", "aa:bb:cc:00:00:01", "N/A", ""]
    for net in nets:
        first, last = int(net.network_address), int(net.broadcast_address)
        for n in (first, last, first - 1, last + 1, rng.randint(first, last)):
            if 0 <= n < 1 << net.max_prefixlen:
                ips.append(str(net.network_address.__class__(n)))
    df = spark.createDataFrame([(i,) for i in ips], "ip string")
    rows = df.select("ip", A.in_networks(F.col("ip"), DEFAULT_TRUSTED).alias("inside")).collect()

    def inside(text):
        try:
            ip = ipaddress.ip_address(text)
        except ValueError:
            return False
        return any(ip.version == n.version and ip in n for n in nets)

    assert {r.ip: r.inside for r in rows} == {i: inside(i) for i in ips}


def test_network_file(tmp_path):
    text = "20.0.0.0/8 # cloud\n# comment\n# [SEMI-TRUSTED]\n104.16.0.5/12\nnonsense\n#[TRUSTED]\n::1/128\n"
    path = tmp_path / "nets.txt"
    path.write_text(text)
    nets = load_networks(str(path))
    assert nets.trusted == ("20.0.0.0/8", "::1/128") and nets.semi_trusted == ("104.16.0.0/12",)
    assert parse_networks("") == load_networks(str(tmp_path / "none"))


def test_threshold_file(tmp_path):
    text = (
        "# comment\nsuppress gen_id 1, sig_id 7, track by_dst, ip 10.0.0.0/8\n"
        "threshold gen_id 1, sig_id 9, type limit, track by_src, count 2, seconds 60\n"
        "threshold gen_id 1, sig_id 9, type both, track by_src, count 2, seconds 60\n"
    )
    (tmp_path / "t.config").write_text(text)
    suppress, limits = load_thresholds(str(tmp_path / "t.config"))
    assert (suppress, limits) == parse_thresholds(text)
    assert load_thresholds(str(tmp_path / "none")) == ((), ())
    assert [(r.signature_id, r.track, r.network) for r in suppress] == [(7, "by_dst", "10.0.0.0/8")]
    assert [(r.signature_id, r.track, r.count, r.seconds) for r in limits] == [(9, "by_src", 2, 60)]


def test_rounding_equals_python(spark):
    rng = random.Random(1)
    xs = [i / 20 for i in range(500)] + [i / 8 for i in range(500)] + [1450 / 1000, 1350 / 1000, -1.25, 0.0]
    xs += [rng.random() * 10 ** rng.randint(-3, 9) for _ in range(2000)]
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    for digits in range(4):
        for r in df.select("x", fixed_text(F.col("x"), digits).alias("t"), exact_round(F.col("x"), digits).alias("r")).collect():
            assert r.t == f"{r.x:.{digits}f}" and r.r == round(r.x, digits)


@pytest.mark.parametrize(
    "number,text", [(0, "0 B"), (999, "999 B"), (1000, "1.0 KB"), (1450, "1.4 KB"), (10**6, "1.0 MB"), (25 * 10**8, "2.5 GB")]
)
def test_si_bytes(spark, number, text):
    assert value(spark, fmt.bytes_si_text(F.lit(number))) == text


@pytest.mark.parametrize(
    "seconds,text", [(None, "-"), (0.0, "-"), (0.25, "250ms"), (5.0, "5.0s"), (125.0, "2m 5s"), (7320.0, "2h 2m")]
)
def test_short_durations(spark, seconds, text):
    assert value(spark, fmt.duration_short(F.lit(seconds).cast("double"))) == text


def test_binary_bytes(spark):
    assert value(spark, fmt.bytes_binary_text(F.lit(1536))) == "1.50 KB"
    assert value(spark, fmt.bytes_binary_text(F.lit(5 * 1024**4))) == "5.00 TB"


def test_services(spark):
    pick = lambda t, a, b: value(spark, codes.service_name(F.lit(t), F.lit(a), F.lit(b)))
    assert pick("TCP", 50000, 6885) == "BitTorrent"
    assert pick("TCP", 22, 80) == "HTTP"  # the earlier rule wins on either port
    assert pick("TCP", 1, 2) == "TCP" and pick("UDP", 1, 2) == "UDP"
    assert pick("UDP", 443, 53) == "QUIC"


def test_flags(spark):
    letters = P.flags_text(P.flags_from_letters(F.lit("·······A··S·")))
    assert value(spark, letters) == "ACK, SYN"
    assert value(spark, P.flags_text(P.flags_from_letters(F.lit("············")))) == ""
    assert value(spark, P.flags_text(P.flags_from_bits(F.lit(0xD2)))) == "SYN, ACK, ECE, CWR"


def test_private_variants_differ_on_purpose(spark):
    df = spark.createDataFrame([("172.200.1.1",), ("172.20.0.1",), (None,), ("ff02::1",)], "ip string")
    rows = df.select(*[A.is_private(F.col("ip"), v).alias(v) for v in A.PRIVATE_PATTERNS]).collect()
    assert [tuple(r) for r in rows] == [
        (False, False, True, False), (True, True, True, False), (True, False, True, False),
        (True, False, False, False),
    ]


def test_multicast_names_are_no_addresses(spark):
    df = spark.createDataFrame([("ff02::1",), ("ffmpeg.org",), ("239.1.1.1",), ("2390.example",)], "k string")
    assert [r[0] for r in df.select(A.is_multicast_key(F.col("k"))).collect()] == [True, False, True, False]
