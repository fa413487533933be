import random
import statistics

import pandas as pd
import pytest

from helpers import flow, flows
from netloom.config import BeaconConfig, Tuning
from netloom.operators import beacons as B
from netloom.operators.detectors import detect_beaconing
from netloom.sources.networks import Networks

NETS = Networks()


def tagged(spark, rows, tuning=Tuning(), domains=None, nets=NETS):
    found = detect_beaconing(flows(spark, rows), nets, tuning, domains).collect()
    return {r.id: r.reason for r in found}


def steady(n=20, step=60.0, **other):
    return [flow(i, at=i * step, **other) for i in range(n)]


def test_perfect_beacon(spark):
    got = tagged(spark, steady())
    assert len(got) == 20
    assert got[0] == "20 connections to 203.0.113.9, interval ~60.0s (CV=0.000)"


def test_jitter_and_too_few(spark):
    rng = random.Random(2)
    jittered = [flow(i, at=i * 60 + rng.uniform(-30, 30)) for i in range(20)]
    assert not tagged(spark, jittered) and not tagged(spark, steady(19))


@pytest.mark.parametrize(
    "dst,port,protocol,count",
    [
        ("142.250.1.1", 443, "TCP", 0), ("104.16.2.1", 443, "TCP", 0), ("104.16.2.1", 4444, "TCP", 20),
        ("104.16.2.1", 443, "SSH", 20), ("127.0.0.53", 53, "DNS", 0), ("ff02::1", 443, "TCP", 0),
        ("239.1.1.1", 443, "TCP", 0), ("104.16.2.1", None, "TCP", 20),
    ],
)
def test_suppression(spark, dst, port, protocol, count):
    assert len(tagged(spark, steady(dst=dst, dst_port=port, protocol=protocol))) == count


def test_domain_groups_addresses(spark):
    rows = [flow(i, dst=f"198.51.100.{i % 2}", at=i * 30.0) for i in range(20)]
    names = spark.createDataFrame([("198.51.100.0", "ffa.example"), ("198.51.100.1", "ffa.example")], "ip string, domain string")
    assert not tagged(spark, rows)
    assert set(tagged(spark, rows, domains=names)) == set(range(20))


def test_tier_follows_the_first_flow(spark):
    names = spark.createDataFrame([("142.250.1.1", "a.example"), ("198.51.100.1", "a.example")], "ip string, domain string")
    order = ["142.250.1.1"] + ["198.51.100.1"] * 19
    assert not tagged(spark, [flow(i, dst=d, at=i * 30.0) for i, d in enumerate(order)], domains=names)
    assert tagged(spark, [flow(i, dst=d, at=i * 30.0) for i, d in enumerate(reversed(order))], domains=names)


def test_trusted_floor_without_suppression(spark):
    tuning = Tuning(beaconing=BeaconConfig(suppress_whitelisted=False))
    assert not tagged(spark, steady(dst="142.250.1.1"), tuning)
    assert len(tagged(spark, steady(), tuning)) == 20


def test_unreadable_start_is_tagged_with_its_group(spark):
    assert 99 in tagged(spark, steady() + [flow(99, at=None)])


def greedy(times):
    kept = [times[0]]
    for t in times[1:]:
        if t - kept[-1] > 1_000_000:
            kept.append(t)
    return kept


def stats_of(spark, groups):
    rows = [(src, "d", t) for src, times in groups.items() for t in set(times)]
    df = spark.createDataFrame(rows, "src_ip string, dst_key string, at bigint").repartition(5)
    return {r.src_ip: r for r in B.interval_stats(df).collect()}


def test_greedy_dedup_example(spark):
    got = stats_of(spark, {"a": [int(x * 1e6) for x in (0, 0.8, 1.6, 2.4, 2.5, 10)]})["a"]
    assert got.kept == 3 and got.mean == 5.0


def test_interval_stats_equal_plain_fold(spark):
    rng = random.Random(11)
    groups = {}
    for g in range(60):
        # some groups cross hours in an unbroken run of close starts
        step = rng.choice([0.05, 0.3, 0.7, 1.0, 1.3, 40.0, 900.0])
        t, times = rng.randint(0, 7200) * 1_000_000, []
        for _ in range(rng.choice([1, 2, 5, 400])):
            t += int(rng.choice([step, step * rng.random(), 1.0]) * 1000) * 1000
            times.append(t)
        groups[f"s{g}"] = times
    dense = [3590_000_000 + i * 1000 for i in range(0, 25000, 7)]
    groups["dense"] = dense
    groups["edge"] = [3599_500_000, 3600_400_000, 3600_500_000, 3600_500_001, 3601_500_001, 7199_999_999, 7200_999_999, 7201_000_000]
    got = stats_of(spark, groups)
    for name, times in groups.items():
        kept = greedy(sorted(set(times)))
        gaps = [(b - a) / 1e6 for a, b in zip(kept, kept[1:])]
        assert got[name].kept == len(kept), name
        if gaps:
            assert got[name].mean == pytest.approx(statistics.mean(gaps))
        if len(gaps) > 1:
            assert got[name].stdev == pytest.approx(statistics.stdev(gaps), abs=1e-6)


def test_chains_do_not_depend_on_batches():
    rng = random.Random(4)
    rows = sorted(
        (rng.choice("ab"), rng.choice("xy"), at // 3_600_000_000, at)
        for at in {rng.randint(0, 3 * 3600) * 1_000_000 // 4 for _ in range(3000)}
    )
    frame = pd.DataFrame(rows, columns=["src_ip", "dst_key", "slot", "at"])
    follow = B.chain_batches(["src_ip", "dst_key", "slot"])
    whole = pd.concat(follow(iter([frame])))
    pieces = [frame.iloc[i : i + 37].reset_index(drop=True) for i in range(0, len(frame), 37)]
    split = pd.concat(follow(iter(pieces)))
    key = ["src_ip", "dst_key", "slot", "entry"]
    a, b = whole.sort_values(key).reset_index(drop=True), split.sort_values(key).reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b)


def test_sessions_can_be_judged_apart(spark):
    rows = [flow(i, session_id=1 + i % 2, at=i * 60.0) for i in range(30)]
    df = flows(spark, rows)
    assert detect_beaconing(df, NETS, scope=()).count() == 30
    assert detect_beaconing(df, NETS).count() == 0
    more = flows(spark, rows + [flow(100 + i, session_id=1, at=1800 + i * 120.0) for i in range(10)])
    assert {r.id % 2 for r in detect_beaconing(more, NETS, scope=("session_id",)).collect() if r.id < 100} == {0}
