"""The window form of TCP analysis against a plain fold over random segments."""

import random

import pytest
from pyspark.sql import functions as F

from netloom.operators.scan import Running, by_group_size
from netloom.operators.tcp import label_segments, relative_numbers

SCHEMA = (
    "session_id int, frame_number bigint, src_ip string, dst_ip string, src_port int, dst_port int, "
    "tcp_flags string, seq bigint, ack bigint, win bigint, payload_len bigint, has_sack boolean, win_scale int"
)


def segments(seed, count):
    rng = random.Random(seed)
    ends = [("10.0.0.1", 1000), ("8.8.8.8", 443), ("10.0.0.2", 1000)]
    rows = []
    for frame in range(1, count + 1):
        a, b = rng.choice([(0, 1), (1, 0), (0, 1), (1, 0), (2, 1), (1, 2)])
        flags = rng.choice(["ACK"] * 14 + ["PSH, ACK", "PSH, ACK", "FIN, ACK", "FIN", "SYN", "SYN, ACK", "RST", "RST, SYN", ""])
        rows.append(
            (1 + frame % 2, frame, *[ends[a][0], ends[b][0], ends[a][1], ends[b][1]], flags,
             100 + rng.choice([0, 0, 1, 9, 10, 20, 30]), 200 + rng.choice([0, 0, 0, 10, 20]), rng.choice([0, 50, 50, 60]),
             rng.choice([0, 0, 0, 0, 1, 10, 20]), rng.random() < 0.2, rng.choice([None, 0, 3, 7]))
        )
    return rows


def fold(rows):
    """Row-by-row state machine."""
    state, isn, scale, labels, relative = {}, {}, {}, {}, {}
    for s, frame, sip, dip, sp, dp, flags, seq, ack, win, size, sack, shift in rows:
        me, peer = (s, sip, sp, dip, dp), (s, dip, dp, sip, sp)
        syn, fin, has_ack, psh, rst = (f in flags for f in ("SYN", "FIN", "ACK", "PSH", "RST"))
        f, r, label = state.get(me), state.get(peer), None
        if syn:
            isn[me] = seq
            if shift is not None:
                scale[me] = 1 << shift
        elif not rst:
            isn.setdefault(me, seq - 1)
            if has_ack and ack > 0:
                isn.setdefault(peer, ack - 1)
        relative[s, frame] = (
            (seq - isn[me]) & 0xFFFFFFFF if me in isn else seq,
            (ack - isn[peer]) & 0xFFFFFFFF if peer in isn else ack,
            win if syn else win * scale.get(me, 1),
        )
        if rst and not syn:
            continue
        if syn:
            state[me] = dict(exp=seq + 1, ack=ack, win=win, ka=False, dup=0, orig=frame, hi=ack if has_ack else 0)
            labels[s, frame] = None
            continue
        eff = size + (1 if fin else 0)
        if f and has_ack:
            exp = f["exp"]
            if not fin:
                if size <= 1 and seq == exp - 1 and not psh:
                    label = "TCP Keep-Alive"
                    if r:
                        r["ka"] = True
                elif size == 0 and not psh and f["ka"]:
                    label = "TCP Keep-Alive ACK"
                    f["ka"] = False
                elif size == 0 and ack == f["ack"] and seq == exp and not psh and (win == f["win"] or sack):
                    f["dup"] += 1
                    label = f"TCP Dup ACK {f['orig']}#{f['dup']}"
            if label is None and (size > 0 or fin) and seq < exp:
                if r and seq + eff <= r["hi"]:
                    label = "TCP Spurious Retransmission"
                else:
                    label = "TCP Retransmission" if seq + eff <= exp else "TCP Out-Of-Order"
            if label is None and size == 0 and not fin:
                if win == 0:
                    label = "TCP ZeroWindow"
                elif ack == f["ack"] and win != f["win"] and not psh:
                    label = "TCP Window Update"
                elif not psh and r is None and ack > 0:
                    label = "TCP ACKed unseen segment"
        if f and (size > 0 or fin) and label is None and seq > f["exp"]:
            label = "TCP Previous segment not captured"
        new = dict(exp=seq + eff, ack=ack, win=win, ka=False, dup=0, orig=frame, hi=ack)
        if f:
            new.update(exp=max(f["exp"], seq + eff) if eff else f["exp"], ka=f["ka"], hi=max(f["hi"], ack))
            if ack == f["ack"]:
                new.update(dup=f["dup"], orig=f["orig"])
        state[me] = new
        labels[s, frame] = label
    return labels, relative


@pytest.mark.parametrize("seed,large", [(1, 10**6), (2, 10**6), (3, 90)])
def test_labels_equal_fold(spark, seed, large):
    rows = segments(seed, 900)
    labels, _ = fold(rows)
    got = label_segments(spark.createDataFrame(rows, SCHEMA).repartition(3), large).collect()
    assert {(r.session_id, r.frame_number): r.tcp_label for r in got} == labels
    assert len({(x or "").split(" 1")[0].split(" #")[0][:14] for x in labels.values()}) >= 9


@pytest.mark.parametrize("large", [10**6, 70])
def test_relative_numbers_equal_fold(spark, large):
    rows = segments(4, 600)
    _, relative = fold(rows)
    got = relative_numbers(spark.createDataFrame(rows, SCHEMA), large).collect()
    assert {(r.session_id, r.frame_number): (r.rel_seq, r.rel_ack, r.scaled_win) for r in got} == relative


def test_sequence_numbers_wrap(spark):
    base = ("10.0.0.1", "8.8.8.8", 1, 2)
    rows = [(1, 1, *base, "SYN", 2**32 - 5, 0, 1, 0, False, 2), (1, 2, *base, "ACK", 3, 0, 10, 0, False, None)]
    got = relative_numbers(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.frame_number: (r.rel_seq, r.scaled_win) for r in got} == {1: (0, 1), 2: (8, 40)}


def test_ranges_of_a_large_group_lie_in_several_tasks(spark):
    """However the table of large groups is joined, none of them may come into one task."""
    changed = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in changed}
    rows = spark.range(4000).selectExpr("id div 10000 as session_id", "id as frame_number")

    def operator(df, scan):
        out = scan.run(df, {"sofar": Running("sum", F.lit(1), inclusive=True)})
        return out.withColumn("task", F.spark_partition_id())

    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        found = by_group_size(rows, ["session_id"], "frame_number", operator, limit=100).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert all(r.sofar == r.frame_number + 1 for r in found) and len(found) == 4000
    assert len({r.task for r in found}) > 2
