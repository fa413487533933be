"""Flows and counters of a complete capture, TLS versions included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from netloom.functions.packet import is_tls
from netloom.operators.flows import (
    FLOW_KEYS, aggregate_flows, decode_flows, dedup_and_count, flow_keys, flow_parts, merge_flows,
    running_counters,
)
from netloom.operators.tls import apply_versions, first_versions
from netloom.session import shuffled_in, stored

#: Packets of one task where whole packets are shuffled.
TASK_ROWS = 500_000
VERSION_KEYS = ["session_id", "lo_ip", "lo_port", "hi_ip", "hi_port"]


def with_versions(parts: DataFrame, versions: DataFrame) -> DataFrame:
    """Coded flow parts beside the first frames that name a version on their pair."""
    flat = versions.select(
        "session_id", F.col("lo.ip").alias("lo_ip"), F.col("lo.port").alias("lo_port"),
        F.col("hi.ip").alias("hi_ip"), F.col("hi.port").alias("hi_port"), "first13", "first12",
    )
    return parts.join(flat, VERSION_KEYS, "left")


def relabel_parts(parts: DataFrame) -> DataFrame:
    """Label of a part all of whose frames follow the hello."""
    tls, start = is_tls(F.col("label")), F.col("first_frame")
    label = (
        F.when(tls & (start >= F.col("first13")), "TLSv1.3")
        .when(tls & (start >= F.col("first12")), "TLSv1.2")
        .otherwise(F.col("label"))
    )
    return parts.withColumn("label", label).drop("first13", "first12")


def _divided() -> Column:
    """Has the part frames on both sides of a change of version?

    Parts without usable ports are always looked at frame by frame.
    """
    def between(version: str) -> Column:
        change = F.col(version)
        inside = (F.col("first_frame") < change) & (change <= F.col("last_frame"))
        return F.coalesce(inside, F.lit(False))

    no_ports = F.col("lo_port") == 0
    return is_tls(F.col("label")) & (between("first13") | between("first12") | no_ports)


def build_tls_flows(packets: DataFrame) -> DataFrame:
    """Flows whose TLS labels follow the negotiated version (B6 then C2).

    Relabelling every packet first would shuffle all packets to their pair. A
    hello is normally the first TLS frame of its connection, so packets are
    folded under the label they carry, and whole parts are relabelled. Only
    flows with TLS frames on both sides of a change are folded again from their
    packets. Those are rare; their keys are stored, and packets are joined to them
    as their size allows. Packets are read three times here, so they should be a
    table and not text that is parsed each time.
    """
    versions = first_versions(packets)
    parts = stored(with_versions(aggregate_flows(flow_parts(packets)), versions), "flow-parts")
    divided = stored(parts.filter(_divided()).select(*FLOW_KEYS), "divided")
    whole = relabel_parts(parts.filter(~_divided()))
    again = flow_keys(packets).join(divided, list(FLOW_KEYS), "left_semi").select(*packets.columns)
    split = aggregate_flows(flow_parts(apply_versions(again, versions)))
    return decode_flows(merge_flows(whole.unionByName(split)))


def rebuild(packets: DataFrame, arrival: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Dedup, refold and recount a complete capture.

    Packets without repeated frames are stored once in columns, and so are the
    flows; everything else is read from there. Counters by label come from the
    flows, which carry the final labels. Where whole packets are shuffled, the
    number of tasks follows the number of packets.
    """
    clean, rows = dedup_and_count(packets, arrival)
    with shuffled_in(packets.sparkSession, rows // TASK_ROWS + 1):
        clean = stored(clean, "packets")
    flows = stored(build_tls_flows(clean), "flows")
    labels = flows.groupBy("session_id", F.col("protocol").alias("name")).agg(
        F.sum("total_packets").alias("packets"), F.sum("total_bytes").alias("bytes")
    )
    others = running_counters(clean).filter(F.col("kind") != "protocol")
    return flows, others.unionByName(labels.withColumn("kind", F.lit("protocol")))
