"""Small tables for the tests."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

T0 = datetime(2024, 1, 1)

FLOW_SCHEMA = (
    "id bigint, session_id int, src_ip string, dst_ip string, src_port int, dst_port int, "
    "protocol string, transport string, direction string, start_time timestamp_ntz, "
    "end_time timestamp_ntz, duration double, total_packets bigint, total_bytes bigint, state string"
)


def flow(i, dst="203.0.113.9", at=0.0, **other):
    when = None if at is None else T0 + timedelta(seconds=at)
    row = dict(
        id=i, session_id=1, src_ip="10.0.0.1", dst_ip=dst, src_port=40000, dst_port=443,
        protocol="TCP", transport="TCP", direction="OUTGOING", start_time=when, end_time=when,
        duration=0.0, total_packets=1, total_bytes=100, state="ACTIVE",
    )
    row.update(other)
    return row


def flows(spark, rows):
    names = [part.split()[0] for part in FLOW_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], FLOW_SCHEMA)


def known(spark, rows=()):
    return spark.createDataFrame(
        list(rows), "ip string, first_seen timestamp_ntz, session_count int, total_bytes_avg double"
    )


PACKET_SCHEMA = (
    "session_id int, frame_number bigint, ts timestamp_ntz, src_ip string, dst_ip string, "
    "src_port int, dst_port int, transport string, protocol string, tcp_flags string, "
    "direction string, packet_length bigint, supported_version string, info string"
)


def packet(frame, src="10.0.0.1", sport=1000, dst="8.8.8.8", dport=443, **other):
    row = dict(
        session_id=1, frame_number=frame, ts=T0 + timedelta(seconds=frame), src_ip=src, dst_ip=dst,
        src_port=sport, dst_port=dport, transport="TCP", protocol="TCP", tcp_flags="",
        direction="OUTGOING", packet_length=100, supported_version="", info="",
    )
    row.update(other)
    return row


def packets(spark, rows):
    names = [part.split()[0] for part in PACKET_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], PACKET_SCHEMA)


def value(spark, expression):
    return spark.range(1).select(expression.alias("v")).first().v


def operators(df):
    """Names of the physical operators of a plan."""
    return df._jdf.queryExecution().executedPlan().toString()


__all__ = ["F"]
