"""A1: dissected packet lines to typed packet rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from netloom.functions import packet as P

# fixed values: the 18 tab-separated fields of a line, in order
FIELDS = (
    "frame_number", "time_epoch", "time_relative", "ip_src", "ipv6_src", "ip_dst",
    "ipv6_dst", "tcp_srcport", "udp_srcport", "tcp_dstport", "udp_dstport", "protocol",
    "frame_len", "tcp_flags", "supported_version", "eth_src", "eth_dst", "info",
)
REQUIRED_FIELDS = 15
LOOPBACK = ("127.0.0.1", "::1")


def split_lines(lines: DataFrame, keep: Sequence[str] = ("session_id",)) -> DataFrame:
    """Tab-separated text in ``value`` to 18 text columns.

    Short lines are dropped; the last field keeps any further tabs.
    """
    parts = F.split(F.rtrim(F.col("value"), F.lit("\n")), "\t", len(FIELDS))
    fields = lines.withColumn("_parts", parts).filter(F.size("_parts") >= REQUIRED_FIELDS)
    named = [
        F.coalesce(F.get("_parts", F.lit(i)), F.lit("")).alias(name)
        for i, name in enumerate(FIELDS)
    ]
    return fields.select(*keep, *named)


def parse_packets(
    lines: DataFrame, local_ips: Sequence[str] = (), keep: Sequence[str] = ("session_id",)
) -> DataFrame:
    """Lines to packets (B1-B5, B7, B8, B10, B12), batch or streaming.

    ``supported_version`` is kept for the TLS propagation of B6.
    """
    c = F.col
    raw = split_lines(lines, keep)
    label = F.coalesce(P.non_empty(F.trim(c("protocol"))), F.lit("UNKNOWN"))
    raw = raw.withColumn("_label", P.fix_tls_label(label, c("supported_version")))
    tcp = (c("tcp_srcport") != "") | (c("tcp_dstport") != "")
    udp = (c("udp_srcport") != "") | (c("udp_dstport") != "")
    info = F.trim(c("info"))
    src = P.pick_address(c("ip_src"), c("ipv6_src"), c("ip_dst"), c("ipv6_dst"), c("eth_src"))
    dst = P.pick_address(c("ip_dst"), c("ipv6_dst"), c("ip_src"), c("ipv6_src"), c("eth_dst"))
    raw = raw.withColumns(
        {
            "src_ip": src,
            "dst_ip": dst,
            "transport": P.transport_of(c("_label"), tcp, udp),
            "_info": info,
        }
    )
    unknown = P.is_unknown_record(c("transport"), c("_info"))
    return raw.select(
        *keep,
        P.to_number(c("frame_number"), "bigint").alias("frame_number"),
        P.epoch_to_timestamp(c("time_epoch")).alias("ts"),
        P.to_number(c("time_relative"), "double").alias("relative_time"),
        "src_ip",
        "dst_ip",
        P.pick_port(c("tcp_srcport"), c("udp_srcport")).alias("src_port"),
        P.pick_port(c("tcp_dstport"), c("udp_dstport")).alias("dst_port"),
        "transport",
        F.when(unknown, "TCP").otherwise(c("_label")).alias("protocol"),
        P.flags_from_letters(c("tcp_flags")).alias("tcp_flags"),
        P.direction(c("src_ip"), c("dst_ip"), (*LOOPBACK, *local_ips)).alias("direction"),
        P.to_number(c("frame_len"), "bigint").alias("packet_length"),
        F.when(unknown, P.SEGMENT_TEXT).otherwise(c("_info")).alias("info"),
        "supported_version",
    )


def read_packet_lines(spark: SparkSession, path: str, session_id: int | None = None) -> DataFrame:
    """Text files as lines. ``session_id`` is given, or a directory partition."""
    lines = spark.read.text(path)
    return lines if session_id is None else lines.withColumn("session_id", F.lit(session_id))


def read_packets(
    spark: SparkSession, path: str, session_id: int | None = None, local_ips: Sequence[str] = ()
) -> DataFrame:
    return parse_packets(read_packet_lines(spark, path, session_id), local_ips)


def stream_packet_lines(
    spark: SparkSession, path: str, session_id: int, files_per_trigger: int = 100
) -> DataFrame:
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    return lines.withColumn("session_id", F.lit(session_id))
