"""CSV exports (A3-A5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from netloom.functions.predicates import ConnectionFilter, all_of, in_session

# fixed values: output header and source column, in order
PACKET_COLUMNS = (
    ("packet_id", "frame_number"), ("absolute_timestamp", "ts"),
    ("relative_time", "relative_time"), ("src_ip", "src_ip"), ("dst_ip", "dst_ip"),
    ("src_port", "src_port"), ("dst_port", "dst_port"), ("transport_protocol", "transport"),
    ("application_protocol", "protocol"), ("tcp_flags", "tcp_flags"),
    ("direction", "direction"), ("packet_length", "packet_length"), ("info", "info"),
)
# the same columns under the header of the older capture log
TITLED_PACKET_HEADER = (
    "Packet_ID", "Absolute_Timestamp", "Relative_Time", "Source_IP", "Destination_IP",
    "Source_Port", "Destination_Port", "Transport_Protocol", "Application_Protocol",
    "TCP_Flags", "Direction", "Packet_Length", "Info",
)
CONNECTION_COLUMNS = (
    ("Connection_ID", "id"), ("Source_IP", "src_ip"), ("Destination_IP", "dst_ip"),
    ("Source_Port", "src_port"), ("Destination_Port", "dst_port"), ("Protocol", "protocol"),
    ("Transport", "transport"), ("Direction", "direction"), ("Start_Time", "start_time"),
    ("End_Time", "end_time"), ("Duration_Seconds", "duration"),
    ("Total_Packets", "total_packets"), ("Total_Bytes", "total_bytes"), ("State", "state"),
    ("Tags", "tags"), ("Severity", "severity"),
)
FILTERED_COLUMNS = (
    ("ID", "id"), ("Source IP", "src_ip"), ("Source Port", "src_port"),
    ("Destination IP", "dst_ip"), ("Destination Port", "dst_port"), ("Protocol", "protocol"),
    ("Direction", "direction"), ("Packets", "total_packets"), ("Bytes", "total_bytes"),
    ("State", "state"), ("Tags", "tags"), ("Timestamp", "start_time"),
)
FILTERED_LIMIT = 10_000


def _renamed(df: DataFrame, columns) -> DataFrame:
    """Select and rename; lists become comma-joined text, absent columns blank."""
    chosen = []
    for header, name in columns:
        if name not in df.columns:
            value = F.lit("")
        elif df.schema[name].dataType.typeName() == "array":
            value = F.array_join(name, ", " if name == "tcp_flags" else ",")
        else:
            value = F.col(name)
        chosen.append(value.alias(header))
    return df.select(*chosen)


def packet_rows(packets: DataFrame, titled: bool = False) -> DataFrame:
    rows = _renamed(packets, PACKET_COLUMNS)
    return rows.toDF(*TITLED_PACKET_HEADER) if titled else rows


def connection_rows(
    flows: DataFrame, session_id: int | None = None, limit: int | None = None
) -> DataFrame:
    """A4: largest first; without a limit this is a distributed sort."""
    ordered = in_session(flows, session_id).orderBy(F.desc("total_bytes"), "id")
    return _renamed(ordered.limit(limit) if limit else ordered, CONNECTION_COLUMNS)


def filtered_rows(
    flows: DataFrame, where: ConnectionFilter = ConnectionFilter(), limit: int | None = FILTERED_LIMIT
) -> DataFrame:
    """A5: matching flows, newest first; ``limit`` None gives all by a distributed sort."""
    chosen = flows.filter(all_of(where.conditions())).orderBy(F.desc("id"))
    return _renamed(chosen if limit is None else chosen.limit(limit), FILTERED_COLUMNS)


def write_csv(rows: DataFrame, path: str) -> None:
    """One header per file; part files keep the order of the frame."""
    rows.write.mode("overwrite").option("header", True).option(
        "timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSS"
    ).csv(path)


def write_packets_csv(packets: DataFrame, path: str, titled: bool = False) -> None:
    """A3."""
    write_csv(packet_rows(packets, titled), path)


def export_connections_csv(
    flows: DataFrame, path: str, session_id: int | None = None, limit: int | None = None
) -> None:
    """A4."""
    write_csv(connection_rows(flows, session_id, limit), path)


def export_filtered_csv(
    flows: DataFrame, path: str, where: ConnectionFilter = ConnectionFilter(),
    limit: int | None = FILTERED_LIMIT,
) -> None:
    """A5."""
    write_csv(filtered_rows(flows, where, limit), path)
