"""Explicit schemas of every table. Nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

_TYPES = {
    "INT": T.IntegerType(), "BIGINT": T.LongType(), "DOUBLE": T.DoubleType(),
    "STRING": T.StringType(), "BOOLEAN": T.BooleanType(),
    "TIMESTAMP_NTZ": T.TimestampNTZType(), "STRINGS": T.ArrayType(T.StringType()),
}


def _schema(text: str) -> T.StructType:
    """Fields as ``name TYPE``; usable before a session exists."""
    pairs = [field.split() for field in text.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


PACKETS = _schema(
    "session_id INT, frame_number BIGINT, ts TIMESTAMP_NTZ, relative_time DOUBLE, "
    "src_ip STRING, dst_ip STRING, src_port INT, dst_port INT, transport STRING, "
    "protocol STRING, tcp_flags STRINGS, direction STRING, packet_length BIGINT, "
    "info STRING"
)

SEGMENTS = _schema(
    "session_id INT, frame_number BIGINT, src_ip STRING, dst_ip STRING, src_port INT, "
    "dst_port INT, tcp_flags STRING, seq BIGINT, ack BIGINT, win BIGINT, "
    "payload_len BIGINT, has_sack BOOLEAN, win_scale INT"
)

CONNECTIONS = _schema(
    "id BIGINT, src_ip STRING, dst_ip STRING, src_port INT, dst_port INT, "
    "protocol STRING, transport STRING, direction STRING, start_time TIMESTAMP_NTZ, "
    "end_time TIMESTAMP_NTZ, duration DOUBLE, total_packets BIGINT, total_bytes BIGINT, "
    "state STRING, tags STRINGS, severity STRING, session_id INT"
)

ALERTS = _schema(
    "id BIGINT, timestamp TIMESTAMP_NTZ, severity STRING, severity_num INT, "
    "signature STRING, signature_id BIGINT, category STRING, src_ip STRING, "
    "dst_ip STRING, src_port INT, dst_port INT, proto STRING, action STRING, "
    "session_id INT"
)

SESSIONS = _schema(
    "id INT, start_time TIMESTAMP_NTZ, end_time TIMESTAMP_NTZ, total_packets BIGINT, "
    "total_bytes BIGINT, interface STRING, pcap_file STRING, status STRING"
)

PROTOCOL_STATS = _schema(
    "protocol STRING, packet_count BIGINT, total_bytes BIGINT, last_seen TIMESTAMP_NTZ"
)

KNOWN_DESTINATIONS = _schema(
    "ip STRING, first_seen TIMESTAMP_NTZ, session_count INT, total_bytes_avg DOUBLE"
)

IP_REPUTATION = _schema(
    "ip STRING, abuse_score INT, country STRING, isp STRING, is_malicious BOOLEAN, "
    "last_checked TIMESTAMP_NTZ"
)

TEXT_CACHE = _schema(
    "cache_key STRING, explanation STRING, created_at TIMESTAMP_NTZ"
)

NETWORKS = _schema("cidr STRING, tier STRING")

# one JSON line of the intrusion-detection log
IDS_EVENT = _schema(
    "timestamp STRING, event_type STRING, src_ip STRING, dest_ip STRING, src_port INT, "
    "dest_port INT, proto STRING"
).add(
    "alert",
    _schema(
        "severity INT, signature STRING, signature_id BIGINT, category STRING, action STRING"
    ),
)

# values that columns added by later versions take in older rows
COLUMN_DEFAULTS = {"severity": "", "pcap_file": None, "tags": []}


def evolve_schema(df: DataFrame, schema: T.StructType = CONNECTIONS) -> DataFrame:
    """Bring an older table to ``schema``, filling added columns with defaults."""
    present = set(df.columns)
    columns = []
    for field in schema:
        if field.name in present:
            columns.append(F.col(field.name).cast(field.dataType).alias(field.name))
            continue
        default = COLUMN_DEFAULTS.get(field.name)
        value = F.array() if default == [] else F.lit(default)
        columns.append(value.cast(field.dataType).alias(field.name))
    return df.select(*columns)
