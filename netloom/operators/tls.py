"""The negotiated TLS version of a connection labels its later frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from netloom.functions.packet import has_version, is_tls

PAIR = ("session_id", "lo", "hi")


def _paired(packets: DataFrame) -> DataFrame:
    def end(side: str):
        return F.struct(F.col(f"{side}_ip").alias("ip"), F.col(f"{side}_port").alias("port"))

    has_ports = F.col("src_port").isNotNull() & F.col("dst_port").isNotNull()
    return packets.withColumns(
        {
            "lo": F.least(end("src"), end("dst")),
            "hi": F.greatest(end("src"), end("dst")),
            "_tls": F.coalesce(is_tls(F.col("protocol")) & has_ports, F.lit(False)),
        }
    )


def first_versions(packets: DataFrame) -> DataFrame:
    """Per endpoint pair the first frame that names 1.3 and the first that names 1.2."""
    is13 = has_version(F.col("supported_version"), "0x0304")
    is12 = has_version(F.col("supported_version"), "0x0303")
    frame = F.col("frame_number")
    hello = _paired(packets.filter(F.col("supported_version") != "")).filter(
        F.col("_tls") & (is13 | is12)
    )
    return hello.groupBy(*PAIR).agg(
        F.min(F.when(is13, frame)).alias("first13"), F.min(F.when(~is13, frame)).alias("first12")
    )


def apply_versions(packets: DataFrame, versions: DataFrame) -> DataFrame:
    """Relabel TLS/SSL frames at or after the first frame that names a version."""
    frame, tls = F.col("frame_number"), F.col("_tls")
    label = (
        F.when(tls & (frame >= F.col("first13")), "TLSv1.3")
        .when(tls & (frame >= F.col("first12")), "TLSv1.2")
        .otherwise(F.col("protocol"))
    )
    return (
        _paired(packets)
        .join(versions, list(PAIR), "left")
        .withColumn("protocol", label)
        .select(*packets.columns)
    )


def propagate_tls(packets: DataFrame) -> DataFrame:
    """Each TLS/SSL frame takes the version negotiated so far on its pair.

    1.3 is sticky and 1.2 counts only before it, so the state at a frame follows
    from two numbers per pair. They come from a small aggregate over handshakes
    that is joined back; there is no per-pair ordering, so a busy pair can be
    split by AQE.
    """
    return apply_versions(packets, first_versions(packets))
