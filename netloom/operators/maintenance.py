"""Retention and statistics upkeep (A8, A9, G1-G5) as table-to-table plans."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from netloom.schemas import SESSIONS


def without_session(table: DataFrame, session_id: int, column: str = "session_id") -> DataFrame:
    """G1: everything but one session."""
    return table.filter(F.coalesce(F.col(column) != session_id, F.lit(True)))


def older_than(as_of: str, days: int) -> Column:
    """Started more than ``days`` before ``as_of``."""
    cutoff = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(days)} DAYS")
    return F.coalesce(F.col("start_time") < cutoff, F.lit(False))


def started_on(day: str) -> Column:
    """Started on the given date. A range test, so file statistics apply."""
    first = F.lit(date.fromisoformat(day)).cast("timestamp_ntz")
    following = first + F.expr("INTERVAL 1 DAY")
    return F.coalesce((F.col("start_time") >= first) & (F.col("start_time") < following), F.lit(False))


def deletion_report(connections: DataFrame, doomed: Column) -> DataFrame:
    """How many flows a deletion removes and leaves."""
    return connections.agg(
        F.count_if(doomed).alias("deleted"), F.count_if(~doomed).alias("remaining")
    )


def protocol_stats_from(connections: DataFrame) -> DataFrame:
    """Protocol statistics always follow from the flows."""
    return connections.groupBy("protocol").agg(
        F.sum("total_packets").alias("packet_count"),
        F.sum("total_bytes").alias("total_bytes"),
        F.max("end_time").alias("last_seen"),
    )


def upsert_protocol_stats(stats: DataFrame, counts: DataFrame, as_of: str) -> DataFrame:
    """Set count and time of the protocols in ``counts(protocol, packet_count)``.

    Bytes of a known protocol stay; a new one starts at 0.
    """
    fresh = counts.filter(F.coalesce("protocol", F.lit("")) != "").select(
        "protocol", F.col("packet_count").alias("_n")
    )
    now = F.lit(as_of).cast("timestamp_ntz")
    return stats.join(fresh, "protocol", "full").select(
        "protocol",
        F.coalesce("_n", "packet_count").alias("packet_count"),
        F.coalesce("total_bytes", F.lit(0)).alias("total_bytes"),
        F.when(F.col("_n").isNotNull(), now).otherwise(F.col("last_seen")).alias("last_seen"),
    )


def sessions_from_packets(packets: DataFrame, status: str = "completed") -> DataFrame:
    """Session rows of complete captures."""
    return packets.groupBy(F.col("session_id").alias("id")).agg(
        F.min("ts").alias("start_time"),
        F.max("ts").alias("end_time"),
        F.count("*").alias("total_packets"),
        F.sum("packet_length").alias("total_bytes"),
    ).withColumn("status", F.lit(status))


def start_session(
    sessions: DataFrame, as_of: str, interface: str | None = None, pcap_file: str | None = None
) -> DataFrame:
    """The table with one more, active session; its id is the largest plus one."""
    new = sessions.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).cast("int").alias("id")).select(
        "id",
        F.lit(as_of).cast("timestamp_ntz").alias("start_time"),
        F.lit(None).cast("timestamp_ntz").alias("end_time"),
        F.lit(0).cast("bigint").alias("total_packets"),
        F.lit(0).cast("bigint").alias("total_bytes"),
        F.lit(interface).cast("string").alias("interface"),
        F.lit(pcap_file).cast("string").alias("pcap_file"),
        F.lit("active").alias("status"),
    )
    return sessions.select(*[f.name for f in SESSIONS]).unionByName(new)


def end_session(sessions: DataFrame, finished: DataFrame, as_of: str) -> DataFrame:
    """Close the sessions of ``finished(id, packets, bytes)``."""
    now = F.lit(as_of).cast("timestamp_ntz")
    done = F.col("_p").isNotNull()
    totals = finished.select("id", F.col("packets").alias("_p"), F.col("bytes").alias("_b"))
    return sessions.join(totals, "id", "left").withColumns(
        {
            "end_time": F.when(done, now).otherwise(F.col("end_time")),
            "total_packets": F.coalesce("_p", "total_packets"),
            "total_bytes": F.coalesce("_b", "total_bytes"),
            "status": F.when(done, "completed").otherwise(F.col("status")),
        }
    ).drop("_p", "_b")
