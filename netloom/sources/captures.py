"""Capture files in a folder, with size and owning session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from netloom.functions.fmt import bytes_si_text


def list_captures(spark: SparkSession, folder: str, pattern: str = "*.pcapng") -> DataFrame:
    """Name and size of each file. Content is never read: only path and length
    are selected, which the binary source takes from the file listing."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size")
    )


def capture_inventory(files: DataFrame, sessions: DataFrame) -> DataFrame:
    """Files joined to sessions by base name; newest name first is the display order."""
    owners = sessions.filter(F.col("pcap_file").isNotNull()).select(
        F.element_at(F.split("pcap_file", "/"), -1).alias("name"), F.col("id").alias("session_id")
    )
    return files.join(owners, "name", "left").select(
        "name", "size", bytes_si_text(F.col("size")).alias("size_display"), "session_id"
    )


def capture_totals(files: DataFrame) -> DataFrame:
    total = F.coalesce(F.sum("size"), F.lit(0))
    return files.agg(F.count("*").alias("pcap_count"), total.alias("pcap_total_size")).withColumn(
        "pcap_total_display", bytes_si_text(F.col("pcap_total_size"))
    )
