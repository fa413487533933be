"""A2: JSON lines of an intrusion-detection engine to alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from netloom.operators.alerts import ids_severity
from netloom.schemas import IDS_EVENT


def event_time(text: Column) -> Column:
    """UTC time of a text with or without an offset (``Z``, ``+0530``, ``-08:00``)."""
    zone = r":\d{2}(?:\.\d+)?(Z|[+-]\d{2}:?\d{2})$"
    plain = F.regexp_replace(text, r"(?:Z|[+-]\d{2}:?\d{2})$", "")
    offset = F.regexp_extract(text, zone, 1)
    hours, minutes = F.substring(offset, 2, 2), F.substring(offset, -2, 2)
    away = (hours.try_cast("int") * 60 + minutes.try_cast("int")) * F.when(offset.startswith("-"), -1).otherwise(1)
    # without a time of day nothing is cut off, so that a date stays a date
    local = F.when(offset != "", plain).otherwise(text).try_cast("timestamp_ntz")
    return local - F.make_dt_interval(mins=F.when(offset.isin("", "Z"), 0).otherwise(away))


def alerts_from_events(events: DataFrame, *keep: str) -> DataFrame:
    """Keep alert events with a non-empty ``alert`` and fill defaults."""
    a = F.col("alert")
    present = [a[field].isNotNull() for field in ("severity", "signature", "signature_id", "category", "action")]
    filled = present[0]
    for test in present[1:]:
        filled = filled | test
    blank = F.lit("")
    number = F.coalesce(a["severity"], F.lit(3))
    return events.filter((F.col("event_type") == "alert") & a.isNotNull() & filled).select(
        *keep,
        event_time(F.col("timestamp")).alias("timestamp"),
        ids_severity(number).alias("severity"),
        number.alias("severity_num"),
        F.coalesce(a["signature"], F.lit("Unknown")).alias("signature"),
        F.coalesce(a["signature_id"], F.lit(0)).cast("bigint").alias("signature_id"),
        F.coalesce(a["category"], blank).alias("category"),
        F.coalesce("src_ip", blank).alias("src_ip"),
        F.coalesce("dest_ip", blank).alias("dst_ip"),
        F.coalesce("src_port", F.lit(0)).alias("src_port"),
        F.coalesce("dest_port", F.lit(0)).alias("dst_port"),
        F.coalesce("proto", blank).alias("proto"),
        F.coalesce(a["action"], F.lit("allowed")).alias("action"),
    )


def parse_ids_lines(lines: DataFrame, *keep: str) -> DataFrame:
    """JSON text in ``value``, batch or streaming; unreadable lines are skipped."""
    parsed = F.from_json("value", IDS_EVENT, {"mode": "PERMISSIVE"})
    events = lines.select(*keep, parsed.alias("e")).filter(F.col("e").isNotNull())
    return alerts_from_events(events.select(*keep, "e.*"), *keep)


def read_ids_events(spark: SparkSession, path: str) -> DataFrame:
    events = spark.read.schema(IDS_EVENT).option("mode", "DROPMALFORMED").json(path)
    return alerts_from_events(events)


def stream_ids_lines(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
