"""Sessions, totals, protocol and traffic reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from netloom.functions.fmt import bytes_si_text, count_short, mean_size, share_of_total
from netloom.functions.predicates import in_session

POINTS = 12


def _per_session(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy(F.col("session_id").alias("id")).agg(F.count("*").alias(name))


def sessions_with_alerts(sessions: DataFrame, alerts: DataFrame) -> DataFrame:
    """sessions, newest first, with their alert count."""
    joined = sessions.join(_per_session(alerts, "alert_count"), "id", "left")
    return joined.select(
        "id", "start_time", "end_time", "total_packets", "total_bytes", "interface", "pcap_file",
        F.coalesce("alert_count", F.lit(0)).alias("alert_count"),
    ).orderBy(F.desc("id"))


def session_overview(sessions: DataFrame, alerts: DataFrame, connections: DataFrame) -> DataFrame:
    """sessions with alert and flow counts and display defaults."""
    joined = sessions.join(_per_session(alerts, "alerts"), "id", "left").join(
        _per_session(connections, "connections"), "id", "left"
    )
    zero = F.lit(0)
    return joined.select(
        "id",
        "start_time",
        "end_time",
        F.coalesce("total_packets", zero).alias("packets"),
        bytes_si_text(F.coalesce("total_bytes", zero)).alias("bytes_display"),
        F.coalesce("interface", F.lit("—")).alias("interface"),
        F.coalesce(F.element_at(F.split("pcap_file", "/"), -1), F.lit("")).alias("pcap_file"),
        F.coalesce("status", F.lit("completed")).alias("status"),
        F.coalesce("alerts", zero).alias("alerts"),
        F.coalesce("connections", zero).alias("connections"),
    ).orderBy(F.desc("id"))


def traffic_stats(connections: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """F4 (and F2 on one session): rows (section, name, packets, bytes, flows).

    Sections are protocol, direction and total. Flows are read once into cells
    per (protocol, direction); the sections are grouping sets over the cells.
    The total row is there even for no flows, which grouping sets alone would
    not give. With ``sessions`` a row with the session count is added.
    """
    cells = connections.groupBy("protocol", "direction").agg(
        F.sum("total_packets").alias("p"), F.sum("total_bytes").alias("b"), F.count("*").alias("n")
    )
    p, d = F.col("protocol"), F.col("direction")
    grouped = cells.groupingSets([[p], [d], []], p, d).agg(
        F.grouping_id().alias("g"), F.sum("p").alias("packets"), F.sum("b").alias("bytes"),
        F.sum("n").alias("flows"),
    )
    section = F.when(F.col("g") == 1, "protocol").when(F.col("g") == 2, "direction").otherwise("total")
    zero = F.lit(0)
    rows = grouped.select(
        section.alias("section"),
        F.when(F.col("g") == 1, p).when(F.col("g") == 2, d).otherwise("").alias("name"),
        F.coalesce("packets", zero).alias("packets"),
        F.coalesce("bytes", zero).alias("bytes"),
        F.coalesce("flows", zero).alias("flows"),
    ).filter((F.col("section") != "direction") | (F.col("name") != ""))

    def plain(section: str, flows: Column) -> list[Column]:
        none = F.lit(0).cast("bigint")
        return [
            F.lit(section).alias("section"), F.lit("").alias("name"), none.alias("packets"),
            none.alias("bytes"), flows.cast("bigint").alias("flows"),
        ]

    rows = rows.unionByName(connections.sparkSession.range(1).select(*plain("total", F.lit(0))))
    rows = rows.groupBy("section", "name").agg(
        *[F.sum(c).alias(c) for c in ("packets", "bytes", "flows")]
    )
    if sessions is None:
        return rows
    counted = sessions.agg(F.count("*").alias("n"))
    return rows.unionByName(counted.select(*plain("sessions", F.col("n"))))


def session_stats(connections: DataFrame, sessions: DataFrame, session_id: int) -> DataFrame:
    """statistics of one session; no rows when there is no such session."""
    rows = traffic_stats(connections.filter(F.col("session_id") == session_id))
    return rows.filter(sessions.filter(F.col("id") == session_id).exists())


def latest_session(sessions: DataFrame) -> DataFrame:
    """F3."""
    return sessions.agg(F.max("id").alias("id"))


def totals(connections: DataFrame, alerts: DataFrame) -> DataFrame:
    """packets, flows and alerts in one row, 0 on empty tables."""
    flows = connections.agg(
        F.coalesce(F.sum("total_packets"), F.lit(0)).alias("packets"), F.count("*").alias("connections")
    )
    return flows.withColumn("alerts", alerts.agg(F.count("*").alias("n")).scalar())


def protocol_stats(stats: DataFrame) -> DataFrame:
    """F6."""
    return stats.select("protocol", "packet_count", "total_bytes").orderBy(
        F.desc("packet_count"), "protocol"
    )


def top_talkers(connections: DataFrame, limit: int = 10, session_id: int | None = None) -> DataFrame:
    """both ends of every flow, counted per address, largest first.

    One scan with two rows per flow; partial sums before the shuffle.
    """
    ends = in_session(connections, session_id).select(
        F.explode(F.array("src_ip", "dst_ip")).alias("ip"), "total_packets", "total_bytes"
    )
    per_ip = ends.groupBy("ip").agg(
        F.count("*").alias("connections"),
        F.sum("total_packets").alias("total_packets"),
        F.sum("total_bytes").alias("total_bytes"),
    )
    return per_ip.orderBy(F.desc("total_bytes"), "ip").limit(limit)


def tag_summary(connections: DataFrame) -> DataFrame:
    """rows (section, name, count): flows per tag, per severity, and tagged in all."""
    cells = (
        connections.filter(F.size("tags") > 0)
        .groupBy("tags", F.coalesce("severity", F.lit("")).alias("severity"))
        .agg(F.count("*").alias("n"))
    )
    names = F.explode(
        F.concat(
            F.transform("tags", lambda t: F.struct(F.lit("tag").alias("section"), F.trim(t).alias("name"))),
            F.array(
                F.struct(F.lit("severity").alias("section"), F.col("severity").alias("name")),
                F.struct(F.lit("total").alias("section"), F.lit("").alias("name")),
            ),
        )
    )
    rows = cells.select(names.alias("k"), "n").select("k.section", "k.name", "n")
    rows = rows.filter((F.col("section") == "total") | (F.col("name") != ""))
    return rows.groupBy("section", "name").agg(F.sum("n").alias("count"))


def _last(df: DataFrame, order: str, points: int) -> DataFrame:
    return df.orderBy(F.desc(order)).limit(points)


def hourly_series(
    connections: DataFrame, alerts: DataFrame, session_id: int, points: int = POINTS
) -> DataFrame:
    """rows (series, bucket, value) of the last hours of one session.

    Series with no data keep a single zero with a null bucket.
    """
    flows = connections.filter((F.col("session_id") == session_id) & F.col("start_time").isNotNull())
    hours = _last(
        flows.groupBy(F.date_trunc("hour", "start_time").cast("timestamp_ntz").alias("bucket")).agg(
            F.sum("total_packets").alias("packets"), F.sum("total_bytes").alias("bytes")
        ),
        "bucket", points,
    )
    raised = alerts.filter((F.col("session_id") == session_id) & F.col("timestamp").isNotNull())
    alert_hours = _last(
        raised.groupBy(F.date_trunc("hour", "timestamp").cast("timestamp_ntz").alias("bucket")).agg(
            F.count("*").alias("value")
        ),
        "bucket", points,
    )
    measures = F.explode(F.create_map(F.lit("packets"), F.col("packets"), F.lit("bytes"), F.col("bytes")))
    rows = hours.select("bucket", measures.alias("series", "value")).unionByName(
        alert_hours.withColumn("series", F.lit("alerts"))
    )
    return _with_empty(rows, ["packets", "bytes", "alerts"])


def _with_empty(rows: DataFrame, names: list[str]) -> DataFrame:
    """Every series appears; a handful of rows on both sides."""
    spark = rows.sparkSession
    series = spark.range(len(names)).select(F.get(F.array(*map(F.lit, names)), F.col("id").cast("int")).alias("series"))
    return series.join(rows, "series", "left").select(
        "series", "bucket", F.coalesce("value", F.lit(0)).alias("value")
    ).orderBy("series", "bucket")


def session_series(sessions: DataFrame, points: int = POINTS) -> DataFrame:
    """the last sessions with their running number, oldest first.

    The number is counted back from the total, so the table is never put in
    order as a whole.
    """
    count = sessions.agg(F.count("*").alias("n")).scalar()
    last = _last(sessions.select("id", "total_packets", "total_bytes"), "id", points)
    back = F.row_number().over(W.orderBy(F.desc("id")))  # at most ``points`` rows
    return last.withColumn("_back", back).select(
        "id",
        F.coalesce("total_packets", F.lit(0)).alias("packets"),
        F.coalesce("total_bytes", F.lit(0)).alias("bytes"),
        (count - F.col("_back") + 1).alias("sessions"),
    ).orderBy("id")


def protocol_shares(connections: DataFrame, session_id: int | None = None) -> DataFrame:
    """protocols by packets with their share and display text."""
    cells = in_session(connections, session_id).groupBy("protocol").agg(
        F.sum("total_packets").alias("packets"), F.sum("total_bytes").alias("bytes")
    )
    # one row per protocol from here on
    total = F.sum("packets").over(W.partitionBy())
    return cells.select(
        F.col("protocol").alias("name"),
        "packets",
        share_of_total(F.col("packets"), total).alias("pct"),
        F.concat(*count_short(F.col("packets"))).alias("packets_display"),
        bytes_si_text(F.col("bytes")).alias("bytes_display"),
    ).orderBy(F.desc("packets"), "name")


def session_exists(sessions: DataFrame, session_id: int) -> DataFrame:
    """the session's row, or none."""
    return sessions.filter(F.col("id") == session_id).select("id", "interface", "start_time").limit(1)


def capture_summary(counters: DataFrame, top_labels: int = 15) -> DataFrame:
    """F30 from the counters of C5: shares by direction, transport and label.

    Rows (session_id, kind, name, packets, bytes, mean_size, share); labels are
    cut to the most frequent.
    """
    scope = W.partitionBy("session_id")
    total = F.max(F.when(F.col("kind") == "total", F.col("packets"))).over(scope)
    rank = F.row_number().over(W.partitionBy("session_id", "kind").orderBy(F.desc("packets"), "name"))
    rows = counters.withColumns({"_total": total, "_rank": rank})
    kept = rows.filter((F.col("kind") != "protocol") | (F.col("_rank") <= top_labels))
    return kept.select(
        "session_id", "kind", "name", "packets", "bytes",
        mean_size(F.col("bytes"), F.col("packets")).alias("mean_size"),
        share_of_total(F.col("packets"), F.col("_total")).alias("share"),
    )
