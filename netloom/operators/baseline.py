"""Rolling byte mean per destination."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def observations(flows: DataFrame) -> DataFrame:
    """One observation per session and destination: bytes and first time seen."""
    return (
        flows.filter(F.coalesce("dst_ip", F.lit("")) != "")
        .groupBy("session_id", F.col("dst_ip").alias("ip"))
        .agg(F.sum("total_bytes").alias("bytes"), F.min("start_time").alias("seen"))
    )


def baseline(flows: DataFrame, include_first: bool = False) -> DataFrame:
    """D9 over whole history.

    The rolling update weighs the first observation by zero once a second
    arrives, so the mean is that of the 2nd to last (``include_first`` gives the
    plain mean). Order matters only in which observation is first.
    """
    n, total = F.count("*"), F.sum("bytes")
    first = F.min_by("bytes", "session_id")
    later = F.when(n == 1, first.cast("double")).otherwise((total - first) / (n - 1))
    return (
        observations(flows)
        .groupBy("ip")
        .agg(
            F.min("seen").alias("first_seen"),
            n.cast("int").alias("session_count"),
            (total / n if include_first else later).alias("total_bytes_avg"),
        )
    )


def update_baseline(known: DataFrame, flows: DataFrame) -> DataFrame:
    """D9 incrementally: add the observations of one new session; flows of more than
    one fail, since their order would decide.

    mean' = (mean * (n - 1) + x) / n with the old n; new addresses start at x.
    """
    one = flows.agg(F.min("session_id").eqNullSafe(F.max("session_id"))).scalar()
    single = F.assert_true(one, F.lit("flows of one session are required"))
    new = observations(flows).groupBy("ip").agg(
        F.sum("bytes").alias("x"), F.min("seen").alias("seen")
    ).filter(single.isNull())
    n, mean, x = F.col("session_count"), F.col("total_bytes_avg"), F.col("x")
    return known.join(new, "ip", "full").select(
        "ip",
        F.coalesce("first_seen", "seen").alias("first_seen"),
        F.when(n.isNull(), 1).when(x.isNull(), n).otherwise(n + 1).cast("int").alias("session_count"),
        F.when(n.isNull(), x.cast("double"))
        .when(x.isNull(), mean)
        .otherwise((mean * (n - 1) + x) / n)
        .alias("total_bytes_avg"),
    )


def extend_baseline(known: DataFrame, observed: DataFrame) -> DataFrame:
    """D9 with the observations ``session_id, ip, bytes, seen`` of any number of later sessions, one row each.

    The rolling update is a sum in disguise: mean * (n - 1) is the sum of all observations but the first, so
    only which one is first matters, and all sessions are taken in at once.
    """
    new = observed.groupBy("ip").agg(
        F.count("*").alias("k"), F.sum("bytes").alias("total"), F.min_by("bytes", "session_id").alias("one"),
        F.min("seen").alias("seen"),
    )
    n, k, total, mean = F.col("session_count"), F.col("k"), F.col("total"), F.col("total_bytes_avg")
    return known.join(new, "ip", "full").select(
        "ip",
        F.coalesce("first_seen", "seen").alias("first_seen"),
        (F.coalesce(n, F.lit(0)) + F.coalesce(k, F.lit(0))).cast("int").alias("session_count"),
        F.when(k.isNull(), mean)
        .when(n.isNotNull(), (mean * (n - 1) + total) / (n - 1 + k))
        .when(k == 1, F.col("one").cast("double"))
        .otherwise((total - F.col("one")) / (k - 1))
        .alias("total_bytes_avg"),
    )


def known_among(ips: DataFrame, known: DataFrame) -> DataFrame:
    """Which of ``ips(ip)`` are in the baseline."""
    return ips.select("ip").distinct().join(known.select("ip"), "ip", "left_semi")


def destination_means(known: DataFrame, min_observations: int = 2) -> DataFrame:
    """Means with enough observations behind them."""
    return known.filter(F.col("session_count") >= min_observations).select("ip", "total_bytes_avg")
