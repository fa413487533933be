"""Alert lists, pages and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from netloom.functions.fmt import severity_name
from netloom.functions.predicates import AlertFilter, all_of, in_session
from netloom.plans.connections import page_counts, page_slice
from netloom.session import stored


def recent_alerts(alerts: DataFrame, limit: int = 100, session_id: int | None = None) -> DataFrame:
    """newest first."""
    newest = in_session(alerts, session_id).orderBy(F.desc("id")).limit(limit)
    return newest.select(
        "id", "timestamp", "severity", "signature", "category", "src_ip", "dst_ip", "dst_port", "proto"
    )


def threat_summary(alerts: DataFrame, session_id: int | None = None, top: int = 10) -> DataFrame:
    """rows (section, name, count): total, severities, top sources and signatures.

    One pass into grouping sets, whose result is stored: the total and the levels
    are taken from it as they are, the two top lists are cut by rank, with a
    per-task limit before the shuffle. Sections come one after the other, each
    by count.
    """
    scoped = in_session(alerts, session_id)
    sev, src, sig = F.col("severity"), F.col("src_ip"), F.col("signature")
    grouped = scoped.groupingSets([[], [sev], [src], [sig]], sev, src, sig).agg(
        F.grouping_id().alias("g"), F.count("*").alias("count")
    )
    section = (
        F.when(F.col("g") == 7, "total").when(F.col("g") == 3, "severity")
        .when(F.col("g") == 5, "source").otherwise("signature")
    )
    rows = stored(grouped.select(
        section.alias("section"), F.coalesce("severity", "src_ip", "signature", F.lit("")).alias("name"),
        "count",
    ), "threats")
    order = W.partitionBy("section").orderBy(F.desc("count"), "name")
    lists = F.col("section").isin("source", "signature")
    ranked = rows.filter(lists).withColumn("_rank", F.row_number().over(order))
    every = rows.filter(~lists).unionByName(ranked.filter(F.col("_rank") <= top).drop("_rank"))
    return every.orderBy("section", F.desc("count"), "name")


def _matching(alerts: DataFrame, where: AlertFilter) -> DataFrame:
    level = where.level()
    tests = where.conditions() + ([] if level is None else [level])
    return alerts.filter(all_of(tests))


def alert_page(
    alerts: DataFrame, where: AlertFilter = AlertFilter(), page: int = 1, per_page: int = 50
) -> DataFrame:
    """one page of matching alerts, newest first."""
    chosen = page_slice(_matching(alerts, where).orderBy(F.desc("id")), page, per_page)
    blank = F.lit("")
    target = F.when(
        F.coalesce("dst_port", F.lit(0)) != 0, F.concat_ws(":", "dst_ip", F.col("dst_port").cast("string"))
    ).otherwise(F.col("dst_ip"))
    return chosen.select(
        "id",
        "timestamp",
        severity_name(F.col("severity_num")).alias("severity"),
        F.coalesce(F.nullif(F.col("signature"), blank), F.lit("Unknown Alert")).alias("signature"),
        F.coalesce("category", blank).alias("category"),
        F.coalesce("src_ip", blank).alias("src_ip"),
        F.coalesce("dst_ip", blank).alias("dst_ip"),
        "src_port",
        "dst_port",
        F.coalesce("proto", blank).alias("proto"),
        F.coalesce("action", F.lit("allowed")).alias("action"),
        F.concat(F.col("src_ip"), F.lit(" → "), target).alias("meta"),
    )


def alert_page_counts(
    alerts: DataFrame, where: AlertFilter = AlertFilter(), per_page: int = 50
) -> DataFrame:
    """matching rows, pages and the level cards, in one pass.

    The cards ignore the level filter, so it is a condition of the count only.
    """
    level = where.level()
    number = F.col("severity_num")
    counted = alerts.filter(all_of(where.conditions())).agg(
        (F.count("*") if level is None else F.count_if(level)).alias("n"),
        F.count_if(number == 1).alias("high_count"),
        F.count_if(number == 2).alias("medium_count"),
        F.count_if(number == 3).alias("low_count"),
    )
    return counted.select(*page_counts(F.col("n"), per_page), "high_count", "medium_count", "low_count")


def grouped_alerts(
    alerts: DataFrame, where: AlertFilter = AlertFilter(), page: int = 1, per_page: int = 50,
    shown: int = 5,
) -> DataFrame:
    """one page of alert groups (signature, level), newest group first.

    Of each group's addresses only the first ``shown`` are kept: they are made
    distinct and ranked before they are collected, so no group holds more.
    """
    chosen = _matching(alerts, where)
    keys = ["signature", "severity_num"]
    groups = chosen.groupBy(*keys).agg(
        F.max_by("category", "id").alias("category"),
        F.max_by("proto", "id").alias("proto"),
        F.count("*").alias("count"),
        F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"),
        F.max("id").alias("last_id"),
    )
    paged = page_slice(groups.orderBy(F.desc("last_id")), page, per_page)
    sides = F.explode(F.create_map(F.lit("src"), F.col("src_ip"), F.lit("dst"), F.col("dst_ip")))
    ends = chosen.select(*keys, sides.alias("side", "ip")).filter(F.col("ip").isNotNull()).distinct()
    order = W.partitionBy(*keys, "side").orderBy("ip")
    first = ends.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= shown)

    def listed(side: str):
        found = F.collect_list(F.when(F.col("side") == side, F.col("ip")))
        return F.sort_array(found).alias(f"{side}_ips")

    addresses = first.groupBy(*keys).agg(listed("src"), listed("dst"))
    joined = paged.join(addresses, keys, "left")
    return joined.select(
        F.coalesce(F.nullif(F.col("signature"), F.lit("")), F.lit("Unknown Alert")).alias("signature"),
        severity_name(F.col("severity_num")).alias("severity"),
        F.coalesce("category", F.lit("")).alias("category"),
        F.coalesce("proto", F.lit("")).alias("proto"),
        "count", "first_seen", "last_seen", "src_ips", "dst_ips", "last_id",
    ).orderBy(F.desc("last_id"))


def grouped_alert_counts(
    alerts: DataFrame, where: AlertFilter = AlertFilter(), per_page: int = 50
) -> DataFrame:
    """number of groups and pages."""
    groups = _matching(alerts, where).select("signature", "severity_num").distinct()
    return groups.agg(F.count("*").alias("n")).select(*page_counts(F.col("n"), per_page))


def latest_alert(alerts: DataFrame, after: int = 0) -> DataFrame:
    """the newest alert; with a cursor only when it is newer."""
    newest = alerts.orderBy(F.desc("id")).limit(1).filter(F.col("id") > after)
    return newest.select(
        "id",
        "timestamp",
        severity_name(F.col("severity_num")).alias("severity"),
        F.coalesce(F.nullif(F.col("signature"), F.lit("")), F.lit("Unknown Alert")).alias("title"),
        F.concat("src_ip", F.lit(" → "), "dst_ip").alias("meta"),
    )
