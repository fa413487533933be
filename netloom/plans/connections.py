"""Flow searches, pages and drill-down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from netloom.functions.fmt import bytes_si_text, endpoint, per_second
from netloom.functions.predicates import (
    ConnectionFilter, all_of, either_side, in_session, protocol_is, tag_contains,
)
from netloom.functions.rounding import exact_round

SEARCH_LIMIT = 100
ORDER_COLUMNS = ("total_bytes", "total_packets", "duration", "start_time")
RESULT = (
    "id", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "direction", "start_time",
    "end_time", "duration", "total_packets", "total_bytes", "state", "tags", "severity",
)


def _result(flows: DataFrame) -> DataFrame:
    """The columns a search returns, in one form for every caller."""
    shown = {"tags": F.array_join("tags", ",")} if "tags" in flows.columns else {"tags": F.lit("")}
    if "severity" not in flows.columns:
        shown["severity"] = F.lit("")
    return flows.withColumns(shown).select(*RESULT)


def top_connections(
    flows: DataFrame, limit: int = 50, order_by: str = "total_bytes", session_id: int | None = None
) -> DataFrame:
    """by one of four columns (anything else means bytes)."""
    column = order_by if order_by in ORDER_COLUMNS else "total_bytes"
    return _result(in_session(flows, session_id).orderBy(F.desc(column), "id").limit(limit))


def _search(flows: DataFrame, test: Column, session_id: int | None, limit: int | None) -> DataFrame:
    """Largest first; ``limit`` None gives every match by a distributed sort."""
    found = in_session(flows, session_id).filter(test).orderBy(F.desc("total_bytes"), "id")
    return _result(found if limit is None else found.limit(limit))


def search_by_ip(
    flows: DataFrame, ip: str, session_id: int | None = None, limit: int | None = SEARCH_LIMIT,
) -> DataFrame:
    """F8."""
    return _search(flows, either_side("src_ip", "dst_ip", ip), session_id, limit)


def search_by_protocol(
    flows: DataFrame, name: str, session_id: int | None = None, limit: int | None = SEARCH_LIMIT,
) -> DataFrame:
    """F9."""
    return _search(flows, protocol_is(name), session_id, limit)


def search_by_port(
    flows: DataFrame, port: int, session_id: int | None = None, limit: int | None = SEARCH_LIMIT,
) -> DataFrame:
    """F10."""
    return _search(flows, either_side("src_port", "dst_port", port), session_id, limit)


def search_by_tag(
    flows: DataFrame, text: str, session_id: int | None = None, limit: int | None = SEARCH_LIMIT,
) -> DataFrame:
    """F11."""
    return _search(flows, tag_contains(text), session_id, limit)


def page_slice(df: DataFrame, page: int, per_page: int) -> DataFrame:
    """One page of an ordered frame. Top-k of page * per_page rows."""
    return df.offset((page - 1) * per_page).limit(per_page)


def page_counts(rows: Column, per_page: int) -> list[Column]:
    pages = F.greatest(F.ceil(rows / per_page), F.lit(1)).cast("bigint")
    return [rows.alias("total_count"), pages.alias("total_pages")]


def connection_page(
    flows: DataFrame, where: ConnectionFilter = ConnectionFilter(), page: int = 1, per_page: int = 50
) -> DataFrame:
    """one page of matching flows, newest first, ready for display."""
    chosen = flows.filter(all_of(where.conditions())).orderBy(F.desc("id"))
    zero, blank = F.lit(0), F.lit("")
    shown = _with_tags(page_slice(chosen, page, per_page))
    return shown.select(
        "id",
        endpoint(F.col("src_ip"), F.col("src_port")).alias("src"),
        endpoint(F.col("dst_ip"), F.col("dst_port")).alias("dst"),
        "src_ip",
        "dst_ip",
        F.coalesce("src_port", zero).alias("src_port"),
        F.coalesce("dst_port", zero).alias("dst_port"),
        "protocol",
        F.coalesce("transport", blank).alias("transport"),
        F.coalesce("direction", F.lit("—")).alias("direction"),
        F.coalesce("total_packets", zero).alias("packets"),
        bytes_si_text(F.coalesce("total_bytes", zero)).alias("bytes"),
        F.coalesce("total_bytes", zero).alias("raw_bytes"),
        F.array_join("tags", ",").alias("tags"),
        F.col("start_time").alias("time"),
        "end_time",
        exact_round(F.coalesce("duration", F.lit(0.0)), 2).alias("duration"),
        F.coalesce("state", blank).alias("state"),
        F.coalesce("severity", blank).alias("severity"),
        F.coalesce("session_id", zero).alias("session_id"),
    )


def _with_tags(flows: DataFrame) -> DataFrame:
    missing = {}
    if "tags" not in flows.columns:
        missing["tags"] = F.array().cast("array<string>")
    if "severity" not in flows.columns:
        missing["severity"] = F.lit("")
    return flows.withColumns(missing)


def connection_page_counts(
    flows: DataFrame, where: ConnectionFilter = ConnectionFilter(), per_page: int = 50
) -> DataFrame:
    """matching rows and pages."""
    return flows.filter(all_of(where.conditions())).agg(F.count("*").alias("n")).select(
        *page_counts(F.col("n"), per_page)
    )


def distinct_protocols(table: DataFrame, column: str = "protocol") -> DataFrame:
    """sorted distinct labels."""
    name = F.col(column)
    filled = table.filter(name.isNotNull() & (name != "")) if column == "proto" else table
    return filled.select(name.alias("protocol")).distinct().orderBy("protocol")


def distinct_tags(flows: DataFrame) -> DataFrame:
    """sorted distinct single tags."""
    tags = flows.select(F.explode("tags").alias("t")).select(F.trim("t").alias("tag"))
    return tags.filter(F.col("tag") != "").distinct().orderBy("tag")


def _pair(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {"_a": F.least("src_ip", "dst_ip"), "_b": F.greatest("src_ip", "dst_ip")}
    )


def related_alerts(chosen: DataFrame, alerts: DataFrame, limit: int = 20) -> DataFrame:
    """the newest alerts between the same two addresses, either direction.

    Alerts are cut to ``limit`` per pair first (a per-task limit before the
    shuffle), so a busy pair never multiplies with its flows.
    """
    order = W.partitionBy("_a", "_b").orderBy(F.desc("timestamp"), F.desc("id"))
    newest = (
        _pair(alerts)
        .withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") <= limit)
        .select(
            "_a", "_b", F.col("id").alias("alert_id"), "timestamp", "severity", "signature",
            F.coalesce("category", F.lit("")).alias("category"),
            F.coalesce("proto", F.lit("")).alias("proto"),
            F.coalesce("action", F.lit("allowed")).alias("action"),
        )
    )
    return _pair(chosen.select("id", "src_ip", "dst_ip")).join(newest, ["_a", "_b"]).drop(
        "_a", "_b", "src_ip", "dst_ip"
    )


def sibling_connections(chosen: DataFrame, flows: DataFrame, limit: int = 10) -> DataFrame:
    """the newest other flows to the same destination."""
    order = W.partitionBy("dst_ip").orderBy(F.desc("start_time"), F.desc("id"))
    # one more than needed, since a flow may be among the newest itself
    newest = (
        flows.withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") <= limit + 1)
        .select(
            "dst_ip", "_rank", F.col("id").alias("other_id"), F.col("src_ip").alias("other_src"),
            "protocol", F.col("start_time").alias("time"), F.col("total_packets").alias("packets"),
            bytes_si_text(F.coalesce("total_bytes", F.lit(0))).alias("bytes"),
        )
    )
    pairs = chosen.select("id", "dst_ip").join(newest, "dst_ip").filter(F.col("id") != F.col("other_id"))
    again = W.partitionBy("id").orderBy("_rank")
    return (
        pairs.withColumn("_n", F.row_number().over(again)).filter(F.col("_n") <= limit).drop("_n", "_rank")
    )


def connection_details(
    chosen: DataFrame, reputation: DataFrame, known: DataFrame
) -> DataFrame:
    """the flow itself with rates, the reputation of both ends and the
    destination's history. ``chosen`` is any set of flows; for one id filter first."""
    score = reputation.select("ip", "abuse_score")
    src = score.select(F.col("ip").alias("src_ip"), F.col("abuse_score").alias("src_abuse_score"))
    dst = score.select(F.col("ip").alias("dst_ip"), F.col("abuse_score").alias("dst_abuse_score"))
    history = known.select(F.col("ip").alias("dst_ip"), "session_count", "total_bytes_avg")
    rate = per_second(F.coalesce("total_bytes", F.lit(0)), F.col("duration"))
    joined = chosen.join(src, "src_ip", "left").join(dst, "dst_ip", "left").join(history, "dst_ip", "left")
    return joined.select(
        "id", "src_ip", "dst_ip",
        bytes_si_text(F.coalesce("total_bytes", F.lit(0))).alias("bytes"),
        exact_round(F.coalesce("duration", F.lit(0.0)), 2).alias("duration"),
        F.concat(bytes_si_text(rate.cast("bigint")), F.lit("/s")).alias("data_rate"),
        per_second(F.col("total_packets"), F.col("duration")).alias("packets_per_sec"),
        "src_abuse_score", "dst_abuse_score", "session_count",
        F.when(
            F.col("session_count").isNotNull(),
            bytes_si_text(F.coalesce(F.col("total_bytes_avg").cast("bigint"), F.lit(0))),
        ).alias("avg_bytes"),
    )


def alert_context(chosen: DataFrame, alerts: DataFrame, limit: int = 3, cut: int = 60) -> DataFrame:
    """per flow the last alerts that touch either address, joined as text.

    Each address keeps its ``limit`` newest alerts, so a flow meets at most
    twice that many.
    """
    order = W.partitionBy("ip").orderBy(F.desc("alert_id"))
    touching = alerts.select(
        F.explode(F.array_distinct(F.array("src_ip", "dst_ip"))).alias("ip"),
        F.col("id").alias("alert_id"), "signature", "severity",
    )
    newest = touching.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= limit)
    ends = chosen.select("id", F.explode(F.array_distinct(F.array("src_ip", "dst_ip"))).alias("ip"))
    met = ends.join(newest, "ip").select("id", "alert_id", "signature", "severity").distinct()
    rows = F.slice(F.sort_array(F.collect_list(F.struct("alert_id", "severity", "signature")), False), 1, limit)
    text = F.transform(
        "rows", lambda r: F.concat(F.lit("["), r["severity"], F.lit("] "), F.substring(r["signature"], 1, cut))
    )
    grouped = met.groupBy("id").agg(rows.alias("rows"))
    return grouped.select(
        "id", F.size("rows").alias("alert_count"), F.array_join(text, "; ").alias("alerts")
    )


def connection_text_key() -> Column:
    """cache key of a flow's text."""
    parts = ["src_ip", "dst_ip", "protocol", "id"]
    return F.concat_ws("|", F.lit("conn"), *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts])


def alert_text_key() -> Column:
    """cache key of an alert's text; missing ports count as 0."""
    ports = [F.coalesce(F.col(p), F.lit(0)).cast("string") for p in ("src_port", "dst_port")]
    return F.concat_ws("|", "signature", "src_ip", "dst_ip", *ports)


def texts_missing(rows: DataFrame, cache: DataFrame, key: Column) -> DataFrame:
    """distinct keys that have no text yet."""
    return rows.select(key.alias("cache_key")).distinct().join(cache, "cache_key", "left_anti")


def texts_cached(rows: DataFrame, cache: DataFrame, key: Column) -> DataFrame:
    """rows with their stored text, null where it is missing."""
    keyed = rows.withColumn("cache_key", key)
    return keyed.join(cache.select("cache_key", "explanation"), "cache_key", "left")
