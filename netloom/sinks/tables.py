"""Parquet tables (A6-A9, G1-G5). Flows and alerts are partitioned by session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from netloom.operators import maintenance as M
from netloom.operators.baseline import extend_baseline, update_baseline
from netloom.operators.reputation import upsert_reputation
from netloom.schemas import (
    ALERTS, CONNECTIONS, IP_REPUTATION, KNOWN_DESTINATIONS, PROTOCOL_STATS, SESSIONS, TEXT_CACHE,
    evolve_schema,
)
from netloom.session import durable, stored

PARTITIONED = ("connections", "alerts")
SCHEMAS = {
    "connections": CONNECTIONS, "alerts": ALERTS, "sessions": SESSIONS,
    "protocol_stats": PROTOCOL_STATS,
}
# kept when sessions are cleared
LASTING = {"known_destinations": KNOWN_DESTINATIONS, "reputation": IP_REPUTATION, "texts": TEXT_CACHE}


def _path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}"


def _hadoop(spark: SparkSession, path: str):
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), location


def table_exists(spark: SparkSession, root: str, name: str) -> bool:
    files, location = _hadoop(spark, _path(root, name))
    return files.exists(location)


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table by its fixed schema; one not written yet is empty."""
    schema = {**SCHEMAS, **LASTING}[name]
    if not table_exists(spark, root, name):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(_path(root, name))


def _drop_partition(spark: SparkSession, root: str, name: str, session_id: int) -> None:
    files, location = _hadoop(spark, f"{_path(root, name)}/session_id={int(session_id)}")
    files.delete(location, True)


def _balanced(df: DataFrame) -> DataFrame:
    """Few, even files per session: small ones are merged, large ones split."""
    return df.hint("rebalance", "session_id")


def write_connections(flows: DataFrame, root: str, session_id: int | None = None) -> None:
    """Replace the whole snapshot of the sessions present in ``flows``.

    Counters are cumulative, so a new snapshot overwrites; other sessions stay.
    With ``session_id`` the snapshot is that session's, and an empty one leaves
    it without rows. A row without session fails the write.
    """
    required = F.assert_true(F.col("session_id").isNotNull(), F.lit("session_id is required"))
    rows = evolve_schema(flows, CONNECTIONS)
    if session_id is not None:
        rows = rows.filter(F.col("session_id") == session_id)
        _drop_partition(flows.sparkSession, root, "connections", session_id)
    rows = rows.filter(required.isNull())
    _balanced(rows).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("session_id").parquet(_path(root, "connections"))


def with_alert_defaults(alerts: DataFrame) -> DataFrame:
    """Defaults of a stored alert; absent columns are added."""
    defaults = {
        "severity": "LOW", "severity_num": 3, "signature": "", "signature_id": 0,
        "category": "", "src_ip": "", "dst_ip": "", "proto": "", "action": "allowed",
    }
    columns = []
    for field in ALERTS:
        value = F.col(field.name) if field.name in alerts.columns else F.lit(None)
        if field.name in defaults:
            value = F.coalesce(value, F.lit(defaults[field.name]))
        columns.append(value.cast(field.dataType).alias(field.name))
    return alerts.select(*columns)


def append_alerts(alerts: DataFrame, root: str) -> None:
    """A7."""
    _balanced(with_alert_defaults(alerts)).write.mode("append").partitionBy("session_id").parquet(
        _path(root, "alerts")
    )


def replace_table(df: DataFrame, root: str, name: str) -> None:
    """Overwrite a table with a plan that may read it."""
    durable(df).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(
        _path(root, name)
    )


def update_known_destinations(flows: DataFrame, root: str) -> None:
    """The stored baseline with the observations of one more session."""
    known = read_table(flows.sparkSession, root, "known_destinations")
    replace_table(update_baseline(known, flows), root, "known_destinations")


def extend_known_destinations(observed: DataFrame, root: str) -> None:
    """The stored baseline with the observations of any number of later sessions."""
    known = read_table(observed.sparkSession, root, "known_destinations")
    replace_table(extend_baseline(known, observed), root, "known_destinations")


def store_reputation(checked: DataFrame, root: str) -> None:
    """H1: the stored checks with newer ones put in."""
    known = read_table(checked.sparkSession, root, "reputation")
    replace_table(upsert_reputation(known, checked), root, "reputation")


def store_texts(texts: DataFrame, root: str) -> None:
    """texts by key; the newest of a key stays."""
    both = read_table(texts.sparkSession, root, "texts").unionByName(texts.select(*TEXT_CACHE.fieldNames()))
    newest = F.max_by(F.struct("explanation", "created_at"), F.struct("created_at", "explanation"))
    kept = both.groupBy("cache_key").agg(newest.alias("r")).select("cache_key", "r.*")
    replace_table(kept, root, "texts")


def delete_session(spark: SparkSession, root: str, session_id: int) -> bool:
    """G1: drop the session's partitions and row; False when there is none."""
    sessions = read_table(spark, root, "sessions")
    if sessions.filter(F.col("id") == session_id).isEmpty():
        return False
    for name in PARTITIONED:
        _drop_partition(spark, root, name, session_id)
    replace_table(M.without_session(sessions, session_id, "id"), root, "sessions")
    return True


def clear_all(spark: SparkSession, root: str) -> int:
    """Empty sessions, flows, alerts and protocol statistics; the baseline,
    reputation and text tables stay. Returns the number of sessions."""
    count = read_table(spark, root, "sessions").count()
    for name, schema in SCHEMAS.items():
        spark.createDataFrame([], schema).write.mode("overwrite").option(
            "partitionOverwriteMode", "static"
        ).parquet(_path(root, name))
    return count


def clear_session_flows(spark: SparkSession, root: str, session_id: int) -> None:
    """Drop one session's flows; protocol statistics follow from the rest."""
    _drop_partition(spark, root, "connections", session_id)
    refresh_protocol_stats(spark, root)


def refresh_protocol_stats(spark: SparkSession, root: str) -> None:
    stats = M.protocol_stats_from(read_table(spark, root, "connections"))
    replace_table(stats, root, "protocol_stats")


def _delete_flows(spark: SparkSession, root: str, doomed: Column) -> int:
    """Delete matching flows, rewriting only the sessions that hold any.

    The sessions are counted once and stored; those that keep rows are found by a
    join, those that keep none lose their folder, one after the other.
    """
    flows = read_table(spark, root, "connections")
    touched = stored(flows.groupBy("session_id").agg(
        F.count_if(doomed).alias("gone"), F.count("*").alias("rows")
    ).filter(F.col("gone") > 0), "touched")
    gone = touched.agg(F.coalesce(F.sum("gone"), F.lit(0))).first()[0]
    if gone:
        partial = touched.filter("gone < rows").select("session_id")
        kept = flows.filter(F.coalesce(~doomed, F.lit(True))).join(partial, "session_id", "left_semi")
        write_connections(stored(kept, "kept"), root)
        for row in touched.filter("gone = rows").toLocalIterator():
            _drop_partition(spark, root, "connections", row.session_id)
    return gone


def delete_older(spark: SparkSession, root: str, as_of: str, days: int = 30) -> int:
    """Flows that started more than ``days`` before ``as_of``."""
    return _delete_flows(spark, root, M.older_than(as_of, days))


def delete_date(spark: SparkSession, root: str, day: str) -> int:
    """Flows of one date; if any, protocol statistics are rebuilt."""
    deleted = _delete_flows(spark, root, M.started_on(day))
    if deleted:
        refresh_protocol_stats(spark, root)
    return deleted
