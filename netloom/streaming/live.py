"""Live pipelines.

Packets arrive as lines. Each micro-batch is parsed, freed of repeated frames
and folded into flow parts, which are appended to a log under their batch
number; a retried batch overwrites its own folder, so nothing counts twice. The
flow parts merge by the same minimum, maximum and sum as the batch aggregate,
and the current snapshot is that merge. The watermark only bounds how long
frame numbers are remembered.
"""

from __future__ import annotations

import dataclasses as dc
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from netloom.operators.alerts import (
    AlertRules, alerts_from_tags, apply_behaviour_rules, apply_ids_rules,
)
from netloom.operators.baseline import extend_baseline, observations
from netloom.operators.detectors import Context, tag_flows
from netloom.operators.dns import answers
from netloom.operators.flows import aggregate_flows, decode_flows, flow_parts, merge_flows
from netloom.operators.rebuild import relabel_parts, with_versions
from netloom.operators.tls import PAIR, apply_versions, first_versions
from netloom.sinks.tables import _hadoop, write_connections
from netloom.sources.ids import parse_ids_lines
from netloom.sources.packets import parse_packets

FLUSH = "2 seconds"
DELAY = "10 minutes"
Callback = Callable[[DataFrame, int], None]


def live_packets(
    lines: DataFrame, local_ips: Sequence[str] = (), delay: str = DELAY
) -> DataFrame:
    """S1 up to the flows: parse, then one row per frame within the watermark."""
    packets = parse_packets(lines, local_ips)
    timed = packets.withColumn("event_time", F.col("ts").cast("timestamp"))
    return (
        timed.withWatermark("event_time", delay)
        .dropDuplicatesWithinWatermark(["session_id", "frame_number"])
        .drop("event_time")
    )


def _exists(spark: SparkSession, path: str) -> bool:
    files, location = _hadoop(spark, path)
    return files.exists(location)


def _log(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def _versions(hellos: DataFrame) -> DataFrame:
    return hellos.groupBy(*PAIR).agg(
        F.min("first13").alias("first13"), F.min("first12").alias("first12")
    )


def current_flows(spark: SparkSession, root: str) -> DataFrame:
    """The snapshot of all flows seen so far.

    Parts logged before the hello that names their version arrived are relabelled
    here when all their frames follow it, so files may arrive in any order. Only
    a part whose frames lie on both sides of a late hello keeps the label it was
    given; the rebuild of C8 settles those.
    """
    parts = spark.read.parquet(f"{root}/flow_parts").drop("batch_id")
    versions = _versions(spark.read.parquet(f"{root}/hellos"))
    return decode_flows(merge_flows(relabel_parts(with_versions(parts, versions))))


def current_domains(spark: SparkSession, root: str) -> DataFrame:
    """The name last given to each address, by session: captures do not name each other's addresses."""
    pairs = spark.read.parquet(f"{root}/dns")
    newest = F.max_by("domain", F.struct("frame_number", "domain"))
    return pairs.groupBy("session_id", "ip").agg(newest.alias("domain"))


def observe_batch(spark: SparkSession, root: str, batch_id: int) -> None:
    """What each session of a batch has sent so far, one ledger row per session and destination.

    A row is the whole observation, not what the batch adds, and lies in the batch's folder; a retried
    batch writes the same rows again, and a later one of the session takes their place.
    """
    _log(observations(_touched(spark, root, batch_id)), f"{root}/observed", batch_id)


def current_baseline(spark: SparkSession, root: str, known: DataFrame, before: int | None = None) -> DataFrame:
    """``known`` with the observations of the stream, those of batches below ``before`` if it is given.
    Every session counts once, with its newest row."""
    if not _exists(spark, f"{root}/observed"):
        return known
    ledger = spark.read.parquet(f"{root}/observed")
    if before is not None:
        ledger = ledger.filter(F.col("batch_id") < before)
    newest = F.max_by(F.struct("bytes", "seen"), "batch_id")
    rows = ledger.groupBy("session_id", "ip").agg(newest.alias("r")).select("session_id", "ip", "r.*")
    return extend_baseline(known, rows)


def _touched(spark: SparkSession, root: str, batch_id: int) -> DataFrame:
    """Current flows of the sessions that a batch has parts of."""
    parts = spark.read.parquet(f"{root}/flow_parts").filter(F.col("batch_id") == batch_id)
    return current_flows(spark, root).join(parts.select("session_id").distinct(), "session_id", "left_semi")


def flow_writer(root: str, on_batch: Callback | None = None) -> Callback:
    """What a micro-batch of packets does."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        packets = batch.persist()
        _log(first_versions(packets), f"{root}/hellos", batch_id)
        hellos = spark.read.parquet(f"{root}/hellos").filter(F.col("batch_id") <= batch_id)
        labelled = apply_versions(packets, _versions(hellos))
        _log(aggregate_flows(flow_parts(labelled)), f"{root}/flow_parts", batch_id)
        replies = packets.filter((F.col("protocol") == "DNS") & F.col("info").contains("response"))
        found = replies.select("session_id", "frame_number", answers(F.col("info")).alias("a"))
        pairs = found.filter(F.col("a.domain").isNotNull()).select(
            "session_id", "frame_number", F.col("a.domain").alias("domain"),
            F.explode("a.ips").alias("ip"),
        )
        _log(pairs, f"{root}/dns", batch_id)
        if on_batch:
            on_batch(labelled, batch_id)
        packets.unpersist()

    return write


def start_flows(
    packets: DataFrame, root: str, on_batch: Callback | None = None, once: bool = False,
    ctx: Context | None = None, rules: AlertRules = AlertRules(), as_of: str | None = None,
) -> StreamingQuery:
    """Run the packet pipeline; ``once`` reads what is there and ends.

    With ``ctx`` each batch also replaces the stored snapshot of its sessions, logs the alerts that were
    not raised before, and then enters its observations in the ledger of the baseline. Detection
    sees ``ctx.known`` and the ledger as it was before the batch.
    """
    log = flow_writer(root, on_batch)

    def write(batch: DataFrame, batch_id: int) -> None:
        log(batch, batch_id)
        if ctx is not None:
            store_snapshot(batch.sparkSession, root, batch_id)
            detect_now(batch.sparkSession, root, ctx, batch_id, rules, as_of)
            observe_batch(batch.sparkSession, root, batch_id)

    writer = packets.writeStream.foreachBatch(write).option(
        "checkpointLocation", f"{root}/_checkpoint_flows"
    )
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=FLUSH)
    return writer.start()


def store_snapshot(spark: SparkSession, root: str, batch_id: int) -> None:
    """Replace the stored flows of the sessions that a batch has parts of."""
    write_connections(_touched(spark, root, batch_id), root)


def detect_now(
    spark: SparkSession, root: str, ctx: Context, batch_id: int, rules: AlertRules = AlertRules(),
    as_of: str | None = None,
) -> None:
    """S3: run all detectors over the flows of the batch's sessions and log alerts not raised before.

    An alert's identity is (session, destination, tag); the key counts as used
    even when a rule then drops the alert.
    """
    domains = ctx.domains if ctx.domains is not None else current_domains(spark, root)
    known = current_baseline(spark, root, ctx.known, before=batch_id)
    tagged = tag_flows(_touched(spark, root, batch_id), dc.replace(ctx, domains=domains, known=known))
    raised = alerts_from_tags(tagged, domains, rules, as_of)
    keys = ["session_id", "dst_display", "tag"]
    if _exists(spark, f"{root}/alerted"):
        before = spark.read.parquet(f"{root}/alerted").filter(F.col("batch_id") < batch_id)
        raised = raised.join(before.select(*keys), keys, "left_anti")
    raised = raised.persist()
    _log(apply_behaviour_rules(raised, rules), f"{root}/behaviour_alerts", batch_id)
    _log(raised.select(*keys), f"{root}/alerted", batch_id)
    raised.unpersist()


def start_ids_alerts(
    lines: DataFrame, root: str, session_id: int, rules: AlertRules = AlertRules(),
    on_batch: Callback | None = None, once: bool = False,
) -> StreamingQuery:
    """New engine events through the alert rules to the alert table."""
    alerts = apply_ids_rules(parse_ids_lines(lines), rules).withColumn(
        "session_id", F.lit(session_id)
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        _log(batch, f"{root}/ids_alerts", batch_id)
        if on_batch:
            on_batch(batch, batch_id)

    writer = alerts.writeStream.foreachBatch(write).option(
        "checkpointLocation", f"{root}/_checkpoint_ids"
    )
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=FLUSH)
    return writer.start()
