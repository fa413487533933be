"""Packets to flows and running counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window as W, functions as F

from netloom.functions.packet import TRANSPORTS
from netloom.functions.predicates import shown_in_feed
from netloom.session import stored

# fixed values; the position is the code held in aggregation buffers
TRANSPORT_CODES = (*TRANSPORTS, "UNKNOWN")
DIRECTION_CODES = ("INCOMING", "OUTGOING", "")
STATES = ("SYN_SENT", "ESTABLISHED", "FIN", "RST")


#: Repeated frame numbers that are still a small table beside the packets.
FEW_REPEATED = 1_000_000


def dedup_frames(packets: DataFrame, arrival: str | None = None) -> DataFrame:
    """One row per frame number of a session.

    The first to arrive when an ``arrival`` column exists, else the smallest
    row, so the choice does not depend on the partitioning.

    Repeated frames are rare, so only frame numbers are counted and shuffled
    for all rows, once, when this is called. Those seen more than once are stored
    as a table, and rows are joined to it as its size allows: the optimizer knows
    that size. The choice among copies is an aggregate, so copies collapse on the
    map side even when one number (0, for unreadable ones) holds a third of all
    rows. Where more than ``FEW_REPEATED`` numbers repeat, the joins would move
    every row, and twice; all rows go through the aggregate instead.
    """
    return dedup_and_count(packets, arrival)[0]


def dedup_and_count(packets: DataFrame, arrival: str | None = None) -> tuple[DataFrame, int]:
    """``dedup_frames``, and the number of rows of ``packets``."""
    keys = ["session_id", "frame_number"]
    rest = [c for c in packets.columns if c not in keys and c != arrival]
    seen = Observation()
    counts = packets.groupBy(*keys).agg(F.count("*").alias("_n")).observe(seen, F.sum("_n").alias("rows"))
    repeated = stored(counts.filter(F.col("_n") > 1).select(*keys), "repeated")
    row = F.struct(*rest)
    first = F.min(row) if arrival is None else F.min_by(row, F.struct(F.col(arrival), row))
    if repeated.count() > FEW_REPEATED:
        keyed = F.col("session_id").isNotNull() & F.col("frame_number").isNotNull()
        single = packets.filter(~keyed).select(*keys, *rest)
        copies = packets.filter(keyed)
    else:
        single = packets.join(repeated, keys, "left_anti").select(*keys, *rest)
        copies = packets.join(repeated, keys, "left_semi")
    copies = copies.groupBy(*keys).agg(first.alias("_r"))
    return single.unionByName(copies.select(*keys, "_r.*")), seen.get["rows"] or 0


def _flags_text(packets: DataFrame) -> Column:
    if packets.schema["tcp_flags"].dataType.typeName() == "array":
        return F.array_join("tcp_flags", ",")
    return F.replace(F.col("tcp_flags"), F.lit(" "), F.lit(""))


def _state_code(flags: Column) -> Column:
    """Position in STATES (from 1) for the recognised flag sets, in any order."""
    return (
        F.when(flags == "SYN", 1)
        .when(flags.isin("SYN,ACK", "ACK,SYN"), 2)
        .when(flags.isin("FIN", "FIN,ACK", "ACK,FIN"), 3)
        .when(flags.isin("RST", "RST,ACK", "ACK,RST"), 4)
    )


def _code(column: Column, values) -> Column:
    return F.array_position(F.array(*map(F.lit, values)), column).cast("int")


def _decode(code: Column, values, missing) -> Column:
    return F.when(code > 0, F.get(F.array(*map(F.lit, values)), code - 1)).otherwise(missing)


FLOW_KEYS = ("session_id", "lo_ip", "lo_port", "hi_ip", "hi_port", "label")


def _end(side: str) -> Column:
    """One endpoint; without two usable ports both count as 0."""
    has_ports = (F.coalesce("src_port", F.lit(0)) != 0) & (F.coalesce("dst_port", F.lit(0)) != 0)
    port = F.when(has_ports, F.col(f"{side}_port")).otherwise(0)
    return F.struct(F.col(f"{side}_ip").alias("ip"), port.alias("port"))


def flow_keys(packets: DataFrame, key: str = "label") -> DataFrame:
    """Packets with the columns of FLOW_KEYS; the endpoints are put in order, so
    both directions share a key."""
    low, high = F.least(_end("src"), _end("dst")), F.greatest(_end("src"), _end("dst"))
    label = F.coalesce(F.nullif(F.col("protocol"), F.lit("")), F.col("transport"))
    return packets.withColumns(
        {
            "lo_ip": low["ip"], "lo_port": low["port"], "hi_ip": high["ip"], "hi_port": high["port"],
            "label": label if key == "label" else F.col("transport"),
        }
    )


def flow_parts(packets: DataFrame, key: str = "label") -> DataFrame:
    """Per-packet inputs of the flow aggregate.

    Everything the first or last packet decides is a number: buffers of fixed
    width keep the aggregate in the hash path, where strings would force a sort.
    """
    state = _state_code(_flags_text(packets))
    return flow_keys(packets, key).select(
        *FLOW_KEYS,
        (_end("src") <= _end("dst")).alias("forward"),
        "src_port",
        "dst_port",
        _code(F.col("transport"), TRANSPORT_CODES).alias("transport_code"),
        _code(F.col("direction"), DIRECTION_CODES).alias("direction_code"),
        state.alias("state_code"),
        F.when(state.isNotNull(), F.col("frame_number")).alias("state_frame"),
        "frame_number",
        "ts",
        "packet_length",
    )


def aggregate_flows(parts: DataFrame) -> DataFrame:
    """The flow aggregate in coded form; parts of it merge by ``merge_flows``."""

    def first(name: str) -> Column:
        return F.min_by(name, "frame_number").alias(name)

    return parts.groupBy(*FLOW_KEYS).agg(
        F.min("frame_number").alias("first_frame"),
        F.max("frame_number").alias("last_frame"),
        first("forward"),
        first("src_port"),
        first("dst_port"),
        first("transport_code"),
        first("direction_code"),
        F.min_by("ts", "frame_number").alias("start_time"),
        F.max_by("ts", "frame_number").alias("end_time"),
        F.max_by("state_code", "state_frame").alias("state_code"),
        F.max("state_frame").alias("state_frame"),
        F.count("*").alias("total_packets"),
        F.sum("packet_length").alias("total_bytes"),
    )


def merge_flows(parts: DataFrame) -> DataFrame:
    """Coded parts of flows to one coded row per flow."""

    def first(name: str) -> Column:
        return F.min_by(name, "first_frame").alias(name)

    return parts.groupBy(*FLOW_KEYS).agg(
        *[
            first(name)
            for name in (
                "forward", "src_port", "dst_port", "transport_code", "direction_code", "start_time",
            )
        ],
        F.max_by("end_time", "last_frame").alias("end_time"),
        F.max_by("state_code", "state_frame").alias("state_code"),
        F.sum("total_packets").alias("total_packets"),
        F.sum("total_bytes").alias("total_bytes"),
        F.min("first_frame").alias("first_frame"),
        F.max("last_frame").alias("last_frame"),
    )


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1e6


def decode_flows(coded: DataFrame) -> DataFrame:
    """Coded flows to the connections model.

    ``id`` orders flows by first packet within a session, as insertion did.
    """
    forward = F.col("forward")
    start, end = F.col("start_time"), F.col("end_time")
    return coded.select(
        (F.shiftleft(F.col("session_id").cast("bigint"), 40) + F.col("first_frame")).alias("id"),
        F.when(forward, F.col("lo_ip")).otherwise(F.col("hi_ip")).alias("src_ip"),
        F.when(forward, F.col("hi_ip")).otherwise(F.col("lo_ip")).alias("dst_ip"),
        "src_port",
        "dst_port",
        F.col("label").alias("protocol"),
        _decode(F.col("transport_code"), TRANSPORT_CODES, "UNKNOWN").alias("transport"),
        _decode(F.col("direction_code"), DIRECTION_CODES, "").alias("direction"),
        "start_time",
        "end_time",
        F.coalesce(seconds_between(start, end), F.lit(0.0)).alias("duration"),
        "total_packets",
        "total_bytes",
        _decode(F.col("state_code"), STATES, "ACTIVE").alias("state"),
        "first_frame",
        "session_id",
    )


def build_flows(packets: DataFrame, key: str = "label") -> DataFrame:
    """Bidirectional flows of deduplicated packets.

    ``key='transport'`` joins the labels of one connection (off by default).
    """
    return decode_flows(aggregate_flows(flow_parts(packets, key)))


def running_counters(packets: DataFrame) -> DataFrame:
    """Packets and bytes per session in total, by transport, label and direction.

    One pass over the packets into a small table; the four groupings are then
    taken from that table.
    """
    cells = packets.groupBy("session_id", "transport", "protocol", "direction").agg(
        F.count("*").alias("n"), F.sum("packet_length").alias("b")
    )
    s, t, p, d = (F.col(c) for c in ("session_id", "transport", "protocol", "direction"))
    grouped = cells.groupingSets([[s], [s, t], [s, p], [s, d]], s, t, p, d).agg(
        F.grouping_id().alias("g"), F.sum("n").alias("packets"), F.sum("b").alias("bytes")
    )
    kind = (
        F.when(F.col("g") == 7, "total")
        .when(F.col("g") == 3, "transport")
        .when(F.col("g") == 5, "protocol")
        .otherwise("direction")
    )
    named = grouped.select(
        "session_id", kind.alias("kind"),
        F.coalesce("transport", "protocol", "direction", F.lit("")).alias("name"),
        "packets", "bytes",
    )
    known = (F.col("kind") != "direction") | F.col("name").isin("INCOMING", "OUTGOING")
    return named.filter(known)


def recent_packets(
    packets: DataFrame, after: int = 0, limit: int = 50, buffer: int = 500, session_id: int | None = None
) -> DataFrame:
    """The feed of one session, by default the latest. Rows after a cursor
    within its buffer, or the last ``limit``.

    Top-k on the frame number: each task keeps ``buffer`` rows.
    """
    from netloom.functions.fmt import cut, endpoint, short_ipv6
    from netloom.functions.rounding import exact_round

    latest = packets.agg(F.max("session_id")).scalar() if session_id is None else F.lit(session_id)
    own = packets.filter(F.col("session_id") == latest)
    feed = own.filter(shown_in_feed()).orderBy(F.desc("frame_number"))
    kept = feed.limit(buffer).filter(F.col("frame_number") > after) if after > 0 else feed.limit(limit)
    return kept.select(
        F.col("frame_number").alias("num"),
        exact_round(F.col("relative_time"), 3).alias("time"),
        F.col("protocol").alias("proto"),
        cut(endpoint(short_ipv6(F.col("src_ip")), F.col("src_port")), 28).alias("src"),
        cut(endpoint(short_ipv6(F.col("dst_ip")), F.col("dst_port")), 28).alias("dst"),
        F.col("packet_length").alias("length"),
        "direction",
        cut(F.coalesce("info", F.lit("")), 80).alias("info"),
    )


def packets_per_second(packets: DataFrame, trailing: int = 5) -> DataFrame:
    """Rate over the samples of the last ``trailing`` seconds, truncated.

    A sample is the running packet count at each second with traffic. Packets
    are first counted per second, so the window sees seconds, not packets.
    """
    second = F.unix_seconds(F.col("ts").cast("timestamp"))
    counts = packets.groupBy("session_id", second.alias("second")).agg(F.count("*").alias("n"))
    order = W.partitionBy("session_id").orderBy("second")
    recent = order.rangeBetween(-trailing, 0)
    sampled = counts.withColumn("total", F.sum("n").over(order.rowsBetween(W.unboundedPreceding, 0)))
    gained = F.col("total") - F.min("total").over(recent)
    elapsed = F.col("second") - F.min("second").over(recent)
    rate = F.when(elapsed > 0, F.floor(gained / elapsed)).otherwise(0).cast("bigint")
    return sampled.select("session_id", "second", F.col("total").alias("packets"), rate.alias("pps"))


def override_totals(totals: DataFrame, stored: DataFrame, live: DataFrame) -> DataFrame:
    """Total - stored(live session) + authoritative counters.

    ``totals`` is one row (total_packets, total_bytes); ``stored`` has sums per
    session; ``live`` holds the sessions being captured with their own counters.
    """
    both = live.join(stored, "session_id", "left")

    def change(live_name: str, stored_name: str) -> Column:
        gained = F.sum(F.col(live_name) - F.coalesce(stored_name, F.lit(0)))
        return both.agg(F.coalesce(gained, F.lit(0)).alias("d")).scalar()

    return totals.select(
        (F.col("total_packets") + change("live_packets", "total_packets")).alias("total_packets"),
        (F.col("total_bytes") + change("live_bytes", "total_bytes")).alias("total_bytes"),
    )
