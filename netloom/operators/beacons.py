"""Periodic connections from one source to one destination."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from netloom.config import Tuning
from netloom.functions.address import is_multicast_key
from netloom.functions.rounding import fixed_text
from netloom.operators.dns import named
from netloom.operators.trust import after, is_unusual, trust_tier
from netloom.sources.networks import SEMI_TRUSTED, TRUSTED, Networks

RANGE_SECONDS = 3600
SECOND = 1_000_000  # microseconds

Scope = Sequence[str]
SESSION = ("session_id",)


def pair_groups(
    flows: DataFrame, domains: DataFrame | None, networks: Networks, tuning: Tuning, scope: Scope = ()
) -> DataFrame:
    """Candidate groups (src_ip, dst_key) with the addresses they cover.

    Flows are first reduced to (src_ip, dst_ip); names and trust tiers are
    looked up on that small table only. Returns one row per (src_ip, dst_ip) of
    every group that passes the count, multicast and trust rules.
    """
    cfg, semi = tuning.beaconing, tuning.semi_trusted
    port = F.col("dst_port")
    pairs = flows.groupBy(*scope, "src_ip", "dst_ip").agg(
        F.count("*").alias("n"),
        F.min("id").alias("first"),
        F.count("dst_port").alias("ports"),
        F.count_if(~port.isin(*semi.beaconing_safe_ports)).alias("odd_ports"),
        F.max(is_unusual(F.col("protocol"), semi)).alias("unusual"),
    )
    if domains is None:
        # a group is one address: no second aggregate is needed
        groups = pairs.withColumns({"dst_key": F.col("dst_ip"), "first_dst": after("dst_ip", "n")})
    else:
        pairs = named(pairs, domains).withColumn("dst_key", F.coalesce("domain", "dst_ip"))
        groups = pairs.groupBy(*scope, "src_ip", "dst_key").agg(
            F.sum("n").alias("n"),
            F.min_by("dst_ip", "first").alias("first_dst"),
            F.sum("ports").alias("ports"),
            F.sum("odd_ports").alias("odd_ports"),
            F.max("unusual").alias("unusual"),
        )
    key = after("dst_key", "n")
    suppressed = F.col("first_dst").isin(*cfg.always_suppress_destinations) | key.isin(
        *cfg.always_suppress_destinations
    )
    groups = groups.filter(
        (F.col("n") >= cfg.min_connections) & ~is_multicast_key(key) & ~suppressed
    ).withColumn("tier", trust_tier(F.col("first_dst"), networks))
    if cfg.suppress_whitelisted:
        usual = ~F.col("unusual") & (F.col("ports") > 0) & (F.col("odd_ports") == 0)
        dropped = (F.col("tier") == TRUSTED) | ((F.col("tier") == SEMI_TRUSTED) & usual)
        groups = groups.filter(~F.coalesce(dropped, F.lit(False)))
    if domains is None:
        return groups.select(*scope, "src_ip", F.col("dst_key").alias("dst_ip"), "dst_key", "tier")
    chosen = groups.select(*scope, "src_ip", "dst_key", "tier")
    return pairs.select(*scope, "src_ip", "dst_ip", "dst_key").join(
        chosen, [*scope, "src_ip", "dst_key"]
    )


def _chains(frame: pd.DataFrame, keys: Sequence[str]) -> pd.DataFrame:
    """Follow the 1-second rule inside every slot of a sorted frame.

    ``keys`` end with the slot. From each start the next kept one is the first
    more than a second later, so the rule is a pointer per start. For every start
    that a chain coming from the previous slot could enter at, report where the
    chain leaves the slot, how many starts it keeps and the sum of its squared
    intervals.
    """
    at = frame["at"].to_numpy()
    slot = frame["slot"].to_numpy()
    changed = np.zeros(len(at) - 1, dtype=bool)
    for key in keys:
        values = frame[key].to_numpy()
        changed |= values[1:] != values[:-1]
    part = np.concatenate([[0], np.cumsum(changed)])
    opening = slot * (RANGE_SECONDS * SECOND)
    # one increasing axis for all parts, so a single search serves them all
    span = (RANGE_SECONDS + 2) * SECOND
    axis = part * span + (at - opening)
    follow = np.searchsorted(axis, axis + SECOND, side="right")
    last = np.searchsorted(part, part, side="right")
    here = np.arange(len(at))
    follow = np.where(follow < last, follow, here)
    gap = (at[follow] - at) / 1e6
    leave, kept, squares = follow.copy(), (follow != here).astype(np.int64), gap * gap
    # double the length of every chain until all have reached their end
    while True:
        onward = leave[leave]
        if np.array_equal(onward, leave):
            break
        kept = kept + kept[leave]
        squares = squares + squares[leave]
        leave = onward
    first = np.searchsorted(part, part, side="left")
    early = at < opening + SECOND
    after = (here == first) | np.concatenate([[True], early[:-1]])
    pick = early | after
    found = frame.loc[pick, list(keys)].reset_index(drop=True)
    return found.assign(
        entry=at[pick], leave=at[leave][pick], kept=kept[pick] + 1, squares=squares[pick]
    )


def chain_batches(keys: Sequence[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Whole slots only: the last slot of a batch waits for the next batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            if not len(batch):
                continue
            frame = batch if held is None else pd.concat([held, batch], ignore_index=True)
            whole = np.zeros(len(frame), dtype=bool)
            for key in keys:
                values = frame[key].to_numpy()
                whole |= values != values[-1]
            held = frame[~whole].reset_index(drop=True)
            ready = frame[whole].reset_index(drop=True)
            if len(ready):
                yield _chains(ready, keys)
        if held is not None and len(held):
            yield _chains(held, keys)

    return run


def interval_stats(starts: DataFrame, scope: Scope = ()) -> DataFrame:
    """Kept starts, mean and sample deviation of their intervals per group.

    ``starts`` has one row per distinct (src_ip, dst_key, at in microseconds).
    A group is cut into hours: each hour is followed on its own from every start
    at which a chain could enter it, and the hours of a group are then joined
    end to end. An hour holds at most one row per distinct time, and what
    remains of it is only its first second, so no task sees a whole busy group.
    """
    group = [*scope, "src_ip", "dst_key"]
    keys = [*group, "slot"]
    slotted = starts.withColumn("slot", F.floor(F.col("at") / (RANGE_SECONDS * SECOND)))
    sorted_slots = slotted.select(*keys, "at").repartition(*keys).sortWithinPartitions(*keys, "at")
    incoming = sorted_slots.schema
    schema = T.StructType([incoming[key] for key in keys])
    for name in ("entry", "leave", "kept"):
        schema = schema.add(name, T.LongType())
    schema = schema.add("squares", T.DoubleType())
    chains = sorted_slots.mapInPandas(chain_batches(keys), schema)
    entries = F.sort_array(
        F.collect_list(F.struct("slot", "entry", "leave", "kept", "squares"))
    )
    begin = F.struct(
        F.lit(None).cast("bigint").alias("slot"),
        F.lit(None).cast("bigint").alias("first"),
        F.lit(None).cast("bigint").alias("leave"),
        F.lit(0).cast("bigint").alias("kept"),
        F.lit(0.0).alias("squares"),
    )

    def enter(acc: Column, e: Column) -> Column:
        gap = (e["entry"] - acc["leave"]) / 1e6
        taken = acc["slot"].isNull() | ((e["slot"] > acc["slot"]) & (gap > 1.0))
        new = F.struct(
            e["slot"].alias("slot"),
            F.coalesce(acc["first"], e["entry"]).alias("first"),
            e["leave"].alias("leave"),
            (acc["kept"] + e["kept"]).alias("kept"),
            (acc["squares"] + e["squares"] + F.coalesce(gap * gap, F.lit(0.0))).alias("squares"),
        )
        return F.when(taken, new).otherwise(acc)

    joined = chains.groupBy(*group).agg(F.aggregate(entries, begin, enter).alias("c"))
    n = F.col("c.kept") - 1
    mean = (F.col("c.leave") - F.col("c.first")) / 1e6 / n
    variance = F.greatest((F.col("c.squares") - n * mean * mean) / (n - 1), F.lit(0.0))
    return joined.select(
        *group,
        F.col("c.kept").alias("kept"),
        F.when(n > 0, mean).alias("mean"),
        F.when(n > 1, F.sqrt(variance)).otherwise(0.0).alias("stdev"),
    )


def beacon_pairs(
    flows: DataFrame, networks: Networks, tuning: Tuning = Tuning(), domains: DataFrame | None = None,
    scope: Scope = (),
) -> DataFrame:
    """Verdicts of D1: one row per (src_ip, dst_ip) whose group beacons.

    ``scope`` names further grouping columns, such as the session.
    """
    cfg = tuning.beaconing
    pairs = pair_groups(flows, domains, networks, tuning, scope)
    timed = flows.filter(F.col("start_time").isNotNull()).select(
        *scope, "src_ip", "dst_ip", F.unix_micros(F.col("start_time").cast("timestamp")).alias("at")
    )
    counted = (
        timed.join(pairs, [*scope, "src_ip", "dst_ip"])
        .groupBy(*scope, "src_ip", "dst_key", "at")
        .agg(F.count("*").alias("n"))
    )
    stats = interval_stats(counted, scope)
    cv = F.col("stdev") / F.col("mean")
    # kept starts never exceed timed flows, so this covers both count rules
    found = stats.filter((F.col("kept") >= cfg.min_connections) & (F.col("mean") >= 1.0))
    found = found.withColumn("cv", cv).filter(F.col("cv") < cfg.cv_threshold)
    reason = F.concat(
        F.col("kept").cast("string"), F.lit(" connections to "), F.col("dst_key"),
        F.lit(", interval ~"), fixed_text(F.col("mean"), 1), F.lit("s (CV="),
        fixed_text(F.col("cv"), 3), F.lit(")"),
    )
    shown = (*scope, "src_ip", "dst_ip", "dst_key", "kept", "mean", "cv", reason.alias("reason"))
    if domains is None and cfg.suppress_whitelisted:
        # trusted groups are gone already, and each group is its own address
        return found.withColumn("dst_ip", F.col("dst_key")).select(*shown)
    steady = (F.col("cv") < cfg.cv_floor_for_trusted) & (F.coalesce("tier", F.lit("")) == TRUSTED)
    return pairs.join(found, [*scope, "src_ip", "dst_key"]).filter(~steady).select(*shown)
