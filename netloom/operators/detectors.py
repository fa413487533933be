"""Volume and novelty detectors, and their tags on flows."""

from __future__ import annotations

import dataclasses as dc
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, functions as F

from netloom.config import MB, Tuning
from netloom.functions.address import is_private
from netloom.functions.rounding import fixed_text
from netloom.operators.beacons import SESSION, Scope, beacon_pairs
from netloom.operators.trust import after, is_unusual, trust_tier
from netloom.sources.networks import SEMI_TRUSTED, TRUSTED, Networks

# fixed values: tags in the order they are attached
TAGS = ("beaconing", "data_exfil", "new_dest", "traffic_anomaly")
SEVERITY_RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1}


def _megabytes(value: Column) -> Column:
    return F.concat(fixed_text(value / MB, 1), F.lit(" MB"))


def _tier_is(name: str) -> Column:
    return F.coalesce(F.col("tier") == name, F.lit(False))


def destination_totals(
    flows: DataFrame, networks: Networks, tuning: Tuning, scope: Scope = ()
) -> DataFrame:
    """Bytes per public destination, outgoing and in all, with its trust tier.

    One aggregate feeds D2, D3 and D4; partial sums take care of busy addresses.
    """
    outgoing = F.col("direction") == "OUTGOING"
    unusual = is_unusual(F.col("protocol"), tuning.semi_trusted)
    totals = flows.groupBy(*scope, "dst_ip").agg(
        F.count("*").alias("flows"),
        F.sum("total_bytes").alias("bytes"),
        F.max(unusual).alias("unusual"),
        F.sum(F.when(outgoing, F.col("total_bytes"))).alias("out_bytes"),
        F.max(F.when(outgoing, unusual)).alias("out_unusual"),
    )
    # address tests run once per destination, after the aggregate
    address = after("dst_ip", "flows")
    return totals.filter(~is_private(address)).withColumn("tier", trust_tier(address, networks))


def with_baseline(totals: DataFrame, known: DataFrame) -> DataFrame:
    """Totals beside their baseline row; ``session_count`` is null for new ones."""
    history = known.select(F.col("ip").alias("dst_ip"), "session_count", "total_bytes_avg")
    return totals.join(history, "dst_ip", "left")


def _exfil(tuning: Tuning) -> Column:
    """Verdict of D2 on a row of totals: (tag, severity, reason) or null."""
    cfg, semi = tuning.data_exfil, tuning.semi_trusted
    total, is_semi = F.col("out_bytes"), _tier_is(SEMI_TRUSTED)
    severity = (
        F.when(is_semi & (total >= semi.exfil_always_alert_bytes) & F.col("out_unusual"), "high")
        .when(is_semi & (total >= semi.exfil_always_alert_bytes), semi.exfil_demoted_severity)
        .when(~is_semi & (total >= cfg.threshold_high_bytes), "high")
        .when(~is_semi & (total >= cfg.threshold_medium_bytes), "medium")
    )
    if cfg.suppress_whitelisted:
        severity = F.when(~_tier_is(TRUSTED), severity)
    reason = F.concat(
        _megabytes(total), F.lit(" uploaded to "), F.col("dst_ip"),
        F.when(is_semi, " (semi-trusted)").otherwise(""),
    )
    return _verdict("data_exfil", severity, reason)


def _anomaly(tuning: Tuning) -> Column:
    """Verdict of D4 on totals with baseline."""
    cfg, semi = tuning.traffic_anomaly, tuning.semi_trusted
    total, mean = F.col("bytes"), F.col("total_bytes_avg")
    ratio = total / mean
    small = _tier_is(SEMI_TRUSTED) & (total < semi.suppress_max_bytes) & ~F.col("unusual")
    odd = (
        (total >= cfg.min_absolute_bytes) & ~small
        & (F.col("session_count") >= cfg.min_observations)
        & (mean >= cfg.min_average_bytes) & (ratio >= cfg.multiplier)
    )
    if cfg.suppress_whitelisted:
        odd = odd & ~_tier_is(TRUSTED)
    reason = F.concat(
        F.col("dst_ip"), F.lit(": "), _megabytes(total), F.lit(" this session vs "),
        _megabytes(mean), F.lit(" average ("), fixed_text(ratio, 1), F.lit("×)"),
    )
    return _verdict("traffic_anomaly", F.when(odd, "medium"), reason)


def _unknown(tuning: Tuning) -> Column:
    """D3 per destination: null when known or trusted, else whether semi-trusted
    rules apply to its flows."""
    suppress = tuning.new_dest.suppress_whitelisted
    new = F.col("session_count").isNull()
    if suppress:
        new = new & ~_tier_is(TRUSTED)
    return F.when(new, _tier_is(SEMI_TRUSTED) & F.lit(suppress))


def _verdict(tag: str, severity: Column, reason: Column) -> Column:
    found = F.struct(F.lit(tag).alias("tag"), severity.alias("severity"), reason.alias("reason"))
    return F.when(severity.isNotNull(), found)


def _new_flow(tuning: Tuning, learning: bool) -> Column:
    """Per-flow half of D3, given ``semi`` of an unknown destination."""
    small = F.col("total_bytes") < tuning.semi_trusted.suppress_max_bytes
    quiet = F.col("semi") & small & ~is_unusual(F.col("protocol"), tuning.semi_trusted)
    shown = F.col("semi").isNotNull() & ~quiet
    if not learning and tuning.new_dest.post_learning_https_only_suppress:
        shown = shown & ~F.coalesce(F.col("dst_port").isin(443, 80), F.lit(False))
    return F.coalesce(shown, F.lit(False))


def _new_severity(tuning: Tuning, learning: bool) -> str:
    return tuning.new_dest.learning_period_severity if learning else "low"


def _finding(flows: DataFrame) -> DataFrame:
    """One row per flow and finding ``f``."""
    return flows.select("id", "f.tag", "f.severity", "f.reason")


def detect_beaconing(
    flows: DataFrame, networks: Networks, tuning: Tuning = Tuning(), domains: DataFrame | None = None,
    scope: Scope = SESSION,
) -> DataFrame:
    """(id, tag, severity, reason) of every flow in a beaconing group.

    In all detectors ``scope`` names the columns within which flows are judged: by
    default each session on its own, with ``()`` the given flows together.
    """
    keys = [*scope, "src_ip", "dst_ip"]
    found = beacon_pairs(flows, networks, tuning, domains, scope).select(*keys, _beacon().alias("f"))
    return _finding(flows.join(found, keys))


def _beacon() -> Column:
    return _verdict("beaconing", F.lit("high"), F.col("reason"))


def _join_verdict(flows: DataFrame, totals: DataFrame, verdict: Column, scope: Scope) -> DataFrame:
    keys = [*scope, "dst_ip"]
    found = totals.select(*keys, verdict.alias("f")).filter(F.col("f").isNotNull())
    return flows.join(found, keys)


def detect_data_exfil(
    flows: DataFrame, networks: Networks, tuning: Tuning = Tuning(), scope: Scope = SESSION
) -> DataFrame:
    """D2."""
    totals = destination_totals(flows, networks, tuning, scope)
    outgoing = flows.filter(F.col("direction") == "OUTGOING")
    return _finding(_join_verdict(outgoing, totals, _exfil(tuning), scope))


def _first_connection(tuning: Tuning, learning: bool) -> Column:
    reason = F.concat(F.lit("First connection to "), F.col("dst_ip"))
    return _verdict("new_dest", F.lit(_new_severity(tuning, learning)), reason)


def detect_new_destination(
    flows: DataFrame, known: DataFrame, networks: Networks, as_of: date | datetime | str,
    tuning: Tuning = Tuning(),
) -> DataFrame:
    """D3."""
    learning = tuning.learning(as_of)
    totals = with_baseline(destination_totals(flows, networks, tuning), known)
    new = totals.select("dst_ip", _unknown(tuning).alias("semi")).filter(F.col("semi").isNotNull())
    found = flows.join(new, "dst_ip").filter(_new_flow(tuning, learning))
    return _finding(found.withColumn("f", _first_connection(tuning, learning)))


def detect_traffic_anomaly(
    flows: DataFrame, known: DataFrame, networks: Networks, tuning: Tuning = Tuning(),
    scope: Scope = SESSION,
) -> DataFrame:
    """D4."""
    totals = with_baseline(destination_totals(flows, networks, tuning, scope), known)
    return _finding(_join_verdict(flows, totals, _anomaly(tuning), scope))


@dc.dataclass(frozen=True)
class Context:
    """What the detectors need beside the flows."""

    known: DataFrame
    networks: Networks
    as_of: date | datetime | str
    tuning: Tuning = Tuning()
    domains: DataFrame | None = None
    scope: Scope = SESSION  # each capture run is judged on its own


def tag_flows(flows: DataFrame, ctx: Context) -> DataFrame:
    """All detectors at once; adds ``findings``, ``tags`` and ``severity``.

    Verdicts are per destination (or pair): one aggregate, joined once to the
    baseline, gives those of D2-D4. Flows meet the two verdict tables and are
    never regrouped. ``findings`` is an array of (tag, severity, reason) in
    detector order.
    """
    tuning, learning = ctx.tuning, ctx.tuning.learning(ctx.as_of)
    at, pair = [*ctx.scope, "dst_ip"], [*ctx.scope, "src_ip", "dst_ip"]
    totals = destination_totals(flows, ctx.networks, tuning, ctx.scope)
    verdicts = with_baseline(totals, ctx.known).select(
        *at, _exfil(tuning).alias("exfil"), _anomaly(tuning).alias("odd"),
        _unknown(tuning).alias("semi"),
    ).filter("exfil IS NOT NULL OR odd IS NOT NULL OR semi IS NOT NULL")
    beacons = beacon_pairs(flows, ctx.networks, tuning, ctx.domains, ctx.scope).select(
        *pair, _beacon().alias("beacon")
    )
    joined = flows.drop("tags", "severity").join(verdicts, at, "left").join(beacons, pair, "left")
    findings = F.array_compact(
        F.array(
            F.col("beacon"),
            F.when(F.col("direction") == "OUTGOING", F.col("exfil")),
            F.when(_new_flow(tuning, learning), _first_connection(tuning, learning)),
            F.col("odd"),
        )
    )
    return assemble(joined.withColumn("findings", findings).drop("beacon", "exfil", "odd", "semi"))


def assemble(flows: DataFrame) -> DataFrame:
    """Tags and the highest severity out of ``findings``; ties go to the first."""
    ranks = F.create_map(*[F.lit(v) for pair in SEVERITY_RANK.items() for v in pair])

    def rank(severity: Column) -> Column:
        return F.coalesce(F.try_element_at(ranks, severity), F.lit(0))

    def higher(best: Column, f: Column) -> Column:
        return F.when(best.isNull() | (rank(f["severity"]) > rank(best)), f["severity"]).otherwise(best)

    top = F.aggregate("findings", F.lit(None).cast("string"), higher)
    return flows.withColumns(
        {
            "tags": F.transform("findings", lambda f: f["tag"]),
            "severity": F.coalesce(top, F.lit("")),
        }
    )
