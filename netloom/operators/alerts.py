"""Alert rules."""

from __future__ import annotations

import dataclasses as dc
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from netloom.config import read_yaml
from netloom.operators.dns import named
from netloom.functions.address import address_key, network_range
from netloom.sources.networks import RateLimit, SuppressRule

# fixed values
IDS_LEVELS = {1: "CRITICAL", 2: "HIGH", 3: "MEDIUM", 4: "LOW"}
LEVELS = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
TAG_TITLES = {
    "beaconing": "Beaconing Detected",
    "data_exfil": "Data Exfiltration",
    "new_dest": "New Destination",
    "traffic_anomaly": "Traffic Anomaly",
}
# (severity, number, LIKE pattern); a later match overrides an earlier one
RECLASSIFICATION = [
    ("HIGH", 1, "%BRUTE%FORCE%"), ("HIGH", 1, "%SCAN%Scan%"), ("HIGH", 1, "%Rapid Port Scan%"),
    ("HIGH", 1, "%Data Exfiltration%"), ("MEDIUM", 2, "%Beaconing Detected%"),
    ("MEDIUM", 2, "%Traffic Anomaly%"), ("MEDIUM", 2, "SURICATA%"),
    ("MEDIUM", 2, "%FILE_SHARING%"), ("LOW", 3, "ET INFO%"), ("LOW", 3, "ET POLICY%"),
    ("LOW", 3, "ET DNS%"), ("LOW", 3, "%New Destination%"), ("LOW", 3, "%GNU/Linux APT%"),
]
BEHAVIOUR_REMAP = {
    "data_exfil": "HIGH", "beaconing": "MEDIUM", "traffic_anomaly": "MEDIUM", "new_dest": "LOW",
}


@dc.dataclass(frozen=True)
class AlertRules:
    """Remap and protection rules. ``sensor`` is the word that the local rule
    set puts before its own signatures; without it the rules for those are left out."""

    sensor: str = ""
    behaviour: tuple[tuple[str, str], ...] = tuple(BEHAVIOUR_REMAP.items())
    # fixed values, in order: first contained key wins; {sensor} is filled in
    signatures: tuple[tuple[str, str], ...] = (
        ("{sensor}BRUTE_FORCE", "HIGH"), ("{sensor}SCAN", "HIGH"), ("ET_SCAN", "HIGH"),
        ("SURICATA", "MEDIUM"), ("ET_FILE_SHARING", "MEDIUM"), ("ET_INFO", "LOW"),
        ("ET_POLICY", "LOW"), ("ET_DNS", "LOW"), ("ET_GNU", "LOW"),
    )
    protected_patterns: tuple[str, ...] = (
        "{sensor}BRUTE-FORCE SSH Password Spray", "{sensor}BRUTE-FORCE SSH Brute Force Detected",
    )
    protected_keywords: tuple[str, ...] = ("BRUTE-FORCE SSH", "LATERAL", "MALWARE", "EXPLOIT", "C2")
    protected_pairs: tuple[tuple[str, str, int | None], ...] = ()
    protected_ids: tuple[int, ...] = (2001219, 2003068, 2019284, 2210000)

    def usable(self, template: str) -> bool:
        return bool(self.sensor) or "{sensor}" not in template

    def text(self, template: str) -> str:
        return template.replace("{sensor}", f"{self.sensor} " if self.sensor else "")


def load_rules(remap_path: str, protect_path: str, sensor: str = "") -> AlertRules:
    """Rules from the two YAML files, read on the driver."""
    remap, protect = read_yaml(remap_path), read_yaml(protect_path)

    def severities(section: str, other: str) -> tuple[tuple[str, str], ...]:
        entries = remap.get(section) or remap.get(other) or {}
        return tuple((k, v["severity"]) for k, v in entries.items() if v and v.get("severity"))

    def field(section: str, name: str) -> tuple:
        return tuple(e[name] for e in protect.get(section) or [] if e.get(name))

    return AlertRules(
        sensor=sensor,
        behaviour=severities("behavioral", "behaviour"),
        signatures=severities("suricata", "signatures"),
        protected_patterns=field("confirmed_alerts", "signature_pattern"),
        protected_keywords=field("protected_categories", "match_signature"),
        protected_pairs=tuple(
            (p.get("source", ""), p.get("destination", ""), p.get("port"))
            for p in protect.get("protected_ip_pairs") or []
        ),
        protected_ids=field("protected_sids", "sid"),
    )


def ids_severity(number: Column) -> Column:
    """Label of an engine's severity number; unknown is LOW."""
    levels = F.create_map(*[F.lit(v) for pair in IDS_LEVELS.items() for v in pair])
    return F.coalesce(F.try_element_at(levels, number), F.lit("LOW"))


def _any(tests: list[Column]) -> Column:
    found = reduce(lambda a, b: a | b, tests, F.lit(False))
    return F.coalesce(found, F.lit(False))


def is_protected(rules: AlertRules = AlertRules()) -> Column:
    """Never remapped and never dropped."""
    signature = F.col("signature")
    tests = [signature.contains(rules.text(p)) for p in rules.protected_patterns if rules.usable(p)]
    tests += [F.upper(signature).contains(k.upper()) for k in rules.protected_keywords]
    for source, target, port in rules.protected_pairs:
        pair = (F.col("src_ip") == source) & (F.col("dst_ip") == target)
        tests.append(pair if port is None else pair & F.coalesce(F.col("dst_port") == port, F.lit(False)))
    if rules.protected_ids:
        tests.append(F.col("signature_id").isin(*rules.protected_ids))
    return _any([F.coalesce(t, F.lit(False)) for t in tests])


def _plain(text: str) -> str:
    return text.replace("_", " ").replace("-", " ").upper()


def remapped_signature(rules: AlertRules = AlertRules()) -> Column:
    """Severity by the first rule whose key the signature contains."""
    signature = F.translate(F.upper("signature"), "-_", "  ")
    chain = None
    for key, severity in rules.signatures:
        if not rules.usable(key):
            continue
        test = signature.contains(_plain(rules.text(key)))
        chain = F.when(test, severity) if chain is None else chain.when(test, severity)
    return F.col("severity") if chain is None else F.coalesce(chain, F.col("severity"))


def _number(severity: Column, table: dict[str, int]) -> Column:
    names = F.create_map(*[F.lit(v) for pair in table.items() for v in pair])
    return F.coalesce(F.try_element_at(names, F.upper(severity)), F.lit(3))


IDS_NUMBERS = {"LOW": 3, "MEDIUM": 2, "HIGH": 1, "CRITICAL": 1}
BEHAVIOUR_NUMBERS = {**IDS_NUMBERS, "INFO": 4}


def apply_ids_rules(alerts: DataFrame, rules: AlertRules = AlertRules()) -> DataFrame:
    """E3-E5 on engine alerts: protect, remap, drop SUPPRESS."""
    kept = alerts.withColumns({"_safe": is_protected(rules), "_new": remapped_signature(rules)})
    kept = kept.filter(F.col("_safe") | (F.upper("_new") != "SUPPRESS"))
    number = F.when(F.col("_safe"), F.col("severity_num")).otherwise(_number(F.col("_new"), IDS_NUMBERS))
    label = F.when(F.col("_safe"), F.col("severity")).otherwise(F.col("_new"))
    return kept.withColumns({"severity_num": number, "severity": label}).drop("_safe", "_new")


def apply_behaviour_rules(alerts: DataFrame, rules: AlertRules = AlertRules()) -> DataFrame:
    """E2, E4, E5 on behavioural alerts, which carry their ``tag``."""
    table = dict(rules.behaviour)
    names = F.create_map(*[F.lit(v) for pair in table.items() for v in pair]) if table else None
    mapped = F.try_element_at(names, F.col("tag")) if table else F.lit(None)
    kept = alerts.withColumns(
        {"_safe": is_protected(rules), "_new": F.upper(F.coalesce(mapped, F.col("severity")))}
    ).filter(F.col("_safe") | (F.col("_new") != "SUPPRESS"))
    number = F.when(F.col("_safe"), F.col("severity_num")).otherwise(
        _number(F.col("_new"), BEHAVIOUR_NUMBERS)
    )
    label = F.when(F.col("_safe"), F.col("severity")).otherwise(F.col("_new"))
    return kept.withColumns({"severity_num": number, "severity": label}).drop("_safe", "_new")


def alerts_from_tags(
    tagged: DataFrame, domains: DataFrame | None = None, rules: AlertRules = AlertRules(),
    as_of: str | None = None,
) -> DataFrame:
    """One alert per session, destination (name if known) and tag; the first
    flow wins. The rank filter becomes a per-task limit before the shuffle, so a
    busy destination sends one row per task."""
    flows = tagged.filter(F.size("findings") > 0)
    if domains is None:
        flows = flows.withColumn("dst_display", F.col("dst_ip"))
    else:
        flows = named(flows, domains).withColumn("dst_display", F.coalesce("domain", "dst_ip"))
    found = flows.withColumn("f", F.explode("findings")).withColumn("tag", F.col("f.tag"))
    order = W.partitionBy("session_id", "dst_display", "tag").orderBy("id")
    first = found.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") == 1)
    titles = F.create_map(*[F.lit(v) for pair in TAG_TITLES.items() for v in pair])
    title = F.coalesce(F.try_element_at(titles, F.col("tag")), F.col("tag"))
    when = F.col("end_time") if as_of is None else F.lit(as_of).cast("timestamp_ntz")
    level = F.col("f.severity")
    return first.select(
        when.alias("timestamp"),
        F.upper(level).alias("severity"),
        _number(level, IDS_NUMBERS).alias("severity_num"),
        F.concat(F.lit(rules.text("{sensor}BEHAVIOR ")), title, F.lit(" — "), F.col("f.reason")).alias("signature"),
        F.lit(0).cast("bigint").alias("signature_id"),
        F.concat(F.lit("Behavioral: "), F.col("tag")).alias("category"),
        "src_ip",
        "dst_ip",
        "src_port",
        "dst_port",
        F.col("protocol").alias("proto"),
        F.lit("allowed").alias("action"),
        "session_id",
        "tag",
        "dst_display",
    )


def behaviour_alerts(
    tagged: DataFrame, domains: DataFrame | None = None, rules: AlertRules = AlertRules(),
    as_of: str | None = None,
) -> DataFrame:
    """E1, E2, E4, E5 together."""
    return apply_behaviour_rules(alerts_from_tags(tagged, domains, rules, as_of), rules)


def reclassify(alerts: DataFrame) -> DataFrame:
    """The cascade of LIKE rules, then numbers made to agree with labels.

    Later rules overwrite earlier ones, so they are tested in reverse order.
    """
    chain = None
    for severity, number, pattern in reversed(RECLASSIFICATION):
        test = F.col("signature").ilike(pattern)
        value = F.struct(F.lit(severity).alias("s"), F.lit(number).alias("n"))
        chain = F.when(test, value) if chain is None else chain.when(test, value)
    current = F.struct(F.col("severity").alias("s"), F.col("severity_num").alias("n"))
    ruled = alerts.withColumn("_r", chain.otherwise(current))
    label = F.col("_r.s")
    number = (
        F.when(label.isin("LOW", "low"), 3)
        .when(label.isin("MEDIUM", "medium"), 2)
        .when(label.isin("HIGH", "high", "CRITICAL", "critical"), 1)
        .otherwise(F.col("_r.n"))
    )
    return ruled.withColumns({"severity": label, "severity_num": number}).drop("_r")


def _tracked(track: str) -> str:
    return "src_ip" if track == "by_src" else "dst_ip"


def suppress_by_network(alerts: DataFrame, suppress: Sequence[SuppressRule]) -> DataFrame:
    """Drop alerts whose signature id (0 = any) and tracked end match a rule.

    Addresses are judged once each: those inside a rule's network keep the ids
    that are suppressed for them, and alerts are joined to that list.
    """
    kept = alerts
    for side in ("src_ip", "dst_ip"):
        rules = [
            (bounds, rule.signature_id) for rule in suppress
            if _tracked(rule.track) == side and (bounds := network_range(rule.network)) is not None
        ]
        if not rules:
            continue
        key = F.col("_key")
        ids = F.array_compact(F.array(*[
            F.when(key.between(*bounds), F.lit(sid).cast("bigint")) for bounds, sid in rules
        ]))
        held = alerts.select(F.col(side).alias("_ip")).distinct().withColumn("_key", address_key(F.col("_ip")))
        held = held.select("_ip", ids.alias("_ids")).filter(F.size("_ids") > 0)
        gone = F.array_contains("_ids", F.lit(0).cast("bigint")) | F.array_contains("_ids", F.col("signature_id").cast("bigint"))
        joined = kept.join(held, F.col(side) == F.col("_ip"), "left")
        kept = joined.filter(~F.coalesce(gone, F.lit(False))).select(*alerts.columns)
    return kept


def limit_rate(alerts: DataFrame, limits: Sequence[RateLimit]) -> DataFrame:
    """At most ``count`` alerts per signature, tracked end and time window.

    Windows are aligned to the epoch. Alerts without a limit pass by without a
    shuffle. The limits of the others are literal lookups, so one rank serves
    all rules; its largest count limits each task before the shuffle.
    """
    rules = {rule.signature_id: rule for rule in limits}  # one per signature
    if not rules:
        return alerts

    def setting(field: str) -> Column:
        pairs = [v for sid, r in rules.items() for v in (F.lit(sid).cast("bigint"), F.lit(getattr(r, field)))]
        return F.try_element_at(F.create_map(*pairs), F.col("signature_id").cast("bigint"))

    limited = F.coalesce(F.col("signature_id").isin(*rules), F.lit(False))
    second = F.unix_seconds(F.col("timestamp").cast("timestamp"))
    tracked = F.when(setting("track") == "by_src", F.col("src_ip")).otherwise(F.col("dst_ip"))
    keyed = alerts.filter(limited).withColumns(
        {"_who": tracked, "_slot": F.floor(second / setting("seconds")), "_most": setting("count")}
    )
    order = W.partitionBy("signature_id", "_who", "_slot").orderBy("timestamp", "id")
    most = max(rule.count for rule in rules.values())
    ranked = keyed.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= most)
    kept = ranked.filter(F.col("_rank") <= F.col("_most")).select(*alerts.columns)
    return alerts.filter(~limited).unionByName(kept)


def severity_counts(alerts: DataFrame) -> DataFrame:
    """One row, the four levels, zero when absent."""
    return alerts.agg(
        *[F.count_if(F.col("severity") == level).alias(level.lower()) for level in LEVELS]
    )
