"""IP reputation tables (H1-H5). The lookups themselves are an external service."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from netloom.functions.address import is_private

FIELDS = ("abuse_score", "country", "isp", "is_malicious", "last_checked")


def upsert_reputation(known: DataFrame, checked: DataFrame) -> DataFrame:
    """H1: the newest check of each address; malicious means a score above 50."""
    scored = checked.withColumn("is_malicious", F.col("abuse_score") > 50)
    columns = ["ip", *FIELDS]
    both = known.select(*columns, F.lit(0).alias("_new")).unionByName(
        scored.select(*columns, F.lit(1).alias("_new"))
    )
    order = F.struct("_new", "last_checked", "abuse_score", "country", "isp")
    row = F.max_by(F.struct(*FIELDS), order)
    return both.groupBy("ip").agg(row.alias("r")).select("ip", "r.*")


def ips_to_check(flows: DataFrame, known: DataFrame) -> DataFrame:
    """H2: distinct public addresses not looked up yet."""
    ips = flows.select(F.explode(F.array("src_ip", "dst_ip")).alias("ip")).distinct()
    public = ips.filter(F.coalesce(~is_private(F.col("ip"), "reputation"), F.lit(False)))
    return public.join(known.select("ip"), "ip", "left_anti")


def verdict(ip: Column, score: Column) -> Column:
    """H3, first scale: PRIVATE, MALICIOUS over 50, SUSPICIOUS over 20, CLEAN."""
    return (
        F.when(is_private(ip, "lookup"), "PRIVATE")
        .when(score > 50, "MALICIOUS")
        .when(score > 20, "SUSPICIOUS")
        .otherwise("CLEAN")
    )


def verdict_report(score: Column) -> Column:
    """H3, second scale: 75 MALICIOUS, 50 SUSPICIOUS, 25 LOW RISK, CLEAN."""
    return (
        F.when(score >= 75, "MALICIOUS")
        .when(score >= 50, "SUSPICIOUS")
        .when(score >= 25, "LOW RISK")
        .otherwise("CLEAN")
    )


def still_valid(known: DataFrame, as_of: str, seconds: int = 300) -> DataFrame:
    """H4: entries checked less than ``seconds`` before ``as_of``."""
    cutoff = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(seconds)} SECONDS")
    return known.filter(F.col("last_checked") > cutoff)


def lookup_reputation(known: DataFrame, ip: str) -> DataFrame:
    """F16: the cached row of one address, or none."""
    return known.filter(F.col("ip") == ip)


def enrich(flows: DataFrame, known: DataFrame) -> DataFrame:
    """H5: reputation of both ends. The table grows with the data, so the join
    is left to the optimizer, which broadcasts it only when it is small."""
    for side in ("src", "dst"):
        renamed = known.select(
            F.col("ip").alias(f"{side}_ip"), *[F.col(f).alias(f"{side}_{f}") for f in FIELDS]
        )
        flows = flows.join(renamed, f"{side}_ip", "left")
    return flows
