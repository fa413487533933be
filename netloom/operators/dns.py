"""Which domain an address was resolved from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def answers(info: Column) -> Column:
    """Struct (domain, ips) from the text of a DNS response.

    After each ``A`` or ``AAAA`` token the next token is its value and is
    skipped. The first value with a dot and a letter is the domain; values
    without letters, or with a colon, are addresses.
    """
    start = F.struct(
        F.lit(False).alias("skip"),
        F.lit("").alias("kind"),
        F.lit(None).cast("string").alias("domain"),
        F.array().cast("array<string>").alias("ips"),
    )
    tokens = F.filter(F.split(F.trim(info), r"\s+"), lambda t: t != "")

    def step(acc: Column, token: Column) -> Column:
        alphabetic = token.rlike(r"\p{L}")
        dotted = token.contains(".") & ~token.startswith("0x")
        name = acc["skip"] & dotted & alphabetic & acc["domain"].isNull()
        address = acc["skip"] & ~name & (
            (dotted & (~alphabetic | token.contains(":"))) | (~dotted & token.contains(":"))
        )
        return F.struct(
            (~acc["skip"] & token.isin("A", "AAAA")).alias("skip"),
            token.alias("kind"),
            F.when(name, token).otherwise(acc["domain"]).alias("domain"),
            F.when(address, F.array_append(acc["ips"], token)).otherwise(acc["ips"]).alias("ips"),
        )

    folded = F.aggregate(tokens, start, step)
    return F.struct(folded["domain"].alias("domain"), folded["ips"].alias("ips"))


def named(rows: DataFrame, domains: DataFrame) -> DataFrame:
    """``rows`` with the ``domain`` of their ``dst_ip``, or null. Names that come with a session count in
    that session alone, unless the rows have none; then the latest session's name counts."""
    names = domains.withColumnRenamed("ip", "dst_ip")
    if "session_id" not in domains.columns:
        return rows.join(names.select("dst_ip", "domain"), "dst_ip", "left")
    if "session_id" in rows.columns:
        return rows.join(names.select("session_id", "dst_ip", "domain"), ["session_id", "dst_ip"], "left")
    latest = names.groupBy("dst_ip").agg(F.max_by("domain", F.struct("session_id", "domain")).alias("domain"))
    return rows.join(latest, "dst_ip", "left")


def ip_domains(packets: DataFrame, per_session: bool = False) -> DataFrame:
    """(ip, domain), the last response of an address wins."""
    keys = ["session_id", "ip"] if per_session else ["ip"]
    text = F.col("info")
    responses = packets.filter((F.col("protocol") == "DNS") & text.contains("response"))
    found = responses.select("session_id", "frame_number", answers(text).alias("a"))
    pairs = found.filter(F.col("a.domain").isNotNull()).select(
        "session_id", "frame_number", F.col("a.domain").alias("domain"), F.explode("a.ips").alias("ip")
    )
    order = F.struct("session_id", "frame_number", "domain")
    return pairs.groupBy(*keys).agg(F.max_by("domain", order).alias("domain"))
