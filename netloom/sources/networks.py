"""A10 and the two rule files of E7/E8: small configuration read on the driver."""

from __future__ import annotations

import dataclasses as dc
import ipaddress
import re

from pyspark.sql import DataFrame, SparkSession

from netloom.schemas import NETWORKS

TRUSTED = "trusted"
SEMI_TRUSTED = "semi_trusted"

# fixed values
DEFAULT_TRUSTED = (
    "2404:6800::/32", "2607:f8b0::/32", "2a00:1450::/32", "142.250.0.0/15",
    "172.217.0.0/16", "216.58.0.0/16", "2a03:2880::/32", "157.240.0.0/16",
    "2a04:4e42::/32", "151.101.0.0/16", "2603:1000::/24", "20.0.0.0/8", "13.64.0.0/11",
    "40.64.0.0/10", "2600:1f00::/24", "3.0.0.0/8", "52.0.0.0/8", "127.0.0.0/8", "::1/128",
)
DEFAULT_SEMI_TRUSTED = ("64:ff9b::/96", "2606:4700::/32", "104.16.0.0/12", "172.64.0.0/13")


@dc.dataclass(frozen=True)
class Networks:
    trusted: tuple[str, ...] = DEFAULT_TRUSTED
    semi_trusted: tuple[str, ...] = DEFAULT_SEMI_TRUSTED

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [(c, TRUSTED) for c in self.trusted]
        rows += [(c, SEMI_TRUSTED) for c in self.semi_trusted]
        return spark.createDataFrame(rows, NETWORKS)


def parse_networks(text: str) -> Networks:
    """Section headers switch the tier, inline comments end a line, entries that
    are not networks are skipped, host bits are allowed."""
    found: dict[str, list[str]] = {TRUSTED: [], SEMI_TRUSTED: []}
    tier = TRUSTED
    header = re.compile(r"# ?\[(SEMI-)?TRUSTED\]")
    for line in map(str.strip, text.splitlines()):
        section = header.match(line.upper())
        if section:
            tier = SEMI_TRUSTED if section.group(1) else TRUSTED
            continue
        entry = line.partition("#")[0].strip()
        try:
            found[tier].append(str(ipaddress.ip_network(entry, strict=False)))
        except ValueError:
            continue
    return Networks(tuple(found[TRUSTED]), tuple(found[SEMI_TRUSTED]))


def load_networks(path: str) -> Networks:
    """A10; a missing file means no networks."""
    try:
        with open(path, encoding="utf-8") as handle:
            return parse_networks(handle.read())
    except OSError:
        return Networks((), ())


@dc.dataclass(frozen=True)
class SuppressRule:
    signature_id: int  # 0 = any
    track: str  # by_src | by_dst
    network: str


@dc.dataclass(frozen=True)
class RateLimit:
    signature_id: int
    track: str
    count: int
    seconds: int


# fixed values
DEFAULT_SUPPRESS = tuple(
    SuppressRule(sid, "by_dst", net)
    for sid, net in [
        (2027865, "2404:6800::/32"), (2027865, "2600:1901::/32"), (2027866, "2404:6800::/32"),
        (2027866, "2606:4700::/32"), (2027865, "2a03:2880::/32"), (2027865, "2405:200::/32"),
        (2027865, "2a04:4e42::/32"), (2027865, "2606:4700::/32"), (2027865, "104.16.0.0/12"),
        (2027865, "20.0.0.0/8"), (2027865, "13.64.0.0/11"), (0, "64:ff9b::/96"),
        (0, "127.0.0.0/8"), (0, "::1/128"),
    ]
)
DEFAULT_LIMITS = (
    RateLimit(2027757, "by_src", 1, 60), RateLimit(2027758, "by_src", 1, 60),
    RateLimit(2027763, "by_src", 1, 300), RateLimit(2028609, "by_dst", 1, 300),
    RateLimit(2028610, "by_dst", 1, 300), RateLimit(2028675, "by_src", 1, 600),
    RateLimit(2028676, "by_src", 1, 600),
)


def parse_thresholds(text: str) -> tuple[tuple[SuppressRule, ...], tuple[RateLimit, ...]]:
    """``suppress`` and ``threshold ... type limit`` lines of a threshold file."""
    suppress, limits = [], []
    for line in map(str.strip, text.splitlines()):
        pairs = dict(re.findall(r"(\w+) +([^,\s]+)", line.partition(" ")[2]))
        if line.startswith("suppress ") and {"sig_id", "track", "ip"} <= pairs.keys():
            suppress.append(SuppressRule(int(pairs["sig_id"]), pairs["track"], pairs["ip"]))
        elif line.startswith("threshold ") and pairs.get("type") == "limit":
            limits.append(
                RateLimit(
                    int(pairs["sig_id"]), pairs["track"], int(pairs["count"]), int(pairs["seconds"])
                )
            )
    return tuple(suppress), tuple(limits)


def load_thresholds(path: str) -> tuple[tuple[SuppressRule, ...], tuple[RateLimit, ...]]:
    """Rules of a threshold file; none when it is missing."""
    try:
        with open(path, encoding="utf-8") as handle:
            return parse_thresholds(handle.read())
    except OSError:
        return (), ()
