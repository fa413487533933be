"""Trust tier of an address and unusual labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from netloom.config import SemiTrustedConfig
from netloom.functions.address import address_key, first_network_list, network_range
from netloom.sources.networks import SEMI_TRUSTED, TRUSTED, Networks


def trust_tier(ip: Column, networks: Networks) -> Column:
    """D6: 'trusted', 'semi_trusted' or null, trusted tested first.

    Use it on one row per address (after an aggregate), not per flow. A filter
    on a grouping column moves below its aggregate and would be evaluated per
    flow again; ``after`` ties the address to an aggregate's result instead.
    """
    return first_network_list(
        ip, {TRUSTED: networks.trusted, SEMI_TRUSTED: networks.semi_trusted}
    )


def after(ip: str, count: str) -> Column:
    """The address of a group, tied to the group's row count."""
    return F.when(F.col(count) > 0, F.col(ip))


def is_unusual(protocol: Column, cfg: SemiTrustedConfig) -> Column:
    """A non-empty label outside the standard list, ignoring case."""
    standard = [p.upper() for p in cfg.standard_protocols]
    label = F.upper(F.coalesce(protocol, F.lit("")))
    return (label != "") & ~label.isin(*standard)


def matching_networks(ip: Column, networks: Networks) -> Column:
    """Array of (cidr, tier) of every listed network that holds the address.

    The list is literal configuration; use it on one row per address.
    """
    listed = []
    for tier, cidrs in ((TRUSTED, networks.trusted), (SEMI_TRUSTED, networks.semi_trusted)):
        for cidr in cidrs:
            low, high = network_range(cidr)
            listed.append(
                F.struct(
                    F.lit(cidr).alias("cidr"), F.lit(tier).alias("tier"),
                    F.lit(low).alias("low"), F.lit(high).alias("high"),
                )
            )
    if not listed:
        return F.array().cast("array<struct<cidr:string,tier:string>>")
    key = F.array(address_key(ip))
    held = F.flatten(
        F.transform(key, lambda k: F.filter(F.array(*listed), lambda n: k.between(n["low"], n["high"])))
    )
    return F.transform(held, lambda n: F.struct(n["cidr"].alias("cidr"), n["tier"].alias("tier")))
