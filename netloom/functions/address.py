"""Addresses: sortable keys, network membership, private and scope tests."""

from __future__ import annotations

import ipaddress
from collections.abc import Iterable

from pyspark.sql import Column, functions as F

_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_V4 = rf"^{_OCTET}(\.{_OCTET}){{3}}$"
_GROUPS = r"([0-9a-f]{1,4}:)*[0-9a-f]{1,4}"
_V6 = rf"^({_GROUPS})?(::({_GROUPS})?)?$"


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body`` as often as needed."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _hex_byte(text: Column) -> Column:
    return F.lpad(F.lower(F.hex(text.try_cast("int"))), 2, "0")


def _v4_key(ip: Column) -> Column:
    octets = F.transform(F.split(ip, r"\."), _hex_byte)
    return F.concat(F.lit("4"), F.array_join(octets, ""))


def _without_dots(text: Column) -> Column:
    """Write a dotted tail as two hex groups; null when the tail is no IPv4."""
    head, last = F.regexp_extract(text, "^(.*:)", 1), F.regexp_extract(text, "([^:]*)$", 1)
    bytes_ = F.transform(F.split(last, r"\."), _hex_byte)
    tail = F.concat_ws(":", F.array_join(F.slice(bytes_, 1, 2), ""), F.array_join(F.slice(bytes_, 3, 2), ""))
    return F.when(~text.contains("."), text).when(last.rlike(_V4), F.concat(head, tail))


def _groups(text: Column, n: int) -> Column:
    part = F.split_part(text, F.lit("::"), F.lit(n))
    return F.filter(F.split(part, ":"), lambda g: g != "")


def _fill(text: Column) -> Column:
    """All 32 hex digits of valid text, null otherwise."""

    def joined(sides: Column) -> Column:
        left, right = sides["left"], sides["right"]
        missing = F.lit(8) - F.size(left) - F.size(right)
        valid = F.when(text.contains("::"), missing >= 1).otherwise(missing == 0)
        gap = F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0)))
        padded = F.transform(F.concat(left, gap, right), lambda g: F.lpad(g, 4, "0"))
        return F.when(valid, F.concat(F.lit("6"), F.array_join(padded, "")))

    sides = F.struct(_groups(text, 1).alias("left"), _groups(text, 2).alias("right"))
    return F.when(text.rlike(_V6), _let(sides, joined))


def _v6_key(ip: Column) -> Column:
    plain = F.regexp_replace(F.lower(ip), "%.+$", "")
    return _let(_let(plain, _without_dots), _fill)


def address_key(ip: Column) -> Column:
    """Fixed-width text that sorts like the address; null when not an address.

    ``'4'`` + 8 hex digits or ``'6'`` + 32. The first digit keeps the families
    apart, so an IPv4-mapped IPv6 address is in no IPv4 network.
    """
    return F.when(ip.rlike(_V4), _v4_key(ip)).when(ip.contains(":"), _v6_key(ip))


def network_range(cidr: str) -> tuple[str, str] | None:
    """Key range of one network (host bits allowed), or None when malformed."""
    try:
        net = ipaddress.ip_network(cidr.strip(), strict=False)
    except ValueError:
        return None
    width = 8 if net.version == 4 else 32
    first, last = int(net.network_address), int(net.broadcast_address)
    return f"{net.version}{first:0{width}x}", f"{net.version}{last:0{width}x}"


def _inside(cidrs: Iterable[str]):
    """Test of a key against the merged ranges of a network list."""
    nets = []
    for cidr in cidrs:
        try:
            nets.append(ipaddress.ip_network(cidr.strip(), strict=False))
        except ValueError:
            continue
    merged = []
    for version in (4, 6):
        merged += ipaddress.collapse_addresses(n for n in nets if n.version == version)
    ranges = [network_range(str(net)) for net in merged]

    def test(key: Column) -> Column:
        if not ranges:
            return F.lit(False)
        return F.exists(literal_ranges(ranges), lambda r: key.between(r["low"], r["high"]))

    return test


def literal_ranges(ranges: Iterable[tuple[str, str]]) -> Column:
    """Constant array of (low, high) keys, built in one expression."""
    rows = ", ".join(f"named_struct('low', '{low}', 'high', '{high}')" for low, high in ranges)
    return F.expr(f"array({rows})")


def in_networks(ip: Column, cidrs: Iterable[str]) -> Column:
    """Is the address in any of the networks? False for a bad address.

    The list is driver-side configuration (tens of entries), so it becomes a
    literal range predicate. Apply it to aggregated or distinct addresses.
    """
    inside = F.exists(F.array(address_key(ip)), _inside(cidrs))
    return F.coalesce(inside, F.lit(False))


def first_network_list(ip: Column, lists: dict[str, Iterable[str]]) -> Column:
    """Name of the first list that holds the address, else null."""
    tests = {name: _inside(cidrs) for name, cidrs in lists.items()}

    def pick(key: Column) -> Column:
        found = F.lit(None).cast("string")
        for name, test in reversed(tests.items()):
            found = F.when(test(key), name).otherwise(found)
        return found

    return _let(address_key(ip), pick)


# fixed values: one anchored pattern per variant of the private-address test
PRIVATE_PATTERNS = {
    "detector": r"^(10\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.|127\.|169\.254\.|0\.0\.0\.0|::|fe80:|fc|fd|ff)",
    "capture": r"^(10\.|192\.168\.|172\.0*(1[6-9]|2[0-9]|3[01])(\.|$)|fe80:|fc|fd)",
    "reputation": r"^(10\.|192\.168\.|172\.(1[6-9]\.|2|3)|127\.|169\.254\.|0\.0\.0\.0$|::|fe80:|fc|fd)",
    "lookup": r"^(10\.|192\.168\.|172\.16\.|127\.|169\.254\.|0\.0\.0\.0$|::|fe80:|fc|fd)",
}


def is_private(ip: Column, variant: str = "detector") -> Column:
    """Private, local or multicast? The four variants differ on purpose.

    ``detector`` and ``reputation`` count a missing address as private.
    """
    missing = F.lit(variant in ("detector", "reputation"))
    blank = ip.isNull() | (ip == "")
    return F.when(blank, missing).otherwise(ip.rlike(PRIVATE_PATTERNS[variant]))


def ipv6_scope(ip: Column) -> Column:
    """Scope class of an IPv6 address, first match wins."""
    return (
        F.when(ip.startswith("fe80:"), "Link-Local")
        .when(ip.startswith("ff02:"), "Multicast-Link")
        .when(ip.startswith("ff"), "Multicast")
        .when(ip.rlike("^f[cd]"), "Unique-Local")
        .when(ip.rlike("^[23]"), "Global-Unicast")
        .when(ip == "::1", "Loopback")
        .otherwise("Other")
    )


def is_multicast_key(key: Column) -> Column:
    """Multicast destination; ``ff`` counts only for addresses, not names."""
    return key.rlike(r"^(224\.|239\.)") | (key.startswith("ff") & key.contains(":"))
