"""Column expressions on dissected packet fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# fixed values
TRANSPORTS = (
    "TCP", "UDP", "ICMP", "ICMPv6", "ARP", "IGMP", "GRE", "SCTP", "RTP", "RTCP", "SRTP",
    "SRTCP",
)
FLAG_LETTERS = {
    "S": "SYN", "A": "ACK", "F": "FIN", "R": "RST", "P": "PSH", "U": "URG", "E": "ECE",
    "C": "CWR",
}
# bit and name, in the order they are shown
FLAG_BITS = [
    (0x01, "FIN"), (0x02, "SYN"), (0x04, "RST"), (0x08, "PSH"), (0x10, "ACK"),
    (0x20, "URG"), (0x80, "ECE"), (0x40, "CWR"),
]
UNKNOWN_RECORD_TEXTS = ("Continuation Data", "Ignored Unknown Record")
SEGMENT_TEXT = "[TCP segment of a reassembled PDU]"


def non_empty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def pick_address(ipv4: Column, ipv6: Column, other4: Column, other6: Column, mac: Column) -> Column:
    """B1: IPv4, else IPv6; the MAC only when neither end has an IP, else 'N/A'."""
    own = F.coalesce(non_empty(ipv4), non_empty(ipv6))
    other = F.coalesce(non_empty(other4), non_empty(other6))
    hardware = F.coalesce(non_empty(mac), F.lit("N/A"))
    return F.when(own.isNull() & other.isNull(), hardware).otherwise(F.coalesce(own, F.lit("")))


def pick_port(tcp: Column, udp: Column) -> Column:
    """B2: TCP port, else UDP port; null when it is not a number."""
    return F.coalesce(non_empty(tcp), non_empty(udp)).try_cast("int")


def to_number(text: Column, kind: str) -> Column:
    """0 for anything that is not a number."""
    return F.coalesce(text.try_cast(kind), F.lit(0).cast(kind))


def epoch_to_timestamp(text: Column) -> Column:
    """Epoch seconds to a timestamp cut (not rounded) to milliseconds.

    The text is read as a decimal, so no digit is lost; null when unreadable.
    """
    millis = F.floor(text.try_cast("decimal(20,9)") * 1000).cast("bigint")
    return F.timestamp_millis(millis).cast("timestamp_ntz")


def has_version(supported: Column, code: str) -> Column:
    listed = F.split(F.coalesce(supported, F.lit("")), "[, ]+")
    return F.array_contains(listed, code)


def fix_tls_label(protocol: Column, supported: Column) -> Column:
    """A 'TLSv1' hello carries its real version in the extension."""
    return (
        F.when((protocol == "TLSv1") & has_version(supported, "0x0304"), "TLSv1.3")
        .when((protocol == "TLSv1") & has_version(supported, "0x0303"), "TLSv1.2")
        .otherwise(protocol)
    )


def is_tls(protocol: Column) -> Column:
    return protocol.startswith("TLS") | protocol.startswith("SSL")


def transport_of(protocol: Column, tcp_port: Column, udp_port: Column) -> Column:
    """A transport label stands for itself; else by which port field is set."""
    return (
        F.when(protocol.isin(*TRANSPORTS), protocol)
        .when(tcp_port, "TCP")
        .when(udp_port, "UDP")
        .otherwise("UNKNOWN")
    )


def flags_from_letters(text: Column) -> Column:
    """Letters to names in the order given; dots and blanks are dropped."""
    letters = F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda c: ~c.isin("·", " ", ""))
    names = F.create_map(*[F.lit(v) for pair in FLAG_LETTERS.items() for v in pair])
    return F.transform(letters, lambda c: F.coalesce(F.try_element_at(names, c), c))


def flags_from_bits(bits: Column) -> Column:
    """Bit mask to names, in display order."""
    named = [F.when(bits.bitwiseAND(F.lit(bit)) != 0, name) for bit, name in FLAG_BITS]
    return F.array_compact(F.array(*named))


def flags_text(flags: Column) -> Column:
    return F.array_join(flags, ", ")


def has_flag(flags: Column, name: str) -> Column:
    """Is a flag set, on the comma-joined text form?"""
    return F.coalesce(flags.contains(name), F.lit(False))


def direction(src: Column, dst: Column, local_ips: Sequence[str]) -> Column:
    """By which end is local; neither means OUTGOING."""
    return (
        F.when(src.isin(*local_ips), "OUTGOING")
        .when(dst.isin(*local_ips), "INCOMING")
        .otherwise("OUTGOING")
    )


def direction_private_aware(src: Column, dst: Column, local_ips: Sequence[str]) -> Column:
    """As B10, but with neither end local a public source means INCOMING."""
    from netloom.functions.address import is_private

    return (
        F.when(src.isin(*local_ips), "OUTGOING")
        .when(dst.isin(*local_ips), "INCOMING")
        .when(is_private(src, "capture"), "OUTGOING")
        .otherwise("INCOMING")
    )


def direction_arp(operation: Column, sender: Column, target: Column, local_ips: Sequence[str]) -> Column:
    """ARP request by its target, reply by its sender, else OUTGOING."""
    return (
        F.when((operation == 1) & target.isin(*local_ips), "INCOMING")
        .when(operation == 1, "OUTGOING")
        .when((operation == 2) & ~sender.isin(*local_ips), "INCOMING")
        .otherwise("OUTGOING")
    )


def is_unknown_record(transport: Column, info: Column) -> Column:
    """Texts of a TCP record the dissector could not name."""
    return (transport == "TCP") & info.isin(*UNKNOWN_RECORD_TEXTS)


def is_pdu_segment(payload_len: Column, flags: Column) -> Column:
    """Payload without PSH, SYN or FIN."""
    closing = has_flag(flags, "PSH") | has_flag(flags, "SYN") | has_flag(flags, "FIN")
    return (payload_len > 0) & ~closing
