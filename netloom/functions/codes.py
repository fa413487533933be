"""Fixed code tables as literal lookups (no join, no shuffle)."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

# fixed values: (service, first port, last port), first rule that fits wins
TCP_SERVICES = [
    ("HTTP", 80, 80), ("SSH", 22, 22), ("FTP", 21, 21), ("FTP-DATA", 20, 20),
    ("RDP", 3389, 3389), ("SMTP", 25, 25), ("SMTP", 587, 587), ("POP3", 110, 110),
    ("IMAP", 143, 143), ("IMAPS", 993, 993), ("MySQL", 3306, 3306),
    ("PostgreSQL", 5432, 5432), ("MongoDB", 27017, 27017), ("Redis", 6379, 6379),
    ("HTTP-ALT", 8080, 8080), ("HTTPS-ALT", 8443, 8443), ("Telnet", 23, 23),
    ("Tor-SOCKS", 9050, 9050), ("Tor-Browser", 9150, 9150), ("SOCKS", 1080, 1080),
    ("Squid-Proxy", 3128, 3128), ("HTTP-Proxy", 8888, 8888), ("BitTorrent", 6881, 6889),
    ("Elasticsearch", 9200, 9200), ("CouchDB", 5984, 5984), ("Memcached", 11211, 11211),
    ("AMQP", 5672, 5672), ("MQTT", 1883, 1883), ("Kafka", 9092, 9092),
    ("Minecraft", 25565, 25565), ("Docker", 2375, 2375), ("Docker-TLS", 2376, 2376),
    ("Kubernetes", 6443, 6443), ("Git", 9418, 9418), ("LDAP", 389, 389),
    ("LDAPS", 636, 636), ("WHOIS", 43, 43),
]
UDP_SERVICES = [
    ("QUIC", 443, 443), ("DNS", 53, 53), ("DHCP", 67, 67), ("DHCP", 68, 68),
    ("NTP", 123, 123), ("SNMP", 161, 161), ("SNMP-TRAP", 162, 162), ("IPSec", 500, 500),
    ("OpenVPN", 1194, 1194), ("mDNS", 5353, 5353), ("NetBIOS-NS", 137, 137),
    ("NetBIOS-DGM", 138, 138), ("SSDP", 1900, 1900),
]
WELL_KNOWN_PORTS = {
    22: "SSH", 53: "DNS", 80: "HTTP", 443: "HTTPS/TLS", 993: "IMAPS", 995: "POP3S",
    3306: "MySQL", 3389: "RDP", 5432: "PostgreSQL", 8080: "HTTP-Alt", 8443: "HTTPS-Alt",
}
DNS_QTYPES = {
    1: "A", 2: "NS", 5: "CNAME", 6: "SOA", 12: "PTR", 15: "MX", 16: "TXT", 28: "AAAA",
    33: "SRV", 35: "NAPTR", 43: "DS", 46: "RRSIG", 48: "DNSKEY", 52: "TLSA",
    65: "HTTPS", 255: "ANY",
}
TLS_VERSIONS = {
    0x0300: "SSLv3", 0x0301: "TLSv1.0", 0x0302: "TLSv1.1", 0x0303: "TLSv1.2",
    0x0304: "TLSv1.3",
}
TLS_HANDSHAKES = {
    1: "Client Hello", 2: "Server Hello", 4: "New Session Ticket", 11: "Certificate",
    12: "Server Key Exchange", 14: "Server Hello Done", 16: "Client Key Exchange",
    20: "Finished",
}
ICMP_TYPES = {
    0: "ICMP Echo Reply | Ping Response", 3: "ICMP Dest Unreachable | Route Problem",
    8: "ICMP Echo Request | Ping Outgoing", 11: "ICMP Time Exceeded | TTL Expired",
}
ICMPV6_TYPES = {
    1: "Destination Unreachable", 2: "Packet Too Big", 3: "Time Exceeded",
    4: "Parameter Problem", 128: "Echo Request (Ping)", 129: "Echo Reply (Pong)",
    133: "Router Solicitation", 134: "Router Advertisement", 135: "Neighbor Solicitation",
    136: "Neighbor Advertisement", 143: "Multicast Listener Report v2",
}
QUIC_LONG_TYPES = ["Initial", "0-RTT", "Handshake", "Retry"]


def lookup(table: dict, code: Column) -> Column:
    """Value of ``code`` in a fixed table, null when absent."""
    literal = F.create_map(*[F.lit(v) for v in chain.from_iterable(table.items())])
    return F.try_element_at(literal, code.cast("int"))


def _best_rule(rules, port: Column) -> Column:
    ranks = {}
    for rank, (_, first, last) in enumerate(rules):
        for number in range(first, last + 1):
            ranks.setdefault(number, rank)
    return lookup(ranks, port)


def service_name(transport: Column, src_port: Column, dst_port: Column) -> Column:
    """First rule that fits either port; default is the transport itself."""

    def pick(rules, default):
        rank = F.least(_best_rule(rules, src_port), _best_rule(rules, dst_port))
        names = {i: name for i, (name, _, _) in enumerate(rules)}
        return F.coalesce(lookup(names, rank), F.lit(default))

    return F.when(transport == "TCP", pick(TCP_SERVICES, "TCP")).when(
        transport == "UDP", pick(UDP_SERVICES, "UDP")
    )


def port_label(port: Column) -> Column:
    """Well-known name, else ``port N``."""
    return F.coalesce(lookup(WELL_KNOWN_PORTS, port), F.concat(F.lit("port "), port.cast("string")))


def dns_query_type(code: Column) -> Column:
    return F.coalesce(lookup(DNS_QTYPES, code), code.cast("string"))


def tls_version_name(code: Column) -> Column:
    return lookup(TLS_VERSIONS, code)


def tls_handshake_name(code: Column) -> Column:
    return lookup(TLS_HANDSHAKES, code)


def icmp_name(code: Column) -> Column:
    return F.coalesce(lookup(ICMP_TYPES, code), F.concat(F.lit("ICMP Type "), code.cast("string")))


def icmpv6_name(code: Column) -> Column:
    return lookup(ICMPV6_TYPES, code)


def quic_packet_type(first_byte: Column, payload_len: Column) -> Column:
    """Packet type from the first payload byte (null byte: no payload seen)."""
    long_type = F.shiftright(first_byte.bitwiseAND(F.lit(0x30)), 4)
    size = F.concat(F.lit(" ("), payload_len.cast("string"), F.lit(" bytes)"))
    return (
        F.when(first_byte.isNull() & (payload_len == 0), "QUIC: Empty Payload")
        .when(first_byte.isNull(), "QUIC: Protected Payload")
        .when(
            first_byte.bitwiseAND(F.lit(0x80)) != 0,
            F.concat(F.lit("QUIC: "), lookup(dict(enumerate(QUIC_LONG_TYPES)), long_type)),
        )
        .when(
            first_byte.bitwiseAND(F.lit(0x40)) != 0,
            F.concat(F.lit("QUIC: Protected Payload"), size),
        )
        .otherwise(F.concat(F.lit("QUIC: Encrypted Data"), size))
    )
