"""Shares, rates and display text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from netloom.functions.rounding import exact_round, fixed_text


def share_of_total(count: Column, total: Column) -> Column:
    """Percent with one place; an empty total gives 0."""
    return exact_round(F.when(total > 0, count / total * 100).otherwise(0.0), 1)


def per_second(amount: Column, duration: Column) -> Column:
    """Rate with one place, 0 when there is no duration."""
    return F.when(duration > 0, exact_round(amount / duration, 1)).otherwise(F.lit(0.0))


def mean_size(total_bytes: Column, packets: Column) -> Column:
    """Whole bytes per packet, 0 when empty."""
    whole = F.floor(total_bytes / packets)
    return F.when(packets > 0, whole).otherwise(F.lit(0)).cast("bigint")


def _scale(value: Column, steps, plain_unit: str) -> tuple[Column, Column]:
    """Number text and unit of the largest step that ``value`` reaches."""
    text = unit = None
    for limit, digits, name in steps:
        shown = fixed_text(value / float(limit), digits)
        reached = value >= limit
        text = F.when(reached, shown) if text is None else text.when(reached, shown)
        unit = F.when(reached, name) if unit is None else unit.when(reached, name)
    return text.otherwise(value.cast("string")), unit.otherwise(plain_unit)


def bytes_si(value: Column) -> tuple[Column, Column]:
    """Number text and unit, steps of 1000."""
    return _scale(value, [(10**9, 1, "GB"), (10**6, 1, "MB"), (10**3, 1, "KB")], "B")


def bytes_si_text(value: Column) -> Column:
    return F.concat_ws(" ", *bytes_si(value))


def count_short(value: Column) -> tuple[Column, Column]:
    """Number text and unit, with K and M."""
    return _scale(value, [(10**6, 2, "M"), (10**3, 1, "K")], "")


def bytes_binary_text(value: Column) -> Column:
    """Two places, steps of 1024."""
    text = None
    for power, unit in enumerate(["B", "KB", "MB", "GB"]):
        shown = F.concat(fixed_text(value / float(1024**power), 2), F.lit(" " + unit))
        inside = value < float(1024 ** (power + 1))
        text = F.when(inside, shown) if text is None else text.when(inside, shown)
    return text.otherwise(F.concat(fixed_text(value / float(1024**4), 2), F.lit(" TB")))


def _whole(value: Column) -> Column:
    return F.floor(value).cast("bigint")


def duration_short(seconds: Column) -> Column:
    """B23: '-', '12ms', '3.4s', '5m 6s' or '7h 8m'."""
    minutes = _whole(seconds / 60)
    hours = _whole(seconds / 3600)
    return (
        F.when(seconds.isNull() | (seconds == 0), "-")
        .when(seconds < 1, F.concat(fixed_text(seconds * 1000, 0), F.lit("ms")))
        .when(seconds < 60, F.concat(fixed_text(seconds, 1), F.lit("s")))
        .when(
            seconds < 3600,
            F.concat(minutes.cast("string"), F.lit("m "), _whole(F.pmod(seconds, F.lit(60.0))).cast("string"), F.lit("s")),
        )
        .otherwise(
            F.concat(hours.cast("string"), F.lit("h "), _whole(F.pmod(seconds, F.lit(3600.0)) / 60).cast("string"), F.lit("m"))
        )
    )


def duration_long(seconds: Column) -> Column:
    """B23: '1h 2m 3s', '2m 3s' or '3s'."""
    whole = _whole(seconds)
    hours, minutes = _whole(whole / 3600), _whole(F.pmod(whole, F.lit(3600)) / 60)
    rest = F.concat(F.pmod(whole, F.lit(60)).cast("string"), F.lit("s"))
    with_minutes = F.concat(minutes.cast("string"), F.lit("m "), rest)
    return (
        F.when(whole >= 3600, F.concat(hours.cast("string"), F.lit("h "), with_minutes))
        .when(whole >= 60, with_minutes)
        .otherwise(rest)
    )


def endpoint(ip: Column, port: Column) -> Column:
    """B24: 'ip:port', or 'ip' when the port is missing or 0."""
    return F.when(port.isNull() | (port == 0), ip).otherwise(F.concat_ws(":", ip, port.cast("string")))


def cut(text: Column, limit: int) -> Column:
    """Shorten to ``limit`` characters, ending in three dots."""
    short = F.concat(F.substring(text, 1, limit - 3), F.lit("..."))
    return F.when(F.length(text) > limit, short).otherwise(text)


def short_ipv6(ip: Column) -> Column:
    """Display form of a long IPv6 address."""
    return F.when(ip.contains(":"), cut(ip, 20)).otherwise(ip)


def severity_name(number: Column) -> Column:
    """Three display levels of the severity number."""
    return F.when(number == 1, "high").when(number == 2, "medium").otherwise("low")
