"""Filters shared by searches, pages and exports."""

from __future__ import annotations

import dataclasses as dc
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

SEVERITY_NUMBERS = {"high": 1, "medium": 2, "low": 3}
OWN_PORTS = (8000, 5173)


def in_session(df: DataFrame, session_id: int | None) -> DataFrame:
    """One session, or all for None / 0. Prunes partitions."""
    return df.filter(F.col("session_id") == session_id) if session_id else df


def either_side(left: str, right: str, value) -> Column:
    """The value on either side."""
    return (F.col(left) == value) | (F.col(right) == value)


def protocol_is(name: str) -> Column:
    """Label or transport, ignoring case."""
    return (F.upper("protocol") == name.upper()) | (F.upper("transport") == name.upper())


def contains_text(column: Column, text: str) -> Column:
    """Case-insensitive LIKE '%text%'; % and _ in the text are wildcards."""
    return column.ilike("%" + text.replace("\\", "\\\\") + "%")


def any_contains(columns: list[str], text: str) -> Column:
    return reduce(lambda a, b: a | b, [contains_text(F.col(c), text) for c in columns])


def not_before(column: str, start: str) -> Column:
    """Lower bound, inclusive."""
    return F.col(column) >= F.lit(datetime.fromisoformat(start)).cast("timestamp_ntz")


def not_after(column: str, end: str) -> Column:
    """Upper bound. A bare date covers its whole day up to 23:59:59; a bound
    to the minute ends before that minute, as comparing the texts does."""
    moment = datetime.fromisoformat(end)
    if len(end) == 10:
        moment = moment.replace(hour=23, minute=59, second=59)
    bound = F.lit(moment).cast("timestamp_ntz")
    return F.col(column) < bound if len(end) == 16 else F.col(column) <= bound


def tag_contains(text: str) -> Column:
    """substring of the comma-joined tags."""
    return contains_text(F.array_join("tags", ","), text)


@dc.dataclass(frozen=True)
class ConnectionFilter:
    search: str = ""
    protocol: str = ""
    port: int = 0
    tag: str = ""
    date_from: str = ""
    date_to: str = ""
    session_id: int = 0

    def conditions(self) -> list[Column]:
        found = []
        if self.search:
            found.append(any_contains(["src_ip", "dst_ip", "protocol"], self.search))
        if self.protocol:
            found.append(F.col("protocol") == self.protocol)
        if self.port > 0:
            found.append(either_side("src_port", "dst_port", self.port))
        if self.tag:
            found.append(tag_contains(self.tag))
        if self.date_from:
            found.append(not_before("start_time", self.date_from))
        if self.date_to:
            found.append(not_after("start_time", self.date_to))
        if self.session_id > 0:
            found.append(F.col("session_id") == self.session_id)
        return found


@dc.dataclass(frozen=True)
class AlertFilter:
    severity: str = ""
    search: str = ""
    proto: str = ""
    date_from: str = ""
    date_to: str = ""
    session_id: int = 0

    def level(self) -> Column | None:
        """P5: the named level; unknown names are ignored."""
        number = SEVERITY_NUMBERS.get(self.severity)
        return None if number is None else F.col("severity_num") == number

    def conditions(self) -> list[Column]:
        """Everything but the level, which the level cards leave out."""
        found = []
        if self.search:
            found.append(any_contains(["src_ip", "dst_ip", "signature", "category"], self.search))
        if self.proto:
            found.append(F.col("proto") == self.proto)
        if self.date_from:
            found.append(not_before("timestamp", self.date_from))
        if self.date_to:
            found.append(not_after("timestamp", self.date_to))
        if self.session_id > 0:
            found.append(F.col("session_id") == self.session_id)
        return found


def all_of(conditions: list[Column]) -> Column:
    """Conjunction of whatever was given."""
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def shown_in_feed() -> Column:
    """No traffic of the tool's own ports, no row with an empty end."""
    def own(port: str) -> Column:
        return F.coalesce(F.col(port).isin(*OWN_PORTS), F.lit(False))

    def filled(ip: str) -> Column:
        return F.coalesce(F.col(ip) != "", F.lit(False))

    return ~own("src_port") & ~own("dst_port") & filled("src_ip") & filled("dst_ip")
