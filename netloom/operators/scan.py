"""Running aggregates over ordered groups, safe for very large groups.

``Plain`` is a window. ``Ranged`` is a segmented scan: rows of a group are cut into ranges of the order
column, each range runs its own window, and its last row, which then holds the range's total, meets the
last rows of the other ranges in a window of their own, one row a range. What that finds for the ranges
before goes back to the range's rows. No task holds more of a group than one range, or one row for each
of its ranges. Both give the same columns, so an operator is written once against ``run``.
"""

from __future__ import annotations

import dataclasses as dc

from pyspark.sql import Column, DataFrame, Window as W, functions as F

_MERGE = {"max": F.max, "min": F.min, "sum": F.sum}


@dc.dataclass(frozen=True)
class Running:
    """``kind`` over the rows up to this one, without it unless ``inclusive``."""

    kind: str
    value: Column
    inclusive: bool = False


def _joined(kind: str, own: str, earlier: str) -> str:
    """Two partial results in one; a missing one adds nothing."""
    if kind == "sum":
        return f"if({own} is null and {earlier} is null, null, coalesce({own}, 0) + coalesce({earlier}, 0))"
    return f"{'greatest' if kind == 'max' else 'least'}({own}, {earlier})"


class Plain:
    def __init__(self, keys: list[str], order: str):
        self.keys, self.order = keys, order

    def _columns(self, specs: dict[str, Running], keys: list[str]) -> dict[str, Column]:
        window = W.partitionBy(*keys).orderBy(self.order)
        return {
            name: _MERGE[s.kind](s.value).over(window.rowsBetween(W.unboundedPreceding, 0 if s.inclusive else -1))
            for name, s in specs.items()
        }

    def run(self, df: DataFrame, specs: dict[str, Running]) -> DataFrame:
        return df.withColumns(self._columns(specs, self.keys))


class Ranged(Plain):
    """Ranges of ``width`` consecutive values of an integer order column that is
    unique within a group, so a range never holds more than ``width`` rows."""

    def __init__(self, keys: list[str], order: str, width: int):
        super().__init__(keys, order)
        self.width = width

    def run(self, df: DataFrame, specs: dict[str, Running]) -> DataFrame:
        spot = F.floor(F.col(self.order) / self.width)
        rows = df.withColumns({"_range": spot, **{f"_v_{name}": s.value for name, s in specs.items()}})
        keys = ", ".join(self.keys)
        inside = f"over (partition by {keys}, _range order by {self.order}"
        upto = {True: "rows between unbounded preceding and current row)", False: "rows between unbounded preceding and 1 preceding)"}
        # as text: these steps are many, and each column object is a round trip to the JVM
        rows = rows.selectExpr(
            "*", *[f"{s.kind}(_v_{name}) {inside} {upto[s.inclusive]} as {name}" for name, s in specs.items()],
            f"lead(1) {inside}) is null as _last",
        )
        # last rows of a group's ranges share a partition, all others stay with their range
        before = f"over (partition by {keys}, if(_last, null, _range) order by _range {upto[False]}"
        total = {name: name if s.inclusive else _joined(s.kind, name, f"_v_{name}") for name, s in specs.items()}
        rows = rows.selectExpr("*", *[f"if(_last, {s.kind}({total[name]}) {before}, null) as _b_{name}" for name, s in specs.items()])
        carried = {name: f"max(_b_{name}) over (partition by {keys}, _range)" for name in specs}  # one row of a range has it
        return rows.selectExpr(*df.columns, *[f"{_joined(s.kind, name, carried[name])} as {name}" for name, s in specs.items()])


def by_group_size(df: DataFrame, keys: list[str], order: str, operator, limit: int = 4_000_000):
    """Apply ``operator(rows, scan)``; groups above ``limit`` rows are scanned in ranges of ``limit``.

    It is one plan: which groups are large is a table that rows are joined to, never a list on the
    driver. Where no group is large, adaptive execution finds that table empty and drops the join and
    the ranges. The table is broadcast: it has less than a row for each ``limit`` rows of ``df``. A join
    that shuffles would bring each group into one task, and windows over ranges, whose keys contain the
    group's, would all run there.
    """
    large = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > limit).drop("_n")
    large = F.broadcast(large)
    rest = operator(df.join(large, keys, "left_anti"), Plain(keys, order))
    return rest.unionByName(operator(df.join(large, keys, "left_semi"), Ranged(keys, order, limit)))
