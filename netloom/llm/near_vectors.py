"""Near-duplicate vectors: an exact metric range join.

Cosine >= c means a distance of at most r = sqrt(2 - 2c) between unit vectors. Pivots partition
the vectors of a label into cells, each with its nearest pivot. A vector within r of another cell's
members is copied there: by the triangle inequality it is at most r from the surface between the
two pivots. So each cell holds all partners of its own vectors, and cells are joined on their own,
large ones in blocks. Equal vectors are one, with a count.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.components import components
from netloom.llm.store import written
from netloom.llm.vectors import matrix, usable

#: Vectors a pivot, and pivots at most (they are sent to every task); more vectors make larger
#: cells, which more blocks hold. Rows of a block.
CELL, PIVOTS, BLOCK = 2_048, 4_096, 2_048


def _assign(pivots: dict[tuple, np.ndarray], radius: float):
    """Each vector in its own cell, and copies in the cells whose vectors it may be near."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            parts = []
            for key, rows in batch.groupby(["label", "size"], sort=False):
                p = pivots.get((int(key[0]), int(key[1])))
                if p is None:
                    parts.append(rows.assign(cell=0, home=True))
                    continue
                x = matrix(rows["vector"])
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                d2 = np.maximum(0, 2 - 2 * (x @ p.T))
                between = np.sqrt(np.maximum(0, 2 - 2 * (p @ p.T)))
                own = d2.argmin(1)
                # distance to the surface halfway between the pivots, never above half the difference
                # of the distances to them
                gap = (d2 - d2[np.arange(len(x)), own][:, None]) / np.maximum(2 * between[own], 1e-12)
                near = gap <= radius + 1e-9
                near[np.arange(len(x)), own] = True
                row, cell = np.nonzero(near)
                parts.append(rows.iloc[row].assign(cell=cell, home=cell == own[row]))
            yield pd.concat(parts)

    return run


def _join(threshold: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        q, t = rows[rows["asks"]], rows[~rows["asks"]]
        names = ["node", "links", "least"]
        if not len(q) or not len(t):
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in names})
        q, t = q.sort_values("node"), t.sort_values("node")
        x, y = matrix(q["vector"]), matrix(t["vector"])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        y /= np.linalg.norm(y, axis=1, keepdims=True)
        near = x @ y.T >= threshold
        a, b = q["node"].to_numpy(), t["node"].to_numpy()
        near &= a[:, None] != b[None, :]
        links = near @ t["copies"].to_numpy()
        linked = near.any(1)
        out = [(a[linked], links[linked], a[linked])]
        todo = linked.copy()
        while todo.any():  # one turn for each component of the block
            ts = near[todo.argmax()]
            while True:
                qs = near[:, ts].any(1)
                more = near[qs].any(0)
                if (more == ts).all():
                    break
                ts = more
            least = min(a[qs].min(), b[ts].min())
            todo &= ~qs
            ids = np.concatenate([a[qs], b[ts]])
            out.append((ids, np.zeros(len(ids), np.int64), np.full(len(ids), least)))
        return pd.DataFrame({c: np.concatenate([o[i] for o in out]) for i, c in enumerate(names)})

    return run


def near_vectors(rows: DataFrame, threshold: float = 0.93, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of ``vec_id, embedding, label``.

    Vectors link if their labels are equal and not null, their lengths are equal and their cosine is at
    least ``threshold``. Null, zero or non-finite vectors, null labels and null ids link with nothing:
    they have no links and are their own component (null for a null id, and then not kept). Repeated rows
    count as vectors of their own, each a link of the others; an id that is repeated is one node. Other
    columns play no part.
    """
    table = rows.select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").alias("vector"), F.col("label").cast("bigint").alias("label")
    )
    part = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector")), F.lit(False))
    valid = table.where(part)
    one = valid.groupBy("label", "vector").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))
    one = written(one.withColumn("size", F.size("vector")), "vectors")
    classes = one.groupBy("label", "size").count().where(F.col("count") > cell)
    large = written(classes, "classes")
    total = large.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    pivots: dict[tuple, list] = {}
    if total:
        some = one.join(large.select("label", "size"), ["label", "size"], "left_semi")
        some = some.orderBy(F.xxhash64("vector", "label"), "node").limit(min(PIVOTS, -(-total // cell)))
        for r in some.collect():  # at most PIVOTS
            pivots.setdefault((r.label, r["size"]), []).append(r.vector)
    unit = {k: np.array(v, dtype=np.float64) for k, v in pivots.items()}
    unit = {k: v / np.linalg.norm(v, axis=1, keepdims=True) for k, v in unit.items()}
    radius = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    kind = dict(one.dtypes)["vector"]
    placed = one.mapInPandas(
        _assign(unit, radius), f"label bigint, vector {kind}, node bigint, copies bigint, size int, cell bigint, home boolean"
    )
    placed = written(placed, "cells")
    key = ["label", "size", "cell"]
    sizes = placed.groupBy(*key).agg(
        F.ceil(F.sum(F.col("home").cast("int")) / block).cast("int").alias("own"), F.ceil(F.count("*") / block).cast("int").alias("all")
    )
    placed = placed.join(written(sizes, "sizes"), key)
    spread = F.xxhash64("node", "vector")
    mine = F.pmod(spread, F.greatest("own", F.lit(1))).cast("int")
    other = F.pmod(spread, "all").cast("int")
    columns = [*key, "node", "copies", "vector"]
    asks = placed.where("home").select(*columns, mine.alias("i"), F.explode(F.sequence(F.lit(0), F.col("all") - 1)).alias("j"), F.lit(True).alias("asks"))
    told = placed.where("own > 0").select(*columns, F.explode(F.sequence(F.lit(0), F.col("own") - 1)).alias("i"), other.alias("j"), F.lit(False).alias("asks"))
    found = asks.unionAll(told).groupBy(*key, "i", "j").applyInPandas(_join(threshold), "node bigint, links bigint, least bigint")
    found = written(found, "found")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    copies = valid.join(one.select("label", "vector", "node", "copies"), ["label", "vector"])
    copies = written(copies.select("vec_id", "node", "copies"), "copies")
    stars = components(found.select(F.col("node").alias("a"), F.col("least").alias("b")).unionAll(
        copies.where("vec_id != node").select(F.col("vec_id").alias("a"), F.col("node").alias("b"))
    )).toDF("id", "component")
    joined = copies.join(links.withColumnRenamed("node", "n2"), F.col("node") == F.col("n2"), "left")
    joined = joined.select("vec_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    every = joined.unionAll(table.where(~part).select("vec_id", F.lit(0).cast("bigint")))
    every = every.join(stars, F.col("vec_id") == F.col("id"), "left")
    return every.select(
        "vec_id", "n_links", F.coalesce("component", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("component", "vec_id") == F.col("vec_id"), F.lit(False)).alias("kept"),
    )
