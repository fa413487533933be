"""Approximate nearest neighbours by counting collisions of query-centred windows.

Vectors are projected on random lines, and for each line kept sorted. A query opens a window
around its own projection on every line; a vector collides on a line if it lies in the window. The
windows widen step by step (virtual rehashing: the same arrays serve every width, and a step
only reads what is new). A vector with enough collisions is verified by its true inner
product; a query is done when its k-th best is nearer than the width that the windows stand
for, since what is as near has by then collided often enough with high probability.
"""

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm.store import written
from netloom.llm.vectors import matrix, usable

LINES = 96
#: The least first width, its growth, and the vectors that a query measures to choose its own first width.
FIRST, GROWTH, MEASURED = 0.3, 1.06, 512
#: Deviations below the mean number of collisions that still pass, for a vector as far as the width.
SLACK = 1.2
#: Vectors of one sorted array, and queries that one task holds against it.
BLOCK, QUERIES = 16_384, 4_096


def first_widths(unit: np.ndarray, wide: np.ndarray, k: int) -> np.ndarray:
    """Where each query's windows begin: about where its k-th neighbour would be if distances were normal, by
    their mean and deviation over evenly spaced vectors. It decides how much is counted, not what is found."""
    n = len(wide)
    some = wide[np.linspace(0, n - 1, min(n, MEASURED)).astype(np.int64)]
    apart = np.sqrt(np.maximum(0, 2 - 2 * unit @ some[:, :unit.shape[1]].T))
    z = NormalDist().inv_cdf(min(0.5, max(k, 1) / (n + 1)))
    return np.clip(apart.mean(1) + z * apart.std(1), FIRST, 2.0)


def search(ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray, k: int, seed: int = 11, counters: dict | None = None) -> list[tuple]:
    """Query, id and inner product of the k best found for each query, best first.

    Largest inner products are nearest unit vectors once each vector gets one more component that
    brings it to the largest norm; queries get a zero there.
    """
    n, dim = x.shape
    square = (x * x).sum(1)
    top = square.max()
    wide = np.concatenate([x, np.sqrt(np.maximum(0, top - square))[:, None]], axis=1) / np.sqrt(top)
    unit = q / np.linalg.norm(q, axis=1, keepdims=True)
    lines = np.random.default_rng(seed).normal(size=(dim + 1, LINES))
    on, at = (wide @ lines).T, unit @ lines[:dim]
    first = first_widths(unit, wide, k)
    steps = max(1, int(np.ceil(np.log(2 / first.min()) / np.log(GROWTH))) + 1)
    widths = np.minimum(first[:, None] * GROWTH ** np.arange(steps), 2.0)  # unit vectors are at most 2 apart
    kind = np.uint16 if n < 1 << 16 else np.uint32
    place = np.empty((LINES, n), kind)  # of each vector in the sorted array of each line
    low = np.empty((len(q), steps, LINES, 1), kind)
    wide_by = np.empty_like(low)
    for i in range(LINES):
        order = np.argsort(on[i], kind="stable")
        place[i, order] = np.arange(n, dtype=kind)
        values = on[i][order]
        left = np.searchsorted(values, at[:, i:i + 1] - widths, "left")
        low[:, :, i, 0] = left
        wide_by[:, :, i, 0] = np.searchsorted(values, at[:, i:i + 1] + widths, "right") - left
    shifted, inside = np.empty_like(place), np.empty(place.shape, bool)
    share = 0.6826894921370859  # of a normal variable within one deviation
    needed = int(LINES * share - SLACK * np.sqrt(LINES * share * (1 - share)))
    out = []
    for j in range(len(q)):
        seen = ids == qids[j]
        found, scores = [], []
        done = False
        for w in range(steps):
            # places below the window wrap around to large numbers, so one comparison says who is inside
            np.subtract(place, low[j, w], out=shifted)
            np.less(shifted, wide_by[j, w], out=inside)
            counts = inside.view(np.uint8).sum(axis=0, dtype=np.uint8)
            fresh = np.flatnonzero((counts >= needed) & ~seen)
            if len(fresh):
                seen[fresh] = True
                found.append(fresh)
                scores.append(x[fresh] @ q[j])
            have = sum(map(len, found))
            if have >= k:
                best = np.concatenate(scores)
                kth = np.partition(best, have - k)[have - k]
                # the distance, between unit vectors, of that inner product
                apart = np.sqrt(max(0.0, 2 - 2 * kth / (np.linalg.norm(q[j]) * np.sqrt(top))))
                if apart <= widths[j, w]:
                    done = True
                    break
        if not done and not seen.all():  # the widest window has everything
            rest = np.flatnonzero(~seen)
            found.append(rest)
            scores.append(x[rest] @ q[j])
        if counters is not None:
            counters["verified"] = counters.get("verified", 0) + sum(map(len, found))
        if found:
            f, s = np.concatenate(found), np.concatenate(scores)
            for i in np.lexsort((ids[f], -s))[:k].tolist():
                out.append((int(qids[j]), int(ids[f[i]]), float(s[i])))
    return out


def _task(k: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        q, x = rows[rows["asks"]], rows[~rows["asks"]]
        found = []
        if len(q) and len(x):
            found = search(x["vec_id"].to_numpy(), matrix(x["vector"]), q["vec_id"].to_numpy(), matrix(q["vector"]), k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return run


def nearest(
    rows: DataFrame, queries: DataFrame | None = None, k: int = 20, every: int = 20, block: int = BLOCK, per_task: int = QUERIES,
) -> DataFrame:
    """``query_id, rank, vec_id, score`` for each query: its k candidates of largest inner product.

    ``queries`` are rows of ``vec_id, embedding``; without them those rows are asked whose id is
    divisible by ``every``. Candidates are all rows of the same length with another id. Null, zero or
    non-finite vectors and null ids take no part. An id that queries repeat is asked once, with its
    smallest vector; candidates that repeat an id are ranked each for themselves. Ties go to the smaller
    id. Queries meet the rows in blocks: each task holds one block of both, dealt out evenly.
    """
    def fine(df: DataFrame) -> DataFrame:
        df = df.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").alias("vector"))
        return df.where(F.col("vec_id").isNotNull() & usable(F.col("vector"))).withColumn("size", F.size("vector"))

    base = written(fine(rows), "base")
    asked = base.where(F.col("vec_id") % every == 0) if queries is None else fine(queries)
    asked = written(asked.groupBy("vec_id").agg(F.min("vector").alias("vector")).withColumn("size", F.size("vector")), "asked")
    nb, nq = (max(1, -(-df.count() // size)) for df, size in ((base, block), (asked, per_task)))
    number = F.monotonically_increasing_id()
    columns = ["vec_id", "vector", "size"]
    held = base.select(*columns, F.pmod(F.xxhash64(number), F.lit(nb)).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("j"), F.lit(False).alias("asks"))
    asks = asked.select(*columns, F.explode(F.sequence(F.lit(0), F.lit(nb - 1))).alias("i"), F.pmod(F.xxhash64(number), F.lit(nq)).cast("int").alias("j"), F.lit(True).alias("asks"))
    held = held.withColumn("i", F.col("i").cast("int"))
    found = held.unionAll(asks).groupBy("size", "i", "j").applyInPandas(_task(k), "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = written(found, "nearest").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
