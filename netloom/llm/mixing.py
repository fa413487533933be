"""Mixing sources to target weights by Poisson replication.

A source with weight w and n of the N rows is to be seen at a rate of w * T / n per row,
T being the rows wanted. Every row draws its number of copies by inverting the Poisson
distribution of that mean at a hash of the row and the seed, is exploded by it, and all
copies are shuffled by another hash. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm.store import column_or_null, written

#: A higher mean is drawn as the sum of equal parts of at most this mean, which is the
#: same distribution; it keeps exp(-mean) exact and the tables of probabilities short.
PART = 32.0
#: Entries of a table beyond the mean; what is left is under the hash's 2**-52.
TAIL = 12.0
SEED = "mix-1"


def source_rates(
    docs: DataFrame, weights: Mapping[str, float] | None, power: float, total: int | None
) -> DataFrame:
    """``source, rate, parts, cdf``: one row for each source that has a positive rate."""
    counts = docs.groupBy(column_or_null(docs, "source", "string").alias("source")).agg(
        F.count("*").cast("double").alias("n")
    )
    if weights is None:
        counts = counts.withColumn("w", F.pow("n", F.lit(float(power))))
    else:
        listed = docs.sparkSession.createDataFrame(
            [(k, float(v)) for k, v in weights.items()], "source string, w double"
        )
        counts = counts.join(listed.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left")
        counts = counts.select("source", "n", F.coalesce("w", F.lit(0.0)).alias("w"))
    counts = written(counts, "mix-sources")
    sums = counts.agg(F.sum("w").alias("all_w"), F.sum("n").alias("all_n")).first()
    wanted = float(total) if total is not None else (sums.all_n or 0.0)
    rate = F.col("w") / F.lit(sums.all_w or 1.0) * F.lit(wanted) / F.col("n")
    rates = counts.select("source", rate.alias("rate")).where("rate > 0")
    rates = rates.withColumn("parts", F.ceil(F.col("rate") / F.lit(PART)).cast("int"))
    rates = rates.withColumn("mean", F.col("rate") / F.col("parts"))
    last = F.ceil(F.col("mean") + F.lit(TAIL) * F.sqrt("mean") + F.lit(30.0)).cast("int")
    # probability of k, and of at most k, for k = 0, 1, ...
    first = F.exp(-F.col("mean"))
    start = F.struct(first.alias("p"), F.array(first).alias("cdf"))

    def step(so_far: Column, k: Column) -> Column:
        p = so_far["p"] * F.col("mean") / k.cast("double")
        return F.struct(p.alias("p"), F.concat(so_far["cdf"], F.array(F.element_at(so_far["cdf"], -1) + p)).alias("cdf"))

    cdf = F.aggregate(F.sequence(F.lit(1), last), start, step)["cdf"]
    return written(rates.select("source", "rate", "parts", cdf.alias("cdf")), "mix-rates")


def uniform(*parts: Column) -> Column:
    """52 bits of a hash, as a number from 0 to below 1."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def mix(
    docs: DataFrame, weights: Mapping[str, float] | None = None, power: float = 0.5,
    total: int | None = None, seed: str = SEED,
) -> DataFrame:
    """The copies that make up the mixture: all columns of ``docs``, then ``copy`` (from 1),
    ``rate`` and ``order_key``; each partition is sorted by the key.

    ``weights`` gives a share to each named source, others get none; without it a source of
    n rows weighs n ** ``power``. Null is a source of its own. ``total`` is the number of rows
    aimed at, by default as many as come in. Rows draw by ``doc_id`` (by their text where it is
    null), so rows that repeat an id draw alike. Columns of ``docs`` with the new names are
    replaced. Rates are one row a source; Spark broadcasts that table if its size allows and
    else joins by shuffle, where adaptive execution splits a source that holds most rows.
    """
    rates = source_rates(docs, weights, power, total)
    own = [c for c in docs.columns if c not in ("copy", "rate", "order_key")]
    key = F.coalesce(
        column_or_null(docs, "doc_id", "string"), F.md5(F.coalesce(column_or_null(docs, "text", "string"), F.lit("")))
    )
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), key.alias("key"),
        column_or_null(docs, "source", "string").alias("s"),
    )
    rows = rows.join(rates, F.col("s").eqNullSafe(F.col("source")))
    drawn = F.transform(
        F.sequence(F.lit(1), F.col("parts")),
        lambda j: F.size(F.filter(
            F.col("cdf"), lambda c: c <= uniform(F.lit(seed), F.col("key"), j.cast("string"))
        )),
    )
    # one part is the common case and needs no loop
    one = F.size(F.filter(F.col("cdf"), lambda c: c <= F.col("u")))
    rows = rows.withColumn("u", uniform(F.lit(seed), F.col("key"), F.lit("1")))
    count = F.when(F.col("parts") == 1, one).otherwise(
        F.aggregate(drawn, F.lit(0), lambda a, b: a + b)
    )
    rows = rows.select("row", "key", "rate", count.alias("n")).where("n > 0")
    copies = rows.select("row", "key", "rate", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    order = F.md5(F.concat_ws("|", F.lit(seed), F.lit("order"), F.col("key"), F.col("copy").cast("string")))
    out = copies.select("row.*", "copy", "rate", order.alias("order_key"))
    return out.repartition("order_key").sortWithinPartitions("order_key")
