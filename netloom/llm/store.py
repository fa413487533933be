"""Tables written between the steps of one job, and small column helpers."""

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.session import fresh_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, safe from lost executors."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def batches_of(spark: SparkSession, size: str) -> Iterator[None]:
    """Arrow batches of ``size`` for what is written within: rows that hold long arrays fill a
    batch of the usual size with more than two Python workers have room for."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, size)
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


_DROP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a job within go when it has ended. Otherwise those of all jobs stay on the disks until the driver happens
    to collect its garbage. For jobs that write tables; none of them is run again."""
    before = spark.conf.get(_DROP, "false")
    spark.conf.set(_DROP, "true")
    try:
        yield
    finally:
        spark.conf.set(_DROP, before)


def lower_ascii(column: Column) -> Column:
    """Lower case for A-Z alone."""
    return F.translate(column, UPPER, UPPER.lower())


def column_or_null(df: DataFrame, name: str, kind: str) -> Column:
    """The column, or nulls where the table has none of that name."""
    return F.col(f"`{name}`").cast(kind) if name in df.columns else F.lit(None).cast(kind)


#: Bits of the filter below: 16 for each key, this many at most.
FILTER_BITS = 1 << 27
_SEGMENT = 1 << 16


def among(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """``df`` without most rows whose bigint ``key`` is not among ``keys``, so that a join need not move
    them. A bitmap of hashed keys, 16 MB at most, is sent to the tasks; with more keys than it can
    hold apart it lets more rows through, never fewer."""
    bits = _SEGMENT
    wanted = keys.count() * 16
    while bits < min(wanted, FILTER_BITS):
        bits *= 2
    spot = F.pmod(F.xxhash64(F.col(key).cast("bigint")), F.lit(bits))
    found = keys.select(F.col(key)).select(spot.alias("spot")).distinct()
    parts = found.groupBy((F.col("spot") / _SEGMENT).cast("int").alias("segment")).applyInPandas(
        _bitmap, "segment int, bits binary"
    )
    table = np.zeros(bits // 8, np.uint8)
    for r in parts.collect():  # at most FILTER_BITS / _SEGMENT rows of 8 kB, in one job and not one a partition
        at = r.segment * (_SEGMENT // 8)
        table[at:at + _SEGMENT // 8] = np.frombuffer(r.bits, np.uint8)

    def held(spots: pd.Series) -> pd.Series:
        x = spots.to_numpy()
        return pd.Series((table[x >> 3] >> (x & 7)) & 1 == 1)

    return df.where(F.pandas_udf(held, "boolean")(spot))


def _bitmap(rows: pd.DataFrame) -> pd.DataFrame:
    spots = rows["spot"].to_numpy()
    flags = np.zeros(_SEGMENT, np.uint8)
    flags[spots % _SEGMENT] = 1
    return pd.DataFrame({"segment": [int(spots[0] // _SEGMENT)], "bits": [np.packbits(flags, bitorder="little").tobytes()]})
