"""Folders for tables that a job writes on its way."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's own switch for what :func:`tidy` asks.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which driver and executors share. Where that is unset, a temporary folder takes its place on
    one machine (``local[...]``, as in tests); on a cluster that would lose data, and is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="facetry-")
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder there."""
    return f"{shared(spark)}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """The rows of ``df``, computed once: what follows doesn't plan or compute it again."""
    shared(df.sparkSession)
    with tidy(df.sparkSession):
        return df.checkpoint(eager=True)


@contextmanager
def unsorted(spark: SparkSession, folders: int) -> Iterator[None]:
    """A write that deals its rows to at most so many folders keeps a file open for each, and sorts no rows for it."""
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key)
    spark.conf.set(key, str(folders))
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is computed inside go when it ends. Else they stay until the driver happens to collect its garbage,
    and the steps of a job add up on disk. Not for a lazy table that something outside computes further."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def stored(df: DataFrame) -> DataFrame:
    """As :func:`settled`, for large tables: a compressed Parquet table, read by columns."""
    place = scratch(df.sparkSession, "stored")
    with tidy(df.sparkSession):
        df.write.option("compression", "zstd").parquet(place)
    return df.sparkSession.read.parquet(place)


#: Bits of the map in :func:`thinned`: half a million words at most.
BITS = 1 << 25


def thinned(df: DataFrame, keys: DataFrame, *names: str) -> DataFrame:
    """Rows of ``df`` without most of those whose ``names`` are not in ``keys``, to spare a join's exchange: by a bitmap of hashes
    in words of 64 bits, which is broadcast. The fuller it is, the more rows stay; the join decides."""
    place = F.pmod(F.xxhash64(*names), F.lit(BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))
    words = keys.groupBy(F.shiftright(place, 6).alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    rows = df.withColumn("_word", F.shiftright(place, 6)).join(F.broadcast(words), "_word")
    return rows.where(F.col("_bits").bitwiseAND(bit) != 0).select(*df.columns)
