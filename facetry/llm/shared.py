"""What several operators need: cutting lineage, and gapless numbers without a single task."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a temporary folder takes its
    place on one machine (``local[...]``, as in tests); on a cluster that would lose data, and is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="facetry-")
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder


#: Rows of a partition of a small settled table.
ROWS = 8192


def settled(df: DataFrame, most: int | None = None) -> DataFrame:
    """The rows of ``df``, computed once and kept in the shared folder, so that a lost executor costs no recomputation.

    ``most``: how many rows there are at most, where that is known. A small table then has as many partitions as these need
    (two at least, so that joins still deal it out), however many there are for shuffles. Each is a file, and for each file
    Hadoop's local file system has the executor begin processes that share its memory until they have their own."""
    shared_folder(df.sparkSession)
    return (df if most is None else df.coalesce(max(2, -(-most // ROWS)))).checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The same as a Parquet table, for large rows: compressed, and read by columns."""
    place = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(place)
    return df.sparkSession.read.parquet(place)


def thinned(df: DataFrame, keys: DataFrame, name: str, bits: int = 1 << 26) -> DataFrame:
    """Rows of ``df`` without most of those whose ``name`` is not in ``keys``, to spare a join's exchange: by a bitmap of
    hashes, of ``bits`` / 8 bytes at most (8 MB), which is broadcast. Where it is full, all rows stay; the join decides."""
    place = F.pmod(F.xxhash64(name), F.lit(bits))
    maps = keys.select(place.alias("_place")).groupBy(F.bitmap_bucket_number("_place").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_place")).alias("_map"))
    rows = df.withColumn("_place", place).withColumn("_bucket", F.bitmap_bucket_number("_place")).join(F.broadcast(settled(maps)), "_bucket")
    set_ = F.expr("(cast(conv(hex(substring(_map, cast(bitmap_bit_position(_place) div 8 as int) + 1, 1)), 16, 10) as int) & shiftleft(1, cast(bitmap_bit_position(_place) % 8 as int))) != 0")
    return rows.where(set_).select(*df.columns)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(df: DataFrame, keys: list[str], order: list[Column], spread_by: list[Column], name: str, buckets: int) -> DataFrame:
    """Adds ``name``: 0, 1, 2, ... within equal ``keys``, without gaps.

    A key may hold any share of the rows: its rows are dealt to ``buckets`` buckets by a hash of ``spread_by``, numbered
    within a bucket, and shifted by the sizes of the buckets before. ``df`` is read twice and should be settled.
    """
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(*spread_by), F.lit(buckets)).cast("int"))
    by = [*keys, "_bucket"]
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shift = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).select(*by, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    own = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.join(shift, by).withColumn(name, F.col("_shift") + own - 1).drop("_bucket", "_shift")
