"""Tables in parts that follow one another in the order of a key, with a directory of the parts.

A part is a folder ``part=<k>``, so a scan that names parts lists and opens these alone. The directory has a row a part: the
least and the largest key, the number of rows, and how many rows lie before it. From it follow, with no look at the rows,
the parts that may hold a key, a range of keys, or a rank. It has one row for each ``ROWS`` rows of the table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facetry.sources.scratch import stored, tidy

#: Rows of a part, about.
ROWS = 1 << 20
#: Rows that a task sorts, about, where parts are smaller; and the most parts that one task's numbers leave room for.
TASK_ROWS, STRIDE = 1 << 17, 1 << 20


def write_ranged(table: DataFrame, path: str, by: Sequence[str], rows: int = ROWS, again: bool = False) -> None:
    """Writes ``table`` below ``path`` and its directory below ``path``_parts. The first column of ``by`` is the key; further
    ones order equal keys and let a key of many rows go on from part to part. A null key is in no directory entry's range,
    but counts among the rows of its part, where it comes first. ``again``: the table is cheap to compute again.

    A task sorts one range of keys and cuts it into parts, so that small parts don't need a task each."""
    spark = table.sparkSession
    # Counted, sampled for the ranges, and written.
    table = table if again else stored(table)
    with tidy(spark):
        n = table.count()
        if n:
            tasks = -(-n // max(rows, TASK_ROWS))
            place = F.monotonically_increasing_id()
            part = F.shiftright(place, 33) * STRIDE + F.floor(place.bitwiseAND((1 << 33) - 1) / rows)
            dealt = table.repartitionByRange(tasks, *by).sortWithinPartitions(*by).withColumn("part", part)
            dealt.write.mode("overwrite").option("compression", "zstd").partitionBy("part").parquet(path)
        else:
            table.withColumn("part", F.lit(0)).coalesce(1).write.mode("overwrite").parquet(path)
        held = spark.read.parquet(path).select(by[0], "part")
        sizes = held.groupBy("part").agg(F.min(by[0]).alias("least"), F.max(by[0]).alias("most"), F.count(F.lit(1)).alias("rows"))
        before = F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
        sizes.withColumn("before", F.coalesce(before, F.lit(0))).coalesce(1).write.mode("overwrite").parquet(f"{path}_parts")


@dataclass(frozen=True)
class Ranged:
    """A written table: all rows, its directory, and the columns of its order, the key first."""

    rows: DataFrame
    parts: DataFrame
    by: tuple[str, ...]

    @staticmethod
    def read(spark: SparkSession, path: str, by: Sequence[str]) -> Ranged:
        return Ranged(spark.read.parquet(path), spark.read.parquet(f"{path}_parts"), tuple(by))

    def table(self) -> DataFrame:
        return self.rows.drop("part")

    def _named(self, test: Column) -> list[int]:
        return [r["part"] for r in self.parts.where(test).select("part").collect()]

    def _among(self, test: Column) -> DataFrame:
        parts = self._named(test)
        return self.rows.where(F.col("part").isin(*parts)) if parts else self.rows.where("false")

    def with_keys(self, keys: Sequence[int]) -> DataFrame:
        """Rows with any of the keys, which a caller names: only parts whose range holds one are opened."""
        if not keys:
            return self.table().where("false")
        hit = F.exists(F.array(*(F.lit(k) for k in keys)), lambda k: k.between(F.col("least"), F.col("most")))
        return self._among(hit).where(F.col(self.by[0]).isin(*keys)).drop("part")

    def between(self, least: int, most: int) -> DataFrame:
        """Rows with a key from ``least`` to ``most``."""
        return self._among((F.col("most") >= least) & (F.col("least") <= most)).where(F.col(self.by[0]).between(least, most)).drop("part")

    def total(self) -> int:
        return self.parts.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]

    def select(self, ranks: Sequence[int], following: int = 1) -> DataFrame:
        """The rows of each rank (from 0) and of the ``following`` - 1 after it, with the columns ``start`` (the rank that was asked
        for) and ``rank``. Ranks past the end have no row. Only parts with such ranks are opened, and rows are numbered
        within a part, from what lies before it."""
        last = F.col("before") + F.col("rows") - 1
        starts = F.array(*(F.lit(r).cast("long") for r in ranks)) if ranks else F.array().cast("array<long>")
        hit = F.exists(starts, lambda r: (r <= last) & (r + following > F.col("before")))
        found = self._among(hit).join(F.broadcast(self.parts.select("part", "before").where(hit)), "part")
        own = F.row_number().over(Window.partitionBy("part").orderBy(*self.by)) - 1
        ranked = found.withColumn("rank", F.col("before") + own).drop("part", "before")
        return ranked.withColumn("start", F.explode(F.filter(starts, lambda r: F.col("rank").between(r, r + following - 1))))


def start_rank(total: int, far: int = 10_000, page: int = 50) -> int:
    """Where a window into a long listing starts: at ``far``, or so that a last page remains."""
    return far if total >= far else max(0, total - page)
