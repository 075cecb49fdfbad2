"""An index on disk: Parquet tables below versioned folders, and a pointer that is written last."""

from __future__ import annotations

import re
from collections.abc import Collection

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetry.errors import BadRequest, InvalidData, NotFound
from facetry.operators.filters import indices_of
from facetry.operators.ingest import manifest
from facetry.operators.summaries import faction_counts, stat_histogram
from facetry.sources.ranged import ROWS, Ranged, write_ranged
from facetry.sources.scratch import tidy

POINTER = "version long, span long, card_count long, built_at long"
#: Tables that are written as they are, those in parts with the columns of their order, and the counts that merges add up.
PLAIN = ("families", "abilities", "aliases")
PARTED = {"cards": ("card_index",), "occurrences": ("id_gd", "card_index")}
SUMMARIES = ("stat_counts", "faction_counts", "manifest")


def publish(index: dict[str, DataFrame], root: str, version: int, rows: int = ROWS, again: Collection[str] = ()) -> None:
    """Writes all tables of a version, then the pointer: readers see a version only when it is whole. Cards are written in
    parts by their index and occurrences by ability, ``rows`` a part, each with a directory, so that lookups open
    only the parts they need. Summaries that the index doesn't bring are counted. ``again``: names of tables in parts that
    are cheap to compute again."""
    with tidy(index["cards"].sparkSession):
        _publish(index, root, version, rows, again)


def _publish(index: dict[str, DataFrame], root: str, version: int, rows: int, again: Collection[str]) -> None:
    place = f"{root}/v={version}"
    for name in PLAIN:
        index[name].write.mode("overwrite").option("compression", "zstd").parquet(f"{place}/{name}")
    for name, by in PARTED.items():
        write_ranged(index[name], f"{place}/{name}", by, rows, name in again)
    cards = Ranged.read(index["cards"].sparkSession, f"{place}/cards", PARTED["cards"]).table()
    counted = {"stat_counts": lambda: stat_histogram(cards), "faction_counts": lambda: faction_counts(cards), "manifest": lambda: manifest(index)}
    for name in SUMMARIES:
        own = index[name] if name in index else counted[name]()
        own.coalesce(1).write.mode("overwrite").parquet(f"{place}/{name}")
    row = index["families"].agg(F.coalesce(F.sum("max_unique_id"), F.lit(0)).alias("span"), F.coalesce(F.sum("card_count"), F.lit(0)).alias("card_count"))
    row.select(F.lit(version).cast("long").alias("version"), "span", "card_count", F.unix_timestamp().alias("built_at")).coalesce(1).write.mode("append").json(f"{root}/pointer")


def latest(spark: SparkSession, root: str) -> dict | None:
    """The pointer of the newest version, or None."""
    from pyspark.errors import AnalysisException

    try:
        row = spark.read.schema(POINTER).json(f"{root}/pointer").orderBy(F.desc("version"), F.desc("built_at")).first()
    except AnalysisException:
        return None
    return row.asDict() if row else None


def load(spark: SparkSession, root: str, version: int | None = None, parted: dict[str, Ranged] | None = None) -> dict[str, DataFrame]:
    """The tables of a version, the newest if none is named; fails if spans don't add up. ``parted``: what :func:`ranged`
    has given, so that folders are listed once."""
    if version is None:
        pointer = latest(spark, root)
        if pointer is None:
            raise NotFound(f"no published index below {root}")
        version = pointer["version"]
    index = {name: spark.read.parquet(f"{root}/v={version}/{name}") for name in (*PLAIN, *SUMMARIES)}
    parted = parted or ranged(spark, root, version)
    span = index["families"].agg(F.coalesce(F.sum("max_unique_id"), F.lit(0))).first()[0]
    most = parted["cards"].parts.agg(F.max("most")).first()[0]
    if most is not None and most >= span:
        raise InvalidData("a card lies beyond the families' spans")
    return index | {name: own.table() for name, own in parted.items()}


def ranged(spark: SparkSession, root: str, version: int) -> dict[str, Ranged]:
    """The tables in parts of a version, for lookups by key or rank."""
    return {name: Ranged.read(spark, f"{root}/v={version}/{name}", by) for name, by in PARTED.items()}


def add_list(index: dict[str, DataFrame], root: str, filter_id: str, refs: DataFrame, negated: bool = False, kind: str | None = None, replace: bool = False) -> DataFrame:
    """Registers a list of references as an extra filter: members below extra/filter_id=..., and a catalogue row. Every
    reference must resolve. An id that exists is an error unless it is to be replaced. Returns its members."""
    if not re.fullmatch(r"[A-Za-z0-9_-]+", filter_id):
        raise BadRequest(f"invalid filter id '{filter_id}'")
    spark = refs.sparkSession
    if not replace and any(r["filter_id"] == filter_id for r in lists(spark, root).collect()):
        raise BadRequest(f"filter '{filter_id}' exists")
    found = indices_of(refs.distinct(), index["families"])
    bad = found.where("problem is not null").first()
    if bad:
        raise BadRequest(f"{bad['problem']} reference '{bad['reference']}'")
    place = f"{root}/extra/filter_id={filter_id}"
    found.select("card_index").distinct().write.mode("overwrite").parquet(place)
    members = spark.read.parquet(place)
    entry = members.agg(F.count(F.lit(1)).alias("card_count")).select(F.lit(kind).cast("string").alias("type"), F.lit(negated).alias("negated"), "card_count")
    entry.coalesce(1).write.mode("overwrite").json(f"{root}/extra_catalog/filter_id={filter_id}")
    return members


def lists(spark: SparkSession, root: str) -> DataFrame:
    """(filter_id, type, negated, card_count) of the registered lists."""
    from pyspark.errors import AnalysisException

    schema = "type string, negated boolean, card_count long, filter_id string"
    try:
        return spark.read.schema(schema).option("basePath", f"{root}/extra_catalog").json(f"{root}/extra_catalog").select("filter_id", "type", "negated", "card_count")
    except AnalysisException:
        return spark.createDataFrame([], "filter_id string, type string, negated boolean, card_count long")
