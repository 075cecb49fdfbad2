"""Card documents: one JSON file each, below json/<set>/<faction>/<family>/."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetry.functions.references import parsed

LOCALE_TEXT = "map<string,struct<locale:string,text:string>>"
LOCALE_NAME = "map<string,struct<locale:string,name:string>>"
SCHEMA = f"""name string, translations {LOCALE_NAME}, illustrator struct<nickName:string>,
    cardSubTypes array<struct<reference:string,name:string,translations:{LOCALE_NAME}>>, cardSet struct<reference:string,name:string>,
    mainFaction struct<reference:string>, cardElements array<struct<cardElementType:struct<reference:string>, value:string,
    cardEffectDisplays array<struct<cardEffect:struct<cardEffectElements:array<struct<idGd:bigint,type:string,text:string,translations:{LOCALE_TEXT}>>>>>>>"""
FIELDS = ("name", "translations", "illustrator", "cardSubTypes", "cardSet", "mainFaction", "cardElements")


def discovered(paths: DataFrame, source_set: str, limit: int | None = None) -> DataFrame:
    """(path) -> (path, source_set, faction, family_number, unique_id) of the card files of one set: name and folders agree,
    and no part of the path is a foiled version. ``limit`` keeps the first of them by faction, number of the family and
    unique number. Looks at paths only."""
    parts = F.split(F.col("path"), "/")
    named = paths.select("path", parsed(F.regexp_extract(F.element_at(parts, -1), r"\A(.*)\.json\z", 1)).alias("_r"), F.slice(parts, F.greatest(F.size(parts) - 3, F.lit(1)), 3).alias("_folders"))
    agree = (F.col("_r.source_set") == source_set) & (F.col("_folders") == F.array("_r.source_set", "_r.faction", "_r.family_number"))
    kept = named.where(agree & ~F.contains("path", F.lit("FOILER"))).select("path", "_r.*")
    return kept.orderBy("faction", F.col("family_number").cast("long"), "unique_id", "path").limit(limit) if limit is not None else kept


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length) of the JSON files below a folder. No file is opened: only what listings tell is asked for."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(folder).select("path", "length")


def read_cards(spark: SparkSession, root: str, source_set: str, limit: int | None = None) -> DataFrame:
    """Documents of one set with the parts of their path: source_set, faction, family_number, unique_id, and the ``FIELDS``.
    Files whose name and folders disagree, and foiled versions, are left out; a malformed document fails. With ``limit``
    (see :func:`discovered`), files are listed first and only the named ones are opened: at most that many paths come to
    the driver, and files beyond the limit may hold anything."""
    folder = f"{root}/json/{source_set}"
    reader = spark.read.schema(SCHEMA).option("multiLine", True).option("mode", "FAILFAST")
    if limit is None:
        files = reader.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(folder)
    else:
        named = [r["path"] for r in discovered(listed(spark, folder), source_set, limit).select("path").collect()]
        files = reader.json(named) if named else None
    if files is None:
        return spark.createDataFrame([], f"source_set string, faction string, family_number string, unique_id long, {SCHEMA}").select("source_set", "faction", "family_number", "unique_id", *FIELDS)
    held = files.withColumn("path", F.col("_metadata.file_path"))
    parts = F.split("path", "/")
    named_ = held.withColumn("_r", parsed(F.regexp_extract(F.element_at(parts, -1), r"\A(.*)\.json\z", 1))).withColumn("_folders", F.slice(parts, -4, 3))
    agree = (F.col("_r.source_set") == source_set) & (F.col("_folders") == F.array("_r.source_set", "_r.faction", "_r.family_number"))
    return named_.where(agree & ~F.contains("path", F.lit("FOILER"))).select("_r.*", *FIELDS)
