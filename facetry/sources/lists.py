"""Lists of references, and formats with their manifest."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT_SCHEMA = "id string, version long, included_refs array<string>, excluded_sets array<string>, excluded_refs array<string>"


def read_references(spark: SparkSession, path: str) -> DataFrame:
    """(reference): one a line, trimmed; blank lines and those that start with # are left out."""
    lines = spark.read.text(path).select(F.trim("value").alias("reference"))
    return lines.where((F.length("reference") > 0) & ~F.startswith("reference", F.lit("#")))


def references_in(body: str) -> list[str]:
    return [x for line in body.splitlines() if (x := line.strip()) and not x.startswith("#")]


def read_formats(spark: SparkSession, folder: str) -> DataFrame:
    """(id, version, included_refs, excluded_sets, excluded_refs, status) of the manifest's entries. status: ready, or failed
    where the definition is missing or has another id or version, where it both includes and excludes, or where an id is
    listed twice."""
    listed = spark.read.schema("id string, path string, version long").option("multiLine", True).json(f"{folder}/manifest.json")
    listed = listed.where(F.length("id").between(1, 32))
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    held = spark.read.schema(FORMAT_SCHEMA).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder).withColumn("file", name)
    held = held.where("file <> 'manifest.json'").withColumnsRenamed({"id": "own_id", "version": "own_version"})
    again = listed.groupBy("id").agg(F.count(F.lit(1)).alias("times"))
    joined = listed.withColumn("file", F.element_at(F.split("path", "/"), -1)).join(held, "file", "left").join(again, "id")
    excludes = (F.coalesce(F.size("excluded_sets"), F.lit(0)) > 0) | (F.coalesce(F.size("excluded_refs"), F.lit(0)) > 0)
    includes = F.coalesce(F.size("included_refs"), F.lit(0)) > 0
    good = (F.col("own_id") == F.col("id")) & (F.col("own_version") == F.col("version")) & (F.col("times") == 1) & (includes != excludes)
    return joined.select("id", "version", "included_refs", "excluded_sets", "excluded_refs", F.when(good, "ready").otherwise("failed").alias("status")).dropDuplicates(["id"])


def format_members(formats: DataFrame, families: DataFrame) -> DataFrame:
    """(id, negated, card_index) of ready formats; (id, problem) rows hold the references that don't resolve."""
    from facetry.operators.filters import indices_of

    ready = formats.where("status = 'ready'")
    negated = F.coalesce(F.size("included_refs"), F.lit(0)) == 0
    refs = ready.select("id", negated.alias("negated"), F.explode(F.when(negated, F.col("excluded_refs")).otherwise(F.col("included_refs"))).alias("reference"))
    found = refs.join(indices_of(refs.select("reference").distinct(), families), "reference").select("id", "negated", "card_index", "problem")
    sets = ready.where(negated).select("id", F.explode("excluded_sets").alias("source_set"))
    spans = sets.join(families, "source_set").select("id", F.lit(True).alias("negated"), F.explode(F.sequence(F.col("start_bit"), F.col("start_bit") + F.col("max_unique_id") - 1)).alias("card_index"), F.lit(None).cast("string").alias("problem"))
    return found.union(spans)


def filter_id(text: str) -> bool:
    return bool(re.fullmatch(r"[A-Za-z0-9_-]+", text))


def collection_id(text: str) -> bool:
    return bool(re.fullmatch(r"[A-Za-z0-9_-]{4,36}", text.strip()))
