"""Filters of cards: columns, families, lists, and their conjunction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetry.functions.references import FACTIONS, parsed
from facetry.functions.text import fold, fold_word
from facetry.operators.matching import request_match
from facetry.plans.request import MOST_STAT, Request, Stat


def stat(column: str, wanted: Stat) -> Column:
    """Values above 15 are in no bucket, so no comparison finds them."""
    value = F.col(column)
    if wanted.op == "in":
        return value.isin(*wanted.values)
    bound = wanted.values[0]
    test = {"gt": value > bound, "gte": value >= bound, "lt": value < bound, "lte": value <= bound}[wanted.op]
    return test & value.between(0, MOST_STAT)


def factions(letters: list[str]) -> Column:
    return F.col("faction_code").isin(*(FACTIONS[f] for f in letters))


def universe(families: DataFrame) -> DataFrame:
    """Every slot of every family span, gaps included."""
    return families.select(F.explode(F.sequence(F.col("start_bit"), F.col("start_bit") + F.col("max_unique_id") - 1)).alias("card_index"), "source_set", "family_id")


def named(families: DataFrame, needle: str) -> DataFrame:
    """Families that have a name, in any language, that contains the needle, accents and case aside."""
    word = fold_word(needle.strip())
    return families.where(F.exists(F.map_values("name"), lambda n: F.contains(fold(n), F.lit(word))))


def indices_of(refs: DataFrame, families: DataFrame) -> DataFrame:
    """(reference) -> (reference, card_index, problem): problem is malformed, unknown, ambiguous or padding, or null."""
    read = refs.withColumn("r", parsed(F.col("reference"))).select("reference", "r.*")
    span = families.select("source_set", "faction", "family_number", "start_bit", "max_unique_id")
    same = span.groupBy("source_set", "faction", "family_number").agg(F.count(F.lit(1)).alias("rows"), F.min("start_bit").alias("start_bit"), F.min("max_unique_id").alias("max_unique_id"))
    found = read.join(same, ["source_set", "faction", "family_number"], "left")
    problem = F.when(F.col("unique_id").isNull(), "malformed").when(F.col("rows").isNull(), "unknown").when(F.col("rows") > 1, "ambiguous").when(F.col("unique_id") > F.col("max_unique_id"), "padding")
    return found.withColumn("problem", problem).select("reference", F.when(F.col("problem").isNull(), F.col("start_bit") + F.col("unique_id") - 1).alias("card_index"), "problem")


def references_of(indices: DataFrame, families: DataFrame) -> DataFrame:
    """(card_index) -> (card_index, reference) by the family span that holds it; indices in no span have none.

    Spans are cut at multiples of a grid, so the join is an equi-join on the grid cell and not a range over all pairs."""
    from facetry.functions.references import reference

    grid = 4096
    cells = families.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start_bit") / grid), F.floor((F.col("start_bit") + F.col("max_unique_id") - 1) / grid))))
    cells = cells.select("cell", "start_bit", "max_unique_id", "source_set", "faction", "family_number")
    asked = indices.withColumn("cell", F.floor(F.col("card_index") / grid))
    inside = (F.col("card_index") >= F.col("start_bit")) & (F.col("card_index") < F.col("start_bit") + F.col("max_unique_id"))
    found = asked.alias("a").join(cells.alias("c"), (F.col("a.cell") == F.col("c.cell")) & inside)
    return found.select("card_index", reference(F.col("source_set"), F.col("faction"), F.col("family_number"), F.col("card_index") - F.col("start_bit") + 1).alias("reference"))


def include(cards: DataFrame, members: DataFrame) -> DataFrame:
    return cards.join(members.select("card_index"), "card_index", "left_semi")


def exclude(cards: DataFrame, members: DataFrame) -> DataFrame:
    return cards.join(members.select("card_index"), "card_index", "left_anti")


def conjunction(cards: DataFrame, request: Request, occurrences: DataFrame, families: DataFrame, aliases: DataFrame | None = None, members: list[tuple[DataFrame, bool]] = ()) -> DataFrame:
    """Cards that meet every group of the request. ``members``: (cards, negated) of formats, collections and extra lists."""
    out = cards
    for column, wanted in request.stats.items():
        out = out.where(stat(column, wanted))
    if request.factions:
        out = out.where(factions(list(request.factions)))
    if request.sets:
        out = out.where(F.col("source_set").isin(*request.sets))
    if request.name:
        ids = named(families, request.name).select("source_set", "family_id").distinct()
        out = out.join(ids, ["source_set", "family_id"], "left_semi")
    if request.refs:
        refs = cards.sparkSession.createDataFrame([(r,) for r in request.refs], "reference string")
        out = include(out, indices_of(refs, families).where("card_index is not null"))
    matched = request_match(occurrences, aliases, request.effects, request.effect_mode, request.support)
    if matched is not None:
        out = include(out, matched)
    for list_, negated in members:
        out = exclude(out, list_) if negated else include(out, list_)
    return out
