"""Merging the indexes of several sets into one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facetry.errors import InvalidData
from facetry.functions.references import family_order
from facetry.operators import summaries
from facetry.operators.aliases import united
from facetry.operators.ingest import aliases_of, duplicates_of, lazy, masked, posting_counts, remapped_slots, unmasked
from facetry.sources.scratch import settled, stored

Index = dict[str, DataFrame]


def overlap_groups(families_of_set: dict[str, set[str]]) -> dict[str, int]:
    """The group of each set, in order: a set joins the last group if they share a family, else it begins one."""
    out: dict[str, int] = {}
    group, held = -1, set()
    for name, ids in families_of_set.items():
        if group < 0 or not held & ids:
            group, held = group + 1, set()
        held |= ids
        out[name] = group
    return out


def layout(families: DataFrame, groups: dict[str, int]) -> DataFrame:
    """families of all sets -> (source_set, family_id, old_start, new_start, max_unique_id): within a group by family, within
    a family by the order of sets. The window is over families."""
    spark = families.sparkSession
    order = spark.createDataFrame([(s, g, k) for k, (s, g) in enumerate(groups.items())], "source_set string, set_group int, set_rank int")
    placed = families.join(F.broadcast(order), "source_set")
    by = Window.orderBy("set_group", *family_order(F.col("faction"), F.col("family_number")), "family_number", "set_rank").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("source_set", "family_id", F.col("start_bit").alias("old_start"), F.coalesce(F.sum("max_unique_id").over(by), F.lit(0)).cast("long").alias("new_start"), "max_unique_id")


def moved(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows with (source_set, card_index) with the merged index; rows outside the plan's spans go. Spans are cut at a grid,
    so the join has a key; the cells, one for each 4,096 places of the index, go to every task, so that no row moves."""
    grid = 4096
    end = F.col("old_start") + F.col("max_unique_id") - 1
    cells = plan.withColumn("cell", F.explode(F.sequence(F.floor(F.col("old_start") / grid), F.floor(end / grid))))
    joined = rows.withColumn("cell", F.floor(F.col("card_index") / grid)).join(F.broadcast(cells.drop("family_id")), ["source_set", "cell"])
    inside = F.col("card_index").between(F.col("old_start"), end)
    return joined.where(inside).withColumn("card_index", F.col("new_start") + F.col("card_index") - F.col("old_start")).drop("cell", "old_start", "new_start", "max_unique_id")


def merged(sources: dict[str, Index], collapse: bool = True) -> Index:
    """One index of at least two sets, each with families, cards, occurrences and abilities. Types and texts come from the
    first set that has an id; flags hold if they hold in any; counts of abilities are made anew, those of stats and factions
    are added. Each id that any set has collapsed has one canonical id after (see :func:`united`)."""
    if len(sources) < 2:
        raise InvalidData("a merge needs at least two sets")
    names = list(sources)
    tagged = lambda t: _union([sources[s][t].withColumn("source_set", F.lit(s)) if "source_set" not in sources[s][t].columns else sources[s][t] for s in names])
    families = tagged("families")
    held: dict[str, set[str]] = {s: set() for s in names}
    for r in families.select("source_set", "family_id").distinct().collect():
        if r["source_set"] not in held:
            raise InvalidData(f"a source holds families of {r['source_set']}")
        held[r["source_set"]].add(r["family_id"])
    plan = settled(layout(families, overlap_groups(held)))
    cards = moved(tagged("cards"), plan)
    held_on = moved(tagged("occurrences"), plan)
    rank = F.array_position(F.array(*map(F.lit, names)), F.col("source_set"))
    abilities = tagged("abilities").groupBy("id_gd").agg(F.min_by("element_type", rank).alias("element_type"), F.min_by("translations", rank).alias("translations"), F.bool_or("is_main").alias("is_main"), F.bool_or("is_echo").alias("is_echo"))
    abilities = stored(abilities) if collapse else abilities
    aliases = aliases_of(abilities) if collapse else abilities.select(F.col("id_gd").alias("alias"), F.col("id_gd").alias("canonical")).where("false")
    old = [sources[s]["aliases"].select("alias", "canonical") for s in names if "aliases" in sources[s]]
    aliases = united(_union([aliases.select("alias", "canonical"), *old]))
    # An id that is an alias in one set goes everywhere: its cards of other sets must be found by the id that stands for it.
    masks = masked(held_on, aliases, lazy)
    abilities = abilities.join(posting_counts(masks).drop("is_main", "is_echo"), "id_gd").join(duplicates_of(aliases), F.col("id_gd") == F.col("canonical"), "left").drop("canonical")
    starts = plan.select("source_set", "family_id", F.col("new_start").alias("start_bit"))
    families = families.drop("start_bit").join(starts, ["source_set", "family_id"])
    counts = [sources[s].get("stat_counts", summaries.stat_histogram(sources[s]["cards"])) for s in names]
    by_faction = [sources[s].get("faction_counts", summaries.faction_counts(sources[s]["cards"])) for s in names]
    sums = {"stat_counts": summaries.added(counts, "field", "value"), "faction_counts": summaries.added(by_faction, "faction")}
    return {"cards": remapped_slots(cards, aliases), "families": families, "occurrences": unmasked(masks), "abilities": abilities, "aliases": aliases, **sums}


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def deduplicated(index: Index) -> Index | None:
    """The index with abilities of equal text collapsed; None if there is nothing to collapse."""
    texts = stored(index["abilities"].select("id_gd", "element_type", "translations"))
    aliases = stored(aliases_of(texts))
    if not aliases.head(1):
        return None
    every = united(_union([index["aliases"].select("alias", "canonical"), aliases.select("alias", "canonical")]))
    masks = masked(index["occurrences"], every, lazy)
    abilities = texts.join(posting_counts(masks), "id_gd").join(duplicates_of(every), F.col("id_gd") == F.col("canonical"), "left").drop("canonical")
    return index | {"cards": remapped_slots(index["cards"], every), "occurrences": unmasked(masks), "abilities": abilities, "aliases": every}
