"""From card documents to the tables of the index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetry.errors import InvalidData
from facetry.functions.references import faction_code, family_id, family_order, reference, set_code
from facetry.functions.text import has_no_break_space, in_locale, one_space, small_number
from facetry.sources.scratch import settled, stored, thinned, tidy

STAT_ELEMENTS = {"main_cost": "MAIN_COST", "recall_cost": "RECALL_COST", "mountain_power": "MOUNTAIN_POWER", "ocean_power": "OCEAN_POWER", "forest_power": "FOREST_POWER"}
TYPES = ("TRIGGER", "CONDITION", "OUTPUT")
GROUPS = ("m1", "m2", "m3", "ec")
#: Locales that a subtype's name is given in where only the English one is known (fixed values).
SUBTYPE_LOCALES = ("de_DE", "en_US", "es_ES", "fr_FR", "it_IT")
#: Slot ids are kept modulo this number; occurrences keep the whole id.
SLOT_IDS = 65536


def families_of(cards: DataFrame) -> DataFrame:
    """One row per (source_set, faction, family_number): max_unique_id, card_count, start_bit and what its first card says."""
    keys = ["source_set", "faction", "family_number"]
    sizes = settled(cards.groupBy(*keys).agg(F.max("unique_id").alias("max_unique_id"), F.count(F.lit(1)).alias("card_count"), F.min("unique_id").alias("_first")))
    # Only numbers are compared among all cards; what the first one says is looked up.
    said = [c for c in ("name_map", "artist", "card_sub_types", "card_set") if c in cards.columns]
    one = sizes.select(*keys, F.col("_first").alias("unique_id"))
    first = cards.join(F.broadcast(one), [*keys, "unique_id"], "left_semi").groupBy(*keys).agg(*(F.first(c).alias(c) for c in said)) if said else None
    return placed((sizes.join(first, keys, "left") if said else sizes).drop("_first"))


def placed(families: DataFrame) -> DataFrame:
    """Adds family_id and start_bit. Spans follow one another in the order of sets, factions and numbers; the running sum is
    over families, not cards."""
    order = Window.orderBy("source_set", *family_order(F.col("faction"), F.col("family_number")), "family_number")
    before = F.coalesce(F.sum("max_unique_id").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    return families.withColumn("start_bit", before).withColumn("family_id", family_id(F.col("faction"), F.col("family_number")))


def indexed(cards: DataFrame, families: DataFrame) -> DataFrame:
    """Adds card_index, family_id and reference."""
    joined = cards.join(spans_of(families), ["source_set", "faction", "family_number"])
    ref = reference(F.col("source_set"), F.col("faction"), F.col("family_number"), F.col("unique_id"))
    return joined.withColumn("card_index", F.col("start_bit") + F.col("unique_id") - 1).withColumn("reference", ref).drop("start_bit")


def spans_of(families: DataFrame) -> DataFrame:
    """What places a card: a row a family, sent to every task, so that cards and documents stay where they are."""
    return F.broadcast(families.select("source_set", "faction", "family_number", "start_bit", "family_id"))


def check_unique(cards: DataFrame) -> None:
    """Raises if a unique number occurs twice in a family. ``cards`` may have the card_index, which stands for all keys."""
    keys = ["source_set", "faction", "family_number", "unique_id"]
    by, rest = (["card_index"], keys) if "card_index" in cards.columns else (keys, [])
    with tidy(cards.sparkSession):
        twice = cards.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where("n > 1").first()
        if twice and rest:
            twice = cards.where(F.col("card_index") == twice["card_index"]).first()
    if twice:
        raise InvalidData(f"duplicate unique id {twice['unique_id']} in {twice['faction']}_{twice['family_number']}")


def _elements(kind: str) -> Column:
    return F.filter(F.coalesce("cardElements", F.array()), lambda e: e["cardElementType"]["reference"] == kind)


def stat_value(kind: str) -> Column:
    """The last readable value of the elements of this kind, else 0."""
    values = F.filter(F.transform(_elements(kind), lambda e: small_number(e["value"])), lambda v: v.isNotNull())
    return F.coalesce(F.try_element_at(values, F.lit(-1)), F.lit(0)).cast("int")


def _effects(element: Column) -> Column:
    """An array of arrays: the ability elements of each display."""
    return F.transform(F.coalesce(element["cardEffectDisplays"], F.array()), lambda d: F.coalesce(d["cardEffect"]["cardEffectElements"], F.array()))


def _slot(abilities: Column, kind: str) -> Column:
    ids = F.transform(F.filter(abilities, lambda a: (a["type"] == kind) & (a["idGd"] % SLOT_IDS != 0)), lambda a: a["idGd"] % SLOT_IDS)
    return F.coalesce(F.try_element_at(ids, F.lit(1)), F.lit(0)).cast("int")


def with_slots(documents: DataFrame) -> DataFrame:
    """Adds m1, m2, m3, ec: structs (t, c, o) of the first id of each type; of a repeated element the last counts. Elements and
    lines are columns of their own on the way: Spark would evaluate them again for each slot."""
    empty = F.array().cast("array<struct<idGd:bigint,type:string>>")
    ids = lambda displays: F.transform(displays, lambda d: F.transform(d, lambda a: F.struct(a["idGd"].alias("idGd"), a["type"].alias("type"))))
    own = {f"_{kind}": ids(_effects(F.try_element_at(_elements(f"{kind}_EFFECT"), F.lit(-1)))) for kind in ("MAIN", "ECHO")}
    lines = {f"_{g}": F.coalesce(F.try_element_at("_MAIN", F.lit(i + 1)) if g != "ec" else F.flatten("_ECHO"), empty) for i, g in enumerate(GROUPS)}
    found = {g: F.struct(*(_slot(F.col(f"_{g}"), kind).alias(kind[0].lower()) for kind in TYPES)) for g in GROUPS}
    return documents.withColumns(own).withColumns(lines).withColumns(found).drop(*own, *lines)


def names(name: Column, translations: Column) -> Column:
    """Names by locale, blanks dropped; the plain name stands for en_US if that has none."""
    kept = F.map_filter(F.transform_values(F.coalesce(translations, F.create_map().cast("map<string,struct<locale:string,name:string>>")), lambda _, v: v["name"]), lambda _, v: F.length(v) > 0)
    missing = (F.length(name) > 0) & ~F.map_contains_key(kept, "en_US")
    return F.when(missing, F.map_concat(kept, F.create_map(F.lit("en_US"), name))).otherwise(kept)


def sub_types() -> Column:
    """Subtypes with a reference and a name; the English name fills the missing ones of the known locales."""

    def filled(found: Column) -> Column:
        english = F.try_element_at(found, F.lit("en_US"))
        rest = F.map_filter(F.create_map(*(x for code in SUBTYPE_LOCALES for x in (F.lit(code), english))), lambda k, _: ~F.map_contains_key(found, k))
        return F.when(english.isNotNull(), F.map_concat(found, rest)).otherwise(found)

    named = F.transform(F.filter(F.coalesce("cardSubTypes", F.array()), lambda s: F.length(s["reference"]) > 0), lambda s: F.struct(s["reference"].alias("reference"), filled(names(s["name"], s["translations"])).alias("name")))
    return F.filter(named, lambda s: F.size(F.map_keys(s["name"])) > 0)


def card_table(documents: DataFrame) -> DataFrame:
    """Stats, faction code (of the document, not of the path), slots and family metadata of each document."""
    own_set = F.struct(F.col("cardSet.reference").alias("reference"), F.col("cardSet.name").alias("name"), set_code(F.col("cardSet.reference")).alias("code"))
    return with_slots(documents).select(
        "source_set", "faction", "family_number", "unique_id", faction_code(F.col("mainFaction.reference")).alias("faction_code"), *(stat_value(kind).alias(c) for c, kind in STAT_ELEMENTS.items()),
        *GROUPS, names(F.col("name"), F.col("translations")).alias("name_map"), F.coalesce(F.col("illustrator.nickName"), F.lit("")).alias("artist"), sub_types().alias("card_sub_types"), own_set.alias("card_set"),
    )


def occurrence_table(documents: DataFrame) -> DataFrame:
    """(keys, line, id_gd, element_type, translations, at): every ability of every display. line: m1 to m3 for the first three
    displays of a main effect, ec for an echo effect, null elsewhere; at: its place in the document. keys: the card_index, where
    the documents have it."""
    keys = ["card_index"] if "card_index" in documents.columns else ["source_set", "faction", "family_number", "unique_id"]
    elements = documents.select(*keys, F.posexplode("cardElements").alias("i", "e"))
    displays = elements.select(*keys, "i", F.col("e.cardElementType.reference").alias("kind"), F.posexplode("e.cardEffectDisplays").alias("j", "d"))
    abilities = displays.select(*keys, "i", "j", "kind", F.posexplode("d.cardEffect.cardEffectElements").alias("k", "a"))
    line = F.when((F.col("kind") == "MAIN_EFFECT") & (F.col("j") < 3), F.concat(F.lit("m"), F.col("j") + 1)).when(F.col("kind") == "ECHO_EFFECT", "ec")
    given = F.when(F.size(F.map_keys(F.coalesce("a.translations", F.create_map().cast("map<string,struct<locale:string,text:string>>")))) > 0, F.transform_values("a.translations", lambda _, v: v["text"]))
    text = F.coalesce(given, F.when(F.length("a.text") > 0, F.create_map(F.lit("en_US"), F.col("a.text"))), F.create_map().cast("map<string,string>"))
    out = abilities.select(*keys, line.alias("line"), F.assert_true(F.col("a.idGd").isNotNull(), F.lit("an ability without idGd")).alias("_ok"), F.col("a.idGd").alias("id_gd"), F.coalesce("a.type", F.lit("UNKNOWN")).alias("element_type"), text.alias("translations"), F.struct("i", "j", "k").alias("at"))
    return out.where("_ok is null").drop("_ok")


def _line_bit() -> Column:
    out = F.lit(0)
    for i, g in enumerate(GROUPS):
        out = F.when(F.col("line") == g, 1 << i).otherwise(out)
    return out


def _posted(mask: str) -> list[Column]:
    """Counts and flags over one row a card, whose ``mask`` has a bit for each line."""
    each = [F.sum(F.shiftright(mask, i).bitwiseAND(1)).cast("long").alias(f"{g}_cards") for i, g in enumerate(GROUPS)]
    has = lambda bits, name: (F.bit_or(mask).bitwiseAND(bits) > 0).alias(name)
    return [has(7, "is_main"), has(8, "is_echo"), F.count(F.lit(1)).alias("card_count"), *each]


def posting_counts(occurrences: DataFrame) -> DataFrame:
    """Per id: on which kinds of line it stands, and how many cards have it, in all and by line. A card's lines are first
    joined to one mask, so that no row is repeated for each of the counts; tables of :func:`masked` have it."""
    masks = occurrences if "mask" in occurrences.columns else occurrences.groupBy("id_gd", "card_index").agg(F.bit_or(_line_bit()).alias("mask"))
    return masks.groupBy("id_gd").agg(*_posted("mask"))


def masked(occurrences: DataFrame, aliases: DataFrame, keep: Callable[[DataFrame], DataFrame] = stored) -> DataFrame:
    """Occurrences with canonical ids, those that become equal once: a row (id_gd, card_index, mask) for each id of a card, with
    a bit for each line, the last for no line. Stored, where postings and counts both start from it."""
    bit = F.when(F.col("line").isNull(), 1 << len(GROUPS)).otherwise(_line_bit())
    joined = occurrences.select("card_index", "id_gd", bit.alias("mask")).join(aliases.select("alias", "canonical"), F.col("id_gd") == F.col("alias"), "left")
    named = joined.select(F.coalesce("canonical", "id_gd").alias("id_gd"), "card_index", "mask")
    return keep(named.groupBy("id_gd", "card_index").agg(F.bit_or("mask").alias("mask")))


def unmasked(masks: DataFrame) -> DataFrame:
    """(card_index, line, id_gd) of a table of :func:`masked`."""
    each = masks.select("card_index", "id_gd", "mask", F.explode(F.array(*map(F.lit, range(len(GROUPS) + 1)))).alias("i"))
    line = F.lit(None).cast("string")
    for i, g in enumerate(GROUPS):
        line = F.when(F.col("i") == i, g).otherwise(line)
    return each.where(F.expr("shiftright(mask, i) & 1 = 1")).select("card_index", line.alias("line"), "id_gd")


def first_seen(occurrences: DataFrame, keep: Callable[[DataFrame], DataFrame] = stored) -> DataFrame:
    """(id_gd, element_type, translations) of where an id is first seen (by card_index, then place). The first card of each id
    is found by numbers alone; only occurrences on first cards are dealt out with their texts."""
    first = keep(occurrences.groupBy("id_gd").agg(F.min("card_index").alias("card_index")))
    own = thinned(occurrences.select("id_gd", "card_index", "element_type", "translations", "at"), first, "id_gd", "card_index")
    said = own.join(first, ["id_gd", "card_index"], "left_semi").groupBy("id_gd").agg(F.min_by(F.struct("element_type", "translations"), "at").alias("said"))
    return keep(said.select("id_gd", "said.*"))


def lazy(df: DataFrame) -> DataFrame:
    """For ``keep``: a table that is computed where it is used."""
    return df


def ability_table(occurrences: DataFrame) -> DataFrame:
    """:func:`posting_counts` with the type and the texts of where an id is first seen (by card_index, then place)."""
    per = occurrences.groupBy("id_gd", "card_index").agg(F.bit_or(_line_bit()).alias("mask"), F.min_by(F.struct("element_type", "translations"), "at").alias("first"))
    found = per.groupBy("id_gd").agg(F.min_by("first", "card_index").alias("first"), *_posted("mask"))
    return found.select("id_gd", "first.element_type", "first.translations", *found.columns[2:])


def aliases_of(abilities: DataFrame) -> DataFrame:
    """(alias, canonical): abilities of one type with the same text but for white space. The least id whose text has a
    no-break space stands for them, or else the least id; blank texts stand alone."""
    text = in_locale(F.col("translations"), "en_US")
    flat = abilities.select("id_gd", "element_type", one_space(text).alias("text"), has_no_break_space(text).alias("nbsp")).where(F.trim("text") != "")
    own = F.coalesce(F.min(F.when(F.col("nbsp"), F.col("id_gd"))), F.min("id_gd")).alias("canonical")
    groups = flat.groupBy("element_type", "text").agg(own, F.count(F.lit(1)).alias("n")).where("n > 1")
    return flat.join(groups, ["element_type", "text"]).where("id_gd <> canonical").select(F.col("id_gd").alias("alias"), "canonical")


def duplicates_of(aliases: DataFrame) -> DataFrame:
    """canonical -> its aliases, sorted."""
    return aliases.groupBy("canonical").agg(F.array_sort(F.collect_set("alias")).alias("duplicated_id_gd"))


def collapsed(occurrences: DataFrame, aliases: DataFrame) -> DataFrame:
    """Occurrences with canonical ids; those that become equal are one."""
    joined = occurrences.join(aliases, F.col("id_gd") == F.col("alias"), "left")
    return joined.withColumn("id_gd", F.coalesce("canonical", "id_gd")).select("card_index", "line", "id_gd").distinct()


def remapped_slots(cards: DataFrame, aliases: DataFrame) -> DataFrame:
    """Slot ids replaced by canonical ids. Slots hold ids below ``SLOT_IDS``, so only so many aliases can meet one: these are
    sent to every task, once for all slots, and no card moves."""
    few = aliases.where(F.col("alias").between(1 - SLOT_IDS, SLOT_IDS - 1) & (F.col("alias") != 0)).select("alias", F.col("canonical").cast("int").alias("canonical"))
    joined = cards
    for g in GROUPS:
        for t in "tco":
            joined = joined.join(F.broadcast(few.select(F.col("alias").alias("_id"), F.col("canonical").alias(f"_{g}{t}"))), F.col(f"{g}.{t}") == F.col("_id"), "left").drop("_id")
    new = {g: F.struct(*(F.coalesce(F.col(f"_{g}{t}"), F.col(f"{g}.{t}")).alias(t) for t in "tco")) for g in GROUPS}
    return joined.withColumns(new).drop(*(f"_{g}{t}" for g in GROUPS for t in "tco"))


def build(documents: DataFrame, collapse: bool = True) -> dict[str, DataFrame]:
    """cards, families, occurrences, abilities and aliases of the documents of one set."""
    cards = card_table(documents)
    families = settled(families_of(cards))
    # An index is known from the family's span, so that no document moves to find its card.
    spans = spans_of(families)
    located = documents.join(spans, ["source_set", "faction", "family_number"]).withColumn("card_index", F.col("start_bit") + F.col("unique_id") - 1).drop("start_bit", "family_id")
    check_unique(located)
    cards = indexed(cards, families).drop("name_map", "artist", "card_sub_types", "card_set")
    placed = occurrence_table(located)
    if collapse:
        abilities = first_seen(placed)
        aliases = stored(aliases_of(abilities))
        masks = masked(placed, aliases)
        abilities = abilities.join(posting_counts(masks), "id_gd")
        cards, occurrences = remapped_slots(cards, aliases), unmasked(masks)
    else:
        abilities = first_seen(placed, lazy).join(posting_counts(placed), "id_gd")
        aliases = abilities.select(F.col("id_gd").alias("alias"), F.col("id_gd").alias("canonical")).where("false")
        occurrences = placed.select("card_index", "line", "id_gd").distinct()
    abilities = abilities.join(duplicates_of(aliases), F.col("id_gd") == F.col("canonical"), "left").drop("canonical")
    return {"cards": cards, "families": families.withColumnRenamed("name_map", "name"), "occurrences": occurrences, "abilities": abilities, "aliases": aliases}


def manifest(tables: dict[str, DataFrame], source_set: str | None = None, limit: int | None = None) -> DataFrame:
    """One row: set (by default, those of the families, joined by +), counts, span and the time of the build."""
    own = F.lit(source_set) if source_set else F.array_join(F.array_sort(F.collect_set("source_set")), "+")
    families = tables["families"].agg(own.alias("set"), F.count(F.lit(1)).alias("family_count"), F.coalesce(F.sum("card_count"), F.lit(0)).alias("card_count"), F.coalesce(F.sum("max_unique_id"), F.lit(0)).alias("span"))
    return families.select(F.lit(1).alias("version"), "set", "family_count", "card_count", "span", F.unix_timestamp().alias("built_at"), F.lit(limit).cast("long").alias("limit"))
