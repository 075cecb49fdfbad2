"""What a query returns: pages, counts, facets and rendered cards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetry.functions.references import faction_letters, faction_name
from facetry.functions.text import in_locale
from facetry.operators.ingest import GROUPS
from facetry.operators.matching import LINES, MAIN, SUPPORT, masks, on_line
from facetry.plans.request import BUCKETS, Slot

PARTS = ("t", "c", "o")


def page(cards: DataFrame, cursor: int | None, limit: int) -> DataFrame:
    """The next cards after ``cursor`` in index order."""
    after = cards if cursor is None else cards.where(F.col("card_index") > cursor)
    return after.orderBy("card_index").limit(limit)


def next_cursor(page_indices: list[int], limit: int) -> int | None:
    """The last index of a full page; a page that isn't full is the last."""
    return page_indices[-1] if len(page_indices) == limit else None


def span_groups(families: DataFrame) -> DataFrame:
    """Adjacent families of one id whose spans touch, as one group: family_id, range_start, range_end. The window is over
    families, a small table."""
    order = Window.orderBy("start_bit")
    end = F.col("start_bit") + F.col("max_unique_id")
    new = (F.lag("family_id").over(order) != F.col("family_id")) | (F.lag(end).over(order) != F.col("start_bit"))
    marked = families.select("family_id", "start_bit", end.alias("end_bit"), F.coalesce(new, F.lit(True)).cast("int").alias("new"))
    island = marked.withColumn("group", F.sum("new").over(order))
    return island.groupBy("group", "family_id").agg(F.min("start_bit").alias("range_start"), F.max("end_bit").alias("range_end")).drop("group")


def family_facet(cards: DataFrame, families: DataFrame) -> DataFrame:
    """Per span group with matches: family_id, range_start, matches and first_card. ``cards`` has family_id."""
    groups = span_groups(families)
    inside = (F.col("card_index") >= F.col("range_start")) & (F.col("card_index") < F.col("range_end"))
    return cards.select("card_index", "family_id").join(groups, "family_id").where(inside).groupBy("family_id", "range_start").agg(F.count(F.lit(1)).alias("matches"), F.min("card_index").alias("first_card"))


def reachable(base: DataFrame, occurrences: DataFrame, abilities: DataFrame, picks: DataFrame, slot: Slot | tuple[bool, ...], bucket: str, support: bool = False) -> DataFrame:
    """Ids of the bucket's type that stand, on some line of some base card, with the slot's other ids. ``base`` is filtered by
    everything but the slot; the slot's own bucket and its match count don't count."""
    has = slot if isinstance(slot, tuple) else tuple(bool(x) for x in slot.buckets)
    needed = [n and b != bucket for n, b in zip(has, BUCKETS)]
    lines = SUPPORT if support else MAIN
    kind = abilities.where(F.col("element_type") == BUCKETS[bucket]).select("id_gd")
    own = occurrences.where(F.col("line").isin(*lines)).join(base.select("card_index"), "card_index", "left_semi")
    if any(needed):
        fit = masks(own, picks, 1).select("card_index", F.explode(F.filter(F.array(*(F.when(on_line(0, needed, line), F.lit(line)) for line in lines)), lambda x: x.isNotNull())).alias("line"))
        own = own.join(fit, ["card_index", "line"], "left_semi")
    return own.select("id_gd").join(kind, "id_gd", "left_semi").distinct()


def texts_of(cards: DataFrame, abilities: DataFrame, locale: str | None = None) -> DataFrame:
    """(card_index, line, locale, text): each line's ability texts, trigger, condition, output, joined by a space; blank ones
    are left out. Without ``locale``, in en_US and every locale that an ability of the card has."""
    slots = F.array(*(F.struct(F.lit(g).alias("line"), F.lit(i).alias("at"), F.col(f"{g}.{p}").alias("id")) for g in GROUPS for i, p in enumerate(PARTS)))
    long = cards.select("card_index", F.explode(slots).alias("s")).select("card_index", "s.*").where("id <> 0")
    known = long.join(abilities.select(F.col("id_gd").alias("id"), "translations"), "id")
    if locale:
        spoken = known.withColumn("locale", F.lit(locale))
    else:
        spoken = known.join(known.groupBy("card_index").agg(F.array_distinct(F.concat(F.array(F.lit("en_US")), F.flatten(F.collect_set(F.map_keys("translations"))))).alias("locales")), "card_index").withColumn("locale", F.explode("locales")).drop("locales")
    said = spoken.withColumn("text", in_locale(F.col("translations"), F.col("locale")) if locale is None else in_locale(F.col("translations"), locale)).where("text <> ''")
    parts = F.array_sort(F.collect_list(F.struct("at", "text")))
    return said.groupBy("card_index", "locale", "line").agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"))


def effects_of(cards: DataFrame, abilities: DataFrame) -> DataFrame:
    """(card_index, main_effect, echo_effect): texts by locale; main lines are joined by two spaces."""
    texts = texts_of(cards, abilities)
    lines = F.array_sort(F.collect_list(F.when(F.col("line") != "ec", F.struct("line", "text"))))
    per = texts.groupBy("card_index", "locale").agg(F.array_join(F.transform(lines, lambda x: x["text"]), "  ").alias("main"), F.max(F.when(F.col("line") == "ec", F.col("text"))).alias("echo"))
    by = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.length(c) > 0, F.struct("locale", c)))))
    return per.groupBy("card_index").agg(by("main").alias("main_effect"), by("echo").alias("echo_effect"))


def triplets() -> Column:
    """``t/c/o`` of each group that holds an id, main groups first, joined by semicolons."""
    each = [F.when(reduce(lambda a, b: a | b, (F.col(f"{g}.{p}") != 0 for p in PARTS)), F.concat_ws("/", *(F.col(f"{g}.{p}") for p in PARTS))) for g in GROUPS]
    return F.concat_ws(";", *each)


def table_row() -> list[Column]:
    """The columns of a printed row: main groups as t_c_o joined by commas, and the echo group."""
    shown = lambda g: F.when(reduce(lambda a, b: a | b, (F.col(f"{g}.{p}") != 0 for p in PARTS)), F.concat_ws("_", *(F.col(f"{g}.{p}") for p in PARTS)))
    return [F.col("reference"), F.concat_ws(", ", *map(shown, GROUPS[:3])).alias("main"), F.coalesce(shown("ec"), F.lit("")).alias("echo")]


def card_objects(cards: DataFrame, families: DataFrame, abilities: DataFrame, debug: bool = False) -> DataFrame:
    """Rendered cards. A gap in a family shows faction UN, zeros and no texts."""
    meta = families.select("source_set", "family_id", *(c for c in ("name", "artist", "card_set", "card_sub_types") if c in families.columns))
    out = cards.join(meta, ["source_set", "family_id"], "left").join(effects_of(cards, abilities), "card_index", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    code = F.coalesce(F.col("faction_code"), F.lit(0))
    none = F.create_map().cast("map<string,string>")
    shown = ["card_index", "reference", *(c for c in meta.columns if c not in ("source_set", "family_id")), *map(zero, ("main_cost", "recall_cost", "forest_power", "mountain_power", "ocean_power"))]
    extra = [triplets().alias("debug_bga_trigram")] if debug else []
    return out.select(*shown, F.struct(faction_letters(code).alias("code"), faction_name(code).alias("name")).alias("faction"), F.coalesce("main_effect", none).alias("main_effect"), F.coalesce("echo_effect", none).alias("echo_effect"), *extra)


def flat_view(objects: DataFrame, locale: str) -> DataFrame:
    """Rendered cards in one locale; an empty echo effect is null; rarity from the reference."""
    echo = in_locale(F.col("echo_effect"), locale)
    return objects.withColumns({"main_effect": in_locale(F.col("main_effect"), locale), "echo_effect": F.when(echo != "", echo), "rarity": F.when(F.contains("reference", F.lit("_U_")), "UNIQUE")})


def effects_list(abilities: DataFrame) -> DataFrame:
    """Triggers, conditions and outputs in the order of their ids."""
    return abilities.where(F.col("element_type").isin(*BUCKETS.values())).orderBy("id_gd")


def suggestions(abilities: DataFrame, token: str, locale: str = "en_US", most: int = 40, main: bool | None = None) -> DataFrame:
    """The first abilities whose id or text holds the token, for a main or a support slot."""
    text = in_locale(F.col("translations"), locale)
    out = abilities.where(F.contains(F.col("id_gd").cast("string"), F.lit(token)) | F.contains(F.lower(text), F.lit(token.lower())))
    if main is not None:
        out = out.where("is_main" if main else "is_echo")
    return out.orderBy("id_gd").limit(most)


def selected(ids: DataFrame, abilities: DataFrame, locale: str = "en_US") -> DataFrame:
    """(id_gd) -> (id_gd, label, unknown); ids without an ability stay."""
    known = abilities.select("id_gd", in_locale(F.col("translations"), locale).alias("label"), F.lit(True).alias("_known"))
    return ids.join(known, "id_gd", "left").select("id_gd", F.coalesce("label", F.lit("")).alias("label"), F.col("_known").isNull().alias("unknown"))


def match_counts(cards: DataFrame, facet: DataFrame) -> DataFrame:
    """(reference, matches) of the cards that stand for their families in a :func:`family_facet`."""
    return cards.select("card_index", "reference").join(facet.select(F.col("first_card").alias("card_index"), "matches"), "card_index").select("reference", "matches")


def recap(slot: Slot, abilities: DataFrame, locale: str = "en_US") -> DataFrame:
    """(bucket, at, id_gd, text): what a slot asks for, bucket by bucket in the order of the request; blank for unknown ids."""
    rows = [(b, at, i) for b, ids in zip(BUCKETS, slot.buckets) for at, i in enumerate(ids)]
    asked = abilities.sparkSession.createDataFrame(rows, "bucket string, at int, id_gd long")
    known = abilities.select("id_gd", in_locale(F.col("translations"), locale).alias("text"))
    return asked.join(known, "id_gd", "left").select("bucket", "at", "id_gd", F.coalesce("text", F.lit("")).alias("text"))


assert LINES == GROUPS
