"""The index model over a star schema: orders are cards, their lines hold abilities, which are parts.

Card indices of :func:`cards` are order keys, which have no gaps. :func:`numbered_cards` gives each family's cards the odd
unique numbers, so that every second slot of a span is a gap, and :func:`index` places the spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facetry.operators.ingest import STAT_ELEMENTS, aliases_of, indexed, placed
from facetry.sources.cards import FIELDS, SCHEMA
from facetry.sources.scratch import stored

SEGMENTS = {"AUTOMOBILE": "AX", "BUILDING": "BR", "FURNITURE": "LY", "HOUSEHOLD": "MU", "MACHINERY": "OR"}
SETS = {"F": "CORE", "O": "COREKS", "P": "ALIZE"}
TYPES = {"ECONOMY": "TRIGGER", "LARGE": "TRIGGER", "MEDIUM": "CONDITION", "PROMO": "CONDITION", "SMALL": "OUTPUT", "STANDARD": "OUTPUT"}
LINES = {1: "m1", 2: "m2", 3: "m3", 4: "ec"}


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _lookup(pairs: dict, key) -> Column:
    out = F.lit(None)
    for k, v in pairs.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def cards(spark: SparkSession, folder: str) -> DataFrame:
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    joined = read(spark, folder, "orders").join(read(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    faction, number = _lookup(SEGMENTS, F.col("c_mktsegment")), F.lpad(F.col("c_nationkey").cast("string"), 2, "0")
    code = F.when(key % 97 == 0, 0).when(key % 89 == 0, 6).otherwise(_lookup({s: i + 1 for i, s in enumerate(SEGMENTS)}, F.col("c_mktsegment")))
    return joined.select(
        key.alias("card_index"), _lookup(SETS, F.col("o_orderstatus")).alias("source_set"), faction.alias("faction"), number.alias("family_number"), F.concat_ws("_", faction, number).alias("family_id"), code.cast("int").alias("faction_code"),
        F.floor(F.col("o_totalprice") / 20000).cast("int").alias("main_cost"), F.floor(F.col("o_totalprice") / 60000).cast("int").alias("recall_cost"), (customer % 10).cast("int").alias("mountain_power"),
        (key % 7).cast("int").alias("ocean_power"), ((key + customer) % 18).cast("int").alias("forest_power"),
    )


def occurrences(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "lineitem").select(F.col("l_orderkey").alias("card_index"), _lookup(LINES, F.col("l_linenumber")).alias("line"), F.col("l_partkey").alias("id_gd"), F.struct("l_suppkey", "l_partkey").alias("at"))


def abilities(spark: SparkSession, folder: str) -> DataFrame:
    """(id_gd, element_type, text, translations); every seventh text has no-break spaces."""
    text = F.when(F.col("p_partkey") % 7 == 0, F.replace("p_name", F.lit(" "), F.lit(chr(160)))).otherwise(F.col("p_name"))
    part = read(spark, folder, "part").select(F.col("p_partkey").alias("id_gd"), _lookup(TYPES, F.col("p_type")).alias("element_type"), text.alias("text"))
    return part.withColumn("translations", F.create_map(F.lit("en_US"), "text"))


def aliases(spark: SparkSession, folder: str) -> DataFrame:
    return aliases_of(abilities(spark, folder))


def numbered_cards(spark: SparkSession, folder: str) -> DataFrame:
    """Cards with unique_id, odd numbers in the order of the old index, which stays as order_key.

    A family may hold any share of the orders: its rows are numbered within ranges of order keys, then shifted by the
    sizes of the ranges before, so no task gets a whole family."""
    keys = ["source_set", "faction", "family_number"]
    rows = cards(spark, folder).withColumnRenamed("card_index", "order_key").drop("family_id").withColumn("cell", F.shiftright("order_key", 16))
    before = Window.partitionBy(*keys).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    shift = rows.groupBy(*keys, "cell").agg(F.count(F.lit(1)).alias("n")).select(*keys, "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    own = F.row_number().over(Window.partitionBy(*keys, "cell").orderBy("order_key"))
    return rows.join(shift, [*keys, "cell"]).withColumn("unique_id", 2 * (F.col("shift") + own) - 1).drop("cell", "shift")


def index(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(cards with card_index and reference, families with a name map)."""
    numbered = numbered_cards(spark, folder)
    # The largest number of a family follows from its count, so the families need no numbering.
    counts = cards(spark, folder).groupBy("source_set", "faction", "family_number").agg(F.count(F.lit(1)).alias("card_count"))
    families = placed(counts.withColumn("max_unique_id", 2 * F.col("card_count") - 1))
    nation = read(spark, folder, "nation").select(F.lpad(F.col("n_nationkey").cast("string"), 2, "0").alias("family_number"), F.create_map(F.lit("en_US"), "n_name", F.lit("fr_FR"), F.concat(F.lit("Éc"), "n_name", F.lit("ôt"))).alias("name"))
    return indexed(numbered, families), families.join(nation, "family_number", "left")


def slot_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(card_index, line, t, c, o): the first id of each type on each line, 0 if none."""
    typed = occurrences(spark, folder).where("line is not null").join(abilities(spark, folder).select("id_gd", "element_type"), "id_gd").where("id_gd % 65536 <> 0")
    only = lambda kind: F.coalesce(F.min(F.when(F.col("element_type") == kind, F.struct("at", "id_gd")))["id_gd"] % 65536, F.lit(0)).cast("int")
    return typed.groupBy("card_index", "line").agg(only("TRIGGER").alias("t"), only("CONDITION").alias("c"), only("OUTPUT").alias("o"))


def cards_with_slots(spark: SparkSession, folder: str) -> DataFrame:
    """Cards that have slots, as columns m1, m2, m3, ec of structs (t, c, o). One aggregation brings a card's lines together."""
    per = slot_ids(spark, folder)
    pick = lambda g: F.max(F.when(F.col("line") == g, F.struct("t", "c", "o")))
    none = F.struct(*(F.lit(0).alias(p) for p in "tco"))
    return per.groupBy("card_index").agg(*(F.coalesce(pick(g), none).alias(g) for g in LINES.values()))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """The cards of :func:`numbered_cards` as card documents, through JSON text, with the parts of their paths as the reader of
    files gives them. The first three lines are displays of a main effect, the fourth an echo effect, any other a fourth
    display."""
    kind = "array<struct<at:struct<l_suppkey:bigint,l_partkey:bigint>,id_gd:bigint,element_type:string,text:string>>"
    given = lambda x: F.create_map(F.lit("en_US"), F.struct(F.lit("en_US").alias("locale"), x["text"].alias("text")))
    atom = lambda x: F.struct(x["id_gd"].alias("idGd"), x["element_type"].alias("type"), x["text"].alias("text"), given(x).alias("translations"))
    # Numbers and the text are dealt out, once; a card's lines meet in its own task.
    numbers = read(spark, folder, "lineitem").select(F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("n"), "l_suppkey", F.col("l_partkey").alias("id_gd"))
    lines = numbers.join(abilities(spark, folder).select("id_gd", "element_type", "text"), "id_gd").repartition("order_key")
    ability = F.struct(F.struct("l_suppkey", F.col("id_gd").alias("l_partkey")).alias("at"), "id_gd", "element_type", "text")
    on = lambda test: F.array_sort(F.collect_list(F.when(test, ability))).cast(kind)
    held = lines.groupBy("order_key").agg(*(on(F.col("n") == i).alias(g) for i, g in LINES.items()), on(F.col("n").isNull() | ~F.col("n").isin(*LINES)).alias("rest"))
    display = lambda c: F.struct(F.struct(F.transform(F.coalesce(c, F.array().cast(kind)), atom).alias("cardEffectElements")).alias("cardEffect"))

    def element(name: str, value: Column, displays: Column | None = None) -> Column:
        none = F.array(display(F.lit(None).cast(kind)))
        return F.struct(F.struct(F.lit(name).alias("reference")).alias("cardElementType"), value.cast("string").alias("value"), (F.slice(none, 1, 0) if displays is None else displays).alias("cardEffectDisplays"))

    elements = [element(kind_, F.col(c)) for c, kind_ in STAT_ELEMENTS.items()]
    elements += [element("MAIN_EFFECT", F.lit(None), F.array(*(display(F.col(c)) for c in ("m1", "m2", "m3", "rest")))), element("ECHO_EFFECT", F.lit(None), F.array(display(F.col("ec"))))]
    nation = read(spark, folder, "nation").select(F.lpad(F.col("n_nationkey").cast("string"), 2, "0").alias("family_number"), "n_name")
    word = lambda locale, name: (F.lit(locale), F.struct(F.lit(locale).alias("locale"), name.alias("name")))
    letters = _lookup({i + 1: s for i, s in enumerate([*SEGMENTS.values(), "YZ"])}, F.col("faction_code"))
    cards_ = stored(numbered_cards(spark, folder)).join(held, "order_key", "left").join(F.broadcast(nation), "family_number")
    body = F.struct(
        F.col("n_name").alias("name"), F.create_map(*word("fr_FR", F.concat(F.lit("Éc"), "n_name", F.lit("ôt")))).alias("translations"), F.struct(F.lit("someone").alias("nickName")).alias("illustrator"),
        F.struct(F.col("source_set").alias("reference"), F.col("source_set").alias("name")).alias("cardSet"), F.struct(F.coalesce(letters, F.lit("?")).alias("reference")).alias("mainFaction"), F.array(*elements).alias("cardElements"),
    )
    read_ = cards_.select("source_set", "faction", "family_number", "unique_id", F.from_json(F.to_json(body), SCHEMA, {"mode": "FAILFAST"}).alias("d"))
    return read_.select("source_set", "faction", "family_number", "unique_id", *(F.col(f"d.{c}").alias(c) for c in FIELDS))
