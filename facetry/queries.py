"""The registered queries over the driver's tables, each beside the same result in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facetry.functions import references, text
from facetry.engine import Engine
from facetry.operators import filters, ingest, matching, merging, packs, results, summaries
from facetry.plans import adapter
from facetry.plans.request import Request, Slot, Stat
from facetry.sources import store
from facetry.sources.cards import discovered
from facetry.sources.ranged import Ranged, start_rank, write_ranged
from facetry.sources.scratch import scratch, tidy, unsorted
from facetry.streaming.arrivals import ticks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Tables of the model, for every oracle.
PRELUDE = """WITH cards AS (SELECT o_orderkey AS card_index, CASE o_orderstatus WHEN 'F' THEN 'CORE' WHEN 'O' THEN 'COREKS' WHEN 'P' THEN 'ALIZE' END AS source_set, s.faction,
  lpad(c_nationkey::VARCHAR, 2, '0') AS family_number, s.faction || '_' || lpad(c_nationkey::VARCHAR, 2, '0') AS family_id,
  CASE WHEN o_orderkey % 97 = 0 THEN 0 WHEN o_orderkey % 89 = 0 THEN 6 ELSE s.code END::INT AS faction_code, floor(o_totalprice / 20000)::INT AS main_cost, floor(o_totalprice / 60000)::INT AS recall_cost,
  (o_custkey % 10)::INT AS mountain_power, (o_orderkey % 7)::INT AS ocean_power, ((o_orderkey + o_custkey) % 18)::INT AS forest_power
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN (VALUES ('AUTOMOBILE', 'AX', 1), ('BUILDING', 'BR', 2), ('FURNITURE', 'LY', 3), ('HOUSEHOLD', 'MU', 4), ('MACHINERY', 'OR', 5)) s(segment, faction, code) ON c_mktsegment = segment),
occ AS (SELECT l_orderkey AS card_index, CASE l_linenumber WHEN 1 THEN 'm1' WHEN 2 THEN 'm2' WHEN 3 THEN 'm3' WHEN 4 THEN 'ec' END AS line, l_partkey AS id_gd, l_suppkey, l_partkey FROM lineitem),
ability AS (SELECT p_partkey AS id_gd, CASE WHEN p_type IN ('ECONOMY', 'LARGE') THEN 'TRIGGER' WHEN p_type IN ('MEDIUM', 'PROMO') THEN 'CONDITION' WHEN p_type IN ('SMALL', 'STANDARD') THEN 'OUTPUT' END AS element_type,
  CASE WHEN p_partkey % 7 = 0 THEN replace(p_name, ' ', chr(160)) ELSE p_name END AS text FROM part),
flat AS (SELECT id_gd, element_type, replace(text, chr(160), ' ') AS norm, contains(text, chr(160)) AS nbsp FROM ability WHERE trim(text) <> ''),
alias AS (SELECT id_gd AS alias, canonical FROM flat JOIN (SELECT element_type, norm, coalesce(min(id_gd) FILTER (nbsp), min(id_gd)) AS canonical FROM flat GROUP BY ALL HAVING count(*) > 1) USING (element_type, norm) WHERE id_gd <> canonical),
cocc AS (SELECT DISTINCT card_index, line, coalesce(canonical, id_gd) AS id_gd FROM occ LEFT JOIN alias ON id_gd = alias),
tocc AS (SELECT card_index, line, occ.id_gd, element_type, text, l_suppkey FROM occ JOIN ability USING (id_gd)),
numbered AS (SELECT * EXCLUDE card_index, card_index AS order_key, 2 * row_number() OVER (PARTITION BY source_set, faction, family_number ORDER BY card_index) - 1 AS unique_id FROM cards),
fam0 AS (SELECT source_set, faction, family_number, family_id, max(unique_id) AS max_unique_id, count(*) AS card_count FROM numbered GROUP BY ALL),
fam AS (SELECT *, coalesce(sum(max_unique_id) OVER (ORDER BY source_set, faction, family_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_bit FROM fam0),
idx AS (SELECT n.*, start_bit + unique_id - 1 AS card_index, 'ALT_' || n.source_set || '_B_' || n.faction || '_' || n.family_number || '_U_' || unique_id AS reference FROM numbered n JOIN fam USING (source_set, faction, family_number)),
slot AS (SELECT card_index, line, coalesce((min((l_suppkey, id_gd)) FILTER (element_type = 'TRIGGER'))[2] % 65536, 0)::INT AS t, coalesce((min((l_suppkey, id_gd)) FILTER (element_type = 'CONDITION'))[2] % 65536, 0)::INT AS c,
  coalesce((min((l_suppkey, id_gd)) FILTER (element_type = 'OUTPUT'))[2] % 65536, 0)::INT AS o FROM tocc WHERE line IS NOT NULL AND id_gd % 65536 <> 0 GROUP BY ALL)
"""


def query(sql: str, prelude: bool = True) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = (PRELUDE if prelude else "") + sql
        return f

    return put


# Filters on columns.


@query("SELECT card_index, main_cost FROM cards WHERE main_cost = 7")
def stat_exact(spark, d):
    return adapter.cards(spark, d).where(filters.stat("main_cost", Stat("in", (7,)))).select("card_index", "main_cost")


@query("SELECT card_index, forest_power FROM cards WHERE forest_power IN (0, 3, 15)")
def stat_anyof(spark, d):
    return adapter.cards(spark, d).where(filters.stat("forest_power", Stat("in", (0, 3, 15)))).select("card_index", "forest_power")


@query("SELECT card_index, main_cost FROM cards WHERE main_cost >= 3 AND main_cost <= 15")
def stat_range(spark, d):
    return adapter.cards(spark, d).where(filters.stat("main_cost", Stat("gte", (3,)))).select("card_index", "main_cost")


@query("SELECT card_index, faction_code FROM cards WHERE faction_code IN (1, 6)")
def faction_filter(spark, d):
    return adapter.cards(spark, d).where(filters.factions(["AX", "YZ"])).select("card_index", "faction_code")


@query("SELECT card_index, source_set FROM cards WHERE source_set IN ('CORE', 'ALIZE')")
def set_filter(spark, d):
    return adapter.cards(spark, d).where(F.col("source_set").isin("CORE", "ALIZE")).select("card_index", "source_set")


@query("SELECT source_set, family_id, card_count FROM fam JOIN nation ON family_number = lpad(n_nationkey::VARCHAR, 2, '0') WHERE contains(lower(strip_accents('Éc' || n_name || 'ôt')), '3ot') OR contains(lower(strip_accents(n_name)), '3ot')")
def name_contains(spark, d):
    return filters.named(adapter.index(spark, d)[1], " 3ÔT ").select("source_set", "family_id", "card_count")


@query("SELECT idx.card_index, order_key FROM idx JOIN (VALUES ('ALT_CORE_B_AX_03_U_1'), ('ALT_COREKS_B_OR_11_U_3'), ('ALT_CORE_B_MU_07_U_5')) v(reference) USING (reference)")
def ref_filter_lenient(spark, d):
    cards, families = adapter.index(spark, d)
    refs = ["ALT_CORE_B_AX_03_U_1", "ALT_COREKS_B_OR_11_U_3", "ALT_CORE_B_MU_07_U_5", "ALT_NONE_B_MU_07_U_5", "nothing", "ALT_CORE_B_AX_03_U_0"]
    wanted = filters.indices_of(spark.createDataFrame([(r,) for r in refs], "reference string"), families)
    return filters.include(cards, wanted.where("card_index is not null")).select("card_index", "order_key")


# Abilities together on a line.


def _picks(spark, d, *wanted: tuple[int, int, str]) -> DataFrame:
    """(id_gd, slot, bucket) of the abilities that meet each condition."""
    abilities = adapter.abilities(spark, d)
    parts = [abilities.where(test).select("id_gd", F.lit(slot).alias("slot"), F.lit(bucket).alias("bucket")) for slot, bucket, test in wanted]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


T, C, O = "element_type = 'TRIGGER'", "element_type = 'CONDITION'", "element_type = 'OUTPUT'"
LOW, LOW_O = T + " AND text < 'n'", O + " AND text < 'n'"
_K_LINES = "SELECT card_index FROM (SELECT card_index, line FROM tocc WHERE line IN ('m1', 'm2', 'm3') GROUP BY ALL HAVING bool_or({test})) GROUP BY card_index HAVING count(*) >= {k}"


def _k_lines(spark, d, k: int) -> DataFrame:
    return matching.line_match(adapter.occurrences(spark, d), _picks(spark, d, (0, 0, LOW)), [((True, False, False), matching.MAIN, k)])


@query(_K_LINES.format(test=LOW, k=1))
def line_match_any(spark, d):
    return _k_lines(spark, d, 1)


@query(_K_LINES.format(test=LOW, k=2))
def line_match_two(spark, d):
    return _k_lines(spark, d, 2)


@query(_K_LINES.format(test=LOW, k=3))
def line_match_three(spark, d):
    return _k_lines(spark, d, 3)


@query(f"SELECT DISTINCT card_index FROM (SELECT card_index, line FROM tocc WHERE line IN ('m1', 'm2', 'm3') GROUP BY ALL HAVING bool_or({T}) AND bool_or({O}))")
def line_match_same_line(spark, d):
    return matching.line_match(adapter.occurrences(spark, d), _picks(spark, d, (0, 0, T), (0, 2, O)), [((True, False, True), matching.MAIN, 1)])


_TWO = f"""SELECT card_index FROM (SELECT card_index, bool_or(a) AS a, bool_or(b) AS b FROM (SELECT card_index, line, bool_or({LOW}) AND bool_or({C}) AS a, bool_or({LOW_O}) AS b FROM tocc WHERE line IN ('m1', 'm2', 'm3') GROUP BY ALL) GROUP BY ALL) WHERE a {{}} b"""


def _two_slots(spark, d, mode: str) -> DataFrame:
    picks = _picks(spark, d, (0, 0, LOW), (0, 1, C), (1, 2, LOW_O))
    return matching.line_match(adapter.occurrences(spark, d), picks, [((True, True, False), matching.MAIN, 1), ((False, False, True), matching.MAIN, 1)], mode)


@query(_TWO.format("AND"))
def effect_mode_and(spark, d):
    return _two_slots(spark, d, "and")


@query(_TWO.format("OR"))
def effect_mode_or(spark, d):
    return _two_slots(spark, d, "or")


@query(f"SELECT card_index FROM tocc WHERE line = 'ec' GROUP BY card_index HAVING bool_or({T}) AND bool_or({O})")
def support_line(spark, d):
    return matching.line_match(adapter.occurrences(spark, d), _picks(spark, d, (0, 0, T), (0, 2, O)), [((True, False, True), matching.SUPPORT, 1)])


@query(f"SELECT DISTINCT card_index FROM (SELECT card_index, line FROM tocc WHERE line IS NOT NULL GROUP BY ALL HAVING bool_or({T}) AND bool_or({C}) AND bool_or({O}))")
def per_line(spark, d):
    return matching.line_match(adapter.occurrences(spark, d), _picks(spark, d, (0, 0, T), (0, 1, C), (0, 2, O)), [((True, True, True), matching.LINES, 1)])


@query(f"SELECT card_index FROM tocc GROUP BY card_index HAVING bool_or({LOW}) AND bool_or({C}) AND bool_or({LOW_O})")
def whole_card(spark, d):
    return matching.whole_card(adapter.occurrences(spark, d), _picks(spark, d, (0, 0, LOW), (0, 1, C), (0, 2, LOW_O)), (True, True, True))


# Lists, formats, conjunction.


def _urgent(spark, d) -> DataFrame:
    return adapter.read(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("card_index"))


_LIST = "SELECT card_index, main_cost FROM cards WHERE card_index {} (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')"


@query(_LIST.format("IN"))
def format_include(spark, d):
    return filters.include(adapter.cards(spark, d), _urgent(spark, d)).select("card_index", "main_cost")


@query(_LIST.format("NOT IN") + " AND source_set <> 'ALIZE'")
def format_exclude(spark, d):
    sets = adapter.cards(spark, d).where("source_set = 'ALIZE'").select("card_index")
    return filters.exclude(adapter.cards(spark, d), _urgent(spark, d).union(sets)).select("card_index", "main_cost")


@query(_LIST.format("IN") + " AND faction_code = 2")
def collection_filter(spark, d):
    return filters.include(adapter.cards(spark, d).where(filters.factions(["BR"])), _urgent(spark, d)).select("card_index", "main_cost")


@query(_LIST.format("NOT IN"))
def extra_filter_negated(spark, d):
    return filters.exclude(adapter.cards(spark, d), _urgent(spark, d)).select("card_index", "main_cost")


def _flagship(spark, d) -> DataFrame:
    cards = adapter.cards(spark, d).where(filters.factions(["AX", "MU"])).where(filters.stat("main_cost", Stat("lte", (7,))))
    return filters.include(cards, line_match_same_line(spark, d)).select("card_index", "source_set", "family_id", "main_cost")


_FLAGSHIP = f"""SELECT card_index, source_set, family_id, main_cost FROM cards WHERE faction_code IN (1, 4) AND main_cost <= 7 AND card_index IN
  (SELECT card_index FROM (SELECT card_index, line FROM tocc WHERE line IN ('m1', 'm2', 'm3') GROUP BY ALL HAVING bool_or({T}) AND bool_or({O})))"""


@query(_FLAGSHIP)
def conjunction_all(spark, d):
    return _flagship(spark, d)


@query("SELECT source_set, family_id, unnest(range(start_bit, start_bit + max_unique_id)) AS card_index FROM fam")
def universe_with_padding(spark, d):
    return filters.universe(adapter.index(spark, d)[1]).select("source_set", "family_id", "card_index")


# Pages and facets.


@query(_FLAGSHIP + " ORDER BY card_index LIMIT 50")
def page_first(spark, d):
    return results.page(_flagship(spark, d), None, 50)


@query("SELECT card_index, main_cost FROM cards WHERE main_cost <= 7 AND card_index > 400 ORDER BY card_index LIMIT 50")
def page_cursor(spark, d):
    return results.page(adapter.cards(spark, d).where(filters.stat("main_cost", Stat("lte", (7,)))), 400, 50).select("card_index", "main_cost")


@query("SELECT card_index FROM cards WHERE main_cost <= 7 ORDER BY card_index OFFSET 1000 LIMIT 50")
def rank_window(spark, d):
    return adapter.cards(spark, d).where("main_cost <= 7").select("card_index").orderBy("card_index").offset(1000).limit(50)


@query("SELECT count(*) AS total FROM cards WHERE faction_code IN (1, 4) AND main_cost <= 7")
def result_total(spark, d):
    return adapter.cards(spark, d).where(filters.factions(["AX", "MU"]) & filters.stat("main_cost", Stat("lte", (7,)))).agg(F.count(F.lit(1)).alias("total"))


_GROUPS = """, isl AS (SELECT *, sum(CASE WHEN family_id = lag_id AND start_bit = lag_end THEN 0 ELSE 1 END) OVER (ORDER BY start_bit) AS g FROM (SELECT *, start_bit + max_unique_id AS end_bit, lag(family_id) OVER (ORDER BY start_bit) AS lag_id, lag(start_bit + max_unique_id) OVER (ORDER BY start_bit) AS lag_end FROM fam)),
grp AS (SELECT family_id, min(start_bit) AS range_start, max(end_bit) AS range_end FROM isl GROUP BY g, family_id)
"""


@query(_GROUPS + "SELECT family_id, range_start, range_end FROM grp")
def span_groups(spark, d):
    return results.span_groups(adapter.index(spark, d)[1]).select("family_id", "range_start", "range_end")


@query(_GROUPS + "SELECT grp.family_id, range_start, count(*) AS matches, min(card_index) AS first_card FROM idx JOIN grp ON card_index >= range_start AND card_index < range_end WHERE main_cost <= 7 GROUP BY ALL")
def families_facet(spark, d):
    cards, families = adapter.index(spark, d)
    return results.family_facet(cards.where("main_cost <= 7"), families)


_REACH = """SELECT DISTINCT id_gd FROM tocc JOIN (SELECT card_index, line FROM tocc WHERE line IN ({lines}) GROUP BY ALL HAVING bool_or({test})) USING (card_index, line)
  WHERE element_type = '{kind}' AND card_index IN (SELECT card_index FROM cards WHERE main_cost <= 7 AND faction_code = 3)"""


def _reach(spark, d, bucket: str, support: bool, *wanted) -> DataFrame:
    base = adapter.cards(spark, d).where(filters.factions(["LY"]) & filters.stat("main_cost", Stat("lte", (7,))))
    has = tuple(any(b == i for _, b, _ in wanted) for i in range(3))
    return results.reachable(base, adapter.occurrences(spark, d), adapter.abilities(spark, d), _picks(spark, d, *wanted), has, bucket, support)


@query(_REACH.format(lines="'m1', 'm2', 'm3'", test=LOW, kind="OUTPUT"))
def reachable_abilities(spark, d):
    return _reach(spark, d, "o", False, (0, 0, LOW))


@query(_REACH.format(lines="'ec'", test=T, kind="CONDITION"))
def reachable_support(spark, d):
    return _reach(spark, d, "c", True, (0, 0, T))


# Abilities.

_COUNTS = "count(DISTINCT card_index) AS card_count, " + ", ".join(f"count(DISTINCT card_index) FILTER (line = '{g}') AS {g}_cards" for g in ("m1", "m2", "m3", "ec"))


def _ability_table(spark, d) -> DataFrame:
    joined = adapter.occurrences(spark, d).join(adapter.abilities(spark, d), "id_gd")
    return ingest.ability_table(joined)


@query(f"SELECT id_gd, {_COUNTS} FROM tocc GROUP BY id_gd")
def ability_catalog_counts(spark, d):
    return _ability_table(spark, d).select("id_gd", "card_count", "m1_cards", "m2_cards", "m3_cards", "ec_cards")


@query("SELECT id_gd, coalesce(bool_or(line IN ('m1', 'm2', 'm3')), false) AS is_main, coalesce(bool_or(line = 'ec'), false) AS is_echo FROM tocc GROUP BY id_gd")
def region_flags(spark, d):
    return _ability_table(spark, d).select("id_gd", "is_main", "is_echo")


@query("SELECT o_custkey AS id_gd, arg_min(line_text, (card_index, l_suppkey, l_partkey)) AS first_text FROM (SELECT o.card_index, l_suppkey, l_partkey, a.text AS line_text, o_custkey FROM occ o JOIN ability a USING (id_gd) JOIN orders ON o_orderkey = o.card_index) GROUP BY o_custkey")
def first_seen_metadata(spark, d):
    orders = adapter.read(spark, d, "orders").select(F.col("o_orderkey").alias("card_index"), F.col("o_custkey").alias("owner"))
    seen = adapter.occurrences(spark, d).join(adapter.abilities(spark, d), "id_gd").join(orders, "card_index").drop("id_gd").withColumnRenamed("owner", "id_gd")
    return ingest.ability_table(seen).select("id_gd", text.in_locale(F.col("translations"), "en_US").alias("first_text"))


@query("SELECT alias, canonical FROM alias")
def collapse_remap(spark, d):
    return adapter.aliases(spark, d)


@query("SELECT canonical, string_agg(alias::VARCHAR, ',' ORDER BY alias) AS aliases FROM alias GROUP BY canonical")
def duplicated_ids(spark, d):
    return ingest.duplicates_of(adapter.aliases(spark, d)).select("canonical", F.array_join(F.col("duplicated_id_gd").cast("array<string>"), ",").alias("aliases"))


@query("SELECT id_gd, count(*) AS occurrences, count(DISTINCT card_index) AS card_count FROM cocc GROUP BY id_gd")
def collapsed_postings(spark, d):
    merged = ingest.collapsed(adapter.occurrences(spark, d).select("card_index", "line", "id_gd"), adapter.aliases(spark, d))
    return merged.groupBy("id_gd").agg(F.count(F.lit(1)).alias("occurrences"), F.count_distinct("card_index").alias("card_count"))


@query("SELECT id_gd, element_type, replace(text, chr(160), '~') AS text FROM ability WHERE element_type IN ('TRIGGER', 'CONDITION', 'OUTPUT')")
def effects_list(spark, d):
    return results.effects_list(adapter.abilities(spark, d)).select("id_gd", "element_type", F.replace(text.in_locale(F.col("translations"), "fr_FR"), F.lit(chr(160)), F.lit("~")).alias("text"))


@query("SELECT id_gd FROM ability WHERE contains(id_gd::VARCHAR, '12') OR contains(lower(text), '12') ORDER BY id_gd LIMIT 40")
def suggestion_list(spark, d):
    return results.suggestions(adapter.abilities(spark, d), "12").select("id_gd")


@query("SELECT v.id_gd, coalesce(text, '') AS label, text IS NULL AS unknown FROM (SELECT DISTINCT o_custkey * 3 AS id_gd FROM orders) v LEFT JOIN ability USING (id_gd)")
def selected_labels(spark, d):
    ids = adapter.read(spark, d, "orders").select((F.col("o_custkey") * 3).alias("id_gd")).distinct()
    return results.selected(ids, adapter.abilities(spark, d))


# Slots and rendered texts.


@query("SELECT card_index, line, t, c, o FROM slot")
def compact_slots(spark, d):
    return adapter.slot_ids(spark, d)


@query("""SELECT card_index, line, replace(concat_ws(' ', nullif(a1.text, ''), nullif(a2.text, ''), nullif(a3.text, '')), chr(160), '~') AS text FROM slot LEFT JOIN ability a1 ON a1.id_gd = nullif(t, 0) LEFT JOIN ability a2 ON a2.id_gd = nullif(c, 0) LEFT JOIN ability a3 ON a3.id_gd = nullif(o, 0)
  WHERE coalesce(a1.text, '') || coalesce(a2.text, '') || coalesce(a3.text, '') <> ''""")
def effect_text(spark, d):
    return results.texts_of(adapter.cards_with_slots(spark, d), adapter.abilities(spark, d), "en_US").select("card_index", "line", F.replace("text", F.lit(chr(160)), F.lit("~")).alias("text"))


@query("""SELECT card_index, replace(coalesce(string_agg(text, '  ' ORDER BY line) FILTER (line <> 'ec'), ''), chr(160), '~') AS main, replace(coalesce(max(text) FILTER (line = 'ec'), ''), chr(160), '~') AS echo FROM (SELECT card_index, line, concat_ws(' ', nullif(a1.text, ''), nullif(a2.text, ''), nullif(a3.text, '')) AS text FROM slot LEFT JOIN ability a1 ON a1.id_gd = nullif(t, 0)
  LEFT JOIN ability a2 ON a2.id_gd = nullif(c, 0) LEFT JOIN ability a3 ON a3.id_gd = nullif(o, 0) WHERE coalesce(a1.text, '') || coalesce(a2.text, '') || coalesce(a3.text, '') <> '') GROUP BY card_index""")
def effects_by_locale(spark, d):
    shown = results.effects_of(adapter.cards_with_slots(spark, d), adapter.abilities(spark, d))
    return shown.select("card_index", *(F.replace(text.in_locale(F.col(f"{c}_effect"), "en_US"), F.lit(chr(160)), F.lit("~")).alias(c) for c in ("main", "echo")))


@query("SELECT card_index, string_agg(t || '/' || c || '/' || o, ';' ORDER BY CASE line WHEN 'ec' THEN 'z' ELSE line END) AS triplets FROM slot GROUP BY card_index")
def debug_triplets(spark, d):
    return adapter.cards_with_slots(spark, d).select("card_index", results.triplets().alias("triplets"))


@query("SELECT card_index, line, coalesce(a1.canonical, t)::INT AS t, coalesce(a2.canonical, c)::INT AS c, coalesce(a3.canonical, o)::INT AS o FROM slot LEFT JOIN alias a1 ON a1.alias = nullif(t, 0) LEFT JOIN alias a2 ON a2.alias = nullif(c, 0) LEFT JOIN alias a3 ON a3.alias = nullif(o, 0) WHERE coalesce(a1.canonical, t) + coalesce(a2.canonical, c) + coalesce(a3.canonical, o) > 0")
def remap_slots(spark, d):
    moved = ingest.remapped_slots(adapter.cards_with_slots(spark, d), adapter.aliases(spark, d))
    lines = moved.select("card_index", F.explode(F.array(*(F.struct(F.lit(g).alias("line"), f"{g}.t", f"{g}.c", f"{g}.o") for g in matching.LINES))).alias("x")).select("card_index", "x.*")
    return lines.where("t + c + o > 0")


# Families, references, spans.


@query("SELECT source_set, family_id, max_unique_id, card_count, start_bit FROM fam")
def family_summary(spark, d):
    return adapter.index(spark, d)[1].select("source_set", "family_id", "max_unique_id", "card_count", "start_bit")


@query("SELECT order_key, card_index, reference FROM idx")
def card_index_assignment(spark, d):
    return adapter.index(spark, d)[0].select("order_key", "card_index", "reference")


@query("SELECT card_index, reference FROM idx")
def decode_bits(spark, d):
    cards, families = adapter.index(spark, d)
    return filters.references_of(cards.select("card_index"), families)


@query("SELECT reference, card_index FROM idx")
def encode_refs(spark, d):
    cards, families = adapter.index(spark, d)
    return filters.indices_of(cards.select("reference"), families).select("reference", "card_index")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'CORE_KS' END AS source_set, CASE WHEN c_custkey % 3 = 0 THEN c_custkey + 1 END AS unique_id FROM customer", prelude=False)
def reference_parse(spark, d):
    shape = F.when(F.col("c_custkey") % 3 == 0, "ALT_CORE_KS_B_AX_07_U_").when(F.col("c_custkey") % 3 == 1, "ALT_CORE_B_ax_07_U_").otherwise("ALT__B_AX_07_U_")
    read = references.parsed(F.concat(shape, F.col("c_custkey") + 1))
    return adapter.read(spark, d, "customer").select("c_custkey", read["source_set"].alias("source_set"), read["unique_id"].alias("unique_id"))


# Summaries.

_HIST = " UNION ALL ".join(f"SELECT '{s}' AS field, {s} AS value FROM {{0}}" for s in summaries.STATS)


@query(f"SELECT field, value, count(*) AS n FROM ({_HIST.format('cards')}) WHERE value BETWEEN 0 AND 15 GROUP BY ALL")
def stat_histogram(spark, d):
    return summaries.stat_histogram(adapter.cards(spark, d))


@query("SELECT f.faction, count(card_index) AS n FROM (VALUES ('AX', 1), ('BR', 2), ('LY', 3), ('MU', 4), ('OR', 5), ('YZ', 6), ('UN', 0)) f(faction, code) LEFT JOIN cards ON faction_code = code GROUP BY ALL")
def faction_summary(spark, d):
    return summaries.faction_counts(adapter.cards(spark, d))


@query("SELECT 'ALT_' || f.source_set || '_B_' || f.family_id AS family, f.u AS unique_id, CASE WHEN greatest(n.main_cost, n.recall_cost, n.mountain_power, n.ocean_power, n.forest_power) > 0 THEN 'corrupt' ELSE 'missing' END AS kind FROM (SELECT *, unnest(range(1, max_unique_id + 1)) AS u FROM fam) f LEFT JOIN numbered n ON n.source_set = f.source_set AND n.family_id = f.family_id AND n.unique_id = f.u WHERE coalesce(n.faction_code, 0) = 0")
def audit_gaps(spark, d):
    cards, families = adapter.index(spark, d)
    return summaries.gaps(families, cards)


@query("SELECT event_type, count(*) AS n, min(value) AS least, quantile_disc_p50 AS p50, quantile_disc_p95 AS p95, round(avg(value), 6) AS mean, max(value) AS most FROM (SELECT *, max(CASE WHEN r = (n - 1) * 50 // 100 + 1 THEN value END) OVER (PARTITION BY event_type) AS quantile_disc_p50, max(CASE WHEN r = (n - 1) * 95 // 100 + 1 THEN value END) OVER (PARTITION BY event_type) AS quantile_disc_p95 FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events)) GROUP BY ALL", prelude=False)
def timing_percentiles(spark, d):
    return summaries.timings(adapter.read(spark, d, "events"), ["event_type"], "value").withColumn("mean", F.round("mean", 6))


@query("SELECT event_type, n, round(100.0 * n / sum(n) OVER (), 6) AS percent FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)", prelude=False)
def percent_share(spark, d):
    counts = adapter.read(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return summaries.shares(counts, "n").withColumn("percent", F.round("percent", 6))


@query("SELECT event_id, count(value) OVER w AS n_recent, round(avg(value) OVER w, 6) AS recent FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW)", prelude=False)
def rolling_average(spark, d):
    return summaries.rolling(adapter.read(spark, d, "events"), ["user_id"], "ts", "value", 3600).select("event_id", "n_recent", F.round("recent", 6).alias("recent"))


@query("SELECT time_bucket(INTERVAL 600 SECOND, ts) AS tick, count(*) AS done, round(count(*) / 600.0, 9) AS per_second FROM events GROUP BY ALL", prelude=False)
def tick_rate(spark, d):
    return summaries.tick_rate(adapter.read(spark, d, "events"), "ts", 600).withColumn("per_second", F.round("per_second", 9))


@query("SELECT time_bucket(INTERVAL 3600 SECOND, ts) AS tick, count(*) AS done FROM events GROUP BY ALL", prelude=False)
def arrival_ticks(spark, d):
    return ticks(adapter.read(spark, d, "events"), "ts", "1 hour")


# Merging.

_ORDER = {"CORE": 0, "COREKS": 0, "ALIZE": 0}
_PLAN = """, plan AS (SELECT *, coalesce(sum(max_unique_id) OVER (ORDER BY faction, family_number, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS new_start FROM (SELECT *, CASE source_set WHEN 'CORE' THEN 0 WHEN 'COREKS' THEN 1 ELSE 2 END AS r FROM fam))
"""


def _plan(spark, d) -> tuple[DataFrame, DataFrame]:
    cards, families = adapter.index(spark, d)
    return cards, merging.layout(families, _ORDER)


@query(_PLAN + "SELECT source_set, family_id, start_bit AS old_start, new_start, max_unique_id FROM plan")
def merge_layout(spark, d):
    return _plan(spark, d)[1]


@query(_PLAN + "SELECT order_key, new_start + unique_id - 1 AS card_index FROM numbered JOIN plan USING (source_set, family_id)")
def merge_rows(spark, d):
    cards, plan = _plan(spark, d)
    return merging.moved(cards.select("source_set", "card_index", "order_key"), plan).select("order_key", "card_index")


@query(_PLAN + "SELECT n.new_start + n.unique_id - 1 AS card_index, line, id_gd FROM (SELECT * FROM numbered JOIN plan USING (source_set, family_id)) n JOIN cocc ON cocc.card_index = order_key")
def merge_postings(spark, d):
    cards, plan = _plan(spark, d)
    held = ingest.collapsed(adapter.occurrences(spark, d).select("card_index", "line", "id_gd"), adapter.aliases(spark, d)).withColumnRenamed("card_index", "order_key")
    return merging.moved(held.join(cards.select("order_key", "card_index", "source_set"), "order_key").drop("order_key"), plan).select("card_index", "line", "id_gd")


@query(_PLAN + f"SELECT field, value, count(*) AS n FROM ({_HIST.format('numbered')}) WHERE value BETWEEN 0 AND 15 GROUP BY ALL")
def merged_histogram(spark, d):
    cards, plan = _plan(spark, d)
    return summaries.stat_histogram(merging.moved(cards, plan))


# Text functions.


@query("SELECT doc_id, md5(lower(strip_accents(text))) AS folded FROM documents", prelude=False)
def fold_text(spark, d):
    return adapter.read(spark, d, "documents").select("doc_id", F.md5(text.fold(F.col("text"))).alias("folded"))


@query(r"SELECT doc_id, md5(regexp_replace(text, '[\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')) AS spaced FROM documents", prelude=False)
def ws_normalise(spark, d):
    return adapter.read(spark, d, "documents").select("doc_id", F.md5(text.one_space(F.col("text"))).alias("spaced"))


@query("SELECT event_id, CASE WHEN k <= 60 AND event_id % 3 <> 2 THEN k END AS number FROM (SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events)", prelude=False)
def guarded_parse(spark, d):
    k = F.get_json_object("props", "$.k")
    given = F.when(F.col("event_id") % 3 == 0, k).when(F.col("event_id") % 3 == 1, F.concat(F.lit("+"), k)).otherwise(F.concat(F.lit(" "), k))
    return adapter.read(spark, d, "events").select("event_id", text.small_number(given, 60).alias("number"))


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'fr' WHEN turn % 3 = 1 THEN role ELSE 'de' END AS picked FROM conversations", prelude=False)
def locale_pick(spark, d):
    one = F.create_map(F.lit("fr_FR"), F.lit("fr"), F.lit("en_US"), F.col("role"))
    two = F.create_map(F.lit("en_US"), F.col("role"), F.lit("it_IT"), F.lit("it"))
    three = F.create_map(F.lit("it_IT"), F.lit("it"), F.lit("de_DE"), F.lit("de"))
    names = F.when(F.col("turn") % 3 == 0, one).when(F.col("turn") % 3 == 1, two).otherwise(three)
    return adapter.read(spark, d, "conversations").select("conv_id", "turn", text.in_locale(names, "fr_FR").alias("picked"))


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1", prelude=False)
def first_per_group(spark, d):
    first = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return adapter.read(spark, d, "events").withColumn("r", F.row_number().over(first)).where("r = 1").select("user_id", "event_id", "value")


# Card documents through the whole build, merging and removal of duplicates.

#: Aliases among the abilities that occur, and occurrences by index with and without them.
_BUILT = """, flat2 AS (SELECT * FROM flat WHERE id_gd IN (SELECT id_gd FROM occ)),
alias2 AS (SELECT id_gd AS alias, canonical FROM flat2 JOIN (SELECT element_type, norm, coalesce(min(id_gd) FILTER (nbsp), min(id_gd)) AS canonical FROM flat2 GROUP BY ALL HAVING count(*) > 1) USING (element_type, norm) WHERE id_gd <> canonical),
post AS (SELECT DISTINCT idx.card_index, line, coalesce(canonical, id_gd) AS id_gd FROM occ JOIN idx ON order_key = occ.card_index LEFT JOIN alias2 ON id_gd = alias),
plain AS (SELECT DISTINCT idx.card_index, source_set, line, id_gd FROM occ JOIN idx ON order_key = occ.card_index)
"""
_POSTED = f"count(DISTINCT card_index) AS card_count, bool_or(coalesce(line IN ('m1', 'm2', 'm3'), false)) AS is_main, bool_or(coalesce(line = 'ec', false)) AS is_echo, {', '.join(f"count(DISTINCT card_index) FILTER (line = '{g}') AS {g}_cards" for g in ingest.GROUPS)}"
_STATS = ", ".join(summaries.STATS)


#: Tables that several queries start from, by session and folder: the first that needs one writes it.
_WRITTEN: dict[tuple[str, str, str], str] = {}


def _once(spark, d, name: str, write: Callable[[str], None]) -> str:
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _WRITTEN:
        path = scratch(spark, name)
        write(path)
        _WRITTEN[key] = path
    return _WRITTEN[key]


def _documents(spark, d) -> DataFrame:
    return spark.read.parquet(_once(spark, d, "documents", lambda path: _write_documents(spark, d, path)))


def _write_documents(spark, d, path: str) -> None:
    # By set, as merges build each set by itself.
    with tidy(spark), unsorted(spark, len(_ORDER)):
        adapter.documents(spark, d).write.partitionBy("source_set").option("compression", "zstd").parquet(path)


def _built(spark, d, collapse: bool = True) -> dict[str, DataFrame]:
    return ingest.build(_documents(spark, d), collapse)


@query(f"SELECT card_index, reference, faction_code, {_STATS} FROM idx")
def build_cards(spark, d):
    return _built(spark, d, False)["cards"].select("card_index", "reference", "faction_code", *summaries.STATS)


@query("SELECT idx.card_index, line, t, c, o FROM slot JOIN idx ON order_key = slot.card_index WHERE t + c + o > 0")
def build_slots(spark, d):
    lines = F.explode(F.array(*(F.struct(F.lit(g).alias("line"), f"{g}.t", f"{g}.c", f"{g}.o") for g in ingest.GROUPS)))
    return _built(spark, d, False)["cards"].select("card_index", lines.alias("x")).select("card_index", "x.*").where("t + c + o > 0")


@query("SELECT source_set, family_id, max_unique_id, card_count, start_bit, n_name AS english, 'Éc' || n_name || 'ôt' AS french FROM fam JOIN nation ON family_number = lpad(n_nationkey::VARCHAR, 2, '0')")
def build_families(spark, d):
    shown = (text.in_locale(F.col("name"), code).alias(c) for c, code in (("english", "en_US"), ("french", "fr_FR")))
    return _built(spark, d, False)["families"].select("source_set", "family_id", "max_unique_id", "card_count", "start_bit", *shown)


@query(_BUILT + "SELECT card_index, line, id_gd FROM post")
def build_occurrences(spark, d):
    return _built(spark, d)["occurrences"].select("card_index", "line", "id_gd")


@query(_BUILT + f"SELECT id_gd, {_POSTED}, aliases FROM post LEFT JOIN (SELECT canonical, string_agg(alias::VARCHAR, ',' ORDER BY alias) AS aliases FROM alias2 GROUP BY canonical) ON canonical = id_gd GROUP BY id_gd, aliases")
def build_abilities(spark, d):
    aliases = F.when(F.col("duplicated_id_gd").isNotNull(), F.array_join(F.col("duplicated_id_gd").cast("array<string>"), ","))
    return _built(spark, d)["abilities"].select("id_gd", "card_count", "is_main", "is_echo", *(f"{g}_cards" for g in ingest.GROUPS), aliases.alias("aliases"))


@query(_BUILT + "SELECT card_index, line, id_gd FROM post")
def deduplicate_index(spark, d):
    return merging.deduplicated(_built(spark, d, False))["occurrences"].select("card_index", "line", "id_gd")


def _merged(spark, d) -> dict[str, DataFrame]:
    documents = _documents(spark, d)
    return merging.merged({s: ingest.build(documents.where(F.col("source_set") == s), False) for s in _ORDER}, False)


@query(_PLAN + f"SELECT new_start + unique_id - 1 AS card_index, source_set, faction_code, {_STATS} FROM numbered JOIN plan USING (source_set, family_id)")
def merge_index_cards(spark, d):
    return _merged(spark, d)["cards"].select("card_index", "source_set", "faction_code", *summaries.STATS)


@query(_PLAN + f"SELECT id_gd, {_POSTED} FROM (SELECT n.new_start + n.unique_id - 1 AS card_index, line, id_gd FROM (SELECT * FROM numbered JOIN plan USING (source_set, family_id)) n JOIN occ ON occ.card_index = order_key) GROUP BY id_gd")
def merge_index_abilities(spark, d):
    return _merged(spark, d)["abilities"].select("id_gd", "card_count", "is_main", "is_echo", *(f"{g}_cards" for g in ingest.GROUPS))


_IDS = {"t": (1, 4, 7, 10, 13, 16, 19, 22, 25, 28, 31, 34, 37, 40), "o": (2, 3, 5, 6, 8, 9, 11, 12, 14, 15, 17, 18, 20, 21)}


@query(f"""SELECT card_index, source_set, family_id FROM idx WHERE source_set IN ('CORE', 'COREKS') AND faction_code IN (1, 2, 3, 4) AND main_cost <= 14
  AND EXISTS (SELECT 1 FROM nation WHERE family_number = lpad(n_nationkey::VARCHAR, 2, '0') AND contains(lower(n_name), 'a'))
  AND order_key NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')
  AND order_key IN (SELECT card_index FROM occ WHERE line IN ('m1', 'm2', 'm3') AND id_gd IN {_IDS['t'] + _IDS['o']})""")
def request_conjunction(spark, d):
    cards, families = adapter.index(spark, d)
    key = cards.select(F.col("order_key").alias("_key"), F.col("card_index").alias("_at"))
    occurrences = adapter.occurrences(spark, d).join(key, F.col("card_index") == F.col("_key")).select(F.col("_at").alias("card_index"), "line", "id_gd")
    urgent = _urgent(spark, d).join(key, F.col("card_index") == F.col("_key")).select(F.col("_at").alias("card_index"))
    asked = Request(sets=("CORE", "COREKS"), factions=("AX", "BR", "LY", "MU"), name="a", stats={"main_cost": Stat("lte", (14,))}, effects=(Slot(0, t=_IDS["t"]), Slot(1, o=_IDS["o"])), effect_mode="or")
    return filters.conjunction(cards, asked, occurrences, families, members=[(urgent, True)]).select("card_index", "source_set", "family_id")


# Ranks, postings and packs.

#: Rows of a part in the queries below: the tables here are far smaller than those the default is meant for.
PART = 4096
_RANKED = ", r AS (SELECT card_index, row_number() OVER (ORDER BY card_index) - 1 AS rank FROM idx WHERE main_cost <= 7), t AS (SELECT count(*) AS n FROM r) "


def _ranked(spark, d) -> Ranged:
    path = scratch(spark, "ranked")
    write_ranged(adapter.index(spark, d)[0].where("main_cost <= 7").select("card_index"), path, ["card_index"], PART)
    return Ranged.read(spark, path, ["card_index"])


@query(_RANKED + "SELECT start, rank, card_index FROM r JOIN (SELECT unnest(range(50)) * (SELECT n FROM t) // 50 AS start) ON rank BETWEEN start AND start + 19")
def rank_select(spark, d):
    held = _ranked(spark, d)
    total = held.total()
    return held.select([i * total // 50 for i in range(50)], 20).select("start", "rank", "card_index")


@query(_RANKED + "SELECT rank, card_index FROM r, t WHERE rank >= CASE WHEN n >= 10000 THEN 10000 ELSE greatest(n - 50, 0) END ORDER BY rank LIMIT 50")
def rank_page(spark, d):
    held = _ranked(spark, d)
    return held.select([start_rank(held.total())], 50).select("rank", "card_index")


@query("SELECT card_index, line, id_gd FROM occ WHERE id_gd IN (SELECT id_gd FROM occ GROUP BY id_gd ORDER BY count(*) DESC, id_gd LIMIT 20)")
def posting_lookup(spark, d):
    path = scratch(spark, "postings")
    held = adapter.occurrences(spark, d).select("card_index", "line", "id_gd")
    write_ranged(held, path, ["id_gd", "card_index"], PART)
    wanted = [r["id_gd"] for r in held.groupBy("id_gd").count().orderBy(F.desc("count"), "id_gd").limit(20).collect()]
    return Ranged.read(spark, path, ["id_gd", "card_index"]).with_keys(wanted).select("card_index", "line", "id_gd")


_DRAW = "('0x' || substr(md5('7:' || pack || ':{0}:' || {1}), 1, 8))::BIGINT % (SELECT count(*) FROM pos)"
_LEVEL = """,
n{0} AS (SELECT pack, t, list_sort(list_append(l{1}.ids, pos.id_gd)) AS ids FROM (SELECT pack, ids, unnest(range(8)) AS t FROM l{1}) l{1} JOIN pos ON position = """ + _DRAW.format("{0}", "t") + """ WHERE NOT list_contains(l{1}.ids, pos.id_gd)),
x{0} AS (SELECT pack, t, ids, unnest(ids) AS id_gd FROM n{0}),
v{0} AS (SELECT DISTINCT x.pack, x.t, x.ids FROM (SELECT x.pack, x.t, x.ids, card_index, line, count(DISTINCT kind) AS held FROM x{0} x JOIN pos USING (id_gd) JOIN occ USING (id_gd) WHERE line IS NOT NULL GROUP BY ALL) x
  JOIN (SELECT pack, t, count(DISTINCT kind) AS need FROM x{0} JOIN pos USING (id_gd) GROUP BY ALL) y ON x.pack = y.pack AND x.t = y.t AND held = need),
l{0} AS (SELECT pack, arg_min(ids, t) AS ids FROM v{0} GROUP BY pack)"""


@query(""", pos AS (SELECT id_gd, element_type AS kind, row_number() OVER (ORDER BY id_gd) - 1 AS position FROM ability WHERE element_type IS NOT NULL AND id_gd IN (SELECT id_gd FROM occ WHERE line IS NOT NULL)),
l0 AS (SELECT pack, [id_gd] AS ids FROM (SELECT c_custkey AS pack FROM customer) JOIN pos ON position = """ + _DRAW.format(0, 0) + ")" + "".join(_LEVEL.format(i, i - 1) for i in (1, 2)) + " SELECT pack, array_to_string(ids, ',') AS ids FROM l2")
def viable_packs(spark, d):
    asked = adapter.read(spark, d, "customer").select(F.col("c_custkey").alias("pack"))
    found = packs.grown(asked, adapter.abilities(spark, d), adapter.occurrences(spark, d).select("card_index", "line", "id_gd"), 3, seed=7)
    return found.select("pack", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query("SELECT path, faction, family_number, unique_id FROM (SELECT 'file:/data/json/' || source_set || '/' || faction || '/' || CASE WHEN order_key % 11 = 0 THEN 'elsewhere' ELSE family_number END || '/' || reference || CASE WHEN order_key % 7 = 0 THEN '_FOILER' ELSE '' END || '.json' AS path, faction, family_number, unique_id FROM idx WHERE source_set = 'CORE' AND order_key % 11 <> 0 AND order_key % 7 <> 0) ORDER BY faction, family_number::INT, unique_id LIMIT 500")
def discover_limit(spark, d):
    folder = F.when(F.col("order_key") % 11 == 0, "elsewhere").otherwise(F.col("family_number"))
    name = F.concat("reference", F.when(F.col("order_key") % 7 == 0, "_FOILER").otherwise(""), F.lit(".json"))
    paths = adapter.index(spark, d)[0].select(F.concat_ws("/", F.lit("file:/data/json"), "source_set", "faction", folder, name).alias("path"))
    return discovered(paths, "CORE", 500).select("path", "faction", "family_number", "unique_id")


# A published index, and the engine over it.

def _root(spark, d) -> str:
    return _once(spark, d, "index", lambda root: store.publish(_built(spark, d), root, 1, PART, ("occurrences",)))


def _most_held(engine: Engine, kind: str, n: int = 12) -> tuple[int, ...]:
    held = engine.index["abilities"].where(F.col("element_type") == kind).orderBy(F.desc("card_count"), "id_gd").limit(n)
    return tuple(sorted(r["id_gd"] for r in held.collect()))


_TOP = _BUILT + """, tops AS (SELECT id_gd, element_type FROM (SELECT id_gd, element_type, row_number() OVER (PARTITION BY element_type ORDER BY count(DISTINCT card_index) DESC, id_gd) AS k FROM post JOIN ability USING (id_gd) GROUP BY id_gd, element_type) WHERE k <= 12 AND element_type IS NOT NULL),
hits AS (SELECT DISTINCT card_index FROM post JOIN tops USING (id_gd) WHERE line IN ('m1', 'm2', 'm3') AND element_type IN ('TRIGGER', 'OUTPUT')),
letters AS (SELECT * FROM (VALUES (1, 'AX'), (2, 'BR'), (3, 'LY'), (4, 'MU'), (5, 'OR'), (6, 'YZ'), (0, 'UN')) x(faction_code, letters))
"""


def _asked(engine: Engine, **more) -> Request:
    slots = (Slot(0, t=_most_held(engine, "TRIGGER")), Slot(1, o=_most_held(engine, "OUTPUT")))
    return Request(effects=slots, effect_mode="or", stats={"main_cost": Stat("lte", (14,))}, **more)


def _shown(cards: DataFrame) -> DataFrame:
    return cards.select("card_index", "reference", "main_cost", F.col("faction.code").alias("letters"))


_SHOWN = "SELECT card_index, reference, main_cost, letters FROM idx JOIN letters USING (faction_code) "


@query(_TOP + _SHOWN + "JOIN hits USING (card_index) WHERE main_cost <= 14 AND card_index > 300 ORDER BY card_index LIMIT 100")
def engine_page(spark, d):
    engine = Engine.open(spark, _root(spark, d))
    return _shown(engine.cards_of(_asked(engine, limit=100, cursor=300)).cards)


@query(_TOP + _GROUPS + "SELECT grp.family_id, range_start, count(*) AS matches, min(card_index) AS first_card FROM idx JOIN hits USING (card_index) JOIN grp ON grp.family_id = idx.family_id AND card_index >= range_start AND card_index < range_end WHERE main_cost <= 14 GROUP BY ALL")
def engine_families(spark, d):
    engine = Engine.open(spark, _root(spark, d))
    return engine.cards_of(_asked(engine, with_families=True)).families.select("family_id", "range_start", "matches", "first_card")


@query(_TOP + _SHOWN + "WHERE reference = (SELECT max(reference) FROM idx WHERE faction_code > 0)")
def engine_card(spark, d):
    engine = Engine.open(spark, _root(spark, d))
    return _shown(engine.card(engine.index["cards"].where("faction_code > 0").agg(F.max("reference")).first()[0]))


@query(_TOP + "SELECT DISTINCT post.id_gd, element_type FROM post JOIN ability USING (id_gd) WHERE line IN ('m1', 'm2', 'm3') AND element_type = 'CONDITION' AND card_index IN (SELECT card_index FROM idx WHERE main_cost <= 14 AND faction_code IN (1, 2)) AND card_index IN (SELECT card_index FROM post JOIN tops USING (id_gd) WHERE line IN ('m1', 'm2', 'm3') AND element_type = 'TRIGGER')")
def engine_reachable(spark, d):
    engine = Engine.open(spark, _root(spark, d))
    ids = ",".join(map(str, _most_held(engine, "TRIGGER")))
    found = engine.reachable(f"effect[0][t]={ids}&faction=AX,BR&mainCost[lte]=14&editing=condition:1")
    return found.join(engine.index["abilities"].select("id_gd", "element_type"), "id_gd")


@query(_TOP + _SHOWN + "WHERE card_index IN (SELECT start_bit FROM fam) AND main_cost BETWEEN 2 AND 15 ORDER BY card_index LIMIT 200")
def engine_collection(spark, d):
    engine = Engine.open(spark, _root(spark, d))
    refs = engine.index["cards"].join(engine.index["families"].select("start_bit"), F.col("card_index") == F.col("start_bit"), "left_semi").select("reference")
    engine.register("firsts", [r["reference"] for r in refs.collect()])
    return _shown(engine.cards_of(Request(collection="firsts", stats={"main_cost": Stat("gte", (2,))}, limit=200)).cards)


def _formats(spark, engine: Engine) -> DataFrame:
    firsts = engine.index["families"].select(references.reference(F.col("source_set"), F.col("faction"), F.col("family_number"), F.lit(1)).alias("r"))
    refs = F.sort_array(F.collect_list("r"))
    none = F.array().cast("array<string>")
    row = lambda name, *lists: firsts.agg(F.lit(name).alias("id"), F.lit(1).cast("long").alias("version"), *(x.alias(c) for x, c in zip(lists, ("included_refs", "excluded_sets", "excluded_refs"))), F.lit("ready").alias("status"))
    return row("only", refs, none, none).union(row("rest", none, F.array(F.lit("ALIZE")), refs))


@query(_TOP + _SHOWN + "WHERE card_index IN (SELECT start_bit FROM fam) AND faction_code IN (1, 3) ORDER BY card_index LIMIT 200")
def engine_format_only(spark, d):
    engine = Engine.open(spark, _root(spark, d))
    engine = Engine(engine.index, 1, _formats(spark, engine), ranged=engine.ranged)
    return _shown(engine.cards_of(Request(format="only", factions=("AX", "LY"), limit=200)).cards)


@query(_TOP + _SHOWN + "JOIN hits USING (card_index) WHERE main_cost <= 14 AND card_index NOT IN (SELECT start_bit FROM fam) AND source_set <> 'ALIZE' ORDER BY card_index LIMIT 200")
def engine_format_rest(spark, d):
    engine = Engine.open(spark, _root(spark, d))
    engine = Engine(engine.index, 1, _formats(spark, engine), ranged=engine.ranged)
    return _shown(engine.cards_of(_asked(engine, format="rest", limit=200)).cards)


@query(_TOP + "SELECT DISTINCT card_index, reference FROM idx JOIN post USING (card_index) JOIN tops USING (id_gd) WHERE line IS NOT NULL AND element_type = 'OUTPUT'")
def engine_by_ids(spark, d):
    engine = Engine.open(spark, _root(spark, d))
    return engine.by_ids(list(_most_held(engine, "OUTPUT"))).select("card_index", "reference")


# Published summaries, and merges that collapse.


@query(f"SELECT field, value::VARCHAR AS value, count(*) AS n FROM ({_HIST.format('cards')}) WHERE value BETWEEN 0 AND 15 GROUP BY ALL UNION ALL SELECT 'faction', f.faction, count(card_index) FROM (VALUES ('AX', 1), ('BR', 2), ('LY', 3), ('MU', 4), ('OR', 5), ('YZ', 6), ('UN', 0)) f(faction, code) LEFT JOIN cards ON faction_code = code GROUP BY ALL UNION ALL SELECT 'cards', string_agg(DISTINCT source_set, '+' ORDER BY source_set), sum(card_count)::BIGINT FROM fam")
def published_summaries(spark, d):
    index = store.load(spark, _root(spark, d))
    text_ = lambda c: F.col(c).cast("string").alias("value")
    stats = index["stat_counts"].select("field", text_("value"), "n")
    factions = index["faction_counts"].select(F.lit("faction").alias("field"), text_("faction"), "n")
    return stats.union(factions).union(index["manifest"].select(F.lit("cards").alias("field"), text_("set"), F.col("card_count").alias("n")))


def _merged_published(spark, d) -> dict[str, DataFrame]:
    """Each set built and collapsed by itself, published, loaded and merged."""

    def write(root: str) -> None:
        for s in _ORDER:
            store.publish(ingest.build(_documents(spark, d).where(F.col("source_set") == s)), f"{root}/{s}", 1, PART, ("occurrences",))

    root = _once(spark, d, "sets", write)
    return merging.merged({s: store.load(spark, f"{root}/{s}") for s in _ORDER})


@query(f"SELECT field, value, count(*) AS n FROM ({_HIST.format('cards')}) WHERE value BETWEEN 0 AND 15 GROUP BY ALL")
def merged_summaries(spark, d):
    return _merged_published(spark, d)["stat_counts"].select("field", "value", "n")


_TOGETHER = _BUILT + _PLAN + ", moved AS (SELECT DISTINCT n.new_start + n.unique_id - 1 AS card_index, line, coalesce(canonical, id_gd) AS id_gd FROM (SELECT * FROM numbered JOIN plan USING (source_set, family_id)) n JOIN occ ON occ.card_index = order_key LEFT JOIN alias2 ON id_gd = alias) "


@query(_TOGETHER + "SELECT card_index, line, id_gd FROM moved")
def merge_collapsed_occurrences(spark, d):
    return _merged_published(spark, d)["occurrences"].select("card_index", "line", "id_gd")


@query(_TOGETHER + f"SELECT id_gd, {_POSTED}, aliases FROM moved LEFT JOIN (SELECT canonical, string_agg(alias::VARCHAR, ',' ORDER BY alias) AS aliases FROM alias2 GROUP BY canonical) ON canonical = id_gd GROUP BY id_gd, aliases")
def merge_collapsed_abilities(spark, d):
    aliases = F.when(F.col("duplicated_id_gd").isNotNull(), F.array_join(F.col("duplicated_id_gd").cast("array<string>"), ","))
    return _merged_published(spark, d)["abilities"].select("id_gd", "card_count", "is_main", "is_echo", *(f"{g}_cards" for g in ingest.GROUPS), aliases.alias("aliases"))


# Smaller pieces of the interface.


@query(_TOP + _GROUPS + "SELECT reference, matches FROM idx JOIN (SELECT count(*) AS matches, min(card_index) AS card_index FROM idx JOIN hits USING (card_index) JOIN grp ON grp.family_id = idx.family_id AND card_index >= range_start AND card_index < range_end WHERE main_cost <= 14 GROUP BY grp.family_id, range_start) USING (card_index)")
def engine_family_counts(spark, d):
    answer = Engine.open(spark, _root(spark, d)).cards_of(_asked(Engine.open(spark, _root(spark, d)), with_families=True))
    return results.match_counts(answer.cards, answer.families)


@query(_TOP + "SELECT CASE element_type WHEN 'TRIGGER' THEN 't' ELSE 'o' END AS bucket, (row_number() OVER (PARTITION BY element_type ORDER BY id_gd) - 1)::INT AS at, id_gd, replace(text, chr(160), '~') AS text FROM tops JOIN ability USING (id_gd, element_type) WHERE element_type IN ('TRIGGER', 'OUTPUT')")
def engine_recap(spark, d):
    engine = Engine.open(spark, _root(spark, d))
    slot = Slot(0, t=_most_held(engine, "TRIGGER"), o=_most_held(engine, "OUTPUT"))
    return results.recap(slot, engine.index["abilities"]).withColumn("text", F.replace("text", F.lit(chr(160)), F.lit("~")))


@query(_BUILT + "SELECT id_gd FROM post JOIN ability USING (id_gd) WHERE contains(id_gd::VARCHAR, '1') OR contains(lower(text), '1') GROUP BY id_gd HAVING bool_or(coalesce(line = 'ec', false)) ORDER BY id_gd LIMIT 40")
def suggestion_support(spark, d):
    abilities = store.load(spark, _root(spark, d))["abilities"]
    return results.suggestions(abilities, "1", main=False).select("id_gd")


@query("SELECT source_set, family_id, split_part(family_id, '_', 1) AS faction, split_part(family_id, '_', 2)::BIGINT AS number FROM fam")
def family_split(spark, d):
    parts = references.family_parts(F.col("family_id"))
    return adapter.index(spark, d)[1].select("source_set", "family_id", parts["faction"].alias("faction"), parts["number"].alias("number"))


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'us' WHEN turn % 3 = 1 THEN role ELSE 'de' END AS picked FROM conversations", prelude=False)
def shown_locale(spark, d):
    one = F.create_map(F.lit("de_DE"), F.lit("de"), F.lit("en_us"), F.lit("us"))
    two = F.create_map(F.lit("en_us"), F.lit("us"), F.lit("en_US"), F.col("role"))
    three = F.create_map(F.lit("it_IT"), F.lit("it"), F.lit("de_DE"), F.lit("de"))
    names = F.when(F.col("turn") % 3 == 0, one).when(F.col("turn") % 3 == 1, two).otherwise(three)
    return adapter.read(spark, d, "conversations").select("conv_id", "turn", text.shown_in(names, "fr_FR").alias("picked"))


@query("SELECT doc_id, len(v) AS n, md5(array_to_string(v, '|')) AS listed FROM (SELECT doc_id, [y FOR y IN [trim(x) FOR x IN string_split(text, ',')] IF y <> ''] AS v FROM documents)", prelude=False)
def listed_values(spark, d):
    held = text.listed(F.col("text"))
    return adapter.read(spark, d, "documents").select("doc_id", F.size(held).cast("long").alias("n"), F.md5(F.array_join(held, "|")).alias("listed"))
