"""Building an index from documents, merging, publishing, lists and audits."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from facetry.engine import Engine
from facetry.errors import BadRequest, InvalidData, NotFound
from facetry.operators import filters, ingest, merging, results, summaries
from facetry.sources import lists, store
from facetry.sources.cards import read_cards

TYPES = ("TRIGGER", "CONDITION", "OUTPUT")
NBSP = "\u00a0"


def stat(kind, value):
    return {"cardElementType": {"reference": kind}, "value": value}


def effect(kind, *displays):
    return {"cardElementType": {"reference": kind}, "cardEffectDisplays": [{"cardEffect": {"cardEffectElements": [{"idGd": i, "type": t, "text": x} for i, t, x in d]}} for d in displays]}


def card(faction, name, stats, *effects, **more):
    costs = [stat(k, v) for k, v in zip(("MAIN_COST", "RECALL_COST", "MOUNTAIN_POWER", "OCEAN_POWER", "FOREST_POWER"), stats)]
    return {"name": name, "mainFaction": {"reference": faction}, "cardElements": costs + list(effects), "ignored": 1, **more}


A, B, Cn = TYPES
FIRST = card(
    "AX", "First", ["2", "2", "0", "2", "0"], effect("MAIN_EFFECT", [(24, A, "t24"), (191, B, "[]"), (76, Cn, "o76")], [(24, A, "t24"), (171, B, "c171"), (70, Cn, "o70")]),
    illustrator={"nickName": "Someone"}, cardSet={"reference": "COREKS", "name": "Set name"}, cardSubTypes=[{"reference": "ENGINEER", "name": "Engineer"}, {"name": "none"}], translations={"fr_FR": {"locale": "fr_FR", "name": "Premier"}},
)
SECOND = card("MU", "Second", ["7", "8", "5", "0", "5"], effect("MAIN_EFFECT", [(23, A, "[]"), (181, B, "c181"), (142, Cn, "o142")], [(20, A, f"t{NBSP}20"), (191, B, "[]"), (146, Cn, "o146")], [], [(999, Cn, "fourth")]), effect("ECHO_EFFECT", [(192, A, "t192"), (191, B, "[]"), (245, Cn, f"Draw{NBSP}a card.")]))
THIRD = card("YZ", "Third", ["3", "x", " 3", "+3", "300"], stat("RECALL_COST", "3"), effect("MAIN_EFFECT", [(236, A, "t236"), (191, B, "[]"), (65536 + 90, Cn, "big"), (90, Cn, "Draw a  card.")]), effect("ECHO_EFFECT", [(192, A, "t192"), (191, B, "[]"), (59, Cn, "o59")]))
FILES = {"json/COREKS/AX/06/ALT_COREKS_B_AX_06_U_5.json": FIRST, "json/COREKS/MU/22/ALT_COREKS_B_MU_22_U_3140.json": SECOND, "json/COREKS/OR/16/ALT_COREKS_B_OR_16_U_6.json": THIRD}


def tree(files):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for name, body in files.items():
        os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
        with open(f"{root}/{name}", "w") as f:
            f.write(body if isinstance(body, str) else json.dumps(body))
    return root


@pytest.fixture(scope="module")
def documents(spark):
    odd = {"json/COREKS/AX/07/ALT_COREKS_B_AX_06_U_9.json": FIRST, "json/COREKS/AX/06/ALT_CORE_B_AX_06_U_9.json": FIRST, "json/COREKS/AX/06/ALT_COREKS_B_AX_06_U_7_FOILER.json": FIRST, "json/COREKS/AX/06/notes.txt": "x"}
    return read_cards(spark, tree(FILES | odd), "COREKS").persist()


@pytest.fixture(scope="module")
def plain(documents):
    return {k: v.persist() for k, v in ingest.build(documents, collapse=False).items()}


@pytest.fixture(scope="module")
def built(documents):
    return {k: v.persist() for k, v in ingest.build(documents).items()}


def cards_with(index, id_gd, line=None):
    rows = index["occurrences"].where(f"id_gd = {id_gd}" + (f" and line = '{line}'" if line else "")).select("card_index").distinct().collect()
    return sorted(r[0] for r in rows)


def test_spans_and_indices(plain):
    assert [(r["family_id"], r["start_bit"], r["max_unique_id"]) for r in plain["families"].orderBy("start_bit").collect()] == [("AX_06", 0, 5), ("MU_22", 5, 3140), ("OR_16", 3145, 6)]
    assert sorted(r[0] for r in plain["cards"].select("card_index").collect()) == [4, 3144, 3150]
    assert ingest.manifest(plain, "COREKS").first().asDict() | {"built_at": 0} == {"version": 1, "set": "COREKS", "family_count": 3, "card_count": 3, "span": 3151, "built_at": 0, "limit": None}


def test_stats_and_factions(plain):
    row = {r["card_index"]: r for r in plain["cards"].collect()}
    assert [row[3150][c] for c in ("main_cost", "recall_cost", "mountain_power", "ocean_power", "forest_power")] == [3, 3, 0, 3, 0]
    assert {(r["field"], r["value"]): r["n"] for r in summaries.stat_histogram(plain["cards"]).where("field = 'main_cost'").collect()} == {("main_cost", 2): 1, ("main_cost", 3): 1, ("main_cost", 7): 1}
    counts = {r["faction"]: r["n"] for r in summaries.faction_counts(plain["cards"]).collect()}
    assert counts == {"AX": 1, "BR": 0, "LY": 0, "MU": 1, "OR": 0, "YZ": 1, "UN": 0}


def test_lines(plain):
    assert cards_with(plain, 90) == [3150] and cards_with(plain, 24, "m1") == [4] == cards_with(plain, 24, "m2") and cards_with(plain, 24, "m3") == []
    assert cards_with(plain, 999) == [3144] and cards_with(plain, 999, "m1") == []
    row = {r["id_gd"]: r for r in plain["abilities"].collect()}
    assert (row[24]["card_count"], row[24]["m1_cards"], row[24]["m2_cards"], row[24]["is_main"], row[24]["is_echo"]) == (1, 1, 1, True, False)
    assert (row[191]["card_count"], row[191]["ec_cards"], row[191]["is_main"], row[191]["is_echo"]) == (3, 2, True, True)
    assert not row[999]["is_main"] and not row[999]["is_echo"]


def test_slots(plain):
    row = {r["card_index"]: r for r in plain["cards"].collect()}
    assert row[4]["m1"].asDict() == {"t": 24, "c": 191, "o": 76} and row[4]["ec"].asDict() == {"t": 0, "c": 0, "o": 0}
    assert row[3150]["m1"]["o"] == 90
    shown = {r["card_index"]: r["x"] for r in plain["cards"].select("card_index", results.triplets().alias("x")).collect()}
    assert shown[3150] == "236/191/90;192/191/59"
    printed = {r["reference"]: (r["main"], r["echo"]) for r in plain["cards"].select(*results.table_row()).collect()}
    assert printed["ALT_COREKS_B_AX_06_U_5"] == ("24_191_76, 24_171_70", "")


def test_metadata(plain):
    row = plain["families"].where("family_id = 'AX_06'").first()
    assert row["name"] == {"en_US": "First", "fr_FR": "Premier"} and row["artist"] == "Someone" and row["card_set"].asDict() == {"reference": "COREKS", "name": "Set name", "code": "BTG"}
    assert [s["reference"] for s in row["card_sub_types"]] == ["ENGINEER"] and set(row["card_sub_types"][0]["name"]) == set(ingest.SUBTYPE_LOCALES)


def test_collapse(built):
    assert {r["alias"]: r["canonical"] for r in built["aliases"].collect()} == {90: 245}
    assert cards_with(built, 245) == [3144, 3150] and cards_with(built, 90) == []
    row = {r["id_gd"]: r for r in built["abilities"].collect()}
    assert row[245]["duplicated_id_gd"] == [90] and row[245]["card_count"] == 2 and 90 not in row
    assert built["cards"].where("card_index = 3150").first()["m1"]["o"] == 245
    assert merging.deduplicated(built) is None


def test_collapse_rules(spark):
    rows = [(200, A, "When played"), (100, A, "When played"), (95, Cn, "a b"), (214, Cn, f"a{NBSP}b"), (1, A, "x"), (2, B, "x"), (3, B, ""), (4, B, ""), (7, A, "y"), (8, A, "y ")]
    abilities = spark.createDataFrame([(i, t, {"en_US": x}) for i, t, x in rows], "id_gd long, element_type string, translations map<string,string>")
    assert {r["alias"]: r["canonical"] for r in ingest.aliases_of(abilities).collect()} == {200: 100, 95: 214}


def test_deduplicate_later(plain):
    later = merging.deduplicated(plain)
    assert cards_with(later, 245) == [3144, 3150] and {r["alias"]: r["canonical"] for r in later["aliases"].collect()} == {90: 245}


def test_bad_documents(spark):
    bad = card("AX", "x", [], effect("MAIN_EFFECT", [(None, A, "x")]))
    with pytest.raises(Exception, match="idGd"):
        ingest.build(read_cards(spark, tree({"json/S/AX/1/ALT_S_B_AX_1_U_1.json": bad}), "S"))["occurrences"].collect()
    with pytest.raises(Exception):
        read_cards(spark, tree({"json/S/AX/1/ALT_S_B_AX_1_U_1.json": "{"}), "S").collect()
    twice = read_cards(spark, tree({"json/S/AX/1/ALT_S_B_AX_1_U_1.json": FIRST, "json/S/AX/1/ALT_S_B_AX_1_U_01.json": FIRST}), "S")
    with pytest.raises(InvalidData):
        ingest.build(twice)


def test_limit(spark):
    root = tree({f"json/S/{f}/1/ALT_S_B_{f}_1_U_{u}.json": FIRST for f in ("BR", "AX") for u in range(1, 6)})
    got = read_cards(spark, root, "S", limit=6).select("faction", "unique_id").collect()
    assert sorted((r[0], r[1]) for r in got) == [*(("AX", u) for u in range(1, 6)), ("BR", 1)]


def small(spark, source_set, faction, slots, held):
    """One family with an ability on some of its slots."""
    none = (0, 0, 0)
    families = spark.createDataFrame([(source_set, faction, "04" if faction == "AX" else "01", f"{faction}_04" if faction == "AX" else f"{faction}_01", slots, slots, 0)], "source_set string, faction string, family_number string, family_id string, max_unique_id long, card_count long, start_bit long")
    slot = "struct<t:int,c:int,o:int>"
    cards = spark.createDataFrame([(source_set, i, 1, 2, 0, 0, 0, 0, (0, 0, 90), none, none, none) for i in held], f"source_set string, card_index long, faction_code int, main_cost int, recall_cost int, mountain_power int, ocean_power int, forest_power int, m1 {slot}, m2 {slot}, m3 {slot}, ec {slot}")
    occurrences = spark.createDataFrame([(i, "m1", 90) for i in held], "card_index long, line string, id_gd long")
    abilities = spark.createDataFrame([(90, Cn, {"en_US": source_set}, True, source_set == "CORE")], "id_gd long, element_type string, translations map<string,string>, is_main boolean, is_echo boolean")
    return {"families": families, "cards": cards, "occurrences": occurrences, "abilities": abilities, "aliases": spark.createDataFrame([(91, 90)], "alias long, canonical long")}


def test_merge(spark):
    sources = {"COREKS": small(spark, "COREKS", "AX", 3, [0]), "CORE": small(spark, "CORE", "AX", 3, [0]), "ALIZE": small(spark, "ALIZE", "BR", 2, [1])}
    out = merging.merged(sources)
    assert [(r["source_set"], r["start_bit"]) for r in out["families"].orderBy("start_bit").collect()] == [("COREKS", 0), ("CORE", 3), ("ALIZE", 6)]
    assert cards_with(out, 90) == [0, 3, 7] == sorted(r[0] for r in out["cards"].select("card_index").collect())
    row = out["abilities"].first()
    assert row["translations"] == {"en_US": "COREKS"} and row["is_echo"] and row["card_count"] == 3 and row["duplicated_id_gd"] == [91]
    assert [(r["family_id"], r["range_start"], r["range_end"]) for r in results.span_groups(out["families"]).orderBy("range_start").collect()] == [("AX_04", 0, 6), ("BR_01", 6, 8)]
    with pytest.raises(InvalidData):
        merging.merged({"CORE": sources["CORE"]})


def test_overlap_groups():
    assert merging.overlap_groups({"a": {"x"}, "b": {"y"}, "c": {"y", "z"}, "d": {"x"}, "e": {"x", "q"}}) == {"a": 0, "b": 1, "c": 1, "d": 2, "e": 2}


def test_decode_and_encode(spark):
    families = spark.createDataFrame([("S", "AX", "04", "AX_04", 4200, 0), ("S", "AX", "05", "AX_05", 6146, 4200)], "source_set string, faction string, family_number string, family_id string, max_unique_id long, start_bit long")
    asked = spark.createDataFrame([(i,) for i in (0, 4199, 4200, 10345, 10346)], "card_index long")
    got = {r["card_index"]: r["reference"] for r in filters.references_of(asked, families).collect()}
    assert got == {0: "ALT_S_B_AX_04_U_1", 4199: "ALT_S_B_AX_04_U_4200", 4200: "ALT_S_B_AX_05_U_1", 10345: "ALT_S_B_AX_05_U_6146"}
    back = filters.indices_of(spark.createDataFrame([(r,) for r in got.values()], "reference string"), families)
    assert {r["reference"]: r["card_index"] for r in back.collect()} == {v: k for k, v in got.items()}


def test_audit(spark):
    families = spark.createDataFrame([("TEST", "AX_01", 4)], "source_set string, family_id string, max_unique_id long")
    cards = spark.createDataFrame([("TEST", "AX_01", 1, 1, 1), ("TEST", "AX_01", 3, 1, 1), ("TEST", "AX_01", 4, 0, 7)], "source_set string, family_id string, unique_id long, faction_code int, main_cost int").selectExpr("*", "0 recall_cost", "0 mountain_power", "0 ocean_power", "0 forest_power")
    row = summaries.gap_report(families, cards).first()
    assert (row["family"], row["missing"], row["corrupt"]) == ("ALT_TEST_B_AX_01", [2], [4])


def test_publish_and_refresh(spark, built, plain):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    with pytest.raises(NotFound):
        Engine.open(spark, root)
    store.publish(plain, root, 1)
    engine = Engine.open(spark, root)
    engine.register("mine", ["ALT_COREKS_B_AX_06_U_5"])
    assert engine.span == 3151 and not engine.refresh()
    assert [r["reference"] for r in engine.cards_of("effect[0][o]=90").cards.collect()] == ["ALT_COREKS_B_OR_16_U_6"]
    store.publish(built, root, 2)
    assert engine.refresh() and engine.version == 2 and engine.collections.get("mine") is None
    answer = engine.cards_of("effect[0][o]=90")
    assert answer.total == 1 and [r["id_gd"] for r in engine.effects().where("id_gd in (90, 245)").collect()] == [245]
    text = engine.card("ALT_COREKS_B_OR_16_U_6").first()["main_effect"]["en_US"]
    assert text == f"t236 [] Draw{NBSP}a card."


def test_extra_lists(spark, built):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    refs = spark.createDataFrame([("ALT_COREKS_B_AX_06_U_5",), ("ALT_COREKS_B_MU_22_U_3140",)], "reference string")
    members = store.add_list(built, root, "owned-1", refs, kind="own")
    assert filters.exclude(built["cards"], members).count() == 1
    assert [r.asDict() for r in store.lists(spark, root).collect()] == [{"filter_id": "owned-1", "type": "own", "negated": False, "card_count": 2}]
    with pytest.raises(BadRequest):
        store.add_list(built, root, "owned-1", refs)
    store.add_list(built, root, "owned-1", refs.limit(1), negated=True, replace=True)
    assert [(r["negated"], r["card_count"]) for r in store.lists(spark, root).collect()] == [(True, 1)]
    for name, bad in (("a b", refs), ("other", spark.createDataFrame([("nonsense",)], "reference string"))):
        with pytest.raises(BadRequest):
            store.add_list(built, root, name, bad)


def test_formats(spark, plain):
    own = {"id": "a", "version": 2, "included_refs": ["ALT_COREKS_B_AX_06_U_5"]}
    out = {"id": "b", "version": 1, "excluded_sets": ["COREKS"], "excluded_refs": ["ALT_X_B_AX_06_U_5"]}
    root = tree({"manifest.json": [{"id": "a", "path": "a.json", "version": 2}, {"id": "b", "path": "b.json", "version": 1}, {"id": "c", "path": "a.json", "version": 2}, {"id": "d", "path": "none.json", "version": 1}, {"id": "e", "path": "e.json", "version": 1}, {"id": "e", "path": "e.json", "version": 1}, {"id": "f", "path": "f.json", "version": 9}], "a.json": own, "b.json": out, "e.json": out | {"id": "e"}, "f.json": own | {"id": "f"}})
    formats = lists.read_formats(spark, root)
    assert {r["id"]: r["status"] for r in formats.collect()} == {"a": "ready", "b": "ready", "c": "failed", "d": "failed", "e": "failed", "f": "failed"}
    members = lists.format_members(formats, plain["families"])
    assert {(r["negated"], r["card_index"]) for r in members.where("id = 'a'").collect()} == {(False, 4)}
    assert members.where("id = 'b' and card_index is not null").count() == 3151 and members.where("id = 'b' and problem is not null").count() == 1


def test_reference_lists(spark):
    root = tree({"x.txt": "# head\n\n a \nb\n#c\na\n"})
    assert sorted(r[0] for r in lists.read_references(spark, f"{root}/x.txt").collect()) == ["a", "a", "b"] == sorted(lists.references_in("# head\n\n a \nb\n#c\na\n"))


def test_windows(spark):
    rows = [(1, "2024-01-01 00:00:00", 1.0), (1, "2024-01-01 00:00:04", 3.0), (1, "2024-01-01 00:00:05", 5.0), (1, "2024-01-01 00:00:20", 7.0)]
    samples = spark.createDataFrame(rows, "k int, at string, v double").selectExpr("k", "timestamp(at) at", "v")
    assert [(r["n_recent"], r["recent"]) for r in summaries.rolling(samples, ["k"], "at", "v").orderBy("at").collect()] == [(1, 1.0), (2, 2.0), (3, 3.0), (1, 7.0)]
    assert sorted((r["done"], r["per_second"]) for r in summaries.tick_rate(samples, "at", 10).collect()) == [(1, 0.1), (3, 0.3)]
    row = summaries.timings(samples, ["k"], "v").first()
    assert (row["n"], row["least"], row["p50"], row["p95"], row["mean"], row["most"]) == (4, 1.0, 3.0, 5.0, 4.0, 7.0)
    assert {r["percent"] for r in summaries.shares(samples.where("v in (1, 3)"), "v").collect()} == {25.0, 75.0}


def test_seconds_left(spark):
    rows = spark.createDataFrame([(10, 25, 10.0), (0, 7, 0.0), (5, 5, 2.0), (9, 5, 2.0), (1, 3, None)], "done long, total long, rate double")
    left = rows.select(summaries.seconds_left(F.col("done"), F.col("total"), F.col("rate")).alias("left"))
    assert [r["left"] for r in left.collect()] == [2, None, 0, 0, None]


def test_stream_of_arrivals(spark):
    from facetry.streaming.arrivals import ticks

    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.sql("select timestamp('2024-01-01 00:00:00') ts union all select timestamp('2024-01-01 00:00:00.5') union all select timestamp('2024-01-01 00:00:02')").write.parquet(f"{root}/in")
    query = ticks(spark.readStream.schema("ts timestamp").parquet(f"{root}/in")).writeStream.format("memory").queryName("arrived").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(r["done"] for r in spark.table("arrived").collect()) == [1, 2]
