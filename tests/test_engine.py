"""A ten-card index whose answers are known by hand."""

import pytest

from facetry.engine import Engine
from facetry.errors import BadRequest, CollectionNotLoaded, FormatFailed, NotFound
from facetry.functions.references import read_reference
from facetry.operators import filters, matching, results
from facetry.plans.request import Slot

POSTINGS = {(24, "m2"): [2, 5], (25, "m1"): [7, 8], (25, "m2"): [7], (191, "m1"): [5], (192, "m1"): [7, 8], (192, "m2"): [7], (42, "ec"): [5], (90, "m1"): [2]}
KINDS = {24: "TRIGGER", 25: "TRIGGER", 191: "CONDITION", 192: "CONDITION", 42: "OUTPUT", 90: "OUTPUT"}


def ref(i):
    return f"ALT_TEST_B_AX_01_U_{i + 1}"


def slots(t=0, c=0, o=0):
    return {"t": t, "c": c, "o": o}


@pytest.fixture(scope="module")
def index(spark):
    none = slots()
    rows = [(2, 1, 2, 3, 2, 0, 1, slots(24, 191, 90), none, none, slots(24, 0, 42)), (5, 1, 2, 3, 2, 0, 4, slots(24, 191, 90), none, none, slots(24, 0, 42)), (7, 2, 9, 9, 9, 9, 9, none, none, none, none), (8, 2, 9, 9, 9, 9, 20, none, none, none, none)]
    slot = "struct<t:int,c:int,o:int>"
    cards = spark.createDataFrame([(i, "TEST", "AX", "01", "AX_01", i + 1, ref(i), *rest) for i, *rest in rows], f"card_index long, source_set string, faction string, family_number string, family_id string, unique_id long, reference string, faction_code int, main_cost int, recall_cost int, mountain_power int, ocean_power int, forest_power int, m1 {slot}, m2 {slot}, m3 {slot}, ec {slot}")
    families = spark.createDataFrame([("TEST", "AX", "01", "AX_01", 10, 4, 0, {"en_US": "Test Card", "fr_FR": "Élémentaire de Mélon"})], "source_set string, faction string, family_number string, family_id string, max_unique_id long, card_count long, start_bit long, name map<string,string>")
    occurrences = spark.createDataFrame([(i, line, a) for (a, line), cards_ in POSTINGS.items() for i in cards_], "card_index long, line string, id_gd long")
    abilities = spark.createDataFrame([(i, k, {"en_US": f"text {i}"}, i != 42, i == 42) for i, k in KINDS.items()], "id_gd long, element_type string, translations map<string,string>, is_main boolean, is_echo boolean")
    aliases = spark.createDataFrame([(240, 24)], "alias long, canonical long")
    return {"cards": cards, "families": families, "occurrences": occurrences, "abilities": abilities, "aliases": aliases}


@pytest.fixture(scope="module")
def formats(spark):
    schema = "id string, version long, included_refs array<string>, excluded_sets array<string>, excluded_refs array<string>, status string"
    return spark.createDataFrame([("in", 1, [ref(i) for i in range(5)], None, None, "ready"), ("out", 1, None, None, [ref(2)], "ready"), ("bad", 1, None, None, None, "failed"), ("lost", 1, ["ALT_X_B_AX_01_U_1"], None, None, "ready")], schema)


@pytest.fixture(scope="module")
def engine(index, formats):
    return Engine(index, 1, formats)


def found(engine, query):
    return sorted(r["card_index"] for r in engine.matching(engine.request(query)).select("card_index").collect())


@pytest.mark.parametrize(
    "query, cards",
    [
        ("effect[0][t]=24", [2, 5]), ("effect[0][t]=240", [2, 5]), ("effect[0][t]=24&effect[0][o]=42", []), ("effect[0][t]=24&support[o]=42", [5]), ("support[o]=42", [5]),
        ("effect[0][t]=25&effect[0][c]=192", [7, 8]), ("effect[0][t]=25&effect[0][c]=192&effect[0][matchCount]=2", [7]), ("effect[0][t]=25&effect[0][c]=192&effect[0][matchCount]=3", []),
        ("effect[0][t]=24&effect[1][o]=90", [2]), ("effect[0][t]=24&effect[1][o]=90&effectMode=or", [2, 5]), ("effect[0][t]=24&faction=AX&recallCost=3", [2, 5]),
        ("forestPower[gte]=2&faction=AX", [5]), ("mountainPower=2", [2, 5]), ("oceanPower[]=0,1", [2, 5]), ("forestPower[gt]=10", []),
        ("name=test card", list(range(10))), ("name=melon", list(range(10))), ("name=ELEMENTAIRE", list(range(10))), ("name=zzzzz", []), ("name=   ", list(range(10))), ("", list(range(10))),
        ("set=TEST", list(range(10))), (f"ref={ref(2)},{ref(5)}", [2, 5]), (f"ref={ref(2)},nonsense,ALT_TEST_B_AX_01_U_99", [2]), ("ref=nonsense", []),
        ("format=in&faction=AX", [2]), ("format=out", [0, 1, 3, 4, 5, 6, 7, 8, 9]), (f"format=in&ref={ref(2)},{ref(5)}", [2]),
    ],
)
def test_filters(engine, query, cards):
    assert found(engine, query) == cards


def test_six_slots_need_two_words(index, spark):
    wanted = [Slot(k, t=(24,)) for k in range(5)] + [Slot(5, o=(90,))]
    got = matching.request_match(index["occurrences"], index["aliases"], wanted, "and", Slot())
    assert [r["card_index"] for r in got.collect()] == [2]


def test_pages_chain(engine):
    one = engine.cards_of("effect[0][t]=24&limit=1")
    assert (one.total, one.cursor, [r["reference"] for r in one.cards.collect()]) == (2, 2, [ref(2)])
    two = engine.cards_of("effect[0][t]=24&limit=1&cursor=2")
    assert (two.total, two.cursor, [r["reference"] for r in two.cards.collect()]) == (2, 5, [ref(5)])
    three = engine.cards_of("effect[0][t]=24&limit=1&cursor=5")
    assert (three.cursor, three.cards.collect()) == (None, [])


def test_rendered_card(engine):
    row = engine.card(ref(2), debug=True).first()
    assert row["debug_bga_trigram"] == "24/191/90;24/0/42"
    assert row["main_effect"] == {"en_US": "text 24 text 191 text 90"} and row["echo_effect"] == {"en_US": "text 24 text 42"}
    assert row["faction"].asDict() == {"code": "AX", "name": "Axiom"}
    gap = engine.cards_of("limit=1").cards.first()
    assert gap["faction"]["code"] == "UN" and gap["main_cost"] == 0 and gap["main_effect"] == {}


def test_flat_view(engine):
    shown = {r["reference"]: r for r in results.flat_view(engine.cards_of("").cards, "fr_FR").collect()}
    assert len(shown) == 10 and {r["rarity"] for r in shown.values()} == {"UNIQUE"}
    full, plain = shown[ref(2)], shown[ref(0)]
    assert (full["main_effect"], full["echo_effect"]) == ("text 24 text 191 text 90", "text 24 text 42")
    assert not plain["main_effect"] and plain["echo_effect"] is None


def test_missing_cards(engine):
    for text in (ref(0), "ALT_TEST_B_AX_01_U_11"):
        with pytest.raises(NotFound):
            engine.card(text)
    with pytest.raises(BadRequest):
        engine.card("nonsense")


def test_families(engine):
    answer = engine.cards_of("effect[0][t]=24,25&withFamilies=1")
    assert [(r["family_id"], r["matches"], r["first_card"]) for r in answer.families.collect()] == [("AX_01", 4, 2)]
    assert [r["reference"] for r in answer.cards.collect()] == [ref(2)]


@pytest.mark.parametrize("query", ["set=NONE", "effect[0][t]=191", "effect[0][t]=777", "format=nope", "cursor=10", "collection=a"])
def test_bad_names(engine, query):
    with pytest.raises(BadRequest):
        engine.request(query)


def test_formats_that_failed(engine):
    for name in ("bad", "lost"):
        with pytest.raises(FormatFailed):
            engine.request(f"format={name}")


def test_collections(engine):
    with pytest.raises(CollectionNotLoaded):
        engine.request("collection=mine")
    assert engine.register("mine", f"# list\n{ref(2)}\n\n{ref(3)}\n{ref(2)}") == 2
    assert found(engine, "collection=mine&mainCost=2") == [2]
    for body in ("# nothing", f"{ref(2)}\nALT_TEST_B_AX_01_U_99"):
        with pytest.raises(BadRequest):
            engine.register("mine", body)


def test_reachable(engine):
    ids = lambda q: [r["id_gd"] for r in engine.reachable(q).collect()]
    assert ids("editing=output:support") == [42]
    assert ids("editing=condition:0&effect[0][t]=25") == [192]
    assert ids("editing=trigger:0&effect[0][t]=24") == [24, 25]
    assert ids("editing=output:0&effect[0][t]=24") == []
    with pytest.raises(BadRequest):
        engine.reachable("effect[0][t]=24")


def test_whole_card(index, spark):
    picks = matching.picks_of(spark, [Slot(t=(24,), c=(191,))])
    assert [r["card_index"] for r in matching.whole_card(index["occurrences"], picks, (True, True, False)).collect()] == [5]


def test_references(index, spark):
    texts = [ref(0), "ALT_TEST_B_AX_01_U_0", ref(0) + "\n", "ALT_A__B_B_AX_01_U_1", "ALT_TEST_B_AX_02_U_1", ref(10)]
    rows = {r["reference"]: (r["card_index"], r["problem"]) for r in filters.indices_of(spark.createDataFrame([(t,) for t in texts], "reference string"), index["families"]).collect()}
    assert [rows[t] for t in texts] == [(0, None), (None, "malformed"), (None, "malformed"), (None, "malformed"), (None, "unknown"), (None, "padding")]
    assert str(read_reference(ref(3))) == ref(3) and read_reference("ALT_X_Y_B_AX_1_U_4294967296") is None


def test_queries_by_ids(engine):
    assert engine.slot_of([24, 240, 191]) == Slot(0, t=(24,), c=(191,))
    got = lambda *a, **k: [r["card_index"] for r in engine.by_ids(*a, **k).collect()]
    assert got([24, 191]) == [] and got([24, 191], whole=True) == [5] and got([42]) == [5] and got([24], most=1) == [2]
    assert engine.by_ids([240]).first()["main"] == "24_191_90"
    for ids in ([], [777]):
        with pytest.raises(BadRequest):
            engine.by_ids(ids)
