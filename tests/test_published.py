"""Tables in parts, lookups that open few files, packs, listings, alias unions, and following a published index."""

import json
import tempfile
from itertools import combinations

import pytest

from facetry.engine import Engine
from facetry.errors import NotFound
from facetry.operators import ingest, merging, packs, summaries
from facetry.operators.aliases import united
from facetry.plans.request import Request, Slot
from facetry.sources import store
from facetry.sources.cards import discovered, listed, read_cards
from facetry.sources.ranged import Ranged, start_rank, write_ranged
from facetry.streaming.following import follow
from tests.test_index import FILES, FIRST, Cn, card, effect, tree


def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def files_read(df):
    """(rows, files opened by the scan) of a plan of one scan."""
    rows = df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = (plan.executedPlan() if plan.nodeName().startswith("Adaptive") else plan).collectLeaves()
    return rows, sum(leaves.apply(i).metrics().apply("numFiles").value() for i in range(leaves.size()) if leaves.apply(i).metrics().contains("numFiles"))


@pytest.fixture(scope="module")
def numbers(spark):
    path = folder() + "/t"
    write_ranged(spark.range(0, 3000).selectExpr("id * 3 as k", "cast(id as string) as v").repartition(5), path, ["k"], 100)
    return Ranged.read(spark, path, ["k"])


def test_parts_follow_one_another(numbers):
    parts = numbers.parts.orderBy("part").collect()
    assert len(parts) >= 25 and sum(p["rows"] for p in parts) == numbers.total() == 3000
    assert all(a["most"] < b["least"] and a["before"] + a["rows"] == b["before"] for a, b in zip(parts, parts[1:]))


def test_lookups_open_few_files(numbers):
    rows, files = files_read(numbers.with_keys([3, 6, 8997, 5]))
    assert sorted(r["k"] for r in rows) == [3, 6, 8997] and 1 <= files <= 3
    rows, files = files_read(numbers.between(300, 330))
    assert sorted(r["k"] for r in rows) == list(range(300, 331, 3)) and files <= 2
    assert numbers.with_keys([]).collect() == [] and numbers.with_keys([10**9]).collect() == []


def test_ranks(numbers):
    got = numbers.select([0, 17, 1500, 2995, 4000], 10).select("start", "rank", "k").collect()
    assert sorted(map(tuple, got)) == sorted((s, s + i, 3 * (s + i)) for s in (0, 17, 1500, 2995) for i in range(10) if s + i < 3000)
    plan = numbers.select([17])._jdf.queryExecution().optimizedPlan().toString()
    assert "part" in plan and numbers.select([]).collect() == []
    assert [start_rank(n) for n in (0, 30, 60, 9999, 10000, 10**6)] == [0, 0, 10, 9949, 10000, 10000]


def test_odd_parts(spark):
    path = folder() + "/t"
    write_ranged(spark.createDataFrame([], "k long, v string"), path, ["k"])
    empty = Ranged.read(spark, path, ["k"])
    assert empty.total() == 0 and empty.with_keys([1]).collect() == [] and empty.select([0]).collect() == []
    # One key of most rows goes on from part to part; nulls come first.
    rows = [(7, i) for i in range(500)] + [(1, 0), (9, 0), (None, 0)]
    write_ranged(spark.createDataFrame(rows, "k long, v long"), path + "2", ["k", "v"], 50)
    hot = Ranged.read(spark, path + "2", ["k", "v"])
    assert hot.with_keys([7]).count() == 500 and hot.parts.count() > 5 and hot.total() == 503
    assert [r["v"] for r in hot.select([2], 4).orderBy("rank").collect()] == [0, 1, 2, 3]


def brute_viable(ids, held, whole):
    bits = {i: k for i, k, _ in held}
    need = {bits[i] for i in ids}
    places = {}
    for i, k, (c, line) in held:
        if i in ids:
            places.setdefault(c if whole else (c, line), set()).add(k)
    return any(v >= need for v in places.values())


@pytest.mark.parametrize("whole", [False, True])
def test_packs(spark, whole):
    held = [(1, "TRIGGER", (0, "m1")), (2, "CONDITION", (0, "m1")), (3, "OUTPUT", (0, "m2")), (4, "TRIGGER", (1, "m2")), (5, "OUTPUT", (1, "m2")), (2, "CONDITION", (1, "ec")), (6, "OUTPUT", (2, None)), (7, "OTHER", (2, "m1"))]
    occurrences = spark.createDataFrame([(i, c, line) for i, _, (c, line) in held], "id_gd long, card_index long, line string")
    abilities = spark.createDataFrame(sorted({(i, k) for i, k, _ in held} | {(8, "TRIGGER")}), "id_gd long, element_type string")
    known = [r["id_gd"] for r in packs.catalogue(abilities, occurrences, whole).orderBy("position").collect()]
    assert known == ([1, 2, 3, 4, 5, 6] if whole else [1, 2, 3, 4, 5])
    asked = spark.range(300).withColumnRenamed("id", "pack")
    own = [h for h in held if (whole or h[2][1]) and h[1] != "OTHER"]
    for size in (1, 2, 3):
        got = packs.grown(asked, abilities, occurrences, size, 12, 3, whole).collect()
        assert len(got) > 200 and all(len(set(r["ids"])) == size and brute_viable(r["ids"], own, whole) for r in got)
        # Every viable pack that can be grown one id at a time is reached.
        assert {tuple(r["ids"]) for r in got} == {c for c in combinations(known, size) if brute_viable(c, own, whole)}
    assert packs.grown(asked, abilities.where("false"), occurrences, 2).collect() == []


def test_listing_before_reading(spark):
    later = {"json/COREKS/ZZ/99/ALT_COREKS_B_ZZ_99_U_1.json": "{ not json", "json/COREKS/AX/06/ALT_COREKS_B_AX_06_U_4_FOILER.json": "{", "json/COREKS/AX/07/ALT_COREKS_B_AX_06_U_1.json": "{"}
    root = tree(FILES | later)
    assert listed(spark, f"{root}/json/COREKS").count() == 6
    rows, files = files_read(read_cards(spark, root, "COREKS", limit=2))
    assert [(r["faction"], r["unique_id"]) for r in sorted(rows, key=lambda r: r["faction"])] == [("AX", 5), ("MU", 3140)] and files == 2
    with pytest.raises(Exception, match="MALFORMED|malformed|Malformed"):
        read_cards(spark, root, "COREKS", limit=4).collect()
    assert read_cards(spark, root, "COREKS", limit=0).collect() == []
    paths = spark.createDataFrame([(None,), ("x.json",), ("json/S/AX/1/ALT_S_B_AX_1_U_3.json",), ("json/S/AX/1/ALT_S_B_AX_1_U_3.json.json",)], "path string")
    assert [r["unique_id"] for r in discovered(paths, "S").collect()] == [3]


def brute_union(pairs):
    pairs = {(a, c) for a, c in pairs if a is not None and c is not None and a != c}
    group = {x: {x} for p in pairs for x in p}
    for a, c in pairs:
        both = group[a] | group[c]
        for x in both:
            group[x] = both
    calls, called = {a for a, _ in pairs}, {c for _, c in pairs}
    root = lambda g: min(g - calls or g & called)
    return {(x, root(g)) for x, g in group.items() if x != root(g)}


@pytest.mark.parametrize(
    "pairs",
    [
        [], [(3, 2), (5, 4), (3, 2)], [(3, 2), (3, 1)], [(3, 2), (2, 1)], [(i + 1, i) for i in range(40)], [(i, i + 1) for i in range(40)],
        [(1, 2), (2, 3), (3, 1), (9, 3)], [(7, 7), (None, 3), (4, None), (5, 4)], [(10, 1), (10, 2), (11, 2), (11, 3), (12, 3), (20, 21)],
    ],
)
def test_alias_union(spark, pairs):
    got = united(spark.createDataFrame(pairs, "alias long, canonical long")).collect()
    assert sorted(map(tuple, got)) == sorted(brute_union(pairs))


def one_set(spark, name, *texts):
    """A set of one card whose line holds the (id, text) outputs."""
    own = card("AX", "X", ["1", "1", "0", "0", "0"], effect("MAIN_EFFECT", [(i, Cn, t) for i, t in texts]))
    return ingest.build(read_cards(spark, tree({f"json/{name}/AX/0{len(texts)}/ALT_{name}_B_AX_0{len(texts)}_U_1.json": own}), name))


def test_two_merges_with_a_conflicting_alias(spark):
    one, two, three = one_set(spark, "S", (3, "same"), (2, "same")), one_set(spark, "T", (3, "same"), (1, "same"), (8, "other")), one_set(spark, "U", (3, "same"), (9, "other"), (8, "other"), (7, "x"))
    assert {tuple(r) for r in one["aliases"].collect()} == {(3, 2)} and {tuple(r) for r in two["aliases"].collect()} == {(3, 1)}
    first = merging.merged({"S": one, "T": two})
    assert {tuple(r) for r in first["aliases"].collect()} == {(3, 1), (2, 1)}
    place = folder()
    store.publish(first, place, 1)
    again = store.load(spark, place)
    renamed = {t: again[t].replace({"S": "ST", "T": "ST"}, subset="source_set") for t in ("families", "cards")}
    both = merging.merged({"ST": again | renamed, "U": three})
    assert {tuple(r) for r in both["aliases"].collect()} == {(3, 1), (2, 1), (9, 8)}
    assert {r["id_gd"] for r in both["occurrences"].collect()} == {1, 7, 8}
    assert {r["id_gd"]: r["card_count"] for r in both["abilities"].collect()} == {1: 3, 7: 1, 8: 2}
    assert {tuple(r) for r in both["stat_counts"].collect()} == {tuple(r) for r in summaries.stat_histogram(both["cards"]).collect()}
    assert {tuple(r) for r in both["faction_counts"].collect()} == {tuple(r) for r in summaries.faction_counts(both["cards"]).collect()}


@pytest.fixture(scope="module")
def published(spark):
    root = folder()
    store.publish(ingest.build(read_cards(spark, tree(FILES), "COREKS")), root, 1, 2)
    return root


def test_published_summaries(spark, published):
    index = store.load(spark, published)
    assert {tuple(r) for r in index["stat_counts"].collect()} == {tuple(r) for r in summaries.stat_histogram(index["cards"]).collect()}
    row = index["manifest"].first()
    assert (row["set"], row["family_count"], row["card_count"], row["span"]) == ("COREKS", 3, 3, 5 + 3140 + 6)


def test_point_lookup(spark, published):
    engine = Engine.open(spark, published)
    one = engine._one("ALT_COREKS_B_MU_22_U_3140")
    rows, files = files_read(one)
    assert [r["card_index"] for r in rows] == [5 + 3139] and files == 1
    assert "Generate" not in one._jdf.queryExecution().optimizedPlan().toString()
    assert engine.card("ALT_COREKS_B_MU_22_U_3140").first()["faction"]["code"] == "MU"
    for text in ("ALT_COREKS_B_MU_22_U_3141", "ALT_COREKS_B_MU_22_U_7", "ALT_X_B_MU_22_U_1"):
        with pytest.raises(NotFound):
            engine.card(text)


def test_postings_of_a_request(spark, published):
    engine, plain = Engine.open(spark, published), Engine(store.load(spark, published), 1)
    asked = Request(effects=(Slot(0, t=(24,)),))
    assert [r["card_index"] for r in engine.matching(asked).collect()] == [r["card_index"] for r in plain.matching(asked).collect()] == [4]
    rows, files = files_read(engine._occurrences([24]))
    assert {r["id_gd"] for r in rows} == {24} and files < engine.ranged["occurrences"].parts.count()
    # An alias is found through the id that stands for it.
    assert [r["reference"] for r in engine.by_ids([90]).collect()] == [r["reference"] for r in engine.by_ids([245]).collect()]
    assert {r["card_index"] for r in engine.at_ranks([0, 2]).collect()} == {4, 5 + 3139 + 6}


def test_universe_only_where_needed(spark, published):
    engine = Engine.open(spark, published)
    has_universe = lambda r: "Generate explode" in engine.matching(r)._jdf.queryExecution().optimizedPlan().toString()
    assert has_universe(Request()) and not has_universe(Request(factions=("AX",))) and not has_universe(Request(effects=(Slot(0, t=(24,)),)))
    assert engine.matching(Request()).count() == 5 + 3140 + 6


def put(root, name, body):
    with open(f"{root}/{name}", "w") as f:
        json.dump(body, f)


def test_following(spark):
    root, formats, checkpoint = folder(), folder(), folder()
    index = ingest.build(read_cards(spark, tree(FILES), "COREKS"))
    store.publish(index, root, 1)
    own = {"id": "kept", "version": 1, "included_refs": ["ALT_COREKS_B_AX_06_U_5"]}
    put(formats, "kept.json", own)
    put(formats, "moved.json", own | {"id": "moved"})
    entry = lambda name, version: {"id": name, "path": f"{name}.json", "version": version}
    put(formats, "manifest.json", [entry("kept", 1), entry("moved", 1)])
    engine = Engine.open(spark, root, formats)
    found = lambda name: [r["card_index"] for r in engine.matching(Request(format=name)).collect()]
    assert found("kept") == found("moved") == [4]
    held = engine._resolved["kept"][0]
    # Only a format changes: the others keep what they have.
    put(formats, "moved.json", own | {"id": "moved", "version": 2, "included_refs": ["ALT_COREKS_B_OR_16_U_6"]})
    put(formats, "manifest.json", [entry("kept", 1), entry("moved", 2)])
    assert engine.refresh_formats(formats) == ["moved"] and engine._resolved["kept"][0] is held and "moved" not in engine._resolved
    assert found("moved") == [5 + 3139 + 6]
    told = []
    follow(engine, checkpoint, formats, lambda *a: told.append(a), once=True).awaitTermination(120)
    assert told == [(1, [])]
    extra = FILES | {"json/COREKS/AX/05/ALT_COREKS_B_AX_05_U_2.json": FIRST}
    store.publish(ingest.build(read_cards(spark, tree(extra), "COREKS")), root, 2)
    put(formats, "moved.json", own | {"id": "moved", "version": 3, "included_refs": ["ALT_COREKS_B_AX_05_U_2"]})
    put(formats, "manifest.json", [entry("kept", 1), entry("moved", 3)])
    follow(engine, checkpoint, formats, lambda *a: told.append(a), once=True).awaitTermination(120)
    assert told == [(1, []), (2, ["moved"])] and engine.version == 2
    assert found("kept") == [2 + 4] and found("moved") == [1]
    # A restart from the checkpoint has nothing new to see.
    follow(engine, checkpoint, formats, lambda *a: told.append(a), once=True).awaitTermination(120)
    assert len(told) == 2


def test_mixed_lines_are_counted_once(spark):
    rows = [(1, "m1", 5), (1, "m1", 5), (1, "ec", 5), (2, "m3", 5), (3, None, 5), (3, None, 6)]
    got = {r["id_gd"]: r.asDict() for r in ingest.posting_counts(spark.createDataFrame(rows, "card_index long, line string, id_gd long")).collect()}
    assert got[5] == {"id_gd": 5, "is_main": True, "is_echo": True, "card_count": 3, "m1_cards": 1, "m2_cards": 0, "m3_cards": 1, "ec_cards": 1}
    assert got[6] == {"id_gd": 6, "is_main": False, "is_echo": False, "card_count": 1, "m1_cards": 0, "m2_cards": 0, "m3_cards": 0, "ec_cards": 0}
