import pytest

from facetry.errors import BadRequest
from facetry.plans.request import Slot, Stat, compacted, compose, cost_values, editing, parse, without_slot


def test_lists_keep_order_once():
    r = parse("set[]=CORE&set=ALIZE,CORE&faction=AX, BR&ref[]=b&ref=a,b")
    assert (r.sets, r.factions, r.refs) == (("CORE", "ALIZE"), ("AX", "BR"), ("b", "a"))


def test_first_and_last_values():
    r = parse("name= one &name=two&format=a&format=b&format=&collection=x&collection=yyyy")
    assert (r.name, r.format, r.collection) == ("one", "b", "yyyy")


@pytest.mark.parametrize("query, stat", [("mainCost=7", Stat("in", (7,))), ("mainCost[]=1,2&mainCost[]=2", Stat("in", (1, 2))), ("mainCost[lte]=3&mainCost[gt]=1", Stat("gt", (1,)))])
def test_stats(query, stat):
    assert parse(query).stats == {"main_cost": stat}


@pytest.mark.parametrize("query", ["mainCost=16", "mainCost=1&mainCost[]=2", "mainCost[gt]=x", "faction=ZZ", "limit=0", "limit=201", "effectMode=xor", "effect[0]=1", "effect[][t]=1", "effect[0][x]=1", "effect[0][t]=a", "effect[0][matchCount]=4", "cursor=-1"])
def test_rejected(query):
    with pytest.raises(BadRequest):
        parse(query)


def test_slots():
    r = parse("effect[3][t]=24,25&effect[3][matchCount]=2&effect[1][o]=9&effect[7][matchCount]=3&support[c]=5&effectMode=OR")
    assert r.effects == (Slot(1, o=(9,)), Slot(3, t=(24, 25), match_count=2))
    assert r.support == Slot(0, c=(5,)) and r.effect_mode == "or"
    assert compacted(r, 3) == 1 and compacted(r, 7) is None
    rest, own = without_slot(r, 3)
    assert own.t == (24, 25) and [s.index for s in rest.effects] == [1]


def test_compose_round_trip():
    r = parse("set=CORE&mainCost[]=1,2&forestPower[gte]=4&effect[2][t]=1&support[o]=3&effectMode=or&limit=7&cursor=5&withFamilies=1")
    again = parse(compose(r))
    assert again.effects == (Slot(0, t=(1,)),)
    assert (again.sets, again.stats, again.support, again.effect_mode, again.limit, again.cursor, again.with_families) == (r.sets, r.stats, r.support, "or", 7, 5, True)


def test_editing():
    assert editing("output:0") == ("o", 0) and editing("trigger:support") == ("t", None)
    for text in (None, "", "banana:0", "trigger:nope"):
        with pytest.raises(BadRequest):
            editing(text)


def test_costs():
    assert cost_values("1,3-5") == [1, 3, 4, 5]
    for text in ("5-3", "16", "a", ""):
        with pytest.raises(BadRequest):
            cost_values(text)
