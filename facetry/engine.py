"""What callers ask: cards, one card, abilities, reachable abilities, collections; on one index at a time."""

from __future__ import annotations

from collections import OrderedDict
from dataclasses import dataclass, field
from time import monotonic

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetry.errors import BadRequest, CollectionNotLoaded, FormatFailed, InvalidData, NotFound
from facetry.functions.references import read_reference, reference
from facetry.operators import results
from facetry.operators.filters import conjunction, indices_of, universe
from facetry.operators.matching import LINES, canonical, line_match, picks_of, whole_card
from facetry.plans.request import BUCKETS, Request, Slot, editing, multimap, parse, without_slot
from facetry.sources import store
from facetry.sources.lists import collection_id, format_members, read_formats, references_in
from facetry.sources.ranged import Ranged

#: Bounds of what the driver looks up by itself: ids a request may name, and cached collections.
MOST_COLLECTIONS = 256


@dataclass
class Collections:
    """Named lists of cards, the least recently used first to go; each lives ``idle`` seconds after its last use."""

    most: int = MOST_COLLECTIONS
    idle: float = 3600.0
    held: OrderedDict[str, tuple[DataFrame, float]] = field(default_factory=OrderedDict)

    def put(self, name: str, members: DataFrame) -> None:
        self.held[name] = (members, monotonic())
        self.held.move_to_end(name)
        while len(self.held) > self.most:
            self.held.popitem(last=False)[1][0].unpersist()

    def get(self, name: str) -> DataFrame | None:
        found = self.held.get(name)
        if found is None or monotonic() - found[1] > self.idle:
            self.held.pop(name, None)
            return None
        self.put(name, found[0])
        return found[0]


@dataclass(frozen=True)
class Answer:
    """A page of cards, the number of all matches, and where the next page starts."""

    cards: DataFrame
    total: int
    cursor: int | None
    families: DataFrame | None = None


class Engine:
    """Queries one set of index tables. Cards include the gaps of family spans, as a listing without filters shows them."""

    def __init__(self, index: dict[str, DataFrame], version: int = 0, formats: DataFrame | None = None, root: str | None = None, ranged: dict[str, Ranged] | None = None):
        self.spark: SparkSession = index["cards"].sparkSession
        self.root = root
        self.collections = Collections()
        #: Matches of the last request, kept while its count, page and facet are made.
        self._matches: DataFrame | None = None
        self._take(index, version, ranged)
        self._take_formats(formats)

    @staticmethod
    def open(spark: SparkSession, root: str, formats: str | None = None) -> Engine:
        pointer = store.latest(spark, root)
        if pointer is None:
            raise NotFound(f"no published index below {root}")
        version = pointer["version"]
        parted = store.ranged(spark, root, version)
        return Engine(store.load(spark, root, version, parted), version, read_formats(spark, formats) if formats else None, root, parted)

    def _take(self, index: dict[str, DataFrame], version: int, ranged: dict[str, Ranged] | None = None) -> None:
        self.index, self.version, self.ranged = index, version, ranged or {}
        spans = universe(index["families"])
        every = spans.join(index["families"].select("source_set", "family_id", "faction", "family_number", "start_bit"), ["source_set", "family_id"])
        ref = reference(F.col("source_set"), F.col("faction"), F.col("family_number"), F.col("card_index") - F.col("start_bit") + 1)
        held = index["cards"].drop("source_set", "family_id", "faction", "family_number", "reference")
        self.cards = every.withColumn("reference", ref).drop("start_bit").join(held, "card_index", "left")
        self.span = index["families"].agg(F.coalesce(F.sum("max_unique_id"), F.lit(0))).first()[0]

    def _take_formats(self, formats: DataFrame | None) -> list[str]:
        """Keeps what is resolved of the formats whose version and status stay; returns the ids of the others."""
        before: dict[str, tuple] = getattr(self, "_listed", {})
        self.formats = formats
        self._listed = {} if formats is None else {r["id"]: (r["version"], r["status"], r["negated"]) for r in formats.select("id", "version", "status", (F.coalesce(F.size("included_refs"), F.lit(0)) <= 0).alias("negated")).collect()}
        resolved: dict[str, tuple[DataFrame, bool]] = getattr(self, "_resolved", {})
        self._resolved = {k: m for k, m in resolved.items() if before.get(k) == self._listed.get(k)}
        for k in resolved.keys() - self._resolved.keys():
            resolved[k][0].unpersist()
        return sorted(k for k, v in self._listed.items() if before.get(k) != v)

    def refresh(self) -> bool:
        """Takes a newer published version, if there is one; collections of the old one go, formats stay but are resolved anew."""
        pointer = store.latest(self.spark, self.root) if self.root else None
        if pointer is None or pointer["version"] <= self.version:
            return False
        version = pointer["version"]
        parted = store.ranged(self.spark, self.root, version)
        self._take(store.load(self.spark, self.root, version, parted), version, parted)
        self.collections = Collections()
        for members, _ in self._resolved.values():
            members.unpersist()
        self._resolved = {}
        return True

    def refresh_formats(self, folder: str) -> list[str]:
        """Reads the formats' list again. Those whose version and status are as before stay resolved; returns the others' ids."""
        return self._take_formats(read_formats(self.spark, folder))

    def register(self, name: str, refs: str | list[str]) -> int:
        """Holds a collection of references, all of which must resolve; returns its size."""
        if not collection_id(name):
            raise BadRequest(f"invalid collection id '{name}'")
        wanted = references_in(refs) if isinstance(refs, str) else list(refs)
        if not wanted:
            raise BadRequest("an empty collection")
        found = indices_of(self.spark.createDataFrame([(r,) for r in dict.fromkeys(wanted)], "reference string"), self.index["families"])
        bad = found.where("problem is not null").first()
        if bad:
            raise BadRequest(f"{bad['problem']} reference '{bad['reference']}'")
        members = found.select("card_index").distinct().persist()
        self.collections.put(name.strip(), members)
        return members.count()

    def request(self, query: str | Request) -> Request:
        """A request whose names all stand for something."""
        r = parse(query) if isinstance(query, str) else query
        if r.cursor is not None and r.cursor >= self.span:
            raise BadRequest("cursor beyond the index")
        if r.sets:
            known = {x[0] for x in self.index["families"].select("source_set").where(F.col("source_set").isin(*r.sets)).distinct().collect()}
            if unknown := set(r.sets) - known:
                raise BadRequest(f"unknown set '{min(unknown)}'")
        if named := r.ids():
            wanted = canonical(self.spark.createDataFrame([(i, k, 0) for k, (_, i, _) in enumerate(named)], "id_gd long, slot int, bucket int"), self.index["aliases"].select("alias", "canonical"))
            kinds = {x["slot"]: x["element_type"] for x in wanted.join(self.index["abilities"].select("id_gd", "element_type"), "id_gd").collect()}
            for k, (name, i, kind) in enumerate(named):
                if kinds.get(k) != kind:
                    raise BadRequest(f"{name} contains {'unknown id' if k not in kinds else 'id of another type'}: {i}")
        self._members(r)
        return r

    def _members(self, r: Request) -> list[tuple[DataFrame, bool]]:
        out: list[tuple[DataFrame, bool]] = []
        if r.collection:
            if not collection_id(r.collection):
                raise BadRequest(f"invalid collection id '{r.collection}'")
            members = self.collections.get(r.collection)
            if members is None:
                raise CollectionNotLoaded(r.collection)
            out.append((members, False))
        if r.format:
            if r.format not in self._listed:
                raise BadRequest(f"unknown format '{r.format}'")
            _, status, negated = self._listed[r.format]
            if r.format not in self._resolved:
                found = format_members(self.formats.where(F.col("id") == r.format), self.index["families"]).persist()
                self._resolved[r.format] = (found, bool(found.where("problem is not null").head(1)))
            members, bad = self._resolved[r.format]
            if status != "ready" or bad:
                raise FormatFailed(r.format)
            out.append((members, negated))
        return out

    def _occurrences(self, ids: list[int]) -> DataFrame:
        """The occurrences, or, in a published index, those of the ids and of what stands for them, from the parts that hold any."""
        if "occurrences" not in self.ranged:
            return self.index["occurrences"]
        other = [r["canonical"] for r in self.index["aliases"].where(F.col("alias").isin(*ids)).select("canonical").distinct().collect()] if ids else []
        return self.ranged["occurrences"].with_keys(sorted({*ids, *other}))

    def _without_gaps(self, r: Request) -> bool:
        """Gaps hold no number, faction or ability: only requests without such filters need them."""
        return bool(r.stats or r.factions or any(r.effects) or r.support)

    def _rows(self, r: Request, indices: list[int]) -> DataFrame:
        """Whole rows of the named cards: of a published index, from the parts that hold them."""
        if self._without_gaps(r) and "cards" in self.ranged:
            return self.ranged["cards"].with_keys(indices)
        return (self.index["cards"] if self._without_gaps(r) else self.cards).where(F.col("card_index").isin(*indices))

    def matching(self, r: Request) -> DataFrame:
        cards = self.index["cards"] if self._without_gaps(r) else self.cards
        return conjunction(cards, r, self._occurrences([i for _, i, _ in r.ids()]), self.index["families"], self.index["aliases"].select("alias", "canonical"), self._members(r))

    def cards_of(self, query: str | Request) -> Answer:
        """One page. With families and no cursor: one card per family that has a match, in index order, and their counts."""
        r = self.request(query)
        if self._matches is not None:
            self._matches.unpersist()
        # Which cards match, and their families, are kept; the other columns are read for those that are shown.
        matches = self._matches = self.matching(r).select("card_index", "family_id").persist()
        total = matches.count()
        if r.with_families and r.cursor is None:
            facet = results.family_facet(matches, self.index["families"])
            # A card a family: few, as families are.
            shown = self._rows(r, sorted(x["first_card"] for x in facet.select("first_card").distinct().collect()))
            return Answer(self._objects(shown, r.debug), total, None, facet.orderBy("range_start"))
        rows = results.page(matches, r.cursor, r.limit)
        indices = [x["card_index"] for x in rows.select("card_index").collect()]
        some = self._rows(r, indices)
        return Answer(self._objects(some, r.debug), total, results.next_cursor(indices, r.limit))

    def _objects(self, cards: DataFrame, debug: bool = False) -> DataFrame:
        return results.card_objects(cards, self.index["families"], self.index["abilities"], debug).orderBy("card_index")

    def _one(self, text: str) -> DataFrame | None:
        """The card of a reference, without rows if it is a gap; None if no family holds it. The family's row gives the index,
        and the index the part to open."""
        r = read_reference(text)
        if r is None:
            return None
        same = (F.col("source_set") == r.source_set) & (F.col("faction") == r.faction) & (F.col("family_number") == r.family_number)
        family = self.index["families"].where(same).select("start_bit", "max_unique_id").first()
        if family is None or r.unique_id > family["max_unique_id"]:
            return None
        at = family["start_bit"] + r.unique_id - 1
        return self.ranged["cards"].with_keys([at]) if "cards" in self.ranged else self.index["cards"].where(F.col("card_index") == at)

    def card(self, text: str, debug: bool = False) -> DataFrame:
        """One card; a gap or a card without a faction isn't found."""
        if read_reference(text) is None:
            raise BadRequest(f"malformed reference '{text}'")
        one = self._one(text)
        one = one.where(F.col("faction_code") > 0) if one is not None else None
        if one is None or not one.head(1):
            raise NotFound(text)
        return self._objects(one, debug)

    def indexed_card(self, text: str) -> DataFrame:
        """As :meth:`card`, for maintenance: tells a gap from a corrupt record."""
        one = self._one(text)
        if one is None:
            raise NotFound(text)
        row = one.first()
        if row is None:
            raise NotFound(f"not indexed: {text}")
        if not row["faction_code"]:
            filled = any(row[c] for c in ("main_cost", "recall_cost", "mountain_power", "ocean_power", "forest_power"))
            raise InvalidData(f"corrupt record {text}") if filled else NotFound(f"not indexed: {text}")
        return self._objects(one)

    def slot_of(self, ids: list[int]) -> Slot:
        """The ids by their types, aliases replaced, each once; an unknown id, one of no such type, or no id is an error."""
        if not ids:
            raise BadRequest("no ids")
        wanted = canonical(self.spark.createDataFrame([(i, k, 0) for k, i in enumerate(ids)], "id_gd long, slot int, bucket int"), self.index["aliases"].select("alias", "canonical"))
        found = {r["slot"]: r for r in wanted.join(self.index["abilities"].select("id_gd", "element_type"), "id_gd").collect()}
        groups: dict[str, list[int]] = {kind: [] for kind in BUCKETS.values()}
        for k, i in enumerate(ids):
            if k not in found or found[k]["element_type"] not in groups:
                raise BadRequest(f"{'unknown id' if k not in found else 'id of no queried type'}: {i}")
            groups[found[k]["element_type"]].append(found[k]["id_gd"])
        return Slot(0, *(tuple(dict.fromkeys(g)) for g in groups.values()))

    def by_ids(self, ids: list[int], whole: bool = False, most: int | None = None) -> DataFrame:
        """Cards that have the ids of each type together on any one line, the support line included, or, if ``whole``,
        anywhere; in index order, as rows of reference, main and echo."""
        slot = self.slot_of(ids)
        picks, needed = picks_of(self.spark, [slot]), [bool(x) for x in slot.buckets]
        held = self._occurrences([i for b in slot.buckets for i in b])
        match = whole_card(held, picks, needed) if whole else line_match(held, picks, [(needed, LINES, 1)])
        rows = self.index["cards"].join(match, "card_index", "left_semi").orderBy("card_index")
        return (rows.limit(most) if most else rows).select("card_index", *results.table_row())

    def at_ranks(self, ranks: list[int], following: int = 1) -> DataFrame:
        """Of the published cards, in index order: those of the ranks, and the ``following`` - 1 after each."""
        return self.ranged["cards"].select(ranks, following)

    def effects(self) -> DataFrame:
        return results.effects_list(self.index["abilities"])

    def reachable(self, query: str) -> DataFrame:
        """Ids that the edited part of a slot can take together with all the other filters, sorted."""
        bucket, slot_index = editing((multimap(query).get("editing") or [""])[0])
        r = self.request(query)
        rest, slot = without_slot(r, slot_index)
        picks = canonical(picks_of(self.spark, [slot]), self.index["aliases"].select("alias", "canonical"))
        return results.reachable(self.matching(rest), self.index["occurrences"], self.index["abilities"], picks, slot, bucket, slot_index is None).orderBy("id_gd")
