"""Requests: what a query string may ask, checked and put into one flat conjunction."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from urllib.parse import parse_qsl

from facetry.errors import BadRequest
from facetry.functions.references import FACTIONS

STATS = {"mainCost": "main_cost", "recallCost": "recall_cost", "forestPower": "forest_power", "mountainPower": "mountain_power", "oceanPower": "ocean_power"}
BUCKETS = {"t": "TRIGGER", "c": "CONDITION", "o": "OUTPUT"}
BOUNDS = ("gt", "gte", "lt", "lte")
MOST_STAT, MOST_ID, MOST_PAGE, PAGE = 15, 2**32 - 1, 200, 50


@dataclass(frozen=True)
class Slot:
    """Ids wanted together on one line, on at least ``match_count`` lines. ``index`` is the caller's number of it."""

    index: int = 0
    t: tuple[int, ...] = ()
    c: tuple[int, ...] = ()
    o: tuple[int, ...] = ()
    match_count: int = 1

    @property
    def buckets(self) -> tuple[tuple[int, ...], ...]:
        return self.t, self.c, self.o

    def __bool__(self) -> bool:
        return any(self.buckets)


@dataclass(frozen=True)
class Stat:
    """``op`` is one of ``in``, ``gt``, ``gte``, ``lt``, ``lte``."""

    op: str
    values: tuple[int, ...]


@dataclass(frozen=True)
class Request:
    sets: tuple[str, ...] = ()
    factions: tuple[str, ...] = ()
    refs: tuple[str, ...] = ()
    name: str | None = None
    format: str | None = None
    collection: str | None = None
    stats: dict[str, Stat] = field(default_factory=dict)
    effects: tuple[Slot, ...] = ()
    effect_mode: str = "and"
    support: Slot = Slot()
    limit: int = PAGE
    cursor: int | None = None
    with_families: bool = False
    debug: bool = False

    def ids(self) -> list[tuple[str, int, str]]:
        """(parameter, id, wanted type) of every ability named."""
        groups = [(f"effect[{s.index}]", s) for s in self.effects] + [("support", self.support)]
        return [(f"{name}[{b}]", i, kind) for name, slot in groups for (b, kind), ids in zip(BUCKETS.items(), slot.buckets) for i in ids]


def multimap(query: str) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for key, value in parse_qsl(query.lstrip("?"), keep_blank_values=True):
        out.setdefault(key, []).append(value)
    return out


def number(name: str, text: str, most: int = MOST_ID) -> int:
    if not re.fullmatch(r"\+?[0-9]+", text, re.ASCII) or int(text) > most:
        raise BadRequest(f"invalid {name} value '{text}'")
    return int(text)


def _split(values: list[str]) -> list[str]:
    return [p.strip() for v in values for p in v.split(",") if p.strip()]


def _distinct(params: dict[str, list[str]], name: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys(_split(params.get(f"{name}[]", []) + params.get(name, []))))


def _last(params: dict[str, list[str]], name: str) -> str | None:
    filled = [v.strip() for v in params.get(name, []) if v.strip()]
    return filled[-1] if filled else None


def _first(params: dict[str, list[str]], name: str) -> str:
    return params.get(name, [""])[0].strip()


def _ids(params: dict[str, list[str]], name: str) -> tuple[int, ...]:
    return tuple(number(name, x) for x in _split(params.get(name, [])))


def _slots(params: dict[str, list[str]]) -> tuple[Slot, ...]:
    slots: dict[int, dict] = {}
    for key in params:
        if not key.startswith("effect["):
            continue
        m = re.fullmatch(r"effect\[([^\]]+)\]\[(t|c|o|matchCount)\]", key)
        if not m:
            raise BadRequest(f"invalid effect parameter '{key}'")
        own = slots.setdefault(number("effect slot index", m[1]), {})
        if m[2] == "matchCount":
            own["match_count"] = number(key, _first(params, key), 3)
            if not own["match_count"]:
                raise BadRequest(f"invalid {key}: expected 1, 2 or 3")
        else:
            own[m[2]] = _ids(params, key)
    return tuple(s for i, own in sorted(slots.items()) if (s := Slot(i, **own)))


def _stat(params: dict[str, list[str]], name: str) -> Stat | None:
    filled = lambda key: any(v.strip() for v in params.get(key, []))
    forms = [filled(name), filled(f"{name}[]"), any(filled(f"{name}[{b}]") for b in BOUNDS)]
    if sum(forms) > 1:
        raise BadRequest(f"{name}, {name}[] and {name}[gt|gte|lt|lte] can't be mixed")
    if forms[0]:
        text = _first(params, name)
        return Stat("in", (number(name, text, MOST_STAT),)) if text else None
    if forms[1]:
        values = tuple(dict.fromkeys(number(name, x, MOST_STAT) for x in _split(params[f"{name}[]"])))
        return Stat("in", values) if values else None
    for bound in BOUNDS:  # only the first one counts
        if text := _first(params, f"{name}[{bound}]"):
            return Stat(bound, (number(name, text, MOST_STAT),))
    return None


def parse(query: str | dict[str, list[str]]) -> Request:
    """Reads a query string; names of sets, ids, formats and collections are checked against data by the engine."""
    params = multimap(query) if isinstance(query, str) else query
    factions = _distinct(params, "faction")
    if unknown := [f for f in factions if f not in FACTIONS]:
        raise BadRequest(f"invalid faction value '{unknown[0]}'")
    mode = _first(params, "effectMode").lower() if "effectMode" in params else "and"
    if mode not in ("and", "or"):
        raise BadRequest(f"invalid effectMode value '{mode}'")
    limit = number("limit", _first(params, "limit")) if "limit" in params else PAGE
    if not 1 <= limit <= MOST_PAGE:
        raise BadRequest(f"limit must be 1 to {MOST_PAGE}")
    truth = lambda name: name in params and _first(params, name).lower() in ("", "1", "true")
    return Request(
        sets=_distinct(params, "set"), factions=factions, refs=_distinct(params, "ref"), name=_first(params, "name") or None,
        format=_last(params, "format"), collection=_last(params, "collection"), stats={column: s for name, column in STATS.items() if (s := _stat(params, name))},
        effects=_slots(params), effect_mode=mode, support=Slot(0, *(_ids(params, f"support[{b}]") for b in BUCKETS)),
        limit=limit, cursor=number("cursor", _first(params, "cursor")) if "cursor" in params else None, with_families=truth("withFamilies"), debug=truth("debug_bga_trigram"),
    )


def editing(text: str | None) -> tuple[str, int | None]:
    """(bucket, slot number, or None for the support line) of ``<trigger|condition|output>:<number|support>``."""
    part, colon, region = (text or "").strip().partition(":")
    names = {kind.lower(): b for b, kind in BUCKETS.items()}
    if not colon or part not in names:
        raise BadRequest("editing must be <trigger|condition|output>:<number|support>")
    return names[part], None if region == "support" else number("editing", region)


def compose(request: Request) -> str:
    """The query string of a request: defaults left out, empty slots dropped and the rest numbered from 0, limit kept in
    bounds, one value of a stat as itself and several as a list."""
    from urllib.parse import urlencode

    out: list[tuple[str, str]] = [*(("set[]", s) for s in request.sets), *(("faction[]", f) for f in request.factions), *(("ref[]", r) for r in request.refs)]
    out += [(k, v) for k, v in (("name", (request.name or "").strip()), ("format", request.format), ("collection", request.collection)) if v]
    for name, column in STATS.items():
        if s := request.stats.get(column):
            out.append((name if len(s.values) == 1 else f"{name}[]", ",".join(map(str, s.values))) if s.op == "in" else (f"{name}[{s.op}]", str(s.values[0])))
    for i, slot in enumerate(s for s in request.effects if s):
        out += [(f"effect[{i}][{b}]", ",".join(map(str, ids))) for b, ids in zip(BUCKETS, slot.buckets) if ids]
        if slot.match_count > 1:
            out.append((f"effect[{i}][matchCount]", str(slot.match_count)))
    out += [("effectMode", "or")] * (request.effect_mode == "or")
    out += [(f"support[{b}]", ",".join(map(str, ids))) for b, ids in zip(BUCKETS, request.support.buckets) if ids]
    out.append(("limit", str(min(max(request.limit, 1), MOST_PAGE))))
    if request.cursor is not None:
        out.append(("cursor", str(request.cursor)))
    return urlencode(out + [("withFamilies", "1")] * request.with_families + [("debug_bga_trigram", "1")] * request.debug)


def compacted(request: Request, index: int) -> int | None:
    """The number that the slot of this index gets from :func:`compose`, or None if it is empty."""
    filled = [s.index for s in request.effects if s]
    return filled.index(index) if index in filled else None


def cost_values(text: str) -> list[int]:
    """``1,3-5`` as sorted distinct numbers from 0 to 15."""
    out: set[int] = set()
    for part in text.split(","):
        lo, dash, hi = part.strip().partition("-")
        a = number("cost", lo.strip(), MOST_STAT)
        b = number("cost", hi.strip(), MOST_STAT) if dash else a
        if a > b:
            raise BadRequest(f"invalid range '{part.strip()}'")
        out |= set(range(a, b + 1))
    return sorted(out)


def without_slot(request: Request, index: int | None) -> tuple[Request, Slot]:
    """(the request without one slot or, for None, the support line; that slot)."""
    if index is None:
        return replace(request, support=Slot()), request.support
    own = next((s for s in request.effects if s.index == index), Slot(index))
    return replace(request, effects=tuple(s for s in request.effects if s.index != index)), own
