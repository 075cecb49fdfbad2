"""Record references, factions and sets."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Faction letters by code, their names, and the codes shown for sets.
FACTIONS = {"AX": 1, "BR": 2, "LY": 3, "MU": 4, "OR": 5, "YZ": 6}
FACTION_NAMES = {"AX": "Axiom", "BR": "Bravos", "LY": "Lyra", "MU": "Muna", "OR": "Ordis", "YZ": "Yzmir"}
SET_CODES = {"CORE": "BTG", "COREKS": "BTG", "ALIZE": "TBF", "BISE": "WFM", "CYCLONE": "SKY", "DUSTER": "SDU", "EOLE": "ROC"}
UNKNOWN_FACTION = "UN"

# Fixed format of references: set (parts joined by single underscores), faction, family number, unique number.
REFERENCE = r"ALT_([^_]+(?:_[^_]+)*)_B_([A-Z]{2})_([0-9]+)_U_([0-9]+)"
MOST_UID = 2**32 - 1


@dataclass(frozen=True)
class Reference:
    source_set: str
    faction: str
    family_number: str
    unique_id: int

    def __str__(self) -> str:
        return f"ALT_{self.source_set}_B_{self.faction}_{self.family_number}_U_{self.unique_id}"


def read_reference(text: str) -> Reference | None:
    """One request value; None if it isn't a reference or its number is 0 or too large."""
    m = re.fullmatch(REFERENCE, text.strip(), re.ASCII)
    return Reference(m[1], m[2], m[3], int(m[4])) if m and 1 <= int(m[4]) <= MOST_UID else None


def parsed(text: Column) -> Column:
    """Struct (source_set, faction, family_number, unique_id) of a reference, null if it is none."""
    part = lambda i: F.regexp_extract(text, rf"\A{REFERENCE}\z", i)
    uid = part(4).try_cast("decimal(38,0)")
    whole = F.struct(part(1).alias("source_set"), part(2).alias("faction"), part(3).alias("family_number"), uid.cast("long").alias("unique_id"))
    return F.when(text.rlike(rf"\A{REFERENCE}\z") & uid.between(1, MOST_UID), whole)


def reference(source_set: Column, faction: Column, number: Column, uid: Column) -> Column:
    return F.concat(F.lit("ALT_"), source_set, F.lit("_B_"), faction, F.lit("_"), number, F.lit("_U_"), uid.cast("string"))


def family_id(faction: Column, number: Column) -> Column:
    return F.concat_ws("_", faction, number)


def _mapped(pairs: dict, key: Column, other: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv)), key), other)


def faction_code(letters: Column) -> Column:
    """1 to 6, or 0 for any other value or null."""
    return _mapped(FACTIONS, F.coalesce(letters, F.lit("")), F.lit(0))


def faction_letters(code: Column) -> Column:
    return _mapped({v: k for k, v in FACTIONS.items()}, code.cast("int"), F.lit(UNKNOWN_FACTION))


def faction_name(code: Column) -> Column:
    return _mapped({v: FACTION_NAMES[k] for k, v in FACTIONS.items()}, code.cast("int"), F.lit(""))


def set_code(source_set: Column) -> Column:
    """Null for a set without a shown code."""
    return _mapped(SET_CODES, source_set, F.lit(None).cast("string"))


def family_order(faction: Column, number: Column) -> list[Column]:
    """Sort keys of families: rank of the faction (255 if unknown), then the number (last if it is none)."""
    rank = _mapped({k: v - 1 for k, v in FACTIONS.items()}, faction, F.lit(255))
    return [rank, F.coalesce(number.try_cast("long"), F.lit(MOST_UID))]


def family_parts(family: Column) -> Column:
    """Struct (faction, number) of a family id: its first two parts; 0 where the second is no number of 32 bits."""
    digits = F.split_part(family, F.lit("_"), F.lit(2))
    number = F.when(digits.rlike(r"\A\+?[0-9]+\z"), digits.try_cast("decimal(38,0)"))
    return F.struct(F.split_part(family, F.lit("_"), F.lit(1)).alias("faction"), F.coalesce(F.when(number <= MOST_UID, number.cast("long")), F.lit(0)).alias("number"))
