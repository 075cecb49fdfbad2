"""Text expressions that stay in Catalyst."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_BREAK_SPACE = "\u00a0"


@lru_cache(1)
def _folding() -> tuple[str, str]:
    """Letters that decompose to one letter with marks, and those letters."""
    source, target = [], []
    for code in range(128, sys.maxunicode + 1):
        if 0xD800 <= code < 0xE000 or 0xAC00 <= code < 0xD7A4:
            continue
        c = chr(code)
        bare = [x for x in unicodedata.normalize("NFD", c) if not unicodedata.category(x).startswith("M")]
        if len(bare) == 1 and bare[0] != c and code < 0x10000:
            source.append(c)
            target.append(bare[0])
    return "".join(source), "".join(target)


def fold(text: Column) -> Column:
    """Without accents and case: decomposed, marks dropped, lowered."""
    return F.lower(F.regexp_replace(F.translate(text, *_folding()), r"\p{M}", ""))


def fold_word(text: str) -> str:
    """:func:`fold` of a request value."""
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.category(c).startswith("M")).lower()


def one_space(text: Column) -> Column:
    """Each run of white space, no-break spaces included, as one space; ends stay."""
    return F.regexp_replace(text, r"\p{IsWhite_Space}+", " ")


def has_no_break_space(text: Column) -> Column:
    return F.contains(text, F.lit(NO_BREAK_SPACE))


def small_number(text: Column, most: int = 255) -> Column:
    """The integer that ``text`` spells in digits, with or without a plus sign, if it is at most ``most``; else null."""
    value = F.when(text.rlike(r"\A\+?[0-9]+\z"), text.try_cast("decimal(38,0)"))
    return F.when(value <= most, value.cast("long"))


def listed(text: Column) -> Column:
    """Comma-separated values, trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def in_locale(names: Column, locale: str) -> Column:
    """A map's value for ``locale``, else for en_US, else for the first key in order, else ''."""
    first = F.try_element_at(F.array_sort(F.map_keys(names)), F.lit(1))
    return F.coalesce(F.try_element_at(names, F.lit(locale)), F.try_element_at(names, F.lit("en_US")), F.try_element_at(names, first), F.lit(""))


def shown_in(names: Column, locale: str) -> Column:
    """As :func:`in_locale`, but en_us is tried after en_US."""
    first = F.try_element_at(F.array_sort(F.map_keys(names)), F.lit(1))
    return F.coalesce(*(F.try_element_at(names, F.lit(k)) for k in (locale, "en_US", "en_us")), F.try_element_at(names, first), F.lit(""))
