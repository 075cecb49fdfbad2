"""Which cards have abilities together on one line: one scan of occurrences and one aggregation.

Every wanted id has a bit for each (slot, bucket) that lists it. An occurrence contributes these bits, shifted by its
line, to its card's mask; ``bit_or`` combines them in the map side already, so the only shuffle carries one row per card
and task that has any wanted id, however many slots, buckets and lines are asked for. The conditions are then integer
arithmetic on the mask.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetry.plans.request import Slot

LINES = ("m1", "m2", "m3", "ec")
MAIN, SUPPORT = ("m1", "m2", "m3"), ("ec",)
#: Bits of a slot: four lines of three buckets. A 64-bit word holds five slots.
WIDTH, PER_WORD = 12, 5
#: Ids of a request up to which they are broadcast (24 bytes each).
BROADCAST_IDS = 100_000


def picks_of(spark, slots: Sequence[Slot]) -> DataFrame:
    """(id_gd, slot, bucket) of a request."""
    rows = [(i, k, b) for k, slot in enumerate(slots) for b, ids in enumerate(slot.buckets) for i in ids]
    picks = spark.createDataFrame(rows, "id_gd long, slot int, bucket int")
    return F.broadcast(picks) if len(rows) <= BROADCAST_IDS else picks


def canonical(picks: DataFrame, aliases: DataFrame | None) -> DataFrame:
    """Alias ids replaced by the ids they stand for."""
    if aliases is None:
        return picks
    return picks.join(aliases, picks["id_gd"] == aliases["alias"], "left").select(F.coalesce("canonical", "id_gd").alias("id_gd"), "slot", "bucket").distinct()



def masks(occurrences: DataFrame, picks: DataFrame, n_slots: int) -> DataFrame:
    """(card_index, mask_0, mask_1, ...): bits of slots, lines and buckets."""
    words = -(-n_slots // PER_WORD)
    of_word = lambda w: F.coalesce(F.bit_or(F.when(F.floor(F.col("slot") / PER_WORD) == w, F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("slot") % PER_WORD * WIDTH + F.col("bucket")).cast("int")))), F.lit(0)).alias(f"_w{w}")
    per_id = picks.groupBy("id_gd").agg(*map(of_word, range(words)))
    line = F.array_position(F.array(*map(F.lit, LINES)), F.col("line")).cast("int") - 1
    wanted = occurrences.where(F.col("line").isin(*LINES)).select("card_index", "id_gd", (3 * line).alias("_by"))
    hits = wanted.join(per_id, "id_gd")
    return hits.groupBy("card_index").agg(*(F.bit_or(F.call_function("shiftleft", F.col(f"_w{w}"), F.col("_by"))).alias(f"mask_{w}") for w in range(words)))


def on_line(k: int, needed: Sequence[bool], line: str) -> Column:
    """Whether slot ``k`` has all its needed buckets on ``line``."""
    need = sum(1 << b for b, n in enumerate(needed) if n)
    shift = k % PER_WORD * WIDTH + 3 * LINES.index(line)
    return F.shiftright(F.col(f"mask_{k // PER_WORD}"), shift).bitwiseAND(need) == need


def lines_matched(k: int, needed: Sequence[bool], lines: Sequence[str]) -> Column:
    return reduce(lambda a, b: a + b, (on_line(k, needed, line).cast("int") for line in lines))


def line_match(occurrences: DataFrame, picks: DataFrame, slots: Sequence[tuple[Sequence[bool], Sequence[str], int]], mode: str = "and") -> DataFrame:
    """Cards that meet the slots, all or any. A slot: which buckets are asked for, the lines, and on how many of these."""
    tests = [lines_matched(k, needed, lines) >= least for k, (needed, lines, least) in enumerate(slots)]
    both = reduce(lambda a, b: a & b if mode == "and" else a | b, tests)
    return masks(occurrences, picks, len(slots)).where(both).select("card_index")


def request_match(occurrences: DataFrame, aliases: DataFrame | None, effects: Sequence[Slot], mode: str, support: Slot) -> DataFrame | None:
    """Cards that meet a request's effect slots on the main lines, by ``mode``, and its support slot; None if it has none."""
    slots = [*effects, *([support] if support else [])]
    if not slots:
        return None
    picks = canonical(picks_of(occurrences.sparkSession, slots), aliases)
    has = [[bool(ids) for ids in s.buckets] for s in slots]
    tests = [lines_matched(k, has[k], MAIN) >= s.match_count for k, s in enumerate(effects)]
    test = reduce(lambda a, b: a & b if mode == "and" else a | b, tests) if tests else F.lit(True)
    if support:
        test = test & on_line(len(slots) - 1, has[-1], SUPPORT[0])
    return masks(occurrences, picks, len(slots)).where(test).select("card_index")


def whole_card(occurrences: DataFrame, picks: DataFrame, needed: Sequence[bool]) -> DataFrame:
    """Cards that have an id of every needed bucket anywhere, on different lines or on none."""
    test = reduce(lambda a, b: a & b, (F.bool_or(F.col("bucket") == b) for b, n in enumerate(needed) if n))
    return occurrences.select("card_index", "id_gd").join(picks, "id_gd").groupBy("card_index").agg(test.alias("ok")).where("ok").select("card_index")
