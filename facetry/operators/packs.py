"""Packs of abilities that some line holds together, grown level by level.

A pack is a set of ids. Those of one type stand for one another; a pack is *viable* if some line (or card) has an id of every
type that the pack has. All packs are grown in one table: a level proposes a few ids to each, tests all proposals with one
join against the lines that have several ids, and keeps each pack's first viable proposal. This
draws uniformly among the viable ids, by rejection; a pack whose proposals all fail is dropped.

The draws are bits of md5 digests of (seed, pack, level, try), so a run can be repeated anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetry.operators.matching import LINES
from facetry.plans.request import BUCKETS
from facetry.sources.scratch import stored

#: Bits of the three types.
BITS = {kind: 1 << i for i, kind in enumerate(BUCKETS.values())}


def catalogue(abilities: DataFrame, occurrences: DataFrame, whole: bool = False) -> DataFrame:
    """(position, id_gd, bit): abilities of the three types that stand on a line, or, if ``whole``, anywhere; others are in no
    answer even alone. Numbered from 0 in the order of ids: the window is over abilities."""
    held = occurrences if whole else occurrences.where(F.col("line").isin(*LINES))
    bit = F.lit(0)
    for kind, b in BITS.items():
        bit = F.when(F.col("element_type") == kind, b).otherwise(bit)
    alone = abilities.select("id_gd", bit.alias("bit")).where("bit > 0").join(held.select("id_gd"), "id_gd", "left_semi")
    return alone.withColumn("position", (F.row_number().over(Window.orderBy("id_gd")) - 1).cast("long"))


def drawn(seed: int, level: int, tries: Column, size: Column) -> Column:
    """A position below ``size``."""
    text = F.concat_ws(":", F.lit(seed), F.col("pack"), F.lit(level), tries)
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % size


def together(occurrences: DataFrame, whole: bool = False) -> DataFrame:
    """(on): the ids of each line, or card, that has several."""
    held = occurrences if whole else occurrences.where(F.col("line").isin(*LINES))
    line = F.lit(0) if whole else F.array_position(F.array(*map(F.lit, LINES)), F.col("line")).cast("int")
    rows = held.select("card_index", line.alias("at"), "id_gd").repartition("card_index", "at")
    return rows.groupBy("card_index", "at").agg(F.collect_set("id_gd").alias("on")).where(F.size("on") > 1).select("on")


def viable(proposals: DataFrame, occurrences: DataFrame, whole: bool = False, lines: DataFrame | None = None) -> DataFrame:
    """Of (pack, try, ids) with ids an array of (id_gd, bit): those that some line, or card, holds. ``lines``: a kept table of
    :func:`together`, from callers all of whose ids stand on some line.

    A pack of one type needs a line with any of its ids. One of several types needs a line with several ids: it goes, with
    the ids of its type that has the fewest, to the lines that hold one of these, and each such line is tested as it
    comes, so that (proposal, line) pairs are never dealt out."""
    need = F.aggregate("ids", F.lit(0), lambda a, x: a.bitwiseOR(x["bit"]))
    asked = proposals.withColumn("need", need).where("need > 0")
    single = F.expr("need & (need - 1) = 0")
    one, several = asked.where(single), asked.where(~single)
    if lines is None:
        held = (occurrences if whole else occurrences.where(F.col("line").isin(*LINES))).select(F.col("id_gd").alias("_id")).distinct()
        one = one.withColumn("x", F.explode("ids")).join(held, F.col("x.id_gd") == F.col("_id"), "left_semi").drop("x")
        lines = together(occurrences, whole)
    of = lambda b: F.filter("ids", lambda x: x["bit"] == b)
    rarest = F.array_min(F.array(*(F.when(F.size(of(b)) > 0, F.struct(F.size(of(b)).alias("n"), F.lit(b).alias("b"))) for b in BITS.values())))["b"]
    sent = several.withColumn("rarest", rarest).withColumn("x", F.explode(F.filter("ids", lambda x: x["bit"] == F.col("rarest")))).withColumn("_id", F.col("x.id_gd"))
    places = lines.select("on", F.explode("on").alias("_place"))
    mask = F.aggregate("ids", F.lit(0), lambda a, x: F.when(F.array_contains("on", x["id_gd"]), a.bitwiseOR(x["bit"])).otherwise(a))
    found = sent.join(places, (F.col("_id") == F.col("_place")) & (mask == F.col("need")), "left_semi")
    return one.select("pack", "try", "ids").union(found.select("pack", "try", "ids")).distinct()


def grown(packs: DataFrame, abilities: DataFrame, occurrences: DataFrame, size: int, tries: int = 8, seed: int = 0, whole: bool = False) -> DataFrame:
    """(pack) -> (pack, ids): a viable pack of ``size`` distinct ids, sorted, for each number that none of ``tries`` draws a level
    has failed. The loop is over levels; no pack or id comes to the driver."""
    # Each level draws from it: numbered once.
    ids = stored(catalogue(abilities, occurrences, whole))
    counted = ids.agg(F.count(F.lit(1)).alias("size"))
    member = F.struct("id_gd", F.col("bit").cast("int").alias("bit"))
    lines = stored(together(occurrences, whole))
    # One row of one number.
    asked = packs.select("pack").distinct().crossJoin(F.broadcast(counted)).where("size > 0")
    out = asked.withColumn("position", drawn(seed, 0, F.lit(0), F.col("size"))).join(ids, "position").select("pack", "size", F.array(member).alias("ids"))
    for level in range(1, size):
        proposed = out.withColumn("try", F.explode(F.sequence(F.lit(0), F.lit(tries - 1)))).withColumn("position", drawn(seed, level, F.col("try"), F.col("size")))
        new = proposed.join(ids, "position").where(~F.exists("ids", lambda x: x["id_gd"] == F.col("id_gd")))
        found = viable(new.select("pack", "try", F.array_sort(F.concat("ids", F.array(member))).alias("ids")), occurrences, whole, lines)
        out = found.groupBy("pack").agg(F.min(F.struct("try", "ids"))["ids"].alias("ids")).crossJoin(F.broadcast(counted))
    return out.select("pack", F.transform("ids", lambda x: x["id_gd"]).alias("ids"))
