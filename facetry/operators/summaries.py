"""Counts, audits, and time windows of index builds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetry.functions.references import FACTIONS
from facetry.plans.request import MOST_STAT

STATS = ("main_cost", "recall_cost", "mountain_power", "ocean_power", "forest_power")


def stat_histogram(cards: DataFrame) -> DataFrame:
    """(field, value, n) of the indexed values 0 to 15 that occur."""
    long = cards.select(F.explode(F.array(*(F.struct(F.lit(s).alias("field"), F.col(s).cast("int").alias("value")) for s in STATS))).alias("x")).select("x.*")
    return long.where(F.col("value").between(0, MOST_STAT)).groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))


def faction_counts(cards: DataFrame) -> DataFrame:
    """(faction, n) of all factions, those without cards too, and of cards without a known one as UN."""
    spark = cards.sparkSession
    known = spark.createDataFrame([*FACTIONS.items(), ("UN", 0)], "faction string, faction_code int")
    counts = cards.groupBy(F.col("faction_code").cast("int").alias("faction_code")).agg(F.count(F.lit(1)).alias("n"))
    return known.join(counts, "faction_code", "left").select("faction", F.coalesce("n", F.lit(0)).alias("n"))


def added(counts: list[DataFrame], *by: str) -> DataFrame:
    """Counts of several sets, added: sets share no card, so no card is looked at again."""
    every = counts[0]
    for other in counts[1:]:
        every = every.unionByName(other)
    return every.groupBy(*by).agg(F.sum("n").alias("n"))


def gaps(families: DataFrame, cards: DataFrame) -> DataFrame:
    """(family, unique_id, kind): numbers below a family's largest without a card (missing), or whose card has no faction
    (corrupt if it holds anything else, missing if not). Only families with gaps are unfolded,
    where their ``card_count`` is given."""
    key = F.concat(F.lit("ALT_"), F.col("source_set"), F.lit("_B_"), F.col("family_id")).alias("family")
    keys = ["source_set", "family_id", "unique_id"]
    short = families.where(F.col("card_count") < F.col("max_unique_id")) if "card_count" in families.columns else families
    numbers = short.select("source_set", "family_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("max_unique_id").cast("long"))).alias("unique_id"))
    held = cards.withColumn("unique_id", F.col("unique_id").cast("long"))
    missing = numbers.join(held.select(*keys), keys, "left_anti").select(key, "unique_id", F.lit("missing").alias("kind"))
    tail = F.greatest(*(F.col(s) for s in STATS)) > 0
    empty = held.where("faction_code is null or faction_code = 0").select(key, "unique_id", F.when(tail, "corrupt").otherwise("missing").alias("kind"))
    return missing.union(empty)


def gap_report(families: DataFrame, cards: DataFrame) -> DataFrame:
    """(family, missing, corrupt): numbers in order."""
    of = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("unique_id")))).alias(kind)
    return gaps(families, cards).groupBy("family").agg(of("missing"), of("corrupt"))


def index_percentile(n: Column, p: int) -> Column:
    """The 1-based place of a percentile among ``n`` sorted values: (n - 1) * p / 100, rounded down, plus 1."""
    return F.floor((n - 1) * p / 100) + 1


def timings(samples: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, least, p50, p95, mean and most of each group. Ranks are found within a group by value; equal values are counted
    first, so a group's values are never gathered in one row."""
    counts = samples.groupBy(*by, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    own = Window.partitionBy(*by).orderBy("v")
    ranked = counts.withColumn("hi", F.sum("c").over(own)).withColumn("n", F.sum("c").over(Window.partitionBy(*by)))
    at = lambda p: F.min(F.when(F.col("hi") >= index_percentile(F.col("n"), p), F.col("v"))).alias(f"p{p}")
    return ranked.groupBy(*by).agg(F.max("n").alias("n"), F.min("v").alias("least"), at(50), at(95), (F.sum(F.col("v") * F.col("c")) / F.max("n")).alias("mean"), F.max("v").alias("most"))


def shares(totals: DataFrame, value: str) -> DataFrame:
    """Adds each row's percentage of the sum; the sum comes from one aggregate row."""
    total = totals.agg(F.sum(value).alias("_all"))
    return totals.crossJoin(F.broadcast(total)).withColumn("percent", F.when(F.col("_all") > 0, 100 * F.col(value) / F.col("_all")).otherwise(0.0)).drop("_all")


def rolling(samples: DataFrame, by: list[str], at: str, value: str, seconds: int = 5) -> DataFrame:
    """Adds n_recent and recent: number and mean of the values of the last ``seconds``."""
    recent = Window.partitionBy(*by).orderBy(F.unix_micros(F.col(at).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return samples.withColumns({"n_recent": F.count(value).over(recent), "recent": F.avg(value).over(recent)})


def tick_rate(samples: DataFrame, at: str, seconds: int = 1) -> DataFrame:
    """(tick, done, per_second) of each tumbling window that has any."""
    ticks = samples.groupBy(F.window(at, f"{seconds} seconds").alias("w")).agg(F.count(F.lit(1)).alias("done"))
    return ticks.select(F.col("w.start").alias("tick"), "done", (F.col("done") / seconds).alias("per_second"))


def seconds_left(done: Column, total: Column, per_second: Column) -> Column:
    """Whole seconds until ``total`` at the given rate; null without a rate, 0 when all is done."""
    return F.when(per_second > 0, F.greatest(F.ceil((total - done) / per_second), F.lit(0)))
