"""One canonical id for abilities that several sets or merges have tied together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.sources.scratch import settled


def united(pairs: DataFrame) -> DataFrame:
    """(alias, canonical) pairs of any number of sets -> one canonical id for each alias.

    Pairs link ids; a linked group's canonical id is the least that no pair calls an alias or, if pairs go round in a
    circle, the least that some pair calls canonical. Where no alias is canonical elsewhere and none has two canonical ids,
    the pairs stay as they are. Else labels go along the links and double their reach each round (least label of the
    neighbours, then the label's label), until none changes. Pairs of equal or null ids don't count."""
    pairs = settled(pairs.select("alias", "canonical").where("alias <> canonical").distinct())
    twice = pairs.groupBy("alias").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("alias")
    chained = pairs.select(F.col("canonical").alias("alias")).join(pairs, "alias", "left_semi")
    if not twice.union(chained).head(1):
        return pairs
    links = pairs.select(F.col("alias").alias("a"), F.col("canonical").alias("b"))
    links = settled(links.union(links.select("b", "a")))
    labels = settled(links.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).withColumnRenamed("a", "node"))
    while True:
        near = links.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        step = settled(labels.join(near, F.col("node") == F.col("a")).select("node", F.least("label", "near").alias("next"), "label"))
        jump = step.select(F.col("node").alias("_node"), F.col("next").alias("_next"))
        new = settled(step.join(jump, F.col("next") == F.col("_node"), "left").select("node", F.least("next", F.coalesce("_next", "next")).alias("label"), F.col("label").alias("was")))
        moved = new.where("label <> was").head(1)
        labels = new.select("node", "label")
        if not moved:
            break
    called = pairs.select(F.col("alias").alias("node"), F.lit(True).alias("alias_"), F.lit(False).alias("canonical_")).union(pairs.select("canonical", F.lit(False), F.lit(True)))
    called = called.groupBy("node").agg(F.bool_or("alias_").alias("alias_"), F.bool_or("canonical_").alias("canonical_"))
    known = labels.join(called, "node")
    root = F.coalesce(F.min(F.when(~F.col("alias_"), F.col("node"))), F.min(F.when(F.col("canonical_"), F.col("node"))))
    roots = known.groupBy("label").agg(root.alias("canonical"))
    return known.join(roots, "label").where("node <> canonical").select(F.col("node").alias("alias"), "canonical")
