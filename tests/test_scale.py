"""What a build leaves on disk, and what it deals out."""

import tempfile
from pathlib import Path

from pyspark.sql import functions as F

from facetry.operators import ingest, packs
from facetry.plans import adapter
from facetry.sources import store
from facetry.sources.ranged import STRIDE, Ranged, write_ranged
from facetry.sources.scratch import stored, thinned

SMALL = "/root/testdata/sf0.001"


def shuffled(spark):
    return sum(p.stat().st_size for p in Path(spark.conf.get("spark.local.dir")).rglob("shuffle_*.data"))


def test_publish_leaves_no_shuffle_files(spark):
    documents = stored(adapter.documents(spark, SMALL))
    before = shuffled(spark)
    store.publish(ingest.build(documents), tempfile.mkdtemp(prefix="spark-", dir="/tmp"), 1, 4096, ("occurrences",))
    assert shuffled(spark) <= before + 100_000


def test_tasks_write_several_parts(spark):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/t"
    write_ranged(spark.range(3000).selectExpr("id as k").repartition(3), path, ["k"], 100)
    parts = [r["part"] for r in Ranged.read(spark, path, ["k"]).parts.collect()]
    assert len(parts) == 30 and len({p // STRIDE for p in parts}) == 1


def test_thinned_keeps_all_that_match(spark):
    rows = spark.range(2000).selectExpr("id as a", "id % 7 as b")
    kept = thinned(rows, rows.where("a % 10 = 0"), "a", "b")
    assert kept.where("a % 10 = 0").count() == 200 and kept.count() < 400


def test_packs_meet_lines_without_dealing_out_pairs(spark):
    ids = spark.createDataFrame([(1, 0, [(1, 1), (2, 2)]), (2, 0, [(1, 1), (3, 2)]), (3, 0, [(1, 1), (4, 1)]), (4, 0, [(9, 1)])], "pack long, try int, ids array<struct<id_gd:long,bit:int>>")
    held = spark.createDataFrame([(1, "m1", 1), (1, "m1", 2), (2, "m1", 1), (2, "m2", 3), (3, None, 9)], "card_index long, line string, id_gd long")
    found = packs.viable(ids, held)
    assert sorted(r["pack"] for r in found.collect()) == [1, 3]
    assert sorted(r["pack"] for r in packs.viable(ids, held, whole=True).collect()) == [1, 2, 3, 4]
    assert "bit_or" not in found._jdf.queryExecution().executedPlan().toString()


def test_first_seen_is_the_earliest(spark):
    rows = [(7, 2, "B", "later", 0), (7, 1, "A", "second", 1), (7, 1, "A", "first", 0), (8, 5, "C", "own", 3)]
    seen = spark.createDataFrame(rows, "id_gd long, card_index long, element_type string, text string, at int").withColumn("translations", F.create_map(F.lit("en_US"), "text"))
    assert {r["id_gd"]: (r["element_type"], r["translations"]["en_US"]) for r in ingest.first_seen(seen).collect()} == {7: ("A", "first"), 8: ("C", "own")}
