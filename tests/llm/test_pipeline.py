"""Every stage on all that the one before kept, against plain restatements."""

import re
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from facetry.llm import minhash
from facetry.llm.pii import base_spans
from facetry.llm.shared import table


def test_stages(spark, odd):
    docs = table(spark, odd, "documents")
    alone = " ".join(f"alone{k}" for k in range(80))
    docs = docs.union(docs.limit(1).withColumns({"doc_id": F.lit(None).cast("long"), "text": F.lit(alone)}))
    names = docs.columns
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = stage(spark, docs, odd)
        place = f"{corpus_pipeline.shared_folder(spark)}/test-{k}-{id(out)}"
        out.write.parquet(place)
        docs = spark.read.parquet(place)
        if name == "packing":
            break
        assert docs.columns == names
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        kept[name] = (before, after)
    before, after = kept["quality"]
    assert 0 < len(after) < len(before) and all(len(re.findall(r"[^\x20\x09-\x0D]+", t)) >= 50 for t in after.values())
    before, after = kept["near-duplicates"]
    assert Counter(before.values()).most_common(1)[0][1] > 1 and max(Counter(after.values()).values()) == 1
    before, after = kept["suffixes"]
    assert set(before) == set(after)
    seen = Counter(b[k : k + 240] for t in before.values() for b in [t.encode()] for k in range(len(b) - 239))
    for i, t in before.items():
        clean = all(seen[t.encode()[k : k + 240]] == 1 for k in range(len(t.encode()) - 239))
        assert (after[i] == t) == clean
    before, after = kept["personal-data"]
    assert set(before) == set(after) and not any(base_spans(t) for t in after.values())
    assert {r["doc_id"] for r in docs.collect()} == set(after)


def test_empty(spark, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_five_words_and_percent():
    assert minhash.WORDS == 5 and minhash.PERCENT >= 80


def test_near_copies_from_four_fifths(spark):
    words = [f"w{k}" for k in range(204)]
    other = [w + "x" if k in (20, 70, 120, 170) else w for k, w in enumerate(words)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other))], "doc_id long, text string")
    assert [r["doc_id"] for r in corpus_pipeline.keep_one_of_each_group(spark, docs, "").collect()] == [1]
    assert all(r["kept"] for r in minhash.near_duplicates(docs, percent=minhash.PERCENT).collect())
