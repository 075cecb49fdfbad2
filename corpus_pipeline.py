"""A corpus from raw documents to packed sequences, in five stages of the training-data operators.

Each stage takes all that the one before kept, as written to Parquet, and all but the last return the columns of
``documents``. Repeated passages count from ``PASSAGE`` bytes, which most passages of 50 words have, and go wherever they
stand.

What every stage does with odd rows: a null text counts as empty (and is rejected by the first stage); a row with a null
doc_id is judged by its own text, takes no part in groups and keeps its text in the third stage, where its passages count
as places of their own; repeated rows are judged
alike, and all rows of a kept id stay; columns beyond those needed pass through whatever their names; texts of any length are
taken whole; an empty table gives an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetry.llm import minhash, packing, pii, quality, suffixes
from facetry.llm.shared import shared_folder, table

PASSAGE = 240
PERCENT = 80


def _numbered(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """(docs with columns named by their places, so that none clashes with an operator's own; those of doc_id and text)."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names["doc_id"], names["text"]


def _named_back(docs: DataFrame, work: DataFrame, text: str | None = None) -> DataFrame:
    """The columns of ``docs`` again; where ``text`` changed, n_chars follows it."""
    if text and "n_chars" in docs.columns:
        work = work.withColumn(f"c{docs.columns.index('n_chars')}", F.length(text).cast(docs.schema["n_chars"].dataType))
    return work.select(*(f"c{i}" for i in range(len(docs.columns)))).toDF(*docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned rules and the base rule keep; null and empty texts go."""
    rules = quality.learn(docs, table(spark, sf_dir, "labels"))
    work, _, text = _numbered(docs)
    return _named_back(docs, quality.judged(work, rules, text).where("kept"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id in each group of near-duplicates, of similarity ``PERCENT`` / 100 or more. Documents
    without an id stay."""
    kept = minhash.near_duplicates(docs, percent=PERCENT).where("kept").select("doc_id")
    return docs.join(kept, "doc_id", "left_semi").select(*docs.columns).union(docs.where("doc_id is null"))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that stand anywhere else; whole characters stay. A text that only repeats becomes empty."""
    rows, _ = suffixes.repeated_spans(docs, lengths=(PASSAGE,))
    work, key, text = _numbered(docs)
    spans = rows.where(F.size("spans_0") > 0).select(F.col("id").alias(key), "sha", F.col("spans_0").alias("spans")).dropDuplicates([key, "sha"])
    # By id and digest, so that rows that share an id each meet the spans of their own text, once.
    cut = work.withColumn("sha", F.unhex(F.sha2(text, 256))).join(spans, [key, "sha"], "left").drop("sha")
    return _named_back(docs, suffixes.without_spans(cut, text, characters=True), text)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every span of personal data, of the patterns or of the field, replaced by its kind."""
    work, _, text = _numbered(docs)
    return _named_back(docs, pii.masked(pii.with_spans(work, pii.learn(work, text), text), text), text)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of 1024 tokens; an empty text is one piece of its end id."""
    return packing.pack(docs)


STAGES = [
    ("quality", keep_quality),
    ("near-duplicates", keep_one_of_each_group),
    ("suffixes", drop_repeated_passages),
    ("personal-data", mask_personal_data),
    ("packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    place = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{k}")
        docs = spark.read.parquet(f"{place}/{k}")
    return docs
