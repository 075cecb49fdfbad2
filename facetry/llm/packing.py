"""Packing of token ids into sequences (operator 2): shortest-pack-first over the length histogram.

Each document, with its closing id, is cut into pieces of at most ``capacity`` ids. Only the histogram of piece lengths,
at most ``capacity`` rows, reaches the driver. Lengths are placed longest first; each goes to the packs with the most
room, and packs of one pattern are counted, not listed. A piece's rank among pieces of its length then gives its
sequence and its offset, by a join with the pattern intervals. A null text is empty and packs as its closing id alone;
repeated rows are packed each; an empty table gives no pieces; other columns are ignored. A very long text is encoded whole,
alone in its chunk, so that a task's memory follows its bytes, and gives as many pieces as it needs.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetry.llm.bpe import vocabulary
from facetry.llm.ragged import chunks, text_bytes
from facetry.llm.shared import numbered, partitions, settled, table
from facetry.llm.tokens import vocabulary_path

#: Pattern intervals up to this number are broadcast (40 bytes each); more are joined by a shuffle.
BROADCAST_INTERVALS = 200_000


def patterns(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """(number of packs, lengths in each) of a histogram {length: pieces}."""
    room: list[list[tuple[int, list[int]]]] = [[] for _ in range(capacity + 1)]
    for length in sorted(histogram, reverse=True):
        left, free = histogram[length], capacity
        while left:
            while free >= length and not room[free]:
                free -= 1
            if free < length:
                room[capacity - length].append((left, [length]))
                break
            count, parts = room[free].pop()
            took = min(count, left)
            if count > took:
                room[free].append((count - took, parts))
            room[free - length].append((took, [*parts, length]))
            left -= took
    return [x for level in room for x in level]


def intervals(packs: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end of ranks, sequence of the first, offset): where the pieces of each length go."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for count, parts in packs:
        offset = 0
        for length in parts:
            lo = used.get(length, 0)
            used[length] = lo + count
            rows.append((length, lo, lo + count, base, offset))
            offset += length
        base += count
    return rows


def cut(df: DataFrame, key: str, text: str, capacity: int, closing_id: int, path: str, keep_ids: bool) -> DataFrame:
    def run(batches):
        vocab = vocabulary(path)
        for batch in batches:
            for part in chunks(batch, text):
                ids, ends = vocab.encode(*text_bytes(part.column(text)))
                rows, start, length, crc, total, lists = [], [], [], [], [], []
                for i in range(part.num_rows):
                    own = np.append(ids[ends[i] : ends[i + 1]], closing_id).astype("<u4")
                    for at in range(0, len(own), capacity):
                        piece = own[at : at + capacity]
                        rows.append(i)
                        start.append(at)
                        length.append(len(piece))
                        crc.append(zlib.crc32(piece.tobytes()))
                        total.append(len(own))
                        if keep_ids:
                            lists.append(piece.astype(np.int32))
                columns = [part.column(key).take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
                names = [key, "start", "length", "ids_crc32", "doc_tokens"]
                if keep_ids:
                    columns, names = [*columns, pa.array(lists, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * keep_ids
    return df.select(key, text).mapInArrow(run, schema)


def pack(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = 1024, closing_id: int = 0, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """One row per piece: ``key``, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if kept)."""
    spark = df.sparkSession
    pieces = settled(cut(df, key, text, capacity, closing_id, path or vocabulary_path(), keep_ids))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = intervals(patterns(histogram, capacity))
    places = spark.createDataFrame(rows, "length long, _lo long, _hi long, _base long, offset long")
    if len(rows) <= BROADCAST_INTERVALS:
        places = F.broadcast(places)
    ranked = numbered(pieces, ["length"], [F.col(key), F.col("start"), F.col("ids_crc32")], [F.col(key), F.col("start")], "_rank", partitions(spark))
    placed = ranked.join(places, (ranked["length"] == places["length"]) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi"))).drop(places["length"])
    return placed.withColumn("sequence_id", F.col("_base") + F.col("_rank") - F.col("_lo")).drop("_rank", "_lo", "_hi", "_base")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
