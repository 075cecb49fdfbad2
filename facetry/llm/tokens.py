"""BPE encoding and decoding of text columns (operator 6).

Encoding gives the ids of the public tokenizers library with ``add_special_tokens=False``: the text of a special token
becomes its id. The method is in :mod:`facetry.llm.bpe`. Tasks hold a few MB of text at a time, texts of any length
are encoded whole, and words that recur in those MB are encoded once. A null text is an empty one and gives no ids. Rows
are independent: repeated rows, an empty table and further columns pass through; a column named like the new one
(``out``) is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetry.llm.bpe import vocabulary
from facetry.llm.ragged import chunks, spread, text_bytes
from facetry.llm.shared import table


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def with_column(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    keep = [i for i, n in enumerate(batch.schema.names) if n != name]
    return pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), column], names=[*(batch.schema.names[i] for i in keep), name])


def grown_schema(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*(f for f in df.schema if f.name != name), T.StructField(name, kind)])


def encode(df: DataFrame, text: str = "text", out: str = "ids", path: str | None = None) -> DataFrame:
    """Adds ``out``: the ids of ``text`` as an array of ints."""
    path = path or vocabulary_path()

    def run(batches):
        vocab = vocabulary(path)
        for batch in batches:
            for part in chunks(batch, text):
                ids, ends = vocab.encode(*text_bytes(part.column(text)))
                yield with_column(part, out, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())))

    return df.mapInArrow(run, grown_schema(df, out, T.ArrayType(T.IntegerType())))


def decode(df: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """Adds ``out``: the text of the array ``ids``; bytes that are no UTF-8 become U+FFFD, a null array an empty text,
    and a null or unknown id within an array nothing."""
    path = path or vocabulary_path()

    def run(batches):
        vocab = vocabulary(path)
        size = np.array([*map(len, vocab.token_bytes), 0], np.int64)
        begin = np.cumsum(size) - size
        table = np.frombuffer(b"".join(vocab.token_bytes), np.uint8)
        for batch in batches:
            column = batch.column(ids)
            for at in range(0, batch.num_rows, 500):
                part, lists = batch.slice(at, 500), column.slice(at, 500)
                rows = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy())
                flat = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                flat[(flat < 0) | (flat >= len(size) - 1)] = len(size) - 1
                data = table[spread(begin[flat], size[flat])]
                ends = np.concatenate([[0], np.cumsum(np.bincount(rows, size[flat], len(lists)).astype(np.int64))])
                raw = data.tobytes()
                try:
                    raw.decode("utf-8")
                    whole = not np.any((data[ends[1:-1][ends[1:-1] < len(data)]] & 0xC0) == 0x80)
                except UnicodeDecodeError:
                    whole = False
                if whole:
                    texts = pa.LargeStringArray.from_buffers(len(lists), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(raw)).cast(pa.string())
                else:
                    texts = pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:])], pa.string())
                yield with_column(part, out, texts)

    return df.mapInArrow(run, grown_schema(df, out, T.StringType()))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = encode(docs).select("doc_id", "ids")
    shown = F.concat_ws(",", F.col("ids").cast("array<string>"))
    digest = ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(shown, 256).alias("ids_sha256"), "ids")
    return decode(digest).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
