"""Near-duplicate documents (operator 9): MinHash with tensored banding, then checked on full shingle sets.

Documents with equal shingle sets form a class, for which its smallest id stands. A representative has two collections
of ``BANDS`` bands of ``WIDTH`` minimum hashes each; the key of table (i, j) joins band i of the first with band j of
the second, so ``2 * BANDS * WIDTH`` hash functions feed ``BANDS ** 2`` tables. A pair with similarity s is missed in
all tables with probability below ``2 * (1 - s ** WIDTH) ** BANDS``: 4e-4 at 0.8, 2e-5 at 0.85 and 2e-10 at 0.95.

Bands that one representative alone has are dropped first. Within a table bucket, each member is tied to the smallest
one; the components of these ties are candidate groups. A group is dealt to blocks, and each pair of blocks is one cell,
whose documents are compared exactly in one task through an inverted list of their shingles. A cell returns a star for each
component of its links, never its pairs.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered. A null, empty or blank text has no shingles and no links; a text of one
to four words is one shingle. A null id never represents others. Of rows that share an id,
one is compared.
Further columns are ignored. An empty table gives no rows. A very long text is shingled whole, alone in its chunk; where it
is a candidate, its text moves to one task for each pair of blocks, whose memory follows the texts of its cell.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetry.llm.graph import Forest, components
from facetry.llm.ragged import U64, chunks, mix, spread, text_bytes, word_hashes, words_of
from facetry.llm.shared import settled, table

WORDS, PERCENT = 5, 85
BANDS, WIDTH = 12, 3
BLOCK = 512
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles, by row and then hash."""
    data = LOWER[data]
    starts, lengths, first = words_of(data, offsets)
    count = np.diff(first)
    row = np.repeat(np.arange(len(count)), count)
    word = word_hashes(data, starts, lengths)[0]
    n = max(0, len(word) - size + 1)
    h = np.zeros(n, U64)
    for k in range(size):
        h = mix(h * U64(0x9E3779B97F4A7C15) + word[k : k + n])
    inside = row[:n] == row[size - 1 :] if n else np.zeros(0, bool)
    rows, hashes = row[:n][inside], h[inside]
    few = np.flatnonzero((count > 0) & (count < size))
    short = np.zeros(len(few), U64)
    for k in range(size - 1):
        on = count[few] > k
        short[on] = mix(short[on] * U64(0x9E3779B97F4A7C15) + word[first[few[on]] + k] + U64(k + 1))
    rows, hashes = np.concatenate([rows, few]), np.concatenate([hashes, short])
    order = np.argsort(hashes)
    order = order[np.argsort(rows[order], kind="stable")]
    rows, hashes = rows[order], hashes[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return rows[new], hashes[new]


def sketches(rows: np.ndarray, hashes: np.ndarray, n: int, bands: int = BANDS, width: int = WIDTH) -> tuple[np.ndarray, ...]:
    """Set sizes, two fingerprints of each whole set and its band values (n x 2 * bands); rows without shingles hold 0."""
    size = np.bincount(rows, minlength=n)
    full = np.flatnonzero(size)
    at = np.cumsum(size[full]) - size[full]
    one, two, values = np.zeros(n, U64), np.zeros(n, U64), np.zeros((n, 2 * bands), U64)
    if len(full):
        one[full] = np.add.reduceat(mix(hashes), at)
        two[full] = np.add.reduceat(mix(hashes ^ U64(0x5851F42D4C957F2D)), at)
        turn = np.random.default_rng(2014).integers(1, 2**63, (2, 2 * bands * width), dtype=np.uint64) | U64(1)
        for b in range(2 * bands):
            h = np.full(len(full), b + 1, U64)
            for k in range(b * width, (b + 1) * width):
                x = (hashes ^ turn[1, k]) * turn[0, k]
                h = mix(h ^ np.minimum.reduceat(x ^ (x >> U64(31)), at))
            values[full, b] = h
    return size, one, two, values


def with_sketches(df: DataFrame, key: str, text: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in chunks(batch, text):
                n = part.num_rows
                size, one, two, values = sketches(*shingles(*text_bytes(part.column(text))), n)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * 2 * BANDS, pa.int32()), pa.array(values.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([part.column(key).cast(pa.int64()), pa.array(size.astype(np.int64)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), lists], names=["id", "size", "one", "two", "bands"])

    return df.select(key, text).mapInArrow(run, "id long, size long, one long, two long, bands array<long>")


def candidate_groups(reps: DataFrame) -> DataFrame:
    """(rep, bands) -> (node, component): representatives that some chain of shared table keys ties together."""
    bands = reps.select("rep", F.posexplode("bands").alias("b", "value"))
    # Settled, so that the joins have exchanges of their own on both sides and a hot band or key can be split.
    n = reps.count()
    shared = settled(bands.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("value"), BANDS * n)
    sides = bands.join(shared, "value").groupBy("rep").agg(F.collect_list(F.when(F.col("b") < BANDS, F.col("value"))).alias("left"), F.collect_list(F.when(F.col("b") >= BANDS, F.col("value"))).alias("right"))
    keys = settled(sides.select("rep", F.explode("left").alias("l"), "right").select("rep", "l", F.explode("right").alias("r")).select("rep", F.xxhash64("l", "r").alias("key")))
    least = settled(keys.groupBy("key").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).where("least < most").select("key", "least"), keys.count() // 2)
    return components(keys.join(least, "key").where("rep <> least").select(F.col("rep").alias("a"), F.col("least").alias("b")).distinct(), contract=False)


def links(ids: list[int], side: np.ndarray, rows: np.ndarray, hashes: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
    """The components of the exact links among sets, as stars of (id, first id of its component); where both sides occur, of
    links between the sides."""
    n = len(ids)
    size = np.bincount(rows, minlength=n)
    begin = np.cumsum(size) - size
    _, term, df = np.unique(hashes, return_inverse=True, return_counts=True)
    term = term.reshape(-1)
    posting = rows[np.argsort(term, kind="stable")]
    p0 = np.cumsum(df) - df
    forest = Forest(n)
    mixed = side.min() != side.max()
    for i in range(n):
        own = term[begin[i] : begin[i] + size[i]]
        own = own[df[own] > 1]
        if not len(own):
            continue
        both = np.bincount(posting[spread(p0[own], df[own])], minlength=n)
        hit = 100 * both >= percent * (size[i] + size - both)
        hit[: i + 1] = False
        if mixed:
            hit &= side != side[i]
        for j in np.flatnonzero(hit).tolist():
            forest.join(i, j)
    return [(ids[i], ids[r]) for i in range(n) if (r := forest.root(i)) != i]


def confirmed(docs: DataFrame, groups: DataFrame, key: str, text: str, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) between representatives of one candidate group, judged on their whole sets: of each cell, a star of every
    component's other members and its least."""
    blocks = groups.groupBy("component").agg((F.floor(F.count(F.lit(1)) / BLOCK) + 1).cast("int").alias("blocks"))
    dealt = groups.join(blocks, "component").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.union(groups.join(blocks, "component").select("component", F.col("component").alias("node"), "blocks", F.pmod(F.xxhash64("component"), F.col("blocks")).cast("int").alias("own")).distinct().select(*dealt.columns))
    cells = dealt.select("node", "component", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cells = cells.select("node", "component", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def run(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.drop_duplicates("node").sort_values("node")
        rows, hashes = shingles(*text_bytes(pa.array(cell["body"], pa.string())))
        return pd.DataFrame(links(cell["node"].tolist(), cell["own"].to_numpy(), rows, hashes, percent), columns=["a", "b"], dtype="int64")

    texts = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("node"), F.col(text).alias("body"))
    return cells.join(texts, "node").groupBy("component", "i", "j").applyInPandas(run, "a long, b long")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """One row per row of ``df``: ``key``, n_shingles, component_id, kept. Similarities count from ``percent``."""
    rows = settled(with_sketches(df, key, text))
    classes = settled(rows.where("size > 0 and id is not null").groupBy("one", "two", "size").agg(F.min(F.struct("id", "bands")).alias("m")).select("one", "two", "size", F.col("m.id").alias("rep"), F.col("m.bands").alias("bands")), rows.count())
    groups = settled(candidate_groups(classes.select("rep", "bands")), classes.count())
    found = components(confirmed(df, groups, key, text, percent), contract=False)
    labels = classes.select("one", "two", "size", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("one", "two", "size", F.coalesce("component", "rep").alias("component_id"))
    joined = rows.select("id", "size", "one", "two").join(labels, ["one", "two", "size"], "left")
    own = F.coalesce("component_id", "id")
    return joined.select(F.col("id").alias(key), F.col("size").alias("n_shingles"), own.alias("component_id"), F.coalesce(F.col("id") == own, F.lit(False)).alias("kept"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), percent=PERCENT)


OP9_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n_shingles FROM s),
c AS MATERIALIZED (SELECT min(doc_id) AS rep, list(doc_id) AS members, s FROM (SELECT doc_id, list_sort(s) AS s FROM s WHERE len(s) > 0) GROUP BY s),
t AS MATERIALIZED (SELECT rep, len(s) AS n, unnest(s) AS x FROM c),
l AS MATERIALIZED (SELECT a.rep AS a, b.rep AS b FROM t a JOIN t b ON a.x = b.x AND a.rep < b.rep GROUP BY a.rep, b.rep HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(node, reached) AS (SELECT rep, rep FROM c UNION SELECT r.node, e.b FROM r JOIN e ON r.reached = e.a),
m AS (SELECT node, min(reached) AS component FROM r GROUP BY node),
k AS (SELECT unnest(members) AS doc_id, component FROM c JOIN m ON c.rep = m.node)
SELECT n.doc_id, n.n_shingles, coalesce(k.component, n.doc_id) AS component_id, coalesce(k.component, n.doc_id) = n.doc_id AS kept FROM n LEFT JOIN k USING (doc_id)
"""
