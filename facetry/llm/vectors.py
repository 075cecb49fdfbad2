"""Near-duplicate embeddings (operator 11): randomised-rotation binary codes with stored correction factors.

Rows of one label with equal vectors form a class, for which its smallest id stands. A class gets

* cell keys, one for each of several tables: in ``PLACES`` random directions, the one of largest absolute value and its sign,
  for one or more turns. A pair at the threshold shares a turn's place with a probability that is measured for the
  dimension; the number of tables follows from it, so that such a pair is missed with probability below ``MISS`` and closer
  ones far less often;
* a code: the signs x' of the rotated unit vector x in two bits a dimension or more, and the factor f = <x', x> / sqrt(B).
  For a unit vector q, <x', q> / (f sqrt(B)) estimates <x, q> without bias, and ``EPSILON`` * sqrt((1 - f f) / f f / (B - 1))
  bounds its error but for a probability that falls as exp(-EPSILON ** 2 / 2);
* the unit vector in bytes with one scale, which is the q of such estimates.

Cells of several classes are compared by these only: vectors stay where they are. A member is flagged if some estimate plus
its bound reaches the threshold in a table that is the first of the pair's common ones. Vectors are then brought to the
cells in which they are flagged, and links are counted there in double precision, each pair in its first common table. A
cell of more than ``BLOCK`` members is compared in pairs of blocks, one task each. A comparison returns members' counts and a
spanning forest of its links, never pairs.

A vector links with nothing if its label is null or if it is null, empty, zero or holds null or non-finite components;
vectors of different lengths don't link. A null id links with nothing and is not kept. Repeated rows count once in ``n_links``, which counts other ids; an id with several vectors counts once for each
of them. Every row is returned, ties go to the smaller id, other columns are ignored, and an empty table gives no rows.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetry.llm.graph import Forest, components
from facetry.llm.shared import settled, table

COSINE = 0.93
#: Directions of a turn, members of a cell above which a further turn is taken, share of pairs at the threshold that may be
#: missed, width of the confidence bound, members of a block.
PLACES, FULL, MISS, EPSILON, BLOCK = 64, 4096, 1e-3, 4.0, 1024


def directions(dim: int, table_: int, turn: int) -> np.ndarray:
    return np.random.default_rng([dim, table_, turn]).normal(size=(dim, PLACES)).astype(np.float32)


@lru_cache(8)
def rotation(dim: int) -> np.ndarray:
    """``dim`` orthonormal columns in a space of a multiple of 64 dimensions, twice as many or more."""
    bits = 64 * -(-2 * dim // 64)
    q, r = np.linalg.qr(np.random.default_rng(dim).normal(size=(bits, dim)))
    return q * np.sign(np.diag(r))


def places(unit: np.ndarray, table_: int, turn: int) -> np.ndarray:
    along = unit.astype(np.float32) @ directions(unit.shape[1], table_, turn)
    best = np.abs(along).argmax(1)
    return 2 * best + (along[np.arange(len(unit)), best] > 0)


def tables_for(dim: int, cosine: float, turns: int) -> int:
    """Tables that miss a pair at the threshold with probability below ``MISS``; the chance of one is measured on 4096 pairs."""
    turn = np.random.default_rng(11)
    x, y = turn.normal(size=(2, 4096, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (y * x).sum(1, keepdims=True) * x
    size = np.linalg.norm(y, axis=1, keepdims=True)
    y = cosine * x + math.sqrt(1 - cosine * cosine) * y / np.where(size > 0, size, 1)
    p = max((places(x, 0, 0) == places(y, 0, 0)).mean(), 0.05) ** turns
    return math.ceil(math.log(MISS) / math.log(1 - p)) if p < 1 else 1


def units(v: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by their largest component first, so that no square overflows."""
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def matrix(lists: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, np.float64) for x in lists])


def encoded(classes: DataFrame, turns: int, tables: dict[int, int]) -> DataFrame:
    """(node, label, dim, v) -> node, label, dim, keys (4 bytes a table), code, factor, bytes, scale."""

    def run(batches):
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                x = units(matrix(part["v"]))
                keys = np.stack([sum(places(x, t, k).astype(np.int64) * (2 * PLACES) ** k for k in range(turns)) for t in range(tables[int(dim)])], 1).astype("<i4")
                turned = x @ rotation(int(dim)).T
                factor = np.abs(turned).sum(1) / math.sqrt(turned.shape[1])
                scale = np.abs(x).max(1) / 127
                # Rounded up or down at random, so that estimates stay without bias.
                small = np.floor(x / scale[:, None] + np.random.default_rng(int(dim)).random(x.shape)).clip(-127, 127).astype(np.int8)
                bits = np.packbits(turned > 0, axis=1)
                blob = lambda rows: [r.tobytes() for r in rows]
                yield pd.DataFrame({"node": part["node"], "label": part["label"], "dim": part["dim"], "keys": blob(keys), "code": blob(bits), "factor": factor, "bytes": blob(small), "scale": scale})

    kind = dict(classes.dtypes)["label"]
    return classes.select("node", "label", "dim", "v").mapInPandas(run, f"node long, label {kind}, dim int, keys binary, code binary, factor double, bytes binary, scale double")


def dealt(members: DataFrame, classes: int) -> DataFrame:
    """(label, dim, t, key, node, ...) -> adds pack, own, i, j. Cells of one member go; the others are compared in packs of whole
    cells of one table or, if larger than a block, in pairs of blocks."""
    cell = ["label", "dim", "t", "key"]
    sizes = settled(members.groupBy(*cell).agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).drop("n"))
    own = members.join(sizes, cell).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    hash_ = F.xxhash64("label", "key")
    pack = F.when(F.col("blocks") == 1, F.pmod(hash_, F.lit(1 + 2 * classes // BLOCK))).otherwise(hash_)
    return other.withColumns({"pack": pack, "i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("blocks", "other")


def compared(ok: np.ndarray, cell: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a < b) where ``ok``, within one cell; between its blocks only, if there are two. Each in its first common table."""
    own, keys = cell["own"].to_numpy(), np.frombuffer(b"".join(cell["keys"]), "<i4").reshape(len(cell), -1)
    if cell["i"].iloc[0] != cell["j"].iloc[0]:
        ok &= own[:, None] < own[None, :]
    else:
        ok = np.triu(ok, 1)
    a, b = np.nonzero(ok)
    of, t = pd.factorize(cell["label"])[0], int(cell["t"].iloc[0])
    same = (of[a] == of[b]) & (keys[a, t] == keys[b, t]) & ~(keys[a, :t] == keys[b, :t]).any(1)
    return a[same], b[same]


CELL = ("dim", "t", "pack", "i", "j")


def flagged(cells: DataFrame, cosine: float) -> DataFrame:
    """(label, dim, t, pack, i, j, own, node, keys) of the members that some estimate may link."""

    def run(cell: pd.DataFrame) -> pd.DataFrame:
        dim = int(cell["dim"].iloc[0])
        turn = rotation(dim).astype(np.float32)
        signs = np.unpackbits(np.frombuffer(b"".join(cell["code"]), np.uint8).reshape(len(cell), -1), axis=1).astype(np.float32) * 2 - 1
        query = (np.frombuffer(b"".join(cell["bytes"]), np.int8).reshape(len(cell), dim) * cell["scale"].to_numpy()[:, None]).astype(np.float32) @ turn.T
        f, bits = cell["factor"].to_numpy(), len(turn)
        bound = EPSILON * np.sqrt(np.maximum(1 - f * f, 0) / (f * f) / (bits - 1))
        near = (signs @ query.T) * (1 / (f * math.sqrt(bits))).astype(np.float32)[:, None] >= (cosine - bound).astype(np.float32)[:, None]
        a, b = compared(near | near.T, cell)
        hit = np.zeros(len(cell), bool)
        hit[a] = hit[b] = True
        return cell.loc[hit, ["label", "dim", "t", "pack", "i", "j", "own", "node", "keys"]]

    kind = dict(cells.dtypes)["label"]
    return cells.groupBy(*CELL).applyInPandas(run, f"label {kind}, dim int, t int, pack long, i int, j int, own int, node long, keys binary")


def counted(hits: DataFrame, classes: DataFrame, cosine: float) -> DataFrame:
    """(a, b, n): links of a cell in double precision. b null: a has n further linked ids; else a link of a spanning forest."""

    def run(cell: pd.DataFrame) -> pd.DataFrame:
        nodes, weight = cell["node"].to_numpy(), cell["weight"].to_numpy()
        x = units(matrix(cell["v"]))
        a, b = compared(x @ x.T >= cosine, cell)
        n = np.bincount(a, weight[b], len(cell)) + np.bincount(b, weight[a], len(cell))
        forest = Forest(len(cell))
        tied = [(nodes[p], nodes[q]) for p, q in zip(a.tolist(), b.tolist()) if forest.join(p, q)]
        on = np.flatnonzero(n)
        rows = [(nodes[p], None, int(n[p])) for p in on.tolist()] + [(p, q, 0) for p, q in tied]
        return pd.DataFrame(rows, columns=["a", "b", "n"]).astype({"a": "int64", "b": "Int64", "n": "int64"})

    held = hits.join(classes.select("node", "v", "weight"), "node")
    return held.groupBy(*CELL).applyInPandas(run, "a long, b long, n long")


def near_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE) -> DataFrame:
    """One row per row of ``df``: ``key``, n_links, component_id, kept."""
    x = F.col(vector).cast("array<double>")
    finite = F.col(key).isNotNull() & F.col(label).isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(x, lambda c: c != 0)
    # Adding 0.0 makes -0.0 equal to 0.0, so that equal vectors are equal keys.
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), F.when(F.coalesce(finite, F.lit(False)), F.transform(x, lambda c: c + F.lit(0.0))).alias("v"))
    # A vector may have a third of all rows: the buckets are settled, so that the join below has an exchange on both sides.
    classes = settled(
        rows.where("v is not null").groupBy("label", "v", F.pmod(F.xxhash64("id"), F.lit(64)).alias("salt")).agg(F.min("id").alias("rep"), F.count_distinct("id").alias("weight"))
        .groupBy("label", "v").agg(F.min("rep").alias("rep"), F.sum("weight").alias("weight"))
        .select("label", "v", F.size("v").alias("dim"), "rep", "weight", F.monotonically_increasing_id().alias("node"))
    )
    size = classes.groupBy("label", "dim").count().agg(F.max("count").alias("largest"), F.sum("count").alias("all")).first()
    largest = size["largest"] or 0
    turns = max(1, math.ceil(math.log(max(largest, 1) / FULL, 2 * PLACES)))
    dims = {r["dim"]: tables_for(r["dim"], cosine, turns) for r in classes.select("dim").distinct().collect()}
    codes = settled(encoded(classes, turns, dims))
    word = F.conv(F.hex(F.reverse(F.substring("keys", 4 * F.col("t") + 1, F.lit(4)))), 16, 10).cast("int")
    number = F.coalesce(F.try_element_at(F.create_map(*(F.lit(i) for d in dims.items() for i in d)), F.col("dim")), F.lit(1)) if dims else F.lit(1)
    members = codes.withColumn("t", F.explode(F.sequence(F.lit(0), number - 1))).withColumn("key", word)
    hits = settled(flagged(dealt(members, size["all"] or 0), cosine))
    found = settled(counted(hits, classes, cosine))
    degree = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    parts = components(found.where("b is not null").select("a", "b")).withColumnRenamed("component", "root")
    named = classes.select("node", "label", "v", "rep", "weight").join(parts, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = settled(named.groupBy("root").agg(F.min("rep").alias("component_id")))
    per = settled(named.join(least, "root").join(degree, "node", "left").select("label", "v", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id"))
    joined = rows.join(per, ["label", "v"], "left")
    own = F.coalesce("component_id", "id")
    return joined.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("id") == own, F.lit(False)).alias("kept"))


def op11_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


OP11_SQL = """
WITH RECURSIVE v AS MATERIALIZED (SELECT DISTINCT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
  AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
e AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE CASE WHEN len(a.v) = len(b.v) THEN list_cosine_similarity(a.v, b.v) END >= 0.93),
r(node, reached) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.node, e.b FROM r JOIN e ON r.reached = e.a),
m AS (SELECT node, min(reached) AS component FROM r GROUP BY node),
n AS (SELECT a, count(*) AS n_links FROM e GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(component, vec_id) AS component_id, coalesce(coalesce(component, vec_id) = vec_id, false) AS kept
FROM embeddings LEFT JOIN m ON node = vec_id LEFT JOIN n ON a = vec_id
"""
