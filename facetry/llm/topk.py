"""Exact top-k by inner product (operator 8): M-tree best-first search.

With M the largest norm, a vector x gains the component sqrt(M^2 - |x|^2) and a query the component 0; then a larger
inner product is a smaller distance, and distances obey the triangle inequality. Equal vectors are indexed once, with
their ``k + 1`` smallest ids. Vectors are dealt to shards by a hash; a shard's tree is a table of pages, each with a
routing object, a covering radius and its distance to the parent's object; a leaf also keeps each entry's distance to its
routing object. Queries go through the trees in blocks: each takes its most promising page, skips the distances of pages
and of leaf entries that stored ones bound away, and stops when no bound reaches its k-th score. A bounded sample of the vectors gives each query a score that its result must reach, so most pages of most shards
are never opened. Nothing is approximate: bounds only save work.

A vector that is null, empty or holds null or non-finite components takes no part, nor does a row with a null id.
Shorter vectors count as padded with zeros. Equal rows count as one; other columns are ignored; an empty table gives no rows.
Scores are exact while they stay below 2 ** 53.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facetry.llm.shared import settled, table

SHARD, PAGE, FAN = 16384, 256, 16
BLOCK = 1024
#: Vectors that give the queries their first bound.
SAMPLE = 2048


def quantized(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): floor(256 * x) of the rows that take part."""
    x = F.col(vector).cast("array<double>")
    fine = F.col(key).isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return df.where(fine).select(F.col(key).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c * 256).cast("long")).alias("v"))


def classes(rows: DataFrame, k: int) -> DataFrame:
    """(v, ids): distinct vectors with their ``k`` smallest ids; thinned in each task and each bucket before the last."""

    def run(batches):
        for batch in batches:
            kept: dict[bytes, tuple[list, list]] = {}
            for i, v in sorted(zip(batch.column("id").to_pylist(), batch.column("v").to_pylist()), key=lambda r: r[0]):
                ids = kept.setdefault(np.array(v, np.int64).tobytes(), (v, []))[1]
                if len(ids) < k and (not ids or ids[-1] != i):
                    ids.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in kept.values()], pa.list_(pa.int64())) for j in (0, 1)], names=["v", "ids"])

    least = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k).alias("ids")
    local = rows.mapInArrow(run, "v array<long>, ids array<long>").withColumn("salt", F.spark_partition_id() % 64)
    return local.groupBy("v", "salt").agg(least).groupBy("v").agg(least)


def matrix(vectors, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def build(x: np.ndarray, page: int = PAGE, fan: int = FAN) -> list[dict]:
    """Pages of an M-tree over the rows of ``x`` (augmented), parents first: node, parent, pivot (row), radius,
    to_parent, members (rows; none for inner pages), apart (the members' distances to the pivot)."""
    pages: list[dict] = []

    def grow(rows: np.ndarray, pivot: int, parent: int) -> None:
        d = np.linalg.norm(x[rows] - x[pivot], axis=1)
        node = len(pages)
        leaf = len(rows) <= page
        to_parent = float(np.linalg.norm(x[pivot] - x[pages[parent]["pivot"]])) if parent >= 0 else 0.0
        pages.append({"node": node, "parent": parent, "pivot": pivot, "radius": float(d.max()), "to_parent": to_parent, "members": rows if leaf else rows[:0], "apart": d if leaf else d[:0]})
        if leaf:
            return
        # Routing objects far from one another; each row goes to the nearest that has room.
        centres, near = [int(rows[d.argmax()])], np.full(len(rows), np.inf)
        parts = min(fan, -(-len(rows) // page))
        distances = []
        while len(centres) <= parts:
            own = np.linalg.norm(x[rows] - x[centres[-1]], axis=1)
            distances.append(own)
            near = np.minimum(near, own)
            if len(centres) == parts:
                break
            centres.append(int(rows[near.argmax()]))
        distances = np.stack(distances, 1)
        room, left, taken = -(-len(rows) // parts), np.arange(len(rows)), np.full(len(rows), -1)
        sizes = np.zeros(parts, np.int64)
        while len(left):
            open_ = sizes < room
            choice = np.where(open_, distances[left], np.inf).argmin(1)
            for c in np.unique(choice):
                want = left[choice == c]
                want = want[np.argsort(distances[want, c], kind="stable")][: room - sizes[c]]
                taken[want] = c
                sizes[c] += len(want)
            left = left[taken[left] < 0]
        for c in range(parts):
            own = rows[taken == c]
            if len(own):
                grow(own, centres[c] if (own == centres[c]).any() else int(own[distances[taken == c, c].argmin()]), node)

    if len(x):
        grow(np.arange(len(x)), 0, -1)
    return pages


def search(pages: list[dict], x: np.ndarray, ids: list, q: np.ndarray, floor: np.ndarray, top: float, k: int, spent: list[int] | None = None) -> list[list[tuple[int, int]]]:
    """For each query its ``k`` best (score, id) that reach ``floor``; ``x`` without the added component. ``spent`` takes
    the numbers of leaf entries scored in each visit."""
    n, nodes = len(q), len(pages)
    norm = (q * q).sum(1)
    slack = 1e-9 * (norm + top) + 1e-6
    bound = np.full((n, nodes), -np.inf)
    to_pivot = np.zeros((n, nodes))
    kids = [[p["node"] for p in pages if p["parent"] == i] for i in range(nodes)]

    def reach(rows: np.ndarray, node: int) -> None:
        p = pages[node]["pivot"]
        d2 = norm[rows] + top - 2 * (q[rows] @ x[p])
        to_pivot[rows, node] = np.sqrt(np.maximum(d2, 0))
        near = np.maximum(to_pivot[rows, node] - pages[node]["radius"], 0)
        bound[rows, node] = (norm[rows] + top - near * near) / 2 + slack[rows]

    best: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    limit = floor.astype(float)
    live = np.arange(n)
    if nodes:
        reach(live, 0)
    while nodes and len(live):
        node = bound[live].argmax(1)
        # A visited page has no bound left, and without ``k`` vectors the limit stays as low.
        go = (bound[live, node] >= limit[live]) & (bound[live, node] > -np.inf)
        live, node = live[go], node[go]
        for at in np.unique(node):
            rows = live[node == at]
            bound[rows, at] = -np.inf
            members = pages[at]["members"]
            for kid in kids[at]:
                # The parent's distance bounds the kid's before it is computed.
                near = np.maximum(np.abs(to_pivot[rows, at] - pages[kid]["to_parent"]) - pages[kid]["radius"], 0)
                able = (norm[rows] + top - near * near) / 2 + slack[rows] >= limit[rows]
                if able.any():
                    reach(rows[able], kid)
            if len(members):
                # An entry's stored distance bounds its score; only entries that some query of the visit can use are scored.
                near = to_pivot[rows, at][:, None] - pages[at]["apart"]
                able = (norm[rows, None] + top - near * near) / 2 + slack[rows, None] >= limit[rows, None]
                some, used = able.any(1), able.any(0)
                rows, members = rows[some], members[used]
                scores = np.rint(q[rows] @ x[members].T).astype(np.int64)
                if spent is not None:
                    spent.append(scores.size)
                for r, own in zip(rows.tolist(), scores):
                    for j in np.flatnonzero(own >= limit[r]).tolist():
                        best[r] += [(-int(own[j]), i) for i in ids[members[j]]]
                    best[r].sort()
                    del best[r][k:]
                    if len(best[r]) == k:
                        limit[r] = max(limit[r], -best[r][-1][0])
    return [[(-s, i) for s, i in b] for b in best]


def top_k(df: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): each row of ``queries`` against every row of ``df`` but those of its own id."""
    rows = settled(quantized(df, key, vector))
    distinct = settled(classes(rows, k + 1))
    norm = F.aggregate("v", F.lit(0).cast("double"), lambda a, c: a + c * c)
    stat = distinct.agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("top"), F.max(F.size("v")).alias("width")).first()
    count, top, width = stat["n"], stat["top"] or 0.0, stat["width"] or 1
    shards = 1 + count // SHARD
    some = settled(distinct.orderBy(F.xxhash64("v"), "v").limit(SAMPLE)).toPandas()
    sample, weights = matrix(some["v"].tolist(), width), np.array([len(i) for i in some["ids"]], np.int64)

    def index(shard: pd.DataFrame) -> pd.DataFrame:
        vectors, ids = shard["v"].tolist(), shard["ids"].tolist()
        x = matrix(vectors, width)
        pages = build(np.column_stack([x, np.sqrt(np.maximum(top - (x * x).sum(1), 0))]))
        out = [(shard["shard"].iloc[0], p["node"], p["parent"], p["radius"], p["to_parent"], vectors[p["pivot"]], [vectors[m] for m in p["members"]], [ids[m] for m in p["members"]], p["apart"].tolist()) for p in pages]
        return pd.DataFrame(out, columns=["shard", "node", "parent", "radius", "to_parent", "pivot", "vectors", "ids", "apart"])

    dealt = distinct.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)))
    pages = settled(dealt.groupBy("shard").applyInPandas(index, "shard long, node int, parent int, radius double, to_parent double, pivot array<long>, vectors array<array<long>>, ids array<array<long>>, apart array<double>"))

    asked = settled(quantized(queries, key, vector))
    wanted = settled(asked.select("v").distinct())
    blocks = 1 + wanted.count() // BLOCK
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = pages.withColumn("block", each(blocks))
    right = wanted.withColumn("block", F.pmod(F.xxhash64("v", F.lit(1)), F.lit(blocks))).withColumn("shard", each(shards))

    def find(cell: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(cell) and len(own):
            cell = cell.sort_values("node")
            vectors, ids, nodes = [], [], []
            for p in cell.itertuples():
                vectors.append(p.pivot)
                ids.append([])
                members = np.arange(len(vectors), len(vectors) + len(p.vectors))
                nodes.append({"node": p.node, "parent": p.parent, "radius": p.radius, "to_parent": p.to_parent, "pivot": len(vectors) - 1, "members": members, "apart": np.asarray(p.apart, float)})
                vectors += list(p.vectors)
                ids += [list(i) for i in p.ids]
            q = matrix(own["v"].tolist(), width)
            scores = q @ sample.T
            order = np.argsort(-scores, axis=1)
            held = np.cumsum(weights[order], 1) >= k + 1
            floor = np.where(held.any(1), scores[np.arange(len(q)), order[np.arange(len(q)), held.argmax(1)]], -np.inf)
            for v, best in zip(own["v"], search(nodes, matrix(vectors, width), ids, q, floor, top, k + 1)):
                found += [(v, s, i) for s, i in best]
        return pd.DataFrame(found, columns=["v", "score", "id"])

    cells = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block"))
    found = cells.applyInPandas(find, "v array<long>, score long, id long")
    best = Window.partitionBy("v").orderBy(F.desc("score"), "id")
    found = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "id"))).alias("found"))
    own = asked.distinct().withColumnRenamed("id", "query_id").join(found, "v")
    others = F.slice(F.filter("found", lambda c: c["id"] != F.col("query_id")), 1, k)
    return own.select("query_id", F.posexplode(others).alias("at", "c")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("c.id").alias("vec_id"), (-F.col("c.less")).alias("score"))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


OP8_SQL = """
WITH v AS (SELECT DISTINCT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
