"""Removal of repeated passages (operator 7), by suffix arrays from external induced sorting.

1. Equal texts are grouped. A text with copies and of at least ``length`` bytes is repeated whole; one row stands for it.
2. Every window of the least wanted length contains a chosen anchor, the least hash of its pieces of ``gram`` bytes. A
   passage that recurs has the same anchor each time, so only anchors that occur twice take part; anything else is proved
   unique. An anchor that is also the least of a longer wanted window reaches as far as that window may, any other only as far
   as the shorter one, for each window has such an anchor of its own length. Anchors whose whole surroundings, all that
   a window of their reach with the anchor may cover, have one digest (128 bits of BLAKE2b over their bytes) need no sorting: their windows recur. One place of each surrounding stands for it beside those
   that differ.
3. Their surroundings go to shards by anchor. Anchors that stand together mostly share a home, the least hash nearby, and
   by it a shard, so that a text is not cut into a piece for each. An anchor with more than ``HOT`` surroundings is not
   sorted: its key is extended by the bytes around it (``hot_spans``) until whole windows are the keys, which Spark counts,
   so that no task takes all places of an anchor.
4. A shard's pieces stream to a file, joined by separators, and their suffixes are sorted with their common prefixes by
   :mod:`facetry.llm.induced`, on disk. Runs of neighbours that share ``length`` bytes are repeats.
5. The bytes of repeats are removed from the whole texts.

A null or empty text has no bytes. Texts below ``length`` keep theirs. Equal rows remove each other. Other columns are
ignored; an empty table gives no rows. Very long texts are scanned in segments, so that memory follows those. Texts are valid
UTF-8, as Spark's strings are. Rows are told apart by numbers of their own, so that each row of a repeated id, and of a null
one, is judged by its own text.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import tempfile
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facetry.llm.induced import blocks, disk, suffixes
from facetry.llm.ragged import U64, chunks, give_back, mix, text_bytes
from facetry.llm.shared import settled, stored, table, thinned

#: Bytes of a repeat that is removed, and of one that is reported: about 50 words of the shorter languages.
LENGTH, PASSAGE = 400, 240
#: Estimated bytes of a shard, of its queue in memory, and of a piece's share of them.
SHARD_BYTES, QUEUE_BYTES, PIECE_BYTES = 1 << 20, 8 << 20, 120
SEPARATOR = 0xF5
#: Surroundings of an anchor up to which they are sorted in one shard; and the offsets of windows that share an extended key.
HOT, CELL = 4096, 15
#: Anchors on either side that may give the home; surroundings of a home up to which they stay together.
NEAR, HOME = 8, 8192
#: Bytes scanned at a time.
SEGMENT = 1 << 18
#: Bytes below 0xC0 move up by one, so that 0 can end a shard; UTF-8 has no 0xC0.
SHIFT = np.array([b + (b < 0xC0) for b in range(256)], np.uint8)


@lru_cache(1)
def _weights(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a byte counts in a hash, and the powers of the base and of its inverse up to n."""
    letters = np.random.default_rng(400).integers(0, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
    base = 0x9E3779B97F4A7C15
    power, back = np.full(n + 1, base, U64), np.full(n + 1, pow(base, -1, 2**64), U64)
    power[0] = back[0] = 1
    np.cumprod(power, out=power)
    np.cumprod(back, out=back)
    return letters, power, back


def anchors(data: np.ndarray, offsets: np.ndarray, lengths: tuple[int, ...], gram: int) -> tuple[np.ndarray, ...]:
    """(positions, hashes, reaches, digests of the surroundings) of the least piece of each window of the least of ``lengths``;
    of equal hashes the first. The reach is the largest length of whose windows one has its least piece here. The surroundings
    are what windows of up to that length with the piece can cover; the piece's place in them and the reach count in the digest."""
    n = len(data)
    if n < min(lengths):
        return np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, object)
    letters, power, back = _weights(max(n, 2 * SEGMENT))
    total = np.zeros(n + 1, U64)
    np.cumsum(letters[data] * power[:n], out=total[1:])
    h = mix((total[gram:] - total[:-gram]) * back[: n - gram + 1])
    level, span = (h >> U64(32) << U64(32)) | np.arange(len(h), dtype=U64), 1
    at = reach = np.zeros(0, np.int64)
    for length in sorted(lengths):
        width = length - gram + 1
        if n < length:
            break
        while 2 * span <= width:
            level = np.minimum(level[:-span], level[span:])
            span *= 2
        least = np.minimum(level[: len(level) - (width - span)], level[width - span :]) if width > span else level
        inside = np.ones(n, bool)
        for a, b in zip(np.maximum(offsets[1:] - length + 1, offsets[:-1]).tolist(), offsets[1:].tolist()):
            inside[a:b] = False
        own = least[inside[: len(least)]]
        own = own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own
        own = (own & U64(0xFFFFFFFF)).astype(np.int64)
        if length == min(lengths):
            at, reach = own, np.full(len(own), length)
        else:
            # The least piece of a window is that of each shorter window that holds it.
            reach[np.searchsorted(at, own)] = length
    row = np.searchsorted(offsets, at, "right") - 1
    lo, hi = np.maximum(at - (reach - gram), offsets[row]), np.minimum(at + reach, offsets[row + 1])
    raw, around = memoryview(np.ascontiguousarray(data)), np.empty(len(at), object)
    # As _digest, place by place.
    salts = np.stack([at - lo, reach], 1).astype("<i8").tobytes()
    around[:] = [hashlib.blake2b(raw[a:b], digest_size=16, salt=salts[k : k + 16]).digest() for a, b, k in zip(lo.tolist(), hi.tolist(), range(0, len(salts), 16))]
    return at, h[at], reach, around


def long_anchors(data: np.ndarray, lengths: tuple[int, ...], gram: int, segment: int = SEGMENT) -> tuple[np.ndarray, ...]:
    """The same of one text, in segments that overlap by what surroundings need."""
    out, n, length, reach = [], len(data), min(lengths), max(lengths)
    for a in range(0, max(1, n - length + 1), segment):
        lo, hi = max(0, a - reach), min(n, a + segment + length + reach)
        at, *own = anchors(data[lo:hi], np.array([0, hi - lo]), lengths, gram)
        at = at + lo
        whole = ((at - (reach - gram) >= lo) | (lo == 0)) & ((at + reach <= hi) | (hi == n))
        out.append((at[whole], *(c[whole] for c in own)))
    at, *own = (np.concatenate(c) for c in zip(*out))
    at, first = np.unique(at, return_index=True)
    return at, *(c[first] for c in own)


def repeated_starts(symbol: np.ndarray, ends: np.ndarray, lengths: tuple[int, ...], folder: str, limit: int = QUEUE_BYTES) -> Iterator[tuple[int, np.ndarray]]:
    """(number of a length, some positions in order) where strings of that length start that also start elsewhere.
    ``symbol``: shifted bytes of pieces, each with a separator, and a 0; ``ends``: the separators' places."""
    sa, shared = suffixes(symbol, folder, limit)
    n = len(symbol)
    for law, length in enumerate(lengths):
        hit, before = disk(folder, n, np.bool_), n
        for s in blocks(n):
            own, same = sa[s], shared[s] >= length
            first = np.concatenate([[before], own[:-1]])
            fits = lambda at: ends[np.minimum(np.searchsorted(ends, at), len(ends) - 1)] - at >= length
            pair = np.flatnonzero(same)
            pair = pair[fits(own[pair]) & fits(first[pair])]
            hit[own[pair]] = True
            hit[first[pair]] = True
            before = int(own[-1])
        for s in blocks(n):
            at = np.flatnonzero(hit[s]) + s.start
            if len(at):
                yield law, at


def shard_spans(pieces: Iterator[tuple[int, int, np.ndarray]], lengths: tuple[int, ...], limit: int = QUEUE_BYTES) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray]]:
    """(ids, number of a length, starts, ends) of repeated runs in the pieces (id, start, bytes) of one shard."""
    with tempfile.TemporaryDirectory(prefix="suffixes-") as folder:
        name, where, size = os.path.join(folder, "text"), [], 0
        with open(name, "wb") as f:
            for i, start, piece in pieces:
                f.write(SHIFT[piece].data)
                f.write(bytes([SEPARATOR]))
                where.append((i, start - size, size + len(piece)))
                size += len(piece) + 1
            f.write(b"\0")
        ids, shift, ends = np.array(where, np.int64).reshape(-1, 3).T
        symbol = np.asarray(np.memmap(name, np.uint8, "r"))
        for law, at in repeated_starts(symbol, ends, lengths, folder, limit):
            piece, length = np.searchsorted(ends, at), lengths[law]
            first = np.flatnonzero(np.concatenate([[True], (piece[1:] != piece[:-1]) | (at[1:] - at[:-1] > length)]))
            last = np.append(first[1:], len(at)) - 1
            own = piece[first]
            yield ids[own], law, at[first] + shift[own], at[last] + length + shift[own]


def _scanned(df: DataFrame, key: str, text: str, lengths: tuple[int, ...], gram: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in chunks(batch, text, SEGMENT):
                data, offsets = text_bytes(part.column(text))
                at, h, r, x = long_anchors(data, lengths, gram) if part.num_rows == 1 else anchors(data, offsets, lengths, gram)
                row = np.searchsorted(offsets, at, "right") - 1
                ends = np.searchsorted(row, np.arange(part.num_rows + 1))
                sha = [hashlib.sha256(data[a:b].data).digest() for a, b in zip(offsets[:-1], offsets[1:])]
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), c) for c in (pa.array(h.view(np.int64)), pa.array(x, pa.binary()), pa.array(at - offsets[row]), pa.array(r.astype(np.int32)))]
                yield pa.RecordBatch.from_arrays([part.column(key).cast(pa.int64()), pa.array(np.diff(offsets)), pa.array(sha, pa.binary()), *lists], names=["id", "n_bytes", "sha", "h", "x", "p", "r"])

    return df.select(key, text).mapInArrow(run, "id long, n_bytes long, sha binary, h array<long>, x array<binary>, p array<long>, r array<int>")


def _pieces(candidates: DataFrame, gram: int) -> DataFrame:
    """(shard, id, start, piece): the bytes that a window with one of the row's anchors can reach; those of a shard that
    overlap are one piece."""

    def run(batches):
        for batch in batches:
            out, held = [], 0
            for i, raw, hits in zip(batch.column("id").to_pylist(), batch.column("body"), batch.column("hits")):
                raw = raw.as_buffer()
                _, p, r, hot, shard = (hits.values.field(k).to_numpy(zero_copy_only=False) for k in range(5))
                p, r, shard = p[~hot], r[~hot].astype(np.int64), shard[~hot]
                if not len(p):
                    continue
                # The text is laid out once for each shard, so that one union serves them all.
                shard, lane = np.unique(shard, return_inverse=True)
                away = lane * (len(raw) + 1)
                lo, hi = merged(np.maximum(p - (r - gram), 0) + away, np.minimum(p + r, len(raw)) + away)
                for a, b in zip(lo.tolist(), hi.tolist()):
                    lane, a = divmod(a, len(raw) + 1)
                    b -= lane * (len(raw) + 1)
                    out.append((int(shard[lane]), i, a, bytes(raw[a:b])))
                    held += b - a
                if held > SEGMENT:
                    yield _rows(out)
                    out, held = [], 0
            yield _rows(out)

    def _rows(out):
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], names=["shard", "id", "start", "piece"])

    return candidates.where(F.exists("hits", lambda x: ~x["hot"])).mapInArrow(run, "shard long, id long, start long, piece binary")


def _sorted_spans(pieces: DataFrame, shards: int, lengths: tuple[int, ...]) -> DataFrame:
    """(id, law, lo, hi) from the shards' pieces, which stream through a task one shard after the other."""

    def run(batches):
        def rows():
            for batch in batches:
                yield from zip(*(batch.column(k).to_pylist() for k in ("shard", "id", "start")), batch.column("piece"))

        for _, shard in itertools.groupby(rows(), key=lambda r: r[0]):
            pieces = ((i, start, np.frombuffer(piece.as_buffer(), np.uint8)) for _, i, start, piece in shard)
            for ids, law, lo, hi in shard_spans(pieces, lengths):
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(ids), law, np.int32)), pa.array(lo), pa.array(hi)], names=["id", "law", "lo", "hi"])
            give_back()

    return pieces.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(run, "id long, law int, lo long, hi long")


def _digest(raw, place: int = 0, reach: int = 0) -> bytes:
    return hashlib.blake2b(raw, digest_size=16, salt=place.to_bytes(8, "little") + reach.to_bytes(8, "little")).digest()


def _told_apart(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows: id, p, c, k, a, b, x, many; windows at the offsets a to b of the anchor at p, whose key is k in cell c and whose
    bytes have the digest x. (done, left): rows whose bytes another row has; and one row of each bytes for keys that have
    several, ``many`` where they are known to stand at two places."""
    by = ["c", "k", "a", "b", "x"]
    # Settled, so that the joins have exchanges of their own on both sides and a hot key can be split.
    alike = settled(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.max("many").alias("many"), F.min(F.struct("id", "p")).alias("m")))
    done = rows.join(alike.where("n > 1").select(*by), by).select("id", "p", "a", "b")
    several = settled(alike.groupBy("c", "k").agg(F.count(F.lit(1)).alias("d")).where("d > 1").select("c", "k"))
    left = alike.join(several, ["c", "k"]).select("m.id", "m.p", "c", "a", "b", (F.col("many") | (F.col("n") > 1)).alias("many"))
    return done, settled(left)


def hot_spans(candidates: DataFrame, length: int, gram: int) -> DataFrame:
    """(id, lo, hi): repeated windows with frequent anchors. Those of one anchor differ by its offset in them. Equal
    surroundings settle all offsets at once. Of the others, the offsets are cut to cells; the bytes that all windows of a
    cell share extend the key, and again equal bytes settle it. What is still open is counted by whole windows."""
    last = length - gram

    def around(batches):
        for batch in batches:
            out = []
            for i, raw, hits in zip(batch.column("id").to_pylist(), batch.column("body"), batch.column("hits")):
                raw = raw.as_buffer().to_pybytes()
                h, p, r, hot = (hits.values.field(k).to_numpy(zero_copy_only=False) for k in range(4))
                hot = hot & (r >= length)
                own: dict[tuple, list[int]] = {}
                for anchor, at in zip(h[hot].tolist(), p[hot].tolist()):
                    a, b = max(0, at + length - len(raw)), min(last, at)
                    if a <= b:
                        own.setdefault((anchor, a, b, _digest(raw[at - b : at - a + length])), []).append(at)
                for (anchor, a, b, x), ats in own.items():
                    lo = np.array(ats) - b
                    runs = merged(lo, lo + b - a + length) if len(ats) > 1 else ((), ())
                    out.append((i, ats[0], 0, anchor.to_bytes(8, "little", signed=True), a, b, x, len(ats) > 1, raw[ats[0] - b : ats[0] - a + length], [{"lo": int(s), "hi": int(e)} for s, e in zip(*runs)]))
                    if len(out) >= 5000:
                        yield table_of(out, [*kinds, pa.binary(), pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))], [*names, "piece", "own"])
                        out = []
            yield table_of(out, [*kinds, pa.binary(), pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))], [*names, "piece", "own"])

    def cells(batches):
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in ("id", "p", "a", "b", "many", "from", "piece")]
            out = []
            for i, p, a, b, many, to, piece in zip(*columns):
                for c in range(a // CELL, b // CELL + 1):
                    lo, hi = c * CELL, min(c * CELL + CELL - 1, last)
                    own_lo, own_hi = max(lo, a), min(hi, b)
                    out.append((i, p, c, _digest(piece[to - lo : to - hi + length]), own_lo, own_hi, _digest(piece[to - own_hi : to - own_lo + length]), many))
            for at in range(0, len(out), 20000):
                yield table_of(out[at : at + 20000], kinds, names)

    def windows(batches):
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in ("id", "p", "a", "b", "many", "from", "piece")]
            out = [(i, p - o, _digest(piece[to - o : to - o + length]), many) for i, p, a, b, many, to, piece in zip(*columns) for o in range(a, b + 1)]
            for at in range(0, len(out), 20000):
                yield table_of(out[at : at + 20000], [pa.int64(), pa.int64(), pa.binary(), pa.bool_()], ["id", "lo", "k", "many"])

    def table_of(out, kinds, names):
        return pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], t) for j, t in enumerate(kinds)], names=names)

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()]
    names = ["id", "p", "c", "k", "a", "b", "x", "many"]
    kind = "id long, p long, c long, k binary, a long, b long, x binary, many boolean"
    places = settled(candidates.where(F.exists("hits", lambda x: x["hot"] & (x["r"] >= length))).mapInArrow(around, kind + ", piece binary, own array<struct<lo:bigint,hi:bigint>>"))
    # A row stands for its own (id, p, a, b); ``from`` is the place of the anchor in its piece.
    pieces = places.select("id", "p", F.col("b").alias("from"), "piece")
    found, left = _told_apart(places.select(*names))
    more, left = _told_apart(settled(left.drop("c").join(pieces, ["id", "p"]).mapInArrow(cells, kind)))
    ends = found.unionByName(more).select("id", (F.col("p") - F.col("b")).alias("lo"), (F.col("p") - F.col("a") + length).alias("hi"))
    each = settled(left.drop("c").join(pieces, ["id", "p"]).mapInArrow(windows, "id long, lo long, k binary, many boolean"))
    # One window can be reached by two anchors: only different places count.
    again = each.groupBy("k").agg(F.max("many").alias("many"), *(f(c).alias(f"{n}_{c}") for c in ("id", "lo") for n, f in (("least", F.min), ("most", F.max))))
    again = settled(again.where("many or least_id < most_id or least_lo < most_lo").select("k"))
    return ends.union(each.join(again, "k").select("id", "lo", (F.col("lo") + length).alias("hi"))).union(places.select("id", F.explode("own").alias("s")).select("id", "s.lo", "s.hi"))


def merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of spans as maximal runs."""
    by = np.argsort(lo, kind="stable")
    lo, hi = lo[by], np.maximum.accumulate(hi[by])
    first = np.flatnonzero(np.concatenate([[True], lo[1:] > hi[:-1]]))
    return lo[first], hi[np.append(first[1:], len(lo)) - 1]


def _homes(left: DataFrame, n: int) -> DataFrame:
    """(h, home) of the anchors of the n rows (id, p, h): the least hash of those nearby, in any of its places; a home that would hold
    more than ``HOME`` surroundings is left."""
    own = left.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("p", "h"))).alias("hits")).withColumn("g", F.transform("hits", lambda x: F.xxhash64(x["h"])))
    near = F.transform("hits", lambda x, i: F.struct(x["h"].alias("h"), F.array_min(F.slice("g", F.greatest(i + 1 - NEAR, F.lit(1)), 2 * NEAR + 1)).alias("home")))
    homes = settled(own.select(F.inline(near)).groupBy("h").agg(F.min("home").alias("home"), F.count(F.lit(1)).alias("n")), n)
    full = settled(homes.groupBy("home").agg(F.sum("n").alias("n")).where(F.col("n") > HOME).select("home", F.lit(True).alias("full")), n // HOME)
    return homes.join(full, "home", "left").select("h", F.when(F.col("full"), F.col("h")).otherwise(F.col("home")).alias("home"))


def _known(hits: DataFrame, length: int, gram: int, law: int) -> DataFrame:
    """The windows of ``length`` bytes that hold the anchor at p, as one span."""
    first, last = F.greatest(F.lit(0), F.col("p") - (length - gram)), F.least(F.col("p"), F.col("n_bytes") - length)
    return hits.where((first <= last) & (F.col("r") >= length)).select("id", F.lit(law).alias("law"), first.alias("lo"), (last + length).alias("hi"))


def repeated_spans(df: DataFrame, key: str = "doc_id", text: str = "text", lengths: tuple[int, ...] = (LENGTH,), gram: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, candidates). rows: row (its own number), id, n_bytes, sha (of the whole text) and spans_0, spans_1, ..., the
    repeated byte runs by each of ``lengths``, of every row. candidates: row and body (bytes) of at least the rows with
    spans that are not the whole text."""
    gram = gram or min(lengths) // 2
    # The numbers are those of the stored rows, so that nothing computes them again. From here on they are the ids.
    named = stored(_scanned(df, key, text, lengths, gram).withColumnRenamed("id", "key").withColumn("id", F.monotonically_increasing_id()))
    # Settled or stored, so that the joins have exchanges of their own on both sides and a hot key can be split.
    copies = settled(named.groupBy("sha").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1"), named.count() // 2)
    found = named.join(copies, "sha", "left").where("n is null or id = rep").select("id", "n_bytes", F.inline(F.arrays_zip("h", "x", "p", "r")))
    again = settled(found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"))
    hits = stored(thinned(found, again, "h").join(again, "h"))
    kinds = stored(hits.groupBy("h", "x").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "p", "r")).alias("m")).select("h", "x", "n", "m.id", "m.p", "m.r"))
    several = settled(kinds.groupBy("h").agg(F.count(F.lit(1)).alias("d")).where("d > 1").select("h", (F.col("d") > HOT).alias("hot")), kinds.count() // 2)
    left = stored(kinds.join(several, "h").select("h", "id", "p", "r", "hot"))
    same = stored(hits.join(settled(kinds.where("n > 1").select("h", "x")), ["h", "x"]).select("id", "p", "r", "n_bytes"))
    cold = left.where("not hot").count()
    shards = 1 + cold * PIECE_BYTES // SHARD_BYTES
    dealt = left.join(settled(_homes(left.where("not hot"), cold), cold), "h", "left").withColumn("shard", F.coalesce(F.pmod(F.xxhash64("home"), F.lit(shards)), F.lit(0)).cast("long"))
    marks = dealt.select("id", F.struct("h", "p", "r", "hot", "shard").alias("hit")).union(same.select("id").distinct().select("id", F.lit(None).alias("hit")))
    marked = settled(marks.groupBy("id").agg(F.collect_list("hit").alias("hits")))
    wanted = stored(thinned(named.select("id", "key", "sha"), marked, "id").join(marked, "id"))
    # A text is found again by its key and its digest: the keys may repeat, and be null.
    bodies = thinned(df.select(F.col(key).cast("long").alias("_key"), F.col(text).cast("binary").alias("body")), wanted.select(F.col("key").alias("_key")), "_key").withColumn("_sha", F.unhex(F.sha2("body", 256)))
    candidates = stored(bodies.join(wanted, F.col("_key").eqNullSafe(F.col("key")) & (F.col("_sha") == F.col("sha"))).select("id", "body", "hits"))
    spans = _sorted_spans(_pieces(candidates, gram), shards, lengths)
    for law, length in enumerate(lengths):
        spans = spans.union(_known(same, length, gram, law))
    if left.where("hot").limit(1).count():
        for law, length in enumerate(lengths):
            spans = spans.union(hot_spans(candidates, length, gram).select("id", F.lit(law).alias("law"), "lo", "hi"))
    spans = _runs(spans).groupBy("id").agg(*(F.array_sort(F.collect_list(F.when(F.col("law") == law, F.struct("lo", "hi")))).alias(f"own_{law}") for law in range(len(lengths))))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("lo"), F.col("n_bytes").alias("hi")))
    none = F.array().cast("array<struct<lo:bigint,hi:bigint>>")
    joined = named.select("id", "key", "n_bytes", "sha").join(copies.select("sha", "n"), "sha", "left").join(spans, "id", "left")
    shown = lambda law, length: F.when(F.col("n_bytes") < length, none).when(F.col("n").isNotNull(), whole).otherwise(F.coalesce(f"own_{law}", none))
    rows = settled(joined.select(F.col("id").alias("row"), F.col("key").alias("id"), "n_bytes", "sha", *(shown(law, length).alias(f"spans_{law}") for law, length in enumerate(lengths))))
    return rows, candidates.select(F.col("id").alias("row"), "body")


def n_in(spans: str) -> Column:
    """Bytes in spans."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["hi"] - s["lo"])


def _runs(spans: DataFrame) -> DataFrame:
    """(id, law, lo, hi) -> their unions as maximal runs; overlapping and touching spans are joined. One exchange by id."""
    before = Window.partitionBy("id", "law").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("id", "law").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, 0)
    first = spans.repartition("id").withColumn("first", (F.col("lo") > F.coalesce(F.max("hi").over(before), F.lit(-1))).cast("long"))
    return first.withColumn("run", F.sum("first").over(upto)).groupBy("id", "law", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def without_spans(df: DataFrame, body: str = "body", spans: str = "spans", characters: bool = False) -> DataFrame:
    """Replaces ``body`` by what the spans leave. ``characters``: a character that a span cuts stays whole."""

    def run(batches):
        for batch in batches:
            at, out = batch.schema.get_field_index(body), []
            for raw, own in zip(batch.column(at), batch.column(spans)):
                raw, own = raw.as_py() or b"", own.as_py() or []
                raw = raw.encode() if isinstance(raw, str) else raw
                kept, last = [], 0
                for s in own:
                    lo, hi = s["lo"], s["hi"]
                    while characters and lo < hi and raw[lo] & 0xC0 == 0x80:
                        lo += 1
                    while characters and lo < hi < len(raw) and raw[hi] & 0xC0 == 0x80:
                        hi -= 1
                    kept.append(raw[last:lo])
                    last = hi
                out.append(b"".join([*kept, raw[last:]]))
            column = pa.array(out, pa.binary()).cast(batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), column)

    return df.mapInArrow(run, df.schema)


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beside the columns of the contract, n_passage_bytes: bytes in strings of at least ``PASSAGE`` bytes that recur."""
    rows, candidates = repeated_spans(table(spark, sf_dir, "documents"), lengths=(LENGTH, PASSAGE))
    rows = rows.withColumn("n_removed", n_in("spans_0")).withColumn("n_passage_bytes", n_in("spans_1"))
    cut = candidates.join(rows.where("n_removed > 0 and n_removed < n_bytes").select("row", F.col("spans_0").alias("spans")), "row")
    left = without_spans(cut).select("row", F.sha2("body", 256).alias("cut_sha"))
    kept = F.when(F.col("n_removed") == 0, F.lower(F.hex("sha"))).when(F.col("n_removed") == F.col("n_bytes"), F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.col("cut_sha"))
    return rows.join(left, "row", "left").select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.size("spans_0").cast("long").alias("n_spans"), kept.alias("kept_sha256"), "n_passage_bytes")
