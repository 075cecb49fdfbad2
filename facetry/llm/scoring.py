"""Language-model scores (operator 4): masked pseudo-likelihood of a bidirectional window network, trained in numpy.

Words are counted over the whole corpus. The ``VOCABULARY`` most frequent have ids of their own in the network, by falling
counts and then by hash; every other word enters it as one of ``RARE`` buckets by its hash. The counts of all words stay in a
Spark table. A rare word's share of its bucket comes from a broadcast list, where the word is among the at most ``LISTED`` most
frequent ones, and from a join of that table with the texts that hold it, where it isn't.

The network looks at ``SIDE`` words on either side, one embedding table per place, and predicts the word between in two
softmax steps, first the group of ``GROUP`` ids of like frequency and then the id within it, both from the same hidden layer.
It starts from the corpus counts. Documents are dealt by hash to lots of about ``LOT`` words, which follow from the
corpus and not from how the table is partitioned; each lot trains a copy in the order of hashes, masking every ``MASK``-th
word as a target, from each of the ``MASK`` first places in turn, so that every word is one. The copies are averaged, weighted
by their words, in a tree of small groups. Scores add the conditional log-probabilities of all words of a text.

A null, empty or blank text has no words and the score 0. Rows are independent: repeated rows score alike; further
columns are ignored; an empty table gives no rows. Texts of any length are taken whole, one at a time where they are long.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facetry.llm.minhash import LOWER
from facetry.llm.ragged import chunks, distinct, text_bytes, word_hashes, words_of
from facetry.llm.shared import settled, stored, table

VOCABULARY, RARE, GROUP, LISTED = 4096, 64, 64, 1 << 18
SIDE, HIDDEN, MASK = 2, 16, 8
BATCH, RATE = 32768, 0.5
LOT, PARTS, TREE = 1 << 20, 8, 32
#: Largest score whose exponential is taken.
BOUND = 60.0
#: Parts of a unit in which the logarithms of counts are added up.
FINE = 1 << 32


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = LOWER[data]
    starts, lengths, first = words_of(data, offsets)
    return word_hashes(data, starts, lengths)[0], first


def word_counts(df: DataFrame, text: str) -> DataFrame:
    """(word, n): the 64-bit hash of each distinct word with its count in the corpus."""

    def run(batches):
        for batch in batches:
            held = []
            for part in chunks(batch, text, 2 << 20):
                words = hashed_words(*text_bytes(part.column(text)))[0]
                word, n = np.unique(words, return_counts=True)
                held.append(pd.DataFrame({"word": word.view(np.int64), "n": n}))
            if held:
                out = pd.concat(held).groupby("word", as_index=False)["n"].sum()
                yield pa.RecordBatch.from_pandas(out, schema=pa.schema([("word", pa.int64()), ("n", pa.int64())]), preserve_index=False)

    return df.select(text).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def fine_log(n: str) -> Column:
    """The logarithm in whole parts of 1 / ``FINE``, whose sum has no order."""
    return F.round(F.log(n) * FINE).cast("long")


def frequencies(counts: DataFrame) -> list[tuple[int, int]]:
    """(n, words): how many words occur at least n times, for the least n of every eighth of a doubling, falling."""
    step = F.floor(F.log2("n") * 8)
    sizes = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("n")).orderBy(F.desc("n")).collect()
    return list(zip([r["n"] for r in sizes], np.cumsum([r["words"] for r in sizes]).tolist()))


@dataclass
class Words:
    """The frequent words' hashes (sorted), their ids, the counts of all ids, and what a word's log-probability adds to its
    id's: that of a bucket lacks the log count of the word. ``listed`` holds hashes (sorted) and log counts (``FINE``) of the
    words that occur at least ``least`` times, all above it."""

    known: np.ndarray
    ids: np.ndarray
    total: np.ndarray
    log_share: np.ndarray
    listed: np.ndarray
    listed_log: np.ndarray
    least: int

    def rare(self, ids: np.ndarray, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, pa.ListArray]:
        """What the listed rare words add to each row, and the distinct other rare ones of each row with their numbers there."""
        at = np.flatnonzero(ids >= len(self.known))
        word = words[at].view(np.int64)
        add = np.zeros(len(ids) + 1, np.int64)
        if len(self.listed):
            place = np.minimum(np.searchsorted(self.listed, word), len(self.listed) - 1)
            hit = self.listed[place] == word
            add[at[hit] + 1] = self.listed_log[place[hit]]
            at, word = at[~hit], word[~hit]
        np.cumsum(add, out=add)
        row = np.searchsorted(first, at, "right") - 1
        by = np.lexsort((word, row))
        row, word = row[by], word[by]
        new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (word[1:] != word[:-1])])) if len(row) else row
        fields = [pa.array(word[new]), pa.array(np.diff(np.append(new, len(row))).astype(np.int64))]
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row[new], np.arange(len(first))), pa.int32()), pa.StructArray.from_arrays(fields, ["word", "m"]))
        return add[first[1:]] - add[first[:-1]], lists

    @property
    def size(self) -> int:
        return len(self.total)

    @staticmethod
    def of(counts: DataFrame) -> Words:
        held = frequencies(counts)
        # From the few words that occur often enough to be among them. Settled first: the tasks' best words are then merged by
        # a task, not by the driver.
        often = next((n for n, words in held if words >= VOCABULARY), 0)
        best = settled(counts.where(F.col("n") >= often).orderBy(F.desc("n"), "word").limit(VOCABULARY))
        top = best.orderBy(F.desc("n"), "word").toPandas()
        bucket = F.pmod("word", F.lit(RARE))
        rest = counts.join(F.broadcast(best.select("word")), "word", "left_anti")
        rare = {r["b"]: r["n"] for r in rest.groupBy(bucket.alias("b")).agg(F.sum("n").alias("n")).collect()}
        total = np.concatenate([top["n"].to_numpy(float), [rare.get(b, 0) for b in range(RARE)]])
        share = np.concatenate([np.zeros(len(top)), -np.log(np.maximum(total[len(top) :], 1))])
        by = np.argsort(top["word"].to_numpy())
        least = min((n for n, words in held if words <= LISTED), default=1 << 62)
        # At most LISTED words, the network's own left out.
        listed = rest.where(F.col("n") >= least).select("word", fine_log("n").alias("log")).toPandas().sort_values("word")
        return Words(top["word"].to_numpy()[by], by.astype(np.int32), total, share, listed["word"].to_numpy(np.int64), listed["log"].to_numpy(np.int64), least)

    def lookup(self, words: np.ndarray) -> np.ndarray:
        words = words.view(np.int64)
        out = (len(self.known) + words % RARE).astype(np.int32)
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, words), len(self.known) - 1)
            hit = self.known[at] == words
            out[hit] = self.ids[at[hit]]
        return out

    def windows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, places x words neighbours, first word of each row, hashes); ``size`` stands past a text's ends."""
        words, first = hashed_words(data, offsets)
        if len(words):
            top, kind = distinct(words, words)
            ids = self.lookup(words[top])[kind]
        else:
            ids = np.zeros(0, np.int32)
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        around = np.full((2 * SIDE, len(ids)), self.size, np.int32)
        for k, o in enumerate([*range(-SIDE, 0), *range(1, SIDE + 1)]):
            a, b = (slice(None, o), slice(-o, None)) if o < 0 else (slice(o, None), slice(None, -o))
            if abs(o) < len(ids):
                around[k, b] = np.where(row[a] == row[b], ids[a], self.size)
        return ids, around, first, words


class Network:
    """Log-probabilities of ids from their neighbours: one tanh layer over summed embeddings, then two softmax steps."""

    def __init__(self, total: np.ndarray, flat: np.ndarray | None = None):
        size, groups = len(total), -(-len(total) // GROUP)
        self.shapes = [(2 * SIDE, size + 1, HIDDEN), (HIDDEN, groups), (groups,), (groups, GROUP, HIDDEN), (groups, GROUP)]
        ends = np.cumsum([0, *(int(np.prod(s)) for s in self.shapes)])
        if flat is None:
            flat = np.random.default_rng(4).normal(0, 0.1, ends[-1])
            # Ids that no word has are out of reach.
            own = np.full(groups * GROUP, -60.0)
            own[:size] = np.log((total + 1) / (total + 1).sum())
            own = own.reshape(groups, GROUP)
            flat[ends[4] :] = own.ravel()
            flat[ends[2] : ends[3]] = np.log(np.exp(own).sum(1))
        self.flat = flat.astype(np.float32)
        self.embed, self.out, self.bias, self.word, self.word_bias = (self.flat[a:b].reshape(s) for a, b, s in zip(ends[:-1], ends[1:], self.shapes))

    def _hidden(self, around: np.ndarray) -> np.ndarray:
        h = self.embed[0][around[0]]
        for k in range(1, len(around)):
            h += self.embed[k][around[k]]
        return np.tanh(h, out=h)

    @staticmethod
    def _groups(ids: np.ndarray) -> list[tuple[int, slice]]:
        """(group, its places) of ids that are sorted by group."""
        group = ids // GROUP
        cut = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(ids)]
        return [(int(group[a]), slice(a, b)) for a, b in zip(cut[:-1], cut[1:]) if a < b]

    def log_chances(self, around: np.ndarray, ids: np.ndarray) -> np.ndarray:
        out = np.empty(len(ids))
        for at in range(0, len(ids), BATCH):
            by = np.argsort((ids[at : at + BATCH] // GROUP).astype(np.uint16), kind="stable") + at
            own, h = ids[by], self._hidden(around[:, by])
            part = _log_softmax(h @ self.out + self.bias, own // GROUP)
            for g, rows in self._groups(own):
                part[rows] += _log_softmax(h[rows] @ self.word[g].T + self.word_bias[g], own[rows] % GROUP)
            out[by] = part
        return out

    def train(self, around: np.ndarray, ids: np.ndarray, rate: float = RATE) -> None:
        for at in range(0, len(ids), BATCH):
            by = np.argsort((ids[at : at + BATCH] // GROUP).astype(np.uint16), kind="stable") + at
            near, own = around[:, by], ids[by]
            h = self._hidden(near)
            z = _softmax_less(h @ self.out + self.bias, own // GROUP)
            back = z @ self.out.T
            for g, rows in self._groups(own):
                part = h[rows]
                y = _softmax_less(part @ self.word[g].T + self.word_bias[g], own[rows] % GROUP)
                back[rows] += y @ self.word[g]
                step = np.float32(rate / max(len(part), GROUP))
                self.word[g] -= step * (y.T @ part)
                self.word_bias[g] -= step * y.sum(0)
            self.out -= np.float32(rate / len(z)) * (h.T @ z)
            self.bias -= np.float32(rate / len(z)) * z.sum(0)
            step = np.clip(back * (1 - h * h), -1, 1) * np.float32(-rate / 16)
            for k in range(len(near)):
                by = np.argsort(near[k].astype(np.uint16), kind="stable") if self.embed.shape[1] <= 1 << 16 else np.argsort(near[k], kind="stable")
                to = near[k][by]
                first = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
                self.embed[k][to[first]] += np.add.reduceat(step[by], first, axis=0)


def _log_softmax(z: np.ndarray, own: np.ndarray) -> np.ndarray:
    # Biases are logarithms of shares, so that scores need no shift; the bound is never met in practice.
    np.minimum(z, BOUND, out=z)
    picked = z[np.arange(len(z)), own]
    return picked - np.log(np.exp(z, out=z) @ np.ones(z.shape[1], z.dtype))


def _softmax_less(z: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Probabilities less 1 at the own place: the gradient of the loss."""
    np.exp(np.minimum(z, BOUND, out=z), out=z)
    z *= (1 / (z @ np.ones(z.shape[1], z.dtype)))[:, None]
    z[np.arange(len(z)), own] -= 1
    return z


def trained(df: DataFrame, words: Words, key: str, text: str) -> Network:
    """Averages the copies that the lots train."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(words)
    width = 65536
    lots = 1 + int(words.total.sum()) // LOT

    def run(batches):
        words, net, seen, now, held = shared.value, None, 0, None, []

        def learn():
            nonlocal seen
            for part in chunks(pa.Table.from_batches(held).combine_chunks().to_batches()[0], "text", 1 << 20) if held else ():
                ids, around, _, _ = words.windows(*text_bytes(part.column("text")))
                for start in range(MASK):
                    target = np.arange(start, len(ids), MASK)
                    net.train(around[:, target], ids[target])
                seen += len(ids)
            held.clear()

        def done():
            if seen:
                parts = [net.flat[at : at + width] for at in range(0, len(net.flat), width)]
                yield pa.RecordBatch.from_arrays([pa.array([now[0]] * len(parts)), pa.array(range(len(parts)), pa.int64()), pa.array([float(seen)] * len(parts)), pa.array(parts, pa.list_(pa.float32()))], names=["lot", "block", "weight", "part"])

        for batch in batches:
            lot, place = (batch.column(k).to_numpy() for k in ("lot", "place"))
            cut = np.flatnonzero((lot[1:] != lot[:-1]) | (place[1:] != place[:-1])) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(lot)]):
                if a == b:
                    continue
                if now != (lot[a], place[a]):
                    learn()
                    if now is None or now[0] != lot[a]:
                        yield from done()
                        net, seen = Network(words.total), 0
                    now = (lot[a], place[a])
                held.append(batch.slice(a, b - a))
                if sum(x.nbytes for x in held) > 8 << 20:
                    learn()
        learn()
        yield from done()

    def average(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("lot")
        weight = group["weight"].to_numpy()
        part = sum(w * np.asarray(p, np.float64) for w, p in zip(weight, group["part"])) / weight.sum()
        return pd.DataFrame({"lot": [group["lot"].iloc[0] // TREE], "block": [group["block"].iloc[0]], "weight": [weight.sum()], "part": [part.astype(np.float32)]})

    kind = "lot long, block long, weight double, part array<float>"
    h = F.xxhash64(key, text)
    dealt = df.select(F.pmod(h, F.lit(lots)).alias("lot"), F.pmod(F.shiftright(h, 32), F.lit(PARTS)).alias("place"), h.alias("h"), F.col(text).alias("text"))
    copies = dealt.repartition(lots, "lot").sortWithinPartitions("lot", "place", "h").mapInArrow(run, kind)
    while lots > 1:
        copies = copies.groupBy("block", F.floor(F.col("lot") / TREE).alias("next")).applyInPandas(lambda group: average(group), kind)
        lots = -(-lots // TREE)
    parts = copies.orderBy("block").collect()
    return Network(words.total, np.concatenate([np.array(r["part"], np.float32) for r in parts]) if parts else None)


def fitted(df: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, Words, Network]:
    """The counts of all words, the frequent ones, and the network."""
    counts = settled(word_counts(df, text))
    words = Words.of(counts)
    return counts, words, trained(df, words, key, text)


def scored(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: ``key``, n_words, score (sum of log-probabilities), mean_score."""
    counts, words, net = fitted(df, key, text)
    model = df.sparkSession.sparkContext.broadcast((words, net.flat))

    def run(batches):
        words, flat = model.value
        net = Network(words.total, flat)
        for batch in batches:
            for part in chunks(batch, text):
                ids, around, first, hashes = words.windows(*text_bytes(part.column(text)))
                logs = net.log_chances(around, ids) + words.log_share[ids]
                n = np.diff(first)
                total = np.bincount(np.repeat(np.arange(len(n)), n), logs, len(n)) if len(ids) else np.zeros(len(n))
                listed, rare = words.rare(ids, hashes, first)
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(n.astype(np.int64)), pa.array(total), pa.array(listed), rare], names=[key, "n_words", "total", "listed", "rare"])

    kind = f"`{key}` {df.schema[key].dataType.simpleString()}, n_words long, total double, listed long, rare array<struct<word:bigint,m:bigint>>"
    # Stored, so that the numbers of the rows hold and the join with all counts has exchanges on both sides.
    rows = stored(df.select(key, text).mapInArrow(run, kind).withColumn("row", F.monotonically_increasing_id()))
    # A word that occurs once adds its logarithm, 0.
    unlisted = counts.where((F.col("n") < words.least) & (F.col("n") > 1)).select("word", fine_log("n").alias("log"))
    more = rows.select("row", F.inline("rare")).join(unlisted, "word").groupBy("row").agg(F.sum(F.col("m") * F.col("log")).alias("more"))
    score = F.col("total") + (F.col("listed") + F.coalesce(F.col("more"), F.lit(0))) / FINE
    return rows.join(more, "row", "left").select(key, "n_words", score.alias("score"), (score / F.greatest("n_words", F.lit(1))).alias("mean_score"))


def op4_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents").select("doc_id", "text"))
