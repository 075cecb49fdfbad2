"""Phrase collocations (operator 13): vertical partitioning of the word suffixes by prefix, one truncated subtree a group.

Three passes over the texts. The first counts words, which are given codes: by rank up to ``LISTED``, beyond that by a
hash that is checked to tell all words of the corpus apart (another seed is taken if it doesn't). The second counts pairs of
adjacent frequent words, and leaves a bitmap of the frequent ones. The third cuts every suffix after its last frequent
pair, or after ``DEPTH`` words. A phrase that occurs ``least`` times has only frequent pairs, so no count is lost.

Suffixes of one prefix go to one group. A prefix is a word; where the word has more than the budget of suffixes, a pair;
where the pair has, the whole suffix. There are as many groups as keep a group at about the budget. Each group sorts its
suffixes and is read once, in order: a run of equal first k words is a node of depth k, its leaf total the phrase's count. A
node above its prefix is spread over groups, whose totals are added. Equal suffixes are counted within a task before
they are exchanged, so that a frequent passage costs a row for each task.

Scores, cuts and the removal of contained candidates are joins over the frequent phrases only. The list of the longest
prefixes and the list of words by rank are broadcast: both have at most ``LISTED`` entries, since the budget rises with the
corpus. Working memory follows ``chunks`` of text and ``HELD``, and rows leave a task in batches of ``SENT``, which Spark reads
whole; a longer text is cut where a piece ends.

A null text has no words, a null language is ``und``. Rows count as often as they stand in the table; ids and other
columns are ignored; ties go to the phrase that is first in bytes; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facetry.llm.ragged import U64, chunks, give_back, mix, text_bytes, word_hashes
from facetry.llm.shared import partitions, settled, stored, table

DEPTH, LEAST, PERCENT, SHOWN = 4, 30, 80, 2000
#: Suffixes of a group; entries of a broadcast list; bits of the bitmap; bytes of text worked on at once; rows kept in a task
#: before they are counted and sent on; rows sent at once.
BUDGET, LISTED, BITS, CHUNK, HELD, SENT = 1 << 20, 1 << 20, 1 << 26, 1 << 22, 1 << 20, 1 << 16
#: No word, and the first code that is not a rank.
NONE, HASHED = -1, 1 << 62
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
ENDS = np.zeros(256, bool)
ENDS[list(b".,;:!?\x0a\x0b\x0c\x0d")] = True
BLANK = ENDS.copy()
BLANK[[9, 32]] = True


def segments(data: np.ndarray, offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, offsets, row of each part): whole rows up to ``limit`` bytes, longer rows in parts that end where a piece ends."""
    at, rows = 0, len(offsets) - 1
    while at < rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        begin, end = int(offsets[at]), int(offsets[to])
        if end - begin <= limit:
            yield data[begin:end], offsets[at : to + 1] - begin, np.arange(at, to)
        else:
            while begin < end:
                cut = end
                if end - begin > limit:
                    stop = np.flatnonzero(ENDS[data[begin : begin + limit]])
                    look = begin + limit
                    while not len(stop) and look < end:
                        stop = np.flatnonzero(ENDS[data[look : look + limit]]) + look - begin
                        look += limit
                    cut = begin + int(stop[-1]) + 1 if len(stop) else end
                yield data[begin:cut], np.array([0, cut - begin]), np.array([at])
                begin = cut
        at = to
    give_back()


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, lengths, row, whether the next word is in the same piece)."""
    solid = ~BLANK[data]
    head, tail = solid.copy(), solid.copy()
    head[1:] &= ~solid[:-1]
    tail[:-1] &= ~solid[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    head[inner] = solid[inner]
    tail[inner - 1] = solid[inner - 1]
    starts = np.flatnonzero(head)
    row = np.searchsorted(offsets, starts, "right") - 1
    piece = np.searchsorted(np.flatnonzero(ENDS[data]), starts)
    same = np.zeros(len(starts), bool)
    same[:-1] = (row[1:] == row[:-1]) & (piece[1:] == piece[:-1])
    return starts, np.flatnonzero(tail) + 1 - starts, row, same


def spelled(data: np.ndarray, lengths: np.ndarray) -> pa.DictionaryArray:
    """The words, each distinct one once: exact, by their bytes, which are all that are not blank."""
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    body = data[~BLANK[data]]
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(body)]).dictionary_encode()


def read(batch: pa.RecordBatch, lang: str, text: str):
    """For each segment: languages, and of each word its language (by number), spelling and whether the next is in its piece."""

    def parsed(part: np.ndarray, own: np.ndarray, of_row: np.ndarray):
        part = LOWER[part]
        _, lengths, row, same = words(part, own)
        return of_row[row], spelled(part, lengths), same

    for some in chunks(batch, text, CHUNK):
        langs = some.column(lang).fill_null("und").dictionary_encode()
        of_row, names = langs.indices.to_numpy(zero_copy_only=False), langs.dictionary.to_pylist()
        for part, own, rows in segments(*text_bytes(some.column(text))):
            of, held, same = parsed(part, own, of_row[rows])
            if len(of):
                yield names, of, held, same


def word_counts(docs: DataFrame, lang: str, text: str) -> DataFrame:
    """(lang, word, n) of every word."""

    def run(batches):
        for batch in batches:
            for names, of, held, _ in read(batch, lang, text):
                at = held.indices.to_numpy().astype(np.int64) * len(names) + of
                pair, n = np.unique(at, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in (pair % len(names)).tolist()], pa.string()), held.dictionary.take(pa.array(pair // len(names))).cast(pa.binary()).cast(pa.string()), pa.array(n)], names=["lang", "word", "n"])

    return docs.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def hashes(words_: pa.Array, langs: list[str], of: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each (language, word)."""
    own, ends = text_bytes(pa.array(langs, pa.string()))
    body, at = text_bytes(words_)
    h = word_hashes(own, ends[:-1], np.diff(ends), seed)[0]
    return mix(word_hashes(body, at[:-1], np.diff(at), seed)[0] ^ mix(h + U64(1))[of])


def hashed(counts: DataFrame, seed: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                langs = batch.column("lang").dictionary_encode()
                h = hashes(batch.column("word"), langs.dictionary.to_pylist(), langs.indices.to_numpy(), seed)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(h.view(np.int64))], names=[*batch.schema.names, "h"])

    return counts.mapInArrow(run, "lang string, word string, n long, h long")


class Codes:
    """The codes of words, in a task: the sorted hashes of the listed words, and whether others may be frequent."""

    def __init__(self, listed: np.ndarray, others: bool, seed: int):
        self.order = np.argsort(listed)
        self.sorted, self.others, self.seed = listed[self.order], others, seed

    def of(self, names: list[str], of: np.ndarray, held: pa.DictionaryArray) -> np.ndarray:
        """Of each word; ``NONE`` for words that are surely rare."""
        pair, back = np.unique(held.indices.to_numpy().astype(np.int64) * len(names) + of, return_inverse=True)
        h = hashes(held.dictionary.take(pa.array(pair // len(names))), names, pair % len(names), self.seed)
        at = np.minimum(np.searchsorted(self.sorted, h), max(len(self.sorted) - 1, 0))
        known = self.sorted[at] == h if len(self.sorted) else np.zeros(len(h), bool)
        other = (h >> U64(2)).astype(np.int64) | HASHED if self.others else np.full(len(h), NONE)
        return np.where(known, self.order[at] if len(self.sorted) else 0, other)[back.reshape(-1)]


def unsigned(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int64, copy=False).view(U64)


def pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(mix(unsigned(a)) * U64(0x9E3779B97F4A7C15) + unsigned(b))


def joined(held: tuple[list[np.ndarray], ...]) -> list[np.ndarray]:
    """The columns whose parts ``held`` has; it is emptied, so that few of them are there twice."""
    columns = []
    for parts in held:
        columns.append(np.concatenate(parts))
        parts.clear()
    return columns


def summed(keys: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Equal rows of the columns ``keys``, counted as far as a sort by a hash brings them together. The list gets the result."""
    if len(keys) == 1:
        keys[0] = np.sort(keys[0])
    else:
        h = pair_keys(keys[0], keys[1])
        for k in keys[2:]:
            h = mix(h + unsigned(k) * U64(0x9E3779B97F4A7C15))
        order = np.argsort(h)
        del h
        for i in range(len(keys)):
            keys[i] = keys[i][order]
        del order
    head = np.zeros(len(keys[0]), bool)
    head[:1] = True
    for k in keys:
        head[1:] |= k[1:] != k[:-1]
    at = np.flatnonzero(head)
    total = np.diff(np.append(at, len(head)))
    for i in range(len(keys)):
        keys[i] = keys[i][at]
    return keys, total


def among(x: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)
    return sorted_[at] == x if len(sorted_) else np.zeros(len(x), bool)


def slices(rows: int) -> Iterator[slice]:
    """What is sent at once of so many rows. Freed memory goes back at the end: no later part of the text does it."""
    for at in range(0, rows, SENT):
        yield slice(at, at + SENT)
    give_back()


def pair_counts(docs: DataFrame, lang: str, text: str, codes) -> DataFrame:
    """(pair, n): occurrences of adjacent words that may be frequent, by a hash of the two."""

    def sent(held):
        (pair,), n = summed(joined(held))
        for s in slices(len(n)):
            yield pa.RecordBatch.from_arrays([pa.array(pair[s]), pa.array(n[s])], names=["pair", "n"])

    def keys(code, same):
        on = np.flatnonzero(same[:-1] & (code[:-1] != NONE) & (code[1:] != NONE))
        return pair_keys(code[on], code[on + 1]).view(np.int64)

    def run(batches):
        held, rows = ([],), 0
        for batch in batches:
            for names, of, found, same in read(batch, lang, text):
                held[0].append(keys(codes.value.of(names, of, found), same))
                rows += len(held[0][-1])
                if rows >= 2 * HELD:
                    yield from sent(held)
                    rows = 0
        if rows:
            yield from sent(held)

    return docs.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def bitmap(pairs: DataFrame) -> np.ndarray:
    """Which of ``BITS`` places the hashes of the pairs fall on, as bytes: 8 MB at most."""
    place = F.pmod(F.col("pair"), F.lit(BITS)) + 1  # Spark counts bits and buckets from 1
    maps = pairs.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m"))
    out = np.zeros(BITS // 8, np.uint8)
    for r in maps.toLocalIterator():
        own = np.frombuffer(bytes(r["m"]), np.uint8)
        at = (r["b"] - 1) * len(own)
        out[at : at + len(own)] = own
    return out


def suffixes(docs: DataFrame, lang: str, text: str, codes, frequent, over_words, over_pairs, groups: int) -> DataFrame:
    """(group, a, b, c, d, n): suffixes of two words or more, cut after their last frequent pair; missing words are ``NONE``."""

    def sent(held):
        all_, counts = summed(joined(held))
        for s in slices(len(counts)):
            columns = [c[s].astype(np.int64, copy=False) for c in all_]
            a, b = columns[:2]
            prefix = mix(unsigned(a))
            long = among(a, over_words.value)
            both = pair_keys(a, b)
            prefix[long] = both[long]
            whole = long & among(both.view(np.int64), over_pairs.value)
            rest = mix(mix(both + unsigned(columns[2])) + unsigned(columns[3]))
            prefix[whole] = rest[whole]
            group = (prefix % U64(groups)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (group, *columns, counts[s])], names=["g", "a", "b", "c", "d", "n"])

    def cut(code, same):
        go = np.zeros(len(code) + DEPTH, bool)
        on = np.flatnonzero(same[:-1] & (code[:-1] != NONE) & (code[1:] != NONE))
        place = pair_keys(code[on], code[on + 1]).view(np.int64) % BITS
        go[on] = frequent.value[place >> 3] >> (place & 7).astype(np.uint8) & 1
        at = np.flatnonzero(go)
        # Ranks fit into 32 bits, which lets twice as many suffixes be counted together.
        padded = np.append(code, [NONE] * DEPTH).astype(np.int64 if codes.value.others else np.int32)
        third = go[at + 1]
        fourth = third & go[at + 2]
        return padded[at], padded[at + 1], np.where(third, padded[at + 2], NONE), np.where(fourth, padded[at + 3], NONE)

    def run(batches):
        held, rows = ([], [], [], []), 0
        for batch in batches:
            for names, of, found, same in read(batch, lang, text):
                for column, part in zip(held, cut(codes.value.of(names, of, found), same)):
                    column.append(part)
                rows += len(held[0][-1])
                if rows >= HELD * (1 if codes.value.others else 2):
                    yield from sent(held)
                    rows = 0
        if rows:
            yield from sent(held)

    return docs.mapInArrow(run, "g int, a long, b long, c long, d long, n long")


def subtrees(rows: DataFrame, over_pairs, least: int) -> DataFrame:
    """Suffixes sorted within their partitions -> (words, n): the nodes of depth 2 and more that have ``least`` leaves, and parts
    of nodes that are spread over groups."""

    def nodes(key: np.ndarray, n: np.ndarray):
        split = np.isin(pair_keys(key[:, 0], key[:, 1]).view(np.int64), over_pairs.value) & (key.shape[1] < DEPTH)
        on = (n >= least) | split
        key, n = key[on], n[on]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * key.shape[1], pa.int32()), pa.array(key.ravel()))
        return pa.RecordBatch.from_arrays([lists, pa.array(n)], names=["words", "n"])

    def run(batches):
        open_: dict[int, tuple[np.ndarray, int]] = {}
        for batch in batches:
            all_ = np.stack([batch.column(c).to_numpy() for c in "abcd"], 1)
            leaves = batch.column("n").to_numpy()
            for depth in range(2, DEPTH + 1):
                on = all_[:, depth - 1] != NONE
                key, n = all_[on, :depth], leaves[on]
                if not len(n):
                    continue
                head = np.ones(len(n), bool)
                head[1:] = (key[1:] != key[:-1]).any(1)
                at = np.flatnonzero(head)
                key, n = key[at], np.add.reduceat(n, at)
                if depth in open_:
                    last, count = open_[depth]
                    if np.array_equal(last, key[0]):
                        n[0] += count
                    else:
                        key, n = np.concatenate([last[None], key]), np.append([count], n)
                open_[depth] = (key[-1].copy(), int(n[-1]))
                if len(n) > 1:
                    yield nodes(key[:-1], n[:-1])
        for key, count in open_.values():
            yield nodes(key[None], np.array([count]))

    return rows.mapInArrow(run, "words array<long>, n long")


def phrase_counts(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words, f) of the phrases of 1 to ``DEPTH`` words that occur ``least`` times, (code, lang, word) of the frequent words,
    and (lang, total)."""
    spark = docs.sparkSession
    docs = docs.select(lang, text)
    counts = settled(word_counts(docs, lang, text))
    seed = 0
    while True:
        numbered = settled(hashed(counts, seed))
        if not numbered.groupBy(F.shiftrightunsigned("h", 2)).agg(F.count(F.lit(1)).alias("k")).where("k > 1").head(1):
            break
        seed += 1
    common = numbered.where(F.col("n") >= least)
    top = common.orderBy(F.desc("n"), "h").limit(LISTED).select("h", "n").toPandas()
    others = len(top) == LISTED and common.count() > LISTED
    total = counts.agg(F.sum("n")).first()[0] or 0
    budget = max(BUDGET, total // LISTED)
    share = lambda x: spark.sparkContext.broadcast(x)
    listed = top["h"].to_numpy(np.int64).view(U64)
    codes = share(Codes(listed, others, seed))
    rank = spark.createDataFrame(top.assign(rank=np.arange(len(top)))[["h", "rank"]], "h long, rank long")
    # At most LISTED rows of two longs.
    code = F.coalesce("rank", F.shiftrightunsigned("h", 2).bitwiseOR(F.lit(HASHED)))
    vocabulary = settled(common.join(F.broadcast(rank), "h", "left").select(code.alias("code"), "lang", "word", "n"))
    over_words = share(np.array(sorted(r["code"] for r in vocabulary.where(F.col("n") > budget).select("code").collect()), np.int64))
    pairs = settled(pair_counts(docs, lang, text, codes).where(F.col("n") >= least))
    over_pairs = share(np.array(sorted(r["pair"] for r in pairs.where(F.col("n") > budget).select("pair").collect()), np.int64))
    frequent = share(bitmap(pairs))
    groups = 1 + (pairs.agg(F.sum("n")).first()[0] or 0) // budget
    dealt = suffixes(docs, lang, text, codes, frequent, over_words, over_pairs, groups)
    sorted_ = dealt.repartition(max(groups, partitions(spark)), "g").select(*"abcdn").sortWithinPartitions(*"abcd")
    nodes = subtrees(sorted_, over_pairs, least).groupBy("words").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    single = vocabulary.select(F.array("code").alias("words"), F.col("n").alias("f"))
    return stored(nodes.union(single)), vocabulary.drop("n"), counts.groupBy("lang").agg(F.sum("n").alias("total"))


def parts_of(words_: Column, least: int, most: int) -> Column:
    """The contiguous parts of ``least`` to ``most`` words of a phrase, the whole aside."""
    size = F.size(words_)
    each = lambda k: F.when(size > k, F.transform(F.sequence(F.lit(1), size - k + 1), lambda i: F.slice(words_, i, k)))
    return F.flatten(F.array(*(F.coalesce(each(k), F.array().cast("array<array<long>>")) for k in range(least, most + 1))))


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, percent: int = PERCENT, shown: int = SHOWN) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the ``shown`` best phrases of each language."""
    counts, vocabulary, totals = phrase_counts(docs, lang, text, least)
    phrases = counts.where(F.size("words") > 1)
    # Settled, like the other side of each join: a part of many phrases can be split.
    within = settled(phrases.where(F.size("words") > 2).select(F.explode(parts_of(F.col("words"), 2, DEPTH - 1)).alias("words"), "f").groupBy("words").agg(F.max("f").alias("longer")))
    kept = phrases.join(within, "words", "left").where("longer is null or cast(longer as decimal(38,0)) * 100 < cast(f as decimal(38,0)) * " + str(int(percent)))
    cuts = kept.select("words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("words", "a", "k", F.slice("words", 1, F.col("k")).alias("first"), F.slice("words", F.col("k") + 1, F.size("words") - F.col("k")).alias("rest"))
    sides = cuts.join(counts.select(F.col("words").alias("first"), F.col("f").alias("l")), "first").join(counts.select(F.col("words").alias("rest"), F.col("f").alias("r")), "rest")
    score = F.expr("cast(cast(2000000 as decimal(38,0)) * cast(a as decimal(19,0)) div (l + r) as long)")
    best = sides.groupBy("words", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("m")).select("words", "a", "m.l", "m.r", "m.score")
    # A phrase's words are one language's: its first word names it.
    long = settled(best).select("words", "a", "l", "r", "score", F.posexplode("words").alias("at", "code")).join(vocabulary, "code")
    said = long.groupBy("words", "a", "l", "r", "score").agg(F.first("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # First within buckets, so that no task ranks a whole language.
    some = said.withColumn("bucket", F.pmod(F.xxhash64("phrase"), F.lit(partitions(docs.sparkSession)))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "bucket").orderBy(*order))).where(F.col("rank") <= shown)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= shown)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


OP13_SQL = """
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS MATERIALIZED (SELECT row_number() OVER () AS p, lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d)),
v AS (SELECT lang, w1, lead(w1) OVER q AS w2, lead(w1, 2) OVER q AS w3, lead(w1, 3) OVER q AS w4 FROM (SELECT p, lang, unnest(w) AS w1, unnest(range(1, len(w) + 1)) AS i FROM p) WINDOW q AS (PARTITION BY p ORDER BY i)),
g AS (SELECT lang, 1 AS k, w1 AS phrase FROM v UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM v WHERE w2 IS NOT NULL UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM v WHERE w3 IS NOT NULL UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM v WHERE w4 IS NOT NULL),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
c AS MATERIALIZED (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE k > 1),
s AS (SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, cut, (2000000::HUGEINT * c.a // (x.f + y.f))::BIGINT AS score FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : cut], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[cut + 1 : c.k], ' ')),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS i FROM s) WHERE i = 1),
x AS (SELECT lang, array_to_string(w[i : i + j - 1], ' ') AS phrase, max(a) AS longer FROM (SELECT lang, w, a, k, j, unnest(range(1, k - j + 2)) AS i FROM c, range(2, 4) r(j) WHERE j < k) GROUP BY ALL),
o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM b LEFT JOIN x ON x.lang = b.lang AND x.phrase = b.phrase WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT o.lang, rank, phrase, a, l, r, n, score FROM o JOIN n ON n.lang = o.lang WHERE rank <= 2000
"""
