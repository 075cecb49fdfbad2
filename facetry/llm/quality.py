"""Quality rules (operator 10): a decision list learned by sequential covering.

:func:`with_statistics` adds counts of the whole text. :func:`learn` reads labelled rows, at most ``sample`` of them (a
documented bound; the statistics themselves cover every row), grows a conjunction of thresholds condition by condition
on two thirds of them by information gain, prunes it on the rest, and goes on with the rows that no rule covers yet.
:meth:`DecisionList.verdict` gives the ordered rules as one Spark conditional expression.

A null or empty text has only zero counts. Statistics replace columns of the same names; other columns pass through.
Repeated rows are judged alike. Without labels of both kinds the list is empty and keeps every row that the base rule keeps.
An empty table gives no rows. A very long text is counted whole, alone in its chunk, so that memory follows its bytes.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetry.llm.ragged import chunks, distinct, text_bytes, word_hashes, words_of
from facetry.llm.shared import table
from facetry.llm.tokens import with_column

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct_words", "n_lines", "n_upper", "n_exclaims", "n_digits")
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS = 50


def _marked(kinds: bytes) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(kinds)] = 1
    return out


MARKS = {"n_symbols": _marked(SYMBOLS), "n_upper": _marked(bytes(range(65, 91))), "n_exclaims": _marked(b"!"), "n_digits": _marked(bytes(range(48, 58)))}


def repeated_words(kind: np.ndarray, row: np.ndarray, size: int = 3) -> np.ndarray:
    """Which words lie in a window of ``size`` words that its row has twice or more. ``row`` ascends."""
    flagged = np.zeros(len(kind), bool)
    if len(kind) < size:
        return flagged
    window = kind.astype(np.int64)
    for k in range(1, size):
        window = np.unique(window[:-1] * (int(kind.max()) + 1) + kind[k:], return_inverse=True)[1].reshape(-1)
    n = len(window)
    own = row[:n] == row[size - 1 :]
    _, inverse, count = np.unique((window * (int(row[-1]) + 1) + row[:n])[own], return_inverse=True, return_counts=True)
    at = np.flatnonzero(own)[count[inverse.reshape(-1)] > 1]
    for k in range(size):
        flagged[at + k] = True
    return flagged


def statistics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    n = len(offsets) - 1
    sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[offsets])
    starts, lengths, first = words_of(data, offsets)
    row = np.repeat(np.arange(n), np.diff(first))
    out = {"n_words": np.diff(first), **{k: sums(v[data]) for k, v in MARKS.items()}}
    solid = np.ones(256, np.int64)
    solid[[32, *range(9, 14), *range(0x80, 0xC0)]] = 0
    out["word_chars"] = sums(solid[data])
    top, kind = distinct(*word_hashes(data, starts, lengths))
    out["n_distinct_words"] = np.bincount(np.unique(row * (len(top) + 1) + kind) // (len(top) + 1), minlength=n)
    out["n_repeat_words"] = np.bincount(row, repeated_words(kind, row), n).astype(np.int64) if len(row) else np.zeros(n, np.int64)
    raw = data.tobytes()
    lines, again = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(n):
        filled = [x for x in raw[offsets[i] : offsets[i + 1]].split(b"\n") if x.strip()]
        lines[i], again[i] = len(filled), len(filled) - len(set(filled))
    return out | {"n_lines": lines, "n_dup_lines": again}


def with_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the columns ``COUNTS``."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch, text):
                found = statistics(*text_bytes(part.column(text)))
                for name in COUNTS:
                    part = with_column(part, name, pa.array(found[name].astype(np.int64)))
                yield part

    schema = T.StructType([*(f for f in df.schema if f.name not in COUNTS), *(T.StructField(c, T.LongType()) for c in COUNTS)])
    return df.mapInArrow(run, schema)


def features() -> dict[str, Column]:
    """What the rules compare: shares that don't depend on a text's length, as Spark expressions."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    return {
        "mean_word": F.col("word_chars") / words, "symbols_per_word": F.col("n_symbols") / words, "repeat_share": F.col("n_repeat_words") / words,
        "distinct_share": F.col("n_distinct_words") / words, "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double"),
        "upper_share": F.col("n_upper") / chars, "exclaims_per_word": F.col("n_exclaims") / words, "digit_share": F.col("n_digits") / chars,
    }


@dataclass
class DecisionList:
    """Ordered rules; each is a conjunction of (feature, '<=' or '>', threshold) and rejects. The default keeps."""

    rules: list[list[tuple[str, str, float]]] = field(default_factory=list)

    def verdict(self) -> Column:
        """True for rows to keep."""
        shown, out = features(), None
        for rule in self.rules:
            test = F.lit(True)
            for name, sign, threshold in rule:
                test = test & (shown[name] <= threshold if sign == "<=" else shown[name] > threshold)
            out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
        return F.lit(True) if out is None else out.otherwise(F.lit(True))

    def rejects(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        return np.any([_covered(rule, x, names) for rule in self.rules], axis=0) if self.rules else np.zeros(len(x), bool)


def _covered(rule, x: np.ndarray, names: list[str]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for name, sign, threshold in rule:
        value = x[:, names.index(name)]
        out &= value <= threshold if sign == "<=" else value > threshold
    return out


def _grow(x: np.ndarray, bad: np.ndarray, names: list[str]) -> list[tuple[str, str, float]]:
    rule, inside = [], np.ones(len(x), bool)
    while bad[inside].any() and not bad[inside].all():
        p0, n0 = bad[inside].sum(), (~bad[inside]).sum()
        best = (1e-9, None)
        for j, name in enumerate(names):
            value, target = x[inside, j], bad[inside]
            order = np.argsort(value, kind="stable")
            value, hits = value[order], np.cumsum(target[order])
            ends = np.flatnonzero(value[1:] > value[:-1])
            for sign, p, total in (("<=", hits[ends], ends + 1), (">", p0 - hits[ends], p0 + n0 - ends - 1)):
                gain = p * (np.log2(np.maximum(p, 1e-12) / total) - np.log2(p0 / (p0 + n0)))
                if len(gain) and gain.max() > best[0]:
                    k = int(gain.argmax())
                    best = (gain[k], (name, sign, float((value[ends[k]] + value[ends[k] + 1]) / 2)))
        if best[1] is None:
            break
        rule.append(best[1])
        inside &= _covered([best[1]], x, names)
    return rule


def _prune(rule, x: np.ndarray, bad: np.ndarray, names: list[str]):
    def worth(r):
        got = _covered(r, x, names)
        p, n = (got & bad).sum(), (got & ~bad).sum()
        return (p - n) / (p + n) if p + n else -1.0

    while len(rule) > 1 and max(shorter := [worth(rule[:k] + rule[k + 1 :]) for k in range(len(rule))]) >= worth(rule):
        k = int(np.argmax(shorter))
        rule = rule[:k] + rule[k + 1 :]
    return rule


def cover(x: np.ndarray, bad: np.ndarray, names: list[str], precision: float = 0.95, seed: int = 7) -> DecisionList:
    """Sequential covering. A rule counts if at least ``precision`` of what it rejects, in either part, is bad. Rules and
    conditions have no set number: a rule grows while it gains, and the list until a rule doesn't count."""
    grow = np.random.default_rng(seed).random(len(x)) < 2 / 3
    out, open_ = DecisionList(), np.ones(len(x), bool)
    while (bad & open_ & grow).any():
        rule = _grow(x[open_ & grow], bad[open_ & grow], names)
        if rule:
            rule = _prune(rule, x[open_ & ~grow], bad[open_ & ~grow], names)
        got = _covered(rule, x, names) & open_
        if not rule or not got.any() or any((got & part).any() and bad[got & part].mean() < precision for part in (grow, ~grow)) or (got & bad).sum() < 3:
            break
        out.rules.append(rule)
        open_ &= ~got
    return out


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = 20_000, **limits) -> DecisionList:
    """Rules that reject ``label`` = 0, from at most ``sample`` labelled rows, those of the smallest key hashes."""
    labelled = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(label).alias("_label"))
    labelled = labelled.orderBy(F.xxhash64("_key"), "_key", "_label").limit(sample)
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("text")).join(F.broadcast(labelled), "_key")
    shown = features()
    stats = with_statistics(rows).where(F.col("n_words") >= LEAST_WORDS).select("_key", "_label", *(c.alias(n) for n, c in shown.items())).toPandas()
    stats = stats.sort_values(list(stats.columns), kind="stable")
    return cover(stats[list(shown)].to_numpy(float), stats["_label"].to_numpy() == 0, list(shown), **limits)


def judged(docs: DataFrame, rules: DecisionList, text: str = "text") -> DataFrame:
    """Adds the counts, ``base_failed`` and ``kept``."""
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return with_statistics(docs, text).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & rules.verdict())


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = learn(docs, table(spark, sf_dir, "labels"))
    return judged(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
