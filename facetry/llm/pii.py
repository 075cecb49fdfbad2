"""Personal data (operator 5): base patterns and a skip-chain conditional random field.

The base spans are the leftmost matches of the patterns of four kinds. Secrets are a feature beside these kinds: they start
from values of at least 16 signs with a digit that are assigned to a name like ``token`` (``SECRET``). The field then labels the tokens that hold a
digit or an ``@`` (any other token is outside by definition of the model): neighbours in the text share chain potentials,
and repeated tokens, or tokens that end in the same seven digits, share skip potentials however far apart they are. Each
token is tied to one other of its group, so ties grow with the text and not with its square: where the group has tokens
in base spans, to the last of these before it or else the first, which is one hop for any number of copies; otherwise to
the token of the group before it, as in the fitting. Weights are fitted by
pseudo-likelihood to the base spans and secrets of at most ``SAMPLE`` documents with at most ``TOKENS`` such tokens, of which
no document brings more than a sixteenth (documented bounds of the fit; every document is labelled, whole). For every second token of these the features that restate a pattern are hidden, so that words before, neighbours
and similar tokens must tell; so the field finds what no pattern matches: a number without its sign, a secret without its name.
Loopy belief propagation, until no message moves by more than ``STILL`` (``ROUNDS`` at most, for loops in which they
swing), gives each token's marginals; a token without a base span whose best label reaches ``SURE``
becomes part of an added span, as every secret is one. Base spans always stay.

Positions are code points, ends exclusive. A null or empty text has no spans. Rows are independent: repeated rows give
the same spans; other columns are ignored; an empty table gives no rows, and without any base span or secret nothing is
added. Texts of any length are taken whole: patterns, graph and messages take time in proportion to it. Equal texts count
once in the sample; ties in its order cannot be, as it follows distinct hashes.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetry.llm.shared import table

KINDS = ("email", "ip", "card", "phone")
#: What the field tells apart.
NAMES = (*KINDS, "secret")
LABELS = len(NAMES) + 1
SAMPLE, TOKENS, WIDTH, SURE, ROUNDS, STILL = 4000, 200_000, 4096, 0.9, 400, 1e-4
CHAIN_PRIOR, SKIP_PRIOR = 2.0, 5.0

DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
NUMBERS = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
SECRET = re.compile(r"\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\b\x20?[:=]\x20?[\"']?([A-Za-z0-9+/_-]{16,})", re.I)
HEX = re.compile(r"[0-9a-fA-F]{16,}")
DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
CALLS = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
TOKEN = re.compile(r"[^\x20\x09-\x0D]++")
WORTH = re.compile(r"[0-9@]")
PLAIN = re.compile(r"[+().0-9-]+[,;:]?")
LOCAL_SIGNS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _is_byte(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or "0") <= 255


def secrets(text: str) -> list[Span]:
    return [("secret", m.start(1), m.end(1)) for m in SECRET.finditer(text) if any("0" <= c <= "9" for c in m[1])]


def base_spans(text: str) -> list[Span]:
    """By kind as listed, then start."""
    out: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_SIGNS:
            start -= 1
        tail = DOMAIN.match(text, at + 1) if start < at else None
        if tail:
            out.append(("email", start, tail.end()))
        done = tail.end() if tail else at + 1
        at = text.find("@", done)
    for m in NUMBERS.finditer(text):
        # Each four numbers of a run in turn, as the leftmost matches are.
        start, parts = m.start(), m[0].split(".")
        for k in range(0, len(parts) - 3, 4):
            end = start + sum(map(len, parts[k : k + 4])) + 3
            if all(map(_is_byte, parts[k : k + 4])):
                out.append(("ip", start, end))
            start = end + 1
    out += [("card", m.start(), m.end()) for m in DIGITS.finditer(text) if 13 <= len(d := only_digits(m[0])) <= 19 and luhn(d)]
    out += [("phone", m.start(), m.end()) for m in CALLS.finditer(text) if 9 <= len(only_digits(m[0])) <= 15]
    return out


def shape(token: str) -> str:
    """Letters as a or A, digits as 9, in runs; other signs as they are."""
    kinds = ["9" if "0" <= c <= "9" else "A" if c.isupper() else "a" if c.isalpha() else c for c in token[:40]]
    return "".join(k for i, k in enumerate(kinds) if not i or k not in "9aA" or k != kinds[i - 1])


#: Features that restate a pattern, which come first.
TELLING = 5


def features(token: str, before: str, after: str, group: str, words: list[str]) -> list[int]:
    """``words``: those before the token, in lower case, the nearest last."""
    digits = only_digits(group)
    core = token.strip(".,;:!?()\"'")
    named = [
        "s" + shape(core), f"g{min(len(digits), 24)}{group.startswith('+')}", f"l{13 <= len(digits) <= 19 and luhn(digits)}", f"i{core.count('.') == 3 and all(p.isdecimal() and p.isascii() and _is_byte(p) for p in core.split('.'))}",
        f"@{token.count('@')}{'.' in token.rpartition('@')[2]}{token.partition('@')[0][-1:] in LOCAL_SIGNS}", f"n{min(len(only_digits(token)), 20)}", f"h{bool(HEX.fullmatch(core))}{min(len(core), 64) // 8}",
        f"b{shape(before)[:6]}", f"a{shape(after)[:6]}", f"w{words[-1] if words else ''}", f"v{' '.join(words[-2:])}",
    ]
    return [int.from_bytes(hashlib.blake2b(f"{k}{x}".encode(), digest_size=4).digest(), "little") % (WIDTH - 1) + 1 for k, x in enumerate(named)]


def half_hidden(x: np.ndarray) -> np.ndarray:
    """Features of which every second token's telling ones are 0."""
    x = x.copy()
    x[::2, :TELLING] = 0
    return x


@dataclass
class Graph:
    """Tokens of some documents: feature numbers, places, and the two kinds of edges."""

    x: np.ndarray
    places: list[tuple[int, int]]
    chain: np.ndarray
    skip: np.ndarray

    @staticmethod
    def of(text: str, base: list[Span] = []) -> Graph:  # noqa: B006
        """``base``: spans whose tokens the others of their groups are tied to."""
        marks = [m for m in TOKEN.finditer(text) if WORTH.search(text, m.start(), m.end())]
        places, tokens = [m.span() for m in marks], [m[0] for m in marks]
        near = [i > 0 and not text[places[i - 1][1] : places[i][0]].strip(" ") for i in range(len(marks))]
        groups, at = [""] * len(marks), 0
        while at < len(marks):
            to = at + 1
            while to < len(marks) and near[to]:
                to += 1
            for i in range(at, to):
                a = b = i
                while a > max(at, i - 3) and PLAIN.fullmatch(tokens[i]) and PLAIN.fullmatch(tokens[a - 1]):
                    a -= 1
                while b + 1 < min(to, i + 4) and PLAIN.fullmatch(tokens[i]) and PLAIN.fullmatch(tokens[b + 1]):
                    b += 1
                groups[i] = " ".join(tokens[a : b + 1])
            at = to
        x, last, skip, hubs = [], {}, [], {}
        sure = _touched(places, base)
        names = [_groups_of(token) for token in tokens]
        for i in np.flatnonzero(sure)[::-1].tolist():
            hubs |= dict.fromkeys(names[i], i)
        for i, token in enumerate(tokens):
            before = tokens[i - 1] if near[i] else ""
            after = tokens[i + 1] if i + 1 < len(tokens) and near[i + 1] else ""
            a = places[i][0]
            x.append(features(token, before, after, groups[i], text[max(0, a - 40) : a].lower().split()[-2:]))
            for name in names[i]:
                hub = hubs.get(name, last.get(name, i))
                if hub != i:
                    skip.append((min(hub, i), max(hub, i)))
                last[name] = i
                if sure[i]:
                    hubs[name] = i
        chain = [(i - 1, i) for i in range(len(tokens)) if near[i]]
        pairs = lambda e: np.array(sorted(set(e)), np.int64).reshape(-1, 2)
        return Graph(np.array(x, np.int64).reshape(len(tokens), -1), places, pairs(chain), pairs(set(skip) - set(chain)))

    def labels(self, spans: list[Span]) -> np.ndarray:
        """Of each token the kind of the last span that overlaps it."""
        out = np.zeros(len(self.places), np.int64)
        edges = np.array(self.places, np.int64).reshape(-1, 2)
        bounds = np.array([(a, b) for _, a, b in spans], np.int64).reshape(-1, 2)
        first, end = np.searchsorted(edges[:, 1], bounds[:, 0], "right"), np.searchsorted(edges[:, 0], bounds[:, 1])
        for (kind, _, _), a, b in zip(spans, first.tolist(), end.tolist()):
            out[a:b] = 1 + NAMES.index(kind)
        return out


def _groups_of(token: str) -> list[tuple[str, str]]:
    """The groups of similar tokens that a token is in."""
    digits, same = only_digits(token), token.strip(".,;:!?()\"'").lower()
    return [("t", same)] * bool(same) + [("d", digits[-7:])] * (len(digits) >= 7)


def _touched(places: list[tuple[int, int]], spans: list[Span]) -> np.ndarray:
    """Which tokens overlap a span."""
    edges = np.array(places, np.int64).reshape(-1, 2)
    out = np.zeros(len(places) + 1, np.int64)
    for _, a, b in spans:
        first, end = np.searchsorted(edges[:, 1], a, "right"), np.searchsorted(edges[:, 0], b)
        if first < end:
            out[first] += 1
            out[end] -= 1
    return np.cumsum(out[:-1]) > 0


@dataclass
class Field:
    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def marginals(self, g: Graph, known: np.ndarray | None = None, rounds: int = ROUNDS) -> np.ndarray:
        """Label probabilities of each token, by sum-product messages along all edges, in both directions, at once.
        ``known``: labels above 0 are evidence."""
        scores = self.unary[g.x].sum(1)
        if known is not None:
            at = np.flatnonzero(known)
            scores[at, known[at]] += 30.0
        edges = np.concatenate([g.chain, g.skip])
        if not len(edges):
            return _soft(scores)
        table = np.concatenate([np.repeat(self.chain[None], len(g.chain), 0), np.repeat(self.skip[None], len(g.skip), 0)])
        table = np.concatenate([table, table.transpose(0, 2, 1)])
        source, goal = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        back = np.roll(np.arange(len(source)), len(edges))
        message = np.zeros((len(source), LABELS))
        for _ in range(rounds):
            belief = scores.copy()
            np.add.at(belief, goal, message)
            out = (belief[source] - message[back])[:, :, None] + table
            peak = out.max(1, keepdims=True)
            out = np.log(np.exp(out - peak).sum(1)) + peak[:, 0]
            step = out - out.max(1, keepdims=True) - message
            message = message + 0.5 * step
            if np.abs(step).max() < STILL:
                break
        belief = scores.copy()
        np.add.at(belief, goal, message)
        return _soft(belief)


def _soft(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(graphs: list[tuple[Graph, np.ndarray]], steps: int = 150, rate: float = 0.1, decay: float = 1e-4) -> Field:
    """Weights of largest pseudo-likelihood; pair potentials start, and are drawn towards, favouring equal labels."""
    priors = [0.0, CHAIN_PRIOR * np.eye(LABELS), SKIP_PRIOR * np.eye(LABELS)]
    theta = [np.zeros((WIDTH, LABELS)), priors[1].copy(), priors[2].copy()]
    theta[0][:, 0] = 0.2
    size = np.cumsum([0] + [len(y) for _, y in graphs])
    x = np.concatenate([g.x for g, _ in graphs])
    y = np.concatenate([y for _, y in graphs])
    chain, skip = (np.concatenate([getattr(g, k) + o for (g, _), o in zip(graphs, size)]) for k in ("chain", "skip"))
    # Tokens that ties join to a labelled one, but no pattern labels, are unknown: neither they nor their edges count.
    near = y > 0
    while len(skip) and (near[skip[:, 0]] != near[skip[:, 1]]).any():
        near[skip[near[skip].any(1)]] = True
    known = ~near | (y > 0)
    chain, skip = (e[known[e].all(1)] for e in (chain, skip))
    target = np.eye(LABELS)[y]
    first, second = ([np.zeros_like(t) for t in theta] for _ in range(2))
    for step in range(1, steps + 1):
        scores = theta[0][x].sum(1)
        for edges, w in ((chain, theta[1]), (skip, theta[2])):
            np.add.at(scores, edges[:, 1], w[y[edges[:, 0]]])
            np.add.at(scores, edges[:, 0], w.T[y[edges[:, 1]]])
        off = (_soft(scores) - target) * (known[:, None] / len(y))
        grads = [np.zeros_like(t) for t in theta]
        np.add.at(grads[0], x, off[:, None, :])
        for edges, k in ((chain, 1), (skip, 2)):
            np.add.at(grads[k], y[edges[:, 0]], off[edges[:, 1]])
            np.add.at(grads[k].T, y[edges[:, 1]], off[edges[:, 0]])
        for k, t in enumerate(theta):
            grads[k] += decay * (t - priors[k])
            first[k] = 0.9 * first[k] + 0.1 * grads[k]
            second[k] = 0.99 * second[k] + 0.01 * grads[k] ** 2
            t -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return Field(*theta)


def added_spans(text: str, base: list[Span], field: Field | None) -> list[Span]:
    if field is None:
        return []
    named = secrets(text)
    g = Graph.of(text, base + named)
    if not len(g.places):
        return []
    known = g.labels(named + base)
    chance = field.marginals(g, known)
    label = np.where(chance.max(1) >= SURE, chance.argmax(1), 0)
    label[known > 0] = 0
    out: list[Span] = list(named)
    runs: list[list[int]] = []
    touching = {tuple(e) for e in g.chain.tolist()}
    for i in np.flatnonzero(label).tolist():
        if runs and runs[-1][-1] == i - 1 and (i - 1, i) in touching and label[i] == label[i - 1]:
            runs[-1].append(i)
        else:
            runs.append([i])
    for run in runs:
        a, b = g.places[run[0]][0], g.places[run[-1]][1]
        while b > a and text[b - 1] in ".,;:!?\"'":
            b -= 1
        while a < b and text[a] in "\"'":
            a += 1
        if a < b:
            out.append((NAMES[label[run[0]] - 1], a, b))
    return out


def shown(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (NAMES.index(s[0]), s[1], s[2])))


def learn(df: DataFrame, text: str = "text", sample: int = SAMPLE) -> Field | None:
    """Fits the field to at most ``sample`` texts that hold a digit or ``@``, those of the smallest hashes, while their tokens
    number at most ``TOKENS``; texts with more than a sixteenth of these are left to the labelling."""
    tokens = F.size(F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda t: t.rlike("[0-9@]")))
    worth = df.where(F.col(text).rlike("[0-9@]")).select(F.xxhash64(text).alias("h"), F.col(text).alias("body"), tokens.alias("n")).where(F.col("n") <= TOKENS // 16)
    sizes = worth.groupBy("h").agg(F.min("n").alias("n")).orderBy("h").limit(sample).collect()
    least, held = None, 0
    for r in sizes:
        held += r["n"]
        if held > TOKENS:
            break
        least = r["h"]
    if least is None:
        return None

    def run(batches):
        for batch in batches:
            rows = []
            for body in batch.column("body").to_pylist():
                g = Graph.of(body)
                rows.append((half_hidden(g.x).ravel().tolist(), g.chain.ravel().tolist(), g.skip.ravel().tolist(), g.labels(secrets(body) + base_spans(body)).tolist()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.list_(pa.int64())) for k in range(4)], names=["x", "chain", "skip", "y"])

    # One row of each text; equal hashes of different texts are within the bound by their least.
    chosen = worth.where(F.col("h") <= least).groupBy("h").agg(F.min("body").alias("body")).orderBy("h").select("body")
    graphs = []
    for r in chosen.mapInArrow(run, "x array<long>, chain array<long>, skip array<long>, y array<long>").toLocalIterator():
        y = np.array(r["y"], np.int64)
        graphs.append((Graph(np.array(r["x"], np.int64).reshape(len(y), -1), [], np.array(r["chain"], np.int64).reshape(-1, 2), np.array(r["skip"], np.int64).reshape(-1, 2)), y))
    graphs = [g for g in graphs if len(g[1])]
    return fit(graphs) if any(y.any() for _, y in graphs) else None


def with_spans(df: DataFrame, field: Field | None, text: str = "text", out: str = "pii") -> DataFrame:
    """Adds ``out``: array of (kind, lo, hi, base)."""
    kind = "array<struct<kind:string,lo:bigint,hi:bigint,base:boolean>>"
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("lo", pa.int64()), ("hi", pa.int64()), ("base", pa.bool_())]))
    weights = df.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        from facetry.llm.tokens import with_column

        for batch in batches:
            rows = []
            for body in batch.column(text):
                body = body.as_py() or ""
                found: list[dict] = []
                if WORTH.search(body):
                    base = base_spans(body)
                    found = [{"kind": k, "lo": a, "hi": b, "base": True} for k, a, b in base]
                    found += [{"kind": k, "lo": a, "hi": b, "base": False} for k, a, b in added_spans(body, base, weights.value)]
                    found.sort(key=lambda s: (NAMES.index(s["kind"]), s["lo"], s["hi"]))
                rows.append(found)
            yield with_column(batch, out, pa.array(rows, arrow))

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != out), f"`{out}` {kind}"])
    return df.mapInArrow(run, schema)


def masked(df: DataFrame, text: str = "text", spans: str = "pii") -> DataFrame:
    """Replaces every span, overlapping ones together, by its kind in angle brackets; drops ``spans``."""

    def run(batches):
        for batch in batches:
            at, rows = batch.schema.get_field_index(text), []
            for body, own in zip(batch.column(at), batch.column(spans)):
                body, own = body.as_py(), own.as_py() or []
                if body is not None and own:
                    parts, last = [], 0
                    for s in sorted(own, key=lambda s: (s["lo"], -s["hi"])):
                        if s["lo"] >= last:
                            parts += [body[last : s["lo"]], f"<{s['kind']}>"]
                        last = max(last, s["hi"])
                    body = "".join([*parts, body[last:]])
                rows.append(body)
            batch = batch.set_column(at, batch.schema.field(at), pa.array(rows, batch.schema.field(at).type))
            yield batch.drop_columns([spans])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != spans)
    return df.mapInArrow(run, schema)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beside the columns of the contract, whose ``spans`` hold the four kinds: secrets (spans of assigned secrets and of tokens
    that the field takes for one), n_added (spans of the four kinds beyond the base ones) and n_found (all spans)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_spans(docs, learn(docs)).select("doc_id", "pii")
    base = F.filter("pii", lambda s: s["base"])
    own, secret = F.filter("pii", lambda s: s["kind"] != "secret"), F.filter("pii", lambda s: s["kind"] == "secret")
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["lo"].cast("string"), s["hi"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(line(base), 256).alias("base_sha256"), line(own).alias("spans"), line(secret).alias("secrets"), (F.size(own) - F.size(base)).cast("long").alias("n_added"), F.size("pii").cast("long").alias("n_found"))
