"""Byte-level BPE encoding and decoding with a contiguous rank array.

A short word keeps its part ids and the merge ranks of adjacent parts in one row of a matrix. All words of equal
length form one matrix: each pass scans every row for its least rank, deletes the boundary there and refreshes the two
neighbouring ranks. A pass takes one boundary from each live row, so the rows of a matrix stay equally long. Words
longer than ``LONG`` bytes keep their ranks in a heap over a linked list.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from functools import lru_cache

import numpy as np

from facetry.llm.ragged import WHITE_SPACE, distinct, spread, word_hashes

NONE = np.int32(2**31 - 1)
LONG = 48
SPACE, LETTER, NUMBER, OTHER = range(4)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in printable else next(rest)) for b in range(256)]


class Vocabulary:
    """Merge ranks and token bytes of a byte-level BPE file (JSON)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        self.byte_id = np.array([vocab[c] for c in letters], np.int32)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.token_bytes = [b""] * size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.decimal = [str(i) for i in range(size)]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.merged = np.array([vocab[a + b] for a, b in pairs] + [0], np.int32)
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        self._table(left << 16 | right)

    def _table(self, keys: np.ndarray) -> None:
        """Open addressing with linear probing: a pair's key gives its rank."""
        self.mask = (1 << 20) - 1
        self.keys, self.ranks = np.full(self.mask + 1, -1, np.int64), np.full(self.mask + 1, NONE, np.int32)
        todo, at = np.arange(len(keys)), keys * 0x9E3779B1 >> 12 & self.mask
        while len(todo):
            free = self.keys[at] < 0
            slot, first = np.unique(at[free], return_index=True)
            put = todo[free][first]
            self.keys[slot], self.ranks[slot] = keys[put], put
            left = self.keys[at] != keys[todo]
            todo, at = todo[left], at[left] + 1 & self.mask

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 16 | b
        at = key * 0x9E3779B1 >> 12 & self.mask
        found = self.keys[at]
        out = np.where(found == key, self.ranks[at], NONE)
        on = np.flatnonzero((found != key) & (found >= 0))
        while len(on):
            at[on] = at[on] + 1 & self.mask
            found = self.keys[at[on]]
            hit = found == key[on]
            out[on[hit]] = self.ranks[at[on[hit]]]
            on = on[~hit & (found >= 0)]
        return out

    def encode_equal(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of byte ids, all equally long -> (ids padded on the right, number of ids)."""
        n, width = ids.shape
        out, count = np.zeros_like(ids), np.full(n, width, np.int32)
        row = np.arange(n)
        if width > 1:
            ranks = self.rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
        while len(row):
            if ids.shape[1] == 1:
                out[row, :1], count[row] = ids, 1
                break
            j = ranks.argmin(1)
            at = np.arange(len(row))
            least = ranks[at, j]
            done = least == NONE
            if done.any():
                out[row[done], : ids.shape[1]], count[row[done]] = ids[done], ids.shape[1]
                live = np.flatnonzero(~done)
                row, ids, ranks, j, least = row[live], ids[live], ranks[live], j[live], least[live]
                at = at[: len(row)]
                if not len(row):
                    break
            w = ids.shape[1]
            ids[at, j] = self.merged[least]
            cols = np.arange(w - 1)
            ids = np.where(cols <= j[:, None], ids[:, :-1], ids[:, 1:])
            if w == 2:
                ranks = ranks[:, :0]
                continue
            cols = cols[:-1]
            ranks = np.where(cols < j[:, None], ranks[:, :-1], ranks[:, 1:])
            k = np.flatnonzero(j > 0)
            ranks[k, j[k] - 1] = self.rank(ids[k, j[k] - 1], ids[k, j[k]])
            k = np.flatnonzero(j < w - 2)
            ranks[k, j[k]] = self.rank(ids[k, j[k]], ids[k, j[k] + 1])
        return out, count

    def encode_long(self, word: bytes) -> list[int]:
        ids = self.byte_id[np.frombuffer(word, np.uint8)]
        first = self.rank(ids[:-1], ids[1:])
        ids, n = ids.tolist(), len(word)
        prev, after, gone = list(range(-1, n - 1)), list(range(1, n + 1)), bytearray(n)
        heap = [(int(r), i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r != NONE]
        heapq.heapify(heap)

        def offer(i: int, j: int) -> None:
            r = int(self.rank(np.array([ids[i]]), np.array([ids[j]]))[0])
            if r != NONE:
                heapq.heappush(heap, (r, i, ids[i], ids[j]))

        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], gone[j], after[i] = int(self.merged[r]), 1, after[j]
            if after[j] < n:
                prev[after[j]] = i
                offer(i, after[j])
            if prev[i] >= 0:
                offer(prev[i], i)
        return [x for x, dead in zip(ids, gone) if not dead]

    def encode_words(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start of each word's ids, number of each word's ids)."""
        count = np.zeros(len(starts), np.int64)
        parts, owners = [], []
        order = np.argsort(lengths, kind="stable")
        sorted_len = lengths[order]
        at = 0
        while at < len(order):
            width = int(sorted_len[at])
            if width > LONG:
                break
            to = min(int(np.searchsorted(sorted_len, width, "right")), at + 32768)
            own = order[at:to]
            if width:
                ids, n = self.encode_equal(self.byte_id[data[starts[own][:, None] + np.arange(width)]])
                count[own] = n
                parts.append(ids[np.arange(width) < n[:, None]])
                owners.append(own)
            at = to
        for w in order[at:]:
            word = data[starts[w] : starts[w] + lengths[w]].tobytes()
            ids = self.encode_long(word)
            count[w] = len(ids)
            parts.append(np.array(ids, np.int32))
            owners.append(np.array([w]))
        ids = np.concatenate([*parts, np.zeros(0, np.int32)])
        own = np.concatenate([*owners, np.zeros(0, np.int64)]).astype(np.int64)
        begin = np.zeros(len(starts), np.int64)
        begin[own] = np.cumsum(count[own]) - count[own]
        return ids, begin, count

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whole texts back to back -> (ids, where each text's ids begin and one past the last)."""
        raw = data.tobytes()
        marks = []
        for token in self.special:
            find, at = token.encode(), -1
            while (at := raw.find(find, at + 1)) >= 0:
                marks.append((at, at + len(find)))
        inside = [(a, b) for a, b in sorted(marks) if np.searchsorted(offsets, a, "right") == np.searchsorted(offsets, b, "left")]
        starts, lengths = split_words(data, offsets, inside)
        first, kind = distinct(*word_hashes(data, starts, lengths))
        ids, begin, count = self.encode_words(data, starts[first], lengths[first])
        if inside:
            ids, begin, count = self._special(raw, starts[first], lengths[first], ids, begin, count)
        out = ids[spread(begin[kind], count[kind])]
        ends = np.concatenate([[0], np.cumsum(count[kind])])
        return out, ends[np.searchsorted(starts, offsets)]

    def _special(self, raw, starts, lengths, ids, begin, count):
        for token, i in self.special.items():
            for w in np.flatnonzero(lengths == len(token.encode())):
                if raw[starts[w] : starts[w] + lengths[w]] == token.encode():
                    begin[w], count[w] = len(ids), 1
                    ids = np.append(ids, np.int32(i))
        return ids, begin, count


@lru_cache(1)
def letter_classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[list(WHITE_SPACE)] = SPACE
    return table


def split_words(data: np.ndarray, offsets: np.ndarray, marks: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and lengths of the words before merging: a contraction after an apostrophe; a run of letters, of
    numbers or of other signs, each with one space before it if there is one; white space, whose last character stays
    out of the run if a word follows. ``marks``: byte spans that are words of their own."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    code = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32) if len(at) < len(data) else data
    kind = letter_classes()[code]
    n = len(code)
    cut = np.zeros(n + 1, bool)
    place = lambda x: np.searchsorted(at, x)
    cut[place(offsets)] = True
    cut[0] = cut[n] = True
    for a, b in marks:
        i, j = int(place(a)), int(place(b))
        kind = kind.copy() if not kind.flags.writeable else kind
        kind[i:j] = OTHER
        cut[i] = cut[j] = True
    start = cut.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    follows = np.flatnonzero(start[1:n] & ~cut[1:n] & (kind[:-1] == SPACE)) + 1
    start[follows - 1] = True
    start[follows[code[follows - 1] == 32]] = False
    quote = np.flatnonzero((code == 39) & start[:n])
    quote = quote[~cut[quote + 1]]
    if len(quote):
        one = np.isin(code[quote + 1], [ord(c) for c in "stmd"])
        start[quote[one] + 1], start[quote[one] + 2] = False, True
        two = quote[~one]
        two = two[~cut[two + 2]] if len(two) else two
        two = two[[chr(a) + chr(b) in ("re", "ve", "ll") for a, b in zip(code[two + 1], code[two + 2])]] if len(two) else two
        start[two + 1], start[two + 3] = False, True
    start[:n] |= cut[:n]
    begin = at[np.flatnonzero(start[:n])]
    return begin, np.diff(np.append(begin, len(data)))


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)
