"""Suffixes with their common prefixes by external induced sorting (Bingmann, Fischer, Osipov 2013), for operator 7.

A suffix is *small* if it is less than the one after it, else *large*; a small one after a large one is a *valley*. The
slices from one valley to the next, through the run of equal symbols there and the symbol after it, are sorted and
named; of slices made this way none begins another, so that two of them differ in a symbol. The string of names is sorted
by the same method, down to a string of different names. From the sorted valleys a queue of tuples (position, rank of the
first symbol, common prefix with the tuple before it in its bucket) yields first the large and then the small suffixes.

Common prefixes count bytes of the first string on every level: a name weighs what it advances, and neighbouring names
bring the bytes that their slices share. A tuple's prefix is the weight of its first symbol and the least prefix between
its source and the one before that went to the same bucket.

Symbols, kinds, runs, names and results lie on disk as memory maps, and so do the tuples beyond ``limit`` bytes; arrays in
memory hold ``BLOCK`` tuples, ``CHUNK`` slices, or the symbols of ``SPAN`` suffixes.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

U64 = np.uint64
BLOCK, CHUNK, SPAN = 1 << 15, 1 << 17, 1 << 13
MOST = np.iinfo(np.int64).max
#: Splitting words of a distribution of slices; ranges of a queue that tuples reach together.
SPLITS, GROUP = 64, 32
#: Tuples of a range that are followed for several steps at once, and the steps.
NARROW, STEPS = 256, 32


def disk(folder: str, n: int, kind) -> np.ndarray:
    """An array of zeros in a file that goes with it."""
    if not n:
        return np.zeros(0, kind)
    handle, name = tempfile.mkstemp(dir=folder)
    os.close(handle)
    out = np.memmap(name, kind, "w+", shape=(n,))
    os.remove(name)
    return np.asarray(out)


def blocks(n: int, size: int = BLOCK) -> Iterator[slice]:
    return (slice(a, min(n, a + size)) for a in range(0, n, size))


class Queue:
    """Rows of three numbers in numbered ranges, first in first out within a range. Beyond ``limit`` bytes the ranges that
    hold most go to disk."""

    def __init__(self, ranges: int, folder: str, limit: int):
        self.parts: list[list[np.ndarray]] = [[] for _ in range(ranges)]
        self.sizes, self.held, self.limit = np.zeros(ranges, np.int64), 0, limit
        self.folder = tempfile.mkdtemp(dir=folder)
        self.files: dict[int, int] = {}
        self.spilled = 0

    def _name(self, which: int) -> str:
        return os.path.join(self.folder, str(which))

    def push(self, which: int, rows: np.ndarray) -> None:
        self.parts[which].append(rows)
        self.sizes[which] += rows.nbytes
        self.held += rows.nbytes
        if self.held > self.limit:
            while self.held > self.limit // 2:
                self._spill(int(self.sizes.argmax()))

    def deal(self, ranges: np.ndarray, rows: np.ndarray) -> None:
        """Pushes rows; ``ranges`` ascend."""
        cut = [0, *(np.flatnonzero(ranges[1:] != ranges[:-1]) + 1).tolist(), len(rows)]
        for a, b in zip(cut[:-1], cut[1:]):
            if a < b:
                self.push(int(ranges[a]), rows[a:b].copy())

    def _spill(self, which: int) -> None:
        with open(self._name(which), "ab") as f:
            for x in self.parts[which]:
                f.write(np.ascontiguousarray(x).data)
        self.files.setdefault(which, 0)
        self.spilled += int(self.sizes[which])
        self.held -= int(self.sizes[which])
        self.parts[which], self.sizes[which] = [], 0

    def pull(self, which: int, most: int | None = None) -> np.ndarray | None:
        """The oldest rows of a range, about ``most`` or else all; None if there are none."""
        out = []
        if which in self.files:
            at = self.files[which]
            rows = np.fromfile(self._name(which), np.int64, -1 if most is None else 3 * most, offset=at).reshape(-1, 3)
            self.files[which] = at + rows.nbytes
            if self.files[which] >= os.path.getsize(self._name(which)):
                os.remove(self._name(which))
                del self.files[which]
            if most is not None:
                return rows
            out.append(rows)
        parts = self.parts[which]
        take = len(parts)
        if most is not None:
            got, take = 0, 0
            while take < len(parts) and got < most:
                got += len(parts[take])
                take += 1
        out += parts[:take]
        del parts[:take]
        freed = sum(x.nbytes for x in out[len(out) - take :]) if take else 0
        self.sizes[which] -= freed
        self.held -= freed
        return np.concatenate(out) if out else None

    def drain(self, which: int) -> Iterator[np.ndarray]:
        while (rows := self.pull(which, BLOCK)) is not None:
            yield rows


class Least:
    """Least value of any run of an array: by blocks of 64, with doubling steps over the blocks' least values."""

    def __init__(self, values: np.ndarray):
        self.values = values
        least = np.array([values[s].min() for s in blocks(len(values), 64)], np.int64)
        self.steps = [least]
        while 2 ** len(self.steps) <= len(least):
            step = 2 ** (len(self.steps) - 1)
            self.steps.append(np.minimum(self.steps[-1][:-step], self.steps[-1][step:]))

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Least of values[first : last + 1]; ``first <= last``."""
        out = np.minimum(self.values[first], self.values[last])
        wide = np.flatnonzero(last - first > 1)
        for part in (wide[s] for s in blocks(len(wide), 4096)):
            a, b = first[part], last[part]
            near = np.arange(64)
            left, right = np.minimum(a[:, None] + near, b[:, None]), np.maximum(b[:, None] - near, a[:, None])
            best = np.minimum(self.values[left].min(1), self.values[right].min(1))
            lo, hi = a // 64 + 1, b // 64 - 1
            inner = np.flatnonzero(lo <= hi)
            if len(inner):
                step = np.frexp((hi - lo + 1)[inner])[1] - 1
                for k in np.unique(step):
                    own = inner[step == k]
                    best[own] = np.minimum(best[own], np.minimum(self.steps[k][lo[own]], self.steps[k][hi[own] - 2**k + 1]))
            out[part] = best
        return out


def _between(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Least of values[first : last + 1] in memory."""
    length = last - first + 1
    step = np.frexp(length)[1] - 1
    out = np.empty(len(first), np.int64)
    level, k = values, 0
    for want in np.unique(step):
        while k < want:
            level = np.minimum(level[: -(1 << k)], level[1 << k :])
            k += 1
        own = np.flatnonzero(step == want)
        out[own] = np.minimum(level[first[own]], level[last[own] - (1 << k) + 1])
    return out


@dataclass
class Level:
    """A string with one 0, at its end, and what its symbols stand for in bytes."""

    symbol: np.ndarray
    n: int
    byte: np.ndarray | None
    weight: np.ndarray | None
    near: Least | None
    folder: str
    #: Of places and bytes of the first string.
    kind: type

    def __post_init__(self):
        n, self.top = self.n, int(max(self.symbol[s].max() for s in blocks(self.n)))
        self.small, self.run_end = disk(self.folder, n, np.bool_), disk(self.folder, n, self.kind)
        valleys = 1
        after, kind_after = n, True
        for a in reversed(range(0, n, BLOCK)):
            b = min(n, a + BLOCK)
            own = np.asarray(self.symbol[a : b + 1])[: b - a + (b < n)]
            change = np.append(own[1:] != own[:-1], [] if b < n else [True])
            ends = np.where(change, np.arange(a + 1, b + 1), MOST)
            ends = np.minimum(np.minimum.accumulate(ends[::-1])[::-1], after)
            self.run_end[a:b], after = ends, int(ends[0])
            small = np.ones(b - a, bool)
            inside = ends < n
            small[inside] = self.symbol[ends[inside]] > own[: b - a][inside]
            self.small[a:b] = small
            valleys += int(np.count_nonzero(small[1:] & ~small[:-1])) + (b < n and kind_after and not small[-1])
            kind_after = bool(small[0])
        self.valleys = valleys - 1 + (n == 1)

    def bytes_between(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return last - first if self.byte is None else self.byte[last] - self.byte[first]

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes that suffixes of the different first symbols ``a < b`` share."""
        return np.zeros(len(a), np.int64) if self.near is None else self.near.of(a + 1, b)

    def seam(self, large: np.ndarray, small: np.ndarray) -> np.ndarray:
        """Bytes that a large and a small suffix of one first symbol share: their runs of it tell."""
        c = self.symbol[large].astype(np.int64)
        i, j = self.run_end[large] - large, self.run_end[small] - small
        x, y = self.symbol[self.run_end[large]].astype(np.int64), self.symbol[self.run_end[small]].astype(np.int64)
        one = np.ones(len(c), np.int64) if self.weight is None else self.weight[c]
        return np.minimum(i, j) * one + self.shared(np.where(i > j, c, x), np.where(i < j, c, y))

    def words(self, at: np.ndarray, left: np.ndarray) -> np.ndarray:
        """The next symbols of slices that have ``left`` more, as numbers of the same order."""
        per = 8 if self.symbol.dtype == np.uint8 else 2
        piece = self.symbol[np.minimum(at[:, None] + np.arange(per), self.n - 1)]
        piece[np.arange(per) >= left[:, None]] = 0
        if per == 8:
            return np.ascontiguousarray(piece).view(">u8").ravel().astype(U64)
        return piece[:, 0].astype(U64) << U64(32) | piece[:, 1].astype(U64)


def _sorted_slices(level: Level, start: np.ndarray, length: np.ndarray, done: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, first of each distinct slice in it) of slices that agree on ``done`` symbols."""
    per = 8 if level.symbol.dtype == np.uint8 else 2
    order, head = np.arange(len(start)), np.zeros(len(start), bool)
    head[:1] = True
    # Places in the order of slices that are not yet told apart, and the numbers of their groups, both ascending.
    live, group = np.arange(len(start)), np.zeros(len(start), np.int64)
    while len(live):
        on = (np.bincount(group)[group] > 1) & (length[order[live]] > done)
        live, group = live[on], group[on]
        own = order[live]
        key = level.words(start[own] + done, length[own] - done)
        if len(group) and group[-1] < 1 << 16:
            by = np.argsort(key)
            by = by[np.argsort(group[by].astype(np.uint16), kind="stable")]
        else:
            by = np.lexsort((key, group))
        order[live], key = own[by], key[by]
        new = np.zeros(len(live), bool)
        new[1:] = (key[1:] != key[:-1]) & (group[1:] == group[:-1])
        head[live[new]] = True
        new[1:] |= group[1:] != group[:-1]
        group = np.cumsum(new)
        done += per
    return order, head


def _named(level: Level, valley: np.ndarray, length: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers of valleys, first of each distinct slice), in order, by distribution on words until a part fits."""
    per = 8 if level.symbol.dtype == np.uint8 else 2

    def parts(rows: Iterator[np.ndarray], count: int, done: int):
        if count <= CHUNK:
            own = np.concatenate([r[:, 0] for r in rows])
            order, head = _sorted_slices(level, valley[own], length[own], done)
            yield own[order], head
            return
        held = Queue(1, level.folder, limit)
        turn, sample = np.random.default_rng(count), []
        for r in rows:
            some = r[turn.integers(0, len(r), min(len(r), 1 + 4096 * len(r) // count)), 0]
            sample.append(level.words(valley[some] + done, np.maximum(length[some] - done, 0)))
            held.push(0, r)
        words = np.sort(np.concatenate(sample))
        split = np.unique(words[:: max(1, len(words) // SPLITS)])
        dealt, sizes, open_ = Queue(2 * len(split) + 1, level.folder, limit), np.zeros(2 * len(split) + 1, np.int64), np.zeros(2 * len(split) + 1, bool)
        for r in held.drain(0):
            key = level.words(valley[r[:, 0]] + done, np.maximum(length[r[:, 0]] - done, 0))
            to = np.searchsorted(split, key, "left") + np.searchsorted(split, key, "right")
            by = np.argsort(to, kind="stable")
            sizes += np.bincount(to, minlength=len(sizes))
            open_[to[length[r[:, 0]] > done + per]] = True
            dealt.deal(to[by], r[by])
        for k in np.flatnonzero(sizes).tolist():
            own = dealt.drain(k)
            if k % 2 and not open_[k]:
                # Equal slices, read to their ends.
                first = True
                for r in own:
                    head = np.zeros(len(r), bool)
                    head[0] = first
                    first = False
                    yield r[:, 0], head
            else:
                yield from parts(own, int(sizes[k]), done + per if k % 2 else done)

    n = len(valley)
    rows = (np.stack([np.arange(s.start, s.stop), np.zeros(s.stop - s.start, np.int64), np.zeros(s.stop - s.start, np.int64)], 1) for s in blocks(n))
    yield from parts(rows, n, 0)


def _shared_prefix(level: Level, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bytes that the suffixes at a and at the greater ones at b share, where their slices differ."""
    p, q, live = a.copy(), b.copy(), np.arange(len(a))
    near = np.arange(8)
    while len(live):
        x, y = level.symbol[np.minimum(p[live, None] + near, level.n - 1)], level.symbol[np.minimum(q[live, None] + near, level.n - 1)]
        differ = x != y
        step = np.where(differ.any(1), differ.argmax(1), 8)
        p[live] += step
        q[live] += step
        live = live[step == 8]
    return level.bytes_between(a, p) + level.shared(level.symbol[p].astype(np.int64), level.symbol[q].astype(np.int64))


def _sorted_valleys(level: Level, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions of the valleys, in order; bytes that each shares with the one before)."""
    m, folder = level.valleys, level.folder
    valley, length = disk(folder, m, level.kind), disk(folder, m, level.kind)
    k, before = 0, True
    for s in blocks(level.n):
        small = level.small[s]
        own = np.flatnonzero(small & ~np.concatenate([[before], small[:-1]])) + s.start
        before = bool(small[-1])
        valley[k : k + len(own)] = own
        k += len(own)
    for s in blocks(m):
        ends = np.minimum(level.run_end[np.append(valley[s.start + 1 : s.stop + 1], [] if s.stop < m else [level.n - 1]).astype(np.int64)] + 1, level.n)
        length[s] = ends - valley[s]
    name, weight, near, first = disk(folder, m, np.uint32), *(disk(folder, m, level.kind) for _ in range(3))
    names = 0
    for own, head in _named(level, valley, length, limit):
        number = names - 1 + np.cumsum(head)
        name[own] = number
        new, at = own[head], number[head]
        first[at] = valley[new]
        weight[at] = level.bytes_between(valley[new], valley[np.minimum(new + 1, m - 1)]) + (new == m - 1)
        names += len(new)
    for s in blocks(names - 1):
        near[s.start + 1 : s.stop + 1] = _shared_prefix(level, first[s], first[s.start + 1 : s.stop + 1])
    if names == m:
        out = disk(folder, m, level.kind)
        for s in blocks(m):
            out[name[s]] = valley[s]
        return out, near
    byte = disk(folder, m, level.kind)
    for s in blocks(m):
        byte[s] = valley[s] if level.byte is None else level.byte[valley[s]]
    del first, length
    at, shared = _suffixes(Level(name, m, byte, weight[:names], Least(near[:names]), folder, level.kind), limit)
    for s in blocks(m):
        at[s] = valley[at[s]]
    return at, shared


def _induced(level: Level, up: bool, seeds: np.ndarray, prefixes: np.ndarray, out: np.ndarray, shared: np.ndarray, limit: int) -> None:
    """``up``: writes the large suffixes, by ascending rank, from the sorted valleys. Else writes all but the last suffix, in
    descending order, from the sorted large ones. ``prefixes``: of each seed with the one before it in ascending order."""
    top, symbol, kind = level.top, level.symbol, level.small
    place = lambda s: s.astype(np.int64) if up else top - s.astype(np.int64)
    counts = disk(level.folder, top + 1, np.int64)
    for s in blocks(level.n):
        if top < BLOCK:
            counts += np.bincount(place(symbol[s]), minlength=top + 1)
            continue
        values, n = np.unique(place(symbol[s]), return_counts=True)
        counts[values] += n
    # A range is one symbol, or symbols with about SPAN suffixes.
    some = counts > 0
    quota = 1 if symbol.dtype == np.uint8 else SPAN
    last = (np.cumsum(counts) - 1) // quota
    cut = np.concatenate([[False], (last[1:] != last[:-1]) & some[1:] | (counts[1:] >= quota) | (counts[:-1] >= quota)])
    del last
    range_of = disk(level.folder, top + 1, np.int64)
    np.cumsum(cut, out=range_of)
    ranges = int(range_of[-1]) + 1
    single = np.bincount(range_of, some, ranges) <= 1
    del cut, some
    m = len(seeds)
    owned = np.zeros(ranges, np.int64)
    for s in blocks(m):
        owned += np.bincount(range_of[place(symbol[seeds[s]])], minlength=ranges)
    ends = np.cumsum(owned)
    # Tuples wait in groups of ranges, and are dealt to the ranges when their group's turn comes.
    group = 1 if quota == 1 else GROUP
    waiting, queue = Queue(-(-ranges // group), level.folder, limit // 2), Queue(ranges, level.folder, limit // 2)
    # Per bucket: the batch of its last source, and the least prefix after that one in its batch. Over whole batches, the
    # least prefixes that a later one does not undercut.
    tail, seen = disk(level.folder, top + 1, np.int64), disk(level.folder, top + 1, np.int64)
    batches, lows = [], []
    state = {"batch": 1, "pos": -1, "rank": -1, "seed": False, "at": 0}

    def goals(pos: np.ndarray) -> np.ndarray:
        goal = np.full(len(pos), MOST, np.int64)
        on = np.flatnonzero(pos > 0)
        before = pos[on] - 1
        fits = kind[before] != up
        goal[on[fits]] = place(symbol[before[fits]])
        return goal

    def steps(pos: np.ndarray, which: int, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(goals, whether a step yields a tuple of the range) of the tuples at pos and of those that they yield there one after
        the other, up to ``most`` steps, a row for each."""
        before = pos - np.arange(1, most + 1)[:, None]
        to = np.full(before.shape, MOST, np.int64)
        step, chain = np.nonzero(before >= 0)
        on = before[step, chain]
        fits = kind[on] != up
        step, chain, to_own = step[fits], chain[fits], place(symbol[on[fits]])
        to[step, chain] = to_own
        inner = np.zeros(before.shape, bool)
        inner[step, chain] = range_of[to_own] == which
        return to, np.logical_and.accumulate(inner, 0)

    def emit(pos: np.ndarray, rank: np.ndarray, seed: np.ndarray, prefix: np.ndarray, goal: np.ndarray, child: np.ndarray | None = None) -> np.ndarray:
        """Takes the next tuples in order and gives those that they yield, by rank. ``child``: for each tuple the place of
        its yield among them, or -1; the prefixes of such yields are found here."""
        prefix = prefix.copy()
        pos_before, rank_before, seed_before = (np.concatenate([[state[k]], v[:-1]]) for k, v in (("pos", pos), ("rank", rank), ("seed", seed)))
        new = rank != rank_before
        if level.near is None:
            prefix[new] = 0
        else:
            on = np.flatnonzero(new & (rank_before >= 0))
            a, b = rank_before[on], rank[on]
            prefix[new] = 0
            prefix[on] = level.shared(a, b) if up else level.shared(top - b, top - a)
        turn = np.flatnonzero(~new & (seed != seed_before))
        if len(turn):
            a, b = pos_before[turn], pos[turn]
            prefix[turn] = level.seam(a, b) if up else level.seam(b, a)
        live = np.flatnonzero(goal != MOST)
        by = live[np.argsort(goal[live].astype(np.uint8) if top < 256 else goal[live], kind="stable")]
        to = goal[by]
        first = np.concatenate([[True], to[1:] != to[:-1]])[: len(by)]
        again, first = np.flatnonzero(~first), np.flatnonzero(first)
        bucket = to[first]
        was = seen[bucket]
        middle = np.array([*lows, MOST], np.int64)[np.searchsorted(np.array(batches, np.int64), was + 1)]
        since = np.minimum(tail[bucket], middle)
        weight = np.ones(len(by), np.int64) if level.weight is None else level.weight[to if up else top - to]
        if child is not None:
            inner = np.flatnonzero(child[by] >= 0)
            inner = inner[~new[child[by[inner]]]]
            heads, place_of = np.searchsorted(first, inner), child[by[inner]]
            head = first[np.minimum(heads, len(first) - 1)] == inner if len(first) else inner < 0
            ends = np.stack([np.where(head, 0, by[inner - 1] + 1), by[inner] + 1], 1).ravel()
            at_head = np.flatnonzero(head)
            bound = np.where(was[heads[at_head]] > 0, since[heads[at_head]], 0)
            own, value = weight[inner], np.append(prefix, MOST)
            # A prefix depends on those of tuples before it only, so that this ends.
            while len(inner):
                found = np.minimum.reduceat(value, ends)[::2]
                found[at_head] = np.minimum(found[at_head], bound)
                found = np.minimum(found, MOST // 4) + own
                new_at = np.flatnonzero(value[place_of] != found)
                if not len(new_at):
                    break
                value[place_of[new_at]] = found[new_at]
            prefix = value[:-1]
        made = np.zeros(len(by), np.int64)
        made[again] = _between(prefix, by[again - 1] + 1, by[again])
        made[first] = np.where(was > 0, np.minimum(np.minimum.accumulate(prefix)[by[first]], since), 0)
        made += weight
        state.update(pos=int(pos[-1]), rank=int(rank[-1]), seed=bool(seed[-1]))
        kept = ~seed if up else slice(None)
        own = pos[kept]
        at = state["at"]
        out[at : at + len(own)], shared[at : at + len(own)] = own, prefix[kept]
        state["at"] += len(own)
        if len(by):
            final = np.append(first[1:], len(by)) - 1
            after = np.append(np.minimum.accumulate(prefix[::-1])[::-1], MOST)
            tail[to[final]], seen[to[final]] = after[by[final] + 1], state["batch"]
        lowest = int(prefix.min())
        while lows and lows[-1] >= lowest:
            lows.pop()
            batches.pop()
        lows.append(lowest)
        batches.append(state["batch"])
        state["batch"] += 1
        if child is not None:
            outer = child[by] < 0
            by, to, made = by[outer], to[outer], made[outer]
        return np.stack([pos[by] - 1, to, made], 1)

    def deal(made: np.ndarray, which: int) -> None:
        to = range_of[made[:, 1]]
        now = int(np.searchsorted(to, (which // group + 1) * group))
        queue.deal(to[:now], made[:now])
        waiting.deal(to[now:] // group, made[now:])

    def seeds_at(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        if up:
            return np.asarray(seeds[a:b]), np.asarray(prefixes[a:b])
        return np.asarray(seeds[m - b : m - a])[::-1], np.asarray(prefixes[m - b + 1 : m - a + 1])[::-1]

    for which in range(ranges):
        lo, hi = int(ends[which - 1]) if which else 0, int(ends[which])
        for rows in waiting.drain(which // group) if which % group == 0 else ():
            to = range_of[rows[:, 1]]
            by = np.argsort(to, kind="stable")
            queue.deal(to[by], rows[by])
        if single[which]:
            for rows in queue.drain(which):
                for s in blocks(len(rows)):
                    pos, rank, prefix = rows[s].T.copy()
                    made = emit(pos, rank, np.zeros(len(pos), bool), prefix, goals(pos))
                    deal(made, which)
            for s in blocks(hi - lo):
                pos, prefix = seeds_at(lo + s.start, lo + s.stop)
                made = emit(pos, place(symbol[pos]), np.ones(len(pos), bool), prefix, goals(pos))
                deal(made, which)
            continue
        ready = queue.pull(which)
        ready = np.zeros((0, 3), np.int64) if ready is None else ready
        pos, prefix = seeds_at(lo, hi)
        # Of one rank come first the tuples yielded by ranges before, then those of this range, then the seeds.
        rows = [np.concatenate([ready, np.stack([pos, place(symbol[pos]), prefix], 1)])]
        kinds, source, count = [np.repeat([0, 2], [len(ready), len(pos)])], [np.arange(len(rows[0]))], len(rows[0])
        # Tuples with their goals, and tuples with what they yield in this range.
        aims, yields = [], []
        front, pos = np.arange(count), rows[0][:, 0]
        while len(front):
            # Of a few tuples, which may begin long chains, many steps at once: a row a step, numbered in that order.
            to, inner = steps(pos, which, STEPS if len(front) <= NARROW else 1)
            number = np.where(inner, count - 1 + np.cumsum(inner).reshape(inner.shape), -1)
            before = np.concatenate([front[None], number])
            step, chain = np.nonzero(inner)
            aims.append((before[:-1][before[:-1] >= 0], to[before[:-1] >= 0]))
            yields.append((before[step, chain], number[step, chain]))
            source.append(before[step, chain])
            kinds.append(np.ones(len(step), np.int64))
            rows.append(np.stack([pos[chain] - 1 - step, to[step, chain], np.full(len(step), MOST // 4)], 1))
            count += len(step)
            on = np.flatnonzero(inner[-1])
            front, pos = number[-1, on], pos[on] - len(inner)
        if not count:
            continue
        rows, kinds, source = (np.concatenate(x) for x in (rows, kinds, source))
        goal, child = np.full(count, MOST, np.int64), np.full(count, -1)
        for tuples, values in aims:
            goal[tuples] = values
        for tuples, values in yields:
            child[tuples] = values
        key, fresh = 3 * rows[:, 1] + kinds, np.flatnonzero(kinds == 1)
        by = np.argsort(key, kind="stable")
        order = np.empty(count, np.int64)
        order[by] = np.arange(count)
        slots = np.sort(order[fresh])
        while len(fresh):
            # Tuples of this range follow the order of their sources, which is known once it no longer changes.
            own = fresh[np.lexsort((order[source[fresh]], key[fresh]))]
            if np.array_equal(order[own], slots):
                break
            order[own] = slots
        by[order] = np.arange(count)
        order = np.append(order, -1)
        deal(emit(rows[by, 0].copy(), rows[by, 1].copy(), kinds[by] == 2, rows[by, 2], goal[by], order[child[by]]), which)


def _suffixes(level: Level, limit: int) -> tuple[np.ndarray, np.ndarray]:
    n, folder = level.n, level.folder
    if n == 1:
        return np.zeros(1, level.kind), np.zeros(1, level.kind)
    seeds, prefixes = _sorted_valleys(level, limit)
    large = n - sum(int(np.count_nonzero(level.small[s])) for s in blocks(n))
    first, shared = disk(folder, large, level.kind), disk(folder, large + 1, level.kind)
    _induced(level, True, seeds, prefixes, first, shared, limit)
    del seeds, prefixes
    out, prefix = disk(folder, n, level.kind), disk(folder, n, level.kind)
    _induced(level, False, first, shared, out, prefix, limit)
    del first, shared
    out[n - 1] = n - 1
    # Descending so far, each with the prefix that it shares with the next greater suffix, which came before it.
    for s in blocks(n // 2):
        t = slice(n - s.stop, n - s.start)
        out[s], out[t] = out[t][::-1].copy(), out[s][::-1].copy()
        prefix[s], prefix[t] = prefix[t][::-1].copy(), prefix[s][::-1].copy()
    for s in reversed(list(blocks(n - 1))):
        prefix[s.start + 1 : s.stop + 1] = prefix[s].copy()
    prefix[0] = 0
    return out, prefix


def suffixes(symbol: np.ndarray, folder: str, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted suffixes, bytes that each shares with the one before) of bytes of which the last, 0, is the only 0."""
    kind = np.int32 if len(symbol) < 2**31 else np.int64
    return _suffixes(Level(symbol, len(symbol), None, None, None, folder, kind), limit)
