"""Vector helpers over Arrow text columns: every row's bytes lie back to back in one buffer."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Code points with the Unicode White_Space property (fixed values).
WHITE_SPACE = (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


@lru_cache(1)
def _trim():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):
        return lambda pad: 0


def give_back() -> None:
    """Returns freed memory to the system: Python workers outlive their tasks and would keep it beside those of later stages."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def chunks(batch: pa.RecordBatch, text: str, limit: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most ``limit`` bytes of text, or one longer row: working memory follows this, not the batch."""
    if not batch.num_rows:
        return
    offsets = text_bytes(batch.column(text))[1]
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to
    give_back()


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every output bit depends on every input bit."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(33))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+``: (starts, lengths, first word of each row and one past the last)."""
    space = np.zeros(256, bool)
    space[[32, *range(9, 14)]] = True
    solid = ~space[data]
    head = solid.copy()
    head[1:] &= ~solid[:-1]
    cut = offsets[:-1][offsets[:-1] < len(data)]
    head[cut] = solid[cut]
    tail = solid.copy()
    tail[:-1] &= ~solid[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    tail[last] = solid[last]
    starts = np.flatnonzero(head)
    return starts, np.flatnonzero(tail) + 1 - starts, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each byte slice, from 8-byte pieces with the length."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)).view(U64).ravel() if len(data) else np.zeros(1, U64)
    keep = np.array([0] + [(1 << 8 * k) - 1 for k in range(1, 9)], U64)
    a = lengths.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(seed)
    b = lengths.astype(U64) + U64(0xD6E8FEB86659FD93)
    live, at = None, 0
    s, n = starts, lengths
    while len(s):
        piece = eight[s + at] & keep[np.minimum(n - at, 8)]
        x = mix((a if live is None else a[live]) ^ piece)
        y = ((b if live is None else b[live]) + piece) * U64(0xA24BAED4963EE407)
        y ^= y >> U64(29)
        if live is None:
            a, b = x, y
        else:
            a[live], b[live] = x, y
        at += 8
        more = np.flatnonzero(n > at)
        live = more if live is None else live[more]
        s, n = s[more], n[more]
    return a, b


def distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first index of each distinct (a, b), class of each element); told apart by 128 bits."""
    _, first, inverse = np.unique(a, return_index=True, return_inverse=True)
    if len(a) and not np.array_equal(b, b[first][inverse]):
        both = np.empty(len(a), [("a", U64), ("b", U64)])
        both["a"], both["b"] = a, b
        _, first, inverse = np.unique(both, return_index=True, return_inverse=True)
    return first, inverse.reshape(-1)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all slices, back to back."""
    lengths = lengths.astype(np.int64)
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)
