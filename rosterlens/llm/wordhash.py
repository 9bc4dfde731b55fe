"""Words and word shingles of whole texts as 64-bit hashes, computed on Arrow batches with numpy.

A word is a maximal run of characters other than blank, tab, line feed, vertical tab, form feed and carriage return;
A-Z count as a-z. Two words (or shingles) are taken as equal when their 64-bit hashes are equal. Texts are cut into
pieces of about ``PIECE`` bytes at white space, so memory does not grow with the length of a text or a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 21
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits (a bijection)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, PIECE + 1)
        _powers[:] = []
        for base in (_BASE, _INVERSE):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers.append(np.cumprod(table, dtype=np.uint64))
    return _powers[0], _powers[1]


def _piece_words(data: np.ndarray, breaks: np.ndarray, prefixes: tuple[int, ...]) -> tuple[np.ndarray, ...]:
    """Starts, ends and hashes of the words in ``data``; a word also ends before each position in ``breaks``."""
    lower = _LOWER[data]
    solid = ~_SPACE[lower]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = breaks[(breaks > 0) & (breaks < len(data))]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((lower.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts])
    heads = []
    for size in prefixes:
        cut = np.minimum(ends, starts + size)
        heads.append(mix((sums[cut] - sums[starts]) * inverse[starts] + np.uint64(size)))
    return starts, ends, hashes, *heads


def _as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows (nulls are empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if len(column) == 0 or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


def word_groups(column: pa.Array, prefixes: tuple[int, ...] = (), spans: bool = False) -> Iterator[tuple]:
    """Hashes of the words of consecutive rows, in groups of bounded size.

    Yields ``(first_row, counts, hashes)`` with the number of words of each row of the group and the hashes of all
    their words in order; with ``prefixes`` also the hashes of the words' first so many bytes, with ``spans`` also starts and
    ends in bytes from the start of the group's first row.
    """
    raw, offsets = _as_bytes(column)
    rows, row = len(offsets) - 1, 0
    while row < rows:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE, side="right")) - 1)
        data = raw[offsets[row] : offsets[stop]]
        if len(data) <= 2 * PIECE:
            found = _piece_words(data, offsets[row + 1 : stop] - offsets[row], prefixes)
        else:  # one very long text, cut at white space
            parts, at = [], 0
            while at < len(data):
                end = min(len(data), at + PIECE)
                while end < len(data) and not _SPACE[data[end]]:
                    end += 1
                part = _piece_words(data[at:end], np.zeros(0, np.int64), prefixes)
                parts.append((part[0] + at, part[1] + at, *part[2:]))
                at = end
            found = tuple(np.concatenate(x) for x in zip(*parts))
        bounds = np.searchsorted(found[0], offsets[row : stop + 1] - offsets[row])
        out = (row, np.diff(bounds), *found[2:])
        yield (*out, found[0], found[1]) if spans else out
        row = stop


def shingle_hashes(words: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words of each row, and their number per row.

    A row with fewer words has its whole sequence as one shingle; a row without words has none.
    """
    ends = np.cumsum(counts)
    if len(words) >= size:
        total = np.zeros(len(words) - size + 1, np.uint64)
        for k in range(size):
            total = (total + words[k : k + len(total)]) * _BASE + np.uint64(2 * k + 1)
        hashed = mix(total)
    else:
        hashed = np.zeros(0, np.uint64)
    per_row = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    out = np.empty(int(per_row.sum()), np.uint64)
    to = np.concatenate([[0], np.cumsum(per_row)])
    whole = np.flatnonzero(counts >= size)
    if len(whole):
        starts = ends[whole] - counts[whole]
        lengths = per_row[whole]
        source = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        target = np.repeat(to[whole] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        out[target] = hashed[source]
    for i in np.flatnonzero((counts > 0) & (counts < size)):
        h = int(counts[i])
        for w in words[ends[i] - counts[i] : ends[i]]:
            h = ((h + int(w)) * int(_BASE) + 7) & 0xFFFFFFFFFFFFFFFF
        out[to[i]] = mix(np.array([h], np.uint64))[0]
    return out, per_row
