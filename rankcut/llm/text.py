"""Vectorised words and hashes of whole texts, for functions that run on Arrow batches inside Spark tasks.

Texts are taken as the UTF-8 bytes of an Arrow string column. Work arrays are bounded: bytes are hashed in chunks that are
cut between words, so only the hashes (one integer per word) of a very long text are held at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19  # bytes hashed at once
GROUP = 1 << 20  # bytes of short texts that are handled together

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def byte_table(separators: bytes, lower: bool) -> np.ndarray:
    """Code per byte: 0 for a separator, else a nonzero code (A-Z as a-z if ``lower``)."""
    table = np.arange(1, 257, dtype=np.uint16)
    if lower:
        table[65:91] += 32
    table[list(separators)] = 0
    return table


SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
# Everything but letters, digits, and the bytes of characters beyond ASCII.
NON_LETTERS = bytes(b for b in range(128) if not chr(b).isalnum())

EXACT_WORDS = byte_table(SPACES, lower=False)
FOLDED_WORDS = byte_table(SPACES, lower=True)
FOLDED_TERMS = byte_table(NON_LETTERS, lower=True)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the whole 64-bit word."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Powers:
    """Powers of the hash base and of its inverse, extended when a longer chunk comes."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n + 1:
            size = max(n + 1, CHUNK + 1)
            up, down = np.full(size, _BASE), np.full(size, _INVERSE)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up), np.cumprod(down)
        return self.up, self.down


_POWERS = _Powers()


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every span of ``codes``; equal spans have equal hashes wherever they stand."""
    up, down = _POWERS.get(len(codes))
    sums = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(codes * up[: len(codes)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the row offsets into them; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def groups(offsets: np.ndarray, limit: int = GROUP) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes; a longer text stands alone."""
    low, rows = 0, len(offsets) - 1
    while low < rows:
        high = int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1
        high = min(max(high, low + 1), rows)
        yield low, high
        low = high


def word_spans(codes: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of nonzero codes; no run crosses a break (``breaks``: positions where a text starts)."""
    inside = np.zeros(len(codes) + 2, dtype=bool)
    inside[1:-1] = codes != 0
    fresh = np.zeros(len(codes) + 1, dtype=bool)
    fresh[breaks] = True
    starts = inside[1:] & (~inside[:-1] | fresh)
    ends = inside[:-1] & (~inside[1:] | fresh)
    return np.flatnonzero(starts), np.flatnonzero(ends)


def _cuts(data: np.ndarray, table: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about ``CHUNK`` bytes that end after a separator (a longer word stretches its range)."""
    low = 0
    while low < len(data):
        high = min(low + CHUNK, len(data))
        while high < len(data):
            gaps = np.flatnonzero(table[data[high : high + CHUNK]] == 0)
            if len(gaps):
                high += int(gaps[0]) + 1
                break
            high = min(high + CHUNK, len(data))
        yield low, high
        low = high


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end (bytes) of every word of the texts that ``offsets`` delimit."""
    hashes, starts, ends = [], [], []
    for low, high in _cuts(data, table):
        codes = table[data[low:high]].astype(np.uint64)
        first, last = np.searchsorted(offsets, [low, high])
        s, e = word_spans(codes, offsets[first:last] - low)
        hashes.append(span_hashes(codes, s, e))
        starts.append(s + low)
        ends.append(e + low)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts), np.concatenate(ends)


def windows(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``n`` words inside one text, and the index of its first word. ``rows``: text of each word."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(len(hashes) - n + 1, dtype=np.uint64)
    for k in range(n):
        total = total * _BASE + hashes[k : len(hashes) - n + 1 + k]
    first = np.flatnonzero(rows[: len(total)] == rows[n - 1 :])
    return mix(total[first] + np.uint64(n)), first
