"""Arrow text columns as flat byte arrays, and words as 64-bit hashes.

Words are runs of bytes other than ``[\\x20\\x09-\\x0D]`` in the UTF-8 text. A word's hash is
``sum(value[byte] * BASE**i)`` modulo 2**64 with well-mixed values per byte, so all words of a block
come from one prefix sum; two different words meet with a chance of about 2**-64.
"""

from __future__ import annotations

import ctypes
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 19
_SPAN_BYTES = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_FOLDED = _VALUES.copy()
_FOLDED[65:91] = _VALUES[97:123]

_tables: list[np.ndarray] = []


def _power_tables() -> list[np.ndarray]:
    """The base's powers and inverse powers up to ``_SPAN_BYTES``, made once in a worker."""
    if not _tables:
        for base in (_BASE, _INVERSE):
            steps = np.full(_SPAN_BYTES + 1, base, np.uint64)
            steps[0] = 1
            _tables.append(np.cumprod(steps, dtype=np.uint64))
    return _tables


def give_back() -> None:
    """Return freed memory to the machine: workers live on between tasks, and what the allocators keep of one
    task's blocks would count against the next stage's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lean(run: Callable) -> Callable:
    """A function over batches that gives its memory back every second and when its task ends."""

    def work(batches):
        given = time.monotonic()
        try:
            for batch in run(batches):
                yield batch
                del batch
                if time.monotonic() > given + 1:
                    give_back()
                    given = time.monotonic()
        finally:
            give_back()

    return work


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = int(offsets[0]) if len(offsets) else 0
    return buf[first : int(offsets[-1])] if len(offsets) else buf[:0], offsets - first


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """The column in runs of whole rows of about ``limit`` bytes: (first row, end row, bytes, offsets)."""
    buf, offsets = flat(column)
    row, rows = 0, len(column)
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        end = min(end, rows)
        yield row, end, buf[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_spans(buf: np.ndarray, offsets: np.ndarray, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each row the index of its first word (one more at the end).

    ``cuts`` are places in words where a new one begins."""
    inside = np.zeros(len(buf) + 2, bool)
    np.logical_not(SEPARATOR[buf], out=inside[1:-1])
    begins = inside[1:] & ~inside[:-1]
    ends = inside[:-1] & ~inside[1:]
    borders = offsets[1:-1] if cuts is None else np.concatenate([offsets[1:-1], cuts])
    borders = borders[(borders > 0) & (borders < len(buf))]
    cut = borders[inside[borders] & inside[borders + 1]]  # a word may not run on into the next row
    begins[cut] = True
    ends[cut] = True
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends)
    return starts, stops, np.searchsorted(starts, offsets)


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """A 64-bit hash of each span of bytes; ``fold`` treats A-Z as a-z. Spans are ordered and apart."""
    values = _FOLDED if fold else _VALUES
    powers, inverses = _power_tables()
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = int(starts[at])
        stop = int(np.searchsorted(ends, low + _SPAN_BYTES, side="right"))
        if stop <= at:  # a span beyond the tables: piece by piece, the power carried on
            total, power = np.zeros(1, np.uint64), np.ones(1, np.uint64)
            for piece in range(low, int(ends[at]), _SPAN_BYTES):
                data = values[buf[piece : min(piece + _SPAN_BYTES, int(ends[at]))]]
                total += power * (data * powers[: len(data)]).sum(dtype=np.uint64)
                power *= powers[_SPAN_BYTES]
            out[at] = total[0]
            at += 1
            continue
        high = int(ends[stop - 1])
        sums = np.empty(high - low + 1, np.uint64)
        sums[0] = 0
        np.cumsum(values[buf[low:high]] * powers[: high - low], out=sums[1:])
        s = starts[at:stop] - low
        out[at:stop] = (sums[ends[at:stop] - low] - sums[s]) * inverses[s]
        at = stop
    return mix(out)


def word_hashes(buf: np.ndarray, offsets: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a block and the index of each row's first word (one more at the end)."""
    starts, ends, first = word_spans(buf, offsets)
    return hash_spans(buf, starts, ends, fold), first


def shingles(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``width`` words within a row, and each row's first one.

    A row of fewer words, but at least one, has its whole sequence as its one shingle.
    """
    n = np.diff(first)
    counts = np.where(n >= width, n - width + 1, (n > 0).astype(n.dtype))
    begin = np.concatenate([[0], np.cumsum(counts)])
    total = int(begin[-1])
    at = np.arange(total) - np.repeat(begin[:-1] - first[:-1], counts)
    short = np.repeat(n < width, counts)
    left = np.repeat(first[1:], counts) - at
    out = np.full(total, width, np.uint64)
    for k in range(width):
        word = words[np.minimum(at + k, len(words) - 1)] if total else words[:0]
        out = mix(out * _BASE + np.where(short & (k >= left), np.uint64(k + 1), word))
    return out, begin


def gather(flat_values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The runs ``flat_values[starts[i] : starts[i] + counts[i]]`` one after another."""
    before = np.cumsum(counts) - counts
    return flat_values[np.arange(int(counts.sum())) + np.repeat(starts - before, counts)]
