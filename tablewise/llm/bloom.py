"""Bloom filters over 64-bit hashes, built by Spark slice by slice of the hash range.

Tasks send hashes packed by slice; every slice streams them through two filters: a hash that the first
holds already goes into the second. Either filter can be kept: seen at least once, or at least twice.
A filter never misses a hash. Its size follows the number of hashes up to ``MAX_BITS`` (128 MB, the bound
of what is broadcast); beyond that it holds more by mistake.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.llm import texts

SLICES = 64
MAX_BITS = 1 << 30
BITS_PER_HASH = 8
HASHES_PER_ROW = 512
ROWS = "slice int, several boolean, hashes binary"
_FIRST, _SECOND = np.uint64(0xA0761D6478BD642F), np.uint64(0xD6E8FEB86659FD93)


def _spread(hashes: np.ndarray) -> np.ndarray:
    """Hashes over the whole range again: a caller may send those of one part of it only."""
    return texts.mix(hashes ^ _FIRST)


def places(hashes: np.ndarray, slice_bits: int) -> np.ndarray:
    """The four places of each hash within its slice (``slice_bits`` is a power of two)."""
    mask, more, shift = np.uint64(slice_bits - 1), texts.mix(hashes ^ _SECOND), np.uint64(24)
    return np.stack([hashes & mask, (hashes >> shift) & mask, more & mask, (more >> shift) & mask]).astype(np.int64)


def slice_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(58)).astype(np.int64)


class Filter:
    def __init__(self, slice_bits: int, bits: np.ndarray):
        self.slice_bits, self.bits = slice_bits, bits

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        hashes = _spread(hashes)
        at = places(hashes, self.slice_bits) + slice_of(hashes) * self.slice_bits
        return ((self.bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(0)


def packed(hashes: Iterable[np.ndarray]) -> pa.RecordBatch:
    """Rows for ``build``: the distinct hashes of several arrays by slice, apart those that repeat."""
    found, n = np.unique(_spread(np.concatenate([np.zeros(0, np.uint64), *hashes])), return_counts=True)
    rows = []
    for several in (False, True):
        part = found[n > 1] if several else found[n == 1]
        cuts = np.searchsorted(slice_of(part), np.arange(SLICES + 1))
        for s in range(SLICES):
            for a in range(cuts[s], cuts[s + 1], HASHES_PER_ROW):
                rows.append((s, several, part[a : min(a + HASHES_PER_ROW, cuts[s + 1])].tobytes()))
    columns = list(zip(*rows)) or [(), (), ()]
    types = (pa.int32(), pa.bool_(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["slice", "several", "hashes"])


def packed_column(df: DataFrame, column: str) -> DataFrame:
    """Rows for ``build`` from a column of longs."""

    def run(batches):
        for batch in batches:
            yield packed([batch.column(0).drop_null().to_numpy(zero_copy_only=False).view(np.uint64)])

    return df.select(column).mapInArrow(texts.lean(run), ROWS)


def build(rows: DataFrame, twice: bool) -> Filter:
    """The filter of hashes seen at least once, or at least twice; ``rows`` is read twice, so written before."""
    n = (rows.agg(F.sum(F.octet_length("hashes"))).first()[0] or 0) // 8
    bits = min(max(1 << max(BITS_PER_HASH * n - 1, 1).bit_length(), SLICES * 1024), MAX_BITS)
    slice_bits = bits // SLICES

    def run(batches):
        current, first, second = None, None, None

        def done():
            bits = np.packbits(second if twice else first).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([current], pa.int32()), pa.array([bits], pa.binary())], names=["slice", "bits"])

        for batch in batches:
            for s, several, data in zip(*(c.to_pylist() for c in batch.columns)):
                if s != current:
                    if current is not None:
                        yield done()
                    current, first, second = s, np.zeros(slice_bits, bool), np.zeros(slice_bits, bool)
                at = places(np.frombuffer(data, np.uint64), slice_bits)
                if twice:
                    second[at if several else at[:, first[at].all(0)]] = True
                first[at] = True
        if current is not None:
            yield done()

    sliced = rows.repartition(SLICES, "slice").sortWithinPartitions("slice").select("slice", "several", "hashes")
    out = np.zeros(bits // 8, np.uint8)
    for r in sliced.mapInArrow(texts.lean(run), "slice int, bits binary").toLocalIterator():
        out[r["slice"] * slice_bits // 8 : (r["slice"] + 1) * slice_bits // 8] = np.frombuffer(r["bits"], np.uint8)
    return Filter(slice_bits, out)
