"""Hashed features of words for linear classifiers, and what fitting them shares.

Every feature is a bucket of a 64-bit hash; a row's value of a bucket is its count divided by a power of
the row's number of words: a half where the whole text shows the label, less where a few words decide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewise.llm import texts
from tablewise.llm.common import without

BUCKET_BITS = 20
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = True


def _bucket(hashes: np.ndarray, kind: int) -> np.ndarray:
    return (texts.mix(hashes + np.uint64(kind * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)


def _tokens(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of words and of runs of punctuation, and the first span of each row."""
    kind = np.zeros(len(buf) + 2, np.int8)
    kind[1:-1] = np.where(texts.SEPARATOR[buf], 0, np.where(PUNCTUATION[buf], 1, 2))
    change = kind[1:] != kind[:-1]
    borders = offsets[1:-1]
    change[borders[(borders > 0) & (borders < len(buf))]] = True
    cuts = np.flatnonzero(change)
    inside = kind[cuts[:-1] + 1] > 0 if len(cuts) else np.zeros(0, bool)
    starts, ends = cuts[:-1][inside], cuts[1:][inside]
    return starts, ends, np.searchsorted(starts, offsets)


def word_ngrams(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of single words and of neighbouring words as they are written, runs of punctuation
    being words of their own and a word after itself one common pair: (buckets, first of each row, words of each row)."""
    starts, ends, first = _tokens(buf, offsets)
    words = texts.hash_spans(buf, starts, ends)
    pairs, pair_first = texts.shingles(words, first, 2)
    at = np.arange(len(pairs)) + np.repeat(first[:-1] - pair_first[:-1], np.diff(pair_first))
    same = words[at] == words[np.minimum(at + 1, len(words) - 1)] if len(pairs) else np.zeros(0, bool)
    pairs[same & np.repeat(np.diff(first) > 1, np.diff(pair_first))] = 0
    return _rows([(_bucket(words, 1), first), (_bucket(pairs, 2), pair_first)]) + (np.diff(first),)


def bare_words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of words without up to four marks of punctuation on either side (one byte always stays)."""
    starts, ends, first = texts.word_spans(buf, offsets)
    for _ in range(4):
        ends = ends - (PUNCTUATION[buf[ends - 1]] & (ends > starts + 1))
        starts = starts + (PUNCTUATION[buf[starts]] & (ends > starts + 1))
    return starts, ends, first


def word_stems(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of lower-cased words without punctuation around them, and of their first 4, 5 and 6 bytes."""
    starts, ends, first = bare_words(buf, offsets)
    parts = [(_bucket(texts.hash_spans(buf, starts, ends, fold=True), 3), first)]
    for size in (4, 5, 6):
        parts.append((_bucket(texts.hash_spans(buf, starts, np.minimum(starts + size, ends), fold=True), size), first))
    return _rows(parts) + (np.diff(first),)


def _rows(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Several features per row, one kind after another within the row."""
    counts = np.stack([np.diff(first) for _, first in parts])
    begin = np.concatenate([[0], np.cumsum(counts.sum(0))])
    out = np.empty(int(begin[-1]), np.int32)
    place = begin[:-1].copy()
    for (values, first), n in zip(parts, counts):
        if len(values):
            out[np.arange(len(values)) + np.repeat(place - first[:-1], n)] = values
        place += n
    return out, begin


def held_out(doc_id: Column) -> Column:
    """One row in five by the CRC-32 of the id as text; a row without id is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def featured(rows: DataFrame, extract, carried: list[str]) -> DataFrame:
    """``carried`` columns, ``features`` (buckets) and ``words`` (their number) of the column ``text``."""
    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in carried), "features array<int>, words bigint"])

    def run(batches):
        for batch in batches:
            for row, end, buf, offsets in texts.blocks(batch.column(len(carried))):
                buckets, begin, words = extract(buf, offsets)
                lists = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(buckets))
                kept = [batch.column(i).slice(row, end - row) for i in range(len(carried))]
                yield pa.RecordBatch.from_arrays([*kept, lists, pa.array(words.astype(np.int64))], names=[*carried, "features", "words"])

    return rows.select(*carried, "text").mapInArrow(texts.lean(run), schema)


def sparse(features: np.ndarray, words: int, power: float) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a row and their values."""
    found, n = np.unique(features, return_counts=True)
    return found, n / max(words, 1) ** power


def scored(df: DataFrame, extract, weights: np.ndarray, bias: float, power: float, text: str) -> DataFrame:
    """``df`` with the column score, the logistic of a sparse dot product per row; a text without words has
    the bias alone."""
    shared = df.sparkSession.sparkContext.broadcast(weights.astype(np.float32))
    kept = without(df, ["score"])
    rows = df.select(*[df[c] for c in kept], df[text].cast("string").alias("__text"))
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField("score", T.DoubleType())])

    def run(batches):
        table = shared.value
        for batch in batches:
            for row, end, buf, offsets in texts.blocks(batch.column(len(kept))):
                buckets, begin, words = extract(buf, offsets)
                sums = np.concatenate([[0.0], np.cumsum(table[buckets], dtype=np.float64)])
                margin = bias + (sums[begin[1:]] - sums[begin[:-1]]) / np.maximum(words, 1) ** power
                score = 1 / (1 + np.exp(-np.clip(margin, -60, 60)))
                columns = [batch.column(i).slice(row, end - row) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(score)], names=[f.name for f in schema])

    return rows.mapInArrow(texts.lean(run), schema)
