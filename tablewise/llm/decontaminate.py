"""Benchmark decontamination: rare n-gram seeds find passages, Smith-Waterman alignment scores them.

1. The documents in which every word n-gram of the test items occurs are counted over the whole corpus.
2. Seeds are the item's rare n-grams, of those that occur: up to twice their median count plus ``RARE`` (so a
   passage that was copied very often keeps its seeds), and the rarest of every ``WINDOW`` neighbouring ones.
3. Where a document holds a seed, the words around it are aligned with the item (a match +2, another word
   or a gap -1; local, so edits and cuts on either side cost little). A passage is a leak when its score
   reaches ``share`` of the item's own score, at least ``LEAST`` and at most ``ENOUGH`` (thirty words
   are a leak of an item of any length). Windows that cannot reach that with all words they share are not aligned.

Words are lower-cased (A-Z) and compared without punctuation around them. Items go through in blocks of ``ITEM_BLOCK``
(the bound of what is broadcast); for each block the documents are read twice and never shuffled, so
copies are no hot key. Test items that cannot reach ``LEAST`` (under eight words), null or empty ones find nothing;
repeated items are reported each. Null and empty texts hold no leak. A column named leaks is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewise.llm import features, texts
from tablewise.llm.common import without

NGRAM = 3
WINDOW = 6
RARE = 32
ITEM_BLOCK = 20_000
MATCH, MISS, GAP = 2, -1, -1
LEAST, ENOUGH = 16, 60
_PROBE_BITS = 22

LEAK = T.StructType([
    T.StructField("item_id", T.LongType()), T.StructField("score", T.LongType()), T.StructField("share", T.DoubleType()),
    T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()),
])


def _words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = features.bare_words(buf, offsets)
    return texts.hash_spans(buf, starts, ends, fold=True), first


def _grid(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Best local score, and the last word of it in item and passage."""
    at = np.arange(1, len(passage) + 1)
    above, best = np.zeros(len(passage) + 1, np.int64), (0, 0, 0)
    for i, word in enumerate(item):
        row = np.maximum(above[:-1] + np.where(passage == word, MATCH, MISS), above[1:] + GAP)
        row = np.maximum.accumulate(np.maximum(row, 0) - GAP * at) + GAP * at
        j = int(row.argmax())
        if row[j] > best[0]:
            best = (int(row[j]), i, j)
        above = np.concatenate([[0], row])
    return best


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman score of two word sequences and the first and last aligned word of the passage."""
    score, i, j = _grid(item, passage)
    if not score:
        return 0, 0, -1
    _, _, back = _grid(item[i::-1], passage[j::-1])
    return score, j - back, j


class Items:
    """A block of test items: words, n-grams, and the places of every n-gram."""

    def __init__(self, ids: list[int], item_texts: list[str], share: float):
        self.ids = ids
        buf, offsets = texts.flat(pa.array(item_texts, pa.string()))
        self.words, self.first = _words(buf, offsets)
        lengths = np.diff(self.first)
        self.own = MATCH * lengths
        self.needed = np.minimum(np.maximum(np.ceil(share * self.own), LEAST), ENOUGH).astype(np.int64)
        grams, begin = texts.shingles(self.words, self.first, NGRAM)
        owner = np.repeat(np.arange(len(ids)), np.diff(begin))
        place = np.arange(len(grams)) - begin[owner]
        fits = self.own[owner] >= LEAST
        self.grams, self.owner, self.place = grams[fits], owner[fits], place[fits]
        self.keys = np.unique(self.grams)

    def seeded(self, rows: dict[int, int]) -> Items:
        """Keep the rare n-grams and the rarest of every window; rows: n-gram -> documents that hold it."""
        count = np.array([rows.get(g, 0) for g in self.grams.view(np.int64).tolist()], np.int64)
        keep = np.zeros(len(self.grams), bool)
        cuts = np.flatnonzero(np.concatenate([[True], self.owner[1:] != self.owner[:-1]])) if len(keep) else []
        for a, b in zip(cuts, [*cuts[1:], len(keep)]):
            own = count[a:b]
            if not own.any():
                continue
            keep[a:b] = (own > 0) & (own <= 2 * np.median(own[own > 0]) + RARE)
            order = np.where(own > 0, own, np.iinfo(np.int64).max)  # what occurs nowhere finds nothing
            for s in range(max(b - a - WINDOW, 0) + 1):
                best = s + int(order[s : s + WINDOW].argmin())
                keep[a + best] |= own[best] > 0
        order = np.flatnonzero(keep)
        order = order[np.argsort(self.grams[order], kind="stable")]
        self.grams, self.owner, self.place = self.grams[order], self.owner[order], self.place[order]
        self.keys = np.unique(self.grams)
        return self

    def probe(self) -> np.ndarray:
        table = np.zeros(1 << _PROBE_BITS, bool)
        table[(self.keys >> np.uint64(64 - _PROBE_BITS)).astype(np.int64)] = True
        return table


def _hits(grams: np.ndarray, keys: np.ndarray, probe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of n-grams that are keys, and which key."""
    maybe = np.flatnonzero(probe[(grams >> np.uint64(64 - _PROBE_BITS)).astype(np.int64)])
    if not len(maybe) or not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(keys, grams[maybe]), len(keys) - 1)
    hit = keys[at] == grams[maybe]
    return maybe[hit], at[hit]


def _counted(docs: DataFrame, items) -> dict[int, int]:
    """Documents that hold each n-gram of the block; one row per n-gram and task is shuffled."""

    def run(batches):
        block = items.value
        keys, probe = block.keys, block.probe()
        total = np.zeros(len(keys), np.int64)
        for batch in batches:
            for _, _, buf, offsets in texts.blocks(batch.column(0)):
                grams, begin = texts.shingles(*_words(buf, offsets), NGRAM)
                at, key = _hits(grams, keys, probe)
                doc = np.searchsorted(begin, at, side="right")
                pairs = np.unique(doc * np.int64(len(keys) + 1) + key)
                total += np.bincount(pairs % (len(keys) + 1), minlength=len(keys)) if len(pairs) else 0
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(keys[used].view(np.int64)), pa.array(total[used])], names=["gram", "n"])

    rows = docs.select("text").mapInArrow(texts.lean(run), "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    return {r["gram"]: r["n"] for r in rows.collect()}  # at most the n-grams of the block


def _leaks(block: Items, probe: np.ndarray, buf: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, dict]]:
    """(row, leak) for every document of a block of texts and item."""
    words, first = _words(buf, offsets)
    grams, begin = texts.shingles(words, first, NGRAM)
    at, key = _hits(grams, block.keys, probe)
    if not len(at):
        return
    low, high = np.searchsorted(block.grams, block.keys[key]), np.searchsorted(block.grams, block.keys[key], side="right")
    seed = texts.gather(np.arange(len(block.grams)), low, high - low)
    at = np.repeat(at, high - low)
    doc, item = np.searchsorted(begin, at, side="right") - 1, block.owner[seed]
    place = at - begin[doc]
    order = np.lexsort((place, item, doc))
    doc, item, place, seed = doc[order], item[order], place[order], block.place[seed[order]]
    cuts = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])]))
    for a, b in zip(cuts, [*cuts[1:], len(doc)]):
        d, i = int(doc[a]), int(item[a])
        test = block.words[block.first[i] : block.first[i + 1]]
        body = words[first[d] : first[d + 1]]
        slack = len(test) // 2 + 4
        best = (0, 0, 0)
        left, right = None, None
        spans = []
        for p, s in zip(place[a:b].tolist(), seed[a:b].tolist()):
            x, y = max(p - s - slack, 0), min(p - s + len(test) + slack, len(body))
            if right is not None and x <= right and y - left <= 4 * (len(test) + slack):
                left, right = min(left, x), max(right, y)
            else:
                if right is not None:
                    spans.append((left, right))
                left, right = x, y
        spans.append((left, right))
        for x, y in spans:
            passage = body[x:y]
            if MATCH * min(int(np.isin(passage, test).sum()), int(np.isin(test, passage).sum())) < block.needed[i]:
                continue
            score, start, end = align(test, passage)
            if score > best[0]:
                best = (score, x + start, x + end)
        if best[0] >= block.needed[i]:
            yield d, {"item_id": block.ids[i], "score": best[0], "share": best[0] / int(block.own[i]), "first_word": best[1], "last_word": best[2]}


def _found(df: DataFrame, items, text: str) -> DataFrame:
    """``df`` with the leaks of a block of items added to the column leaks."""
    schema, place, column = df.schema, df.columns.index("leaks"), df.columns.index(text)
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.int64()), ("share", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64())]))

    def run(batches):
        block = items.value
        probe = block.probe()
        for batch in batches:
            leaks = batch.column(place).to_pylist()
            for row, _, buf, offsets in texts.blocks(batch.column(column)):
                for d, leak in _leaks(block, probe, buf, offsets):
                    leaks[row + d].append(leak)
            columns = list(batch.columns)
            columns[place] = pa.array(leaks, kind)
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

    return df.mapInArrow(texts.lean(run), schema)


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, share: float = 0.5, text: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """``docs`` with ``leaks``: the test items a document holds, their scores and where (word numbers)."""
    kept = without(docs, ["leaks"])
    empty = F.array().cast(T.ArrayType(LEAK))
    out = docs.select(*[docs[c] for c in kept], empty.alias("leaks"))
    corpus = docs.select(docs[text].cast("string").alias("text"))
    rows = benchmark.select(benchmark[item_id].cast("long").alias("id"), benchmark[item_text].cast("string").alias("text"))
    held: list = []

    def block():
        items = Items([r["id"] for r in held], [r["text"] for r in held], share)
        held.clear()
        context = docs.sparkSession.sparkContext
        items = items.seeded(_counted(corpus, context.broadcast(items)))
        return _found(out, context.broadcast(items), text)

    for r in rows.filter(F.col("text").isNotNull()).toLocalIterator():
        held.append(r)
        if len(held) == ITEM_BLOCK:
            out = block()
    return block() if held else out
