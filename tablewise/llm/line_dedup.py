"""Line dedup: lines that occur in many documents stay in one of them.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased. Keys of at least
``min_chars`` code points found in at least ``min_docs`` documents lose all their lines except in the
largest doc_id that holds them.

1. Every task reduces the 64-bit hashes of its keys to those seen once and those seen in several of its
   documents, and writes them by slice of the hash range: 8 bytes per distinct key, no text.
2. Each slice streams its hashes through two Bloom filters: a hash that the first filter holds already
   goes into the second. The second filter never misses a key of two documents.
3. Only lines that the second filter holds are suspects. Their SHA-256 keys are counted exactly, with
   partial counts before the shuffle, so a line of a third of all documents is no hot key.
4. Documents without suspects pass through unshuffled. The others meet their list of lines to drop.

The filter has eight bits per distinct key up to ``bloom.MAX_BITS`` (128 MB, the bound of what is
broadcast). Beyond that more lines become suspects and are counted exactly; the result is the same.

A null or empty text is one empty line (null stays null). Rows with the same doc_id are one document;
a null doc_id is smaller than any other. Columns named n_lines or n_dropped are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewise.llm import bloom, texts
from tablewise.llm.common import stage, without

BLANKS = b" \t\n\x0b\x0c\r"
HELD_HASHES = 1 << 22
NO_ID = -(1 << 63)


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The key of a line, or nothing where it is too short to count."""
    key = line.strip(BLANKS)
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode()) < min_chars):
        return None
    return key.lower()  # bytes: only A-Z change


def _rows(column: pa.Array) -> Iterator[bytes]:
    return (v or b"" for v in column.cast(pa.binary()).to_pylist())


def _hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """Distinct key hashes of each task by slice: those of one document, and those of several."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            found: list[int] = []
            for text in _rows(batch.column(0)):
                keys = (line_key(line, min_chars) for line in text.split(b"\n"))
                found.extend({xxhash.xxh3_64_intdigest(k) for k in keys if k})
            held.append(np.array(found, np.uint64))
            size += len(found)
            if size >= HELD_HASHES:
                yield bloom.packed(held)
                held, size = [], 0
        if size:
            yield bloom.packed(held)

    return docs.select("text").mapInArrow(texts.lean(run), bloom.ROWS)


def _flagged(docs: DataFrame, seen, min_chars: int) -> DataFrame:
    """The documents with ``__suspects``: SHA-256 of their keys that the filter holds."""
    schema = T.StructType([*docs.schema, T.StructField("__suspects", T.ArrayType(T.BinaryType()))])
    place = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            keys, owner = [], []
            for i, text in enumerate(_rows(batch.column(place))):
                found = {k for k in (line_key(line, min_chars) for line in text.split(b"\n")) if k}
                keys.extend(found)
                owner.extend([i] * len(found))
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
            hit = np.flatnonzero(seen.value.holds(hashes)) if len(keys) else np.zeros(0, np.int64)
            offsets = np.searchsorted(np.array(owner, np.int64)[hit], np.arange(batch.num_rows + 1))
            digests = pa.array([hashlib.sha256(keys[i]).digest() for i in hit.tolist()], pa.binary())
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), digests)
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[f.name for f in schema])

    return docs.mapInArrow(texts.lean(run), schema)


def _dropped(docs: DataFrame, min_chars: int) -> DataFrame:
    """Documents (with ``__drop``, the keys to drop) after dropping: ``text``, ``__n_lines`` (before) and ``__n_dropped``."""
    keep = [c for c in docs.columns if c != "__drop"]
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("__n_lines", T.LongType()), T.StructField("__n_dropped", T.LongType())])
    place = keep.index("text")

    def run(batches):
        for batch in batches:
            out, before, n = [], [], []
            for text, drop in zip(batch.column(place).cast(pa.binary()).to_pylist(), batch.column(len(keep)).to_pylist()):
                lines = (text or b"").split(b"\n")
                before.append(len(lines))
                if not drop:
                    out.append(text), n.append(0)
                    continue
                gone, left = set(drop), []
                for line in lines:
                    key = line_key(line, min_chars)
                    if not key or hashlib.sha256(key).digest() not in gone:
                        left.append(line)
                out.append(b"\n".join(left)), n.append(len(lines) - len(left))
            columns = [batch.column(i) for i in range(len(keep))]
            columns[place] = pa.array(out, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(before, pa.int64()), pa.array(n, pa.int64())], names=[f.name for f in schema])

    return docs.select(*keep, "__drop").mapInArrow(texts.lean(run), schema)


def dedup_lines(df: DataFrame, min_chars: int = 20, min_docs: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with the repeated lines of ``text`` dropped, and the columns n_lines and n_dropped."""
    spark = df.sparkSession
    kept = without(df, ["n_lines", "n_dropped", text])
    docs = df.select(
        *[df[c].alias(f"__c{i}") for i, c in enumerate(kept)],
        F.coalesce(df[doc_id].cast("long"), F.lit(NO_ID)).alias("__doc"), df[text].cast("string").alias("text"),
    )
    seen = spark.sparkContext.broadcast(bloom.build(stage(_hashes(docs, min_chars), "line-hashes"), twice=True))

    suspects = _flagged(docs.select("__doc", "text"), seen, min_chars).select("__doc", F.explode("__suspects").alias("key"))
    suspects = stage(suspects, "line-suspects")
    counts = suspects.groupBy("key").agg(F.count_distinct("__doc").alias("n"), F.max("__doc").alias("keeper"))
    repeated = stage(counts.filter(F.col("n") >= min_docs).select("key", "keeper"), "line-repeats")
    drops = suspects.join(repeated, "key").filter("__doc <> keeper").groupBy("__doc").agg(F.collect_set("key").alias("__drop"))

    flagged = _flagged(docs, seen, min_chars)
    lines = F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))), F.lit(0)) + 1
    clean = flagged.filter(F.size("__suspects") == 0).drop("__suspects")
    clean = clean.withColumns({"__n_lines": lines.cast("long"), "__n_dropped": F.lit(0).cast("long")})
    dirty = flagged.filter(F.size("__suspects") > 0).drop("__suspects").join(drops, "__doc", "left")
    dirty = _dropped(dirty.select(*docs.columns, "__drop"), min_chars)

    def column(c):
        return F.col("text").alias(c) if c == text else F.col(f"__c{kept.index(c)}").alias(c)

    both = clean.unionByName(dirty)
    names = [c for c in df.columns if c == text or c in kept]
    return both.select(*map(column, names), F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"))
