"""Token files: ids under one canonical length-limited Huffman code, in blocks that decode on their own.

``write`` tokenizes documents in ascending order of their id (the tokenizers library, no special tokens,
``end_id`` after each document), counts all ids, derives one code from the counts and writes a folder of
three Parquet tables:

* ``codebook``  id, length: the code lengths; canonical codes follow from them.
* ``blocks``    part, block, doc_ids, counts, checkpoints, payload: whole documents of about
  ``BLOCK_TOKENS`` ids as one bit string, with the bit offset of every ``CHECKPOINT``-th id.
* ``index``     part, block, start, n_tokens: the number of ids before each block.

``read`` gives the documents back from these files alone, with their ids. A block is decoded from all its checkpoints at
once: each step looks the next code of every stretch up in one table.

A null or empty text has the end id only. Null doc_ids come first; documents with the same id keep the
order of their texts. Only ids are kept (extra columns are not written). The counts that reach the driver
are bounded by the vocabulary, not by the documents.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewise.llm import texts
from tablewise.llm.bpe import PIECE, SPECIAL_TOKENS, WordTable, read_tokenizer

BLOCK_TOKENS = 1 << 18
CHECKPOINT = 256
LONGEST_CODE = 16  # bits; more only where the vocabulary needs them

_CHUNKS = "part int, block int, doc_ids array<bigint>, counts array<bigint>, n_tokens bigint, ids binary"
_BLOCKS = "part int, block int, doc_ids array<bigint>, counts array<bigint>, checkpoints array<bigint>, payload binary"


# --- code ---------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, longest: int = LONGEST_CODE) -> np.ndarray:
    """Lengths of an optimal prefix code with no code over ``longest`` bits (package-merge).

    Symbols without occurrences get length 0; a single symbol gets one bit.
    """
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    longest = max(longest, int(np.ceil(np.log2(len(used)))))
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    n, levels, merged = len(order), [], weights
    for _ in range(longest):
        # each level: the symbols and the pairs of the level below, by weight; ties take symbols first
        is_symbol = np.ones(n, bool)
        if levels:
            pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
            both = np.concatenate([weights, pairs])
            place = np.argsort(both, kind="stable")
            merged, is_symbol = both[place], place < n
        levels.append(is_symbol)
    take = 2 * (n - 1)
    for is_symbol in reversed(levels):
        symbols = int(is_symbol[:take].sum())
        lengths[order[:symbols]] += 1
        take = 2 * (take - symbols)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id), each one more than the one before, widened to its length."""
    codes = np.zeros(len(lengths), np.int64)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    if len(order):
        top = int(lengths[order].max())
        spans = np.int64(1) << (top - lengths[order])
        codes[order] = (np.cumsum(spans) - spans) >> (top - lengths[order])
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Symbol and length for every string of as many bits as the longest code has."""
    used = np.flatnonzero(lengths)
    top = int(lengths.max()) if len(used) else 1
    order = used[np.lexsort((used, lengths[used]))]
    spans = np.int64(1) << (top - lengths[order])
    symbols, sizes = np.zeros(1 << top, np.int64), np.ones(1 << top, np.int64)
    symbols[: spans.sum()] = np.repeat(order, spans)
    sizes[: spans.sum()] = np.repeat(lengths[order], spans)
    return symbols, sizes, top


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bit string of ids, first bit highest, and the bit offset of every ``CHECKPOINT``-th id."""
    size = lengths[ids]
    ends = np.cumsum(size)
    at = ends - size
    words = int(ends[-1] + 31) // 32 if len(ids) else 0
    out = np.zeros(words + 2, np.uint64)
    if len(ids):
        cell = at >> 5
        value = codes[ids].astype(np.uint64) << (64 - (at & 31) - size).astype(np.uint64)
        begin = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        whole = np.add.reduceat(value, begin)  # bits never overlap, so a sum sets them
        out[cell[begin]] += whole >> np.uint64(32)
        out[cell[begin] + 1] += whole & np.uint64(0xFFFFFFFF)
    return out[:words].astype(">u4").tobytes(), at[::CHECKPOINT]


def unpack(payload: bytes, checkpoints: np.ndarray, n: int, table: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """The ``n`` ids of a block; all stretches between checkpoints advance together."""
    symbols, sizes, top = table
    words = np.concatenate([np.frombuffer(payload, ">u4").astype(np.uint64), np.zeros(2, np.uint64)])
    pairs = (words[:-1] << np.uint64(32)) | words[1:]
    out = np.zeros((CHECKPOINT, len(checkpoints)), np.int64)
    at, mask, last = checkpoints.astype(np.int64), np.uint64((1 << top) - 1), len(pairs) - 1
    for step in range(min(CHECKPOINT, n)):
        cell = np.minimum(at >> 5, last)
        bits = (pairs[cell] >> (64 - top - (at & 31)).astype(np.uint64)) & mask
        found = bits.astype(np.int64)
        out[step] = symbols[found]
        at = at + sizes[found]
    return out.T.reshape(-1)[:n]


# --- write --------------------------------------------------------------------------------------

_library: dict[int, tuple[WordTable, bool]] = {}

MARK = b"\x01"  # stands between words that go to the library in one text; a piece and an id of its own
MARKED_WORDS = 512
_KIND = np.zeros(256, np.uint8)  # 1: ASCII letters, 2: signs that no contraction or special token holds
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in "'<|>"]] = 2


def _known_pieces(source: str) -> bool:
    """Is this the word BPE file, whose rules for pieces ``_folded`` and ``_cuts`` rely on?"""
    spec = json.loads(source)
    special = {t["content"] for t in spec["added_tokens"]}
    rules = json.dumps([spec.get("normalizer"), spec.get("pre_tokenizer")])
    return special <= set(SPECIAL_TOKENS) and json.dumps(PIECE.format(L=r"\p{L}", N=r"\p{N}")) in rules and '"Lowercase"' in rules


def _folded(buf: np.ndarray) -> np.ndarray:
    """A-Z in lower case, as the tokenizer makes them, so that fewer words differ. It composes letters and marks before,
    so letters before a mark stay; so do blocks that may hold special tokens, which have a case."""
    if ((buf[:-1] == ord("<")) & (buf[1:] == ord("|"))).any():
        return buf
    upper = (buf >= 65) & (buf <= 90)
    upper[:-1] &= buf[1:] < 128
    return buf | (upper.astype(np.uint8) << 5)


def _cuts(buf: np.ndarray) -> np.ndarray:
    """Where an ASCII letter meets a sign: a piece ends there, whatever stands around it."""
    kind = _KIND[buf]
    return np.flatnonzero(kind[1:] + kind[:-1] == 3) + 1


def _encoder(source: str) -> tuple[WordTable, bool]:
    """The tokenizers library behind a table of words met before (words end at white space, where this
    tokenizer file never joins pieces), and whether texts may be folded."""
    key = hash(source)
    if key not in _library:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(source)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        known = _known_pieces(source)
        mark = tokenizer.encode(MARK.decode(), add_special_tokens=False).ids

        def encode_texts(found: list[str]) -> list[np.ndarray]:
            return [np.array(e.ids, np.int64) for e in tokenizer.encode_batch_fast(found, add_special_tokens=False)]

        def encode_words(words):
            if not known or len(mark) != 1 or any(MARK in w for w in words):
                ids = encode_texts([w.decode() for w in words])
                return np.concatenate(ids), np.array([len(i) for i in ids], np.int64)
            between = b" " + MARK + b" "
            joined = [between.join(words[k : k + MARKED_WORDS]).decode() for k in range(0, len(words), MARKED_WORDS)]
            ids = np.concatenate([np.append(i, mark) for i in encode_texts(joined)])
            ends = np.flatnonzero(ids == mark[0])
            return np.delete(ids, ends), np.diff(ends, prepend=-1) - 1

        _library.clear()
        _library[key] = WordTable(encode_words, cuts=_cuts if known else None), known
    return _library[key]


def _tokenized(docs: DataFrame, source: str, end_id: int) -> DataFrame:
    """Chunks of whole documents in ascending doc_id order; ids as little-endian 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (table, fold), part, block = _encoder(source), TaskContext.get().partitionId(), 0
        ids, counts, held = [], [], []

        def chunk():
            nonlocal block
            data = np.concatenate(ids).astype("<u4")
            sizes = np.concatenate(counts)
            row = [[part], [block], [[i for h in held for i in h]], [sizes], [len(data)], [data.tobytes()]]
            types = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary()]
            block += 1
            ids.clear(), counts.clear(), held.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types)], names=["part", "block", "doc_ids", "counts", "n_tokens", "ids"])

        for batch in batches:
            for row, end, buf, offsets in texts.blocks(batch.column(1), 1 << 20):
                found, at = table.encode(_folded(buf) if fold else buf, offsets)
                ids.append(np.insert(found, at[1:], end_id))
                counts.append(np.diff(at) + 1)
                held.append(batch.column(0).slice(row, end - row).to_pylist())
                if sum(map(len, ids)) >= BLOCK_TOKENS:
                    yield chunk()
        if ids:
            yield chunk()

    return docs.mapInArrow(texts.lean(run), _CHUNKS)


def _counted(chunks: DataFrame) -> dict[int, int]:
    """Occurrences of every id; at most one row per id and task is shuffled."""

    def run(batches):
        total: dict[int, int] = {}
        for batch in batches:
            for data in batch.column(0):
                found, n = np.unique(np.frombuffer(data.as_py(), "<u4"), return_counts=True)
                for i, k in zip(found.tolist(), n.tolist()):
                    total[i] = total.get(i, 0) + k
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["id", "n"])

    rows = chunks.select("ids").mapInArrow(texts.lean(run), "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    return {r["id"]: r["n"] for r in rows.collect()}


def _lengths(book: dict[int, int]) -> np.ndarray:
    lengths = np.zeros(max(book, default=0) + 1, np.int64)
    lengths[list(book)] = list(book.values())
    return lengths


def _packed(chunks: DataFrame, book: dict[int, int]) -> DataFrame:
    def run(batches):
        lengths = _lengths(book)
        codes = canonical_codes(lengths)
        for batch in batches:
            for i in range(batch.num_rows):
                payload, points = pack(np.frombuffer(batch.column(4)[i].as_py(), "<u4").astype(np.int64), codes, lengths)
                kept = [batch.column(k).slice(i, 1) for k in range(4)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array([points], pa.list_(pa.int64())), pa.array([payload], pa.binary())], names=["part", "block", "doc_ids", "counts", "checkpoints", "payload"])

    return chunks.select("part", "block", "doc_ids", "counts", "ids").mapInArrow(texts.lean(run), _BLOCKS)


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, doc_id: str = "doc_id", text: str = "text") -> None:
    """Tokenize ``docs`` and write the three tables under ``folder``."""
    spark = docs.sparkSession
    source = read_tokenizer(tokenizer)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    narrow = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].cast("string").alias("text"))
    ordered = narrow.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    _tokenized(ordered, source, end_id).write.option("compression", "zstd").parquet(f"{folder}/chunks")
    chunks = spark.read.parquet(f"{folder}/chunks")

    counts = _counted(chunks)
    lengths = code_lengths(_lengths(counts))
    book = {i: int(lengths[i]) for i in sorted(counts)}
    spark.createDataFrame(list(book.items()), "id bigint, length int").coalesce(1).write.parquet(f"{folder}/codebook")
    _packed(chunks, book).write.option("compression", "none").parquet(f"{folder}/blocks")

    sizes = chunks.select("part", "block", "n_tokens")
    parts_before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(parts_before), F.lit(0)).alias("base")
    )
    within = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    index = sizes.withColumn("before", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(bases, "part")
    index.select("part", "block", (F.col("base") + F.col("before")).alias("start"), "n_tokens").write.parquet(f"{folder}/index")


# --- read ---------------------------------------------------------------------------------------


def _decoded(folder: str, spark: SparkSession, schema: str, rows) -> DataFrame:
    """``rows(part, block, doc_ids, counts, ids)`` of every block that is decoded from the files."""
    book = {r["id"]: r["length"] for r in spark.read.parquet(f"{folder}/codebook").collect()}

    def run(batches):
        table = decode_table(_lengths(book))
        for batch in batches:
            for i in range(batch.num_rows):
                part, block, doc_ids, counts, points, payload = (batch.column(k)[i] for k in range(6))
                counts = np.array(counts.values, np.int64)
                ids = unpack(payload.as_py(), np.array(points.values, np.int64), int(counts.sum()), table)
                yield rows(part.as_py(), block.as_py(), doc_ids.values, counts, ids)

    blocks = spark.read.parquet(f"{folder}/blocks")
    return blocks.select("part", "block", "doc_ids", "counts", "checkpoints", "payload").mapInArrow(texts.lean(run), schema)


def _with_start(found: DataFrame, folder: str, *columns: str) -> DataFrame:
    index = found.sparkSession.read.parquet(f"{folder}/index").select("part", "block", "start")
    return found.join(index, ["part", "block"]).select("doc_id", (F.col("start") + F.col("before")).alias("start"), *columns)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, ids of every document, from the files."""

    def rows(part, block, doc_ids, counts, ids):
        ends = np.cumsum(counts)
        n = len(counts)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int32)))
        return pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array([block] * n, pa.int32()), doc_ids, pa.array(ends - counts), lists], names=["part", "block", "doc_id", "before", "ids"])

    schema = "part int, block int, doc_id bigint, before bigint, ids array<int>"
    return _with_start(_decoded(folder, spark, schema, rows), folder, "ids")


def read_checksums(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids (little-endian unsigned 32-bit) of every document."""

    def rows(part, block, doc_ids, counts, ids):
        ends = np.cumsum(counts).tolist()
        data = memoryview(ids.astype("<u4").tobytes())
        sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip([0, *ends], ends)]
        n = len(counts)
        return pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array([block] * n, pa.int32()), doc_ids, pa.array(np.cumsum(counts) - counts), pa.array(counts), pa.array(sums, pa.int64())], names=["part", "block", "doc_id", "before", "n_tokens", "ids_crc32"])

    schema = "part int, block int, doc_id bigint, before bigint, n_tokens bigint, ids_crc32 bigint"
    return _with_start(_decoded(folder, spark, schema, rows), folder, "n_tokens", "ids_crc32")
