"""Tokens of two tokenizers over the same bytes, grouped where both end, and how usual each overlap is.

Tokenizer A is a byte-level BPE (a rank file, read by tiktoken; texts that its regular expressions give up on go to
the same vocabulary in the tokenizers library), B a sentencepiece model with byte fallback. A reads a space and the text,
B the text, before which it puts a space itself. Strings of special tokens are plain text for both.

* Cuts. Both tokenizations are lists of byte ends. An interval of A's ends is searched outwards from its middle for an
  end that bisection finds among B's ends; the interval is then cut there and both halves are searched in turn. An
  interval without a cut is a leaf: with the cut that ends it, it is one group. The intervals of all documents of a block
  are searched together, level by level.
* Links. Inside a group every A token is linked with every B token whose bytes overlap; the ends of both, merged, are
  exactly the links.
* Counts. Every document reports its distinct (A id, B id) pairs, each task adds them up before they are
  shuffled, and a pair's count is the number of its documents. The most frequent pairs (``HEAVY`` at most, chosen by a
  power of two of the count, and so a bounded broadcast) are looked up where the documents lie, since a pair may occur in
  all of them; all others are joined.

Null and empty texts and texts that a tokenizer does not give back byte by byte have no tokens: counts are 0 and
``groups`` is empty. Rows that repeat are rows of their own, and each counts as a document. Extra columns are carried, those
named like the new ones are replaced. An empty table gives an empty one. A text is tokenized whole by one task.
"""

from __future__ import annotations

import base64
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewise.llm import texts
from tablewise.llm.common import stage, without

BLOCK_BYTES = 1 << 20
HEAVY = 1 << 20
KNOWN_CHUNKS, KNOWN_IDS = 1 << 20, 1 << 23  # met before, in a worker
HELD_PAIRS = 1 << 20  # distinct pairs that a task adds up before it passes them on
NEW = ["n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"]


def _table(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pieces one after another, where each begins, and their sizes."""
    size = np.array([len(p) for p in pieces], np.int64)
    return np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(size) - size, size


class Tokenizers:
    """Both vocabularies, and the tokens of chunks met before.

    Both tokenizers are free to be asked chunk by chunk where a chunk ends before a blank that follows a visible
    ASCII character or a letter of U+00C0 to U+00FF: A's expressions begin anew there, and no piece of B has a blank after another
    character (whole texts are taken if one has). Every chunk begins with the blank that B adds by itself.
    """

    def __init__(self, ranks: str, json: str, model: str, pattern: str):
        import sentencepiece
        import tiktoken

        with open(ranks, "rb") as file:
            by_bytes = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, file)}
        pieces = [b""] * (max(by_bytes.values()) + 1)
        for word, rank in by_bytes.items():
            pieces[rank] = word
        self.a_table, self.json, self._whole = _table(pieces), json, None
        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=by_bytes, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=model)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_table = _table([bytes([int(n[3:-1], 16)]) if self.b.is_byte(i) else n.replace("\u2581", " ").encode() for i, n in enumerate(names)])
        self.cuts = not any("\u2581" in n.lstrip("\u2581") for n in names)
        self._clear()

    def _clear(self) -> None:
        self.keys, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.starts, self.n_a, self.n_b = (np.zeros(0, np.int64) for _ in range(3))
        self.same = np.zeros(0, bool)

    def encode_a(self, text: str) -> np.ndarray:
        try:
            return self.a.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
        except BaseException as error:  # the regular expressions run out of stack on very long runs of blanks
            if not isinstance(error, ValueError) and type(error).__name__ != "PanicException":
                raise
        if self._whole is None:
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_file(self.json)
            self._whole.encode_special_tokens = True
            self._whole.no_truncation(), self._whole.no_padding()
        return np.array(self._whole.encode(text, add_special_tokens=False).ids, np.int64)

    def _learn(self, keys: np.ndarray, want: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Tokens of chunks of ``want`` that are new, and whether their bytes are the chunk's."""
        data = want.tobytes()
        chunks = [data[x:y].decode() for x, y in zip(starts.tolist(), ends.tolist())]
        b = self.b.encode([chunk[1:] for chunk in chunks], num_threads=1)
        n_b, sizes = np.array([len(x) for x in b], np.int64), ends - starts
        b = np.fromiter(itertools.chain.from_iterable(b), np.int64, int(n_b.sum()))
        # A reads chunks that may be cut behind as one text, the others one by one
        joins = self._ends_visibly(want, ends) & (want[starts] == 32)
        whole = self.encode_a("".join(itertools.compress(chunks, joins.tolist())))
        ended = np.searchsorted(np.cumsum(self.a_table[2][whole]), np.cumsum(sizes[joins]))
        parts = np.split(whole, ended[:-1] + 1) if len(ended) else []
        alone = iter([self.encode_a(chunk) for chunk in itertools.compress(chunks, (~joins).tolist())])
        parts = iter(parts)
        a = [next(parts) if together else next(alone) for together in joins.tolist()]
        n_a = np.array([len(x) for x in a], np.int64)
        a = np.concatenate(a)
        flat, begin = texts.gather(want, starts, sizes), np.concatenate([[0], np.cumsum(sizes)])
        same = same_bytes(a, np.concatenate([[0], np.cumsum(n_a)]), self.a_table, flat, begin)
        same &= same_bytes(b, np.concatenate([[0], np.cumsum(n_b)]), self.b_table, flat, begin)
        first = len(self.ids) + np.concatenate([[0], np.cumsum(n_a + n_b)])[:-1]
        own = np.empty(len(a) + len(b), np.int32)
        is_a = np.repeat(np.tile([True, False], len(chunks)), np.stack([n_a, n_b], 1).reshape(-1))
        own[is_a], own[~is_a] = a, b
        self.ids, at = np.concatenate([self.ids, own]), np.searchsorted(self.keys, keys)
        for name, values in (("keys", keys), ("starts", first), ("n_a", n_a), ("n_b", n_b), ("same", same)):
            setattr(self, name, np.insert(getattr(self, name), at, values))

    @staticmethod
    def _ends_visibly(want: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Whether the character before each end is a visible ASCII one or a letter of U+00C0 to U+00FF."""
        if not len(ends):
            return np.zeros(0, bool)
        last, lead = want[np.maximum(ends - 1, 0)], want[np.maximum(ends - 2, 0)]
        return (ends > 1) & (((last > 32) & (last < 127)) | ((lead == 0xC3) & (last > 127)))

    def chunks(self, want: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of every chunk of the rows of ``want`` (from ``begin``, one more at the end)."""
        opens = np.zeros(len(want), bool)
        if self.cuts:
            blanks = np.flatnonzero(want == 32)
            opens[blanks[self._ends_visibly(want, blanks)]] = True
        edges = begin[1:]
        opens[edges[edges > 0] - 1] = False  # a last blank alone would be nothing to B
        opens[begin[:-1][np.diff(begin) > 0]] = True
        starts = np.flatnonzero(opens)
        return starts, np.append(starts[1:], len(want))

    def encode(self, want: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A and the first of each row (one more at the end), the same of B, and which rows both give back.

        ``want`` has a blank and the text of every row, or nothing. Other rows have no ids.
        """
        starts, ends = self.chunks(want, begin)
        hashes = texts.hash_spans(want, starts, ends)
        unique, example, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) + len(unique) > KNOWN_CHUNKS or len(self.ids) > KNOWN_IDS:
            self._clear()
        new = ~np.isin(unique, self.keys, assume_unique=True)
        if new.any():
            self._learn(unique[new], want, starts[example[new]], ends[example[new]])
        at = np.searchsorted(self.keys, unique)[inverse]
        first = np.searchsorted(starts, begin)
        bad = np.concatenate([[0], np.cumsum(~self.same[at])])
        ok = (np.diff(begin) > 0) & (bad[first[1:]] == bad[first[:-1]])
        at = at[np.repeat(ok, np.diff(first))]
        counts = np.concatenate([[0], np.cumsum(np.where(ok, np.diff(first), 0))])
        n_a, n_b, place = self.n_a[at], self.n_b[at], self.starts[at]
        a_first = np.concatenate([[0], np.cumsum(n_a)])[counts]
        b_first = np.concatenate([[0], np.cumsum(n_b)])[counts]
        a, b = texts.gather(self.ids, place, n_a), texts.gather(self.ids, place + n_a, n_b)
        return a.astype(np.int64), a_first, b.astype(np.int64), b_first, ok


def same_bytes(ids: np.ndarray, first: np.ndarray, table, want: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Rows whose tokens' bytes, joined, are the row's bytes in ``want`` (from ``begin``, one more at the end)."""
    flat, starts, size = table
    sizes = size[ids]
    upto = np.concatenate([[0], np.cumsum(sizes)])
    ok = upto[first[1:]] - upto[first[:-1]] == np.diff(begin)
    rows = np.flatnonzero(ok & (np.diff(begin) > 0))
    if len(rows):
        tokens = texts.gather(np.arange(len(ids)), first[rows], np.diff(first)[rows])
        got = texts.gather(flat, starts[ids[tokens]], sizes[tokens])
        counts = np.diff(begin)[rows]
        wrong = np.flatnonzero(got != texts.gather(want, begin[rows], counts))
        ok[rows[np.searchsorted(np.cumsum(counts), wrong, side="right")]] = False
    return ok


def shared_cuts(a_ends: np.ndarray, b_ends: np.ndarray, a_first: np.ndarray) -> np.ndarray:
    """The places in ``a_ends`` of the ends that ``b_ends`` has too, in ascending order.

    Rows of ``a_ends`` begin at ``a_first`` (one more at the end); the last end of each row is a cut.
    """
    low, high = a_first[:-1], a_first[1:] - 1
    cuts = [high[high >= low]]
    low, high = low[high > low], high[high > low]
    while len(low):
        middle = (low + high) >> 1
        ends = a_ends[middle]
        found = np.where(b_ends[np.searchsorted(b_ends, ends)] == ends, middle, -1)
        open_, near, far = np.flatnonzero((found < 0) & (high - low > 1)), 1, 2
        while len(open_):
            # the ring of ends that lie near .. far - 1 from the middle, on both sides
            m, lo, hi = middle[open_], low[open_], high[open_]
            left = np.maximum(lo, m - far + 1)
            right = np.minimum(hi, m + far)
            n_left, n_right = np.maximum(m - near + 1 - left, 0), np.maximum(right - m - near, 0)
            counts = n_left + n_right
            owner = np.repeat(np.arange(len(open_)), counts)
            k = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
            at = np.where(k < n_left[owner], left[owner] + k, m[owner] + near + k - n_left[owner])
            place = np.searchsorted(b_ends, a_ends[at])
            hit = np.flatnonzero(b_ends[place] == a_ends[at])
            hit = hit[np.argsort(-np.abs(at[hit] - m[owner[hit]]), kind="stable")]  # the nearest is written last
            found[open_[owner[hit]]] = at[hit]
            done = (found[open_] >= 0) | ((m - far < lo) & (m + far >= hi))
            open_, near, far = open_[~done], far, 2 * far
        cut = found >= 0
        cuts.append(found[cut])
        low, high = np.concatenate([low[cut], found[cut] + 1]), np.concatenate([found[cut], high[cut]])
        low, high = low[high > low], high[high > low]
    return np.sort(np.concatenate(cuts))


def links(a_ends: np.ndarray, b_ends: np.ndarray, a_cuts: np.ndarray, b_cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The A token and the B token of every link, in order of bytes: each end of either, a common one once, ends one."""
    own = np.ones(len(b_ends), bool)
    own[b_cuts] = False
    extra = np.flatnonzero(own)
    at = np.searchsorted(a_ends, b_ends[extra])
    return np.insert(np.arange(len(a_ends)), at, at), np.insert(np.searchsorted(b_ends, a_ends), at, extra)


def decimals(n: int, closing: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ids below n in decimal digits and, at 2 * id and 2 * id + 1, either closing byte behind them, as eight bytes;
    and how many of these are used."""
    texts_ = [str(i).encode() + closing[k : k + 1] for i in range(n) for k in (0, 1)]
    if len(texts_[-1]) > 8:
        raise ValueError("a vocabulary of more than ten million ids")
    return np.frombuffer(b"".join(x.ljust(8) for x in texts_), np.uint64), np.array([len(x) for x in texts_], np.int64)


def grouped_text(a_ids, b_ids, a_cuts, b_cuts, a_first, b_first, a_names, b_names) -> tuple[np.ndarray, np.ndarray]:
    """``a1,a2|b1;a3|b2,b3`` of each row as bytes, and where each row begins (one more at the end)."""
    a_close, b_close = np.zeros(len(a_ids), np.int64), np.zeros(len(b_ids), np.int64)
    a_close[a_cuts], b_close[b_cuts] = 1, 1
    # of a group come its A tokens, then its B tokens
    a_upto, b_upto = np.concatenate([[0], a_cuts + 1]), np.concatenate([[0], b_cuts + 1])
    a_at = np.arange(len(a_ids)) + b_upto[np.cumsum(a_close) - a_close]
    b_at = np.arange(len(b_ids)) + a_upto[np.cumsum(b_close) - b_close + 1]
    words, sizes = np.empty(len(a_ids) + len(b_ids), np.uint64), np.empty(len(a_ids) + len(b_ids), np.int64)
    for at, ids, close, (names, size) in ((a_at, a_ids, a_close, a_names), (b_at, b_ids, b_close, b_names)):
        places = 2 * ids + close
        words[at], sizes[at] = names[places], size[places]
    used = np.arange(8) < sizes[:, None]
    rows = a_first + b_first  # tokens before each row
    last = rows[1:][np.diff(rows) > 0] - 1
    used[last, sizes[last] - 1] = False  # nothing follows the last group
    sizes[last] -= 1
    return words.view(np.uint8).reshape(-1, 8)[used], np.concatenate([[0], np.cumsum(sizes)])[rows]


def packed_pairs(pairs: np.ndarray, row: np.ndarray, rows: int, span: int) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """Distinct pairs of each row in ascending order as gaps, how often each occurs, and their number per row."""
    keys, times = np.unique(row * span + pairs, return_counts=True)
    owner, pair = keys // span, keys % span
    counts = np.bincount(owner, minlength=rows)
    begin = np.concatenate([[0], np.cumsum(counts)])
    gaps = np.diff(pair, prepend=0)
    starts = begin[:-1][counts > 0]
    gaps[starts] = pair[starts]
    kind = np.uint32 if span <= 1 << 32 else np.uint64
    return _blobs(gaps.astype(kind), begin), _blobs(times.astype(np.uint32), begin), counts


def _blobs(values: np.ndarray, begin: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(begin) - 1, [None, pa.py_buffer((begin * values.itemsize).astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])


def unpacked_pairs(blobs: pa.Array, wide: bool) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a column of gaps, and where each row begins (one more at the end)."""
    buf, offsets = texts.flat(blobs)
    values = buf.view(np.uint64 if wide else np.uint32).astype(np.int64)
    begin = offsets // (8 if wide else 4)
    upto = np.concatenate([[0], np.cumsum(values)])
    return upto[1:] - np.repeat(upto[begin[:-1]], np.diff(begin)), begin


def align(df: DataFrame, ranks: str, json: str, model: str, pattern: str, text: str = "text") -> DataFrame:
    """``df`` with n_a, n_b, n_groups, n_links, groups (``a1,a2|b1;a3|b2,b3``: ids of A and B, group by group) and
    what ``counted`` reads: pairs (distinct pairs A id * size of B + B id, ascending, as gaps) and times (of each).

    Paths are those of the vocabulary files on the workers."""
    kept = without(df, NEW)
    rows = df.select(*[df[c].alias(f"__c{i}") for i, c in enumerate(kept)], F.coalesce(df[text].cast("string"), F.lit("")).alias("__text"))
    new = [T.StructField(c, T.LongType()) for c in NEW[:4]] + [T.StructField("groups", T.StringType()), T.StructField("pairs", T.BinaryType()), T.StructField("times", T.BinaryType())]
    schema = T.StructType([*rows.schema.fields[:-1], *new])

    def run(batches):
        both = Tokenizers(ranks, json, model, pattern)
        size_a, size_b = len(both.a_table[2]), len(both.b_table[2])
        a_names, b_names = decimals(size_a, b",|"), decimals(size_b, b",;")
        for batch in batches:
            column = batch.column(len(kept))
            for row, end, buf, offsets in texts.blocks(column, BLOCK_BYTES):
                n, some = end - row, np.diff(offsets) > 0
                want, begin = np.insert(buf, offsets[:-1][some], 32), offsets + np.concatenate([[0], np.cumsum(some)])
                a, a_first, b, b_first, _ = both.encode(want, begin)
                a_ends, b_ends = np.cumsum(both.a_table[2][a]), np.cumsum(both.b_table[2][b])
                a_cuts = shared_cuts(a_ends, b_ends, a_first)
                b_cuts = np.searchsorted(b_ends, a_ends[a_cuts])
                n_a, n_b = np.diff(a_first), np.diff(b_first)
                n_groups = np.diff(np.searchsorted(a_cuts, a_first))
                n_links = n_a + n_b - n_groups
                body, at = grouped_text(a, b, a_cuts, b_cuts, a_first, b_first, a_names, b_names)
                in_a, in_b = links(a_ends, b_ends, a_cuts, b_cuts)
                pairs, times, _ = packed_pairs(a[in_a] * size_b + b[in_b], np.repeat(np.arange(n), n_links), n, size_a * size_b)
                groups = pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(body.tobytes())])
                new = [pa.array(x.astype(np.int64)) for x in (n_a, n_b, n_groups, n_links)]
                carried = [batch.column(i).slice(row, n) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*carried, *new, groups, pairs, times], names=schema.names)

    out = rows.mapInArrow(texts.lean(run), schema)
    return out.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(kept)], *NEW)


def _added(batches, wide: bool):
    """Pairs and in how many rows of the task they are."""
    held, size = [], 0

    def merged():
        keys = np.concatenate([k for k, _ in held])
        n = np.concatenate([c for _, c in held])
        keys, place = np.unique(keys, return_inverse=True)
        return keys, np.bincount(place, n, len(keys)).astype(np.int64)

    def batch_of(keys, n):
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["pair", "n"])

    for batch in batches:
        found = unpacked_pairs(batch.column(0), wide)[0]
        if len(found):
            held.append(np.unique(found, return_counts=True))
            size += len(held[-1][0])
        if size > 2 * HELD_PAIRS:
            held = [merged()]
            size = len(held[0][0])
            if size > HELD_PAIRS:
                yield batch_of(*held[0])
                held, size = [], 0
    if held:
        yield batch_of(*merged())


def counted(aligned: DataFrame, size_a: int, size_b: int, row: str, heavy: int = HEAVY) -> DataFrame:
    """row, n_best and count_sum of every row of ``aligned`` (staged: it is read twice; ``row`` is unique).

    count_sum adds up the counts of a row's links, a pair's count being the number of rows that hold it; n_best is the number
    of links whose count is the highest of their A id.
    """
    wide = size_a * size_b > 1 << 32
    pairs = aligned.select("pairs").mapInArrow(lambda batches: _added(batches, wide), "pair bigint, n bigint")
    counts = stage(pairs.groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    a = F.floor(F.col("pair") / size_b).cast("int")
    highest = np.zeros(size_a, np.int64)
    most = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most")).toArrow()  # one row for each id of A at most
    highest[most.column("a").to_numpy()] = most.column("most").to_numpy()
    powers = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).agg(F.count(F.lit(1)).alias("pairs")).collect()
    power, there = 64, 0
    for r in sorted(powers, key=lambda r: -r["power"]):
        there += r["pairs"]
        if there > heavy:
            break
        power = r["power"]
    bound = 1 << power if power < 64 else 1 << 62
    table = counts.filter(F.col("n") >= bound).toArrow()
    keys, values = table.column("pair").to_numpy(), table.column("n").to_numpy()
    order = np.argsort(keys)
    shared = aligned.sparkSession.sparkContext.broadcast((keys[order], values[order], highest))
    names, kind = ["row", "pair", "times", "n_best", "count_sum"], aligned.schema[row].dataType.simpleString()

    def look_up(batches):
        known, n_of, top = shared.value
        for batch in batches:
            pair, begin = unpacked_pairs(batch.column(1), wide)
            times = texts.flat(batch.column(2))[0].view(np.uint32).astype(np.int64)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(begin))
            place = np.minimum(np.searchsorted(known, pair), max(len(known) - 1, 0))
            hit = known[place] == pair if len(known) else np.zeros(len(pair), bool)
            n = np.where(hit, n_of[place] if len(known) else 0, 0)
            best = hit & (n == top[pair // size_b])
            sums = [np.bincount(owner, x, batch.num_rows).astype(np.int64) for x in (times * best, times * n)]
            rows, none = batch.column(0), pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([rows, none, none, pa.array(sums[0]), pa.array(sums[1])], names=names)
            rest = np.flatnonzero(~hit)
            if len(rest):
                none = pa.nulls(len(rest), pa.int64())
                yield pa.RecordBatch.from_arrays([rows.take(pa.array(owner[rest])), pa.array(pair[rest]), pa.array(times[rest]), none, none], names=names)

    looked = aligned.select(row, "pairs", "times").mapInArrow(look_up, f"row {kind}, pair bigint, times bigint, n_best bigint, count_sum bigint")
    looked = stage(looked, "pair-lookups")
    rare = counts.filter(F.col("n") < bound).select("pair", "n", a.alias("a"))
    best = F.broadcast(counts.sparkSession.createDataFrame(most))  # one row for each id of A at most
    rare = rare.join(best, "a").select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))
    rest = looked.filter("pair is not null").select("row", "pair", "times").join(rare, "pair")
    rest = rest.select("row", (F.col("times") * F.col("best")).alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum"))
    both = looked.filter("pair is null").select("row", "n_best", "count_sum").unionByName(rest)
    return both.groupBy(F.col("row").alias(row)).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def sizes(ranks: str, model: str) -> tuple[int, int]:
    """How many ids the two vocabularies have."""
    import sentencepiece

    with open(ranks, "rb") as file:
        a = max(int(line.split()[1]) for line in file) + 1
    return a, sentencepiece.SentencePieceProcessor(model_file=model).get_piece_size()


def digest(groups: Column) -> Column:
    return F.when(groups == "", F.lit("")).otherwise(F.sha2(groups, 256))
