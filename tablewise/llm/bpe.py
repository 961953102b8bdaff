"""BPE encoding and decoding with the merge table of a public tokenizer file.

``encode`` gives the ids that the tokenizers library gives for a whole text without special tokens;
``decode`` joins the token strings of ids by one space, as the library does for a file that names no
decoder. Inside a task the distinct words of a block of texts are found by hash, words not met before
are cut into pieces, and all pieces go through the merges together: their symbols lie in one flat
array, every round looks up all neighbouring pairs by binary search over the sorted pair keys, and each
piece merges its lowest-ranked pair. Ids of words are kept from block to block in a table of bounded size.

Nulls and empty texts have no ids and decode to an empty string. A row that occurs twice is encoded twice;
input columns named like an output column are replaced. No row is shuffled.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tablewise.llm import texts
from tablewise.llm.common import without

KNOWN_WORDS = 1 << 21  # entries of a task's word table; it starts anew beyond
NEW_WORDS = 1 << 13  # that are encoded at once

# The normalisation and the pieces of the word BPE file.
SPECIAL_TOKENS = ("<|startoftext|>", "<|endoftext|>")
PIECE = "'s|'t|'re|'ve|'m|'ll|'d|[{L}]+|[{N}]|[^\\s{L}{N}]+"
WORD_END = "</w>"
# Letters and numbers of a later Unicode version, which ``regex`` knows and the tokenizers library does not.
LATER_LETTERS = (
    "558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf "
    "10940-10959 10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb 11df1 16ea0-16eb8 16ebb-16ed3 16ff2-16ff3 "
    "187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 "
    "1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed "
    "1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f "
)
LATER_NUMBERS = "11de0-11de9 1246f 12475-1247f 12550-12686 16ff4-16ff6"


def byte_letters() -> list[str]:
    """The printable letter of every byte in byte-level vocabularies: printable Latin-1 stands for
    itself, the other bytes for the letters from U+0100 on, in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def piece_pattern() -> regex.Pattern:
    """The pieces, with the letters and numbers that the tokenizers library knows."""

    def known(name: str, later: str) -> str:
        spans = (s.split("-") for s in later.split())
        return rf"[\p{{{name}}}--[" + "".join(rf"\U{s[0]:0>8}-\U{s[-1]:0>8}" for s in spans) + "]]"

    return regex.compile("(?V1)" + PIECE.format(L=known("L", LATER_LETTERS), N=known("N", LATER_NUMBERS)))


class WordBpe:
    """The vocabulary and merges of a tokenizer file as sorted numpy tables."""

    def __init__(self, source: str):
        spec = json.loads(source)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        strings = {**{i: s for s, i in vocab.items()}, **{i: s for s, i in self.special.items()}}
        self.strings = [strings.get(i, "") for i in range(self.size)]
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + WORD_END] for c in letters], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order, made[order]
        self._special = regex.compile("|".join(map(regex.escape, self.special)) or r"(?!)")
        self._piece = piece_pattern()

    def pieces(self, text: str) -> list[str | int]:
        """The normalised pieces of a text; a special token is its id."""
        out, at = [], 0
        for m in [*self._special.finditer(text), None]:
            plain = text[at : m.start() if m else len(text)]
            if not plain.isascii():
                # lower-casing goes letter by letter, without the rule for a final sigma
                plain = unicodedata.normalize("NFC", plain).replace("Σ", "σ")
            out += self._piece.findall(plain.lower())
            if m:
                out.append(self.special[m.group()])
                at = m.end()
        return out

    def merge(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in one array, and the number of ids of each."""
        raw = [p.encode() for p in pieces]
        lengths = np.array([len(r) for r in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.inner[data]
        ends = np.cumsum(lengths)
        symbols[ends - 1] = self.last[data[ends - 1]]
        owner = np.repeat(np.arange(len(raw)), lengths)
        done_symbols, done_owner = [], []
        while len(symbols):
            rank, found = self._ranks(symbols, owner)
            begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            lowest = np.minimum.reduceat(rank, begin)
            live = np.repeat(lowest < len(self.keys), np.diff(np.append(begin, len(owner))))
            done_symbols.append(symbols[~live])
            done_owner.append(owner[~live])
            hit = live & (rank == np.repeat(lowest, np.diff(np.append(begin, len(owner)))))
            hit = _apart(hit)
            at = np.flatnonzero(hit)
            symbols[at] = self.made[found[at]]
            live[at + 1] = False
            symbols, owner = symbols[live], owner[live]
        ids, owners = np.concatenate(done_symbols or [symbols]), np.concatenate(done_owner or [owner])
        order = np.argsort(owners, kind="stable")
        return ids[order], np.bincount(owners, minlength=len(raw))

    def _ranks(self, symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each symbol the rank of the pair it begins (past all ranks: none) and its table place."""
        none = len(self.keys)
        rank, place = np.full(len(symbols), none, np.int64), np.zeros(len(symbols), np.int64)
        if none and len(symbols) > 1:
            key = symbols[:-1] * self.size + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), none - 1)
            ok = (self.keys[at] == key) & (owner[:-1] == owner[1:])
            rank[:-1] = np.where(ok, self.rank[at], none)
            place[:-1] = at
        return rank, place

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words without white space, and the number of ids of each."""
        cut = [self.pieces(w.decode()) for w in words]
        plain = list(dict.fromkeys(p for c in cut for p in c if isinstance(p, str)))
        place = {p: i for i, p in enumerate(plain)}
        ids, counts = self.merge(plain)
        marks = list(dict.fromkeys(p for c in cut for p in c if isinstance(p, int)))
        place.update({m: len(plain) + i for i, m in enumerate(marks)})
        ids, counts = np.concatenate([ids, np.array(marks, np.int64)]), np.concatenate([counts, np.ones(len(marks), np.int64)])
        starts = np.cumsum(counts) - counts
        order = np.array([place[p] for c in cut for p in c], np.int64)
        pieces = np.array([len(c) for c in cut], np.int64)
        per_piece = np.concatenate([[0], np.cumsum(counts[order])])
        upto = np.cumsum(pieces)
        return texts.gather(ids, starts[order], counts[order]), per_piece[upto] - per_piece[upto - pieces]


def _apart(hit: np.ndarray) -> np.ndarray:
    """Of hits that overlap (a run of equal symbols) every second one, from the left."""
    if not (hit[1:] & hit[:-1]).any():
        return hit
    index = np.arange(len(hit))
    begin = np.maximum.accumulate(np.where(hit & ~np.concatenate([[False], hit[:-1]]), index, 0))
    return hit & ((index - begin) % 2 == 0)


class WordTable:
    """Ids of words met before, found by the word's hash; begins anew when ``limit`` words are exceeded.

    ``cuts`` gives places in a block where words may be cut further."""

    def __init__(
        self,
        encode_words: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]],
        limit: int = KNOWN_WORDS,
        cuts: Callable[[np.ndarray], np.ndarray] | None = None,
    ):
        self.encode_words, self.limit, self.cuts = encode_words, limit, cuts
        self._clear()

    def _clear(self) -> None:
        self.keys, self.starts, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.int32)

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a block in one array, and the offsets of the rows in it."""
        starts, ends, first = texts.word_spans(buf, offsets, self.cuts(buf) if self.cuts else None)
        hashes = texts.hash_spans(buf, starts, ends)
        unique, example, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) + len(unique) > self.limit:
            self._clear()
        at = np.searchsorted(self.keys, unique)
        known = np.zeros(len(unique), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == unique[inside]
        if not known.all():
            new, found = example[~known], []
            for k in range(0, len(new), NEW_WORDS):
                part = new[k : k + NEW_WORDS]
                found.append(self.encode_words([buf[a:b].tobytes() for a, b in zip(starts[part].tolist(), ends[part].tolist())]))
            self._add(unique[~known], *(np.concatenate([x[i] for x in found]) for i in (0, 1)))
            at = np.searchsorted(self.keys, unique)
        counts = self.counts[at][inverse].astype(np.int64)
        upto = np.concatenate([[0], np.cumsum(counts)])
        return texts.gather(self.ids, self.starts[at][inverse], counts), upto[first]

    def _add(self, keys: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        starts = len(self.ids) + np.cumsum(counts) - counts
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.starts = np.insert(self.starts, at, starts)
        self.counts = np.insert(self.counts, at, counts)


_tables: dict[int, tuple[WordBpe, WordTable]] = {}


def _table(source: str) -> tuple[WordBpe, WordTable]:
    """A worker process reads a tokenizer file once and keeps the words it met."""
    key = hash(source)
    if key not in _tables:
        _tables.clear()
        model = WordBpe(source)
        texts.give_back()  # what reading the file took
        _tables[key] = (model, WordTable(model.encode_words))
    return _tables[key]


def read_tokenizer(path: str) -> str:
    """The text of a tokenizer file, read where the driver runs and shipped with the job."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def _ids_array(ids: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))


def decode_ids(strings: list[str], ids: np.ndarray, offsets: np.ndarray) -> list[str]:
    """The token strings of each row's ids, joined by one space."""
    at = offsets.tolist()
    return [" ".join([strings[i] for i in ids[a:b].tolist()]) for a, b in zip(at, at[1:])]


def _mapped(df: DataFrame, column: str, added: list[T.StructField], work: Callable) -> DataFrame:
    """``df`` with columns that ``work`` makes, block by block, from the named column."""
    keep = without(df, [f.name for f in added])
    source = df.select(*[df[c] for c in keep], df[column].alias("__in"))
    schema = T.StructType([*(df.schema[c] for c in keep), *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, arrays in work(batch.column(batch.num_columns - 1)):
                kept = [batch.column(i).slice(row, end - row) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*kept, *arrays], names=[f.name for f in schema])

    return source.mapInArrow(texts.lean(run), schema)


IDS = T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)
DECODED = T.StructField("decoded", T.StringType(), False)


def encode(df: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """``df`` with the column ``ids``."""
    source = read_tokenizer(tokenizer)

    def work(column):
        _, table = _table(source)
        for row, end, buf, offsets in texts.blocks(column):
            yield row, end, [_ids_array(*table.encode(buf, offsets))]

    return _mapped(df, text, [IDS], work)


def decode(df: DataFrame, tokenizer: str, ids: str = "ids") -> DataFrame:
    """``df`` with the column ``decoded``; null ids decode to an empty string."""
    source = read_tokenizer(tokenizer)

    def work(column):
        model, _ = _table(source)
        values, offsets = column.flatten().to_numpy(zero_copy_only=False), np.zeros(len(column) + 1, np.int64)
        np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), out=offsets[1:])
        yield 0, len(column), [pa.array(decode_ids(model.strings, values, offsets), pa.string())]

    return _mapped(df, ids, [DECODED], work)


def encode_and_decode(df: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """``df`` with ``ids`` and ``decoded``, in one pass over the rows."""
    source = read_tokenizer(tokenizer)

    def work(column):
        model, table = _table(source)
        for row, end, buf, offsets in texts.blocks(column):
            ids, at = table.encode(buf, offsets)
            yield row, end, [_ids_array(ids, at), pa.array(decode_ids(model.strings, ids, at), pa.string())]

    return _mapped(df, text, [IDS, DECODED], work)
