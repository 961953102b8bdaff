"""Spelling variants: words that differ by one code point, found through a pair dictionary of two tries.

Every prefix of a word is a node of the forward trie, every suffix a node of the trie of reversed words, and both kinds
of nodes are numbered. A word of length L stands at ``L + 1`` integer pairs (node of the first i code points, node of
the rest from i) with nothing skipped, and at L pairs (node of the first i, node of the rest from i + 1) with one code
point skipped. Exactly two cases meet at one pair:

* two words that skip a code point there differ by a replacement,
* a word that skips and one that does not differ by an insertion. A run of equal code points gives the same shorter
  word at each of its places, so only the first place of a run counts here.

Each near pair meets at one pair of nodes, once, so near words are counted without listing pairs: a pair of nodes has at
most one word without a skip and as many with one as there are letters; a window over it gives every word the number of
the others and the best of them.

Nodes are numbered where the sorted words lie: a word opens a node for each code point beyond what it shares with the
word before it, and takes the others from that word. Nodes that reach over the border of two range partitions are
given the number of the first partition; for this the driver gets two words and one list of nodes per partition, as
many as Spark's own range bounds, and never the words themselves.

Null, empty and very long words are words like others (null is left out); repeated rows of a word add up their n. An
empty table gives an empty one. Extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewise.llm import texts
from tablewise.llm.common import stage

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PART = 40  # bits below the number of a partition in ids and nodes
NODES_AT_ONCE = 1 << 20  # in one batch between Python and Spark


def words_of(docs: DataFrame, every: int | None = None, least: int = 7, occurrences: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n: maximal runs of letters in whole texts, A-Z lower-cased, of ``least`` code points in ``occurrences``
    places or more. ``every`` plants misspellings: a run whose CRC-32 with its doc_id (null: empty) it divides
    loses one code point first."""
    pattern = RUN.replace("+", f"{{{least},}}")  # shorter runs cannot grow
    found = F.explode(F.regexp_extract_all(docs[text].cast("string"), F.lit(pattern), F.lit(0))).alias("run")
    runs = docs.select(F.coalesce(docs[doc_id].cast("string"), F.lit("")).alias("doc"), found)
    runs = runs.select("doc", F.translate("run", _UPPER, _LOWER).alias("word"))
    if every:
        runs = runs.withColumn("h", F.crc32(F.concat("doc", F.lit(":"), "word").cast("binary")))
        gone = (F.col("h") % F.length("word")).cast("int")
        less = F.concat(F.substring("word", F.lit(1), gone), F.substring("word", gone + 2, F.length("word")))
        runs = runs.select(F.when(F.col("h") % every == 0, less).otherwise(F.col("word")).alias("word"))
        runs = runs.filter(F.length("word") >= least)
    return runs.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= occurrences)


def code_points(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all words one after another, and where each word begins (one more at the end)."""
    flat = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = pa.compute.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    return flat, np.concatenate([[0], np.cumsum(sizes)])


def shared_depths(flat: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """How many first code points each word shares with the one before it (the first word: none)."""
    size = np.diff(begin)
    out = np.zeros(len(size), np.int64)
    same = np.arange(1, len(size))
    depth = 0
    while len(same):
        same = same[(size[same] > depth) & (size[same - 1] > depth)]
        same = same[flat[begin[same] + depth] == flat[begin[same - 1] + depth]]
        depth += 1
        out[same] = depth
    return out


def trie_nodes(size: np.ndarray, shared: np.ndarray, first: int) -> np.ndarray:
    """Nodes of every word's code points, one word after another: new ones, counted from ``first``, beyond what a
    word shares with the word before it, the earlier word's ones up to there."""
    begin = np.concatenate([[0], np.cumsum(size)])
    base = first + np.concatenate([[0], np.cumsum(size - shared)])
    out = np.empty(int(begin[-1]), np.int64)
    rows, depth = np.flatnonzero(size > 0), 1
    while len(rows):
        owner = np.maximum.accumulate(np.where(shared[rows] < depth, np.arange(len(rows)), 0))
        opener = rows[owner]
        out[begin[rows] + depth - 1] = base[opener] + depth - 1 - shared[opener]
        rows = rows[size[rows] > depth]
        depth += 1
    return out


def _numbered(words: DataFrame, key: str, name: str) -> DataFrame:
    """``words`` (a column ``word`` and others) in ranges of ``key`` (the word or the reversed word) with

    row: place in the order of ``key``; nodes: of every code point of ``key``; open: how many of them all
    words of the partition so far share, which may belong to earlier partitions.
    """
    carried = [c for c in words.columns if c != key]
    kinds = [f"`{c}` {words.schema[c].dataType.simpleString()}" for c in carried]
    names = [*carried, "key", "row", "nodes", "open"]

    def run(batches):
        row = fresh = TaskContext.get().partitionId() << _PART
        last, last_nodes, least = None, np.zeros(0, np.int64), None
        for batch in batches:
            column, at = batch.column(len(carried)), 0
            length = pa.compute.utf8_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(np.cumsum(length[at:]), NODES_AT_ONCE, side="right")) + at)
                part = column.slice(at, end - at)
                # the last word of the block before leads this one, so that what it shares is known
                led = part if last is None else pa.concat_arrays([pa.array([last], part.type), part])
                flat, begin = code_points(led)
                size, shared = np.diff(begin), shared_depths(flat, begin)
                lead = int(last is not None)
                nodes = trie_nodes(size, shared, fresh - lead * int(size[0]))
                if lead:  # of the leading word come the numbers it was given before
                    path, own = int(size[0]), begin[1:-1]
                    still = np.minimum.accumulate(shared[1:])
                    counts = np.minimum(still, path)
                    cells = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
                    nodes[np.repeat(own, counts) + cells] = last_nodes[cells]
                    size, shared, nodes, begin = size[1:], shared[1:], nodes[path:], begin[1:] - path
                still = np.minimum.accumulate(shared[1:] if least is None else shared) if len(shared) > (least is None) else shared[:0]
                if least is None:
                    still, least = np.concatenate([size[:1], np.minimum(still, size[0])]), int(size[0])
                still = np.minimum(still, least)
                least = int(still[-1])
                fresh += int((size - shared).sum())
                lists = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(nodes))
                rows = pa.array(np.arange(row, row + end - at))
                kept = [batch.column(i).slice(at, end - at) for i in range(len(carried))]
                yield pa.RecordBatch.from_arrays([*kept, part, rows, lists, pa.array(still)], names=names)
                row += end - at
                last, last_nodes = part[-1].as_py(), nodes[begin[-2] : begin[-1]]
                at = end

    ranges = words.repartitionByRange(key).sortWithinPartitions(key).select(*carried, key)
    schema = ", ".join([*kinds, "key string, row bigint, nodes array<bigint>, open bigint"])
    found = stage(ranges.mapInArrow(texts.lean(run), schema), name)
    return _across_borders(found)


def _across_borders(found: DataFrame) -> DataFrame:
    """The nodes that a partition's first words share with the last word of an earlier one get that one's numbers."""
    part = F.shiftright("row", _PART).alias("part")
    ends = found.groupBy(part).agg(F.min("row").alias("low"), F.max("row").alias("high"))
    ends = ends.select(F.explode(F.array_distinct(F.array("low", "high"))).alias("row"))
    rows = sorted(found.join(F.broadcast(ends), "row").select("row", "key", "nodes", "open").toLocalIterator(), key=lambda r: r["row"])
    moved, before = {}, None  # two rows a partition, as many as Spark's range bounds
    for r in rows:
        number, nodes = r["row"] >> _PART, list(r["nodes"])
        if before and before[0] != number:
            shared = next((i for i, (a, b) in enumerate(zip(before[1], r["key"])) if a != b), min(len(before[1]), len(r["key"])))
            moved[number] = before[2][:shared]
        given = moved.get(number, [])
        upto = min(len(given), r["open"])
        before = (number, r["key"], given[:upto] + nodes[upto:])
    moved = {number: nodes for number, nodes in moved.items() if nodes}
    if not moved:
        return found.drop("open")
    table = found.sparkSession.createDataFrame(list(moved.items()), "part bigint, given array<bigint>")
    out = found.withColumn("part", part).join(F.broadcast(table), "part", "left")
    upto = F.least(F.size("given").cast("long"), F.col("open")).cast("int")
    mended = F.concat(F.slice("given", F.lit(1), upto), F.slice("nodes", upto + 1, F.size("nodes")))
    return out.withColumn("nodes", F.when(F.col("given").isNull(), F.col("nodes")).otherwise(mended)).drop("part", "given", "open")


def _pairs(words: DataFrame) -> DataFrame:
    """head, tail (nodes), id, n and what is skipped (0 nothing, 1 the first of a run, 2 another one) of each word's pairs."""

    def run(batches):
        for batch in batches:
            heads, tails = batch.column(3), batch.column(4)
            length = heads.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            at = 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(np.cumsum(length[at:] * 2 + 1), NODES_AT_ONCE, side="right")) + at)
                flat, begin = code_points(batch.column(2).slice(at, end - at))
                size = np.diff(begin)
                own = np.repeat(np.arange(len(size)), size + 1)
                place = np.arange(len(own)) - np.repeat(begin[:-1] + np.arange(len(size)), size + 1)
                # the node of the first i code points and of those from i on; the roots are -1
                head, tail = np.full(len(own), -1, np.int64), np.full(len(own), -1, np.int64)
                head[place > 0] = heads.slice(at, end - at).flatten().to_numpy(zero_copy_only=False)
                back = tails.slice(at, end - at).flatten().to_numpy(zero_copy_only=False)
                inner = place < size[own]
                tail[inner] = back[(begin[own] + size[own] - 1 - place)[inner]]
                skips = np.flatnonzero(inner)
                again = np.concatenate([[False], flat[1:] == flat[:-1]]) if len(flat) else np.zeros(0, bool)
                again[begin[:-1][size > 0]] = False
                kind = np.concatenate([np.zeros(len(own), np.int8), np.where(again, 2, 1).astype(np.int8)])
                both = np.concatenate([own, own[skips]]) + at
                columns = [np.concatenate([head, head[skips]]), np.concatenate([tail, tail[skips + 1]])]
                carried = [batch.column(i).to_numpy(zero_copy_only=False)[both] for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in [*columns, *carried, kind]], names=["head", "tail", "id", "n", "kind"])
                at = end

    return words.select("id", "n", "word", "heads", "tails").mapInArrow(texts.lean(run), "head bigint, tail bigint, id bigint, n bigint, kind tinyint")


def near_words(pairs: DataFrame) -> DataFrame:
    """id, n_near, best (n and the negated id of the near word of largest n, ties: smallest id) of words that have one."""
    meet = Window.partitionBy("head", "tail")
    ranked = meet.orderBy((F.col("kind") > 0).asc(), F.col("n").desc(), "id")
    plain, skipping, first = F.col("kind") == 0, F.col("kind") > 0, F.col("kind") == 1
    me = F.struct("n", (-F.col("id")).alias("back"))
    rows = pairs.withColumns({
        "skips": F.count(F.when(skipping, 1)).over(meet),
        "firsts": F.count(F.when(first, 1)).over(meet),
        "whole": F.max(F.when(plain, me)).over(meet),
        "top": F.max(F.when(skipping, me)).over(meet),
        "top_first": F.max(F.when(first, me)).over(meet),
        "next": F.lead(me).over(ranked),
    }).filter((F.col("skips") > 1) | (F.col("whole").isNotNull() & (F.col("firsts") > 0)))
    other = F.when(F.col("top") == me, F.col("next")).otherwise(F.col("top"))
    longer = first & F.col("whole").isNotNull()
    n_near = F.when(plain, F.col("firsts")).otherwise(F.col("skips") - 1 + F.when(longer, 1).otherwise(0))
    best = F.when(plain, F.col("top_first")).otherwise(F.greatest(other, F.when(longer, F.col("whole"))))
    rows = rows.select("id", n_near.alias("n_near"), best.alias("best")).filter("n_near > 0")
    return rows.groupBy("id").agg(F.sum("n_near").alias("n_near"), F.max("best").alias("best"))


def _roots(forms: DataFrame, hops: int) -> DataFrame:
    """id, root: the end of each chain id -> form, by doubling; chains have ``hops`` steps at most."""
    roots = forms.select("id", F.col("form_id").alias("root"))
    for _ in range(max(0, math.ceil(math.log2(max(hops, 1))))):
        step = roots.select(F.col("id").alias("root"), F.col("root").alias("further"))
        roots = stage(roots.join(step, "root", "left").select("id", F.coalesce("further", "root").alias("root")), "spelling-roots")
    return roots


def group(words: DataFrame, times: int = 10, word: str = "word", n: str = "n") -> DataFrame:
    """word, form, root, n, n_near, form_n of every distinct word.

    form: the near word of largest n (ties: smallest in code-point order) if that n is ``times`` the word's or more,
    else null; root: the last form on the way, or the word itself. ``times`` must be 2 or more, so that ways end.
    """
    if times < 2:
        raise ValueError("times must be 2 or more")
    rows = words.select(words[word].cast("string").alias("word"), words[n].cast("long").alias("n"))
    rows = rows.filter("word is not null").groupBy("word").agg(F.sum("n").alias("n"))
    forward = _numbered(stage(rows, "spelling-words"), "word", "spelling-forward")
    forward = forward.select(F.col("key").alias("word"), F.col("row").alias("id"), "n", F.col("nodes").alias("heads"))
    both = _numbered(forward.withColumn("turned", F.reverse("word")), "turned", "spelling-backward")
    both = both.select("word", "id", "n", "heads", F.col("nodes").alias("tails"))
    near = near_words(_pairs(both))
    names = stage(both.select("id", "word", "n"), "spelling-names")
    near = names.select("id", "n").join(near, "id", "left")
    near = stage(near.withColumn("form_id", F.when(F.col("best.n") >= times * F.col("n"), -F.col("best.back"))), "spelling-near")
    forms = near.filter("form_id is not null").select("id", "form_id")
    most = near.agg(F.max("n")).first()[0] or 1
    # every step of a way has ``times`` the n of the one before
    roots = _roots(forms, int(math.log(max(most, 1), times)) + 1)
    form = names.select(F.col("id").alias("form_id"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    root = names.select(F.col("id").alias("root"), F.col("word").alias("root_word"))
    named = forms.join(form, "form_id").join(roots, "id").join(root, "root").select("id", "form", "form_n", "root_word")
    out = names.join(near.select("id", "n_near"), "id").join(named, "id", "left")
    return out.select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n")
