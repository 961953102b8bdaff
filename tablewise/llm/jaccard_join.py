"""N-gram Jaccard join by token-combination prefixes, and the components of its links.

A document's set holds its distinct word shingles; two documents link when
``100 * intersection >= percent * union``. Equal sets are one class, so copies are never paired.

1. Probe. A set may lose at most ``tau = n - ceil(percent * n / 100)`` tokens to a partner. Of its tokens
   below a fixed hash all but ``tau`` must therefore occur in another class. Only those tokens are counted;
   classes that fail have no partner. Most documents end here.
2. Order. The tokens of the classes left are counted and put in order, rarest first. A token of one class alone is known to be
   lost, and a class that loses more than ``tau`` ends here.
3. Signatures. Rare tokens (``RARE`` classes at most) of the prefix are signatures by themselves. Frequent
   tokens are dealt into parts, and pairs of one part are signatures. A part with m prefix tokens has lost all
   its pairs only after m - 1 tokens are lost, so the prefix is extended until rare tokens and parts together outlast
   ``tau`` losses: a signature is then left that any partner has too. The number of parts grows with the
   set (both partners use the parts of the smaller one's size), so signatures stay in proportion to it.
4. Verify. In each signature's list every class is compared with one centre first, the class that lost the
   fewest tokens, and links are joined to components. Then only pairs of different components are compared.
   A large group of near copies is linked through its centre and is not expanded into pairs. Pairs whose
   bit maps (the parity of ``MAP_BITS`` token groups) differ in more places than two linked sets can are left out
   before sets are fetched.

Sets of the classes left are found again from the texts through a Bloom filter of bounded size. Everything
else is joined, with partial sums before each shuffle; skewed joins are between written tables, so that
Spark can split them.

Documents without a word have no shingle and are linked with nothing. Null doc_ids are ignored when the
smallest id of a component is taken. Rows with the same id are documents each. Other columns do not matter.
Sets and classes are compared by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewise.llm import bloom, texts
from tablewise.llm.common import stage

PROBE_SHARE = 0.3  # of the range of token hashes
RARE = 32
TOKENS_PER_PART = 64
CENTRE_ROUNDS = 2
MAP_BITS = 1024


def _least(n, percent: int):
    """Tokens that a set of n shares with any partner, at least."""
    return (percent * n + 99) // 100


def _can_differ(n, percent: int):
    """Whether a set of n can link with a different set at all."""
    return (n - _least(n, percent) >= 1) | (100 * n >= percent * (n + 1))


def _sets(batch_column: pa.Array, width: int):
    """For every block of texts: row, and for each text its sorted distinct shingles."""
    for row, end, buf, offsets in texts.blocks(batch_column):
        shingles, begin = texts.shingles(*texts.word_hashes(buf, offsets), width)
        yield row, [np.unique(shingles[a:b]) for a, b in zip(begin[:-1], begin[1:])]


def _class(tokens: np.ndarray) -> int | None:
    """A signed 64-bit name of a set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())).view(np.int64)) if len(tokens) else None


def _lists(arrays: list[np.ndarray], null: list[bool] | None = None) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    values = pa.array(np.concatenate([np.zeros(0, np.uint64), *arrays]).view(np.int64))
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=pa.array(null, pa.bool_()) if null else None)


def _probed(rows: DataFrame, width: int) -> DataFrame:
    """doc_id, n, class of every document; probes: low tokens where the task met the class first, else null."""
    limit = np.uint64(int(PROBE_SHARE * 2**64))

    def run(batches):
        met: set[int] = set()
        for batch in batches:
            for row, sets in _sets(batch.column(1), width):
                names, probes, known = [_class(s) for s in sets], [], []
                for name, tokens in zip(names, sets):
                    known.append(name is None or name in met)
                    probes.append(tokens[: 0 if known[-1] else np.searchsorted(tokens, limit)])
                    met.add(name)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, len(sets)), pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(names, pa.int64()), _lists(probes, known),
                    ],
                    names=["doc_id", "n", "class", "probes"],
                )

    return rows.mapInArrow(texts.lean(run), "doc_id bigint, n bigint, class bigint, probes array<bigint>")


def _candidates(docs: DataFrame, percent: int) -> DataFrame:
    """Classes that enough of their probes leave a chance."""
    probes = docs.select("class", F.explode("probes").alias("token"))
    repeated = probes.groupBy("token").agg(F.min("class").alias("low"), F.max("class").alias("high"))
    repeated = stage(bloom.packed_column(repeated.filter("low <> high"), "token"), "jaccard-probes")
    seen = docs.sparkSession.sparkContext.broadcast(bloom.build(repeated, twice=False))

    def run(batches):
        for batch in batches:
            n, lists = batch.column(1).to_numpy(), batch.column(2)
            size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            hit = seen.value.holds(lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64))
            upto = np.concatenate([[0], np.cumsum(hit)])
            ends = np.cumsum(size)
            found = upto[ends] - upto[ends - size]
            ok = (found >= size - (n - _least(n, percent))) & _can_differ(n, percent)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok))], names=["class"])

    return docs.filter("probes is not null").select("class", "n", "probes").mapInArrow(texts.lean(run), "class bigint").distinct()


def _bit_map(tokens: np.ndarray) -> np.ndarray:
    """Whether the number of tokens in each of ``MAP_BITS`` groups is odd."""
    groups = np.bincount((tokens % np.uint64(MAP_BITS)).astype(np.int64), minlength=MAP_BITS)
    return np.packbits((groups & 1).astype(bool)).view(np.uint64)


def _survivors(rows: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """class, n, tokens and bit map of the classes left."""
    filter_rows = stage(bloom.packed_column(classes, "class"), "jaccard-filter")
    seen = rows.sparkSession.sparkContext.broadcast(bloom.build(filter_rows, twice=False))

    def run(batches):
        met: set[int] = set()
        for batch in batches:
            for _, sets in _sets(batch.column(0), width):
                names = [_class(s) for s in sets]
                known = np.array([x is not None for x in names], bool)
                hashes = np.array([x or 0 for x in names], np.int64).view(np.uint64)
                keep = []
                for i in np.flatnonzero(known & seen.value.holds(hashes)).tolist():
                    if names[i] not in met:
                        met.add(names[i])
                        keep.append(i)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([names[i] for i in keep], pa.int64()), pa.array([len(sets[i]) for i in keep], pa.int64()),
                        _lists([sets[i] for i in keep]), _lists([_bit_map(sets[i]) for i in keep]),
                    ],
                    names=["class", "n", "tokens", "bits"],
                )

    found = rows.select("text").mapInArrow(texts.lean(run), "class bigint, n bigint, tokens array<bigint>, bits array<bigint>")
    return found.join(classes, "class", "left_semi").dropDuplicates(["class"])


def signatures(tokens: np.ndarray, counts: np.ndarray, n: int, percent: int) -> list[np.ndarray]:
    """Signatures of a set, for its own level of size and the one its smallest partner may have.

    tokens, counts: the tokens that other classes have too, and in how many classes each is.
    """
    order = np.lexsort((tokens, counts))
    tokens, counts = tokens[order], counts[order]
    need = n - _least(n, percent) + 1 - (n - len(tokens))
    out = []
    for level in sorted({n.bit_length() - 1, _least(n, percent).bit_length() - 1}):
        salt = texts.mix(np.array([level], np.uint64))[0]
        rare = tokens[counts <= RARE][:need]
        out.append(texts.mix(rare ^ salt))
        rest = need - len(rare)
        if rest > 0:
            frequent = tokens[counts > RARE]
            part = frequent % np.uint64(max(1, (1 << level) // TOKENS_PER_PART))
            opens = np.zeros(len(frequent), bool)
            opens[np.unique(part, return_index=True)[1]] = True
            end = int(np.searchsorted(np.cumsum(~opens), rest)) + 1
            frequent, part = frequent[:end], part[:end]
            by = np.argsort(part, kind="stable")
            frequent, cuts = frequent[by], np.flatnonzero(np.diff(part[by])) + 1
            for group in np.split(frequent, cuts):
                a, b = np.triu_indices(len(group), 1)
                low, high = np.minimum(group[a], group[b]), np.maximum(group[a], group[b])
                out.append(texts.mix(texts.mix(low ^ salt) + high))
    return out


def _signed(sets: DataFrame, percent: int) -> DataFrame:
    """sig, class, n, shared (tokens that other classes have) of every signature."""
    tokens = sets.select("class", "n", F.explode("tokens").alias("token"))
    counts = stage(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("count")).filter("count > 1"), "jaccard-counts")
    known = tokens.join(counts, "token").groupBy("class", "n").agg(F.collect_list(F.struct("token", "count")).alias("known"))
    known = known.filter(F.size("known") >= _least_column(F.col("n"), percent))
    known = known.select("class", "n", F.col("known.token").alias("tokens"), F.col("known.count").alias("counts"))

    def run(batches):
        for batch in batches:
            sigs, owner = [], []
            n = batch.column(1).to_numpy()
            shared = batch.column(2).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            for i in range(batch.num_rows):
                values = np.array(batch.column(2)[i].values, np.int64).view(np.uint64)
                own = np.concatenate(signatures(values, np.array(batch.column(3)[i].values, np.int64), int(n[i]), percent))
                sigs.append(own)
                owner.append(np.full(len(own), i))
            at = np.concatenate([np.zeros(0, np.int64), *owner])
            columns = [np.concatenate([np.zeros(0, np.uint64), *sigs]).view(np.int64), batch.column(0).to_numpy()[at], n[at], shared[at]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["sig", "class", "n", "shared"])

    return known.mapInArrow(texts.lean(run), "sig bigint, class bigint, n bigint, shared bigint")


def _least_column(n: Column, percent: int) -> Column:
    return F.floor((n * percent + 99) / 100)


def _may_link(percent: int) -> Column:
    """Sizes and known losses of a and b leave room for a link."""
    most = F.least("a_shared", "b_shared")
    return (100 + percent) * most >= percent * (F.col("a_n") + F.col("b_n"))


def _maps_near(percent: int) -> Column:
    """Every place where the bit maps differ is a token of one set alone."""
    differ = sum(F.bit_count(F.col("a_bits")[i].bitwiseXOR(F.col("b_bits")[i])) for i in range(MAP_BITS // 64))
    both = F.col("a_n") + F.col("b_n")
    return (100 + percent) * (both - differ) >= 2 * percent * both


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link, by their whole sets."""
    a = sets.select(F.col("class").alias("a"), F.col("tokens").alias("a_tokens"))
    b = sets.select(F.col("class").alias("b"), F.col("tokens").alias("b_tokens"))
    both = pairs.select("a", "b").join(a, "a").join(b, "b")
    overlap = F.size(F.array_intersect("a_tokens", "b_tokens"))
    return both.filter((100 + percent) * overlap >= percent * (F.size("a_tokens") + F.size("b_tokens"))).select("a", "b")


def _joined(labels: DataFrame | None, edges: DataFrame) -> DataFrame:
    """node, root after joining the edges into the components so far; edges shrink with every round."""
    if labels is not None:
        edges = _through(_through(edges, labels, "a"), labels, "b")
    edges = stage(edges.filter("a <> b").distinct(), "jaccard-edges")
    while not edges.isEmpty():
        ends = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).unionAll(edges.select("b", "a"))
        roots = ends.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("root"))
        roots = stage(roots, "jaccard-roots")
        roots = stage(_through(roots, roots, "root"), "jaccard-roots")
        if labels is None:
            labels = roots
        else:
            moved = _through(labels, roots, "root")
            labels = stage(moved.unionAll(roots.join(labels, "node", "left_anti")), "jaccard-labels")
        edges = stage(_through(_through(edges, roots, "a"), roots, "b").filter("a <> b").distinct(), "jaccard-edges")
    return labels


def _through(df: DataFrame, roots: DataFrame, column: str) -> DataFrame:
    """``df`` with a column of nodes replaced by their roots."""
    step = roots.select(F.col("node").alias("__node"), F.col("root").alias("__root"))
    moved = df.join(step, df[column] == F.col("__node"), "left")
    return moved.select(*[F.coalesce("__root", df[c]).alias(c) if c == column else df[c] for c in df.columns])


def _components(signed: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """class, root for every class with a link (nothing where there is no link)."""
    labels = None
    for round_ in range(CENTRE_ROUNDS + 1):
        rows = signed.withColumn("root", F.col("class"))
        if labels is not None:
            rows = _through(rows, labels, "root")
        rows = stage(rows, "jaccard-rows")
        losses = F.col("n") - F.col("shared") if round_ == 0 else F.lit(0).cast("long")
        member = F.struct(losses.alias("losses"), F.xxhash64("class", F.lit(round_)).alias("order"), "class", "n", "shared", "root")
        lists = rows.groupBy("sig").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min(member).alias("centre"))
        lists = stage(lists.filter("low <> high").select("sig", "centre"), "jaccard-lists")
        a = rows.select("sig", F.col("class").alias("a"), F.col("n").alias("a_n"), F.col("shared").alias("a_shared"), F.col("root").alias("a_root"))
        a = a.join(lists, "sig")
        if round_ < CENTRE_ROUNDS:
            pairs = a.select("*", *[F.col(f"centre.{c}").alias(f"b_{c}") for c in ("n", "shared", "root")], F.col("centre.class").alias("b"))
        else:
            maps = sets.select(F.col("class").alias("a"), F.col("bits").alias("a_bits"))
            a = stage(a.drop("centre").join(maps, "a"), "jaccard-open")
            b = a.select("sig", *[F.col(c).alias("b" + c[1:]) for c in a.columns if c != "sig"])
            pairs = a.join(b, "sig").filter("a_root < b_root").filter(_maps_near(percent))
        pairs = pairs.filter("a_root <> b_root").filter(_may_link(percent)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        edges = stage(_linked(stage(pairs.distinct(), "jaccard-pairs"), sets, percent), "jaccard-links")
        labels = _joined(labels, edges)
    return labels


def link(df: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach) of every document."""
    if not 80 <= percent <= 100:
        raise ValueError("percent must lie between 80 and 100")
    rows = df.select(df[doc_id].cast("long").alias("doc_id"), df[text].cast("string").alias("text"))
    docs = stage(_probed(rows, width), "jaccard-docs")
    classes = stage(_candidates(docs, percent), "jaccard-classes")
    sets = stage(_survivors(rows, classes, width), "jaccard-sets")
    labels = _components(stage(_signed(sets, percent), "jaccard-signatures"), sets, percent)

    narrow = docs.select("doc_id", "n", "class")
    first = narrow.filter("class is not null").groupBy("class").agg(F.min("doc_id").alias("first")).withColumn("root", F.col("class"))
    if labels is not None:
        first = _through(first, labels, "root")
    first = stage(first, "jaccard-first")
    smallest = first.groupBy("root").agg(F.min("first").alias("component_id"))
    found = stage(first.join(smallest, "root").select("class", "component_id"), "jaccard-components")
    out = narrow.join(found, "class", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
