"""Cross-tokenizer alignment, embedding near-dedup and spelling variants against plain versions on small tables."""

import collections
import random

import numpy as np
import pytest

from tablewise.llm import embedding_dedup, queries, spelling, token_align

public_tokenizers = pytest.importorskip("public_tokenizers")
RANKS, JSON, MODEL = (public_tokenizers.path(n) for n in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"))


# --- cross-tokenizer alignment ------------------------------------------------------------------


@pytest.fixture(scope="module")
def libraries():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(JSON)
    whole.encode_special_tokens = True
    return whole, token_align.Tokenizers(RANKS, JSON, MODEL, public_tokenizers.PATTERN)


def _spans(ids, table):
    flat, starts, sizes = table
    out, data = [], b""
    for i in ids:
        piece = bytes(flat[starts[i] : starts[i] + sizes[i]])
        out.append((i, len(data), len(data) + len(piece)))
        data += piece
    return out, data


def _plain_alignment(rows, libraries):
    """Every row's counts by comparing all byte ranges."""
    whole, both = libraries
    found, counts = [], collections.Counter()
    for text in rows:
        want = (" " + (text or "")).encode()
        a, a_bytes = _spans(whole.encode(" " + text, add_special_tokens=False).ids if text else [], both.a_table)
        b, b_bytes = _spans(both.b.encode(text) if text else [], both.b_table)
        if not text or a_bytes != want or b_bytes != want:
            found.append(None)
            continue
        cuts, low, groups = sorted({x[2] for x in a} & {x[2] for x in b}), 0, []
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for i, s, _ in side if low <= s < cut) for side in (a, b)))
            low = cut
        links = [(i, j) for i, s, e in a for j, t, f in b if s < f and t < e]
        found.append((len(a), len(b), len(cuts), links, ";".join(groups)))
        counts.update(set(links))
    top = collections.defaultdict(int)
    for (i, _), n in counts.items():
        top[i] = max(top[i], n)
    return [
        (0, 0, 0, 0, "", 0, 0) if x is None else
        (x[0], x[1], x[2], len(x[3]), x[4], sum(counts[p] == top[p[0]] for p in x[3]), sum(counts[p] for p in x[3])) for x in found
    ]


ODD = [
    "a", "b", " ", "  ", "\n", "é", "ß", "漢", " ", "　", "▁", "<s>", "<|endoftext|>", "<0x0A>", "'s", "1", "23", ".", "!",
    "\t", "\U0001d518", "́", "\x00", "hello", "World", "ﬁ", "×", " a", "x ",
]


def _aligned(spark, rows, heavy):
    df = spark.createDataFrame([(i, t, f"extra{i}") for i, t in enumerate(rows)], "doc_id long, text string, n_links string")
    out = token_align.align(df, RANKS, JSON, MODEL, public_tokenizers.PATTERN)
    out = token_align.stage(out, "test-align")
    sums = token_align.counted(out, *token_align.sizes(RANKS, MODEL), row="doc_id", heavy=heavy)
    rows = out.join(sums, "doc_id").orderBy("doc_id").collect()
    return [(r.n_a, r.n_b, r.n_groups, r.n_links, r.groups, r.n_best, r.count_sum) for r in rows]


@pytest.mark.parametrize("heavy", [1 << 20, 16, 0])
def test_alignment_equals_all_pairs(spark, libraries, heavy):
    rng = random.Random(heavy)
    rows = ["".join(rng.choice(ODD) for _ in range(rng.randrange(0, 20))) for _ in range(150)]
    rows += [None, "", " ", "the same", "the same", "Words of one text, and others."]
    assert _aligned(spark, rows, heavy) == _plain_alignment(rows, libraries)


def test_alignment_of_very_long_texts(spark, libraries):
    whole, both = libraries
    rows = [" " * 1_200_000 + "x", "ab" * 100_000, "word and word " * 80_000]
    got = _aligned(spark, rows, 1 << 20)
    for text, (n_a, n_b, n_groups, n_links, groups, *_) in zip(rows, got):
        a, b = whole.encode(" " + text, add_special_tokens=False).ids, both.b.encode(text)
        assert (n_a, n_b, n_links) == (len(a), len(b), n_a + n_b - n_groups)
        sides = [g.split("|") for g in groups.split(";")]
        assert [int(i) for s in sides for i in s[0].split(",")] == a
        assert [int(i) for s in sides for i in s[1].split(",")] == b


def test_cuts_by_halves_are_the_common_ends():
    rng = np.random.default_rng(1)
    for share in (0.02, 0.3, 0.9):
        ends = np.flatnonzero(rng.random(30_000) < share) + 1
        b_ends = np.unique(np.append(ends[rng.random(len(ends)) < share], [30_000]))
        a_ends = np.unique(np.append(np.flatnonzero(rng.random(30_000) < 0.5) + 1, [30_000]))
        first = np.array([0, len(a_ends)])
        assert np.array_equal(a_ends[token_align.shared_cuts(a_ends, b_ends, first)], np.intersect1d(a_ends, b_ends))


def test_alignment_of_nothing(spark):
    assert _aligned(spark, [], 4) == []


def test_alignment_query(spark, folder, libraries):
    got = {r.doc_id: r for r in queries.QUERIES["op11_token_align"](spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for doc_id, text in docs[:5]:
        r = got[doc_id]
        assert r.n_links == r.n_a + r.n_b - r.n_groups and (len(r.groups_sha256) == 64) == bool(text)


# --- embedding near-dedup -----------------------------------------------------------------------


def _plain_components(x, threshold=0.9):
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = (n @ n.T) >= threshold
    np.fill_diagonal(linked, False)
    root = np.arange(len(x))
    while True:
        low = np.array([min(root[i], root[linked[i]].min(initial=len(x))) for i in range(len(x))])
        if np.array_equal(low, root):
            return linked.sum(1), root
        root = low


def _near(rng, centre, n, noise):
    return centre + rng.standard_normal((n, len(centre))) * noise


@pytest.mark.parametrize("tile", [1024, 48])
def test_embeddings_equal_brute_force(spark, tile, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "TILE", tile)
    rng = np.random.default_rng(tile)
    parts = [rng.standard_normal((300, 24)), _near(rng, rng.standard_normal(24), 260, 0.3), _near(rng, rng.standard_normal(24), 200, 0.05)]
    circle = np.zeros((150, 24))
    angles = np.linspace(0, 6.2, 150)
    circle[:, 0], circle[:, 1] = np.cos(angles), np.sin(angles)
    x = np.concatenate([*parts, circle, np.repeat(parts[0][:2], 40, 0)])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(3)
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df, window=32, passes=24).collect()}
    links, root = _plain_components(x)
    assert [got[i].n_links for i in range(len(x))] == links.tolist()
    assert [got[i].component_id for i in range(len(x))] == root.tolist()
    assert all(got[i].kept == (root[i] == i) for i in range(len(x)))


def test_embeddings_recall_at_the_threshold(spark):
    rng = np.random.default_rng(5)
    a = rng.standard_normal((500, 32))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.standard_normal((500, 32))
    side -= (side * a).sum(1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    b = 0.9001 * a + np.sqrt(1 - 0.9001**2) * side
    c = 0.8999 * a - np.sqrt(1 - 0.8999**2) * side
    rows = [(i, v) for i, v in enumerate(np.concatenate([a, b, c]).tolist())]
    out = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), window=32)
    links = {r.vec_id: r.n_links for r in out.collect()}
    assert sum(links[i] for i in range(500, 1000)) >= 0.9 * 500
    assert sum(links[i] for i in range(1000, 1500)) == 0


def test_embeddings_odd_rows(spark):
    rows = [
        (1, [1.0, 0.0], "a"), (1, [1.0, 0.0], "b"), (None, [2.0, 0.1], "c"), (None, [0.0, -1.0], "d"), (5, None, "e"), (6, [], "f"),
        (7, [0.0, 0.0], "g"), (8, [1.0, None], "h"), (9, [1.0, float("nan")], "i"), (10, [1.0, 0.0, 0.0], "j"), (11, [1e300, 1e298], "k"),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, KEPT string")
    got = sorted(embedding_dedup.near_duplicates(df).select("vec_id", "n_links", "component_id", "kept").collect(), key=str)
    want = [(1, 3, 1, True), (1, 3, 1, True), (None, 3, 1, False), (None, 0, None, True), (11, 3, 1, False)]
    want += [(i, 0, i, True) for i in (5, 6, 7, 8, 9, 10)]
    assert [tuple(r) for r in got] == [tuple(r) for r in sorted([spark.createDataFrame([w], "vec_id long, n_links long, component_id long, kept boolean").first() for w in want], key=str)]
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_passes_follow_the_number_of_vectors():
    counts = [embedding_dedup.passes_needed(10**k, 0.9, 128, 0.95) for k in range(1, 10)]
    assert counts == sorted(counts) and counts[0] == 1 and counts[-1] > 20


# --- spelling variants --------------------------------------------------------------------------


def _plain_variants(words, times=10):
    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    found = {}
    for w, n in words.items():
        others = [x for x in words if near(w, x)]
        form = min(others, key=lambda x: (-words[x], x)) if others else None
        found[w] = (form if form is not None and words[form] >= times * n else None, len(others))

    def root(w):
        return w if found[w][0] is None else root(found[w][0])

    return {(w, f, root(w), words[w], k, words[f] if f is not None else None) for w, (f, k) in found.items()}


@pytest.mark.parametrize("letters, parts", [("ab", 1), ("ab", 5), ("abcé漢\U0001d518", 3)])
def test_variants_equal_all_pairs(spark, letters, parts):
    rng = random.Random(parts)
    words = {"".join(rng.choice(letters) for _ in range(rng.randrange(9))): rng.choice([1, 2, 10, 30, 200, 5000]) for _ in range(400)}
    words |= {"x" * n: 10 ** (n % 7) for n in range(90, 110)}
    df = spark.createDataFrame([(w, n, w) for w, n in words.items()], "word string, n long, form string").repartition(parts)
    assert {tuple(r) for r in spelling.group(df).collect()} == _plain_variants(words)


def test_variants_of_repeated_null_and_long_words(spark):
    rows = [("alphabet", 3), ("alphabet", 97), ("alphabe", 1), (None, 5), ("y" * 30_000, 40), ("y" * 29_999, 4), ("", 1), ("z", 10)]
    got = {tuple(r) for r in spelling.group(spark.createDataFrame(rows, "word string, n long")).collect()}
    long = "y" * 30_000
    assert got == {
        ("alphabet", None, "alphabet", 100, 1, None), ("alphabe", "alphabet", "alphabet", 1, 1, 100),
        (long, None, long, 40, 1, None), (long[1:], long, long, 4, 1, 40), ("", "z", "z", 1, 1, 10), ("z", None, "z", 10, 1, None),
    }
    assert spelling.group(spark.createDataFrame([], "word string, n long")).count() == 0


def test_words_are_maximal_runs_and_lose_a_planted_point(spark):
    import zlib

    docs = [(1, "Zebrafish zebrafish ZEBRAFISH1zebrafis"), (2, "ÉCOLIER école été écolier_écolier"), (None, "zebrafish"), (3, None), (4, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {tuple(r) for r in spelling.words_of(df, every=None).collect()}
    assert got == {("zebrafish", 4), ("écolier", 2)}
    counts = collections.Counter()
    for doc_id, text in docs:
        for run in ([w for w in (text or "").replace("1", " ").replace("_", " ").split()]):
            low = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
            if h % 2 == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            if len(low) >= 7:
                counts[low] += 1
    assert {tuple(r) for r in spelling.words_of(df, every=2, occurrences=1).collect()} == set(counts.items())
