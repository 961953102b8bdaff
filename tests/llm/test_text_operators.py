"""Line dedup, BPE, token files, HTML and the vector search against plain versions on small tables."""

import collections
import hashlib
import math
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tablewise.llm import bpe, html_text, line_dedup, queries, shard_tree, texts, token_files, topk
from tablewise.llm.html_text import render
from tablewise.session import work_folder

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string"
ODD = [
    (1, None), (2, ""), (3, " \t\n "), (4, "one"), (4, "one"), (None, "no id here"), (5, "Été ΣΑΣ İstanbul ﬁ 中文 12½ it's <|endoftext|>x"),
    (6, "word " * 30_000), (7, "a" * 5000), (8, "\x1c\x85 tab space, don't!!"), (9, "😀" * 300),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(TOKENIZER)


# --- words --------------------------------------------------------------------------------------


def test_words_and_shingles_agree_with_split():
    rows = ["a B  c", None, "", " x\ty", "zz", "a b\n c d e", "é Ü", "one"]
    buf, offsets = texts.flat(pa.array(rows))
    words, first = texts.word_hashes(buf, offsets)
    names, seen = {}, {}
    for i, row in enumerate(rows):
        plain = (row or "").encode().lower().split()
        assert first[i + 1] - first[i] == len(plain)
        for word, h in zip(plain, words[first[i] :]):
            assert names.setdefault(word, h) == h
    assert len(set(names.values())) == len(names)
    shingles, begin = texts.shingles(words, first, 3)
    for i, row in enumerate(rows):
        plain = (row or "").encode().lower().split()
        want = [tuple(plain[k : k + 3]) for k in range(len(plain) - 2)] or ([tuple(plain)] if plain else [])
        assert begin[i + 1] - begin[i] == len(want)
        for s, h in zip(want, shingles[begin[i] :]):
            assert seen.setdefault(s, h) == h
    assert len(set(seen.values())) == len(seen)


def test_blocks_cover_rows():
    column = pa.array(["x" * 10] * 25).slice(3, 20)
    spans = [(a, b) for a, b, _, _ in texts.blocks(column, 25)]
    assert spans[0][0] == 0 and spans[-1][1] == 20
    assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


# --- BPE ----------------------------------------------------------------------------------------


def test_bpe_is_the_library(spark, odd, library):
    out = bpe.encode_and_decode(odd.withColumn("ids", F.lit("clash")), TOKENIZER)
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    rows = out.collect()
    assert len(rows) == len(ODD)
    for r in rows:
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == want
        assert r.decoded == library.decode(want, skip_special_tokens=False)
    again = bpe.decode(bpe.encode(odd, TOKENIZER), TOKENIZER).select("decoded").collect()
    assert sorted(r.decoded for r in again) == sorted(r.decoded for r in rows)


def test_bpe_of_nothing(spark):
    assert bpe.encode(spark.createDataFrame([], DOCS), TOKENIZER).collect() == []


def test_word_table_starts_anew(library):
    model = bpe.WordBpe(bpe.read_tokenizer(TOKENIZER))
    table = bpe.WordTable(model.encode_words, limit=4)
    for text in ("the cat sat on mats", "dogs run far away now", "the cat"):
        buf, offsets = texts.flat(pa.array([text]))
        ids, _ = table.encode(buf, offsets)
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_bpe_query(spark, folder, library):
    rows = queries.op10_bpe(spark, folder).collect()
    source = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert len(rows) == len(source)
    for r in rows:
        ids = library.encode(source[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


# --- token files --------------------------------------------------------------------------------


def test_code_is_optimal_and_limited():
    rng = np.random.default_rng(3)
    counts = np.bincount(rng.zipf(1.2, 50_000).clip(0, 900))
    lengths = token_files.code_lengths(counts, 12)
    assert lengths.max() <= 12 and math.isclose(sum(2.0 ** -lengths[lengths > 0]), 1.0)
    fibonacci = np.array([1, 1, 2, 3, 5, 8, 13, 21, 34, 55])
    assert token_files.code_lengths(fibonacci, 5).max() == 5
    free = token_files.code_lengths(fibonacci, 30)
    assert (free * fibonacci).sum() == 363  # the sum of the inner nodes of the Huffman tree
    assert token_files.code_lengths(np.array([0, 7]), 16).tolist() == [0, 1]


def test_pack_and_unpack():
    rng = np.random.default_rng(4)
    ids = rng.zipf(1.3, 5000).clip(0, 2000).astype(np.int64)
    lengths = token_files.code_lengths(np.bincount(ids))
    payload, points = token_files.pack(ids, token_files.canonical_codes(lengths), lengths)
    assert (token_files.unpack(payload, points, len(ids), token_files.decode_table(lengths)) == ids).all()


def _check_files(rows, docs, library):
    at, want = 0, []
    for doc_id, text in docs:
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == want


def test_token_files(spark, odd, library):
    folder = work_folder(spark, "token-files-test")
    token_files.write(odd.withColumn("part", F.lit(1)), folder, TOKENIZER)
    ordered = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    _check_files(token_files.read_checksums(spark, folder).collect(), ordered, library)
    lists = {(r.doc_id, r.start): r.ids for r in token_files.read(spark, folder).collect()}
    assert all(ids[-1] == 2 for ids in lists.values()) and len(lists) == len(ODD)


def test_token_files_know_words_by_their_parts(library, monkeypatch):
    """Words are folded and cut before they are looked up; the ids stay those of the library on whole texts."""
    monkeypatch.setattr(token_files, "_library", {})
    table, fold = token_files._encoder(bpe.read_tokenizer(TOKENIZER))
    assert fold

    def ids_of(found):
        buf, offsets = texts.flat(pa.array(found))
        ids, at = table.encode(token_files._folded(buf), offsets)
        return [ids[a:b].tolist() for a, b in zip(at, at[1:])]

    def wanted(found):
        return [library.encode(t, add_special_tokens=False).ids for t in found]

    few = ["The the THE", "(the) the! the,THE"]
    assert ids_of(few) == wanted(few) and len(table.keys) == 5  # the ( ) ! ,
    parts = ["a", "B", "H", "The", "'s", "'LL", "'", "!", "=", "-", "_", "7", " ", "\n", "\x01", "\xa0", "\u0301", "\u0331", "\u0338", "é", "É", "Σ", "ß", "…", "<", "|", ">", "<|endoftext|>", "<|EndOfText|>", "日", "\U0001f600"]
    draw = np.random.default_rng(3)
    for rare in (False, True):  # in most blocks neither special tokens nor marks stand
        some = parts if rare else [p for p in parts if p not in ("\x01", "|") and "<|" not in p]
        found = ["".join(draw.choice(some, draw.integers(0, 12))) for _ in range(4000)]
        assert ids_of(found) == wanted(found)


def test_token_files_of_nothing(spark):
    folder = work_folder(spark, "token-files-empty")
    token_files.write(spark.createDataFrame([], DOCS), folder, TOKENIZER)
    assert token_files.read_checksums(spark, folder).collect() == []


def test_token_files_query(spark, folder, library):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect())
    rows = queries.op3_token_files(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    _check_files(rows, docs, library)


# --- line dedup ---------------------------------------------------------------------------------


def _key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate({i: i + 32 for i in range(65, 91)})


def _plain_dedup(docs, min_chars, min_docs):
    holders = collections.defaultdict(set)
    for doc_id, text in docs:
        for line in (text or "").split("\n"):
            if len(_key(line)) >= min_chars:
                holders[_key(line)].add(-(2**63) if doc_id is None else doc_id)
    for doc_id, text in docs:
        lines, own = (text or "").split("\n"), -(2**63) if doc_id is None else doc_id
        left = [x for x in lines if not (len(_key(x)) >= min_chars and len(holders[_key(x)]) >= min_docs and max(holders[_key(x)]) != own)]
        yield doc_id, len(lines), len(lines) - len(left), "\n".join(left) if text is not None else None


def test_line_dedup(spark):
    line, short = "This line is in many documents", "short"
    docs = [(i, f"  {line.upper()}\t\n{short}\nown text number {i} of this test") for i in range(1, 6)]
    docs += [(7, f"{line}\n{line}\r\n"), (8, "é" * 20), (9, "É" * 20), (10, "é" * 20), (11, "é" * 20), (12, None), (13, "")]
    docs += [(None, line), (14, line + " twice only here"), (15, line + " twice only here"), (14, line)]
    out = line_dedup.dedup_lines(spark.createDataFrame(docs, DOCS).withColumn("n_lines", F.lit("clash")).repartition(3))
    assert out.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    got = collections.Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in out.collect())
    assert got == collections.Counter(_plain_dedup(docs, 20, 3))


def test_line_dedup_of_nothing(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], DOCS)).collect() == []


def test_line_dedup_query(spark, folder):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    want = {d: (n, k, hashlib.sha256((t or "").encode()).hexdigest()) for d, n, k, t in _plain_dedup(docs, 20, 3)}
    assert {r[0]: tuple(r[1:]) for r in queries.op1_line_dedup(spark, folder).collect()} == want


# --- sharding -----------------------------------------------------------------------------------


def test_sharding_query(spark, folder):
    rows = queries.op2_shard_tree(spark, folder).collect()
    source = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert len(rows) == len(source)
    for r in rows:
        assert (r.size, r.text_crc32, r.law) == (len(source[r.doc_id]) + 16, zlib.crc32(source[r.doc_id]), "key")
        assert r.grown_shard in (r.shard, 40) and 0 <= r.shard < 40
    for shard, n in collections.Counter(r.shard for r in rows).items():
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(n))


def test_sharding_moves_only_where_weights_change(spark):
    keys = spark.range(20_000).withColumnRenamed("id", "doc_id")
    tree = shard_tree.standard_tree(20)
    heavier = [shard_tree.Leaf(x.region, x.rack, x.shard, 3.0 if x.shard == 3 else 1.0) for x in tree]
    c = F.col("doc_id")
    rows = keys.select(shard_tree.shard_of(c, tree).alias("a"), shard_tree.shard_of(c, heavier).alias("b"), shard_tree.shard_of(c, shard_tree.grow(tree)).alias("g")).collect()
    counts = collections.Counter(r.a for r in rows)
    assert min(counts.values()) > 850 and max(counts.values()) < 1150
    assert all(r.a == r.b or r.b < 10 for r in rows)  # only into the region of shard 3
    assert all(r.g in (r.a, 20) for r in rows)
    assert 2400 < sum(r.b == 3 for r in rows) < 3100


def test_sharding_edges(spark):
    rows = [(None, "x"), (None, None), (1, "a"), (1, "a"), (2, "")]
    df = spark.createDataFrame(rows, DOCS).withColumn("shard", F.lit("clash")).withColumn("slot", F.lit(9))
    out = shard_tree.assign(df, shard_tree.standard_tree(3)).collect()
    assert len(out) == 5 and sorted(r.size for r in out) == [16, 16, 17, 17, 17]
    assert len({r.shard for r in out if r.doc_id is None}) == 1
    for shard in {r.shard for r in out}:
        slots = sorted(r.slot for r in out if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert shard_tree.assign(spark.createDataFrame([], DOCS), shard_tree.standard_tree(3)).collect() == []
    zero = [shard_tree.Leaf("a", "a", 0, 0.0), shard_tree.Leaf("b", "b", 1)]
    assert {r[0] for r in spark.range(50).select(shard_tree.shard_of(F.col("id"), zero)).collect()} == {1}


# --- search -------------------------------------------------------------------------------------


def _plain_search(rows, k):
    fine = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v in sorted({(i, tuple(v)) for i, v in fine if i % 100 == 0}):
        scores = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in fine if j != i)[:k]
        out += [(i, n, j, -s) for n, (s, j) in enumerate(scores, 1)]
    return sorted(out)


def test_search_edges(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=40)]) for i in range(300)]
    rows += [(500, None), (600, [1.0, None]), (700, [float("nan")] * 40), (800, [float("inf")] * 40), (None, [1.0] * 40)]
    rows += [(900, []), (901, [0.5] * 12), (1000, [0.25] * 64), (7, [1.0] * 40), (7, [1.0] * 40), (200, rows[200][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).repartition(3)
    got = topk.search(df, F.col("vec_id") % 100 == 0, k=10)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == _plain_search(rows, 10)


def test_search_query_is_its_sql(spark, folder):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    want = sorted(db.execute(queries.SQL["op4_topk"]).fetchall())
    assert sorted(map(tuple, queries.op4_topk(spark, folder).collect())) == want


def test_search_of_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.search(df, F.col("vec_id") % 100 == 0).collect()] == [(0, 1, 1, 1024 * 3072 + 2048 * 1024)]
    assert topk.search(df.limit(0), F.col("vec_id") % 100 == 0).collect() == []


def test_search_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(topk, "CELL", 7)
    assert topk.cells(10, 100, 4) == (4, 15)
    rng = np.random.default_rng(6)
    rows = [(i * 10, [float(x) for x in rng.normal(size=20)]) for i in range(100)]
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0)
    assert sorted(map(tuple, got.collect())) == _plain_search(rows, 10)


# --- HTML ---------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("<p>One <b>two</b>\nthree<p>four", "One two three\n\nfour"),
        ("<ul><li>a<li>b<ol start=3><li>c<li value=9>d</ol><li>e</ul>z", "- a\n- b\n  3. c\n  9. d\n- e\n\nz"),
        ("<table><tr><th>Name<th>Qty<tr><td>apple<td>3<tr><td>fig<td>12</table>", "Name   Qty\napple  3\nfig    12"),
        ("<table><td rowspan=2>r<td>1<tr><td>2<tr><td colspan=2>both of them<td>x</table>", "r  1\n   2\nboth of them  x"),
        ("<table><tr><td>a<table><tr><td>in</table><td>b</table>", "a   b\nin"),
        ("<p hidden>x</p><p style='display: none'>y</p>z<span style='visibility:hidden'>a<i style='visibility:visible'>b</i></span>", "zb"),
        ("<style>.gone, #no{display:none}</style><div class='a gone'>x</div><div id=no>y</div>z", "z"),
        ("<title>T &amp; x</title><script>if (a < b) '</p>'</script>a<!-- b -->c<!doctype x>", "ac"),
        ("<pre>\n x  y\n   z</pre>after", " x  y\n   z\n\nafter"),
        ("<details><summary>s</summary>hid</details><details open><summary>t</summary>seen</details>", "s\nt\nseen"),
        ("a<br>b<br><br>c</p>d", "a\nb\n\nc\n\nd"),
        ("<blockquote>q<p>r</blockquote><dl><dt>t<dd>d<dt>u<dd>e</dl>", "  q\n\n  r\n\nt\n  d\nu\n  e"),
        ("5 < 6 &lt;ok&gt; &copy; &nosuch; <a title=it's href='x>y'>link</a>", "5 < 6 <ok> © &nosuch; link"),
        ("<p>a<table><tr><td>b</table>c</i></div>", "a\n\nb\n\nc"),
        ("text<a href='never closed", "text"),
        ("<select><option>one<option>two</select><textarea>\nkept  so</textarea>", "one\ntwo\nkept  so"),
        ("<h1>a<h2>b</h1>c", "a\n\nb\n\nc"),
    ],
)
def test_render(page, text):
    assert render(page)[1].rstrip() == text


@pytest.mark.parametrize(
    ("sheet", "body", "text"),
    [
        ("@media print { .nav { display:none } }", "<p class=nav>a", "a"),
        ("@media (max-width:600px) { .s { display:none } }", "<p class=s>a", "a"),
        ("@media screen and (min-width:600px) { .s { display:none } } p{color:red}", "<p class=s>a<p>b", "b"),
        ("@media not print { .s { display:none } }", "<p class=s>a<p>b", "b"),
        ("@media (max-width:1500px) { .s { display:none } }", "<p class=s>a", "a"),
        ("@media (min-width:40em) { .md\\:block { display:block } } .hide { display:none }", "<p class='hide md:block'>a<p class=hide>b", ""),
        (".hide { display:none } @media (min-width:40em) { .md\\:block { display:block } }", "<p class='hide md:block'>a<p class=hide>b", "a"),
        ("@supports (display:x) { .s { display:none } } @keyframes k { from { display:none } }", "<p class=s>a<from>b</from>", "ab"),
        (".m { display:none } .m.open { display:block }", "<p class='m open'>a<p class=m>b", "a"),
        (".m.open { display:block } .m { display:none }", "<p class='m open'>a<p class=m>b", "a"),
        (".m { display:none } .m { display:block }", "<p class=m>a", "a"),
        (".m { display:block } .m { display:none }", "<p class=m>a<p>b", "b"),
        (".m { display:none }", "<p class=m style='display:block'>a", "a"),
        (".m { display:none !important }", "<p class=m style='display:block'>a<p>b", "b"),
        ("", "<p style='display:none;display:block'>a<p style='display:none'>b", "a"),
        (".m { display:none } .top .m { display:block }", "<div class=top><p class=m>a</div><p class=m>b", "a"),
        (".m { display:none } .m:hover { display:block }", "<p class=m>a<p>b", "b"),
        (".m { display:none } .m:not(.x) { display:block }", "<p class=m>a", "a"),
        ("[hidden] { display:none !important } .f { display:flex }", "<p class=f hidden>a<p class=f>b", "b"),
        (".f { display:flex }", "<p class=f hidden>a<p hidden>b", "a"),
        (".a { content:'}'; display:none } /* .b { display:none } */", "<p class=a>a<p class=b>b", "b"),
        ("@layer x { #a { display:none } } p { display:block }", "<p id=a>a", "a"),
        (".m { visibility:hidden } .m.on { visibility:visible }", "<p class='m on'>a<p class=m>b", "a"),
        (".m { display:none }", "<p class=m>a<p>b<style>.m { display:block }</style>", "a\n\nb"),
    ],
)
def test_render_style_sheets(sheet, body, text):
    assert render(f"<style>{sheet}</style><body>{body}")[1].rstrip() == text


def test_render_print_sheet_and_sheet_after_the_body():
    assert render("<style media=print>p { display:none }</style><p>a")[1] == "a"
    assert render("<p class=x>a<p>b<style>.x { display:none }</style>")[1] == "b"
    assert render("<style>" + ".a { display:none }" * 20_000 + "</style>" + "<b class=a>x</b>" * 20_000 + "y")[1] == "y"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<body><svg width='1'/> a", "a"),
        ("<svg/>a<p>b", "a\n\nb"),
        ("<math/>a<p>b", "a\n\nb"),
        ("<body>a <svg viewBox='0 0 1 1'><path d='M0'/><g/></svg> b<p>c", "a b\n\nc"),
        ("<svg><g><path d='M0'><div>a</div>b", "a\nb"),
        ("<svg><text>left</text><text>right</text></svg>end", "left right end"),
        ("<svg><text>one<tspan> two</tspan><tspan x=1>three</tspan></text> stray</svg>", "one two three"),
        ("<svg><title>t</title><desc>d</desc><text>x</text></svg>y", "x y"),
        ("<title>page</title><svg><title/><style/><script/></svg>a", "a"),
        ("<svg><foreignObject><p>in</p></foreignObject></svg>out", "in\n\nout"),
        ("<svg><switch><foreignObject>a</foreignObject><text>b</text></switch></svg>", "a"),
        ("<svg><text display=none>a</text><text style='display:none'>b</text><text>c</text></svg>", "c"),
        ("<svg><style>.k { display:none }</style><text class=k>a</text></svg><p class=k>b<p>c", "c"),
        ("<svg><style><![CDATA[ .k > b { } .k { display:none } ]]></style></svg><p class=k>b<p>c", "c"),
        ("<svg><symbol><text>a</text></symbol></svg>b", "b"),
        ("<svg><symbol id=s><text>a</text></symbol><use href='#s'/></svg>b", "a b"),
        ("<svg><td>x</td><li>y<table><tr><td>z</table>", "- y\n  z"),
        ("So <math><mi>x</mi> <mo>=</mo> <mfrac><mn>1</mn><mn>2</mn></mfrac></math>, then", "So x = 1 2, then"),
        ("<math><semantics><mi>x</mi><annotation>TeX</annotation></semantics></math> y", "x y"),
        ("<math><mtext>if <b>all</b></mtext><mspace/><mi>x</mi></math>", "if all x"),
        ("a<math display=block><mi>x</mi></math>b", "a\nx\nb"),
        ("<math><mphantom><mi>p</mi></mphantom><mi>q</mi></math>", "q"),
        ("<p>a<math><mi>x</p>b", "ax\n\nb"),
        ("<div/>a<svg class=x />b", "ab"),
    ],
)
def test_render_svg_and_math(page, text):
    assert render(page)[1].strip() == text


def test_render_svg_title_is_not_the_title():
    assert render("<svg><title>t</title></svg><p>a")[0] is None
    assert render("<svg>" * 50_000 + "<p>x" + "</g>" * 50_000)[1] == "x"


def test_render_deep_and_long():
    assert render("<div>" * 50_000 + "x")[1] == "x"
    assert render("<b>" * 20_000 + "<p>" * 20_000 + "y")[1] == "y"
    assert len(render("word " * 200_000)[1]) == 999_999
    wide = render("<table><tr><td>" + "x" * 5000 + "<td>a<tr><td>b<td>c</table>")[1].split("\n")
    assert wide == ["x" * 5000 + "  a", "b  c"]


def test_extract_keeps_every_visible_word(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    out = {r.page_id: r for r in html_text.extract(pages).collect()}
    assert len(out) == pages.count()
    import html
    import re

    for r in pages.collect():
        body = re.sub(r"<!--.*?-->|<(script|style|title).*?</\1>", "", r.html or "", flags=re.S)
        words = html.unescape(re.sub(r"<[^>]*>", " ", body)).replace("\xa0", " ").split()
        found = [w for w in out[r.page_id].text.split() if w != "-"]
        assert "".join(found) == "".join(w for w in words if w != "-")


def test_extract_edges(spark):
    df = spark.createDataFrame([(1, None, "t"), (2, "", "t"), (2, "", "t"), (3, "<title>x</title>y", "t")], "page_id long, html string, text string")
    out = html_text.extract(df)
    assert out.columns == ["page_id", "title", "text"]
    assert sorted(map(tuple, out.collect())) == [(1, None, None), (2, None, ""), (2, None, ""), (3, "x", "y")]
    assert html_text.extract(df.limit(0)).collect() == []
