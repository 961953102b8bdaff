"""Jaccard join, classifiers, decontamination and the pipeline against plain versions on small tables."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tablewise.llm import decontaminate, features, jaccard_join, quality, queries, toxicity

DOCS = "doc_id long, text string"


def _words(n, seed, vocabulary=5000):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


# --- Jaccard join -------------------------------------------------------------------------------


def _shingles(text, width):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())


def _plain_components(docs, width, percent):
    sets = [_shingles(t, width) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    holders = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    shared = collections.Counter((a, b) for rows in holders.values() for n, a in enumerate(rows) for b in rows[n + 1 :])
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            parent[find(a)] = find(b)
    smallest = {}
    for i, (doc_id, _) in enumerate(docs):
        if doc_id is not None:
            smallest[find(i)] = min(smallest.get(find(i), doc_id), doc_id)
    return collections.Counter((d, len(sets[i]), smallest.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(docs))


def _near_copies(base, n, edits, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randrange(edits + 1)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80)])
def test_components(spark, width, percent, monkeypatch):
    monkeypatch.setattr(jaccard_join, "RARE", 4)
    texts = [" ".join(_words(n, n)) for n in (1, 2, 3, 5, 8, 13, 40, 90, 200, 700)]
    texts += _near_copies(_words(120, 1), 60, 6, 2) + _near_copies(_words(300, 3), 40, 14, 4) + _near_copies(_words(9, 5), 25, 1, 6)
    passage = " ".join(_words(60, 7))
    texts += [f"{' '.join(_words(20, 100 + i))} {passage} {' '.join(_words(30, 200 + i))}" for i in range(30)]
    texts += [" ".join(_words(50, 8)[: 50 - k]) for k in range(12)]  # a chain by length
    texts += [" ".join(_words(n, 9)) for n in range(4, 11)] * 2
    texts += ["same text in many documents, again and again"] * 40 + [None, "", "  \n", "One", "one", "ONE "]
    random.Random(10).shuffle(texts)
    docs = list(enumerate(texts)) + [(None, texts[0]), (3, texts[5]), (None, "quite alone without any id")]
    df = spark.createDataFrame(docs, DOCS).withColumns({"class": F.lit("clash"), "n": F.lit(1)}).repartition(5)
    got = collections.Counter(map(tuple, jaccard_join.link(df, width, percent).collect()))
    assert got == _plain_components(docs, width, percent)


def test_signatures_meet_for_every_linked_pair():
    rng = np.random.default_rng(1)
    for n in (6, 7, 20, 63, 64, 130, 500):
        for _ in range(20):
            tokens = rng.choice(10**6, n + n // 5 + 2, replace=False).astype(np.uint64)
            counts = dict(zip(tokens.tolist(), rng.choice([2, 20, 40, 500], len(tokens)).tolist()))
            lost = rng.integers(0, n - (85 * n + 99) // 100 + 1)
            a, b = tokens[:n], tokens[lost:n]
            if 100 * len(b) < 85 * n:
                continue
            sigs = [set(np.concatenate(jaccard_join.signatures(s, np.array([counts[int(t)] for t in s]), len(s), 85)).tolist()) for s in (a, b)]
            assert sigs[0] & sigs[1]


def test_jaccard_of_nothing(spark):
    assert jaccard_join.link(spark.createDataFrame([], DOCS)).collect() == []
    with pytest.raises(ValueError):
        jaccard_join.link(spark.createDataFrame([], DOCS), percent=70)


def test_jaccard_query(spark, folder):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert collections.Counter(map(tuple, queries.op6_jaccard_join(spark, folder).collect())) == _plain_components(docs, 4, 85)


# --- classifiers --------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def marked(spark):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(1500):
        words = _words(rng.randrange(30, 200), i, 400)
        toxic, poor = i % 8 == 0, i % 5 == 1
        for _ in range(1 + len(words) // 40 if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(["Nasty", "vile,", "brutish", "vilest"])
        rows.append((i, " ".join(f"{w}%%%" if poor else w for w in words)))
        if i % 2 == 0 or toxic:
            labels.append((i, int(not poor), int(toxic)))
    rows += [(5000, None), (5001, ""), (None, "no id"), (5002, "w1 " * 50_000), (8, rows[8][1]), (5003, "\x85 ½")]
    labels += [(5000, 1, None), (None, 1, 1), (1, None, None), (2, 7, 0), (8, 1, 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"score": F.lit("clash"), "label": F.lit(3)})
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_learns_from_positives(marked):
    docs, labels = marked
    model = toxicity.fit(docs, labels)
    out = toxicity.score(docs, model)
    assert out.columns == ["doc_id", "text", "label", "score"]
    rows = out.collect()
    assert len(rows) == 1506 and all(0 <= r.score <= 1 for r in rows)
    fresh = [r for r in rows if r.doc_id is not None and r.doc_id < 1500]
    caught = [r.score >= 0.5 for r in fresh if r.doc_id % 8 == 0]
    wrong = [r.score >= 0.5 for r in fresh if r.doc_id % 8]
    assert np.mean(caught) > 0.95 and np.mean(wrong) < 0.02


def _cells(rows):
    cells = toxicity.Cells()
    for buckets in rows:
        cells.add(np.array(buckets, np.int32), len(buckets))
    return cells


def test_risk_estimator_turns_round():
    positive = np.arange(90) < 30
    used, weights, bias = toxicity.nn_pu(_cells([[0]] * 30 + [[1]] * 60), positive, 0.3, 1)
    assert used.tolist() == [0, 1] and weights[0] + bias > 0 and np.isfinite(weights).all()


def test_cells_are_counts_by_row():
    rng, positive = np.random.default_rng(3), np.arange(60) < 20
    rows = [np.append(rng.integers(2, 40, rng.integers(1, 30)), [i < 20] * 3).tolist() for i in range(60)]
    cells = _cells(rows)
    used = cells.contrasting(positive)
    assert {0, 1} <= set(used.tolist())
    for i, row in enumerate(rows):
        own = slice(cells.begin[i], cells.begin[i + 1])
        got = dict(zip(used[cells.place[own]].tolist(), cells.n[own].tolist()))
        assert got == {b: row.count(b) for b in set(row) if b in used} and cells.scale[i] == len(row) ** toxicity.POWER


@pytest.mark.parametrize("bias", [2.0, -1.0, -12.0])
def test_risk_gradient_is_the_slope(bias, monkeypatch):
    """Against differences of the risk, and of the unlabelled part alone (turned round) where that is below zero."""
    monkeypatch.setattr(toxicity, "BATCH", 6)
    rng, prior = np.random.default_rng(7), 0.4
    place, row, x = rng.integers(0, 5, 48), np.repeat(np.arange(12), 4), rng.random(48)
    w = np.append(rng.normal(size=5), bias)
    if bias < -10:
        w[:5] += 8 * (np.bincount(place[row < 6], minlength=5) > np.bincount(place[row >= 6], minlength=5))

    def cost(w):
        f = toxicity.margins(w, place, x, row)
        part = toxicity.negative_part(f, prior)
        return prior * np.logaddexp(0, -f[:6]).mean() + part if start >= 0 else -part

    start = toxicity.negative_part(toxicity.margins(w, place, x, row), prior)
    slopes = [(cost(w + e) - cost(w - e)) / 2e-6 for e in np.eye(6) * 1e-6]
    assert np.allclose(toxicity.risk_gradient(w, place, x, row, prior), slopes, atol=1e-6)


def test_quality_learns(marked):
    docs, labels = marked
    rows = quality.score(docs, quality.fit(docs, labels)).collect()
    assert len(rows) == 1506
    fresh = [r for r in rows if r.doc_id is not None and r.doc_id < 1500]
    assert np.mean([(r.score >= 0.3) == (r.doc_id % 5 != 1) for r in fresh]) > 0.97


def test_ftrl_is_its_formula():
    learner, z, n = quality.Ftrl(3), np.zeros(4), np.zeros(4)
    rng = np.random.default_rng(2)
    for _ in range(50):
        x, y = rng.normal(size=2), int(rng.integers(2))
        at = rng.choice(3, 2, replace=False)
        learner.update(at, x, y)
        full = np.zeros(4)
        full[at], full[3] = x, 1.0
        w = np.zeros(4)
        for i in range(4):
            l1 = 0 if i == 3 else quality.L1
            if abs(z[i]) > l1:
                w[i] = -(z[i] - np.sign(z[i]) * l1) / ((quality.BETA + n[i] ** 0.5) / quality.ALPHA + quality.L2)
        g = (1 / (1 + np.exp(-w @ full)) - y) * full
        z += g - (np.sqrt(n + g * g) - np.sqrt(n)) / quality.ALPHA * w
        n += g * g
    assert np.allclose(learner.z, z) and np.allclose(learner.n, n)


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifiers_without_labels(spark, module):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = module.score(docs, module.fit(docs, labels)).collect()
    assert [r.score for r in rows] == [0.5, 0.5]
    assert module.score(docs.limit(0), module.fit(docs.limit(0), labels)).collect() == []


@pytest.mark.parametrize(("query", "label", "threshold"), [("op7_toxicity", "toxic", 0.5), ("op9_quality", "quality", 0.3)])
def test_classifier_queries(spark, query, label, threshold):
    import zlib

    folder = "/root/testdata/sf0.1"
    rows = queries.QUERIES[query](spark, folder).collect()
    known = {r.doc_id: r[label] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.predicted == int(r.score >= threshold) and 0 <= r.score <= 1
    held = [(known[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in known]
    assert np.mean([a == b for a, b in held]) > 0.97
    assert np.mean([p for y, p in held if y == 1]) > 0.88


def test_labels_of_held_out_rows_are_not_read(spark, marked):
    docs, labels = marked
    turned = labels.withColumn("quality", F.when(features.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.fit(docs, labels), quality.fit(docs, turned)
    assert a.bias == b.bias and (a.weights == b.weights).all()


# --- decontamination ----------------------------------------------------------------------------


def _plain_score(item, passage):
    best, above = 0, [0] * (len(passage) + 1)
    for a in item:
        row = [0]
        for j, b in enumerate(passage, 1):
            row.append(max(0, above[j - 1] + (2 if a == b else -1), above[j] - 1, row[-1] - 1))
        best, above = max(best, *row), row
    return best


def test_alignment_is_smith_waterman():
    rng = np.random.default_rng(7)
    for _ in range(200):
        a, b = rng.integers(0, 5, rng.integers(1, 12)), rng.integers(0, 5, rng.integers(1, 15))
        score, first, last = decontaminate.align(a, b)
        assert score == _plain_score(a.tolist(), b.tolist())
        if score:
            assert _plain_score(a.tolist(), b[first : last + 1].tolist()) == score


def test_leaks(spark):
    items = [(i, " ".join(_words(30, 300 + i))) for i in range(6)] + [(6, "too short to count"), (7, None), (8, ""), (None, " ".join(_words(20, 999)))]
    items.append((0, items[0][1]))
    rng = random.Random(12)

    def edited(words, every):
        return [f"e{rng.randrange(10**6)}" if k % every == every - 1 else w for k, w in enumerate(words)]

    def around(words):
        return " ".join(_words(80, rng.random()) + words + _words(60, rng.random()))

    item = [i[1].split() if i[1] else [] for i in items]
    docs = [
        (0, around(item[0])), (1, around(edited(item[1], 6))), (2, around(item[2][:10])), (3, around(item[3][5:25])),
        (4, " ".join(w.upper() + "," for w in item[4])), (5, None), (6, ""), (7, around(_words(50, 13))), (8, around(item[6])),
        (9, around(item[0] + _words(40, 14) + item[5])), (None, around(item[9])), (0, around(item[0])), (10, "w1 " * 30_000),
    ]
    df = spark.createDataFrame(docs, DOCS).withColumn("leaks", F.lit("clash"))
    out = decontaminate.find_leaks(df, spark.createDataFrame(items, "item_id long, text string").withColumn("id", F.lit(1)))
    assert out.columns == ["doc_id", "text", "leaks"]
    rows = out.collect()
    found = collections.Counter((r.doc_id, x.item_id) for r in rows for x in r.leaks)
    want = {(0, 0): 4, (1, 1): 1, (3, 3): 1, (4, 4): 1, (9, 0): 2, (9, 5): 1, (None, None): 1}
    assert found == want
    for r in rows:
        for x in r.leaks:
            if (r.doc_id, x.item_id) == (3, 3):
                assert (x.score, x.last_word - x.first_word) == (40, 19)
    assert decontaminate.find_leaks(df, spark.createDataFrame([], "item_id long, text string")).filter(F.size("leaks") > 0).count() == 0
    assert decontaminate.find_leaks(df.limit(0), spark.createDataFrame(items, "item_id long, text string")).collect() == []


def test_leaks_do_not_depend_on_item_blocks(spark, monkeypatch, folder):
    docs, items = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = {(r.doc_id, tuple(sorted(x.item_id for x in r.leaks))) for r in decontaminate.find_leaks(docs, items).collect()}
    monkeypatch.setattr(decontaminate, "ITEM_BLOCK", 15)
    parts = {(r.doc_id, tuple(sorted(x.item_id for x in r.leaks))) for r in decontaminate.find_leaks(docs, items).collect()}
    assert whole == parts


def test_decontamination_query(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    items = spark.read.parquet(f"{folder}/benchmark.parquet").collect()
    copied = {(d.doc_id, i.item_id) for d in docs for i in items if d.text and i.text in d.text}
    assert {(r.doc_id, r.item_id) for r in queries.op8_decontaminate(spark, folder).collect()} == copied


# --- pipeline -----------------------------------------------------------------------------------


def test_pipeline(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names, steps = docs.columns, []
    for name, work in corpus_pipeline.STAGES:
        out = work(spark, docs, folder)
        if name != "bpe":
            assert out.columns == names
        out = spark.createDataFrame(out.collect(), out.schema)
        steps.append((name, docs.collect(), out.collect()))
        docs = out
    before, after = steps[0][1], steps[0][2]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    kept = {r.doc_id for r in after}
    clean = [r.doc_id for r in before if labels.get(r.doc_id) == 0]
    assert len([d for d in clean if d not in kept]) <= 0.01 * len(clean)
    assert all(r.n_chars == len(r.text or "") for r in steps[1][2])
    lines, left = steps[1][1], {r.doc_id: r.text for r in steps[1][2]}
    holders = collections.defaultdict(set)
    fold = {i: i + 32 for i in range(65, 91)}
    for r in lines:
        for line in (r.text or "").split("\n"):
            holders[line.strip(" \t\n\x0b\x0c\r").translate(fold)].add(r.doc_id)
    for r in lines:
        want = []
        for line in (r.text or "").split("\n"):
            own = holders[key := line.strip(" \t\n\x0b\x0c\r").translate(fold)]
            if not (len(key) >= 20 and len(own) >= 3 and max(own) != r.doc_id):
                want.append(line)
        assert left[r.doc_id] == "\n".join(want)
    groups = _plain_components([(r.doc_id, r.text) for r in steps[2][1]], 5, 80)
    assert sorted(r.doc_id for r in steps[2][2]) == sorted(d for d, _, c in groups if d == c)
    items = spark.read.parquet(f"{folder}/benchmark.parquet").collect()
    leaked = {r.doc_id for r in steps[3][1] if any(i.text in (r.text or "") for i in items)}
    assert {r.doc_id for r in steps[3][1]} - {r.doc_id for r in steps[3][2]} == leaked
    assert [r.doc_id for r in steps[4][1]] and all(len(r.ids) == r.n_tokens for r in steps[4][2])


def test_pipeline_stages_on_odd_rows(spark, folder):
    schema = spark.read.parquet(f"{folder}/documents.parquet").schema
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "a\nb" * 9000, None, None, None), (3, "x", "de", "s", 1)]
    for table in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, work in corpus_pipeline.STAGES:
            out = work(spark, table, folder)
            assert out.count() == table.count(), name


def test_one_row_of_near_copies_stays(spark):
    a, b, c, d, e = (" ".join(_words(60, 700 + i)) for i in range(5))
    near = a.rsplit(" ", 2)[0] + " x"
    rows = [(2, near), (1, a), (2, b), (3, c), (3, c), (None, d), (None, d), (None, e), (5, e), (None, "alone here"), (4, "")]
    docs = spark.createDataFrame(rows, DOCS)
    left = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert left.columns == docs.columns
    want = [(1, a), (2, b), (3, c), (None, d), (5, e), (None, "alone here"), (4, "")]
    assert sorted(map(tuple, left.collect()), key=str) == sorted(want, key=str)
    own = docs.withColumn("__Row", F.lit("own"))
    assert corpus_pipeline.drop_near_copies(spark, own, "").filter("__Row = 'own'").count() == len(want)
