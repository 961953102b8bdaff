"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic rows are used as labels. The rest of the training data is unlabelled text, toxic or
not. With the class prior pi (the share of toxic rows, given or taken from the labelled rows) the risk of a
linear classifier is ``pi * R_p(+) + max(0, R_u(-) - pi * R_p(-))``: what positives would cost as negatives
is taken out of the unlabelled part, and when that part falls below zero its gradient is turned round
so that it does not overfit. ``MODELS`` classifiers see different unlabelled rows and are averaged; each is
fitted in its own task with numpy. Samples are bounded by ``max_positive`` and ``max_unlabelled`` rows,
chosen by a hash of the id. Scoring is one pass without a shuffle.

Features are lower-cased words without punctuation and their first 4 to 6 bytes, so inflected forms
share what they learn. Without a confirmed toxic row every score is the prior. Null and empty texts get
the score of the bias. Repeated rows are scored alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.llm import features, texts
from tablewise.llm.quality import LinearModel, sampled_labels

MODELS = 3
MAX_POSITIVE = 4_000  # confirmed rows that are fitted
MAX_UNLABELLED = 9_000  # unlabelled rows that are fitted, over all models
STEPS, BATCH, RATE, DECAY = 600, 512, 0.1, 1e-3
LEAST_ROWS, LEAST_CONTRAST = 4, 4.0  # rows that have a bucket, and its standard score, for a weight
POWER = 0.5  # of the number of words that counts are divided by


def nn_pu(cells: Cells, positive: np.ndarray, prior: float, seed: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Buckets, weights and bias that minimise the non-negative risk with the logistic loss (Adam)."""
    p, u = np.flatnonzero(positive), np.flatnonzero(~positive)
    used = cells.contrasting(positive)
    size, begin = np.diff(cells.begin), cells.begin
    rng = np.random.default_rng(seed)
    w, m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1), np.zeros(len(used) + 1)  # the last is the bias
    if len(p) == 0 or len(u) == 0:
        return used, w[:-1], float(np.log(prior / (1 - prior)))
    w[-1] = -1.0
    for step in range(1, STEPS + 1):
        picked = np.concatenate([rng.choice(p, BATCH), rng.choice(u, BATCH)])
        counts = size[picked]
        at = np.arange(counts.sum()) + np.repeat(begin[picked] - (np.cumsum(counts) - counts), counts)
        place, row = cells.place[at], np.repeat(np.arange(len(picked)), counts)
        x = cells.n[at] / cells.scale[picked][row]
        g = risk_gradient(w, place, x, row, prior)
        g[:-1] += DECAY * w[:-1] / len(picked)
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    # the non-negative part holds margins back: the border goes down to where the prior's share of the unlabelled
    # rows lies above it, but no further than halfway from confirmed to ordinary rows, as a prior may be wrong
    row = np.repeat(np.arange(len(size)), size)
    f = np.bincount(row, w[cells.place] * (cells.n / cells.scale[row]), len(size)) + w[-1]
    border = max(np.quantile(f[u], 1 - prior), (np.median(f[p]) + np.median(f[u])) / 2)
    return used, w[:-1], float(w[-1] - min(border, 0.0))


def margins(w: np.ndarray, place: np.ndarray, x: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Of ``2 * BATCH`` rows, confirmed ones first; the last weight is the bias."""
    return np.bincount(row, w[place] * x, 2 * BATCH) + w[-1]


def risk_gradient(w: np.ndarray, place: np.ndarray, x: np.ndarray, row: np.ndarray, prior: float) -> np.ndarray:
    """The gradient of the risk, or where its unlabelled part is below zero, of that part turned round."""
    f = margins(w, place, x, row)
    up = 1 / (1 + np.exp(-np.clip(f, -35, 35)))  # derivative of log(1 + e^f)
    slope = np.empty(len(f))
    if negative_part(f, prior) >= 0:
        slope[:BATCH] = (prior * (up[:BATCH] - 1) - prior * up[:BATCH]) / BATCH
        slope[BATCH:] = up[BATCH:] / BATCH
    else:
        slope[:BATCH] = prior * up[:BATCH] / BATCH
        slope[BATCH:] = -up[BATCH:] / BATCH
    g = np.bincount(place, slope[row] * x, len(w))
    g[-1] = slope.sum()
    return g


def negative_part(f: np.ndarray, prior: float) -> float:
    """What the unlabelled rows cost as negatives, less what the confirmed ones among them would."""
    cost = np.logaddexp(0, f)
    return cost[BATCH:].mean() - prior * cost[:BATCH].mean()


class Cells:
    """Counts of buckets of the sampled rows, in flat arrays: begin (of each row), bucket and n."""

    def __init__(self) -> None:
        self._parts, self._words = [], []

    def add(self, features_: np.ndarray, words: int) -> None:
        found, n = np.unique(features_, return_counts=True)
        self._parts.append((found.astype(np.int32), n.astype(np.int32)))
        self._words.append(max(words, 1))

    def __len__(self) -> int:
        return len(self._words)

    def contrasting(self, positive: np.ndarray) -> np.ndarray:
        """The buckets with a weight; others are dropped, and ``place`` tells a cell's weight."""
        size = np.array([len(found) for found, _ in self._parts])
        self.scale = np.array(self._words) ** POWER
        bucket, self.n = (np.concatenate([part[k] for part in self._parts]) for k in (0, 1))
        self._parts.clear()
        keeps = _contrast(bucket, np.repeat(positive, size), 1 << features.BUCKET_BITS, int(positive.sum()), int((~positive).sum()))
        used, kept = np.flatnonzero(keeps), keeps[bucket]
        row = np.repeat(np.arange(len(size), dtype=np.int32), size)[kept]
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(size)))])
        places = np.zeros(len(keeps), np.int32)
        places[used] = np.arange(len(used))
        self.place, self.n = places[bucket[kept]], self.n[kept]
        return used


def _contrast(place: np.ndarray, positive: np.ndarray, buckets: int, n_p: int, n_u: int) -> np.ndarray:
    """Buckets whose share of rows differs between confirmed and unlabelled rows beyond chance."""
    in_p = np.bincount(place[positive], minlength=buckets)
    in_u = np.bincount(place[~positive], minlength=buckets)
    both = (in_p + in_u) / max(n_p + n_u, 1)
    error = np.sqrt(both * (1 - both) * (1 / max(n_p, 1) + 1 / max(n_u, 1)))
    score = np.abs(in_p / max(n_p, 1) - in_u / max(n_u, 1)) / np.maximum(error, 1e-12)
    return (in_p + in_u >= LEAST_ROWS) & (score >= LEAST_CONTRAST)


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", prior: float | None = None,
    max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, doc_id: str = "doc_id", text: str = "text",
) -> LinearModel:
    named = labels.select(labels[doc_id].alias("doc_id"), labels[label].cast("int").alias("label"))
    if prior is None:
        known = named.filter(~features.held_out(F.col("doc_id")) & F.col("label").isin(0, 1))
        share = known.agg(F.avg("label")).first()[0]
        prior = min(max(share if share is not None else 0.5, 1e-3), 0.5)
    toxic = sampled_labels(named.filter("label = 1"), "label", max_positive).select("doc_id", F.lit(True).alias("positive"))
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].cast("string").alias("text"))
    share = min(1.0, max_unlabelled / max(rows.count(), 1) * 1.25)  # of the four fifths
    order = F.pmod(F.xxhash64("doc_id", F.lit("unlabelled")), F.lit(1 << 30))
    rows = rows.join(F.broadcast(toxic), "doc_id", "left").withColumn("order", order)  # bounded by max_positive
    chosen = ~features.held_out(F.col("doc_id")) & (F.col("order") < (1 << 30) * share)
    pools = F.when(F.col("positive"), F.array(*map(F.lit, range(MODELS)))).otherwise(F.array())
    pools = F.when(chosen, F.array_union(pools, F.array(F.lit(MODELS) + F.col("order") % MODELS))).otherwise(pools)
    rows = rows.withColumn("pools", F.transform(pools, lambda p: p.cast("int"))).filter(F.size("pools") > 0)
    rows = features.featured(rows.select("order", "pools", "text"), features.word_stems, ["order", "pools"])
    # pools below MODELS hold the confirmed rows, the others the unlabelled rows of each model
    rows = rows.withColumn("pool", F.explode("pools")).withColumn("model", F.col("pool") % MODELS)

    def train(key, table):
        positive = table.column("pool").to_numpy() < MODELS
        words, order = table.column("words").to_numpy(), table.column("order").to_numpy()
        lists = table.column("features").combine_chunks()
        values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        cells, kept, seen = Cells(), [], set()
        for i in np.lexsort((words, order)).tolist():
            own = values[offsets[i] : offsets[i + 1]]
            mark = (bool(positive[i]), hash(own.tobytes()))
            if len(own) and mark not in seen:
                seen.add(mark)
                cells.add(own, int(words[i]))
                kept.append(i)
        if kept:
            used, weights, bias = nn_pu(cells, positive[kept], prior, seed=int(key[0].as_py()))
            used, weights = used[weights != 0], weights[weights != 0]
        else:
            used, weights, bias = np.zeros(0, np.int64), np.zeros(0), float(np.log(prior / (1 - prior)))
        out = pa.table({"bucket": pa.array(np.append(used, -1).astype(np.int64)), "weight": pa.array(np.append(weights, bias))})
        del cells, lists, values
        texts.give_back()
        return out

    fitted = rows.select("model", "pool", "order", "features", "words").groupBy("model").applyInArrow(train, "bucket bigint, weight double")
    weights, models, bias = np.zeros(1 << features.BUCKET_BITS), 0, float(np.log(prior / (1 - prior)))
    for r in fitted.groupBy("bucket").agg(F.sum("weight").alias("sum"), F.count(F.lit(1)).alias("n")).collect():
        if r["bucket"] < 0:
            models, bias = r["n"], r["sum"] / r["n"]
        else:
            weights[r["bucket"]] = r["sum"]  # at most one row per bucket
    return LinearModel(weights / max(models, 1), bias)


def score(docs: DataFrame, model: LinearModel, text: str = "text") -> DataFrame:
    """``docs`` with the column score."""
    return features.scored(docs, features.word_stems, model.weights, model.bias, POWER, text)
