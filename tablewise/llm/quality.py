"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

``fit`` takes at most about ``max_rows`` labelled rows (chosen by a hash of the id, whatever the size of
the corpus), extracts their features in parallel and feeds them one by one to FTRL-proximal updates in one
task: the only state is two numbers per bucket. ``score`` is a sparse dot product per document, in one
pass without a shuffle.

Rows without a label, or whose label is not 0 or 1, are not fitted. Several labels of one id are each
fitted; texts that repeat are fitted once. Without any labelled row every score is 0.5. Null and empty texts
get the score of the bias.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.llm import features, texts

MAX_ROWS = 12_000  # labelled rows that are fitted
PASSES = 3
POWER = 0.5  # of the number of words that counts are divided by
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.05, 1e-4


@dataclass
class LinearModel:
    weights: np.ndarray
    bias: float


class Ftrl:
    """FTRL-proximal for logistic loss, one row at a time; the last place is the bias, without L1."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def _weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == len(self.z) - 1, 0.0, L1)
        shrunk = np.sign(z) * l1 - z
        return np.where(np.abs(z) > l1, shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)

    def update(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        at, x = np.append(at, len(self.z) - 1), np.append(x, 1.0)
        w = self._weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - label) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g

    def model(self) -> LinearModel:
        w = self._weights(np.arange(len(self.z)))
        return LinearModel(w[:-1], float(w[-1]))


def sampled_labels(labels: DataFrame, label: str, max_rows: int, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, label, order: about ``max_rows`` labelled rows outside the held-out fifth, by a hash of the id."""
    rows = labels.select(labels[doc_id].alias("doc_id"), labels[label].cast("int").alias("label"))
    rows = rows.filter(~features.held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("label").isin(0, 1)).distinct()
    n = rows.count()
    order = F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 30))
    return rows.withColumn("order", order).filter(F.col("order") < (1 << 30) * min(1.0, max_rows / max(n, 1)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS, doc_id: str = "doc_id", text: str = "text") -> LinearModel:
    picked = sampled_labels(labels, label, max_rows, doc_id)
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].cast("string").alias("text"))
    rows = rows.join(F.broadcast(picked), "doc_id")  # bounded by max_rows
    rows = features.featured(rows.select("order", "label", "text"), features.word_ngrams, ["order", "label"])

    def train(batches):
        held, seen = [], set()
        for batch in batches:
            labels, lists, words = batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()
            for i, y in enumerate(labels):
                values = np.array(lists[i].values, np.int32)
                if (key := (y, hash(values.tobytes()))) not in seen:
                    seen.add(key)
                    held.append((*features.sparse(values, words[i], POWER), y))
        learner = Ftrl(1 << features.BUCKET_BITS)
        for _ in range(PASSES):
            for at, x, y in held:
                learner.update(at, x, y)
        model = learner.model()
        used = np.flatnonzero(model.weights)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(used, -1)), pa.array(np.append(model.weights[used], model.bias))], names=["bucket", "weight"]
        )

    fitted = rows.repartition(1).sortWithinPartitions("order", "label", "words").mapInArrow(texts.lean(train), "bucket bigint, weight double")
    weights, bias = np.zeros(1 << features.BUCKET_BITS), 0.0
    for r in fitted.collect():  # at most one row per bucket
        if r["bucket"] < 0:
            bias = r["weight"]
        else:
            weights[r["bucket"]] = r["weight"]
    return LinearModel(weights, bias)


def score(docs: DataFrame, model: LinearModel, text: str = "text") -> DataFrame:
    """``docs`` with the column score."""
    return features.scored(docs, features.word_ngrams, model.weights, model.bias, POWER, text)
