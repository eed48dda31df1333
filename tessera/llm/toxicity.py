"""Toxicity: FTRL-proximal logistic regression on hashed n-grams and skip-grams.

Per-coordinate rates and L1 sparsity leave few weights; what is broadcast is
those, at most 2^``bits`` numbers whatever the corpus. A text's features are
the distinct slots of its words, bigrams and skip-grams over its whole length.

The fit takes a sample of about ``SAMPLE`` labelled rows, chosen by the hash of
doc_id (all rows where there are fewer), in a fixed order in one task.

Defined results: null and empty texts have no feature and score the bias; rows
whose label or doc_id is null are not learnt from; null doc_ids are not held
out; repeated rows are scored each; an empty table gives no rows, and without
labels every score is 0.5 with predicted 1 by the rule score >= 0.5; extra
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .hashing import grams, word_hashes, words

SAMPLE, BITS, LEAST = 12_000, 20, 5


class Ftrl:
    """Follow the regularised leader, proximal, per coordinate."""

    def __init__(self, size: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 30.0, l2: float = 0.0):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, label: int, weight: float = 1.0) -> float:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
        g = (p - label) * weight
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g
        return p


def features(text: str | None, bits: int) -> np.ndarray:
    """Distinct slots; the last slot of all is the bias."""
    h = word_hashes(words(text))
    return np.append(np.unique(grams(h, bits)) if len(h) else np.empty(0, "i4"), np.int32(1 << bits))


def fit(labelled: DataFrame, bits: int = BITS, rounds: int = 5) -> dict[int, float]:
    """Weights by slot. ``labelled``: doc_id, text, label. Slots in under
    ``LEAST`` rows are left out; L1 grows with the rows up to its full strength."""
    common.tune(labelled.sparkSession)

    def train(batches):
        rows = []
        for batch in batches:
            rows += [(features(t, bits), y) for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        model = Ftrl((1 << bits) + 1, l1=min(30.0, len(rows) / 100))
        seen = np.zeros((1 << bits) + 1, "i8")
        for at, _ in rows:
            seen[at] += 1
        rows = [(at[seen[at] >= LEAST], y) for at, y in rows]
        ones = sum(y for _, y in rows)
        balance = (1.0, max(1.0, min(10.0, (len(rows) - ones) / max(1, ones))) ** 0.5)
        for _ in range(rounds):
            for at, y in rows:
                model.learn(at, y, balance[y])
        some = np.flatnonzero(np.abs(model.z) > model.l1)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(model.weights(some))], ["slot", "weight"])

    order = F.xxhash64("doc_id", F.lit(11))
    rows = labelled.select(order.alias("order"), F.col("text").cast("string").alias("text"), F.col("label").cast("int").alias("label"))
    ordered = rows.repartition(1).sortWithinPartitions("order", "text", "label").select("text", "label")
    return {r["slot"]: r["weight"] for r in ordered.mapInArrow(train, "slot bigint, weight double").collect()}


def sampled_labels(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """About ``sample`` labels by the hash of doc_id."""
    labels = labels.filter("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    total = labels.count()
    cut = 1_000_000 if total <= sample else int(1e6 * sample / total)
    return labels.filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) < cut)


def score(docs: DataFrame, weights: dict[int, float], bits: int = BITS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row."""
    common.tune(docs.sparkSession)
    table = np.zeros((1 << bits) + 1, "f8")
    for slot, w in weights.items():
        table[slot] = w
    some = np.flatnonzero(table)
    held = docs.sparkSession.sparkContext.broadcast((some.astype("i4"), table[some]))

    def run(batches):
        weight = np.zeros((1 << bits) + 1)
        weight[held.value[0]] = held.value[1]
        heavy = weight != 0
        for batch in batches:
            out = []
            for text in batch.column(2).to_pylist():
                h = word_hashes(words(text))
                at = grams(h, bits) if len(h) else np.empty(0, "i4")
                out.append(weight[np.unique(at[heavy[at]])].sum() + weight[-1])
            s = 1 / (1 + np.exp(-np.clip(np.array(out), -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= 0.5).astype("i4"))], ["doc_id", "held_out", "score", "predicted"])

    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, column: str = "toxic") -> DataFrame:
    """Learns ``column`` of labels from rows that are not held out, scores all."""
    learnt = labels.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0).select("doc_id", F.col(column).alias("label"))
    some = sampled_labels(learnt)
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # about SAMPLE rows
    return score(docs, fit(rows))
