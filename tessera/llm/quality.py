"""Quality classifier: a weak-label model trains a hashed linear scorer.

Heuristic labellers vote good (1), bad (0) or nothing (-1) on a text. How often
each pattern of votes occurs is counted over all documents (at most 3^L rows
for L labellers, so a bound that no corpus exceeds); expectation-maximisation on
those counts estimates every labeller's accuracy and each pattern's posterior.
Posterior labels of a bounded sample (``SAMPLE`` rows by the hash of the text)
train a logistic scorer on hashed word shapes and words, which scores all
documents. No gold label is used.

Defined results: null, empty and wordless texts have no feature and score 0; null and repeated doc_ids are
rows like others; an empty table gives no rows; extra columns are not read by
``scores`` and kept by ``keep``; a score of exactly the threshold is kept (ties), equal texts score
alike; very long texts are judged whole, their features being counts.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .hashing import _slot, word_hashes

SAMPLE, BITS, THRESHOLD = 12_000, 18, 0.5
#: Frequent words of running prose (fixed values).
FUNCTION_WORDS = frozenset("the of and to in a is that for on with as was it by la le les de et des que der die und das von zu el los en y con del".split())
#: Prior means: how often a labeller calls good texts bad (narrow detectors little, broad ones more), how often it finds
#: texts bad in its own way, the share of good texts; and what the priors are worth in shares of the documents.
FALSE_ALARM = np.array([0.0005, 0.0005, 0.0005, 0.0005, 0.2, 0.0005, 0.3])
FOUND, GOOD, PRIOR = 0.9, 0.85, 1.0
LABELLERS = ("signs", "capitals", "cells", "marks", "function words", "variety", "length")
_SIGN, _LETTER = re.compile(r"[^\w\s.,;:'\"!?()-]"), re.compile(r"[^\W\d_]")
_END = re.compile(r"([^\w\s.,;:)'\"]+)(?:\s|$)")


def votes(text: str | None) -> tuple[int, ...]:
    """One vote of each labeller; each judges one property of the whole text."""
    words = text.split() if text else []
    if not words:
        return (-1, -1, -1, -1, 0, -1, 0)
    n = len(words)
    letters = sum(map(len, _LETTER.findall(text))) or 1
    signs = len(_SIGN.findall(text)) / n
    upper = sum(map(str.isupper, text)) / letters
    cells = words.count("|") / n
    marks = len(_END.findall(text)) / n
    known = sum(w.strip(".,").lower() in FUNCTION_WORDS for w in words) / n
    variety = len(set(words)) / n
    between = lambda x, good, bad: 1 if x <= good else 0 if x >= bad else -1
    return (between(signs, 0.05, 0.3), between(upper, 0.1, 0.4), between(cells, 0.02, 0.2), between(marks, 0.1, 0.4), between(-known, -0.1, -0.02), -1 if n < 50 else between(-variety, -0.3, -0.15), 0 if n < 3 else -1)


def weak_labels(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 200) -> tuple[dict[tuple[int, ...], float], np.ndarray]:
    """Posterior of "good" by pattern, and each labeller's estimated accuracy on
    good and on bad texts.

    A bad text mostly fails one labeller, so there is one class of good texts and
    a class of bad ones for each labeller; within a class votes are taken as
    independent, and an abstention says nothing. Accuracies and shares are
    maximum a posteriori estimates: Beta priors (on good texts ``FALSE_ALARM``,
    in a bad class ``FOUND`` for its own labeller), worth ``PRIOR`` of the
    documents, tell which class is which, since votes alone can't; beyond that
    the votes decide, within no bounds.
    """
    v = np.array([p for p, _ in patterns])
    n = np.array([c for _, c in patterns], "f8")
    k = v.shape[1]
    # How likely a class's texts are to pass each labeller: the good class, then one bad class a labeller.
    mean = np.tile(1 - FALSE_ALARM[:k], (1 + k, 1))
    mean[1 + np.arange(k), np.arange(k)] = 1 - FOUND
    first = np.r_[GOOD, np.full(k, (1 - GOOD) / k)]
    worth = (PRIOR * n.sum() * first + 2)[:, None]
    passes, share = mean.copy(), first
    for _ in range(rounds):
        odds = (v == 1) @ np.log(passes).T + (v == 0) @ np.log(1 - passes).T + np.log(share)
        odds = np.exp(odds - odds.max(1, keepdims=True))
        post = odds / odds.sum(1, keepdims=True)
        w = n[:, None] * post
        passes = (w.T @ (v == 1) + worth * mean) / (w.T @ (v >= 0) + worth)
        share = w.sum(0) + PRIOR * n.sum() * first
        share = share / share.sum()
    bad = share[1:] / share[1:].sum()
    return {tuple(p): float(x) for (p, _), x in zip(patterns, post[:, 0], strict=True)}, np.array([passes[0], bad @ (1 - passes[1:])])


class _Kinds(dict):
    """Each letter's kind; other signs are themselves."""

    def __missing__(self, at: int) -> str:
        c = chr(at)
        self[at] = "0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c
        return self[at]


_KINDS, _RUN = _Kinds(), re.compile(r"(.)\1+", re.DOTALL)


def shape(word: str) -> str:
    """Kinds of letters without repeats, and other signs as they are: "Word," -> "Aa,"."""
    return _RUN.sub(r"\1", word.translate(_KINDS))


_SHAPES: dict[str, str] = {}


def features(text: str | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values: shares of word shapes, shape pairs and short words, the
    tenth that repeated words make up; last the bias."""
    words = text.split() if text else []
    last = np.array([1 << bits])
    if not words:
        return last, np.ones(1)
    if len(_SHAPES) > 200_000:
        _SHAPES.clear()
    for w in set(words).difference(_SHAPES):
        _SHAPES[w] = "\x00" + shape(w)
    s = word_hashes([_SHAPES[w] for w in words])
    h = word_hashes([w if len(w) < 5 else "\x01" for w in words])
    at, n = np.unique(np.concatenate([_slot(s, 1, bits), _slot(s[:-1] * np.uint64(31) + s[1:], 2, bits), _slot(h, 3, bits)]), return_counts=True)
    repeats = 1 - len(set(words)) / len(words) if len(words) >= 50 else 0.0
    kind = _slot(np.array([int(10 * repeats)], "u8"), 4, bits)
    return np.concatenate([at, kind, last]), np.concatenate([np.sqrt(n / len(words)), [1.0, 1.0]])


def fit_scorer(rows: list[tuple[tuple[np.ndarray, np.ndarray], float]], bits: int, rounds: int = 6, rate: float = 0.5) -> np.ndarray:
    """Logistic regression on soft labels by AdaGrad, in the given order."""
    w, g2 = np.zeros((1 << bits) + 1), np.full((1 << bits) + 1, 1e-6)
    for _ in range(rounds):
        for (at, x), y in rows:
            p = 1 / (1 + np.exp(-np.clip(w[at] @ x, -35, 35)))
            g = (p - y) * x
            g2[at] += g * g
            w[at] -= rate * g / np.sqrt(g2[at])
    return w


def model(docs: DataFrame, bits: int = BITS) -> np.ndarray | None:
    """The scorer's weights (2^bits + 1 numbers), or null for an empty table."""
    common.tune(docs.sparkSession)
    scratch = common.Scratch(docs.sparkSession)
    text = docs.select(F.col("text").cast("string").alias("text"))
    order = F.xxhash64("text", F.lit(3))

    def vote(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([list(votes(t)) for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))], ["order", "votes"])

    voted = scratch.table(text.select(order.alias("order"), "text").mapInArrow(vote, "order bigint, votes array<int>"), "votes")
    patterns = [(tuple(r["votes"]), r["n"]) for r in voted.groupBy("votes").agg(F.count("*").alias("n")).orderBy("votes").collect()]
    if not patterns:
        return None
    posterior, _ = weak_labels(patterns)
    total = sum(n for _, n in patterns)
    cut = 1_000_000 if total <= SAMPLE else int(1e6 * SAMPLE / total)

    def train(batches):
        rows = [(features(t, bits), posterior[votes(t)]) for batch in batches for t in batch.column(0).to_pylist()]
        w = fit_scorer(rows, bits)
        some = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(w[some])], ["slot", "weight"])

    # Equal texts hash alike, so one of each: a text of very many copies is one row of the sample.
    some = text.filter(F.pmod(order, F.lit(1_000_000)) < cut).withColumn("order", order).dropDuplicates(["order"])
    ordered = some.repartition(1).sortWithinPartitions("order").select("text")
    w = np.zeros((1 << bits) + 1)
    for r in ordered.mapInArrow(train, "slot bigint, weight double").collect():
        w[r["slot"]] = r["weight"]
    return w


def _scorer(docs: DataFrame, weights: np.ndarray, bits: int):
    some = np.flatnonzero(weights)
    held = docs.sparkSession.sparkContext.broadcast((some, weights[some]))

    def table() -> np.ndarray:
        w = np.zeros((1 << bits) + 1)
        w[held.value[0]] = held.value[1]
        return w

    def one(text: str | None, w: np.ndarray) -> float:
        at, x = features(text, bits)
        return float(1 / (1 + np.exp(-np.clip(w[at] @ x, -35, 35)))) if len(at) > 1 else 0.0

    return table, one


def scores(docs: DataFrame, threshold: float = THRESHOLD, bits: int = BITS) -> DataFrame:
    """(doc_id, score, kept) of each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    weights = model(docs, bits)
    schema = "doc_id bigint, score double, kept boolean"
    if weights is None:
        return docs.sparkSession.createDataFrame([], schema)
    table, one = _scorer(docs, weights, bits)

    def run(batches):
        w = table()
        for batch in batches:
            s = np.array([one(t, w) for t in batch.column(1).to_pylist()], "f8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array(s >= threshold)], ["doc_id", "score", "kept"])

    return rows.mapInArrow(run, schema)


def keep(docs: DataFrame, threshold: float = THRESHOLD, bits: int = BITS) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, all columns as they
    are; decided in one pass over the rows, without a join."""
    weights = model(docs, bits)
    if weights is None:
        return docs
    table, one = _scorer(docs, weights, bits)
    at = docs.columns.index("text")

    def run(batches):
        w = table()
        for batch in batches:
            yield batch.filter(pa.array([one(t, w) >= threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
