"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct words, stems (a word's first STEM bytes), word pairs
and pairs with a word between of a whole text, hashed to 2**BITS coordinates. FTRL-proximal (McMahan et al., "Ad
Click Prediction: a View from the Trenches") gives every coordinate its own
rate, and its L1 term leaves most weights at zero; what remains is a sparse
vector of bounded size that is broadcast for scoring.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simweave.llm import textkit as tk
from simweave.llm.fitting import fit_in_one_task, fold, one_each, row_of, rows_of, sample, sigmoid, word_grams
from simweave.scratch import discard, materialize

BITS = 20
STEM = 4


@dataclass(frozen=True)
class Ftrl:
    """Chosen on a split inside the training folds."""

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 6.0
    l2: float = 1.0
    passes: int = 8

    def fit(self, rows: list[np.ndarray], y: np.ndarray, size: int) -> tuple[np.ndarray, float]:
        """Weights and bias after ``passes`` over ``rows`` (each the indices of its features) in a fixed shuffled order."""
        z, n = np.zeros(size), np.zeros(size)
        bias = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))) if len(y) else 0.0
        z0 = n0 = 0.0
        start = bias
        rng = np.random.default_rng(2)
        for _ in range(self.passes):
            for k in rng.permutation(len(rows)):
                i = rows[k]
                zi, ni = z[i], n[i]
                root = np.sqrt(ni)
                w = np.where(np.abs(zi) <= self.l1, 0.0, (np.sign(zi) * self.l1 - zi) / ((self.beta + root) / self.alpha + self.l2))
                g = float(sigmoid(bias + w.sum())) - y[k]
                after = np.sqrt(ni + g * g)
                z[i] = zi + g - (after - root) / self.alpha * w
                n[i] = ni + g * g
                step = (np.sqrt(n0 + g * g) - np.sqrt(n0)) / self.alpha
                z0, n0 = z0 + g - step * (bias - start), n0 + g * g
                bias = start - z0 / ((self.beta + np.sqrt(n0)) / self.alpha)
        w = np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))
        return w, bias


def _grams(text: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row, feature) of all features of a batch of texts."""
    hashes, off = tk.words(text)
    stems = tk.mix(tk.words(text, STEM)[0] + np.uint64(STEM)) >> np.uint64(64 - BITS)
    return [*word_grams(hashes, off, BITS), (row_of(off), stems.astype(np.int64))]


def features(text: pa.Array) -> list[np.ndarray]:
    """The distinct features of each text."""
    out: list[np.ndarray] = []
    for a in range(0, len(text), 256):
        part = text.slice(a, 256)
        keys = np.unique(np.concatenate([(r << BITS) | f for r, f in _grams(part)]))
        out += np.split(keys & ((1 << BITS) - 1), np.searchsorted(keys, np.arange(1, len(part)) << BITS))
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, y) -> (doc_id, feats, y): a text's distinct features, as bytes."""
    for part in (x for b in batches for x in tk.slices(b, 1)):
        cells = [x.astype(np.int32).tobytes() for x in features(part.column(1))]
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cells, type=pa.binary()), part.column(2)], names=["doc_id", "feats", "y"])


def _train(settings: Ftrl):
    def run(table: pa.Table | None) -> bytes:
        rows, y = [], np.zeros(0)
        if table is not None:
            rows = [np.frombuffer(x.as_buffer(), dtype=np.int32) for x in table.column(0)]
            y = table.column(1).to_numpy().astype(np.float64)
        w, bias = settings.fit(rows, y, 1 << BITS)
        at = np.flatnonzero(w)
        out = io.BytesIO()
        np.savez(out, at=at.astype(np.int32), w=w[at].astype(np.float32), bias=bias)
        return out.getvalue()

    return run


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.load(io.BytesIO(model.value))
        w = np.zeros(1 << BITS)
        w[found["at"]] = found["w"]
        for batch in (x for b in batches for x in tk.slices(b, 1)):
            keys = []
            for r, f in _grams(batch.column(1)):
                told = w[f] != 0
                keys.append((r[told] << BITS) | f[told])
            keys = np.unique(np.concatenate(keys))
            total = np.bincount(keys >> BITS, weights=w[keys & ((1 << BITS) - 1)], minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sigmoid(total + float(found["bias"])))], names=["doc_id", "score"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 4, held_out: int = 2, max_rows: int = 20000, max_bytes: int = 256 << 20, settings: Ftrl = Ftrl()) -> DataFrame:
    """``docs`` (doc_id, text), ``labels`` (doc_id, toxic) -> (doc_id, held_out, score, predicted), a row for each document.

    Learns from at most ``max_rows`` labelled documents with ``max_bytes`` of
    text outside the held-out fold, see :func:`simweave.llm.fitting.sample`:
    null labels, texts and ids and documents with contradicting labels are not
    learned from, and a doc_id counts once however often it comes. Every text
    is scored whole; null and blank texts get the score of no features. Without
    any labels every score is 0.5. Nothing but the text enters a score.
    """
    spark = docs.sparkSession
    known = labels.where("toxic is not null and doc_id is not null").select("doc_id", F.col("toxic").cast("double").alias("y")).where(fold(F.col("doc_id"), folds) != held_out)
    texts, kind = docs.select("doc_id", F.col("text").cast("string").alias("text")), docs.schema["doc_id"].dataType.simpleString()
    rows = rows_of(texts, sample(texts, known, max_rows, max_bytes)).select("doc_id", "text", "y")
    rows = materialize(one_each(rows.mapInArrow(tk.tidy(_features), f"doc_id {kind}, feats binary, y double")), "features")
    model = spark.sparkContext.broadcast(fit_in_one_task(rows, _train(settings)))
    discard(rows)
    scored = texts.mapInArrow(tk.tidy(_score(model)), f"doc_id {kind}, score double")
    return scored.select("doc_id", (fold(F.col("doc_id"), folds) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
