"""Fitting on a bounded sample, and hashed features shared by the classifiers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simweave.llm import textkit as tk
from simweave.scratch import discard, materialize


def fold(column: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; -1 for null."""
    return F.coalesce(F.crc32(column.cast("string")) % folds, F.lit(-1)).cast("int")


def sample(docs: DataFrame, labels: DataFrame, max_rows: int, max_bytes: int, seed: int = 0, even: bool = False) -> DataFrame:
    """(doc_id, key, y): the documents to learn from, at most ``max_rows`` of them with ``max_bytes`` of text in all.

    ``docs`` is (doc_id, text, ...), ``labels`` (doc_id, y) without nulls. A
    document is a doc_id that ``docs`` has with a text and that is labelled
    one way only; of several rows with one doc_id the one with the smallest
    hash counts, ``key`` is that hash. Texts beyond a 64th of ``max_bytes`` are
    not learned from. Chosen by hash of doc_id, the same in every run; if
    ``even``, every label gets an equal number.
    """
    key = F.xxhash64("text")
    told = labels.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("other")).where("y = other").drop("other")
    texts = docs.where(F.col("doc_id").isNotNull() & (F.octet_length("text") <= max_bytes // 64)).select("doc_id", F.struct(key.alias("key"), F.octet_length("text").alias("size")).alias("t"))
    there = materialize(texts.join(told, "doc_id").groupBy("doc_id", "y").agg(F.min("t").alias("t")).select("doc_id", "y", "t.*"), "labelled")
    order = F.xxhash64(F.lit(seed), "doc_id")
    classed = there.withColumn("class", F.col("y").cast("string") if even else F.lit(""))
    # a row for each label, of which a model has as many weights
    sizes = {r["class"]: r["n"] for r in classed.groupBy("class").agg(F.count("*").alias("n")).collect()}
    shares = _shares(sizes, max_rows)
    # little more than is wanted leaves the tasks: doc_ids are distinct here, so their hashes are spread evenly
    cuts = docs.sparkSession.createDataFrame([(c, n, int((1 << 30) * min(1, (n + 3 * n**0.5 + 10) / sizes[c]))) for c, n in shares.items()], "class string, share long, cut long")
    some = classed.join(F.broadcast(cuts), "class").where(F.pmod(order, F.lit(1 << 30)) < F.col("cut"))
    nth = F.row_number().over(Window.partitionBy("class").orderBy(order, "doc_id"))
    # a window over at most max_rows rows
    upto = F.sum("size").over(Window.partitionBy(F.lit(1)).orderBy(order, "doc_id"))
    picked = some.withColumn("nth", nth).where(F.col("nth") <= F.col("share")).withColumn("upto", upto).where(F.col("upto") <= max_bytes)
    out = materialize(picked.select("doc_id", "key", "y"), "sample")
    discard(there)
    return out


def _shares(sizes: dict, total: int) -> dict:
    """Equal shares of ``total``; what a small class leaves goes to the others."""
    out, left = {}, total
    for k, y in enumerate(sorted(sizes, key=lambda y: sizes[y])):
        out[y] = min(sizes[y], -(-left // (len(sizes) - k)))
        left -= out[y]
    return out


def rows_of(docs: DataFrame, picked: DataFrame) -> DataFrame:
    """Those rows of ``docs`` (doc_id, text, ...) that :func:`sample` picked, with ``key`` and ``y``; equal rows are all there."""
    # bounded by max_rows
    return docs.withColumn("key", F.xxhash64("text")).join(F.broadcast(picked), ["doc_id", "key"])


def one_each(rows: DataFrame, by: str = "doc_id") -> DataFrame:
    """One row for each value of ``by``, the smallest."""
    rest = [c for c in rows.columns if c != by]
    return rows.groupBy(by).agg(F.min(F.struct(*rest)).alias("r")).select(by, "r.*")


def fit_in_one_task(rows: DataFrame, train: Callable[[pa.Table | None], bytes]) -> bytes:
    """Run ``train`` on the bounded ``rows`` (doc_id, ...) in one task, in the order of its columns and without doc_id; it gets None if there are no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        yield pa.RecordBatch.from_arrays([pa.array([train(pa.Table.from_batches(got) if got else None)], type=pa.binary())], names=["model"])

    # sorted inside the task: a sort before it would send keys to the driver
    found = rows.repartition(1).sortWithinPartitions(*rows.columns).drop("doc_id").mapInArrow(tk.tidy(run), "model binary").collect()
    return found[0]["model"] if found else train(None)


def sigmoid(x: np.ndarray | float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def row_of(off: np.ndarray) -> np.ndarray:
    """The row of every element of rows bounded by ``off``."""
    return np.repeat(np.arange(len(off) - 1), np.diff(off))


def word_grams(hashes: np.ndarray, off: np.ndarray, bits: int, skip: bool = True) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row, feature) of all words, word pairs and, if ``skip``, pairs with one word between, hashed to ``bits`` bits."""
    row = row_of(off)
    shift = np.uint64(64 - bits)
    out = [(row, (hashes >> shift).astype(np.int64))]
    with np.errstate(over="ignore"):
        for gap, salt in ((1, 0xD6E8FEB86659FD93), (2, 0xA0761D6478BD642F))[: 1 + skip]:
            if len(hashes) > gap:
                same = row[gap:] == row[:-gap]
                pair = tk.mix(hashes[:-gap] * np.uint64(salt) + hashes[gap:])
                out.append((row[:-gap][same], (pair[same] >> shift).astype(np.int64)))
    return out
