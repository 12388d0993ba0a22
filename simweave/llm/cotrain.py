"""Document quality by co-training a text-content view and a page-metadata view.

The text view sees words, word pairs, the shapes of words and immediate
repetition, as shares of the words, hashed to 2**BITS features. The metadata
view sees what a crawler's page record holds: source, declared language,
sizes, line layout and shares of kinds of characters, each cut into bins.
Both are logistic regressions. Over a few rounds each labels all unlabelled
documents, where they lie, and its most confident labels join the *other*
view's training rows. Then each view's logits are calibrated on labelled rows
kept aside, and a logistic combination of both scores every document. The task
that trains gets hashed features, not texts.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from simweave.llm import textkit as tk
from simweave.llm.fitting import fit_in_one_task, fold, one_each, row_of, rows_of, sample, sigmoid, word_grams
from simweave.llm.sifting import near
from simweave.scratch import discard, materialize

BITS = 16
BINS = 10
KINDS = 64
DENSE = 11

_CLASS = np.arange(256, dtype=np.uint64)
_CLASS[97:123] = _CLASS[128:] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_UPPER, _DIGIT, _OTHER = ((np.arange(256) >= 65) & (np.arange(256) < 91)), ((np.arange(256) >= 48) & (np.arange(256) < 58)), (_CLASS > 3) & ~tk.SPACE


@dataclass(frozen=True)
class CoTraining:
    rounds: int = 4
    epochs: int = 12
    rate: float = 0.3
    l2: float = 1e-4
    sure: float = 0.95
    share: float = 0.1
    seed: int = 3


def text_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) of the text-content view."""
    data, off = tk.text_buffer(column)
    rows, feats = [], []
    words = np.zeros(len(off) - 1)
    for i, j, lo, hi in tk.blocks(data, off):
        starts, ends, row = tk.spans(data, off, i, j, lo, hi)
        if not len(starts):
            continue
        hashes = tk.hash_spans(data, lo, hi, starts, ends)
        o = np.searchsorted(row, np.arange(i, j + 1))
        for r, f in word_grams(hashes, o, BITS, skip=False):
            rows.append(r + i)
            feats.append(f)
        body = data[lo:hi]
        with np.errstate(over="ignore"):
            shape = np.minimum(ends - starts, 8).astype(np.uint64)
            for at in (starts, np.minimum(starts + 1, ends - 1), np.maximum(ends - 3, starts), np.maximum(ends - 2, starts), ends - 1):
                shape = tk.mix(shape * np.uint64(31) + _CLASS[body[at]])
            shape = (shape >> np.uint64(64 - BITS)).astype(np.int64)
        same = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
        rows += [row, row[1:][same]]
        feats += [shape, np.full(int(same.sum()), 7, dtype=np.int64)]
        words += np.bincount(row, minlength=len(words))
    row = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    feat = np.concatenate(feats) if feats else np.zeros(0, np.int64)
    return row, feat, 20 / np.maximum(words[row], 1)


def metadata(text: pa.Array, lang: pa.Array, source: pa.Array, n_chars: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows x DENSE numbers, rows x 2 kinds) of the metadata view."""
    data, off = tk.text_buffer(text)
    hashes, o = tk.words(text)
    n, words, size = len(off) - 1, np.diff(o).astype(float), np.diff(off).astype(float)
    sums = np.zeros((4, n))
    for i, j, lo, hi in tk.blocks(data, off):
        body = data[lo:hi]
        row = np.repeat(np.arange(i, j), np.diff(np.clip(off[i : j + 1], lo, hi)))
        for k, kind in enumerate((_UPPER, _DIGIT, _OTHER)):
            sums[k] += np.bincount(row[kind[body]], minlength=n)
        sums[3] += np.bincount(row[body == 10], minlength=n)
    distinct = np.zeros(n)
    if len(hashes):
        row = row_of(o)
        order = np.lexsort((hashes, row))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (row[order][1:] != row[order][:-1])
        distinct = np.bincount(row[order][new], minlength=n).astype(float)
    per = np.maximum(size, 1)
    declared = n_chars.cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False)
    lines = sums[3] + 1
    dense = np.stack([np.log1p(size), np.log1p(words), np.log1p(np.maximum(declared, 0)), np.log1p(lines), np.log1p(size / lines), size / np.maximum(words, 1), sums[0] / per, sums[1] / per, sums[2] / per, distinct / np.maximum(words, 1), distinct / np.maximum(np.sqrt(words), 1)], axis=1)
    kinds = []
    for k, column in enumerate((lang, source)):
        hashes, o = tk.words(column)
        first = np.zeros(n, dtype=np.int64)
        some = np.diff(o) > 0
        first[some] = (hashes[o[:-1][some]] >> np.uint64(58)).astype(np.int64)
        kinds.append(first + k * KINDS)
    return np.nan_to_num(dense, posinf=0, neginf=0), np.stack(kinds, axis=1)


def meta_view(dense: np.ndarray, kinds: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(dense)
    bins = np.stack([np.searchsorted(edges[k], dense[:, k]) + k * (BINS + 1) for k in range(DENSE)] + [kinds[:, 0] + DENSE * (BINS + 1), kinds[:, 1] + DENSE * (BINS + 1)], axis=1)
    return np.repeat(np.arange(n), bins.shape[1]), bins.ravel(), np.ones(bins.size)


class View:
    """Logistic regression over sparse rows, by Adagrad."""

    def __init__(self, bounds: np.ndarray, feat: np.ndarray, value: np.ndarray, size: int):
        self.bounds, self.feat, self.value = bounds, feat, value
        self.w, self.size = np.zeros(size + 1), size

    def _rows(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        pick = np.concatenate([np.arange(self.bounds[r], self.bounds[r + 1]) for r in rows]) if len(rows) else np.zeros(0, np.int64)
        return np.repeat(np.arange(len(rows)), self.bounds[rows + 1] - self.bounds[rows]), self.feat[pick], self.value[pick]

    def logits(self, at: np.ndarray) -> np.ndarray:
        of, f, v = self._rows(at)
        return np.bincount(of, weights=self.w[f] * v, minlength=len(at)) + self.w[-1]

    def fit(self, at: np.ndarray, y: np.ndarray, s: CoTraining) -> None:
        self.w, g2 = np.zeros(self.size + 1), np.full(self.size + 1, 1e-3)
        rng = np.random.default_rng(s.seed)
        for _ in range(s.epochs):
            order = rng.permutation(len(at))
            for k in range(0, len(order), 64):
                rows = at[order[k : k + 64]]
                of, f, v = self._rows(rows)
                z = np.bincount(of, weights=self.w[f] * v, minlength=len(rows)) + self.w[-1]
                e = sigmoid(z) - y[order[k : k + 64]]
                u = np.flatnonzero(np.bincount(f, minlength=self.size))
                g = np.bincount(f, weights=e[of] * v, minlength=self.size)[u] / len(rows) + s.l2 * self.w[u]
                g2[u] += g * g
                self.w[u] -= s.rate * g / np.sqrt(g2[u])
                b = e.mean()
                g2[-1] += b * b
                self.w[-1] -= s.rate * b / np.sqrt(g2[-1])


def _platt(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coefficients of a logistic regression of y on the columns of x and 1, by Newton's method, slightly regularised."""
    x = np.column_stack([x, np.ones(len(y))])
    c = np.zeros(x.shape[1])
    for _ in range(50):
        p = sigmoid(x @ c)
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-2] * x.shape[1])
        step = np.linalg.solve(h, x.T @ (y - p) - 1e-2 * c)
        c = c + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return c


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, key, text, lang, source, n_chars, y) -> (doc_id, key, feats, vals, dense, kinds, y): a text's distinct features with their summed values, as bytes."""
    names = ["doc_id", "key", "feats", "vals", "dense", "kinds", "y"]
    for batch in batches:
        for part in tk.slices(batch, 2):
            row, feat, value = text_view(part.column(2))
            code, back = np.unique(row.astype(np.int64) << BITS | feat, return_inverse=True)
            value = np.bincount(back, weights=value, minlength=len(code)).astype(np.float32)
            bounds = np.searchsorted(code, np.arange(part.num_rows + 1) << BITS)
            feat = (code & ((1 << BITS) - 1)).astype(np.uint16)
            cells = [[x[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] for x in (feat, value)]
            cells += [[r.tobytes() for r in x] for x in metadata(*part.columns[2:6])]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array(c, type=pa.binary()) for c in cells], part.column(6)], names=names)


def _train(s: CoTraining, taught: dict[int, list[float]]):
    """Fit both views on the labelled rows and on those that the other view taught: ``taught`` has a row's label for each view, or nan."""

    def run(table: pa.Table | None) -> bytes:
        out = io.BytesIO()
        y = table.column("y").to_numpy().astype(float) if table is not None else np.zeros(0)
        if not {0.0, 1.0} <= set(y[~np.isnan(y)]):  # one class or none: nothing to tell apart
            np.savez(out, text=np.zeros((1 << BITS) + 1), meta=np.zeros(DENSE * (BINS + 1) + 2 * KINDS + 1), edges=np.zeros((DENSE, BINS)), cal=np.zeros((2, 2)), mix=np.zeros(3), rate=np.nan)
            return out.getvalue()
        n = len(y)
        cells = lambda c, t: np.frombuffer(b"".join(table.column(c).to_pylist()), dtype=t)
        bounds = np.concatenate([[0], np.cumsum(pc.binary_length(table.column("feats")).to_numpy() // 2, dtype=np.int64)])
        dense, kinds = cells("dense", np.float64).reshape(n, DENSE), cells("kinds", np.int64).reshape(n, 2)
        edges = np.quantile(dense, np.linspace(0, 1, BINS + 2)[1:-1], axis=0).T
        text = View(bounds, cells("feats", np.uint16), cells("vals", np.float32), 1 << BITS)
        row, feat, value = meta_view(dense, kinds, edges)
        meta = View(np.searchsorted(row, np.arange(n + 1)), feat, value, DENSE * (BINS + 1) + 2 * KINDS)
        rng = np.random.default_rng(s.seed)
        known = rng.permutation(np.flatnonzero(~np.isnan(y)))  # the same split in every round
        aside, labelled = np.split(known, [max(1, len(known) // 5)])
        keys = table.column("key").to_numpy()
        given = np.array([taught.get(int(x), (np.nan, np.nan)) if np.isnan(t) else (np.nan, np.nan) for x, t in zip(keys, y, strict=True)])
        logits = []
        for k, view in enumerate((text, meta)):
            more = np.flatnonzero(~np.isnan(given[:, k]))
            view.fit(np.concatenate([labelled, more]), np.concatenate([y[labelled], given[more, k]]), s)
            logits.append(view.logits(aside))
        cal = np.stack([_platt(x[:, None], y[aside]) for x in logits])
        both = np.stack([x * c[0] + c[1] for x, c in zip(logits, cal, strict=True)], axis=1)
        np.savez(out, text=text.w, meta=meta.w, edges=edges, cal=cal, mix=_platt(both, y[aside]), rate=y[labelled].mean() if len(labelled) else np.nan)
        return out.getvalue()

    return run


def _views(m: dict, part: pa.RecordBatch) -> list[np.ndarray]:
    """Both views' logits of (text, lang, source, n_chars)."""
    n = part.num_rows
    row, feat, value = text_view(part.column(0))
    text = np.bincount(row, weights=m["text"][feat] * value, minlength=n) + m["text"][-1]
    row, feat, value = meta_view(*metadata(*part.columns), m["edges"])
    return [text, np.bincount(row, weights=m["meta"][feat] * value, minlength=n) + m["meta"][-1]]


def _sure(model, least: float):
    """(doc_id, key, text, lang, source, n_chars) -> (doc_id, key, z0, z1): the rows of whose label a view is sure.

    ``model`` comes with the keys that each view has taught before, at most
    max_taught a round and class; there the view's logit is null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, done = model.value
        m = dict(np.load(io.BytesIO(found)))
        for batch in batches:
            for part in tk.slices(batch, 2):
                z = np.stack(_views(m, pa.RecordBatch.from_arrays(part.columns[2:], names=["text", "lang", "source", "n_chars"])))
                old = np.stack([np.isin(part.column(1).to_numpy(), x) for x in done])
                at = np.flatnonzero(((np.abs(z) >= least) & ~old).any(axis=0))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), part.column(1).take(pa.array(at)), *[pa.array(x[at], mask=o[at]) for x, o in zip(z, old, strict=True)]], names=["doc_id", "key", "z0", "z1"])

    return run


def _keys(spark: SparkSession, keys: list[int]) -> DataFrame:
    return spark.createDataFrame(pa.table({"key": pa.array(keys, pa.int64())}))


def _fit(docs: DataFrame, told: DataFrame, pool: DataFrame, held_out: Column, max_labelled: int, max_taught: int, max_bytes: int, s: CoTraining) -> bytes:
    """The model from ``docs`` (doc_id, text, ...), the labels ``told`` (doc_id, y) and the unlabelled ``pool`` (doc_id)."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text", "lang", "source", "n_chars")
    shape = f"doc_id {kind}, key long, feats binary, vals binary, dense binary, kinds binary, y double"
    # a row's features are at most 2**BITS numbers; rows are bounded by max_labelled, and by 2 * max_taught a round
    first = rows_of(docs, sample(docs, told, max_labelled, max_bytes, s.seed)).withColumn("key", F.xxhash64("doc_id", "text")).select(*keyed.columns, "y")
    rows = [materialize(one_each(first.mapInArrow(tk.tidy(_features), shape)), "labelled")]
    pool = materialize(pool, "unlabelled")
    n_pool, least = pool.count(), float(np.log(s.sure / (1 - s.sure)))
    taught: dict[int, list[float]] = {}

    def fitted() -> bytes:
        sample = rows[0]
        for x in rows[1:]:
            sample = sample.unionByName(x)
        return fit_in_one_task(sample, _train(s, taught))

    model = fitted()
    rate = float(np.load(io.BytesIO(model))["rate"])
    for _ in range(s.rounds if n_pool and not np.isnan(rate) else 0):
        seen = spark.sparkContext.broadcast((model, [np.array([x for x, t in taught.items() if not np.isnan(t[1 - k])], dtype=np.int64) for k in (0, 1)]))
        # a bitmap leaves out most other rows before they are scored, an exact join of ids the rest
        mine = near(keyed.where(~held_out & (F.octet_length("text") <= max_bytes // 64)), pool, "doc_id")
        sure = mine.mapInArrow(tk.tidy(_sure(seen, least)), f"doc_id {kind}, key long, z0 double, z1 double").join(pool, "doc_id", "left_semi")
        sure = materialize(sure.select("key", "z0", "z1").dropDuplicates(["key"]), "sure")
        known = set(taught)
        for k in (0, 1):  # view k teaches view 1 - k
            for label, part in ((1.0, rate), (0.0, 1 - rate)):
                z = F.col(f"z{k}") * (1 if label else -1)
                best = sure.where(z >= least).orderBy(z.desc(), "key").limit(int(np.ceil(part * min(s.share * n_pool, max_taught))))
                for r in best.select("key").collect():
                    taught.setdefault(r["key"], [np.nan, np.nan])[1 - k] = label
        discard(sure)
        new = sorted(set(taught) - known)
        if new:
            # bounded by 2 * max_taught
            found = keyed.join(F.broadcast(_keys(spark, new)), "key").select(*keyed.columns).withColumn("y", F.lit(None).cast("double"))
            rows.append(materialize(one_each(found.mapInArrow(tk.tidy(_features), shape), "key").select(*rows[0].columns), "taught"))
        model = fitted()
        seen.destroy()
    discard(pool, *rows)
    return model


def _scorer(model):
    kind = pa.struct([("score", pa.float64()), ("text_score", pa.float64()), ("meta_score", pa.float64())])

    @F.arrow_udf("struct<score: double, text_score: double, meta_score: double>")
    def score(text: pa.Array, lang: pa.Array, source: pa.Array, n_chars: pa.Array) -> pa.Array:
        m = dict(np.load(io.BytesIO(model.value)))
        out = []
        whole = pa.RecordBatch.from_arrays([text, lang, source, n_chars], names=["text", "lang", "source", "n_chars"])
        for part in tk.slices(whole, 0):
            views = [x * c[0] + c[1] for x, c in zip(_views(m, part), m["cal"], strict=True)]
            out.append(np.stack([views[0] * m["mix"][0] + views[1] * m["mix"][1] + m["mix"][2], *views]))
        scores = sigmoid(np.concatenate(out, axis=1)) if out else np.zeros((3, 0))
        tk.release()
        return pa.StructArray.from_arrays([pa.array(x) for x in scores], fields=list(kind))

    return score


def with_quality(docs: DataFrame, labels: DataFrame, out: str = "quality", folds: int = 5, held_out: int = 0, max_labelled: int = 6000, max_taught: int = 600, max_bytes: int = 256 << 20, settings: CoTraining = CoTraining()) -> DataFrame:
    """``docs`` with a column ``out``: struct of score (the probability of good quality), text_score and meta_score.

    ``labels`` is (doc_id, quality). Learns from at most ``max_labelled``
    labelled documents with ``max_bytes`` of text outside the held-out fold,
    see :func:`simweave.llm.fitting.sample`: null labels, texts and ids and
    documents with contradicting labels are not learned from, and a doc_id
    counts once. All other documents outside that fold with texts up to a 64th
    of ``max_bytes`` are labelled anew in every round, and each view teaches
    the other those it is surest of: ``share`` of them, at most ``max_taught``
    a round. Each document is read whole. Every row is scored, null and blank
    texts too; without both classes among the labels every score is 0.5.
    Columns lang, source and n_chars may be absent; a column that is named
    like ``out`` is replaced, others are kept. An empty table gives an empty one.
    """
    absent = lambda c, t: F.col(c).cast(t) if c in docs.columns else F.lit(None).cast(t)
    ours = [F.col("text").cast("string").alias("text"), absent("lang", "string").alias("lang"), absent("source", "string").alias("source"), absent("n_chars", "long").alias("n_chars")]
    told = labels.where("quality is not null and doc_id is not null").select("doc_id", F.col("quality").cast("double").alias("y")).where(fold(F.col("doc_id"), folds) != held_out)
    pool = docs.where("doc_id is not null").where(fold(F.col("doc_id"), folds) != held_out).select("doc_id").join(labels.where("quality is not null").select("doc_id"), "doc_id", "left_anti").distinct()
    found = _fit(docs.select("doc_id", *ours), told, pool, fold(F.col("doc_id"), folds) == held_out, max_labelled, max_taught, max_bytes, settings)
    model = docs.sparkSession.sparkContext.broadcast(found)
    return docs.withColumn(out, _scorer(model)(*ours))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, folds: int = 5, held_out: int = 0, **options) -> DataFrame:
    """(doc_id, held_out, score, text_score, meta_score, keep) for each row of ``docs``; see :func:`with_quality`."""
    scored = with_quality(docs.select("doc_id", *[c for c in ("text", "lang", "source", "n_chars") if c in docs.columns]), labels, "q", folds, held_out, **options)
    return scored.select("doc_id", (fold(F.col("doc_id"), folds) == held_out).alias("held_out"), "q.score", "q.text_score", "q.meta_score", (F.col("q.score") >= threshold).alias("keep"))


def kept(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with their columns."""
    mark = "_quality"
    while mark in docs.columns:
        mark = "_" + mark
    return with_quality(docs, labels, mark, **options).where(F.col(mark)["score"] >= threshold).drop(mark)
