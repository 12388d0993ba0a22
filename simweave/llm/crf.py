"""Language identification by a linear-chain conditional random field over words.

A word's features are its affixes (up to three bytes at either end), all its
byte bigrams and trigrams with the word's borders, and itself as a lexicon
entry, hashed to 2**BITS rows of weights, one weight a language. Transitions
between languages are learned with them, by Adagrad on the conditional
likelihood of sequences spliced from passages of different documents, so that
switching inside a text has been seen. Forward-backward gives every word its
posterior; a document's language is the one with the largest share of them.

Inference cuts the chains into pieces of ``PIECE`` words and is exact: pieces
are first summarised as transfer matrices, all of them at once, then messages
run along the pieces, then posteriors are filled in. A text's length adds to
the number of pieces only.
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
from simweave.llm.fitting import fit_in_one_task, fold, one_each, rows_of, sample

BITS = 17
PIECE = 64
AFFIXES = 6


@dataclass(frozen=True)
class CrfFit:
    chunk: int = 30
    chunks: int = 4
    batch: int = 64
    steps: int = 400
    rate: float = 0.25
    switch: float = 0.5


def _padded(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes with a space before every row and at the end, white space as spaces."""
    n = len(off) - 1
    lengths = np.diff(off)
    out = np.full(int(off[-1] - off[0]) + n + 1, 0x20, dtype=np.uint8)
    at = np.arange(off[0], off[-1]) - off[0] + np.repeat(np.arange(n), lengths) + 1
    body = tk.LOWER[data[off[0] : off[-1]]]
    body[tk.SPACE[body]] = 0x20
    out[at] = body
    return out, off - off[0] + np.arange(n + 1)


def word_features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features of byte positions, first position of each word, other features of words, words' bounds by row).

    Positions hold the bigram and the trigram that start there; word w owns the
    positions from its leading border to its last byte.
    """
    buf, at = _padded(data, off)
    solid = buf != 0x20
    starts = np.flatnonzero(solid[1:] & ~solid[:-1]) + 1
    ends = np.flatnonzero(solid[:-1] & ~solid[1:]) + 1
    bounds = np.searchsorted(starts, at)
    shift = np.uint64(64 - BITS)
    with np.errstate(over="ignore"):
        b = np.concatenate([buf, np.full(2, 0x20, np.uint8)]).astype(np.uint32)
        two = b[:-2] << np.uint32(8) | b[1:-1]
        three = two << np.uint32(8) | np.where(b[1:-1] == 0x20, np.uint32(0x20), b[2:])  # never into the next word
        grams = np.stack([(two * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS), (three * np.uint32(0x85EBCA77) + np.uint32(0x1B873593)) >> np.uint32(32 - BITS)]).astype(np.int32)
        hashes = tk.hash_spans(buf, 0, len(buf), starts, ends)
        extra = [(hashes >> shift).astype(np.int32)]
        for k in range(AFFIXES // 2):
            for tag, i, j in ((2 * k + 1, starts, np.minimum(starts + k + 1, ends)), (2 * k + 2, np.maximum(ends - k - 1, starts), ends)):
                extra.append((tk.mix(tk.hash_spans(buf, 0, len(buf), i, j) + np.uint64(tag)) >> shift).astype(np.int32))
    return grams, np.stack([starts - 1, ends]), np.stack(extra), bounds


def _sum_rows(x: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Sums of x[first:last] for the words; between words there is a border that neither owns."""
    if not len(first):
        return np.zeros((0, x.shape[1]), x.dtype)
    cut = np.stack([first, last], axis=1).ravel()
    return np.add.reduceat(x, np.minimum(cut, len(x) - 1), axis=0)[::2]


def emissions(weights: np.ndarray, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores (words x languages) of all words of rows, and the rows' bounds in them."""
    out, counts = [], np.zeros(len(off), dtype=np.int64)
    for i, j, lo, hi in tk.blocks(data, off, 1 << 19):
        grams, span, extra, bounds = word_features(data, np.clip(off[i : j + 1], lo, hi))
        e = _sum_rows(weights[grams[0]] + weights[grams[1]], span[0], span[1])
        for row in extra:
            e += weights[row]
        out.append(e)
        counts[i + 1 : j + 1] += np.diff(bounds)
    return (np.concatenate(out) if out else np.zeros((0, weights.shape[1]), np.float32)), np.cumsum(counts)


def posteriors(e: np.ndarray, off: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Each word's posterior over languages, by forward-backward along every row."""
    n, k = e.shape
    psi = np.exp(e - e.max(axis=1, keepdims=True))
    move = np.exp(trans)
    lengths = np.diff(off)
    pieces = -(-lengths // PIECE)
    total = int(pieces.sum())
    if not total:
        return psi
    row = np.repeat(np.arange(len(lengths)), pieces)
    rank = np.arange(total) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = off[:-1][row] + rank * PIECE
    size = np.minimum(PIECE, off[1:][row] - begin)
    head = rank == 0
    # words of a piece at step t: begin + t where t < size
    transfer = np.broadcast_to(np.eye(k), (total, k, k)).copy()
    for t in range(int(size.max())):
        on = np.flatnonzero(size > t)
        m = transfer[on]
        moved = (m.reshape(-1, k) @ move).reshape(-1, k, k)
        if t == 0:
            moved[head[on]] = 1.0
        moved *= psi[begin[on] + t][:, None, :]
        transfer[on] = moved / moved.sum(axis=(1, 2), keepdims=True)
    into, out = np.ones((total, k)), np.ones((total, k))
    first = np.cumsum(pieces) - pieces
    for r in range(1, int(pieces.max())):
        at = first[pieces > r] + r
        v = (into[at - 1][:, None, :] @ transfer[at - 1])[:, 0, :]
        into[at] = v / v.sum(axis=1, keepdims=True)
        at = (first + pieces)[pieces > r] - 1 - r
        v = (transfer[at + 1] @ out[at + 1][:, :, None])[:, :, 0]
        out[at] = v / v.sum(axis=1, keepdims=True)
    result = np.empty_like(psi)
    a = into
    for t in range(int(size.max())):
        on = np.flatnonzero(size > t)
        v = a[on] @ move
        if t == 0:
            v[head[on]] = 1.0
        v = v * psi[begin[on] + t]
        a[on] = v / v.sum(axis=1, keepdims=True)
        result[begin[on] + t] = a[on]
    b = out
    for t in range(int(size.max()) - 1, -1, -1):
        on = np.flatnonzero(size > t)
        at = begin[on] + t
        v = result[at] * b[on]
        result[at] = v / v.sum(axis=1, keepdims=True)
        v = (b[on] * psi[at]) @ move.T
        b[on] = v / v.sum(axis=1, keepdims=True)
    return result


def _gradient(psi: np.ndarray, move: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sequences (batch x steps x languages): truth less expectation, of labels and of transitions."""
    n, steps, k = psi.shape
    alpha, beta = np.empty_like(psi), np.ones_like(psi)
    a = psi[:, 0]
    alpha[:, 0] = a / a.sum(axis=1, keepdims=True)
    for t in range(1, steps):
        a = (alpha[:, t - 1] @ move) * psi[:, t]
        alpha[:, t] = a / a.sum(axis=1, keepdims=True)
    for t in range(steps - 2, -1, -1):
        b = (beta[:, t + 1] * psi[:, t + 1]) @ move.T
        beta[:, t] = b / b.sum(axis=1, keepdims=True)
    p = alpha * beta
    p /= p.sum(axis=2, keepdims=True)
    pair = alpha[:, :-1, :, None] * move * (psi[:, 1:] * beta[:, 1:])[:, :, None, :]
    pair /= pair.sum(axis=(2, 3), keepdims=True)
    one = np.eye(k)[y]
    return one - p, np.einsum("nti,ntj->ij", one[:, :-1], one[:, 1:]) - pair.sum(axis=(0, 1))


def _train(settings: CrfFit):
    def run(table: pa.Table | None) -> bytes:
        out = io.BytesIO()
        langs = sorted(set(table.column(1).to_pylist())) if table is not None else []
        if not langs:
            np.savez(out, langs=np.array([], dtype=str), w=np.zeros((1 << BITS, 0), np.float32), trans=np.zeros((0, 0)))
            return out.getvalue()
        rng, k, c = np.random.default_rng(5), len(langs), settings.chunk
        flat, first, labels = [], [], []  # features of chunks of c words: one row a chunk, with bounds by word
        over: list[list[np.ndarray]] = [[] for _ in langs]  # words of short texts and of tails, spliced into chunks of one language

        def add(per: list[np.ndarray], lang: int) -> None:
            flat.append(np.concatenate(per))
            first.append(np.repeat(np.arange(c, dtype=np.int32), [len(x) for x in per]))
            labels.append(lang)

        for text, lang in zip(table.column(0).to_pylist(), table.column(1).to_pylist(), strict=True):
            data, off = tk.text_buffer(pa.array([text]))
            grams, span, extra, _ = word_features(data, off)
            words, at = len(span[0]), langs.index(lang)
            for s in range(0, words, c):
                per = [np.concatenate([grams[0, span[0, w] : span[1, w]], grams[1, span[0, w] : span[1, w]], extra[:, w]]) for w in range(s, min(words, s + c))]
                if len(per) == c:
                    add(per, at)
                    continue
                over[at] += per
                if len(over[at]) >= c:
                    add(over[at][:c], at)
                    over[at] = over[at][c:]
        for at, per in enumerate(over):
            if per:  # the last words of a language, repeated to a chunk
                add([per[i % len(per)] for i in range(c)], at)
        w, trans = np.zeros((1 << BITS, k), np.float32), np.zeros((k, k))
        gw, gt = np.full((1 << BITS, k), 1e-6, np.float32), np.full((k, k), 1e-6)
        labels = np.array(labels)
        by_lang = [np.flatnonzero(labels == i) for i in range(k)]
        by_lang = [x for x in by_lang if len(x)]
        for _ in range(settings.steps if by_lang else 0):
            pick = np.empty((settings.batch, settings.chunks), dtype=np.int64)
            for q in range(settings.chunks):  # languages come equally often
                other = np.array([rng.choice(by_lang[rng.integers(len(by_lang))]) for _ in range(settings.batch)])
                stay = rng.random(settings.batch) >= settings.switch
                pick[:, q] = np.where(stay, pick[:, q - 1] + 1, other) if q else other
                if q:
                    off_end = (pick[:, q] >= len(labels)) | (labels[np.minimum(pick[:, q], len(labels) - 1)] != labels[pick[:, q - 1]])
                    pick[:, q] = np.where(stay & off_end, pick[:, q - 1], pick[:, q])
            order = pick.ravel()
            feats = np.concatenate([flat[i] for i in order])
            word = np.concatenate([first[i] + m * c for m, i in enumerate(order)])
            n = len(order) * c
            e = np.stack([np.bincount(word, weights=w[feats, i], minlength=n) for i in range(k)], axis=1)
            psi = np.exp(e - e.max(axis=1, keepdims=True)).reshape(settings.batch, -1, k)
            g, t = _gradient(psi, np.exp(trans), np.repeat(labels[order], c).reshape(settings.batch, -1))
            g = g.reshape(n, k) / settings.batch
            step = np.stack([np.bincount(feats, weights=g[word, i], minlength=1 << BITS) for i in range(k)], axis=1).astype(np.float32)
            gw += step * step
            w += settings.rate * step / np.sqrt(gw) * (step != 0)
            t = t / settings.batch - 1e-3 * trans
            gt += t * t
            trans += settings.rate * t / np.sqrt(gt)
        np.savez(out, langs=np.array(langs), w=w, trans=trans)
        return out.getvalue()

    return run


def _fit(docs: DataFrame, folds: int, held_out: int, max_rows: int, max_bytes: int, settings: CrfFit) -> bytes:
    known = docs.where("lang is not null and doc_id is not null").where(fold(F.col("doc_id"), folds) != held_out).select("doc_id", F.col("lang").alias("y"))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    rows = rows_of(texts, sample(texts, known, max_rows, max_bytes, seed=5, even=True)).select("doc_id", "text", F.col("y").alias("lang"))
    # equal rows are one before the texts travel
    return fit_in_one_task(one_each(rows), _train(settings))


def _read(model) -> tuple[list[str], np.ndarray, np.ndarray]:
    found = np.load(io.BytesIO(model.value))
    return found["langs"].tolist(), found["w"], found["trans"]


def _slices(off: np.ndarray, words: int = 400_000) -> Iterator[tuple[int, int]]:
    i = 0
    while i < len(off) - 1:
        j = max(i + 1, int(np.searchsorted(off, off[i] + words, side="right")) - 1)
        yield i, j
        i = j


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, w, trans = _read(model)
        for batch in batches:
            data, off = tk.text_buffer(batch.column(1))
            for i, j in _slices(off, 1 << 21):
                letters = batch.column(2).slice(i, j - i).to_numpy(zero_copy_only=False)
                pred, score = np.full(j - i, "und", dtype=object), np.zeros(j - i)
                if langs:
                    e, o = emissions(w, data, off[i : j + 1])
                    p = posteriors(e.astype(np.float64), o, trans)
                    sums = np.zeros((j - i, len(langs)))
                    some = np.flatnonzero(np.diff(o) > 0)
                    if len(some):
                        sums[some] = np.add.reduceat(p, o[:-1][some], axis=0)
                    share = sums / np.maximum(sums.sum(axis=1, keepdims=True), 1e-300)
                    best = share.argmax(axis=1)
                    told = letters & (np.diff(o) > 0)
                    pred[told] = np.array(langs, dtype=object)[best[told]]
                    score[told] = share[np.arange(j - i), best][told]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(pred, type=pa.string()), pa.array(np.clip(score, 0, 1))], names=["doc_id", "lang_pred", "score"])

    return run


def _segments(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, w, trans = _read(model)
        for batch in batches:
            data, off = tk.text_buffer(batch.column(1))
            for i, j in _slices(off, 1 << 21):
                e, o = emissions(w, data, off[i : j + 1])
                best = posteriors(e.astype(np.float64), o, trans).argmax(axis=1) if langs else np.zeros(0, np.int64)
                found = []
                for a, b in zip(o[:-1], o[1:], strict=True):
                    x = best[a:b] if langs else best
                    cuts = np.concatenate([[0], np.flatnonzero(np.diff(x)) + 1, [len(x)]]) if len(x) else np.zeros(1, np.int64)
                    found.append([{"first": int(s), "end": int(t), "lang": langs[x[s]]} for s, t in zip(cuts[:-1], cuts[1:], strict=True)])
                kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(found, type=kind)], names=["doc_id", "segments"])

    return run


def identify(docs: DataFrame, folds: int = 5, held_out: int = 0, max_rows: int = 4000, max_bytes: int = 32 << 20, settings: CrfFit = CrfFit()) -> DataFrame:
    """``docs`` (doc_id, text, lang) -> (doc_id, held_out, lang_pred, score), a row for each of its rows.

    Learns from at most ``max_rows`` documents with ``max_bytes`` of text
    outside the held-out fold, as many of each language as there are, see
    :func:`simweave.llm.fitting.sample`: documents without text, language or id
    or with several languages are not learned from, and a doc_id counts once.
    Each is read whole, short ones too. Prediction reads whole texts and
    nothing else. A null text, or one without a letter, is ``und`` with score
    0; so is all if nothing could be learned. The score is the share of the
    words' posteriors. Other columns are ignored; an empty table gives an
    empty one.
    """
    model = docs.sparkSession.sparkContext.broadcast(_fit(docs, folds, held_out, max_rows, max_bytes, settings))
    rows = docs.select("doc_id", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    found = rows.mapInArrow(tk.tidy(_predict(model)), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
    return found.select("doc_id", (fold(F.col("doc_id"), folds) == held_out).alias("held_out"), "lang_pred", "score")


def code_switches(docs: DataFrame, train: DataFrame | None = None, folds: int = 5, held_out: int = 0, max_rows: int = 4000, max_bytes: int = 32 << 20, settings: CrfFit = CrfFit()) -> DataFrame:
    """(doc_id, segments): the runs of words (first, end, lang) that forward-backward gives one language."""
    model = docs.sparkSession.sparkContext.broadcast(_fit(train if train is not None else docs, folds, held_out, max_rows, max_bytes, settings))
    return docs.select("doc_id", "text").mapInArrow(tk.tidy(_segments(model)), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, segments array<struct<first: long, end: long, lang: string>>")
