"""Benchmark decontamination by the q-gram lemma.

A passage of ``window`` characters (bytes of lower-cased text with runs of
white space as one space) of a benchmark item leaks into a document if it
occurs there within an edit budget of k = rate * window. Then the two share at
least window - q + 1 - k * q of their q-grams (Jokinen and Ukkonen), on
diagonals that differ by at most k.

1. A document's q-grams are looked up among the benchmark's; only stretches
   with enough hits to meet the bound go on (no document is looked at through
   a sample or a prefix).
2. In those, hits are counted by item and overlapping diagonal band (2k + 1
   wide, every k), and windows of the item with enough distinct q-grams kept.
3. A banded alignment of each such window confirms it or not.

The benchmark's index is broadcast in parts of about ``PART_BYTES`` of item
text, ``GROUP`` of them in a pass over the documents; a larger benchmark takes
several passes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simweave.llm import textkit as tk
from simweave.scratch import materialize

Q = 8
PART_BYTES = 1 << 20
#: Parts that one pass over the documents holds at once.
GROUP = 4
BLOOM_BITS = 22
#: What a word is not made of.
WHITE = " \t\n\v\f\r"
STRETCH = 1 << 16


@dataclass(frozen=True)
class Budget:
    """Items shorter than ``window`` are one window; those shorter than ``least`` must occur unchanged, those under q characters as whole words."""

    window: int = 100
    rate: float = 0.08
    least: int = 40

    def of(self, size: int) -> tuple[int, int, int]:
        """(window, edits, shared q-grams needed) for an item of that many characters."""
        w = min(size, self.window)
        k = int(w * self.rate) if size >= self.least else 0
        while k and w - Q + 1 - k * Q < 1:
            k -= 1
        return w, k, w - Q + 1 - k * Q


def normal(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised bytes and where each came from."""
    space = tk.SPACE[data]
    keep = ~space
    if len(space):
        keep[0] = True
        keep[1:] |= ~space[:-1]
    at = np.flatnonzero(keep)
    out = tk.LOWER[data[at]]
    out[space[at]] = 0x20
    return out, at


def grams(b: np.ndarray) -> np.ndarray:
    """Each run of Q = 8 bytes as an integer."""
    if len(b) < Q:
        return np.zeros(0, np.uint64)
    x = b.astype(np.uint64)
    for width in (1, 2, 4):
        x = (x[:-width] << np.uint64(8 * width)) | x[width:]
    return x


def _runs(b: np.ndarray, size: int) -> np.ndarray:
    """Each run of fewer than Q bytes as an integer."""
    n = max(0, len(b) - size + 1)
    x = np.zeros(n, np.uint64)
    for k in range(size):
        x = (x << np.uint64(8)) | b[k : k + n]
    return x


def _slot(g: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BLOOM_BITS)


class GramIndex:
    """The q-grams of benchmark items, in classes of items with like windows."""

    def __init__(self, items: list[tuple[int, str]], budget: Budget):
        self.ids, self.text, self.plan = [], [], []
        self.short: dict[int, dict[int, list[int]]] = {}  # by length, by bytes: item ids
        for i, t in items:
            b, _ = normal(np.frombuffer(t.strip(WHITE).encode(), dtype=np.uint8))
            if 0 < len(b) < Q:
                self.short.setdefault(len(b), {}).setdefault(int(_runs(b, len(b))[0]), []).append(i)
            if len(b) >= Q:
                self.ids.append(i)
                self.text.append(b)
                self.plan.append(budget.of(len(b)))
        per = [grams(b) for b in self.text]
        g = np.concatenate(per) if per else np.zeros(0, np.uint64)
        order = np.argsort(g, kind="stable")
        self.item = np.repeat(np.arange(len(per)), [len(x) for x in per])[order]
        self.place = np.concatenate([np.arange(len(x)) for x in per])[order] if per else np.zeros(0, np.int64)
        self.gram, first = np.unique(g[order], return_index=True)
        self.bounds = np.append(first, len(g))
        # windows differ by less than a quarter inside a class
        self.classes: list[tuple[int, int, np.ndarray]] = []
        kind = [(int(np.log2(w) * 3), k == 0) for w, k, _ in self.plan]
        for c in sorted(set(kind)):
            mine = [x for x, y in zip(range(len(kind)), kind, strict=True) if y == c]
            table = np.zeros(1 << BLOOM_BITS, dtype=bool)
            for m in mine:
                table[_slot(per[m])] = True
            self.classes.append((max(self.plan[m][0] + self.plan[m][1] for m in mine), min(self.plan[m][2] for m in mine), table))

    def stretches(self, g: np.ndarray) -> np.ndarray:
        """Which q-grams of a text lie in a stretch with enough hits."""
        slot, near = _slot(g), np.zeros(len(g), dtype=bool)
        for span, need, table in self.classes:
            hit = table[slot]
            sums = np.concatenate([np.zeros(1, np.int32), np.cumsum(hit, dtype=np.int32)])
            width = min(span - Q + 1, len(g))
            rich = np.flatnonzero(sums[width:] - sums[:-width] >= need)
            if len(rich):
                mark = np.zeros(len(g) + 1, dtype=np.int32)
                np.add.at(mark, rich, 1)
                np.add.at(mark, rich + width, -1)
                near |= (np.cumsum(mark[:-1]) > 0) & hit
        return near

    def leaks(self, data: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item id, edits, first byte, end byte) of the items of which a window leaks into a text, one each, by item."""
        b, origin = normal(data)
        exact = list(self._short_leaks(b, origin))
        g = grams(b)
        if not len(g) or not len(self.gram):
            return sorted(exact)
        at = np.flatnonzero(self.stretches(g))
        found: dict[int, tuple[int, int, int]] = {}
        reach = max(p[0] + p[1] for p in self.plan)
        while len(at):
            # stretches of bounded size, overlapping by the longest window
            n = max(int(np.searchsorted(at, at[0] + max(STRETCH, 2 * reach))), 1)
            self._stretch(b, origin, g, at[:n], found)
            if n == len(at):
                break
            m = int(np.searchsorted(at, at[n - 1] - reach))
            at = at[max(m, 1):]
        return sorted(exact + [(self.ids[i], *v) for i, v in found.items()])

    def _short_leaks(self, b: np.ndarray, origin: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """The items under Q bytes that occur between white space or ends, each at its first place."""
        border = np.concatenate([[True], b == 0x20, [True]])  # before byte p: border[p]
        for size, items in self.short.items():
            x = _runs(b, size)
            at = np.flatnonzero(np.isin(x, np.fromiter(items, np.uint64, len(items))) & border[: len(x)] & border[size + 1 : size + 1 + len(x)])
            values, first = np.unique(x[at], return_index=True)
            for v, p in zip(values, at[first], strict=True):
                for i in items[int(v)]:
                    yield i, 0, int(origin[p]), int(origin[p + size - 1]) + 1

    def _stretch(self, b, origin, g, at, found) -> None:
        where = np.minimum(np.searchsorted(self.gram, g[at]), len(self.gram) - 1)
        known = self.gram[where] == g[at]
        at, where = at[known], where[known]
        times = self.bounds[where + 1] - self.bounds[where]
        if not len(at):
            return
        pos = np.repeat(at, times)
        src = np.repeat(self.bounds[where] - np.cumsum(times) + times, times) + np.arange(times.sum())
        item, place = self.item[src], self.place[src]
        plan = np.array(self.plan)
        step = np.maximum(plan[item, 1], 1)
        diagonal = pos - place
        low = diagonal // step
        # a diagonal lies in two or three of the bands [s * step, s * step + 2 * step]
        band = np.concatenate([low, low - 1, (low - 2)[diagonal % step == 0]])
        item = np.concatenate([item, item, item[diagonal % step == 0]])
        place = np.concatenate([place, place, place[diagonal % step == 0]])
        order = np.lexsort((place, band, item))
        item, band, place = item[order], band[order], place[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (item[1:] != item[:-1]) | (band[1:] != band[:-1]) | (place[1:] != place[:-1])
        item, band, place = item[new], band[new], place[new]
        edge = np.flatnonzero(np.concatenate([[True], (item[1:] != item[:-1]) | (band[1:] != band[:-1]), [True]]))
        size = np.diff(edge)
        for a, n in zip(edge[:-1][size >= plan[item[edge[:-1]], 2]], size[size >= plan[item[edge[:-1]], 2]], strict=True):
            i = int(item[a])
            if i in found:
                continue
            w, k, need = self.plan[i]
            p = place[a : a + n]
            ok = np.flatnonzero(p[need - 1 :] - p[: n - need + 1] <= w - Q)
            if len(ok):
                lo = np.maximum(p[ok + need - 1] + Q - w, 0)
                hi = np.minimum(p[ok], len(self.text[i]) - w)
                starts = np.unique(np.concatenate([np.arange(x, y + 1) for x, y in zip(lo, hi, strict=True)]))
                hit = self._align(b, i, starts, int(band[a]) * max(k, 1), w, k)
                if hit:
                    edits, end = hit
                    first = max(0, min(end, len(b)) - w)
                    found[i] = (edits, int(origin[first]), int(origin[min(end, len(b)) - 1]) + 1)

    def _align(self, b: np.ndarray, i: int, starts: np.ndarray, diagonal: int, w: int, k: int) -> tuple[int, int] | None:
        """(edits, end in the text) of the first window that aligns within the band and the budget."""
        width = 2 * max(k, 1) + 1
        text = self.text[i]
        shift = np.arange(width)
        for c in range(0, len(starts), 64):
            s = starts[c : c + 64]
            at = s[:, None] + diagonal + np.arange(w + width)
            t = np.where((at >= 0) & (at < len(b)), b[np.clip(at, 0, len(b) - 1)], 0)
            d = np.zeros((len(s), width), dtype=np.int32)
            for r in range(w):
                x = d + (t[:, r : r + width] != text[s + r][:, None])
                x[:, :-1] = np.minimum(x[:, :-1], d[:, 1:] + 1)
                d = np.minimum.accumulate(x - shift, axis=1) + shift
            best = d.min(axis=1)
            if (best <= k).any():
                m = int(np.argmax(best <= k))
                return int(best[m]), int(s[m] + diagonal + w + d[m].argmin())
        return None


LEAKS = "array<struct<item_id: long, edits: int, first: long, end: long>>"


def _finder(index):
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int32()), ("first", pa.int64()), ("end", pa.int64())]))

    @F.arrow_udf(LEAKS)
    def find(text: pa.Array) -> pa.Array:
        data, off = tk.text_buffer(text)
        found = pa.array([[dict(zip(("item_id", "edits", "first", "end"), x, strict=True)) for x in index.value.leaks(data[a:b])] for a, b in zip(off[:-1], off[1:], strict=True)], type=kind)
        tk.release()
        return found

    return find


def leaks(docs: DataFrame, benchmark: DataFrame, budget: Budget = Budget(), text: str = "text") -> Iterator[Column]:
    """Columns for ``docs``, one a pass: the benchmark items (item_id, text) that leak into a row's text, each with the edits and the bytes of one place."""
    spark = docs.sparkSession
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // PART_BYTES))
    for first in range(0, parts, GROUP):
        found: list[Column] = []
        for k in range(first, min(parts, first + GROUP)):
            # about PART_BYTES of text
            rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).distinct().orderBy("item_id", "text").collect()
            index = spark.sparkContext.broadcast(GramIndex([(r["item_id"], r["text"]) for r in rows], budget))
            found.append(_finder(index)(F.coalesce(F.col(text).cast("string"), F.lit(""))))
        yield F.concat(*found) if len(found) > 1 else found[0]


def contaminated(docs: DataFrame, benchmark: DataFrame, budget: Budget = Budget()) -> DataFrame:
    """(doc_id, item_id, edits, first, end): a row for each document and benchmark item that leaks into it; first and end are bytes of the text.

    Null and blank texts hold no leak, null items are left out; items that
    share an id or a text are each looked for. Repeated rows give repeated rows.
    """
    passes = [docs.select("doc_id", F.explode(found).alias("l")).select("doc_id", "l.*") for found in leaks(docs, benchmark, budget)]
    return reduce(DataFrame.unionAll, passes)


def clean(docs: DataFrame, benchmark: DataFrame, budget: Budget = Budget()) -> DataFrame:
    """The rows of ``docs`` into which no benchmark item leaks, with their columns."""
    for n, found in enumerate(leaks(docs, benchmark, budget)):
        # a pass of its own for each group, so that a worker holds one group's index
        docs = (materialize(docs, "clean") if n else docs).where(F.size(found) == 0)
    return docs
