import random

import numpy as np
import pyarrow as pa

from simweave.llm import textkit as tk
from tests.llm.brute import LOWER, WORD


def test_words_equal_a_regex(monkeypatch):
    rng = random.Random(9)
    alphabet = "aAbBéß \t\n\x0b\x85 zZ"
    texts = [None if rng.random() < 0.1 else "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 5, 60, 3000]))) for _ in range(200)]
    for size in (64, 1 << 21):
        monkeypatch.setattr(tk, "BLOCK", size)
        hashes, off = tk.words(pa.array(texts, type=pa.string()))
        names = {}
        for t, a, b in zip(texts, off[:-1], off[1:], strict=True):
            want = [w.translate(LOWER) for w in WORD.findall(t or "")]
            assert len(want) == b - a
            for w, h in zip(want, hashes[a:b], strict=True):
                assert names.setdefault(w, h) == h
        assert len(set(names.values())) == len(names)


def test_sliced_column():
    column = pa.array(["a b", "c", "d e f"]).slice(1)
    hashes, off = tk.words(column)
    assert off.tolist() == [0, 1, 4] and len(hashes) == 4


def test_shingles():
    hashes, off = tk.words(pa.array(["a b a b", "", "a", "b a"]))
    s = list(tk.shingles(hashes, off, 2))
    assert [len(x) for x in s] == [2, 0, 1, 1] and s[3][0] in s[0] and s[2][0] not in s[0]
    assert all(np.array_equal(x, np.unique(x)) for x in s)
