import re

import numpy as np
import pyarrow as pa
import pytest

from wardflow.llm import words as W

TEXTS = ["", "a b a b a", "x", None, "Hello  hello\tÉ é", "  ", "z" * 50 + " q " * 7, "a\nb", "\u3000 ü\x0bü", "q" * 200]


@pytest.mark.parametrize("segment", [8, 64, 1 << 20])
@pytest.mark.parametrize("size", [1, 2, 5])
def test_words_and_shingles_match_python(monkeypatch, segment, size):
    monkeypatch.setattr(W, "SEGMENT", segment)
    data, offsets = W.text_buffer(pa.array(TEXTS))
    w = W.words(data, offsets, W.not_blank())
    sets, first = W.shingle_sets(w, size)
    by_word = {}
    for r, t in enumerate(TEXTS):
        want = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        span = slice(w.first[r], w.first[r + 1])
        assert [bytes(data[s:e]).decode() for s, e in zip(w.start[span], w.end[span])] == want
        low = ["".join(c.lower() if c.isascii() else c for c in x) for x in want]
        for x, h in zip(low, w.hash[span].tolist()):
            assert by_word.setdefault(x, h) == h
        shingles = {tuple(low[k: k + size]) for k in range(len(low) - size + 1)} if len(low) >= size else {tuple(low)} if low else set()
        assert first[r + 1] - first[r] == len(shingles)
    assert len(set(by_word.values())) == len(by_word)


def test_row_groups_cover_all_rows():
    offsets = np.array([0, 5, 5, 100, 101, 101])
    got = list(W.row_groups(offsets, 10))
    assert [i for i, _ in got] == [0] + [j for _, j in got[:-1]] and got[-1][1] == 5
