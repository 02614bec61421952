"""Vectorised words and shingles against plain Python."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from apptflow.llm import words as W


def _texts():
    rng = random.Random(5)
    alphabet = ["a", "B", "é", " ", "\n", "\t", "x1", "-", "\x0b", "\x1f", "\x00", "日本", "ſ", "|"]
    out = ["", None, "   ", "one", "one two", "a" * 3000, "b" * 3000 + " " + "a" * 3000, "A b C d A b C d"]
    for _ in range(200):
        out.append("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))))
    return out


def _lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


@pytest.mark.parametrize("table,pattern", [(W.SPACE_WORDS, r"[^\x20\x09-\x0D]+"),
                                           (W.ALNUM_WORDS, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")])
@pytest.mark.parametrize("block", [7, 64, 1 << 20])
def test_words_equal_regex(table, pattern, block):
    texts = _texts()
    arr = pa.array([None, "skip"] + texts).slice(2)
    buf, off = W.text_buffers(arr)
    h, s, e, first = W.words(buf, off, table, block=block)
    seen = {}
    for i, t in enumerate(texts):
        want = re.findall(pattern, _lower(t or ""))
        got = [bytes(buf[a:b]).decode("utf-8") for a, b in zip(s[first[i]:first[i + 1]], e[first[i]:first[i + 1]])]
        assert [_lower(x) for x in got] == want
        for w, x in zip(want, h[first[i]:first[i + 1]].tolist()):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_long_words_differ_by_block_order():
    a, b = "a" * 1024 + "b" * 1024, "b" * 1024 + "a" * 1024
    buf, off = W.text_buffers(pa.array([a, b]))
    h = W.words(buf, off, W.SPACE_WORDS)[0]
    assert h[0] != h[1]


@pytest.mark.parametrize("k", [1, 2, 4, 5])
def test_shingle_sets(k):
    texts = _texts()
    buf, off = W.text_buffers(pa.array(texts))
    h, _, _, first = W.words(buf, off, W.SPACE_WORDS)
    sets, at = W.shingle_sets(h, first, k)
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", _lower(t or ""))
        want = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
        mine = sets[at[i]:at[i + 1]]
        assert len(mine) == len(want)
        assert (np.diff(mine.astype(object)) > 0).all()


def test_chunk_rows_cover():
    off = np.array([0, 5, 5, 30, 31, 40])
    got = list(W.chunk_rows(off, 10))
    assert [a for a, _ in got] == [0] + [b for _, b in got[:-1]] and got[-1][1] == 5
