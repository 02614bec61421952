"""Elias-Fano against numpy; the language model against plain dictionaries."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from apptflow.llm import elias_fano as E
from apptflow.llm import ngram_lm as M


@pytest.mark.parametrize("n,universe,repeat", [(0, 10, False), (1, 1, False), (5, 7, True), (1000, 1 << 60, False),
                                               (70_000, 80_000, True), (3000, 1 << 20, True), (20, 1 << 63, False)])
def test_elias_fano(n, universe, repeat):
    rng = np.random.RandomState(n)
    v = np.sort(np.minimum(rng.randint(0, min(universe, 1 << 62), n).astype(np.uint64), universe - 1))
    if not repeat:
        v = np.unique(v)
    s = E.EliasFano(E.encode(v, universe))
    i = rng.permutation(len(v))
    assert (s.get(i) == v[i]).all()
    x = np.concatenate([v, rng.randint(0, min(universe, 1 << 62), 500).astype(np.uint64), [np.uint64(0), np.uint64(universe - 1)]])
    at, ok = s.search(x)
    assert (at == np.searchsorted(v, x)).all()
    assert (ok == np.isin(x, v)).all()


def test_elias_fano_size():
    v = np.unique(np.random.RandomState(1).randint(0, 1 << 40, 100_000).astype(np.uint64))
    size = sum(x.nbytes for x in E.encode(v, 1 << 40).values())
    assert size * 8 / len(v) < 2 + math.log2((1 << 40) / len(v)) + 2


def test_quantised_order_and_error():
    x = np.random.RandomState(2).randn(5000)
    code, book = M.quantised(x)
    assert np.abs(book[code] - x).max() < 2 and np.abs(book[code] - x).mean() < 0.01


def tokens(t):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def corpus(seed=1, n=300):
    rng = random.Random(seed)
    v = [f"w{i}" for i in range(40)] + ["É", "THE", "a|b"]
    rows = []
    for d in range(n):
        w = [rng.choice(v)]
        for _ in range(rng.randint(0, 60)):
            w.append(v[(zlib.crc32(w[-1].encode()) * 7 + rng.randint(0, 3)) % len(v)] if rng.random() < .8 else rng.choice(v + [f"rare{rng.random()}"]))
        rows.append((d, rng.choice([" ", "\n", "\t "]).join(w)))
    rows += [(n, None), (n + 1, ""), (n + 2, "never seen before at all"), (None, "w1 w2 w3"), (3, rows[3][1]), (n + 3, "w1 " * 3000)]
    return rows


class Plain:
    """The model in dictionaries, not quantised."""

    def __init__(self, texts, order, least):
        self.order, self.c = order, [Counter() for _ in range(3)]
        for t in texts:
            w = ["<s>", *tokens(t), "</s>"]
            for k in range(3):
                self.c[k].update(tuple(w[i:i + k + 1]) for i in range(len(w) - k))
        self.N = sum(c for g, c in self.c[0].items() if g != ("<s>",))
        self.V = sum(1 for g in self.c[0] if g != ("<s>",))
        self.kept = [None] + [{g: c for g, c in self.c[k].items() if c >= least} for k in (1, 2)]
        self.mass = [defaultdict(float) for _ in range(3)]
        for k in (1, 2):
            for g, c in self.kept[k].items():
                self.mass[k][g[:-1]] += c - M.DISCOUNT

    def uni(self, w):
        return (self.c[0][w,] + .5) / (self.N + .5 * (self.V + 1))

    def prob(self, h, w):
        if not h:
            return self.uni(w)
        k = len(h)
        if k == 1 and h not in self.c[0] or k == 2 and h not in self.kept[1]:
            return self.prob(h[1:], w)
        total = self.c[k - 1][h]
        back = max(1 - self.mass[k][h] / total, 1e-9)
        own = max(self.kept[k].get((*h, w), 0) - M.DISCOUNT, 0) / total
        return own + back * self.prob(h[1:], w)

    def score(self, t):
        w = ["<s>", *tokens(t), "</s>"]
        return sum(math.log10(self.prob(tuple(w[max(0, i - self.order + 1):i]), w[i])) for i in range(1, len(w)))


@pytest.mark.parametrize("order,least", [(1, 2), (2, 2), (3, 2), (3, 3)])
def test_equals_plain_model(spark, order, least):
    rows = corpus()
    held = {d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in rows}
    plain = Plain([t for d, t in rows if not held[d]], order, least)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).selectExpr("'x' as id", "doc_id", "text", "1 as score")
    got = M.lm_scores(df, order=order, min_count=least).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for d, t in rows:
        by[d].append(t)
    for r in got:
        t = by[r.doc_id][0]
        w = [*tokens(t), "</s>"]
        assert r.held_out == held[r.doc_id] and r.train_tokens == plain.N and r.n_tokens == len(w)
        assert r.n_known == sum(plain.c[0][x,] > 0 for x in w)
        assert r.base_score == pytest.approx(sum(math.log10(plain.uni(x)) for x in w), rel=1e-9)
        assert r.score == pytest.approx(plain.score(t), abs=0.02 * len(w) + 0.02)
    seen = [r for r in got if r.held_out and r.n_tokens > 5]
    if order > 1:
        assert sum(r.score for r in seen) > sum(r.base_score for r in seen)


def test_empty_and_no_training_text(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert M.lm_scores(none).count() == 0
    d = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    r = M.lm_scores(spark.createDataFrame([(d, "only held out")], "doc_id long, text string")).first()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (4, 0, 0) and r.score == r.base_score == pytest.approx(0.0)


def test_probabilities_sum_to_one():
    rows = corpus(3, 80)
    plain = Plain([t for _, t in rows], 3, 2)
    words = [g[0] for g in plain.c[0] if g != ("<s>",)]
    for h in [(), ("w1",), ("w1", "w7"), ("<s>",), ("nope",)]:
        total = sum(plain.prob(h, w) for w in words) + plain.prob(h, "unseen")
        assert total == pytest.approx(1, abs=1e-6)


def test_query_counts_what_occurs_once(spark, tmp_path):
    from apptflow.llm import queries
    rows = corpus(5, 120)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    by = {d: t for d, t in rows if d is not None and d != 3}
    train = [t for d, t in rows if d is None or zlib.crc32(str(d).encode()) % 5 != 1]
    every, twice = Plain(train, 3, 1), Plain(train, 3, 2)
    off = [[], []]
    for r in queries.op6_lm_scoring(spark, str(tmp_path)).collect():
        if r.doc_id in by:
            t, n = by[r.doc_id], r.n_tokens
            assert r.score == pytest.approx(every.score(t), abs=0.02 * n + 0.02)
            off[0].append(abs(r.score - every.score(t)) / n)
            off[1].append(abs(r.score - twice.score(t)) / n)
    assert sum(off[0]) * 5 < sum(off[1])


def test_blocks_pack_sorted_keys_and_guard_their_size():
    keys = np.array([0, 5, 6, 1 << 40, (1 << 64) - 1], np.uint64)
    counts = np.array([1, 2, 300, 1, 7])
    t = pa.Table.from_batches([M._block(3, keys, counts), M._block(3, keys[1:3], counts[:2]), M._block(3, keys[:0], counts[:0])])
    k, c = M._merged(t)
    assert k.tolist() == keys.tolist() and c.tolist() == [1, 3, 302, 1, 7]
    M._fits(1 << 64, "keys")
    with pytest.raises(OverflowError):
        M._fits((1 << 64) + 1, "keys")
