"""Jaccard join against all pairs."""

import random
import re

import numpy as np
import pytest

from apptflow.llm import jaccard as J
from apptflow.llm.components import connected_components


def brute(rows, k, num, den):
    def sets(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")))
        if len(w) >= k:
            return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
        return frozenset([tuple(w)]) if w else frozenset()
    s = [sets(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j]:
                both = len(s[i] & s[j])
                if den * both >= num * (len(s[i]) + len(s[j]) - both):
                    parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            r = find(i)
            least[r] = min(least.get(r, d), d)
    return sorted(((d, len(s[i]), (d if not s[i] else least.get(find(i)))) for i, (d, _) in enumerate(rows)),
                  key=lambda r: tuple((x is None, x or 0) for x in r))


def corpus(seed=3):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(vocab) for _ in range(30))
    rows, d = [], 100
    for g in range(12):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 8, 40, 150]))]
        for _ in range(rng.choice([1, 2, 6, 25])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                if len(w) > 5:
                    w[rng.randrange(len(w))] = rng.choice(vocab)
            if rng.random() < .3:
                w.append(passage)
            rows.append((d, " ".join(w)))
            d += rng.randint(1, 3)
    for i in range(40):                                   # many share a passage, none link
        rows.append((d + i, passage + " " + " ".join(rng.choice(vocab) for _ in range(60))))
    rows += [(1, None), (2, ""), (3, " \n\t"), (4, "One Two"), (5, "one\ttwo"), (6, "two one"), (None, "one two"),
             (None, "nobody else says this at all"), (4, "One Two"), (7, "z" * 5000), (8, "long " * 5000)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("k,num,den,tile", [(4, 85, 100, 4096), (5, 80, 100, 8), (1, 1, 1, 4096), (2, 50, 100, 16)])
def test_components_equal_brute_force(spark, k, num, den, tile):
    rows = corpus(k)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    df = df.selectExpr("doc_id", "text", "'x' as fp", "1 as n", "2 as component_id", "text as row")
    got = [tuple(r) for r in J.ngram_jaccard_join(df, k=k, num=num, den=den, tile=tile).collect()]
    assert sorted(got, key=lambda r: tuple((x is None, x or 0) for x in r)) == brute(rows, k, num, den)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    out = J.ngram_jaccard_join(df)
    assert out.columns == ["doc_id", "n_shingles", "component_id"] and out.count() == 0


def test_summed_minima_bounds_overlap():
    rng = np.random.RandomState(0)
    for _ in range(200):
        pool = rng.randint(0, 1 << 62, 400, dtype=np.int64).astype(np.uint64)
        a = np.unique(rng.choice(pool, rng.randint(1, 300)))
        b = np.unique(rng.choice(pool, rng.randint(1, 40)))
        assert J.summed_minima(J.count_vector(a).tobytes(), J.count_vector(b).tobytes()) >= len(np.intersect1d(a, b))


def test_tree_lets_every_link_through():
    rng = np.random.RandomState(1)
    base = rng.randint(0, 1 << 62, 5000, dtype=np.int64).astype(np.uint64)
    sets = []
    for _ in range(150):
        s = base[:rng.choice([20, 100, 110, 120])].copy()
        k = rng.randint(0, 10)
        s[rng.choice(len(s), k, replace=False)] = rng.randint(0, 1 << 62, k, dtype=np.int64).astype(np.uint64)
        sets.append(np.unique(s))
    n = np.array([len(s) for s in sets])
    label = np.arange(150) // 3
    got = {tuple(sorted(p)) for p in J.RTree(n, [J.count_vector(s).tobytes() for s in sets], label).self_join(85, 100)}
    for i in range(150):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if label[i] != label[j] and 100 * both >= 85 * (n[i] + n[j] - both):
                assert (j, i) in got


def test_tree_of_several_levels():
    """The descent yields just the pairs of leaves' points that the bounds let through."""
    rng = np.random.RandomState(2)
    bases = rng.randint(0, 1 << 62, (60, 200), dtype=np.int64).astype(np.uint64)
    sets = []
    for _ in range(2500):
        s = bases[rng.randint(60)][:rng.choice([60, 150, 190, 200])].copy()
        k = rng.randint(0, 25)
        s[rng.choice(len(s), k, replace=False)] = rng.randint(0, 1 << 62, k, dtype=np.int64).astype(np.uint64)
        sets.append(np.unique(s))
    n = np.array([len(s) for s in sets])
    vecs = [J.count_vector(s).tobytes() for s in sets]
    label = np.arange(len(sets)) // 2
    tree = J.RTree(n, vecs, label)
    assert len(tree.levels) >= 3 and len(tree.levels[-1][0]) == 1
    got = sorted(tuple(sorted(p)) for p in tree.self_join(85, 100))
    want = []
    for i in range(len(sets)):
        near = np.flatnonzero((85 * np.maximum(n[:i], n[i]) <= 100 * np.minimum(n[:i], n[i])) & (label[:i] != label[i]))
        need = J.need_overlap(n[near], n[i], 85, 100)
        want += [(int(j), i) for j, m in zip(near, need) if J.summed_minima(vecs[i], vecs[j]) >= m]
    assert got == sorted(want) and got


def test_links_that_only_the_tree_finds(spark):
    """With one anchor a block, chains of neighbours link through trees of small tiles."""
    rows, words = [], [f"w{i}" for i in range(400)]
    for i in range(120):
        rows.append((i, " ".join(words[i * 2:i * 2 + 100]) + " and a shared ending of every text here"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in J.ngram_jaccard_join(df, k=4, num=85, den=100, tile=8, anchors=1).collect()]
    assert sorted(got) == brute(rows, 4, 85, 100) and len({c for _, _, c in got}) == 1


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for u, v in edges:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    want = {x: find(x) for e in edges for x in e if e[0] != e[1]}
    assert got == want
