"""Quality classifier: sums against numpy, held-out accuracy, odd inputs."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from apptflow.llm import quality as Q
from apptflow.llm.words import text_buffers


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(500)]
    docs, labels = [], []
    for d in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randint(10, 200))]
        good = rng.random() < .7
        if good:
            t = ". ".join(" ".join(w[i:i + 9]).capitalize() for i in range(0, len(w), 9)) + "."
        else:
            t = rng.choice([" | ".join(w), " ".join(x.upper() + "!!" for x in w), " ".join([w[0]] * len(w)),
                            "\n".join(["a b c"] * len(w))])
        docs.append((d, t))
        if rng.random() < .8:
            labels.append((d, int(good)))
    return docs, labels


def test_held_out_accuracy_and_columns(spark):
    docs, labels = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("'l' as lang", "doc_id", "text", "1 as quality", "2 as score")
    lab = spark.createDataFrame(labels + [(1, None), (10**6, 1)], "doc_id long, quality int")
    rows = Q.classify(df, lab).collect()
    assert len(rows) == len(docs) and rows[0].__fields__ == ["doc_id", "held_out", "score", "predicted"]
    truth = dict(labels)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)


def test_labels_of_the_held_out_fold_change_nothing(spark):
    docs, labels = corpus(200, 2)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    flipped = [(d, 1 - q if zlib.crc32(str(d).encode()) % 4 == 2 else q) for d, q in labels]
    a, b = ({r.doc_id: r.score for r in Q.classify(df, spark.createDataFrame(x, "doc_id long, quality int")).collect()}
            for x in (labels, flipped))
    assert a == pytest.approx(b, abs=1e-9)


def test_model_equals_numpy(spark):
    docs, labels = corpus(150, 3)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    m = Q.learn(Q.document_statistics(df, "doc_id", "text"), spark.createDataFrame(labels, "doc_id long, quality int"),
                "doc_id", "quality", 0.2, 0.1)
    x = Q.statistics(*text_buffers(pa.array([t for _, t in docs])))
    y = dict(labels)
    for k in (0, 1):
        z = x[[d for d, _ in docs if y.get(d) == k]]
        assert np.allclose(m.mean[k], z.mean(axis=0))
    full = m.factor[1] @ m.factor[1].T
    c = [np.cov(x[[d for d, _ in docs if y.get(d) == k]].T, bias=True) for k in (0, 1)]
    n = [sum(1 for q in y.values() if q == k) for k in (0, 1)]
    pooled = (n[0] * c[0] + n[1] * c[1]) / sum(n)
    assert np.allclose(full, 0.9 * (0.8 * c[1] + 0.2 * pooled) + 0.1 * np.diag(np.maximum(np.diag(pooled), 1e-6)))


def test_statistics_follow_their_own_text_only():
    texts = ["", "One two.", None, "a | b | c", "日本語 テキスト", "x" * 5000, "", "l\nl\nl"]
    x = Q.statistics(*text_buffers(pa.array(texts)))
    assert np.isfinite(x).all()
    for i, t in enumerate(texts):
        assert np.allclose(x[i], Q.statistics(*text_buffers(pa.array([t], pa.string())))[0])


def test_odd_rows(spark):
    docs, labels = corpus(100, 4)
    docs += [(None, "who am I"), (3, None), (3, ""), (5, docs[5][1])]
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    rows = Q.classify(spark.createDataFrame(docs, "doc_id long, text string"), lab).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows)
    assert [r.held_out for r in rows if r.doc_id is None] == [False]
    none = spark.createDataFrame([], "doc_id long, text string")
    assert Q.classify(none, lab).count() == 0
    with pytest.raises(ValueError):
        Q.classify(spark.createDataFrame(docs, "doc_id long, text string"), lab.limit(0))
