"""Line dedup against a plain search for repeated windows."""

import random

import numpy as np
import pytest

from apptflow.llm import line_dedup as L


def brute(rows, min_words):
    """rows: (id, text) in order of id; what is left of each text."""
    seen, out = {}, []
    docs = []
    for d, t in rows:
        lines = (t or "").split("\n")
        real = [i for i, x in enumerate(lines) if x.strip(L._BLANK)]
        docs.append((d, t, lines, real, [tuple("".join(c.lower() if "A" <= c <= "Z" else c for c in lines[i]).split())
                                         for i in real]))
    for k, (d, t, lines, real, w) in enumerate(docs):
        gone = set()
        for a in range(len(w)):
            e, n = a, len(w[a])
            while n < min_words and e + 1 < len(w):
                e += 1
                n += len(w[e])
            if n < min_words:
                continue
            win = tuple(w[a:e + 1])
            if win in seen:
                k0, a0 = seen[win]
                gone.update(range(max(a, a0 + len(win)) if k0 == k else a, e + 1))
            else:
                seen[win] = (k, a)
        drop = {real[i] for i in gone}
        for i in sorted(gone):
            if i + 1 in gone:
                drop.update(range(real[i], real[i + 1]))
        out.append((d, None if t is None else "\n".join(x for i, x in enumerate(lines) if i not in drop), len(gone)))
    return out


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(50)]
    pool = [" ".join(rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 5, 12]))) for _ in range(25)]
    rows = []
    for d in range(60):
        lines = []
        for _ in range(rng.randint(0, 25)):
            r = rng.random()
            if r < .1:
                lines.append(rng.choice(["", "  ", "\t"]))
            elif r < .3:
                i = rng.randrange(20)
                lines += pool[i:i + rng.randint(1, 6)]
            elif r < .4:
                lines += ["same again"] * rng.randint(1, 12)
            else:
                lines.append(" ".join(rng.choice(vocab) for _ in range(rng.choice([1, 4, 9]))))
        rows.append((d, "\n".join(lines)))
    rows[7] = (7, None)
    rows[9] = (9, rows[8][1])
    rows[11] = (11, rows[8][1].upper())
    rows[13] = (13, "long " * 4000 + "\n" + "x" * 9000)
    rows[14] = rows[13][:0] + (14, rows[13][1])
    return rows


@pytest.mark.parametrize("seed,words,gram", [(1, 10, 5), (2, 6, 6), (3, 12, 3), (4, 1, 1)])
def test_equals_brute_force(spark, seed, words, gram):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3) \
        .selectExpr("doc_id as key", "text", "doc_id", "1 as runs", "9 as lines_removed", "2 as `a b`")
    out = L.line_dedup(df, min_words=words, gram_words=gram)
    assert out.columns == ["key", "text", "doc_id", "runs", "a b", "lines_removed"]
    got = sorted((r["doc_id"], r["text"], r["lines_removed"]) for r in out.collect() if r["text"] is not None)
    assert got == [r for r in brute(rows, words) if r[1] is not None]


def test_null_ids_and_repeated_rows(spark):
    line = " ".join(f"t{i}" for i in range(60))
    rows = [(None, line), (5, line), (5, line), (6, "a\n" + line + "\nb"), (7, "")]
    got = L.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in got) == sorted(
        [("None", ""), ("5", line), ("5", line), ("6", "a\nb"), ("7", "")])
    assert L.line_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_winnowing_guarantee():
    """Equal windows select equal fingerprints, wherever they stand."""
    rng = np.random.RandomState(3)
    run_h, run_n = rng.randint(1, 1 << 60, 12).astype(np.uint64), rng.randint(1, 9, 12)
    got = []
    for pre, post in ((0, 0), (5, 3), (1, 30)):
        h = np.concatenate([rng.randint(1, 1 << 60, pre).astype(np.uint64), run_h, rng.randint(1, 1 << 60, post).astype(np.uint64)])
        n = np.concatenate([rng.randint(1, 9, pre), run_n, rng.randint(1, 9, post)])
        a, e, fp, wh = L.windows_of(h, n, np.zeros(len(h), np.int64), 20, 8)
        inside = (a >= pre) & (e < pre + 12)
        got.append(list(zip(a[inside] - pre, e[inside] - pre, fp[inside], wh[inside])))
    assert got[0] and got[0] == got[1] == got[2]


def whole(rows, min_words):
    """What is left of each text without later repeats of any run of lines."""
    seen, out = {}, []
    for k, (d, t) in enumerate(rows):
        lines = (t or "").split("\n")
        real = [i for i, x in enumerate(lines) if x.strip(L._BLANK)]
        w = [tuple("".join(c.lower() if "A" <= c <= "Z" else c for c in lines[i]).split()) for i in real]
        gone = set()
        for a in range(len(w)):
            n = 0
            for e in range(a, len(w)):
                n += len(w[e])
                if n >= min_words:
                    k0, a0 = seen.setdefault(tuple(w[a:e + 1]), (k, a))
                    if (k0, a0) != (k, a):
                        gone.update(range(max(a, a0 + e + 1 - a) if k0 == k else a, e + 1))
        drop = {real[i] for i in gone}
        for i in gone:
            if i + 1 in gone:
                drop.update(range(real[i], real[i + 1]))
        out.append((d, None if t is None else "\n".join(x for i, x in enumerate(lines) if i not in drop), len(gone)))
    return out


@pytest.mark.parametrize("seed,words,gram", [(1, 10, 5), (5, 12, 3)])
def test_whole_runs_equal_brute_force(spark, seed, words, gram):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r["doc_id"], r["text"], r["lines_removed"])
                 for r in L.line_dedup(df, min_words=words, gram_words=gram, extend=True).collect() if r["text"] is not None)
    want = [r for r in whole(rows, words) if r[1] is not None]
    assert got == want and want != [r for r in brute(rows, words) if r[1] is not None]


def test_query_and_stage_leave_no_tail(spark, tmp_path):
    import corpus_pipeline
    from apptflow.llm import queries
    tail = "\n".join(" ".join(f"{p}{i}" for i in range(n)) for p, n in (("a", 60), ("b", 30)))
    df = spark.createDataFrame([(1, tail, 1), (2, tail, 1)], "doc_id long, text string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.text for r in queries.op9_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: tail, 2: ""}
    assert [r.doc_id for r in corpus_pipeline.line_dedup_stage(spark, df, str(tmp_path)).collect()] == [1]
