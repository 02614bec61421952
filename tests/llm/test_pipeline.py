"""Every stage of the corpus pipeline against a brute-force version."""

import re

import pytest

import corpus_pipeline as C
from apptflow.llm import quality

from . import test_bpe as bpe_brute
from . import test_decontam as decontam_brute
from . import test_jaccard as jaccard_brute
from . import test_line_dedup as line_brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The documents and what each stage made of them, as dictionaries by id."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out, names = [docs], docs.columns
    for name, stage in C.STAGES:
        got = stage(spark, out[-1], SF)
        if name != "bpe":
            assert got.columns == names and dict(got.dtypes) == dict(docs.dtypes)
        got.write.parquet(f"{folder}/{name}")
        out.append(spark.read.parquet(f"{folder}/{name}"))
    return [{r.doc_id: r for r in d.collect()} for d in out]


def test_quality(spark, stages):
    got = quality.classify(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    assert set(stages[1]) == {r.doc_id for r in got.collect() if r.predicted == 1}
    assert all(stages[0][d] == r for d, r in stages[1].items())


def test_line_dedup(stages):
    """Whole repeated runs go, as the stage asks for."""
    rows = sorted((d, r.text) for d, r in stages[1].items())
    want = {d: t for d, t, n in line_brute.whole(rows, 50) if not n or t.strip(" \t\n\x0b\x0c\r")}
    assert {d: r.text for d, r in stages[2].items()} == want
    assert all(r.n_chars == len(r.text) for r in stages[2].values())
    assert any(len(stages[1][d].text) > len(t) for d, t in want.items())


def test_near_duplicates(stages):
    rows = sorted((d, r.text) for d, r in stages[2].items())
    want = {d for d, _, c in jaccard_brute.brute(rows, 5, 80, 100) if d == c}
    assert set(stages[3]) == want and all(stages[2][d] == r for d, r in stages[3].items())


def test_decontamination(spark, stages):
    rows = sorted((d, r.text) for d, r in stages[3].items())
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    windows = set()
    for _, t in items:
        w = re.findall(decontam_brute.WORD, decontam_brute.low(t))
        windows |= {tuple(w[i:i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    def clean(t):
        w = re.findall(decontam_brute.WORD, decontam_brute.low(t))
        return not any(tuple(w[i:i + n]) in windows for n in {len(x) for x in windows} for i in range(len(w) - n + 1))
    want = {d for d, t in rows if clean(t)}
    assert set(stages[4]) == want and len(want) < len(rows)


def test_bpe(stages):
    ids = sorted(stages[4])
    want, _ = bpe_brute.library([stages[4][d].text for d in ids])
    assert {d: r.tokens for d, r in stages[5].items()} == dict(zip(ids, want))
    assert all(r.n_tokens == len(r.tokens) for r in stages[5].values())


def test_run(spark, stages):
    assert sorted(r.doc_id for r in C.run(spark, SF).collect()) == sorted(stages[5])


def test_odd_rows_and_extra_columns(spark):
    """Nulls in every column, repeated rows and clashing names pass every stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", "1 as key", "2 as c", "'x' as runs", "3 as __x")
    odd = spark.createDataFrame([(None, None, None, None, None, 1, 2, "x", 3), (5, None, "en", "s", 0, 1, 2, "x", 3),
                                 (None, "same text", "en", "s", 9, 1, 2, "x", 3), (None, "same text", "en", "s", 9, 1, 2, "x", 3),
                                 (7, "", "en", None, None, 1, 2, "x", 3)], docs.schema)
    frame = docs.unionByName(odd)
    for name, stage in C.STAGES[:-1]:
        got = stage(spark, frame, SF)
        assert got.columns == frame.columns, name
        assert got.count() <= frame.count()
        empty = stage(spark, frame.limit(0), SF)
        assert empty.columns == frame.columns and empty.count() == 0
    same = C.near_duplicate_stage(spark, odd, SF)
    assert same.where("text = 'same text'").count() == 1


def test_near_duplicates_with_clashing_names(spark):
    rows = [(1, "one two three four five six", "a", 7, 1, 2), (1, "one two three four five six", "b", 7, 3, 4),
            (2, "one two three four five six", "c", 7, 5, 6), (3, "others", "d", 7, 7, 8)]
    names = "doc_id long, text string, `a b` string, __key int, __row int, place int"
    frame = spark.createDataFrame(rows, names)
    got = [C.jaccard.drop_near_duplicates(x, k=5, num=80, den=100).collect() for x in (frame, frame.repartition(3), frame.orderBy("place", ascending=False))]
    assert got[0] and sorted(got[0]) == sorted(got[1]) == sorted(got[2])
    assert [r.doc_id for r in sorted(got[0])] == [1, 3] and all(set(r.asDict()) == {"doc_id", "text", "a b", "__key", "__row", "place"} for r in got[0])
