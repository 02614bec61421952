"""Packing against the tokenizers library and by the properties of its result."""

import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from apptflow.llm import packing as P
from apptflow.llm import queries as Q

SF = "/root/testdata/sf0.001"
VOCAB = Q.vocabulary("byte_bpe_50k.json")


@pytest.mark.parametrize("dims,bits", [(2, 1), (2, 5), (3, 3), (4, 2), (4, 3)])
def test_the_curve_visits_every_cell_by_single_steps(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    key = P.hilbert_keys(cells, bits)
    assert sorted(key) == list(range(1 << dims * bits))
    assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def library(texts):
    t = Tokenizer.from_file(VOCAB)
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


ODD = ["", " ", "\n\n  \t", "I'll we've  IT'S", "<|endoftext|>", "a<|endoftext|><|endoftext|>b <|endoftext", "ü" * 300, "漢字かな 123456",
       "a" * 20_000, "\x00\x01 ​\u0085", "x" * 3 + " " * 70 + "y", "é퟿🙂👩‍👩‍👧", "<|startoftext|>"]


def test_ids_are_those_of_the_library(spark):
    texts = ODD + [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    encode = P.encoder(VOCAB)
    assert P._as_ranks(VOCAB) is not None and P._as_ranks(Q.vocabulary("word_bpe_49k.json")) is None
    assert [list(encode(t)) for t in texts] == library(texts)


def test_other_vocabularies_go_through_the_library():
    path = Q.vocabulary("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    t.no_truncation(), t.no_padding()
    assert list(P.encoder(path)("Some words, in a row")) == t.encode("Some words, in a row", add_special_tokens=False).ids


def check(pieces, docs, length=2048, end_id=1):
    """Every contract of the pieces: (id, start, length, crc, doc_tokens, sequence, offset)."""
    want = {}
    for (d, t), ids in zip(docs, library([t or "" for _, t in docs])):
        want.setdefault(d, []).append(np.array([*ids, end_id], "<u4"))
    sequences = {}
    for p in pieces:
        sequences.setdefault(p[5], []).append(p)
    fills = []
    for s in sequences.values():
        s.sort(key=lambda p: p[6])
        at = 0
        for p in s:
            assert p[6] == at and p[2] > 0
            at += p[2]
        fills.append(at)
    assert all(f == length or (f < length and f & (f - 1) == 0) for f in fills)
    assert sum(fills) == sum(len(x) for v in want.values() for x in v)
    got = {}
    for p in sorted(pieces, key=lambda p: (p[0] is not None, p[0] or 0, p[4], p[1])):
        got.setdefault(p[0], []).append(p)
    for d, texts in want.items():
        if len(texts) == 1:
            at = 0
            for p in got[d]:
                assert p[1] == at and p[4] == len(texts[0]) and p[3] == zlib.crc32(texts[0][at:at + p[2]].tobytes())
                at += p[2]
            assert at == len(texts[0])
        else:
            assert sum(p[2] for p in got[d]) == sum(map(len, texts))
    assert set(got) == set(want)
    return sequences


def test_given_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows = Q.op12_packing(spark, SF).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset").collect()
    seqs = check([tuple(r) for r in rows], docs)
    assert sum(sum(p[2] for p in s) < 2048 for s in seqs.values()) <= 11 * 8


def test_odd_rows(spark):
    docs = [(i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (50, None), (51, "same text"), (51, "same text")]
    docs += [(100 + i, "one text a third of all rows holds") for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as key", "2 as row", "3 as id").repartition(3)
    got = P.pack_documents(df, VOCAB, length=64, parts=5)
    got = got.select("doc_id", "start", "length", F.crc32("ids"), "doc_tokens", "sequence_id", "offset").collect()
    check([tuple(r) for r in got], docs, 64)
    copies = {r.sequence_id >> 40 for r in got if (r.doc_id or 0) >= 100}
    assert len(copies) > 1                     # copies are spread over tasks
    empty = P.pack_documents(df.limit(0), VOCAB)
    assert empty.count() == 0 and empty.columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]


def test_neighbours_are_alike(spark):
    """Documents next to each other on the curve share more words than any two do."""
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    texts = [t for t in texts if t and len(t.split()) > 50]
    key = P.curve_keys(pa.array(texts))
    bags = [set(t.lower().split()) for t in texts]

    def alike(a, b):
        return len(bags[a] & bags[b]) / len(bags[a] | bags[b])
    order = np.argsort(key, kind="stable")
    near = np.mean([alike(a, b) for a, b in zip(order, order[1:])])
    far = np.random.default_rng(1).permutation(len(texts))
    assert near > 1.5 * np.mean([alike(a, b) for a, b in zip(far, far[1:])])


def test_packer_cuts_the_rest_into_powers_of_two():
    p = P.Packer(16)
    got = [*p.add("a", np.arange(20)), *p.add("b", np.arange(3)), *p.end()]
    assert [(d, s, len(i), q, o) for d, s, i, _, q, o in got] == [
        ("a", 0, 16, 0, 0), ("a", 16, 4, 1, 0), ("b", 0, 2, 2, 0), ("b", 2, 1, 3, 0)]
    assert list(P.Packer(16).end()) == [] and P.powers(13) == [8, 4, 1]
