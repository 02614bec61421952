"""Exact dedup against a dictionary; the filters themselves."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from apptflow.llm import exact_dedup as D


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000, 60_000])
def test_filter_holds_its_keys_and_few_others(n):
    rng = np.random.RandomState(n)
    keys = np.unique(rng.randint(-2**62, 2**62, n).astype(np.int64)).view(np.uint64)
    f = D.build_filter(keys)
    assert D.may_hold(keys, *f).all()
    other = rng.randint(-2**62, 2**62, 200_000).astype(np.int64).view(np.uint64)
    other = other[~np.isin(other, keys)]
    assert D.may_hold(other, *f).mean() < 3e-4
    if n >= 10_000:
        assert len(f[3]) * 16 < 20 * len(keys)


def test_equal_keys_are_refused():
    with pytest.raises(RuntimeError):
        D.build_filter(np.array([5, 5], np.uint64), tries=3)


@pytest.mark.parametrize("old,bucket_keys", [("doc_id % 2 = 0", 7), ("doc_id < 0", 100_000), ("doc_id >= 0", 20),
                                             ("crc32(cast(doc_id as string)) % 3 = 1", 100_000)])
def test_equals_dictionary(spark, old, bucket_keys):
    rng = random.Random(7)
    texts = ["", None, " ", "a b", "a  b", "a\tb", "a\n\nb", "A b", "a b ", "é", "x" * 50_000] + [f"t {i % 9}" for i in range(60)]
    rows = [(i, rng.choice(texts)) for i in range(300)] + [(5, "a b"), (5, "a b"), (7, "other"), (None, "a b"),
                                                          (None, "only here"), (None, "only here"), (5, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4) \
        .selectExpr("'k' as key", "doc_id", "text", "'s' as sha", "0 as row")
    out = D.exact_dedup(df, F.expr(old), bucket_keys=bucket_keys).collect()
    groups = {}
    for d, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(d)
    want = []
    for t, ids in groups.items():
        known = [d for d in ids if d is not None]
        keep = min(known) if known else None
        sha = hashlib.sha256(t.encode()).hexdigest()
        want += [(d, keep, len(ids), sha) for d in ids]
    def key(r):
        return tuple((x is None, x) if not isinstance(x, type(None)) else (True, 0) for x in r)
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out], key=key) == sorted(want, key=key)
    kept = [r for r in out if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)


def test_empty(spark):
    out = D.exact_dedup(spark.createDataFrame([], "doc_id long, text string"), F.lit(True))
    assert out.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"] and out.count() == 0
