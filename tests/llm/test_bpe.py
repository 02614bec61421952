"""BPE against the tokenizers library, exact round trips, the automaton."""

import random
import re

import numpy as np
import pytest

from apptflow.llm import bpe as B

P = pytest.importorskip("public_tokenizers")
PATH = P.path("word_bpe_49k.json")

TEXTS = ["", None, " \n\t", "Hello World", "it's they're I'M don't 'S", "naïve café Ünïcödé Σίσυφος ΣΑΣ İstanbul ſ ß",
         "123 4567 x9y ²³ ½ Ⅷ ٣", "!!! ... -- ### $$$ @@", "a" * 300, "ab" * 1000 + " " + "é" * 500, "日本語のテキスト 中文",
         "emoji 👍🏽 👨‍👩‍👧 ​ zero", "<|endoftext|> in <|startoftext|>the middle<|endoftext|>", "<|other|> <|endoftext",
         "é combining ̈́", "nbsp x　y z\x85w\x1cv\x00u", "ᾳ ΐ Ǆ ǅ", "q̣́", "﻿bom"]


def _random_texts(n, seed=1):
    rng = random.Random(seed)
    alphabet = "abcdefghijklmnopqrstuvwxyzABCÉéßΣσ' 0123 \n!?#-日👍"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 80))) for _ in range(n)]


def library(texts):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(PATH)
    t.no_padding()
    t.no_truncation()
    ids = [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    return ids, [t.decode(x, skip_special_tokens=False) for x in ids]


def test_equals_library(spark):
    texts = TEXTS + _random_texts(300)
    df = spark.createDataFrame(list(enumerate(texts)) + [(None, "null id"), (3, "Hello World")], "doc_id long, text string") \
        .selectExpr("1 as ids", "doc_id", "text", "2 as decoded")
    rows = B.encode_documents(df, PATH, lexicon_words=50).collect()
    assert len(rows) == len(texts) + 2 and rows[0].__fields__ == ["doc_id", "ids", "decoded"]
    ids, decoded = library(texts)
    for r in rows:
        if r.doc_id is not None:
            assert np.frombuffer(r.ids, "<u4").tolist() == ids[r.doc_id], texts[r.doc_id]
            assert r.decoded == decoded[r.doc_id]


def test_empty_table(spark):
    assert B.encode_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


@pytest.mark.parametrize("words", [[], ["only"], ["a", "ab", "abc", "b", "bc"], None])
def test_lexicon_ranks(words):
    if words is None:
        rng = random.Random(4)
        words = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 7))) + rng.choice(["ing", "tion", ""])
                 for _ in range(3000)]
    data = sorted({w.encode() for w in words})
    arrays = B.build_lexicon(data)
    lex = B.Lexicon(arrays)
    probe = data + [b"zzz", b"", b"a", b"abcd", b"ing"]
    assert lex.ranks(probe).tolist() == [data.index(p) if p in data else -1 for p in probe]
    # minimal: no two states with the same arcs and finality
    at = arrays["first"]
    states = [(int(arrays["final"][s]), tuple(zip(arrays["label"][at[s]:at[s + 1]], arrays["target"][at[s]:at[s + 1]])))
              for s in range(len(at) - 1)]
    assert len(set(states)) == len(states)
    assert len(states) <= 1 + sum(map(len, data))


def test_long_and_short_merges_agree():
    v = B.Vocabulary(PATH)
    for w in re.findall(r"\S+", " ".join(_random_texts(200, 3)).lower()):
        s = [v.letters[b] for b in w.encode()]
        s[-1] += B.WORD_END
        assert [v.ids[x] for x in B._merge_long(s, v.rank)] == v.merge(w)


def test_merging_many_words_at_once():
    v = B.Vocabulary(PATH)
    words = sorted(set(re.findall(r"\S+", " ".join(_random_texts(400, 5)).lower())) | {"a", "zz" * 40, "é" * 32, "thththth"})
    got = B.Merger(v)([w.encode() for w in words])
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [v.merge(w) for w in words]


def test_plain_text_round_trip():
    v = B.Vocabulary(PATH)
    for t in ("hello world", "naïve café 日本", "a" * 200):
        ids = b"".join(np.array(v.merge(p), "<u4").tobytes() for p in v.split(t))
        assert B.plain_text(ids, v.tokens) == " ".join(v.split(t))
