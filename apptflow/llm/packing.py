"""Packing along a space-filling curve.

Every document's words are hashed into a signed vector, its direction is projected
to a few dimensions, and the place of that point on a Hilbert curve is the
document's key.  Documents are range-sorted by key, so each task has a stretch of
the curve, tokenised there and laid end to end into sequences of one length:
documents of a sequence are neighbours on the curve.  What a stretch leaves at
its end becomes sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import tidy
from .words import SPACE_WORDS, chunk_rows, text_buffers, words

BUCKETS, DIMS, BITS = 256, 4, 15        # of the hashed vector; of the curve, 60 bits in all


# --------------------------------------------------------------------- curve

def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each point (rows x dims of cell numbers below
    2^bits), dims * bits at most 63.  Works on the transposed form of the key,
    from the highest bit down, all points at once."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:                                  # undo the turns of each level
        low = q - 1
        for i in range(dims):
            turned = (x[i] & q) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(turned, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):                      # Gray code
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where(x[-1] & q, q - 1, 0)
        q >>= 1
    x ^= flip
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


_PLANE = np.linalg.qr(np.random.RandomState(12).standard_normal((BUCKETS, DIMS)))[0]


def text_points(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Points in [-1, 1]^DIMS of texts: word hashes in BUCKETS signed counts,
    square roots of their sizes, unit length, projected.  A text without words is
    the origin."""
    n = len(off) - 1
    h, _, _, first = words(buf, off, SPACE_WORDS)
    row = np.repeat(np.arange(n, dtype=np.int64), np.diff(first))
    bucket = (h & np.uint64(BUCKETS - 1)).astype(np.int64)
    sign = 1.0 - 2.0 * ((h >> np.uint64(32)) & np.uint64(1)).astype(float)
    v = np.bincount(row * BUCKETS + bucket, weights=sign, minlength=n * BUCKETS).reshape(n, BUCKETS)
    v = np.sign(v) * np.sqrt(np.abs(v))
    size = np.linalg.norm(v, axis=1, keepdims=True)
    return (v / np.where(size > 0, size, 1)) @ _PLANE


def curve_keys(col: pa.Array) -> np.ndarray:
    """The curve key of every text of a column; null counts as empty."""
    buf, off = text_buffers(col)
    out = [np.zeros(0, np.int64)]
    for lo, hi in chunk_rows(off, max_rows=4096):
        at = off[lo:hi + 1]
        p = text_points(buf[at[0]:at[-1]], at - at[0])
        cells = np.clip(np.floor((p + 1) / 2 * (1 << BITS)), 0, (1 << BITS) - 1)
        out.append(hilbert_keys(cells, BITS))
    return np.concatenate(out)


# -------------------------------------------------------------------- tokens

_ENCODERS: dict[str, object] = {}     # this worker's encoders, by path


def _byte_values() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def _as_ranks(path: str):
    """A rank encoder that gives the ids of a tokenizers file, or None where the
    file is more than byte-level BPE whose ids are in the order of its merges."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = (model.get("type") == "BPE" and not any(model.get(k) for k in (
        "dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
        and spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space")
        and pre.get("use_regex", True))
    added = spec.get("added_tokens") or []
    plain &= not any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
    if not plain:
        return None
    import tiktoken

    from .token_counts import PATTERN
    byte, special = _byte_values(), {t["content"]: t["id"] for t in added}
    vocab = {k: v for k, v in model["vocab"].items() if k not in special}
    if not all(c in byte for k in vocab for c in k):
        return None
    ranks = {bytes(byte[c] for c in k): v for k, v in vocab.items()}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [vocab.get(a + b, -1) for a, b in pairs]
    if made != sorted(set(made)) or len(ranks) != len(pairs) + 256 or len({k for k in ranks if len(k) == 1}) != 256:
        return None
    enc = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return lambda t: enc.encode(t, allowed_special="all")


def encoder(path: str):
    """text -> ids as the tokenizers library gives them by the file at ``path``
    without added special tokens, truncation or padding.  Plain byte-level BPE is
    merged by the faster rank encoder, with equal ids."""
    if path not in _ENCODERS:
        got = _as_ranks(path)
        if got is None:
            from tokenizers import Tokenizer
            t = Tokenizer.from_file(path)
            t.no_truncation()
            t.no_padding()
            got = lambda s: t.encode(s, add_special_tokens=False).ids
        _ENCODERS[path] = got
    return _ENCODERS[path]


# ------------------------------------------------------------------- packing

def powers(n: int) -> list[int]:
    """The powers of two that add up to n, falling."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


class Packer:
    """Lays documents end to end; ``add`` and ``end`` give the pieces of sequences
    that are complete: (document, start, ids, doc_tokens, sequence, offset)."""

    def __init__(self, length: int, first: int = 0):
        self.length, self.sequence, self.open, self.fill = length, first, [], 0

    def _full(self, sizes: list[int]) -> Iterator[tuple]:
        """The open pieces, cut into sequences of the given sizes."""
        left = list(reversed(sizes))
        room = left.pop() if left else 0
        offset = 0
        for doc, start, ids, tokens in self.open:
            while len(ids):
                take = min(room - offset, len(ids))
                yield doc, start, ids[:take], tokens, self.sequence, offset
                start, ids, offset = start + take, ids[take:], offset + take
                if offset == room:
                    self.sequence += 1
                    room, offset = left.pop() if left else 0, 0
        self.open, self.fill = [], 0

    def add(self, doc, ids: np.ndarray) -> Iterator[tuple]:
        start, tokens = 0, len(ids)
        while start < tokens:
            take = min(self.length - self.fill, tokens - start)
            self.open.append((doc, start, ids[start:start + take], tokens))
            start, self.fill = start + take, self.fill + take
            if self.fill == self.length:
                yield from self._full([self.length])

    def end(self) -> Iterator[tuple]:
        yield from self._full(powers(self.fill))


def pack_documents(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", length: int = 2048,
                   end_id: int = 1, parts: int | None = None) -> DataFrame:
    """One row per piece: (id_col, start, length, ids, doc_tokens, sequence_id,
    offset); ``ids`` are little-endian unsigned 32-bit ids.

    A document is its text's ids and ``end_id``, null and empty texts that id alone;
    it is cut where a sequence is full, so each id lies in one piece.  Sequences have
    ``length`` ids, apart from at most log2(length) shorter ones a task, whose
    lengths are powers of two: nothing is padded.

    Rows are dealt and sorted by (key, id, place in the input), so copies of one
    text, however many, are spread over tasks.  Repeated rows are packed once each
    and null ids are kept.  Other columns are not read; an empty table gives an
    empty result.  Where the stretches of the curve begin is sampled when the result
    is computed: write it once instead of reading it twice."""
    spark = docs.sparkSession

    @F.arrow_udf(T.LongType())
    def key(text: pa.Array) -> pa.Array:
        return pa.array(curve_keys(text))

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    src = src.withColumn("key", key("text")).withColumn("row", F.monotonically_increasing_id())
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    order = ["key", "id", "row"]
    dealt = src.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("id", "text")
    schema = T.StructType([
        T.StructField("id", docs.schema[id_col].dataType), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocab_path)
        packer = Packer(length, TaskContext.get().partitionId() << 40)
        id_type = None

        def table(pieces):
            return pa.RecordBatch.from_arrays([
                pa.array([p[0].as_py() for p in pieces], id_type), pa.array([p[1] for p in pieces], pa.int64()),
                pa.array([len(p[2]) for p in pieces], pa.int64()), pa.array([p[2].tobytes() for p in pieces], pa.binary()),
                pa.array([p[3] for p in pieces], pa.int64()), pa.array([p[4] for p in pieces], pa.int64()),
                pa.array([p[5] for p in pieces], pa.int64())], schema.names)

        pieces, held = [], 0
        for b in batches:
            id_type = b.column(0).type
            for doc, text in zip(b.column(0), b.column(1)):
                ids = np.array([*encode(text.as_py() or ""), end_id], "<u4")
                for p in packer.add(doc, ids):
                    pieces.append(p)
                    held += len(p[2])
                    if held >= 1 << 20:
                        yield table(pieces)
                        pieces, held = [], 0
        pieces += packer.end()
        if pieces:
            yield table(pieces)

    return dealt.mapInArrow(tidy(run), schema).withColumnRenamed("id", id_col)
