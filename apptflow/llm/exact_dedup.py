"""Exact dedup: static binary-fuse filters per immutable snapshot.

A snapshot is the distinct digests of texts that were taken in before, dealt
into buckets by digest.  Each bucket gets a static binary-fuse filter (16-bit
fingerprints, about 18 bits a key).  An incoming batch is grouped by digest on
its own; each of its digests is then screened by its bucket's filter.  What the
filter denies is new for certain; what it lets through joins the snapshot's
exact buckets, and the two texts are compared byte by byte.

Digests are aggregated map-side before anything is shuffled, so a text with
millions of copies is one row of its bucket; buckets are bounded by
``bucket_keys`` and their number follows the data.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut
from .words import mix

_U = np.uint64


# ------------------------------------------------------- binary-fuse filters

def _slots(h: np.ndarray, segment: int, segments: int) -> np.ndarray:
    """Three slots a key (3 x n), in neighbouring segments of equal length."""
    start = ((h >> _U(32)) * _U(segments)) >> _U(32)        # first segment, uniform
    inside = _U(segment - 1)
    base = start * _U(segment)
    g = mix(h ^ _U(0xA0761D6478BD642F))
    return np.stack([base + (g & inside), base + _U(segment) + ((g >> _U(21)) & inside),
                     base + _U(2 * segment) + ((g >> _U(42)) & inside)]).astype(np.int64)


def build_filter(keys: np.ndarray, tries: int = 64) -> tuple[int, int, int, np.ndarray]:
    """(seed, segment length, segments, fingerprints) of distinct 64-bit keys.

    Keys are peeled in rounds: every slot held by one key only gives that key
    its slot; fingerprints are then set in the reverse order, a round at a time
    (keys of one round never share a chosen slot)."""
    n = len(keys)
    # segment length and load as recommended for three-wise binary-fuse filters
    segment = 1 << max(2, min(18, int(math.log(max(n, 2)) / math.log(3.33) + 2.25)))
    load = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
    segments = max(1, math.ceil(n * load / segment) - 2)
    for seed in range(tries):
        h = mix(keys + _U(0x9E3779B97F4A7C15 * (seed + 1) % 2**64))
        slots = _slots(h, segment, segments)
        size = (segments + 2) * segment
        count = np.bincount(slots.ravel(), minlength=size)
        held = np.zeros(size, np.int64)                      # xor of key numbers in a slot
        number = np.arange(n, dtype=np.int64)
        for row in slots:
            np.bitwise_xor.at(held, row, number)
        rounds, left = [], n
        alone = np.flatnonzero(count == 1)
        while len(alone):
            key, at = np.unique(held[alone], return_index=True)
            rounds.append((key, alone[at]))
            left -= len(key)
            touched = slots[:, key]
            for row in touched:
                np.subtract.at(count, row, 1)
                np.bitwise_xor.at(held, row, key)
            touched = np.unique(touched)
            alone = touched[count[touched] == 1]
        if left == 0:
            mark = _fingerprint(h)
            table = np.zeros(size, np.uint16)
            for key, slot in reversed(rounds):
                table[slot] = 0
                three = table[slots[:, key]]
                table[slot] = mark[key] ^ three[0] ^ three[1] ^ three[2]
            return seed, segment, segments, table
    raise RuntimeError("no binary-fuse filter found: are the keys distinct?")


def _fingerprint(h: np.ndarray) -> np.ndarray:
    return (mix(h ^ _U(0xE7037ED1A0B428DB)) & _U(0xFFFF)).astype(np.uint16)


def may_hold(keys: np.ndarray, seed: int, segment: int, segments: int, table: np.ndarray) -> np.ndarray:
    """False: certainly not among the filter's keys."""
    h = mix(keys + _U(0x9E3779B97F4A7C15 * (seed + 1) % 2**64))
    three = table[_slots(h, segment, segments)]
    return (three[0] ^ three[1] ^ three[2]) == _fingerprint(h)


# --------------------------------------------------------------- the operator

def normalised(text: Column) -> Column:
    """White space runs as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.shiftright(key, 17), F.lit(buckets)).cast("long")


def snapshot_filters(groups: DataFrame, buckets: int) -> DataFrame:
    """(bucket, seed, segment, segments, table): a filter for every bucket of the
    snapshot's (key) rows."""
    def run(key, t):
        keys = np.unique(t.column("key").to_numpy()).view(np.uint64)
        seed, segment, segments, table = build_filter(keys)
        return pa.table({"bucket": [key[0].as_py()], "seed": [seed], "segment": [segment], "segments": [segments],
                         "table": pa.array([table.tobytes()], pa.binary())})

    return (groups.select(_bucket(F.col("key"), buckets).alias("bucket"), "key").groupBy("bucket")
            .applyInArrow(run, "bucket long, seed long, segment long, segments long, table binary"))


def screen(groups: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """(sha, maybe): each incoming digest, and whether its bucket's filter lets
    it through."""
    def run(left, right):
        if not left.num_rows:
            return pa.table({"sha": pa.array([], pa.binary()), "maybe": pa.array([], pa.bool_())})
        maybe = np.zeros(left.num_rows, bool)
        for f in right.to_pylist():
            maybe |= may_hold(left.column("key").to_numpy().view(np.uint64), f["seed"], f["segment"], f["segments"],
                              np.frombuffer(f["table"], np.uint16))
        return pa.table({"sha": left.column("sha"), "maybe": pa.array(maybe)})

    left = groups.select(_bucket(F.col("key"), buckets).alias("bucket"), "sha", "key")
    return left.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(run, "sha binary, maybe boolean")


def exact_dedup(docs: DataFrame, in_snapshot: Column, id_col: str = "doc_id", text_col: str = "text",
                bucket_keys: int = 100_000, broadcast_rows: int = 1_000_000) -> DataFrame:
    """One row per row of ``docs``: (id_col, keep_id, group_size, kept, text_sha256).

    ``in_snapshot`` tells the rows of the immutable snapshot from those of the
    incoming batch (null: batch).  Texts are equal when identical after each run
    of white space became one space; null counts as empty, and empty texts are
    equal to each other.  Of equal texts the row of the smallest id stays (a row
    without id only if none has one; of repeated rows with that id, one).
    text_sha256 is of the normalised text in UTF-8.  Other columns are not
    looked at; an empty table gives an empty result."""
    d = cut(docs.select(F.col(id_col).alias("id"), F.coalesce(in_snapshot, F.lit(False)).alias("old"),
                        F.unhex(F.sha2(normalised(F.col(text_col)).cast("binary"), 256)).alias("sha"))
            .withColumn("key", F.xxhash64("sha")).withColumn("row", F.monotonically_increasing_id()))
    groups = cut(d.groupBy("old", "sha", "key").agg(
        F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("least"),
        F.count(F.lit(1)).alias("n")))
    old, new = groups.where("old"), groups.where("not old")
    buckets = max(1, math.ceil(groups.count() / bucket_keys))
    maybe = screen(new, snapshot_filters(old, buckets), buckets).where("maybe").select("sha")
    both = cut(new.join(maybe, "sha", "left_semi").select("sha", F.col("least.id").alias("new_id"))
               .join(old.select("sha", F.col("least.id").alias("old_id")), "sha"))
    same = equal_bytes(docs, both, id_col, text_col, broadcast_rows)

    # groups of a snapshot and a batch whose bytes are the same become one
    tagged = groups.join(same.withColumn("one", F.lit(True)), "sha", "left").select(
        "old", "sha", "least", "n", F.when(F.col("one"), F.lit(2)).otherwise(F.col("old").cast("int")).alias("tag"))
    total = tagged.groupBy("sha", "tag").agg(F.min("least").alias("first"), F.sum("n").alias("size"))
    of = tagged.select("old", "sha", "tag").join(total, ["sha", "tag"]).select("old", "sha", "first", "size")
    return d.select("id", "old", "sha", "row").join(of, ["old", "sha"]).select(
        F.col("id").alias(id_col), F.col("first.id").alias("keep_id"), F.col("size").alias("group_size"),
        (F.col("row") == F.col("first.row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def equal_bytes(docs: DataFrame, pairs: DataFrame, id_col: str, text_col: str, broadcast_rows: int) -> DataFrame:
    """(sha) of the pairs (sha, new_id, old_id) whose normalised texts are the
    same bytes.  Pairs without an id on one side are held equal by their digest."""
    ids = pairs.select(F.explode(F.array("new_id", "old_id")).alias(id_col)).where(F.col(id_col).isNotNull()).distinct()
    if pairs.count() <= broadcast_rows:
        ids = F.broadcast(ids)
    texts = (docs.select(id_col, text_col).join(ids, id_col, "left_semi")
             .select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("bytes"))
             .withColumn("sha", F.unhex(F.sha2(F.col("bytes").cast("binary"), 256))))
    a = pairs.join(texts.select("sha", F.col("id").alias("new_id"), F.col("bytes").alias("a")), ["sha", "new_id"], "left")
    b = a.join(texts.select("sha", F.col("id").alias("old_id"), F.col("bytes").alias("b")), ["sha", "old_id"], "left")
    return b.where(F.coalesce(F.col("a") == F.col("b"), F.lit(True))).select("sha").distinct()
