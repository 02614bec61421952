"""Language-model scoring with an Elias-Fano n-gram trie.

Training counts all n-grams of the training texts; n-grams of two and more
words are kept from ``min_count`` occurrences on (1: all).  A word's id is its place
among the sorted word hashes.  The trie's levels are flat files:

    level 1   word hashes (Elias-Fano), counts, backoffs
    level 2   pointers from each word to its successors (Elias-Fano, monotone),
              the successors' ids (Elias-Fano of id + place of the context),
              probabilities, backoffs
    level 3   the same, with contexts that are places in level 2 and successors
              numbered among the successors of the middle word, so their numbers
              are small

Probabilities are absolute-discounted and interpolated with the next shorter
context, and quantised to 256 values a file, as are the backoffs.  Files are
cut by ranges of word hashes, written to the shared folder and memory-mapped by
every task; an n-gram is looked up by a successor search inside its context.

Counting never gathers words at the driver: tasks send sorted blocks of keys and
counts, dealt by hash, so a frequent word is spread over all shards and is one
row of a task; what passes ``min_count`` is then dealt by context.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .elias_fano import DTYPES, EliasFano, encode
from .jaccard import _packed, _unpacked
from .shared import map_array, new_folder, put_file, tidy
from .words import SPACE_WORDS, chunk_rows, mix, text_buffers, words

_U = np.uint64
START, END = _U(0x8C5A9F1D3B7E2461), _U(0x35D1C7B9E40F6A83)    # hashes of no word
DISCOUNT = 0.75
_BLOCK = "shard long, keys binary, counts binary"


# ------------------------------------------------------------------ sequences

def sequences(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of [start, words, end] of each text in a row, and their offsets."""
    h, _, _, first = words(buf, off, SPACE_WORDS)
    n = len(off) - 1
    at = first + 2 * np.arange(n + 1)
    out = np.empty(at[-1], np.uint64)
    inner = np.ones(len(out), bool)
    out[at[:-1]], inner[at[:-1]] = START, False
    out[at[1:] - 1], inner[at[1:] - 1] = END, False
    out[inner] = h
    return out, at


def _chunks(batches, column: int, size: int):
    for b in batches:
        buf, off = text_buffers(b.column(column))
        for lo, hi in chunk_rows(off, size):
            yield b, lo, hi, *sequences(buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])


class _Counter:
    """Counts of 64-bit keys in bounded memory: sorted runs, merged as they grow
    and handed out as blocks by shard when there are too many keys."""

    def __init__(self, shards: int, shard_of, limit: int = 3_000_000):
        self.shards, self.shard_of, self.limit = shards, shard_of, limit
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray):
        u, c = np.unique(keys, return_counts=True)
        self.runs.append((u, c))
        if sum(len(x) for x, _ in self.runs) > self.limit:
            self.runs = [_merge(self.runs)]
            if len(self.runs[0][0]) > self.limit // 2:
                yield from self.blocks()

    def blocks(self):
        u, c = _merge(self.runs) if self.runs else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.runs = []
        s = self.shard_of(u)
        o = np.argsort(s, kind="stable")
        u, c, s = u[o], c[o], s[o]
        begin = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
        for a, b in zip(begin, np.append(begin[1:], len(s))):
            yield _block(int(s[a]), u[a:b], c[a:b])


def _block(shard: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """Sorted keys, as differences by byte planes, and their counts."""
    kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if counts.max(initial=0) <= np.iinfo(t).max)
    tag = np.array([np.dtype(kind).itemsize], np.uint8).tobytes()
    return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([_packed(keys)], pa.binary()),
                                       pa.array([tag + counts.astype(kind).tobytes()], pa.binary())],
                                      ["shard", "keys", "counts"])


def _merge(runs) -> tuple[np.ndarray, np.ndarray]:
    if len(runs) == 1:
        return runs[0]
    k, c = np.concatenate([x for x, _ in runs]), np.concatenate([x for _, x in runs])
    o = np.argsort(k, kind="stable")
    k, c = k[o], c[o]
    at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[at], (np.add.reduceat(c, at) if len(at) else c).astype(np.int64)


def _merged(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Keys and total counts of a shard's blocks."""
    runs = []
    for k, c in zip(t.column("keys"), t.column("counts")):
        c = c.as_buffer()
        kind = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}[c[0]]
        k = k.as_buffer()
        runs.append((_unpacked(k) if len(k) else np.zeros(0, np.uint64), np.frombuffer(c, kind, offset=1).astype(np.int64)))
    return _merge(runs)


# ---------------------------------------------------------------------- files

def _put_sequence(folder: str, name: str, values: np.ndarray, universe: int) -> None:
    for k, x in encode(values, universe).items():
        put_file(folder, f"{name}.{k}", x)


def _sequence(folder: str, name: str) -> EliasFano:
    return EliasFano({k: map_array(folder, f"{name}.{k}", t) for k, t in DTYPES.items()})


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and the 256 values they stand for: means of equal parts of the sorted
    distinct values."""
    u, inverse = np.unique(x, return_inverse=True)
    code = np.arange(len(u)) * 256 // max(len(u), 1)
    n = np.bincount(code, minlength=256)
    book = np.bincount(code, weights=u, minlength=256) / np.maximum(n, 1)
    return code[inverse].astype(np.uint8), book


def _put_quantised(folder: str, name: str, x: np.ndarray) -> None:
    code, book = quantised(x)
    put_file(folder, f"{name}.code", code)
    put_file(folder, f"{name}.book", book)


class _Quantised:
    def __init__(self, folder: str, name: str):
        self.code, self.book = map_array(folder, f"{name}.code", "u1"), map_array(folder, f"{name}.book", "<f8")

    def __getitem__(self, i):
        return self.book[self.code[i]]


class Trie:
    """The mapped levels.  ``words``/``pairs``: entries by shard of levels 1 and 2."""

    def __init__(self, folder: str, shards: int, tokens: int, types: int, levels: int = 1, words=None, pairs=None,
                 fan_out: int = 0):
        self.folder, self.shards, self.tokens, self.types, self.levels = folder, shards, tokens, types, levels
        self.words, self.pairs, self.fan_out = words, pairs, fan_out
        self.word_start = np.concatenate([[0], np.cumsum(words)]) if words is not None else None
        self.pair_start = np.concatenate([[0], np.cumsum(pairs)]) if pairs is not None else None
        self._open: dict = {}

    def _part(self, kind, name: str):
        if name not in self._open:
            self._open[name] = kind(self.folder, name)
        return self._open[name]

    def _counts(self, name: str) -> np.ndarray:
        if name not in self._open:
            self._open[name] = map_array(self.folder, name, "<i8")
        return self._open[name]

    @staticmethod
    def _each(shard: np.ndarray):
        """(shard, positions) of sorted shard numbers."""
        at = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(shard) else np.zeros(0, np.int64)
        for a, b in zip(at, np.append(at[1:], len(shard))):
            yield int(shard[a]), slice(a, b)

    def word_ids(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id or -1, count) of sorted word hashes."""
        ids, counts = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64)
        bits = self.shards.bit_length() - 1
        top = (h >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
        for s, at in self._each(top):
            if self.words[s]:
                i, ok = self._part(_sequence, f"1.{s}.words").search(h[at] - _U(s << (64 - bits) if bits else 0))
                ids[at] = np.where(ok, i + self.word_start[s], -1)
                counts[at][ok] = self._counts(f"1.{s}.counts")[i[ok]]
        return ids, counts

    def backoff1(self, ids: np.ndarray) -> np.ndarray:
        """log10 of the mass that words (sorted ids) leave to shorter contexts."""
        out = np.zeros(len(ids))
        shard = np.searchsorted(self.word_start, ids, side="right") - 1
        for s, at in self._each(shard):
            out[at] = self._part(_Quantised, f"2.{s}.back")[ids[at] - self.word_start[s]]
        return out

    def pair_places(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Place in level 2 of pairs of word ids, sorted by the first; -1 if not kept."""
        out = np.full(len(a), -1, np.int64)
        shard = np.searchsorted(self.word_start, a, side="right") - 1
        total = _U(self.word_start[-1])
        for s, at in self._each(shard):
            if self.pairs[s]:
                x = (a[at] - self.word_start[s]).astype(np.uint64) * total + b[at].astype(np.uint64)
                i, ok = self._part(_sequence, f"2.{s}.next").search(x)
                out[at] = np.where(ok, i + self.pair_start[s], -1)
        return out

    def first_successor(self, a: np.ndarray) -> np.ndarray:
        """Place in level 2 of the first successor of words (sorted ids)."""
        out = np.zeros(len(a), np.int64)
        shard = np.searchsorted(self.word_start, a, side="right") - 1
        for s, at in self._each(shard):
            out[at] = self._part(_sequence, f"2.{s}.pointer").get(a[at] - self.word_start[s]).astype(np.int64) + self.pair_start[s]
        return out

    def pair_values(self, place: np.ndarray, what: str) -> np.ndarray:
        """Values of level 2 (prob), or those that level 3 has for its contexts
        (3: back), by sorted places."""
        out = np.zeros(len(place))
        shard = np.searchsorted(self.pair_start, place, side="right") - 1
        for s, at in self._each(shard):
            name = f"2.{s}.prob" if what == "prob" else f"3.{s}.back"
            out[at] = self._part(_Quantised, name)[place[at] - self.pair_start[s]]
        return out

    def triple_probs(self, place: np.ndarray, rel: np.ndarray) -> np.ndarray:
        """log10 probability of triples by the place of their first two words
        (sorted) and the third's number among the middle word's successors; nan if
        not kept."""
        out = np.full(len(place), np.nan)
        shard = np.searchsorted(self.pair_start, place, side="right") - 1
        for s, at in self._each(shard):
            seq = self._part(_sequence, f"3.{s}.next")
            if seq.n:
                x = (place[at] - self.pair_start[s]).astype(np.uint64) * _U(self.fan_out) + rel[at].astype(np.uint64)
                i, ok = seq.search(x)
                got = np.full(len(x), np.nan)
                got[ok] = self._part(_Quantised, f"3.{s}.prob")[i[ok]]
                out[at] = got
        return out


# ------------------------------------------------------------------- training

def _keys_of(trie: Trie, seq: np.ndarray, at: np.ndarray, min_word: int = 0):
    """(ids of the sequence, whether a position starts a text); words seen fewer
    than ``min_word`` times have id -1."""
    u, inverse = np.unique(seq, return_inverse=True)
    ids, counts = trie.word_ids(u)
    ids[counts < min_word] = -1
    begin = np.zeros(len(seq), bool)
    begin[at[:-1]] = True
    return ids[inverse], begin


class _Pairs:
    """The pairs of words of a chunk in level 2.  ``at``: positions of second
    words; ``of``: the number of each one's distinct pair; ``first``, ``place``: the
    pairs' first words and places (-1: not kept), both ascending."""

    def __init__(self, trie: Trie, ids: np.ndarray, begin: np.ndarray):
        self.trie = trie
        self.at = np.flatnonzero(~begin[1:] & (ids[1:] >= 0) & (ids[:-1] >= 0)) + 1
        n = _U(trie.word_start[-1])
        u, self.of = np.unique(ids[self.at - 1].astype(np.uint64) * n + ids[self.at].astype(np.uint64), return_inverse=True)
        self.first = (u // n).astype(np.int64)
        self.place = trie.pair_places(self.first, (u - self.first.astype(np.uint64) * n).astype(np.int64)) if len(u) \
            else np.zeros(0, np.int64)
        self.kept = self.place >= 0

    def spread(self, size: int, values: np.ndarray, rest) -> np.ndarray:
        """The pairs' values at the positions of their second words."""
        out = np.full(size, rest, values.dtype)
        out[self.at] = values[self.of]
        return out

    def relative(self) -> np.ndarray:
        """Number of the second word among the first's successors, of kept pairs."""
        out = np.zeros(len(self.place), np.int64)
        f = self.first[self.kept]
        change = np.flatnonzero(np.concatenate([[True], f[1:] != f[:-1]])) if len(f) else np.zeros(0, np.int64)
        start = np.repeat(self.trie.first_successor(f[change]), np.diff(np.append(change, len(f))))
        out[self.kept] = self.place[self.kept] - start
        return out


def _counted(texts: DataFrame, shards: int, keys_of, shard_of, chunk_bytes: int) -> DataFrame:
    """Blocks (shard, keys, counts) of the keys of all texts."""
    def run(batches):
        counter = _Counter(shards, shard_of)
        for _, _, _, seq, at in _chunks(batches, 0, chunk_bytes):
            yield from counter.add(keys_of(seq, at))
        yield from counter.blocks()

    return texts.mapInArrow(tidy(run), _BLOCK)


def _pruned(blocks: DataFrame, min_count: int, starts: np.ndarray, unit: int, to: int) -> DataFrame:
    """Blocks of the keys that reach min_count, dealt by the range (of ``starts``)
    that key // unit lies in."""
    def run(key, t):
        k, c = _merged(t)
        k, c = k[c >= min_count], c[c >= min_count]
        s = np.searchsorted(starts, (k // _U(unit)).astype(np.int64), side="right") - 1
        out = [_block(i, k[at], c[at]) for i, at in Trie._each(s)]
        return pa.Table.from_batches(out) if out else pa.schema(
            [("shard", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())]).empty_table()

    # every range gets a row, so that ranges without keys get their files too
    spark = blocks.sparkSession
    none = spark.range(to).select(F.col("id").alias("shard"), F.lit(b"").alias("keys"), F.lit(b"\x01").alias("counts"))
    return blocks.groupBy("shard").applyInArrow(run, _BLOCK).unionByName(none)


def _hash_shard(shards: int):
    return lambda k: (mix(k) & _U(shards - 1)).astype(np.int64)


def _fits(keys: int, what: str) -> None:
    """Keys are 64-bit numbers; more of them would be counted as others."""
    if keys > 1 << 64:
        raise OverflowError(f"{what} have more than 2^64 keys; train on fewer texts or a lower order")


def _level(trie: Trie, level: int, s: int, local: np.ndarray, c: np.ndarray, contexts: int, context_count: np.ndarray,
           unit: int, lower: np.ndarray) -> np.ndarray:
    """Write a level's files of shard s: ``local`` keys (context * unit + rel),
    their counts and their probabilities in the shorter context.  Returns the
    log10 backoffs of the contexts."""
    ctx = (local // _U(unit)).astype(np.int64)
    total = np.maximum(context_count, 1).astype(float)
    kept = np.bincount(ctx, weights=c - DISCOUNT, minlength=contexts)
    back = np.maximum(1 - kept / total, 1e-9)
    prob = (c - DISCOUNT) / total[ctx] + back[ctx] * lower
    _put_sequence(trie.folder, f"{level}.{s}.next", local, contexts * unit)
    _put_sequence(trie.folder, f"{level}.{s}.pointer",
                  np.searchsorted(ctx, np.arange(contexts + 1)).astype(np.uint64), len(ctx) + 1)
    _put_quantised(trie.folder, f"{level}.{s}.prob", np.log10(prob))
    _put_quantised(trie.folder, f"{level}.{s}.back", np.log10(back))
    return back


def train(texts: DataFrame, text_col: str = "text", order: int = 3, min_count: int = 1, shards: int | None = None,
          chunk_bytes: int = 4 << 20) -> Trie:
    """The trie of all ``texts`` (null texts count as empty)."""
    spark = texts.sparkSession
    texts = texts.select(F.col(text_col).cast("string").alias("text"))
    if shards is None:
        shards = max(8, 1 << (texts.rdd.getNumPartitions() - 1).bit_length())
    folder = new_folder(spark, "trie")
    bits = shards.bit_length() - 1

    def by_hash(h):
        return (h >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)

    def write_words(key, t):
        s = key[0].as_py()
        h, c = _merged(t)
        _put_sequence(folder, f"1.{s}.words", h - _U(s << (64 - bits) if bits else 0), 1 << (64 - bits))
        put_file(folder, f"1.{s}.counts", c.astype("<i8"))
        own = h != START
        return pa.table({"shard": [s], "n": [len(h)], "tokens": [int(c[own].sum())], "types": [int(own.sum())]})

    got = (_counted(texts, shards, lambda seq, at: seq, by_hash, chunk_bytes).groupBy("shard")
           .applyInArrow(write_words, "shard long, n long, tokens long, types long").toArrow().to_pydict())
    sizes = np.zeros(shards, np.int64)
    sizes[got["shard"]] = got["n"]
    one = Trie(folder, shards, sum(got["tokens"]), sum(got["types"]), words=sizes)
    if order < 2 or not one.tokens:
        return one
    n_words = int(one.word_start[-1])
    unit = n_words
    _fits(n_words * n_words, "pairs of words")

    def pair_keys(seq, at):
        ids, begin = _keys_of(one, seq, at, min_count)
        ok = ~begin[1:] & (ids[1:] >= 0) & (ids[:-1] >= 0)
        return ids[:-1][ok].astype(np.uint64) * _U(unit) + ids[1:][ok].astype(np.uint64)

    def write_pairs(key, t):
        s = key[0].as_py()
        k, c = _merged(t)
        local = k - _U(int(one.word_start[s]) * unit)
        count = np.asarray(map_array(folder, f"1.{s}.counts", "<i8")) if sizes[s] else np.zeros(0, np.int64)
        second = (local % _U(unit)).astype(np.int64)
        u, inverse = np.unique(second, return_inverse=True)
        low = np.zeros(len(u))
        shard = np.searchsorted(one.word_start, u, side="right") - 1
        for i, at in Trie._each(shard):
            low[at] = (one._counts(f"1.{i}.counts")[u[at] - one.word_start[i]] + 0.5) / (one.tokens + 0.5 * (one.types + 1))
        _level(one, 2, s, local, c, int(sizes[s]), count, unit, low[inverse])
        put_file(folder, f"2.{s}.counts", c.astype("<i8"))
        ctx = (local // _U(unit)).astype(np.int64)
        return pa.table({"shard": [s], "n": [len(k)], "fan": [int(np.bincount(ctx).max(initial=0))]})

    blocks = _pruned(_counted(texts, shards, pair_keys, _hash_shard(shards), chunk_bytes), min_count,
                     one.word_start[:-1], unit, shards)
    got = blocks.groupBy("shard").applyInArrow(write_pairs, "shard long, n long, fan long").toArrow().to_pydict()
    pairs = np.zeros(shards, np.int64)
    pairs[got["shard"]] = got["n"]
    two = Trie(folder, shards, one.tokens, one.types, 2, sizes, pairs, max(got["fan"]) + 1)
    if order < 3 or not pairs.sum():
        return two
    fan = two.fan_out
    _fits(int(pairs.sum()) * fan, "triples of words")

    def triple_keys(seq, at):
        ids, begin = _keys_of(two, seq, at, min_count)
        pairs_of = _Pairs(two, ids, begin)
        place = pairs_of.spread(len(seq), pairs_of.place, -1)
        rel = pairs_of.spread(len(seq), pairs_of.relative(), 0)
        i = np.flatnonzero((place[1:] >= 0) & (place[:-1] >= 0)) + 1
        return place[i - 1].astype(np.uint64) * _U(fan) + rel[i].astype(np.uint64)

    def write_triples(key, t):
        s = key[0].as_py()
        k, c = _merged(t)
        local = k - _U(int(two.pair_start[s]) * fan)
        count = np.asarray(map_array(folder, f"2.{s}.counts", "<i8"))
        # the shorter context: (middle word, third word), by its place in level 2
        ctx = (local // _U(fan)).astype(np.int64)
        lower = np.zeros(len(local))
        if len(local):
            seq = two._part(_sequence, f"2.{s}.next")
            middle, inverse = np.unique((seq.get(ctx) % _U(unit)).astype(np.int64), return_inverse=True)
            place = two.first_successor(middle)[inverse] + (local % _U(fan)).astype(np.int64)
            p, back = np.unique(place, return_inverse=True)
            lower = (10 ** two.pair_values(p, "prob"))[back]
        _level(two, 3, s, local, c, int(pairs[s]), count, fan, lower)
        return pa.table({"shard": [s]})

    blocks = _pruned(_counted(texts, shards, triple_keys, _hash_shard(shards), chunk_bytes), min_count,
                     two.pair_start[:-1], fan, shards)
    blocks.groupBy("shard").applyInArrow(write_triples, "shard long").toArrow()
    two.levels = 3
    two._open = {}
    return two


# -------------------------------------------------------------------- scoring

def score_chunk(trie: Trie, seq: np.ndarray, at: np.ndarray):
    """(tokens, known tokens, base score, score) of each text of a chunk."""
    u, inverse = np.unique(seq, return_inverse=True)
    uid, ucount = trie.word_ids(u)
    ids, count = uid[inverse], ucount[inverse]
    begin = np.zeros(len(seq), bool)
    begin[at[:-1]] = True
    base = np.log10((ucount + 0.5) / (trie.tokens + 0.5 * (trie.types + 1)))[inverse]
    base[begin] = 0.0
    logp = base.copy()
    if trie.levels >= 2:
        pairs = _Pairs(trie, ids, begin)
        kept = pairs.kept
        # kept pairs have a probability; others add their context's backoff
        value = np.zeros(len(kept))
        value[kept] = trie.pair_values(pairs.place[kept], "prob")
        value[~kept] = trie.backoff1(pairs.first[~kept])
        own = kept[pairs.of]
        logp[pairs.at] = np.where(own, 0.0, logp[pairs.at]) + value[pairs.of]
        # an unseen word after a known one
        left = np.flatnonzero((ids[1:] < 0) & ~begin[1:] & (ids[:-1] >= 0)) + 1
        c, back = np.unique(ids[left - 1], return_inverse=True)
        logp[left] += trie.backoff1(c)[back]
    if trie.levels >= 3:
        # words whose two words before are a kept pair
        size = len(seq)
        place = pairs.spread(size, pairs.place, -1)
        value = np.zeros(len(kept))
        value[kept] = trie.pair_values(pairs.place[kept], "back")
        backoff = pairs.spread(size, value, 0.0)
        rel = pairs.spread(size, pairs.relative(), 0)
        inner = np.flatnonzero((place[:-1] >= 0) & ~begin[1:]) + 1
        logp[inner] += backoff[inner - 1]
        i = inner[place[inner] >= 0]
        k = place[i - 1].astype(np.uint64) * _U(trie.fan_out) + rel[i].astype(np.uint64)
        o = np.argsort(k)
        k = k[o]
        context = k // _U(trie.fan_out)
        got = trie.triple_probs(context.astype(np.int64), (k - context * _U(trie.fan_out)).astype(np.int64))
        o, got = o[~np.isnan(got)], got[~np.isnan(got)]
        logp[i[o]] = got
    n = np.diff(at) - 1
    seen = np.add.reduceat(((count > 0) & ~begin).astype(np.int64), at[:-1]) if len(n) else n
    total = [np.add.reduceat(x, at[:-1]) if len(n) else np.zeros(0) for x in (base, logp)]
    return n, seen, *total


_TRIES: dict[str, Trie] = {}       # this worker's mapped trie, by a key of its own


def score_texts(docs: DataFrame, trie: Trie, id_col: str = "doc_id", text_col: str = "text",
                chunk_bytes: int = 4 << 20) -> DataFrame:
    """One row per row of ``docs``: (id_col, n_tokens, n_known, base_score, score),
    by a trained trie.  A token's base probability is (c + 0.5) / (N + 0.5 (V + 1))."""
    args = (trie.folder, trie.shards, trie.tokens, trie.types, trie.levels, trie.words, trie.pairs, trie.fan_out)
    key = uuid.uuid4().hex
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        if key not in _TRIES:
            _TRIES.clear()
            _TRIES[key] = Trie(*args)
        for b, lo, hi, seq, at in _chunks(batches, 1, chunk_bytes):
            n, seen, base, score = score_chunk(_TRIES[key], seq, at)
            yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(n), pa.array(seen), pa.array(base),
                                              pa.array(score)], ["id", "n_tokens", "n_known", "base_score", "score"])

    return src.mapInArrow(tidy(run), T.StructType([
        T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()),
        T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()),
        T.StructField("score", T.DoubleType())])).withColumnRenamed("id", id_col)


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_out_fold: int = 1,
              order: int = 3, min_count: int = 1) -> DataFrame:
    """One row per row of ``docs``: (id_col, held_out, n_tokens, n_known,
    train_tokens, base_score, score).

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered; each text ends with one end
    token.  The model learns from the texts whose crc32(id as text) mod ``folds``
    is not ``held_out_fold``.  Null and empty texts are one end token.  A null id
    is not held out, and its text is learned from; repeated rows count once each.
    With no training texts every probability is that of an unseen token.  Other
    columns are not read; an empty table gives an empty result."""
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == held_out_fold, F.lit(False))
    trie = train(docs.where(~held), text_col, order, min_count)
    got = score_texts(docs, trie, id_col, text_col)
    return got.select(id_col, held.alias("held_out"), "n_tokens", "n_known",
                      F.lit(trie.tokens).cast("long").alias("train_tokens"), "base_score", "score")
