"""N-gram Jaccard join: a count-vector R-tree over documents' shingle sets.

Every document is the set of its distinct k-word shingles.  The shingles are
hashed into groups and the counts by group are the document's point; the
overlap of two sets is at most the sum over groups of the smaller count, so a
pair whose summed minima stay below the overlap that the threshold asks for
cannot link.  Points of a block are packed into an R-tree whose boxes (largest
count by group) bound whole leaves at once; surviving pairs are verified on
the full sets.

How it is dealt out
    * Equal sets are one class; only one document of a class goes on.
    * R-trees are built per block: the classes that share a shingle of their
      prefix (the n - ceil(t n) + 1 first shingles of a set, in one fixed order;
      two sets that link share one of these).  Any order is exact; the rarest
      come first, and those that no other document holds make no block at all.
    * Blocks with the same members are merged by a hash of their members.
    * First every member is checked against a few members of its block, the first
      in fixed orders, and verified links are merged to components.  The R-trees then only look at
      pairs whose components still differ, so a group of n near copies costs n
      checks and not n squared.  Blocks over ``tile`` points are split by size
      strata and tiles.

Nothing is capped or sampled: every link between different components is
verified, so the components are exact (up to 64-bit hash collisions).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .components import connected_components
from .shared import cut, drop_folder, map_array, new_folder, put_file, tidy
from .words import SPACE_WORDS, chunk_rows, mix, shingle_sets, signed, text_buffers, words

LEAF = 32


# ---------------------------------------------------------------- set bounds

def need_overlap(na, nb, num: int, den: int):
    """Smallest overlap with den * overlap >= num * union."""
    return -(-(num * (na + nb)) // (num + den))


def groups_of(n: int) -> int:
    """Groups of a set of n shingles, a power of two: one or two shingles in each,
    so that what two sets don't share rarely meets in a group by chance."""
    return 1 << max(4, (max(n, 1) // 2).bit_length())


def count_vector(s: np.ndarray) -> np.ndarray:
    """Counts by group, at most 255: shingles are distinct and their hashes mixed,
    so the limit is never met (and is checked)."""
    g = groups_of(len(s))
    v = np.bincount((s & np.uint64(g - 1)).astype(np.int64), minlength=g)
    if v.max(initial=0) > 255:
        raise ValueError("a group of more than 255 shingles")
    return v.astype(np.uint8)


def _text_sets(docs: DataFrame, id_col: str, text_col: str, k: int, make, schema: T.StructType) -> DataFrame:
    """``make(ids, sets, offsets)`` -> record batch, over chunks of documents."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = text_buffers(b.column(1))
            for lo, hi in chunk_rows(off):
                h, _, _, first = words(buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], SPACE_WORDS)
                sets, at = shingle_sets(h, first, k)
                yield from make(b.column(0).slice(lo, hi - lo), sets, at)

    return src.mapInArrow(tidy(run), schema)


def _fingerprint(s: np.ndarray) -> bytes:
    a = mix(s).sum(dtype=np.uint64)
    b = np.bitwise_xor.reduce(mix(s + np.uint64(0xD1B54A32D192ED03))) if len(s) else np.uint64(0)
    return np.array([a, b ^ np.uint64(len(s))], dtype=np.uint64).tobytes()


# ------------------------------------------------------------- the operators

# ------------------------------------------------- how frequent shingles are

def _segments(batches, column: int, k: int, size: int):
    """A partition's documents in segments of at most ``size`` shingles (a longer
    document alone): (ids, sets, offsets)."""
    held: list = []

    def joined():
        ids = pa.concat_arrays([x[0] for x in held])
        at = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(x[2]) for x in held]))])
        return ids, np.concatenate([x[1] for x in held]), at

    n = 0
    for b in batches:
        buf, off = text_buffers(b.column(column))
        for lo, hi in chunk_rows(off):
            h, _, _, first = words(buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], SPACE_WORDS)
            sets, at = shingle_sets(h, first, k)
            if held and n + len(sets) > size:
                yield joined()
                held, n = [], 0
            held.append((b.column(0).slice(lo, hi - lo), sets, at))
            n += len(sets)
    if held:
        yield joined()


def _short(sets: np.ndarray, bits: int) -> np.ndarray:
    return sets >> np.uint64(64 - bits)


def _packed(sorted_keys: np.ndarray) -> bytes:
    """Differences of sorted keys by byte planes, which the shuffle compresses."""
    d = np.diff(sorted_keys, prepend=np.uint64(0))
    planes = d.view(np.uint8).reshape(-1, 8)
    used = 8
    while used > 1 and not planes[:, used - 1].any():
        used -= 1
    return bytes([used]) + np.ascontiguousarray(planes[:, :used].T).tobytes()


def _unpacked(data) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    used = int(raw[0])
    planes = np.zeros(((len(raw) - 1) // used, 8), np.uint8)
    planes[:, :used] = raw[1:].reshape(used, -1).T
    return np.cumsum(planes.view(np.uint64).ravel(), dtype=np.uint64)


def _checksum(keys: np.ndarray) -> int:
    return int(np.bitwise_xor.reduce(mix(keys)) if len(keys) else 0) >> 1


def frequency_classes(docs: DataFrame, id_col: str, text_col: str, k: int, folder: str, shards: int, bits: int,
                      segment: int) -> None:
    """Write, for every segment of every partition of ``docs``, the class of each
    of its distinct shingles: the logarithm of the number of documents that hold
    it (0: only one).

    A segment sends its sorted shingles (``bits`` of their hash) to shards by
    range; a shard counts them over all documents and sends the classes back,
    a byte for a shingle.  Nothing is gathered at one place."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    shift = np.uint64(bits - (shards.bit_length() - 1))

    def send(batches):
        part = TaskContext.get().partitionId()
        for j, (_, sets, _) in enumerate(_segments(batches, 1, k, segment)):
            u, c = np.unique(_short(sets, bits), return_counts=True)
            c = np.minimum(c, 65535).astype(np.uint16)
            cut_at = np.searchsorted(u, np.arange(shards + 1, dtype=np.uint64) << shift)
            full = [s for s in range(shards) if cut_at[s + 1] > cut_at[s]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(full, pa.int64()), pa.array([part] * len(full), pa.int64()), pa.array([j] * len(full), pa.int64()),
                 pa.array([_packed(u[cut_at[s]:cut_at[s + 1]] - (np.uint64(s) << shift)) for s in full], pa.binary()),
                 pa.array([c[cut_at[s]:cut_at[s + 1]].tobytes() for s in full], pa.binary())],
                ["shard", "part", "seg", "keys", "counts"])

    def count(key, t):
        keys = [_unpacked(x.as_buffer()) for x in t.column("keys")]
        counts = np.concatenate([np.frombuffer(x.as_buffer(), np.uint16) for x in t.column("counts")])
        u, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(inverse, weights=counts, minlength=len(u))
        level = np.log2(total).astype(np.uint8)[inverse]
        ends = np.cumsum([len(x) for x in keys])
        return pa.table({"shard": t.column("shard"), "part": t.column("part"), "seg": t.column("seg"),
                         "level": pa.array([x.tobytes() for x in np.split(level, ends[:-1])], pa.binary()),
                         "sums": pa.array([_checksum(x + (np.uint64(key[0].as_py()) << shift)) for x in keys], pa.int64())})

    def write(key, t):
        t = t.sort_by("shard")
        total = 0
        for x in t.column("sums").to_pylist():
            total ^= x
        level = b"".join(t.column("level").to_pylist())
        put_file(folder, f"{key[0].as_py()}-{key[1].as_py()}",
                 np.array([total], "<i8").tobytes() + zstandard.ZstdCompressor(level=1).compress(level))
        return pa.table({"n": [len(level)]})

    (src.mapInArrow(tidy(send), "shard long, part long, seg long, keys binary, counts binary").groupBy("shard")
     .applyInArrow(count, "shard long, part long, seg long, level binary, sums long").groupBy("part", "seg")
     .applyInArrow(write, "n long").agg(F.sum("n")).collect())


def _classes_of(folder: str, part: int, j: int, u: np.ndarray) -> np.ndarray:
    if not len(u):
        return np.zeros(0, np.uint8)
    raw = map_array(folder, f"{part}-{j}", np.uint8).tobytes()
    level = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[8:], max_output_size=len(u) + 1), np.uint8)
    if len(level) != len(u) or int(np.frombuffer(raw[:8], "<i8")[0]) != _checksum(u):
        raise ValueError("the documents came in another order when read again; write them to a table first")
    return level


# ------------------------------------------------------------- the operator

def document_sets(docs: DataFrame, id_col: str, text_col: str, k: int, num: int, den: int, folder: str, bits: int,
                  segment: int, heavy_class: int) -> DataFrame:
    """(id, key, n, fp, prefix, heavy, vec): a hash of the text, set size, fingerprint of the set, those
    shingles of its prefix that other documents hold too (``heavy`` of them, the
    last ones, are held by 2**heavy_class or more), and the point."""
    src = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("key")).alias("id"),
                      F.col(text_col).cast("string").alias("text"))

    def run(batches):
        part = TaskContext.get().partitionId()
        for j, (ids, sets, at) in enumerate(_segments(batches, 1, k, segment)):
            short = _short(sets, bits)
            u, inverse = np.unique(short, return_inverse=True)
            level = _classes_of(folder, part, j, u)[inverse]
            n, fps, prefixes, heavy, vecs = np.diff(at), [], [], [], []
            for i in range(len(n)):
                s, f = sets[at[i]:at[i + 1]], level[at[i]:at[i + 1]]
                m = len(s)
                p = m - -(-num * m // den) + 1 if m else 0
                o = np.argsort(f, kind="stable")[:p]             # by class, then by hash
                o = o[f[o] > 0]
                fps.append(_fingerprint(s))
                prefixes.append(s[o])
                heavy.append(int((f[o] >= heavy_class).sum()))
                vecs.append(count_vector(s).tobytes() if len(o) else b"")
            po = np.concatenate([[0], np.cumsum([len(x) for x in prefixes])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n.astype(np.int32)), pa.array(fps, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(po), pa.array(signed(np.concatenate(prefixes)))),
                 pa.array(heavy, pa.int32()), pa.array(vecs, pa.binary())],
                ["id", "n", "fp", "prefix", "heavy", "vec"])

    return src.mapInArrow(tidy(run), T.StructType([
        src.schema["id"], T.StructField("n", T.IntegerType()),
        T.StructField("fp", T.BinaryType()), T.StructField("prefix", T.ArrayType(T.LongType())),
        T.StructField("heavy", T.IntegerType()), T.StructField("vec", T.BinaryType())])) \
        .select("id.id", "id.key", "n", "fp", "prefix", "heavy", "vec")


def _member_hash():
    return [F.count(F.lit(1)), F.bit_xor(F.xxhash64("c", F.lit(1))), F.bit_xor(F.xxhash64("c", F.lit(2)))]


def blocks(reps: DataFrame) -> DataFrame:
    """(sig, c): members of the blocks of two or more classes; blocks with the
    same members come out once."""
    reps = reps.where(F.size("prefix") > 0)
    rare = reps.select("c", F.explode(F.slice("prefix", F.lit(1), F.size("prefix") - F.col("heavy"))).alias("token"))
    w = Window.partitionBy("token")
    cnt, x1, x2 = _member_hash()
    rare = (rare.select("c", "token", cnt.over(w).alias("m"), x1.over(w).alias("x1"), x2.over(w).alias("x2"))
            .where("m > 1").select("c", F.xxhash64("m", "x1", "x2").alias("sig")))
    # frequent shingles: aggregated before the shuffle, then joined back (a join
    # that Spark can split), as one of them may belong to a third of all rows
    freq = reps.where("heavy > 0").select(
        "c", F.explode(F.slice("prefix", F.size("prefix") - F.col("heavy") + 1, F.col("heavy"))).alias("token"))
    of = (freq.groupBy("token").agg(cnt.alias("m"), x1.alias("x1"), x2.alias("x2")).where("m > 1")
          .select("token", F.xxhash64("m", "x1", "x2").alias("sig")))
    freq = freq.join(of, "token").select("c", "sig")
    return rare.unionByName(freq).distinct().select("sig", "c")


def _matrix(vecs: list[bytes], g: int) -> np.ndarray:
    """Points of any numbers of groups (at least g) at g groups."""
    out = np.empty((len(vecs), g), dtype=np.int32)
    for i, v in enumerate(vecs):
        out[i] = np.frombuffer(v, dtype=np.uint8).reshape(-1, g).sum(axis=0)
    return out


def summed_minima(va: bytes, vb: bytes) -> int:
    """Upper bound of the overlap of two sets from their points."""
    a, b = np.frombuffer(va, np.uint8), np.frombuffer(vb, np.uint8)
    g = min(len(a), len(b))
    a, b = (x if len(x) == g else x.reshape(-1, g).sum(axis=0) for x in (a, b))
    return int(np.minimum(a, b).sum())


class RTree:
    """Points packed into leaves of LEAF neighbours in (order, size, first counts),
    FAN nodes to a parent up to one root; a node's box is its largest count by group
    and the ranges of its sizes and labels."""

    COARSE = 64
    FAN = 8
    AT_ONCE = 256       # pairs of nodes opened together

    def __init__(self, n: np.ndarray, vecs: list[bytes], label: np.ndarray):
        g = min(self.COARSE, min((len(v) for v in vecs), default=16))
        coarse = _matrix(vecs, g)
        o = np.lexsort((coarse[:, 1], coarse[:, 0], n, label))
        self.order, self.n, self.label = o, n[o], label[o]
        self.vecs = [vecs[i] for i in o]
        self.coarse = coarse[o]
        cuts = np.arange(0, len(o), LEAF)
        self.cuts = np.append(cuts, len(o))
        self.levels = [self._boxes((self.coarse, self.n, self.n, self.label, self.label), cuts)]     # leaves first
        while len(self.levels[-1][0]) > 1:
            self.levels.append(self._boxes(self.levels[-1], np.arange(0, len(self.levels[-1][0]), self.FAN)))

    @staticmethod
    def _boxes(below, cuts: np.ndarray):
        """(hi, n_lo, n_hi, l_lo, l_hi) of the runs of boxes that start at ``cuts``."""
        best = np.maximum, np.minimum, np.maximum, np.minimum, np.maximum
        return tuple(f.reduceat(x, cuts, axis=0) for f, x in zip(best, below))

    def _passing(self, level: int, i: np.ndarray, j: np.ndarray, num: int, den: int):
        """The pairs of nodes of a level that may hold a pair of points."""
        hi, n_lo, n_hi, l_lo, l_hi = self.levels[level]
        ok = num * np.maximum(n_lo[i], n_lo[j]) <= den * np.minimum(n_hi[i], n_hi[j])
        ok &= ~((l_lo[i] == l_hi[i]) & (l_lo[j] == l_hi[j]) & (l_lo[i] == l_lo[j]))
        i, j = i[ok], j[ok]
        box = np.minimum(hi[i], hi[j]).sum(axis=1)
        ok = box >= need_overlap(n_lo[i], n_lo[j], num, den)
        return i[ok], j[ok]

    def _opened(self, level: int, i: np.ndarray, j: np.ndarray):
        """All pairs of children of pairs of nodes, each pair (lower, higher) once."""
        x = (i[:, None] * self.FAN + np.arange(self.FAN))[:, :, None]
        y = (j[:, None] * self.FAN + np.arange(self.FAN))[:, None, :]
        ok = (x <= y) & (y < len(self.levels[level - 1][0]))
        x, y = np.broadcast_arrays(x, y)
        return x[ok], y[ok]

    def self_join(self, num: int, den: int, skip=lambda i, j: False) -> Iterator[tuple[int, int]]:
        """Pairs (positions in the input) with different labels that the bound
        lets through, but for those to ``skip``, by descent from the root."""
        top = np.zeros(min(1, len(self.levels[-1][0])), np.int64)
        stack = [(len(self.levels) - 1, top, top)]
        while stack:
            level, i, j = stack.pop()
            i, j = self._passing(level, i, j, num, den)
            if level:
                for a in range(0, len(i), self.AT_ONCE):
                    stack.append((level - 1, *self._opened(level, i[a:a + self.AT_ONCE], j[a:a + self.AT_ONCE])))
            else:
                for x, y in zip(i.tolist(), j.tolist()):
                    yield from self._leaves(x, y, num, den, skip)

    def _leaves(self, a: int, b: int, num: int, den: int, skip):
        sa, sb = slice(self.cuts[a], self.cuts[a + 1]), slice(self.cuts[b], self.cuts[b + 1])
        na, nb = self.n[sa][:, None], self.n[sb][None, :]
        ok = (num * np.maximum(na, nb) <= den * np.minimum(na, nb)) & (self.label[sa][:, None] != self.label[sb][None, :])
        if a == b:
            ok &= np.tri(len(ok), k=-1, dtype=bool)
        need = need_overlap(na, nb, num, den)
        x, y = np.nonzero(ok)
        if not len(x):
            return
        ca, cb = self.coarse[sa], self.coarse[sb]
        keep = np.minimum(ca[x], cb[y]).sum(axis=1) >= need[x, y]
        x, y = x[keep], y[keep]
        for p, q in zip(x, y):
            i, j = sa.start + p, sb.start + q
            if not skip(self.order[i], self.order[j]) and summed_minima(self.vecs[i], self.vecs[j]) >= need[p, q]:
                yield int(self.order[i]), int(self.order[j])


def _bound_filter(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) of rows (a, na, va, b, nb, vb) whose summed minima reach the need."""
    def run(batches):
        for t in batches:
            a, na, va, b, nb, vb = (t.column(i) for i in range(6))
            na, nb = na.to_numpy().astype(np.int64), nb.to_numpy().astype(np.int64)
            need = need_overlap(na, nb, num, den)
            keep = np.fromiter((summed_minima(x, y) >= m for x, y, m in zip(va.to_pylist(), vb.to_pylist(), need)),
                               dtype=bool, count=len(need))
            yield pa.RecordBatch.from_arrays([a.filter(pa.array(keep)), b.filter(pa.array(keep))], ["a", "b"])

    return (pairs.where(F.lit(num) * F.greatest("na", "nb") <= F.lit(den) * F.least("na", "nb"))
            .select("a", "na", "va", "b", "nb", "vb").mapInArrow(tidy(run), "a long, b long"))


def verified(docs: DataFrame, reps: DataFrame, pairs: DataFrame, id_col: str, text_col: str, k: int,
             num: int, den: int, broadcast_rows: int = 1_000_000) -> DataFrame:
    """The pairs (a, b) of classes that link, by their full sets.  Sets are made
    again from the texts of the classes that occur; the ids asked for are
    broadcast while there are few of them, else joined by shuffle."""
    def sets_of(side: str) -> DataFrame:
        want = pairs.select(F.col(side).alias("c")).distinct().join(reps.select("c", "rep", "fp"), "c")
        ids = want.select(F.col("rep").alias(id_col)).distinct()
        if n_pairs <= broadcast_rows:
            ids = F.broadcast(ids)
        some = docs.select(id_col, text_col).join(ids, id_col, "left_semi")

        def make(_, sets, at):
            rows = [sets[at[i]:at[i + 1]] for i in range(len(at) - 1)]
            yield pa.RecordBatch.from_arrays([pa.array([_fingerprint(s) for s in rows], pa.binary()),
                                              pa.array([s.tobytes() for s in rows], pa.binary())], ["fp", "items"])

        made = _text_sets(some, id_col, text_col, k, make, T.StructType([
            T.StructField("fp", T.BinaryType()), T.StructField("items", T.BinaryType())]))
        return made.join(want.select("c", "fp"), "fp").dropDuplicates(["c"]).select(
            F.col("c").alias(side), F.col("items").alias(f"items_{side}"))

    def run(batches):
        for t in batches:
            out = np.zeros(t.num_rows, dtype=bool)
            for i, (x, y) in enumerate(zip(t.column(2), t.column(3))):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                both = int((y[at] == x).sum())
                out[i] = den * both >= num * (len(x) + len(y) - both)
            keep = pa.array(out)
            yield pa.RecordBatch.from_arrays([t.column(0).filter(keep), t.column(1).filter(keep)], ["u", "v"])

    n_pairs = pairs.count()
    return (pairs.join(sets_of("a"), "a").join(sets_of("b"), "b").select("a", "b", "items_a", "items_b")
            .mapInArrow(tidy(run), "u long, v long"))


def tree_pairs(members: DataFrame, point: DataFrame, num: int, den: int, tile: int, early: int = 32) -> DataFrame:
    """(a, b): pairs with different components that the R-trees let through.

    ``members``: (sig, c, comp), ``point``: (c, n, vec).  A block of up to ``tile``
    rows is one tree.  A larger one is split by size strata (sizes that link are at
    most one stratum apart, so a row goes to two cells), and a cell that is still
    larger into tiles, of which every two meet.

    Two classes often share many blocks.  Each row carries its class's first
    ``early`` block numbers, and a pair that shares an earlier block by these is
    left to that one."""
    step = math.log(den / num) * (1 + 1e-9) if num < den else 1e-6
    size = members.groupBy("sig").agg(F.count(F.lit(1)).alias("m"), F.min("comp").alias("lo"),
                                      F.max("comp").alias("hi")).where("lo <> hi").select("sig", "m")
    own = members.groupBy("c").agg(F.slice(F.sort_array(F.collect_set("sig")), 1, early).alias("sigs"))
    live = members.join(size, "sig").join(point.join(own, "c"), "c").withColumn(
        "s", F.floor(F.log(F.col("n").cast("double")) / F.lit(step)).cast("long"))
    zero = F.lit(0).cast("long")
    small = live.where(F.col("m") <= tile).select(
        "sig", zero.alias("cell"), zero.alias("p"), zero.alias("q"), zero.alias("t"), zero.alias("s"), "c", "n", "vec",
        "comp", "sigs")
    big = live.where(F.col("m") > tile).withColumn("cell", F.explode(F.array(F.col("s"), F.col("s") - 1)))
    cells = (big.groupBy("sig", "cell").agg(F.count(F.lit(1)).alias("mc"))
             .select("sig", "cell", F.ceil(F.col("mc") / F.lit(tile)).cast("long").alias("tiles")))
    big = (big.join(cells, ["sig", "cell"])
           .withColumn("t", F.pmod(F.xxhash64("c"), F.col("tiles")))
           .withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
           .select("sig", "cell", F.least("t", "o").alias("p"), F.greatest("t", "o").alias("q"), "t", "s",
                   "c", "n", "vec", "comp", "sigs"))
    rows = small.unionByName(big)

    def run(key, t):
        sig, cell, p, q = (x.as_py() for x in key)
        c = t.column("c").to_numpy()
        n = t.column("n").to_numpy().astype(np.int64)
        comp, own, s = (t.column(k).to_numpy() for k in ("comp", "t", "s"))
        sigs = [frozenset(x for x in y if x < sig) for y in t.column("sigs").to_pylist()]
        a, b = [], []

        def skip(i, j):
            return not sigs[i].isdisjoint(sigs[j]) or p != q and own[i] == own[j] or min(s[i], s[j]) != cell

        if len(c) > 1 and (comp != comp[0]).any():
            for i, j in RTree(n, t.column("vec").to_pylist(), comp).self_join(num, den, skip):
                a.append(min(c[i], c[j]))
                b.append(max(c[i], c[j]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return (rows.groupBy("sig", "cell", "p", "q").applyInArrow(run, "a long, b long").distinct())


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5,
                       num: int = 80, den: int = 100, tile: int = 512, bits: int = 40,
                       segment: int = 1_000_000, heavy_class: int = 7, anchors: int = 4, keep_key: bool = False) -> DataFrame:
    """One row per row of ``docs``: (id_col, n_shingles, component_id), with
    ``keep_key`` also ``key``, the xxhash64 of the text.

    Two documents link when ``den * intersection >= num * union`` of their sets
    of distinct k-word shingles (words ``[^\\x20\\x09-\\x0D]+``, A-Z lowered; with
    fewer than k words, the whole sequence is the one shingle).  component_id is
    the smallest id reachable by links.

    Null or empty texts and texts without words have the empty set, link with
    nothing and are their own component.  Rows with a null id keep their row and
    take the component of their equals (null if those have no id either) but
    start no links.  Repeated rows come out once each.  An empty table gives an
    empty result.  Other columns are not looked at.

    ``docs`` is read several times and has to come in the same partitions each
    time, as tables read from files do; where its plan has an exchange, its ids
    and texts are checkpointed first."""
    spark = docs.sparkSession
    if "Exchange" in docs._jdf.queryExecution().executedPlan().toString():
        docs = cut(docs.select(id_col, text_col))
    folder = new_folder(spark, "classes")
    shards = 1 << (4 * docs.rdd.getNumPartitions() - 1).bit_length()
    frequency_classes(docs, id_col, text_col, k, folder, shards, bits, segment)
    sets = cut(document_sets(docs, id_col, text_col, k, num, den, folder, bits, segment, heavy_class)
               .withColumn("row", F.monotonically_increasing_id()))
    drop_folder(spark, folder)
    classes = (sets.where("n > 0 and id is not null").groupBy("fp")
               .agg(F.min(F.struct("id", "row")).alias("r")).select("fp", F.col("r.id").alias("rep"), F.col("r.row").alias("c")))
    reps = cut(sets.join(classes.select("fp", "rep", F.col("c").alias("row")), ["fp", "row"])
               .select(F.col("row").alias("c"), "rep", "fp", "n", "prefix", "heavy", "vec"))
    member = cut(blocks(reps))
    point = reps.select("c", "n", "vec")

    def pointed(pairs):
        """Pairs (a, b) with the points of both."""
        return (pairs.join(point.select(F.col("c").alias("a"), F.col("n").alias("na"), F.col("vec").alias("va")), "a")
                .join(point.select(F.col("c").alias("b"), F.col("n").alias("nb"), F.col("vec").alias("vb")), "b"))

    # the first members of a block in a few fixed orders: near copies of one text
    # share most blocks, and so these members
    first_in = [F.min("c")] + [F.min_by("c", F.xxhash64("c", F.lit(i))) for i in range(1, anchors)]
    anchor = member.groupBy("sig").agg(F.array_distinct(F.array(*first_in)).alias("a")).select("sig", F.explode("a").alias("a"))
    first = member.join(anchor, "sig").where("c <> a").select(
        F.least("a", "c").alias("a"), F.greatest("a", "c").alias("b")).distinct()
    first = cut(_bound_filter(pointed(first), num, den))
    edges = cut(verified(docs, reps, first, id_col, text_col, k, num, den))
    comp = cut(connected_components(edges))

    member = member.join(comp.select(F.col("node").alias("c"), "label"), "c", "left").select(
        "sig", "c", F.coalesce("label", "c").alias("comp"))
    second = cut(tree_pairs(member, point, num, den, tile))
    more = verified(docs, reps, second, id_col, text_col, k, num, den)
    # the components found so far are stars; what follows only joins them
    stars = comp.select(F.col("node").alias("u"), F.col("label").alias("v"))
    comp = connected_components(stars.unionByName(more))

    named = reps.select("c", "fp", "rep").join(comp.select(F.col("node").alias("c"), "label"), "c", "left") \
        .select("fp", "rep", F.coalesce("label", "c").alias("label"))
    least = named.groupBy("label").agg(F.min("rep").alias("component"))
    of = named.join(least, "label").select("fp", "component")
    return sets.select("id", "key", "n", "fp").join(of, "fp", "left").select(
        F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("id")).otherwise(F.coalesce("component", "id")).alias("component_id"),
        *(["key"] if keep_key else []))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80,
                         den: int = 100) -> DataFrame:
    """``docs`` with one document of each component of
    :func:`ngram_jaccard_join`: the one of the smallest id.  Documents without
    words stay.  Rows that repeat both id and text are one document, of which one
    row stays: the first by a hash of all its columns.  A row without id stays unless it has equals with one."""
    comp = ngram_jaccard_join(docs, id_col, text_col, k, num, den, keep_key=True)
    own = F.col(id_col).eqNullSafe(F.col("component_id"))
    stay = comp.where(own).select(F.col(id_col).alias("sid"), F.col("key").alias("skey")).distinct()
    # the row as one value, so no column of it meets the names used here
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("id"),
                        F.xxhash64(F.col(f"`{text_col}`")).alias("key"))
    kept = keyed.join(stay, (F.col("key") == F.col("skey")) & F.col("id").eqNullSafe(F.col("sid")), "left_semi")
    # of repeated rows the first by a hash of all their columns
    first = Window.partitionBy("key", "id").orderBy(F.xxhash64("row"), F.to_json("row"))
    return kept.withColumn("place", F.row_number().over(first)).where("place = 1").select(
        *[F.col("row")[c].alias(c) for c in docs.columns])
