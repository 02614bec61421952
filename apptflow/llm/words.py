"""Vectorised words, hashes and shingles over Arrow text columns.

Words are found byte-wise in UTF-8 (every separator class used here is ASCII,
so bytes of multi-byte characters are always word bytes) and hashed to 64 bits
without a Python loop over words.  Texts are handled in chunks of a few
megabytes, so memory follows the chunk and the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 4 << 20
BLOCK_BYTES = 1 << 20      # of the passes over bytes, whose arrays are the largest

_U = np.uint64
_M1, _M2, _M3 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0x9E3779B97F4A7C15)


def _class_table(separators: set[int], lower: bool) -> np.ndarray:
    """256 entries: 0 for a separator, else the byte (A-Z lowered if asked)."""
    t = np.arange(256, dtype=np.uint8)
    if lower:
        t[ord("A"):ord("Z") + 1] += 32
    t[sorted(separators)] = 0
    return t


WHITE = {0x20, *range(0x09, 0x0E)}
# [^\x20\x09-\x0D]+ with A-Z lowered
SPACE_WORDS = _class_table(WHITE, True)
SPACE_WORDS_CASED = _class_table(WHITE, False)
# NUL is a word byte under [^\x20\x09-\x0D]; 0 marks separators, so it maps to a
# byte that UTF-8 never uses.
SPACE_WORDS[0] = SPACE_WORDS_CASED[0] = 0xFF
# [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lowering A-Z
ALNUM_WORDS = _class_table(set(range(0x00, 0x30)) | set(range(0x3A, 0x41)) | set(range(0x5B, 0x61))
                           | set(range(0x7B, 0x80)), True)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective, so distinct inputs stay distinct)."""
    x = x ^ (x >> _U(30))
    x = x * _M1
    x ^= x >> _U(27)
    x *= _M2
    x ^= x >> _U(31)
    return x


_rng = np.random.RandomState(20240514)
_BYTE = _rng.randint(1, 1 << 62, 256, dtype=np.int64).astype(np.uint64) | _U(1)
_BYTE[0] = 0
_POS = mix(np.arange(1, 1025, dtype=np.uint64) * _M3) | _U(1)
_POS2 = mix(np.arange(5001, 5001 + 1024, dtype=np.uint64) * _M3) | _U(1)
_POS2[0] = 1


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null texts count as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    off = np.frombuffer(col.buffers()[1], dtype=np.int64, count=len(col) + 1 + col.offset)[col.offset:]
    data = col.buffers()[2]
    if data is None or len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    buf = np.frombuffer(data, dtype=np.uint8)
    return buf[off[0]:off[-1]], off - off[0]


def chunk_rows(offsets: np.ndarray, max_bytes: int = CHUNK_BYTES,
               max_rows: int = 1 << 17) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of at most ``max_bytes`` of text (a longer text alone)."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + max_bytes, side="right")) - 1
        b = min(max(b, a + 1), a + max_rows, n)
        yield a, b
        a = b


def _hash_block(mapped: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of one block of mapped bytes; ``cuts``: positions where a word must
    start anew (text starts).  Returns (hash, start, end)."""
    word = mapped != 0
    edge = np.empty(len(word) + 1, dtype=bool)
    edge[0], edge[-1] = word[0], word[-1]
    np.not_equal(word[1:], word[:-1], out=edge[1:-1])
    begin = np.zeros(len(word) + 1, dtype=bool)
    begin[:-1] = edge[:-1] & word
    stop = edge.copy()
    stop[:-1] &= ~word
    if len(cuts):
        c = cuts[(cuts > 0) & (cuts < len(word))]
        c = c[word[c] & word[c - 1]]
        begin[c] = True
        stop[c] = True
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop)
    if not len(starts):
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z
    pos = np.arange(len(word), dtype=np.int32)
    anchor = np.zeros(len(word), dtype=np.int32)
    anchor[starts] = starts
    np.maximum.accumulate(anchor, out=anchor)
    pos -= anchor
    val = _BYTE[mapped]
    if (ends - starts).max() > 1024:     # long words (pos also counts the separators after a word)
        val *= _POS2[(pos >> 10) & 1023]
    val *= _POS[pos & 1023]
    h = np.add.reduceat(val, starts)
    return mix(h + (ends - starts).astype(np.uint64) * _M3), starts, ends


def words(buf: np.ndarray, offsets: np.ndarray, table: np.ndarray, block: int = BLOCK_BYTES):
    """Word hashes of texts in ``buf``.

    Returns (hash, start, end, first): first[i]:first[i+1] are text i's words.
    The byte passes run block by block, cut at separators, so a very long text
    costs memory by its words only."""
    hs, ss, es = [], [], []
    a, n = 0, len(buf)
    while a < n:
        b = min(n, a + block)
        while b < n and table[buf[b - 1]] != 0:      # to the end of the word
            step = table[buf[b:b + 65536]] == 0
            k = int(step.argmax())
            if step[k]:
                b += k + 1
            else:
                b = min(n, b + 65536)
        lo, hi = np.searchsorted(offsets, [a, b])
        h, s, e = _hash_block(table[buf[a:b]], offsets[lo:hi + 1] - a)
        hs.append(h)
        ss.append(s + a)
        es.append(e + a)
        a = b
    if not hs:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, np.zeros(len(offsets), np.int64)
    h, s, e = (np.concatenate(x) if len(x) > 1 else x[0] for x in (hs, ss, es))
    return h, s, e, np.searchsorted(s, offsets).astype(np.int64)


def run_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive entries (len(h) - k + 1 of them)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    x = mix(h[:n] + _M3)
    for j in range(1, k):
        x = x * _M2 + h[j:j + n]
        x ^= x >> _U(29)
    return mix(x)


def shingle_sets(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-word shingle hashes of each text.

    A text of fewer than k words, but not none, has one shingle: its whole
    sequence.  Returns (hashes, offsets by text)."""
    n = len(first) - 1
    count = np.diff(first)
    size = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    out = np.concatenate([[0], np.cumsum(size)])
    row = np.repeat(np.arange(n, dtype=np.int64), size)
    rolled = run_hash(h, k)
    at = np.arange(out[-1]) + np.repeat(first[:-1] - out[:-1], size)
    val = rolled[np.minimum(at, len(rolled) - 1)] if len(rolled) else np.zeros(out[-1], np.uint64)
    for i in np.flatnonzero((count > 0) & (count < k)):
        val[out[i]] = run_hash(h[first[i]:first[i + 1]], int(count[i]))[0] ^ _U(int(count[i]))
    for i in np.flatnonzero(size > 1):
        val[out[i]:out[i + 1]].sort()
    keep = np.ones(len(val), dtype=bool)
    keep[1:] = (val[1:] != val[:-1]) | (row[1:] != row[:-1])
    return val[keep], np.concatenate([[0], np.cumsum(keep)])[out].astype(np.int64)


def signed(x: np.ndarray) -> np.ndarray:
    """uint64 hashes as Spark's long, same bits."""
    return x.view(np.int64)
