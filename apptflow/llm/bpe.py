"""BPE encoding and decoding over a minimal acyclic transducer.

The vocabulary file's frequent words are compiled into a lexicon: a minimal
acyclic automaton over bytes (words that end alike share their suffix states)
whose arcs count the words below them, so that walking a word also gives its
rank, and the rank gives the word's ids.  The flat arrays are written once to
the shared folder and memory-mapped by every task.  Distinct words of a batch
walk the automaton side by side, one byte a step; words it doesn't hold are
merged exactly, by the ranks of the vocabulary's merges.

Text is split as the vocabulary file says: NFC, lower case by character, then
the pieces of its pattern; special tokens' strings are cut out of the raw text
first.  Decoding gives the token strings joined by one space (the file has no
decoder), and :func:`plain_text` the words.
"""

from __future__ import annotations

import itertools
import json
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import map_array, new_folder, put_file, tidy
from .words import SPACE_WORDS, chunk_rows, text_buffers, words

WORD_END = "</w>"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where it is
    printable Latin-1, else the next code point from 256 on."""
    own = set(range(ord("!"), ord("~") + 1)) | set(range(0xA1, 0xAD)) | set(range(0xAE, 0x100))
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Merges, ids and special tokens of a ``tokenizers`` file of kind BPE with
    word ends and a byte-level alphabet."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        self.ids: dict[str, int] = spec["model"]["vocab"]
        self.rank = {tuple(m.split(" ")) if isinstance(m, str) else tuple(m): i
                     for i, m in enumerate(spec["model"]["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        # white space by its code points: engines differ in what \s holds
        white = r"\t-\r \x85\xa0  -     　"
        self.pieces = regex.compile(pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^{white}\p{{L}}\p{{N}}]"))
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") \
            if self.special else None
        self.letters = byte_alphabet()

    def merge(self, piece: str) -> list[int]:
        """Ids of one piece: the lowest-ranked pair is merged, leftmost first,
        until no pair has a rank."""
        s = [self.letters[b] for b in piece.encode("utf-8")]
        if not s:
            return []
        s[-1] += WORD_END
        if len(s) > 64:
            return [self.ids[x] for x in _merge_long(s, self.rank)]
        while len(s) > 1:
            best = min(range(len(s) - 1), key=lambda i: self.rank.get((s[i], s[i + 1]), 1 << 60))
            if (s[best], s[best + 1]) not in self.rank:
                break
            s[best:best + 2] = [s[best] + s[best + 1]]
        return [self.ids[x] for x in s]

    def split(self, text: str) -> list[str | int]:
        """Pieces of a text, special tokens as ids."""
        if self.cut is None or "<|" not in text:
            return self.pieces.findall(self.normalise(text))
        out: list[str | int] = []
        for part in self.cut.split(text):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out += self.pieces.findall(self.normalise(part))
        return out

    @staticmethod
    def normalise(text: str) -> str:
        """NFC, then lower case one character at a time (no final sigma)."""
        if text.isascii():
            return text.lower()
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def _merge_long(s: list[str], rank: dict) -> list[str]:
    """The same merges over a linked list with a heap, for long pieces."""
    import heapq
    left, right = list(range(-1, len(s) - 1)), list(range(1, len(s) + 1))
    alive = [True] * len(s)
    heap = [(rank[p], i, p) for i, p in enumerate(zip(s, s[1:])) if p in rank]
    heapq.heapify(heap)
    while heap:
        _, i, p = heapq.heappop(heap)
        j = right[i] if alive[i] else len(s)
        if j >= len(s) or (s[i], s[j]) != p:
            continue
        s[i] += s[j]
        alive[j] = False
        right[i] = right[j]
        if right[i] < len(s):
            left[right[i]] = i
        for a in (left[i], i):
            b = right[a] if a >= 0 else len(s)
            if b < len(s) and (q := (s[a], s[b])) in rank:
                heapq.heappush(heap, (rank[q], a, q))
    return [x for x, ok in zip(s, alive) if ok]


class Merger:
    """Merges of many words at once: a word is a row of ids, the pair table a hash
    table; each round merges every row's lowest-ranked pair, leftmost first."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.inner = np.array([v.ids[c] for c in v.letters], np.int32)
        self.last = np.array([v.ids[c + WORD_END] for c in v.letters], np.int32)
        pairs = [(v.ids[a], v.ids[b], v.ids[a + b]) for a, b in v.rank]       # in the order of their ranks
        left, right, made = (np.array(x, np.int64) for x in zip(*pairs))
        self.bits = max(4, int(4 * len(pairs)).bit_length())
        self.key = np.full(1 << self.bits, -1, np.int64)
        self.rank = np.full(1 << self.bits, 1 << 30, np.int32)
        self.made = np.zeros(1 << self.bits, np.int32)
        keys = left << 32 | right
        for k, at, i, m in zip(keys.tolist(), self._slot(keys).tolist(), range(len(pairs)), made.tolist()):
            while self.key[at] >= 0:
                at = (at + 1) & ((1 << self.bits) - 1)
            self.key[at], self.rank[at], self.made[at] = k, i, m

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Slots of the keys (an empty slot, with the largest rank, for others)."""
        at = self._slot(keys)
        todo = np.flatnonzero((self.key[at] != keys) & (self.key[at] >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            todo = todo[(self.key[at[todo]] != keys[todo]) & (self.key[at[todo]] >= 0)]
        return at

    def __call__(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        for lo, hi in ((1, 4), (5, 8), (9, 12), (13, 16), (17, 32), (33, 64)):
            pick = np.flatnonzero((size >= lo) & (size <= hi))
            for part in np.array_split(pick, len(pick) // 8192 + 1):
                if len(part):
                    self._merge([words[i] for i in part], size[part], hi, part, out)
        for i in np.flatnonzero(size > 64):
            out[i] = np.array(self.v.merge(words[i].decode("utf-8")), "<u4").tobytes()
        return out

    def _merge(self, words, size, width, part, out) -> None:
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width)
        ids = self.inner[raw]
        row = np.arange(len(words))
        ids[row, size - 1] = self.last[raw[row, size - 1]]
        size = size.copy()
        col = np.arange(width)
        live = np.flatnonzero(size > 1)
        while len(live):
            x = ids[live]
            keys = x[:, :-1].astype(np.int64) << 32 | x[:, 1:]
            slot = self._find(keys.ravel()).reshape(keys.shape)
            rank = self.rank[slot]
            rank[col[1:] >= size[live][:, None]] = 1 << 30      # behind the word's end
            best = rank.argmin(axis=1)
            n = np.arange(len(live))
            ok = rank[n, best] < 1 << 30
            live, x, best, made = live[ok], x[ok], best[ok], self.made[slot[n, best]][ok]
            if not len(live):
                break
            moved = np.take_along_axis(x, np.minimum(col + (col > best[:, None]), width - 1), axis=1)
            moved[np.arange(len(live)), best] = made
            ids[live] = moved
            size[live] -= 1
            live = live[size[live] > 1]
        data = ids.astype("<u4").tobytes()
        for j, (i, k) in enumerate(zip(part.tolist(), size.tolist())):
            out[i] = data[4 * j * width:4 * (j * width + k)]


# ------------------------------------------------------------------ the lexicon

def build_lexicon(words: list[bytes]) -> dict[str, np.ndarray]:
    """Flat arrays of the minimal acyclic automaton of sorted distinct words.

    States are numbered; state s has arcs first[s]:first[s+1], by label, with the
    target state and the number of words that sort before the arc among those of
    s (a word's rank is the sum along its path).  ``final`` marks word ends."""
    register: dict[tuple, int] = {}
    arcs: list[tuple] = []       # by state: ((label, target), ...)
    final: list[bool] = []

    def state(fin, out) -> int:
        key = (fin, tuple(out))
        if key not in register:
            register[key] = len(arcs)
            arcs.append(key[1])
            final.append(fin)
        return register[key]

    # path[i]: the open state after i bytes of the last word: [final, finished arcs]
    path: list[list] = [[False, []]]
    last = b""
    for w in words:
        k = 0
        while k < len(last) and k < len(w) and last[k] == w[k]:
            k += 1
        for i in range(len(last), k, -1):
            fin, out = path.pop()
            path[i - 1][1].append((last[i - 1], state(fin, out)))
        path += [[False, []] for _ in range(len(w) - k)]
        path[len(w)][0] = True
        last = w
    for i in range(len(last), 0, -1):
        fin, out = path.pop()
        path[i - 1][1].append((last[i - 1], state(fin, out)))
    root = state(*path[0])
    below = [0] * len(arcs)      # children are made before their parents
    for s, out in enumerate(arcs):
        below[s] = int(final[s]) + sum(below[t] for _, t in out)
    first = np.zeros(len(arcs) + 1, np.int32)
    label, target, skip = [], [], []
    for s, out in enumerate(arcs):
        n = int(final[s])
        for c, t in out:
            label.append(c)
            target.append(t)
            skip.append(n)
            n += below[t]
        first[s + 1] = len(label)
    return {"first": first, "label": np.array(label, np.uint8), "target": np.array(target, np.int32),
            "skip": np.array(skip, np.int32), "final": np.array(final, np.uint8), "root": np.array([root], np.int32)}


class Lexicon:
    """Words to ids by the mapped automaton arrays."""

    FIELDS = {"first": "<i4", "label": "u1", "target": "<i4", "skip": "<i4", "final": "u1", "root": "<i4",
              "id_at": "<i4", "ids": "<i4"}

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.a = arrays
        # one sorted key per arc: state and label
        self.key = np.repeat(np.arange(len(arrays["first"]) - 1, dtype=np.int64), np.diff(arrays["first"])) * 256 \
            + arrays["label"]

    @classmethod
    def mapped(cls, folder: str) -> "Lexicon":
        return cls({k: map_array(folder, k, t) for k, t in cls.FIELDS.items()})

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """Rank of each word among the lexicon's, -1 for others.  All words walk
        together, one byte a step."""
        n = len(words)
        out = np.full(n, -1, np.int64)
        if not n or not len(self.key):
            return out
        size = np.fromiter(map(len, words), np.int64, n)
        at = np.concatenate([[0], np.cumsum(size)])
        data = np.frombuffer(b"".join(words), np.uint8)
        live = np.flatnonzero(size > 0)
        state = np.full(len(live), int(self.a["root"][0]), np.int64)
        rank = np.zeros(len(live), np.int64)
        step = 0
        while len(live):
            want = state * 256 + data[at[live] + step]
            arc = np.searchsorted(self.key, want)
            ok = self.key[np.minimum(arc, len(self.key) - 1)] == want
            live, arc, rank = live[ok], arc[ok], rank[ok]
            state = self.a["target"][arc].astype(np.int64)
            rank = rank + self.a["skip"][arc]
            step += 1
            done = size[live] == step
            hit = done & (self.a["final"][state] != 0)
            out[live[hit]] = rank[hit]
            live, state, rank = live[~done], state[~done], rank[~done]
        return out


def frequent_words(texts: DataFrame, text_col: str, vocab_path: str, most: int) -> list[str]:
    """Up to ``most`` pieces to compile, most frequent first, then by name: counted
    over all texts in each task, where the less frequent half is let go whenever
    the table is full.  The lexicon only saves merging; ids never depend on it."""
    def run(batches):
        v, seen = _vocabulary(vocab_path), Counter()
        for b in batches:
            buf, off = text_buffers(b.column(0))
            for lo, hi in chunk_rows(off, 2 << 20):
                part = buf[off[lo]:off[hi]]
                h, s, e, _ = words(part, off[lo:hi + 1] - off[lo], SPACE_WORDS)
                _, at, n = np.unique(h, return_index=True, return_counts=True)
                at, n = at[n > 1], n[n > 1]
                data = part.tobytes()
                for i, j, c in zip(s[at].tolist(), e[at].tolist(), n.tolist()):
                    if j - i <= 64:
                        seen[data[i:j]] += c
            if len(seen) > 4 * most:
                seen = Counter(dict(seen.most_common(2 * most)))
        pieces = Counter()
        for w, c in seen.most_common(2 * most):
            for p in v.split(w.decode("utf-8")):
                if isinstance(p, str):
                    pieces[p] += c
        got = pieces.most_common(most)
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in got], pa.string()),
                                          pa.array([c for _, c in got], pa.int64())], ["w", "n"])

    rows = (texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run, f"{__name__}:_LOADED"), "w string, n long")
            .where(F.length("w") <= 64).groupBy("w").agg(F.sum("n").alias("n"))
            .orderBy(F.desc("n"), "w").limit(most).select("w").toArrow())
    return rows.column(0).to_pylist()


def write_lexicon(spark: SparkSession, lexicon_words: list[str], vocab_path: str) -> str:
    """Compile words with their ids; the folder of the mapped arrays."""
    v = Vocabulary(vocab_path)
    pairs = sorted({w.encode("utf-8"): w for w in lexicon_words}.items())
    arrays = build_lexicon([b for b, _ in pairs])
    ids = Merger(v)([b for b, _ in pairs])
    at = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])])
    arrays["id_at"] = np.append(at, at[-1]).astype(np.int32)      # one more, so that an empty lexicon can be indexed
    arrays["ids"] = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
    folder = new_folder(spark, "lexicon")
    for k, t in Lexicon.FIELDS.items():
        put_file(folder, k, np.ascontiguousarray(arrays[k].astype(t)))
    return folder


_LOADED: dict[str, object] = {}     # this worker's vocabularies and lexicons, by path


def _vocabulary(path: str) -> Vocabulary:
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def _merger(path: str) -> Merger:
    key = f"merger:{path}"
    if key not in _LOADED:
        _LOADED[key] = Merger(_vocabulary(path))
    return _LOADED[key]


def _lexicon(folder: str) -> Lexicon:
    if folder not in _LOADED:
        for k in [k for k, x in _LOADED.items() if isinstance(x, Lexicon)]:
            del _LOADED[k]
        _LOADED[folder] = Lexicon.mapped(folder)
    return _LOADED[folder]


class Encoder:
    """Texts to ids and decoded strings; both are kept of the words met, up to
    ``keep`` of them."""

    def __init__(self, vocab: Vocabulary, lexicon: Lexicon, merger: Merger, keep: int = 200_000):
        self.v, self.lex, self.merger, self.keep = vocab, lexicon, merger, keep
        self._forget()

    def _forget(self) -> None:
        self.ids = {i: np.array([i], "<u4").tobytes() for i in self.v.special.values()}
        self.texts = {i: t for t, i in self.v.special.items()}

    def learn(self, pieces: set, decoded: bool = True) -> None:
        new = [p for p in pieces if p not in self.ids]
        if len(self.ids) + len(new) > self.keep:
            self._forget()
            new = [p for p in pieces if p not in self.ids]
        raw = [p.encode("utf-8") for p in new]
        ranks = self.lex.ranks(raw)
        at = self.lex.a["id_at"]
        lexicon = np.asarray(self.lex.a["ids"]).astype("<u4").tobytes()
        merged = iter(self.merger([w for w, r in zip(raw, ranks.tolist()) if r < 0]))
        begin, end = (4 * at[np.maximum(ranks, 0)]).tolist(), (4 * at[np.maximum(ranks, 0) + 1]).tolist()
        ids = [lexicon[a:b] if r >= 0 else next(merged) for r, a, b in zip(ranks.tolist(), begin, end)]
        self.ids.update(zip(new, ids))
        if decoded:
            tokens = list(map(self.v.tokens.__getitem__, np.frombuffer(b"".join(ids), "<u4").tolist()))
            ends = [0, *itertools.accumulate(len(x) // 4 for x in ids)]
            self.texts.update(zip(new, [" ".join(tokens[a:b]) for a, b in zip(ends, ends[1:])]))

    def encode(self, texts: list[str | None], decoded: bool = True) -> tuple[list[bytes], list[str] | None]:
        """Ids of each text as little-endian 32-bit integers, and what they decode
        to (a text's decoded pieces joined are its decoded ids)."""
        pieces = [self.v.split(t) if t else [] for t in texts]
        self.learn(set().union(*pieces), decoded)
        return ([b"".join(map(self.ids.__getitem__, x)) for x in pieces],
                [" ".join(map(self.texts.__getitem__, x)) for x in pieces] if decoded else None)


def decode(ids: bytes, tokens: dict[int, str]) -> str:
    """Token strings joined by one space, as the library does without a decoder."""
    return " ".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])


def plain_text(ids: bytes, tokens: dict[int, str]) -> str:
    """The words: bytes of the token strings, one space after each word's end."""
    back = {c: b for b, c in enumerate(byte_alphabet())}
    out = bytearray()
    for i in np.frombuffer(ids, "<u4").tolist():
        t = tokens[i]
        end = t.endswith(WORD_END)
        out += bytes(back[c] for c in (t[:-len(WORD_END)] if end else t))
        if end:
            out += b" "
    return out.decode("utf-8", "replace").rstrip(" ")


def encode_documents(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text",
                     lexicon_words: int = 50_000, chunk: int = 256, decoded: bool = True) -> DataFrame:
    """One row per row of ``docs``: (id_col, ids, decoded); without ``decoded``:
    (id_col, n_tokens, tokens), the ids as an array of integers.

    ``ids``: the text's token ids as little-endian unsigned 32-bit integers,
    without special tokens added; ``decoded``: the token strings joined by one
    space, special ones kept.  Null and empty texts, and texts of white space,
    have no ids and decode to the empty string.  Repeated rows and null ids are
    rows like others; other columns are not read."""
    spark = docs.sparkSession
    folder = write_lexicon(spark, frequent_words(docs, text_col, vocab_path, lexicon_words), vocab_path)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        v = _vocabulary(vocab_path)
        enc = Encoder(v, _lexicon(folder), _merger(vocab_path))
        for b in batches:
            for lo in range(0, b.num_rows, chunk):
                part = b.slice(lo, chunk)
                ids, texts = enc.encode(part.column(1).to_pylist(), decoded)
                if decoded:
                    out = [pa.array(ids, pa.binary()), pa.array(texts, pa.string())]
                else:
                    n = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
                    at = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                    out = [pa.array(n), pa.ListArray.from_arrays(at, pa.array(np.frombuffer(b"".join(ids), "<i4")))]
                yield pa.RecordBatch.from_arrays([part.column(0), *out], names)

    fields = [T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())] if decoded else \
        [T.StructField("n_tokens", T.LongType()), T.StructField("tokens", T.ArrayType(T.IntegerType()))]
    names = ["id", *(f.name for f in fields)]
    return src.mapInArrow(tidy(run, f"{__name__}:_LOADED"), T.StructType([T.StructField("id", docs.schema[id_col].dataType), *fields])) \
        .withColumnRenamed("id", id_col)
