"""Benchmark decontamination with one Aho-Corasick automaton.

Benchmark items and documents are normalised alike: A-Z lowered, words
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` joined by one space.  Every ``window``
consecutive words of an item (or all words of a shorter item) are a pattern,
bounded by spaces; one automaton over all patterns scans each whole text once.
Matches are mapped back to words and to code points of the original text.

The windows are a table: every item's patterns are exploded, grouped with the ids
of their items, and dealt by hash to blocks of about ``group_bytes``, each written
once as a file of the shared folder.  Tasks load block after block and build its
automaton (up to ``keep`` of them stay in a worker's memory); where there are more
blocks than that, ``scan_bytes`` of texts go past them at a time.  So no benchmark
passes through the driver, and its size only adds passes over texts in memory.
"""

from __future__ import annotations

import itertools
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import cut, map_array, new_folder, stream_file, tidy
from .words import ALNUM_WORDS

_TABLE = bytes(int(x) or 32 for x in ALNUM_WORDS)
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_BUILT: dict[tuple[str, int], ahocorasick.Automaton] = {}   # this worker's automata, by folder and block
_SLICE = 4096                                               # patterns a record batch


def normalised(text: str | None) -> str:
    """Words joined by one space; each character is one byte of UTF-8."""
    return b" ".join((text or "").encode("utf-8").translate(_TABLE).split()).decode("latin-1")


def patterns(text: str | None, window: int):
    w = normalised(text).split(" ")
    if w != [""]:
        for i in range(max(1, len(w) - window + 1)):
            yield f" {' '.join(w[i:i + window])} "


def build(group) -> ahocorasick.Automaton:
    """group: (pattern, item ids) with distinct patterns."""
    a = ahocorasick.Automaton()
    for p, items in group:
        a.add_word(p, (len(p), p.count(" ") - 1, items))
    a.make_automaton()
    return a


def item_windows(items: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """(pattern, items): every pattern with the sorted ids of its items; an item of a
    null id has no place in the result and is passed over, a repeated one counts once."""
    src = items.select(F.col(item_col).cast("string").alias("item"),
                       F.col(text_col).cast("string").alias("text")).where("item is not null")

    def run(batches):
        for b in batches:
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                of = patterns(text, window)
                while some := list(itertools.islice(of, _SLICE)):
                    yield pa.RecordBatch.from_pydict({"pattern": some, "item": [item] * len(some)})

    return (src.mapInArrow(tidy(run), "pattern string, item string")
            .groupBy("pattern").agg(F.sort_array(F.collect_set("item")).alias("items")))


def write_blocks(items: DataFrame, item_col: str, text_col: str, window: int, group_bytes: int) -> tuple[str, int]:
    """(folder, number of blocks): the patterns, dealt to files of about ``group_bytes``."""
    spark = items.sparkSession
    of = cut(item_windows(items, item_col, text_col, window))
    own = F.length("pattern") + F.aggregate("items", F.lit(0), lambda n, x: n + F.length(x))
    total = of.agg(F.sum(own.cast("long"))).first()[0]
    folder = new_folder(spark, "windows")
    if not total:
        return folder, 0
    blocks = -(-total // group_bytes)

    def write(key, t):
        with stream_file(folder, f"block-{key[0].as_py()}") as f, pa.ipc.new_stream(f, t.schema) as out:
            out.write_table(t)
        return pa.table({"n": pa.array([t.num_rows], pa.int64())})

    dealt = of.withColumn("block", F.pmod(F.xxhash64("pattern"), F.lit(blocks)))
    dealt.groupBy("block").applyInArrow(write, "n long").agg(F.sum("n")).first()
    return folder, blocks


def word_spans(text: str, ranges: np.ndarray) -> list[tuple[int, int]]:
    """Code-point spans, end exclusive, of word ranges [from, to] of the text."""
    raw = text.encode("utf-8")
    at = [m.span() for m in _WORD.finditer(raw)]
    return [(len(raw[:at[a][0]].decode("utf-8")), len(raw[:at[b][1]].decode("utf-8"))) for a, b in ranges]


def matches_of(norms: list[str], automata) -> list[tuple[int, np.ndarray, set[str]]]:
    """(words, merged word ranges hit, items) of normalised texts."""
    found = [[] for _ in norms]
    items = [set() for _ in norms]
    for a in automata:
        for i, norm in enumerate(norms):
            if norm:
                for end, (size, n, ids) in a.iter(f" {norm} "):
                    found[i].append((end - size + 1, n))
                    items[i].update(ids)
    out = []
    for norm, got, ids in zip(norms, found, items):
        n_words = norm.count(" ") + 1 if norm else 0
        ranges = np.zeros((0, 2), np.int64)
        if got:
            spaces = np.flatnonzero(np.frombuffer(f" {norm} ".encode("latin-1"), np.uint8) == 32)
            got = np.asarray(got, np.int64)
            first = np.searchsorted(spaces, got[:, 0])
            hit = np.zeros(n_words + 1, np.int64)
            np.add.at(hit, first, 1)
            np.add.at(hit, first + got[:, 1], -1)
            on = np.concatenate([[False], np.cumsum(hit[:-1]) > 0, [False]])
            edge = np.flatnonzero(on[1:] != on[:-1])
            ranges = np.stack([edge[::2], edge[1::2] - 1], axis=1)
        out.append((n_words, ranges, ids))
    return out


def _automata(folder: str, blocks: int, keep: int):
    """The automata of the blocks, one after the other; a block that no pattern was
    dealt to has no file."""
    for i in range(blocks):
        key = folder, i
        if key not in _BUILT:
            if len(_BUILT) >= keep:
                _BUILT.clear()
            try:
                t = pa.ipc.open_stream(pa.py_buffer(map_array(folder, f"block-{i}", np.uint8))).read_all()
            except FileNotFoundError:
                continue
            _BUILT[key] = build(zip(t.column("pattern").to_pylist(), t.column("items").to_pylist()))
        yield _BUILT[key]


def _scanned(batches, at: int, folder: str, blocks: int, keep: int, scan_bytes: int):
    """(batch, its texts, its matches); where not all automata stay in memory, batches
    of ``scan_bytes`` together go past them."""
    held, size = [], 0

    def go():
        texts = [b.column(at).cast(pa.string()).to_pylist() for b in held]
        found = iter(matches_of([normalised(t) for ts in texts for t in ts], _automata(folder, blocks, keep)))
        for b, ts in zip(held, texts):
            yield b, ts, list(itertools.islice(found, len(ts)))
        held.clear()

    for b in batches:
        held.append(b)
        size += b.column(at).nbytes
        if blocks <= keep or size >= scan_bytes:
            yield from go()
            size = 0
    if held:
        yield from go()


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id",
                      item_text_col: str = "text", window: int = 10, group_bytes: int = 2 << 20,
                      keep: int = 2, scan_bytes: int = 16 << 20) -> DataFrame:
    """``docs`` without the rows that :func:`decontaminate` finds hit words in:
    the same columns and rules, filtered in the scan."""
    folder, blocks = write_blocks(items, item_col, item_text_col, window, group_bytes)
    at = docs.columns.index(text_col)

    def run(batches):
        for b, _, found in _scanned(batches, at, folder, blocks, keep, scan_bytes):
            yield b.filter(pa.array([not len(ranges) for _, ranges, _ in found], pa.bool_()))

    return docs.mapInArrow(tidy(run, f"{__name__}:_BUILT"), docs.schema)


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", window: int = 10,
                  group_bytes: int = 2 << 20, keep: int = 2, scan_bytes: int = 16 << 20) -> DataFrame:
    """One row per row of ``docs``: (id_col, n_words, n_hit, items, spans).

    n_hit counts the words inside any occurrence of a pattern; ``items`` are the
    ids (as strings, sorted) of items with occurring patterns; ``spans`` are the
    hit words' code-point spans of the original text, end exclusive, runs joined.
    Items of the same pattern are one list with it, as a text that holds it names
    them all.  Null and empty texts have no words; repeated rows and null ids are rows like
    others; with no items (or none with words) nothing is hit.  Only the id and
    text columns are read."""
    folder, blocks = write_blocks(items, item_col, item_text_col, window, group_bytes)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for b, texts, matches in _scanned(batches, 1, folder, blocks, keep, scan_bytes):
            n_words, n_hit, found, spans = [], [], [], []
            for text, (n, ranges, ids) in zip(texts, matches):
                n_words.append(n)
                n_hit.append(int((ranges[:, 1] - ranges[:, 0] + 1).sum()))
                found.append(sorted(ids))
                spans.append([{"start": s, "end": e} for s, e in word_spans(text, ranges)] if len(ranges) else [])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()),
                 pa.array(found, pa.list_(pa.string())),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                ["id", "n_words", "n_hit", "items", "spans"])

    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    return src.mapInArrow(tidy(run, f"{__name__}:_BUILT"), T.StructType([
        T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("spans", span)])).withColumnRenamed("id", id_col)
