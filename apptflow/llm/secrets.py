"""Secret scans: patterns, and dictionary-primed zstandard novelty.

Base kinds are found by pattern (``assign``, ``access``, ``hex``).  The method
adds kind ``novel``: strings whose bytes can't be saved, on the line of a
sensitive word, the lines beside it or a few characters off, on both sides.  A
candidate's marginal bytes are what it adds to the zstandard size of the text
around it, with a compressor primed with an identifier dictionary; names that
the dictionary or the surroundings hold cost next to nothing, keys cost most of
their length or more.  The dictionary is made of common identifiers and of the
names that long strings of all documents are put together from, the most frequent
``dictionary_words`` of them.  A sensitive word counts as a word of its own, also
inside names like client_secret and authToken, not inside authors.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import tidy

KINDS = ("assign", "access", "hex", "novel")

_ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")     # the longest match, so those of fewer are the failing ones
_HEX = re.compile(r"[0-9a-f]{24,}")

_SENSITIVE = ("password", "passwd", "secret", "token", "api_key", "apikey", "api-key", "credential", "bearer",
              "private_key", "access_key", "auth")
_SENSITIVE_RE = re.compile("(?:" + "|".join(map(re.escape, _SENSITIVE)) + ")s?")
_PART = re.compile(r"[A-Z]?[a-z]{4,}|[A-Z]{5,}")       # names that identifiers are put together from
LEAST_DOCUMENTS = 5          # that hold a name of the corpus's dictionary
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")

#: Identifiers that code is full of; a raw-content dictionary (the last are the cheapest to refer to).
IDENTIFIERS = (
    "function return import from class public private static const void string boolean integer default "
    "export require module package interface implements extends abstract override virtual namespace "
    "configuration environment development production staging application settings properties database "
    "connection username password passwd credential authorization authentication authenticate bearer "
    "client_id client_secret access_token refresh_token access_key secret_key private_key public_key "
    "api_key apikey api_secret session_id session_token csrf_token encryption certificate fingerprint "
    "localhost example.com http:// https:// www. .com .org .net /usr/local/bin/ /home/user/ /var/log/ "
    "request response header content-type application/json charset=utf-8 timeout retries endpoint "
    "getElementById addEventListener createElement querySelector toString undefined null true false "
    "0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ").split()


class Novelty:
    """Marginal zstandard bytes of a string in its surroundings."""

    def __init__(self, identifiers=IDENTIFIERS, level: int = 19):
        raw = "\n".join(identifiers).encode("utf-8").ljust(8, b"\n")
        self.zip = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(
            raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False)

    def marginal(self, left: str, candidate: str, right: str) -> int:
        """Bytes that the candidate adds; other places of it in the surroundings
        are taken out, so a repeated key doesn't pay for itself."""
        left, right = left.replace(candidate, " "), right.replace(candidate, " ")
        size = [len(self.zip.compress(x.encode("utf-8", "surrogatepass"))) for x in (left + right, left + candidate + right)]
        return size[1] - size[0]


def base_spans(text: str, low: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) by pattern, leftmost and not overlapping in a kind."""
    out = []
    if any(w in low for w in _ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def lowered(text: str) -> str:
    """The text with A-Z lowered; every character keeps its place."""
    if text.isascii():
        return text.lower()
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def _joined_up(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _around(text: str, marks, near: int) -> list[tuple[int, int]]:
    """Ranges of the lines of the marks and the lines beside them, and of ``near``
    characters on both sides."""
    out, end = [], -1
    for s, e in marks:
        out.append((max(0, s - near), min(len(text), e + near)))
        if s >= end:
            first = text.rfind("\n", 0, s)
            first = text.rfind("\n", 0, first) + 1 if first > 0 else 0
            end = text.find("\n", e)
            end = len(text) if end < 0 else end
            last = text.find("\n", end + 1)
            out.append((first, len(text) if last < 0 else last))
    return _joined_up(out)


def _at_edge(text: str, s: int, e: int) -> bool:
    """Whether text[s:e] is a word of its own: between what are no letters, or where
    a capital follows a small letter."""
    def edge(i):
        if i in (0, len(text)) or not (text[i - 1].isalpha() and text[i].isalpha()):
            return True
        return text[i - 1].islower() and text[i].isupper()
    return edge(s) and edge(e)


def sensitive_words(text: str, low: str) -> list[tuple[int, int]]:
    out = []
    for m in _SENSITIVE_RE.finditer(low):
        s, e = m.span()
        if _at_edge(text, s, e):
            out.append((s, e))
        elif low[e - 1] == "s" and _at_edge(text, s, e - 1):
            out.append((s, e - 1))
    return out


def corpus_identifiers(docs: DataFrame, text_col: str = "text", most: int = 2048) -> list[str]:
    """The ``most`` frequent names in long strings (of 16 characters or more), by the
    documents that hold them, LEAST_DOCUMENTS at least; ties in order of the names."""
    src = docs.select(F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for b in batches:
            counts: dict[str, int] = {}
            for text in b.column(0):
                own = {p.lower() for m in _CANDIDATE.finditer(text.as_py() or "") for p in _PART.findall(m.group())}
                for p in own:
                    counts[p] = counts.get(p, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(counts, pa.string()), pa.array(counts.values(), pa.int64())], ["name", "n"])

    got = (src.mapInArrow(tidy(run), "name string, n long").groupBy("name").agg(F.sum("n").alias("n"))
           .where(F.col("n") >= LEAST_DOCUMENTS).orderBy(F.desc("n"), "name").limit(most).collect())
    return [r["name"] for r in reversed(got)]            # the last are the cheapest to refer to


def novel_spans(text: str, low: str, base, novelty: Novelty, near: int, around: int,
                share: float) -> list[tuple[int, int, int]]:
    """Incompressible strings before and behind a sensitive word, clear of the base
    spans: on its line, the lines beside it or within ``near`` characters.  Of a
    string that holds a sensitive word, the pieces beside the word are measured."""
    if not any(w in low for w in _SENSITIVE):
        return []
    if len(low) != len(text):
        low = lowered(text)
    marks = sensitive_words(text, low)
    cuts = _joined_up(marks + [(s, e) for s, _, e in base])
    out, done, k = [], 0, 0
    for lo, hi in _around(text, marks, near):
        while lo > done and text[lo - 1] in _BODY:
            lo -= 1
        for m in _CANDIDATE.finditer(text, max(lo, done)):
            s, stop = m.span()
            if s >= hi:
                break
            done = stop
            while k < len(cuts) and cuts[k][1] <= s:
                k += 1
            pieces, i, whole = [], k, True
            while i < len(cuts) and cuts[i][0] < stop:
                pieces.append((s, cuts[i][0], whole))
                s, whole, i = cuts[i][1], False, i + 1
            pieces.append((s, stop, whole))
            for s, e, whole in pieces:
                while not whole and s < e and text[s] in "=._-/+":     # behind a word: from its separators on
                    s += 1
                c = text[s:e].rstrip("=.-/_+") if s < e else ""
                if len(c) < 16:
                    continue
                e = s + len(c)
                cost = novelty.marginal(text[max(0, s - around):s], c, text[e:e + around])
                if cost >= share * len(c):
                    out.append((s, 3, e))
    return out


_BODY = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", identifiers=IDENTIFIERS,
                 near: int = 48, around: int = 256, share: float = 0.88, dictionary_words: int = 2048) -> DataFrame:
    """One row per row of ``docs``: (id_col, n_assign, n_access, n_hex, n_novel,
    base_sha256, spans).

    ``spans`` lists kind:start:end of all spans by start, then kind (code points,
    end exclusive); base_sha256 is of the list of base spans.  The dictionary is
    ``dictionary_words`` names of the corpus (0: none), then ``identifiers``.  Null and empty
    texts have no spans (the hash of the empty string).  Repeated rows and null
    ids are rows like others; other columns are not read."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    if dictionary_words:
        identifiers = [*corpus_identifiers(docs, text_col, dictionary_words), *identifiers]

    def run(batches):
        novelty = Novelty(identifiers)
        for b in batches:
            rows = []
            for text in b.column(1):
                text = text.as_py() or ""
                low = lowered(text)
                base = base_spans(text, low)
                more = novel_spans(text, low, base, novelty, near, around, share)
                n = [sum(k == j for _, k, _ in base) for j in range(3)]
                rows.append((*n, len(more), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more)))
            cols = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.string()) for c in cols[4:])],
                ["id", "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"])

    return src.mapInArrow(tidy(run), T.StructType(
        [T.StructField("id", docs.schema[id_col].dataType)]
        + [T.StructField(f"n_{k}", T.LongType()) for k in KINDS]
        + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])) \
        .withColumnRenamed("id", id_col)
