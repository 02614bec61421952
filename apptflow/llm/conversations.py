"""Conversation structure repair: weighted interval parsing.

A conversation's role initials have to read ``(s?(ua)+)?``.  The repair grammar
is in Chomsky normal form: the nonterminal [p, q] stands for rows and insertions
that take the format from state p to state q (nothing yet, after s, after u,
after a), with the rules [p, q] -> [p, r] [r, q] and [p, q] -> one row, edited,
between insertions (the insertion closure, a table).  A chart cell holds the
least (cost, audit) of every nonterminal over one span of rows.  The states make
a span's cell the same at whatever place it is cut, so each span needs one cut:
cells are combined bottom-up by span length, two neighbours at a time, and a
long conversation's spans can be parsed in different tasks.

The least (cost, audit) of two spans is that of their parts: audits of one span,
one nonterminal and one cost are never prefixes of each other (a longer one
would hold more insertions, and cost more), so the first difference decides.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import cut, tidy

REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1      # costs; keeping is free
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
STATES, ACCEPTING = 4, (0, 3)
ROLE = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
GONE = "-"                # the symbol of a row that has to be deleted

_BLANK = re.compile(r"[\x20\x09-\x0D]*\Z")
_WHITE = " \t\n\x0b\x0c\r"


def _less(a, b):
    return b if a is None or b is not None and b < a else a


def combine(a: tuple, b: tuple) -> tuple:
    """The cells of two neighbouring spans as one."""
    out = []
    for p in range(0, STATES * STATES, STATES):
        for q in range(STATES):
            best = None
            for r in range(STATES):
                x, y = a[p + r], b[r * STATES + q]
                if x is not None and y is not None and (best is None or x[0] + y[0] <= best[0]):
                    best = _less(best, (x[0] + y[0], x[1] + y[1]))
            out.append(best)
    return tuple(out)


def _insertions() -> tuple:
    """The cell of no rows: the cheapest insertions between each two states."""
    one: list = [None] * (STATES * STATES)
    for p in range(STATES):
        one[p * STATES + p] = (0, "")
    for (p, c), q in STEPS.items():
        if c in ROLE:
            one[p * STATES + q] = _less(one[p * STATES + q], (INSERT, "I"))
    now = tuple(one)
    for _ in range(STATES):
        now = combine(now, now)
    return now


NOTHING = _insertions()


@functools.lru_cache(maxsize=None)           # at most nine symbols
def _row(symbol: str) -> tuple:
    """The cell of one row, with insertions on both sides.  Its symbol is the
    role's initial (x: another), in upper case where the text is truncated."""
    cell: list = [None] * (STATES * STATES)
    extra = TRUNCATED if symbol.isupper() else 0
    for p in range(STATES):
        cell[p * STATES + p] = (DELETE, "D")
    if symbol != GONE:
        for (p, c), q in STEPS.items():
            if c == symbol.lower():
                cell[p * STATES + q] = _less(cell[p * STATES + q], (extra, "K"))
            elif c in ROLE:
                cell[p * STATES + q] = _less(cell[p * STATES + q], (extra + REROLE, "R"))
    return combine(combine(NOTHING, tuple(cell)), NOTHING)


@functools.lru_cache(maxsize=4096)
def _short(symbols: str) -> tuple:
    if len(symbols) == 1:
        return _row(symbols)
    half = len(symbols) // 2
    return combine(_short(symbols[:half]), _short(symbols[half:]))


def join_spans(cells: list) -> tuple:
    """Neighbouring spans' cells combined bottom-up, by span length."""
    if not cells:
        return NOTHING
    while len(cells) > 1:
        cells = [combine(*cells[i:i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0]


def parse(symbols: str) -> tuple:
    """The cell of a run of rows."""
    return join_spans([_short(symbols[i:i + 8]) for i in range(0, len(symbols), 8)])


def best(cell: tuple) -> tuple[int, str]:
    """The least (cost, audit) that leaves a whole format."""
    got = None
    for q in ACCEPTING:
        got = _less(got, cell[q])
    return got


def fault(text: str, seen: bool) -> str:
    """'blank', 'duplicate', 'truncated' or ''."""
    if _BLANK.match(text):
        return "blank"
    if seen:
        return "duplicate"
    return "" if text.rstrip(_WHITE)[-1] in ".!?" else "truncated"


def symbol(role: str, what: str) -> str:
    if what in ("blank", "duplicate"):
        return GONE
    s = role[:1] if role[:1] in ("s", "u", "a") else "x"
    return s.upper() if what == "truncated" else s


class Rewriter:
    """Applies an audit to rows in order and gives the lines that are left."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0

    def _go(self, c: str) -> None:
        self.state = STEPS[self.state, c]

    def _inserted(self) -> Iterator[str]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            c = "a" if self.state == 2 else "u"
            self._go(c)
            self.at += 1
            yield f"{ROLE[c]}:"

    def row(self, role: str, text: str) -> Iterator[str]:
        yield from self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self._go(role[0])
            yield f"{role}:{text}"
        elif edit == "R":
            c = "a" if self.state == 2 else "u"
            self._go(c)
            yield f"{ROLE[c]}:{text}"

    def end(self) -> Iterator[str]:
        yield from self._inserted()


class _Sha:
    """sha256 of lines joined by newlines, line by line."""

    def __init__(self):
        self.h, self.first = hashlib.sha256(), True

    def add(self, lines) -> None:
        for s in lines:
            self.h.update((s if self.first else "\n" + s).encode())
            self.first = False

    def hexdigest(self) -> str:
        return self.h.hexdigest()


class Span:
    """What one pass over consecutive rows of a conversation finds; spans add up."""

    def __init__(self):
        self.low = self.high = self.last_turn = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.first = self.last = None        # role initials
        self.symbols: list[str] = []

    def add(self, turn, role: str, text: str, seen: bool) -> None:
        if turn is not None:
            self.turns += self.last_turn != turn
            self.low, self.high, self.last_turn = turn if self.low is None else self.low, turn, turn
        what = fault(text, seen)
        if what:
            setattr(self, what, getattr(self, what) + 1)
        if self.first is None:
            self.first = role[:1]
        else:
            self.illegal += self.last + role[:1] not in LEGAL
        self.last = role[:1]
        self.symbols.append(symbol(role, what))

    def cell(self) -> tuple:
        return parse("".join(self.symbols))

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns

    def counts(self) -> list[int]:
        return [self.gaps, self.blank, self.duplicate, self.truncated, self.illegal]


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal"]
_ANSWER = T.StructType([T.StructField(c, T.LongType()) for c in [*COUNTS, "cost"]]
                       + [T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])
_CELL = T.ArrayType(T.StructType([T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType())]))


def _rows_of(batch: pa.RecordBatch, names: list[str]):
    return zip(*[batch.column(n).to_pylist() for n in names])


def _arrow(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema
    s = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], s.field(i).type) for i in range(len(s))], schema=s)


def _lines(rows) -> tuple[list, list[str]]:
    """(counts, cost and audit; the repaired lines) of a whole conversation's rows
    (turn, role, text, digest)."""
    span, seen = Span(), set()
    for turn, role, text, digest in rows:
        span.add(turn, role, text, digest in seen)
        seen.add(digest)
    cost, audit = best(span.cell())
    w = Rewriter(audit)
    lines = [s for _, role, text, _ in rows for s in w.row(role, text)] + list(w.end())
    return [*span.counts(), cost, audit], lines


def repair_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text", present: Column | None = None, lines: bool = False) -> DataFrame:
    """One row per conversation: (conv_col, gaps, blank, duplicate, truncated,
    illegal, cost, audit, repaired_sha256) and, with ``lines``, ``repaired``: the
    ``role:text`` lines of the repaired conversation, an array.

    Rows are taken by turn, nulls first; rows of one turn by the sha256 of their
    role and text, so equal rows are neighbours.  Null roles and texts count as one
    space; a null conversation id is one conversation.  Rows for which ``present``
    is false or null only say that the conversation exists; a conversation without
    other rows has zeros, an empty audit and the hash of an empty string.  Other
    columns are not read; an empty table gives an empty result.

    Rows are sorted in slices, dealt by range on everything that they are sorted
    by, so a conversation of any length is spread over as many slices as it fills
    and a task holds one slice at most.  Conversations inside a slice are done
    there.  The first and the last of each slice may go on in the next: their rows
    are set aside, earlier copies are found by a join, each slice's spans are parsed
    and the cells combined by conversation, one a slice.  Only the hash of such a
    conversation is one stream in one task, as sha256 asks.  With ``lines``, its
    lines are held whole, as they are one value."""
    spark = rows.sparkSession
    keep = F.lit(True) if present is None else F.coalesce(present, F.lit(False))
    null = F.lit(" ")
    src = rows.select(F.col(conv_col).alias("c"), F.col(turn_col).cast("long").alias("t"),
                      F.coalesce(F.col(role_col).cast("string"), null).alias("r"),
                      F.coalesce(F.col(text_col).cast("string"), null).alias("x"), keep.alias("there"))
    src = src.withColumn("d", F.unhex(F.sha2(F.concat("r", F.lit("\0"), "x"), 256)))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    order = ["c", "t", "d", "n"]
    src = src.withColumn("n", F.monotonically_increasing_id())
    sliced = src.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    row_type = T.StructType([src.schema[x] for x in ("t", "r", "x", "there", "d", "n")])
    conv = src.schema["c"]
    schema = T.StructType([conv, T.StructField("answer", _ANSWER), T.StructField("lines", T.ArrayType(T.StringType())),
                           T.StructField("row", row_type)])

    def answered(c, held):
        counts, text = _lines([(t, r, x, d) for t, r, x, there, d, _ in held if there])
        sha = _Sha()
        sha.add(text)
        names = [f.name for f in _ANSWER]
        return c, dict(zip(names, [*counts, sha.hexdigest()])), text if lines else None, None

    def set_aside(c, held):
        names = row_type.names
        return [(c, None, None, dict(zip(names, r))) for r in held]

    def whole(batches):
        first, now, held = True, None, []           # the first conversation; the one being read, its rows
        started = False
        for b in batches:
            out = []
            for c, *r in _rows_of(b, ["c", "t", "r", "x", "there", "d", "n"]):
                if not started or c != now:
                    if started:
                        out += set_aside(now, held) if first else [answered(now, held)]
                        first = False
                    started, now, held = True, c, []
                held.append(r)
            if first:
                out += set_aside(now, held)
                held = []
            if out:
                yield _arrow(out, schema)
        if held:
            yield _arrow(set_aside(now, held), schema)

    found = cut(sliced.mapInArrow(tidy(whole), schema))
    names = [f.name for f in _ANSWER]
    done = found.where(F.col("answer").isNotNull()).select("c", "answer.*", "lines")
    rest = _across_slices(found.where(F.col("row").isNotNull()).select("c", "row.*"), parts, conv, lines)
    out = done.unionByName(rest).select(F.col("c").alias(conv_col), *names, *([F.col("lines").alias("repaired")] if lines else []))
    return out


def _across_slices(rows: DataFrame, parts: int, conv: T.StructField, lines: bool) -> DataFrame:
    """The conversations that slice ends cut, of any length."""
    place = F.struct("t", "n")
    first = (rows.where("there").groupBy("c", "d").agg(F.min(place).alias("f"))
             .withColumnRenamed("c", "_c").withColumnRenamed("d", "_d"))
    marked = rows.join(first, F.col("c").eqNullSafe(F.col("_c")) & (F.col("d") == F.col("_d")), "left").select(
        "c", "t", "r", "x", "there", "d", "n", (~place.eqNullSafe(F.col("f"))).alias("seen"))
    order = ["c", "t", "d", "n"]
    marked = cut(marked)
    sliced = marked.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    kinds = {"slice": T.LongType(), "low": T.LongType(), "high": T.LongType(), "turns": T.LongType(),
             **{c: T.LongType() for c in COUNTS[1:]}, "first": T.StringType(), "last": T.StringType(), "cell": _CELL}
    schema = T.StructType([conv, *[T.StructField(k, v) for k, v in kinds.items()]])

    def spans(batches):
        at = TaskContext.get().partitionId()
        now, span, started, out = None, Span(), False, []

        def ended():
            cell = [None if x is None else {"cost": x[0], "audit": x[1]} for x in span.cell()]
            out.append((now, at, span.low, span.high, span.turns, *span.counts()[1:], span.first, span.last, cell))

        for b in batches:
            for c, t, r, x, there, seen in _rows_of(b, ["c", "t", "r", "x", "there", "seen"]):
                if not started or c != now:
                    if started:
                        ended()
                    now, span, started = c, Span(), True
                if there:
                    span.add(t, r, x, seen)
        if started:
            ended()
            yield _arrow(out, schema)

    answer = T.StructType([conv, *[f for f in _ANSWER if f.name != "repaired_sha256"]])

    def together(key, table):
        got = sorted((r for r in table.to_pylist()), key=lambda r: r["slice"])
        total, last, high = dict.fromkeys(COUNTS, 0), None, None
        low, turns = None, 0
        for r in got:
            for k in COUNTS[1:]:
                total[k] += r[k]
            if r["first"] is not None:
                total["illegal"] += last is not None and last + r["first"] not in LEGAL
                last = r["last"]
            if r["low"] is not None:
                turns += r["turns"] - (r["low"] == high)     # a turn that goes on
                low, high = r["low"] if low is None else low, r["high"]
        total["gaps"] = 0 if low is None else high - low + 1 - turns
        cost, audit = best(join_spans([tuple(None if x is None else (x["cost"], x["audit"]) for x in r["cell"])
                                       for r in got]))
        return pa.Table.from_batches([_arrow([(got[0]["c"], *[total[k] for k in COUNTS], cost, audit)], answer)])

    solved = cut(sliced.select("c", "t", "r", "x", "there", "seen").mapInArrow(tidy(spans), schema)
                 .groupBy("c").applyInArrow(together, answer))
    # each conversation's audit before its rows, in one stream
    stream = (marked.where("there").select("c", F.lit(1).alias("k"), "t", "d", "n", "r", "x", F.lit(None).cast("string").alias("audit"))
              .unionByName(solved.select("c", F.lit(0).alias("k"), "audit"), allowMissingColumns=True)
              .repartition("c").sortWithinPartitions("c", "k", "t", "d", "n"))
    hashed = T.StructType([conv, T.StructField("repaired_sha256", T.StringType()),
                           T.StructField("lines", T.ArrayType(T.StringType()))])

    def rewrite(batches):
        now, w, sha, kept, out = None, None, None, [], []

        def add(new):
            new = list(new)
            sha.add(new)
            if lines:
                kept.extend(new)

        def ended():
            add(w.end())
            out.append((now, sha.hexdigest(), list(kept) if lines else None))

        for b in batches:
            for c, k, r, x, audit in _rows_of(b, ["c", "k", "r", "x", "audit"]):
                if k == 0:
                    if w is not None:
                        ended()
                    now, w, sha, kept = c, Rewriter(audit), _Sha(), []
                else:
                    add(w.row(r, x))
        if w is not None:
            ended()
            yield _arrow(out, hashed)

    text = stream.mapInArrow(tidy(rewrite), hashed).withColumnRenamed("c", "_c")
    names = [f.name for f in _ANSWER]
    return solved.join(text, F.col("c").eqNullSafe(F.col("_c"))).select("c", *names, "lines")


def damage(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """Damaged conversations: (conv_col, turn_col, role_col, text_col, present), by
    crc32 of ``conv:turn`` modulo 20: 0 drops a row (present is false), 1 empties its
    text, 2 takes out ``.!?``, 3 repeats it, 4 makes its role user.  Null conversation
    ids, turns, roles and texts count as one space."""
    def s(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    k = F.crc32(F.concat(s(conv_col), F.lit(":"), s(turn_col)).cast("binary")) % 20
    out = rows.select(F.col(conv_col).alias("c"), F.col(turn_col).alias("t"), s(role_col).alias("r"), s(text_col).alias("x"),
                      k.alias("k"))
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("x", ".!?", "")).otherwise(F.col("x"))
    copies = F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return out.select("c", "t", F.when(F.col("k") == 4, "user").otherwise(F.col("r")).alias("r"), text.alias("x"),
                      (F.col("k") != 0).alias("present"), F.explode(copies).alias("_copy")).select(
        F.col("c").alias(conv_col), F.col("t").alias(turn_col), F.col("r").alias(role_col), F.col("x").alias(text_col), "present")
