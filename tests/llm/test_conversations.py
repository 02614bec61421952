"""Conversation repair against a cubic chart parser and an exhaustive search."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from apptflow.llm import conversations as C

SF = "/root/testdata/sf0.001"
FORMAT = re.compile(r"(s?(ua)+)?\Z")
SCHEMA = "conv_id long, turn long, role string, text string"


def exhaustive(symbols, most_inserts):
    """The least (cost, audit) over all edit scripts with few insertions."""
    best = None
    choices = []
    for s in symbols:
        extra = int(s.isupper())
        opts = [(3, "D", "")]
        if s != "-":
            opts += [(extra, "K", s.lower()), (2 + extra, "R", "u"), (2 + extra, "R", "a")]
        choices.append(opts)
    for picked in itertools.product(*choices):
        for where in itertools.product(range(most_inserts + 1), repeat=len(symbols) + 1):
            if sum(where) > most_inserts:
                continue
            for letters in itertools.product("ua", repeat=sum(where)):
                it, out, audit, cost = iter(letters), "", "", 2 * sum(where)
                for i, k in enumerate(where):
                    for _ in range(k):
                        out += next(it)
                        audit += "I"
                    if i < len(picked):
                        cost += picked[i][0]
                        audit += picked[i][1]
                        out += picked[i][2]
                if FORMAT.match(out) and (best is None or (cost, audit) < best):
                    best = cost, audit
    return best


def cubic(symbols):
    """A chart over all spans and all cuts."""
    n = len(symbols)
    chart = {(i, i + 1): C._row(s) for i, s in enumerate(symbols)}
    for size in range(2, n + 1):
        for i in range(n - size + 1):
            cells = [C.combine(chart[i, k], chart[k, i + size]) for k in range(i + 1, i + size)]
            chart[i, i + size] = tuple(min((c[x] for c in cells if c[x] is not None), default=None) for x in range(16))
    return C.best(chart[0, n]) if n else C.best(C.NOTHING)


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_every_short_run_against_all_edits(n):
    for symbols in itertools.product("suaxSUAX-", repeat=n) if n < 3 else random.Random(1).sample(
            list(itertools.product("suaxSUAX-", repeat=3)), 60):
        assert C.best(C.parse("".join(symbols))) == exhaustive(symbols, 2), symbols


def test_one_cut_a_span_gives_what_all_cuts_give():
    rnd = random.Random(2)
    for n in (1, 4, 7, 12, 17):
        for _ in range(6):
            s = "".join(rnd.choice("suaxSUAX-") for _ in range(n))
            assert C.best(C.parse(s)) == cubic(s)


def reference(rows, damaged=True):
    """Every conversation's answer, row by row in Python."""
    given = {}
    for c, t, r, x in rows:
        given.setdefault(c, [])
        r, x = " " if r is None else r, " " if x is None else x
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20 if damaged else 9
        if k == 0:
            continue
        x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
        given[c] += [(t, "user" if k == 4 else r, x)] * (2 if k == 3 else 1)
    out = {}
    for c, got in given.items():
        got.sort(key=lambda v: (v[0] is not None, v[0] or 0, hashlib.sha256((v[1] + "\0" + v[2]).encode()).digest()))
        turns = [v[0] for v in got if v[0] is not None]
        seen, n, symbols = set(), dict.fromkeys(("blank", "duplicate", "truncated"), 0), ""
        for _, r, x in got:
            last = re.sub(r"[\x20\x09-\x0D]", "", x)[-1:]
            f = "blank" if not last else "duplicate" if (r, x) in seen else "truncated" if last not in ".!?" else None
            seen.add((r, x))
            if f:
                n[f] += 1
            s = r[:1] if r[:1] in ("s", "u", "a") else "x"
            symbols += "-" if f in ("blank", "duplicate") else s.upper() if f else s
        i = [v[1][:1] for v in got]
        cost, audit = cubic(symbols)
        lines, state, rest = [], "", iter(got)
        for e in audit:
            want = "user" if state in ("", "s", "a") else "assistant"
            if e == "I":
                line = want, ""
            else:
                _, r, x = next(rest)
                if e == "D":
                    continue
                line = (r if e == "K" else want), x
            state = line[0][0]
            lines.append(":".join(line))
        out[c] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, n["blank"], n["duplicate"], n["truncated"],
                  sum(a + b not in ("su", "ua", "au") for a, b in zip(i, i[1:])), cost, audit, "\n".join(lines))
    return out


def answers(df):
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    rows = df.collect()
    assert all(hashlib.sha256("\n".join(r.repaired).encode()).hexdigest() == r.repaired_sha256 for r in rows)
    got = {r.conv_id: (*[r[n] for n in names], "\n".join(r.repaired)) for r in rows}
    assert len(got) == len(rows)
    return got


def test_given_table(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet")
    got = answers(C.repair_conversations(C.damage(rows), present=F.col("present"), lines=True))
    assert got == reference([tuple(r) for r in rows.select("conv_id", "turn", "role", "text").collect()])
    assert {c for v in got.values() for c in v[6]} == set("DIKR")


def odd_rows():
    rnd = random.Random(3)
    texts = [None, "", " \t", "Yes.", "No", "Why?\n", "a" * 50_000, "a" * 50_000 + "!", "  Stop! ", "ü."]
    roles = [None, "", "system", "user", "assistant", "tool", "User", "unknown"]
    rows = [(rnd.choice([None, 1, 2, 3, 4]), rnd.choice([None, 0, 1, 2, 5, 9]), rnd.choice(roles), rnd.choice(texts)) for _ in range(60)]
    rows += rows[:8] + [(7, None, "user", "Alone.")] * 3
    # one conversation with a third of all rows and more, cut by many slices
    return rows + [(5, i // 2, ["user", "assistant", "tool"][i % 3], f"{i % 17} words" + ".?"[i % 2] * (i % 5 > 0)) for i in range(90)]


def test_odd_rows_and_a_long_conversation(spark):
    rows = odd_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = answers(C.repair_conversations(df, lines=True))
    assert got == reference(rows, damaged=False)
    got = answers(C.repair_conversations(C.damage(df), present=F.col("present"), lines=True))
    assert got == reference(rows)


def test_dropped_and_empty(spark):
    rows = [(None, 1, "user", "Hi."), (1, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("present", F.lit(None).cast("boolean"))
    got = C.repair_conversations(df, present=F.col("present")).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == [
        (c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in ("1", "None")]
    empty = C.repair_conversations(df.limit(0), present=F.col("present"))
    assert empty.columns == ["conv_id", *C.COUNTS, "cost", "audit", "repaired_sha256"] and empty.count() == 0


def test_extra_columns_and_names(spark):
    df = spark.createDataFrame([("x", 0, "user", "Hi.", 1, 2), ("x", 1, "assistant", "Ho.", 3, 4)],
                               "c string, t int, r string, x string, n int, answer int")
    got = C.repair_conversations(df, "c", "t", "r", "x").collect()
    assert [(r.c, r.cost, r.audit) for r in got] == [("x", 0, "KK")]
    assert C.damage(df, "c", "t", "r", "x").columns == ["c", "t", "r", "x", "present"]
