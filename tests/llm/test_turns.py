"""Conversation repair against an enumeration of all edits, split and whole."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from gridreach.llm import turns

SCHEMA = "conv_id long, turn long, role string, text string, audit string, COST int"
GRAMMAR = re.compile(r"(s?(ua)+)?")


def repaired(rows, edits):
    """Cost and rows of one list of edits: for each row D, K, or the role that it is given, and inserts between."""
    cost, out = 0, []
    faults = iter(rows)
    for e in edits:
        if e in "ua" and len(e) == 1:
            cost += 3
            out.append(("user" if e == "u" else "assistant", ""))
            continue
        role, text, gone, cut = next(faults)
        if e == "D":
            cost += 4
            continue
        if gone:
            return None
        cost += (0 if e == "K" else 3) + (3 if cut else 0)
        out.append((role if e == "K" else {"Ru": "user", "Ra": "assistant"}[e], text))
    return (cost, out) if GRAMMAR.fullmatch("".join(r[:1] or "-" for r, _ in out)) else None


def brute(rows):
    """The cheapest edits of all, with up to two inserts in every place."""
    inserts = [(), ("u",), ("a",), ("u", "a"), ("a", "u")]
    best = None
    for choice in itertools.product(("K", "D", "Ru", "Ra"), repeat=len(rows)):
        for gaps in itertools.product(inserts, repeat=len(rows) + 1):
            edits = [*gaps[0], *itertools.chain.from_iterable((c, *g) for c, g in zip(choice, gaps[1:], strict=True))]
            found = repaired(rows, edits)
            if found:
                letters = "".join("I" if e in ("u", "a") else e[0] for e in edits)
                best = min(best or (found[0], letters, found[1]), (found[0], letters, found[1]))
    return best


def faults(rows):
    """(role, text, must go, cut) of rows (role, text)."""
    seen, out = set(), []
    for role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        blank, again = not body, (role, text) in seen
        seen.add((role, text))
        out.append((role, text, blank or again, not blank and not again and body[-1] not in ".!?"))
    return out


def least(search):
    ends = turns.close([x and (x[0], 0, x[1]) for x in search.whole()])
    cost, _, edits = min(x for x in (ends[turns.NOTHING], ends[turns.ASSISTANT]) if x)
    return cost, edits


def made(r, n):
    return [(r.choice(["user", "user", "assistant", "assistant", "system", "tool", ""]), r.choice(["a.", "b!", "c?", "d", "e", " \t", "", "f. "])) for _ in range(n)]


def test_search_finds_the_cheapest_edits():
    r = random.Random(5)
    for _ in range(40):
        rows = faults(made(r, r.randint(0, 3)))
        search = turns.Search(turns.NOTHING)
        for role, _, gone, cut in rows:
            search.row(role[:1], gone, cut)
        assert least(search) == brute(rows)[:2], rows


def test_parts_joined_are_the_whole():
    r = random.Random(6)
    for _ in range(200):
        rows = made(r, r.randint(1, 40))
        cuts = sorted({0, len(rows), *(r.randrange(len(rows)) for _ in range(r.randint(0, 5)))})
        flags, whole, one = faults(rows), turns._Whole(1), turns._Whole(1)
        for k, (a, b) in enumerate(itertools.pairwise(cuts)):
            part = turns._Part(1, k, range(4) if k else (turns.NOTHING,))
            for i in range(a, b):
                part.add(i, rows[i][0][:1], not rows[i][1].strip(), flags[i][2] and bool(rows[i][1].strip()), flags[i][3], 1)
            whole.add(*part.row()[1:])
        part = turns._Part(1, 0, (turns.NOTHING,))
        for i, (role, text) in enumerate(rows):
            part.add(i, role[:1], not text.strip(), flags[i][2] and bool(text.strip()), flags[i][3], 1)
        one.add(*part.row()[1:])
        a, b = whole.row(), one.row()
        assert a[:-1] == b[:-1] and "".join(p["edits"] for p in a[-1]) == b[-1][0]["edits"]


def test_long_searches_settle():
    """Edits put aside change nothing, also where states never agree again."""
    r = random.Random(7)
    for repeated in (False, True):
        rows = faults(made(r, 3000)) if repeated else [(x, "", r.random() < 0.1, r.random() < 0.2) for x in r.choices(["user", "assistant", "system"], k=3000)]
        search, plain = turns.Search(turns.NOTHING), turns.start(turns.NOTHING)
        for role, _, gone, cut in rows:
            search.row(role[:1], gone, cut)
            plain = turns.step(plain, role[:1], gone, cut)
        assert search.whole() == [x and (x[0], x[2]) for x in plain]
        assert max(len(x[2]) for x in search.best if x) < turns._LONG + 10


def table(spark):
    r = random.Random(8)
    rows = [(c, t, role, text, "x", 1) for c in range(40) for t, (role, text) in enumerate(made(r, r.randint(1, 4)))]
    rows += [
        (None, None, None, None, None, None), (None, 1, "user", "Hi.", None, 0), (None, 1, "user", "Hi.", None, 0), (100, None, "user", None, "", 0), (100, None, "assistant", "Yes.", "", 0), (100, 5, "user", "ok?", "", 0),
        (100, 5, "assistant", "ok.", "", 0), (101, 1 << 40, "user", "w " * 200_000 + "!", "", 0), (101, 3, "system", "é 日本.", "", 0),
    ]
    return rows, spark.createDataFrame(rows, SCHEMA)


def expected(rows):
    """The contract, row by row; the cheapest edits by the search, which the other tests hold against brute force."""
    out = {}
    for conv in {r[0] for r in rows}:
        kept = []
        for c, t, role, text, *_ in rows:
            role, text = " " if role is None else role, " " if text is None else text
            kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
            if c != conv or kind == 0:
                continue
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            kept += [(t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
        kept.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        flags = faults([x[1:] for x in kept])
        search = turns.Search(turns.NOTHING)
        for role, _, gone, cut in flags:
            search.row(role[:1], gone, cut)
        cost, audit = least(search)
        state, lines, at = 0, [], iter(flags)
        for e in audit:
            role, text = next(at)[:2] if e != "I" else ("", "")
            if e != "D":
                letter = role[0] if e == "K" else "a" if state == turns.USER else "u"
                state = turns._AFTER[state][letter]
                lines.append((role if e == "K" else {"u": "user", "a": "assistant"}[letter]) + ":" + text)
        ts = [x[0] for x in kept if x[0] is not None]
        blank = sum(not x[2].strip(" \t\n\x0b\x0c\r") for x in kept)
        initials = [x[1][:1] for x in kept]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        gaps = max(ts) - min(ts) + 1 - len(set(ts)) if ts else 0
        cut = sum(f[3] for f in flags)
        out[conv] = (gaps, blank, sum(f[2] for f in flags) - blank, cut, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_report(spark, parts):
    rows, df = table(spark)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r[0]: tuple(r)[1:] for r in turns.repair_report(df).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == expected(rows)


def test_one_long_conversation_over_many_parts(spark):
    """A conversation that holds all rows, one text repeated often, and rows that are equal in all."""
    r = random.Random(9)
    rows = [(7, t, role, text if t % 3 else "Same.", "", 0) for t, (role, text) in enumerate(made(r, 3000))] + [(7, 11, "user", "Same.", "", 0)] * 50
    df = spark.createDataFrame(rows, SCHEMA)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert turns.with_faults(df).select("part").distinct().count() > 1
        got = {x[0]: tuple(x)[1:] for x in turns.repair_report(df).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert got == expected(rows)


def test_empty_and_repaired_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert turns.repair_report(empty).count() == 0
    df = spark.createDataFrame([(1, 0, "assistant", "So.", "", 0), (1, 1, "user", "And?", "", 0)], SCHEMA)
    report, rows = turns.repair(df)
    assert report.select("cost", F.expr("array_join(transform(pieces, p -> p.edits), '')")).first()[:] == (6, "IKKI")
    assert [tuple(r) for r in rows.orderBy("part", "seq").select("edit", "role", "text").collect()] == [("I", "user", ""), ("K", "assistant", "So."), ("K", "user", "And?"), ("I", "assistant", "")]
