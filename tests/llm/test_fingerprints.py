import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from gridreach.llm import fingerprints as fp


def h64(*values):
    seed = 42
    for v in values:
        if v is not None:
            data = v.encode() if isinstance(v, str) else v.data() if isinstance(v, Int) else v.to_bytes(8, "little", signed=v < 0)
            seed = xxhash.xxh64(data, seed=seed).intdigest()
    return seed


class Int:
    """A 32-bit integer: Spark hashes it by four bytes."""

    def __init__(self, n):
        self.n = n

    def data(self):
        return self.n.to_bytes(4, "little", signed=True)


def signed(x):
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def tokens(text):
    return re.findall(fp.TOKEN, text)


def brute(text):
    """Order MinHash of a text in plain Python."""
    parts = tokens(text)
    assert "".join(parts) == text
    kmers = [parts[i : i + fp.K] for i in range(len(parts) - fp.K + 1)] if len(parts) >= fp.K else [[text]] if parts else []
    seen, items = {}, []
    for place, k in enumerate(kmers):
        key = signed(h64(*k)) >> 32
        number = seen[key] = seen.get(key, -1) + 1
        items.append((signed(h64(key, Int(number))) >> 32 if number else key, place))
    if not items:
        return []
    least = [min((signed(h64(x, Int(j))) >> 32, place) for x, place in items) for j in range(fp.PERMUTATIONS)]
    out = []
    for (a, p), (b, q) in zip(least, least[1:] + least[:1]):
        forth = p <= q
        value = h64(Int(int(forth)), *((a, b) if forth else (b, a))) >> 32
        out.append(value - (1 << 32) if value >> 31 else value)
    return out


TEXTS = ["", " \n", "one", "one two", "a b c", "the cat sat on the mat and the cat sat on the mat again", "x " * 700, "x" * 500, "é ü 日本語 \x1f b", "日本語の文章" * 40, "ab" * 300 + " x", "line one\nline two\n" * 30 + "\t end.  ", "a" * 100, " ".join(f"w{i % 37}" for i in range(900)), None]


def test_matches_brute_force(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumn("text", F.coalesce("text", F.lit("")))
    got = {r["doc_id"]: r["fp"] for r in fp.fingerprints(docs, ["doc_id"], "text").collect()}
    for i, t in enumerate(TEXTS):
        assert got[i] == brute(t or ""), t


def likeness(a, b):
    return 1.0 if not a and not b else sum(x == y for x, y in zip(a, b)) / fp.PERMUTATIONS


def test_edits_are_local():
    """One inserted character, at the front or amid, with blanks or without; a moved half; doubled blanks."""
    r = random.Random(1)
    for letters in ("".join(chr(0x4E00 + i) for i in range(3000)), "abcdefghijklmnopqrstuvwxyz", "ACGT", "abcde fghi jklm no", "\u0431\u0430\u0442\u0435\u043b\u0438"):
        text = "".join(r.choice(letters) for _ in range(3000))
        for at in (0, 1500):
            assert likeness(brute(text), brute(text[:at] + r.choice(letters.strip()) + text[at:])) > 0.9, (letters[:5], at)
        assert likeness(brute(text), brute(text[1500:] + text[:1500])) < 0.75
        assert likeness(brute(text), brute("".join(r.choice(letters) for _ in range(3000)))) < 0.2
    assert likeness(brute(text := "abc def " * 3 + "ghi jkl mno"), brute(text.replace(" ", "  "))) < 0.2


@pytest.mark.parametrize("group_rows", [1, 3, 500])
def test_next_documents(spark, group_rows):
    rows = [(i * 7 % 23, f"t{i}") for i in range(23)] + [(5, "tie"), (5, "tie"), (None, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = fp.with_next(docs, group_rows).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = sorted(((str(a), b, c[1]) for (a, b), c in zip(order, order[1:] + order[:1])))
    assert sorted((str(r["doc_id"]), r["text"], r["next_text"]) for r in got) == want


def test_report(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(99, TEXTS[5])]
    docs = spark.createDataFrame([(a, b, "extra", "clash") for a, b in rows], "doc_id long, text string, fp string, TEXT2 string")
    got = {r["doc_id"]: r for r in fp.fingerprint_report(docs).collect()}
    order = sorted(rows, reverse=True)
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        t, after = t or "", after or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert got[i]["n_chars"] == len(t)
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i]["near_edited"] == pytest.approx(likeness(brute(t), brute(edited)))
        assert got[i]["near_next"] == pytest.approx(likeness(brute(t), brute(after)))
    assert got[99]["fingerprint"] == got[5]["fingerprint"]
    assert len(got) == len(rows)


def test_single_and_empty(spark):
    one = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    assert fp.fingerprint_report(one).first()["near_next"] == 1.0
    assert fp.fingerprint_report(one.limit(0)).count() == 0
