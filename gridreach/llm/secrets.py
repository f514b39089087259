"""Secret scans: base patterns, and a linear-chain conditional random field over words.

The field tags white-space separated words as begin (B), inside (I) or outside (O) of a secret,
from a word's shape, its neighbours' shapes and features of the file, and is decoded by Viterbi.
It is trained here, by maximum likelihood on generated lines (``training_lines``), so the model is
the same whatever table is scanned.

Decoding is exact and mostly vectorised: a word whose score for O exceeds its other scores by more
than the transitions can ever repay is O on the best path, so Viterbi runs only between such words.

Base spans always stay. A decoded span is added where it overlaps no base span; its ends are those
of the words without surrounding marks. Offsets are code points.

Defined results: a null text is an empty one, which has no spans; repeated rows give their result
again; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shipping import ship
from .common import hex_sha256, pick

KINDS = ("assign", "access", "hex", "crf")
LABELS = "BIO"
B, I, O = range(3)  # noqa: E741
#: Distinct words that a worker remembers at most.
CACHE_ENTRIES = 300_000

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ASSIGN_WORDS = ("passw", "secret", "token", "api_key", "apikey")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_HEX_MAP = bytes(120 if 48 <= b <= 57 or 97 <= b <= 102 else 32 for b in range(256))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), by start, then kind as listed."""
    out = []
    lowered = text.lower()
    if any(w in lowered for w in _ASSIGN_WORDS):
        out += [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if b"x" * 24 in text.encode("utf-8", "surrogatepass").translate(_HEX_MAP):
        out += [(*m.span(), "hex") for m in _HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


# Features ------------------------------------------------------------------------------------

_CORE = re.compile(r"[A-Za-z0-9].*[A-Za-z0-9=]|[A-Za-z0-9]", re.DOTALL)
_KEYWORD = re.compile(r"passw|pwd|secret|token|api.?key|access.?key|private.?key|credential|bearer|authorization|auth", re.IGNORECASE | re.ASCII)
#: Openings of well-known public token formats.
_PREFIX = re.compile(r"ghp_|gho_|ghs_|github_pat_|glpat-|sk-|sk_live_|rk_live_|pk_live_|xox[abp]-|AIza|eyJ|ya29\.|hf_|npm_|SG\.|AKIA|ASIA")
_OPEN = re.compile(r"-----(BEGIN|END)")


def _bucket(n: int) -> int:
    return 0 if n < 6 else 1 if n < 12 else 2 if n < 16 else 3 if n < 24 else 4 if n < 40 else 5


_PLAIN = re.compile(r"([A-Za-z]{1,11})[,.;!#$%&*]*")


def shape(word: str) -> str:
    """What the field knows of a word: a class name; there are a few thousand at most."""
    if (m := _PLAIN.fullmatch(word)) and not _PREFIX.match(word):  # the common case, with the general one's result
        return f"{_bucket(len(m[1]))}|w|0|0|-|{'k' if _KEYWORD.search(m[1]) else ''}|"
    found = _CORE.search(word)
    core = found[0] if found else ""
    if "=" in core.rstrip("=") and not core.startswith("="):
        name, _, value = core.partition("=")  # name=value: judged by its value
        value = value.strip("\"'")
        named = bool(_KEYWORD.search(name))
    else:
        value, named = core, False
    n = len(value)
    lower = sum(c.islower() and c.isascii() for c in value)
    upper = sum(c.isupper() and c.isascii() for c in value)
    digit = sum(c.isdigit() and c.isascii() for c in value)
    odd = n - lower - upper - digit
    joined = sum(c in "+/_-.=" for c in value)
    mix = ("l" if lower else "") + ("u" if upper else "") + ("d" if digit else "") + ("j" if joined else "") + ("x" if odd > joined else "")
    turns = sum((a.isdigit() != b.isdigit()) or (a.islower() != b.islower()) for a, b in zip(value, value[1:], strict=False))
    rough = 0 if n < 2 else min(3, int(4 * turns / (n - 1)))
    spread = 0
    if n >= 12:
        entropy = -sum(k / n * math.log2(k / n) for k in Counter(value).values())
        spread = 1 if entropy < 3 else 2 if entropy < 3.8 else 3
    kind = "pre" if _PREFIX.match(value) else "end" if _OPEN.search(word) else "url" if "://" in word or "@" in word else "-"
    if n < 12 and kind == "-":
        mix, rough = ("d" if digit and not lower and not upper else "m" if digit and (lower or upper) else "w"), 0
    keyword = ("k" if _KEYWORD.search(core) else "") if not named else "n"
    tail = "=" if word.rstrip("\"'").endswith(("=", ":")) else ""
    return f"{_bucket(n)}|{mix}|{rough}|{spread}|{kind}|{keyword}|{tail}"


def _own(c: str) -> list[str]:
    size, mix, rough, spread, kind, keyword, tail = c.split("|")
    return [f"size={size}", f"mix={mix}", f"rough={rough}", f"spread={spread}", f"kind={kind}", f"key={keyword}", f"tail={tail}", f"{size},{mix},{rough}", f"{spread},{rough},{mix}", f"{keyword},{size}"]


def _beside(c: str) -> list[str]:
    size, mix, _, _, kind, keyword, tail = c.split("|")
    return [f"key={keyword}{tail}", f"kind={kind}", f"tail={tail},{size}", f"long={size in '345' and 'd' in mix}"]


def file_class(text: str, lowered: str | None = None) -> int:
    """Features of the file, as a number: 1 for a word of secrets, 2 for a key block, 4 for much code."""
    lowered = text.lower() if lowered is None else lowered
    return (
        any(w in lowered for w in ("passw", "secret", "token", "key", "bearer", "credential"))
        + 2 * ("-----BEGIN" in text) + 4 * (text.count("=") + text.count(";") + text.count("{") > 0.01 * len(text) + 1)
    )


PLACES = ("own", "left", "left2", "right")


def _features(classes: list[str], i: int, file: int) -> list[str]:
    out = ["bias"] + [f"own:{f}" for f in _own(classes[i])] + [f"file:{file & 1}", f"file2:{file & 2}", f"file4:{file & 4}"]
    for place, j in (("left", i - 1), ("left2", i - 2), ("right", i + 1)):
        out += [f"{place}:{f}" for f in (_beside(classes[j]) if 0 <= j < len(classes) else ["edge"])]
    return out


# Training ------------------------------------------------------------------------------------

_LETTERS, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
_WORD_SET = _LETTERS + _LETTERS.upper() + _DIGITS


def training_lines(n: int, seed: int = 0) -> list[tuple[list[str], list[int]]]:
    """Generated lines with labels: prose and junk in many guises, and secrets in a third of them."""
    r = random.Random(seed)
    text = lambda letters, low, high: "".join(r.choice(letters) for _ in range(r.randint(low, high)))
    syllables = ["th", "er", "an", "ing", "on", "re", "ed", "es", "ou", "le", "la", "que", "der", "ung", "ción", "é", "ment", "sch", "keit", "ra"]

    def word() -> str:
        w = "".join(r.choice(syllables) for _ in range(r.choice([1, 1, 2, 2, 3, 3, 4, 5, 7, 9])))
        w = r.choice([w, w, w, w.capitalize(), w.upper()])
        return w + r.choice(["", "", "", "", ",", ".", ";", "!!", "###", "$$$", "%%%", "&&&", "***", ".\""])

    def plain() -> str:
        return r.choice([
            word, word, word, word, word, word, word, word, lambda: "|", lambda: text(_DIGITS, 1, 6), lambda: text(_DIGITS, 13, 16),
            lambda: f"{r.randint(1, 255)}.{r.randint(0, 255)}.{r.randint(0, 255)}.{r.randint(0, 255)}", lambda: f"+1 ({text(_DIGITS, 3, 3)})", lambda: f"{text(_DIGITS, 3, 3)}-{text(_DIGITS, 4, 4)}",
            lambda: f"20{text(_DIGITS, 2, 2)}-0{r.randint(1, 9)}-1{r.randint(0, 9)}", lambda: f"{text(_LETTERS, 4, 9)}.{text(_LETTERS + _DIGITS, 2, 12)}@{text(_LETTERS, 4, 8)}.com",
            lambda: f"https://{text(_LETTERS, 4, 9)}.org/{text(_LETTERS + _DIGITS + '/-', 4, 30)}", lambda: f"{word().strip('.,;')}-{word().strip('.,;')}-{word()}", lambda: f"{text(_LETTERS, 3, 8)}_{text(_LETTERS, 3, 9)}()",
            lambda: f"{text(_LETTERS, 3, 8)}/{text(_LETTERS, 3, 9)}/{text(_LETTERS, 3, 8)}.py", lambda: "Copyright", lambda: f"v{r.randint(0, 9)}.{r.randint(0, 30)}.{r.randint(0, 9)}", lambda: f"{text(_LETTERS, 2, 6)}{text(_DIGITS, 1, 3)}",
            lambda: "==========", lambda: "token", lambda: "secret", lambda: "key", lambda: "password", lambda: "tokens,", lambda: f"id={text(_DIGITS, 2, 6)}", lambda: word().lower() * r.randint(2, 4),
        ])()

    def secret() -> str:
        return r.choice([
            lambda: text(_WORD_SET, 20, 44), lambda: text(_WORD_SET + "+/", 30, 60), lambda: text("0123456789abcdef", 24, 64), lambda: "AKIA" + text(_LETTERS.upper() + _DIGITS, 16, 16),
            lambda: r.choice(["ghp_", "gho_", "hf_", "npm_", "glpat-"]) + text(_WORD_SET, 20, 36), lambda: r.choice(["sk-", "sk_live_", "rk_live_"]) + text(_WORD_SET, 24, 48),
            lambda: f"xoxb-{text(_DIGITS, 10, 12)}-{text(_WORD_SET, 20, 24)}", lambda: "AIza" + text(_WORD_SET + "_-", 35, 35), lambda: f"eyJ{text(_WORD_SET, 14, 30)}.eyJ{text(_WORD_SET, 20, 40)}.{text(_WORD_SET + '_-', 30, 43)}",
            lambda: text(_LETTERS.upper() + _DIGITS, 24, 40),
        ])()

    def weak() -> str:
        return text(_WORD_SET + "_-", 8, 16)

    names = ["password", "passwd", "secret", "token", "api_key", "apikey", "API_KEY", "access_key", "client_secret", "auth_token", "credentials", "TOKEN", "db.password", "private_key"]

    def marked() -> list[tuple[str, int]]:
        name, q = r.choice(names), r.choice(["", '"', "'"])
        value = r.choice([secret, secret, weak])()
        after = r.choice(["", "", ";", ",", "###", "!!"])
        return r.choice([
            lambda: [(name, O), (r.choice(["=", ":", ":=", "=>"]), O), (q + value + q + after, B)], lambda: [(name + r.choice(["=", ":"]), O), (q + value + q + after, B)], lambda: [(f"{name}={q}{value}{q}{after}", B)],
            lambda: [("Authorization:", O), ("Bearer", O), (secret(), B)], lambda: [("export", O), (f"{name.upper()}={value}", B)], lambda: [(secret() + after, B)], lambda: [(q + secret() + q, B)],
            lambda: [("-----BEGIN", B), ("PRIVATE", I), ("KEY-----", I), *[(text(_WORD_SET + "+/", 40, 64), I) for _ in range(r.randint(1, 4))], ("-----END", I), ("PRIVATE", I), ("KEY-----", I)],
        ])()

    out = []
    for _ in range(n):
        line = [(plain(), O) for _ in range(r.randint(0, 14))]
        if r.random() < 0.4:
            line += marked() + [(plain(), O) for _ in range(r.randint(0, 10))]
        if line:
            out.append(([w for w, _ in line], [y for _, y in line]))
    return out


class Field:
    """Weights: feature -> three scores; transitions[from, to], with O before the first and after the last word."""

    def __init__(self, weights: dict[str, np.ndarray], transitions: np.ndarray):
        self.weights, self.transitions = weights, transitions
        # By how much other labels than O can gain in transitions, at most, for one word.
        self.bound = max(transitions[a, b] + transitions[b, c] - transitions[a, O] - transitions[O, c] for a in range(3) for b in (B, I) for c in range(3))
        zero = np.zeros(3)
        self.edge = {place: weights.get(f"{place}:edge", zero) for place in PLACES[1:]}
        self.files = [sum((weights.get(f, zero) for f in ("bias", f"file:{k & 1}", f"file2:{k & 2}", f"file4:{k & 4}")), zero) for k in range(8)]
        self.numbers: dict[str, int] = {}  # class -> row of the tables
        self.words: dict[str, int] = {}
        self.tables = {place: np.zeros((64, 3)) for place in PLACES}

    def number(self, word: str) -> int:
        if (n := self.words.get(word)) is not None:  # met just before, in the same text
            return n
        c = shape(word)
        n = self.numbers.get(c)
        if n is None:
            n = self.numbers[c] = len(self.numbers)
            for place, table in self.tables.items():
                if n >= len(table):
                    table = self.tables[place] = np.concatenate([table, np.zeros_like(table)])
                for f in _own(c) if place == "own" else _beside(c):
                    table[n] += self.weights.get(f"{place}:{f}", 0)
        if len(self.words) >= CACHE_ENTRIES:
            self.words.clear()
        if len(word) < 200:
            self.words[word] = n
        return n

    def emissions(self, words: list[str], file: int) -> np.ndarray:
        get = self.words.get
        at = [get(w, -1) for w in words]
        if -1 in at:
            at = [n if n >= 0 else self.number(w) for n, w in zip(at, words, strict=True)]
        k = np.array(at)
        out = self.tables["own"][k] + self.files[file]
        left, left2, right = (self.tables[p] for p in PLACES[1:])
        out[1:] += left[k[:-1]]
        out[0] += self.edge["left"]
        out[2:] += left2[k[:-2]]
        out[:2] += self.edge["left2"]
        out[:-1] += right[k[1:]]
        out[-1] += self.edge["right"]
        return out

    def viterbi(self, scores: np.ndarray) -> list[int]:
        """The best labels of a stretch between words that are O, or the text's ends."""
        best, back = self.transitions[O] + scores[0], []
        for s in scores[1:]:
            ways = best[:, None] + self.transitions
            back.append(ways.argmax(axis=0))
            best = ways.max(axis=0) + s
        path = [int((best + self.transitions[:, O]).argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1]

    def decode(self, words: list[str], file: int) -> dict[int, int]:
        """Word number -> B or I, for the words that aren't O."""
        scores = self.emissions(words, file)
        open_ = np.flatnonzero(scores[:, O] - np.maximum(scores[:, B], scores[:, I]) <= self.bound)
        out: dict[int, int] = {}
        if len(open_):
            for stretch in np.split(open_, np.flatnonzero(np.diff(open_) > 1) + 1):
                for i, y in zip(stretch, self.viterbi(scores[stretch[0] : stretch[-1] + 1]), strict=True):
                    if y != O:
                        out[int(i)] = y
        return out


def _line_file(words: list[str]) -> int:
    return file_class(" ".join(words))


@lru_cache(1)
def train(lines: int = 2500, rounds: int = 6, rate: float = 0.5, decay: float = 1e-5, seed: int = 0) -> Field:
    """Maximum likelihood by adaptive gradient steps, a line each; forward and backward sums in the log domain."""
    data = training_lines(lines, seed)
    index: dict[str, int] = {}
    coded = []
    for words, labels in data:
        classes, file = [shape(w) for w in words], _line_file(words)
        coded.append(([np.array([index.setdefault(f, len(index)) for f in _features(classes, i, file)]) for i in range(len(words))], np.array(labels)))
    w, t = np.zeros((len(index), 3)), np.zeros((3, 3))
    gw, gt = np.full_like(w, 1e-2), np.full_like(t, 1e-2)
    order = list(range(len(coded)))
    r = random.Random(seed)
    for _ in range(rounds):
        r.shuffle(order)
        for k in order:
            features, y = coded[k]
            n = len(y)
            emit = np.array([w[f].sum(axis=0) for f in features])
            forward, backward = np.empty((n, 3)), np.empty((n, 3))
            forward[0] = t[O] + emit[0]
            for i in range(1, n):
                forward[i] = np.logaddexp.reduce(forward[i - 1][:, None] + t, axis=0) + emit[i]
            backward[-1] = t[:, O]
            for i in range(n - 2, -1, -1):
                backward[i] = np.logaddexp.reduce(t + (emit[i + 1] + backward[i + 1])[None], axis=1)
            z = np.logaddexp.reduce(forward[-1] + backward[-1])
            node = np.exp(forward + backward - z)
            node[np.arange(n), y] -= 1
            pair = np.zeros((3, 3))
            pair[O] += np.exp(forward[0] + backward[0] - z)
            pair[:, O] += np.exp(forward[-1] + backward[-1] - z)
            path = [O, *y, O]
            for i in range(1, n):
                pair += np.exp(forward[i - 1][:, None] + t + (emit[i] + backward[i])[None] - z)
            for a, b in zip(path, path[1:], strict=False):
                pair[a, b] -= 1
            gt += pair**2
            t -= rate * (pair + decay * t) / np.sqrt(gt)
            for f, g in zip(features, node, strict=True):
                if np.abs(g).max() > 1e-4:
                    gw[f] += g**2
                    w[f] -= rate * (g + decay * w[f]) / np.sqrt(gw[f])
    return Field({f: w[i] for f, i in index.items()}, t)


# Scanning ------------------------------------------------------------------------------------

_WORDS = re.compile(r"\S+")


def find_spans(text: str, field: Field) -> list[tuple[int, int, str]]:
    """Base and decoded spans (start, end, kind), by start, then kind as listed."""
    base = base_spans(text)
    words = text.split()
    labels = field.decode(words, file_class(text)) if words else {}
    if not labels:
        return base
    # Words that touch a base span are left out of a decoded span; what is left on either side stays.
    # Of the base spans that start before b, one goes beyond a if the farthest does.
    starts, farthest = [s for s, _, _ in base], list(accumulate((e for _, e, _ in base), max))
    touches = lambda a, b: (k := bisect_left(starts, b)) > 0 and farthest[k - 1] > a
    added: list[list[int]] = []
    last = -1
    for i, m in enumerate(_WORDS.finditer(text)):
        if (y := labels.get(i)) is not None:
            core = _CORE.search(m[0])
            start, end = (m.start() + core.start(), m.start() + core.end()) if core else m.span()
            if touches(start, end):
                continue
            if y == I and added and last == i - 1 and not touches(added[-1][0], end):
                added[-1][1] = end
            else:
                added.append([start, end])
            last = i
    return sorted([*base, *((a, b, "crf") for a, b in added)], key=lambda s: (s[0], KINDS.index(s[2])))


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


_WORKER: dict[bytes, Field] = {}


def _field(weights: dict, transitions: np.ndarray) -> Field:
    key = hashlib.sha256(transitions.tobytes()).digest()
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = Field(weights, transitions)
    return _WORKER[key]


def scan(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """Per document: doc_id, spans array<struct<start, end, kind>>, base_sha256, written spans."""
    spark = docs.sparkSession
    ship(spark)
    field = field or train()
    shared = spark.sparkContext.broadcast((field.weights, field.transitions))  # a few thousand weights
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _field(*shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                found = [find_spans(t, model) for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([
                    b.column(0), pa.array([[{"start": a, "end": e, "kind": k} for a, e, k in spans] for spans in found], pa.list_(span)),
                    pa.array([hex_sha256(written([s for s in spans if s[2] != "crf"]).encode()) for spans in found]), pa.array([written(s) for s in found], pa.string()),
                ], names=["doc_id", "found", "base_sha256", "spans"])

    read = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return read.mapInArrow(run, "doc_id long, found array<struct<start: long, end: long, kind: string>>, base_sha256 string, spans string")


def secret_report(docs: DataFrame) -> DataFrame:
    """``scan`` with a count of each base kind instead of the list."""
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scan(docs).select("doc_id", *map(count, KINDS), "base_sha256", "spans")
