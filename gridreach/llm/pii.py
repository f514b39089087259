"""Personal data by weak supervision, in DataFrame functions only.

Regular expressions propose candidate spans: the four base kinds (email, ip, card, phone) and wider
ones (local phone numbers, social security numbers, bank account numbers, names after a title,
spelled-out addresses). Four labelers vote on each candidate, for, against or not at all: a form
stricter than the pattern, a gazetteer, the words before it, and the variety of its characters.
Expectation-maximisation over the counts of all vote patterns estimates each labeler's reliability
on each kind and each candidate's probability; a logistic span classifier is trained on these and decides which wider candidates are
added. Base spans always stay; an added span overlaps none of them. Offsets are code points.

The driver gets the counts of distinct patterns: a number bounded by kinds, votes and buckets, not
by the rows. They cover all rows.

Defined results: a null text is an empty one, which has no spans; repeated rows give their result
again and count again; of spans that start together the kind listed first comes first; very long texts
are searched whole, in time that grows with their length (running sums and bounds of n candidates
take n * n / 8192 steps more, which count from a million on); an empty table gives no rows; other
columns, whatever their names, are ignored, or kept by ``mask``.

So that no place is read again and again, spelled addresses with over 40 characters before or after
the "at" and names of over 21 letters are no candidates of the wider kinds.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.checkpoints import cut
from .common import pick

BASE = ("email", "ip", "card", "phone")
WIDER = ("local", "ssn", "iban", "name", "spelled")
KINDS = (*BASE, *WIDER)
LABELERS = ("form", "gazetteer", "context", "variety")

# The base patterns, with possessive repeats and anchors that spare retries inside a run of the same
# class: same matches, linear time, and no recursion over a long run.
_LOCAL = "[A-Za-z0-9._%+-]"
_PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# A bank account number's length follows from its country; other letters take any length of 15 to 34.
_IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK|FI|FK|FO|GL|NL|SD", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|MN|XK", 21: "CH|HR|LI|LV", 22: "BG|BH|CR|DE|GB|GE|IE|ME|RS|VA",
    23: "AE|GI|IL|IQ|OM|SO|TL", 24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG", 25: "LY|PT|ST", 26: "IS|TR", 27: "BI|DJ|FR|GR|IT|MC|MR|SM",
    28: "AL|AZ|BY|CY|DO|GT|HN|HU|LB|NI|PL|SV", 29: "BR|EG|PS|QA|UA", 30: "JO|KW|MU|YE", 31: "MT|SC", 32: "LC", 33: "RU",
}
_GROUP = r"\x20?[A-Z0-9]"


def _iban() -> str:
    known = [rf"(?:{c})[0-9]{{2}}(?:{_GROUP}{{4}}){{{n // 4 - 1}}}" + (rf"{_GROUP}{{{n % 4}}}" if n % 4 else "") for n, c in _IBAN_LENGTHS.items()]
    other = rf"[A-Z]{{2}}[0-9]{{2}}(?:(?:{_GROUP}{{4}}){{7}}(?:{_GROUP}{{1,2}})?|(?:{_GROUP}{{4}}){{3,6}}(?:{_GROUP}{{1,3}})?|(?:{_GROUP}{{4}}){{2}}{_GROUP}{{3}})"
    # The trailing test is here too: an account number of its country's length comes before a longer one.
    return rf"(?=[A-Z]{{2}}[0-9]{{2}})(?:(?:{'|'.join(known)})(?![0-9A-Za-z])|{other})"


_FORMS = {
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "local": r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}",
    "iban": _iban(),
    "name": r"(?:Mr|Mrs|Ms|Dr)\.\x20[A-Z][a-z]{1,20}(?:\x20[A-Z][a-z]{1,20})?",
    "spelled": r"[A-Za-z0-9_%+-]{1,40}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,40}(?:\x20?[\[(]dot[\])]\x20?[a-z]{2,10}|\.[a-z]{2,10})",
}
_WIDER = r"(?<![0-9A-Za-z+])(?:" + "|".join(_FORMS.values()) + r")(?![0-9A-Za-z])"

# Gazetteers and context words.
_DOMAINS = r"\.(?:com|org|net|edu|gov|info|io|co|uk|de|fr|es|it|nl|eu|us|ca|ch|at|be|pl|ru|jp|cn|in|br|au)$"
_COUNTRIES = r"^\+(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-9]|35|37|38|42|67|68|85|88|96|97|99)"
_ISSUERS = "^(?:3|4|5|6|2[2-7])"
_FOR = {
    "email": r"mail|contact|write|address", "ip": r"\bip\b|host|server|address|client|addr", "card": r"card|visa|master|amex|credit|payment",
    "phone": r"phone|call|tel|mobile|fax|contact|whatsapp", "local": r"phone|call|tel|mobile|fax|contact", "ssn": r"ssn|social|security",
    "iban": r"iban|account|bank", "name": r"name|dear|patient|signed|contact", "spelled": r"mail|contact|write|address",
}
#: Frequent family and given names; words that follow a title without being a name.
_NAMES = (
    "Adams|Allen|Anderson|Baker|Becker|Bell|Bernard|Brown|Campbell|Carter|Clark|Collins|Cook|Cooper|Davis|Dubois|Edwards|Evans|Fischer|Garcia|Gonzalez|Green|Hall|Harris|Hernandez|Hill|Hoffmann|Hughes|"
    "Jackson|James|Johnson|Jones|Kelly|King|Koch|Lee|Lewis|Lopez|Martin|Martinez|Meyer|Miller|Mitchell|Moore|Morgan|Morris|Murphy|Nelson|Nguyen|Parker|Patel|Perez|Phillips|Ramirez|Richardson|Roberts|"
    "Robinson|Rodriguez|Rossi|Sanchez|Schmidt|Schneider|Schulz|Scott|Singh|Smith|Stewart|Taylor|Thomas|Thompson|Torres|Turner|Wagner|Walker|Watson|Weber|White|Williams|Wilson|Wright|Young|"
    "Anna|Daniel|David|Elizabeth|Emma|Hans|James|John|Jean|Laura|Maria|Mary|Michael|Peter|Pierre|Robert|Sarah|Susan|William"
)
_NO_NAMES = "Bean|Bones|Fix|Fox|Hyde|Incredible|Right|Robot|Speaker|President|Chairman|Chair|Secretary|The|This|That|Who|What|And|But|In|On|Of|It"
_AGAINST = r"version|isbn|order|invoice|page|copyright|doi|serial|model|part no"


def _total(part: Column) -> Column:
    return F.aggregate(part, F.lit(0), lambda a, x: a + x)


#: How often a labeler's vote is right, before any is counted: as if ``_PRIOR_VOTES`` votes had been seen.
_PRIOR_VOTES = 20
_PRIOR = {"form": 0.65, "gazetteer": 0.65, "context": 0.85, "variety": 0.55} | {("gazetteer", "name"): 0.85, ("gazetteer", "spelled"): 0.85}
_EMPTY = "array<struct<start: int, match: string, before: string>>"


def _with_matches(df: DataFrame, pattern: str, out: str) -> DataFrame:
    """``df`` with ``out``: the leftmost, non-overlapping matches in ``text``, with their places and 32 characters before."""
    kept = df.columns
    df = df.withColumn("__m", F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    df = df.withColumn("__g", F.when(F.size("__m") > 0, F.split("text", pattern, -1)))
    # Each list is made once: what a lambda reads is a column of the step before, used twice there,
    # or the list it runs over; else the optimizer would move its making into the lambda.
    df = df.withColumn("__z", F.when(F.size("__m") > 0, F.arrays_zip(F.col("__g").alias("g"), F.col("__m").alias("m"))))
    df = df.withColumn("__l", F.transform("__z", lambda z: F.length(z["g"]) + F.coalesce(F.length(z["m"]), F.lit(0))))
    # Sums of the lengths before each element, by blocks of 64.
    df = df.withColumn("__b", F.transform(F.sequence(F.lit(0), F.floor((F.size("__l") - 1) / 64).cast("int")), lambda b: F.slice(F.col("__l"), b * 64 + 1, 64)))
    df = df.withColumn("__t", F.transform("__b", _total))
    df = df.withColumn("__p", F.transform("__t", lambda _, i: _total(F.slice(F.col("__t"), 1, i))))
    starts = F.flatten(F.zip_with("__b", "__p", lambda x, p: F.transform(x, lambda _, i: p + _total(F.slice(x, 1, i)))))
    found = F.zip_with("__z", starts, lambda z, s: F.struct((s + F.length(z["g"])).alias("start"), z["m"].alias("match"), F.lower(F.right(z["g"], F.lit(32))).alias("before")))
    found = F.filter(found, lambda x: x["match"].isNotNull())
    return df.select(*kept, F.when(F.size("__m") > 0, found).otherwise(F.array().cast(_EMPTY)).alias(out))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    reversed_ = F.split(F.reverse(digits), "")
    value = lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2))
    return F.aggregate(F.transform(F.filter(reversed_, lambda c: c != ""), value), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    """What the base rules ask of a match beside its pattern; of a wider kind, what tells impossible ones."""
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.concat(F.lit("0"), F.substring(F.regexp_replace(p, "^0+", ""), 1, 3)).cast("int") <= 255))
    if kind == "card":
        return F.length(_digits(match)).between(12, 19) & _luhn(_digits(match))
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    if kind == "local":
        return ~match.rlike(r"^\(?[01]")
    if kind == "ssn":
        return ~match.rlike(r"^(?:000|666|9)|-00-|0000$")
    if kind == "iban":
        return F.length(F.regexp_replace(match, " ", "")).between(15, 34)
    return F.lit(True)


def _strict(kind: str, match: Column) -> Column:
    """Whether a match has the form that its kind is mostly written in, beyond what makes it a candidate."""
    if kind == "email":
        return match.rlike(r"^[A-Za-z0-9](?:[A-Za-z0-9_%+-]|\.(?!\.))*@[A-Za-z0-9](?:[A-Za-z0-9-]*\.)+[A-Za-z]{2,}$")
    if kind == "ip":
        return ~match.rlike(r"(?:^|\.)0[0-9]|^0\.")
    if kind == "card":
        return _digits(match).rlike("^(?:4(?:[0-9]{12}|[0-9]{15}|[0-9]{18})|5[1-5][0-9]{14}|2[2-7][0-9]{14}|3[47][0-9]{13}|6[0-9]{15,18})$")
    if kind == "phone":
        return match.rlike(r"^\+[1-9][0-9]{0,2}[\x20.-]?\(?[0-9]") & (F.length(F.regexp_replace(match, r"[^(]", "")) == F.length(F.regexp_replace(match, r"[^)]", "")))
    if kind == "local":
        return match.rlike(r"^(?:\([2-9][0-9]{2}\)\x20[2-9][0-9]{2}-|([2-9][0-9]{2})([.\x20-])[2-9][0-9]{2}\2)[0-9]{4}$")
    if kind == "iban":
        return match.rlike("^(?:" + "|".join(c for cs in _IBAN_LENGTHS.values() for c in cs.split("|")) + ")")
    if kind == "name":
        return match.rlike(r"^[A-Z][a-z]+\.\x20(?=[A-Z][a-z]*[aeiouy])[A-Z][a-z]{2,}")
    if kind == "spelled":
        return match.rlike(r"(?i)[\[(]at[\])].*[\[(]dot[\])]")
    return _valid(kind, match)


def _gazetteer(kind: str, match: Column) -> Column:
    """1 for, 0 against, null for no vote."""
    if kind == "email":
        return F.lower(match).rlike(_DOMAINS).cast("int")
    if kind == "ip":
        return F.when(match.rlike(r"^(?:0|127|255)\."), 0)
    if kind == "card":
        return _digits(match).rlike(_ISSUERS).cast("int")
    if kind == "phone":
        return match.rlike(_COUNTRIES).cast("int")
    if kind == "iban":
        return match.rlike("^(?:DE|FR|ES|GB|IT|NL|CH|AT|BE|PL|PT|IE|SE|NO|DK|FI)").cast("int")
    if kind == "name":
        return F.when(match.rlike(rf"\x20(?:{_NAMES})(?:\x20|$)"), 1).when(match.rlike(rf"\x20(?:{_NO_NAMES})(?:\x20|$)"), 0)
    if kind == "spelled":
        return F.concat(F.lit("."), F.lower(F.regexp_extract(match, "([A-Za-z]+)$", 1))).rlike(_DOMAINS).cast("int")
    if kind == "local":  # area codes have no 9 amid, and no 11 behind
        return F.substring(_digits(match), 2, 2).rlike("^(?:[0-8][02-9]|[02-8]1)$").cast("int")
    if kind == "ssn":  # areas that were given out
        return (F.substring(match, 1, 3).cast("int") <= 772).cast("int")
    return F.lit(None).cast("int")


def _candidate(kind: str, x: Column, base: bool, valid: Column) -> Column:
    """start, rank of the kind, end, kind, base, and the features that votes and buckets make up."""
    match, before = x["match"], x["before"]
    votes = {
        "form": (valid & _strict(kind, match)).cast("int"), "gazetteer": _gazetteer(kind, match),
        "context": F.when(before.rlike(_FOR[kind]), 1).when(before.rlike(_AGAINST), 0),
        "variety": F.lit(None).cast("int") if kind in ("name", "spelled") else F.when(F.size(F.array_distinct(F.split(match, ""))) <= 4, 0).when(F.size(F.array_distinct(F.split(match, ""))) >= 7, 1),
    }
    features = [F.lit(f"kind={kind}")] + [F.concat(F.lit(f"{name}="), F.coalesce(v.cast("string"), F.lit("-"))) for name, v in votes.items()]
    features.append(F.concat(F.lit("size="), F.least(F.floor(F.length(match) / 8), F.lit(4)).cast("string")))
    features.append(F.concat(F.lit("edge="), F.when(before.rlike(r"[\s(:,;]$|^$"), "1").otherwise("0")))
    return F.struct(
        x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), (x["start"] + F.length(match)).alias("end"),
        F.lit(kind).alias("kind"), F.lit(base).alias("base"), F.concat_ws(";", *features).alias("features"),
    )


def with_candidates(df: DataFrame) -> DataFrame:
    """``df`` (with a text that isn't null) and ``found``: all candidates, by start, then kind.

    Base kinds' matches that fail their rules are dropped, as the rules say.
    """
    kept = df.columns
    for kind, pattern in _PATTERNS.items():
        df = _with_matches(df, pattern, f"__{kind}")
    df = _with_matches(df, _WIDER, "__wider")
    parts = []
    for kind in BASE:
        good = F.filter(F.col(f"__{kind}"), lambda x: _valid(kind, x["match"]))
        parts.append(F.transform(good, lambda x: _candidate(kind, x, True, F.lit(True))))
    for kind in WIDER:
        mine = F.filter("__wider", lambda x: x["match"].rlike("^(?:" + _FORMS[kind] + ")$"))
        parts.append(F.transform(mine, lambda x: _candidate(kind, x, False, _valid(kind, x["match"]))))
    sizes = sum((F.size(f"__{k}") for k in (*BASE, "wider")), F.lit(0))
    empty = F.array().cast("array<struct<start: int, rank: int, end: int, kind: string, base: boolean, features: string>>")
    return df.select(*kept, F.when(sizes > 0, F.array_sort(F.concat(*parts))).otherwise(empty).alias("found"))


# The model, from counts of patterns -------------------------------------------------------------


def _votes(features: str) -> tuple[str, list[int | None]]:
    parts = dict(f.split("=") for f in features.split(";"))
    return parts["kind"], [None if parts[name] == "-" else int(parts[name]) for name in LABELERS]


def estimate(counts: dict[str, int], rounds: int = 40) -> tuple[dict[str, float], dict[tuple[str, str, int], float]]:
    """Expectation-maximisation over vote patterns: each pattern's probability, each labeler's reliability.

    A reliability is the probability that a labeler's vote is right, given the kind that it votes on
    and the truth; prior votes keep it off 0 and 1, and steady where few are counted.
    """
    before = {(name, kind, truth): _PRIOR.get((name, kind), _PRIOR[name]) for name in LABELERS for kind in KINDS for truth in (0, 1)}
    reliable = dict(before)
    prior = dict.fromkeys(KINDS, 0.5)
    known = {f: _votes(f) for f in counts}
    chance: dict[str, float] = {}
    for _ in range(rounds):
        for f, (kind, votes) in known.items():
            odds = math.log(prior[kind] / (1 - prior[kind]))
            for name, v in zip(LABELERS, votes, strict=True):
                if v is not None:
                    right, wrong = reliable[name, kind, 1], reliable[name, kind, 0]
                    odds += math.log(right / (1 - wrong)) if v else math.log((1 - right) / wrong)
            chance[f] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        for kind in KINDS:
            mine = [(chance[f], n) for f, n in counts.items() if known[f][0] == kind]
            prior[kind] = (sum(p * n for p, n in mine) + 1) / (sum(n for _, n in mine) + 2)
        right_votes, votes_cast = Counter(), Counter()
        for f, p in chance.items():
            kind, votes = known[f]
            for name, v in zip(LABELERS, votes, strict=True):
                if v is not None:
                    for truth in (0, 1):
                        weight = (p if truth else 1 - p) * counts[f]
                        votes_cast[name, kind, truth] += weight
                        right_votes[name, kind, truth] += weight * (v == truth)
        reliable = {k: (right_votes[k] + _PRIOR_VOTES * p) / (votes_cast[k] + _PRIOR_VOTES) for k, p in before.items()}
    return chance, reliable


def train(counts: dict[str, int], rounds: int = 300) -> dict[str, float]:
    """Weights of the span classifier: logistic regression on the estimated probabilities.

    A pattern weighs as the logarithm of its count; for every kind two made-up patterns, with all votes
    for and all against, stand for what the labelers mean, so that an empty table has a model too.
    """
    counts = dict(counts)
    for kind in KINDS:
        for v in (0, 1):
            f = ";".join([f"kind={kind}", *(f"{name}={v}" for name in LABELERS), "size=1", f"edge={v}"])
            counts[f] = counts.get(f, 0) + 2
    chance, _ = estimate(counts)
    rows = [(f.split(";"), chance[f], math.log1p(n)) for f, n in sorted(counts.items())]
    weights = {"": 0.0} | {name: 0.0 for names, _, _ in rows for name in names}
    total = sum(n for _, _, n in rows)
    for _ in range(rounds):
        slope = {name: 1e-3 * w for name, w in weights.items()}
        for names, p, n in rows:
            z = weights[""] + sum(weights[x] for x in names)
            g = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - p) * n / total
            slope[""] += g
            for x in names:
                slope[x] += g
        weights = {name: w - 1.5 * slope[name] for name, w in weights.items()}
    return weights


def _with_earlier(df: DataFrame, values: str, least: bool, out: str) -> DataFrame:
    """``df`` with ``out``: for each element of ``values``, an array or null, the greatest (or ``least``) of those before it; null where none.

    By blocks of 64: of n elements each is compared with 32 others, and each 64th with n / 128 more.
    """
    kept = df.columns
    fold, choose = (F.array_min, F.least) if least else (F.array_max, F.greatest)
    df = df.withColumn("__b", F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / 64).cast("int")), lambda b: F.slice(F.col(values), b * 64 + 1, 64)))
    df = df.withColumn("__t", F.transform("__b", fold))
    df = df.withColumn("__p", F.transform("__t", lambda _, i: fold(F.slice(F.col("__t"), 1, i))))
    return df.select(*kept, F.flatten(F.zip_with("__b", "__p", lambda x, p: F.transform(x, lambda _, i: choose(p, fold(F.slice(x, 1, i)))))).alias(out))


def _with_accepted(df: DataFrame, weights: dict[str, float], out: str) -> DataFrame:
    """``df`` with ``out`` in place of ``found``: the base spans, and the wider ones that the classifier accepts and that overlap none of them.

    Candidates come by their starts. A base span before a wider one overlaps it if it ends behind
    its start; one after it does if the next starts before its end.
    """
    kept = [c for c in df.columns if c != "found"]
    known = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    odds = lambda s: F.aggregate(F.split(s["features"], ";"), F.lit(weights[""]), lambda a, f: a + F.coalesce(F.element_at(known, f), F.lit(0.0)))
    # both lists are null where there is nothing to hold against base spans
    mixed = F.exists("found", lambda s: s["base"]) & F.exists("found", lambda s: ~s["base"])
    df = df.withColumn("__ends", F.when(mixed, F.transform("found", lambda s: F.when(s["base"], s["end"]))))
    df = df.withColumn("__starts", F.when(mixed, F.reverse(F.transform("found", lambda s: F.when(s["base"], s["start"])))))
    df = _with_earlier(_with_earlier(df, "__ends", False, "__before"), "__starts", True, "__behind")
    zipped = F.arrays_zip(F.col("found").alias("s"), F.coalesce("__before", F.array().cast("array<int>")).alias("e"), F.coalesce(F.reverse("__behind"), F.array().cast("array<int>")).alias("n"))
    clear = lambda z: F.coalesce(z["e"] <= z["s"]["start"], F.lit(True)) & F.coalesce(z["n"] >= z["s"]["end"], F.lit(True))
    good = F.filter(zipped, lambda z: z["s"]["base"] | (clear(z) & (odds(z["s"]) >= 0)))
    return df.select(*kept, F.transform(good, lambda z: z["s"]).alias(out))


def _pattern_counts(found: DataFrame) -> dict[str, int]:
    """How many candidates have each pattern: a few thousand patterns at most."""
    # Outer: for a plain explode the optimizer would add a filter on the list's size and push the
    # list's making down to the scan with it, once more for each step.
    rows = found.select(F.explode_outer("found.features").alias("f")).filter("f IS NOT NULL").groupBy("f").agg(F.count("*").alias("n")).collect()
    return {r["f"]: r["n"] for r in rows}


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def find_spans(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, found (accepted spans as structs: start, rank, end, kind, base, features)."""
    texts = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = cut(with_candidates(texts).select("doc_id", "found"))
    weights = train(_pattern_counts(found))
    return _with_accepted(found, weights, "found")


def pii_report(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, a digest of the base spans, and all spans written out."""
    count = lambda kind: F.size(F.filter("found", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda s: s["base"])
    return find_spans(docs).select("doc_id", *map(count, BASE), F.sha2(_written(base), 256).alias("base_sha256"), _written(F.col("found")).alias("spans"))


def mask(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, with each span's text replaced by its kind in angle brackets.

    Overlapping spans are replaced together, by the first one's kind. ``n_chars``, if it is there,
    is counted anew where a text changes. Candidates are found twice, once for the counts, once with
    the texts: they cost less than writing the texts for a second reading.
    """
    names = docs.columns
    flat = docs.toDF(*[f"__c{i}" for i in range(len(names))])  # by position: names may clash
    raw = f"__c{names.index('text')}"
    texts = flat.withColumn("text", F.coalesce(raw, F.lit("")))
    weights = train(_pattern_counts(with_candidates(texts.select("text")).select("found")))
    df = _with_accepted(with_candidates(texts), weights, "__f")
    df = df.withColumn("__e", F.when(F.size("__f") > 0, F.transform("__f", lambda s: s["end"])))
    df = _with_earlier(df, "__e", False, "__before")
    # A span that starts where all before it have ended is the first of those to be replaced together;
    # they end where all before the next such span have ended.
    first = F.filter(F.zip_with("__f", "__before", lambda s, e: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), e.alias("before"))), lambda z: z["before"].isNull() | (z["before"] <= z["start"]))
    df = df.select(*flat.columns, "text", F.array_max("__e").alias("__last"), first.alias("__h"))
    joined = F.transform("__h", lambda h, j: F.struct(h["start"].alias("start"), F.coalesce(F.get(F.col("__h"), j + 1)["before"], F.col("__last")).alias("end"), h["kind"].alias("kind")))
    df = df.withColumn("__j", F.coalesce(joined, F.array().cast("array<struct<start: int, end: int, kind: string>>"))).drop("__h")
    end = lambda i: F.coalesce(F.get(F.col("__j"), i - 1)["end"], F.lit(0))
    pieces = F.transform("__j", lambda s, i: F.concat(F.substring(F.col("text"), end(i) + 1, s["start"] - end(i)), F.lit("<"), F.upper(s["kind"]), F.lit(">")))
    tail = F.substring(F.col("text"), F.get(F.col("__j"), F.size("__j") - 1)["end"] + 1, F.length("text"))
    df = df.withColumn("__new", F.when(F.size("__j") > 0, F.concat(F.array_join(pieces, ""), tail)).otherwise(F.col(raw)))
    out = {raw: F.col("__new")}
    if "n_chars" in names:
        at = names.index("n_chars")
        out[f"__c{at}"] = F.when(F.size("__j") > 0, F.length("__new").cast(docs.schema.fields[at].dataType)).otherwise(F.col(f"__c{at}"))
    return df.select(*[out.get(c, F.col(c)) for c in flat.columns]).toDF(*names)
