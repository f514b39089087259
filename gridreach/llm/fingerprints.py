"""Document fingerprints by Order MinHash, in DataFrame functions only.

A text is cut into tokens that cover it whole, white space included; its k-mers are three tokens in a
row (all tokens, with fewer). A token's ends depend on the characters around them, not on the
distance from the text's start, so an edit changes the k-mers near it only, with or without blanks.
Each k-mer is numbered by its occurrence. Under each of 64 permutations of (k-mer, number) the
minimal one of the whole text is selected; a sketch takes the ones of two permutations, itself and the
next, puts them in text order and hashes the tuple. Two fingerprints are alike in the share of equal
sketches; since tuples keep the order, moved passages count as edits.

K-mers are rows: one aggregation makes the 64 minima of a text as they stream by, so a text's k-mers
are held once, as an array of numbers, and only its minima beyond.

Bounds: k-mers are compared by 32 bits of hash within a text (of 2000 k-mers two different ones are
taken for equal with probability 5e-4, which changes their numbers only); places have 31 bits, more
than a text can have tokens. A run of more than 15 letters without any of ``_ENDS`` is one token to
its end.

Defined results: a null text is an empty one, whose fingerprint is empty; two empty fingerprints
are alike (1), an empty and another one are not (0). ``with_next``: documents follow each other in
descending doc_id, null ids last, equal ids by text; the first follows the last, so a document that
is alone follows itself; repeated rows follow each other; an empty table gives no rows. A very long
text is one row and its tokens one array. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick

K, PERMUTATIONS = 3, 64
#: Characters that end a token: marks, and all from U+0590 on, whose scripts go without blanks or are dense.
_MARKS = r"!-/:-@\[-`{-~\u0590-\U0010ffff"
#: Characters that end a token of more than 15 characters.
_ENDS = "aeiouAEIOU0-9\u0430\u0435\u0438\u043e\u0443\u03b1\u03b5\u03b9\u03bf"
_BLANK = r" \t\n\x0b\f\r"
TOKEN = rf"[{_BLANK}]++|[{_MARKS}][{_BLANK}]*+|[^{_BLANK}{_MARKS}]{{1,15}}+[^{_BLANK}{_MARKS}{_ENDS}]*+[{_MARKS}{_ENDS}]?[{_BLANK}]*+"
#: Documents that one group puts in order, about.
GROUP_ROWS = 500
_FAN = 64

_LOW = (1 << 32) - 1


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def _packed(hashed: Column, place: Column) -> Column:
    """32 bits of hash above a place."""
    return hashed.bitwiseAND(_long(~_LOW)).bitwiseOR(place)


def _kmers(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with ``out`` array<long> in place of ``text``: the numbered k-mers, each above its place.

    One step a column: each array is made once and then read by place, at least twice in its step;
    else the optimizer would make it anew for each element.
    """
    kept = [c for c in df.columns if c != text]
    java = TOKEN.replace("\\U0010ffff", r"\x{10ffff}")
    df = df.select(*kept, F.regexp_extract_all(F.col(text), F.lit(java), F.lit(0)).alias("__t"))
    df = df.withColumn("__n", F.size("__t"))
    token = lambda i: F.get(F.col("__t"), i)
    found = F.when(F.col("__n") >= K, F.transform(F.sequence(F.lit(0), F.greatest(F.col("__n") - K, F.lit(0))), lambda i: _packed(F.xxhash64(*[token(i + j) for j in range(K)]), i.cast("long"))))
    found = found.when(F.col("__n") > 0, F.array(_packed(F.xxhash64(F.array_join("__t", "")), _long(0)))).otherwise(F.array().cast("array<long>"))
    df = df.select(*kept, found.alias("__p"))
    kmer = lambda x: F.shiftright(x, 32)
    # Most texts repeat no k-mer: all numbers are 0. In others equal ones are neighbours once sorted.
    df = df.select(*kept, "__p", (F.size(F.array_distinct(F.transform("__p", kmer))) < F.size("__p")).alias("__again"))
    df = df.select(*kept, "__p", F.when(F.col("__again"), F.sort_array("__p")).alias("__s"))
    same = lambda x, i: (i > 0) & (kmer(F.get(F.col("__s"), i - 1)) == kmer(x))
    df = df.select(*kept, "__p", "__s", F.filter("__s", same).alias("__r"), F.filter("__s", lambda x, i: ~same(x, i)).alias("__f"))
    # Runs of equal ones among the repeats, by where they start.
    starts = F.filter(F.sequence(F.lit(0), F.size("__r") - 1), lambda i: (i == 0) | (kmer(F.get(F.col("__r"), i)) != kmer(F.get(F.col("__r"), i - 1))))
    df = df.select(*kept, "__p", "__r", "__f", F.when(F.size("__r") > 0, starts).alias("__b"))
    run = lambda b, j: F.slice(F.col("__r"), b + 1, F.coalesce(F.get(F.col("__b"), j + 1), F.size("__r")) - b)
    numbered = lambda x, o: _packed(F.xxhash64(kmer(x), o + 1), x.bitwiseAND(_long(_LOW)))
    again = F.flatten(F.transform("__b", lambda b, j: F.transform(run(b, j), numbered)))
    return df.select(*kept, F.when(F.size("__r") > 0, F.concat("__f", again)).otherwise(F.col("__p")).alias(out))


def fingerprints(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, fp array<int>): a row for each value of the keys, which must tell different texts apart.

    Where ``df`` is dealt out by some of the keys, nothing is sent.
    """
    kmers = _kmers(df.select(*keys, F.coalesce(text, F.lit("")).alias("__text")), "__text", "__k").select(*keys, F.explode_outer("__k").alias("__x"))
    x = F.col("__x")
    least = [F.min(_packed(F.xxhash64(F.shiftright(x, 32), F.lit(j)), x.bitwiseAND(_long(_LOW)))).alias(f"__m{j}") for j in range(PERMUTATIONS)]
    found = kmers.groupBy(*keys).agg(*least)

    def sketch(j: int) -> Column:
        a, b = F.col(f"__m{j}"), F.col(f"__m{(j + 1) % PERMUTATIONS}")
        place, value = (lambda m: m.bitwiseAND(_long(_LOW))), (lambda m: F.shiftright(m, 32))
        forth = place(a) <= place(b)
        return F.shiftright(F.xxhash64(forth, F.when(forth, value(a)).otherwise(value(b)), F.when(forth, value(b)).otherwise(value(a))), 32).cast("int")

    return found.select(*keys, F.when(F.col("__m0").isNotNull(), F.array(*map(sketch, range(PERMUTATIONS)))).otherwise(F.array().cast("array<int>")).alias("fp"))


def written(fp: str) -> Column:
    """A fingerprint as text: eight hexadecimal digits for each sketch."""
    return F.array_join(F.transform(fp, lambda x: F.lower(F.lpad(F.hex(x.cast("long").bitwiseAND(_long(_LOW))), 8, "0"))), "")


def likeness(a: str, b: str) -> Column:
    """The share of equal sketches, 0 to 1."""
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(equal / PERMUTATIONS)


def _levels(bounds: list[float]) -> list[list[float]]:
    """Every 64th bound, every 4096th and so on, the sparsest first."""
    out = [bounds]
    while len(out[0]) > _FAN:
        out.insert(0, out[0][_FAN - 1 :: _FAN])
    return out


def _group(doc_id: Column, bounds: list[float]) -> Column:
    """How many bounds an id doesn't exceed: ascending groups of descending ids; null ids last."""
    levels, at = _levels(bounds), F.lit(0)
    below = doc_id.cast("double")
    for level in levels:  # ascending; count the bounds below the id, among 64 of each level
        known = F.lit(level).cast("array<double>") if level else F.array().cast("array<double>")
        at = at * _FAN + F.size(F.filter(F.slice(known, at * _FAN + 1, _FAN), lambda b: b < below))
    return F.when(doc_id.isNull(), F.lit(len(bounds))).otherwise(F.lit(len(bounds)) - at)


def _in_order(docs: DataFrame, group_rows: int) -> DataFrame:
    """(doc_id, text, __g, __ghost, __pos, next_text): ``docs`` in groups that each hold a run of the order.

    Ids are cut at quantiles into groups of bounded size, of which a window puts each in order; the
    first document of a group is also sent to the group before it, where it stands last, as a ghost.
    """
    spark = docs.sparkSession
    ids = docs.select("doc_id")
    groups = min(_FAN**3, max(1, -(-ids.count() // group_rows)))
    bounds = sorted({float(b) for b in ids.dropna().approxQuantile("doc_id", [i / groups for i in range(1, groups)], max(0.25 / groups, 1e-5))}) if groups > 1 else []
    grouped = docs.withColumn("__g", _group(F.col("doc_id"), bounds))
    heads = ids.groupBy(_group(F.col("doc_id"), bounds).alias("__g")).agg(F.max("doc_id").alias("__head"))
    everything = Window.orderBy("__g").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    known = heads.select("__g", "__head", F.coalesce(F.lag("__g").over(Window.orderBy("__g")), F.max("__g").over(everything)).alias("__before"))
    rows = grouped.join(F.broadcast(known), "__g")  # a row per group, 262144 at most
    own = F.struct(F.col("__g").alias("group"), F.lit(False).alias("ghost"))
    guest = F.struct(F.col("__before").alias("group"), F.lit(True).alias("ghost"))
    rows = rows.withColumn("__p", F.explode(F.when(F.col("doc_id").eqNullSafe(F.col("__head")), F.array(own, guest)).otherwise(F.array(own))))
    rows = rows.select("doc_id", "text", F.col("__p.group").alias("__g"), F.col("__p.ghost").alias("__ghost"))
    order = Window.partitionBy("__g").orderBy("__ghost", F.col("doc_id").desc_nulls_last(), "text")
    return rows.select("*", F.row_number().over(order).alias("__pos"), F.lead("text").over(order).alias("next_text"))


def with_next(docs: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``docs`` (doc_id, text) with ``next_text``, the following document's."""
    return _in_order(docs, group_rows).filter(~F.col("__ghost")).select("doc_id", "text", "next_text")


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts and of their edited texts, and likenesses.

    The edited text: the last floor(n_chars / 2) code points are replaced by the first as many
    (or all) of the following document. All is done where the order was made: texts are sent once.
    """
    docs = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = _in_order(docs, GROUP_ROWS).select("__g", "__pos", "__ghost", "doc_id", "text", F.when(~F.col("__ghost"), edited).alias("edited"))
    rows = rows.select("*", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    both = F.array(F.struct(F.lit(0).alias("v"), F.col("text").alias("t")), F.struct(F.lit(1).alias("v"), F.col("edited").alias("t")))
    keys = ["__g", "__pos", "__ghost", "doc_id", "n_chars", "edited_sha256", "v"]
    texts = rows.select(*keys[:-1], F.explode(both).alias("b")).select(*keys[:-1], "b.v", "b.t")
    # In order: a document, its edited text, the next document; a ghost's edited text is none and not read.
    order = Window.partitionBy("__g").orderBy("__pos", "v")
    found = fingerprints(texts, keys, "t").select("*", F.lead("fp", 1).over(order).alias("edited_fp"), F.lead("fp", 2).over(order).alias("next_fp"))
    found = found.filter("v = 0 AND NOT __ghost")
    return found.select("doc_id", "n_chars", "edited_sha256", written("fp").alias("fingerprint"), written("edited_fp").alias("edited_fingerprint"), likeness("fp", "edited_fp").alias("near_edited"), likeness("fp", "next_fp").alias("near_next"))
