"""The pipeline against a plain reading of its stages, one document after another."""

import random
import re

import pytest

import corpus_pipeline
import public_tokenizers
import tiktoken
from gridreach.llm import bpe, decontaminate, pii, quality

from .test_operators import WORDS, near_duplicates_by_pairs


def tables(spark, folder, seed=4):
    """Good and bad texts, copies, leaks, personal data; nulls, ties, repeated rows and clashing names."""
    r = random.Random(seed)
    item = " ".join(f"item{i}" for i in range(14))
    good = lambda n=70: " ".join(r.choice(WORDS) + str(r.randrange(30)) for _ in range(n)) + "."
    bad = lambda: " ".join("$#!|" + str(r.randrange(9)) * r.randint(1, 5) for _ in range(40))
    texts = [good() if i % 3 else bad() for i in range(90)]
    texts += [texts[1], texts[2] + " more", texts[4].replace("0", "1", 1), texts[5] + " " + item, item, item + " " + item, "mail a.b@c.org or +49 30 1234567, card 4111 1111 1111 1111 " + good(20), None, "", " ", good(3000)]
    rows = [(i, t, "en", i % 5, 0.5) for i, t in enumerate(texts)]
    rows += [rows[1], (2, good(), "en", 0, 0.1), (None, good(), "en", 0, 0.2), (None, None, "en", 0, 0.3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, found int, score double")
    docs.selectExpr("*", "cast(length(text) as long) as n_chars", "1 as __f", "2 as __kept", "3 as words", "4 as c0").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, item), (1, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_stages_against_plain_reading(spark, tmp_path):
    tables(spark, tmp_path)
    sf = str(tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    model = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    automaton = decontaminate.SuffixAutomaton([("0", decontaminate.words_of(spark.read.parquet(f"{sf}/benchmark.parquet").filter("item_id = 0").first()["text"].encode()))], 10)
    key = lambda rows: sorted((tuple(x) for x in rows), key=repr)
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        before = docs.collect()
        stage(spark, docs, sf).write.parquet(f"{sf}/{i}")
        docs = spark.read.parquet(f"{sf}/{i}")
        assert docs.columns == columns, name
        got = docs.collect()
        if name == "quality":
            keep = quality.scores(model, [x["text"] or "" for x in before]) >= 0.5
            assert 20 < sum(keep) < len(before) - 20
            assert key(got) == key(x for x, k in zip(before, keep, strict=True) if k)
        elif name == "near_duplicates":
            known = [x for x in before if x["doc_id"] is not None]
            group = near_duplicates_by_pairs([(n, x["text"]) for n, x in enumerate(known)])  # by row
            linked = [x for x, (_, n, _) in zip(known, group, strict=True) if not n]
            least = {}
            for x, (_, n, g) in zip(known, group, strict=True):
                if n:
                    least[g] = min(least.get(g, (x["doc_id"], x["text"])), (x["doc_id"], x["text"]))
            want = [*least.values(), *((x["doc_id"], x["text"]) for x in linked), *((None, x["text"]) for x in before if x["doc_id"] is None)]
            assert key((x["doc_id"], x["text"]) for x in got) == key(want)
            assert len(got) < len(before)
        elif name == "decontamination":
            want = {}
            for n, x in enumerate(before):
                raw, gone = (x["text"] or "").encode(), 0
                total = len(decontaminate.words_of(raw))
                while spans := automaton.scan(decontaminate.words_of(raw))[0]:
                    gone += sum(b - a for a, b in spans)
                    raw = decontaminate.cut_spans(raw, spans)
                if gone <= total / 2:
                    want[n] = (x["doc_id"], raw.decode() if gone else x["text"])
            assert key((x["doc_id"], x["text"]) for x in got) == key(want.values()) and len(want) < len(before)
            assert not any("item3 item4" in (x["text"] or "") for x in got)
        else:
            assert len(got) == len(before)
            by_id = {x["doc_id"]: x["text"] for x in got if x["doc_id"] is not None}
            private = [x for x in before if "a.b@c.org" in (x["text"] or "")]
            for x in private:
                masked = by_id[x["doc_id"]]
                assert masked.startswith("mail <EMAIL> or <PHONE>, card <CARD> ") and masked.endswith(x["text"][-100:])
            rest = lambda rows: key((x["doc_id"], x["text"]) for x in rows if "mail " not in (x["text"] or ""))
            assert private and rest(got) == rest(before)
        for x in got:
            assert x["n_chars"] == (None if x["text"] is None else len(x["text"]))
    coder = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = key((x["doc_id"], tuple(coder.encode_ordinary(x["text"] or ""))) for x in docs.collect())
    done = corpus_pipeline.run(spark, sf)
    assert key((x["doc_id"], tuple(x["ids"])) for x in done.collect()) == want
    assert all(x["n_tokens"] == len(x["ids"]) for x in done.collect())


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("block_words", [10**6, 6])
def test_coverage_counts_all_cuts(spark, block_words):
    """What remains after a cut joins to a new leak; the share counts both, whatever the blocks."""
    bench = spark.createDataFrame([(0, "a b"), (1, "c d e f")], "item_id long, text string")
    rows = [(1, "x a b y z"), (2, "c d a b e f g"), (3, "c d a b e f g h i j k l m n")]
    got = decontaminate.remove_leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench, block_words=block_words)
    assert {x["doc_id"]: re.sub(r"\s+", " ", x["text"]).strip() for x in got.collect()} == {1: "x y z", 3: "g h i j k l m n"}


def test_mask_and_score_keep_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "mail x@y.org", 7, 8, 0.5)], "doc_id long, text string, found int, __f int, Score double")
    assert pii.mask(docs).collect()[0].asDict() == {"doc_id": 1, "text": "mail <EMAIL>", "found": 7, "__f": 8, "Score": 0.5}
    scored = quality.score(docs, None, "score_")
    assert scored.columns == [*docs.columns, "score_"] and scored.first()["Score"] == 0.5
