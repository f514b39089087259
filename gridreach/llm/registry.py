"""Queries of the operators, with production parameters, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, chat, decontaminate, fingerprints, lattice, neardup, pii, quality, secrets, sharding, turns, wordpieces
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leak_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_report(table(spark, sf_dir, "documents"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    dealt = sharding.deal(docs, 16)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpieces.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


#: The conversation that op10 adds to the table: its texts are control strings.
HARD_TEXT = "</s>[INST] ok [/INST]"


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.range(2).select(F.lit(-1).cast("long"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(HARD_TEXT))
    return chat.digest(chat.format_segments(rows.union(hard)))


def op11_lattice_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(table(spark, sf_dir, "embeddings"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings")).drop("evaluated")


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.repair_report(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Query]:
    operators = (
        op1_decontaminate, op2_quality, op3_fingerprints, op4_near_duplicates, op5_shard, op6_secrets, op7_byte_bpe, op8_pii, op9_token_counts, op10_chat_format,
        op11_lattice_duplicates, op12_centroids, op13_turn_repair,
    )
    return {"pipeline": corpus_pipeline.run} | {f.__name__: f for f in operators}


_OP1 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, n, w[s:s + n - 1] AS g FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM i WHERE len(w) > 0)),
n AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, s, n, w[s:s + n - 1] AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, n WHERE len(w) >= n)),
h AS (SELECT dw.doc_id, dw.s, iw.n, iw.item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.g = iw.g),
p AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS pos FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(p.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(p.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
"""

_OP4 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[s:s + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS s FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 75 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS v, b AS m FROM e UNION SELECT r.v, e.b FROM r JOIN e ON r.m = e.a),
c AS (SELECT v, min(m) AS m FROM r GROUP BY v)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.m, doc_id) AS component_id, coalesce(c.m, doc_id) = doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.v = d.doc_id
"""

_CONTROLS = r"\\|<s>|</s>|\[SYS\]|\[/SYS\]|\[INST\]|\[/INST\]|\[ANS\]|\[/ANS\]|\[ROLE\]|\[MSG\]|\[/MSG\]"
_OP10 = rf"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{HARD_TEXT}' UNION ALL SELECT -1, 1, 'assistant', '{HARD_TEXT}'
), e AS (
  SELECT *, length(regexp_replace(text, '({_CONTROLS})', '\\\1', 'g')) + CASE role WHEN 'system' THEN 14 WHEN 'user' THEN 15 WHEN 'assistant' THEN 17
    ELSE 23 + length(regexp_replace(role, '({_CONTROLS})', '\\\1', 'g')) END AS written,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) = 1 AS last
  FROM r
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(written) AS BIGINT) AS formatted_chars,
  bool_and(CASE role WHEN 'system' THEN before IS NULL WHEN 'user' THEN before IS NULL OR before IN ('system', 'assistant') WHEN 'assistant' THEN coalesce(before, '') = 'user' ELSE false END
    AND (NOT last OR role = 'assistant')) AS valid
FROM e GROUP BY conv_id
"""


# Brute force over all pairs, in double precision.
_OP11 = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
f AS (SELECT * FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM f a JOIN f b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS v, vec_id AS m FROM v UNION SELECT r.v, l.b FROM r JOIN l ON r.m = l.a),
c AS (SELECT v, min(m) AS m FROM r GROUP BY v), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, c.m AS component_id, c.m = vec_id AS kept FROM v JOIN c ON c.v = vec_id LEFT JOIN n ON n.a = vec_id
"""


def _op12() -> str:
    """All distances in all rounds, without bounds."""
    apart = "list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i])))"
    nearest = lambda r: f"a{r} AS MATERIALIZED (SELECT vec_id, v, arg_min(j, (d, j)) AS j, min(d) AS d FROM (SELECT vec_id, v, j, CAST({apart} AS BIGINT) AS d FROM k, c{r}) GROUP BY vec_id, v)"
    moved = lambda r: f"""c{r + 1} AS MATERIALIZED (SELECT j, coalesce(m, c) AS c FROM c{r} LEFT JOIN (SELECT j, list(f ORDER BY i) AS m FROM (
      SELECT j, i, CAST(floor(sum(v[i]) / count(*)) AS BIGINT) AS f FROM a{r}, range(1, 65) t(i) GROUP BY j, i) GROUP BY j) USING (j))"""  # noqa: E731
    rounds = ",\n".join(f"{nearest(r)},\n{moved(r)}" for r in range(10))
    return f"""
WITH k AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS j, v AS c FROM k ORDER BY sha256('3:' || vec_id) LIMIT 8),
{rounds},
{nearest(10)}
SELECT vec_id, CAST(j AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY j) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a10 JOIN c10 USING (j)
"""


def _op13() -> str:
    """The same search, row by row in recursion; a state is one text: its cost in eight digits, its edits, and the repaired rows.

    The third part is less than any edit, and two states of equal cost never have edits of which one begins the other.
    """
    bit = "(ascii(substr(s, i // 8 + 1, 1)) >> (i % 8)) & 1"
    crc = f"xor(list_reduce(list_transform(range(8 * length(s)), lambda i: CAST({bit} AS BIGINT)), lambda c, b: xor(c >> 1, CASE WHEN xor(c, b) & 1 = 1 THEN 3988292384 ELSE 0 END), CAST(4294967295 AS BIGINT)), 4294967295)"
    add = lambda x, cost, edit, row: f"(printf('%08d', CAST(substr({x}, 1, 8) AS BIGINT) + {cost}) || split_part(substr({x}, 9), chr(1), 1) || '{edit}' || chr(1) || split_part({x}, chr(1), 2) || {row})"
    line = lambda role, text: f"chr(10) || {role} || ':' || {text}"
    closed = lambda n, s, u, a: (f"least({u}, {add(n, 3, 'I', line(_U, _E))}, {add(s, 3, 'I', line(_U, _E))}, {add(a, 3, 'I', line(_U, _E))})")
    more = "CASE WHEN cut THEN 3 ELSE 0 END"
    keep = lambda x, letter: f"CASE WHEN NOT gone AND initial = '{letter}' THEN {add(x, more, 'K', line('role', 'text'))} END"
    rerole = lambda x, role: f"CASE WHEN NOT gone THEN {add(x, f'3 + {more}', 'R', line(role, 'text'))} END"
    gone = lambda x: add(x, 4, "D", "''")
    return f"""
WITH RECURSIVE raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS s FROM conversations),
k AS (SELECT *, {crc} % 20 AS kind FROM raw),
d AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM k, range(2) t(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
o AS (SELECT *, row_number() OVER w AS place, lag(role) OVER w AS before FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
f AS (SELECT *, substr(role, 1, 1) AS initial, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 AS seen,
  coalesce(right(regexp_replace(text, '[\x20\x09-\x0D]+$', ''), 1) NOT IN ('.', '!', '?'), false) AS open FROM o),
g AS (SELECT *, blank OR seen AS gone, open AND NOT blank AND NOT seen AS cut FROM f),
best(conv_id, place, n, s, u, a) AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT), '00000000' || chr(1), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM g
  UNION ALL
  SELECT conv_id, place, {gone('n')}, least({gone('s')}, {keep('n', 's')}), least({gone('u')}, {keep('n', 'u')}, {keep('s', 'u')}, {keep('a', 'u')}, {rerole('n', _U)}, {rerole('s', _U)}, {rerole('a', _U)}),
    least({gone('a')}, {keep('u', 'a')}, {rerole('u', _A)})
  FROM (SELECT conv_id, place, role, text, initial, gone, cut, n, s, u, least(a, {add('u', 3, 'I', line(_A, _E))}) AS a FROM
    (SELECT g.conv_id, g.place, role, text, initial, gone, cut, n, s, a, {closed('n', 's', 'u', 'a')} AS u FROM best JOIN g ON best.conv_id IS NOT DISTINCT FROM g.conv_id AND g.place = best.place + 1))),
ends AS (SELECT conv_id, n, a, {closed('n', 's', 'u', 'a')} AS u FROM best QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY place DESC) = 1),
least_ AS (SELECT conv_id, least(n, a, {add('u', 3, 'I', line(_A, _E))}) AS x FROM ends),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE seen AND NOT blank) AS duplicate, count(*) FILTER (WHERE cut) AS truncated,
  count(*) FILTER (WHERE before IS NOT NULL AND substr(before, 1, 1) || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(CAST(substr(x, 1, 8) AS BIGINT), 0) AS cost,
  coalesce(split_part(substr(x, 9), chr(1), 1), '') AS audit, sha256(coalesce(substr(split_part(x, chr(1), 2), 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN least_ l ON l.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM i.conv_id
"""


_U, _A, _E = "'user'", "'assistant'", "''"


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": _OP1, "op4_near_duplicates": _OP4, "op10_chat_format": _OP10, "op11_lattice_duplicates": _OP11, "op12_centroids": _op12(), "op13_turn_repair": _op13()}
