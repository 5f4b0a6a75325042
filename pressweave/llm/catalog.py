"""The registered queries of this package and, where SQL can say the same, their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import (cascade, chat, decontam, htmltext, langid, linededup, mixing, neardup, prefixtrie, ruleensemble, tokenbin, vectorcode,
               wordbpe)
from .common import load, remainder

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return keep


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_language_id")
def op1_language_id(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 4) == 2
    trees = langid.learn(docs.where(~held_out))
    return langid.identify(docs, trees, keep={"held_out": held_out}).select("doc_id", "held_out", "lang_pred", "score")


OP2_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
p AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS i, unnest(ls) AS ln FROM (
  SELECT doc_id, string_split(regexp_replace(t || chr(10), '(\n|[.!?] )', '\1' || chr(1), 'g'), chr(1)) AS ls FROM d)),
h AS (SELECT *, CAST('0x' || md5(rtrim(ln))[1:8] AS BIGINT) AS h FROM p WHERE ln <> ''),
b AS (SELECT *, (31 * coalesce(lag(h) OVER (PARTITION BY doc_id ORDER BY i), 0) + h) % 3 = 0 AS ends FROM h),
c AS (SELECT *, coalesce(sum(CAST(ends AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM b),
k AS (SELECT doc_id, c, min(i) AS s, count(*) AS n, rtrim(string_agg(ln, '' ORDER BY i)) AS t FROM c GROUP BY doc_id, c),
r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id, s) AS nth FROM k WHERE n >= 2 AND length(t) >= 40),
gone AS (SELECT doc_id, c, n FROM r WHERE nth > 1),
size AS (SELECT doc_id, max(i) AS m FROM c GROUP BY doc_id),
left_ AS (SELECT doc_id, string_agg(CASE WHEN i = m THEN left(ln, length(ln) - 1) ELSE ln END, '' ORDER BY i) AS text FROM c JOIN size USING (doc_id) ANTI JOIN gone USING (doc_id, c) GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN g.doc_id IS NULL THEN d.t ELSE coalesce(left_.text, '') END AS text, CAST(coalesce(g.m, 0) AS BIGINT) AS n_lines_removed
FROM d LEFT JOIN left_ USING (doc_id) LEFT JOIN (SELECT doc_id, sum(n) AS m FROM gone GROUP BY doc_id) g ON g.doc_id = d.doc_id"""


@query("op2_line_dedup", OP2_SQL)
def op2_line_dedup(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return linededup.dedup_lines(docs, removed_lines="n_lines_removed")


OP3_SQL = r"""
WITH dw AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, n, ws[i:i + n - 1] AS w FROM (
    SELECT item_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM (SELECT *, least(len(ws), 10) AS n FROM iw WHERE len(ws) > 0))),
dwin AS (SELECT rid, i, n, ws[i:i + n - 1] AS w FROM (
    SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM win) WHERE len(ws) >= n)),
hit AS (SELECT rid, i, n, item_id FROM dwin JOIN win USING (n, w)),
pos AS (SELECT rid, count(DISTINCT j) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS j FROM hit) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)"""


@query("op3_decontamination", OP3_SQL)
def op3_decontamination(spark, sf_dir):
    return decontam.contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
b AS (SELECT d.rid, d.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
        length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS n_letters
      FROM d JOIN w USING (rid)),
l AS (SELECT rid, unnest(string_split(t, chr(10))) AS ln FROM d),
ld AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT ln) AS n_dup_lines FROM l
       WHERE regexp_matches(ln, '[^\x20\x09-\x0D]') GROUP BY rid),
p AS (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5),
g AS (SELECT rid, i, ws[i:i+4] AS win FROM p),
r AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM g),
rw AS (SELECT rid, count(DISTINCT j) AS n_repeat_words FROM (SELECT rid, unnest(range(i, i + 5)) AS j FROM r WHERE n >= 2) GROUP BY rid),
tw AS (SELECT rid, max(n) AS n_top FROM (SELECT rid, x, count(*) AS n FROM (SELECT rid, unnest(ws) AS x FROM w) GROUP BY rid, x) GROUP BY rid),
a AS (SELECT b.*, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines,
        coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_top, 0) AS n_top
      FROM b LEFT JOIN ld USING (rid) LEFT JOIN rw USING (rid) LEFT JOIN tw USING (rid)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM a)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 100 * n_dup_lines > 50 * n_lines OR word_chars < 2 * n_words
       OR word_chars > 20 * n_words OR 2 * n_upper > n_letters OR 10 * n_top > 3 * n_words) AS kept
FROM f"""


@query("op4_quality_cascade", OP4_SQL)
def op4_quality_cascade(spark, sf_dir):
    return cascade.quality_cascade(load(spark, sf_dir, "documents"), counts=True).select(
        "doc_id", *cascade.BASE, "base_failed", "kept")


@query("op5_token_binary")
def op5_token_binary(spark, sf_dir):
    return tokenbin.binary_round_trip(load(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=2)


OP6_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(ws) < 2 THEN ws
    ELSE [ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))] END) AS s FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
m AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS m FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM m JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * m >= 80 * (a.n + b.n - m)),
u AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r(x, y) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.x, u.y FROM r JOIN u ON r.y = u.x)
SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.y) AS component_id, w.doc_id = min(r.y) AS kept
FROM w JOIN r ON r.x = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id GROUP BY w.doc_id"""


@query("op6_near_duplicates", OP6_SQL)
def op6_near_duplicates(spark, sf_dir):
    return neardup.near_duplicates(load(spark, sf_dir, "documents"), width=2)


@query("op7_quality_classifier")
def op7_quality_classifier(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    stats = ruleensemble.cut(ruleensemble.text_statistics(docs))
    labels = load(spark, sf_dir, "labels").where(remainder(F.col("doc_id"), 5) != 0)
    scored = ruleensemble.classify(stats, ruleensemble.learn(stats, labels))
    return scored.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


@query("op8_html_text")
def op8_html_text(spark, sf_dir):
    return htmltext.extract_pages(load(spark, sf_dir, "pages"))


def _sql_escaped(x: str) -> str:
    out = f"replace({x}, '\\', '\\\\')"
    for mark in chat.CONTROL:
        out = f"replace({out}, '{mark}', '{mark[0]}\\{mark[1:]}')"
    return out


OP9_SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(chat.TURN) + len(chat.TEXT) + len(chat.END)} + length({_sql_escaped('role')}) + length({_sql_escaped('text')})) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""


@query("op9_chat_format", OP9_SQL)
def op9_chat_format(spark, sf_dir):
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    ok = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ok).alias("text"))
    records = chat.conversation_records(rows.unionByName(more))
    return chat.chat_digests(chat.format_chats(records, keep=("conv_id",)))


@query("op10_bpe_round_trip")
def op10_bpe_round_trip(spark, sf_dir):
    return wordbpe.round_trip(load(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s AS (SELECT source, source_size, 2.0::DOUBLE * source_size AS most,
  [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1]::DOUBLE AS w FROM s0),
t AS (SELECT sum(source_size) * 1.5::DOUBLE AS whole, sum(w) AS weight FROM s),
o AS (SELECT *, row_number() OVER r AS k, sum(most) OVER r AS given, sum(w) OVER r AS taken FROM s
  WINDOW r AS (ORDER BY most / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
c AS (SELECT 0 AS k, whole AS rest, weight AS left_w FROM t UNION ALL SELECT k, whole - given, weight - taken FROM o, t),
level AS (SELECT arg_min(rest, k) AS rest, arg_min(left_w, k) AS left_w FROM c LEFT JOIN (SELECT k - 1 AS k, most, w FROM o) n USING (k)
  WHERE n.k IS NULL OR most * left_w > w * rest),
g AS (SELECT source, source_size, CASE WHEN left_w <= 0 OR most * left_w <= w * rest THEN most ELSE w * rest / left_w END AS target FROM s, level),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM g),
h AS (SELECT d.*, r.source_size, r.target, floor(rate)::BIGINT AS whole, (rate - floor(rate)) * 4294967296 AS bound,
  sha256('0:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS x FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
v AS (SELECT source, i, abs(any_value(whole) * any_value(source_size) + sum(CASE WHEN CAST('0x' || substr(x, 8 * i + 1, 8) AS BIGINT) < bound THEN size ELSE 0 END)
  - any_value(target)) AS off FROM h, (SELECT unnest(range(8)) AS i) GROUP BY source, i),
b AS (SELECT v.source, min(i) AS i FROM v JOIN (SELECT source, min(off) AS off FROM v GROUP BY source) m
  ON v.source IS NOT DISTINCT FROM m.source AND v.off = m.off GROUP BY v.source)
SELECT doc_id, size, source_size, target, size * (whole + CASE WHEN CAST('0x' || substr(x, CAST(8 * i + 1 AS BIGINT), 8) AS BIGINT) < bound THEN 1 ELSE 0 END) AS taken
FROM h JOIN b ON h.source IS NOT DISTINCT FROM b.source
"""


@query("op11_source_mix", OP11_SQL)
def op11_source_mix(spark, sf_dir):
    rows, _ = mixing.plan(load(spark, sf_dir, "documents"), share=1.5, cap=2.0, weights=(3, 1, 2))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP12_SQL = r"""
WITH t AS (SELECT conv_id AS c, sha256(strlen(r) || ':' || r || x) AS k, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS w,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(r) || ':' || r || x)) AS p
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)),
h AS (SELECT c, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda ch: [ascii(ch), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT c FROM t)),
b AS (SELECT h.c, t.p, t.k, t.w FROM h JOIN t ON t.c = h.c - h.c % 20 AND t.p <= h.h),
r AS (SELECT c, p AS d, k, w FROM b UNION ALL
  SELECT t.c, p - h + coalesce(n, 0), k, w FROM t JOIN h USING (c) LEFT JOIN (SELECT c, count(*) AS n FROM b GROUP BY c) USING (c) WHERE p > h),
m AS (SELECT c, d, list(k) OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING) AS path, w FROM r UNION ALL SELECT c, 0, [], 0 FROM h),
n AS (SELECT d, path, min(c) AS conv_id, count(*) AS n_convs, any_value(w) AS w FROM m GROUP BY d, path),
l AS (SELECT c, max(d) AS d FROM m GROUP BY c),
e AS (SELECT d, path, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS ends FROM m JOIN l USING (c, d) GROUP BY d, path),
k AS (SELECT d - 1 AS d, path[:d - 1] AS path, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
z AS (SELECT n.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * w AS own FROM n LEFT JOIN k USING (d, path)),
s AS (SELECT m.d, m.path, sum(own)::BIGINT AS saved, count(*) FILTER (n_children = 0) AS leaves FROM z JOIN m ON m.c = z.conv_id AND m.d <= z.d GROUP BY m.d, m.path)
SELECT z.conv_id, z.d AS depth, u.conv_id AS parent_conv_id, z.n_convs, z.n_children, leaves AS n_leaves, saved AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM z JOIN s USING (d, path) LEFT JOIN e USING (d, path) LEFT JOIN n u ON z.d > 0 AND u.d = z.d - 1 AND u.path = z.path[:z.d - 1]
"""


@query("op12_prefix_trie", OP12_SQL)
def op12_prefix_trie(spark, sf_dir):
    paths = prefixtrie.conversation_paths(load(spark, sf_dir, "conversations"))
    c = F.col("conv_id")
    return prefixtrie.prefix_trie(prefixtrie.with_heads(paths, c - c % 20, F.crc32(c.cast("string")) % 4, most=3))


OP13_SQL = r"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT vec_id, p, v[4 * p + 1] AS a, v[4 * p + 2] AS b, v[4 * p + 3] AS c, v[4 * p + 4] AS d FROM k, (SELECT unnest(range(16)) AS p)),
c0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, a, b, c, d FROM q
  QUALIFY row_number() OVER (PARTITION BY p ORDER BY vec_id) <= 64),
{rounds},
s AS (SELECT vec_id, string_agg(printf('%02x', CAST(y AS INT)), '' ORDER BY p) AS code, sum(z)::BIGINT AS error FROM (SELECT vec_id, p, e AS y, dist AS z FROM a2) GROUP BY vec_id),
f AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM (
  SELECT p, e, generate_subscripts([a, b, c, d], 1) AS i, unnest([a, b, c, d]) AS x FROM c2)),
g AS (SELECT label, sum(error)::BIGINT AS label_error FROM k JOIN s USING (vec_id) GROUP BY label)
SELECT vec_id, code, error, label_error, codebooks_sha256 FROM k JOIN s USING (vec_id) JOIN g ON k.label IS NOT DISTINCT FROM g.label, f
"""
_SQUARES = " + ".join(f"(q.{x} - c.{x}) * (q.{x} - c.{x})" for x in "abcd")
_FLOORS = ", ".join(f"CASE WHEN n IS NULL THEN c.{x} ELSE (m.{x} - ((m.{x} % n) + n) % n) // n END AS {x}" for x in "abcd")
OP13_SQL = OP13_SQL.replace("{rounds}", ",\n".join(f"""a{i} AS (SELECT vec_id, p, min(x * 64 + e) % 64 AS e, min(x) AS dist FROM (
  SELECT vec_id, p, e, {_SQUARES} AS x FROM q JOIN c{i} c USING (p)) GROUP BY vec_id, p)""" + ("" if i == 2 else f""",
c{i + 1} AS (SELECT p, e, {_FLOORS} FROM c{i} c LEFT JOIN (SELECT p, e, count(*) AS n, sum(a)::BIGINT AS a, sum(b)::BIGINT AS b, sum(c)::BIGINT AS c, sum(d)::BIGINT AS d
  FROM a{i} JOIN q USING (vec_id, p) GROUP BY p, e) m USING (p, e))""") for i in range(3)))


@query("op13_vector_codes", OP13_SQL)
def op13_vector_codes(spark, sf_dir):
    return vectorcode.vector_codes(load(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2, scale=256)
