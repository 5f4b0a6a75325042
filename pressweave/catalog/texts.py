"""Row-wise text features."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from .. import vocab
from ..functions import parsing as ps
from ..functions import text as tx
from ..plans.pairing import assign_compatible, needs_validation, pair_compatible, rescue_allowed
from ..session import spread
from . import query

WS = tx.WS
SPACE_OUT = f"regexp_replace(%s, '{WS}+', ' ', 'g')"


def sq(x):
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def strip_sql(x):
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def words_sql(x):
    return f"regexp_replace(strip_accents(lower({x})), '[^\\p{{L}}\\p{{N}}{WS[1:-1]}]', ' ', 'g')"


def tokens_sql(x):
    return f"list_distinct(list_filter(regexp_split_to_array({words_sql(x)}, '{WS}+'), lambda t: length(t) >= 4))"


def articles(spark, sf):
    return fx.news_articles(spark, sf)


@query("content_fingerprint", f"""
SELECT id, sha256({sq('lower(coalesce(body, title))')}) AS fingerprint FROM news_articles""")
def content_fingerprint(spark, sf):
    a = spread(articles(spark, sf).select("id", "title", "body"))
    return a.select("id", tx.content_fingerprint("body", "title").alias("fingerprint"))


@query("significant_tokens", f"""
SELECT id, CAST(len({tokens_sql('title')}) AS BIGINT) AS n_tokens,
  array_to_string(list_sort({tokens_sql('title')}), ' ') AS tokens FROM news_articles""")
def significant_tokens(spark, sf):
    t = tx.significant_tokens("title")
    return articles(spark, sf).select("id", F.size(t).cast("bigint").alias("n_tokens"),
                                      F.array_join(F.array_sort(t), " ").alias("tokens"))


@query("significant_tokens_exact", f"""
SELECT id, CAST(len({tokens_sql('body')}) AS BIGINT) AS n_tokens,
  md5(array_to_string(list_sort({tokens_sql('body')}), ' ')) AS tokens_md5 FROM news_articles""")
def significant_tokens_exact(spark, sf):
    t = tx.significant_tokens("body", exact=True)
    return articles(spark, sf).select("id", t.alias("t")).select(
        "id", F.size("t").cast("bigint").alias("n_tokens"), F.md5(F.array_join(F.array_sort("t"), " ")).alias("tokens_md5"))


@query("entity_lists", """
SELECT id, coalesce(array_to_string(list_sort(list_distinct(list_transform(entities, lambda x: lower(trim(x))))),
  ','), '') AS entities FROM news_articles""")
def entity_lists(spark, sf):
    return articles(spark, sf).select(
        "id", F.array_join(F.array_sort(tx.norm_entities("entities")), ",").alias("entities"))


@query("entity_normal_form", f"""
SELECT id, {sq(words_sql('title'))} AS entity FROM news_articles""")
def entity_normal_form(spark, sf):
    return articles(spark, sf).select("id", tx.norm_entity("title").alias("entity"))


def _neighbours(spark, sf):
    """Each article next to the first article of its story."""
    a = articles(spark, sf).where("story_id is not null")
    head = a.groupBy("story_id").agg(F.min(F.struct("id", "title", "entities")).alias("h"))
    return a.join(head, "story_id").where("id <> h.id")


NEIGHBOURS_SQL = """
WITH h AS (SELECT story_id, arg_min(title, id) AS ht, arg_min(struct_pack(e := entities), id).e AS he,
  min(id) AS hid FROM news_articles WHERE story_id IS NOT NULL GROUP BY 1),
n AS (SELECT a.*, h.ht, h.he, h.hid FROM news_articles a JOIN h USING (story_id) WHERE a.id <> h.hid)
"""
EMPTY = "CAST([] AS VARCHAR[])"


@query("set_similarity", NEIGHBOURS_SQL + f""",
s AS (SELECT id, {tokens_sql('title')} AS a, {tokens_sql('ht')} AS b,
  coalesce(list_distinct(list_transform(entities, lambda x: lower(trim(x)))), {EMPTY}) AS ea,
  coalesce(list_distinct(list_transform(he, lambda x: lower(trim(x)))), {EMPTY}) AS eb FROM n)
SELECT id, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0
    ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, 6) AS token_jaccard,
  round(CASE WHEN len(ea) = 0 OR len(eb) = 0 THEN 0.0
    ELSE len(list_intersect(ea, eb)) / len(list_distinct(list_concat(ea, eb))) END, 6) AS entity_jaccard,
  CAST(len(list_intersect(ea, eb)) AS BIGINT) AS shared_entities,
  round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0
    ELSE len(list_intersect(a, b)) / least(len(a), len(b)) END, 6) AS token_overlap FROM s""")
def set_similarity(spark, sf):
    n = _neighbours(spark, sf).select(
        "id", tx.significant_tokens("title").alias("a"), tx.significant_tokens("h.title").alias("b"),
        tx.norm_entities("entities").alias("ea"), tx.norm_entities("h.entities").alias("eb"))
    return n.select("id", F.round(tx.jaccard("a", "b"), 6).alias("token_jaccard"),
                    F.round(tx.jaccard("ea", "eb"), 6).alias("entity_jaccard"),
                    tx.shared_count("ea", "eb").cast("bigint").alias("shared_entities"),
                    F.round(tx.overlap_coef("a", "b"), 6).alias("token_overlap"))


def rule_sql(x):
    return sq(f"regexp_replace(strip_accents(lower(coalesce({x}, ''))), '[\\^`¨¯´·¸]', '', 'g')")


@query("rule_text", f"SELECT id, {rule_sql('title')} AS rule_text FROM news_articles")
def rule_text(spark, sf):
    return articles(spark, sf).select("id", tx.norm_rule_text("title").alias("rule_text"))


def role_sql():
    text = "title || chr(10) || coalesce(story_identity, '') || chr(10) || coalesce(main_event, '')"

    def hit(stems):
        return f"regexp_matches({text}, '(?:^|[^A-Za-z0-9_])(?:{'|'.join(stems)})', 'i')"

    return (f"CASE WHEN article_type = 'aggregation' THEN 'aggregation' WHEN article_type = 'opinion' THEN 'analysis' "
            f"WHEN article_type = 'background' THEN 'background' WHEN {hit(vocab.REACTION_STEMS)} THEN 'reaction' "
            f"WHEN {hit(vocab.ANNOUNCEMENT_STEMS)} THEN 'announcement' ELSE 'event' END")


ROLE = ("title", "story_identity", "main_event", "article_type")


@query("event_roles", f"SELECT id, {role_sql()} AS role FROM news_articles")
def event_roles(spark, sf):
    return articles(spark, sf).select("id", tx.event_role(*ROLE).alias("role"))


def line_sql(label, value):
    return f"'{label}: ' || {value}"


NE = "nullif({}, '')"


@query("cluster_texts", f"""
WITH a AS (SELECT *, {role_sql()} AS role, {strip_sql('title')} AS t, nullif({strip_sql('main_event')}, '') AS me,
  nullif({strip_sql('story_identity')}, '') AS si FROM news_articles)
SELECT id, substr(concat_ws(chr(10), {line_sql('STORY_IDENTITY', 'coalesce(si, me, t)')},
  {line_sql('EVENT_ROLE', 'role')}, {line_sql('MAIN_EVENT', 'me')}, {line_sql('ARTICLE_TYPE', 'article_type')},
  {line_sql('LOCATION', 'location')}, {line_sql('ENTITIES', "array_to_string(entities[1:8], '; ')")},
  {line_sql('TOPICS', "array_to_string(topics[1:3], '; ')")}, {line_sql('TITLE', 't')}), 1, 1800) AS cluster_text
FROM a""")
def cluster_texts(spark, sf):
    return articles(spark, sf).select(
        "id", tx.cluster_text(*ROLE, "location", "entities", "topics").alias("cluster_text"))


def clean_body_sql(x):
    out = strip_sql(x)
    for p in vocab.BOILERPLATE:
        out = f"regexp_replace({out}, '{p}', '', 'g')"
    return strip_sql(out)


@query("embedding_texts", f"""
WITH a AS (SELECT *, nullif(story_identity, '') AS si, nullif(main_event, '') AS me,
  {clean_body_sql("nullif(body, '')")} AS cb,
  regexp_replace({strip_sql('title')}, '^(?:{vocab.TITLE_PREFIXES}){WS}*:{WS}*', '') AS ct FROM news_articles)
SELECT id, concat_ws(' | ', CASE WHEN article_type = 'aggregation' THEN '[ÖSSZEFOGLALÓ]' END, si,
  CASE WHEN me IS DISTINCT FROM si THEN me END, ct, '[' || strftime(published_at, '%Y-%m-%d') || ']',
  'Szereplők: ' || array_to_string(entities, ', '),
  CASE WHEN length(summary) >= 150 THEN summary
       WHEN length(main_event) >= 150 THEN main_event || ' ' || substr(cb, 1, greatest(400 - length(main_event), 0))
       WHEN length(cb) >= 150 THEN substr(cb, 1, 400) END, si) AS embedding_text FROM a""")
def embedding_texts(spark, sf):
    return articles(spark, sf).select("id", tx.embedding_text(
        "title", "body", "published_at", "summary", "main_event", "main_event", "story_identity",
        "article_type", "entities").alias("embedding_text"))


@query("broken_summaries", f"""
SELECT id, summary IS NULL OR {strip_sql('summary')} = ''
  OR lower({strip_sql('summary')}) IN ('n/a', 'null', 'undefined') AS broken FROM news_articles""")
def broken_summaries(spark, sf):
    return articles(spark, sf).select("id", tx.is_broken("summary").alias("broken"))


@query("redacted_texts", r"""
WITH t AS (SELECT conv_id, turn, 'Bearer abc' || conv_id || ' postgresql://u' || turn || ':pw@db/x key=S3CRET '
  || text AS text FROM conversations)
SELECT conv_id, turn, md5(regexp_replace(regexp_replace(replace(text, 'S3CRET', '<redacted:API_KEY>'),
  'postgresql://[^@\s]+@', 'postgresql://<redacted>@', 'g'), 'Bearer\s+[A-Za-z0-9._~+/=-]+', 'Bearer <redacted>', 'g'))
  AS digest FROM t""")
def redacted_texts(spark, sf):
    c = fx.table(spark, sf, "conversations")
    raw = F.concat(F.lit("Bearer abc"), F.col("conv_id").cast("string"), F.lit(" postgresql://u"),
                   F.col("turn").cast("string"), F.lit(":pw@db/x key=S3CRET "), F.col("text"))
    return c.select("conv_id", "turn", F.md5(tx.redact(raw, {"API_KEY": "S3CRET"})).alias("digest"))


def answers(spark, sf):
    """Model answers derived from the articles: clean JSON, JSON in prose, trash, missing field, odd topics."""
    a = articles(spark, sf)
    kind = F.col("id") % 5
    obj = F.to_json(F.struct(
        F.col("title").alias("summary"), F.when(kind == 3, F.lit("")).otherwise(F.col("title")).alias("headline"),
        F.concat(F.lit(" event "), F.col("id").cast("string"), F.lit(" ")).alias("mainEvent"),
        F.when(F.col("id") % 2 == 0, F.concat(F.lit("identity "), F.col("id").cast("string"))).alias("storyIdentity"),
        F.when(F.col("id") % 3 == 0, F.lit("gossip")).otherwise(F.col("article_type")).alias("articleType"),
        F.col("location"), F.col("entities"),
        F.concat(F.array(F.lit("nope")), F.coalesce("topics", F.array().cast("array<string>"))).alias("topics")))
    return a.select("id", "title", F.when(kind == 2, " 0 ").when(kind == 1, F.concat(
        F.lit("Here it is:\n"), obj, F.lit("\nDone."))).otherwise(obj).alias("answer"))


@query("parsed_analyses", f"""
SELECT id, CASE WHEN id % 5 = 2 THEN 'trash' WHEN id % 5 = 3 OR title = '' THEN 'failed' ELSE 'analyzed' END AS status,
  CASE WHEN ok THEN {strip_sql('title')} END AS summary, CASE WHEN ok THEN 'event ' || id END AS main_event,
  CASE WHEN ok THEN CASE WHEN id % 2 = 0 THEN 'identity ' ELSE 'event ' END || id END AS story_identity,
  CASE WHEN ok THEN CASE WHEN id % 3 = 0 THEN 'event' ELSE article_type END END AS article_type,
  CASE WHEN ok THEN location END AS location,
  CASE WHEN ok THEN coalesce(array_to_string(entities, ','), '') END AS entities,
  CASE WHEN ok THEN coalesce(array_to_string(topics, ','), '') END AS topics
FROM (SELECT *, id % 5 NOT IN (2, 3) AND title <> '' AS ok FROM news_articles)""")
def parsed_analyses(spark, sf):
    p = answers(spark, sf).select("id", ps.parse_analysis("answer").alias("p"))
    return p.select("id", "p.status", "p.summary", "p.main_event", "p.story_identity", "p.article_type",
                    "p.location", F.array_join("p.entities", ",").alias("entities"),
                    F.array_join("p.topics", ",").alias("topics"))


@query("analysis_inputs", """
SELECT id, md5('Cím: ' || title || chr(10) || chr(10) || CASE WHEN main_event <> '' THEN 'Lead: ' || main_event
  || chr(10) || chr(10) ELSE '' END || 'Szöveg: ' || substr(body, 1, 2000)) AS digest
FROM (SELECT id, title, coalesce(main_event, '') AS main_event, body FROM news_articles WHERE body <> '')""")
def analysis_inputs(spark, sf):
    return articles(spark, sf).where("body <> ''").select(
        "id", F.md5(ps.analysis_input("title", "main_event", "body")).alias("digest"))


@query("usage_tags", """
SELECT id, split_part(activity, '_', 1) || '_' || 'x' || '_' || operation AS activity,
  CASE WHEN id % 7 = 0 THEN 'openrouter' ELSE mode END AS mode,
  CASE WHEN id % 7 = 0 THEN CASE WHEN provider = 'gemini' THEN 'gemini-fallback' ELSE 'openrouter' END
       ELSE mode END AS historic_mode, prompt_tokens + completion_tokens AS total_tokens FROM usage_log""")
def usage_tags(spark, sf):
    u = fx.usage_log(spark, sf)
    mode = F.when(F.col("id") % 7 == 0, None).otherwise(F.col("mode"))
    return u.select("id", ps.activity(F.substring_index("activity", "_", 1), F.lit("x"), "operation").alias("activity"),
                    ps.usage_mode(mode).alias("mode"), ps.historic_usage_mode(mode, "provider").alias("historic_mode"),
                    ps.total_tokens("prompt_tokens", "completion_tokens").alias("total_tokens"))


RAW_ID = """CASE event_id % 5 WHEN 0 THEN 'bad' WHEN 1 THEN '-' || event_id WHEN 2 THEN 'NaN'
  ELSE CAST(event_id AS VARCHAR) END"""


@query("clean_ids", "SELECT event_id, event_id AS clean FROM events WHERE event_id % 5 IN (3, 4) AND event_id > 0")
def clean_ids(spark, sf):
    e = fx.table(spark, sf, "events")
    return e.select("event_id", ps.positive_id(F.expr(RAW_ID.replace("VARCHAR", "STRING"))).alias("clean")).where(
        "clean is not null")


@query("bounded_settings", """
SELECT event_id, least(greatest(coalesce(CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(floor(value) AS BIGINT) END,
  7), 5), 40) AS setting FROM events""")
def bounded_settings(spark, sf):
    e = fx.table(spark, sf, "events")
    raw = F.when(F.col("event_id") % 3 == 0, "x").otherwise(F.floor("value").cast("string"))
    return e.select("event_id", ps.bounded_int(raw, 7, 5, 40).alias("setting"))


@query("pair_compatibility", NEIGHBOURS_SQL.replace("min(id) AS hid", """min(id) AS hid,
  arg_min(struct_pack(e := main_event), id).e AS hm, arg_min(location, id) AS hl,
  arg_min(article_type, id) AS hk""").replace("h.ht, h.he, h.hid", "h.*").replace("SELECT a.*, h.*", """
  SELECT a.*, h.ht, h.he, h.hid, h.hm, h.hl, h.hk""") + f""",
x AS (SELECT id, {role_sql()} AS lr, {role_sql().replace('story_identity', 'ht').replace('main_event', 'hm')
      .replace('title', 'ht').replace('article_type', 'hk')} AS rr,
  {sq(words_sql('location'))} AS ll, {sq(words_sql('hl'))} AS rl,
  {tokens_sql("coalesce(story_identity, '') || ' ' || coalesce(main_event, '')")} AS lt,
  {tokens_sql("coalesce(ht, '') || ' ' || coalesce(hm, '')")} AS rt,
  coalesce(list_distinct(list_transform(entities, lambda e: {sq(words_sql('e'))})), {EMPTY}) AS le,
  coalesce(list_distinct(list_transform(he, lambda e: {sq(words_sql('e'))})), {EMPTY}) AS re FROM n),
y AS (SELECT *, len(list_intersect(le, re)) AS sh, CASE WHEN len(lt) = 0 OR len(rt) = 0 THEN 0.0
  ELSE len(list_intersect(lt, rt)) / least(len(lt), len(rt)) END AS ov FROM x)
SELECT id, CASE WHEN lr = 'aggregation' OR rr = 'aggregation' THEN 'aggregation'
  WHEN lr <> rr AND (lr IN ('analysis', 'background') OR rr IN ('analysis', 'background')) THEN 'role mismatch'
  WHEN ll <> rl THEN 'location mismatch' WHEN ov < 0.22 AND sh = 0 THEN 'low identity overlap'
  WHEN sh <= 1 AND ov < 0.34 THEN 'weak entity match' ELSE 'compatible' END AS reason FROM y""")
def pair_compatibility(spark, sf):
    a = articles(spark, sf).where("story_id is not null")
    side = F.struct("id", "title", "story_identity", "main_event", "article_type", "location", "entities")
    head = a.groupBy("story_id").agg(F.min(side).alias("r"))
    pairs = a.select("story_id", side.alias("l")).join(head, "story_id").where("l.id <> r.id")
    return pair_compatible(pairs).select(F.col("l.id").alias("id"), "reason")


@query("assignment_gates", NEIGHBOURS_SQL + f""",
s AS (SELECT id, {role_sql()} AS role, (id * 7 % 100) / 1000.0 + 0.9 AS sim, {tokens_sql('title')} AS a,
  {tokens_sql('ht')} AS b, coalesce(list_transform(entities, lambda x: lower(x)), {EMPTY}) AS ea,
  coalesce(list_transform(he, lambda x: lower(x)), {EMPTY}) AS eb FROM n),
m AS (SELECT id, role, sim, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0
    ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END AS tok,
  CASE WHEN len(ea) = 0 OR len(eb) = 0 THEN 0.0
    ELSE len(list_intersect(ea, eb)) / len(list_distinct(list_concat(ea, eb))) END AS ent,
  len(list_intersect(ea, eb)) AS sh FROM s)
SELECT id, CASE WHEN role = 'reaction' THEN tok >= 0.18 AND ent >= 0.34 AND sh >= 2
    WHEN role IN ('analysis', 'background') THEN tok >= 0.28 ELSE true END AS compatible,
  CASE WHEN role IN ('opinion', 'background', 'reaction', 'analysis') THEN sim >= 0.94 AND sh >= 1 AND tok >= 0.18
    WHEN sim >= 0.94 THEN sh >= 1 OR ent >= 0.15 OR tok >= 0.10
    WHEN sim >= 0.90 THEN sh >= 1 AND (ent >= 0.25 OR tok >= 0.20) ELSE false END AS rescue FROM m""")
def assignment_gates(spark, sf):
    n = _neighbours(spark, sf).select(
        "id", tx.event_role(*ROLE).alias("role"), (F.col("id") * 7 % 100 / 1000 + 0.9).alias("sim"),
        tx.significant_tokens("title").alias("a"), tx.significant_tokens("h.title").alias("b"),
        tx.norm_entities("entities").alias("ea"), tx.norm_entities("h.entities").alias("eb"))
    m = n.select("id", "role", "sim", tx.jaccard("a", "b").alias("tok"), tx.jaccard("ea", "eb").alias("ent"),
                 tx.shared_count("ea", "eb").alias("sh"))
    return m.select("id", assign_compatible("role", "tok", "ent", "sh").alias("compatible"),
                    rescue_allowed("role", "sim", "tok", "ent", "sh").alias("rescue"))


@query("merge_validation_flags", f"""
WITH p AS (SELECT story_id, id % 2 AS part, count(*) AS n, bool_or({role_sql()} IN ('analysis', 'background', 'reaction'))
  AS soft FROM news_articles WHERE story_id IS NOT NULL GROUP BY 1, 2)
SELECT story_id, count(*) > 1 AND (bool_or(soft) OR min(n) = 1) AS needs_validation FROM p GROUP BY 1""")
def merge_validation_flags(spark, sf):
    a = articles(spark, sf).where("story_id is not null").select(
        "story_id", (F.col("id") % 2).alias("part"), tx.event_role(*ROLE).alias("role"))
    return needs_validation(a, "story_id", "part")


@query("analyzed_articles")
def analyzed_articles(spark, sf):
    """A stand-in analyser called inside the tasks, its answers parsed like any model's."""
    import json

    from ..functions.hooks import analyze

    def model(title, lead, body):
        return json.dumps({"summary": (lead or body or "")[:100], "headline": title, "mainEvent": title,
                           "topics": ["sport"], "entities": (title or "").split()[:7]})

    a = articles(spark, sf).select("id", "title", F.col("summary").alias("lead"), "body")
    p = analyze(a, fn=model).select("id", ps.parse_analysis("answer").alias("p"))
    return p.select("id", "p.status", "p.main_event", F.size("p.entities").alias("n_entities"))


@query("analysis_table_lookup", """
SELECT id, CASE WHEN length(coalesce(body, '')) + length(coalesce(summary, '')) >= 50 AND id % 2 = 0
  THEN 'answer ' || id END AS answer FROM news_articles""")
def analysis_table_lookup(spark, sf):
    from ..functions.hooks import analyze
    a = articles(spark, sf)
    r = a.where("id % 2 = 0").select("id", F.concat(F.lit("answer "), F.col("id").cast("string")).alias("answer"))
    return analyze(a.select("id", "title", F.col("summary").alias("lead"), "body"), responses=r).select("id", "answer")
