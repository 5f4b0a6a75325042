"""SQL definitions of the fixture views, prepended to a twin when it mentions them."""

from __future__ import annotations

import re

from .. import vocab
from ..fixtures import NOW


def sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


TOPIC_WEIGHT_CASE = "CASE topics[1] " + " ".join(
    f"WHEN '{t}' THEN {w}" for t, w in vocab.TOPIC_WEIGHTS.items()) + " ELSE 0.5 END"
LEFT = "('left', 'center-left')"
RIGHT = "('right', 'center-right')"
GROUP3 = ("CASE WHEN bias_rating IN ('left','center-left') THEN 'left' "
          "WHEN bias_rating IN ('right','center-right') THEN 'right' ELSE 'center' END")

VIEWS = {
    "news_sources": f"""
SELECT DISTINCT CAST(substr(source, 4) AS BIGINT) AS id, source AS slug, source AS name,
  'https://' || source || '.example' AS url,
  {sql_list(vocab.BIAS_ZONES)}[CAST(substr(source, 4) AS BIGINT) % 5 + 1] AS bias_rating,
  CAST(substr(source, 4) AS BIGINT) <> 19 AS is_active
FROM documents""",
    "news_articles": f"""
SELECT doc_id AS id, CAST(substr(source, 4) AS BIGINT) AS source_id, source AS source_slug,
  'https://' || source || '.example/a/' || doc_id AS url,
  substr(split_part(text, chr(10), 1), 1, 80) AS title, text AS body,
  CASE WHEN doc_id % 19 = 0 THEN NULL WHEN doc_id % 43 = 0 THEN 'N/A' ELSE substr(text, 1, 200) END AS summary,
  CASE WHEN doc_id % 5 = 0 THEN NULL ELSE substr(text, 1, 120) END AS main_event,
  substr(split_part(text, chr(10), 1), 1, 80) AS story_identity,
  CASE WHEN doc_id % 29 = 0 THEN NULL
       ELSE TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id * 37 % 43200) END AS published_at,
  TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id * 37 % 43200 + 20) AS created_at,
  CASE WHEN doc_id % 37 = 0 THEN NULL
       WHEN doc_id % 13 = (doc_id // 13) % 13 THEN [{sql_list(vocab.TOPICS)}[doc_id % 13 + 1]]
       ELSE [{sql_list(vocab.TOPICS)}[doc_id % 13 + 1], {sql_list(vocab.TOPICS)}[(doc_id // 13) % 13 + 1]]
  END AS topics,
  CASE WHEN doc_id % 31 = 0 THEN NULL
       ELSE ['Ent ' || (doc_id % 17), 'Org ' || (doc_id % 11), 'Ent ' || (doc_id % 5)] END AS entities,
  ['event','event','event','opinion','background','aggregation'][doc_id % 6 + 1] AS article_type,
  'Loc ' || (doc_id % 9) AS location,
  CASE WHEN doc_id % 7 = 0 THEN NULL ELSE 'https://img.example/' || doc_id END AS image_url,
  CASE WHEN doc_id % 41 = 0 THEN NULL ELSE doc_id % 199 END AS story_id
FROM documents""",
    "article_vectors": """
SELECT d.doc_id AS id, CAST(e.embedding AS DOUBLE[]) AS embedding
FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id % (SELECT count(*) FROM embeddings)""",
    "article_topics": """
SELECT id, story_id, unnest(topics) AS topic, generate_subscripts(topics, 1) AS pos
FROM news_articles WHERE topics IS NOT NULL""",
    "article_entities": """
SELECT id, story_id, source_id, unnest(entities) AS entity, generate_subscripts(entities, 1) AS pos
FROM news_articles WHERE entities IS NOT NULL""",
    "topic_rank": """
SELECT story_id, topic, row_number() OVER (PARTITION BY story_id ORDER BY n DESC, fid, fpos) AS rn FROM (
  SELECT story_id, topic, count(*) AS n, min(id) AS fid, arg_min(pos, id) AS fpos
  FROM article_topics WHERE story_id IS NOT NULL GROUP BY story_id, topic)""",
    "entity_forms": """
SELECT story_id, lower(trim(entity)) AS l, min(id) AS fid,
  arg_min(pos, id * 100 + pos) AS fpos, arg_min(entity, id * 100 + pos) AS form
FROM article_entities WHERE story_id IS NOT NULL GROUP BY story_id, lower(trim(entity))""",
    "entity_rank": """
SELECT story_id, form, row_number() OVER (PARTITION BY story_id ORDER BY fid, fpos) AS rn
FROM entity_forms f WHERE NOT EXISTS (
  SELECT 1 FROM entity_forms g WHERE g.story_id = f.story_id AND length(g.l) > length(f.l)
    AND contains(g.l, f.l))""",
    "news_stories": f"""
SELECT s.*, t.topics, e.entities,
  source_count * 3.0 + article_count * 1.0
    + CASE WHEN bias_groups >= 3 THEN 15.0 WHEN bias_groups >= 2 THEN 8.0 ELSE 0.0 END AS relevance_score
FROM (
  SELECT a.story_id AS id, count(*) AS article_count, count(DISTINCT a.source_id) AS source_count,
    count(DISTINCT {GROUP3}) AS bias_groups,
    min(coalesce(published_at, created_at)) AS first_seen_at, max(created_at) AS updated_at,
    max(published_at) AS latest_published_at, arg_min(title, a.id) AS title,
    arg_min(struct_pack(s := summary), a.id).s AS summary
  FROM news_articles a JOIN news_sources s ON s.id = a.source_id
  WHERE story_id IS NOT NULL GROUP BY a.story_id) s
LEFT JOIN (SELECT story_id, list(topic ORDER BY rn) AS topics FROM topic_rank WHERE rn <= 3 GROUP BY 1) t
  ON t.story_id = s.id
LEFT JOIN (SELECT story_id, list(form ORDER BY rn) AS entities FROM entity_rank WHERE rn <= 15 GROUP BY 1) e
  ON e.story_id = s.id""",
    "story_bias": f"""
SELECT a.story_id, count(*) FILTER (WHERE bias_rating IN {LEFT}) AS left_count,
  count(*) FILTER (WHERE bias_rating = 'center') AS center_count,
  count(*) FILTER (WHERE bias_rating IN {RIGHT}) AS right_count
FROM news_articles a JOIN news_sources s ON s.id = a.source_id WHERE story_id IS NOT NULL GROUP BY 1""",
    "story_image": """
SELECT story_id, image_url FROM (
  SELECT a.story_id, a.image_url,
    row_number() OVER (PARTITION BY story_id ORDER BY published_at DESC NULLS LAST, a.id) AS rn
  FROM news_articles a JOIN news_sources s ON s.id = a.source_id
  WHERE story_id IS NOT NULL AND image_url IS NOT NULL AND slug NOT IN ('src3', 'src7')) WHERE rn = 1""",
    "usage_log": """
SELECT event_id AS id, CASE WHEN event_type IN ('click', 'view') THEN 'gemini' ELSE 'openrouter' END AS provider,
  CASE WHEN user_id % 2 = 1 THEN 'gemini-fallback' ELSE 'openrouter' END AS mode,
  'm' || (user_id % 3) AS model, CASE WHEN event_type = 'signup' THEN 'embedding' ELSE 'chat' END AS operation,
  (CASE WHEN event_id % 2 = 0 THEN 'scheduled' ELSE 'manual' END)
    || (CASE WHEN user_id % 2 = 1 THEN '_recluster_storytitle' ELSE '_process_summarize' END) AS activity,
  CAST(floor(value * 10) AS BIGINT) AS prompt_tokens,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(floor(value) AS BIGINT) END AS completion_tokens,
  ts AS called_at FROM events""",
    "counter_samples": """
SELECT event_id AS sample_id, user_id AS project_id,
  CASE WHEN user_id % 3 = 0 THEN NULL ELSE 'br' || (user_id % 3) END AS branch_id,
  ts AS collected_at, CAST(floor(value * 1000) AS BIGINT) AS bytes FROM events""",
    "log_lines": """
SELECT 'exec' || user_id AS execution, ts, event_id AS pos, CASE event_type
  WHEN 'signup' THEN '[12:00:00] INFO: Job finished'
  WHEN 'purchase' THEN '    durationMs: ' || CAST(floor(value * 100) AS BIGINT)
  WHEN 'view' THEN '    count: ' || CAST(floor(value * 100) AS BIGINT)
  WHEN 'click' THEN '[12:00:00] INFO: Job started'
  ELSE '{"msg":"Job complete","durationMs":' || CAST(floor(value * 100) AS BIGINT) || '}' END AS text
FROM events""",
    "job_execs": """
SELECT 'job' || (user_id % 6) AS job, 'exec' || event_id AS execution, ts AS started_at,
  CASE WHEN event_id % 17 = 0 THEN NULL ELSE ts + to_seconds(CAST(floor(value * 10) AS BIGINT)) END AS completed_at,
  CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_type = 'error' THEN 'False' ELSE 'True' END AS completed_condition,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE floor(value * 10) * 3 / 4 END AS app_seconds
FROM events WHERE event_type IN ('purchase', 'error')""",
    "job_limits": """
SELECT DISTINCT 'job' || (user_id % 6) AS job,
  CASE WHEN user_id % 6 % 2 = 0 THEN 0.5 ELSE 1.0 END AS cpu,
  CASE WHEN user_id % 6 % 3 = 0 THEN 0.5 ELSE 1.0 END AS gib,
  CASE WHEN user_id % 6 = 5 THEN 0.0 ELSE 600.0 END AS timeout_s FROM events""",
}


def expand(sql: str) -> str:
    """Prefix ``sql`` with the views it uses, in definition order."""
    needed: set[str] = set()

    def visit(text):
        for name, body in VIEWS.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(body)

    visit(sql)
    if not needed:
        return sql
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in VIEWS if n in needed)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


NOW_SQL = f"TIMESTAMP '{NOW}'"
