"""Ingest: feeds, pages, screening, keyed writes, repair lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from .. import vocab
from ..functions.text import content_fingerprint
from ..operators import keyed
from ..plans import repair as rp
from ..plans import screening as sc
from ..sources import feeds, html
from ..session import spread
from . import query
from .texts import rule_sql, sq, strip_sql


def articles(spark, sf):
    return fx.news_articles(spark, sf)


# ---- feeds ------------------------------------------------------------------------

def feed_items(spark, sf):
    a = articles(spark, sf)
    i = F.col("id")
    return a.select(
        "source_slug", i.alias("pos"), F.when(i % 23 == 0, None).otherwise(F.col("url")).alias("link"), "title",
        F.when(i % 4 == 0, "").otherwise(F.col("summary")).alias("contentSnippet"),
        F.when(i % 8 == 0, None).otherwise(F.col("main_event")).alias("content"),
        F.when(i % 10 == 0, "not a date").otherwise(F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .alias("isoDate"),
        F.when(i % 3 == 0, F.concat(F.lit("by "), i.cast("string"))).alias("creator"), F.lit("desk").alias("author"),
        F.col("topics").alias("categories"),
        F.struct(F.col("image_url").alias("url"),
                 F.when(i % 6 == 0, "video/mp4").otherwise("image/jpeg").alias("type")).alias("enclosure"))


@query("feed_candidates", """
SELECT source_slug, url, title, body_fallback, category, author, image_url, published_at FROM (
SELECT source_slug, url, title, coalesce(nullif(CASE WHEN id % 4 = 0 THEN '' ELSE summary END, ''),
    nullif(CASE WHEN id % 8 = 0 THEN NULL ELSE main_event END, '')) AS body_fallback,
  topics[1] AS category, CASE WHEN id % 3 = 0 THEN 'by ' || id ELSE 'desk' END AS author,
  CASE WHEN id % 6 <> 0 THEN image_url END AS image_url,
  CASE WHEN id % 10 <> 0 THEN date_trunc('second', published_at) END AS published_at,
  row_number() OVER (PARTITION BY source_slug ORDER BY id) AS rn
FROM news_articles WHERE id % 23 <> 0 AND title <> '') WHERE rn <= 50""")
def feed_candidates(spark, sf):
    return feeds.feed_candidates(feed_items(spark, sf), 50)


# ---- pages ------------------------------------------------------------------------

def pages(spark, sf):
    p = spread(fx.table(spark, sf, "pages"))
    return p.withColumn("source", F.regexp_extract("url", r"^https?://([^/?#]+)", 1))


def _text_sql(x):
    for name, char in html.NAMED:
        x = f"replace({x}, '&{name};', '{char.replace(chr(39), chr(39) * 2)}')"
    return f"replace({x}, '&amp;', '&')"


def _squeezed(x):
    return f"trim(regexp_replace({x}, '{html.SPACE}', ' ', 'g'))"


def _visible(x):
    return _squeezed(_text_sql(f"regexp_replace({x}, '{html.TAG}', '', 'g')"))


def _lit(pattern):
    return "'" + pattern.replace("'", "''") + "'"


def _quoted(x, pattern):
    return f"regexp_extract({x}, {_lit(pattern)}, 1) || regexp_extract({x}, {_lit(pattern)}, 2)"


def _meta(keys, tags="m"):
    one = [f"nullif({_squeezed(_text_sql('(' + _quoted(f'list_filter({tags}, lambda t: regexp_matches(t, {_lit(html.meta_key(*k))}))[1]', html.CONTENT) + ')'))}, '')"
           for k in keys]
    return f"coalesce({', '.join(one)})"


_FIELDS = {n: _meta(keys) for n, keys in html.META_FIELDS.items()}
LINKS_SQL = f"""
WITH l AS (SELECT page_id, url, unnest(a) AS a, generate_subscripts(a, 1) - 1 AS pos FROM (
  SELECT page_id, url, regexp_extract_all(html, {_lit(html.LINK)}) AS a FROM pages)),
t AS (SELECT page_id, url, pos, {_text_sql('(' + _quoted('a', html.HREF) + ')')} AS href, {_visible('a')} AS text FROM l)
SELECT page_id, href, regexp_extract(url, '^(https?://[^/?#]+)', 1) || href AS link,
  coalesce(nullif(min_by(text, pos), ''), href) AS title, CAST(min(pos) AS INT) AS pos
FROM t WHERE starts_with(href, '/') GROUP BY page_id, url, href"""
PAGE_TEXT_SQL = f"""
SELECT page_id, {_visible(f"regexp_replace(html, {_lit(html.elements('head', *html.DROPPED))}, '', 'g')")} AS text FROM pages"""
META_SQL = f"""
SELECT page_id, {', '.join(f'{v} AS {n}' for n, v in _FIELDS.items())}
FROM (SELECT page_id, regexp_extract_all(html, {_lit(html.META)}) AS m FROM pages)"""


def _all_inside(name):
    return f"nullif(array_to_string(regexp_extract_all(c, {_lit(html.inside(name))}, 1), ''), '')"


ARTICLES_SQL = f"""
SELECT page_id, url, source, CAST(length(html) AS INT) AS html_len, html IS NULL AS fetch_failed,
  coalesce(nullif({_visible(f"regexp_extract(html, {_lit(html.inside('title'))}, 1)")}, ''), {_meta([('property', 'og:title')])}) AS title,
  {_visible(f"coalesce(art, main, regexp_replace(c, {_lit(html.elements('head'))}, '', 'g'))")} AS body,
  nullif({_visible(f"regexp_extract(art, {_lit(html.inside('p'))}, 1)")}, '') AS lead,
  coalesce({_FIELDS['section']}, nullif({_visible(f"regexp_extract(c, {_lit(html.CATEGORY)}, 1)")}, '')) AS category,
  {_FIELDS['og_image']} AS image_url, {_FIELDS['og_description']} AS og_description, {_FIELDS['published_time']} AS published
FROM (SELECT *, {_all_inside('article')} AS art, {_all_inside('main')} AS main FROM (
  SELECT *, regexp_replace(html, {_lit(html.elements(*html.DROPPED))}, '', 'g') AS c, regexp_extract_all(html, {_lit(html.META)}) AS m,
    regexp_extract(url, '^https?://([^/?#]+)', 1) AS source FROM pages))"""
KEY30 = "substr(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]', '', 'g'), 1, 50)"
QUALITY_CTE = f"""a AS ({ARTICLES_SQL}),
q AS (SELECT *, CASE WHEN fetch_failed THEN 'fallback' WHEN length(coalesce(body, '')) < 100 THEN 'degraded' ELSE 'good' END AS quality,
  CASE WHEN page_id % 3 = 0 THEN 'feed fallback text' END AS fb, {KEY30.format("'Feed item ' || page_id")} AS f, {KEY30.format('title')} AS t FROM a),
r AS (SELECT page_id, url, source, quality, nullif(CASE WHEN quality = 'good' THEN body ELSE fb END, '') AS final_body,
  quality = 'good' AND length(coalesce(body, '')) / html_len < 0.01 AS low_ratio,
  quality = 'good' AND coalesce(NOT (contains(t, substr(f, 1, 30)) OR contains(f, substr(t, 1, 30))), false) AND length(t) > 0 AS title_mismatch,
  coalesce(lead, 'feed lead') AS final_lead, category AS final_category, image_url AS final_image FROM q)"""
QUALITY_SQL = f"""WITH {QUALITY_CTE} SELECT *, final_body IS NULL AS skipped FROM r"""
STATS_SQL = f"""WITH {QUALITY_CTE} SELECT source, count(*) AS pages, count(*) FILTER (WHERE final_body IS NULL) AS skipped,
  count(*) FILTER (WHERE quality = 'fallback') AS fetch_failed, count(*) FILTER (WHERE quality = 'degraded') AS degraded,
  count(*) FILTER (WHERE low_ratio OR title_mismatch) AS issues FROM r GROUP BY source"""


@query("harvested_links", LINKS_SQL)
def harvested_links(spark, sf):
    return html.harvest_links(pages(spark, sf), "/")


@query("page_text", PAGE_TEXT_SQL)
def page_text(spark, sf):
    return html.extract_text(pages(spark, sf))


@query("page_articles", ARTICLES_SQL)
def page_articles(spark, sf):
    return html.extract_articles(pages(spark, sf))


@query("page_meta", META_SQL)
def page_meta(spark, sf):
    return html.meta_fields(pages(spark, sf))


def candidates(spark, sf):
    p = pages(spark, sf)
    i = F.col("page_id")
    return p.select("url", F.concat(F.lit("Feed item "), i.cast("string")).alias("title"),
                    F.when(i % 3 == 0, "feed fallback text").alias("body_fallback"), F.lit("feed lead").alias("lead"),
                    F.lit(None).cast("string").alias("category"), F.lit(None).cast("string").alias("image_url"))


@query("extraction_quality", QUALITY_SQL)
def extraction_quality(spark, sf):
    return html.extraction_quality(html.extract_articles(pages(spark, sf)), candidates(spark, sf))


@query("extraction_stats", STATS_SQL)
def extraction_stats(spark, sf):
    return html.extraction_stats(extraction_quality(spark, sf))


# ---- screening --------------------------------------------------------------------

def screenable(spark, sf):
    a = articles(spark, sf)
    i = F.col("id")
    teaser = F.when(i % 12 == 0, "Szexi fotók a strandról: ").when(i % 12 == 1, "Kvíz: ").when(
        i % 12 == 2, "A kormány döntött: ").when(i % 12 == 3, "Horoszkóp és galéria ").otherwise("")
    return spread(a.select(
        "id", F.when(i % 9 == 0, "ripost").otherwise(F.col("source_slug")).alias("source_slug"),
        F.when(i % 5 == 0, F.concat(F.lit("https://x.example/sztar/"), i.cast("string"))).otherwise(F.col("url"))
        .alias("url"), F.concat(teaser, "title").alias("title"),
        F.when(i % 7 == 0, "").otherwise(F.col("summary")).alias("lead"),
        F.when(i % 7 == 0, "foto").otherwise(F.col("body")).alias("body"),
        F.when(i % 4 == 0, "Bulvár").otherwise(F.get("topics", F.lit(0))).alias("category"), "published_at"))


SCREENABLE = """screenable AS (SELECT id, CASE WHEN id % 9 = 0 THEN 'ripost' ELSE source_slug END AS source_slug,
  CASE WHEN id % 5 = 0 THEN 'https://x.example/sztar/' || id ELSE url END AS url,
  CASE id % 12 WHEN 0 THEN 'Szexi fotók a strandról: ' WHEN 1 THEN 'Kvíz: ' WHEN 2 THEN 'A kormány döntött: '
    WHEN 3 THEN 'Horoszkóp és galéria ' ELSE '' END || title AS title,
  CASE WHEN id % 7 = 0 THEN '' ELSE summary END AS lead, CASE WHEN id % 7 = 0 THEN 'foto' ELSE body END AS body,
  CASE WHEN id % 4 = 0 THEN 'Bulvár' ELSE topics[1] END AS category, published_at FROM news_articles)"""


def verdict_ctes(stage: str) -> str:
    def word(c, p):
        return f"regexp_matches({c}, '(?:^|[^A-Za-z0-9_])(?:{p})(?:$|[^A-Za-z0-9_])')"

    def path(p):
        return f"regexp_matches(u, '/(?:{p})(?:/|-|$)')"

    def hits(rules_, test):
        return ", ".join(f"CASE WHEN {test(r[1])} THEN '{r[0]}' END" for r in rules_)

    def points(rules_, test):
        return " + ".join(f"CASE WHEN {test(r[1])} THEN {r[2]} ELSE 0 END" for r in rules_)

    thin = (f"({'false' if stage == 'candidate' else 'true'} AND length(l) + length(b) BETWEEN 1 AND 159 AND "
            + word("t || ' ' || l || ' ' || b", vocab.THIN_MEDIA_WORDS) + ")")
    soft = [(vocab.LOW_VALUE_TITLE, lambda p: word("t", p)), (vocab.LOW_VALUE_URL, path),
            (vocab.LOW_VALUE_CATEGORY, lambda p: word("c", p))]
    strict_hits = hits(vocab.STRICT_LOW_VALUE, lambda p: word("low", p))
    public_hits = hits(vocab.PUBLIC_INTEREST, lambda p: word("pub", p))
    soft_hits = ", ".join(hits(r, f) for r, f in soft)
    base = " + ".join(points(r, f) for r, f in soft)
    return f"""{SCREENABLE},
n AS (SELECT *, {rule_sql('title')} AS t, {rule_sql('url')} AS u, {rule_sql('category')} AS c, {rule_sql('lead')} AS l,
  {rule_sql('body')} AS b FROM screenable),
m AS (SELECT *, t || ' ' || c || ' ' || u AS low, t || ' ' || c || ' ' || l || ' ' || substr(b, 1, 500) AS pub FROM n),
k AS (SELECT *, list_filter([{strict_hits}], lambda x: x IS NOT NULL) AS strict_s,
  list_filter([{public_hits}], lambda x: x IS NOT NULL) AS public_s, {base} + CASE WHEN {thin} THEN 2 ELSE 0 END AS base,
  list_filter([{soft_hits}, CASE WHEN {thin} THEN 'thin-media-content' END], lambda x: x IS NOT NULL) AS soft_s FROM m),
z AS (SELECT *, base > 0 AND source_slug IN ('ripost', 'origo', 'metropol', 'blikk') AS boost,
  base + CASE WHEN base > 0 AND source_slug IN ('ripost', 'origo', 'metropol', 'blikk') THEN 1 ELSE 0 END AS score FROM k),
v AS (SELECT *, CASE WHEN len(strict_s) > 0 THEN 'strict-low-value'
    WHEN len(public_s) = 0 AND score >= 3 THEN 'low-value-media' END AS rule_id FROM z)"""


@query("low_value_verdicts", f"""
WITH {verdict_ctes('extracted')}
SELECT id, CASE WHEN rule_id IS NULL THEN 'keep' ELSE 'discard' END AS action, rule_id,
  round(CASE rule_id WHEN 'strict-low-value' THEN 0.9 WHEN 'low-value-media' THEN least(0.98, 0.55 + score * 0.08) END
    ::DOUBLE, 6) AS confidence,
  array_to_string(CASE WHEN len(strict_s) > 0 THEN strict_s WHEN len(public_s) > 0 THEN public_s
    WHEN boost THEN list_append(soft_s, 'source-boost') ELSE soft_s END, ',') AS signals FROM v""")
def low_value_verdicts(spark, sf):
    c = sc.classify_low_value(screenable(spark, sf), "extracted")
    return c.select("id", "action", "rule_id", F.round("confidence", 6).alias("confidence"),
                    F.array_join("signals", ",").alias("signals"))


@query("discard_log", f"""
WITH {verdict_ctes('candidate')}
SELECT source_slug, url, title, category, rule_id, 'candidate' AS stage, 'rules' AS detector, published_at
FROM v WHERE rule_id IS NOT NULL""")
def discard_log(spark, sf):
    _, log = sc.route_low_value(screenable(spark, sf), "candidate")
    return log.drop("reason", "confidence")


def payloads(spark, sf):
    a = articles(spark, sf)
    i = F.col("id")
    return a.select("id", F.when(i % 31 == 0, "").otherwise(F.col("url")).alias("url"), "title",
                    F.when(i % 11 == 0, "").otherwise(F.col("body")).alias("body"),
                    F.when(i % 2 == 0, None).otherwise(F.col("summary")).alias("lead"),
                    F.when(i % 3 == 0, None).otherwise(F.get("topics", F.lit(0))).alias("category"),
                    F.when(i % 13 == 0, "garbage").otherwise(F.date_format("published_at", "yyyy-MM-dd HH:mm:ss"))
                    .alias("published_at"))


PAYLOADS = """p AS (SELECT id, CASE WHEN id % 31 = 0 THEN '' ELSE url END AS url, title,
  CASE WHEN id % 11 = 0 THEN '' ELSE body END AS body, CASE WHEN id % 2 = 0 THEN NULL ELSE summary END AS lead,
  CASE WHEN id % 3 = 0 THEN NULL ELSE topics[1] END AS category,
  CASE WHEN id % 13 = 0 THEN NULL ELSE published_at END AS published_at FROM news_articles),
r AS (SELECT *, CASE WHEN url = '' OR title = '' THEN 'missing-required'
  WHEN body = '' AND coalesce(lead, '') = '' AND coalesce(category, '') = '' THEN 'no-content' END AS reject_reason FROM p)"""


@query("valid_payloads", f"""
WITH {PAYLOADS} SELECT id, sha256({sq('lower(coalesce(body, title))')}) AS fingerprint, published_at
FROM r WHERE reject_reason IS NULL""")
def valid_payloads(spark, sf):
    ok, _ = sc.validate_articles(payloads(spark, sf))
    return ok.select("id", "fingerprint", F.col("published_at").cast("timestamp_ntz").alias("published_at"))


@query("rejected_payloads", f"WITH {PAYLOADS} SELECT id, reject_reason FROM r WHERE reject_reason IS NOT NULL")
def rejected_payloads(spark, sf):
    return sc.validate_articles(payloads(spark, sf))[1].select("id", "reject_reason")


def probes(spark, sf):
    a = articles(spark, sf).where("image_url is not null and id % 17 <> 0")
    i = F.col("id")
    none = F.lit(None).cast("string")
    head = a.select(F.col("image_url").alias("url"), F.lit("HEAD").alias("method"),
                    F.when(i % 4 == 0, 405).when(i % 9 == 0, 404).otherwise(200).alias("status"),
                    F.when(i % 10 == 0, "text/html").otherwise("Image/JPEG").alias("content_type"),
                    F.when(i % 19 == 0, F.lit("timeout")).otherwise(none).alias("error"))
    get = a.where(i % 4 == 0).select(
        F.col("image_url").alias("url"), F.lit("GET").alias("method"),
        F.when(i % 8 == 0, 206).otherwise(500).alias("status"), F.lit("image/png").alias("content_type"),
        none.alias("error"))
    return head.unionByName(get)


@query("image_screening", """
SELECT id, CASE WHEN source_slug IN ('src3', 'src7') THEN 'excluded-source'
  WHEN image_url IS NULL OR id % 20 = 0 THEN 'invalid-url' WHEN id % 17 = 0 THEN 'fetch-failed'
  WHEN id % 19 = 0 THEN 'timeout'
  WHEN id % 4 = 0 THEN CASE WHEN id % 8 = 0 THEN 'ok' ELSE 'http-500' END
  WHEN id % 9 = 0 THEN 'http-404' WHEN id % 10 = 0 THEN 'non-image-content-type' ELSE 'ok' END AS image_reason
FROM news_articles""")
def image_screening(spark, sf):
    a = articles(spark, sf).select("id", "source_slug", F.when(
        F.col("id") % 20 == 0, F.concat(F.lit("ftp://"), "url")).otherwise(F.concat(F.lit(" "), "image_url", F.lit("\n")))
        .alias("image_url"))
    return sc.screen_images(a, probes(spark, sf), fx.EXCLUDED_IMAGES).select("id", "image_reason")


# ---- anti joins, keyed writes -----------------------------------------------------

@query("unknown_urls", """
SELECT id, url FROM news_articles WHERE url NOT IN (SELECT url FROM news_articles WHERE id % 3 = 0)""")
def unknown_urls(spark, sf):
    a = articles(spark, sf)
    return keyed.drop_known(a.select("id", "url"), a.where("id % 3 = 0"), "url")


FP = f"SELECT id, sha256({sq('lower(coalesce(body, title))')}) AS fingerprint FROM news_articles"


@query("unknown_fingerprints", f"""
WITH f AS ({FP}) SELECT min(id) AS id, fingerprint FROM f
WHERE fingerprint NOT IN (SELECT fingerprint FROM f WHERE id % 3 = 0) GROUP BY fingerprint""")
def unknown_fingerprints(spark, sf):
    f = spread(articles(spark, sf).select("id", "title", "body")).select("id", content_fingerprint("body", "title").alias("fingerprint"))
    return keyed.drop_known(f, f.where("id % 3 = 0"), "fingerprint", within_batch=True, order=[F.col("id")])


def samples(spark, sf):
    return fx.counter_samples(spark, sf).select("project_id", "branch_id", "bytes", "sample_id")


@query("upserted_counters", """
WITH b AS (SELECT project_id, branch_id, max(bytes) AS bytes FROM counter_samples GROUP BY 1, 2),
c AS (SELECT project_id, branch_id, min(bytes) AS bytes FROM counter_samples WHERE project_id % 2 = 0 GROUP BY 1, 2)
SELECT * FROM c UNION ALL SELECT * FROM b WHERE project_id % 2 <> 0""")
def upserted_counters(spark, sf):
    s = samples(spark, sf)
    base = s.groupBy("project_id", "branch_id").agg(F.max("bytes").alias("bytes"))
    new = s.where("project_id % 2 = 0").groupBy("project_id", "branch_id").agg(F.min("bytes").alias("bytes"))
    return keyed.upsert(base, new, ["project_id", "branch_id"])


@query("insert_ignored_logs", """
WITH b AS (SELECT id, url FROM news_articles WHERE id % 4 = 0),
n AS (SELECT id + 1000000000 AS id, url FROM news_articles UNION ALL SELECT id + 2000000000, url FROM news_articles)
SELECT * FROM b UNION ALL SELECT min(id), url FROM n WHERE url NOT IN (SELECT url FROM b) GROUP BY url""")
def insert_ignored_logs(spark, sf):
    a = articles(spark, sf).select("id", "url")
    new = (a.withColumn("id", F.col("id") + 1000000000)
           .unionByName(a.withColumn("id", F.col("id") + 2000000000)))
    return keyed.insert_ignore(a.where("id % 4 = 0"), new, ["url"], [F.col("id")])


@query("updated_sources", """
SELECT id, slug, CASE WHEN id % 3 = 0 THEN 'center' ELSE bias_rating END AS bias_rating FROM news_sources""")
def updated_sources(spark, sf):
    s = fx.news_sources(spark, sf).select("id", "slug", "bias_rating")
    values = s.where("id % 3 = 0").select("id", F.lit("center").alias("bias_rating"))
    return keyed.update_from(s, values, "id")


@query("requested_ids", """
SELECT count(*) AS requested, count(*) FILTER (WHERE a.id IS NULL) AS missing FROM (
  SELECT CASE WHEN event_id % 5 = 0 THEN -event_id - 1 ELSE event_id END AS id FROM events) e
LEFT JOIN news_articles a ON a.id = e.id""")
def requested_ids(spark, sf):
    e = fx.table(spark, sf, "events").select(
        F.when(F.col("event_id") % 5 == 0, -F.col("event_id") - 1).otherwise(F.col("event_id")).alias("id"))
    return keyed.lookup_summary(keyed.lookup_ids(e, articles(spark, sf).select("id")))


@query("ingest_funnel", f"""
WITH {verdict_ctes('extracted')},
f AS (SELECT id, source_slug, rule_id, title, url, body, lead, category,
  sha256({sq('lower(coalesce(body, title))')}) AS fp FROM v),
o AS (SELECT id, CASE WHEN source_slug = 'ripost' THEN 'missing_source'
  WHEN title = '' OR (coalesce(body, '') = '' AND coalesce(lead, '') = '' AND coalesce(category, '') = '') THEN 'skipped'
  WHEN rule_id IS NOT NULL THEN 'discarded' END AS early FROM f),
known AS (SELECT fp FROM f WHERE id % 10 = 3),
first AS (SELECT fp, min(id) AS id FROM f WHERE rule_id IS NULL AND title <> '' AND
  NOT (coalesce(body, '') = '' AND coalesce(lead, '') = '' AND coalesce(category, '') = '')
  AND fp NOT IN (SELECT fp FROM known) GROUP BY fp),
x AS (SELECT f.source_slug, coalesce(o.early, CASE WHEN first.id IS NULL THEN 'duplicate' ELSE 'inserted' END) AS outcome
  FROM f JOIN o USING (id) LEFT JOIN first ON first.id = f.id)
SELECT source_slug, count(*) AS scraped, count(*) FILTER (WHERE outcome = 'inserted') AS inserted,
  count(*) FILTER (WHERE outcome = 'duplicate') AS duplicate, count(*) FILTER (WHERE outcome = 'skipped') AS skipped,
  count(*) FILTER (WHERE outcome = 'discarded') AS discarded,
  count(*) FILTER (WHERE outcome = 'missing_source') AS missing_source FROM x GROUP BY 1""")
def ingest_funnel(spark, sf):
    batch = screenable(spark, sf)
    known = batch.where("id % 10 = 3").select(content_fingerprint("body", "title").alias("fingerprint"))
    return sc.ingest_funnel(sc.with_outcomes(batch, known, fx.news_sources(spark, sf)))


@query("run_status", """
SELECT user_id, count(*) FILTER (WHERE event_type <> 'error') AS succeeded,
  count(*) FILTER (WHERE event_type = 'error') AS failed,
  CASE WHEN count(*) FILTER (WHERE event_type = 'error') = 0 THEN 'success'
       WHEN count(*) FILTER (WHERE event_type <> 'error') = 0 THEN 'failure' ELSE 'partial_failure' END AS status
FROM events GROUP BY 1""")
def run_status(spark, sf):
    e = fx.table(spark, sf, "events").withColumn("ok", F.col("event_type") != "error")
    return sc.run_status(e, ["user_id"])


# ---- repair -----------------------------------------------------------------------

REPAIR_NOW = "2024-01-20 12:00:00"
WINDOW = f"created_at > TIMESTAMP '{REPAIR_NOW}' - INTERVAL 72 HOUR AND created_at <= TIMESTAMP '{REPAIR_NOW}' - INTERVAL 90 MINUTE"
BROKEN = f"(summary IS NULL OR {strip_sql('summary')} = '' OR lower({strip_sql('summary')}) IN ('n/a', 'null', 'undefined'))"


def flagged(spark, sf):
    a = articles(spark, sf)
    v = a.where("id % 8 <> 0").select("id")
    return rp.with_embedding_flag(a, v)


@query("repair_articles", f"""
SELECT id, {BROKEN} AS broken, id % 8 = 0 AS no_vector FROM news_articles
WHERE {WINDOW} AND ({BROKEN} OR id % 8 = 0) ORDER BY created_at DESC, id LIMIT 100""")
def repair_articles(spark, sf):
    out = rp.repair_articles(flagged(spark, sf), REPAIR_NOW, lookback_hours=72)
    return out.select("id", rp.is_broken("summary").alias("broken"), (~F.col("has_embedding")).alias("no_vector"))


@query("repair_images", f"""
SELECT id, image_url FROM news_articles WHERE {WINDOW} AND image_url <> '' ORDER BY created_at DESC, id LIMIT 100""")
def repair_images(spark, sf):
    return rp.repair_images(articles(spark, sf), REPAIR_NOW, lookback_hours=72).select("id", "image_url")


@query("repair_stories", f"""
SELECT id, article_count FROM news_stories WHERE {WINDOW.replace('created_at', 'updated_at')
  .replace('72 HOUR', '720 HOUR').replace(REPAIR_NOW, fx.NOW)} AND article_count >= 2 AND {BROKEN} ORDER BY updated_at DESC, id LIMIT 50""")
def repair_stories(spark, sf):
    s = fx.news_stories(spark, sf)
    return rp.repair_stories(s, fx.NOW, lookback_hours=720).select("id", "article_count")


@query("backfill_batches", """
SELECT id, position, CAST(ceil(position / 50.0) AS BIGINT) AS batch FROM (
  SELECT id, row_number() OVER (ORDER BY created_at, id) AS position FROM news_articles WHERE id % 8 = 0)""")
def backfill_batches(spark, sf):
    return rp.backfill_batches(flagged(spark, sf)).select("id", "position", "batch")
