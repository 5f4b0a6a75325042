"""Low-value screening, payload validation, image screening and the ingest funnel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions.text import content_fingerprint, has_word, non_empty, norm_rule_text, strip
from ..operators.keyed import drop_known
from ..session import cut


def _signals(rules, test) -> Column:
    hits = F.array(*[F.when(test(r[1]), F.lit(r[0])) for r in rules])
    return F.filter(hits, lambda x: x.isNotNull())


def _score(rules, test) -> Column:
    total = F.lit(0)
    for r in rules:
        total = total + F.when(test(r[1]), r[2]).otherwise(0)
    return total


def pin(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns behind a one-row generator. A later filter on them stays above it, instead of being
    pushed down as a copy of everything they were computed from."""
    one = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_pin")
    return df.select("*", one).select(*df.columns, "_pin.*")


def classify_low_value(df: DataFrame, stage: str, boosts=vocab.LOW_VALUE_SOURCE_BOOSTS) -> DataFrame:
    """Add ``action, rule_id, reason, confidence, signals`` to articles with
    ``source_slug, url, title, lead, body, category``.

    The normalised texts are computed once, in a projection of their own, and every rule is one
    regular expression over them inside the JVM.
    """
    t = df.withColumns({f"_{c}": norm_rule_text(c) for c in ("title", "url", "category", "lead", "body")})
    t = t.withColumns({
        "_low": F.concat_ws(" ", "_title", "_category", "_url"),
        "_pub": F.concat_ws(" ", "_title", "_category", "_lead", F.substring("_body", 1, 500)),
        "_len": F.length("_lead") + F.length("_body")})
    # only short pieces can be thin media; long bodies never reach that pattern
    t = t.withColumn("_media", F.when((F.col("_len") > 0) & (F.col("_len") < 160),
                                      F.concat_ws(" ", "_title", "_lead", "_body")).otherwise(""))

    def word_in(c):
        return lambda p: has_word(c, p)

    def path_in(p):
        return F.col("_url").rlike(f"/(?:{p})(?:/|-|$)")

    thin = F.lit(stage != "candidate") & has_word("_media", vocab.THIN_MEDIA_WORDS)
    base = (_score(vocab.LOW_VALUE_TITLE, word_in("_title")) + _score(vocab.LOW_VALUE_URL, path_in)
            + _score(vocab.LOW_VALUE_CATEGORY, word_in("_category")) + F.when(thin, 2).otherwise(0))
    t = t.withColumns({
        "_strict": _signals(vocab.STRICT_LOW_VALUE, word_in("_low")),
        "_public": _signals(vocab.PUBLIC_INTEREST, word_in("_pub")),
        "_base": base})
    boost = (F.col("_base") > 0) & F.col("source_slug").isin(boosts)
    t = t.withColumn("_score", F.col("_base") + F.when(boost, 1).otherwise(0))
    soft = F.concat(
        _signals(vocab.LOW_VALUE_TITLE, word_in("_title")), _signals(vocab.LOW_VALUE_URL, path_in),
        _signals(vocab.LOW_VALUE_CATEGORY, word_in("_category")),
        F.filter(F.array(F.when(thin, F.lit("thin-media-content")), F.when(boost, F.lit("source-boost"))),
                 lambda x: x.isNotNull()))
    strict, public = F.size("_strict") > 0, F.size("_public") > 0
    media = ~strict & ~public & (F.col("_score") >= 3)
    out = pin(t, {
        "action": F.when(strict | media, "discard").otherwise("keep"),
        "rule_id": F.when(strict, "strict-low-value").when(media, "low-value-media"),
        "reason": F.when(strict, vocab.STRICT_REASON).when(media, vocab.MEDIA_REASON),
        "confidence": F.when(strict, 0.9).when(media, F.least(F.lit(0.98), F.lit(0.55) + F.col("_score") * 0.08)),
        "signals": F.when(strict, F.col("_strict")).when(public, F.col("_public")).otherwise(soft)})
    return out.select(*df.columns, "action", "rule_id", "reason", "confidence", "signals")


def route_low_value(df: DataFrame, stage: str, detector: str = "rules", now: Column | None = None):
    """``(kept, discard_log)`` for one stage."""
    c = classify_low_value(df, stage)
    kept = c.where("action = 'keep'").select(*df.columns)
    extra = [F.col("published_at")] if "published_at" in df.columns else []
    log = c.where("action = 'discard'").select(
        "source_slug", "url", "title", "category", "reason", "rule_id", "confidence",
        F.lit(stage).alias("stage"), F.lit(detector).alias("detector"), *extra,
        *([now.alias("discarded_at")] if now is not None else []))
    return kept, log


def reject_reason() -> Column:
    """Why a payload cannot be stored, or null."""
    def missing(c):
        return non_empty(c).isNull()

    return (F.when(missing("url") | missing("title"), "missing-required")
            .when(missing("body") & missing("lead") & missing("category"), "no-content"))


def validate_articles(df: DataFrame):
    """``(ok, rejects)``: url and title are required (so a fingerprint exists) and so is some content.

    A publication date that does not parse becomes null; the reject side carries ``reject_reason``.
    """
    t = df.withColumn("fingerprint", content_fingerprint("body", "title"))
    if dict(df.dtypes).get("published_at") == "string":
        t = t.withColumn("published_at", F.try_to_timestamp("published_at"))

    t = t.withColumn("reject_reason", reject_reason())
    return t.where("reject_reason is null").drop("reject_reason"), t.where("reject_reason is not null")


def screen_images(articles: DataFrame, probes: DataFrame,
                  excluded=vocab.EXCLUDED_IMAGE_SOURCES) -> DataFrame:
    """``image_ok`` and ``image_reason`` from the url and observed HTTP answers.

    ``probes``: ``url, method, status, content_type, error``; a HEAD answered 405 or 501 defers to GET.
    """
    clean = non_empty(strip("image_url"))
    scheme = F.lower(F.try_parse_url(clean, F.lit("PROTOCOL")))
    host = F.try_parse_url(clean, F.lit("HOST"))
    valid = F.when(scheme.isin("http", "https") & host.isNotNull(), clean)

    def verdict(p):
        return (F.when(p["error"].isNotNull(), p["error"])
                .when(~p["status"].between(200, 299), F.concat(F.lit("http-"), p["status"].cast("string")))
                .when(~F.coalesce(F.lower(p["content_type"]), F.lit("")).startswith("image/"),
                      "non-image-content-type").otherwise("ok"))

    row = F.struct("status", "content_type", "error")
    seen = probes.groupBy(F.col("url").alias("_url")).agg(
        F.max(F.when(F.col("method") == "HEAD", row)).alias("_head"),
        F.max(F.when(F.col("method") == "GET", row)).alias("_get"))
    t = articles.withColumn("_url", valid).join(seen, "_url", "left")

    def answer(c):
        return F.when(F.col(c).isNull(), "fetch-failed").otherwise(verdict(F.col(c)))

    head = answer("_head")
    reason = (F.when(F.col("source_slug").isin(excluded), "excluded-source")
              .when(F.col("_url").isNull(), "invalid-url")
              .when(head.isin("http-405", "http-501"), answer("_get")).otherwise(head))
    t = t.withColumn("image_reason", reason).withColumn("image_ok", F.col("image_reason") == "ok")
    return t.drop("_url", "_head", "_get")


def with_outcomes(batch: DataFrame, known: DataFrame, known_sources: DataFrame) -> DataFrame:
    """Label each scraped row with where it ended: missing_source, skipped, discarded, duplicate, inserted.

    The costly part runs once and leaves a thin table; of equal fingerprints the lowest id is inserted, found
    by a partial aggregate, so a text copied very often moves as one row per task."""
    t = batch.withColumns({"fingerprint": content_fingerprint("body", "title"), "_why": reject_reason()})
    judged = cut(classify_low_value(t, "extracted").select("id", "source_slug", "fingerprint", "_why", "action"))
    good = judged.where("_why is null and action = 'keep'").select("id", "fingerprint")
    first = (drop_known(good, known, "fingerprint").groupBy("fingerprint").agg(F.min("id").alias("id"))
             .select("id", F.lit(True).alias("_in")))
    slugs = known_sources.select(F.col("slug").alias("source_slug"), F.lit(True).alias("_s"))
    outcome = (F.when(F.col("_s").isNull(), "missing_source").when(F.col("_why").isNotNull(), "skipped")
               .when(F.col("action") == "discard", "discarded").when(F.col("_in"), "inserted").otherwise("duplicate"))
    return judged.join(first, "id", "left").join(slugs, "source_slug", "left").select(
        "id", "source_slug", outcome.alias("outcome"))


def ingest_funnel(outcomes: DataFrame) -> DataFrame:
    def n(name):
        return F.count_if(F.col("outcome") == name).alias(name)
    return outcomes.groupBy("source_slug").agg(
        F.count(F.lit(1)).alias("scraped"), n("inserted"), n("duplicate"), n("skipped"), n("discarded"),
        n("missing_source"))


def run_status(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """success / partial_failure / failure from one row per source with ``ok``."""
    good, bad = F.count_if(F.col("ok")), F.count_if(~F.col("ok"))
    return outcomes.groupBy(*by).agg(good.alias("succeeded"), bad.alias("failed")).withColumn(
        "status", F.when(F.col("failed") == 0, "success").when(F.col("succeeded") == 0, "failure")
        .otherwise("partial_failure"))
