"""Parsing of model answers, resource strings and log lines as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab
from .text import col, non_empty, strip

ANALYSIS_SCHEMA = ("summary string, headline string, mainEvent string, storyIdentity string, "
                   "articleType string, location string, entities array<string>, topics array<string>")


def json_object(c) -> Column:
    """From the first ``{`` to the last ``}``."""
    return non_empty(F.regexp_extract(col(c), r"(?s)\{.*\}", 0))


def parse_analysis(c) -> Column:
    """Struct with ``status`` (analyzed / trash / failed) and the cleaned analysis fields."""
    p = F.from_json(json_object(c), ANALYSIS_SCHEMA)
    have = (non_empty(p["summary"]).isNotNull() & non_empty(p["headline"]).isNotNull()
            & non_empty(p["mainEvent"]).isNotNull())
    status = F.when(strip(c) == "0", "trash").when(have, "analyzed").otherwise("failed")
    ok = status == "analyzed"
    empty = F.array().cast("array<string>")
    topics = F.filter(F.coalesce(p["topics"], empty), lambda t: t.isin(vocab.TOPICS))

    def keep(v):
        return F.when(ok, v)

    return F.struct(
        status.alias("status"),
        keep(strip(p["summary"])).alias("summary"),
        keep(strip(p["headline"])).alias("headline"),
        keep(strip(p["mainEvent"])).alias("main_event"),
        keep(strip(F.coalesce(non_empty(p["storyIdentity"]), p["mainEvent"]))).alias("story_identity"),
        keep(F.when(p["articleType"].isin(vocab.ARTICLE_TYPES), p["articleType"]).otherwise("event"))
        .alias("article_type"),
        keep(strip(non_empty(p["location"]))).alias("location"),
        keep(F.slice(F.coalesce(p["entities"], empty), 1, 5)).alias("entities"),
        keep(F.slice(topics, 1, 3)).alias("topics"))


COHERENCE_SCHEMA = ("coherent boolean, title string, headline string, summary string, "
                    "groups array<array<int>>")


def parse_coherence(answer, article_ids, old_title=None, old_summary=None) -> Column:
    """Verdict struct ``(coherent, title, summary, groups)`` or null.

    ``article_ids`` is the numbered member list the judge saw; groups come back as ids. The answer
    ``1`` keeps the existing title.
    """
    ids = col(article_ids)
    p = F.from_json(json_object(answer), COHERENCE_SCHEMA)
    groups = F.filter(
        F.transform(p["groups"], lambda g: F.filter(
            F.transform(g, lambda i: F.when(i >= 1, F.get(ids, i - 1))), lambda x: x.isNotNull())),
        lambda g: F.size(g) > 0)
    no_groups = F.lit(None).cast("array<array<bigint>>")
    text = F.lit(None).cast("string")

    def verdict(coherent, title, summary, grp):
        return F.struct(F.lit(coherent).alias("coherent"), title.alias("title"), summary.alias("summary"),
                        grp.alias("groups"))

    kept = (strip(answer) == "1") & (col(old_title).isNotNull() if old_title is not None else F.lit(False))
    fallback = F.coalesce(p["title"], p["headline"])
    return (F.when(kept, verdict(True, col(old_title) if old_title is not None else text,
                                 col(old_summary) if old_summary is not None else text, no_groups))
            .when(p["coherent"] & p["title"].isNotNull(),
                  verdict(True, strip(p["title"]), strip(p["summary"]), no_groups))
            .when(~p["coherent"] & (F.size(groups) >= 2), verdict(False, text, text, groups))
            .when(strip(fallback) != "", verdict(True, strip(fallback), strip(p["summary"]), no_groups)))


def analysis_input(title, lead, body, body_chars: int = 2000) -> Column:
    def part(label, v):
        return F.concat(F.lit(f"{label}: "), v)
    return F.concat_ws("\n\n", part("Cím", col(title)), part("Lead", non_empty(lead)),
                       part("Szöveg", F.substring(non_empty(body), 1, body_chars)))


# ---- resource strings -----------------------------------------------------------

def cpu_cores(c) -> Column:
    t = strip(c)
    milli = t.endswith("m")
    return F.coalesce(F.when(milli, F.regexp_replace(t, "m$", "").try_cast("double") / 1000)
                      .otherwise(t.try_cast("double")), F.lit(0.0))


def mem_gib(c) -> Column:
    t = F.lower(strip(c))
    n = F.regexp_extract(t, r"^([0-9.]+)", 1).try_cast("double")
    unit = F.regexp_extract(t, r"([a-z]*)$", 1)
    return F.coalesce(
        F.when(unit.isin("g", "gi"), n).when(unit.isin("m", "mi"), n / 1024)
        .when(unit.isin("k", "ki"), n / 1048576).otherwise(n / 1073741824), F.lit(0.0))


def secs(c) -> Column:
    return F.coalesce(F.regexp_replace(strip(c), "s+$", "").try_cast("double"), F.lit(0.0))


# ---- log lines ------------------------------------------------------------------

def clean_log(c) -> Column:
    return strip(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"\x1b\[[0-9;]*m", ""))


def log_message(clean) -> Column:
    """The message of a ``[time] LEVEL: msg`` line, or null."""
    return non_empty(F.regexp_extract(clean, r"^\[[0-9:]+\]\s+\w+:\s+(.+)$", 1))


def log_field(clean) -> Column:
    """Struct (key, value) of a ``key: value`` line that is not a message line, or null."""
    key = F.regexp_extract(clean, r"^\s*([A-Za-z0-9_]+):\s*(.*)$", 1)
    raw = F.regexp_replace(strip(F.regexp_extract(clean, r"^\s*([A-Za-z0-9_]+):\s*(.*)$", 2)), ",+$", "")
    return F.when(log_message(clean).isNull() & (key != ""),
                  F.struct(key.alias("key"), F.regexp_replace(raw, '^"(.*)"$', "$1").alias("value")))


def value_kind(v) -> Column:
    v = col(v)
    return (F.when(v.isin("true", "false"), "bool").when(v.try_cast("bigint").isNotNull(), "int")
            .when(v.try_cast("double").isNotNull(), "float").otherwise("text"))


def is_finished(msg) -> Column:
    m = F.lower(col(msg))
    return m.contains("finished") | m.contains("complete")


def json_duration_ms(c) -> Column:
    """``durationMs`` of a structured line whose message says the work finished."""
    c = col(c)
    msg = F.coalesce(non_empty(F.get_json_object(c, "$.msg")), F.get_json_object(c, "$.message"))
    return F.when(is_finished(msg), F.get_json_object(c, "$.durationMs").try_cast("double"))


# ---- usage tags, ids ------------------------------------------------------------

def activity(trigger, stage, operation) -> Column:
    return F.concat_ws("_", col(trigger), col(stage), col(operation))


def usage_mode(c) -> Column:
    c = col(c)
    return F.when(c.isin(vocab.USAGE_MODES), c).otherwise(vocab.DEFAULT_USAGE_MODE)


def historic_usage_mode(mode, provider) -> Column:
    return F.coalesce(col(mode), F.when(col(provider) == "gemini", "gemini-fallback")
                      .otherwise(vocab.DEFAULT_USAGE_MODE))


def total_tokens(prompt, completion) -> Column:
    return col(prompt) + col(completion)


def positive_id(c) -> Column:
    n = strip(c).try_cast("double")
    return F.when((n > 0) & (n == F.floor(n)), n.cast("bigint"))


def bounded_int(c, default: int, low: int, high: int) -> Column:
    n = F.regexp_extract(col(c), r"^\s*([+-]?\d+)", 1).try_cast("bigint")
    return F.when(n.isNull(), F.lit(default)).otherwise(F.least(F.greatest(n, F.lit(low)), F.lit(high)))
