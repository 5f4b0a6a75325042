"""Row-wise text features as native Column expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .. import vocab

# Whitespace as browsers define it; the class is valid in Java regex and in RE2.
WS = (r"[\t\n\x0b\f\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}"
      r"\x{3000}\x{feff}]")
# word borders that only know ASCII word characters, as the rules were written for
WORD_START = r"(?<![A-Za-z0-9_])"
WORD_END = r"(?![A-Za-z0-9_])"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    return F.regexp_replace(col(c), f"^{WS}+|{WS}+$", "")


def squash(c) -> Column:
    """Collapse whitespace runs to one space and trim.

    A lone plain space, by far the most common run, is not matched and so costs no replacement."""
    return F.trim(F.regexp_replace(col(c), f"{WS.replace(' ', '', 1)}{WS}*| {WS}+", " "))


def non_empty(c) -> Column:
    """The value, or null when it is null or ''."""
    c = col(c)
    return F.when(c != "", c)


def fingerprint(c) -> Column:
    return F.sha2(squash(F.lower(col(c))), 256)


def content_fingerprint(body, title) -> Column:
    """Fingerprint of the body; the title stands in only for a missing (not empty) body."""
    return fingerprint(F.coalesce(col(body), col(title)))


# ---- accent folding -----------------------------------------------------------

@lru_cache(maxsize=2)
def _fold_table(form: str) -> tuple[str, str]:
    """Characters that normalise to exactly one base character once marks are dropped."""
    src, dst = [], []
    for cp in range(0x00A0, 0x10000):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        ch = chr(cp)
        out = "".join(x for x in unicodedata.normalize(form, ch)
                      if not unicodedata.category(x).startswith("M"))
        if out != ch and len(out) == 1:
            src.append(ch)
            dst.append(out)
    return "".join(src), "".join(dst)


def fold(c, form: str = "NFKD") -> Column:
    """Lower-case and drop diacritics inside the JVM.

    One-to-one mappings use ``translate``; characters that expand to several
    (ligatures, Hangul) are left alone - :func:`fold_exact` covers those.
    """
    src, dst = _fold_table(form)
    low = F.lower(col(c))
    plain = F.length(low) == F.octet_length(low)
    return F.when(plain, low).otherwise(F.regexp_replace(F.translate(low, src, dst), r"\p{M}", ""))


@F.pandas_udf(StringType())
def fold_exact(s: pd.Series) -> pd.Series:
    def one(x):
        if x is None:
            return None
        return "".join(ch for ch in unicodedata.normalize("NFKD", x.lower())
                       if not unicodedata.category(ch).startswith("M"))
    return s.map(one)


def _words(c, exact: bool) -> Column:
    folded = fold_exact(col(c)) if exact else fold(c)
    return F.regexp_replace(folded, r"[^\p{L}\p{N}" + WS[1:-1] + "]", " ")


def significant_tokens(c, min_len: int = 4, exact: bool = False) -> Column:
    """Distinct folded words of at least ``min_len`` characters (empty array for null)."""
    parts = F.split(_words(F.coalesce(col(c), F.lit("")), exact), f"{WS}+")
    return F.array_distinct(F.filter(parts, lambda t: F.length(t) >= min_len))


def norm_entity(c, exact: bool = False) -> Column:
    return squash(_words(c, exact))


def norm_entities(c) -> Column:
    """Lower-cased, trimmed, non-empty, distinct entity list (empty array for null)."""
    cleaned = F.transform(F.coalesce(col(c), F.array().cast("array<string>")),
                          lambda x: strip(F.lower(x)))
    return F.array_distinct(F.filter(cleaned, lambda x: x != ""))


# ---- set similarity -------------------------------------------------------------

def shared_count(a, b) -> Column:
    return F.size(F.array_intersect(col(a), col(b)))


def jaccard(a, b) -> Column:
    a, b = col(a), col(b)
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
        shared_count(a, b) / union)


def overlap_coef(a, b) -> Column:
    a, b = col(a), col(b)
    smaller = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(smaller == 0, F.lit(0.0)).otherwise(shared_count(a, b) / smaller)


# ---- rule text, event role ------------------------------------------------------

def norm_rule_text(c) -> Column:
    """Accent-free, space-collapsed form the low-value rules are written in."""
    plain = F.regexp_replace(fold(F.coalesce(col(c), F.lit("")), "NFD"), r"[\^`¨¯´·¸]", "")
    return squash(plain)


def has_word(c, alternatives: str) -> Column:
    return col(c).rlike(f"{WORD_START}(?:{alternatives}){WORD_END}")


def event_role(title, story_identity, main_event, article_type) -> Column:
    text = F.concat_ws("\n", F.coalesce(col(title), F.lit("")),
                       F.coalesce(col(story_identity), F.lit("")),
                       F.coalesce(col(main_event), F.lit("")))

    def any_stem(stems):
        return text.rlike("(?iu)" + WORD_START + "(?:" + "|".join(stems) + ")")

    kind = F.coalesce(col(article_type), F.lit(""))
    return (F.when(kind == "aggregation", "aggregation")
            .when(kind == "opinion", "analysis")
            .when(kind == "background", "background")
            .when(any_stem(vocab.REACTION_STEMS), "reaction")
            .when(any_stem(vocab.ANNOUNCEMENT_STEMS), "announcement")
            .otherwise("event"))


def cluster_text(title, story_identity, main_event, article_type, location, entities, topics,
                 role=None, limit: int = 1800) -> Column:
    """Labelled lines that describe one article to the cluster embedder."""
    role = event_role(title, story_identity, main_event, article_type) if role is None else col(role)
    event, ident = non_empty(strip(main_event)), non_empty(strip(story_identity))

    def line(label, value):
        return F.concat(F.lit(f"{label}: "), value)

    def listed(c, n):
        c = col(c)
        return F.when(F.size(c) > 0, F.array_join(F.slice(c, 1, n), "; "))

    return F.substring(F.concat_ws(
        "\n",
        line("STORY_IDENTITY", F.coalesce(ident, event, strip(title))),
        line("EVENT_ROLE", role),
        line("MAIN_EVENT", event),
        line("ARTICLE_TYPE", non_empty(strip(article_type))),
        line("LOCATION", non_empty(strip(location))),
        line("ENTITIES", listed(entities, 8)),
        line("TOPICS", listed(topics, 3)),
        line("TITLE", strip(title)),
    ), 1, limit)


# ---- embedding text (repair / backfill variant) -----------------------------------

def clean_title(c) -> Column:
    return F.regexp_replace(strip(c), f"^(?:{vocab.TITLE_PREFIXES}){WS}*:{WS}*", "")


def clean_body(c) -> Column:
    out = strip(c)
    for pattern in vocab.BOILERPLATE:
        out = F.regexp_replace(out, pattern, "")
    return strip(out)


def embedding_text(title, body, published_at, summary, lead, main_event, story_identity,
                   article_type, entities, body_chars: int = 400, min_chars: int = 150) -> Column:
    ident, event = non_empty(story_identity), non_empty(main_event)
    summary, lead, body = col(summary), col(lead), non_empty(body)
    cleaned = clean_body(body)
    people = F.when(F.size(col(entities)) > 0,
                    F.concat(F.lit("Szereplők: "), F.array_join(col(entities), ", ")))
    lead_room = F.greatest(F.lit(body_chars) - F.length(lead), F.lit(0))
    content = (F.when(F.length(summary) >= min_chars, summary)
               .when(F.length(lead) >= min_chars,
                     F.concat(lead, F.coalesce(F.concat(F.lit(" "), cleaned.substr(F.lit(1), lead_room)),
                                               F.lit(""))))
               .when(F.length(cleaned) >= min_chars, F.substring(cleaned, 1, body_chars)))
    return F.concat_ws(
        " | ",
        F.when(col(article_type) == "aggregation", F.lit("[ÖSSZEFOGLALÓ]")),
        ident,
        F.when(event.eqNullSafe(ident), None).otherwise(event),
        clean_title(title),
        F.concat(F.lit("["), F.date_format(col(published_at), "yyyy-MM-dd"), F.lit("]")),
        people, content, ident)


# ---- predicates, redaction ----------------------------------------------------------

def is_broken(c) -> Column:
    t = strip(c)
    return t.isNull() | (t == "") | F.lower(t).isin(vocab.BROKEN_TEXT)


def redact(c, secrets: dict[str, str] | None = None) -> Column:
    out = col(c)
    for name, value in (secrets or {}).items():
        if value:
            out = F.replace(out, F.lit(value), F.lit(f"<redacted:{name}>"))
    out = F.regexp_replace(out, r"postgresql://[^@\s]+@", "postgresql://<redacted>@")
    return F.regexp_replace(out, r"Bearer\s+[A-Za-z0-9._~+/=-]+", "Bearer <redacted>")
