"""Scoring and labelling expressions used by the read queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab
from .text import col


def bias_group(c, unknown: str | None = "center") -> Column:
    """Five ratings to left / center / right; ``unknown`` names the group of anything else."""
    c = col(c)
    return (F.when(c.isin("left", "center-left"), "left")
            .when(c == "center", "center")
            .when(c.isin("right", "center-right"), "right")
            .otherwise(F.lit(unknown)))


def relevance(source_count, article_count, bias_groups) -> Column:
    diversity = (F.when(col(bias_groups) >= 3, 15.0).when(col(bias_groups) >= 2, 8.0).otherwise(0.0))
    return col(source_count) * 3.0 + col(article_count) * 1.0 + diversity


def topic_weight(c) -> Column:
    table = F.create_map(*[F.lit(x) for kv in vocab.TOPIC_WEIGHTS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, col(c)), F.lit(vocab.DEFAULT_TOPIC_WEIGHT))


def seconds_between(later, earlier) -> Column:
    """Exact seconds (with fraction) between two timestamps."""
    def micros(c):
        return F.unix_micros(col(c).cast("timestamp"))
    return (micros(later) - micros(earlier)) / F.lit(1e6)


def age_bucket(ts, now) -> Column:
    s = F.floor(seconds_between(now, ts))
    return (F.when(s < 60, "most recently")
            .when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit(" min ago")))
            .when(s < 86400, F.concat(F.floor(s / 3600).cast("string"), F.lit("h ago")))
            .when(s < 604800, F.concat(F.floor(s / 86400).cast("string"), F.lit("d ago")))
            .otherwise(F.date_format(col(ts), "yyyy-MM-dd")))


def is_fresh(ts, now) -> Column:
    return seconds_between(now, ts) < 3600


def widely_covered(source_count) -> Column:
    return col(source_count) >= 8


def lopsided(left, center, right) -> Column:
    left, center, right = col(left), col(center), col(right)
    both = (left > 0) & (right > 0)
    return (F.when(left + center + right < 4, None)
            .when(both & (right >= left * 3), "right")
            .when(both & (left >= right * 3), "left"))
