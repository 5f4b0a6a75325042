"""Gates on a candidate pair: may these two belong to one story?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import (col, event_role, jaccard, non_empty, norm_entities, norm_entity, overlap_coef,
                              shared_count, significant_tokens, strip)

SOFT_ROLES = ("opinion", "background", "reaction", "analysis")


def pair_compatible(pairs: DataFrame, l: str = "l", r: str = "r") -> DataFrame:
    """Add ``compatible`` and ``reason`` to a frame of article struct pairs."""
    def features(s):
        f = F.col
        role = event_role(f(f"{s}.title"), f(f"{s}.story_identity"), f(f"{s}.main_event"), f(f"{s}.article_type"))
        place = F.when(non_empty(strip(f"{s}.location")).isNotNull(), norm_entity(f"{s}.location"))
        text = F.concat(F.coalesce(f(f"{s}.story_identity"), F.lit("")), F.lit(" "),
                        F.coalesce(f(f"{s}.main_event"), F.lit("")))
        ents = F.array_distinct(F.transform(F.coalesce(f(f"{s}.entities"), F.array().cast("array<string>")),
                                            lambda e: norm_entity(e)))
        return {f"_{s}_role": role, f"_{s}_place": place, f"_{s}_tok": significant_tokens(text), f"_{s}_ent": ents}

    t = pairs.withColumns({**features(l), **features(r)})
    t = t.withColumns({"_ov": overlap_coef(f"_{l}_tok", f"_{r}_tok"), "_sh": shared_count(f"_{l}_ent", f"_{r}_ent")})
    a, b = F.col(f"_{l}_role"), F.col(f"_{r}_role")
    reason = (F.when((a == "aggregation") | (b == "aggregation"), "aggregation")
              .when((a != b) & (a.isin("analysis", "background") | b.isin("analysis", "background")), "role mismatch")
              .when(F.col(f"_{l}_place") != F.col(f"_{r}_place"), "location mismatch")
              .when((F.col("_ov") < 0.22) & (F.col("_sh") == 0), "low identity overlap")
              .when((F.col("_sh") <= 1) & (F.col("_ov") < 0.34), "weak entity match")
              .otherwise("compatible"))
    return (t.withColumn("reason", reason).withColumn("compatible", F.col("reason") == "compatible")
            .select(*pairs.columns, "compatible", "reason"))


def assign_compatible(role, token_score, entity_score, shared) -> Column:
    role, tok, ent, sh = col(role), col(token_score), col(entity_score), col(shared)
    return (F.when(role == "reaction", (tok >= 0.18) & (ent >= 0.34) & (sh >= 2))
            .when(role.isin("analysis", "background"), tok >= 0.28).otherwise(True))


def rescue_allowed(role, sim, token_score, entity_score, shared) -> Column:
    role, sim, tok, ent, sh = col(role), col(sim), col(token_score), col(entity_score), col(shared)
    return (F.when(role.isin(*SOFT_ROLES), (sim >= 0.94) & (sh >= 1) & (tok >= 0.18))
            .when(sim >= 0.94, (sh >= 1) | (ent >= 0.15) | (tok >= 0.10))
            .when(sim >= 0.90, (sh >= 1) & ((ent >= 0.25) | (tok >= 0.20))).otherwise(False))


def needs_validation(members: DataFrame, group: str, part: str) -> DataFrame:
    """Merged groups that a judge should look at again."""
    soft = F.bool_or(F.col("role").isin("analysis", "background", "reaction"))
    parts = members.groupBy(group, part).agg(F.count(F.lit(1)).alias("n"), soft.alias("soft"))
    return parts.groupBy(group).agg(
        ((F.count(F.lit(1)) > 1) & (F.bool_or("soft") | (F.min("n") == 1))).alias("needs_validation"))


def terms(rows: DataFrame, text: str, entities: str, name: str) -> DataFrame:
    """Significant tokens of a text as ``name`` and entities in normal form as ``name`` with an ``e``.

    Taken once per row, before rows are copied to their pairs."""
    return rows.withColumns({name: significant_tokens(text), f"{name}e": norm_entities(entities)})


def pair_scores(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Token Jaccard, entity Jaccard and shared-entity count of candidate pairs with the :func:`terms` of both sides."""
    return pairs.withColumns({"token_score": jaccard(left, right), "entity_score": jaccard(f"{left}e", f"{right}e"),
                              "shared_entities": shared_count(f"{left}e", f"{right}e")}).drop(left, right, f"{left}e", f"{right}e")
