"""Tiers of works as CASE chains over their signals: columns named as in the arguments, scores between 0 and 1 or null."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tiers and reasons of each version, in the order in which arms are tried, with their thresholds.
HARD_DOMAINS = ("physics", "chemistry", "materials-science", "mathematics")
NOT_THESES = ("book chapter", "capitulo de libro", "articulo", "article", "libro", "book", "ponencia", "conference", "manual")


def _first(arms: Sequence[tuple[Column, str, str]], tier: str, reason: str) -> Column:
    """Struct (tier, reason) of the first arm that holds."""
    answer = lambda t, r: F.struct(F.lit(t).alias("tier"), F.lit(r).alias("reason"))
    out = None
    for holds, t, r in arms:
        out = (F if out is None else out).when(holds, answer(t, r))
    return out.otherwise(answer(tier, reason))


def tier_v1(is_phenomenology: Column, hard_noise: Column, family: Column, concept: Column, n_concepts: Column) -> Column:
    score = F.coalesce(family, F.lit(0.0))
    arms = [
        (is_phenomenology & (F.coalesce(hard_noise, F.lit(0.0)) >= 0.55) & (score < 0.20), "EXCLUDE", "phenomenology-hard-science-noise"),
        (score >= 0.50, "CORE", "strong-philosophy-keyword"),
        ((score >= 0.30) & (n_concepts >= 2), "CORE", "keyword-plus-multiple-concepts"),
        ((score >= 0.30) & (concept >= 0.50), "CORE", "keyword-plus-concept-score"),
        (score >= 0.30, "PROBABLE", "moderate-philosophy-keyword"),
        ((n_concepts >= 2) & (concept >= 0.40), "PROBABLE", "multiple-philosophy-concepts"),
    ]
    return _first(arms, "BORDERLINE", "insufficient-corroboration")


def tier_v2(is_phenomenology: Column, is_ambiguous: Column, hard_noise: Column, own: Column, keyword: Column, secondary: Column, concept: Column, n_concepts: Column) -> Column:
    """own: the score of keywords that do not repeat the concept's own name."""
    zero = F.lit(0.0)
    arms = [
        (is_phenomenology & (F.coalesce(hard_noise, zero) >= 0.55) & (own < 0.20), "EXCLUDE", "phenomenology-hard-science-noise"),
        ((own >= 0.50) & (concept >= 0.40), "CORE", "strong-nonduplicate-corroboration"),
        ((F.coalesce(keyword, zero) >= 0.35) & (F.coalesce(secondary, zero) >= 0.35), "CORE", "generic-plus-secondary-philosophy"),
        ((own >= 0.45) & (n_concepts >= 2), "CORE", "corroboration-plus-multiple-concepts"),
        (own >= 0.25, "PROBABLE", "moderate-nonduplicate-corroboration"),
        ((n_concepts >= 2) & (concept >= 0.45), "PROBABLE", "multiple-philosophy-concepts"),
        (~is_ambiguous & (concept >= 0.65), "PROBABLE", "strong-anchor-only"),
    ]
    return _first(arms, "BORDERLINE", "insufficient-corroboration")


def tier_v3_1(v2: Column, role: Column, evidence: Column, is_phenomenology: Column, is_ambiguous: Column, own: Column, hard_noise: Column, top_domain: Column, top_domain_score: Column, has_text_hits: Column) -> Column:
    """Tier by the second version's tier, the document's role and the points of evidence."""
    hard = (F.coalesce(hard_noise, F.lit(0.0)) >= 0.35) | (F.coalesce(top_domain, F.lit("")).isin(*HARD_DOMAINS) & (F.coalesce(top_domain_score, F.lit(0.0)) >= 0.45))
    strong = evidence >= 6
    arms = [
        (v2 == "EXCLUDE", "EXCLUDE", "carry-v2-high-confidence-exclude"),
        (is_phenomenology & (own < 0.20) & ~has_text_hits & hard, "EXCLUDE", "phenomenology-hard-science-v3-1"),
        (role == "LOW_QUALITY", "BORDERLINE", "low-quality-document"),
        ((role == "PARATEXT") & strong, "PROBABLE", "paratext-with-strong-philosophy"),
        (role == "PARATEXT", "BORDERLINE", "paratext"),
        ((role == "EMPIRICAL_ADJACENT") & strong, "PROBABLE", "empirical-adjacent-with-strong-philosophy"),
        (role == "EMPIRICAL_ADJACENT", "BORDERLINE", "empirical-adjacent"),
        ((v2 == "CORE") & ~is_ambiguous, "CORE", "carry-v2-core-nonambiguous"),
        (strong, "CORE", "context-evidence>=6"),
        (evidence >= 3, "PROBABLE", "context-evidence>=3"),
    ]
    return _first(arms, "BORDERLINE", "context-evidence<3")


def searchable(tier: Column, role: Column) -> Column:
    """What the search index takes."""
    return tier.isin("CORE", "PROBABLE") & ~role.isin("LOW_QUALITY", "PARATEXT")


def source_type(folded: Column) -> Column:
    """thesis, non-thesis or unknown by a folded type name."""
    starts = folded.startswith(NOT_THESES[0])
    for prefix in NOT_THESES[1:]:
        starts |= folded.startswith(prefix)
    return F.when(folded.contains("tesis") | folded.contains("thesis"), "thesis").when(starts, "non-thesis").otherwise("unknown")
