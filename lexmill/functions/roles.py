"""Document roles and evidence points of a corpus build. Texts are folded by `text.fold_ascii`; hits and persons are counts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Titles and marks of roles, concepts whose names collide with other words, concepts that have empirical neighbours.
PARATEXT_TITLES = (
    "publisher's announcement", "publishers announcement", "publisher announcement", "editorial board", "preface", "preface and acknowledgements", "preface and acknowledgement", "acknowledgements", "acknowledgments", "table of contents",
    "contents", "front matter", "notes on contributors", "errata", "erratum", "corrigendum", "correction", "retraction",
)
REVIEW = ("book review", "review of ", "buchbesprechungen", "book reviews")
SPAM, LOW_QUALITY = "click here to download", ("click here to download", "downloads:", "rating:")
METHOD = (
    "phenomenological study", "phenomenological method", "phenomenological methodology", "phenomenological research", "phenomenology research pattern", "interpretative phenomenological analysis", "qualitative phenomenological",
    "transcendental phenomenological methodology", "method of qualitative research", "qualitative research method", "phenomenology as a research method", "phenomenology as research method",
)
EMPIRICAL = ("participants", "participant", "interviews", "interview", "survey", "sample", "study group", "qualitative research", "content analysis", "focus group", "patients", "patient", "students", "student", "teachers", "teacher")
CLINICAL = ("patient", "patients", "clinical", "psychotherapy", "therapy", "therapies", "psychiatric", "psychiatry", "psychological", "psychology", "anxiety", "ptsd", "palliative", "well-being", "mental health")
MEDICAL = ("participants", "patients", "patient", "clinical", "qualitative study", "qualitative research", "interview", "survey", "obstetric", "dental", "oral health", "pregnancy")
PHENOMENOLOGY, EXISTENTIALISM, MEDICINE = "Phenomenology (philosophy)", "Existentialism", "Philosophy of medicine"
COLLIDING = (PHENOMENOLOGY, EXISTENTIALISM)


def marks(text: Column, phrases: Sequence[str]) -> Column:
    """How many of the phrases a text holds."""
    return F.size(F.filter(F.array(*map(F.lit, phrases)), lambda p: text.contains(p)))


def role(title: Column, abstract: Column, concept: Column, persons: Column, title_hits: Column, abstract_hits: Column, explicit: Column, paratext: Column) -> Column:
    """LOW_QUALITY, REVIEW, PARATEXT, EMPIRICAL_ADJACENT or SCHOLARLY, the first that holds."""
    full = F.trim(F.concat_ws(" ", title, abstract))
    alone = (persons == 0) & ~explicit & (title_hits + abstract_hits <= 1)
    phenomenological = (concept == PHENOMENOLOGY) & (marks(full, METHOD) >= 1) & (marks(full, EMPIRICAL) >= 1)
    clinical = (concept == EXISTENTIALISM) & (marks(full, CLINICAL) >= 2) | (concept == MEDICINE) & (marks(full, MEDICAL) >= 2)
    return (
        F.when(full.contains(SPAM) | (marks(full, LOW_QUALITY) >= 2), "LOW_QUALITY").when(marks(title, REVIEW) >= 1, "REVIEW").when(title.isin(*PARATEXT_TITLES) | paratext & (abstract == ""), "PARATEXT")
        .when(F.coalesce(phenomenological | clinical, F.lit(False)) & alone, "EMPIRICAL_ADJACENT").otherwise("SCHOLARLY")
    )


def evidence(prior: Column, concept_collides: Column, concept_score: Column, concepts: Column, corroboration: Column, keyword: Column, title_persons: Column, abstract_persons: Column, explicit: Column, title_hits: Column, abstract_hits: Column) -> Column:
    """Struct (score, reasons): points that add up, with their reasons in the order in which they are given.

    prior: whether the earlier classifier said PROBABLE; corroboration and keyword are scores, null for none.
    """
    other, named = F.coalesce(corroboration, F.lit(0.0)), F.coalesce(keyword, F.lit(0.0))
    steps = [
        (prior, 1, "v2-probable"), (other >= 0.50, 3, "nondup>=.50"), ((other < 0.50) & (other >= 0.25), 2, "nondup>=.25"), (concepts >= 2, 1, "multi-concept"), (~concept_collides & (concept_score >= 0.65), 1, "strong-anchor"),
        (named >= 0.50, 2, "ontology-keyword>=.50"), ((named < 0.50) & (named >= 0.30), 1, "ontology-keyword>=.30"), (title_persons >= 1, 3, "philosopher-in-title"), (title_persons >= 2, 1, "multiple-title-philosophers"),
        ((title_persons == 0) & (abstract_persons >= 1), 1, "philosopher-in-abstract"), (explicit, 1, "explicit-philosophy-text"), (title_hits >= 1, 2, "strong-title-term"), (title_hits >= 2, 1, "multiple-title-terms"),
        (abstract_hits >= 1, 1, "strong-abstract-term"), (abstract_hits >= 3, 1, "multiple-abstract-terms"),
    ]
    score = reduce(Column.__add__, [F.when(holds, points).otherwise(0) for holds, points, _ in steps])
    return F.struct(score.alias("score"), F.array_compact(F.array(*[F.when(holds, reason) for holds, _, reason in steps])).alias("reasons"))
