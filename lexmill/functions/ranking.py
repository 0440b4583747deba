"""The ranking profile: how well a work answers an understood query. Scores lie between 0 and 1 unless they say otherwise."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions.scoring import clamp
from lexmill.functions.text import once

# Weights of the parts of the total.
WEIGHTS = {"q": 0.28, "p": 0.30, "d": 0.20, "s": 0.10, "b": 0.08, "i": 0.04}


@dataclass(frozen=True)
class Understood:
    """A query as understood, all folded: its text, expansions with weights, persons' aliases, concepts' names, works,
    related works with whether they share a concept, areas with confidence, and terms of areas and domains."""

    original: str
    expansions: Sequence[tuple[str, float]] = ()
    persons: Sequence[Sequence[str]] = ()
    concepts: Sequence[Sequence[str]] = ()
    works: Sequence[str] = ()
    related: Sequence[tuple[Sequence[str], bool]] = ()
    areas: Sequence[tuple[Sequence[str], float]] = ()
    area_terms: Sequence[Sequence[str]] = ()
    domain_terms: Sequence[Sequence[str]] = field(default_factory=tuple)


def _sum(parts: Sequence[Column]) -> Column:
    return reduce(Column.__add__, parts, F.lit(0.0))


def _any(x: Column, phrases: Sequence[str]) -> Column:
    return reduce(Column.__or__, [x.contains(p) for p in phrases], F.lit(False))


def covered(words: str, tokens: Column) -> Column:
    """Share of the words that are among the tokens."""
    wanted = sorted(set(words.split()))
    return F.size(F.array_intersect(F.array(*map(F.lit, wanted)), tokens)) / F.lit(float(len(wanted))) if wanted else F.lit(0.0)


def query_match(title: Column, tokens: Column, q: Understood) -> Column:
    """title: folded; tokens: its distinct words."""
    zero = F.struct(F.lit(0.0).alias("score"), F.lit(0.0).alias("weight"))
    found = [F.struct((covered(x, tokens) * w).alias("score"), F.lit(w).alias("weight")) for x, w in q.expansions]
    best = F.reduce(F.array(*found), zero, lambda a, x: F.when(x["score"] > a["score"], x).otherwise(a)) if found else zero
    person = F.when(reduce(Column.__or__, [_any(title, a) for a in q.persons], F.lit(False)), 0.20).otherwise(0.0)
    cover = [F.greatest(F.lit(0.0), *[covered(v, tokens) for v in names]) for names in q.concepts]
    concepts = _sum([F.when(c >= 0.60, c * 0.10).otherwise(0.0) for c in cover])
    return clamp(covered(q.original, tokens) * 0.20 + best["score"] * 0.45 + person + concepts + best["weight"] * 0.10)


def domain_match(title: Column, tokens: Column, topic: Column, q: Understood) -> Column:
    score = [F.when(_any(title, a), 0.30).otherwise(0.0) for a in q.persons]
    for names in q.concepts:
        cover = F.when(_any(title, names), 1.0).otherwise(F.greatest(F.lit(0.0), *[covered(v, tokens) for v in names]))
        score.append(F.when(cover >= 0.60, cover * 0.25).otherwise(0.0))
    score += [F.when(title.contains(w), 0.50).otherwise(0.0) for w in q.works]
    score += [F.when(_any(title, titles), 0.50 if shares else 0.35).otherwise(0.0) for titles, shares in q.related]
    for names, confidence in q.areas:
        if confidence >= 0.40:
            near = reduce(Column.__or__, [topic.contains(n) | F.lit(n).contains(topic) for n in names])
            score.append(F.when(near, 0.08 * confidence).otherwise(0.0))
    return clamp(_sum(score))


def discipline(topics: Column, journal: Column, person: Column, concepts: Column, areas: Column, outside_topics: Column, outside_journal: Column) -> Column:
    """Evidence for the discipline less what speaks for another; strong evidence softens the latter."""
    positive = topics + journal + person + concepts + areas
    factor = F.when((topics >= 0.55) | (journal >= 0.35), 0.30).when(positive >= 0.35, 0.65).otherwise(1.00)
    return clamp(F.lit(0.15) + positive - clamp(outside_topics + outside_journal) * factor)


def source_adjustment(coverage: Column, providers: Column, plus_five: str, plus_three: str, minus_two: str) -> Column:
    """Points: four for full coverage of the query by the title, and priors of three providers."""
    has = lambda p: F.array_contains(providers, p)
    return coverage * 4 + F.when(has(plus_five), 5).otherwise(0) + F.when(has(plus_three), 3).otherwise(0) - F.when(has(minus_two) & (coverage < 0.50), 2).otherwise(0)


def conjunction(text: Column, has_abstract: Column, q: Understood) -> Column:
    """Struct (bucket, points) for queries that name areas and domains."""
    if not q.area_terms or not q.domain_terms:
        return F.struct(F.lit("not-applicable").alias("bucket"), F.lit(0).alias("points"))
    all_of = lambda groups: reduce(Column.__and__, [_any(text, g) for g in groups])
    area, domain = all_of(q.area_terms), all_of(q.domain_terms)
    is_ = lambda bucket, points: F.struct(F.lit(bucket).alias("bucket"), F.lit(points).alias("points"))
    return F.when(area & domain, is_("both", 2)).when(area, is_("area-only", -2)).when(domain, is_("domain-only", 0)).when(has_abstract, is_("neither", -1)).otherwise(is_("neither", 0))


def author_tier(author_tokens: Column, query: str) -> Column:
    """3: the query's words are the author's, 2: among them, 0: not all."""
    words = F.array(*[F.lit(w) for w in sorted(set(query.split()))])
    inside = F.size(F.array_except(words, author_tokens)) == 0
    return F.when(inside & (F.size(author_tokens) == F.size(words)), 3).when(inside, 2).otherwise(0)


def with_author_floor(score: Column, tier: Column) -> Column:
    return F.greatest(score, F.when(tier == 3, 95).when(tier > 0, 90).otherwise(0))


def prefix_match(token: str, tokens: Column) -> Column:
    """The word itself, or with four letters and more a word that starts with it."""
    return F.array_contains(tokens, token) | (F.exists(tokens, lambda t: t.startswith(token)) if len(token) >= 4 else F.lit(False))


def local_score(query: str, doi: Column, title: Column, fields: dict[str, tuple[Column, int]], phrases: dict[str, int]) -> Column:
    """Points of a work in a local corpus. title and query: folded; fields: distinct words and points of each matched word,
    `title` among them; phrases: points of fields that hold the whole query (title: unless it equals the query)."""
    yes = lambda cond, n: F.when(cond, F.lit(float(n))).otherwise(0.0)
    words = list(dict.fromkeys(query.split()))

    def total(found: Column) -> Column:
        hits = [{name: found[f"{name}_{i}"] for name in fields} for i in range(len(words))]
        whole = lambda name: reduce(Column.__and__, [h[name] for h in hits])
        score = yes(F.coalesce(doi == query, F.lit(False)), 120) + F.when(title == query, 90.0).when(whole("title"), float(phrases["title"])).otherwise(0.0)
        score += _sum([yes(whole(name), n) for name, n in phrases.items() if name != "title"])
        score += _sum([yes(hit, fields[name][1]) for h in hits for name, hit in h.items()])
        matched = _sum([yes(reduce(Column.__or__, h.values()), 1) for h in hits])
        return F.round(score + matched / float(len(words)) * 22 + yes(whole("title"), 22), 3)

    # every word is looked up in every field once
    return once(F.struct(*[prefix_match(w, tokens).alias(f"{name}_{i}") for i, w in enumerate(words) for name, (tokens, _) in fields.items()]), total)


def softmax(logits: dict[str, Column]) -> Column:
    """Map of each label to its share."""
    top = F.greatest(*logits.values())
    parts = {k: F.exp(v - top) for k, v in logits.items()}
    total = _sum(list(parts.values()))
    return F.create_map(*[x for k, v in parts.items() for x in (F.lit(k), v / total)])


# Points of a query word by field, marks of secondary literature, words that ask for nothing, most words.
ARCHIVE_POINTS = {"title": 6, "authors": 5, "subjects": 3, "description": 1}
SECONDARY = """
introduction interpretation commentary companion essays reflections guide note notes study studies
introduccion interpretacion comentario comentarios ensayos reflexiones guia estudio estudios
""".split()
ARCHIVE_STOPWORDS = "a an and the of in on for to with de del la las el los en y por para un una sobre".split()
ARCHIVE_WORDS = 12


def archive_words(query: Column) -> Column:
    """The first distinct words of a folded query that ask for something."""
    return F.slice(F.array_distinct(F.filter(F.split(query, " "), lambda t: (F.length(t) > 1) & ~t.isin(*ARCHIVE_STOPWORDS))), 1, ARCHIVE_WORDS)


def archive_score(query: Column, title: Column, authors: Column, subjects: Column, description: Column) -> Column:
    """How well an archive's item answers a query before any ranking, in points; all texts are folded.

    Points per word and field it stands in, 12 for the share of words found, 15 if title, authors and subjects hold all,
    3 for each of several words in the title, 16 and 3 for each word in the authors, 20 for the share of the title that
    was asked for, less 12, at most twice, for each mark of secondary literature that was not.
    """
    words = archive_words(query)
    fields = {"title": title, "authors": authors, "subjects": subjects, "description": description}
    bibliography = F.concat_ws(" ", title, authors, subjects)
    length = F.size(F.filter(F.split(title, " "), lambda t: t != ""))
    penalty = F.size(F.filter(F.array(*map(F.lit, SECONDARY)), lambda m: title.contains(m) & ~query.contains(m))) * 12

    def total(found: Column) -> Column:
        hits = lambda *names: F.size(F.filter(found["words"], lambda w: reduce(Column.__or__, [w[n] for n in names])))
        asked = F.size(found["words"])
        points = _sum([hits(n) * F.lit(float(p)) for n, p in ARCHIVE_POINTS.items()])
        in_title, in_authors, length = hits("title"), hits("authors"), found["length"]
        points = (
            points + hits(*fields) / asked * 12 + F.when(F.forall(found["words"], lambda w: w["whole"]), 15).otherwise(0) + F.when(in_title >= 2, in_title * 3).otherwise(0)
            + F.when(in_authors > 0, 16 + in_authors * 3).otherwise(0) + F.when((length > 0) & (in_title > 0), in_title / length * 20).otherwise(0) - F.least(found["penalty"], F.lit(24))
        )
        return F.when(asked == 0, F.lit(0.0)).otherwise(F.round(F.greatest(F.lit(0.0), points), 3))

    # every word meets every text once; the points are counted from what it found
    where = lambda whole: F.transform(words, lambda w: F.struct(*[x.contains(w).alias(n) for n, x in fields.items()], whole.contains(w).alias("whole")))
    return once(F.struct(once(bibliography, where).alias("words"), length.alias("length"), penalty.alias("penalty")), total)
