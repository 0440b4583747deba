"""Text functions as column expressions: folding, tokens, phrase tests, overlaps, titles, names, light HTML cleaning."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented letters and the letters they fold to, in order.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"

# Function words by which a language is voted for.
FUNCTION_WORDS = {
    "en": ("the", "of", "and", "to", "in", "that", "for", "with", "this", "from"),
    "fr": ("le", "les", "des", "du", "que", "qui", "pour", "dans", "avec", "sur"),
    "de": ("der", "die", "das", "und", "den", "dem", "mit", "ist", "auf", "von"),
    "es": ("el", "los", "las", "del", "que", "por", "para", "con", "su", "una"),
}


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x computed once however often f names it (an optimizer inlines what a projection names)."""
    return F.element_at(F.transform(F.array(x), f), 1)


def fold(x: Column) -> Column:
    """Lower case, without accents, everything but a-z and 0-9 as one space, trimmed."""
    return F.trim(F.regexp_replace(F.translate(F.lower(F.coalesce(x, F.lit(""))), ACCENTED, PLAIN), "[^a-z0-9]+", " "))


def _marked() -> dict[str, str]:
    """Letters of the Latin blocks that decompose into one letter and marks, with that letter."""
    out = {}
    for point in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        bare = "".join(c for c in unicodedata.normalize("NFD", chr(point)) if not unicodedata.combining(c))
        if len(bare) == 1 and bare != chr(point):
            out[chr(point)] = bare
    return out


_MARKED = _marked()


def strip_accents(x: Column) -> Column:
    """Without combining marks; letters of the Latin blocks without theirs."""
    return F.regexp_replace(F.translate(F.coalesce(x, F.lit("")), "".join(_MARKED), "".join(_MARKED.values())), r"\p{M}", "")


def _kept(x: Column, keep: str) -> Column:
    """Lower case without accents; runs of what is not kept as one space; trimmed."""
    return F.trim(F.regexp_replace(F.lower(strip_accents(x)), f"[^{keep}]+", " "))


def fold_search(x: Column) -> Column:
    """Letters and digits of any script, hyphens."""
    return F.trim(F.regexp_replace(_kept(x, r"\p{L}\p{N} -"), " +", " "))


def fold_corpus(x: Column) -> Column:
    """a-z, 0-9, hyphens."""
    return F.trim(F.regexp_replace(_kept(x, "a-z0-9 -"), " +", " "))


def fold_plain(x: Column) -> Column:
    """a-z and 0-9; hyphens part words."""
    return _kept(x, "a-z0-9")


def fold_ascii(x: Column) -> Column:
    """Tags out, everything beyond ASCII dropped, spaces collapsed; punctuation stays."""
    bare = F.regexp_replace(F.lower(strip_accents(x)), "<[^>]*>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"[^\x00-\x7F]", ""), r"[ \t\n\r]+", " "))


# Titles before and roles behind a person's name.
HONORIFICS = ("dr", "dra", "prof", "profa", "mtro", "mtra", "lic", "ing", "mr", "mrs", "ms", "sir")
ROLES = ("coord", "coordinador", "coordinadora", "comp", "compilador", "ed", "eds", "editor", "trad", "dir", "director")


def fold_name(x: Column) -> Column:
    """Letters and digits of any script, without leading honorifics."""
    return F.regexp_replace(_kept(x, r"\p{L}\p{N}"), f"^(?:(?:{'|'.join(HONORIFICS)}) )+", "")


def fold_ui(x: Column) -> Column:
    """Lower case without accents; punctuation stays."""
    return F.lower(strip_accents(x))


def person_key(x: Column) -> Column:
    """fold_name without roles at the end."""
    return F.regexp_replace(fold_name(x), f"(?: (?:{'|'.join(ROLES)}))+$", "")


def person_names(x: Column) -> Column:
    """Distinct names of a creator statement, in order: parted at semicolons, slashes, ampersands and conjunctions."""
    parts = F.split(F.coalesce(x, F.lit("")), r"\s*(?:;|/|&|\by\b|\band\b|\be\b)\s*")
    return F.array_distinct(F.filter(F.transform(parts, person_key), lambda n: n != ""))


def keywords(x: Column) -> Column:
    """Distinct keywords of a statement, in order: parted at semicolons, commas, bars and line ends; one letter is none."""
    parts = F.transform(F.split(F.coalesce(x, F.lit("")), r"[;,|\n]"), lambda k: F.trim(F.regexp_replace(k, r"^\s*[-.]+|[.\s]+$", "")))
    return F.array_distinct(F.filter(parts, lambda k: F.length(k) > 1))


def slug(x: Column) -> Column:
    return F.replace(fold(x), F.lit(" "), F.lit("-"))


def tokens(x: Column, shortest: int = 1) -> Column:
    """Folded tokens of at least `shortest` letters, in order."""
    return F.filter(F.split(fold(x), " "), lambda t: F.length(t) >= shortest)


# Words that say nothing about a work's subject, in full texts and in titles.
SUBJECT_STOPWORDS = """
the and for from with into about after before this that these those between through toward towards over under within without where when which while
sobre para por con del las los una uno unos unas que como entre desde hacia tras ante sin sus este esta estos estas donde cuando cual cuales pero porque
study studies analysis analyses approach approaches introduction review paper article estudio estudios analisis enfoque enfoques introduccion revision articulo
""".split()
LEXICAL_STOPWORDS = """
the and for from with into about after before this that these those between through toward towards
sobre para por con del las los una uno unos unas que como entre desde hacia tras ante sin sus
estudio study analysis analisis approach introduction introduccion perspective perspectiva
""".split()


def subject_tokens(x: Column, stopwords: Sequence[str]) -> Column:
    """Folded tokens of three letters or more that are neither numbers nor stop words, in order."""
    return F.filter(F.split(fold(x), " "), lambda t: (F.length(t) >= 3) & ~t.rlike("^[0-9]+$") & ~t.isin(*stopwords))


def token_set(x: Column, shortest: int = 1) -> Column:
    return F.array_sort(F.array_distinct(tokens(x, shortest)))


def title_of(text: Column) -> Column:
    """The first line."""
    return F.substring_index(F.coalesce(text, F.lit("")), "\n", 1)


def has_phrase(folded: Column, phrase: Column) -> Column:
    """Whether folded text holds a folded phrase as whole words."""
    return F.concat(F.lit(" "), folded, F.lit(" ")).contains(F.concat(F.lit(" "), phrase, F.lit(" ")))


def overlap(a: Column, b: Column) -> Column:
    """Share of a's tokens that b has."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def containment(a: Column, b: Column) -> Column:
    """Shared tokens over the smaller set."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


# Words that name a volume before its number, and the numerals that count as one.
VOLUME_WORDS = ("tomo", "volumen", "volume", "vol", "parte", "part", "book", "libro", "band")
NUMERAL = "[0-9]+|[ivxlcdm]+"


def volume_markers(x: Column) -> Column:
    """Volume numbers that a title names behind a volume word, or in brackets if roman; lower case, sorted, distinct."""
    named = F.regexp_extract_all(fold(x), F.lit(rf"\b(?:{'|'.join(VOLUME_WORDS)}) ({NUMERAL})\b"), 1)
    bracketed = F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit(r"\(([ivxlcdm]+)\)"), 1)
    return F.array_sort(F.array_distinct(F.concat(named, bracketed)))


def title_similarity(a: Column, b: Column) -> Column:
    """1 for equal folds, 0 for other volumes or under three tokens, .97 if one holds the other with four shared, else
    .7 of the Jaccard similarity and .3 of the containment."""
    x, y = token_set(a), token_set(b)
    vx, vy = volume_markers(a), volume_markers(b)
    other = (F.size(vx) > 0) & (F.size(vy) > 0) & ~F.arrays_overlap(vx, vy)
    short = F.least(F.size(x), F.size(y)) < 3
    inside = (containment(x, y) == 1.0) & (F.size(F.array_intersect(x, y)) >= 4)
    return F.when(fold(a) == fold(b), 1.0).when(other | short, 0.0).when(inside, 0.97).otherwise(0.7 * jaccard(x, y) + 0.3 * containment(x, y))


def language_votes(x: Column) -> Column:
    """Struct of votes per language: distinct function words present."""
    vote = lambda words, fw: F.size(F.array_intersect(words, F.array(*map(F.lit, fw))))
    return once(F.array_distinct(tokens(x)), lambda words: F.struct(*[vote(words, fw).alias(lang) for lang, fw in FUNCTION_WORDS.items()]))


def voted_language(votes: Column) -> Column:
    """The language with most votes; null without votes or for a tie."""
    langs = list(FUNCTION_WORDS)

    def leader(v: Column) -> Column:
        top = F.greatest(*[v[x] for x in langs])
        leaders = sum(((v[x] == top).cast("int") for x in langs), F.lit(0))
        best = F.coalesce(*[F.when(v[x] == top, F.lit(x)) for x in langs])
        return F.when((top > 0) & (leaders == 1), best)

    return once(votes, leader)


# Letters by which a language shows, and the weight of such a letter against a function word.
TELLING_LETTERS = {"de": "[ßẞ]", "pt": "[ãõÃÕ]", "es": "[¿¡ñÑ]", "fr": "[œŒ]"}
TELLING_WEIGHT = 3


def query_language(x: Column) -> Column:
    """The language of a short query by its function words and telling letters; unknown without votes or for a tie."""
    words = token_set(x)
    letter = lambda lang: F.coalesce(x.rlike(TELLING_LETTERS[lang]), F.lit(False)).cast("int") * TELLING_WEIGHT if lang in TELLING_LETTERS else F.lit(0)
    votes = {lang: F.size(F.array_intersect(words, F.array(*map(F.lit, FUNCTION_WORDS.get(lang, ("",)))))) * int(lang in FUNCTION_WORDS) + letter(lang) for lang in (*FUNCTION_WORDS, *(k for k in TELLING_LETTERS if k not in FUNCTION_WORDS))}
    ranked = F.reverse(F.array_sort(F.array(*[F.struct(v.alias("n"), F.lit(lang).alias("lang")) for lang, v in votes.items()])))
    return once(ranked, lambda r: F.when((r[0]["n"] > 0) & (r[0]["n"] > r[1]["n"]), r[0]["lang"]).otherwise("unknown"))


def effective_language(title: Column, body: Column, declared: Column) -> Column:
    """The voted language of the title, else of the body, else the declared one; texts under 12 letters have no say."""
    said = lambda x: F.when(F.length(F.trim(x)) >= 12, voted_language(language_votes(x)))
    return F.coalesce(said(title), said(body), declared)


def subset_name(a: Column, b: Column) -> Column:
    """All tokens of one name, two at least, are in the other."""
    return subset_of(token_set(a), token_set(b))


def subset_of(x: Column, y: Column) -> Column:
    """The same of sets of tokens."""
    return (F.least(F.size(x), F.size(y)) >= 2) & (F.size(F.array_intersect(x, y)) == F.least(F.size(x), F.size(y)))


def name_signature(name: Column) -> Column:
    """Sorted distinct tokens of a name."""
    return F.array_join(token_set(name), " ")


def name_aliases(name: Column) -> Column:
    """Array of (kind, signature): whole name, first and last token, initial and last token, last token."""
    parts = tokens(name)
    first, last = F.element_at(parts, 1), F.element_at(parts, -1)
    alias = lambda kind, x: F.struct(F.lit(kind).alias("kind"), x.alias("signature"))
    return F.array(alias("full", name_signature(name)), alias("first_last", F.concat_ws(" ", first, last)), alias("initial", F.concat_ws(" ", F.substring(first, 1, 1), last)), alias("last", last))


def initials_compatible(a: Column, b: Column) -> Column:
    """Token by token, one starts with the other; as many tokens in both."""
    return initials_agree(tokens(a), tokens(b))


def initials_agree(x: Column, y: Column) -> Column:
    """The same of lists of tokens."""
    pairs = F.zip_with(x, y, lambda p, q: F.coalesce(p.startswith(q) | q.startswith(p), F.lit(False)))
    return (F.size(x) == F.size(y)) & (F.size(x) > 0) & F.forall(pairs, lambda ok: ok)


def strip_html(x: Column) -> Column:
    """Scripts, styles, comments and tags out; the five XML references and &nbsp; decoded; space collapsed."""
    bare = F.regexp_replace(F.coalesce(x, F.lit("")), r"(?is)<!--.*?-->|<(script|style)[^>]*>.*?</(script|style)>|<[^>]*>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def contains_all(haystack: Column, query: Column) -> Column:
    """Every token of the query occurs in the folded haystack."""
    hay = fold(haystack)
    return F.forall(tokens(query), lambda t: hay.contains(t))


# Titles that name no work, and words that do not tell titles apart.
GENERIC_TITLES = ("introduction", "introduccion", "preface", "prefacio", "foreword", "prologue", "prologo", "editorial", "review", "resena", "conclusion", "chapter", "capitulo", "index", "indice", "bibliography", "bibliografia")
TITLE_STOPWORDS = ("a", "an", "and", "the", "of", "in", "on", "for", "to", "with", "from", "de", "del", "la", "las", "el", "los", "en", "y", "por", "para", "un", "una")


def is_generic_title(x: Column) -> Column:
    """Whether a title alone cannot identify a work."""
    return fold_plain(x).isin(*GENERIC_TITLES)


def title_words(x: Column) -> Column:
    """Distinct words of a title that tell it apart, in order."""
    return F.array_distinct(F.filter(F.split(fold_plain(x), " "), lambda t: (t != "") & ~t.isin(*TITLE_STOPWORDS)))


def stem_labels(x: Column, anchor: Column, stems: dict[str, str]) -> Column:
    """Sorted labels of the stems that a text holds, without those that its anchor already names."""
    new = [F.when(x.contains(stem) & ~anchor.contains(stem) & ~anchor.contains(label), label) for stem, label in stems.items()]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*new))))


def split_people(x: Column, known: list[str]) -> Column:
    """Array of (input, canonical) of a query for several persons; empty for fewer than two.

    Parted at conjunctions, else at commas if there are two. A part takes the known name that shares most of its words
    (all, two, or the last word of the name; the earlier one among equals), and no name serves two parts.
    """
    source = F.trim(F.coalesce(x, F.lit("")))
    by_word = F.split(source, r"(?i)\s+(?:y|e|and|et|und|&)\s+")
    parts = F.when((F.size(by_word) < 2) & (F.size(F.split(source, ",")) >= 3), F.split(source, r"\s*,\s*")).otherwise(by_word)
    # folded with the part itself, so that equal names count once, as first written
    pairs = F.filter(F.transform(parts, lambda p: F.struct(fold_name(p).alias("key"), F.trim(p).alias("input"))), lambda p: p["key"] != "")
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    segments = F.transform(keys, lambda k: F.struct(k.alias("key"), F.element_at(F.filter(pairs, lambda p: p["key"] == k), 1)["input"].alias("input")))
    names = F.array(*[F.struct(F.lit(n).alias("name"), F.split(fold_name(F.lit(n)), " ").alias("words"), F.lit(-i).alias("place")) for i, n in enumerate(known)])

    def best(done: Column, part: Column) -> Column:
        words = F.array_distinct(F.split(part["key"], " "))
        free = F.filter(names, lambda n: ~F.exists(done, lambda a: F.coalesce(a["canonical"] == n["name"], F.lit(False))))
        shared = F.transform(free, lambda n: F.struct(F.size(F.array_intersect(words, n["words"])).alias("shared"), n["place"].alias("place"), n["name"].alias("name"), F.array_contains(words, F.element_at(n["words"], -1)).alias("last")))
        fit = F.filter(shared, lambda s: (s["shared"] > 0) & ((s["shared"] == F.size(words)) | (s["shared"] >= 2) | s["last"]))
        return F.concat(done, F.array(F.struct(part["input"].alias("input"), F.array_max(fit)["name"].alias("canonical"))))

    empty = F.from_json(F.lit("[]"), "array<struct<input string, canonical string>>")
    return F.when(F.size(segments) >= 2, F.aggregate(segments, empty, best)).otherwise(empty)
