"""Joins by edit distance: no pair within the bound is lost, and only pairs that share a piece of text are compared.

If two texts of m and n characters are within t edits, one of t + 1 pieces of the second stands unchanged in the first,
and no farther from its place than the edits before it can move it (the pigeonhole principle). Texts of the right side
give their pieces as keys, those of the left side the stretches that could be such a piece, so candidates come from an
equal join on pieces of some eight characters at a bound of .06.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text

# The least ratio of a damaged title, its least length, and the most characters that it may have lost.
RATIO, SHORTEST, MOST_LOST = 0.94, 27, 7
#: Stretches of a text that may be a piece of another's, about: what a row costs, in comparisons.
STRETCHES = 400
#: Stands for a character that was lost in a folded text, which has no other marks.
LOST = "?"
REPLACEMENT = "�"


def fold_damaged(x: Column) -> Column:
    """Lower case without accents, words of letters, digits and lost characters, each of which is a question mark."""
    marked = F.regexp_replace(F.regexp_replace(F.lower(text.strip_accents(F.coalesce(x, F.lit("")))), r"[^\p{L}\p{N}_\x{FFFD}]+", " "), REPLACEMENT, LOST)
    return F.trim(marked)


def _within(m: Column, n: Column, share: float) -> Column:
    """Edits that texts of m and n characters may be apart; rounded so that exact multiples stay in."""
    return F.floor(F.round((m + n) * share, 6)).cast("int")


def _piece(n: Column, pieces: Column, i: Column) -> tuple[Column, Column]:
    """Start (from 0) and length of the i-th of some even pieces of a text of n characters."""
    start = F.floor(i * n / pieces).cast("int")
    return start, F.floor((i + 1) * n / pieces).cast("int") - start


def candidates(left: DataFrame, right: DataFrame, on: Sequence[str], share: float) -> DataFrame:
    """x, y: every pair of texts that some rows equal on `on` have and that are within share * (m + n) edits, and some
    that are not.

    left: x, `on`; right: y, `on`. Empty texts pair with nothing. From a third on a text could be edited away as a
    whole, so share must be less.
    """
    if not 0 <= share < 1 / 3:
        raise ValueError("share must be at least 0 and under 1/3")
    wide = (1 + share) / (1 - share)  # no partner is longer than that, relative to the shorter
    pieces = lambda n: F.least(n, _within(n, F.floor(n * wide + 1e-6), share) + 1)
    r = right.select("y", *on, F.length("y").alias("n")).filter("n > 0").withColumn("k", pieces(F.col("n")))
    r = r.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    start, length = _piece(F.col("n"), F.col("k"), F.col("i"))
    keyed = r.select("y", *on, "n", "i", F.substring("y", start + 1, length).alias("piece"))
    m = left.select("x", *on, F.length("x").alias("m")).filter("m > 0")
    m = m.withColumn("n", F.explode(F.sequence(F.greatest(F.lit(1), F.ceil(F.col("m") / wide - 1e-6).cast("int")), F.floor(F.col("m") * wide + 1e-6).cast("int"))))
    m = m.withColumn("t", _within(F.col("m"), F.col("n"), share)).filter(F.abs(F.col("m") - F.col("n")) <= F.col("t")).withColumn("k", pieces(F.col("n")))
    m = m.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    start, length = _piece(F.col("n"), F.col("k"), F.col("i"))
    m = m.withColumn("start", start).withColumn("length", length)
    back, ahead = F.floor((F.col("t") - (F.col("m") - F.col("n"))) / 2), F.floor((F.col("t") + (F.col("m") - F.col("n"))) / 2)
    low, high = F.greatest(F.lit(0), F.col("start") - back).cast("int"), F.least(F.col("m") - F.col("length"), F.col("start") + ahead).cast("int")
    m = m.filter(low <= high).withColumn("at", F.explode(F.sequence(low, high)))
    stretches = m.select("x", *on, "n", "i", F.substring("x", F.col("at") + 1, F.col("length")).alias("piece")).distinct()
    keys, parts = [*on, "n", "i", "piece"], int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # few and short rows make many pairs: without a stated number of tasks their size would leave them to one
    pairs = stretches.repartition(parts, *keys).join(keyed.repartition(parts, *keys), keys)
    return pairs.select("x", "y").repartition(parts, "x", "y").distinct()


def text_pairs(left: DataFrame, right: DataFrame, on: Sequence[str], share: float) -> DataFrame:
    """x, y: the candidates, each pair of different rows' texts once, whatever the copies.

    Texts that recur under many values of `on` are compared without regard to it, if that costs less; what
    joins the pairs to the rows is equal on `on` again.
    """
    l, r = (df.select(c, *on).na.drop().distinct().persist() for df, c in ((left, "x"), (right, "y")))
    per = l.groupBy(*on).agg(F.count("*").cast("double").alias("n")).join(r.groupBy(*on).agg(F.count("*").alias("k")), list(on)) if on else None
    within = STRETCHES * l.count() + (per.agg(F.sum(F.col("n") * F.col("k"))).first()[0] or 0) if on else None
    texts = l.select("x").distinct(), r.select("y").distinct()
    n = texts[0].count()
    if within is None or within <= n * (STRETCHES + texts[1].count()):
        return candidates(l, r, on, share)
    return candidates(*texts, [], share)


def edit_join(left: DataFrame, right: DataFrame, on: Sequence[str], share: float) -> DataFrame:
    """a, b, distance of the pairs within share * (m + n) single-character edits.

    Distances are found between different texts once; the rows that have them are joined at the end.
    """
    found = text_pairs(left, right, on, share).withColumn("distance", F.levenshtein("x", "y"))
    near = found.filter(F.col("distance") <= _within(F.length("x"), F.length("y"), share))
    return near.join(left.select("a", "x", *on), "x").join(right.select("b", "y", *on), ["y", *on]).select("a", "b", "distance")


def text_ratios(left: DataFrame, right: DataFrame, on: Sequence[str], ratio: float = RATIO) -> DataFrame:
    """x, y, ratio: pairs of texts whose matching blocks cover at least `ratio` of both.

    Such blocks are a common subsequence, so at most (1 - ratio) of all characters are inserted or deleted, and no more
    are edits; blocks are looked for where edits allow them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [SequenceMatcher(None, x, y).ratio() for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            whole = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], names=["x", "y", "ratio"])
            yield whole.filter(pa.array([s >= ratio for s in scores], pa.bool_()))

    near = text_pairs(left, right, on, 1 - ratio).filter(F.levenshtein("x", "y") <= _within(F.length("x"), F.length("y"), 1 - ratio))
    return near.mapInArrow(run, "x string, y string, ratio double")


def ratio_join(left: DataFrame, right: DataFrame, on: Sequence[str], ratio: float = RATIO) -> DataFrame:
    """a, b, ratio: the pairs of rows, equal on `on`, whose texts have that ratio."""
    return text_ratios(left, right, on, ratio).join(left.select("a", "x", *on), "x").join(right.select("b", "y", *on), ["y", *on]).select("a", "b", "ratio")


def damaged_match(records: DataFrame, catalogue: DataFrame, id_col: str, primary: str) -> DataFrame:
    """id, status, ref, ratio for records whose title has lost characters: the catalogue entry of the same issue.

    records(id, title, issue); catalogue(entry, source, ref, title, issue, author), entry unique. Titles of fewer than
    27 characters or with more than 7 lost ones, and entries with lost characters, match nothing. Verified unless an
    identity repeats, authors disagree or the primary source has several; its entry wins, then the ratio, then one with
    an author, then the least reference.
    """
    folded = records.select(F.col(id_col).alias("a"), "issue", fold_damaged(F.col("title")).alias("x")).filter(F.col("x").contains(LOST))
    lost = F.length("x") - F.length(F.replace("x", F.lit(LOST), F.lit("")))
    fit = folded.filter((F.length("x") >= SHORTEST) & (lost <= MOST_LOST))
    entries = catalogue.select(F.col("entry").alias("b"), "source", "ref", "issue", "author", fold_damaged(F.col("title")).alias("y")).filter(~F.col("y").contains(LOST))
    asked = fit.select("x", "issue").distinct()  # all records of a title and issue have one answer
    found = text_ratios(asked, entries, ["issue"]).join(asked, "x").join(entries, ["y", "issue"])
    # the winner, and among the rest the first with an author if the winner has none
    rank = F.struct((F.col("source") != primary).alias("other"), (-F.col("ratio")).alias("far"), F.col("author").isNull().alias("bare"), "ref", "source")
    first, authored = F.min_by(F.struct("ref", "author", "ratio"), rank), F.min_by(F.struct("ref", "author", "ratio"), F.when(F.col("author").isNotNull(), rank))
    per = found.groupBy("x", "issue").agg(
        F.count("*").alias("n"), F.countDistinct("source", "ref").alias("ids"), F.countDistinct("author").alias("authors"), F.count(F.when(F.col("source") == primary, 1)).alias("main"), first.alias("w"), authored.alias("v")
    )
    status = F.when(F.col("n").isNull(), "no verified match").when(F.col("ids") < F.col("n"), "repeated identity").when(F.col("authors") > 1, "conflicting authors").when(F.col("main") > 1, "ambiguous").otherwise("verified")
    best = F.when(F.col("w.author").isNull(), F.coalesce("v", "w")).otherwise(F.col("w"))
    out = folded.select("a", "x", "issue").join(per, ["x", "issue"], "left").withColumn("status", status).withColumn("best", best)
    good = F.col("status") == "verified"
    return out.select(F.col("a").alias(id_col), "status", F.when(good, F.col("best.ref")).alias("ref"), F.when(good, F.round("best.ratio", 6)).alias("ratio"))
