"""Licence scans: exact seeds by the pigeonhole principle locate candidates, bounded-error matching verifies them.

A notice that may have k edits is cut into k + 1 pieces: any match with at most k edits holds one piece unchanged. The
pieces are searched exactly in the normalised text (lower case words joined by one space); around each hit, in a window no longer
than the notice and its edits allow, the regex library looks for the notice with at most k edits, between word
boundaries, and reports span and edits. Of overlapping spans of a notice the one with fewer edits stays, then the
earlier. Phrases of the base are notices without edits; they are counted at every place.

Null or empty text: no words, no spans. A text of any length is scanned whole, in time linear in its hits. Rows are
independent, so ties and repeats scan alike. Empty table: no rows. Only the id and the text are read, so other columns
may have any names.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import map_batches, text_bytes


@dataclass(frozen=True)
class Notice:
    phrase: str
    label: str
    edits: int = 0

    def seeds(self) -> list[tuple[int, str]]:
        """(offset, piece) of the edits + 1 pieces."""
        n, k = len(self.phrase), self.edits + 1
        cuts = [i * n // k for i in range(k + 1)]
        return [(a, self.phrase[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


# The base phrases with their labels, then the notices that are searched with edits.
BASE = (
    Notice("gnu general public license", "gpl"),
    Notice("apache license", "apache"),
    Notice("cc by", "cc-by"),
    Notice("mit license", "mit"),
)
NOTICES = (
    Notice("gnu general public license", "gpl", 2),
    Notice("gnu lesser general public license", "lgpl", 2),
    Notice("gnu affero general public license", "agpl", 2),
    Notice("apache license", "apache", 1),
    Notice("apache licence", "apache"),
    Notice("mit licence", "mit"),
    Notice("creative commons attribution", "cc-by", 2),
    Notice("mozilla public license", "mpl", 2),
    Notice("eclipse public license", "epl", 2),
    Notice("permission is hereby granted free of charge to any person obtaining a copy", "mit", 5),
    Notice("redistribution and use in source and binary forms", "bsd", 4),
    Notice("permission to use copy modify and or distribute this software", "isc", 4),
    Notice("this is free and unencumbered software released into the public domain", "unlicense", 5),
    Notice("all rights reserved", "reserved", 1),
)

#: What is no ASCII letter, digit or byte over 127 becomes a space; A-Z become a-z.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def normalise(text: str | None) -> bytes:
    return b" ".join(text_bytes(text).translate(_WORDS).split())


def _places(data: bytes, piece: bytes) -> Iterator[int]:
    at = data.find(piece)
    while at >= 0:
        yield at
        at = data.find(piece, at + 1)


def _matches(pattern: regex.Pattern, window: str) -> Iterator[regex.Match]:
    """The best match, then those of what is left before and after it."""
    left = [(0, len(window))]
    while left:
        a, b = left.pop()
        if match := pattern.search(window, a, b):
            yield match
            left += [(a, match.start()), (match.end(), b)]


class Scanner:
    """Compiled notices; scan() gives the spans of one text."""

    def __init__(self, base: tuple[Notice, ...] = BASE, notices: tuple[Notice, ...] = NOTICES):
        self.base = [(x.phrase.encode(), x) for x in base]
        self.fuzzy = []
        self.by_seed: dict[bytes, list[tuple[int, int]]] = {}
        for i, x in enumerate(notices):
            limit = f"{{e<={x.edits}}}" if x.edits else ""
            self.fuzzy.append((regex.compile(rf"(?b)(?<![^ ])(?:{regex.escape(x.phrase)}){limit}(?![^ ])"), x))
            for offset, piece in x.seeds():
                self.by_seed.setdefault(piece.encode(), []).append((i, offset))

    def scan(self, text: str | None) -> tuple[int, list[tuple[str, int, int, int, bool]]]:
        """Number of words, and (label, first word, end word, edits, base) by first word, then label."""
        data = normalise(text)
        spaces = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
        n_words = len(spaces) + 1 if data else 0
        word_at = lambda at: int(np.searchsorted(spaces, at))
        found: dict[tuple[str, int, int, bool], int] = {}
        framed = b" " + data + b" "
        for phrase, x in self.base:
            for at in _places(framed, b" " + phrase + b" "):
                word = word_at(at)
                found[x.label, word, word + phrase.count(b" ") + 1, True] = 0
        windows: dict[int, set[tuple[int, int]]] = {}
        for piece, uses in self.by_seed.items():
            for at in _places(data, piece):
                for i, offset in uses:
                    x = self.fuzzy[i][1]
                    # an edit is one character of up to four bytes; a match lies between spaces in the window
                    a, b = at - offset - 4 * x.edits - 1, at - offset + len(x.phrase) + 4 * x.edits + 1
                    a = 0 if a < 0 else data.find(b" ", a, at + 1) + 1
                    b = len(data) if b >= len(data) else data.rfind(b" ", at, b)
                    if b > a and (a or at - offset - 4 * x.edits - 1 < 0):
                        windows.setdefault(i, set()).add((a, b))
        for i, spans in windows.items():
            pattern, x = self.fuzzy[i]
            matches = set()
            for a, b in spans:
                window = data[a:b].decode("utf-8", "surrogatepass")
                for match in _matches(pattern, window):
                    first = word_at(a) + window.count(" ", 0, match.start())
                    matches.add((sum(match.fuzzy_counts), first, first + match[0].count(" ") + 1))
            taken: list[tuple[int, int]] = []
            for edits, first, end in sorted(matches):
                place = bisect.bisect(taken, (first, end))
                if place and taken[place - 1][1] > first or place < len(taken) and taken[place][0] < end:
                    continue
                taken.insert(place, (first, end))
                key = x.label, first, end, False
                found[key] = min(found.get(key, 99), edits)
        plain = {k[:3] for k in found if k[3]}
        return n_words, sorted((*k[:3], edits, k[3]) for k, edits in found.items() if k[3] or k[:3] not in plain)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: tuple[Notice, ...] = BASE, notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """One row per document: id, n_words, spans array<struct<label, first_word, end_word, edits, base, likeness>>."""
    kind, names = dict(docs.dtypes)[id_col], ("label", "first_word", "end_word", "edits", "base", "likeness")
    shortest = {x.label: min(len(y.phrase) for y in (*base, *notices) if y.label == x.label) for x in (*base, *notices)}
    spans_type = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("edits", pa.int64()), ("base", pa.bool_()), ("likeness", pa.float64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(base, notices)
        for batch in batches:
            found = [scanner.scan(t) for t in batch.column(1).to_pylist()]
            spans = [[dict(zip(names, (*s, max(0.0, 1 - s[3] / shortest[s[0]])), strict=True)) for s in x[1]] for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.int64()), pa.array(spans, spans_type)], names=[id_col, "n_words", "spans"])

    return map_batches(docs.select(id_col, text_col), scan, f"`{id_col}` {kind}, n_words bigint, spans array<struct<label: string, first_word: bigint, end_word: bigint, edits: bigint, base: boolean, likeness: double>>")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and places of the base, labels of both, and the best likeness as score."""
    base = F.filter("spans", lambda s: s["base"])
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    starts = F.transform(base, lambda s: s["first_word"])
    return found.select(
        id_col, "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("spans")).alias("labels"), F.coalesce(F.array_max(F.transform("spans", lambda s: s["likeness"])), F.lit(0.0)).alias("score"), "spans",
    )
