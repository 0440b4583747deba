"""Secret scans: an Aho-Corasick keyword prefilter, regular expressions anchored at the hits, checksums inside tokens.

A text is scanned once for keywords. Only at a hit is the kind's pattern tried, anchored there, left to right and
past the end of the kind's previous match, which gives what a leftmost non-overlapping search of the whole text gives.
Runs of hex digits have no keyword: a byte-class translation turns them into a plain substring search.
Kinds whose tokens embed a CRC-32 are dropped when it does not match.

Null or empty text: no spans. Positions are code points, end exclusive. Texts of any length are scanned whole. Rows are
independent: ties and repeats scan alike. Empty table: no rows. Scanning reads only the id and the text; redaction returns
all columns in their places, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import map_batches, text_bytes

# The kinds in listed order, their keywords (lower case), and the patterns tried at a keyword.
KINDS = ("assign", "access", "hex", "github", "npm", "google", "slack", "stripe", "pem")
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
    "google": ("aiza",),
    "slack": ("xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-"),
    "stripe": ("sk_live_", "rk_live_"),
    "pem": ("-----begin",),
}
PATTERNS = {
    "assign": rb"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    "access": rb"AKIA[A-Z0-9]+",
    "github": rb"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])",
    "npm": rb"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])",
    "google": rb"AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-])",
    "slack": rb"xox[abprs]-[A-Za-z0-9-]{10,}",
    "stripe": rb"[sr]k_live_[A-Za-z0-9]{16,}",
    "pem": rb"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----",
}
BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 8, 16, 32

_COMPILED = {k: re.compile(p) for k, p in PATTERNS.items()}
_HEX = bytes(ord("h") if c in b"0123456789abcdef" else 32 for c in range(256))
_automaton = None


def _keywords():
    global _automaton
    if _automaton is None:
        import ahocorasick

        found = ahocorasick.Automaton()
        for kind, words in KEYWORDS.items():
            for word in words:
                found.add_word(word, (kind, len(word)))
        found.make_automaton()
        _automaton = found
    return _automaton


def crc_matches(token: bytes) -> bool:
    """Whether the last six base-62 digits of a prefixed token are the CRC-32 of the thirty characters before them."""
    body, value, digits = token[4:-6], zlib.crc32(token[4:-6]), bytearray()
    for _ in range(6):
        value, digit = divmod(value, 62)
        digits.append(BASE62[digit])
    return len(body) == 30 and bytes(reversed(digits)) == token[-6:]


def _keeps(kind: str, match: re.Match) -> bool:
    if kind == "assign":
        return len(match[2]) >= MIN_ASSIGN
    if kind == "access":
        return len(match[0]) >= MIN_ACCESS
    return crc_matches(match[0]) if kind in ("github", "npm") else True


def _hex_runs(data: bytes) -> Iterator[tuple[int, int]]:
    classes, at, run = data.translate(_HEX), 0, b"h" * MIN_HEX
    while (at := classes.find(run, at)) >= 0:
        end = at + MIN_HEX
        while classes[end : end + 1] == b"h":
            end += 1
        yield at, end
        at = end


def scan_text(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every secret, by start, then kind in listed order."""
    data = text_bytes(text)
    hits: dict[str, list[int]] = {}
    for last, (kind, n) in _keywords().iter(data.lower().decode("latin-1")):
        hits.setdefault(kind, []).append(last - n + 1)
    spans = [(start, KINDS.index("hex"), end) for start, end in _hex_runs(data)]
    for kind, starts in hits.items():
        free = 0
        for start in sorted(set(starts)):
            if start >= free and (match := _COMPILED[kind].match(data, start)):
                free = match.end()
                if _keeps(kind, match):
                    spans.append((start, KINDS.index(kind), free))
    spans.sort()
    if spans and not data.isascii():
        points, at, n = {}, 0, 0
        for x in sorted({p for start, _, end in spans for p in (start, end)}):
            n += len(data[at:x].decode("utf-8", "surrogatepass"))
            at = x
            points[x] = n
        spans = [(points[start], kind, points[end]) for start, kind, end in spans]
    return [(KINDS[kind], start, end) for start, kind, end in spans]


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id and spans array<struct<kind, start, end>>, empty where there is none."""
    kind = dict(docs.dtypes)[id_col]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in scan_text(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, SPANS)], names=[id_col, "spans"])

    return map_batches(docs.select(id_col, text_col), scan, f"`{id_col}` {kind}, spans array<struct<kind: string, start: bigint, end: bigint>>")


def redact_text(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with each secret replaced; spans that overlap are replaced as one."""
    if not (spans := scan_text(text)):
        return text
    merged: list[list[int]] = []
    for _, start, end in spans:
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    out, at = [], 0
    for start, end in merged:
        out += [text[at:start], mark]
        at = end
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, text_col: str = "text", chars_col: str | None = None, mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns, with secrets in text_col replaced by mark and chars_col, if given, counted anew."""
    names, schema = docs.columns, docs.schema

    def redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, place = list(batch.columns), names.index(text_col)
            old = columns[place].to_pylist()
            new = [redact_text(t, mark) for t in old]
            columns[place] = pa.array(new, columns[place].type)
            if chars_col:
                counts = columns[names.index(chars_col)]
                fixed = [n if a == b else len(b or "") for n, a, b in zip(counts.to_pylist(), old, new, strict=True)]
                columns[names.index(chars_col)] = pa.array(fixed, counts.type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return map_batches(docs, redact, schema)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts per base kind, the base spans' SHA-256 and all spans as text."""
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(id_col, n("assign"), n("access"), n("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
