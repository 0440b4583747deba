"""Document fingerprints: a Merkle tree over pieces, paragraphs and sections.

A paragraph is a line; its leaves are the sentence pieces in it, cut at stops or after 200 bytes. A section is a run of
paragraphs that ends at a blank line, before a heading, or where a paragraph's digest says so (one in eight), so that
an insertion moves no boundary but its own. Nothing is dropped between leaves: equal roots mean equal texts. A node's
digest is the 128-bit xxh3 hash of its children's digests.

The text form is root/sections, sections joined by "." and each digest:paragraphs, paragraphs joined by "," and each
digest=leaves; digests of inner nodes have 16 hex digits, leaves 8 each. Two trees are compared from the roots down, and
only where digests differ: equal roots are 1; else leaves under equal sections, then equal paragraphs, then equal leaves
count as shared, and likeness is twice their number over all leaves of both. The branches that differ are the places
(section.paragraph) of paragraphs whose digests the other tree does not have.

Null text: as empty, one root for all. Very long texts make trees in proportion. In documents that follow each other by
id, null ids come first and ties of an id are ordered by the text's hash; rows that repeat follow each other. One
document is followed by itself; an empty table gives no rows. Only id and text are read, so other columns may have any
names.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import map_batches

_PIECE = re.compile(rb"[^.!?]{1,200}[.!?]*|[.!?]+")
_HASH = xxhash.xxh3_128_digest


class Tree:
    """root: hex digest; sections: (digest, paragraphs), each paragraph (digest, leaves), all in hex."""

    __slots__ = ("root", "sections")

    def __init__(self, root: str, sections: list[tuple[str, tuple[tuple[str, str], ...]]]):
        self.root, self.sections = root, sections

    def __str__(self) -> str:
        return f"{self.root}/{'.'.join([d + ':' + ','.join([p + '=' + leaves for p, leaves in inner]) for d, inner in self.sections])}"

    @classmethod
    def parse(cls, text: str) -> Tree:
        root, _, rest = text.partition("/")
        sections = [s.partition(":") for s in rest.split(".")] if rest else []
        return cls(root, [(d, tuple((p[:16], p[17:]) for p in inner.split(","))) for d, _, inner in sections])


def build(text: str) -> Tree:
    data = text.encode("utf-8", "surrogatepass")
    sections: list[tuple[str, tuple[tuple[str, str], ...]]] = []
    open_paragraphs: list[tuple[str, str]] = []
    open_digests: list[bytes] = []
    tops: list[bytes] = []

    def close() -> None:
        if open_digests:
            tops.append(_HASH(b"".join(open_digests)))
            sections.append((tops[-1][:8].hex(), tuple(open_paragraphs)))
            open_paragraphs.clear()
            open_digests.clear()

    for line in data.splitlines(keepends=True) if b"\r" not in data and b"\x0b" not in data and b"\x0c" not in data else re.findall(rb"[^\n]*\n|[^\n]+", data):
        if line[:1] == b"#" and open_digests:
            close()
        leaves = [_HASH(x) for x in _PIECE.findall(line)]
        digest = _HASH(b"".join(leaves))
        open_paragraphs.append((digest[:8].hex(), b"".join([x[:4] for x in leaves]).hex()))
        open_digests.append(digest)
        if digest[0] < 32 or line.isspace():
            close()
    close()
    return Tree(_HASH(b"".join(tops)).hex(), sections)


def likeness(a: Tree, b: Tree) -> float:
    if a.root == b.root:
        return 1.0
    leaves = lambda paragraphs: sum(len(x) // 8 for _, x in paragraphs)
    total = sum(leaves(inner) for t in (a, b) for _, inner in t.sections)
    left, right = Counter(a.sections), Counter(b.sections)
    same = left & right
    shared = sum(leaves(inner) * n for (_, inner), n in same.items())
    left, right = (Counter(p for (_, inner), n in (x - same).items() for p in inner for _ in range(n)) for x in (left, right))
    same = left & right
    shared += sum(len(x) // 8 * n for (_, x), n in same.items())
    left, right = (Counter(x[i : i + 8] for (_, x), n in (y - same).items() for _ in range(n) for i in range(0, len(x), 8)) for y in (left, right))
    shared += sum((left & right).values())
    return 2 * shared / total if total else 1.0


def differing(a: Tree, b: Tree) -> list[tuple[int, int]]:
    """(section, paragraph) of the paragraphs of a that b does not have: where to look for the edit."""
    if a.root == b.root:
        return []
    sections = {d for d, _ in b.sections}
    paragraphs = {p for _, inner in b.sections for p, _ in inner}
    return [(i, j) for i, (d, inner) in enumerate(a.sections) if d not in sections for j, (p, _) in enumerate(inner) if p not in paragraphs]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([str(build(t or "")) for t in batch.column(1).to_pylist()], pa.string())], names=[id_col, "fingerprint"])

    return map_batches(docs.select(id_col, text_col), run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, fingerprint string")


def edited(text: str, after: str) -> str:
    """The last half of the text's code points replaced by the first as many of the one after."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def _bucket(key: Column, bounds: list[int]) -> Column:
    """How many bounds are at most key, by halving."""

    def halve(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(key < bounds[middle], halve(low, middle)).otherwise(halve(middle + 1, high))

    return halve(0, len(bounds))


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its fingerprint, its edited text's hash and fingerprint, likeness to that and to the next,
    and the branches of the edited text's tree that the document's does not have.

    Documents are dealt by ranges of ids, one shuffle of the texts. A range also gets the first document of the range
    after it (the last range that of the first), so that each document meets the one after it without a window over
    all rows; what goes to the driver is one id per range.
    """
    spark = docs.sparkSession
    low = -(2**63)
    keyed = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(low)).alias("key"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = min(4 * parts, 2000)
    bounds = sorted(set(map(int, keyed.approxQuantile("key", [i / ranges for i in range(1, ranges)], 1 / (4 * ranges)) if ranges > 1 else [])))
    bucketed = keyed.withColumn("bucket", _bucket(F.col("key"), bounds))
    firsts = sorted((r["bucket"], r["key"]) for r in bucketed.groupBy("bucket").agg(F.min("key").alias("key")).collect())
    if not firsts:
        bounds, firsts = [], [(0, low)]
    carry_to = {key: firsts[i - 1][0] for i, (_, key) in enumerate(firsts)}
    carried = bucketed.filter(F.col("key").isin([k for _, k in firsts]))
    goes = F.create_map(*[F.lit(x) for pair in carry_to.items() for x in pair])[F.col("key")]
    both = bucketed.withColumn("carried", F.lit(False)).unionByName(carried.withColumn("bucket", goes).withColumn("carried", F.lit(True)))
    laid = both.repartition(parts, "bucket").sortWithinPartitions("bucket", "carried", "key", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # bucket, id, text, tree of the row that waits for the one after it
        for batch in batches:
            rows: list[tuple] = []
            for key_id, text, bucket, extra in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "bucket", "carried")), strict=True):
                if extra and (held is None or held[0] != bucket):
                    continue  # a further tie of the carried id
                tree = build(text)
                if held is not None and held[0] == bucket:
                    _, old_id, old, old_tree = held
                    new = edited(old, text)
                    new_tree = build(new)
                    rows.append((old_id, len(old), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), str(old_tree), str(new_tree), likeness(old_tree, new_tree), likeness(old_tree, tree), ",".join([f"{i}.{j}" for i, j in differing(new_tree, old_tree)])))
                held = None if extra else (bucket, key_id, text, tree)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "edited_branches"]
    kind = keyed.schema["id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(kind), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string()]
    return map_batches(laid, run, f"`{id_col}` {kind.simpleString()}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_branches string")


__all__ = ["Tree", "build", "differing", "edited", "fingerprints", "likeness", "with_edits"]
