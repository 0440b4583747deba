"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, and how common each pair is.

Two tokenizers spell the same bytes, so the ends of their tokens are offsets into one string. A two-pointer merge of the
cumulative ends of A and B walks both lists once: it emits a link for each A and B token that overlap and closes a group
wherever both end. The merge runs in Arrow batches where the texts lie; per document its distinct pairs and their
numbers are kept. Spark then counts the documents of each pair (partial counts before the shuffle), takes the highest
count per A id and per B id, and joins counts and maxima back to the documents' pairs. A count of pairs has at most as
many rows as the vocabularies have pairs that touch; it is broadcast only up to `PAIR_ROWS` rows of about 40 bytes, and
dealt by salts beyond that.

Where no piece of either vocabulary reaches from a character that is no white space over a following space, tokens never
cross such a place: the text is cut there, and each distinct part is encoded and merged once per worker (a store of
at most about `STORE` parts, of which the longest unused go first). Otherwise the text is one part. A document is exactly the sum of its parts either way.

Null and empty texts, and texts whose joined token bytes differ from a space and the text in either tokenizer, have no
tokens: zeros and an empty digest; they hold no pair. Special tokens inside a text are plain text. Ids may be null or
repeated: each row is its own document. Very long texts are read whole. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import join_lookup, map_batches, materialise

#: Rows of the table of pairs up to which it is broadcast.
PAIR_ROWS = 1_000_000
#: Parts that a worker remembers, and the characters up to which a part is worth it.
STORE, STORE_CHARS = 300_000, 40
#: Bits of a pair's code that hold the B id.
SHIFT = 32
_SPACE = "▁"
#: Before a space that ends neither white space nor the text (a part of one space would be an empty text to B), and the same in a token.
_PLACE, _CROSSING = re.compile(r"(?<=\S)(?= [\s\S])"), re.compile(r"\S ")
_WIDE = re.compile(r"\s ")


#: The alignment of one stretch of text: A tokens, groups in text form, and codes of its links as 8 bytes each. A group of
#: p A and q B tokens has p + q - 1 links, so the other counts follow. None where the bytes differ.
Part = tuple[int, str, bytes]


class Tokenizers:
    """A: a byte-level tokenizers file. B: a sentencepiece model, which puts a space before each text."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(shown[c] for c in token) if all(c in shown for c in token) else token.encode()
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.cuts = not any(_CROSSING.search(x.decode(errors="replace")) for x in (*self.a_bytes, *self.b_bytes))
        self.a_size, self.b_size = ([len(x) for x in y] for y in (self.a_bytes, self.b_bytes))
        self.a_size_of, self.b_size_of = np.array(self.a_size), np.array(self.b_size)
        self.store: dict[str, Part | None] = {}
        self.older: dict[str, Part | None] = {}

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[1:-1], 16)]) if self.b.is_byte(i) else piece.replace(_SPACE, " ").encode()

    def _encode_a(self, words: list[str]) -> list[list[int]]:
        """A's ids of a space and each word: at once where the words may stand in one text, else one by one."""
        plain = [w for w in words if w and not w[-1].isspace()] if self.cuts else []
        if not plain:
            return [x.ids for x in self.a.encode_batch_fast([f" {w}" for w in words], add_special_tokens=False)]
        ids = self.a.encode_batch_fast([" " + " ".join(plain)], add_special_tokens=False)[0].ids
        last = np.searchsorted(np.cumsum(self.a_size_of[ids]), np.cumsum([len(w.encode()) + 1 for w in plain])) + 1
        found = dict(zip(plain, [ids[i:j] for i, j in zip([0, *last[:-1].tolist()], last.tolist(), strict=True)], strict=True))
        odd = [w for w in words if w not in found]
        found |= zip(odd, [x.ids for x in self.a.encode_batch_fast([f" {w}" for w in odd], add_special_tokens=False)], strict=True)
        return [found[w] for w in words]

    @staticmethod
    def _spelt(words: list[str], ids: list[list[int]], spelling: list[bytes], size_of: np.ndarray) -> list[bool]:
        """Whether the tokens of each word spell a space and the word: for all words together, or if that fails one by one."""
        flat = list(chain.from_iterable(ids))
        if b"".join(map(spelling.__getitem__, flat)) == "".join([f" {w}" for w in words]).encode():
            ends = np.append(0, np.cumsum(size_of[flat]))[np.cumsum([len(x) for x in ids])]
            if (ends == np.cumsum([len(w.encode()) + 1 for w in words])).all():
                return [True] * len(words)
        return [b"".join(map(spelling.__getitem__, x)) == f" {w}".encode() for w, x in zip(words, ids, strict=True)]

    def align(self, words: list[str]) -> list[Part | None]:
        """The parts that a space and each word make."""
        if not words:
            return []
        many_a, many_b = self._encode_a(words), self.b.encode(words, num_threads=1)
        good_a, good_b = self._spelt(words, many_a, self.a_bytes, self.a_size_of), self._spelt(words, many_b, self.b_bytes, self.b_size_of)
        return [merge(a, b, self.a_size, self.b_size) if good and well else None for a, b, good, well in zip(many_a, many_b, good_a, good_b, strict=True)]

    def _words(self, text: str) -> list[str]:
        """What stands between the places where a text may be cut, each without the space before it."""
        if not self.cuts:
            return [text]
        if text[-1] != " " and text[0] != " " and not _WIDE.search(text):
            return text.split(" ")
        return [p[1:] for p in _PLACE.split(f" {text}")]

    def documents(self, texts: list[str]) -> Iterator[list[Part | None]]:
        """The parts of each text, in order; texts are not empty, a space is put before them."""
        words = [self._words(t) for t in texts]
        if len(self.store) > STORE // 2:
            self.store, self.older = {}, self.store
        store, older, fresh = self.store, self.older, []
        for w in set().union(*words).difference(store):
            if w in older:
                store[w] = older[w]
            else:
                fresh.append(w)
        store.update(zip(fresh, self.align(fresh), strict=True))
        for some in words:
            yield list(map(store.__getitem__, some))
        for w in fresh:
            if len(w) > STORE_CHARS:
                del store[w]


def merge(a: list[int], b: list[int], size_a: list[int], size_b: list[int]) -> Part:
    """Two pointers over the cumulative ends: links of overlapping tokens, groups closed where both end.

    a and b spell equally many bytes; size_a and size_b are the bytes of each id.
    """
    last_a, last_b = len(a), len(b)
    if last_a == 1:  # one pointer stands still
        x = a[0]
        return 1, f"{x}|{','.join(map(str, b))}", array("q", [x << SHIFT | y for y in b]).tobytes()
    if last_b == 1:
        y = b[0]
        return last_a, f"{','.join(map(str, a))}|{y}", array("q", [x << SHIFT | y for x in a]).tobytes()
    i = j = end_a = end_b = 0
    links, groups = [], []
    while i < last_a:
        x, y = a[i], b[j]
        end_a, end_b = end_a + size_a[x], end_b + size_b[y]
        links.append(x << SHIFT | y)
        if end_a == end_b:
            groups.append(f"{x}|{y}")
        else:
            first_i, first_j = i, j
            while end_a != end_b:
                if end_a < end_b:
                    i += 1
                    x = a[i]
                    end_a += size_a[x]
                else:
                    j += 1
                    y = b[j]
                    end_b += size_b[y]
                links.append(x << SHIFT | y)
            groups.append(f"{','.join(map(str, a[first_i : i + 1]))}|{','.join(map(str, b[first_j : j + 1]))}")
        i += 1
        j += 1
    return last_a, ";".join(groups), array("q", links).tobytes()


_open: dict[tuple[str, str], Tokenizers] = {}


def tokenizers(a_path: str, b_path: str) -> Tokenizers:
    """One per worker."""
    if (a_path, b_path) not in _open:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _open[a_path, b_path] = Tokenizers(a_path, b_path)
    return _open[a_path, b_path]


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def align_documents(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", keep_groups: bool = False) -> DataFrame:
    """One row per document: id, counts, groups_sha256 (with keep_groups also groups), codes and times of its distinct pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(a_path, b_path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = both.documents([t for t in texts if t])
            rows = []
            for t in texts:
                parts = next(found) if t else []
                if not parts or None in parts:
                    rows.append(((0, 0, 0, 0), "", None, np.zeros(0, np.int64), np.zeros(0, np.int64)))
                    continue
                n_a, groups, links = zip(*parts, strict=True)
                every = np.frombuffer(b"".join(links), np.int64)
                codes, n = np.unique(every, return_counts=True)
                groups = ";".join(groups)
                n_a, n_groups = sum(n_a), groups.count("|")
                counts = n_a, len(every) + n_groups - n_a, n_groups, len(every)
                rows.append((counts, hashlib.sha256(groups.encode()).hexdigest(), groups if keep_groups else None, codes, n))
            offsets = pa.array(np.cumsum([0, *[len(r[3]) for r in rows]]), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([r[k] for r in rows]) if rows else [], pa.int64())) for k in (3, 4)]
            columns = [batch.column(0), *[pa.array([r[0][k] for r in rows], pa.int64()) for k in range(4)], pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string()), *lists]
            yield pa.RecordBatch.from_arrays(columns, names=["id", *_COUNTS, "groups_sha256", "groups", "codes", "times"])

    kind = dict(docs.dtypes)[id_col]
    return map_batches(docs.select(id_col, text_col), run, f"id {kind}, {', '.join(f'{c} long' for c in _COUNTS)}, groups_sha256 string, groups string, codes array<long>, times array<long>")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """One row per pair of ids that any document links: code, a, b, n_docs, and whether that is the most of its A id, of its B id."""
    counted = aligned.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("n_docs"))
    counted = counted.withColumn("a", F.shiftright("code", SHIFT)).withColumn("b", F.col("code").bitwiseAND(F.lit((1 << SHIFT) - 1)))
    most = [counted.groupBy(F.col(x).alias(f"id_{x}")).agg(F.max("n_docs").alias(f"most_{x}")) for x in "ab"]
    for x, table in zip("ab", most, strict=True):
        counted = counted.join(table, F.col(x) == F.col(f"id_{x}"))
    return counted.select("code", "a", "b", "n_docs", *[(F.col("n_docs") == F.col(f"most_{x}")).alias(f"best_{x}") for x in "ab"])


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", pair_rows: int = PAIR_ROWS) -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, n_links, n_best, n_best_b, count_sum, groups_sha256."""
    found = align_documents(docs, a_path, b_path, id_col, text_col).drop("groups")
    aligned = materialise(found.withColumn("row", F.monotonically_increasing_id()), "alignment")  # numbers are read from the table from here on
    pairs = materialise(pair_counts(aligned).drop("a", "b"), "pairs")
    each = aligned.select("row", F.explode(F.arrays_zip("codes", "times")).alias("z")).select("row", F.col("z.codes").alias("code"), F.col("z.times").alias("times"))
    joined = join_lookup(each, pairs, ["code"], "inner", bound=pair_rows)
    sums = joined.groupBy("row").agg(
        F.sum(F.when(F.col("best_a"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.when(F.col("best_b"), F.col("times")).otherwise(0)).alias("n_best_b"), F.sum(F.col("times") * F.col("n_docs")).alias("count_sum")
    )
    sums = sums.withColumnRenamed("row", "of")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return aligned.join(sums, aligned["row"] == sums["of"], "left").select(F.col("id").alias(id_col), *_COUNTS, zero("n_best"), zero("n_best_b"), zero("count_sum"), "groups_sha256")
