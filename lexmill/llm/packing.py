"""Packing: token pieces into sequences by first-fit decreasing, run apart in randomised groups.

Texts are tokenised where they lie and cut at multiples of the sequence length, so no row is longer than a sequence
and a document of any length spreads over groups. A piece's group is a seeded hash of its document and start. In a
group, pieces go by falling length into the first bin with room, which a tournament tree of bin capacities finds in
logarithmic time. As pieces may be cut anywhere, gaps of at least `min_fill` tokens are then filled from the emptiest
bins, and what is left of the last one is dealt into sequences of powers of two, which need no padding.

Null text: as empty, a document of the end id alone. Very long texts are cut into pieces and packed whole. Null, equal
or repeated ids: each row is packed as its own document; rows that follow each other with one id are its copies 0, 1,
..., dealt to groups apart, so that a document mixed in twice does not meet itself in a sequence by its hash. Ties of
length go by id, start, copy and place. Empty table: no rows. Only the id and the text are read, so other columns may
have any names.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import map_batches, ship

#: Fixed value: the pattern by which this vocabulary cuts texts before merging bytes.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END_ID = 0
GROUP_PIECES = 2048

_encodings: dict[str, object] = {}


def encoding(path: str):
    """The byte-level BPE of a tokenizers file, whose ids are its merges' ranks, in the faster of two libraries.

    Its added tokens are taken whole wherever a text has them, as the first library does.
    """
    if path not in _encodings:
        import tiktoken

        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {x["content"]: x["id"] for x in spec.get("added_tokens", ())}
        ranks = {bytes(map(shown.__getitem__, token)): i for token, i in spec["model"]["vocab"].items() if token not in special}
        _encodings[path] = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return _encodings[path]


class Tournament:
    """First fit over bins: each inner node holds the larger capacity of its two children."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.tree = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """The first bin with room for size, whose capacity shrinks by it."""
        tree, at = self.tree, 1
        if tree[1] < size:
            raise ValueError("no bin has room")
        while at < self.leaves:
            at *= 2
            if tree[at] < size:
                at += 1
        tree[at] -= size
        found = at - self.leaves
        at //= 2
        while at:
            best = max(tree[2 * at], tree[2 * at + 1])
            if tree[at] == best:
                break
            tree[at] = best
            at //= 2
        return found


Slice = tuple[int, int, int]  # piece, start in it, length


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[list[Slice]]:
    """Bins of whole pieces; sizes fall and none is over capacity. One of full size opens a bin of its own."""
    full = sum(1 for n in sizes if n == capacity)
    bins: list[list[Slice]] = [[(i, 0, capacity)] for i in range(full)]
    tree = Tournament(len(sizes) - full, capacity)
    bins += [[] for _ in sizes[full:]]
    for i in range(full, len(sizes)):
        bins[full + tree.place(sizes[i])].append((i, 0, sizes[i]))
    return [b for b in bins if b]


def fill_gaps(bins: list[list[Slice]], capacity: int, min_fill: int) -> list[list[Slice]]:
    """Moves slices from the emptiest bins into gaps of at least min_fill, cutting them, and deals out the last bin."""
    load = lambda b: sum(n for _, _, n in b)
    done = [b for b in bins if capacity - load(b) < min_fill]
    rest = sorted((b for b in bins if capacity - load(b) >= min_fill), key=load, reverse=True)
    low, high = 0, len(rest) - 1
    while low < high:
        gap = capacity - load(rest[low])
        while gap and low < high:
            piece, start, n = rest[high].pop()
            if n > gap:
                rest[high].append((piece, start + gap, n - gap))
                n = gap
            rest[low].append((piece, start, n))
            gap -= n
            if not rest[high]:
                high -= 1
        if gap == 0:
            done.append(rest[low])
            low += 1
    if low == high:
        last, total = rest[low], load(rest[low])
        while total:
            want = 1 << (total.bit_length() - 1)
            total -= want
            out: list[Slice] = []
            while want:
                piece, start, n = last.pop(0)
                if n > want:
                    last.insert(0, (piece, start + want, n - want))
                    n = want
                out.append((piece, start, n))
                want -= n
            done.append(out)
    return done


def _tokenised(docs: DataFrame, id_col: str, text_col: str, path: str, length: int) -> DataFrame:
    """A row per piece of at most `length` ids: id, start, doc_tokens, ids (unsigned 16 or 32 bits, little-endian), copy."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoding(path)
        width = np.dtype("<u2" if code.n_vocab <= 1 << 16 else "<u4")
        before, copy = None, 0
        for batch in batches:
            rows, starts, totals, pieces, copies = [], [], [], [], []
            for row, (doc_id, text) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                copy = copy + 1 if doc_id is not None and doc_id == before else 0
                before = doc_id
                ids = np.append(np.asarray(code.encode_to_numpy(text or "", allowed_special="all")), END_ID).astype(width)
                for start in range(0, len(ids), length):
                    rows.append(row)
                    starts.append(start)
                    totals.append(len(ids))
                    pieces.append(ids[start : start + length].tobytes())
                    copies.append(copy)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int32())), pa.array(starts, pa.int64()), pa.array(totals, pa.int64()), pa.array(pieces, pa.binary()), pa.array([width.itemsize] * len(rows), pa.int32()), pa.array(copies, pa.int64())],
                names=["id", "start", "doc_tokens", "ids", "width", "copy"],
            )

    kind = dict(docs.dtypes)[id_col]
    return map_batches(docs.select(id_col, text_col), run, f"id {kind}, start bigint, doc_tokens bigint, ids binary, width int, copy bigint")


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = 1024, seed: int = 17, group_pieces: int = GROUP_PIECES, min_fill: int = 16) -> DataFrame:
    """One row per piece: id, start, length, ids (unsigned 32 bits, little-endian), doc_tokens, sequence_id, offset, padded, copy."""
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length(text_col)), F.lit(0)).alias("chars")).first()
    groups = max(1, round((size["n"] + size["chars"] / 3 / length) / group_pieces))
    pieces = _tokenised(docs, id_col, text_col, tokenizer, length)
    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64(F.lit(seed), "id", "start", "doc_tokens", "copy"), F.lit(groups)))

    def run(key: tuple[pa.Scalar], found: pa.Table) -> pa.Table:
        order = found.select(["id", "start", "copy"]).append_column("n", pa.array([len(x) for x in found["ids"].to_pylist()], pa.int64()))
        taken = order.append_column("row", pa.array(range(len(found)), pa.int64())).sort_by([("n", "descending"), ("id", "ascending"), ("start", "ascending"), ("copy", "ascending"), ("row", "ascending")])
        found = found.take(taken["row"])
        wide = np.dtype("<u2" if found["width"][0].as_py() == 2 else "<u4")
        ids = [np.frombuffer(x, wide) for x in found["ids"].to_pylist()]
        bins = fill_gaps(first_fit_decreasing([len(x) for x in ids], length), length, min_fill)
        rows, starts, data, sequences, offsets, padded = [], [], [], [], [], []
        before = found["start"].to_pylist()
        for number, members in enumerate(bins):
            at, total = 0, sum(n for _, _, n in members)
            for piece, start, n in members:
                rows.append(piece)
                starts.append(before[piece] + start)
                data.append(ids[piece][start : start + n])
                sequences.append((key[0].as_py() << 32) + number)
                offsets.append(at)
                padded.append(total if total & (total - 1) == 0 else length)
                at += n
        take = pa.array(rows, pa.int64())
        column = lambda values: pa.array(values, pa.int64())
        return pa.table(
            {id_col: found["id"].take(take), "start": column(starts), "length": column([len(x) for x in data]), "ids": pa.array([x.astype("<u4").tobytes() for x in data], pa.binary()), "doc_tokens": found["doc_tokens"].take(take), "sequence_id": column(sequences), "offset": column(offsets), "padded": column(padded), "copy": found["copy"].take(take)}
        )

    kind = dict(docs.dtypes)[id_col]
    ship(docs.sparkSession)
    return dealt.groupBy("grp").applyInArrow(run, f"`{id_col}` {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint, padded bigint, copy bigint")


def digest(packed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return packed.select(id_col, "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "padded", "copy")
