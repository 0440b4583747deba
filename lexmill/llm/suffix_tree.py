"""LM scoring by a probabilistic suffix tree over bytes, next to a unigram baseline.

Training texts are read as their lower-case words (A-Z only) joined by spaces, then an end symbol. One pass counts, per
task, words and all strings of DEPTH + 1 symbols (fewer at a text's start: the history before it is the end symbol);
the counts are summed in Spark. A context of up to DEPTH bytes is a node of the tree. It is retained if its next-symbol
distribution departs from that of its longest suffix: count times Kullback-Leibler divergence must reach `least_gain`,
whatever the size of the input. Suffixes of retained nodes are retained. Distributions are smoothed towards the
suffix's with the weight of the number of distinct symbols seen, and at the root with one more count per byte. A text is
scored by the longest retained suffix at each position; all bytes of all texts are scored.

The nodes of the highest counts, about `cells` probabilities, travel with the model; the others stay in a partitioned
table. A node that travels knows by which symbols before it a node of the table follows: just positions that lead there
are joined. `cells` decides where a node is looked up, not whether it is retained.

Baseline counts of the most frequent words (a bounded table) travel with the model; all other words are joined.

Null text: no words, the end symbol alone. Null id: crc32 of nothing, so training. An empty training set leaves the
uniform root and base scores of zero; an empty table of documents gives no rows. Rows with equal ids or texts are counted
and scored each; ties of counts go by their bins, so they stay together. Texts of any length are read whole, in slices.
Only the id and the text are read, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexmill.llm.common import give_back, map_batches, materialise, text_bytes

DEPTH, END = 5, 0xFF
LEAST_GAIN, CELLS, HOT_WORDS = 16.0, 8_000_000, 300_000
_CHUNK, _SLICE = 800_000, 400_000
_ROWS = 8192  # nodes whose probabilities are made at once
_SYMBOLS = 8 * (DEPTH + 1)  # bits of a code


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word) - (1 << 63)
        return found


def is_held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def read_words(text: str | None) -> list[bytes]:
    return text_bytes(text).lower().split()


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, list[list[bytes]]]]:
    """(first row, words of the rows) of about _CHUNK characters."""
    start = total = 0
    for i, text in enumerate(texts):
        total += len(text or "") + DEPTH + 1
        if total >= _CHUNK or i == len(texts) - 1:
            yield start, [read_words(t) for t in texts[start : i + 1]]
            start, total = i + 1, 0


def _layout(lists: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the texts, each after DEPTH end symbols, and where each text with its history starts."""
    blocks = [bytes([END]) * DEPTH + b" ".join(words) + bytes([END]) for words in lists]
    return np.frombuffer(b"".join(blocks), np.uint8), np.cumsum([0, *map(len, blocks)])[:-1]


def _windows(symbols: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, codes) of the strings of DEPTH + 1 symbols that end at a text's own symbols, in bounded slices."""
    own = np.ones(len(symbols), bool)
    for j in range(DEPTH):
        own[starts + j] = False
    for a in range(DEPTH, len(symbols), _SLICE):
        b = min(len(symbols), a + _SLICE)
        codes = np.zeros(b - a, np.int64)
        for j in range(DEPTH + 1):
            codes = (codes << 8) | symbols[a - DEPTH + j : b - DEPTH + j]
        keep = own[a:b]
        yield np.flatnonzero(keep) + a, codes[keep]


def _merge(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    u, n = np.concatenate(codes), np.concatenate(counts)
    order = np.argsort(u, kind="stable")
    u, n = u[order], n[order]
    first = np.flatnonzero(np.append(True, u[1:] != u[:-1]))
    return u[first], np.add.reduceat(n, first)


def corpus_counts(texts: DataFrame) -> DataFrame:
    """kind, code, n over a column of texts: kind 0 words by hash, 1 strings of symbols, 2 texts (the end tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        held: dict[int, tuple[list[np.ndarray], list[np.ndarray]]] = {0: ([], []), 1: ([], [])}
        n_texts = 0

        def add(kind: int, values: np.ndarray) -> None:
            u, n = np.unique(values, return_counts=True)
            held[kind][0].append(u)
            held[kind][1].append(n)
            if len(held[kind][0]) >= 24:
                u, n = _merge(*held[kind])
                held[kind] = [u], [n]

        def out(kind: int) -> Iterator[pa.RecordBatch]:
            if held[kind][0]:
                u, n = _merge(*held[kind])
                held[kind] = [], []
                for i in range(0, len(u), 100_000):
                    part = u[i : i + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), kind, np.int32)), pa.array(part), pa.array(n[i : i + 100_000])], names=["kind", "code", "n"])

        for batch in batches:
            n_texts += len(batch)
            for _, some in _chunks(batch.column(0).to_pylist()):
                flat = [w for words in some for w in words]
                add(0, np.fromiter(map(hashes.__getitem__, flat), np.int64, len(flat)))
                for _, codes in _windows(*_layout(some)):
                    add(1, codes)
            for kind in held:  # what a task holds stays bounded; the sums are made in Spark
                if held[kind][0] and len(held[kind][0][0]) > 3_000_000:
                    yield from out(kind)
        for kind in held:
            yield from out(kind)
        yield pa.RecordBatch.from_arrays([pa.array([2], pa.int32()), pa.array([0], pa.int64()), pa.array([n_texts], pa.int64())], names=["kind", "code", "n"])

    return map_batches(texts, run, "kind int, code bigint, n bigint").groupBy("kind", "code").agg(F.sum("n").alias("n"))


@dataclass
class Tree:
    """keys[L]: sorted contexts of length L as numbers, nodes[L]: their rows in logs; column: of each byte."""

    keys: list[np.ndarray]
    nodes: list[np.ndarray]
    column: np.ndarray
    logs: np.ndarray
    lengths: np.ndarray
    outside: np.ndarray | None = None  # a bit per node and symbol: the symbol before the node gives one that is not here

    def prepare(self) -> list[pd.Index]:
        return [pd.Index(k) for k in self.keys]

    def states(self, contexts: np.ndarray, index: list[pd.Index]) -> np.ndarray:
        """The node of the longest retained suffix of each context of DEPTH symbols."""
        out = np.zeros(len(contexts), np.int32)
        open_at: np.ndarray | slice = slice(None)
        for length in range(DEPTH, 0, -1):
            if not len(self.keys[length]):
                continue
            here = contexts[open_at] & ((1 << 8 * length) - 1)
            found = index[length].get_indexer(here)
            hit = found >= 0
            places = np.arange(len(contexts)) if isinstance(open_at, slice) else open_at
            out[places[hit]] = self.nodes[length][found[hit]]
            open_at = places[~hit]
            if not len(open_at):
                break
        return out

    def score(self, lists: list[list[bytes]], index: list[pd.Index]) -> np.ndarray:
        """log10 probability of each text's words and end."""
        return self.walk(lists, index)[0]

    def walk(self, lists: list[list[bytes]], index: list[pd.Index]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """log10 probability of each text at the positions whose node is here; (row, code, times) of the others.

        Above its DEPTH + 1 symbols such a code has the least length of its node.
        """
        symbols, starts = _layout(lists)
        out, rest = np.zeros(len(lists)), []
        for positions, codes in _windows(symbols, starts):
            contexts = codes >> 8
            states = self.states(contexts, index)
            logs = self.logs[states, self.column[codes & 255]].astype(np.float64)
            row = np.searchsorted(starts, positions, side="right") - 1
            if self.outside is not None:
                lengths = self.lengths[states]
                before = (contexts >> 8 * lengths) & 255
                away = (lengths < DEPTH) & ((self.outside[states, before >> 3] >> (7 - (before & 7))) & 1 > 0)
                if away.any():
                    rows, longer = row[away], codes[away] | (lengths[away] + 1) << _SYMBOLS
                    order = np.lexsort((longer, rows))
                    rows, longer = rows[order], longer[order]
                    new = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]) | (longer[1:] != longer[:-1])))
                    rest.append((rows[new], longer[new], np.diff(np.append(new, len(rows)))))
                    logs[away] = 0
            out += np.bincount(row, weights=logs, minlength=len(lists))
        return out, rest


def grow(grams: DataFrame, least_gain: float = LEAST_GAIN, cells: int = CELLS) -> Tree:
    """grams: code, n of strings of DEPTH + 1 symbols. The part of the tree that travels."""
    return plant(grams, least_gain, cells)[0]


def plant(grams: DataFrame, least_gain: float = LEAST_GAIN, cells: int = CELLS) -> tuple[Tree, DataFrame | None]:
    """The nodes of the highest counts, and length, node, logs of all others, if there are any."""
    mask = lambda length: (1 << 8 * length) - 1
    levels = [grams.select(F.shiftright("code", 8).alias("ctx"), F.col("code").bitwiseAND(255).cast("int").alias("sym"), "n")]
    for length in range(DEPTH - 1, -1, -1):
        levels.append(materialise(levels[-1].groupBy(F.col("ctx").bitwiseAND(F.lit(mask(length))).alias("ctx"), "sym").agg(F.sum("n").alias("n")), "pst-level"))
    levels.reverse()
    gains = []
    for length in range(1, DEPTH + 1):
        whole = lambda df: df.withColumn("total", F.sum("n").over(W.partitionBy("ctx")))
        child = whole(levels[length]).withColumn("suffix", F.col("ctx").bitwiseAND(F.lit(mask(length - 1))))
        parent = whole(levels[length - 1]).select(F.col("ctx").alias("suffix"), F.col("sym"), F.col("n").alias("p_n"), F.col("total").alias("p_total"))
        gain = F.sum(F.col("n") * F.log(F.col("n") * F.col("p_total") / (F.col("total") * F.col("p_n"))))
        gains.append(child.join(parent, ["suffix", "sym"]).groupBy("ctx").agg(gain.alias("gain")).filter(F.col("gain") >= least_gain).select(F.lit(length).alias("length"), "ctx"))
    kept = materialise(reduce(DataFrame.union, gains), "pst-gains")
    symbols = sorted(r["sym"] for r in levels[0].select("sym").collect())  # at most 256
    closed = kept
    for drop in range(1, DEPTH):
        shorter = kept.filter(F.col("length") > drop).withColumn("length", F.col("length") - drop)
        narrow = F.lit(0).cast("long")
        for length in range(1, DEPTH):
            narrow = F.when(F.col("length") == length, F.col("ctx").bitwiseAND(F.lit(mask(length)))).otherwise(narrow)
        closed = closed.union(shorter.select("length", narrow.alias("ctx")))
    closed = materialise(closed.distinct(), "pst-closed")
    part = lambda df, length: df.filter(F.col("length") == length).select("ctx")
    of = lambda df, length: levels[length].join(part(df, length), "ctx", "left_semi")
    retained = materialise(reduce(DataFrame.union, [of(closed, k).groupBy("ctx").agg(F.sum("n").alias("n")).select(F.lit(k).alias("length"), "ctx", "n") for k in range(1, DEPTH + 1)]), "pst-nodes")
    # a suffix has the count of its extensions at least, so suffixes of what travels travel
    cut = least_count(retained, max(1, cells // (len(symbols) + 1)))
    near = F.lit(False) if cut is None else F.col("n") >= cut
    rows = reduce(DataFrame.union, [of(retained.filter(near), k).select(F.lit(k).alias("length"), "ctx", "sym", "n") for k in range(1, DEPTH + 1)])
    found = rows.toArrow()
    root = levels[0].toArrow()
    column = np.full(256, len(symbols), np.int32)
    column[symbols] = np.arange(len(symbols))
    keys, nodes = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
    base = np.ones(len(symbols) + 1)
    base[column[root["sym"].to_numpy()]] += root["n"].to_numpy()
    length_of, ctx, sym, n = (found[c].to_numpy() for c in ("length", "ctx", "sym", "n"))
    del found
    places = [np.flatnonzero(length_of == length) for length in range(1, DEPTH + 1)]
    keys += [np.unique(ctx[at]) for at in places]
    logs = np.empty((1 + sum(map(len, keys)), len(symbols) + 1), np.float32)  # probabilities until all levels are done
    logs[0] = base / (base[:-1].sum() + 256 - len(symbols))
    start, above = 1, 0  # the first nodes of the level and of the one above
    for length, at in enumerate(places, 1):
        contexts = keys[length]
        at = at[np.argsort(ctx[at], kind="stable")]
        edges = np.searchsorted(ctx[at], contexts)
        for low in range(0, len(contexts), _ROWS):  # a bounded part at a time, so the table has no copies
            some = contexts[low : low + _ROWS]
            own = at[edges[low] : edges[low + _ROWS] if low + _ROWS < len(contexts) else len(at)]
            counts = np.zeros((len(some), len(symbols) + 1), np.float32)
            counts[np.searchsorted(some, ctx[own]), column[sym[own]]] = n[own]
            kinds, total = (counts > 0).sum(1, keepdims=True, dtype=np.float32), counts.sum(1, keepdims=True, dtype=np.float32)
            parents = np.zeros(len(some), np.int64) if length == 1 else above + np.searchsorted(keys[length - 1], some & mask(length - 1))
            logs[start + low : start + low + len(some)] = (counts + kinds * logs[parents]) / np.maximum(total + kinds, 1)
        nodes.append(np.arange(start, start + len(contexts), dtype=np.int32))
        start, above = start + len(contexts), start
    lengths = np.repeat(np.arange(DEPTH + 1), [1, *map(len, keys[1:])])
    tree = Tree(keys, nodes, column, np.log10(logs, out=logs), lengths)
    del length_of, ctx, sym, n, places
    give_back()
    far = retained.filter(~near)
    if far.isEmpty():
        return tree, None
    edge = far.select((F.col("length") - 1).alias("length"), F.expr("ctx & (shiftleft(1L, 8 * (length - 1)) - 1)").alias("ctx"), F.expr("shiftright(ctx, 8 * (length - 1))").cast("int").alias("before"))
    root_or_near = retained.filter(near).select("length", "ctx").union(edge.sparkSession.range(1).select(F.lit(0).alias("length"), F.col("id").alias("ctx")))
    tree.outside = np.zeros((start, 32), np.uint8)
    for r in edge.join(root_or_near, ["length", "ctx"], "left_semi").groupBy("length", "ctx").agg(F.collect_set("before").alias("before")).toLocalIterator():  # at most a row per node that travels
        node = nodes[r["length"]][np.searchsorted(keys[r["length"]], r["ctx"])] if r["length"] else 0
        for symbol in r["before"]:
            tree.outside[node, symbol >> 3] |= 128 >> (symbol & 7)
    return tree, _tabled(tree, [of(far, k) for k in range(1, DEPTH + 1)])


def _tabled(tree: Tree, levels: list[DataFrame]) -> DataFrame:
    """length, node, logs of the nodes whose ctx, sym, n are in levels, smoothed like those of the tree."""
    shared = levels[0].sparkSession.sparkContext.broadcast(tree)
    done: list[DataFrame] = []
    for length, level in enumerate(levels, 1):

        def run(batches: Iterator[pa.RecordBatch], length: int = length) -> Iterator[pa.RecordBatch]:
            tree = shared.value
            for batch in batches:
                k, width = len(batch), tree.logs.shape[1]
                pairs = batch.column(2)
                row = np.repeat(np.arange(k), pairs.value_lengths().to_numpy())
                sym, n = (x.to_numpy(zero_copy_only=False) for x in pairs.flatten().flatten())
                counts = np.zeros((k, width))
                counts[row, tree.column[sym]] = n
                kinds, total = (counts > 0).sum(1, keepdims=True), counts.sum(1, keepdims=True)
                suffix = batch.column(1).to_numpy()
                at = np.zeros(k, np.int64) if length == 1 or not len(tree.keys[length - 1]) else tree.nodes[length - 1][np.minimum(np.searchsorted(tree.keys[length - 1], suffix), len(tree.keys[length - 1]) - 1)]
                parent = tree.logs[at].astype(np.float64)
                tabled = batch.column(3)
                if tabled.null_count < k:
                    parent[tabled.is_valid().to_numpy(zero_copy_only=False)] = tabled.drop_null().flatten().to_numpy().reshape(-1, width)
                logs = np.log10((counts + kinds * 10.0**parent) / (total + kinds)).astype(np.float32)
                offsets = pa.array(np.arange(k + 1) * width, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, length, np.int32)), batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(logs.ravel()))], names=["length", "node", "logs"])

        some = level.groupBy("ctx").agg(F.collect_list(F.struct("sym", "n")).alias("pairs")).withColumn("suffix", F.col("ctx").bitwiseAND(F.lit((1 << 8 * (length - 1)) - 1)))
        if done:
            some = some.join(done[-1].select(F.col("node").alias("suffix"), "logs"), "suffix", "left")
        else:
            some = some.withColumn("logs", F.lit(None).cast("array<float>"))
        done.append(materialise(map_batches(some.select("ctx", "suffix", "pairs", "logs"), run, "length int, node bigint, logs array<float>"), "pst-table"))
    return reduce(DataFrame.union, done)


def _looked_up(away: DataFrame, table: DataFrame, column: np.ndarray) -> DataFrame:
    """row, away_score of the positions (row, code, times) by the longest of their suffixes in the table."""
    node = "ctx & (shiftleft(1L, 8 * length) - 1)"
    parts = away.select("row", "times", F.expr(f"shiftright(code, {_SYMBOLS})").cast("int").alias("least"), F.expr(f"shiftright(code & {(1 << _SYMBOLS) - 1}L, 8)").alias("ctx"), F.get(F.array(*[F.lit(int(c)) for c in column]), F.col("code").bitwiseAND(255).cast("int")).alias("place"))
    tried = parts.select("ctx", "least").distinct().select("ctx", F.explode(F.sequence("least", F.lit(DEPTH))).alias("length")).withColumn("node", F.expr(node))
    longest = materialise(tried.join(table.select("length", "node"), ["length", "node"]).groupBy("ctx").agg(F.max("length").alias("length")), "pst-longest")
    found = parts.join(longest, "ctx").withColumn("node", F.expr(node)).join(table, ["length", "node"])
    return found.select("row", (F.col("times") * F.get("logs", F.col("place")).cast("double")).alias("s")).groupBy("row").agg(F.sum("s").alias("away_score"))


def least_count(counted: DataFrame, most: int) -> int | None:
    """The least count that at most `most` rows reach; counts are compared by their six leading bits.

    A sum per such bin decides it, so no task sorts or holds the vocabulary.
    """
    unit = F.pow(F.lit(2.0), F.greatest(F.length(F.bin("n")) - 6, F.lit(0))).cast("long")
    bins = counted.groupBy((F.col("n") - F.col("n") % unit).alias("least")).agg(F.count("*").alias("k")).collect()
    cut, total = None, 0
    for r in sorted(bins, key=lambda r: -r["least"]):
        total += r["k"]
        if total > most:
            break
        cut = r["least"]
    return cut


def frequent(words: DataFrame, most: int) -> DataFrame:
    """The words over the least count that at most `most` words reach."""
    cut = least_count(words, most)
    return words.filter(F.lit(False) if cut is None else F.col("n") >= cut)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None, least_gain: float = LEAST_GAIN, cells: int = CELLS, hot_words: int = HOT_WORDS) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    out_of = is_held_out(F.col(id_col)) if held_out is None else held_out
    counts = materialise(corpus_counts(docs.filter(~out_of).select(text_col)), "lm-counts")
    words = counts.filter("kind = 0").select(F.col("code").alias("word"), "n")
    sizes = counts.agg(F.sum(F.when(F.col("kind") == 2, F.col("n"))).alias("ends"), F.sum(F.when(F.col("kind") == 0, F.col("n"))).alias("words"), F.count(F.when(F.col("kind") == 0, 1)).alias("distinct")).first()
    ends = sizes["ends"] or 0
    tokens, vocabulary = (sizes["words"] or 0) + ends, sizes["distinct"] + (ends > 0)
    tree, table = plant(counts.filter("kind = 1").select("code", "n"), least_gain, cells)
    hot = frequent(words, hot_words).toArrow()  # at most hot_words rows of 16 bytes
    hot_keys, hot_logs = hot["word"].to_numpy(), np.log10(hot["n"].to_numpy() + 1.0)
    shared = spark.sparkContext.broadcast((tree, hot_keys, hot_logs))
    end_log = float(np.log10(ends + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, hot_keys, hot_logs = shared.value
        index, hot_index, hashes = tree.prepare(), pd.Index(hot_keys), _WordHashes()
        next_row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for first, some in _chunks(batch.column(1).to_pylist()):
                k = len(some)
                rows = np.arange(next_row, next_row + k)
                next_row += k
                lengths = np.fromiter(map(len, some), np.int64, k)
                flat = np.fromiter((hashes[w] for words in some for w in words), np.int64, int(lengths.sum()))
                owner = np.repeat(np.arange(k), lengths)
                at = hot_index.get_indexer(flat)
                known = at >= 0
                base = np.bincount(owner[known], weights=hot_logs[at[known]], minlength=k) + end_log
                n_known = np.bincount(owner[known], minlength=k) + (ends > 0)
                part = batch.slice(first, k)
                scores, away = tree.walk(some, index)
                for row, code, times in away:
                    m = len(row)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rows[row]), pa.nulls(m, pa.int64()), pa.array(code), pa.array(times), pa.nulls(m, part.column(0).type), *[pa.nulls(m, t) for t in (pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]], names=names
                    )
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), part.column(0), part.column(2), pa.array(lengths + 1), pa.array(n_known.astype(np.int64)), pa.array(base), pa.array(scores)], names=names
                )
                if not known.all():
                    order = np.lexsort((flat[~known], owner[~known]))
                    o, h = owner[~known][order], flat[~known][order]
                    new = np.flatnonzero(np.append(True, (o[1:] != o[:-1]) | (h[1:] != h[:-1])))
                    times = np.diff(np.append(new, len(o)))
                    m = len(new)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rows[o[new]]), pa.array(h[new]), pa.nulls(m, pa.int64()), pa.array(times), pa.nulls(m, part.column(0).type), *[pa.nulls(m, t) for t in (pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]], names=names
                    )

    names = ["row", "word", "code", "times", "id", "held_out", "n_tokens", "n_known", "base", "score"]
    kind = dict(docs.dtypes)[id_col]
    scored = materialise(map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col), out_of.alias("out")), run, f"row bigint, word bigint, code bigint, times bigint, id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base double, score double"), "lm-scored")
    rare = scored.filter("word is not null").select("row", "word", "times").join(words, "word")
    rest = rare.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("rare_base"), F.sum("times").alias("rare_known"))
    joined = scored.filter("word is null and code is null").join(rest, "row", "left")
    whole = F.col("score")
    if table is not None:
        joined = joined.join(_looked_up(scored.filter("code is not null").select("row", "code", "times"), table, tree.column), "row", "left")
        whole += F.coalesce("away_score", F.lit(0.0))
    scale = float(np.log10(tokens + vocabulary + 1))
    return joined.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0)) - F.col("n_tokens") * F.lit(scale)).alias("base_score"), whole.alias("score"),
    )
