"""Token alignment against whole texts encoded by the libraries and all pairs of tokens by their byte ranges."""

import hashlib
from collections import Counter

import pytest

from lexmill.llm import queries
from lexmill.llm import token_alignment as A
from tests.llm.fixtures import DATA, awkward, awkward_rows, empty

PATHS = queries.tokenizer_path(), queries.tokenizer_path("piece_bpe_32k.model")


def spans(ids, spelt):
    out, at = [], 0
    for i in ids:
        out.append((i, at, at + len(spelt(i))))
        at += len(spelt(i))
    return out, b"".join(map(spelt, ids))


def brute(texts):
    """Rows of (n_a, n_b, n_groups, n_links, n_best, n_best_b, count_sum, groups_sha256)."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer, decoders

    a, b = Tokenizer.from_file(PATHS[0]), SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    assert isinstance(a.decoder, decoders.ByteLevel)
    letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(x): x for x in letters} | {chr(256 + n): x for n, x in enumerate(x for x in range(256) if x not in letters)}
    spelt_a = lambda i: bytes(shown[c] for c in a.id_to_token(i))
    spelt_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    docs = []
    for t in texts:
        (x, bytes_a), (y, bytes_b) = (spans(a.encode(f" {t}").ids, spelt_a), spans(b.encode(t), spelt_b)) if t else (([], b""), ([], b""))
        if not t or not bytes_a == bytes_b == f" {t}".encode():
            docs.append(None)
            continue
        links, first = [], 0
        for i, low, high in x:
            while y[first][2] <= low:
                first += 1
            j = first
            while j < len(y) and y[j][1] < high:
                links.append((i, y[j][0]))
                j += 1
        ends = sorted({e for *_, e in x} & {e for *_, e in y})
        groups, at, bt = [], 0, 0
        for e in ends:
            mine = []
            for side, k in ((x, at), (y, bt)):
                n = k
                while n < len(side) and side[n][2] <= e:
                    n += 1
                mine.append((n, ",".join(str(i) for i, _, _ in side[k:n])))
            (at, left), (bt, right) = mine
            groups.append(f"{left}|{right}")
        docs.append((len(x), len(y), groups, Counter(links)))
    counts = Counter(p for d in docs if d for p in d[3])
    best_a, best_b = {}, {}
    for (i, j), n in counts.items():
        best_a[i], best_b[j] = max(best_a.get(i, 0), n), max(best_b.get(j, 0), n)
    for d in docs:
        if d is None:
            yield 0, 0, 0, 0, 0, 0, 0, ""
        else:
            n_a, n_b, groups, links = d
            digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
            yield n_a, n_b, len(groups), sum(links.values()), sum(n for p, n in links.items() if counts[p] == best_a[p[0]]), sum(n for p, n in links.items() if counts[p] == best_b[p[1]]), sum(n * counts[p] for p, n in links.items()), digest


def rows_of(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.n_best_b, r.count_sum, r.groups_sha256) for r in df.collect())


ODD = ["<|endoftext|> and <s> </s><unk>", "a▁b", "  two  spaces \n end ", " ", "▁", "nb    sp", "  wide", "ﷺ ½ ﬁ Å Å", "x\x00 y", "\x1c z \x85 q", "'s don't I'LL 12 345.6", "é́ ́a", "😀 👩‍👩‍👧 x", "a b" * 5]


@pytest.mark.parametrize("pair_rows", [0, A.PAIR_ROWS])
def test_awkward_rows_and_both_joins(spark, pair_rows):
    rows = [(i, t) for i, t, *_ in awkward_rows()]
    docs = awkward(spark).select("doc_id", "text", "id", "n", "key").union(spark.createDataFrame([(100 + i, t, "i", 1, "k") for i, t in enumerate(ODD)], "doc_id long, text string, id string, n long, key string"))
    rows += [(100 + i, t) for i, t in enumerate(ODD)]
    want = sorted((i is None, i or 0, *x) for (i, _), x in zip(rows, brute([t for _, t in rows]), strict=True))
    assert rows_of(A.align(docs, *PATHS, pair_rows=pair_rows)) == want
    assert A.align(empty(spark), *PATHS, pair_rows=pair_rows).count() == 0


def test_whole_table_equals_all_pairs(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    want = sorted((i is None, i or 0, *x) for (i, _), x in zip(docs, brute([t for _, t in docs]), strict=True))
    assert rows_of(queries.op12_token_alignment(spark, DATA)) == want


def test_parts_that_are_forgotten_and_texts_in_one_part(monkeypatch):
    monkeypatch.setattr(A, "STORE", 4)
    both, whole = A.Tokenizers(*PATHS), A.Tokenizers(*PATHS)
    whole.cuts = False
    assert both.cuts
    texts = [f"w{i % 7} {i} the of {'long' * 30} " for i in range(60)]
    for some in (texts[:20], texts[20:25], texts[25:]):
        for parts, (one,) in zip(both.documents(some), whole.documents(some), strict=True):
            assert (sum(p[0] for p in parts), ";".join(p[1] for p in parts), b"".join(p[2] for p in parts)) == one
