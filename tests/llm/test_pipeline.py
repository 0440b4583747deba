"""The pipeline's stages against brute force, each on its own input."""

import sys

import corpus_pipeline
from lexmill.llm import mixing, queries
from lexmill.llm import secret_scan as S
from tests.llm.fixtures import DATA, awkward, empty
from tests.llm.test_documents import brute_kept, brute_measures
from tests.llm.test_pairs_and_packs import brute_components, check_packing


def test_stages(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "jaccard_join", "secret_scan", "mixing", "packing"]
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = sorted(map(tuple, docs.collect()))
    columns = docs.columns
    at = {c: i for i, c in enumerate(columns)}

    good = stages["quality_rules"](spark, docs, DATA)
    kept = brute_kept([((r[at["lang"]], r[at["source"]]), brute_measures(r[at["text"]])) for r in rows])
    assert good.columns == columns and sorted(map(tuple, good.collect())) == [r for r, k in zip(rows, kept, strict=True) if k]

    rows = sorted(map(tuple, good.collect()))
    alone = stages["jaccard_join"](spark, good, DATA)
    first = {d for d, _, c in brute_components([(r[at["doc_id"]], r[at["text"]]) for r in rows], 80, 5) if d == c}
    assert alone.columns == columns and sorted(map(tuple, alone.collect())) == [r for r in rows if r[at["doc_id"]] in first]

    rows = sorted(map(tuple, alone.collect()))
    clean = stages["secret_scan"](spark, alone, DATA)
    got = sorted(map(tuple, clean.collect()))
    assert clean.columns == columns and [r[at["doc_id"]] for r in got] == [r[at["doc_id"]] for r in rows]
    for before, after in zip(rows, got, strict=True):
        assert after[at["text"]] == S.redact_text(before[at["text"]]) and after[at["n_chars"]] == len(after[at["text"]])

    mixed = stages["mixing"](spark, clean, DATA)
    copies = {r.doc_id: r.copies for r in mixing.plan_mix(clean, queries.MIX, queries.domain()).collect()}
    assert mixed.columns == columns and sorted(map(tuple, mixed.collect())) == sorted(r for r in got for _ in range(copies[r[at["doc_id"]]]))

    packed = stages["packing"](spark, mixed.coalesce(1), DATA).collect()
    texts = {r.doc_id: r.text for r in mixed.collect()}
    assert check_packing(packed, {(d, c): texts[d] for d, n in copies.items() for c in range(n)}, queries.tokenizer_path()) < 0.02
    assert sum(r.doc_tokens for r in packed if r.start == 0) == sum(r.length for r in packed)


def test_awkward_rows_pass_every_stage(spark):
    """Nulls, repeats and clashing columns go through the stages one after the other."""
    docs = awkward(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        rows = out.collect()
        assert rows and (name == "packing" or out.columns == docs.columns), name
        docs = spark.createDataFrame(rows, out.schema)
    assert all(r.length > 0 for r in rows)


def test_run_writes_and_rereads_every_stage(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert out.count() > 0 and set(out.columns) >= {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}


def test_empty_tables(spark):
    docs = empty(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        assert out.count() == 0, name


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names) and "corpus_pipeline" in sys.modules
