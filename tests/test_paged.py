"""Paged services: sets as partitions, an interrupted harvest that goes on at its token, deletions."""

import json
import time
from pathlib import Path

import pytest

from lexmill.sources import paged

RECORD = "<record><header{s}><identifier>{i}</identifier><datestamp>{d}</datestamp></header><metadata><dc:title>{t}</dc:title></metadata></record>"


def page(*records):
    return "<ListRecords>" + "".join(RECORD.format(i=i, d=d, t=t, s=' status="deleted"' if t is None else "") for i, d, t in records) + "</ListRecords>"


SETS = {
    "a": [page(("r1", "2024-01-01", "one"), ("r2", "2024-01-01", "two")), page(("r3", "2024-01-02", "three")), page(("r1", "2024-02-01", None)), page(("r2", "2024-03-01", "two again"))],
    "b": [page(("s1", "2024-01-01", "b one")), page(("s1", "2024-01-01", "b one, later page"))],
}


def service(folder):
    """A service over stored pages that notes every call and fails while a file says so."""

    def fetch(name, token):
        number = int(token.removeprefix("t") or 0) if token else 0
        with open(f"{folder}/calls", "a") as f:
            f.write(json.dumps([name, token]) + "\n")
        broken = Path(f"{folder}/broken")
        if broken.exists() and broken.read_text() == f"{name}{number}":
            raise ConnectionError("the service is down")
        pages = json.loads(Path(f"{folder}/pages").read_text())[name]
        return pages[number], f"t{number + 1}" if number + 1 < len(pages) else None

    Path(f"{folder}/pages").write_text(json.dumps(SETS))
    return fetch


def calls(folder):
    return [tuple(json.loads(x)) for x in Path(f"{folder}/calls").read_text().splitlines()]


def run(spark, folder, until):
    """A harvest until it fails or has written so many batches."""
    query = paged.harvest(spark, "stored_pages", ["a", "b"], f"{folder}/changes", f"{folder}/at")
    began = time.time()
    try:
        while query.isActive and time.time() - began < 90:
            done = [p.name for p in Path(f"{folder}/at/commits").glob("[0-9]*")] if Path(f"{folder}/at/commits").exists() else []
            if len(done) >= until:
                break
            time.sleep(0.2)
    finally:
        failed = query.exception()
        query.stop()
    return failed


def test_batch_reads_every_page_of_every_set(spark, tmp_path):
    paged.register(spark, "stored_pages", service(tmp_path))
    df = spark.read.format("stored_pages").option("sets", "a, b").load()
    assert df.rdd.getNumPartitions() == 2
    assert sorted((r.set, r.token, r.body) for r in df.collect()) == sorted((s, f"t{i}" if i else "", p) for s, pages in SETS.items() for i, p in enumerate(pages))
    with pytest.raises(Exception, match="sets"):
        spark.read.format("stored_pages").load().count()


def test_an_interrupted_harvest_goes_on_at_its_token(spark, tmp_path):
    paged.register(spark, "stored_pages", service(tmp_path))
    Path(f"{tmp_path}/broken").write_text("a2")
    assert run(spark, tmp_path, 99) is not None
    before = calls(tmp_path)
    assert ("a", "t2") in before and ("a", "t3") not in before and before.count(("a", "")) <= 2
    assert {r.record_id for r in paged.snapshot(spark, f"{tmp_path}/changes").collect()} >= {"r1", "r2", "r3"}
    Path(f"{tmp_path}/broken").write_text("")
    Path(f"{tmp_path}/calls").write_text("")
    assert run(spark, tmp_path, 4) is None
    after = calls(tmp_path)
    assert ("a", "t2") in after and ("a", "t3") in after and ("a", "") not in after and ("b", "") not in after
    got = {r.record_id: r.title for r in paged.snapshot(spark, f"{tmp_path}/changes").collect()}
    assert got == {"r2": ["two again"], "r3": ["three"], "s1": ["b one, later page"]}
