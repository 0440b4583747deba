"""Licence and secret scans against whole-text searches."""

import hashlib
import re
import zlib

import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from lexmill.llm import license_scan as L
from lexmill.llm import queries
from lexmill.llm import secret_scan as S
from tests.llm.fixtures import DATA, awkward, awkward_rows, empty

ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute_secrets(text):
    text = text or ""
    spans = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    spans += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(spans, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["password", "passwd", "Secret", "TOKEN", "api_key", "apikey", "api", "_", "key", ":", "=", " ", '"', "'", "AKIA", "ABCDEFGH12345678", "akia", "0123456789abcdef", "deadbeef", "é", "漢", "x", "-", "\n", "ſecret"]), max_size=30).map("".join))
def test_anchored_scan_equals_search_of_the_whole_text(text):
    assert [s for s in S.scan_text(text) if s[0] in ("assign", "access", "hex")] == brute_secrets(text)


def test_checksums():
    body = b"0123456789abcdefghijABCDEFGHIJ"
    value, digits = zlib.crc32(body), b""
    for _ in range(6):
        value, d = divmod(value, 62)
        digits = S.BASE62[d : d + 1] + digits
    good = "x ghp_" + (body + digits).decode() + " y"
    assert ("github", 2, 42) in S.scan_text(good)
    assert not [s for s in S.scan_text(good.replace("ghp_0", "ghp_1")) if s[0] == "github"]
    assert S.scan_text("-----BEGIN RSA PRIVATE KEY-----") == [("pem", 0, 31)]


def test_redaction():
    assert S.redact_text("a password=hunter2hunter2 b") == "a [SECRET] b"
    assert S.redact_text(None) is None and S.redact_text("nothing") == "nothing"
    text = "secret=" + "0123456789abcdef" * 2
    assert S.redact_text(text) == "[SECRET]"


def test_secret_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = queries.op10_secret_scan(spark, DATA).collect()
    assert len(rows) == len(docs)
    for r in rows:
        spans = brute_secrets(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(joined(spans).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[0] == k for s in spans) for k in ("assign", "access", "hex")]
        assert set(joined(spans).split(",")) - {""} <= set(r.spans.split(","))


def test_secret_awkward(spark):
    assert S.digest(S.find_secrets(awkward(spark))).count() == len(awkward_rows())
    assert S.find_secrets(empty(spark)).count() == 0
    out = S.redact_secrets(awkward(spark), chars_col="n_chars")
    assert out.columns == awkward(spark).columns and out.count() == len(awkward_rows())
    assert S.redact_secrets(empty(spark), chars_col="n_chars").count() == 0
    again = S.find_secrets(out).filter("size(spans) > 0")
    assert again.count() == 0


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_base(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    places = [(i, x.label) for x in L.BASE for i in range(len(words)) if words[i : i + len(x.phrase.split())] == x.phrase.split()]
    return len(words), places


def test_license_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = queries.op1_license_scan(spark, DATA).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, places = brute_base(docs[r.doc_id])
        assert (r.n_words, r.n_base) == (n, len(places))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
        assert not places or r.score == 1


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_seeds_lose_no_match(data):
    notice = data.draw(st.sampled_from(L.NOTICES))
    phrase = list(notice.phrase)
    for _ in range(data.draw(st.integers(0, notice.edits + 1))):
        i = data.draw(st.integers(0, len(phrase) - 1))
        change = data.draw(st.sampled_from("xdi"))
        phrase[i : i + (change != "i")] = [] if change == "d" else [data.draw(st.sampled_from("abz"))]
    text = "some words " + "".join(phrase) + " more words"
    scanner = L.Scanner((), (notice,))
    whole = L.normalise(text).decode()
    limit = f"{{e<={notice.edits}}}" if notice.edits else ""
    there = regex.search(rf"(?<![^ ])(?:{regex.escape(notice.phrase)}){limit}(?![^ ])", whole)
    assert bool(scanner.scan(text)[1]) == bool(there)


def test_license_edits_and_awkward(spark):
    spans = L.Scanner().scan("under the GNU Generel Publik License.")[1]
    assert [(s[0], s[1], s[3]) for s in spans] == [("gpl", 2, 2)]
    assert L.digest(L.scan_licenses(awkward(spark))).count() == len(awkward_rows())
    assert L.scan_licenses(empty(spark)).count() == 0


def test_a_better_notice_hides_no_other():
    for text, want in (("mozila public license mozilla public license", [(0, 3, 1), (3, 6, 0)]), ("mozilla public license mozila public license", [(0, 3, 0), (3, 6, 1)]), ("mozila public license mozilla public license mozila public license", [(0, 3, 1), (3, 6, 0), (6, 9, 1)])):
        spans = L.Scanner((), tuple(x for x in L.NOTICES if x.phrase == "mozilla public license")).scan(text)[1]
        assert [s[1:4] for s in spans] == want


def test_repetitive_texts_are_scanned_in_linear_time():
    import time

    scanner = L.Scanner()
    for text, n in (("all rights reservd " * 55_000, 55_000), ("mitlicence" * 100_000, 0), ("gnu generel public license mozila public license " * 10_000, 20_000)):
        began = time.time()
        assert len(scanner.scan(text)[1]) == n and time.time() - began < 10


def test_every_notice_of_a_text_is_reported():
    assert [s[:4] for s in L.Scanner().scan("mozila public license words mozilla public license")[1]] == [("mpl", 0, 3, 1), ("mpl", 4, 7, 0)]
    assert [s[:4] for s in L.Scanner().scan("gnu generel public license then gnu general public license")[1]] == [("gpl", 0, 4, 1), ("gpl", 5, 9, 0)]
