"""Fingerprints, quality rules and HTML extraction."""

import hashlib
import re
from collections import Counter

import pytest

from lexmill.llm import fingerprint as P
from lexmill.llm import html_extract as H
from lexmill.llm import quality_rules as Q
from lexmill.llm import queries
from tests.llm.fixtures import DATA, awkward, awkward_rows, empty


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def test_fingerprint_query(spark, docs):
    rows = {r.doc_id: r for r in queries.op2_fingerprint(spark, DATA).collect()}
    order = sorted(docs)
    assert sorted(rows) == order
    by_print = {}
    for i, doc_id in enumerate(order):
        r, text, after = rows[doc_id], docs[doc_id].text or "", docs[order[(i + 1) % len(order)]].text or ""
        half = len(text) // 2
        new = text[: len(text) - half] + after[:half]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert r.fingerprint == str(P.build(text)) and r.edited_fingerprint == str(P.build(new))
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and r.near_next == P.likeness(P.build(text), P.build(after))
        assert by_print.setdefault(r.fingerprint, text) == text
        if i % 4 == 0:
            assert abs(r.near_edited - brute_likeness(text, new)) < 1e-12 and (r.edited_branches == "") == (set(paragraphs(new)) <= set(paragraphs(text)))
    assert len(by_print) == len({d.text for d in docs.values()})


def paragraphs(text):
    return re.findall(r"[^\n]*\n|[^\n]+", text)


def brute_likeness(a, b):
    """Shared sentence pieces over all, counted without a tree: what the descent must find, as equal nodes have equal leaves."""
    if a == b:
        return 1.0
    pieces = [Counter(x for p in paragraphs(t) for x in re.findall(rb"[^.!?]{1,200}[.!?]*|[.!?]+", p.encode())) for t in (a, b)]
    total = sum(map(len, map(list, (x.elements() for x in pieces))))
    return 2 * sum((pieces[0] & pieces[1]).values()) / total if total else 1.0


def test_fingerprint_tree():
    a = P.build("One. Two.\nThree!\n\nFour is here.\n")
    assert P.likeness(a, a) == 1 and P.build("").root == P.build("").root
    b = P.build("One. Two.\nThree!\n\nFive is here.\n")
    assert 0.5 < P.likeness(a, b) < 1 and P.differing(a, b) == [(len(a.sections) - 1, 0)]
    assert str(P.Tree.parse(str(a))) == str(a)
    for x, y in (("a\n", "a"), ("a.b", "a. b"), ("x", "x "), ("a\r\n", "a\n")):
        assert P.build(x).root != P.build(y).root
    assert P.likeness(P.build("q"), P.build("")) == 0 and P.likeness(P.build(""), P.build("")) == 1


def test_fingerprint_awkward(spark):
    assert P.with_edits(awkward(spark)).count() == len(awkward_rows())
    assert P.with_edits(empty(spark)).count() == 0 and P.fingerprints(empty(spark)).count() == 0
    one = P.with_edits(awkward(spark).filter("doc_id = 3")).collect()
    assert len(one) == 1 and one[0].near_next == 1


def brute_measures(text):
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(lines), sum(a == b for a, b in zip(words, words[1:], strict=False))


def test_measures(docs):
    for text in [d.text for d in docs.values()] + [r[1] for r in awkward_rows()]:
        assert Q.measure_text(text) == brute_measures(text)


def coarse(x):
    unit = 1 << max(0, x.bit_length() - 6)
    return x - x % unit


def brute_limits(rows):
    """rows: (group, measures); limits by group with the fall-back to wider groups."""
    from math import ceil, floor

    out = {}
    passing = [(g, dict(zip(Q.MEASURES, m, strict=True))) for g, m in rows if m[0] >= 20 and 100 * m[4] <= 30 * m[0]]
    for group in {g for g, _ in passing}:
        for depth in (2, 1, 0):
            some = [m for g, m in passing if g[:depth] == group[:depth]]
            if len(some) >= Q.MIN_GROUP or depth == 0:
                break
        limits = {}
        for r in Q.RULES:
            bins = sorted(coarse(floor(1_000_000 * m[r.part] / m[r.whole]) if m[r.whole] else 0) for m in some)
            sizes = sorted(coarse(m[r.whole]) for m in some)
            at = lambda x, q: x[max(1, ceil(len(x) * q)) - 1]
            limit = at(bins, r.middle) + r.spread * (at(bins, r.high) - at(bins, r.middle)) + r.slack * 1_000_000 / max(1, at(sizes, 0.5))
            limits[r.name] = min(r.ceiling, max(r.floor, floor(limit)))
        out[group] = limits
    return out


def brute_kept(rows):
    limits = brute_limits(rows)
    kept = []
    for g, m in rows:
        v = dict(zip(Q.MEASURES, m, strict=True))
        ok = m[0] >= 20 and 100 * m[4] <= 30 * m[0]
        kept.append(ok and all((1_000_000 * v[r.part] // v[r.whole] if v[r.whole] else 0) <= limits[g][r.name] for r in Q.RULES))
    return kept


@pytest.mark.parametrize("min_group", [200, 5])
def test_quality_query(spark, docs, monkeypatch, min_group):
    monkeypatch.setattr(Q, "MIN_GROUP", min_group)
    monkeypatch.setattr(Q.thresholds, "__defaults__", (Q.RULES, min_group))
    rows = {r.doc_id: r for r in queries.op3_quality_rules(spark, DATA).collect()}
    ids = sorted(docs)
    measured = [((docs[i].lang, docs[i].source), brute_measures(docs[i].text)) for i in ids]
    for i, (_, m), kept in zip(ids, measured, brute_kept(measured), strict=True):
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == m[:5]
        assert r.base_failed == (m[0] < 20 or 100 * m[4] > 30 * m[0]) and r.kept == kept


def test_limits_follow_the_data(spark):
    """On real tables no limit sits on a rail, and groups differ."""
    rows = queries.op3_quality_rules(spark, "/root/testdata/sf0.1").select(*[f"max_{r.name}" for r in Q.RULES]).distinct().collect()
    for r in Q.RULES:
        limits = {row[f"max_{r.name}"] for row in rows}
        assert len(limits) > 2 and r.floor < min(limits) and max(limits) < r.ceiling


def test_quality_keeps_good_and_drops_bad(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = [r for r in queries.op3_quality_rules(spark, "/root/testdata/sf0.01").collect() if r.doc_id in labels and not r.base_failed]
    good = [r.kept for r in rows if labels[r.doc_id] == 1]
    bad = [r.kept for r in rows if labels[r.doc_id] == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_quality_awkward(spark):
    assert Q.judge(awkward(spark)).count() == len(awkward_rows())
    kept = Q.keep_good(awkward(spark))
    assert kept.columns == awkward(spark).columns and 0 < kept.count() < len(awkward_rows())
    assert Q.judge(empty(spark)).count() == 0 and Q.keep_good(empty(spark)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body class="home">
<header><a href="/">Logo</a></header><nav><ul><li><a href="/a">A</a></ul></nav><div class="cookie-notice">We use cookies</div>
<div id="page-%d"><div class="sidebar">side text</div><div class="post-%d content"><h1>Head &amp; line</h1><p>First <b>bold</b>
 text<p>Second&nbsp;one &lt;ok&gt;<ul><li>item one<li>item two</ul><form><input value="x"><button>Go</button></form>
<div class="ad-box ads">buy</div><table><tr><td>cell a<td>cell b</table></div><div class="comments"><p>first! great post, a very long reader comment indeed</p></div></div>
<footer>foot</footer></body></html>"""


def test_extraction_of_blocks():
    want = "Head & line First bold text Second one <ok> item one item two cell a cell b"
    assert H.extract_text(PAGE % (1, 7), None) == want
    boxes = H.parse(PAGE % (1, 7))
    assert H.best(boxes).path == "/html/body.home/div/div.content.post-#"
    assert H.extract_text(PAGE % (2, 9), "/html/body.home/div/div.content.post-#") == want
    assert H.extract_text(None, None) == "" and H.extract_text("", "/x") == "" and H.extract_text("plain text", None) == "plain text"
    assert H.extract_text("<article><p>cut off <b>here", None) == "cut off here"
    assert H.extract_text("<p>a<br>b</p><p>c</p>d < e", None) == "a b c d < e"
    assert H.extract_text("<div><!-- <p>no</p> --><p title='a > b'>yes</p></div>", None) == "yes"


def test_long_attributes_and_open_quotes():
    for n in (3_000, 5_000, 300_000):
        for q in "\"'":
            assert H.extract_text(f"<div><p data-x={q}{'a' * n} > <b>leak</b>{q} id=z>text</p></div>", None) == "text"
    assert H.extract_text("<p title=\"never closed>text <b>bold</b></p>", None) == "text bold"
    assert H.extract_text("<p title = 'a > b'>it's <b>5 > 4</b></p>", None) == "it's 5 > 4"


def test_title_and_lead_beside_the_body_stay(spark):
    body, lead = "body text " * 34, "lead text " * 6
    page = "<html><body><nav>menu</nav>%s<h1>Title</h1><div class='lead'><p>" + lead + "</p></div>\n<div class='body'><p>" + body + "</p></div><div class='share'>share</div>%s<footer>foot</footer></body></html>"
    want = " ".join(f"Title {lead} {body}".split())
    for a, b in (("<article>", "</article>"), ("<div class='post'>", "</div>"), ("<main><article>", "</article></main>")):
        assert H.best(H.parse(page % (a, b))).path.endswith("/div.body")
        assert H.extract_text(page % (a, b), None) == want
    bare = "<html><body><article><div class='body'><p>" + body + "</p></div></article></body></html>"
    rows = [(i, "https://t.example/x", bare) for i in range(3)] + [(3, "https://t.example/y", page % ("<article>", "</article>"))]
    out = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[0] == body.strip() and out[3] == want


def test_hosts_agree_on_a_path(spark):
    odd = "<html><body class='home'><div><div class='content post-3'><p>short body</p></div><div class='related-x bigger'><p>" + "teaser text " * 30 + "</p></div></div></body></html>"
    rows = [(i, f"https://h.example/{i}", PAGE % (i, i)) for i in range(9)] + [(9, "https://H.example/9", odd), (10, None, "<p>no host</p>"), (11, "https://e.example/", None), (11, "https://e.example/", None)]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, path string, host string")
    out = {r.page_id: r for r in H.extract(pages).collect()}
    assert out[9].text == "short body" and out[10].text == "no host" and out[11].text == ""
    assert H.extract(pages).count() == 13 and H.extract(pages.limit(0)).count() == 0


PROSE = "The river ran past the mill and the old men watched it turn. "


def three_hosts():
    """Pages of three layouts without any word that marks boilerplate, and their main texts."""
    rows, want = [], {}
    for i in range(8):
        body, title, lead, teaser = f"Body {i}. " + PROSE * (6 + i), f"Title number {i}", f"Lead of {i}, in brief.", f"Elsewhere {i}: another story of ours."
        pages = {
            "a": f"<html><body><div class='wrap'><div class='left'>Our house has kept the same promise since 1950.</div><div class='entry'><h1>{title}</h1><p>{lead}</p><div class='body'><p>{body}</p></div><div class='teaser'>{teaser}</div></div></div></body></html>",
            "b": f"<html><body><article><h1>{title}</h1><div class='lead'>{lead}</div><div class='story-{i}'><p>{body}</p></div><div class='next'><p>{teaser}</p></div><p><a href='/x'>{teaser}</a></p></article><div class='right'>{teaser} Again.</div></body></html>",
            "c": f"<html><body><table><tr><td class='l'>Fixed words of the house.</td><td class='m'><h2>{title}</h2><p>{lead}</p><div class='t'><p>{body}</p></div></td><td class='r'>{teaser}</td></tr></table></body></html>",
        }
        for host, page in pages.items():
            want[len(rows)] = " ".join(f"{title} {lead} {body}".split())
            rows.append((len(rows), f"https://{host}.example/{i}", page))
    return rows, want


def test_the_vote_decides(spark):
    rows, want = three_hosts()
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in H.extract(pages).collect()} == want
    found = {r.host: r for r in H.winning_paths(pages).collect()}
    assert {h: r.path for h, r in found.items()} == {"a.example": "/html/body/div.wrap/div.entry/div.body", "b.example": "/html/body/article/div.story-#", "c.example": "/html/body/table/tr/td.m/div.t"}
    assert any(r.votes < 8 for r in found.values())  # pages that voted otherwise are read by their host's path too
    assert all("teaser" not in p and "next" not in p and "left" not in p and "right" not in p for r in found.values() for p in r.also)


def test_another_winner_gives_another_text():
    rows, want = three_hosts()
    page = rows[0][2]
    path, also = "/html/body/div.wrap/div.entry/div.body", frozenset({"/html/body/div.wrap/div.entry|h1", "/html/body/div.wrap/div.entry|p"})
    texts = {H.extract_text(page, p, a) for p, a in ((path, also), (path, frozenset()), ("/html/body/div.wrap/div.entry/div.teaser", frozenset()), ("/html/body/div.wrap/div.left", frozenset()), ("/html/body/div.wrap/div.entry", frozenset()), ("/html/body", frozenset()))}
    assert len(texts) == 6 and want[0] in texts


def test_pieces_are_counted_over_pages(spark):
    """A piece is in if most pages that have it keep it and its text is not the same on most of them."""
    page = "<html><body><div class='x'><p class='q'>%s</p><h2>%s</h2><div class='b'>" + PROSE * 5 + "%d</div></div></body></html>"
    rows = [(i, f"https://h.example/{i}", page % (f"own line {i}" if i % 5 < 2 else "every page says this", f"head {i}", i)) for i in range(10)]
    rows += [(i, f"https://few.example/{i}", page % ("said twice", "head", i)) for i in (20, 21)]
    found = {r.host: r.also for r in H.winning_paths(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {"h.example": ["/html/body/div.x|h2"], "few.example": ["/html/body/div.x|h2", "/html/body/div.x|p"]}


def test_deep_and_clashing_pages(spark):
    deep = "<div>" * 5000 + "<p>" + PROSE * 20 + "</p>" + "</div>" * 5000
    df = spark.createDataFrame([(1, "https://d.example/", deep, "t", 1, "p"), (2, "https://d.example/", deep, "t", 1, "p")], "page_id long, url string, html string, text string, keep int, piece string")
    assert {r.text for r in H.extract(df).collect()} == {(PROSE * 20).strip()}


def test_html_query_equals_articles(spark):
    import html
    import re

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    rows = queries.op6_html_extract(spark, DATA).collect()
    assert len(rows) == len(pages)
    for r in rows:
        body = re.search("<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        want = " ".join(html.unescape(re.sub("<[^>]+>", " ", body)).split())
        assert r.text == want and r.n_chars == len(want)


def test_html_keeps_compound_classes():
    page = """<body><article><h1>t</h1><section class="social-history">one</section><div class="social-links">x</div><p class="related-work">two</p>
    <div class="postComments">c</div><div role="complementary">y</div>three</article><div class="site-footer">z</div></body>"""
    assert H.extract_text(page, None) == "t one two three"


def test_votes_equal_a_count(spark):
    """The vote over a table against a count by hand."""
    from urllib.parse import urlsplit

    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    votes = {}
    for r in pages.collect():
        if r.html:
            votes.setdefault(urlsplit(r.url or "").hostname or "", Counter())[H.best(H.parse(r.html)).path] += 1
    want = {host: min((-n, path) for path, n in found.items()) for host, found in votes.items()}
    assert {r.host: (-r.votes, r.path) for r in H.winning_paths(pages).collect()} == want
