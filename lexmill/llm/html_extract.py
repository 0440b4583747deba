"""HTML extraction by consensus: pages score their containers, hosts vote on paths, winning paths extract anew.

A page is read into containers (body, main, article, section, div, table cells ...), each with its path of tags and
generalised classes (digits become #). Menus, headers outside the article, footers, sidebars, notices, adverts, forms,
scripts, styles and reader comments are left out, by tag or by boilerplate words in class, id or role; inside an article
a name must consist of such words and words that say nothing: "social-links" is out, "social-history" is not. A container's score
is its remaining text less that of its links; a page votes for its deepest container that holds four fifths of the
best score, and on every piece of text that stands beside it, in one of the containers around it: headings, paragraphs,
inner containers, each by its path. A page keeps a piece whose text is mostly outside links, if it is no container, or
one of mostly headings, or one of a quarter of the voted container's text, or one before it in the same parent or article.

Votes are summed per host and path in Spark: a host's winning path is the one of most pages, and the pieces that go with
it are those that most of its pages which have them keep, unless their text is the same on most of these pages. Each page
is then read again: the containers on its host's winning path and the winning pieces beside them, in page order, and
nothing else. A page without the winning path is read by its own vote: its best container, up to the smallest one around
it that holds all text outside links of the article (the outermost article or main element around it, else the page).

Null or empty html: empty text. Null url: pages without a host vote together. Ties of votes go to the smaller path;
pages that repeat vote and are read each. Pages of any length and depth are read whole. Hosts are joined without
gathering a hot host in one task. Empty table: no rows. Only id, url and html are read, so other columns may have any
names.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import join_lookup, map_batches, materialise

# Tags by role, words of class, id or role that mark boilerplate, and words that say nothing beside them.
CONTAINERS = frozenset("html body main article section div td blockquote details dd center table tbody tr".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt pre hr br th thead tfoot caption figure figcaption address header footer nav aside form fieldset summary option".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg math iframe object canvas select".split())
DROPPED = frozenset("nav footer aside form button menu dialog input label fieldset audio video map head".split())
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs header masthead topbar toolbar footer comment comments commentlist disqus replies reply respond notice notices cookie cookies consent gdpr "
    "alert popup modal overlay share sharing social related recommended recommendations newsletter subscribe subscription signup login widget widgets pagination pager skip complementary contentinfo".split()
)
PLAIN = frozenset(
    "area article bar block blog body bottom box btn button buttons col column container content entry entries fixed float footer form global group header holder icon icons inner item items js layout left link links list main module outer page pages panel "
    "post posts primary reader right row secondary section site small sticky story text title top user view wrap wrapper zone".split()
)
HEADINGS = frozenset("h1 h2 h3".split())
CLOSES_P = frozenset("p div ul ol dl table section article aside header footer nav form h1 h2 h3 h4 h5 h6 pre blockquote hr main figure address".split())
SAME_CLOSES = frozenset("p li dt dd tr td th option".split())

# A quote that never closes opens no value, and its tag ends at the next ">"; each kind of quote fails so once a page.
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*+(?:"[^"]*+"|'[^']*+')|[^>])*+)>|<[!?][^>]*>|[^<]+|<""", re.S)
_MARK = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_DIGITS = re.compile(r"\d+")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Box:
    """A container: its path, its pieces of text (text, in a link, block tag) and inner boxes in page order, and its score."""

    __slots__ = ("path", "parts", "chars", "links", "solid", "heads", "depth", "parent")

    def __init__(self, path: str, parent: Box | None = None):
        self.path, self.parent, self.depth, self.parts = path, parent, parent.depth + 1 if parent else 0, []
        self.chars = self.links = self.solid = self.heads = 0

    def tag(self) -> str:
        return self.path.rpartition("/")[2].partition(".")[0]

    def totals(self) -> None:
        self.chars = self.links = self.solid = self.heads = 0  # solid: outside links, without space around
        for x in self.parts:
            if isinstance(x, Box):
                self.chars += x.chars
                self.links += x.links
                self.solid += x.solid
                self.heads += x.heads
            elif x is not None:
                self.chars += len(x[0])
                self.links += len(x[0]) * x[1]
                self.solid += 0 if x[1] else len(x[0].strip())
                self.heads += len(x[0].strip()) if x[2] in HEADINGS else 0

    def text(self) -> str:
        return joined(self.parts)


def joined(parts: list) -> str:
    """The text of pieces and boxes, blocks and white space as one space."""
    out: list[str] = []
    stack = [iter(parts)]
    while stack:
        for x in stack[-1]:
            if isinstance(x, Box):
                out.append(" ")
                stack.append(iter(x.parts))
                break
            out.append(" " if x is None else x[0])
        else:
            stack.pop()
            out.append(" ")
    return " ".join(entities.unescape("".join(out)).split())


def _boilerplate(tag: str, marks: dict[str, str], inside: bool) -> bool:
    if tag in DROPPED or tag == "header" and not inside:
        return True
    if tag in ("body", "html", "main", "article"):
        return False
    for name in " ".join(marks.values()).split():
        words = {w.lower() for w in _PART.findall(name)}
        if (marked := words & WORDS) and not (inside and (marked == {"header"} or not words <= WORDS | PLAIN)):
            return True
    return False


def parse(page: str) -> list[Box]:
    """All containers of a page, outermost first; the first is the page itself."""
    root = Box("")
    boxes = [root]
    open_tags: list[tuple[str, bool, Box, str]] = []  # tag, dropped, the box that its text goes to, the block in that box
    raw: re.Pattern | None = None
    at, end = 0, len(page)
    links = dropped = articles = 0

    def pop() -> None:
        nonlocal links, dropped, articles
        tag, drop, *_ = open_tags.pop()
        links -= tag == "a"
        dropped -= drop
        articles -= tag in ("article", "main")

    while at < end:
        if raw is not None:
            match = raw.search(page, at)
            at, raw = (match.end() if match else end), None
            continue
        match = _TOKEN.match(page, at)
        at = match.end()
        name = match[2]
        box = open_tags[-1][2] if open_tags else root
        if not name:
            text = match[0]
            if not dropped and (text[0] != "<" or text == "<"):
                box.parts.append((text, links > 0, open_tags[-1][3] if open_tags else ""))
            continue
        tag, closing, rest = name.lower(), match[1], match[3]
        if closing:
            if any(x[0] == tag for x in open_tags):
                while open_tags[-1][0] != tag:
                    pop()
                pop()
                if tag in BLOCKS and not dropped:
                    (open_tags[-1][2] if open_tags else root).parts.append(None)
            continue
        if tag in RAW:
            if not rest.endswith("/"):
                raw = re.compile(rf"</{re.escape(tag)}[^>]*>", re.I)
            continue
        if tag in CLOSES_P or tag in SAME_CLOSES:
            for i in range(len(open_tags) - 1, -1, -1):
                inner = open_tags[i][0]
                if inner == "p" and tag in CLOSES_P or inner == tag and tag in SAME_CLOSES:
                    while len(open_tags) > i:
                        pop()
                    break
                if inner in CONTAINERS or inner in ("ul", "ol", "table"):
                    break
            box = open_tags[-1][2] if open_tags else root
        if tag in BLOCKS and not dropped:
            box.parts.append(None)
        if tag in VOID or rest.endswith("/") and tag not in CONTAINERS:
            continue
        marks = {k.lower(): v.strip("\"'") for k, v in _MARK.findall(rest)} if rest else {}
        drop = dropped > 0 or _boilerplate(tag, marks, articles > 0)
        if tag in CONTAINERS and not drop:
            classes = ".".join(sorted(_DIGITS.sub("#", c) for c in set(marks.get("class", "").lower().split())))
            inner_box = Box(f"{box.path}/{tag}{'.' + classes if classes else ''}", box)
            box.parts.append(inner_box)
            boxes.append(inner_box)
            box = inner_box
        block = tag if tag in BLOCKS and tag not in CONTAINERS else open_tags[-1][3] if open_tags and open_tags[-1][2] is box else ""
        open_tags.append((tag, drop, box, block))
        links += tag == "a"
        dropped += drop
        articles += tag in ("article", "main")
    for x in reversed(boxes):
        x.totals()
    return boxes


def best(boxes: list[Box]) -> Box:
    """The deepest container with four fifths of the best score; the first in page order of such."""
    scores = [x.chars - 2 * x.links for x in boxes]
    top = max(scores)
    good = [x for x, s in zip(boxes, scores, strict=True) if s >= 0.8 * top]
    return max(good, key=lambda x: x.depth) if top > 0 else boxes[0]


def article_of(box: Box) -> Box:
    """The outermost article or main element around a box, or the page."""
    found = None
    while box.parent:
        if box.tag() in ("article", "main"):
            found = box
        box = box.parent
    return found or box


def whole(found: list[Box]) -> list[Box]:
    """The boxes, those of an article that hold less than its text outside links by the smallest box that holds it."""
    articles: dict[int, tuple[Box, list[Box]]] = {}
    for x in found:
        article = article_of(x)
        articles.setdefault(id(article), (article, []))[1].append(x)
    out: list[Box] = []
    for article, inside in articles.values():
        if sum(x.solid for x in inside) < article.solid:
            box = inside[0]
            while box.solid < article.solid:
                box = box.parent
            inside = [box]
        out += inside
    return out


def pieces(box: Box) -> list[tuple[str, list]]:
    """What stands directly in a container: the path of each inner container or run of blocks of one tag, and its parts."""
    out: list[tuple[str, list]] = []
    for x in box.parts:
        if isinstance(x, Box):
            out.append((x.path, [x]))
        elif x is not None:
            path = f"{box.path}|{x[2]}"
            if not out or out[-1][0] != path:
                out.append((path, []))
            out[-1][1].append(x)
        elif out and not isinstance(out[-1][1][-1], Box):
            out[-1][1].append(None)
    return out


def beside(chosen: Box) -> list[tuple[str, bool, str]]:
    """Path, whether the page keeps it, and text of every piece in the containers around a box, not in it."""
    found, inner, box = [], chosen, chosen.parent
    while box is not None:
        near = box is chosen.parent or article_of(box).tag() in ("article", "main")
        early = near
        for path, parts in pieces(box):
            if parts[0] is inner or path == chosen.path:
                early = early and parts[0] is not inner
                continue
            whole_piece = Box(path)
            whole_piece.parts = parts
            whole_piece.totals()
            text = joined(parts)
            if text:
                large = not isinstance(parts[0], Box) or early or 2 * whole_piece.heads >= whole_piece.solid or 4 * whole_piece.solid >= chosen.solid
                found.append((path, large and 5 * whole_piece.links <= whole_piece.chars, text))
        inner, box = box, box.parent
    return found


def kept_text(root: Box, path: str, also: frozenset[str]) -> str:
    """The text of the containers on a path and of the winning pieces around them, in page order."""
    parts: list = []
    stack = [iter([(root.path, [root])])]
    while stack:
        for at, some in stack[-1]:
            if at == path or at in also:
                parts += [None, *some, None]
            elif isinstance(some[0], Box) and path.startswith(f"{at}/"):
                stack.append(iter(pieces(some[0])))
                break
        else:
            stack.pop()
    return joined(parts)


def extract_text(page: str | None, path: str | None, also: frozenset[str] = frozenset()) -> str:
    """The text on a host's winning path and of its winning pieces, or around the page's best container if it lacks the path."""
    if not page:
        return ""
    boxes = parse(page)
    if path is not None and any(x.path == path and x.chars for x in boxes) and (text := kept_text(boxes[0], path, also)):
        return text
    return " ".join(t for x in whole([best(boxes)]) if (t := x.text()))


def host_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))


def winning_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, path, votes, also: each host's winner and the paths of the pieces that go with it.

    Votes are counted before any shuffle; of a piece's text its digest is counted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if page:
                    chosen = best(parse(page))
                    out.append((host, chosen.path, None, None, None))
                    seen: dict[str, tuple[bool, str]] = {}
                    for piece, keep, text in beside(chosen):  # of one path in a page, kept if all are
                        before = seen.get(piece, (True, ""))
                        seen[piece] = before[0] and keep, f"{before[1]} {text}"
                    out += [(host, chosen.path, piece, keep, hashlib.md5(text.encode("utf-8", "surrogatepass")).digest()) for piece, (keep, text) in seen.items()]
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.string(), pa.string(), pa.string(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["host", "path", "piece", "keep", "digest"])

    votes = map_batches(pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col)), run, "host string, path string, piece string, keep boolean, digest binary")
    # rows of one vote in one digest are summed in the tasks, so a host or text that most pages have is few rows
    counted = materialise(votes.groupBy("host", "path", "piece", "digest").agg(F.count("*").alias("n"), F.count_if("keep").alias("kept")), "votes")
    own = counted.filter(F.col("piece").isNull()).select("host", "path", F.col("n").alias("votes"))
    ranked = own.groupBy("host").agg(F.max("votes").alias("votes"))
    winners = own.join(ranked, ["host", "votes"]).groupBy("host").agg(F.min("path").alias("path"), F.first("votes").alias("votes"))
    sums = counted.filter(F.col("piece").isNotNull()).groupBy("host", "path", "piece").agg(F.sum("n").alias("n"), F.sum("kept").alias("kept"), F.max("n").alias("same"))
    chosen = sums.filter((2 * F.col("kept") > F.col("n")) & ((F.col("n") < 3) | (2 * F.col("same") <= F.col("n"))))
    also = chosen.groupBy("host", "path").agg(F.array_sort(F.collect_set("piece")).alias("also"))
    return winners.join(also, ["host", "path"], "left").select("host", "path", "votes", F.coalesce("also", F.array().cast("array<string>")).alias("also"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text, path."""
    winners = materialise(winning_paths(pages, url_col, html_col), "paths").select("host", "path", "also")
    joined_pages = join_lookup(pages.select(F.col(id_col), F.col(url_col), F.col(html_col), host_of(F.col(url_col)).alias("host")), winners, ["host"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract_text(x, p, frozenset(a or ())) for x, p, a in zip(*[batch.column(i).to_pylist() for i in (2, 3, 4)], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), batch.column(3)], names=[id_col, url_col, "text", "path"])

    kinds = dict(pages.dtypes)
    return map_batches(joined_pages.select(id_col, url_col, html_col, "path", "also"), run, f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, path string")
