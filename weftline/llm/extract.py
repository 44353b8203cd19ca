"""Main text of web pages by tree scoring.

A page becomes a light tree of its block elements.  Every paragraph earns points for its
length and its commas; the points go to its parent, half of them to the grandparent, and each
container is discounted by the share of its text that stands in links.  The best container
is kept, with those of its siblings that score a fifth of it or are headings or paragraphs, or hold
some, with few links; an article element that holds it, or the parent of a list or table, takes its
place, and keeps only siblings that score a fifth or are long paragraphs.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments
never count or appear, inline ones included.  They are known by element, role or attribute, or by a
word of their class or id; a container that is known by a word alone is spared if it holds more than half of
the page's text and is also called a story, an article, a post or the like, or holds the page's
``main`` element or its first heading.

Edge cases: null or empty html, and pages without text, give an empty string; html of any length
and depth is read in time linear in it; markup that is not closed or not well nested is closed as
browsers do; of containers that score alike the first is best; a page without any scored container
gives all text outside the parts named above.  One row in, one row out, repeated rows included, and
an empty table gives none; columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import blocks, spread, table

#: Bytes of html taken at a time.
BLOCK = 4 << 20

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>|<[!?][^>]*+>?|[^<]++|<", re.S)
SPACE = re.compile(r"\s+")
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary"
    " table tbody td tfoot th thead tr ul template svg button".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = frozenset("p pre blockquote td li dd dt figcaption summary".split()) | HEADINGS
DROPPED = frozenset("head nav header footer aside form menu dialog select option template svg button fieldset object canvas".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice"
    " notices alert sidebar side sidenav aside menu menus nav navbar navigation breadcrumb breadcrumbs pager pagination footer foot masthead"
    " comment comments commentlist disqus respond reply replies discussion share sharing social related recommended newsletter subscribe"
    " subscription signup login popup modal overlay widget toolbar skip outbrain taboola".split()
)
#: Words that call a container the text itself.
TEXTS = frozenset("story article post entry content main body page text".split())
PARTS = frozenset("ul ol dl table tbody thead tfoot tr blockquote figure details".split())
#: An open element on the left ends where one on the right begins.
ENDS = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]),
    "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"]),
}
SCOPES = frozenset("ul ol table dl select article section div body".split())


KEPT, NAMED, TEXT, GONE = range(4)
#: Elements that may end where another begins, or keep it from ending those outside.
_NEAR = frozenset(["p", *ENDS]) | HEADINGS | SCOPES


def _kind(tag: str, attributes: str) -> int:
    """GONE for what never appears, NAMED for what a word of its class or id drops, TEXT if another word calls it the text."""
    if tag in DROPPED:
        return GONE
    if not attributes:
        return KEPT
    if HIDDEN.search(attributes):
        return GONE
    kind = KEPT
    for m in ATTRIBUTE.finditer(attributes):
        value = (m[2] or m[3] or m[4] or "").lower()
        if m[1].lower() == "role":
            if value.strip() in ROLES:
                return GONE
        elif tag not in ("html", "body", "article", "main"):
            words = [w for w in re.split(r"[^a-z0-9]+", value) if w]
            if any(w in NAMES for w in words) or ("header" in words and tag not in HEADINGS and tag != "div") or words == ["header"]:
                kind = TEXT if TEXTS.intersection(words) else max(kind, NAMED)
    return kind


def main_text(html: str | None) -> str:
    """The article's blocks, one a line."""
    if not html:
        return ""
    tags, parents, kinds = ["#"], [-1], [KEPT]
    text_in: list[tuple[int, str, int]] = []  # node, text, characters in links
    stack, near = [0], [0]  # open nodes, and for each the depth of the last one that _NEAR has
    n_open: dict[str, int] = {}
    away: list[tuple[str, int]] = []  # open inline elements that are dropped, and the depth they stand at
    run: list[str] = []
    linked, links = 0, 0

    def flush() -> None:
        nonlocal linked
        if run:
            said = SPACE.sub(" ", "".join(run)).strip()
            if said:
                text_in.append((stack[-1], said, min(linked, len(said))))
            run.clear()
        linked = 0

    def leave(depth: int) -> None:
        flush()
        for node in stack[depth:]:
            n_open[tags[node]] -= 1
        del stack[depth:], near[depth:]
        while away and away[-1][1] >= depth:
            away.pop()

    find, at, size = TOKEN.match, 0, len(html)
    while at < size:
        m = find(html, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            said = m[0]
            if (said[0] != "<" or said == "<") and not away:
                if "&" in said:
                    said = entities.unescape(said)
                run.append(said)
                if links:
                    linked += len(said.strip())
            continue
        tag = tag.lower()
        if m[1]:
            if tag in BLOCKS:
                if n_open.get(tag):
                    depth = len(stack) - 1
                    while tags[stack[depth]] != tag:
                        depth -= 1
                    leave(depth)
                else:
                    flush()
                continue
            if tag == "a":
                links = max(0, links - 1)
            if away and away[-1][0] == tag:
                away.pop()
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)
            at = end.end() if end else size
            continue
        if tag == "br":
            run.append(" ")
        elif tag in BLOCKS:
            flush()
            links = 0 if tag != "p" else links
            depth = near[-1]
            while depth:  # what the new block closes
                open_tag = tags[stack[depth]]
                if open_tag == "p" or open_tag in ENDS and tag in ENDS[open_tag] or open_tag in HEADINGS and tag in HEADINGS:
                    leave(depth)
                    break
                if open_tag in SCOPES:
                    break
                depth = near[depth - 1]
            if tag in VOID:
                continue
            tags.append(tag)
            parents.append(stack[-1])
            kinds.append(GONE if away else _kind(tag, m[3]))
            n_open[tag] = n_open.get(tag, 0) + 1
            near.append(len(stack) if tag in _NEAR else near[-1])
            stack.append(len(tags) - 1)
        elif tag not in VOID:
            if tag == "a":
                links = 1
            if away and away[-1][0] == tag or m[3] and _kind(tag, m[3]) != KEPT:
                away.append((tag, len(stack) - 1))
    flush()
    drop = _drops(tags, parents, kinds, text_in)
    text_in = [x for x in text_in if not drop[x[0]]]
    if not text_in:
        return ""
    n = len(tags)
    score, length, link = [0.0] * n, [0] * n, [0] * n
    for node, said, linked_here in text_in:
        length[node] += len(said)
        link[node] += linked_here
        points = min(len(said) / 100, 3.0) + said.count(",")
        if tags[node] in HEADINGS:
            points = 0.5
        elif tags[node] in PARAGRAPHS:
            points += 1
        home = parents[node] if tags[node] in PARAGRAPHS and parents[node] >= 0 else node
        points *= 1 - linked_here / len(said)
        score[home] += points
        if parents[home] > 0:
            score[parents[home]] += points / 2
    for node in range(n - 1, 0, -1):
        length[parents[node]] += length[node]
        link[parents[node]] += link[node]
    for node in range(n):
        if length[node]:
            score[node] *= 1 - link[node] / length[node]
    best = max(range(n), key=lambda x: (score[x], -x))
    if score[best] <= 0:
        return "\n".join(said for _, said, _ in text_in)
    up = best
    while up > 0:  # lists, tables and quotes are parts of a text; an article that holds the best container is the text
        up = parents[up]
        if up > 0 and tags[best] in PARTS or tags[up] in ("article", "main") and not drop[up]:
            best = up
    kept = {best}
    if best:
        least, alone = max(10.0, score[best] / 5), tags[best] in ("article", "main")
        prose = [t in HEADINGS or t == "p" for t in tags]  # headings and paragraphs, and what holds some
        for node, _, _ in text_in if not alone else ():
            while prose[node] and node and not prose[parents[node]]:
                prose[parents[node]] = True
                node = parents[node]
        for x in range(1, n):
            if parents[x] == parents[best] and x != best and not drop[x] and length[x]:
                few = link[x] / length[x] < 0.25
                if score[x] >= least or (tags[x] == "p" and length[x] > 80 and few if alone else prose[x] and few):
                    kept.add(x)
    inside = [False] * n
    for node in range(n):
        inside[node] = node in kept or parents[node] >= 0 and inside[parents[node]]
    return "\n".join(said for node, said, _ in text_in if inside[node])


def _drops(tags: list[str], parents: list[int], kinds: list[int], text_in: list[tuple[int, str, int]]) -> list[bool]:
    """Which nodes never count: those GONE, those known by name that aren't spared, and what stands in either."""
    n = len(tags)
    gone = [False] * n
    for x in range(1, n):
        gone[x] = gone[parents[x]] or kinds[x] == GONE
    if not any(k in (NAMED, TEXT) for k in kinds):
        return gone
    length, lead = [0] * n, [False] * n
    for node, said, _ in text_in:
        if not gone[node]:
            length[node] += len(said)
    first = next((x for x in range(n) if tags[x] == "h1" and not gone[x]), -1)
    for x in range(n - 1, 0, -1):
        lead[x] = lead[x] or x == first or tags[x] == "main" and not gone[x]
        lead[parents[x]] = lead[parents[x]] or lead[x]
        length[parents[x]] += length[x]
    for x in range(1, n):
        spared = 2 * length[x] > length[0] and (kinds[x] == TEXT or lead[x])
        gone[x] = gone[x] or gone[parents[x]] or kinds[x] in (NAMED, TEXT) and not spared
    return gone


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of each page."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in blocks(whole, "html", BLOCK):
                text = [main_text(h) for h in b.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(spread(table(spark, sf_dir, "pages")))


QUERIES = {"op7_html": op7_html}
ORACLE_SQL: dict[str, str] = {}
