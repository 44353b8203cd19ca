"""Records from crawled pages: links, text snippets, image references, samples.

Where a rule is a matter of literal markup it is a column expression, which stays in the JVM;
rules that need the element tree run as Arrow batches and give arrays of structs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T, urls as U
from . import markup

#: Weights by kind of snippet (fixed values).
WEIGHTS = {"title": 0.4, "meta_description": 0.6, "og_title": 0.5, "og_description": 0.7, "twitter_description": 0.6, "hero": 1.1, "paragraph": 1.5, "product_description": 0.9}

SNIPPETS = "array<struct<kind:string,text:string,weight:double,ord:int>>"


def without_code(html: Column) -> Column:
    """Html without scripts, styles and comments."""
    return F.regexp_replace(html, "(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", "")


def plain(markup_text: Column) -> Column:
    """Text of a piece of markup: tags go, the commonest references are decoded, white space is one space."""
    said = F.regexp_replace(markup_text, "<[^>]*>", "")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        said = F.replace(said, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(said, "[ \\t\\n\\r]+", " "))


#: An anchor up to its href: quoted in either way or bare, in any case, whatever attributes stand before.
ANCHOR = r"""(?is)<a\s(?:[^>"']|"[^"]*"|'[^']*')*?(?<![\w-])href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def hrefs(html: Column) -> Column:
    """The href of every anchor in page order, trimmed, its commonest references decoded; those without any are left out."""

    def plain_href(h: Column) -> Column:
        said = F.regexp_replace(h, r"""^["']|["']$""", "")
        for a, b in (("&#38;", "&"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
            said = F.replace(said, F.lit(a), F.lit(b))
        return F.trim(said)

    return F.filter(F.transform(F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(1)), plain_href), lambda h: h != "")


def links(pages: DataFrame, per_page: bool = True) -> DataFrame:
    """``(page_id, url, href)`` of anchors outside scripts, styles and comments; each href once a page."""
    found = hrefs(without_code(F.col("html")))
    return pages.select("page_id", "url", F.explode(F.array_distinct(found) if per_page else found).alias("href"))


def site_links(pages: DataFrame) -> DataFrame:
    """``(page_id, url, link)``: absolute, without fragment, of the page's own site, each once a page."""
    got = links(pages).withColumn("link", U.defragment(U.absolute_link(F.col("href"), F.col("url"))))
    return got.where(U.same_site(F.col("link"), F.col("url"))).select("page_id", "url", "link").distinct()


def paragraph_array(html: Column, least: int = T.LEAST_PARAGRAPH) -> Column:
    """``array<struct<ord, text>>`` of the paragraphs of literal markup, in page order."""
    parts = F.split(without_code(html), "<p(?:\\s[^>]*)?>")
    each = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p, i: F.struct(i.alias("ord"), plain(F.split_part(p, F.lit("</p>"), F.lit(1))).alias("text")))
    return F.filter(each, lambda x: F.length(x["text"]) >= least)


def paragraphs(pages: DataFrame, least: int = T.LEAST_PARAGRAPH) -> DataFrame:
    """``(page_id, url, ord, text)`` of the paragraphs of literal markup."""
    return pages.select("page_id", "url", F.explode(paragraph_array(F.col("html"), least)).alias("p")).select("page_id", "url", "p.ord", "p.text")


def title(html: Column) -> Column:
    return plain(F.regexp_extract(html, "(?s)<title>(.*?)</title>", 1))


def headings(html: Column) -> Column:
    return F.transform(F.regexp_extract_all(html, F.lit("(?s)<h1[^>]*>(.*?)</h1>"), F.lit(1)), plain)


def literal_snippets(pages: DataFrame) -> DataFrame:
    """``(page_id, url, ord, weight, text)``: titles, headings and paragraphs in one pass over the html."""
    piece = lambda ord_, weight, text: F.struct(F.lit(ord_).alias("ord") if isinstance(ord_, int) else ord_.alias("ord"), F.lit(weight).alias("weight"), text.alias("text"))
    html = F.col("html")
    heads = F.transform(F.filter(headings(html), lambda h: F.length(h) >= T.LEAST_HERO), lambda h: piece(1, WEIGHTS["hero"], h))
    body = F.transform(paragraph_array(html), lambda p: piece(p["ord"] + 2, WEIGHTS["paragraph"], p["text"]))
    every = F.concat(F.array(piece(0, WEIGHTS["title"], title(html))), heads, body)
    got = pages.select("page_id", "url", F.explode(F.filter(every, lambda x: x["text"] != "")).alias("s"))
    return got.select("page_id", "url", "s.ord", "s.weight", "s.text")


def page_snippets(html: str | None, url: str | None) -> list[dict]:
    """Every snippet that the rules find on one page, in the order they look."""
    import re

    if not html:
        return []
    clean = lambda s: re.sub(r"\s+", " ", s or "").strip()
    short = lambda s: s if len(s) <= T.MOST_CHARS else s[: T.MOST_CHARS - 1].rstrip() + "…"
    root, out = markup.parse(html), []

    def add(kind: str, said: str, weight: float) -> None:
        if said := clean(said):
            out.append({"kind": kind, "text": short(said), "weight": weight, "ord": len(out)})

    address = re.sub(r"[?#].*", "", re.sub(r"^[A-Za-z][\w+.-]*://[^/?#]*", "", url or "")).lower()
    editorial = any(h in address for h in U.EDITORIAL_HINTS)
    home, product = address in ("", "/"), any(h in address for h in U.PRODUCT_HINTS)
    for node in markup.select(root, "//title")[:1]:
        add("title", node.text(), WEIGHTS["title"])
    for attribute, name, kind, weight in (("name", "description", "meta_description", WEIGHTS["meta_description"]), ("property", "og:title", "og_title", WEIGHTS["og_title"]), ("property", "og:description", "og_description", WEIGHTS["og_description"]), ("name", "twitter:description", "og_description", WEIGHTS["twitter_description"])):
        for node in markup.select(root, f"//meta[@{attribute}='{name}']"):
            add(kind, node.attrs.get("content", ""), weight)
    if home:
        for node in markup.select(root, "//h1") + markup.select(root, "//h2")[:3]:
            if len(clean(node.text())) >= T.LEAST_HERO:
                add("hero", node.text(), WEIGHTS["hero"])
    if home or editorial:
        passing = [n.text() for n in markup.select(root, "//p") if len(clean(n.text())) >= T.LEAST_PARAGRAPH]
        for said in passing[: T.MOST_PARAGRAPHS]:
            add("about" if "/about" in (url or "").lower() else "editorial", said, WEIGHTS["paragraph"])
    if product and not home:
        nodes = markup.select(root, "//*[contains(@class,'description')]//p") + markup.select(root, "//*[contains(@class,'product-detail')]//p") + markup.select(root, "//*[@itemprop='description']")
        for node in [n for n in nodes if len(clean(n.text())) >= T.LEAST_PARAGRAPH][: T.MOST_PRODUCT_PARAGRAPHS]:
            add("product_description", node.text(), WEIGHTS["product_description"])
    return out


def snippets(pages: DataFrame) -> DataFrame:
    """``(page_id, url, ord, kind, text, weight)`` of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string()), ("weight", pa.float64()), ("ord", pa.int32())]))
        for b in batches:
            got = [page_snippets(h, u) for h, u in zip(b.column("html").to_pylist(), b.column("url").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(got, kind)], names=["page_id", "url", "s"])

    rows = pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, f"page_id bigint, url string, s {SNIPPETS}")
    return rows.select("page_id", "url", F.explode("s").alias("s")).select("page_id", "url", "s.ord", "s.kind", "s.text", "s.weight")


def srcset(value: Column) -> Column:
    """Image references of a srcset: absolute ones, then relative ones with an image ending, each once."""
    absolute = F.regexp_extract_all(value, F.lit("(https?://[^\\s]+?)(?:\\s+[0-9]+[wx])?(?:,|$)"), F.lit(1))
    relative = F.regexp_extract_all(value, F.lit(f"(?i)(/?[\\w./%-]+[.](?:{U.IMAGE_EXTENSIONS}))\\s+[0-9]+[wx]"), F.lit(1))
    return F.array_distinct(F.concat(absolute, relative))


def embedded_images(html: Column, fields: tuple[str, ...]) -> Column:
    """Image URLs in configured JSON fields, and bare https image URLs; plausible ones, without fragment, in order of text."""
    named = F.regexp_extract_all(html, F.lit('"(?:' + "|".join(fields) + ')"\\s*:\\s*"(https://[^"]+)"'), F.lit(1))
    bare = F.regexp_extract_all(html, F.lit(f"(?i)https://[^\\s\"'<>\\\\]+?[.](?:{U.IMAGE_EXTENSIONS})(?:[?][^\\s\"'<>\\\\]*)?"), F.lit(0))
    both = F.array_union(F.transform(named, lambda u: F.replace(u, F.lit("\\u002F"), F.lit("/"))), bare)
    return F.array_sort(F.array_distinct(F.transform(F.filter(both, U.plausible_image), U.defragment)))


def sample(html: Column, most: int = 10_000) -> Column:
    """What a page shows of its products: JSON-LD, page data and cards, else its beginning."""
    linked = F.transform(F.regexp_extract_all(html, F.lit('(?s)<script type="application/ld[+]json">.*?</script>'), F.lit(0)), lambda x: F.substring(x, 1, 2000))
    data = F.regexp_extract(html, '(?s)<script id="__NEXT_DATA__" type="application/json">(.*?)</script>', 1)
    head = F.when(data != "", F.array(F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">'), F.substring(data, 1, 4000), F.lit("</script>")))).otherwise(F.array().cast("array<string>"))
    cards = F.transform(F.regexp_extract_all(html, F.lit('(?is)<[^>]+data-testid="product-card"[^>]*>.*?</div>'), F.lit(0)), lambda x: F.substring(x, 1, 2000))
    parts = F.concat(linked, head, cards)
    return F.when(F.size(parts) > 0, F.array_join(parts, "\n")).otherwise(F.substring(html, 1, most))
