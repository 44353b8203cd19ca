"""Queries over embedded records: products, social documents, images, and whole reports."""

from __future__ import annotations

import datetime
import json

import numpy as np
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import crawl, dedupe, palette
from ..sources import images as I, products as X, rules, social
from ..streaming import pages as stream
from . import report
from .registry import query, table

SHOP, CDN = "https://shop.example.com", "https://c.example.com"
CODE = '<script type="application/ld+json">', "</script>"


def _shown(spark, sf_dir, url, html):
    """Pages that show the rows of ``part``; in both texts ``$k`` stands for the key and ``$n`` for the name."""
    part = table(spark, sf_dir, "part")
    said = lambda c: F.replace(F.replace(c, F.lit("$k"), F.col("p_partkey").cast("string")), F.lit("$n"), F.col("p_name"))
    return part.select(F.col("p_partkey").cast("long").alias("page_id"), said(url).alias("url"), said(html).alias("html"))


def _found(pages, **how):
    return X.products(pages, **how).select("page_id", "name", "sku_id", F.array_join("image_urls", ",").alias("images"))


LINKED = [
    (f"{SHOP}/t/shoe/AB$k-100", '{"@type":"Product","name":"$n","sku":"ab$k-100","image":["/i/$k.jpg","https://cdn.example.com/$k.png#x"]}'),
    (f"{SHOP}/p/$k", '{"@graph":[{"@type":["Thing","ProductGroup"],"name":"Coat $n","mpn":$k,"image":{"url":"//cdn.example.com/$k.webp"}},{"@type":"Person","name":"x","image":"/no.jpg"}]}'),
    (f"{SHOP}/", "not json"),
    (f"{SHOP}/p/$k", '[{"@type":"product","name":" ","image":"/a.gif"},{"@type":"product","name":"$n","image":"/h$k.jpeg"}]'),
]


@query(
    "SELECT p_partkey AS page_id, CASE p_partkey % 4 WHEN 1 THEN 'Coat ' || p_name ELSE p_name END AS name, CASE p_partkey % 4 WHEN 0 THEN 'AB' || p_partkey || '-100' WHEN 1 THEN CAST(p_partkey AS VARCHAR) END AS sku_id,"
    f" CASE p_partkey % 4 WHEN 0 THEN 'https://cdn.example.com/' || p_partkey || '.png,{SHOP}/i/' || p_partkey || '.jpg' WHEN 1 THEN 'https://cdn.example.com/' || p_partkey || '.webp' ELSE '{SHOP}/h' || p_partkey || '.jpeg' END AS images FROM part WHERE p_partkey % 4 <> 2"
)
def json_ld_products(spark, sf_dir):
    of = lambda i: F.element_at(F.array(*(F.lit(x[i]) for x in LINKED)), (F.col("p_partkey") % 4 + 1).cast("int"))
    return _found(_shown(spark, sf_dir, of(0), F.concat(F.lit(CODE[0]), of(1), F.lit(CODE[1] + '<img src="/i/1.jpg">'))))


STATE = '<script>window.__ALGOLIA_STATE__ = {"a":{"results":[{"hits":[{"name":{"en":"$n"},"style":"xy$k-1","image":"/b$k.jpg"},{"name":{"en":"Bag"},"style":"bag$k","image":"/c.jpg"},{"style":"none"}]}]},"b":3};</script>'


@query(f"SELECT p_partkey AS page_id, p_name AS name, 'XY' || p_partkey || '-1' AS sku_id, '{SHOP}/b' || p_partkey || '.jpg' AS images FROM part UNION ALL SELECT p_partkey, 'Bag', 'BAG' || p_partkey, '{SHOP}/c.jpg' FROM part")
def algolia_products(spark, sf_dir):
    own = rules.Rules(json_sources=(rules.JsonRule("algolia_state", ("name.en",), ("style",), False, (), ("image",)),))
    return _found(_shown(spark, sf_dir, F.lit(f"{SHOP}/w/all"), F.lit(STATE)), default=own)


NEXT = '<script id="__NEXT_DATA__" type="application/json">' + json.dumps({"props": {"products": {"a": {"title": "$n", "productCode": "ZZ$k-2", "portraitURL": f"{CDN}/r$k.jpg"}}, "wall": [{"copy": {"title": "Trail $n"}, "pdpUrl": {"url": f"{SHOP}/t/trail/TR$k-001"}, "colorwayImages": {"squarishURL": f"{CDN}/t$k.jpg"}}]}}) + "</script>"


@query(f"SELECT p_partkey AS page_id, p_name AS name, 'ZZ' || p_partkey || '-2' AS sku_id, '{CDN}/r' || p_partkey || '.jpg' AS images FROM part UNION ALL SELECT p_partkey, 'Trail ' || p_name, 'TR' || p_partkey || '-001', '{CDN}/t' || p_partkey || '.jpg' FROM part")
def next_data_products(spark, sf_dir):
    return _found(_shown(spark, sf_dir, F.lit(f"{SHOP}/w/all"), F.lit(NEXT)), default=rules.shop_defaults())


INLINE = f'<script>x={{"copy": {{"title":"Caf\\u00e9 $n"}},"portraitURL":"{CDN}/p$k.jpg","squarishURL":"{CDN}/s$k.jpg","pdpUrl": {{"url":"{SHOP}/t/cafe/CF$k-9"}}}}</script>'


@query(f"SELECT p_partkey AS page_id, 'Café ' || p_name AS name, 'CF' || p_partkey || '-9' AS sku_id, '{CDN}/p' || p_partkey || '.jpg,{CDN}/s' || p_partkey || '.jpg' AS images FROM part")
def inline_products(spark, sf_dir):
    return _found(_shown(spark, sf_dir, F.lit(f"{SHOP}/w/all"), F.lit(INLINE)), default=rules.shop_defaults())


CARDS = '<div data-testid="product-card"><a class="link" href="/t/one/ON$k-1">$n</a><img src="/1.jpg" srcset="/s$k.png 320w"></div><div data-testid="product-card"><a class="link" href="/t/none">Two</a><img src="/2.jpg"></div>'


@query(f"SELECT p_partkey AS page_id, p_name AS name, 'ON' || p_partkey || '-1' AS sku_id, '{SHOP}/1.jpg,{SHOP}/s' || p_partkey || '.png' AS images FROM part")
def card_products(spark, sf_dir):
    own = rules.Rules(product_card=rules.CardRule('//div[@data-testid="product-card"]', '//a[contains(@class,"link")]'), json_sources=())
    return _found(_shown(spark, sf_dir, F.lit(f"{SHOP}/w/all"), F.lit(CARDS)), default=own)


DOM = f'<div data-sku="SK$k-2" data-product-name="$n"><span><img src="/cap$k.jpg"></span></div><picture><source srcset="{CDN}/pic$k.webp 2x"></picture><meta property="og:image" content="{CDN}/og.png"><b>{CDN}/bare$k.gif</b>'


@query(
    f"SELECT p_partkey AS page_id, unnest([0, 1, 2, 3]) AS ord, unnest(['{SHOP}/cap' || p_partkey || '.jpg', '{CDN}/pic' || p_partkey || '.webp', '{CDN}/og.png', '{CDN}/bare' || p_partkey || '.gif']) AS url,"
    " unnest([p_name, NULL, NULL, NULL]) AS dom_name, unnest(['SK' || p_partkey || '-2', NULL, NULL, NULL]) AS dom_sku FROM part"
)
def image_candidates(spark, sf_dir):
    return X.candidates(_shown(spark, sf_dir, F.lit(f"{SHOP}/x"), F.lit(DOM))).select("page_id", "ord", "url", "dom_name", "dom_sku")


@query(
    "SELECT n_name AS domain, CASE WHEN n_nationkey % 5 = 0 THEN 'stored' WHEN n_nationkey % 3 = 0 THEN 'inferred' ELSE 'default' END AS origin, CASE WHEN n_nationkey % 5 = 0 THEN 0 WHEN n_nationkey % 3 = 0 THEN 1 ELSE 3 END AS sources,"
    " n_nationkey % 5 <> 0 AS written, (SELECT count(*) FROM nation) AS stored FROM nation"
)
def config_infer(spark, sf_dir):
    """Rules of every nation's site: stored ones of today, inferred ones that find something on its samples, else the usual ones."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_name").alias("domain"), F.col("n_nationkey").alias("k"))
    now = datetime.datetime(2026, 5, 2, 9)
    at = F.when(F.col("k") % 5 == 0, F.lit(now)).otherwise(F.lit(now - datetime.timedelta(days=1))).cast("timestamp")
    blank = spark.createDataFrame([], rules.SCHEMA)
    stored = nation.where("k % 2 = 0 or k % 5 = 0").select("domain", *(F.lit(None).cast(f.dataType).alias(f.name) for f in blank.schema[1:-1]), at.alias("updated_at"))
    page = F.when(F.col("k") % 3 == 0, F.concat(F.lit(CODE[0] + '{"@type":"Product","name":"'), "domain", F.lit('","image":"/a.jpg"}' + CODE[1]))).otherwise("<p>no product</p>")
    samples = nation.select("domain", F.lit(0).alias("ord"), F.lit(f"{SHOP}/p/1").alias("url"), page.alias("html"))
    used, table_now = rules.load_or_infer(nation, stored, samples, lambda prompt, domain: rules.generic(domain), now)
    kept = table_now.agg(F.count("*").alias("stored"))
    return used.select("domain", "origin", F.coalesce(F.size("json_sources"), F.lit(0)).alias("sources"), (F.col("origin") != "stored").alias("written")).withColumn("sources", F.greatest("sources", F.lit(0))).withColumn("stored", kept.scalar())


@query("SELECT event_id, 0 AS ord, '{\"k\":' || json_extract_string(props, '$.k') || '}' AS node FROM events")
def json_tree_walk(spark, sf_dir):
    return X.json_objects(table(spark, sf_dir, "events"), "event_id", "props")


# -- social ----------------------------------------------------------------------------------


def _profiles(spark, sf_dir):
    """Conversations as profiles, their turns as posts of a captured profile document."""
    turns = table(spark, sf_dir, "conversations").where("conv_id is not null")
    node = F.struct(F.struct(
        F.concat(F.col("conv_id"), F.lit("_"), F.col("turn")).alias("shortcode"), F.concat(F.lit("https://c.example.com/"), F.col("conv_id"), F.lit("_"), F.col("turn"), F.lit(".jpg")).alias("display_url"), (F.col("turn") % 2 == 1).alias("is_video"),
        F.struct(F.array(F.struct(F.struct(F.col("text")).alias("node"))).alias("edges")).alias("edge_media_to_caption"),
    ).alias("node"))
    edges = F.transform(F.sort_array(F.collect_list(F.struct("turn", node.alias("e")))), lambda x: x["e"])
    got = turns.groupBy("conv_id").agg(edges.alias("edges"), F.min_by("role", "turn").alias("bio"))
    whole = F.expr("to_json(named_struct('data', named_struct('user', named_struct('biography', bio, 'edge_owner_to_timeline_media', named_struct('edges', edges)))))")
    return got.select(F.col("conv_id").alias("profile"), whole.alias("payload"))


_TURNS = "(SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL)"
_SAID = "trim(regexp_replace(text, '[ \\t\\n\\r\\x0B\\f]+', ' ', 'g'))"


@query(
    "SELECT conv_id AS profile, -1 AS ord, 'tagline' AS kind, arg_min(role, turn) AS text, CAST(2.5 AS DOUBLE) AS weight FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1"
    f" UNION ALL SELECT conv_id, CAST(pos AS INTEGER), 'editorial', CASE WHEN length(s) <= 800 THEN s ELSE rtrim(substr(s, 1, 799)) || '…' END, 1.4 FROM (SELECT conv_id, pos, {_SAID} AS s FROM {_TURNS} WHERE pos < 12) WHERE s <> ''"
)
def social_posts(spark, sf_dir):
    return social.profile_texts(_profiles(spark, sf_dir)).select("profile", "ord", "kind", "text", "weight")


@query(f"SELECT conv_id AS profile, count(*) AS posts FROM {_TURNS} WHERE pos < 12 GROUP BY 1")
def social_caps(spark, sf_dir):
    return social.profile_posts(_profiles(spark, sf_dir)).groupBy("profile").agg(F.count("*").alias("posts"))


@query(f"SELECT conv_id AS profile, CAST(pos AS INTEGER) AS ord, 'https://c.example.com/' || conv_id || '_' || turn || '.jpg' AS url, 'https://www.instagram.com/p/' || conv_id || '_' || turn || '/' AS post_url FROM {_TURNS} WHERE pos < 12")
def social_images(spark, sf_dir):
    return social.profile_images(_profiles(spark, sf_dir)).select("profile", "ord", "url", "post_url")


@query(f"SELECT profile, nth, text FROM (SELECT conv_id AS profile, CAST(pos + 1 AS INTEGER) AS nth, CASE WHEN length(s) <= 800 THEN s ELSE rtrim(substr(s, 1, 799)) || '…' END AS text, row_number() OVER (PARTITION BY conv_id, lower(CASE WHEN length(s) <= 800 THEN s ELSE rtrim(substr(s, 1, 799)) || '…' END) ORDER BY pos) AS n FROM (SELECT conv_id, pos, {_SAID} AS s FROM {_TURNS} WHERE pos < 20) WHERE s <> '') WHERE n = 1")
def social_distinct_text(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").where("conv_id is not null")
    found = dedupe.first_few(turns, ["conv_id"], ["turn"], social.MOST_STATUSES).select(F.col("conv_id").alias("profile"), F.col("rank").alias("nth"), F.col("turn").alias("id"), "text")
    return social.status_texts(found).select("profile", "nth", "text")


def _timelines(spark, sf_dir):
    """Conversations as pages of a timeline: a user, the turns as posts with a photograph or a film, one post again, and what is none."""
    turns = table(spark, sf_dir, "conversations").where("conv_id is not null")
    key = F.concat(F.col("conv_id"), F.lit("_"), F.col("turn"))
    media = F.array(F.struct(F.when(F.col("turn") % 2 == 0, "photo").otherwise("video").alias("type"), F.concat(F.lit("https://pbs.twimg.com/"), key, F.lit(".jpg")).alias("media_url_https")))
    post = F.struct(key.alias("id_str"), F.col("text").alias("full_text"), F.struct(media.alias("media")).alias("entities"))
    posts = turns.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", post.alias("p")))), lambda x: x["p"]).alias("posts"))
    user = F.struct(F.concat(F.lit("BRAND"), "conv_id").alias("screen_name"), F.concat(F.lit(" We make things "), "conv_id", F.lit(" ")).alias("description"))
    other = F.struct(F.lit("x").alias("screen_name"), F.lit("no").alias("description"))
    whole = F.to_json(F.struct(other.alias("first"), user.alias("user"), F.concat("posts", F.slice("posts", 1, 1)).alias("entries"), F.array(F.struct(F.lit("not a post").alias("text"))).alias("rest")))
    html = F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">'), whole, F.lit("</script>"))
    return social.timeline_objects(posts.select(F.concat(F.lit("brand"), "conv_id").alias("profile"), html.alias("html")))


_CUT = "CASE WHEN length(s) <= 800 THEN s ELSE rtrim(substr(s, 1, 799)) || '…' END"


@query(f"SELECT profile, nth, id, text FROM (SELECT 'brand' || conv_id AS profile, CAST(pos + 1 AS INTEGER) AS nth, conv_id || '_' || turn AS id, {_CUT} AS text, row_number() OVER (PARTITION BY conv_id, lower({_CUT}) ORDER BY pos) AS n FROM (SELECT conv_id, turn, pos, {_SAID} AS s FROM {_TURNS} WHERE pos < 20 AND text IS NOT NULL) WHERE s <> '') WHERE n = 1")
def timeline_texts(spark, sf_dir):
    return social.status_texts(social.statuses(_timelines(spark, sf_dir))).select("profile", "nth", "id", "text")


@query(f"SELECT 'brand' || conv_id AS profile, CAST(pos + 1 AS INTEGER) AS nth, 0 AS pos, 'https://pbs.twimg.com/' || conv_id || '_' || turn || '.jpg?name=large' AS url FROM {_TURNS} WHERE pos < 20 AND turn % 2 = 0 AND text IS NOT NULL")
def timeline_images(spark, sf_dir):
    return social.status_images(social.statuses(_timelines(spark, sf_dir))).select("profile", "nth", "pos", "url")


@query("SELECT DISTINCT 'brand' || conv_id AS profile, 'We make things ' || conv_id AS text FROM conversations WHERE conv_id IS NOT NULL")
def timeline_biography(spark, sf_dir):
    return social.biography(_timelines(spark, sf_dir))


# -- images ----------------------------------------------------------------------------------


def png(width: int, height: int, colour: tuple[int, int, int]) -> bytes:
    """A one-colour PNG with a white border of a tenth."""
    edge = max(1, min(width, height) // 10)
    x = np.full((height, width, 3), 255, dtype=np.uint8)
    x[edge : height - edge, edge : width - edge] = colour
    return I.png_bytes(x)


@query("SELECT p_partkey, CASE WHEN p_partkey % 6 <> 5 THEN CAST(40 + p_partkey % 700 AS INTEGER) END AS width, CASE WHEN p_partkey % 6 <> 5 THEN CAST(60 + p_size AS INTEGER) END AS height FROM part")
def image_dims(spark, sf_dir):
    """Sizes from the heads of pictures, one a part; every sixth isn't a picture."""
    number = lambda c: F.lpad(F.hex(c), 8, "0")
    head = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), number(40 + F.col("p_partkey") % 700), number(60 + F.col("p_size")), F.lit("0802000000"))
    content = F.unhex(F.when(F.col("p_partkey") % 6 != 5, head).otherwise(F.concat(F.lit("FFD8"), head)))
    return table(spark, sf_dir, "part").select("p_partkey", I.png_size(content).alias("s")).select("p_partkey", "s.width", "s.height")


@query(
    "WITH i AS (SELECT p_brand, 20 + 90 * (p_size % 3) AS r, 30 + 120 * (p_partkey % 2) AS g, 40 AS b, 100 * (1 + p_partkey % 4) AS n, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part), c AS (SELECT p_brand, r, g, b, sum(n) AS n FROM i WHERE k <= 30 GROUP BY ALL)"
    " SELECT p_brand AS brand, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, r, g, b) AS INTEGER) AS rank, CAST(r AS INTEGER) AS r, CAST(g AS INTEGER) AS g, CAST(b AS INTEGER) AS b, CAST(n AS BIGINT) AS n FROM c"
)
def palette_pixels(spark, sf_dir):
    """Palettes by median cut over pictures of one colour, ten pixels high, whose cut gives just their colours."""
    part = table(spark, sf_dir, "part").withColumn("w", (10 * (1 + F.col("p_partkey") % 4)).cast("int"))
    byte = lambda c: F.lpad(F.hex(c), 2, "0")
    pixel = F.concat(byte(20 + 90 * (F.col("p_size") % 3)), byte(30 + 120 * (F.col("p_partkey") % 2)), byte(F.lit(40)))
    pictures = part.select(F.col("p_partkey").cast("string").alias("url"), F.col("w").alias("width"), F.lit(10).alias("height"), F.unhex(F.repeat(pixel, F.col("w") * 10)).alias("rgb"))
    images = part.select(F.col("p_brand").alias("brand"), F.col("p_partkey").cast("string").alias("url"), F.col("p_partkey").alias("ord"))
    return palette.of_thumbnails(pictures, images, "brand").select("brand", "rank", "r", "g", "b", "n")


# -- whole reports ---------------------------------------------------------------------------


def _report_inputs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    brand = F.regexp_replace("source", "[^0-9]", "").cast("long")
    bundles = docs.groupBy(brand.alias("brand_id")).agg(F.min("source").alias("s"), F.count("*").alias("pages_crawled")).select(
        "brand_id", F.lit("website").alias("source"), F.lit(0).alias("bundle_ord"), F.concat(F.lit("https://www."), "s", F.lit(".example.com/")).alias("brand_url"), F.lit("400x400").alias("min_resolution"),
        "pages_crawled", (F.col("pages_crawled") * 2).alias("candidates_checked"), F.lit(None).cast("struct<url:string,provider:string,reason:string>").alias("bot_protection"),
    )
    e = table(spark, sf_dir, "embeddings")
    images = e.select((F.col("vec_id") % 20).alias("brand_id"), F.lit(0).alias("bundle_ord"), F.col("vec_id").alias("ord"), F.concat(F.lit("u"), "vec_id").alias("url"), F.lit(800).alias("width"), (400 + F.col("vec_id") % 900).cast("int").alias("height"),
        F.concat(F.lit("p"), F.col("label")).alias("source_page"), F.concat(F.lit("n"), F.col("vec_id") % 7).alias("product_name"), F.lit(None).cast("string").alias("sku_id"), F.when(F.col("vec_id") % 4 == 0, "social").otherwise("product").alias("source_kind"))
    texts = docs.select(brand.alias("brand_id"), F.lit(0).alias("bundle_ord"), F.col("doc_id").alias("ord"), F.lit("https://x").alias("source_url"), F.lit("editorial").alias("kind"), T.truncate(T.clean(F.col("text"))).alias("text"), F.lit(1.5).alias("weight"))
    return bundles, images, texts, e.select(F.concat(F.lit("u"), "vec_id").alias("url"), "embedding")


@query(
    "WITH d AS (SELECT CAST(regexp_replace(source, '[^0-9]', '', 'g') AS BIGINT) AS brand_id, source, doc_id, trim(regexp_replace(text, '[ \\t\\n\\r\\x0B\\f]+', ' ', 'g')) AS c FROM documents), t AS (SELECT brand_id, count(DISTINCT lower(trim(CASE WHEN length(c) <= 800 THEN c ELSE rtrim(substr(c, 1, 799)) || '…' END))) AS texts_total FROM d GROUP BY 1),"
    " i AS (SELECT vec_id % 20 AS brand_id, count(*) AS images_total, count_if(vec_id % 4 = 0) AS images_social, count_if(800 / (400 + vec_id % 900) BETWEEN 0.4 AND 2.5) AS images_analysed FROM embeddings GROUP BY 1)"
    " SELECT d.brand_id, upper(min(source)[1]) || substr(min(source), 2) AS name, 'ok' AS status, count(*) AS pages_crawled, 2 * count(*) AS candidates_checked, any_value(images_total) AS images_total, CAST(any_value(images_social) AS BIGINT) AS images_social, CAST(any_value(images_analysed) AS BIGINT) AS images_analysed, any_value(texts_total) AS texts_total FROM d JOIN t USING (brand_id) JOIN i USING (brand_id) GROUP BY 1"
)
def report_counts(spark, sf_dir):
    got = report.build(*_report_inputs(spark, sf_dir)).join(table(spark, sf_dir, "documents").groupBy(F.regexp_replace("source", "[^0-9]", "").cast("long").alias("brand_id")).agg(F.min("source").alias("_s")), "brand_id")
    name = F.concat(F.upper(F.substring("_s", 1, 1)), F.expr("substring(_s, 2)"))
    return got.select("brand_id", F.when(F.col("brand_url").contains(F.col("_s")), name).alias("name"), "status", "pages_crawled", "candidates_checked", "images_total", "images_social", "images_analysed", "texts_total")


@query(None)
def report_full(spark, sf_dir):
    got = report.build(*_report_inputs(spark, sf_dir))
    return got.select("brand_id", "name", "status", F.to_json("clusters").alias("clusters"), F.to_json("names").alias("names"), F.size("texts").alias("prompt_texts"))


@query("SELECT url, min(page_id) AS page_id FROM pages GROUP BY url")
def page_stream_once(spark, sf_dir):
    """Pages as a stream, each address once with its least page, by way of the shared folder."""
    rows = stream.read(spark, f"{sf_dir}/pages.parquet*", "page_id bigint, url string, html string")
    return stream.earliest(rows, ["url"], "page_id", crawl.shared_folder(spark)).select("page_id", "url")
