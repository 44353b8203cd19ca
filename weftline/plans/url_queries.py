"""Queries over addresses."""

from pyspark.sql import functions as F

from ..functions import text as T, urls as U
from .registry import query, table, values

HOST = "regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www[.]', '')"
PATH = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
EDITORIAL = "|".join(U.EDITORIAL_HINTS)

#: Addresses that the pages table has no examples of.
ADDRESSES = """('https://www.Example.com/'),('https://example.com'),('http://shop.example.co.uk/p/1#x'),('https://localhost/about-us'),('https://a.example.com/products/x?y=/about'),
('https://example.com/our-story'),('https://example.com/w/shoes'),('https://example.com/collections/t/1'),('ftp://example.com/a'),('https://example.com:8080/journal/1')"""


def _addresses(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("url").unionByName(values(spark, ADDRESSES, "url"))


_SOURCE = f"(SELECT url FROM pages UNION ALL SELECT * FROM (VALUES {ADDRESSES}) v(url))"


@query(f"SELECT url, regexp_replace(url, '#.*$', '') AS bare FROM {_SOURCE}")
def url_defrag(spark, sf_dir):
    return _addresses(spark, sf_dir).select("url", U.defragment(F.col("url")).alias("bare"))


@query(f"SELECT {HOST} AS host, count(*) AS n FROM {_SOURCE} GROUP BY 1")
def url_netloc(spark, sf_dir):
    return _addresses(spark, sf_dir).groupBy(U.host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


_TOKEN = f"CASE WHEN len(string_split({HOST}, '.')) >= 2 THEN string_split({HOST}, '.')[-2] ELSE {HOST} END"


@query(f"SELECT url, {_TOKEN} AS token, upper(({_TOKEN})[1]) || lower(substr({_TOKEN}, 2)) AS name FROM {_SOURCE}")
def url_brand_token(spark, sf_dir):
    return _addresses(spark, sf_dir).select("url", U.brand_token(F.col("url")).alias("token"), U.brand_name(F.col("url")).alias("name"))


_CLASS = f"CASE WHEN lower({PATH}) IN ('', '/') THEN 'homepage' WHEN regexp_matches(lower({PATH}), '/p/|/t/|/product/|/products/') THEN 'pdp' WHEN regexp_matches(lower({PATH}), '{EDITORIAL}') THEN 'editorial' ELSE 'other' END"


@query(f"SELECT url, {_CLASS} AS class FROM {_SOURCE}")
def url_path_class(spark, sf_dir):
    return _addresses(spark, sf_dir).select("url", U.page_class(F.col("url")).alias("class"))


@query(f"SELECT url FROM {_SOURCE} WHERE regexp_matches(lower({PATH}), '{EDITORIAL}')")
def url_editorial(spark, sf_dir):
    return _addresses(spark, sf_dir).where(U.is_editorial(F.col("url")))


@query(f"SELECT url, CASE WHEN regexp_matches(lower(url), '/w/|/shop/|/collection') THEN 'listing' WHEN regexp_matches(lower(url), '/t/|/product/|/p/') THEN 'pdp' WHEN {PATH} IN ('', '/') THEN 'homepage' ELSE 'other' END AS kind FROM {_SOURCE}")
def url_sample_type(spark, sf_dir):
    return _addresses(spark, sf_dir).select("url", U.sample_type(F.col("url")).alias("kind"))


@query(f"SELECT p.url, s.seed FROM pages p, (SELECT min(url) AS seed FROM pages) s WHERE {HOST.replace('(url,', '(p.url,')} = {HOST.replace('(url,', '(s.seed,')} AND regexp_matches(lower(p.url), '^https?:')")
def url_same_site(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    seed = pages.agg(F.min("url").alias("seed"))  # one row
    return pages.select("url").crossJoin(F.broadcast(seed)).where(U.same_site(F.col("url"), F.col("seed")))


IMAGES = """('https://cdn.example.com/a/B.JPG?x=1','https://www.example.com/'),('https://cdn.example.com/w/f_auto/a.png','https://example.com'),('https://other.net/a.webp','https://example.com'),
('https://img-example.net/x/y.gif','https://example.com'),('https://example.com/a.svg','https://example.com'),('ftp://example.com/a.png','https://example.com'),('https://example.com/W/T_PRODUCT/a.png','https://example.com'),
('https://example.com/a.jpeg#f','https://shop.example.com'),('https://www.example.com/a.png','https://example.com')"""
_PLAUSIBLE = "regexp_matches(lower(url), '^https?:') AND regexp_matches(lower(" + PATH + "), '[.](jpg|jpeg|png|webp|gif)$') AND NOT regexp_matches(lower(" + PATH + f"), '{U.BROKEN_TRANSFORM}')"


@query(f"SELECT url, {_PLAUSIBLE} AS plausible FROM (VALUES {IMAGES}) v(url, seed)")
def url_image_plausible(spark, sf_dir):
    return values(spark, IMAGES, "url, seed").select("url", U.plausible_image(F.col("url")).alias("plausible"))


@query(
    f"SELECT url, seed, ({_PLAUSIBLE}) AND ({HOST} = {HOST.replace('(url,', '(seed,')} OR contains(replace(replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '.', ''), '-', ''), {_TOKEN.replace('(url,', '(seed,')})) AS allowed"
    f" FROM (VALUES {IMAGES}) v(url, seed)"
)
def url_image_allowed(spark, sf_dir):
    return values(spark, IMAGES, "url, seed").select("url", "seed", U.allowed_image(F.col("url"), F.col("seed")).alias("allowed"))


RAW = """('  https://example.com/a.png#x '),('//cdn.example.com/b.jpg'),('/img/c.webp?v=1'),('img/d.png'),('data:image/png;base64,AAA'),('javascript:void(0)'),(''),('blob:x'),('/page.html')"""


@query(
    "WITH r AS (SELECT raw, trim(raw) AS s FROM (VALUES " + RAW + ") v(raw)), u AS (SELECT raw, CASE WHEN s = '' OR regexp_matches(lower(s), '^(data|blob|javascript):') THEN NULL WHEN regexp_matches(lower(s), '^https?://') THEN regexp_replace(s, '#.*$', '')"
    " WHEN starts_with(s, '//') THEN regexp_replace('https:' || s, '#.*$', '') WHEN starts_with(s, '/') THEN regexp_replace('https://example.com' || s, '#.*$', '') END AS url FROM r)"
    f" SELECT raw, CASE WHEN {_PLAUSIBLE} THEN url END AS url FROM u"
)
def url_absolute(spark, sf_dir):
    return values(spark, RAW, "raw").select("raw", U.absolute_image(F.col("raw"), F.lit("https://example.com/x/y")).alias("url"))


PRODUCT_PAGES = """('https://example.com/t/air-shoe/ab123-100'),('https://example.com/t/AB12-001/details/'),('https://example.com/t/none'),('https://example.com/x/1-2/3-4?z=9-9'),('https://example.com/')"""


@query(
    "WITH p AS (SELECT url, list_reverse(string_split(trim(" + PATH + ", '/'), '/')) AS parts FROM (VALUES " + PRODUCT_PAGES + ") v(url))"
    f" SELECT url, upper(list_filter(parts, lambda x: regexp_matches(upper(x), '{U.STYLE_CODE}'))[1]) AS sku FROM p"
)
def url_sku(spark, sf_dir):
    return values(spark, PRODUCT_PAGES, "url").select("url", U.sku_from_url(F.col("url")).alias("sku"))


KEYED = """('https://cdn.example.com/a/0123abcd-ef/Shoe.PNG'),('https://cdn.example.com/ABCDEF0123/deadbeef/x.jpg?y'),('https://cdn.example.com/x.jpg'),('https://cdn.example.com/deadbeef'),('https://cdn.example.com/0011aabb/')"""


@query(
    "WITH p AS (SELECT url, string_split(lower(" + PATH + "), '/') AS parts FROM (VALUES " + KEYED + ") v(url)), k AS (SELECT url, unnest(list_concat([parts[-1]], list_filter(parts, lambda x: regexp_matches(x, '^[a-f0-9-]{8,}$')))) AS key FROM p)"
    " SELECT DISTINCT url, key FROM k WHERE key <> ''"
)
def url_match_keys(spark, sf_dir):
    return values(spark, KEYED, "url").select("url", F.explode(U.image_match_keys(F.col("url"))).alias("key"))


MEDIA = """('https://pbs.twimg.com/media/a.jpg'),('https://pbs.twimg.com/media/a.jpg?name=small'),('https://example.com/a.jpg')"""


@query(f"SELECT url, CASE WHEN contains(url, 'pbs.twimg.com') AND NOT contains(url, '?') THEN url || '?name=large' ELSE url END AS large FROM (VALUES {MEDIA}) v(url)")
def url_media_upgrade(spark, sf_dir):
    return values(spark, MEDIA, "url").select("url", U.large_media(F.col("url")).alias("large"))


PROFILES = """('https://www.instagram.com/Some.Brand/'),('https://x.com/some_brand'),('https://x.com/a/b'),('https://x.com/')"""


@query(f"SELECT url, nullif(regexp_replace(lower(regexp_extract({PATH}, '^/+([A-Za-z0-9_.]+)/?$', 1)), '[^a-z0-9._]', '', 'g'), '') AS handle, nullif(lower(regexp_extract({PATH}, '^/+([A-Za-z0-9_]+)/?$', 1)), '') AS short_handle FROM (VALUES {PROFILES}) v(url)")
def url_profile_handle(spark, sf_dir):
    return values(spark, PROFILES, "url").select("url", U.profile_handle(F.col("url")).alias("handle"), U.profile_handle(F.col("url"), False).alias("short_handle"))


@query("SELECT conv_id, turn, 'https://www.instagram.com/p/' || nullif(role, 'system') || '/' AS post, 'https://x.com/' || role || '/status/' || conv_id AS status FROM conversations")
def url_permalinks(spark, sf_dir):
    code = F.nullif("role", F.lit("system"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", U.post_permalink(code).alias("post"), U.status_permalink(F.col("role"), F.col("conv_id").cast("string")).alias("status"))


@query("SELECT p_type, CASE WHEN s = '' THEN 'brand' ELSE s END AS slug, count(*) AS n FROM (SELECT p_type, regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM part) GROUP BY 1, 2")
def slug_part_type(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_type", U.slug(F.col("p_type")).alias("slug")).agg(F.count("*").alias("n"))


HREFS = """('/a?b#c','https://example.com/x/y.html'),('//cdn.example.com/z','http://example.com/x'),('https://o.net/','https://example.com'),('?q=1','https://example.com/x/y?z'),('next','https://example.com/x/y'),('next','https://example.com'),('#top','https://example.com/x'),('../up','https://example.com/x/y/z'),('mailto:a@b.c','https://example.com/')"""


@query(
    "SELECT href, base, CASE href WHEN '/a?b#c' THEN 'https://example.com/a?b#c' WHEN '//cdn.example.com/z' THEN 'http://cdn.example.com/z' WHEN '?q=1' THEN 'https://example.com/x/y?q=1' WHEN '#top' THEN 'https://example.com/x'"
    " WHEN '../up' THEN 'https://example.com/x/up' WHEN 'next' THEN CASE base WHEN 'https://example.com' THEN 'https://example.com/next' ELSE 'https://example.com/x/next' END ELSE href END AS link FROM (VALUES " + HREFS + ") v(href, base)"
)
def url_join(spark, sf_dir):
    return values(spark, HREFS, "href, base").select("href", "base", U.absolute_link(F.col("href"), F.col("base")).alias("link"))


HANDLES = """('  @@Some.Brand_1 '),('Ünï code'),('@'),('plain')"""


@query(f"SELECT raw, regexp_replace(regexp_replace(lower(trim(raw)), '^@+', ''), '[^a-z0-9._]', '', 'g') AS handle FROM (VALUES {HANDLES}) v(raw)")
def handle_normalize(spark, sf_dir):
    return values(spark, HANDLES, "raw").select("raw", T.social_handle(F.col("raw")).alias("handle"))
