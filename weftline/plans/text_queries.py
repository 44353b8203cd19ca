"""Queries over texts, rules and pages."""

import re

from pyspark.sql import functions as F

from ..functions import rules as R, text as T, urls as U
from ..operators import dedupe
from ..sources import pages as P
from .registry import query, table, values
from .url_queries import HOST

_CLEAN = "trim(regexp_replace(text, '[ \\t\\n\\r\\x0B\\f]+', ' ', 'g'))"


@query(f"SELECT doc_id, CASE WHEN length(c) <= 800 THEN c ELSE rtrim(substr(c, 1, 799)) || '…' END AS said FROM (SELECT doc_id, {_CLEAN} AS c FROM documents)")
def text_clean_truncate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.truncate(T.clean(F.col("text"))).alias("said"))


_PROMO = (
    "coalesce(trim(text) <> '' AND (regexp_matches(text, '(?i)([0-9]+\\s*%\\s*(off|indirim(li|de)?)|%\\s*[0-9]+\\s*(off|indirim(li|de)?)?)') OR regexp_matches(text, '(?i)\\b(sale|discount|promo(tion|tional)?|clearance|indirim(li|de)?)\\b')"
    " OR regexp_matches(text, '(?i)\\b(register|registration|rsvp|sign\\s*up)\\b')::int + regexp_matches(text, '(?i)\\b(store|opening|flagship|boutique)\\b')::int + regexp_matches(text, '(?i)\\b(invite|invitation)\\b')::int >= 2), false)"
)
POSTS = """('50% off everything'),('% 20 indirim'),('Summer SALE now'),('A promotional code'),('clearance today'),('RSVP for the opening'),('you are invited: an invitation to our store'),('sign up for our flagship'),
('%30 indirimde'),('visit our store'),('wholesale wool'),('we register nothing'),(''),('   '),(NULL),('100 % cotton'),('register now'),('discounted')"""


@query(f"SELECT text, {_PROMO} AS promo FROM (VALUES {POSTS}) v(text)")
def promo_literals(spark, sf_dir):
    return values(spark, POSTS, "text").select("text", T.promotional(F.col("text")).alias("promo"))


@query(f"SELECT {_PROMO} AS promo, count(*) AS n FROM (SELECT text FROM conversations UNION ALL SELECT text FROM documents) GROUP BY 1")
def promo_conversations(spark, sf_dir):
    both = table(spark, sf_dir, "conversations").select("text").unionByName(table(spark, sf_dir, "documents").select("text"))
    return both.groupBy(T.promotional(F.col("text")).alias("promo")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, p_size AS width, CAST(1 + p_partkey % 7 AS INTEGER) AS height FROM part WHERE p_size >= 20")
def resolution_parse(spark, sf_dir):
    said = F.format_string("%dx%d", "p_size", 1 + F.col("p_partkey") % 7)
    got = table(spark, sf_dir, "part").select("p_partkey", T.resolution(said).alias("r")).select("p_partkey", "r.*")
    return got.where(R.large_enough(F.col("width"), F.col("height"), F.lit(20), F.lit(1)))


@query("SELECT p_partkey, printf('#%02X%02X%02X', p_size, p_partkey % 256, (p_partkey * 7) % 256) AS hex FROM part")
def rgb_hex(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.rgb_hex(F.col("p_size"), F.col("p_partkey") % 256, (F.col("p_partkey") * 7) % 256).alias("hex"))


NODES = """('{"edge_media_to_caption":{"edges":[{"node":{"text":" hello "}}]}}'),('{"edge_media_to_caption":{"edges":[]}}'),('{"edge_media_to_caption":{"edges":[{"node":{"text":"  "}}]}}'),('not json')"""


@query("SELECT j, nullif(trim(CASE WHEN json_valid(j) THEN json_extract_string(j, '$.edge_media_to_caption.edges[0].node.text') END), '') AS caption FROM (VALUES " + NODES + ") v(j)")
def caption_literals(spark, sf_dir):
    return values(spark, NODES, "j").select("j", T.caption(F.col("j")).alias("caption"))


@query("SELECT event_id, CAST(nullif(trim(json_extract_string(props, '$.k')), '') AS BIGINT) AS k FROM events")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.scalar_text(F.col("props"), "$.k").cast("long").alias("k"))


@query("SELECT p_partkey, '[' || concat_ws(' · ', 'Image ' || p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'product: ' || p_name END, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE 'sku: ' || p_brand END) || ']' AS caption FROM part")
def caption_parts(spark, sf_dir):
    name = F.when(F.col("p_partkey") % 3 == 0, F.lit("")).otherwise(F.col("p_name"))
    brand = F.when(F.col("p_partkey") % 5 != 0, F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", T.image_caption(F.col("p_partkey"), name, brand).alias("caption"))


FETCHED = """(429,map('a','b'),'x'),(403,map('server','AkamaiGHost'),'no'),(403,map('server','nginx'),'Access Denied: Reference #1'),(403,map('server','nginx'),'no'),(400,map('Server','AkamaiGHost'),'x'),(400,map('server','x'),'error GE401001'),
(400,map('server','x'),'bad'),(200,map('server','x'),'<html>bm-verify</html>'),(200,map('server','x'),'<title> &nbsp; </title>'),(200,map('server','x'),'<title>Shop</title>'),(404,map('server','akamai'),'akamai'),(200,map('server','x'),'')"""


def _duck_fetched() -> str:
    return re.sub(r"map\('([^']*)','([^']*)'\)", r"MAP {'\1': '\2'}", FETCHED)


_VALUES_OF = "lower(array_to_string(map_values(headers), ' '))"


@query(
    "WITH f AS (SELECT status, lower(body) AS b, body, " + _VALUES_OF + " AS h FROM (VALUES " + _duck_fetched() + ") v(status, headers, body)) SELECT status, body, split_part(x, '|', 1) AS provider, split_part(x, '|', 2) AS reason FROM (SELECT status, body, CASE"
    " WHEN status = 429 THEN 'unknown|http_429_rate_limited' WHEN status = 403 AND (regexp_matches(b, 'akamai|page_owner|access denied|reference #|edgesuite[.]net') OR regexp_matches(h, 'ak_bmsc|akamai')) THEN 'akamai|http_403_forbidden'"
    " WHEN status = 403 THEN 'unknown|http_403_forbidden' WHEN status = 400 AND (contains(h, 'akamaighost') OR contains(body, 'GE401001')) THEN 'akamai|http_400_bad_request'"
    " WHEN status = 200 AND (regexp_matches(b, 'bm-verify|/interstitial/ic[.]html|triggerinterstitialchallenge') OR (length(body) < 8000 AND regexp_matches(b, '<title>\\s*&nbsp;\\s*</title>'))) THEN 'akamai|interstitial_challenge' END AS x FROM f) WHERE x IS NOT NULL"
)
def bot_detect(spark, sf_dir):
    got = values(spark, FETCHED, "status, headers, body").withColumn("x", R.block(F.col("status"), F.col("headers"), F.col("body")))
    return got.where("x is not null").select("status", "body", "x.provider", "x.reason")


PROFILE_PAGES = """('{"error_type":"user_not_found"}'),('<p>fine</p>'),('sorry, this page isn''t available'),('{"url":"userbyrestid","status":401}')"""


@query("SELECT html, NOT (contains(html, '\"error_type\":\"user_not_found\"') OR contains(html, '\"page_not_found\"') OR contains(html, 'sorry, this page isn''t available')) AS profile_ok, NOT contains(html, '\"url\":\"userbyrestid\",\"status\":401') AS timeline_ok FROM (VALUES " + PROFILE_PAGES + ") v(html)")
def profile_pages(spark, sf_dir):
    rows = spark.createDataFrame([('{"error_type":"user_not_found"}',), ("<p>fine</p>",), ("sorry, this page isn't available",), ('{"url":"userbyrestid","status":401}',)], "html string")
    return rows.select("html", R.profile_page_ok(F.col("html")).alias("profile_ok"), R.timeline_page_ok(F.col("html")).alias("timeline_ok"))


@query("SELECT page_id, regexp_replace(url, '#.*$', '') AS url FROM (SELECT page_id, url, CASE WHEN page_id % 4 = 0 THEN 'application/json' ELSE 'Text/HTML; charset=utf-8' END AS ct FROM pages) WHERE contains(lower(ct), 'html')")
def html_only(spark, sf_dir):
    ct = F.when(F.col("page_id") % 4 == 0, "application/json").otherwise("Text/HTML; charset=utf-8")
    return table(spark, sf_dir, "pages").where(R.html_content(ct)).select("page_id", U.defragment(F.col("url")).alias("url"))


_BARE = "regexp_replace(html, '(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', '', 'g')"


def _plain(x: str) -> str:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, '{a}', '{b}')" if a != "&lt;" else f"replace(regexp_replace({x}, '<[^>]*>', '', 'g'), '{a}', '{b}')"
    return f"trim(regexp_replace({x}, '[ \\t\\n\\r]+', ' ', 'g'))"


@query("SELECT page_id, url, href FROM (SELECT DISTINCT page_id, url, unnest(regexp_extract_all(html, '<a [^>]*href=\"([^\"]*)\"', 1)) AS href FROM pages)")
def html_links(spark, sf_dir):
    return P.links(table(spark, sf_dir, "pages"))


@query(f"SELECT host, count(DISTINCT href) AS hrefs, count(*) AS links FROM (SELECT {HOST} AS host, unnest(regexp_extract_all(html, '<a [^>]*href=\"([^\"]*)\"', 1)) AS href FROM pages) GROUP BY 1")
def html_links_distinct_by_host(spark, sf_dir):
    got = P.links(table(spark, sf_dir, "pages"), per_page=False).withColumn("host", U.host(F.col("url")))
    return got.groupBy("host").agg(F.countDistinct("href").alias("hrefs"), F.count("*").alias("links"))


@query("SELECT DISTINCT page_id, url, regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) || regexp_replace(href, '#.*$', '') AS link FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '<a [^>]*href=\"([^\"]*)\"', 1)) AS href FROM pages) WHERE starts_with(href, '/')")
def html_site_links(spark, sf_dir):
    return P.site_links(table(spark, sf_dir, "pages"))


_TITLE = _plain("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")


@query(f"SELECT page_id, {_TITLE} AS title FROM pages")
def html_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", P.title(F.col("html")).alias("title"))


@query(f"SELECT page_id, hero FROM (SELECT page_id, {_plain('h')} AS hero FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<h1[^>]*>(.*?)</h1>', 1)) AS h FROM pages)) WHERE length(hero) >= 12")
def html_hero(spark, sf_dir):
    got = table(spark, sf_dir, "pages").select("page_id", F.explode(P.headings(F.col("html"))).alias("hero"))
    return got.where(F.length("hero") >= T.LEAST_HERO)


_PARAGRAPHS = (
    f"SELECT page_id, url, CAST(i - 1 AS INTEGER) AS ord, text FROM (SELECT page_id, url, i, {_plain('split_part(part, chr(60) || chr(47) || chr(112) || chr(62), 1)')} AS text FROM"
    f" (SELECT page_id, url, unnest(parts[2:]) AS part, generate_subscripts(parts[2:], 1) AS i FROM (SELECT page_id, url, string_split_regex({_BARE}, '<p(?:\\s[^>]*)?>') AS parts FROM pages))) WHERE length(text) >= 40"
)


@query(_PARAGRAPHS)
def html_paragraphs(spark, sf_dir):
    return P.paragraphs(table(spark, sf_dir, "pages"))


def _page_texts(spark, sf_dir):
    """Titles, headings and paragraphs of every page, with host, order and weight."""
    every = P.literal_snippets(table(spark, sf_dir, "pages"))
    return every.select(U.host(F.col("url")).alias("host"), (F.col("page_id") * 100_000 + F.col("ord")).alias("ord"), "weight", T.truncate(F.col("text")).alias("text"))


_TEXTS = (
    f"SELECT {HOST} AS host, page_id * 100000 + ord AS ord, weight, CASE WHEN length(text) <= 800 THEN text ELSE rtrim(substr(text, 1, 799)) || '…' END AS text FROM (SELECT page_id, url, 0 AS ord, CAST(0.4 AS DOUBLE) AS weight, {_TITLE} AS text FROM pages"
    f" UNION ALL SELECT page_id, url, 1, 1.1, text FROM (SELECT page_id, url, {_plain('h')} AS text FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '(?s)<h1[^>]*>(.*?)</h1>', 1)) AS h FROM pages)) WHERE length(text) >= 12"
    f" UNION ALL SELECT page_id, url, ord + 2, 1.5, text FROM ({_PARAGRAPHS})) WHERE text <> ''"
)
_RANKED = (
    f"WITH t AS ({_TEXTS}), k AS (SELECT *, min(ord) OVER (PARTITION BY host, lower(trim(text))) AS f, row_number() OVER (PARTITION BY host, lower(trim(text)) ORDER BY weight DESC, ord) AS n FROM t),"
    " r AS (SELECT host, text, weight, row_number() OVER (PARTITION BY host ORDER BY weight DESC, f) AS rank FROM k WHERE n = 1)"
)


@query(_RANKED + " SELECT host, text, weight, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 40")
def html_snippets_ranked(spark, sf_dir):
    return dedupe.heaviest_texts(_page_texts(spark, sf_dir), ["host"], 40).select("host", "text", "weight", "rank")


@query(_RANKED + " SELECT host, count(*) AS n, round(sum(weight), 6) AS weight FROM r WHERE rank <= 40 GROUP BY 1")
def html_snippets_by_host(spark, sf_dir):
    got = dedupe.heaviest_texts(_page_texts(spark, sf_dir), ["host"], 40)
    return got.groupBy("host").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 6).alias("weight"))


SETS = """('https://a.example.com/1.jpg 1x, https://a.example.com/2.jpg 2x'),('/img/a.png 320w, /img/b.webp 640w'),('https://a.example.com/only.gif'),('')"""


@query(
    "WITH u AS (SELECT v, list_concat(regexp_extract_all(v, '(https?://[^\\s]+?)(?:\\s+[0-9]+[wx])?(?:,|$)', 1), regexp_extract_all(v, '(?i)(/?[\\w./%-]+[.](?:jpg|jpeg|png|webp|gif))\\s+[0-9]+[wx]', 1)) AS l FROM (VALUES " + SETS + ") t(v))"
    " SELECT DISTINCT v, unnest(l) AS url FROM u"
)
def srcset_parse(spark, sf_dir):
    return values(spark, SETS, "v").select("v", F.explode(P.srcset(F.col("v"))).alias("url"))


EMBEDDED = """('{"portraitURL":"https://a.example.com/p.jpg","x":1} <b>https://b.example.com/z.PNG?v=2</b> "src" : "https://c.example.com/q.svg"'),('{"imageUrl":"https://a.example.com/p.jpg#f"}'),('none')"""


@query(
    "WITH u AS (SELECT html, unnest(list_concat(regexp_extract_all(html, '\"(?:portraitURL|imageUrl|src)\"\\s*:\\s*\"(https://[^\"]+)\"', 1), regexp_extract_all(html, '(?i)https://[^\\s\"''<>\\\\]+?[.](?:jpg|jpeg|png|webp|gif)(?:[?][^\\s\"''<>\\\\]*)?'))) AS url FROM (VALUES " + EMBEDDED + ") t(html))"
    " SELECT DISTINCT html, regexp_replace(url, '#.*$', '') AS url FROM u WHERE regexp_matches(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)), '[.](jpg|jpeg|png|webp|gif)$')"
)
def embedded_images(spark, sf_dir):
    return values(spark, EMBEDDED, "html").select("html", F.explode(P.embedded_images(F.col("html"), ("portraitURL", "imageUrl", "src"))).alias("url"))


@query("SELECT page_id, substr(html, 1, 10000) AS sample FROM pages")
def page_samples(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", P.sample(F.col("html")).alias("sample"))


@query(
    "WITH r AS (SELECT source, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) SELECT source, string_agg('- [editorial | weight=1.5 | doc:' || doc_id || ']' || chr(10) || '  ' || substr(text, 1, 200), chr(10) ORDER BY n) AS lines FROM r WHERE n <= 30 GROUP BY 1"
)
def prompt_lines(spark, sf_dir):
    top = dedupe.first_few(table(spark, sf_dir, "documents"), ["source"], ["doc_id"], 30)
    line = T.prompt_line(F.lit("editorial"), F.lit(1.5), F.concat(F.lit("doc:"), F.col("doc_id").cast("string")), F.substring("text", 1, 200))
    got = top.select("source", "rank", line.alias("line")).groupBy("source").agg(F.sort_array(F.collect_list(F.struct("rank", "line"))).alias("x"))
    return got.select("source", F.array_join(F.transform("x", lambda e: e["line"]), "\n").alias("lines"))


@query("SELECT source, string_agg(substr(text, 1, 200), ' / ' ORDER BY doc_id) AS summary FROM (SELECT source, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n <= 15 GROUP BY 1")
def judge_summary(spark, sf_dir):
    top = dedupe.first_few(table(spark, sf_dir, "documents"), ["source"], ["doc_id"], 15)
    got = top.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("rank", F.substring("text", 1, 200).alias("t")))).alias("x"))
    return got.select("source", F.array_join(F.transform("x", lambda e: e["t"]), " / ").alias("summary"))


@query(None)
def page_snippets(spark, sf_dir):
    """Every snippet kind, by the element tree; held against literal pages in the tests."""
    return P.snippets(table(spark, sf_dir, "pages"))
