"""Queries that choose, join, merge, sample and rank rows."""

import datetime

from pyspark.sql import functions as F

from ..functions import rules as R, urls as U
from ..operators import clusters, crawl, dedupe, gates, hamming, match, merge, palette, sampling, scoring, themes
from ..sources import rules as X
from ..streaming import pages as stream
from .registry import query, table, values

# -- filters ---------------------------------------------------------------------------------


@query("SELECT p_partkey, p_size AS width, CAST(1 + p_partkey % 7 AS INTEGER) AS height FROM part WHERE p_size / (1 + p_partkey % 7) BETWEEN 0.4 AND 2.5 AND p_size > 0")
def gate_heuristic(spark, sf_dir):
    images = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("width"), (1 + F.col("p_partkey") % 7).cast("int").alias("height"))
    return gates.gate(images, "heuristic")


@query("SELECT vec_id, CAST(label AS BIGINT) AS label FROM embeddings")
def gate_null(spark, sf_dir):
    return gates.gate(table(spark, sf_dir, "embeddings"), "null").select("vec_id", F.col("label").cast("long").alias("label"))


@query(
    "WITH p AS (SELECT vec_id AS prompt_id, CAST(embedding AS DOUBLE[]) AS p FROM embeddings WHERE vec_id <= 8), v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id > 8), s AS (SELECT vec_id, prompt_id < 4 AS pos,"
    " 100 * list_dot_product(e, p) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(p, p))) AS s FROM v, p), m AS (SELECT vec_id, max(s) AS m FROM s GROUP BY 1)"
    " SELECT vec_id, round(sum(exp(s - m)) FILTER (WHERE pos) / sum(exp(s - m)), 6) AS share FROM s JOIN m USING (vec_id) GROUP BY 1 HAVING sum(exp(s - m)) FILTER (WHERE pos) / sum(exp(s - m)) >= 0.55"
)
def gate_softmax(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    prompts = e.where("vec_id <= 8").select(F.col("vec_id").alias("prompt_id"), F.col("embedding").alias("prompt"), (F.col("vec_id") < 4).alias("positive"))
    return gates.by_prompts(e.where("vec_id > 8"), prompts).select("vec_id", F.round("share", 6).alias("share"))


@query("SELECT p_partkey, p_size AS width, CAST(10 + p_partkey % 41 AS INTEGER) AS height FROM part WHERE p_size >= 25 AND 10 + p_partkey % 41 >= 25")
def resolution_filter(spark, sf_dir):
    sized = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("width"), (10 + F.col("p_partkey") % 41).cast("int").alias("height"))
    return sized.where(R.large_enough(F.col("width"), F.col("height"), F.lit(25), F.lit(25)))


@query("SELECT l_orderkey, l_linenumber FROM (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE 'n' || l_partkey END AS name, CASE WHEN l_suppkey % 4 = 0 THEN '' ELSE 's' || l_suppkey END AS sku FROM lineitem) WHERE name <> '' AND sku <> ''")
def complete_metadata(spark, sf_dir):
    name, sku = F.when(F.col("l_partkey") % 3 != 0, F.concat(F.lit("n"), "l_partkey")), F.when(F.col("l_suppkey") % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("s"), "l_suppkey"))
    return table(spark, sf_dir, "lineitem").where(R.complete(name, sku)).select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"))


# -- crawl -----------------------------------------------------------------------------------

_EDGES = "(SELECT page_id AS src, (3 * page_id + 1) % (SELECT count(*) FROM pages) AS dst FROM pages UNION ALL SELECT page_id, (7 * page_id + 5) % (SELECT count(*) FROM pages) FROM pages)"


def _edges(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    n = pages.count()
    ends = F.explode(F.array((3 * F.col("page_id") + 1) % n, (7 * F.col("page_id") + 5) % n))
    return pages.select(F.col("page_id").alias("src"), ends.alias("dst"))


_REACH = f"WITH RECURSIVE r AS (SELECT CAST(0 AS BIGINT) AS node, CAST(0 AS BIGINT) AS depth UNION SELECT e.dst, r.depth + 1 FROM r JOIN {_EDGES} e ON e.src = r.node WHERE r.depth < 5) SELECT node, min(depth) AS depth FROM r GROUP BY node"


@query(_REACH)
def crawl_levels(spark, sf_dir):
    edges = _edges(spark, sf_dir).select(F.lit("s").alias("site"), F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))
    got = crawl.reach(edges, spark.createDataFrame([("s", "0")], "site string, url string"), 5)
    return got.select(F.col("url").cast("long").alias("node"), F.col("depth").cast("long").alias("depth"))


@query(_REACH)
def crawl_recursive(spark, sf_dir):
    _edges(spark, sf_dir).createOrReplaceTempView("weftline_edges")
    return crawl.reach_sql(spark, "weftline_edges", 0, 5)


_HREFS = "(SELECT DISTINCT page_id, url, unnest(regexp_extract_all(html, '<a [^>]*href=\"([^\"]*)\"', 1)) AS href FROM pages)"


@query(f"SELECT page_id, href, CAST(rank AS INTEGER) AS rank FROM (SELECT page_id, href, row_number() OVER (PARTITION BY page_id ORDER BY CASE WHEN regexp_matches(href, '^/(the|and|of)') THEN 0 ELSE 1 END, href) AS rank FROM {_HREFS}) WHERE rank <= 3")
def crawl_priority_topk(spark, sf_dir):
    from ..sources.pages import links

    got = links(table(spark, sf_dir, "pages"))
    return dedupe.first_few(got, ["page_id"], [F.when(F.col("href").rlike("^/(the|and|of)"), 0).otherwise(1), "href"], 3).select("page_id", "href", "rank")


@query(
    "WITH s AS (SELECT DISTINCT regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) AS site FROM pages), p AS (SELECT unnest(['/about', '/about-us', '/our-story', '/story', '/journal', '/manifesto', '/sustainability']) AS probe, unnest([0, 1, 2, 3, 4, 5, 6]) AS ord),"
    " t AS (SELECT site, site || probe AS url, row_number() OVER (PARTITION BY site ORDER BY ord) AS rank FROM s, p WHERE NOT (probe = '/about' AND length(site) % 2 = 0)) SELECT site, url, CAST(rank AS INTEGER) AS rank FROM t WHERE rank <= 4 AND length(site) % 2 = 1"
)
def crawl_unvisited_editorial(spark, sf_dir):
    origin = F.regexp_extract("url", "^([A-Za-z]+://[^/?#]*)", 1)
    seeds = table(spark, sf_dir, "pages").select(origin.alias("site"), origin.alias("url")).distinct()
    visited = seeds.where(F.length("site") % 2 == 0).select("site", F.concat("site", F.lit("/about")).alias("url")).unionByName(seeds)
    return crawl.editorial_probes(seeds, visited)


@query(f"SELECT page_id, href, rank FROM (SELECT page_id, href, regexp_matches(href, '/w/|/t/|/products/|/product/|/p/|/shop/') AS pri, CAST(row_number() OVER (PARTITION BY page_id, regexp_matches(href, '/w/|/t/|/products/|/product/|/p/|/shop/') ORDER BY href) AS INTEGER) AS rank FROM {_HREFS}) WHERE rank <= CASE WHEN pri THEN 2 ELSE 1 END")
def crawl_sample_pages(spark, sf_dir):
    from ..sources.pages import links

    got = links(table(spark, sf_dir, "pages")).select(F.lit("all").alias("site"), F.col("page_id").alias("src"), F.col("href").alias("dst"))
    return crawl.sample_pages(got).select(F.col("src").alias("page_id"), F.col("dst").alias("href"), "rank")


@query("SELECT page_id, unnest(hrefs) AS href FROM (SELECT page_id, list_filter(list_distinct(list_transform(string_split(html, '<a '), lambda x: CASE WHEN contains(x, 'href=\"') THEN split_part(split_part(x, 'href=\"', 2), '\"', 1) END)), lambda x: x <> '') AS hrefs FROM pages)")
def html_links_any_markup(spark, sf_dir):
    """Links of the pages written anew: in single quotes, bare and in upper case, with other attributes before, and in comments, which don't count."""
    from ..sources.pages import links

    k = F.col("page_id") % 4
    upper = F.regexp_replace("html", '<a [^>]*?href="([^"]*)"', "<A data-href=\"/no\" title='a > b'\n HREF = \"$1\"")
    single = F.regexp_replace("html", '<a [^>]*?href="([^"]*)"', "<a id=x href='$1'")
    bare = F.regexp_replace("html", '<a [^>]*?href="([^"\\s>]+)"', "<a href=$1 class=y")
    html = F.when(k == 0, upper).when(k == 1, single).when(k == 2, bare).otherwise(F.concat(F.lit("<!-- <a href='/c'> --><script>'<a href=/s>'</script><abbr href='/n'>"), "html"))
    return links(table(spark, sf_dir, "pages").select("page_id", "url", html.alias("html"))).select("page_id", "href")


def _walk(spark, sf_dir):
    """Ten sites of pages with four links each; every fifth page was not captured."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("id"))
    m = F.greatest(F.floor(F.lit(pages.agg(F.count("*").alias("n")).scalar()) / 10), F.lit(1))
    site, k = F.col("id") % 10, F.floor(F.col("id") / 10)
    name = lambda i: F.concat(F.lit("https://s"), (i % 10).cast("string"), F.when(i % 3 == 0, "/t/").otherwise("/a/"), i.cast("string"))
    ends = F.posexplode(F.array(*(site + 10 * ((a * k + b) % m) for a, b in ((3, 1), (7, 5), (1, 2), (5, 3)))))
    links = pages.where("id % 5 <> 4").select(site.alias("site"), name(F.col("id")).alias("src"), ends.alias("pos", "to")).select("site", "src", "pos", name(F.col("to")).alias("dst"))
    captured = pages.where("id % 5 <> 4").select(site.alias("site"), name(F.col("id")).alias("url"))
    return links, pages.where("id < 10").select(site.alias("site"), name(F.col("id")).alias("url")), captured


_NAME = "'https://s' || ({0}) % 10 || CASE WHEN ({0}) % 3 = 0 THEN '/t/' ELSE '/a/' END || ({0})"


@query(
    f"WITH RECURSIVE m AS (SELECT greatest(count(*) // 10, 1) AS m FROM pages), l AS (SELECT page_id, pos, page_id % 10 + 10 * ((a * (page_id // 10) + b) % m) AS dst FROM pages, m, (VALUES (0, 3, 1), (1, 7, 5), (2, 1, 2), (3, 5, 3)) v(pos, a, b) WHERE page_id % 5 <> 4),"
    f" kids AS (SELECT {_NAME.format('page_id')} AS url, coalesce(list({_NAME.format('dst')} ORDER BY pos) FILTER (WHERE dst % 3 = 0), []) AS p, coalesce(list({_NAME.format('dst')} ORDER BY pos) FILTER (WHERE dst % 3 <> 0), []) AS o FROM l GROUP BY page_id),"
    f" w AS (SELECT page_id % 10 AS site, [{_NAME.format('page_id')}] AS q, []::VARCHAR[] AS seen, []::VARCHAR[] AS took FROM pages WHERE page_id < 10 UNION ALL"
    " SELECT site, CASE WHEN list_contains(seen, q[1]) OR kids.url IS NULL OR len(took) = 3 THEN q[2:] ELSE q[2:] || list_filter(p, lambda x: x <> q[1] AND NOT list_contains(seen, x))[:2] || CASE WHEN len(took) = 0 THEN list_filter(o, lambda x: x <> q[1] AND NOT list_contains(seen, x))[:1] ELSE [] END END,"
    " CASE WHEN list_contains(seen, q[1]) THEN seen ELSE list_append(seen, q[1]) END, CASE WHEN list_contains(seen, q[1]) OR kids.url IS NULL THEN took ELSE list_append(took, q[1]) END FROM w LEFT JOIN kids ON kids.url = w.q[1] WHERE len(q) > 0 AND len(took) < 4)"
    " SELECT site, CAST(unnest(range(len(took))) AS INTEGER) AS nth, unnest(took) AS url FROM w WHERE len(q) = 0 OR len(took) = 4"
)
def crawl_sampled(spark, sf_dir):
    links, seeds, captured = _walk(spark, sf_dir)
    return crawl.sampled(links, seeds, captured).select("site", "nth", "url")


# -- candidates and products -----------------------------------------------------------------

_ORD = "(l_orderkey * 100 + l_linenumber) * 100000 + l_suppkey"


def _candidates(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    order = (F.col("l_orderkey") * 100 + F.col("l_linenumber")) * 100_000 + F.col("l_suppkey")
    name = F.when(F.col("l_orderkey") % 3 == 0, F.lit(None).cast("string")).when(F.col("l_orderkey") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("n"), "l_suppkey"))
    sku = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("s"), F.col("l_suppkey") % 50))
    return li.select(F.lit(1).alias("brand"), F.col("l_partkey").cast("string").alias("url"), order.alias("ord"), F.col("l_orderkey").cast("string").alias("source_page"), name.alias("product_name"), sku.alias("sku_id"), F.col("l_extendedprice").alias("tie"))


_CANDIDATES = (
    f"(SELECT CAST(l_partkey AS VARCHAR) AS url, {_ORD} AS ord, CAST(l_orderkey AS VARCHAR) AS source_page, CASE WHEN l_orderkey % 3 = 0 THEN NULL WHEN l_orderkey % 5 = 0 THEN '' ELSE 'n' || l_suppkey END AS product_name,"
    " CASE WHEN l_linenumber % 2 = 0 THEN 's' || (l_suppkey % 50) END AS sku_id, l_extendedprice AS tie FROM lineitem)"
)


@query(f"SELECT url, arg_min(source_page, ord) AS source_page, arg_min(product_name, ord) FILTER (WHERE product_name <> '') AS product_name, arg_min(sku_id, ord) FILTER (WHERE sku_id <> '') AS sku_id FROM {_CANDIDATES} GROUP BY url")
def candidate_url_merge(spark, sf_dir):
    return dedupe.merged_candidates(_candidates(spark, sf_dir), ["brand"]).select("url", "source_page", "product_name", "sku_id")


@query(f"SELECT sku_id, url, product_name FROM (SELECT *, row_number() OVER (PARTITION BY sku_id ORDER BY ord, url, tie) AS n FROM {_CANDIDATES} WHERE product_name <> '' AND sku_id <> '') WHERE n = 1")
def dedupe_sku_first(spark, sf_dir):
    return dedupe.one_image_per_sku(_candidates(spark, sf_dir), ["brand"], ["ord", "url", "tie"]).select("sku_id", "url", "product_name")


@query(f"SELECT url, source_page FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY ord, source_page, tie) AS n FROM {_CANDIDATES}) WHERE n = 1")
def dedupe_first_url(spark, sf_dir):
    return dedupe.first_by(_candidates(spark, sf_dir), ["url"], ["ord", "source_page", "tie"]).select("url", "source_page")


_WEIGHT = "CAST((doc_id * 7) % 5 AS DOUBLE)"


@query(
    f"WITH k AS (SELECT source, doc_id, text, {_WEIGHT} AS w, min(doc_id) OVER (PARTITION BY source, lower(trim(text))) AS f, row_number() OVER (PARTITION BY source, lower(trim(text)) ORDER BY {_WEIGHT} DESC, doc_id) AS n FROM documents)"
    " SELECT source, doc_id, CAST(rank AS INTEGER) AS rank FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY w DESC, f) AS rank FROM k WHERE n = 1) WHERE rank <= 40"
)
def dedupe_text_weight(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", F.col("doc_id").alias("ord"), "text", ((F.col("doc_id") * 7) % 5).cast("double").alias("weight"))
    return dedupe.heaviest_texts(rows, ["source"]).select("source", "doc_id", "rank")


@query(
    "WITH p AS (SELECT p_brand, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_type || p_size % 10 END AS sku, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END AS name, p_partkey AS ord, 'u' || (p_partkey % 97) AS img FROM part)"
    " SELECT p_brand, sku AS sku_id, min(ord) AS ord, arg_min(name, ord) FILTER (WHERE name <> '') AS name, array_to_string(list_sort(list_distinct(list(img))), ',') AS images FROM p GROUP BY p_brand, sku, CASE WHEN sku IS NULL THEN ord END"
)
def dedupe_products_union(spark, sf_dir):
    sku = F.when(F.col("p_partkey") % 4 != 0, F.concat("p_type", F.col("p_size") % 10))
    name = F.when(F.col("p_partkey") % 3 == 0, F.lit("")).otherwise(F.col("p_name"))
    rows = table(spark, sf_dir, "part").select("p_brand", sku.alias("sku_id"), name.alias("name"), F.col("p_partkey").alias("ord"), F.array(F.concat(F.lit("u"), F.col("p_partkey") % 97)).alias("image_urls"))
    return dedupe.merged_products(rows, ["p_brand"]).select("p_brand", "sku_id", "ord", "name", F.array_join("image_urls", ",").alias("images"))


def _products(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    sku = F.when(F.col("p_partkey") % 2 == 0, F.format_string("AB%d-%d", "p_size", F.col("p_partkey"))).otherwise(F.concat(F.lit("plain"), "p_partkey"))
    image = F.concat(F.lit("https://x.example.com/"), F.lpad(F.lower(F.hex(F.col("p_partkey") % 500)), 8, "0"), F.lit("/i"), F.col("p_partkey") % 40, F.lit(".jpg"))
    return part.select("p_brand", F.col("p_partkey").alias("product_ord"), F.col("p_name").alias("name"), sku.alias("sku_id"), F.array(image).alias("image_urls"))


_PRODUCTS = (
    "(SELECT p_brand, p_partkey AS product_ord, p_name AS name, CASE WHEN p_partkey % 2 = 0 THEN printf('AB%d-%d', p_size, p_partkey) ELSE 'plain' || p_partkey END AS sku_id,"
    " 'https://x.example.com/' || lpad(lower(to_hex(p_partkey % 500)), 8, '0') || '/i' || (p_partkey % 40) || '.jpg' AS image, lpad(lower(to_hex(p_partkey % 500)), 8, '0') AS key FROM part)"
)


@query(f"SELECT p_brand, image AS url, arg_max(name, product_ord) AS name, arg_max(sku_id, product_ord) AS sku_id FROM {_PRODUCTS} GROUP BY 1, 2")
def product_exact_match(spark, sf_dir):
    products = _products(spark, sf_dir)
    images = products.select("p_brand", F.explode("image_urls").alias("url")).distinct()
    return match.exact(images, products, ["p_brand"]).select("p_brand", "url", "name", "sku_id")


@query(
    f"WITH p AS (SELECT * FROM {_PRODUCTS}), i AS (SELECT DISTINCT p_brand, 'https://cdn.example.com/' || key || '/big.png' AS url, key FROM p), m AS (SELECT i.p_brand, i.url, p.name, p.sku_id, row_number() OVER (PARTITION BY i.p_brand, i.url ORDER BY CASE WHEN regexp_matches(upper(p.sku_id), '{U.STYLE_CODE}') THEN 0 ELSE 1 END, product_ord) AS n"
    " FROM i JOIN p ON p.p_brand = i.p_brand AND p.key = i.key) SELECT p_brand, url, name, sku_id FROM m WHERE n = 1"
)
def product_key_match(spark, sf_dir):
    products = _products(spark, sf_dir)
    key = F.element_at(F.split(F.col("image_urls")[0], "/"), -2)
    images = products.select("p_brand", F.concat(F.lit("https://cdn.example.com/"), key, F.lit("/big.png")).alias("url")).distinct()
    return match.by_keys(images, products, ["p_brand"])


@query(
    "WITH c AS (SELECT p_brand, p_type, p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name END AS product_name, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'own' END AS sku_id, CASE WHEN p_partkey % 5 = 0 THEN '/x/' ELSE '/t/' END AS page FROM part),"
    " s AS (SELECT p_brand, p_type, min(name) AS name, min(sku) AS sku FROM (SELECT p_brand, p_type, p_name AS name, 's' || p_partkey AS sku FROM part WHERE p_size <= 2) GROUP BY 1, 2 HAVING count(*) = 1)"
    " SELECT p_partkey, coalesce(nullif(product_name, ''), CASE WHEN contains(page, '/t/') THEN s.name END) AS product_name, coalesce(nullif(sku_id, ''), CASE WHEN contains(page, '/t/') THEN s.sku END) AS sku_id FROM c LEFT JOIN s USING (p_brand, p_type)"
)
def single_product_fill(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    page = F.when(F.col("p_partkey") % 5 == 0, "/x/").otherwise("/t/")
    cands = part.select("p_brand", "p_type", "p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).alias("product_name"), F.when(F.col("p_partkey") % 3 == 0, "").otherwise("own").alias("sku_id"), page.alias("page"))
    products = part.where("p_size <= 2").select("p_brand", "p_type", F.col("p_name").alias("name"), F.concat(F.lit("s"), "p_partkey").alias("sku_id"))
    return match.single_product_fill(cands, products, ["p_brand", "p_type"], "page", "/t/").select("p_partkey", "product_name", "sku_id")


@query(
    f"WITH p AS (SELECT * FROM {_PRODUCTS}), c AS (SELECT DISTINCT p_brand, image AS url, CASE product_ord % 3 WHEN 0 THEN 'cd9-1' WHEN 1 THEN 'dom' END AS dom_sku FROM p), e AS (SELECT p_brand, image AS url, arg_max(name, product_ord) AS name, arg_max(sku_id, product_ord) AS sku FROM p GROUP BY 1, 2)"
    f" SELECT p_brand, url, dom_sku, e.name AS product_name, CASE WHEN regexp_matches(upper(coalesce(dom_sku, e.sku)), '{U.STYLE_CODE}') THEN upper(coalesce(dom_sku, e.sku)) ELSE coalesce(dom_sku, e.sku) END AS sku_id FROM c JOIN e USING (p_brand, url)"
)
def candidate_match(spark, sf_dir):
    products = _products(spark, sf_dir)
    m = F.col("product_ord") % 3
    cands = products.select("p_brand", F.col("image_urls")[0].alias("url"), F.when(m == 0, "cd9-1").when(m == 1, "dom").alias("dom_sku"), F.lit(None).cast("string").alias("dom_name")).distinct()
    return match.matched(cands, products, ["p_brand"]).select("p_brand", "url", "dom_sku", "product_name", "sku_id")


# -- configurations --------------------------------------------------------------------------


@query("SELECT n.n_name, coalesce(r.r_name, 'default') AS rules FROM nation n LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 3) r ON n.n_regionkey = r.r_regionkey")
def config_lookup(spark, sf_dir):
    stored = table(spark, sf_dir, "region").where("r_regionkey < 3").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return table(spark, sf_dir, "nation").join(stored, "n_regionkey", "left").select("n_name", F.coalesce("r_name", F.lit("default")).alias("rules"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS domain, CASE WHEN n_nationkey % 3 = 0 THEN 'new' ELSE n_name END AS said FROM nation UNION ALL SELECT 100, 'new'")
def config_upsert(spark, sf_dir):
    at = F.lit(datetime.datetime(2026, 1, 1)).cast("timestamp")
    old = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("domain"), F.col("n_name").alias("said"), at.alias("updated_at"))
    new = old.where("domain % 3 = 0").withColumn("said", F.lit("new")).unionByName(spark.range(100, 101).select(F.col("id").alias("domain"), F.lit("new").alias("said"), at.alias("updated_at")))
    return X.upsert(old, new).select("domain", "said")


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) = (SELECT CAST(max(o_orderdate) AS DATE) FROM orders) AS fresh FROM orders")
def config_fresh(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    today = orders.agg(F.to_date(F.max("o_orderdate")).alias("today"))  # one row
    return orders.crossJoin(F.broadcast(today)).select("o_orderkey", R.fresh(F.col("o_orderdate"), F.col("today")).alias("fresh"))


@query("SELECT n_name AS domain, CASE WHEN n_nationkey % 4 = 0 THEN 'stored' WHEN n_nationkey % 3 = 0 THEN 'inferred' ELSE 'default' END AS origin FROM nation")
def config_resolve(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").withColumn("domain", F.col("n_name"))
    today, before = F.lit(datetime.datetime(2026, 5, 2, 9)).cast("timestamp"), F.lit(datetime.datetime(2026, 5, 1, 9)).cast("timestamp")
    stored = nation.where("n_nationkey % 2 = 0").select("domain", F.when(F.col("n_nationkey") % 4 == 0, today).otherwise(before).alias("updated_at"))
    inferred = nation.where("n_nationkey % 3 = 0").select("domain", today.alias("updated_at"))
    return X.resolve(nation, stored, inferred, F.lit(datetime.date(2026, 5, 2))).select("domain", "origin")


# -- bundles ---------------------------------------------------------------------------------

_BUNDLES = (
    "(SELECT o_custkey AS brand_id, CASE o_orderkey % 3 WHEN 0 THEN 'instagram' WHEN 1 THEN 'website' ELSE 'twitter' END AS source, o_orderkey AS bundle_ord, 'https://b' || o_orderkey AS brand_url, o_orderpriority AS min_resolution,"
    " o_orderkey % 11 AS pages_crawled, o_orderkey % 23 AS candidates_checked, CASE WHEN o_orderkey % 7 = 0 THEN 'p' || o_orderkey END AS provider FROM orders)"
)


def _bundles(spark, sf_dir):
    k = F.col("o_orderkey")
    block = F.when(k % 7 == 0, F.struct(F.lit("u").alias("url"), F.concat(F.lit("p"), k).alias("provider"), F.lit("r").alias("reason")))
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("brand_id"), F.when(k % 3 == 0, "instagram").when(k % 3 == 1, "website").otherwise("twitter").alias("source"), k.alias("bundle_ord"), F.concat(F.lit("https://b"), k).alias("brand_url"),
        F.col("o_orderpriority").alias("min_resolution"), (k % 11).alias("pages_crawled"), (k % 23).alias("candidates_checked"), block.alias("bot_protection"),
    )


@query(f"SELECT brand_id, CAST(sum(pages_crawled) AS BIGINT) AS pages_crawled, CAST(sum(candidates_checked) AS BIGINT) AS candidates_checked FROM {_BUNDLES} GROUP BY 1")
def bundle_merge_counts(spark, sf_dir):
    return merge.counters(_bundles(spark, sf_dir)).drop("bot_protection")


@query(f"SELECT brand_id, arg_min(provider, bundle_ord) FILTER (WHERE provider IS NOT NULL) AS provider FROM {_BUNDLES} GROUP BY 1")
def bundle_first_block(spark, sf_dir):
    return merge.counters(_bundles(spark, sf_dir)).select("brand_id", F.col("bot_protection.provider").alias("provider"))


@query(f"SELECT brand_id, brand_url, min_resolution FROM (SELECT *, row_number() OVER (PARTITION BY brand_id ORDER BY source <> 'website', bundle_ord) AS n FROM {_BUNDLES}) WHERE n = 1")
def bundle_primary(spark, sf_dir):
    return merge.primary(_bundles(spark, sf_dir))


@query(f"SELECT brand_id, url, bundle_ord FROM (SELECT l_suppkey AS brand_id, 'u' || l_partkey % 200 AS url, l_orderkey AS bundle_ord, row_number() OVER (PARTITION BY l_suppkey, l_partkey % 200 ORDER BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n = 1")
def bundle_images(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("brand_id"), F.concat(F.lit("u"), F.col("l_partkey") % 200).alias("url"), F.col("l_orderkey").alias("bundle_ord"), F.col("l_linenumber").alias("ord"))
    return merge.images(rows).select("brand_id", "url", "bundle_ord")


@query(
    "WITH t AS (SELECT source AS brand, doc_id, 0 AS b, text, CAST(doc_id % 3 AS DOUBLE) AS w FROM documents UNION ALL SELECT source, doc_id, 1, '  ' || text || ' ', CAST(doc_id % 2 AS DOUBLE) FROM documents WHERE doc_id % 2 = 0),"
    " k AS (SELECT *, row_number() OVER (PARTITION BY brand, lower(trim(text)) ORDER BY w DESC, b, doc_id) AS n FROM t) SELECT brand, count(*) AS texts, sum(w) AS weight FROM k WHERE n = 1 GROUP BY 1"
)
def bundle_texts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("brand_id"), F.lit(0).alias("bundle_ord"), F.col("doc_id").alias("ord"), "text", (F.col("doc_id") % 3).cast("double").alias("weight"))
    again = docs.where("ord % 2 = 0").withColumn("bundle_ord", F.lit(1)).withColumn("text", F.concat(F.lit("  "), "text", F.lit(" "))).withColumn("weight", (F.col("ord") % 2).cast("double"))
    return merge.texts(docs.unionByName(again)).groupBy(F.col("brand_id").alias("brand")).agg(F.count("*").alias("texts"), F.sum("weight").alias("weight"))


# -- samples ---------------------------------------------------------------------------------


@query(
    "WITH i AS (SELECT source AS brand, doc_id AS ord, lang AS page FROM documents), m AS (SELECT *, count(*) OVER (PARTITION BY brand) AS t, row_number() OVER (PARTITION BY brand, page ORDER BY ord) AS nth, min(ord) OVER (PARTITION BY brand, page) AS f FROM i),"
    " r AS (SELECT brand, ord, row_number() OVER (PARTITION BY brand ORDER BY CASE WHEN t > 20 AND nth > 1 THEN 1 ELSE 0 END, CASE WHEN t > 20 THEN f END, ord) AS rank FROM m) SELECT brand, ord, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 20"
)
def sample_diverse(spark, sf_dir):
    images = table(spark, sf_dir, "documents").select(F.col("source").alias("brand"), F.col("doc_id").alias("ord"), F.col("lang").alias("source_page"))
    return sampling.diverse(images, ["brand"], 20).select("brand", "ord", "rank")


@query("WITH n AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, count(*) OVER (PARTITION BY label) AS t FROM embeddings), k AS (SELECT label, t, least(20, t) AS k FROM n GROUP BY 1, 2), s AS (SELECT label, t, k, unnest(range(k)) AS pick FROM k) SELECT CAST(s.label AS BIGINT) AS label, s.pick, n.vec_id FROM s JOIN n ON n.label = s.label AND n.i = CASE WHEN k <= 1 THEN 0 ELSE CAST(round_even(pick * ((s.t - 1) / (k - 1)), 0) AS BIGINT) END")
def sample_even(spark, sf_dir):
    got = sampling.even(table(spark, sf_dir, "embeddings"), ["label"], ["vec_id"], 20)
    return got.select(F.col("label").cast("long").alias("label"), F.col("pick").cast("long").alias("pick"), "vec_id")


@query("SELECT CAST(label AS BIGINT) AS label, CAST(floor((n - 1) / 12) AS BIGINT) AS batch_no, count(*) AS size FROM (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings) GROUP BY 1, 2")
def batch_sizes(spark, sf_dir):
    got = sampling.batches(table(spark, sf_dir, "embeddings"), ["label"], ["vec_id"], themes.BATCH)
    return got.groupBy(F.col("label").cast("long").alias("label"), F.col("batch_no").cast("long").alias("batch_no")).agg(F.count("*").alias("size"))


@query("SELECT source, name, CAST(rank AS INTEGER) AS rank FROM (SELECT source, name, row_number() OVER (PARTITION BY source ORDER BY f, name) AS rank FROM (SELECT source, lang || (doc_id % 30) AS name, min(doc_id) AS f FROM documents GROUP BY 1, 2)) WHERE rank <= 40")
def ordered_names(spark, sf_dir):
    named = table(spark, sf_dir, "documents").groupBy("source", F.concat("lang", F.col("doc_id") % 30).alias("name")).agg(F.min("doc_id").alias("f"))
    return dedupe.first_few(named, ["source"], ["f", "name"], 40).select("source", "name", "rank")


# -- themes and clusters ---------------------------------------------------------------------


def _images(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    kind = F.when(F.col("vec_id") % 3 == 0, "social").when(F.col("vec_id") % 3 == 1, "product").otherwise("editorial")
    return sampling.numbered(e.select((F.col("label") % 3).cast("long").alias("brand_id"), "vec_id", "embedding", F.concat(F.lit("u"), "vec_id").alias("url"), kind.alias("source_kind")), ["brand_id"], ["vec_id"]).withColumnRenamed("nth", "ord").drop("total")


_IMAGES = "(SELECT CAST(label % 3 AS BIGINT) AS brand_id, vec_id, CAST(embedding AS DOUBLE[]) AS e, row_number() OVER (PARTITION BY label % 3 ORDER BY vec_id) - 1 AS ord, count(*) OVER (PARTITION BY label % 3) AS t, CASE vec_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE 1 END AS kind FROM embeddings)"
_ASSIGNED = (
    f"i AS (SELECT * FROM {_IMAGES}), s AS (SELECT brand_id, unnest(range(5)) AS theme FROM (SELECT DISTINCT brand_id FROM i)), th AS (SELECT s.brand_id, s.theme, i.e AS v FROM s JOIN i ON i.brand_id = s.brand_id AND i.ord = CAST(round_even(theme * ((t - 1) / 4), 0) AS BIGINT)),"
    " c AS (SELECT i.brand_id, i.vec_id, i.ord, i.kind, theme, list_dot_product(e, v) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(v, v))) AS sim FROM i JOIN th ON i.brand_id = th.brand_id),"
    " a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY brand_id, vec_id ORDER BY sim DESC, theme) AS n FROM c) WHERE n = 1)"
)


@query(f"WITH {_ASSIGNED} SELECT brand_id, vec_id, theme AS theme_ord, round(sim, 6) AS similarity FROM a")
def theme_assign(spark, sf_dir):
    images, provider = _images(spark, sf_dir), themes.VectorProvider()
    got = provider.assign(images, provider.discover(images, 5)).join(images.select("brand_id", F.col("ord").alias("image_ord"), "vec_id"), ["brand_id", "image_ord"])
    return got.select("brand_id", "vec_id", F.col("theme_ord").cast("long").alias("theme_ord"), F.round("similarity", 6).alias("similarity"))


@query(f"WITH {_ASSIGNED} SELECT brand_id, vec_id FROM a WHERE sim < 0.25")
def theme_unassigned(spark, sf_dir):
    images, provider = _images(spark, sf_dir), themes.VectorProvider(0.25)
    return themes.unassigned(images, provider.assign(images, provider.discover(images, 5))).select("brand_id", "vec_id")


@query(f"WITH {_ASSIGNED} SELECT s.brand_id, s.theme AS theme_ord, coalesce(string_agg(a.ord, ',' ORDER BY a.ord), '') AS images FROM s LEFT JOIN (SELECT * FROM a WHERE sim >= 0.25) a ON a.brand_id = s.brand_id AND a.theme = s.theme GROUP BY 1, 2")
def theme_members(spark, sf_dir):
    found, assigned = themes.analysed(_images(spark, sf_dir), themes.VectorProvider(0.25), 5)
    return themes.members(found, assigned).select("brand_id", F.col("theme_ord").cast("long").alias("theme_ord"), F.array_join("images", ",").alias("images"))


_BATCHES = "(SELECT l_suppkey % 20 AS brand_id, CAST(l_linenumber % 4 AS INTEGER) AS batch_no, ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS assignment_ord, 't' || l_partkey % 7 AS cluster_label, l_partkey % 15 AS a, l_suppkey % 13 AS b, l_orderkey % 14 AS c FROM lineitem)"


@query(
    f"WITH e AS (SELECT brand_id, CAST(substr(cluster_label, 2) AS INTEGER) AS theme_ord, batch_no, assignment_ord, unnest([0, 1, 2]) AS p, unnest([a, b, c]) AS i, cluster_label FROM {_BATCHES}), k AS (SELECT *, batch_no * 12 + i - 1 AS image_ord FROM e WHERE cluster_label < 't5' AND i BETWEEN 1 AND 12),"
    " o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY brand_id, image_ord ORDER BY batch_no, assignment_ord, p) AS n FROM k) WHERE n = 1)"
    " SELECT brand_id, theme_ord, CAST(row_number() OVER (PARTITION BY brand_id, theme_ord ORDER BY batch_no, assignment_ord, p) - 1 AS INTEGER) AS pos, CAST(image_ord AS BIGINT) AS image_ord FROM o"
)
def theme_first_claim(spark, sf_dir):
    """Order lines as what a model said of batches of twelve images: some labels and numbers are wrong, and most images are claimed often."""
    li = table(spark, sf_dir, "lineitem")
    batch = (F.col("l_linenumber") % 4).cast("int")
    said = li.select((F.col("l_suppkey") % 20).alias("brand_id"), batch.alias("batch_no"), (batch * 12).alias("batch_start"), F.lit(12).alias("batch_len"), (((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100_000 + F.col("l_partkey")) * 10_000 + F.col("l_suppkey")).alias("assignment_ord"),
        F.concat(F.lit("t"), F.col("l_partkey") % 7).alias("cluster_label"), F.array(F.col("l_partkey") % 15, F.col("l_suppkey") % 13, F.col("l_orderkey") % 14).alias("image_indices"))
    brands = li.select((F.col("l_suppkey") % 20).alias("brand_id")).distinct()
    found = brands.select("brand_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("theme_ord")).withColumn("cluster_label", F.concat(F.lit("t"), "theme_ord"))
    images = brands.select("brand_id", F.explode(F.sequence(F.lit(0), F.lit(47))).alias("ord"))
    return themes.claimed(said, images, found).select("brand_id", "theme_ord", "pos", F.col("image_ord").cast("long").alias("image_ord"))


_PICKS = (
    f"WITH {_ASSIGNED}, o AS (SELECT brand_id, theme, vec_id, row_number() OVER (PARTITION BY brand_id, theme ORDER BY kind, ord) AS nth FROM (SELECT *, sim FROM a) WHERE sim >= 0.4), own AS (SELECT * FROM o WHERE nth <= 3),"
    " h AS (SELECT s.brand_id, s.theme, count(own.vec_id) AS n FROM s LEFT JOIN own ON own.brand_id = s.brand_id AND own.theme = s.theme GROUP BY 1, 2), d AS (SELECT *, greatest(2 - n, 0) AS need, sum(greatest(2 - n, 0)) OVER (PARTITION BY brand_id ORDER BY theme) AS upto FROM h),"
    " f AS (SELECT brand_id, vec_id, row_number() OVER (PARTITION BY brand_id ORDER BY ord) - 1 AS p FROM a WHERE sim < 0.4), b AS (SELECT d.brand_id, d.theme, f.vec_id, d.n + f.p - (d.upto - d.need) + 1 AS nth FROM d JOIN f ON f.brand_id = d.brand_id AND f.p >= d.upto - d.need AND f.p < d.upto)"
)


def _picks(spark, sf_dir, floor=0.4):
    images = _images(spark, sf_dir)
    found, assigned = themes.analysed(images, themes.VectorProvider(floor), 5)
    pool = themes.unassigned(images, assigned).select("brand_id", F.col("ord").alias("pool_ord"), "url")
    return found, assigned, images, pool


@query(_PICKS + " SELECT brand_id, theme AS theme_ord, CAST(nth AS BIGINT) AS nth, 'u' || vec_id AS url FROM own UNION ALL SELECT brand_id, theme, CAST(nth AS BIGINT), 'u' || vec_id FROM b")
def cluster_reps(spark, sf_dir):
    got = clusters.representatives(*_picks(spark, sf_dir))
    return got.select("brand_id", F.col("theme_ord").cast("long").alias("theme_ord"), F.col("nth").cast("long").alias("nth"), "url")


@query(_PICKS + " SELECT brand_id, theme AS theme_ord, 'u' || vec_id AS url FROM b")
def cluster_backfill(spark, sf_dir):
    found, assigned, images, pool = _picks(spark, sf_dir)
    got = clusters.representatives(found, assigned, images, pool).join(pool.select("brand_id", "url"), ["brand_id", "url"], "left_semi")
    return got.select("brand_id", F.col("theme_ord").cast("long").alias("theme_ord"), "url")


@query(
    "WITH t AS (SELECT c_custkey AS brand_id, unnest(range(c_custkey % 6 + 1)) AS theme_ord FROM customer), h AS (SELECT *, theme_ord < c.f AS filled FROM t JOIN (SELECT c_custkey, c_nationkey % 5 AS f FROM customer) c ON c.c_custkey = brand_id),"
    " n AS (SELECT brand_id, count(*) AS every, count_if(filled) AS fuller FROM h GROUP BY 1) SELECT brand_id, theme_ord, CASE WHEN filled THEN 'u' || theme_ord END AS url FROM h JOIN n USING (brand_id) WHERE filled OR every <= 3 OR fuller < 3"
)
def cluster_drop_empty(spark, sf_dir):
    """Customers as brands of one to six themes, of which the first none to four have an image."""
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("brand_id"), F.col("c_nationkey").alias("k"))
    found = customer.select("brand_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("brand_id") % 6)).alias("theme_ord"))
    filled = found.join(customer, "brand_id").where("theme_ord < k % 5")
    images = filled.select("brand_id", F.col("theme_ord").alias("ord"), F.concat(F.lit("u"), "theme_ord").alias("url"), F.lit("product").alias("source_kind"))
    assigned = filled.select("brand_id", "theme_ord", F.lit(0).alias("pos"), F.col("theme_ord").alias("image_ord"))
    pool = images.limit(0).select("brand_id", F.col("ord").alias("pool_ord"), "url")
    return clusters.representatives(found, assigned, images, pool).select("brand_id", "theme_ord", "url")


# -- perceptual hashes and palettes ----------------------------------------------------------


def _hashes(spark, sf_dir):
    bits = F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(62)), lambda i: F.when(F.get("embedding", i) > 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, x: s * 2 + x)
    return table(spark, sf_dir, "embeddings").select("vec_id", bits.alias("phash"))


_HASHES = "(SELECT vec_id, CAST(list_sum(list_transform(range(63), lambda i: CASE WHEN embedding[i + 1] > 0 THEN CAST(1 AS BIGINT) << CAST(62 - i AS INTEGER) ELSE 0 END)) AS BIGINT) AS h FROM embeddings)"


@query(
    f"SELECT DISTINCT a.h AS a, b.h AS b, CAST(bit_count(xor(a.h, b.h)) AS INTEGER) AS bits, CAST(NULL AS BIGINT) AS vec_id FROM {_HASHES} a JOIN {_HASHES} b ON a.h < b.h WHERE bit_count(xor(a.h, b.h)) <= 14"
    f" UNION ALL SELECT h, h, CAST(0 AS INTEGER), vec_id FROM {_HASHES}"
)
def phash_pairs(spark, sf_dir):
    """Pairs of near hashes, and every vector beside its hash: vectors of one hash are near as well."""
    return hamming.near_pairs(_hashes(spark, sf_dir), 14, member="vec_id")


_SIZES = f"(SELECT vec_id, h % 200 AS h, CAST(unnest([100, 300, 200]) AS INTEGER) AS w, unnest([0, 1, 2]) AS o FROM {_HASHES})"


@query(f"SELECT phash, width, ord FROM (SELECT h AS phash, w AS width, vec_id * 3 + o AS ord, row_number() OVER (PARTITION BY h ORDER BY w DESC, vec_id * 3 + o) AS n FROM {_SIZES}) WHERE n = 1")
def phash_exact_best(spark, sf_dir):
    sizes = F.posexplode(F.array(F.lit(100), F.lit(300), F.lit(200))).alias("o", "width")
    rows = _hashes(spark, sf_dir).select(F.lit(1).alias("brand_id"), (F.col("phash") % 200).alias("phash"), "vec_id", sizes).select("brand_id", "phash", "width", F.lit(100).alias("height"), (F.col("vec_id") * 3 + F.col("o")).alias("ord"))
    return hamming.exact_best(rows, ["brand_id"]).select("phash", "width", "ord")


@query(
    f"WITH RECURSIVE i AS (SELECT vec_id % 5 AS brand_id, vec_id AS ord, CAST(100 + vec_id % 7 AS INTEGER) AS width, h, row_number() OVER (PARTITION BY vec_id % 5 ORDER BY vec_id) AS k FROM {_HASHES}),"
    " w AS (SELECT brand_id, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(ord BIGINT, width INTEGER, h BIGINT)[]) AS kept FROM (SELECT DISTINCT brand_id FROM i) UNION ALL"
    " SELECT brand_id, k, CASE WHEN spot IS NULL OR spot = 0 THEN list_append(kept, me) WHEN me.width > kept[spot].width THEN kept[: spot - 1] || [me] || kept[spot + 1 :] ELSE kept END FROM (SELECT brand_id, k, kept, me, list_position(list_transform(kept, lambda x: bit_count(xor(x.h, me.h)) <= 20), true) AS spot"
    " FROM (SELECT w.brand_id, i.k, w.kept, {'ord': i.ord, 'width': i.width, 'h': i.h} AS me FROM w JOIN i ON i.brand_id = w.brand_id AND i.k = w.k + 1)))"
    " SELECT brand_id, x.ord AS ord, x.width AS width, 100 AS height, x.h AS phash FROM (SELECT brand_id, unnest(kept) AS x FROM (SELECT * FROM w QUALIFY k = max(k) OVER (PARTITION BY brand_id)))"
)
def phash_greedy(spark, sf_dir):
    rows = _hashes(spark, sf_dir).select((F.col("vec_id") % 5).alias("brand_id"), F.col("vec_id").alias("ord"), (100 + F.col("vec_id") % 7).cast("int").alias("width"), F.lit(100).alias("height"), "phash")
    return hamming.greedy(rows, "brand_id", 20)


def _colours(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand", ((F.col("p_partkey") * 7) % 16 * 16 + 8).cast("int").alias("r"), ((F.col("p_size") * 5) % 16 * 16 + 8).cast("int").alias("g"), ((F.col("p_partkey") + F.col("p_size")) % 16 * 16 + 8).cast("int").alias("b")).agg(F.count("*").alias("n"))


_COLOURS = "(SELECT p_brand, CAST((p_partkey * 7) % 16 * 16 + 8 AS INTEGER) AS r, CAST((p_size * 5) % 16 * 16 + 8 AS INTEGER) AS g, CAST((p_partkey + p_size) % 16 * 16 + 8 AS INTEGER) AS b, count(*) AS n FROM part GROUP BY ALL)"


@query(f"SELECT p_brand, r, g, b, n, round(n * 100.0 / sum(n) OVER (PARTITION BY p_brand), 1) AS pct FROM {_COLOURS}")
def palette_share(spark, sf_dir):
    return palette.shares(_colours(spark, sf_dir), ["p_brand"])


@query(f"SELECT p_brand, r, g, b, n FROM {_COLOURS} WHERE greatest(r, g, b) - least(r, g, b) > 8 AND (greatest(r, g, b) + least(r, g, b)) / 2.0 / 255 BETWEEN 0.04 AND 0.93")
def palette_filter(spark, sf_dir):
    return palette.coloured(_colours(spark, sf_dir))


@query(
    f"WITH RECURSIVE c AS (SELECT *, round(n * 100.0 / sum(n) OVER (PARTITION BY p_brand), 1) AS pct, NOT (greatest(r, g, b) - least(r, g, b) > 8 AND (greatest(r, g, b) + least(r, g, b)) / 2.0 / 255 BETWEEN 0.04 AND 0.93) AS grey FROM {_COLOURS}),"
    " i AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY grey, n DESC, r, g, b) AS k FROM c), w AS (SELECT p_brand, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(r INTEGER, g INTEGER, b INTEGER, n BIGINT, pct DOUBLE)[]) AS taken, 0 AS coloured FROM (SELECT DISTINCT p_brand FROM i) UNION ALL"
    " SELECT p_brand, k, CASE WHEN fits THEN list_append(taken, me) ELSE taken END, CASE WHEN grey THEN coloured ELSE coloured + CAST(fits AS INTEGER) END FROM (SELECT w.p_brand, i.k, taken, coloured, i.grey, {'r': i.r, 'g': i.g, 'b': i.b, 'n': i.n, 'pct': i.pct} AS me,"
    " len(taken) < 8 AND NOT (i.grey AND coloured >= 3) AND len(list_filter(taken, lambda y: abs(i.r - y.r) + abs(i.g - y.g) + abs(i.b - y.b) < 40)) = 0 AS fits FROM w JOIN i ON i.p_brand = w.p_brand AND i.k = w.k + 1))"
    " SELECT p_brand, CAST(rank AS INTEGER) AS rank, x.r AS r, x.g AS g, x.b AS b, x.n AS n, x.pct AS pct, printf('#%02X%02X%02X', x.r, x.g, x.b) AS hex FROM (SELECT p_brand, taken, unnest(range(1, len(taken) + 1)) AS rank, unnest(taken) AS x FROM (SELECT * FROM w QUALIFY k = max(k) OVER (PARTITION BY p_brand)))"
)
def palette_greedy(spark, sf_dir):
    return palette.distinct_colours(_colours(spark, sf_dir), "p_brand")


# -- scores ----------------------------------------------------------------------------------

SCORES = """('one','m1',8.0,9.0,8.0,8.0,8.0,8.5),('one','m2',7.0,8.0,8.0,8.0,8.0,8.0),('other','m1',9.0,9.0,8.0,9.0,9.0,9.0),('other','m2',8.0,9.0,8.0,8.0,9.0,8.0),('other','m3',6.0,7.0,6.0,6.0,6.0,6.0),('one','m3',6.0,7.0,7.0,6.0,6.0,6.0)"""
_SCORES = f"(SELECT *, round(visual * 0.25 + voice * 0.20 + audience * 0.15 + clusters * 0.20 + completeness * 0.10 + actionability * 0.10, 2) AS score FROM (SELECT brand, model, CAST(a AS DOUBLE) AS visual, CAST(b AS DOUBLE) AS voice, CAST(c AS DOUBLE) AS audience, CAST(d AS DOUBLE) AS clusters, CAST(e AS DOUBLE) AS completeness, CAST(f AS DOUBLE) AS actionability FROM (VALUES {SCORES}) v(brand, model, a, b, c, d, e, f)))"


def _scores(spark):
    got = values(spark, SCORES, "brand, model, visual, voice, audience, clusters, completeness, actionability")
    got = got.select("brand", "model", *(F.col(k).cast("double").alias(k) for k in scoring.WEIGHTS))
    return got.withColumn("score", scoring.weighted())


@query(f"SELECT brand, model, score FROM {_SCORES}")
def score_weighted(spark, sf_dir):
    return _scores(spark).select("brand", "model", "score")


@query(f"SELECT brand, model, score, CAST(row_number() OVER (PARTITION BY brand ORDER BY score DESC, model) AS INTEGER) AS rank FROM {_SCORES}")
def score_rank(spark, sf_dir):
    return scoring.ranked(_scores(spark), ["brand"]).select("brand", "model", "score", "rank")


@query(f"SELECT model, score, CAST(row_number() OVER (ORDER BY score DESC, model) AS INTEGER) AS rank FROM (SELECT model, round(avg(score), 2) AS score FROM {_SCORES} GROUP BY 1)")
def score_average(spark, sf_dir):
    return scoring.averaged(_scores(spark))


# -- windows of time -------------------------------------------------------------------------


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_days(spark, sf_dir):
    got = stream.windowed(table(spark, sf_dir, "events"), "ts", ["event_type"])
    return got.select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT source, count(*) AS n, count(DISTINCT doc_id) AS distinct_ids FROM (SELECT 'documents' AS source, doc_id FROM documents UNION ALL SELECT 'labels', doc_id FROM labels UNION ALL SELECT 'both', doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) UNION ALL SELECT 'only', doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) GROUP BY 1")
def set_operations(spark, sf_dir):
    d, l = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")  # noqa: E741
    sets = {"documents": d, "labels": l, "both": d.join(l, "doc_id", "left_semi"), "only": d.join(l, "doc_id", "left_anti")}
    out = None
    for name, rows in sets.items():
        rows = rows.select(F.lit(name).alias("source"), "doc_id")
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("distinct_ids"))
