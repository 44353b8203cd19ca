"""Literal cases of the rules."""

import base64
import datetime
import random
import zlib
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions import rules as R, text as T, urls as U
from weftline.operators import clusters, dedupe, gates, hamming, merge, palette, sampling
from weftline.plans.record_queries import png
from weftline.sources import bundles as B, images as I, markup, pages as P, pdf, products as X, rules as XR, web


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_site_rules(spark):
    df = spark.createDataFrame([("https://www.example.com/a", "http://example.com"), ("ftp://example.com/a", "https://example.com"), ("https://shop.example.com/", "https://example.com")], "u string, s string")
    assert [r[0] for r in df.select(U.same_site(F.col("u"), F.col("s"))).collect()] == [True, False, False]


def test_null_texts(spark):
    df = spark.createDataFrame([(None,), ("",), ("a \n b",)], "t string")
    assert [r[0] for r in df.select(T.snippet(F.col("t"))).collect()] == [None, None, "a b"]
    assert [r[0] for r in df.select(T.promotional(F.col("t"))).collect()] == [False, False, False]


def test_truncated_to_800(spark):
    got = spark.createDataFrame([("x" * 800,), ("y" * 798 + "  zz",)], "t string").select(T.truncate(F.col("t"))).collect()
    assert got[0][0] == "x" * 800 and got[1][0] == "y" * 798 + "…"


def test_bad_resolution_is_an_error(spark):
    with pytest.raises(Exception, match="not a resolution"):
        spark.createDataFrame([("4x",)], "r string").select(T.resolution(F.col("r"))).collect()


def test_image_harvest():
    html = '<img src="/a.jpg" data-src="/b.png" srcset="https://c.example.com/c.webp 1x, https://c.example.com/d.webp 2x"><meta property="og:image" content="https://c.example.com/e.gif">'
    got = [c["url"] for c in X.Reader(XR.generic().normalized()).candidates(html, "https://example.com/x")]
    assert {"https://example.com/a.jpg", "https://example.com/b.png", "https://c.example.com/c.webp", "https://c.example.com/d.webp", "https://c.example.com/e.gif"} <= set(got)
    assert got[:2] == ["https://example.com/a.jpg", "https://example.com/b.png"]


def test_selectors():
    tree = markup.parse('<div class="card big"><a href="/x">T<b>u</b></a></div><div class="other"><a>z</a></div>')
    assert [n.text() for n in markup.select(tree, '//div[contains(@class,"card")]//a[@href]')] == ["Tu"]
    with pytest.raises(ValueError):
        markup.select(tree, "//div[position()=1]")
    deep = markup.parse("<div>" * 5000 + "x" + "</div>" * 5000)
    assert deep.text() == "x"


def test_page_snippets():
    html = "<title> T </title><meta name='description' content='about us'><h1>A long enough heading</h1><h2>short</h2><p>%s</p><p>no</p>" % ("word " * 20)
    kinds = [(s["kind"], s["weight"]) for s in P.page_snippets(html, "https://example.com/")]
    assert kinds == [("title", 0.4), ("meta_description", 0.6), ("hero", 1.1), ("editorial", 1.5)]
    assert [s["kind"] for s in P.page_snippets(html, "https://example.com/about")][-1] == "about"
    product = P.page_snippets(f"<div class='x-description'><p itemprop='description'>{'word ' * 20}</p></div>", "https://example.com/p/1")
    assert [s["kind"] for s in product] == ["product_description"] * 2
    assert P.page_snippets(None, None) == [] and P.page_snippets("", "x") == []


def test_block_needs_short_blank_title(spark):
    df = spark.createDataFrame([(200, {"a": "b"}, "<title>&nbsp;</title>" + "x" * 9000), (200, None, None)], "s int, h map<string,string>, b string")
    assert [r[0] for r in df.select(R.block(F.col("s"), F.col("h"), F.col("b"))).collect()] == [None, None]


def test_merge_of_three_sources(spark):
    b = spark.createDataFrame([(1, "website", 0, "https://a", "1x1", 10, 20, None), (1, "instagram", 1, "https://b", "2x2", 1, 2, ("u", "p", "r")), (1, "twitter", 2, "https://c", "3x3", 1, 1, ("v", "q", "r"))], "brand_id bigint, source string, bundle_ord int, brand_url string, min_resolution string, pages_crawled bigint, candidates_checked bigint, bot_protection struct<url:string,provider:string,reason:string>")
    got = merge.merged(b).collect()[0]
    assert (got.brand_url, got.pages_crawled, got.candidates_checked, got.bot_protection.provider, got.source) == ("https://a", 12, 23, "p", "combined")
    t = spark.createDataFrame([(1, 0, 0, "Shared ", 1.0), (1, 1, 0, "shared", 2.5), (1, 1, 1, "x", 1.0)], "brand_id bigint, bundle_ord int, ord int, text string, weight double")
    assert [(r.text, r.weight, r["rank"]) for r in merge.texts(t).orderBy("rank").collect()] == [("shared", 2.5, 1), ("x", 1.0, 2)]
    assert merge.merged(b.limit(0)).count() == 0


def test_row_order_does_not_matter(spark):
    data = [(k % 7, k, f"t{k % 11}", float(k % 3)) for k in range(200)]
    shuffled = random.Random(1).sample(data, len(data))
    schema = "k int, ord int, text string, weight double"
    a = dedupe.heaviest_texts(spark.createDataFrame(data, schema), ["k"], 5)
    b = dedupe.heaviest_texts(spark.createDataFrame(shuffled, schema).repartition(5), ["k"], 5)
    assert rows(a) == rows(b)
    again = dedupe.heaviest_texts(a.drop("rank"), ["k"], 5)
    assert rows(again.drop("rank")) == rows(a.drop("rank"))  # doing it twice keeps the same rows


def test_even_sample_rounds_half_to_even(spark):
    df = spark.range(6).select(F.lit(1).alias("k"), "id")
    assert [r.id for r in sampling.even(df, ["k"], ["id"], 3).orderBy("pick").collect()] == [0, 2, 5]
    assert sampling.even(df, ["k"], ["id"], 100).count() == 6


def test_backfill_of_shared_images(spark):
    th = spark.createDataFrame([(1, 0), (1, 1)], "brand_id bigint, theme_ord int")
    im = spark.createDataFrame([(1, k, f"u{k}", "product" if k else "editorial") for k in range(5)], "brand_id bigint, ord int, url string, source_kind string")
    asg = spark.createDataFrame([(1, 0, 0, 0), (1, 0, 1, 1), (1, 1, 0, 1)], "brand_id bigint, theme_ord int, pos int, image_ord int")
    pool = spark.createDataFrame([(1, 0, "u1"), (1, 1, "u3"), (1, 2, "u4")], "brand_id bigint, pool_ord int, url string")
    got = clusters.representatives_shared(th, asg, im, pool)
    assert rows(got) == [(1, 0, 1, "u1"), (1, 0, 2, "u0"), (1, 1, 1, "u3"), (1, 1, 2, "u4")]


def test_models_of_backfill_agree(spark):
    r = random.Random(4)
    th, im, asg, pool = [], [], [], []
    for brand in range(12):
        n = r.randrange(1, 6)
        th += [(brand, t) for t in range(n)]
        free = []
        for k in range(r.randrange(0, 14)):
            im.append((brand, k, f"u{k}", r.choice(["product", "editorial", "social"])))
            t = r.randrange(-2, n)
            (asg.append((brand, t, k, k)) if t >= 0 else free.append((brand, k, f"u{k}")))
        pool += free
    frames = (spark.createDataFrame(th, "brand_id bigint, theme_ord int"), spark.createDataFrame(asg, "brand_id bigint, theme_ord int, pos int, image_ord int"), spark.createDataFrame(im, "brand_id bigint, ord int, url string, source_kind string"), spark.createDataFrame(pool, "brand_id bigint, pool_ord int, url string"))
    keep = ["brand_id", "theme_ord", "nth", "url"]
    key = lambda df: sorted((tuple(x) for x in df.select(*[F.col(c).cast("string") for c in keep]).collect()), key=str)
    assert key(clusters.representatives(*frames)) == key(clusters.representatives_shared(*frames))


def test_bands_cover_all_bits():
    for most in (3, 8, 14):
        got = hamming.bands(most)
        assert len(got) == most + 1 and sum(w for _, w in got) == 64 and [s for s, _ in got] == list(np.cumsum([0] + [w for _, w in got])[:-1])


def test_near_pairs_equal_brute_force(spark):
    r = random.Random(2)
    base = [r.getrandbits(64) for _ in range(40)]
    every = {b ^ sum(1 << i for i in r.sample(range(64), r.randrange(0, 12))) for b in base for _ in range(6)}
    signed = [x - (1 << 64) if x >> 63 else x for x in every]
    got = rows(hamming.near_pairs(spark.createDataFrame([(x,) for x in signed], "phash bigint")).select("a", "b"))
    want = sorted((min(a, b), max(a, b)) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 8)
    assert got == want


def test_greedy_keeps_the_larger(spark):
    df = spark.createDataFrame([(1, 0, 10, 10, 0), (1, 1, 20, 20, 1), (1, 2, 5, 5, 3), (1, 3, 5, 5, None), (1, 4, 5, 5, -1)], "brand_id bigint, ord int, width int, height int, phash bigint")
    assert sorted(r.ord for r in hamming.greedy(df, "brand_id", 1).collect()) == [1, 3, 4]


def test_palette_of_drawn_images(spark, tmp_path):
    for k, c in enumerate([(200, 40, 40), (200, 40, 40), (40, 40, 200)]):
        (tmp_path / f"{k}.png").write_bytes(png(64, 64, c))
    (tmp_path / "bad.png").write_bytes(b"nope")
    found = I.decoded(spark, str(tmp_path)).cache()
    assert found.count() == 3
    images = found.select(F.lit(1).cast("long").alias("brand_id"), "url", F.monotonically_increasing_id().alias("ord"))
    got = palette.of_images(I.colours(found), images).orderBy("rank").collect()
    assert [(r.r > r.b) for r in got] == [True, False] and got[0].n > got[1].n
    hashed = I.hashes(found).collect()
    assert len(hashed) == 3 and all(h.phash is not None for h in hashed)
    sizes = I.read_bytes(spark, str(tmp_path)).select(I.png_size(F.col("content")).alias("s")).collect()
    assert sorted(r.s.width if r.s else 0 for r in sizes) == [0, 64, 64, 64]


def test_gate_strategies(spark):
    df = spark.createDataFrame([("a", 10, 10), ("b", 100, 10), ("c", 0, 5)], "url string, width int, height int")
    assert gates.gate(df, "null").count() == 3 and gates.gate(df, "anything").count() == 1 and gates.gate(df, "clip").count() == 3


def test_rules_round_trip(spark):
    own = XR.shop_defaults("example.com")
    stored = XR.table_of(spark, [own]).collect()[0]
    assert XR.of_row(stored) == own
    assert own.normalized().priority_link_path_contains == U.PRIORITY_HINTS
    assert XR.Rules(dom_context=XR.DomRule(ancestor_limit=1)).normalized().dom_context.ancestor_limit == 5


def test_bundles_and_reports_are_written(spark, tmp_path):
    doc = '{"source":"website","brand_url":"https://a/","images":[{"url":"u","width":1,"height":2,"source_page":"p"}],"texts":[{"source_url":"s","kind":"hero","text":"t"}]}'
    (tmp_path / "b.json").write_text(doc)
    df = B.read(spark, str(tmp_path / "b.json")).withColumn("brand_id", F.lit(1)).withColumn("bundle_ord", F.lit(0))
    assert B.images(df).collect()[0].source_kind == "product" and B.texts(df).collect()[0].weight == 1.0
    B.write_reports(spark.createDataFrame([("My Brand!", 1)], "name string, n int"), str(tmp_path / "out"))
    assert (tmp_path / "out" / "slug=my-brand").is_dir()


def test_streams(spark, tmp_path):
    from weftline.streaming import pages as stream

    spark.createDataFrame([(1, "a", "2026-01-01 10:00:00", 1.0), (2, "a", "2026-01-01 11:00:00", 2.0), (3, "b", "2026-01-02 10:00:00", 3.0)], "id bigint, k string, t string, value double").selectExpr("id", "k", "to_timestamp(t) AS ts", "value").write.parquet(str(tmp_path / "in"))
    rows_in = stream.read(spark, str(tmp_path / "in"), "id bigint, k string, ts timestamp, value double")
    for name, df, mode in (("w", stream.windowed(rows_in, "ts", ["k"]), "complete"), ("o", stream.once(rows_in, ["k"], "ts", "10 days").select("k"), "append")):
        q = df.writeStream.format("memory").queryName(f"stream_{name}").outputMode(mode).start()
        q.processAllAvailable()
        q.stop()
    assert sorted((r.k, r.n, r.total) for r in spark.table("stream_w").collect()) == [("a", 2, 3.0), ("b", 1, 3.0)]
    assert sorted(r.k for r in spark.table("stream_o").collect()) == ["a", "b"]


def test_pages_of_any_age_and_order(spark, tmp_path):
    import os

    import pyarrow as pa
    import pyarrow.parquet as pq

    from weftline.plans import catalog
    from weftline.streaming import pages as stream

    # More files than a batch takes, the oldest pages in the last ones, and addresses that come again after hours.
    r, folder = random.Random(6), tmp_path / "in" / "pages.parquet"
    folder.mkdir(parents=True)
    said = [(k * 1000, r.choice([f"u{k % 7}", f"v{k}", None])) for k in range(200)]
    for n in range(20):
        own = said[::-1][n * 10 : n * 10 + 10]
        pq.write_table(pa.table({"page_id": pa.array([x for x, _ in own], pa.int64()), "url": pa.array([u for _, u in own], pa.string()), "html": pa.array(["<p>"] * 10)}), folder / f"{n:02}.parquet")
        os.utime(folder / f"{n:02}.parquet", (1_700_000_000 + n,) * 2)
    want: dict = {}
    for page, url in said:
        want[url] = min(page, want.get(url, page))
    got = catalog.queries()["page_stream_once"](spark, str(tmp_path / "in")).collect()
    assert len(got) == len(want) and {x.url: x.page_id for x in got} == want
    single = stream.earliest(stream.read(spark, str(folder), "page_id bigint, url string", 1), ["url"], "page_id", str(tmp_path / "shared"))
    assert rows(single.where("url is not null")) == sorted((u, p) for u, p in want.items() if u is not None)
    (tmp_path / "none").mkdir()
    assert not stream.earliest(stream.read(spark, str(tmp_path / "none"), "page_id bigint, url string"), ["url"], "page_id", str(tmp_path / "shared")).collect()


# -- web, presence, prompts, documents -----------------------------------------------------------


@pytest.fixture(scope="module")
def site():
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Handler(BaseHTTPRequestHandler):
        got = []

        def do_GET(self):
            status = 404 if self.path == "/missing" else 403 if self.path == "/blocked" else 200
            self.send_response(status)
            self.send_header("Content-Type", "image/png" if self.path == "/i.png" else "text/html")
            self.end_headers()
            self.wfile.write(b"x" * 5000 if self.path == "/long" else b"<title>ok</title>")

        def do_POST(self):
            Handler.got.append(self.rfile.read(int(self.headers["Content-Length"])))
            self.send_response(201)
            self.end_headers()

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", Handler.got
    server.shutdown()


def test_web_source(spark, site):
    from weftline.sources import web

    base, posted = site
    urls = [f"{base}{p}" for p in ("/", "/missing", "/blocked", "/i.png", "/long")] + ["ftp://x", "http://127.0.0.1:1/none"]
    got = {r.url: r for r in web.read(spark, urls, most=1000).collect()}
    assert got[urls[0]].status == 200 and got[urls[1]].status == 404 and len(got[urls[4]].body) == 1000 and got[urls[5]].error == "not http" and got[urls[6]].status is None
    table = web.fetched(spark.createDataFrame([(u,) for u in urls], "url string"), 1000)
    assert sorted(r.url for r in web.usable(table).collect()) == sorted([urls[0], urls[4]])
    assert web.healthy(table.where(F.col("url") == urls[0])).count() == 1
    with pytest.raises(Exception, match="blocked"):
        web.healthy(table.where(F.col("url") == urls[2])).collect()
    assert [(r.status, r.n) for r in web.send(spark.range(3), base).collect()] == [(201, 3)] and len(posted) == 3


def test_presence(spark):
    from weftline.operators import presence

    wanted = presence.profile_urls(spark.createDataFrame([(1, " @Some.Brand "), (2, "gone"), (3, "@")], "brand_id bigint, handle string"))
    pages = spark.createDataFrame([("https://www.instagram.com/some.brand/", 200, '{"username":"some.brand"}'), ("https://x.com/some.brand", 200, '{"url":"UserByRestId","status":401}'), ("https://x.com/gone", 404, "")], "url string, status int, html string")
    got = {r.brand_id: (r.profiles, r.status) for r in presence.present(wanted, pages).collect()}
    assert got == {1: ({"instagram": "https://www.instagram.com/some.brand/"}, "ok"), 2: ({}, "none")}


def test_prompts_and_retries(spark):
    from weftline.plans import prompts

    df = spark.createDataFrame([("B", None, 3, [("a", "first"), ("b", None)])], "name string, url string, n int, themes array<struct<cluster_label:string,description:string>>")
    said = df.select(prompts.assignment(F.col("name"), F.col("url"), F.col("n"), F.col("themes"))).collect()[0][0]
    assert "unknown site" in said and "1. a: first\n2. b: " in said

    def ask(prompt):
        if prompt == "bad":
            raise RuntimeError
        return prompt.upper()

    got = prompts.asked(spark.createDataFrame([(1, "good"), (2, "bad"), (3, None)], "batch int, prompt string"), ask)
    assert rows(got) == [(1, "GOOD"), (2, None), (3, None)]


def test_pdf(spark):
    from weftline.sources import pdf

    reports = spark.createDataFrame([(1, "Brand (one)", [(1, "#FF0000", 50.0)], [("Theme", ["u1", "u2", "u3"])], ["A text. " * 300]), (2, "Empty", None, None, None)], "brand_id bigint, name string, palette array<struct<rank:int,hex:string,pct:double>>, clusters array<struct<label:string,image_urls:array<string>>>, texts array<string>")
    blobs = spark.createDataFrame([("u1", bytearray(png(20, 30, (1, 2, 3)))), ("u2", bytearray(b"nope"))], "url string, content binary")
    got = {r.brand_id: bytes(r.pdf) for r in pdf.documents(reports, blobs).collect()}
    assert got[1].startswith(b"%PDF-1.4") and got[1].endswith(b"%%EOF") and got[1].count(b"/Subtype/Image") == 1 and len(got[2]) > 500
    assert pdf.fitted(2.0, 10, 10) == (5.0, 10) and pdf.fitted(0.5, 10, 10) == (10, 5.0)
    assert pdf.pill_rows(["a" * 20] * 3, 200.0) == [["a" * 20] * 2, ["a" * 20]]


def test_rules_are_settled():
    html = '<script type="application/ld+json">{"@type":"Product","name":"A","image":"/a.jpg"}</script>'
    assert X.finds_anything(XR.generic(), [("https://example.com/", html)]) and not X.finds_anything(XR.generic(), [("https://example.com/", "<p>x</p>")])
    card = XR.CardRule("//div[@class='c']", "//a")
    fell = XR.settled(XR.Rules(domain="d", product_card=card), False)
    assert fell.product_card == card and fell.domain == "d" and len(fell.json_sources) == 3


def test_written_scores(spark, tmp_path):
    from weftline.operators import scoring

    scoring.write_results(spark.createDataFrame([("b", "m1", 1.0), ("b", "m2", 2.0), ("b", "m3", None)], "brand string, model string, score double"), str(tmp_path / "s"), "j")
    got = spark.read.json(str(tmp_path / "s")).collect()[0]
    assert [x.model for x in got.ranking_by_weighted_score] == ["m2", "m1"] and len(got.results) == 3


def test_median_cut_keeps_few_colours_and_all_pixels():
    r = np.random.default_rng(3)
    flat = np.repeat(np.array([[10, 20, 30], [200, 20, 30], [90, 250, 1]], dtype=np.uint8), [5, 70, 300], axis=0)
    assert sorted(palette.median_cut(flat, 8)) == [(10, 20, 30, 5), (90, 250, 1, 300), (200, 20, 30, 70)]
    some = r.integers(0, 256, (4000, 3)).astype(np.uint8)
    for most in (1, 2, 7, 14):
        got = palette.median_cut(some, most)
        assert len(got) == most and sum(x[3] for x in got) == 4000
        mean = sum(np.array(x[:3]) * x[3] for x in got) / 4000
        assert np.allclose(mean, some.mean(axis=0), atol=0.6)
    whole = palette.median_cut(np.concatenate([some // 64 * 64, np.zeros((9000, 3), dtype=np.uint8)]), 14)
    assert max(whole, key=lambda x: x[3])[:3] < (30, 30, 30)


def test_palette_from_pictures(spark, tmp_path):
    for k, c in enumerate([(200, 30, 40), (200, 30, 40), (20, 160, 90)]):
        (tmp_path / f"{k}.png").write_bytes(png(120, 80 + 40 * k, c))
    small = I.thumbnails(I.decoded(spark, str(tmp_path)))
    assert all(x.width <= 96 and x.height <= 96 and len(x.rgb) == 3 * x.width * x.height for x in small.collect())
    own = small.select(F.lit(1).alias("brand_id"), "url", F.col("url").alias("ord"))
    got = [(x.r, x.g, x.b) for x in palette.of_thumbnails(small, own).orderBy("rank").collect()]
    near = lambda a, b: sum(abs(x - y) for x, y in zip(a, b)) < 40
    assert near(got[0], (200, 30, 40)) and any(near(x, (20, 160, 90)) for x in got)


def test_images_for_a_model_are_small_enough(spark, tmp_path):
    (tmp_path / "wide.png").write_bytes(png(1600, 400, (9, 99, 199)))
    (tmp_path / "small.png").write_bytes(png(30, 40, (9, 99, 199)))
    (tmp_path / "no.png").write_bytes(b"nope")
    got = {x.url.rsplit("/", 1)[-1]: base64.b64decode(x.data_uri.split(",", 1)[1]) for x in I.model_uris(I.decoded(spark, str(tmp_path))).collect()}
    size = {k: (int.from_bytes(v[16:20], "big"), int.from_bytes(v[20:24], "big")) for k, v in got.items()}
    assert size == {"wide.png": (768, 192), "small.png": (30, 40)}


def test_rules_are_loaded_or_inferred(spark):
    now = datetime.datetime(2026, 5, 2, 9)
    old = XR.generic("old.com")
    stored = XR.table_of(spark, [replace(old, updated_at=now - datetime.timedelta(days=1)), replace(XR.generic("fresh.com"), updated_at=now), replace(XR.generic("unasked.com"), updated_at=now)])
    wanted = spark.createDataFrame([("old.com",), ("fresh.com",), ("new.com",), ("bare.com",), ("old.com",)], "domain string")
    product = '<script type="application/ld+json">{"@type":"Product","name":"N","image":"/a.jpg"}</script>'
    samples = spark.createDataFrame([("old.com", 0, "https://old.com/p/1", product), ("new.com", 0, "https://new.com/", "<p>x</p>"), ("new.com", 1, "https://new.com/p/2", product)], "domain string, ord int, url string, html string")

    def infer(prompt, domain):
        assert domain in prompt and ("2 pages" in prompt) == (domain == "new.com")
        return replace(XR.generic("wrong.com"), product_card=XR.CardRule("//div", "//a"))

    used, after = XR.load_or_infer(wanted, stored, samples, infer, now)
    got = {x.domain: x for x in used.collect()}
    assert {k: v.origin for k, v in got.items()} == {"old.com": "inferred", "fresh.com": "stored", "new.com": "inferred", "bare.com": "default"}
    assert len(got["bare.com"].json_sources) == 3 and got["bare.com"].product_card.card_selector == "//div" and len(got["new.com"].json_sources) == 1
    assert XR.of_row(got["new.com"]).domain == "new.com"
    assert sorted((x.domain, x.updated_at) for x in after.collect()) == [(d, now) for d in ("bare.com", "fresh.com", "new.com", "old.com", "unasked.com")]
    again, _ = XR.load_or_infer(wanted, after, samples, infer, now)
    assert {x.origin for x in again.collect()} == {"stored"}
    assert "stored" not in {x.origin for x in XR.load_or_infer(wanted, after, samples, infer, now, refresh=True)[0].collect()}


def test_pdf_sections(spark):
    profile = {"summary": "They make things.", "industry": "Goods", "keywords": ["plain", "loud"], "tone": "", "audience_signals": ["young"], "strengths": ["one", "two"]}
    d = zlib.decompressobj
    whole = pdf.rendered("Name", ["#112233"], [{"label": "L", "description": "a theme"}], ["a line"], {}, profile)
    said = b"".join(d().decompress(x.split(b"stream\n", 1)[1]) for x in whole.split(b"endobj") if b"FlateDecode" in x and b"/Image" not in x)
    for part in (b"Summary", b"They make things.", b"Industry", b"Goods", b"plain \xb7 loud", b"Voice", b"a line", b"Audience", b"young", b"Strategic notes", b"one, two", b"a theme"):
        assert b"(" + part + b")" in said, part
    assert b"Visual identity" not in said and b"Tone" not in said


def test_store_answers(spark, tmp_path):
    assert web.store_ready(spark, str(tmp_path)) and not web.store_ready(spark, str(tmp_path / "none"))


def test_too_many_rows_of_a_key_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(hamming, "MOST_WALKED", 3)
    rows = spark.range(5).select(F.lit(1).alias("brand_id"), F.col("id").alias("ord"), F.lit(1).alias("width"), F.lit(1).alias("height"), F.col("id").alias("phash"))
    with pytest.raises(Exception, match="5 images of one key"):
        hamming.greedy(rows, "brand_id").collect()


def test_near_hashes_meet_by_pairs_of_bands(spark):
    r = random.Random(4)
    base = [r.getrandbits(63) for _ in range(20)]
    rows = sorted({b ^ sum(1 << k for k in r.sample(range(63), r.randrange(0, 12))) for b in base for _ in range(12)})
    want = {(a, b) for i, a in enumerate(rows) for b in rows[i + 1 :] if (a ^ b).bit_count() <= 8}
    got = hamming.near_pairs(spark.createDataFrame([(x,) for x in rows], "phash bigint")).collect()
    assert {(x.a, x.b) for x in got} == want and len(got) == len(want) and all(x.bits == (x.a ^ x.b).bit_count() for x in got)


def test_wide_searches_compare_blocks(spark, monkeypatch):
    monkeypatch.setattr(hamming, "BLOCK", 90)
    monkeypatch.setattr(hamming, "SPREAD_ROWS", 50)
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(60)]
    signed = [x - (1 << 64) if x >> 63 else x for b in base for x in {b ^ sum(1 << i for i in r.sample(range(64), r.randrange(0, 20))) for _ in range(8)}]
    keyed = [(k, h) for k in range(3) for h in signed[k :: 3 - k]] + [(0, None), (9, 5), (9, 5), (None, 5), (None, 7)]
    near = lambda own: {(min(a, b), max(a, b), n) for i, a in enumerate(own) for b in own[:i] if 0 < (n := ((a ^ b) & (1 << 64) - 1).bit_count()) <= 14}
    df = spark.createDataFrame(keyed, "brand bigint, phash bigint")
    got = rows(hamming.near_pairs(df, 14, ["brand"]))
    assert got == sorted((k, *x) for k in range(3) for x in near(list({h for j, h in keyed if j == k and h is not None})))
    every = hamming.near_pairs(df, 14)
    assert rows(every) == sorted(near(list({h for _, h in keyed if h is not None})))
    assert not hamming.near_pairs(df.where("brand = 8"), 14).collect()
    # At fourteen bits single bands hold nearly all pairs: rows of pairs aren't made at all.
    assert "Join" not in every._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("most", [8, 14])
def test_images_of_one_hash_are_members(spark, most):
    images = [(1, 5, "p"), (1, 5, "q"), (1, 7, "r"), (2, 5, "s"), (2, 5, "s"), (3, -1, "t"), (3, None, "u"), (None, 5, "v"), (None, 5, "w"), (4, 9, None)]
    got = rows(hamming.near_pairs(spark.createDataFrame(images, "brand bigint, phash bigint, url string"), most, ["brand"], "url"))
    assert sorted(got, key=str) == sorted([(1, 5, 7, 1, None), *((k, h, h, 0, u) for k, h, u in images if k is not None and h is not None)], key=str)
