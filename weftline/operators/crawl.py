"""Traversal of a captured link graph, level by level, with the bounds of a crawl."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import urls as U
from .dedupe import first_by, first_few


#: Pages of a site that are sampled.
SAMPLES = 4


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only in local mode, where none is named."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="weftline-"))
    return sc.getCheckpointDir()


def _cut(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def reach(links: DataFrame, seeds: DataFrame, max_depth: int = 5, most: int | None = None) -> DataFrame:
    """``(site, url, depth)``: what is reached from the seeds ``(site, url)`` over ``(site, src, dst)``.

    The depth is the smallest one.  Of each level, pages behind links that look like products
    come first, then by address; with ``most``, a site stops there.  Each level is one join and
    one anti-join with what was seen, which is written to the shared folder.
    """
    seen = _cut(seeds.select("site", "url").distinct().withColumn("depth", F.lit(0)))
    front = seen
    for depth in range(1, max_depth + 1):
        step = front.join(links.withColumnRenamed("src", "url"), ["site", "url"]).select("site", F.col("dst").alias("url")).distinct()
        new = step.join(seen.select("site", "url"), ["site", "url"], "left_anti").withColumn("depth", F.lit(depth))
        if most is not None:
            left = seen.groupBy("site").agg((F.lit(most) - F.count("*")).alias("left"))
            ranked = first_few(new, ["site"], [F.desc(U.is_priority_link(F.col("url"))), "url"], most)
            new = ranked.join(left, "site").where(F.col("rank") <= F.col("left")).drop("rank", "left")
        front = _cut(new)
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def reach_sql(spark: SparkSession, links: str, seed: int, max_depth: int) -> DataFrame:
    """The same over a view of numbered nodes ``(src, dst)`` as one recursive query."""
    return spark.sql(
        f"WITH RECURSIVE r(node, depth) AS (SELECT CAST({seed} AS BIGINT), 0 UNION ALL SELECT l.dst, r.depth + 1 FROM r JOIN {links} l ON l.src = r.node WHERE r.depth < {max_depth})"
        " SELECT node, CAST(min(depth) AS BIGINT) AS depth FROM r GROUP BY node"
    )


def editorial_probes(seeds: DataFrame, visited: DataFrame, most: int = 4) -> DataFrame:
    """``(site, url)`` of usual editorial addresses, for sites without any visited editorial page; the first few not visited."""
    none = seeds.join(visited.where(U.is_editorial(F.col("url"))).select("site").distinct(), "site", "left_anti")
    origin = F.regexp_extract("url", "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    tried = none.select("site", origin.alias("origin"), F.posexplode(F.array(*map(F.lit, U.EDITORIAL_PROBES))).alias("ord", "probe")).select("site", "ord", F.concat("origin", "probe").alias("url"))
    return first_few(tried.join(visited.select("site", "url"), ["site", "url"], "left_anti"), ["site"], ["ord"], most).select("site", "url", "rank")


def sample_pages(links: DataFrame, most_priority: int = 2, most_other: int = 1) -> DataFrame:
    """Of each page's links ``(site, src, dst)``, the first priority ones and the first other ones, as ``(site, src, dst, rank)``."""
    marked = links.withColumn("priority", U.is_priority_link(F.col("dst")))
    ranked = first_few(marked, ["site", "src", "priority"], ["dst"], max(most_priority, most_other))
    return ranked.where(F.when(F.col("priority"), F.col("rank") <= most_priority).otherwise(F.col("rank") <= most_other))


def sampled(links: DataFrame, seeds: DataFrame, captured: DataFrame, most: int = SAMPLES, most_priority: int = 2, most_other: int = 1) -> DataFrame:
    """``(site, nth, url)``: the first ``most`` captured pages of each site in the order of a short walk.

    A page that is taken hands on its first links that look like products, and the seed's page its first other
    ones, to the end of the site's queue; visited ones are passed over.  ``links`` are ``(site, src, pos, dst)``, ``seeds``
    and ``captured`` ``(site, url)``.  A queue gets a handful of addresses at most, so a site is one
    row, and each step is one join with the pages' first few links.
    """
    steps = 1 + most_other + most_priority * max(0, most - 1)
    first = links.withColumn("priority", U.is_priority_link(F.col("dst")))
    first = first_few(first, ["site", "src", "priority"], ["pos"], max(most_priority, most_other) + steps)  # as many may have been visited
    listed = lambda own: F.transform(F.sort_array(F.collect_list(F.when(own, F.struct("rank", "dst")))), lambda x: x["dst"])
    kids = first.groupBy("site", F.col("src").alias("url")).agg(listed(F.col("priority")).alias("p"), listed(~F.col("priority")).alias("o"))
    pages = captured.select("site", "url").distinct().join(kids, ["site", "url"], "left")
    none = F.array().cast("array<string>")
    state = seeds.groupBy("site").agg(F.array(F.min("url")).alias("queue")).select("site", "queue", none.alias("seen"), none.alias("taken"))
    for _ in range(steps):
        head = F.get(F.filter("queue", lambda u: ~F.array_contains(F.col("seen"), u)), F.lit(0))
        now = state.withColumn("url", F.when(F.size("taken") < most, head)).withColumn("queue", F.filter("queue", lambda u: ~F.array_contains(F.col("seen"), u) & (u != F.col("url"))))
        met = now.join(pages.withColumn("there", F.lit(True)), ["site", "url"], "left")
        seen = F.when(F.col("url").isNotNull(), F.array_append("seen", F.col("url"))).otherwise(F.col("seen"))
        fresh = lambda c, n: F.slice(F.filter(F.coalesce(F.col(c), none), lambda u: ~F.array_contains(F.col("seen"), u)), 1, n)
        step = met.withColumn("seen", seen).withColumn("added", F.concat(fresh("p", most_priority), F.when(F.size("taken") == 0, fresh("o", most_other)).otherwise(none)))
        hit = F.coalesce("there", F.lit(False))
        state = step.select("site", F.when(hit, F.concat("queue", "added")).otherwise(F.col("queue")).alias("queue"), "seen", F.when(hit, F.array_append("taken", F.col("url"))).otherwise(F.col("taken")).alias("taken"))
    return state.select("site", F.posexplode("taken").alias("nth", "url"))


def accepted(candidates: DataFrame, sizes: DataFrame, least_width: int, least_height: int) -> DataFrame:
    """Complete candidates whose image is large enough, one a SKU by order; an image that fails leaves its SKU to the next."""
    from ..functions import rules as R

    good = candidates.where(R.complete(F.col("product_name"), F.col("sku_id"))).join(sizes, "url").where(R.large_enough(F.col("width"), F.col("height"), F.lit(least_width), F.lit(least_height)))
    kind = F.when(U.is_editorial(F.col("source_page")), "editorial").otherwise("product")
    return first_by(good, ["brand_id", "sku_id"], ["ord"]).withColumn("source_kind", kind)
