"""Which product an image belongs to."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import urls as U
from .dedupe import first_by


def exact(images: DataFrame, products: DataFrame, keys: list[str]) -> DataFrame:
    """Images ``(keys, url)`` with the last product that names their URL."""
    named = products.select(*keys, "product_ord", "name", "sku_id", F.explode("image_urls").alias("url"))
    last = named.groupBy(*keys, "url").agg(F.max_by(F.struct("name", "sku_id"), "product_ord").alias("p"))
    return images.join(last, [*keys, "url"]).select(*keys, "url", "p.name", "p.sku_id")


def by_keys(images: DataFrame, products: DataFrame, keys: list[str]) -> DataFrame:
    """Images with the product that shares an id-like path part with them, or, where they have none, the file name.

    Style codes come first, then the order of products.
    """
    def parts(url):
        every = U.image_match_keys(url)
        ids = F.filter(every, lambda k: k.rlike("^[a-f0-9-]{8,}$"))
        return F.when(F.size(ids) > 0, ids).otherwise(every)

    left = images.select(*keys, "url", F.explode(parts(F.col("url"))).alias("key"))
    right = products.select(*keys, "product_ord", "name", "sku_id", F.explode("image_urls").alias("image")).select(*keys, "product_ord", "name", "sku_id", F.explode(U.image_match_keys(F.col("image"))).alias("key")).distinct()
    met = left.join(right, [*keys, "key"])
    return first_by(met, [*keys, "url"], [F.desc(U.style_code(F.col("sku_id"))), "product_ord"]).select(*keys, "url", "name", "sku_id")


def matched(images: DataFrame, products: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates ``(keys, url, dom_name, dom_sku, …)`` with ``product_name`` and ``sku_id``.

    What the page's elements say comes first, then the matched product; style codes are upper case.
    """
    urls = images.select(*keys, "url").distinct()
    first = exact(urls, products, keys).withColumn("via", F.lit(0))
    second = by_keys(urls, products, keys).withColumn("via", F.lit(1))
    found = first_by(first.unionByName(second), [*keys, "url"], ["via"]).drop("via").withColumnRenamed("name", "m_name").withColumnRenamed("sku_id", "m_sku")
    dom, hit = F.nullif(F.trim("dom_sku"), F.lit("")), F.nullif("m_sku", F.lit(""))
    sku = F.coalesce(dom, hit)
    sku = F.when(U.style_code(sku), F.upper(F.trim(sku))).otherwise(sku)
    return images.join(found, [*keys, "url"], "left").withColumn("product_name", F.coalesce(F.nullif(F.trim("dom_name"), F.lit("")), F.nullif("m_name", F.lit("")))).withColumn("sku_id", sku).drop("m_name", "m_sku")


def single_product_fill(candidates: DataFrame, products: DataFrame, keys: list[str], page: str, hint: str) -> DataFrame:
    """On pages of one product whose address holds ``hint``, its name and SKU fill what candidates lack."""
    single = products.groupBy(*keys).agg(F.count("*").alias("n"), F.first("name").alias("s_name"), F.first("sku_id").alias("s_sku")).where("n = 1").drop("n")
    here = F.col(page).contains(hint)
    fill = lambda own, other: F.coalesce(F.nullif(F.col(own), F.lit("")), F.when(here, F.col(other))).alias(own)
    rest = [c for c in candidates.columns if c not in ("product_name", "sku_id")]
    return candidates.join(single, keys, "left").select(*rest, fill("product_name", "s_name"), fill("sku_id", "s_sku"))
