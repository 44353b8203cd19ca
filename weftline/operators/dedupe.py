"""Which of several rows stays: first wins, heaviest wins, or all are made one.

Every relation carries an explicit order, so a result doesn't depend on how rows are dealt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

Names = list[str]


def first_by(rows: DataFrame, keys: Names, order: list[Column | str]) -> DataFrame:
    """The first row of each key."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


def first_few(rows: DataFrame, keys: Names, order: list[Column | str], most: int) -> DataFrame:
    """The first ``most`` rows of each key, with their place as ``rank``."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("rank", n).where(F.col("rank") <= most)


def heaviest_texts(texts: DataFrame, keys: Names, most: int | None = 40) -> DataFrame:
    """Texts equal but for case and ends are one: the heaviest, the earliest of equals.

    Ranked by weight, then by where the text first appeared; at most ``most`` a key, with ``rank``.
    Equal texts are reduced before the shuffle, so a text that very many rows share is no burden.
    """
    best = F.min_by(F.struct(*texts.columns), F.struct(F.col("weight").isNull().alias("none"), (-F.col("weight")).alias("light"), "ord"))
    once = texts.groupBy(*[F.col(k).alias(f"_{k}") for k in keys], F.lower(F.trim("text")).alias("_key")).agg(F.min("ord").alias("_first"), best.alias("_best"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last("weight"), "_first"))
    ranked = once.select("_best.*", "_first").withColumn("rank", rank).drop("_first")
    return ranked if most is None else ranked.where(F.col("rank") <= most)


def merged_products(products: DataFrame, keys: Names) -> DataFrame:
    """Products ``(keys, ord, name, sku_id, image_urls)`` of equal SKU are one: first name there is, all images in order of URL.

    Those without SKU stay apart.
    """
    own = F.when(F.col("sku_id").isNull() | (F.col("sku_id") == ""), F.col("ord"))
    named = F.col("name") != ""
    each = products.withColumn("_alone", own).withColumn("_url", F.explode_outer("image_urls"))
    # Collected by set, so that an image is held once in each task and once in the end, however many rows show it.
    return (
        each.groupBy(*keys, "sku_id", "_alone")
        .agg(F.min("ord").alias("ord"), F.min_by(F.when(named, F.col("name")), F.when(named, F.col("ord"))).alias("name"), F.array_sort(F.collect_set("_url")).alias("image_urls"))
        .drop("_alone")
    )


def merged_candidates(candidates: DataFrame, keys: Names) -> DataFrame:
    """Candidates ``(keys, url, ord, source_page, product_name, sku_id)`` of one URL: the first page, the first name and the first SKU there are."""
    there = lambda c: F.min_by(F.when(F.col(c) != "", F.col(c)), F.when(F.col(c) != "", F.col("ord"))).alias(c)
    return candidates.groupBy(*keys, "url").agg(F.min("ord").alias("ord"), F.min_by("source_page", "ord").alias("source_page"), there("product_name"), there("sku_id"))


def one_image_per_sku(images: DataFrame, keys: Names, order: list[Column | str]) -> DataFrame:
    """The first image of each SKU; images without name or SKU are never taken."""
    return first_by(images.where("product_name <> '' and sku_id <> ''"), [*keys, "sku_id"], order)
