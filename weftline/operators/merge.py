"""Merging the bundles of several sources into one a brand."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .dedupe import first_by, heaviest_texts


def primary(bundles: DataFrame) -> DataFrame:
    """``(brand_id, brand_url, min_resolution)`` of the first website bundle, else of the first bundle."""
    order = F.struct((F.col("source") != "website").alias("other"), "bundle_ord")
    return bundles.groupBy("brand_id").agg(F.min_by(F.struct("brand_url", "min_resolution"), order).alias("p")).select("brand_id", "p.*")


def counters(bundles: DataFrame) -> DataFrame:
    """``(brand_id, pages_crawled, candidates_checked, bot_protection)``: sums, and the first block there was."""
    blocked = F.col("bot_protection").isNotNull()
    return bundles.groupBy("brand_id").agg(F.sum("pages_crawled").alias("pages_crawled"), F.sum("candidates_checked").alias("candidates_checked"), F.min_by(F.when(blocked, F.col("bot_protection")), F.when(blocked, F.col("bundle_ord"))).alias("bot_protection"))


def merged(bundles: DataFrame) -> DataFrame:
    """One ``combined`` bundle row a brand; without any bundle there is none."""
    return primary(bundles).join(counters(bundles), "brand_id").withColumn("source", F.lit("combined"))


def images(rows: DataFrame) -> DataFrame:
    """Each URL of a brand once, the first by bundle and place."""
    return first_by(rows, ["brand_id", "url"], ["bundle_ord", "ord"])


def texts(rows: DataFrame) -> DataFrame:
    """Each text of a brand once, the heaviest, by weight; none is cut off."""
    placed = rows.withColumn("ord", F.struct("bundle_ord", "ord"))
    return heaviest_texts(placed, ["brand_id"], None).drop("ord")
