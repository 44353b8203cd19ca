"""Themes of a brand's images: discovery, assignment in batches, and who is left."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.rules import Rules, shop_defaults
from . import sampling
from .dedupe import first_by
from .gates import cosine

DISCOVERY, BATCH, TARGET = 20, 12, 5


class Provider(Protocol):
    """What a hosted model would do; the default here works on vectors alone and is deterministic."""

    def discover(self, images: DataFrame, target: int) -> DataFrame:
        """``(brand_id, theme_ord, cluster_label, vector)``."""

    def assign(self, images: DataFrame, themes: DataFrame) -> DataFrame:
        """``(brand_id, image_ord, theme_ord, similarity)``."""

    def infer(self, prompt: str, domain: str) -> Rules:
        """Extraction rules of a site, from a prompt with a few of its pages."""


class VectorProvider:
    """Evenly spaced images are the themes; an image goes to the nearest one if near enough."""

    def __init__(self, floor: float = -1.0):
        self.floor = floor

    def infer(self, prompt: str, domain: str) -> Rules:
        return shop_defaults(domain)

    def discover(self, images: DataFrame, target: int = TARGET) -> DataFrame:
        seeds = sampling.even(images, ["brand_id"], ["ord"], target)
        return seeds.select("brand_id", F.col("pick").alias("theme_ord"), F.concat(F.lit("theme "), (F.col("pick") + 1).cast("string")).alias("cluster_label"), F.col("embedding").alias("vector"))

    def assign(self, images: DataFrame, themes: DataFrame) -> DataFrame:
        met = images.select("brand_id", F.col("ord").alias("image_ord"), "embedding").join(themes.select("brand_id", "theme_ord", "vector"), "brand_id")
        scored = met.select("brand_id", "image_ord", "theme_ord", cosine(F.col("embedding"), F.col("vector")).alias("similarity"))
        best = scored.groupBy("brand_id", "image_ord").agg(F.max_by(F.struct("theme_ord", "similarity"), F.struct("similarity", (-F.col("theme_ord")).alias("t"))).alias("x"))
        return best.select("brand_id", "image_ord", "x.theme_ord", "x.similarity").where(F.col("similarity") >= self.floor)


def target_count(wanted: Column, total: Column) -> Column:
    return F.least(F.greatest(wanted, F.lit(1)), total)


def claimed(assignments: DataFrame, images: DataFrame, themes: DataFrame) -> DataFrame:
    """``(brand_id, theme_ord, pos, image_ord)`` from ``(brand_id, batch_no, batch_start, batch_len, assignment_ord, cluster_label, image_indices)``.

    Labels that aren't themes and indices outside their batch are passed over; an image is
    claimed once, by the first batch, assignment and place that name it.
    """
    known = assignments.join(themes.select("brand_id", "cluster_label", "theme_ord"), ["brand_id", "cluster_label"])
    each = known.select("brand_id", "theme_ord", "batch_no", "batch_start", "batch_len", "assignment_ord", F.posexplode("image_indices").alias("p", "index"))
    ok = each.where("index between 1 and batch_len").withColumn("image_ord", F.col("batch_start") + F.col("index") - 1)
    order = ["batch_no", "assignment_ord", "p"]
    once = first_by(ok, ["brand_id", "image_ord"], order)
    pos = F.row_number().over(Window.partitionBy("brand_id", "theme_ord").orderBy(*order)) - 1
    return once.select("brand_id", "theme_ord", pos.alias("pos"), "image_ord").join(images.select("brand_id", F.col("ord").alias("image_ord")), ["brand_id", "image_ord"], "left_semi")


def members(themes: DataFrame, assigned: DataFrame) -> DataFrame:
    """Every theme with its images in order; a theme without any has an empty list."""
    got = assigned.groupBy("brand_id", "theme_ord").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "image_ord"))), lambda x: x["image_ord"]).alias("images"))
    return themes.join(got, ["brand_id", "theme_ord"], "left").withColumn("images", F.coalesce("images", F.array().cast("array<int>")))


def unassigned(images: DataFrame, assigned: DataFrame) -> DataFrame:
    return images.join(assigned.select("brand_id", F.col("image_ord").alias("ord")).distinct(), ["brand_id", "ord"], "left_anti")


def analysed(images: DataFrame, provider: Provider | None = None, target: int = TARGET) -> tuple[DataFrame, DataFrame]:
    """Themes, and assignments ``(brand_id, theme_ord, pos, image_ord)``, by a provider."""
    provider = provider or VectorProvider()
    themes = provider.discover(images, target)
    got = provider.assign(images, themes)
    pos = F.row_number().over(Window.partitionBy("brand_id", "theme_ord").orderBy("image_ord")) - 1
    return themes, got.select("brand_id", "theme_ord", pos.alias("pos"), "image_ord")
