"""Bundles of images and texts as JSON documents, reports, and tables under them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import urls as U

IMAGE = "url string, width int, height int, source_page string, product_name string, sku_id string, source_kind string"
TEXT = "source_url string, kind string, text string, weight double"
BUNDLE = f"""source string, brand_url string, min_resolution string, images array<struct<{IMAGE.replace(' ', ':').replace(',:', ',')}>>, texts array<struct<{TEXT.replace(' ', ':').replace(',:', ',')}>>,
pages_crawled bigint, candidates_checked bigint, created_at timestamp, bot_protection struct<url:string,provider:string,reason:string>"""


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row a JSON document."""
    return spark.read.schema(BUNDLE).option("multiLine", True).json(path)


def write(bundles: DataFrame, path: str) -> None:
    bundles.write.mode("overwrite").json(path)


def images(bundles: DataFrame) -> DataFrame:
    """Image rows with their ordinal; kind is ``product`` where none is given."""
    got = bundles.select("brand_id", "source", "bundle_ord", F.posexplode("images").alias("ord", "i")).select("brand_id", "source", "bundle_ord", "ord", "i.*")
    return got.withColumn("source_kind", F.coalesce("source_kind", F.lit("product")))


def texts(bundles: DataFrame) -> DataFrame:
    """Text rows with their ordinal; weight is 1 where none is given."""
    got = bundles.select("brand_id", "source", "bundle_ord", F.posexplode("texts").alias("ord", "t")).select("brand_id", "source", "bundle_ord", "ord", "t.*")
    return got.withColumn("weight", F.coalesce("weight", F.lit(1.0)))


def write_reports(reports: DataFrame, path: str, name: str = "name") -> None:
    """One JSON document a row, in a folder for each slug."""
    rows = reports.withColumn("slug", U.slug(F.col(name)))
    rows.select(F.to_json(F.struct(*reports.columns)).alias("value"), "slug").write.mode("overwrite").partitionBy("slug").text(path)


def html_report(report: DataFrame) -> DataFrame:
    """``(brand_id, html)``: a page for each report, sections without content left out."""
    esc = lambda c: F.replace(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    section = lambda head, body: F.when(F.coalesce(body, F.lit("")) != "", F.concat(F.lit(f"<h2>{head}</h2>"), body)).otherwise("")
    swatches = F.array_join(F.transform("palette", lambda p: F.concat(F.lit('<span class="swatch" style="background:'), p["hex"], F.lit('"></span>'))), "")
    themes = F.array_join(F.transform("clusters", lambda c: F.concat(F.lit("<h3>"), esc(c["label"]), F.lit("</h3>"), F.array_join(F.transform(c["image_urls"], lambda u: F.concat(F.lit('<img src="'), esc(u), F.lit('">'))), ""))), "")
    quotes = F.array_join(F.transform("texts", lambda t: F.concat(F.lit("<p>"), esc(t), F.lit("</p>"))), "")
    page = F.concat(F.lit("<!DOCTYPE html><h1>"), esc(F.col("name")), F.lit("</h1>"), section("Palette", swatches), section("Themes", themes), section("Voice", quotes))
    return report.select("brand_id", page.alias("html"))
