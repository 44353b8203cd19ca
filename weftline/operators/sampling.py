"""Deterministic samples and batches of ordered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def diverse(images: DataFrame, keys: list[str], most: int) -> DataFrame:
    """At most ``most`` rows a key, with their place as ``rank``.

    With no more than that all stay in order; else the first of each source page, pages in
    order, then the others page by page.
    """
    page = Window.partitionBy(*keys, "source_page")
    marked = (
        images.withColumn("_total", F.count("*").over(Window.partitionBy(*keys))).withColumn("_nth", F.row_number().over(page.orderBy("ord")))
        .withColumn("_page", F.min("ord").over(page))
    )
    many = F.col("_total") > most
    order = Window.partitionBy(*keys).orderBy(F.when(many & (F.col("_nth") > 1), 1).otherwise(0), F.when(many, F.col("_page")), "ord")
    return marked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).drop("_total", "_nth", "_page")


def numbered(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """``nth`` from 0 and ``total`` in each key."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).withColumn("total", F.count("*").over(Window.partitionBy(*keys)))


def even(rows: DataFrame, keys: list[str], order: list, count: int) -> DataFrame:
    """Evenly spaced rows, first and last among them, as ``(…, pick)``; halves round to even."""
    n = numbered(rows, keys, order)
    k = F.least(F.greatest(F.lit(count), F.lit(1)), F.col("total"))
    steps = n.where("nth = 0").select(*keys, F.explode(F.sequence(F.lit(0), (k - 1).cast("int"))).alias("pick"), "total", k.alias("_count"))
    at = F.when(F.col("_count") <= 1, F.lit(0)).otherwise(F.bround(F.col("pick") * ((F.col("total") - 1) / (F.col("_count") - 1)), 0)).cast("int")
    wanted = steps.select(*keys, "pick", at.alias("nth"))
    return n.join(wanted, [*keys, "nth"]).drop("total")


def batches(rows: DataFrame, keys: list[str], order: list, size: int) -> DataFrame:
    """``batch_no`` and ``batch_pos``, both from 0, in order."""
    return numbered(rows, keys, order).withColumn("batch_no", F.floor(F.col("nth") / size).cast("int")).withColumn("batch_pos", F.col("nth") % size).drop("nth", "total")
