"""Representative images of each theme, with backfill and a floor of themes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.rules import kind_rank

LEAST, MOST, FLOOR = 2, 3, 3


def representatives(themes: DataFrame, assigned: DataFrame, images: DataFrame, pool: DataFrame, least: int = LEAST, most: int = MOST, floor: int = FLOOR) -> DataFrame:
    """``(brand_id, theme_ord, nth, url)``; a kept theme without images has one row with null url.

    For images that stand in one theme at most.  Each theme takes up to ``most`` of its own, products first;
    those under ``least`` are filled in turn from the pool ``(brand_id, pool_ord, url)``: a theme's
    needs are places of the pool, so the filling is one equi-join.  Themes left
    empty go only if there are more than ``floor`` themes and at least ``floor`` stay.
    """
    theme = Window.partitionBy("brand_id", "theme_ord")
    own = (
        assigned.join(images.select("brand_id", F.col("ord").alias("image_ord"), "url", "source_kind"), ["brand_id", "image_ord"])
        .withColumn("nth", F.row_number().over(theme.orderBy(kind_rank(F.col("source_kind")), "pos"))).where(F.col("nth") <= most)
        .select("brand_id", "theme_ord", "nth", "url")
    )
    have = themes.select("brand_id", "theme_ord").join(own.groupBy("brand_id", "theme_ord").agg(F.count("*").alias("n")), ["brand_id", "theme_ord"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    need = have.withColumn("need", F.greatest(F.lit(least) - F.col("n"), F.lit(0)))
    upto = F.sum("need").over(Window.partitionBy("brand_id").orderBy("theme_ord"))
    spans = need.withColumn("to", upto).withColumn("from", F.col("to") - F.col("need"))
    free = pool.withColumn("p", F.row_number().over(Window.partitionBy("brand_id").orderBy("pool_ord")) - 1).select("brand_id", "p", "url")
    # A theme wants a few places of the pool by number: an equi-join on brand and place.
    wants = spans.where("need > 0").select("brand_id", "theme_ord", "n", "from", F.explode(F.expr("sequence(from, to - 1)")).alias("p"))
    filled = wants.join(free, ["brand_id", "p"]).select("brand_id", "theme_ord", (F.col("n") + F.col("p") - F.col("from") + 1).alias("nth"), "url")
    picks = own.unionByName(filled)
    left = themes.select("brand_id", "theme_ord").join(picks, ["brand_id", "theme_ord"], "left")
    each = left.groupBy("brand_id", "theme_ord").agg(F.max(F.col("url").isNotNull()).alias("full"))
    stays = each.groupBy("brand_id").agg(F.count("*").alias("_all"), F.count_if("full").alias("_full")).where((F.col("_all") <= floor) | (F.col("_full") < floor)).select("brand_id", F.lit(True).alias("_stays"))
    return left.join(stays, "brand_id", "left").where(F.col("url").isNotNull() | F.col("_stays")).drop("_stays")


def representatives_shared(themes: DataFrame, assigned: DataFrame, images: DataFrame, pool: DataFrame, least: int = LEAST, most: int = MOST, floor: int = FLOOR) -> DataFrame:
    """The same where an image may stand in several themes: the first theme claims it, so a brand's rows are walked in order."""
    own = assigned.join(images.select("brand_id", F.col("ord").alias("image_ord"), "url", "source_kind"), ["brand_id", "image_ord"]).select("brand_id", "theme_ord", kind_rank(F.col("source_kind")).alias("rank"), F.col("pos").cast("long").alias("pos"), "url")
    rest = pool.select("brand_id", F.lit(-1).cast("int").alias("theme_ord"), F.lit(0).alias("rank"), F.col("pool_ord").cast("long").alias("pos"), "url")
    bare = themes.select("brand_id", "theme_ord", F.lit(-1).alias("rank"), F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("string").alias("url"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["theme_ord", "rank", "pos"], kind="stable")
        brand = pdf["brand_id"].iloc[0]
        queue = pdf.loc[pdf["theme_ord"] == -1, "url"].tolist()
        used: set = set()
        picks: dict[int, list] = {}
        for t, r, u in pdf.loc[pdf["theme_ord"] >= 0, ["theme_ord", "rank", "url"]].itertuples(index=False):
            got = picks.setdefault(int(t), [])
            if r >= 0 and u not in used and len(got) < most:
                got.append(u)
                used.add(u)
        for got in picks.values():
            while len(got) < least and queue:
                if (u := queue.pop(0)) not in used:
                    got.append(u)
                    used.add(u)
        full = sum(bool(g) for g in picks.values())
        drop = len(picks) > floor and full >= floor
        rows = [(brand, t, i + 1 if u is not None else None, u) for t, g in picks.items() for i, u in enumerate(g or ([] if drop else [None]))]
        return pd.DataFrame(rows, columns=["brand_id", "theme_ord", "nth", "url"]).astype({"nth": "Int32"})

    every = bare.unionByName(own).unionByName(rest)
    return every.groupBy("brand_id").applyInPandas(run, "brand_id bigint, theme_ord int, nth int, url string")
