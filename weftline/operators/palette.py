"""Colour palettes from counted pixels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import rules as R, text as T

SIZE, MOST_IMAGES, LEAST_DISTANCE, HEADROOM = 8, 30, 40, 6
#: Colours of one key that are walked, at most.
MOST_COLOURS = 1_000_000


def shares(counts: DataFrame, keys: list[str]) -> DataFrame:
    """``pct``: each colour's share of its key's pixels, to one decimal."""
    return counts.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(*keys)), 1))


def coloured(counts: DataFrame) -> DataFrame:
    """Without greys, near-blacks and near-whites."""
    return counts.where(~R.neutral(F.col("r"), F.col("g"), F.col("b")))


def distinct_colours(counts: DataFrame, key: str, size: int = SIZE) -> DataFrame:
    """``(key, rank, r, g, b, n, pct)``: by count, a colour near a taken one is passed over, ``size`` at most.

    A key with fewer than three colours that aren't grey fills up with greys.  A key has at most a
    few thousand colours (pixels are counted in steps), and they are walked in order.
    """
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > MOST_COLOURS:
            raise ValueError(f"{len(pdf)} colours of one key; count pixels in wider steps")
        rows = pdf.sort_values(["n", "r", "g", "b"], ascending=[False, True, True, True])
        taken: list = []
        for grey in (False, True):
            if grey and len(taken) >= min(size, 3):
                break
            for x in rows[rows["neutral"] == grey].itertuples(index=False):
                if len(taken) >= size:
                    break
                if all(abs(x.r - y.r) + abs(x.g - y.g) + abs(x.b - y.b) >= LEAST_DISTANCE for y in taken):
                    taken.append(x)
        out = pd.DataFrame(taken, columns=rows.columns)
        out["rank"] = range(1, len(out) + 1)
        return out[[key, "rank", "r", "g", "b", "n", "pct"]]

    marked = shares(counts, [key]).withColumn("neutral", R.neutral(F.col("r"), F.col("g"), F.col("b")))
    kind = counts.schema[key].dataType.simpleString()
    got = marked.groupBy(key).applyInPandas(run, f"{key} {kind}, rank int, r int, g int, b int, n bigint, pct double")
    return got.withColumn("hex", T.rgb_hex(F.col("r"), F.col("g"), F.col("b")))


def median_cut(pixels: np.ndarray, most: int) -> list[tuple[int, int, int, int]]:
    """``(r, g, b, n)`` of at most ``most`` boxes of pixels: the box whose widest channel times its pixels is most is cut at that channel's median."""
    kinds, n = np.unique(pixels.reshape(-1, 3), axis=0, return_counts=True)
    boxes, cuttable = [(kinds.astype(np.int64), n)], True
    while cuttable and len(boxes) < most:
        width = [int((k.max(axis=0) - k.min(axis=0)).max()) * int(c.sum()) for k, c in boxes]
        cuttable = max(width) > 0
        if cuttable:
            k, c = boxes.pop(int(np.argmax(width)))
            channel = int(np.argmax(k.max(axis=0) - k.min(axis=0)))
            order = np.argsort(k[:, channel], kind="stable")
            k, c = k[order], c[order]
            half = int(np.searchsorted(np.cumsum(c), c.sum() / 2)) + 1
            at = min(max(1, half), len(k) - 1)
            boxes += [(k[:at], c[:at]), (k[at:], c[at:])]
    return [(*(int(round(x)) for x in (k * c[:, None]).sum(axis=0) / c.sum()), int(c.sum())) for k, c in boxes]


def of_thumbnails(thumbnails: DataFrame, images: DataFrame, key: str = "brand_id", size: int = SIZE) -> DataFrame:
    """Palette of each key by median cut over the thumbnails ``(url, width, height, rgb)`` of its first thirty images ``(key, url, ord)``.

    The thumbnails stand side by side on black, as high as the highest; ``size + HEADROOM`` colours are cut before
    near ones are passed over.  A key has thirty small pictures at most.
    """
    first = images.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("ord"))).where(F.col("_n") <= MOST_IMAGES).select(key, "url")
    kind = images.schema[key].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rgb = np.concatenate([np.frombuffer(x, dtype=np.uint8).reshape(-1, 3) for x in pdf["rgb"]])
        black = int(pdf["width"].sum()) * int(pdf["height"].max()) - len(rgb)
        out = pd.DataFrame(median_cut(np.concatenate([rgb, np.zeros((black, 3), dtype=np.uint8)]), size + HEADROOM), columns=["r", "g", "b", "n"])
        out.insert(0, key, pdf[key].iloc[0])
        return out

    counts = thumbnails.join(first, "url").groupBy(key).applyInPandas(run, f"{key} {kind}, r int, g int, b int, n bigint")
    return distinct_colours(counts.groupBy(key, "r", "g", "b").agg(F.sum("n").alias("n")), key, size)


def of_images(colours: DataFrame, images: DataFrame, key: str = "brand_id", size: int = SIZE) -> DataFrame:
    """Palette of each key from the colours ``(url, r, g, b, n)`` of its first thirty images ``(key, url, ord)``."""
    first = images.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("ord"))).where(F.col("_n") <= MOST_IMAGES).select(key, "url")
    counts = colours.join(first, "url").groupBy(key, "r", "g", "b").agg(F.sum("n").alias("n"))
    return distinct_colours(counts, key, size)
