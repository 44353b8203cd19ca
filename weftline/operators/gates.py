"""Which images count: by shape, or by what an image model says of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import rules as R

THRESHOLD, SCALE = 0.55, 100.0


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def by_shape(images: DataFrame) -> DataFrame:
    return images.where(R.aspect_ok(F.col("width"), F.col("height")))


def prompt_share(vectors: DataFrame, prompts: DataFrame, key: str = "vec_id") -> DataFrame:
    """``(key, share)``: softmax over the prompts of 100 times the cosine, summed over the positive ones; nothing is shuffled.

    Prompts ``(prompt_id, prompt, positive)`` are a list of a few dozen at most, which is checked.
    """
    if prompts.count() > 1000:
        raise ValueError("prompts are a short list")
    told = prompts.agg(F.collect_list(F.struct("positive", F.col("prompt").alias("p"), norm(F.col("prompt")).alias("n"))).alias("told")).scalar()

    def share(x: Column) -> Column:
        m = F.array_max(F.transform(x, lambda e: e["s"]))
        total = lambda m, keep: F.aggregate(x, F.lit(0.0), lambda acc, e: acc + F.when(keep(e), F.exp(e["s"] - m)).otherwise(0.0))
        return F.get(F.transform(F.array(m), lambda m: total(m, lambda e: e["positive"]) / total(m, lambda e: F.lit(True))), F.lit(0))

    def similar(own: Column) -> Column:
        return F.transform(F.col("_told"), lambda t: F.struct(t["positive"].alias("positive"), (dot(F.col("embedding"), t["p"]) / (own * t["n"]) * SCALE).alias("s")))

    # Values that are used more than once pass through a transform of one element, which computes them once.
    sims = F.get(F.transform(F.array(norm(F.col("embedding"))), similar), F.lit(0))
    return vectors.withColumn("_told", told).select(key, F.get(F.transform(F.array(sims), share), F.lit(0)).alias("share"))


def by_prompts(vectors: DataFrame, prompts: DataFrame, threshold: float = THRESHOLD, key: str = "vec_id") -> DataFrame:
    """``(key, share)`` of the vectors at or over the threshold."""
    return prompt_share(vectors, prompts, key).where(F.col("share") >= threshold)


def gate(images: DataFrame, strategy: str = "heuristic", prompts: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Images under a named strategy; ``clip`` needs a column ``embedding`` and prompts, and keeps images without a vector; unknown names mean the heuristic."""
    if strategy in ("null", "none"):
        return images
    if strategy == "clip":
        if prompts is None or "embedding" not in images.columns:
            return images
        kept = by_prompts(images.where("embedding is not null"), prompts, threshold, "url").select("url")
        return images.join(kept, "url", "left_semi").unionByName(images.where("embedding is null"))
    return by_shape(images)
