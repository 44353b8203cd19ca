"""Weighted scores of judged reports and their rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Weights of the judged dimensions (fixed values).
WEIGHTS = {"visual": 0.25, "voice": 0.20, "audience": 0.15, "clusters": 0.20, "completeness": 0.10, "actionability": 0.10}


def weighted() -> Column:
    return F.round(sum((F.col(k) * w for k, w in WEIGHTS.items()), F.lit(0.0)), 2)


def ranked(scores: DataFrame, keys: list[str] = (), value: str = "score") -> DataFrame:
    """Rows with a score, best first, as ``rank`` (in each key)."""
    return scores.where(F.col(value).isNotNull()).withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(value), "model")))


def averaged(scores: DataFrame) -> DataFrame:
    """``(model, score, rank)`` over brands."""
    return ranked(scores.groupBy("model").agg(F.round(F.avg("score"), 2).alias("score")))


def write_results(results: DataFrame, path: str, judge: str) -> None:
    """One JSON document a brand: its results, and its models by score."""
    ranked = results.withColumn("n", F.when(F.col("score").isNotNull(), F.row_number().over(Window.partitionBy("brand").orderBy(F.desc_nulls_last("score"), "model"))))
    ranking = F.transform(F.sort_array(F.collect_list(F.when(F.col("n").isNotNull(), F.struct("n", "model", "score")))), lambda x: F.struct(x["model"].alias("model"), x["score"].alias("weighted_score")))
    got = ranked.groupBy("brand").agg(F.lit(judge).alias("judge_model"), F.current_timestamp().alias("generated_at"), F.collect_list(F.struct("model", "score")).alias("results"), ranking.alias("ranking_by_weighted_score"))
    got.write.mode("overwrite").json(path)


def observed(rows: DataFrame, stage: str, kept: Column) -> DataFrame:
    """The same rows; how many there were and how many were kept is told to listeners as ``stage``."""
    return rows.observe(stage, F.count("*").alias("rows"), F.count_if(kept).alias("kept"))
