"""Labelled training texts for the classifiers: a bounded, repeatable sample."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

FOLDS = 5


def held_out(key: str = "doc_id"):
    """Rows whose crc32 of the id as text is 0 modulo five are never learned from."""
    return F.crc32(F.col(key).cast("string")) % FOLDS == 0


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """``(doc_id, text, y)`` of at most ``most`` labelled documents, half of each class at most.

    Which ones: those of smallest hash of the id, outside the held-out fold.  Repeated labels
    of an id count once, by majority (a tie is 1); of texts that repeat an id, that of smallest
    hash is taken, then the smallest; null ids and labels are left out, null texts are empty.
    """
    ids = (
        labels.select("doc_id", F.col(label).alias("y")).where("doc_id is not null and y is not null")
        .where(~held_out()).groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    )
    chosen = [ids.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most // 2) for y in (0, 1)]
    # Both sides are bounded by ``most`` ids.
    known = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen[0].union(chosen[1])), "doc_id")
    return known.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"), F.first("y").alias("y")).select("doc_id", "t.text", "y")
