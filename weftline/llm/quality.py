"""Quality by nearest-neighbour voting in a latent-semantic space.

A text's terms are pairs of neighbouring character kinds (letters by case, digits, white
space, each punctuation sign) and signs of repetition: words equal to one of the eight before,
lines seen before, and the share of distinct words, in the whole text and in that of its
windows of ``WINDOW`` words where it is least.  Counts are damped, weighted by inverse
document frequency and projected on the leading right singular vectors of the labelled
sample's matrix.  The labelled vectors are broadcast; every document's exact cosines with all
of them come from blocked matrix products, and the labels of its nearest vote with their
similarity as weight.

The labelled sample is bounded (``MOST_LABELLED``), and so is what is broadcast: that many
vectors of ``RANK`` numbers.  Edge cases: null and empty texts are a zero vector and get the
share of good labels in the sample; very long texts are read whole; of labelled vectors that tie
for the last of the nearest those of smaller id vote; without labels every score is 0.5; one row in, one row
out, repeated rows included, and an empty table gives none; labels, language, source, id and any
other columns are never read for a score.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import blocks, spread, string_views, table
from .labelled import held_out, sample

BLOCK = 4 << 20
MOST_LABELLED = 3_000
RANK = 48
NEIGHBOURS = 15
#: Similarities that differ by no more are equal.
TIE = 1e-12
#: Words looked at together for the share of distinct ones.
WINDOW = 4096

_KINDS = 40
_KIND = np.zeros(256, dtype=np.int64)
for _c in range(256):
    if chr(_c).isascii() and chr(_c).islower():
        _KIND[_c] = 1
    elif chr(_c).isascii() and chr(_c).isupper():
        _KIND[_c] = 2
    elif chr(_c).isascii() and chr(_c).isdigit():
        _KIND[_c] = 3
    elif _c == 32:
        _KIND[_c] = 4
    elif _c in (9, 11, 12, 13):
        _KIND[_c] = 5
    elif _c == 10:
        _KIND[_c] = 6
    elif _c >= 128:
        _KIND[_c] = 7
for _i, _c in enumerate(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"):
    _KIND[_c] = 8 + _i
_PAIRS = _KINDS * _KINDS
_REPEATS = 12
TERMS = _PAIRS + _REPEATS


def terms(text: bytes) -> np.ndarray:
    """Damped term frequencies of one text, of unit scale whatever its length."""
    out = np.zeros(TERMS)
    if not text:
        return out
    kinds = _KIND[np.frombuffer(text, dtype=np.uint8)]
    if len(kinds) > 1:
        out[:_PAIRS] = np.bincount(kinds[:-1] * _KINDS + kinds[1:], minlength=_PAIRS) / len(kinds)
    words = text.split()
    n = max(1, len(words))
    hashed = np.fromiter(map(hash, words), dtype=np.int64, count=len(words))
    for k in range(1, 9):
        out[_PAIRS + k - 1] = np.count_nonzero(hashed[k:] == hashed[:-k]) / n
    lines = [x for x in text.split(b"\n") if x]
    out[_PAIRS + 8] = 1 - len(set(lines)) / max(1, len(lines))
    # The last window ends with the text, so that all of a longer text are of one size.
    windows = [*range(0, n - WINDOW, WINDOW), max(0, n - WINDOW)]
    distinct = min(len(np.unique(hashed[a : a + WINDOW])) for a in windows) / min(n, WINDOW) if n > 1 else 1.0
    seen = len(np.unique(hashed)) / n
    out[_PAIRS + 9] = max(0.0, 0.5 - distinct)
    out[_PAIRS + 10] = max(0.0, 0.25 - seen)
    out[_PAIRS + 11] = float(len(max(words, key=len, default=b"")) > 200)
    return np.sqrt(out)


@dataclass
class Space:
    """What is broadcast: term weights, the projection, and the labelled vectors with their labels."""

    weight: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def project(self, rows: np.ndarray) -> np.ndarray:
        v = (rows * self.weight) @ self.basis
        size = np.linalg.norm(v, axis=1, keepdims=True)
        return np.divide(v, size, out=np.zeros_like(v), where=size > 0)

    def scores(self, texts: list[bytes], neighbours: int = NEIGHBOURS) -> np.ndarray:
        """Share of good labels among the nearest, weighted by similarity."""
        if not len(self.labels):
            return np.full(len(texts), 0.5)
        out = np.empty(len(texts))
        for a in range(0, len(texts), 512):
            v = self.project(np.stack([terms(t) for t in texts[a : a + 512]]))
            near = v @ self.vectors.T
            k = min(neighbours, near.shape[1])
            least = np.partition(near, near.shape[1] - k, axis=1)[:, -k, None]
            votes, tied = near > least + TIE, np.abs(near - least) <= TIE
            votes |= tied & (np.cumsum(tied, axis=1) <= k - votes.sum(axis=1, keepdims=True))
            w = np.where(votes, np.maximum(near, 0) ** 2, 0) ** 2
            total, voted = w.sum(axis=1), w @ self.labels
            out[a : a + 512] = np.where(total > 0, np.clip(voted / np.where(total > 0, total, 1), 0, 1), self.labels.mean())
        return out


def learn(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, rank: int = RANK) -> Space:
    """The space of a bounded labelled sample outside the held-out fold."""

    def run(batches):
        for b in batches:
            rows = [terms(t) for t in string_views(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([r.tolist() for r in rows], pa.list_(pa.float64())), b.column("y")], names=["doc_id", "v", "y"])

    got = sample(docs, labels, "quality", most).select("doc_id", "text", "y").mapInArrow(run, "doc_id bigint, v array<double>, y int").toArrow()
    if not got.num_rows:
        return Space(np.ones(TERMS), np.zeros((TERMS, 1)), np.zeros((0, 1)), np.zeros(0))
    got = got.take(pa.compute.sort_indices(got, [("doc_id", "ascending")]))
    rows = np.asarray(got.column("v").combine_chunks().flatten()).reshape(got.num_rows, TERMS)
    y = np.asarray(got.column("y"), dtype=np.float64)
    weight = np.log((1 + len(rows)) / (1 + (rows > 0).sum(axis=0))) + 1
    _, _, basis = np.linalg.svd(rows * weight, full_matrices=False)
    space = Space(weight, basis[:rank].T.copy(), np.zeros((0, 1)), y)
    space.vectors = space.project(rows)
    return space


def scored(docs: DataFrame, space: Space) -> DataFrame:
    """``(doc_id, score)`` of each text."""
    shared = docs.sparkSession.sparkContext.broadcast(space)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in blocks(whole, "text", BLOCK):
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(shared.value.scores(string_views(b.column("text"))), pa.float64())], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document, with neighbours from outside the held-out fold."""
    docs = spread(table(spark, sf_dir, "documents"))
    space = learn(docs, table(spark, sf_dir, "labels"))
    return scored(docs, space).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES = {"op6_quality": op6_quality}
ORACLE_SQL: dict[str, str] = {}
