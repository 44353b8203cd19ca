"""Toxicity by a weighted lexicon.

Texts are folded first: case, compatibility forms, look-alike letters of other scripts,
invisible characters, and digits or signs that stand for letters.  An Aho-Corasick automaton
finds the lexicon's entries, which begin at the start of a word and are whole words or stems;
of the entries found in one word the heaviest counts.  A hit inside an exception phrase does
not count.  The weights of a text are summed, divided by a slow function of its length, and
turned into a score by a logistic curve.

The lexicon is learned from labelled texts: document frequencies by class over words and
stems, smoothed log odds as weights, and entries only where the class is almost pure and the
word stands after several different words, so that copies of one text cannot add theirs.
How many entries there are is bounded by the sample alone.  The exceptions are fixed; none is
learned from clean texts.  Without labels of both classes only the starting lexicon is used.

Edge cases: null and empty texts have no hits and the lowest score; very long texts are scored
whole; one row in, one row out, repeated rows included, and an empty table gives none; of
entries that begin a word, the one of greatest weight counts, of equal weights either; labels,
language, source, id and any other columns are never read for a score, and stay as they are
where rows are filtered.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import blocks, spread, table
from .labelled import held_out, sample

BLOCK = 4 << 20
#: Bytes of labelled text counted together.
COUNTED = 1 << 20
#: Labelled documents learned from, at most.
MOST_LABELLED = 12_000
STEMS = range(4, 8)

#: Look-alikes of Latin letters (fixed values).
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "к": "k", "м": "m",
    "т": "t", "в": "b", "н": "h", "ԛ": "q", "ԝ": "w", "ɡ": "g", "ı": "i", "ο": "o", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ρ": "p",
    "τ": "t", "υ": "u", "χ": "x", "ӏ": "l", "ɑ": "a", "ո": "n", "ս": "u", "օ": "o",
}
#: Digits and signs that stand for letters (fixed values).
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}
SIGNS = {"@": "a", "$": "s", "!": "i"}
#: Entries known without labels, with weights (fixed values).
STARTING = {w: 3.0 for w in "idiot moron stupid clown loser trash scum pathetic disgusting worthless".split()}
#: Phrases in which an entry is harmless (fixed values).
EXCEPTIONS = ("trash can", "trash bin", "trash collection", "clown fish", "circus clown", "class clown", "pond scum", "soap scum", "sore loser board", "idiot proof")

_FOLD = str.maketrans(LOOKALIKES | DIGITS)
_DIGIT = str.maketrans(DIGITS)
_RARE = re.compile("[" + "".join(LOOKALIKES) + "­​-‏⁠﻿̀-ͯ℀-⅏＀-￯\U0001d400-\U0001d7ff]")
_HIDDEN = re.compile("[­​-‏⁠﻿]")
_SIGN = re.compile(r"(?<=\w)[@$!](?=\w)|(?<!\w)[@$](?=\w)")
_WORD = re.compile(r"\w+")


def fold(text: str) -> str:
    """The text as the lexicon sees it."""
    text = text.lower()
    if _RARE.search(text):
        text = _HIDDEN.sub("", unicodedata.normalize("NFKC", text)).lower().translate(_FOLD)
    elif any(c in text for c in "013457"):
        for a, b in DIGITS.items():
            text = text.replace(a, b)
    if "@" in text or "$" in text or "!" in text:
        text = _SIGN.sub(lambda m: SIGNS[m[0]], text)
    return text


@dataclass
class Lexicon:
    """Weights by entry (a whole word ends in a space, a stem doesn't), exceptions, and the curve."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    slope: float = 2.0
    offset: float = -2.0
    _automaton: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def automaton(self):
        """Values are (length, weight as a whole word, weight as a stem); no weights mark an exception."""
        if self._automaton is None:
            import ahocorasick

            values: dict[str, tuple] = {e: (len(e), None, None) for e in self.exceptions}
            for entry, w in self.weights.items():
                stem = entry.rstrip(" ")
                _, whole, part = values.get(stem, (0, 0.0, 0.0))
                values[stem] = (len(stem), max(whole or 0.0, w), part or 0.0) if entry.endswith(" ") else (len(stem), whole or 0.0, max(part or 0.0, w))
            a = ahocorasick.Automaton()
            for stem, v in values.items():
                a.add_word(stem, v)
            a.make_automaton()
            self._automaton = a
        return self._automaton

    def hits(self, folded: str) -> list[tuple[int, int, float]]:
        """``(start, end, weight)`` of what counts, one a word."""
        words: dict[int, tuple[int, float]] = {}
        spared: list[tuple[int, int]] = []
        size = len(folded)
        for last, (length, whole, part) in self.automaton().iter(folded):
            start, end = last + 1 - length, last + 1
            if start and (folded[start - 1].isalnum() or folded[start - 1] == "_"):
                continue
            ended = end == size or not (folded[end].isalnum() or folded[end] == "_")
            if whole is None:
                if ended:
                    spared.append((start, end))
                continue
            weight = max(part, whole if ended else 0.0)
            if weight > words.get(start, (0, 0.0))[1]:
                words[start] = (end, weight)
        return [(a, b, w) for a, (b, w) in sorted(words.items()) if not any(x <= a and b <= y for x, y in spared)]

    def strength(self, text: str | None) -> float:
        """Summed weights over a slow function of the length."""
        if not text:
            return 0.0
        got = self.hits(fold(text)) if len(self.automaton()) else []
        return sum(w for _, _, w in got) / (1 + math.log1p(len(text) / 2000)) if got else 0.0

    def score(self, text: str | None) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * self.strength(text) + self.offset))))


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries and, after a tab, the word before, with document frequencies by class."""
    for batch in (b for whole in batches for b in blocks(whole, "text", COUNTED)):
        clean, toxic, beside = Counter(), Counter(), Counter()
        for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
            words = _WORD.findall(fold(text or ""))
            terms = {w + " " for w in words} | {w[:k] for w in words if len(w) > 4 for k in STEMS if len(w) > k}
            (toxic if y else clean).update(terms)
            if y:
                near = set()
                for before, w in zip(["", *words], words):
                    near.add((w + " ", before))
                    near.update((w[:k], before) for k in STEMS if len(w) > k)
                beside.update(near)
        for d, kind in ((clean, 0), (toxic, 1)):
            yield pa.RecordBatch.from_arrays([pa.array(list(d), pa.string()), pa.array([""] * len(d), pa.string()), pa.array([kind] * len(d), pa.int32()), pa.array(list(d.values()), pa.int64())], names=["term", "beside", "kind", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in beside], pa.string()), pa.array([b for _, b in beside], pa.string()), pa.array([2] * len(beside), pa.int32()), pa.array(list(beside.values()), pa.int64())], names=["term", "beside", "kind", "n"])


def _pruned(entries: list[tuple[str, int, float]]) -> dict[str, float]:
    """The starting lexicon, and entries without the stems that one longer entry explains."""
    explained: Counter = Counter()
    for term, bad, _ in entries:
        for k in STEMS:
            if len(term) > k:
                explained[term[:k]] = max(explained[term[:k]], bad)
    out = {t: round(min(w, 6.0), 4) for t, bad, w in entries if t.endswith(" ") or explained[t] < 0.8 * bad}
    return out | {f"{k} ": max(v, out.get(f"{k} ", 0.0)) for k, v in STARTING.items()}


def learn(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Lexicon:
    """A lexicon from a bounded sample of labelled documents outside the held-out fold."""
    got = sample(docs, labels, "toxic", most).repartition(max(2, most // 1000))
    sizes = {r["y"]: r["n"] for r in got.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return Lexicon(_pruned([]))
    counts = got.select("text", "y").mapInArrow(_counted, "term string, beside string, kind int, n bigint")
    by_term = (
        counts.groupBy("term", "kind", "beside").agg(F.sum("n").alias("n"))
        .groupBy("term").agg(F.sum(F.when(F.col("kind") == 1, F.col("n"))).alias("bad"), F.coalesce(F.sum(F.when(F.col("kind") == 0, F.col("n"))), F.lit(0)).alias("good"), F.count(F.when(F.col("kind") == 2, 1)).alias("contexts"))
        .withColumn("weight", F.log((F.col("bad") + 0.5) / (sizes[1] + 1.0)) - F.log((F.col("good") + 0.5) / (sizes[0] + 1.0)))
        .where("bad >= 5 and contexts >= 4 and bad >= 20 * good and contexts * 2 >= bad and weight > 1.5")
    )
    weights = _pruned([(r["term"], r["bad"], r["weight"]) for r in by_term.select("term", "bad", "weight").collect()])
    lexicon = Lexicon(weights)

    def strengths(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([lexicon.strength(t) for t in b.column("text").to_pylist()], pa.float64()), b.column("y")], names=["x", "y"])

    # Two columns of at most ``most`` numbers.
    x, y = (np.array(c, dtype=np.float64) for c in zip(*got.select("text", "y").mapInArrow(strengths, "x double, y int").collect()))
    lexicon.slope, lexicon.offset = curve(x, y)
    return lexicon


def curve(x: np.ndarray, y: np.ndarray, steps: int = 400) -> tuple[float, float]:
    """Logistic curve of one feature by Newton's method with a small ridge; it never falls."""
    a, b = 1.0, -1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = p * (1 - p) + 1e-6
        g = np.array([np.sum((p - y) * x) + 0.05 * a, np.sum(p - y) + 0.01 * b])
        h = np.array([[np.sum(w * x * x) + 0.05, np.sum(w * x)], [np.sum(w * x), np.sum(w) + 0.01]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 1.0 / max(1e-9, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-7:
            break
    return float(max(a, 0.1)), float(b)


def scored(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``(doc_id, score)`` of each text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in blocks(whole, "text", BLOCK):
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([lexicon.score(t) for t in b.column("text").to_pylist()], pa.float64())], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def without_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.5) -> DataFrame:
    """The rows whose text scores below the threshold, all columns as they were."""

    def run(batches):
        for whole in batches:
            for b in blocks(whole, "text", BLOCK):
                yield b.filter(pa.array([lexicon.score(t) < threshold for t in b.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document, with a lexicon learned outside the held-out fold."""
    docs = spread(table(spark, sf_dir, "documents"))
    lexicon = learn(docs, table(spark, sf_dir, "labels"))
    return scored(docs, lexicon).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op3_toxicity": op3_toxicity}
ORACLE_SQL: dict[str, str] = {}
