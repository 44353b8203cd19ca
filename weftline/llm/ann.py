"""Approximate nearest neighbours by a forest of random-projection trees.

Trees are fitted on a bounded sample: each node splits at the median of the projections on the
difference of two of its vectors.  Every vector of the table is then sent down every tree.  A
query walks all trees at once through one priority queue of branches, ordered by the summed
squares of the margins crossed, until it has taken as many leaves as it may.  Queries and
vectors meet leaf by leaf, where cosines in double precision are computed in blocks and the best
of each leaf kept; a query's bests over its leaves are then scored exactly, in the order of the
components.

Depth grows with the table, so that leaves keep about ``LEAF_ROWS`` vectors, up to what the sample
can split (``FITTED_ROWS`` of its vectors a leaf).  How many leaves a query takes is measured: the
true neighbours of ``CALIBRATING`` sampled vectors among all vectors (one pass, blocks against a
broadcast of that many) tell at which place of their queues the neighbours' leaves stand, and
the smallest number of leaves that reaches ``RECALL`` of them is taken.  Vectors without
structure need most leaves at any size; the more they cluster, the fewer.

Vectors are compared within their length: each length has a forest, and a length too rare for
one is a single leaf.  Vectors are scaled by a power of two, which leaves every rounding of a
cosine as it is, so that no sum of squares over- or underflows.  Equal vectors are one candidate
with the smallest ids that could be asked for, so a vector that a third of the rows share does
not fill a leaf; large leaves are dealt over salts, from their counted size.  What is broadcast
is the forests, at most ``TREES`` hyperplanes for every ``FITTED_ROWS`` sampled vectors, and the
calibrating vectors; the sample holds at most ``MOST_FITTED`` vectors and ``MOST_NUMBERS`` numbers.

Edge cases: null, zero or non-finite vectors (or components) and null ids take no part; ids
that repeat are one candidate each row distinct by (id, vector); fewer candidates than asked for
are all returned; ties go to the smaller id; an empty table gives an empty result; very long
vectors work, with fewer of them in the sample; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import cut, sorted_groups, starts_of, table

#: Trees; vectors and numbers in the sample they are fitted on at most; vectors of a leaf, about; sampled vectors of a leaf at least.
TREES, MOST_FITTED, MOST_NUMBERS, LEAF_ROWS, FITTED_ROWS = 4, 20_000, 4_000_000, 256, 8
#: Share of true neighbours whose leaves are to be taken, and vectors by which it is measured.
RECALL, CALIBRATING = 0.95, 128
#: Vectors of a leaf in one group, about.
SALT_ROWS = 20_000


@dataclass
class Forest:
    """Complete binary trees: node k has children 2k+1 and 2k+2; the last level are leaves."""

    normals: np.ndarray  # tree, node, dimension
    offsets: np.ndarray  # tree, node

    @property
    def trees(self) -> int:
        return len(self.normals)

    @property
    def depth(self) -> int:
        return int(np.log2(self.normals.shape[1] + 1))

    def leaves_of(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each vector in each tree, by the hyperplanes on its way only."""
        out = np.zeros((len(x), self.trees), dtype=np.int64)
        for t, (normals, offsets) in enumerate(zip(self.normals, self.offsets)):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (np.einsum("ij,ij->i", x, normals[node]) > offsets[node])
            out[:, t] = node - normals.shape[0]
        return out

    def visit(self, q: np.ndarray) -> Iterator[tuple[int, int]]:
        """``(tree, leaf)`` in the order of a queue shared by all trees."""
        margins = [(normals @ q - offsets).tolist() for normals, offsets in zip(self.normals, self.offsets)]
        inner = self.normals.shape[1]
        queue = [(0.0, t, 0) for t in range(len(margins))]
        while queue:
            crossed, t, node = heapq.heappop(queue)
            while node < inner:
                m = margins[t][node]
                near, far = (2 * node + 2, 2 * node + 1) if m > 0 else (2 * node + 1, 2 * node + 2)
                heapq.heappush(queue, (crossed + m * m, t, far))
                node = near
            yield t, node - inner


def fit(sample: np.ndarray, trees: int, depth: int, seed: int = 7) -> Forest:
    """A forest over unit vectors; a node without two different vectors gets a random direction."""
    rng = np.random.default_rng(seed)
    trees = trees if depth else 1
    inner, width = 2**depth - 1, sample.shape[1]  # no inner node: one leaf
    normals, offsets = np.zeros((trees, inner, width)), np.zeros((trees, inner))
    for t in range(trees):
        rows = {0: np.arange(len(sample))}
        for node in range(inner):
            own = rows.pop(node, np.zeros(0, dtype=np.int64))
            direction = np.zeros(width)
            if len(own) > 1:
                a, b = rng.choice(own, 2, replace=False)
                direction = sample[a] - sample[b]
            if not np.linalg.norm(direction) > 1e-12:
                direction = rng.standard_normal(width)
            direction = direction / np.linalg.norm(direction)
            along = sample[own] @ direction
            normals[t, node], offsets[t, node] = direction, float(np.median(along)) if len(own) else 0.0
            right = along > offsets[t, node]
            rows[2 * node + 1], rows[2 * node + 2] = own[~right], own[right]
    return Forest(normals, offsets)


def usable(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """``(id, v array<double>)`` of the rows that take part; the largest component of ``v`` is near one by a power of two."""
    v = F.transform(F.col(column), lambda x: x.cast("double"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(key).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null and size(v) > 0").where(good)
    # In two steps, as the power that lifts the smallest numbers is none itself; the sum makes a negative zero positive.
    power = F.floor(F.log2(F.array_max(F.transform("v", F.abs)))).cast("int")
    half = F.floor(F.col("power") / 2).cast("int")
    scaled = F.transform("v", lambda x: x * F.pow(F.lit(2.0), -F.col("half")) * F.pow(F.lit(2.0), F.col("half") - F.col("power")) + 0.0)
    return rows.withColumn("power", power).withColumn("half", half).select("id", scaled.alias("v"))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Lists:
    """Rows of an Arrow list column as matrices, one for each length."""

    def __init__(self, column):
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        self.flat, self.at = np.asarray(column.values), np.asarray(column.offsets)
        self.width = np.diff(self.at)

    def matrix(self, a: int, b: int) -> np.ndarray:
        """Rows from ``a`` up to ``b``, which have one length."""
        return self.flat[self.at[a] : self.at[b]].reshape(b - a, -1)

    def by_width(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``(width, rows, matrix)``."""
        for w in np.unique(self.width).tolist():
            rows = np.flatnonzero(self.width == w)
            yield w, rows, self.flat[self.at[rows][:, None] + np.arange(w)]


def depth_of(n: int, fitted: int) -> int:
    """Levels for ``n`` vectors of which ``fitted`` are in the sample."""
    return max(0, int(np.log2(max(1, min(n / LEAF_ROWS, fitted / FITTED_ROWS)))))


def neighbours_of(distinct: DataFrame, asked: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> dict[tuple[int, int], np.ndarray]:
    """The true neighbours of a few vectors among all of their length: ``(width, number)`` to a matrix.

    ``asked`` has ids and unit vectors by width; each task hands on the best it saw.
    """
    known = distinct.sparkSession.sparkContext.broadcast(asked)

    def best(batches):
        kept: dict[tuple[int, int], list] = {}
        for b in batches:
            rep = np.asarray(b.column("rep"))
            for w, rows, x in Lists(b.column("v")).by_width():
                if w not in known.value:
                    continue
                ids, q = known.value[w]
                scores = q @ _unit(x).T
                scores[ids[:, None] == rep[rows][None, :]] = -np.inf
                m = min(k, len(rows))
                for i, at in enumerate(np.argpartition(-scores, m - 1, axis=1)[:, :m]):
                    own = kept.setdefault((w, i), []) + [(s, x[j]) for s, j in zip(scores[i, at].tolist(), at) if s > -np.inf]
                    kept[w, i] = sorted(own, key=lambda p: -p[0])[:k]
        flat = [(w, i, s, v) for (w, i), own in kept.items() for s, v in own]
        if flat:
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in flat]), pa.array([f[1] for f in flat]), pa.array([f[2] for f in flat]), pa.array([f[3] for f in flat], pa.list_(pa.float64()))], names=["w", "i", "s", "v"])

    nth = F.row_number().over(Window.partitionBy("w", "i").orderBy(F.desc("s")))
    got = distinct.select("rep", "v").mapInArrow(best, "w bigint, i bigint, s double, v array<double>").withColumn("n", nth).where(F.col("n") <= k)
    out: dict[tuple[int, int], list] = {}
    for r in got.collect():  # k rows for each vector asked
        out.setdefault((r["w"], r["i"]), []).append(r["v"])
    return {key: np.array(v) for key, v in out.items()}


def leaves_for(forest: Forest, q: np.ndarray, near: list[np.ndarray], recall: float) -> int:
    """The fewest leaves that hold the share ``recall`` of the neighbours ``near`` of the vectors ``q``."""
    places = []
    for x, own in zip(q, near):
        held: dict[tuple[int, int], list[int]] = {}
        for n, leaf in enumerate(forest.leaves_of(_unit(own))):
            for t, at in enumerate(leaf.tolist()):
                held.setdefault((t, at), []).append(n)
        first: dict[int, int] = {}
        for place, at in enumerate(forest.visit(x)):
            for n in held.get(at, ()):
                first.setdefault(n, place)
            if len(first) == len(own):
                break
        places += first.values()
    return int(np.quantile(places, recall, method="higher")) + 1 if places else forest.trees << forest.depth


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, trees: int = TREES, leaves: int | None = None, recall: float = RECALL, most_fitted: int = MOST_FITTED) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` of the ``k`` nearest found of each query row's vector, its own id left out.

    ``vectors`` and ``queries`` are ``(id, v)`` as ``usable`` gives them.  ``leaves`` is the number a query
    takes; without it, it is found for ``recall``.
    """
    spark = vectors.sparkSession
    result = "query_id bigint, rank int, vec_id bigint, score double"
    # Equal vectors: the k + 1 smallest ids suffice, as one of them may be the query's own.
    nth = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    distinct = cut(vectors.distinct().withColumn("nth", nth).where(F.col("nth") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("rep"), "ids", "v"))
    sizes = {r["w"]: r["n"] for r in distinct.groupBy(F.size("v").alias("w")).agg(F.count("*").alias("n")).collect()}  # one row a length
    if not sizes:
        return spark.createDataFrame([], result)
    most = min(most_fitted, max(1, MOST_NUMBERS // max(sizes)))
    fitted = distinct.select("rep", "v").orderBy(F.xxhash64("rep"), "rep").limit(most).toArrow()
    reps, samples = np.asarray(fitted.column("rep")), {w: (rows, _unit(x)) for w, rows, x in Lists(fitted.column("v")).by_width()}
    forests, taken, base, salts, first = {}, {}, {}, {}, 0
    for w, n in sorted(sizes.items()):
        sample = samples[w][1] if w in samples else np.zeros((0, w))
        forests[w] = fit(sample, trees, depth_of(n, len(sample)))
        taken[w] = min(leaves or forests[w].trees << forests[w].depth, forests[w].trees << forests[w].depth)
        base[w], salts[w] = first, max(1, -(-n // (SALT_ROWS << forests[w].depth)))
        first += forests[w].trees << forests[w].depth
    asked_of = {w: (reps[rows[:CALIBRATING]], x[:CALIBRATING]) for w, (rows, x) in samples.items() if forests[w].depth}
    if leaves is None and asked_of:
        near = neighbours_of(distinct, asked_of, k)
        for w, (_, x) in asked_of.items():
            taken[w] = leaves_for(forests[w], x, [near.get((w, i), np.zeros((0, w))) for i in range(len(x))], recall)
    known = spark.sparkContext.broadcast((forests, taken, base, salts))
    asked = queries.select("id", "v").distinct().groupBy("v").agg(F.min("id").alias("qid"))

    def met_at(b, key: str, at: list, group: list, salt: list, kind: int) -> pa.RecordBatch:
        at, group, salt = (np.concatenate(c) for c in (at, group, salt))
        return pa.RecordBatch.from_arrays([pa.array(group), pa.array(salt), pa.array(np.full(len(at), kind, dtype=np.int32)), b.column(key).take(pa.array(at)), b.column("v").take(pa.array(at))], names=["leaf", "salt", "kind", "id", "v"])

    def placed(batches):
        forests, _, base, salts = known.value
        for b in (b for b in batches if b.num_rows):
            at, group, salt, rep = [], [], [], np.asarray(b.column("rep"))
            for w, rows, x in Lists(b.column("v")).by_width():
                leaf, own = forests[w].leaves_of(_unit(x)), forests[w]
                group.append((leaf + np.arange(own.trees) * 2**own.depth + base[w]).ravel())
                at.append(np.repeat(rows, own.trees))
                salt.append(np.abs(rep[at[-1]]) % salts[w])
            yield met_at(b, "rep", at, group, salt, 1)

    def visited(batches):
        forests, taken, base, salts = known.value
        for b in (b for b in batches if b.num_rows):
            at, group, salt = [], [], []
            for w, rows, x in Lists(b.column("v")).by_width():
                if w not in forests:
                    continue
                own, n = forests[w], salts[w]
                for i, q in zip(rows.tolist(), _unit(x)):
                    got = np.array([t * 2**own.depth + leaf for (t, leaf), _ in zip(own.visit(q), range(taken[w]))]) + base[w]
                    at.append(np.full(len(got) * n, i))
                    group.append(np.repeat(got, n))
                    salt.append(np.tile(np.arange(n), len(got)))
            if at:
                yield met_at(b, "qid", at, group, salt, 0)

    placed_schema = "leaf bigint, salt bigint, kind int, id bigint, v array<double>"
    met = distinct.select("rep", "v").mapInArrow(placed, placed_schema).union(asked.mapInArrow(visited, placed_schema))

    def ranked(tables: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
        for t in tables:
            t = t.combine_chunks()
            leaf, salt, kind, ids = (np.asarray(t.column(c)) for c in ("leaf", "salt", "kind", "id"))
            lists, cuts = Lists(t.column("v")), starts_of(leaf, salt)
            q, v, s = ([np.zeros(0, dtype=d)] for d in (np.int64, np.int64, np.float64))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                split = a + int(np.searchsorted(kind[a:b], 1))
                m = min(k + 1, b - split)
                if split == a or not m:
                    continue
                x = _unit(lists.matrix(split, b))
                for c in range(a, split, 256):
                    scores = _unit(lists.matrix(c, min(c + 256, split))) @ x.T
                    least = np.partition(scores, scores.shape[1] - m, axis=1)[:, -m]
                    i, j = np.nonzero(scores >= least[:, None] - 1e-9)
                    q.append(ids[c + i])
                    v.append(ids[split + j])
                    s.append(scores[i, j])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(y)) for y in (q, v, s)], names=["qid", "rep", "s"])

    near = sorted_groups(met, ["leaf", "salt"], ["kind"], ranked, "qid bigint, rep bigint, s double").groupBy("qid", "rep").agg(F.max("s").alias("s"))
    # Of a query's bests over its leaves, those that rounding can't put behind the (k + 1)th.
    own = Window.partitionBy("qid")
    near = near.withColumn("n", F.row_number().over(own.orderBy(F.desc("s")))).withColumn("least", F.max(F.when(F.col("n") == k + 1, F.col("s"))).over(own)).where("least is null or s >= least - 1e-9")
    dot = F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    exact = (
        near.select("qid", "rep").join(asked.select("qid", F.col("v").alias("a")), "qid").join(distinct.select("rep", "ids", F.col("v").alias("b")), "rep")
        .select("qid", "ids", (dot / (norm("a") * norm("b"))).alias("score")).select("qid", F.explode("ids").alias("vec_id"), "score")
    )
    best = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))
    # One more than asked for, as the query's own id is among them.
    best = exact.withColumn("n", best).where(F.col("n") <= k + 1).select("qid", "vec_id", "score")
    each = queries.select("id", "v").distinct().join(asked, "v").select(F.col("id").alias("query_id"), "qid").join(best, "qid").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every fiftieth vector."""
    vectors = cut(usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"))
    return search(vectors, vectors.where("id % 50 = 0"))


QUERIES = {"op10_ann": op10_ann}
ORACLE_SQL: dict[str, str] = {}
