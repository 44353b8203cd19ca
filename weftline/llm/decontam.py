"""Benchmark decontamination through a distributed positional inverted index.

The training texts are indexed shard by shard: a shard is a few megabytes of documents laid
end to end as one sequence of word positions, and its posting list for a term holds the positions
where the term stands.  The index holds every word of every text, is stored once in the shared
folder and serves any benchmark.  To look up a window of benchmark words, the lists of its terms
are intersected from the rarest in the corpus to the commonest, each moved by the term's offset;
what is left are the exact occurrences.  With ``slop`` over zero, windows also match where the
terms stand in order with at most that many foreign words between them (proximity).  Nothing is
shuffled but term counts and the matched documents' short rows.  A term is known by 64 bits of its hash.

The benchmark is taken in blocks of a bounded number of words (``ITEM_WORDS``), each of which
is what the driver holds and broadcasts at a time; the hits of a block are written to the shared
folder before the next, and then merged by the rows' numbers, which the stored index holds.  A
longer item is parted at windows.

Edge cases: null and empty texts have no words; very long texts are a shard of their own; an item
of fewer words than a window is one window; items without words never match; repeated rows are
each reported; item ids that repeat are one id; a null item_id matches but is not named; terms
equally rare are taken in the window's order; without items nothing is hit, and without documents
there are no rows; other columns are not read, and stay as they are where rows are filtered.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import blocks, cut, free_name, shared_dir, spread, string_views, table

#: Bytes of text in a shard.
SHARD = 4 << 20
#: Words of the benchmark looked up in one pass.
ITEM_WORDS = 1_000_000
#: Words in a window (given by the query).
WINDOW = 10

#: A-Z are lowered; digits, letters and all bytes of other characters are kept; the rest parts words.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


def term_id(word: bytes) -> int:
    import xxhash

    return int.from_bytes(xxhash.xxh3_64_digest(word), "little", signed=True)


class Lookup:
    """A block of benchmark items: terms, and the windows with the items that hold them."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]], window: int):
        number: dict[bytes, int] = {}
        of: dict[tuple[int, ...], set] = {}
        for item, words in items:
            if not words:
                continue
            ids = [number.setdefault(w, len(number)) for w in words]
            for a in range(max(1, len(ids) - window + 1)):
                of.setdefault(tuple(ids[a : a + window]), set()).add(item)
        terms = np.array([term_id(w) for w in number], dtype=np.int64)
        self.number = np.argsort(terms)
        self.terms = terms[self.number]
        self.windows = list(of)
        self.items = [sorted(x, key=lambda i: (i is None, i or 0)) for x in of.values()]

    def known(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of a shard's terms stand in the block, and their numbers there."""
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        has = np.flatnonzero(self.terms[at] == terms) if len(self.terms) else np.zeros(0, dtype=np.int64)
        return has, self.number[at[has]]

    def rank(self, frequency: np.ndarray) -> None:
        """Order each window's terms from the rarest in the corpus."""
        self.order = [sorted(range(len(w)), key=lambda k: (frequency[w[k]], k)) for w in self.windows]
        self.rarest = np.array([w[o[0]] for w, o in zip(self.windows, self.order)], dtype=np.int64)

    def find(self, lists: list[np.ndarray | None], slop: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``(window, starts, ends)`` of the occurrences in a shard, exact ones first."""
        has = np.array([x is not None for x in lists] or [False])
        for k in np.flatnonzero(has[self.rarest]).tolist() if len(self.windows) else ():
            w, order = self.windows[k], self.order[k]
            if any(lists[t] is None for t in w):
                continue
            at = lists[w[order[0]]] - order[0]
            for j in order[1:]:
                there = lists[w[j]]
                i = np.minimum(np.searchsorted(there, at + j), len(there) - 1)
                at = at[there[i] == at + j]
                if not len(at):
                    break
            if len(at):
                yield k, at, at + len(w)
            if slop:
                yield from self._near(k, w, order[0], lists, slop, set(at.tolist()))

    def _near(self, k, w, rare, lists, slop, exact):
        """In order around each position of the rarest term, with at most ``slop`` foreign words in all."""
        starts, ends = [], []
        for p in lists[w[rare]].tolist():
            end, ok = p, True
            for t in w[rare + 1 :]:
                i = int(np.searchsorted(lists[t], end + 1))
                if i == len(lists[t]) or lists[t][i] > end + 1 + slop:
                    ok = False
                    break
                end = int(lists[t][i])
            start = p
            for t in reversed(w[:rare]) if ok else ():
                i = int(np.searchsorted(lists[t], start)) - 1
                if i < 0 or lists[t][i] < start - 1 - slop:
                    ok = False
                    break
                start = int(lists[t][i])
            if ok and end + 1 - start <= len(w) + slop and start not in exact:
                starts.append(start)
                ends.append(end + 1)
        if starts:
            yield k, np.array(starts), np.array(ends)


def read_items(benchmark: DataFrame, window: int = WINDOW, most: int = ITEM_WORDS) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """Blocks of items of about ``most`` words; each row goes to the driver once, in turn.  The last may be empty."""
    block, n = [], 0
    for r in benchmark.select(F.col("item_id").cast("long"), "text").toLocalIterator():
        words = words_of((r["text"] or "").encode())
        for a in range(0, max(1, len(words) - window + 1), most):
            part = words[a : a + most + window - 1]
            if block and n + len(part) > most:
                yield block
                block, n = [], 0
            block.append((r["item_id"], part))
            n += len(part)
    yield block


_COLUMNS = ("rows", "ids", "firsts", "n_words", "terms", "sizes", "positions")
_SHARD = "rows array<bigint>, ids array<bigint>, firsts array<int>, n_words array<int>, terms array<bigint>, sizes array<int>, positions array<int>"


def index(docs: DataFrame) -> DataFrame:
    """Shards of the positional index of all words, one row each; stored, so that rows keep their numbers."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in blocks(whole, "text", SHARD):
                number: dict[bytes, int] = {}
                firsts, sizes, found, first = [], [], [], 0
                for text in string_views(b.column("text")):
                    got = words_of(text)
                    firsts.append(first)
                    sizes.append(len(got))
                    found.append(np.fromiter((number.setdefault(w, len(number)) for w in got), dtype=np.int32, count=len(got)))
                    first += len(got)
                t = np.concatenate(found)
                n = np.bincount(t, minlength=len(number)).astype(np.int32)
                terms = np.fromiter(map(term_id, number), dtype=np.int64, count=len(number))
                rows = [b.column("row_id"), b.column("doc_id"), pa.array(firsts, pa.int32()), pa.array(sizes, pa.int32()), pa.array(terms), pa.array(n), pa.array(np.argsort(t, kind="stable").astype(np.int32))]
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in rows], names=list(_COLUMNS))

    return cut(docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SHARD))


def _shards(batches, columns: tuple[str, ...] = _COLUMNS) -> Iterator[tuple]:
    for b in batches:
        for i in range(b.num_rows):
            yield tuple(b.column(c)[i].values if c in ("rows", "ids") else np.asarray(b.column(c)[i].values) for c in columns)


def _ranked(shards: DataFrame, lookup: Lookup) -> None:
    """Order the windows' terms by their frequency in the corpus; one row for each term of the block, whatever the corpus holds."""
    known = shards.sparkSession.sparkContext.broadcast(lookup)

    def run(batches):
        total = np.zeros(len(known.value.terms), dtype=np.int64)
        for terms, sizes in _shards(batches, ("terms", "sizes")):
            has, t = known.value.known(terms)
            total[t] += sizes[has]
        t = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(total[t])], names=["t", "n"])

    frequency = np.zeros(max(1, len(lookup.terms)), dtype=np.int64)
    for t, n in shards.select("terms", "sizes").mapInArrow(run, "t bigint, n bigint").groupBy("t").agg(F.sum("n")).collect():
        frequency[t] = n
    known.destroy()
    lookup.rank(frequency)


def _looked_up(shards: DataFrame, known, slop: int, detail: bool) -> DataFrame:
    def run(batches):
        of = known.value
        for row_ids, ids, firsts, n_words, terms, sizes, positions in _shards(batches):
            lists: list = [None] * len(of.terms)
            ends = np.cumsum(sizes)
            for i, t in zip(*(x.tolist() for x in of.known(terms))):
                lists[t] = positions[ends[i] - sizes[i] : ends[i]].astype(np.int64)
            hits: dict[int, list] = {}
            for k, starts, stops in of.find(lists, slop):
                doc = np.searchsorted(firsts, starts, side="right") - 1
                for d, a, b in zip(doc.tolist(), (starts - firsts[doc]).tolist(), (stops - firsts[doc]).tolist()):
                    if a >= 0 and b <= n_words[d]:
                        hits.setdefault(d, []).append((a, b, k))
            n = range(len(firsts))
            merged = [_merged([(a, b) for a, b, _ in hits.get(d, ())]) for d in n]
            items = [sorted({i for _, _, k in hits.get(d, ()) for i in of.items[k] if i is not None}) for d in n]
            found = [[{"item_id": i, "start": a, "end": b, "exact": b - a == len(of.windows[k])} for a, b, k in hits.get(d, ()) for i in of.items[k]] if detail else [] for d in n]
            columns = [row_ids, ids, pa.array(n_words.astype(np.int64)), pa.array(merged, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.int64())), pa.array(found, _FOUND)]
            yield pa.RecordBatch.from_arrays(columns, names=["row_id", "doc_id", "n_words", "hit", "items", "found"])

    return shards.mapInArrow(run, "row_id bigint, doc_id bigint, n_words bigint, hit array<bigint>, items array<bigint>, found array<struct<item_id:bigint,start:bigint,end:bigint,exact:boolean>>")


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 0, detail: bool = True, most: int = ITEM_WORDS) -> DataFrame:
    """One row a document: ``(row_id, doc_id, n_words, hit, items, found)``.

    ``hit`` holds the starts and ends of the runs of words covered by any match, in order; ``items``
    the ids of the items with a match; ``found`` (if ``detail``) the single matches as
    ``(item_id, start, end, exact)``; row_id tells repeated rows apart.
    """
    spark = docs.sparkSession
    shards, folder = index(docs), f"{shared_dir(spark)}/decontam-{uuid.uuid4().hex}"
    blocks_ = read_items(benchmark, window, most)
    block, n = next(blocks_), 0
    while block is not None:
        lookup, block = Lookup(block, window), next(blocks_, None)
        _ranked(shards, lookup)
        known = spark.sparkContext.broadcast(lookup)
        got = _looked_up(shards, known, slop, detail)
        if block is None and not n:
            return got
        got.where("size(hit) > 0").write.parquet(f"{folder}/block={n}")
        known.destroy()
        n += 1
    found = spark.read.schema(got.schema).parquet(folder).groupBy("row_id").agg(
        F.flatten(F.collect_list("hit")).alias("hit"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("found")).alias("found")
    )

    def run(batches):
        for b in batches:
            hit = [_merged(zip(h[::2], h[1::2])) for h in b.column("hit").to_pylist()]
            yield b.set_column(b.schema.get_field_index("hit"), pa.field("hit", pa.list_(pa.int64())), pa.array(hit, pa.list_(pa.int64())))

    merged = found.mapInArrow(run, found.schema)
    rows = shards.select(F.explode(F.arrays_zip(F.col("rows").alias("row_id"), F.col("ids").alias("doc_id"), "n_words")).alias("x")).select("x.row_id", "x.doc_id", F.col("x.n_words").cast("long").alias("n_words"))
    none = [F.coalesce(c, F.array().cast(got.schema[c].dataType)).alias(c) for c in ("hit", "items", "found")]
    return rows.join(merged, "row_id", "left").select("row_id", "doc_id", "n_words", *none)


_FOUND = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("exact", pa.bool_())]))


def _merged(spans: Iterable[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def digest(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Counts and the items' digest of each document."""

    def run(batches):
        for b in batches:
            n_hit = [sum(h[1::2]) - sum(h[::2]) for h in b.column("hit").to_pylist()]
            names = [sorted(map(str, x)) for x in b.column("items").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("n_words"), pa.array(n_hit, pa.int64()), pa.array(map(len, names), pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names], pa.string()), pa.array([x > 0 for x in n_hit], pa.bool_())],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    found = matches(docs, benchmark, window, detail=False)
    return found.mapInArrow(run, "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean")


def uncontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows whose text holds no benchmark window, all columns as they were.

    Rows go by their text, known by 64 bits of its hash, whatever their ids.  Contaminated texts
    are few against the corpus; the anti-join lets Spark choose by their measured size.
    """
    said = free_name("_said", docs.columns)
    keyed = docs.select(F.xxhash64("text").alias("doc_id"), "text").where("text is not null")
    bad = matches(keyed, benchmark, window, detail=False).where("size(hit) > 0").select(F.col("doc_id").alias(said)).distinct()
    return docs.withColumn(said, F.xxhash64("text")).join(bad, said, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def op8_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    return digest(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


_SQL_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

QUERIES = {"op8_decontam": op8_decontam}
ORACLE_SQL = {
    "op8_decontam": f"""
WITH item AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, list_slice(w, i, i + {WINDOW - 1}) AS x FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - {WINDOW - 1}) + 1)) AS i FROM item WHERE len(w) > 0)),
size AS (SELECT DISTINCT len(x) AS n FROM win),
doc AS (SELECT row_number() OVER () AS r, doc_id, {_SQL_WORDS} AS w FROM documents),
place AS (SELECT r, n, i, list_slice(w, i, i + n - 1) AS x FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, size WHERE len(w) >= n)),
met AS (SELECT place.r, place.i, place.n, win.item_id FROM place JOIN win ON win.x = place.x),
hit AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS p FROM met) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM met WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (r) LEFT JOIN named USING (r)""",
}
