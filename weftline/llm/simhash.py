"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A text's fingerprint has a bit set where more than half of its word shingles' hashes have it.
Two fingerprints at most three bits apart agree in at least five of their eight positional
bytes.  Posting lists of single bytes would hold a 256th of the corpus each, so postings are
kept by four positional bytes at once: of the 14 quadruples of the Steiner system S(3,4,8)
every five positions contain one, so each such pair meets in at least one list, whatever bits
differ.  In a list the shared positional bytes of the pairs are tallied, pairs under five are
dropped, and the rest are verified by their differing bits.  In a long list the tally goes by a fifth
byte: its members are listed once more under each of the other positions, and members that meet
there share five.  Where such a list is long as well, verification looks up each member with up to
three flipped bits, of at most 24 that can differ, instead of comparing pairs, so that work is linear
in the members; the links are the same.  A list reports links enough to join its members (a
spanning forest), never all pairs, and equal fingerprints are one member.

Edge cases: null and empty texts have fingerprint zero and are linked like any other; very long
texts are read whole; fewer words than a shingle are one shingle; repeated rows and ids are all
kept; rows without doc_id take part, but cannot name a component unless all its rows lack one; of
equal ids in a group any names it; an empty table gives an empty result; other columns are not
read, and stay as they are where rows are filtered.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import blocks, connected_components, cut, free_name, joined, local_components, sorted_groups, spread, starts_of, string_views, table

BLOCK = 4 << 20
#: Words in a shingle, seed of the hash, and bits that may differ (given by the query).
SHINGLE, SEED, BITS = 3, 42, 3
#: Members of a list from which on they are listed by a fifth byte, and from which on flips are looked up.
LONG_LIST, LONG_FIFTH = 2_048, 8_192
#: Positional bytes that a pair within BITS shares at least.
LEAST_SHARED = 8 - BITS

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SET = np.array([[b >> k & 1 for k in range(8)] for b in range(256)], dtype=np.int64)


def quadruples() -> list[tuple[int, ...]]:
    """The 14 blocks: two halves of the positions, and pairs of pairs of equal matching."""
    matchings = [((0, 1), (2, 3)), ((0, 2), (1, 3)), ((0, 3), (1, 2))]
    mixed = [(*a, *(x + 4 for x in b)) for m in matchings for a in m for b in m]
    return [(0, 1, 2, 3), (4, 5, 6, 7), *mixed]


def fingerprint(text: bytes) -> int:
    """Fingerprint as a signed 64-bit integer."""
    import xxhash

    words = text.translate(_LOWER).split()
    n = len(words)
    if not n:
        return 0
    whole = b" ".join(words)
    if n <= SHINGLE:
        h = [xxhash.xxh64_intdigest(whole, SEED)]
    else:
        size = np.fromiter(map(len, words), dtype=np.int64, count=n) + 1
        end = np.cumsum(size) - 1
        start = end - size + 1
        digest = xxhash.xxh64_intdigest
        h = [digest(whole[a:b], SEED) for a, b in zip(start[: n - SHINGLE + 1].tolist(), end[SHINGLE - 1 :].tolist())]
    columns = np.array(h, dtype="<u8").view(np.uint8).reshape(-1, 8)
    out = 0
    for k in range(8):
        ones = np.bincount(columns[:, k], minlength=256) @ _SET
        for bit in np.flatnonzero(ones * 2 > len(h)).tolist():
            out |= 1 << 8 * k + bit
    return out - (1 << 64) if out >> 63 else out


def fingerprints(docs: DataFrame, *more: str) -> DataFrame:
    """``(doc_id, *more, fp)`` of each text."""
    rows = docs.select(F.col("doc_id").cast("long"), *more, "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in blocks(whole, "text", BLOCK):
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", *more)), pa.array([fingerprint(t) for t in string_views(b.column("text"))], pa.int64())], names=["doc_id", *more, "fp"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("doc_id", *more))
    return rows.mapInArrow(run, f"{kinds}, fp bigint")


def _mask(positions: tuple[int, ...]) -> int:
    m = sum(0xFF << 8 * p for p in positions)
    return m - (1 << 64) if m >> 63 else m


def _joined(tables: Iterator[pa.Table], bits: int) -> Iterator[pa.RecordBatch]:
    """Links that join the members of each posting list."""
    for t in tables:
        t = t.combine_chunks()
        slot, shared, fp = (np.asarray(t.column(c)) for c in ("slot", "shared", "fp"))
        cuts = starts_of(slot, shared)
        size = np.diff(cuts)
        pairs = cuts[:-1][size == 2]
        u, v = [fp[pairs][_close(fp[pairs], fp[pairs + 1], bits)]], [fp[pairs + 1][_close(fp[pairs], fp[pairs + 1], bits)]]
        for a, n in zip(cuts[:-1][size > 2].tolist(), size[size > 2].tolist()):
            x = fp[a : a + n]
            label = _forest(x, bits)
            linked = label != np.arange(n)
            u.append(x[linked])
            v.append(x[label[linked]])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], names=["u", "v"])


def _close(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Count filter on positional bytes, then the differing bits."""
    x = a ^ b
    tally = np.count_nonzero(x.view(np.uint8).reshape(*x.shape, 8) == 0, axis=-1)
    return (tally >= 8 - bits) & (np.bitwise_count(x.view(np.uint64)) <= bits)


def _forest(x: np.ndarray, bits: int) -> np.ndarray:
    """Smallest index of each member's component within one list, whose members share four bytes."""
    if len(x) <= LONG_LIST:
        return _by_pairs(x, bits)
    label, places = np.arange(len(x)), x.view(np.uint8).reshape(-1, 8)
    for p in range(8):
        order = np.argsort(places[:, p], kind="stable")  # members stay sorted under each byte
        cuts = starts_of(places[order, p])
        if len(cuts) == 2:
            continue  # one of the four bytes that all share
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            own = order[a:b]
            if b - a > 1:
                root = (_by_flips if b - a > LONG_FIFTH else _by_pairs)(x[own], bits)
                linked = root != np.arange(b - a)
                label = local_components(len(x), own[linked], own[root[linked]], label) if linked.any() else label
    return label


def _by_pairs(x: np.ndarray, bits: int, rows: int = 256) -> np.ndarray:
    """By comparing all pairs, some rows at a time."""
    label = np.arange(len(x))
    for a in range(0, len(x), rows):
        for b in range(0, a + rows, 8192):
            other = x[b : min(b + 8192, a + rows)]
            i, j = np.nonzero(_close(x[a : a + rows, None], other[None, :], bits))
            label = local_components(len(x), i + a, j + b, label)
    return label


def _by_flips(x: np.ndarray, bits: int) -> np.ndarray:
    """The same for sorted distinct members that share five bytes: at most 24 bits vary, 2,324 flips."""
    varying = int(np.bitwise_or.reduce(x ^ x[0])) & (1 << 64) - 1
    places = [k for k in range(64) if varying >> k & 1]
    label, every = np.arange(len(x)), np.arange(len(x))
    for n in range(1, bits + 1):
        for flipped in combinations(places, n):
            other = x ^ np.array(sum(1 << k for k in flipped), dtype=np.uint64).view(np.int64)
            at = np.minimum(np.searchsorted(x, other), len(x) - 1)
            hit = np.flatnonzero((x[at] == other) & (at < every))
            if len(hit):
                label = local_components(len(x), hit, at[hit], label)
    return label


def links(distinct: DataFrame, bits: int = BITS) -> DataFrame:
    """``(u, v)`` that join all of the distinct fingerprints ``fp`` within ``bits`` of each other."""
    if bits > 3:
        raise ValueError("the index of four positional bytes is complete for three bits at most")
    postings = F.explode(F.array(*(F.struct(F.lit(k).alias("slot"), F.col("fp").bitwiseAND(F.lit(_mask(q))).alias("shared")) for k, q in enumerate(quadruples()))))
    listed = distinct.select("fp", postings.alias("p")).select("p.slot", "p.shared", "fp")
    return sorted_groups(listed, ["slot", "shared"], ["fp"], lambda t: _joined(t, bits), "u bigint, v bigint")


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _rooted(prints: DataFrame, least, bits: int) -> DataFrame:
    """``(fp, least, n, root)``: the distinct fingerprints with the least of their rows and their number."""
    each = prints.groupBy("fp").agg(F.min(least).alias("least"), F.count("*").alias("n"))
    root = connected_components(links(each.select("fp"), bits)).withColumnRenamed("node", "fp")
    return cut(each.join(root, "fp", "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")))


def components(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """``(doc_id, fp, component_id)``; component_id is the smallest doc_id reachable."""
    prints = cut(prints)
    by_root = _rooted(prints, "doc_id", bits)
    rows, different = by_root.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    of_root = by_root.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    named = joined(by_root.select("fp", "n", "root"), of_root, "root", "members", different).select("fp", "n", "component_id")
    return joined(prints, named, "fp", "n", rows).select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """Of each component one row, all columns as they were: that of smallest doc_id.

    Rows without doc_id come last; of rows of one id, which may stand in different components, the
    one whose row hashes smallest is taken; of rows equal in all columns, one.
    """
    row = free_name("_row", docs.columns)
    hashable = [c for c, kind in docs.dtypes if not kind.startswith("map<")]
    nulls = F.concat(*(F.col(f"`{c}`").isNull().cast("string") for c in hashable))
    keyed = docs.withColumn(row, F.xxhash64(nulls, *(F.col(f"`{c}`") for c in hashable)))
    prints = cut(fingerprints(keyed, row))
    by_root = _rooted(prints, F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", row), bits)
    kept = by_root.groupBy("root").agg(F.min("least").alias("k")).select("k.doc_id", f"k.{row}")
    repeated = prints.groupBy("doc_id", row).count().where("count > 1")

    def taken(keys: DataFrame) -> DataFrame:
        own = F.col("own.doc_id").cast("long").eqNullSafe(F.col("keys.doc_id")) & (F.col(f"own.{row}") == F.col(f"keys.{row}"))
        return keyed.alias("own").join(keys.alias("keys"), own, "left_semi")

    if repeated.isEmpty():
        return taken(kept).drop(row)
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col(f"a.{row}") == F.col(f"b.{row}"))
    once, often = (kept.alias("a").join(repeated.alias("b"), same, how) for how in ("left_anti", "left_semi"))
    return taken(once).unionByName(taken(often).dropDuplicates(["doc_id", row])).drop(row)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    got = components(fingerprints(spread(table(spark, sf_dir, "documents"))))
    return got.select("doc_id", hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


QUERIES = {"op9_simhash": op9_simhash}
ORACLE_SQL: dict[str, str] = {}
