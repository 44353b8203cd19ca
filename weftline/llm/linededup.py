"""Line dedup by a segment-partition edit join.

Two lines at most ``EDITS`` edits apart are one class, as are chains of such lines; of each class
the first line in order of document and place is kept, and the others are removed.  A line is
split into ``EDITS + 1`` even segments, one of which any line within the distance still holds
near its old place.  Segments are indexed under the line's length and their number; each line
probes the indexes of its own length and of the lengths down to ``EDITS`` below with those of its
substrings whose place allows a match.  Lines that meet in an index are verified by trimming
what both ends share and a banded bit-parallel edit distance.

Scale: index entries and probes are 16 bytes and are shuffled once, a line's once a task, however
often the line stands in it (``KNOWN`` lines are remembered at a time); entries that meet nothing
go at once.  Only lines that meet another are fetched again as text, known by a bit filter of
fixed size.  Equal lines are one line throughout.  Index lists are found in one sorted pass that
remembers a row; one of more than ``LIST`` lines is cut into parts of so many, and every two parts are
compared in a group of their own, so no task holds more than two parts of a list.  A group is walked
with histograms of characters before any pair is verified, pairs already in one class are
skipped, and it reports at most one link a line, which is enough for the classes.  Where links
are counted, every pair that meets is verified, once, in its group; only counts leave it.  Lines and
classes with very many members are sent to their rows.  A line is known by 64 bits of its hash.

Edge cases: lines are compared after trimming white space; those of fewer than ``LEAST_CHARS``
characters, which have no segments and are all within the distance of each other, are one class
only with their equals; empty lines always stay; null text stays null; empty texts
stay empty; very long texts and lines are taken whole; rows equal in doc_id and text are treated
alike, so that of a line that stands first in several such rows each keeps it; of lines at the same
place of texts of one id, that of the text of smaller hash is first; rows without doc_id come last
in order; an empty table gives an empty result.  All rows stay, in all other columns, whatever their
names, as they were; ``n_chars``, if there, is counted anew.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import blocks, connected_components, cut, forget, free_name, joined, sorted_groups, spread, starts_of, table

BLOCK = 1 << 20
EDITS = 2
#: Shorter lines can't be split into segments that all hold a character.
LEAST_CHARS = EDITS + 1
#: Bits of the filter that tells which lines are fetched.
FILTER_BITS = 1 << 25
#: Lines a task remembers as seen.
KNOWN = 1 << 19
#: Lines in a part of an index list.
LIST = 1 << 10
#: Pairs of lines taken at a time where links are counted, and the longest lines compared all at once.
PAIRS = 1 << 17
SHORT = 32
#: The side of all lines of a group that is one part.
NO_SIDE = -1

_P = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a constant and of its inverse modulo 2**64."""
    if len(_POWERS.get("p", ())) < n:
        size = max(n, BLOCK + 1)
        for name, x in (("p", _P), ("i", pow(_P, -1, 1 << 64))):
            v = np.full(size, x, dtype=np.uint64)
            v[0] = 1
            _POWERS[name] = np.cumprod(v)
    return _POWERS["p"][:n], _POWERS["i"][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def line_id(line: str) -> int:
    import xxhash

    return int.from_bytes(xxhash.xxh3_64_digest(line.encode()), "little", signed=True)


def split(text: str | None) -> list[str]:
    return text.split("\n") if text else []


def _segment(length: np.ndarray, i: int, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of the i-th (from 0) of ``edits + 1`` even segments."""
    base, more = np.divmod(length, edits + 1)
    first_long = edits + 1 - more
    return i * base + np.maximum(0, i - first_long), base + (i >= first_long)


def entries(lines: list[str], edits: int = EDITS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(role, line numbers, keys)``: role 0 are index entries, 1 are probes only."""
    for less, _, rows, keys in _keyed(lines, edits):
        yield int(less is not None), rows, keys


def _keyed(lines: list[str], edits: int) -> Iterator[tuple[int | None, int, np.ndarray, np.ndarray]]:
    """``(less, segment, line numbers, keys)``: probes of the index of lines ``less`` characters shorter; None are index entries."""
    size = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines))
    code = np.frombuffer("".join(lines).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    power, inverse = _powers(len(code) + 1)
    total = np.zeros(len(code) + 1, dtype=np.uint64)
    np.cumsum(_mix(code + np.uint64(1)) * power[:-1], out=total[1:])
    first = np.cumsum(size) - size

    def key(at: np.ndarray, n: np.ndarray, length: np.ndarray, i: int) -> np.ndarray:
        said = (total[at + n] - total[at]) * inverse[at]
        return _mix(said ^ _mix((length * 64 + i).astype(np.uint64))).view(np.int64)

    every = np.arange(len(lines))
    for i in range(edits + 1):
        at, n = _segment(size, i, edits)
        yield None, i, every, key(first + at, n, size, i)
    for less in range(edits + 1):
        length = size - less
        for i in range(edits + 1):
            at, n = _segment(length, i, edits)
            low, high = max(-i, less - (edits - i)), min(i, less + (edits - i))
            for shift in range(low, high + 1):
                if less == 0 and shift == 0:
                    continue  # its own index entry
                p = at + shift
                ok = np.flatnonzero((p >= 0) & (p + n <= size) & (length >= LEAST_CHARS))
                yield less, i, ok, key((first + p)[ok], n[ok], length[ok], i)


def within(a: str, b: str, k: int) -> bool:
    """Whether the edit distance is at most ``k``, by a bit-parallel band of 2k+1 diagonals."""
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > k:
        return False
    low, high = 0, len(a)
    while low < high:  # length of what both begin with, by halving
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    a, b = a[low:], b[low:]
    low, high = 0, len(a)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[len(a) - mid : len(a) - low] == b[len(b) - mid : len(b) - low] else (low, mid - 1)
    a, b = a[: len(a) - low], b[: len(b) - low]
    m, n = len(a), len(b)
    if not m:
        return n <= k
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    width = 2 * k + 1
    mask = (1 << width) - 1
    vp, vn, far = mask ^ ((1 << k) - 1), 0, min(k, m)
    for j in range(1, n + 1):
        x = at.get(b[j - 1], 0)
        x = (x >> j - k - 1 if j > k else x << k + 1 - j) & mask
        d0 = ((((x & vp) + vp) ^ vp) | x | vn) & mask
        hp, hn = (vn | ~(d0 | vp)) & mask, d0 & vp
        if j + k <= m:
            far += not d0 >> 2 * k & 1
            if far > 2 * k + n - m:
                return False
        else:
            t = m - j + k
            far += (hp >> t & 1) - (hn >> t & 1)
            if far - (n - j) > k:
                return False
        vp, vn = (hn | ~(d0 >> 1 | hp)) & mask, d0 >> 1 & hp
    return far <= k


def _fresh(batches: Iterable[pa.RecordBatch]) -> Iterator[dict[int, str]]:
    """The distinct lines that take part, block by block; those remembered from earlier blocks are left out."""
    seen: set[int] = set()
    for whole in batches:
        for b in blocks(whole, "text", BLOCK):
            found = {x for t in b.column("text").to_pylist() for x in map(str.strip, split(t)) if len(x) >= LEAST_CHARS}
            known = {i: x for x in found if (i := line_id(x)) not in seen}
            if len(seen) + len(known) > KNOWN:
                seen.clear()
            seen.update(known)
            if known:
                yield known


def _entered(edits: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for known in _fresh(batches):
            ids = np.fromiter(known, dtype=np.int64, count=len(known))
            for role, rows, keys in entries(list(known.values()), edits):
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(ids[rows]), pa.array(np.full(len(rows), role, dtype=np.int8))], names=["key", "line", "role"])

    return run


def _meeting(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries, sorted by key, role and line, whose key is held by two lines, one of them indexed, and their places in the list of the key.

    A line that is both indexed and probed under a key may come twice.  Of a list only the first line and the last row are remembered.
    """
    last, first, indexed, place = None, 0, False, 0
    for b in batches:
        if not b.num_rows:
            continue
        key, line, role = (np.asarray(b.column(c)) for c in ("key", "line", "role"))
        opens = np.r_[last is None or last[0] != key[0], key[1:] != key[:-1]]
        other = opens | np.r_[last is None or last[1] != line[0], line[1:] != line[:-1]]
        total, group, starts = np.cumsum(other), np.cumsum(opens), np.flatnonzero(opens)
        at = total - np.r_[-place, total[starts]][group]
        firsts, held = np.r_[first, line[starts]], np.r_[indexed, role[starts] == 0]
        kept = held[group] & other & (at > 0)
        second = kept & (at == 1)
        columns = np.r_[key[second], key[kept]], np.r_[firsts[group[second]], line[kept]], np.r_[np.zeros(second.sum(), dtype=np.int64), at[kept]]
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], names=["key", "line", "at"])
        last, first, indexed, place = (key[-1], line[-1]), firsts[group[-1]], held[group[-1]], at[-1]


def _in_parts(met: DataFrame) -> DataFrame:
    """``(key, line, side, parts)``: the part of its list that each entry is in, and the last part there is."""
    long = met.groupBy("key").agg(F.max("at").alias("last")).where(F.col("last") >= LIST)
    return met.join(long, "key", "left").selectExpr("key", "line", f"at div {LIST} as side", f"coalesce(last div {LIST}, 0L) as parts")


def _paired(rows: DataFrame) -> DataFrame:
    """Entries once for each part that theirs is compared with, its own among them; ``pair`` names the two."""
    each = rows.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), "parts")))
    return each.select("key", "line", "text", "side", (F.least("side", "part") * F.lit(1 << 32) + F.greatest("side", "part")).alias("pair"))


def _verified(edits: int, counted: bool):
    def run(tables: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
        for t in tables:
            t = t.combine_chunks()
            key, line, pair, side = (np.asarray(t.column(c)) for c in ("key", "line", "pair", "side"))
            side = np.where(pair >> 32 == pair & 0xFFFFFFFF, NO_SIDE, side)
            cuts = starts_of(key, pair)
            u, v = [], []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                ids, first = np.unique(line[a:b], return_index=True)
                if len(ids) > 1:
                    texts = t.column("text").take(pa.array(first + a)).to_pylist()
                    for i, j in linked(texts, edits, side[first + a]):
                        u.append(int(ids[i]))
                        v.append(int(ids[j]))
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array([0] * len(u), pa.int64())], names=["u", "v", "n"])
            if counted:
                n = link_counts(key, line, t.column("text").to_pylist(), edits, pair, side)
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(line[at]), pa.array(line[at]), pa.array(n[at])], names=["u", "v", "n"])

    return run


def linked(texts: list[str], edits: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs that join all texts within the distance of each other, if given only those of different sides; at most one less than there are."""
    n = len(texts)
    label = np.arange(n)
    side = np.full(n, NO_SIDE) if side is None else side
    size = np.fromiter(map(len, texts), dtype=np.int64, count=n)
    kinds = np.zeros((n, 32), dtype=np.int16)
    if n > 8:
        for i, t in enumerate(texts):
            code = np.frombuffer(t.encode("utf-32-le"), dtype="<u4")
            kinds[i] = np.minimum(np.bincount(code % 32, minlength=32), 30_000)
    out = []
    for i in range(1, n):
        near = (label[:i] != label[i]) & (np.abs(size[:i] - size[i]) <= edits) & ((side[:i] != side[i]) | (side[i] == NO_SIDE))
        if n > 8 and near.any():
            at = np.flatnonzero(near)
            near[at] = np.abs(kinds[at] - kinds[i]).sum(axis=1, dtype=np.int64) <= 2 * edits
        for j in np.flatnonzero(near).tolist():
            if label[j] != label[i] and within(texts[j], texts[i], edits):
                out.append((i, j))
                label[label == label[i]] = label[j]
    return out


def link_counts(key: np.ndarray, line: np.ndarray, texts: list[str], edits: int, pair: np.ndarray | None = None, side: np.ndarray | None = None) -> np.ndarray:
    """How many links each row has that are counted in its list, or in a pair of its parts, and there between its sides.

    Two lines may meet in several lists.  Their link is counted in that of the first segment of
    the shorter line (of equally long ones, that of smaller id) that the other holds near its
    place, so each link once; pairs are taken some at a time and none is handed on.
    """
    n = len(line)
    pair = np.zeros(n, dtype=np.int64) if pair is None else pair
    side = np.full(n, NO_SIDE) if side is None else side
    order = np.lexsort((line, pair, key))
    out, (key, line, pair, side) = np.zeros(n, dtype=np.int64), (x[order] for x in (key, line, pair, side))
    texts = [texts[i] for i in order]
    size = np.fromiter(map(len, texts), dtype=np.int64, count=n)
    own, probes = np.empty((edits + 1, n), dtype=np.int64), {}
    for less, i, rows, keys in _keyed(texts, edits):
        if less is None:
            own[i] = keys
        else:
            held, ok = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
            held[rows], ok[rows] = keys, True
            probes.setdefault((less, i), []).append((held, ok))
    short = np.zeros((n, SHORT), dtype=np.uint32)
    for i, x in enumerate(texts):
        if len(x) <= SHORT:
            short[i, : len(x)] = np.frombuffer(x.encode("utf-32-le"), dtype="<u4")
    cuts = starts_of(key, pair)
    before = np.arange(n) - np.repeat(cuts[:-1], np.diff(cuts))
    ends = np.cumsum(before)
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + PAIRS, side="right")))
        many = before[row:stop]
        b = np.repeat(np.arange(row, stop), many)
        a = np.arange(len(b)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(np.arange(row, stop) - many, many)
        row = stop
        kept = (np.abs(size[a] - size[b]) <= edits) & (line[a] != line[b]) & ((side[a] != side[b]) | (side[a] == NO_SIDE))
        a, b = a[kept], b[kept]
        swap = size[a] > size[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        here = _first_met(a, b, size, key, own, probes, edits)
        a, b = a[here], b[here]
        brief = size[b] <= SHORT
        near = np.zeros(len(a), dtype=bool)
        near[brief] = _within_short(short, size, a[brief], b[brief], edits)
        for i in np.flatnonzero(~brief).tolist():
            near[i] = within(texts[a[i]], texts[b[i]], edits)
        out += np.bincount(a[near], minlength=n) + np.bincount(b[near], minlength=n)
    back = np.empty(n, dtype=np.int64)
    back[order] = out
    return back


def _first_met(a, b, size, key, own, probes, edits: int) -> np.ndarray:
    """Whether the list is the one in which the pair of a shorter and a longer line is counted."""
    here, open_, less = np.zeros(len(a), dtype=bool), np.ones(len(a), dtype=bool), size[b] - size[a]
    for i in range(edits + 1):
        met = np.zeros(len(a), dtype=bool)
        for d in range(edits + 1):
            at = np.flatnonzero(open_ & (less == d))
            x, y = a[at], b[at]
            if d == 0:
                met[at] |= own[i][x] == own[i][y]
            for held, ok in probes.get((d, i), ()):
                met[at] |= ok[y] & (held[y] == own[i][x])
        here |= met & (own[i][a] == key[a])
        open_ &= ~met
    return here


def _within_short(code: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """Whether pairs of a shorter and a longer short line are within ``k`` edits: a band of 2k+1 diagonals, all pairs at once."""
    if not len(a):
        return np.zeros(0, dtype=bool)
    far, width, low = k + 1, 2 * k + 1, size[a]
    band = np.full((width, len(a)), far, dtype=np.int8)
    for d in range(k + 1):
        band[k + d] = d
    out = np.where(low == 0, np.minimum(far, size[b]), far)
    for i in range(1, int(low.max()) + 1):
        new = np.full_like(band, far)
        for d in range(width):
            j = i + d - k
            if j < 0 or j > code.shape[1]:
                continue
            best = np.full(len(a), i, dtype=np.int8) if j == 0 else band[d] + (code[a, i - 1] != code[b, j - 1])
            if d + 1 < width:
                best = np.minimum(best, band[d + 1] + 1)
            if d and j:
                best = np.minimum(best, new[d - 1] + 1)
            new[d] = np.minimum(best, far)
        band = new
        done = np.flatnonzero(low == i)
        out[done] = band[(size[b[done]] - i + k), done]
    return out <= k


def _bits(lines: DataFrame) -> np.ndarray:
    """Fixed-size bit filter of the line ids, joined word by word on the executors."""
    slot = F.expr(f"pmod(line, {FILTER_BITS})")
    words = (
        lines.select(slot.alias("slot")).selectExpr("cast(slot div 64 as int) as word", "shiftleft(1L, cast(slot % 64 as int)) as bit")
        .groupBy("word").agg(F.expr("bit_or(bit)").alias("bits")).toArrow()
    )
    out = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    out[np.asarray(words.column("word"))] = np.asarray(words.column("bits"))
    return out


def classes(docs: DataFrame, edits: int = EDITS, counted: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """``(node, root)`` of the lines, by id, that are within reach of a different line, and ``(node, links)``, if counted."""
    texts = docs.select("text").where("text is not null")
    entered = texts.mapInArrow(_entered(edits), "key bigint, line bigint, role byte")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = entered.repartition(n, "key").sortWithinPartitions("key", "role", "line").mapInArrow(_meeting, "key bigint, line bigint, at bigint")
    met = cut(lists.groupBy("key", "line").agg(F.min("at").alias("at")))
    known = docs.sparkSession.sparkContext.broadcast(_bits(met))

    def fetched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lines in _fresh(batches):
            ids = np.fromiter(lines, dtype=np.int64, count=len(lines))
            slot = ids % FILTER_BITS
            kept = np.flatnonzero(known.value[slot >> 6] >> (slot & 63) & 1)
            said = list(lines.values())
            yield pa.RecordBatch.from_arrays([pa.array(ids[kept]), pa.array([said[i] for i in kept], pa.string())], names=["line", "text"])

    lines = texts.mapInArrow(fetched, "line bigint, text string")
    once = lines.repartition(n, "line").sortWithinPartitions("line").mapInArrow(_first_of, "line bigint, text string")
    pairs = sorted_groups(_paired(_in_parts(met).join(once, "line")), ["key", "pair"], [], _verified(edits, counted), "u bigint, v bigint, n bigint")
    pairs = cut(pairs)
    forget(met)
    if not counted:
        return connected_components(pairs), None
    return connected_components(pairs), pairs.where("n > 0").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("links"))


def _first_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each line, of rows sorted by line."""
    last = None
    for b in batches:
        line = np.asarray(b.column("line"))
        first = starts_of(line)[:-1]
        if len(first) and line[0] == last:
            first = first[1:]
        last = line[-1] if len(line) else last
        yield b.take(pa.array(first))


def _occurrences(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in blocks(whole, "text", BLOCK):
            row, place, line = [], [], []
            for i, t in enumerate(b.column("text").to_pylist()):
                for p, x in enumerate(map(str.strip, split(t))):
                    if x:
                        row.append(i)
                        place.append(p)
                        line.append(line_id(x))
            row = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc").take(row), b.column("said").take(row), pa.array(place, pa.int32()), pa.array(line, pa.int64())], names=["doc", "said", "place", "line"])


def placed(docs: DataFrame, edits: int = EDITS, counted: bool = False) -> DataFrame:
    """``(doc, said, places)``: the lines of the text of hash ``said`` that go, each with the document and place of the line that stays for it.

    If counted, also those that stay and have others in their class, and all with their class
    and with the number of different lines within the distance.
    """
    roots, links = classes(docs, edits, counted)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("said"), "text").where("text is not null")
    occurrences = cut(keyed.mapInArrow(_occurrences, "doc bigint, said bigint, place int, line bigint"))
    place = F.struct(F.col("doc").isNull().alias("last"), "doc", "said", "place")
    by_line = occurrences.groupBy("line").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    with_class = by_line.join(roots, by_line["line"] == roots["node"], "left").select("line", "first", "n", F.coalesce("root", "line").alias("class"), F.col("root").isNotNull().alias("near"))
    several = with_class.where("n > 1 or near")
    if counted:
        several = several.join(links, several["line"] == links["node"], "left").drop("node").fillna(0, ["links"])
    several = cut(several)
    lines, rows = several.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    of_class = several.groupBy("class").agg(F.min("first").alias("kept"), F.count("*").alias("members"))
    more = ["class", "links"] if counted else []
    kept = joined(several, of_class, "class", "members", lines).select("line", "n", *more, F.col("kept.doc").alias("k_doc"), F.col("kept.said").alias("k_said"), F.col("kept.place").alias("k_place"))
    goes = ~(F.col("doc").eqNullSafe(F.col("k_doc")) & (F.col("said") == F.col("k_said")) & (F.col("place") == F.col("k_place")))
    met = joined(occurrences, kept, "line", "n", rows)
    each = F.struct("place", F.col("k_doc").alias("doc"), F.col("k_place").alias("first"), *([goes.alias("goes"), *more] if counted else []))
    return (met if counted else met.where(goes)).select("doc", "said", each.alias("p")).distinct().groupBy("doc", "said").agg(F.sort_array(F.collect_list("p")).alias("places"))


def without(text: str | None, places: list[int] | None) -> str | None:
    if text is None or not places:
        return text
    gone = set(places)
    return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)


def _rejoined(docs: DataFrame, gone: DataFrame, places: str) -> DataFrame:
    """Documents with the places of their lines that go, as a column of that name."""
    doc, said = (free_name(n, docs.columns) for n in ("_doc", "_said"))
    none = F.lit(-(1 << 62))  # ids that are null meet each other
    keyed = docs.withColumn(doc, F.coalesce(F.col("doc_id").cast("long"), none)).withColumn(said, F.xxhash64("text"))
    other = gone.select(F.coalesce("doc", none).alias(doc), F.col("said").alias(said), F.col("places").alias(places))
    return keyed.join(other, [doc, said], "left")


def deduplicated(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """All rows, their texts without the lines that go."""
    at, places = {c: i for i, c in enumerate(docs.columns)}, free_name("_places", docs.columns)

    def run(batches):
        for b in batches:
            text = pa.array([without(t, [x["place"] for x in p or ()]) for t, p in zip(b.column("text").to_pylist(), b.column(places).to_pylist())], pa.string())
            columns = [b.column(c) for c in at]
            columns[at["text"]] = text
            if "n_chars" in at:
                kind = columns[at["n_chars"]].type
                columns[at["n_chars"]] = pa.array([None if t is None else len(t) for t in text.to_pylist()], kind)
            yield pa.RecordBatch.from_arrays(columns, names=list(at))

    return _rejoined(docs, placed(docs, edits), places).select(*docs.columns, places).mapInArrow(run, docs.schema)


def digest(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """Counts, the digest of what is left of each document, and its lines' classes and links.

    ``classes_sha256`` is over ``place:document:place`` of each line that went and of the line that stays
    for it, in order, one a line (an unknown document is empty).  ``classes`` holds, in order, every line that
    isn't alone in its class: the class by its smallest line id, and the number of different lines
    within the distance, each of which is a link; ``n_links`` is their sum.
    """

    def run(batches):
        for b in batches:
            rows = []
            for t, p in zip(b.column("text").to_pylist(), b.column("_places").to_pylist()):
                gone = [x for x in p or () if x["goes"]]
                left = without(t, [x["place"] for x in gone]) or ""
                classes_of = "\n".join(f"{x['place']}:{'' if x['doc'] is None else x['doc']}:{x['first']}" for x in gone)
                shown = [{k: x[k] for k in ("place", "class", "links")} for x in p or ()]
                rows.append((len(split(t)), len(gone), len(left), hashlib.sha256(left.encode()).hexdigest(), hashlib.sha256(classes_of.encode()).hexdigest(), sum(x["links"] for x in shown), shown))
            columns = list(zip(*rows)) if rows else [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.struct([("place", pa.int32()), ("class", pa.int64()), ("links", pa.int64())]))]
            names = ["n_lines", "n_removed", "n_chars", "text_sha256", "classes_sha256", "n_links", "classes"]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, columns, kinds)], names=["doc_id", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    said = "n_lines bigint, n_removed bigint, n_chars bigint, text_sha256 string, classes_sha256 string, n_links bigint, classes array<struct<place: int, class: bigint, links: bigint>>"
    return _rejoined(docs.select("doc_id", "text"), placed(docs, edits, counted=True), "_places").select("doc_id", "text", "_places").mapInArrow(run, f"doc_id {kind}, {said}")


def op1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines left of every document."""
    return digest(spread(table(spark, sf_dir, "documents")))


QUERIES = {"op1_lines": op1_lines}
ORACLE_SQL: dict[str, str] = {}
