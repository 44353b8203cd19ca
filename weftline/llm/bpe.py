"""Byte-level BPE encoding and decoding by corpus-level merge replay.

Texts are split into pre-tokens once.  Those of a block of texts are numbered by frequency, and the block is
stored in the shared folder as its texts' numbers and its distinct pre-tokens, both packed.  The
latter are dealt by pre-token over the cluster, so that each part of the corpus's vocabulary lies in
one place, with the blocks it stands in; there its words are laid out as one array of byte tokens.
An inverted index maps the rank of a token pair to the positions where the pair stands; merges are
taken from a queue in rank order, each applied to all of its positions at once, and only the pairs
next to a merged position are looked up anew.  The ids go back to the blocks as (number, ids),
where texts are put together from them.

Scale: what is shuffled is one row for each block and part of the vocabulary, twice, with some bytes
a word, and the packed numbers once.  No pre-token is in a block's row twice, so none is hot.  Memory
is that of a block's numbers and vocabulary, and of ``POSTINGS`` words where they are replayed;
a word that stands in more blocks of its part than fit into that is replayed once for each lot.

Edge cases: a null text is an empty text; an empty text has no tokens; one row in, one row
out, repeated rows included; an empty table gives none; other columns are not read; a text of any
length works: its pre-tokens are taken in runs.  Ranks are unique, so merges never tie; of places
of one pair that overlap, the left one is merged.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import blocks, shared_dir, sorted_groups, spread, starts_of, table, tidy

#: Bytes of text that share one numbering, and those split at a time.
BLOCK, PIECE = 32 << 20, 2 << 20
#: Pre-tokens of blocks replayed together.
POSTINGS = 500_000
#: Pre-tokens, or ids, of one text taken at a time, and numbers of texts in a row.
RUN, ROW = 1 << 18, 1 << 20
#: Of compression: what is stored and shuffled counts, time hardly.
LEVEL = 9


class Replay:
    """Encoder and decoder for a table of ranks (token bytes to rank)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.pattern = regex.compile(pattern)
        self.ranks = ranks
        top = max(ranks.values()) + 1
        self.token = [b""] * top
        for t, r in ranks.items():
            self.token[r] = t
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        pairs = {}
        for t, r in ranks.items():
            for k in range(1, len(t)):
                a, b = ranks.get(t[:k]), ranks.get(t[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = r
        self.pair_key = np.array(sorted(pairs), dtype=np.int64)
        self.pair_rank = np.array([pairs[k] for k in self.pair_key.tolist()], dtype=np.int64)
        # After a merge of one of these, a pair of lower rank may stand beside it: one position of a word at a time.
        a, b, r = self.pair_key >> 32, self.pair_key & 0xFFFFFFFF, self.pair_rank
        self.careful = np.zeros(top, dtype=bool)
        self.careful[a[r < a]] = True
        self.careful[b[r < b]] = True
        self.size = np.array([len(t) for t in self.token], dtype=np.int64)
        self.start = np.r_[0, np.cumsum(self.size)[:-1]]
        self.flat = np.frombuffer(b"".join(self.token), dtype=np.uint8)

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where the two do not merge."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[at] == key, self.pair_rank[at], -1)

    def replay(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        tok = self.byte[np.frombuffer(b"".join(words), dtype=np.uint8)]
        n = len(tok)
        word = np.repeat(np.arange(len(words)), size)
        ends = np.cumsum(size)
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        nxt[ends - 1] = -1
        prv[ends - size] = -1
        alive = np.ones(n, dtype=bool)
        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def put(at: np.ndarray) -> None:
            r = self.rank_of(tok[at], tok[nxt[at]])
            at, r = at[r >= 0], r[r >= 0]
            if not len(at):
                return
            order = np.argsort(r, kind="stable")
            at, r = at[order], r[order]
            cuts = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
            for rank, part in zip(r[cuts].tolist(), np.split(at, cuts[1:])):
                if rank in index:
                    index[rank].append(part)
                else:
                    index[rank] = [part]
                    heapq.heappush(queue, rank)

        put(np.flatnonzero(nxt >= 0))
        while queue:
            rank = heapq.heappop(queue)
            got = index.pop(rank)
            at = got[0] if len(got) == 1 else np.concatenate(got)
            at = at[alive[at] & (nxt[at] >= 0)]
            at = at[self.rank_of(tok[at], tok[nxt[at]]) == rank]
            if not len(at):
                continue
            at = np.unique(at)
            if len(at) > 1:
                if self.careful[rank]:
                    first = np.r_[True, word[at[1:]] != word[at[:-1]]]
                    if not first.all():
                        index[rank] = [at[~first]]
                        heapq.heappush(queue, rank)
                        at = at[first]
                else:  # of positions that overlap, every second one from the left
                    chained = np.r_[False, nxt[at[:-1]] == at[1:]]
                    if chained.any():
                        i = np.arange(len(at))
                        head = np.maximum.accumulate(np.where(chained, 0, i))
                        at = at[(i - head) % 2 == 0]
            gone = nxt[at]
            tok[at] = rank
            after = nxt[gone]
            nxt[at] = after
            alive[gone] = False
            has = after >= 0
            prv[after[has]] = at[has]
            before = prv[at]
            put(np.concatenate([before[before >= 0], at[has]]))
        left = np.flatnonzero(alive)
        count = np.bincount(word[left], minlength=len(words))
        packed = tok[left].astype("<u4").tobytes()
        stop = (np.cumsum(count) * 4).tolist()
        return [packed[a:b] for a, b in zip([0, *stop[:-1]], stop)]

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word; whole tokens need no replay."""
        out = [b"" if (r := self.ranks.get(w)) is None else r.to_bytes(4, "little") for w in words]
        hard = [i for i, x in enumerate(out) if not x and words[i]]
        for i, ids in zip(hard, self.replay([words[i] for i in hard]) if hard else ()):
            out[i] = ids
        return out

    def numbers(self, text: str, number: dict[str, int]) -> np.ndarray:
        """The numbers of a text's pre-tokens; new ones are numbered."""
        found, parts = (m.group() for m in self.pattern.finditer(text)) if len(text) > RUN else iter(self.pattern.findall(text)), []
        while part := list(islice(found, RUN)):
            parts.append(np.fromiter((number.setdefault(w, len(number)) for w in part), dtype=np.int32, count=len(part)))
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32)

    def encode_block(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text of a corpus that is at hand."""
        number: dict[str, int] = {}
        found = [self.numbers(t, number) for t in texts]
        ids = self.encode_words([w.encode() for w in number])
        size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        return [gathered(x, np.frombuffer(b"".join(ids), dtype="<u4"), np.cumsum(size) - size, size) for x in found]

    def decode(self, packed: bytes) -> bytes:
        """Bytes of packed ids."""
        out = []
        for a in range(0, len(packed), 4 * RUN):
            ids = np.frombuffer(packed[a : a + 4 * RUN], dtype="<u4")
            size = self.size[ids]
            total = int(size.sum())
            shift = self.start[ids] - (np.cumsum(size) - size)
            out.append(self.flat[np.arange(total) + np.repeat(shift, size)].tobytes())
        return b"".join(out)


def gathered(numbers: np.ndarray, flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> bytes:
    """The ids of numbered words one after the other, from where each begins and how many it has."""
    out = []
    for a in range(0, len(numbers), RUN):
        n = numbers[a : a + RUN]
        s = size[n]
        out.append(flat[np.arange(int(s.sum())) + np.repeat(start[n] - (np.cumsum(s) - s), s)].astype("<u4").tobytes())
    return b"".join(out)


def packed(numbers: np.ndarray) -> bytes:
    """Numbers by planes of their bytes, compressed."""
    return _squeezed(np.ascontiguousarray(numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes()) if len(numbers) else b""


def _squeezed(said: bytes) -> bytes:
    return pa.Codec("zstd", compression_level=LEVEL).compress(said, asbytes=True)


def unpacked(said: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, dtype=np.int64)
    planes = np.frombuffer(pa.decompress(said, decompressed_size=4 * n, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<i4").ravel().astype(np.int64)


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file of lines ``base64 rank``."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def replay_of(path: str, pattern: str) -> Replay:
    """One encoder a worker process."""
    return Replay(read_ranks(path), pattern)


_PACKED = "block bigint, part int, n int, numbers binary, sizes binary, said binary"
_NAMES = ["block", "part", "n", "numbers", "sizes", "said"]


def _row(block: int, part: int | None, n: int, numbers: bytes | None, sizes: bytes | None, said: bytes) -> tuple:
    return block, part, n, numbers, sizes, said


def _batch(rows: list[tuple], more: list[pa.Array] = (), names: list[str] = ()) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 6, kinds)), *more], names=[*_NAMES, *names])


def _words_of(block: int, raw: list[bytes], parts: int) -> tuple[list[tuple], bytes]:
    """A block's vocabulary, one row for each part of that of the corpus, and the words' numbers in the order of the rows."""
    part = np.fromiter(map(zlib.crc32, raw), dtype=np.int64, count=len(raw)) % parts
    order = np.argsort(part, kind="stable")
    cuts, out = starts_of(part[order]), []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        words = [raw[i] for i in order[a:b].tolist()]
        out.append(_row(block, int(part[order[a]]), b - a, None, packed(np.fromiter(map(len, words), dtype=np.int64, count=b - a)), _squeezed(b"".join(words))))
    return out, packed(np.diff(order, prepend=0))


def _texts_of(block: int, found: list[np.ndarray], numbers: bytes) -> Iterator[tuple[int, tuple]]:
    """Texts of a block, about ``ROW`` numbers a row: how many texts, and the row; the first has the words' numbers."""
    size = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    group = np.cumsum(size) // ROW
    cuts = starts_of(group)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        yield b - a, _row(block, None, b - a, None if a else numbers, packed(size[a:b]), packed(np.concatenate(found[a:b])))


def _numbered(docs: DataFrame, path: str, pattern: str, key: str, most: int, parts: int) -> DataFrame:
    """Blocks: rows of their distinct pre-tokens, by part, and rows without part of their texts' numbers, with the keys as ``of``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, number, seen, block = replay_of(path, pattern), {}, 0, TaskContext.get().partitionId() << 32
        found: list[np.ndarray] = []
        keys: list[pa.Array] = []

        def ended() -> Iterator[pa.RecordBatch]:
            count = np.zeros(len(number), dtype=np.int64)
            for a in range(0, len(found), 1000):
                count += np.bincount(np.concatenate(found[a : a + 1000]), minlength=len(number))
            order = np.argsort(-count, kind="stable")
            rank = np.empty(len(number), dtype=np.int32)
            rank[order] = np.arange(len(number))
            raw = list(number)
            rows, numbers = _words_of(block, [raw[i].encode() for i in order.tolist()], parts)
            yield _batch(rows, [pa.nulls(len(rows), pa.list_(keys[0].type))], ["of"])
            all_keys, at = pa.chunked_array(keys).combine_chunks(), 0
            for n, row in _texts_of(block, [rank[x] for x in found], numbers):
                yield _batch([row], [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), all_keys.slice(at, n))], ["of"])
                at += n

        for whole in batches:
            for b in blocks(whole, "text", PIECE):
                texts = [t or "" for t in b.column("text").to_pylist()]
                found += [r.numbers(t, number) for t in texts]
                keys.append(b.column(key))
                seen += sum(map(len, texts))
                if seen > most:
                    yield from ended()
                    number, seen, block = {}, 0, block + 1
                    found.clear()
                    keys.clear()
        if found:
            yield from ended()
        tidy()

    schema = f"{_PACKED}, of array<{docs.schema[key].dataType.simpleString()}>"
    folder = f"{shared_dir(docs.sparkSession)}/bpe-{uuid.uuid4().hex}"
    docs.select(key, "text").mapInArrow(run, schema).write.parquet(folder)
    return docs.sparkSession.read.schema(schema).parquet(folder)


def _replayed(path: str, pattern: str, postings: int):
    """Ids of words, which are all of their part of the vocabulary at once, or about ``postings`` of them."""

    def ids_of(rows: list[dict]) -> pa.RecordBatch:
        number: dict[bytes, int] = {}
        which, out = [], []
        for x in rows:
            size = unpacked(x["sizes"], x["n"])
            ends = np.cumsum(size).tolist()
            text = pa.decompress(x["said"], decompressed_size=ends[-1], codec="zstd", asbytes=True)
            which.append(np.fromiter((number.setdefault(text[a:b], len(number)) for a, b in zip([0, *ends[:-1]], ends)), dtype=np.int64, count=x["n"]))
        ids = replay_of(path, pattern).encode_words(list(number))
        size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        flat, start = np.frombuffer(b"".join(ids), dtype="<u4"), np.cumsum(size) - size
        for x, w in zip(rows, which):
            got = np.frombuffer(gathered(w, flat, start, size), dtype="<u4")
            out.append(_row(x["block"], x["part"], x["n"], None, packed(size[w]), packed(got)))
        return _batch(out)

    def run(batches):
        kept, n = [], 0
        for b in batches:
            for x in b.to_pylist():
                kept.append(x)
                n += x["n"]
                if n >= postings:
                    yield ids_of(kept)
                    kept, n = [], 0
        if kept:
            yield ids_of(kept)
        tidy()

    return run


def _encoded(docs: DataFrame, path: str, pattern: str, key: str, finish: Callable[[list[bytes]], list[pa.Array]], names: list[str], schema: str, block: int = BLOCK, postings: int = POSTINGS) -> DataFrame:
    """``(key, ...)`` of each text, where ``finish`` makes the other columns from packed ids."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stored, kind = _numbered(docs, path, pattern, key, block, 2 * n), docs.schema[key].dataType
    words = stored.where("part is not null").select(*_NAMES).repartition(n, "part")
    ids = words.mapInArrow(_replayed(path, pattern, postings), _PACKED).withColumn("of", F.lit(None).cast(stored.schema["of"].dataType))

    def run(tables: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
        for t in tables:
            t = t.combine_chunks()
            cuts = starts_of(np.asarray(t.column("block")))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                own = t.slice(a, b - a)
                is_text = own.column("part").is_null()
                text = own.filter(is_text).combine_chunks()
                numbers = next(x for x in text.column("numbers").to_pylist() if x is not None)
                flat, start, size = _table_of(own.filter(pa.compute.invert(is_text)).select(_NAMES).to_pylist(), numbers)
                for c, (many, said, n) in enumerate(zip(*(text.column(x).to_pylist() for x in ("sizes", "said", "n")))):
                    ends = np.cumsum(unpacked(many, n))
                    numbers = unpacked(said, int(ends[-1]))
                    cuts_ = np.r_[0, np.cumsum(size[numbers])][np.r_[0, ends]] * 4
                    ids = gathered(numbers, flat, start, size)
                    got = [ids[x:y] for x, y in zip(cuts_[:-1].tolist(), cuts_[1:].tolist())]
                    yield pa.RecordBatch.from_arrays([text.column("of").chunk(0).slice(c, 1).flatten(), *finish(got)], names=[key, *names])

    return sorted_groups(ids.union(stored.where("part is null")), ["block"], [], run, f"`{key}` {kind.simpleString()}, {schema}")


def _table_of(rows: list[dict], numbers: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ids of a block's words, and by number where each word's begin and how many there are."""
    rows = sorted(rows, key=lambda x: x["part"])
    own = np.cumsum(unpacked(numbers, sum(x["n"] for x in rows)))
    many = np.concatenate([np.zeros(0, dtype=np.int64), *(unpacked(x["sizes"], x["n"]) for x in rows)])
    start, size = np.empty(len(own), dtype=np.int64), np.empty(len(own), dtype=np.int64)
    start[own], size[own] = np.cumsum(many) - many, many
    each = np.cumsum(many)[np.cumsum([x["n"] for x in rows]) - 1] if rows else []
    flat = [unpacked(x["said"], n) for x, n in zip(rows, np.diff(each, prepend=0).tolist())]
    return np.concatenate([np.zeros(0, dtype=np.int64), *flat]).astype("<u4"), start, size


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", block: int = BLOCK, postings: int = POSTINGS) -> DataFrame:
    """``(key, ids array<int>)`` of each text, by blocks of about ``block`` characters."""

    def finish(ids: list[bytes]) -> list[pa.Array]:
        return [pa.array([np.frombuffer(x, dtype="<u4").astype(np.int32) for x in ids], pa.list_(pa.int32()))]

    return _encoded(docs, path, pattern, key, finish, ["ids"], "ids array<int>", block, postings)


def decode(encoded: DataFrame, path: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """``(key, text)`` from ``(key, ids)``; null ids give an empty text."""

    def run(batches):
        r = replay_of(path, pattern)
        for b in batches:
            text = [r.decode(np.asarray(x or [], dtype="<u4").tobytes()).decode("utf-8", "replace") for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(text, pa.string())], names=[key, "text"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(key, "ids").mapInArrow(run, f"`{key}` {kind}, text string")


def digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode each text, decode its ids again, and return counts and digests of both."""

    def finish(ids: list[bytes]) -> list[pa.Array]:
        r = replay_of(path, pattern)
        return [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()), pa.array([hashlib.sha256(r.decode(x)).hexdigest() for x in ids], pa.string())]

    return _encoded(docs, path, pattern, "doc_id", finish, ["n_tokens", "ids_sha256", "decoded_sha256"], "n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every document under the 50k byte-level vocabulary."""
    import public_tokenizers

    return digest(spread(table(spark, sf_dir, "documents")), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES = {"op2_bpe": op2_bpe}
ORACLE_SQL: dict[str, str] = {}
