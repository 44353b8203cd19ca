"""Operators that relate texts or vectors to each other, against brute force on small fixtures."""

import collections
import hashlib
import os
import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from weftline.llm import ann, common, decontam, linededup, simhash

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def changed(r, s, n, letters="abc"):
    s = list(s)
    for _ in range(n):
        kind, i = r.randrange(3), r.randrange(len(s) + 1)
        if kind == 0:
            s.insert(i, r.choice(letters))
        elif s and kind == 1:
            s.pop(i % len(s))
        elif s:
            s[i % len(s)] = r.choice(letters)
    return "".join(s)


class Sets:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def test_connected_components(spark):
    r = random.Random(1)
    links = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(1000, 1000 + k) for k in range(300)] + [(2000 + k, 2001 + k) for k in range(150)] + [(5, 5)]
    sets = Sets()
    for a, b in links:
        if a != b:
            sets.join(a, b)
    got = {x.node: x.root for x in common.connected_components(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    assert got == {n: sets.find(n) for n in list(sets.up)}
    assert common.connected_components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_whole_groups_across_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        import pyarrow as pa

        def count(tables):
            for t in tables:
                k = np.asarray(t.column("k"))
                cuts = common.starts_of(k)
                yield pa.RecordBatch.from_arrays([pa.array(k[cuts[:-1]]), pa.array(np.diff(cuts))], names=["k", "n"])

        df = spark.range(500).select(F.when(F.col("id") < 60, F.lit(0)).otherwise(F.col("id") % 37).cast("long").alias("k"))
        got = sorted(tuple(r) for r in common.sorted_groups(df, ["k"], [], count, "k bigint, n bigint").collect())
        assert got == sorted(collections.Counter(r.k for r in df.collect()).items())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


# -- line dedup ------------------------------------------------------------------------------


def test_banded_distance():
    r = random.Random(3)
    for _ in range(8000):
        a = "".join(r.choice("ab") for _ in range(r.randrange(0, 14)))
        b = changed(r, a, r.randrange(0, 5))
        for k in (0, 1, 2, 3, 5):
            assert linededup.within(a, b, k) == (edits(a, b) <= k), (a, b, k)


@pytest.mark.parametrize("most", [1, 2, 3])
def test_no_link_is_missed_by_the_segments(most):
    r = random.Random(4)
    for _ in range(120):
        base = "".join(r.choice("abcdef ") for _ in range(r.randrange(36, 90)))
        lines = [x for x in {base, *[changed(r, base, r.randrange(1, most + 2), "abcdef ") for _ in range(6)]} if len(x) >= linededup.LEAST_CHARS]
        held, indexed = collections.defaultdict(set), collections.defaultdict(set)
        for role, rows, keys in linededup.entries(lines, most):
            for x, k in zip(rows.tolist(), keys.tolist()):
                held[k].add(x)
                if role == 0:
                    indexed[k].add(x)
        met = {frozenset((i, j)) for k in indexed for i in indexed[k] for j in held[k]}
        assert all(frozenset((i, j)) in met for i, j in combinations(range(len(lines)), 2) if edits(lines[i], lines[j]) <= most)


def test_links_of_a_large_list():
    r = random.Random(5)
    base = "the same long line of words with one place that changes "
    texts = list({base[:k] + r.choice("xyz") * r.randrange(1, 4) + base[k + 1 :] for k in range(30) for _ in range(4)})
    sets, own = Sets(), Sets()
    for i, j in combinations(range(len(texts)), 2):
        if edits(texts[i], texts[j]) <= 2:
            sets.join(i, j)
    pairs = linededup.linked(texts, 2)
    for i, j in pairs:
        own.join(i, j)
    assert len(pairs) < len(texts) and all(sets.find(i) == own.find(i) for i in range(len(texts)))


def expected_lines(rows, most=2):
    """Which lines stay, by brute force over all pairs of lines."""
    places = collections.defaultdict(list)
    texts = {(d, t) for d, t in rows if t is not None}
    for d, t in texts:
        for p, x in enumerate(t.split("\n") if t else []):
            x = x.strip()
            if len(x) >= linededup.LEAST_CHARS:
                places[x].append((d is None, d or 0, t, p))
    sets, lines = Sets(), list(places)
    for i, a in enumerate(lines):
        sets.find(i)
        for j in range(i):
            if abs(len(a) - len(lines[j])) <= most and edits(a, lines[j]) <= most:
                sets.join(i, j)
    classes = collections.defaultdict(list)
    for i, x in enumerate(lines):
        classes[sets.find(i)] += places[x]
    return classes


@pytest.mark.parametrize("part", [linededup.LIST, 3])
def test_line_dedup_equals_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(linededup, "LIST", part)
    r = random.Random(6)
    base = ["".join(r.choice("abcdefgh ") for _ in range(r.randrange(20, 70))) for _ in range(25)]
    rows = [(k, "\n".join(changed(r, r.choice(base), r.choice([0, 0, 1, 2, 3]), "abc") for _ in range(r.randrange(1, 6)))) for k in range(60)]
    rows += [(3, None), (70, ""), (71, "short\nshort\n"), (None, base[0] + "\n" + base[1]), (5, rows[5][1]), (90, "é" * 40 + "\n" + "é" * 41)]
    df = spark.createDataFrame([(d, t, "s", len(t or ""), 1) for d, t in rows], "doc_id bigint, text string, _doc string, n_chars bigint, _places int")
    got = linededup.deduplicated(df)
    assert got.schema == df.schema
    classes = expected_lines(rows)
    left = collections.Counter((x.doc_id, x.text) for x in got.collect())
    assert sum(left.values()) == len(rows)
    # Of each class exactly one place stays; which one is given by document and place where one text has an id.
    gone = collections.defaultdict(set)
    for places in classes.values():
        first = min(places, key=lambda q: (q[0], q[1]))
        same = [q for q in places if q[:2] == first[:2] and q[2] == first[2]]
        keep = min(same, key=lambda q: q[3])
        for q in places:
            if q != keep:
                gone[(None if q[0] else q[1], q[2])].add(q[3])
    want = collections.Counter((d, linededup.without(t, list(gone.get((d, t), ())))) for d, t in rows)
    assert left == want
    assert all(x.n_chars == len(x.text) for x in got.where("text is not null").collect())
    d = {x.doc_id: x for x in linededup.digest(df).where("doc_id = 70").collect()}
    assert d[70].n_lines == 0 and d[70].text_sha256 == hashlib.sha256(b"").hexdigest()
    first = {}
    for places in classes.values():
        keep = min(places, key=lambda q: (q[0], q[1]))
        for q in places:
            first[q] = (keep, min(x[3] for x in places if x[:3] == keep[:3]))
    for x in linededup.digest(df).where("doc_id between 10 and 60").collect():
        t = dict(rows)[x.doc_id]
        own = [f"{p}:{k[1]}:{at}" for p in sorted(gone.get((x.doc_id, t), ())) for k, at in [first[(False, x.doc_id, t, p)]]]
        assert x.n_removed == len(own) and x.classes_sha256 == hashlib.sha256("\n".join(own).encode()).hexdigest()
    assert linededup.deduplicated(df.limit(0)).count() == 0


def test_short_lines_take_part(spark):
    rows = [(1, "All rights reserved.\n\n-\nAA\nseven"), (2, "All rights reserved.\n\n-\nAB"), (3, "All right reserved\n \nAA"), (4, "sevens")]
    got = {x.doc_id: x.text for x in linededup.deduplicated(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: rows[0][1], 2: "\nAB", 3: " ", 4: ""}


def test_lists_are_found_across_batches():
    import pyarrow as pa

    r = random.Random(9)
    rows = sorted((r.randrange(12), r.randrange(2), r.randrange(6)) for _ in range(90))
    want = set()
    for k in range(12):
        lines = {x for key, _, x in rows if key == k}
        if len(lines) > 1 and any(key == k and role == 0 for key, role, _ in rows):
            want |= {(k, x) for x in lines}
    for size in (1, 2, 7, 90):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i : i + size])], names=["key", "role", "line"]) for i in range(0, 90, size)]
        got = [tuple(x.values()) for b in linededup._meeting(iter(batches)) for x in b.to_pylist()]
        assert {(k, x) for k, x, _ in got} == want
        for k in {k for k, _ in want}:
            places = sorted(at for key, _, at in got if key == k)
            assert places == list(range(len(places)))


@pytest.mark.parametrize("part", [linededup.LIST, 4])
def test_every_link_is_counted(spark, monkeypatch, part):
    monkeypatch.setattr(linededup, "LIST", part)
    monkeypatch.setattr(linededup, "PAIRS", 50)
    r = random.Random(8)
    base = ["".join(r.choice("abc ") for _ in range(n)) for n in (3, 4, 5, 9, 30, 31, 33, 60) for _ in range(3)]
    lines = [*{x.strip() for _ in range(220) for x in [changed(r, r.choice(base), r.randrange(4), "abc")] if len(x.strip()) >= linededup.LEAST_CHARS}, "AAAA AAAA", "AAAA AAAB", "AAAA AABB"]
    want, sets = collections.Counter(), Sets()
    for a, b in combinations(lines, 2):
        if edits(a, b) <= 2:
            want.update([a, b])
            sets.join(a, b)
    by_key = collections.defaultdict(set)
    for role, rows, keys in linededup.entries(lines):
        for x, k in zip(rows.tolist(), keys.tolist()):
            by_key[k].add(x)
    flat = [(k, x) for k, xs in by_key.items() for x in xs]
    ids = np.array([linededup.line_id(lines[x]) for _, x in flat])
    own = collections.Counter()
    for (_, x), n in zip(flat, linededup.link_counts(np.array([k for k, _ in flat]), ids, [lines[x] for _, x in flat], 2).tolist()):
        own[lines[x]] += n
    assert +own == +want
    docs = [(k, "\n".join(lines[k::40])) for k in range(40)]
    got = {(x.doc_id, c.place): (c["class"], c.links) for x in linededup.digest(spark.createDataFrame(docs, "doc_id bigint, text string")).collect() for c in x.classes if x.n_links == sum(c.links for c in x.classes)}
    at = {x: (k, p) for k, t in docs for p, x in enumerate(t.split("\n"))}
    assert {q: n for q, (_, n) in got.items()} == {at[x]: n for x, n in want.items()}
    for x, y in combinations(want, 2):
        assert (got[at[x]][0] == got[at[y]][0]) == (sets.find(x) == sets.find(y))


# -- simhash ---------------------------------------------------------------------------------


def print_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def test_quadruples_meet_every_five():
    blocks = [set(q) for q in simhash.quadruples()]
    assert len(blocks) == 14 and all(any(b <= set(five) for b in blocks) for five in combinations(range(8), 5))


def test_links_join_all_near_fingerprints(spark):
    r = random.Random(7)
    prints = set()
    for _ in range(30):
        x = r.getrandbits(64)
        prints |= {x ^ sum(1 << i for i in r.sample(range(64), r.randrange(0, 5))) for _ in range(12)}
    centre = r.getrandbits(64)
    prints |= {centre ^ sum(1 << i for i in r.sample(range(64), r.randrange(0, 7))) for _ in range(700)}
    prints = sorted(prints)
    sets = Sets()
    for a, b in combinations(prints, 2):
        if (a ^ b).bit_count() <= 3:
            sets.join(a, b)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    got = [(x.u & (1 << 64) - 1, x.v & (1 << 64) - 1) for x in simhash.links(spark.createDataFrame([(signed(p),) for p in prints], "fp bigint")).collect()]
    assert all((a ^ b).bit_count() <= 3 or sets.find(a) == sets.find(b) for a, b in got)
    own = Sets()
    for a, b in got:
        own.join(a, b)
    assert all(own.find(p) == sets.find(p) for p in prints)
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp bigint"), 4)


def test_flips_equal_pairs():
    r = np.random.default_rng(11)
    x = np.unique((np.int64(0x1234567800000000) | r.integers(0, 1 << 14, 900)) ^ np.int64(-(1 << 63)))
    assert np.array_equal(simhash._by_flips(x, 3), simhash._by_pairs(x, 3)) and np.array_equal(simhash._by_flips(x, 1), simhash._by_pairs(x, 1))


def test_long_lists_are_tallied_by_a_fifth_byte(monkeypatch):
    r = np.random.default_rng(13)
    centre = r.integers(0, 1 << 32, 40)
    x = np.unique(np.int64(0x55AA33CC00000000) | (r.choice(centre, 1500) ^ (1 << r.integers(0, 32, 1500)) ^ (1 << r.integers(0, 32, 1500))))
    want = simhash._by_pairs(x, 3)
    assert len(set(want.tolist())) < len(x) / 4
    for fifth in (4, 10**6):
        monkeypatch.setattr(simhash, "LONG_LIST", 3)
        monkeypatch.setattr(simhash, "LONG_FIFTH", fifth)
        assert np.array_equal(simhash._forest(x, 3), want)


def test_simhash_equals_brute_force(spark):
    r = random.Random(8)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa Lambda MU nu É ünï".split()
    base = [" ".join(r.choice(words) for _ in range(r.randrange(60, 200))) for _ in range(8)]
    rows = [(k, changed(r, r.choice(base), r.choice([0, 1, 1, 2]), "xyz")) for k in range(120)]
    rows += [(200, None), (201, ""), (202, " \n "), (203, "one"), (204, "one  two"), (205, "One\ttwo"), (206, "a b c"), (7, "again"), (7, "again"), (None, "one")]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id bigint, text string, _nth string, component_id int")
    got = simhash.components(simhash.fingerprints(df)).collect()
    assert len(got) == len(rows)
    assert collections.Counter((x.doc_id, x.fp & (1 << 64) - 1) for x in got) == collections.Counter((d, print_of(t)) for d, t in rows)
    sets, prints = Sets(), {print_of(t) for _, t in rows}
    for a, b in combinations(prints, 2):
        sets.find(a), sets.find(b)
        if (a ^ b).bit_count() <= 3:
            sets.join(a, b)
    least = {}
    for d, t in rows:
        if d is not None:
            c = sets.find(print_of(t))
            least[c] = min(least.get(c, d), d)
    assert all(x.component_id == least[sets.find(x.fp & (1 << 64) - 1)] for x in got)
    kept = simhash.one_of_each(df)
    assert kept.schema == df.schema and sorted((x.doc_id is None, x.doc_id or 0) for x in kept.collect()) == sorted((False, v) for v in least.values())
    assert simhash.components(simhash.fingerprints(df.limit(0))).count() == 0


def test_rows_are_told_apart_by_more_than_their_id(spark, monkeypatch):
    r = random.Random(14)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    text = [" ".join(word() for _ in range(80)) for _ in range(6)]
    rows = [(5, text[0], "a"), (5, text[1], "b"), (None, text[2], "c"), (None, text[3], "d"), (None, text[3], "d"), (9, text[4], "e"), (9, text[4], "f"), (10, text[4], "e"), (None, text[0], "g"), (11, text[5], None), (11, text[5], None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, _row string")
    kept = collections.Counter((x.doc_id, x.text) for x in simhash.one_of_each(df).collect())
    assert kept == collections.Counter([(5, text[0]), (5, text[1]), (None, text[2]), (None, text[3]), (9, text[4]), (11, text[5])])
    item = spark.createDataFrame([(1, " ".join(text[1].split()[10:30]))], "item_id bigint, text string")
    left = collections.Counter((x.doc_id, x.text) for x in decontam.uncontaminated(df, item).collect())
    assert left == collections.Counter((d, t) for d, t, _ in rows if t != text[1])


def test_heavy_keys_are_sent_to_their_rows(spark, monkeypatch):
    monkeypatch.setattr(common, "HEAVY_ROWS", 20)
    monkeypatch.setattr(common, "MANY_LINKS", 20)
    rows = spark.range(300).select(F.when(F.col("id") < 100, 7).otherwise(F.col("id")).alias("k"), "id")
    named = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("least")).where("k <> 8")
    got = common.joined(rows, named, "k", "n", 300)
    assert {(x.k, x.id, x.least) for x in got.collect()} == {(7 if i < 100 else i, i, 0 if i < 100 else i) for i in range(300)}
    r = random.Random(1)
    links = [(10_000, k) for k in range(200)] + [(300 + k, 301 + k) for k in range(100)] + [(r.randrange(500, 700), r.randrange(500, 700)) for _ in range(90)]
    sets = Sets()
    for a, b in links:
        if a != b:
            sets.join(a, b)
    assert {x.node: x.root for x in common.connected_components(spark.createDataFrame(links, "u bigint, v bigint")).collect()} == {n: sets.find(n) for n in list(sets.up)}


# -- decontamination -------------------------------------------------------------------------


def hits_of(docs, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    of = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        for a in range(max(1, len(w) - window + 1)) if w else ():
            of[tuple(w[a : a + window])].add(i)
    for d, t in docs:
        w, hit, named = words(t), set(), set()
        for n in {len(k) for k in of}:
            for a in range(len(w) - n + 1):
                if (k := tuple(w[a : a + n])) in of:
                    hit |= set(range(a, a + n))
                    named |= of[k]
        yield d, len(w), len(hit), len(named - {None}), hashlib.sha256(",".join(sorted(map(str, named - {None}))).encode()).hexdigest(), bool(hit)


def test_decontamination_equals_brute_force(spark):
    r = random.Random(9)
    pool = ["the", "of", "and", "Zebra", "quick7", "é", "b2", "x"]
    items = [(k, " ".join(r.choice(pool) for _ in range(r.choice([1, 3, 9, 10, 11, 25])))) for k in range(30)] + [(100, None), (101, "..."), (102, ""), (5, "the of the"), (None, "only nameless words here")]
    docs = [(k, " , ".join([" ".join(r.choice(pool) for _ in range(r.randrange(0, 60))), r.choice(items)[1] or "", "and-more"])) for k in range(80)]
    docs += [(200, None), (201, ""), (1, "the of the"), (1, "the of the"), (202, "ONLY nameless; words here"), (None, items[3][1])]
    d = spark.createDataFrame([(a, b, "z") for a, b in docs], "doc_id bigint, text string, items string")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    want = collections.Counter(hits_of(docs, items))
    for got in (decontam.digest(d, b), ):
        assert collections.Counter(tuple(x) for x in got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()) == want
    parts = decontam.matches(d, b, most=40, detail=False)  # some twenty blocks, and items longer than one
    assert len(list(decontam.read_items(b, 10, 40))) > 8 and len(list(decontam.read_items(b, 10, 12))) > 20
    assert collections.Counter((x.doc_id, x.n_words, sum(x.hit[1::2]) - sum(x.hit[::2]), len(x["items"])) for x in parts.collect()) == collections.Counter(w[:4] for w in want.elements())
    kept = decontam.uncontaminated(d, b)
    assert kept.schema == d.schema and sorted((x.doc_id is None, x.doc_id or 0) for x in kept.collect()) == sorted((w[0] is None, w[0] or 0) for w in want.elements() if not w[5])
    assert decontam.digest(d, b.limit(0)).where("contaminated").count() == 0 and decontam.digest(d.limit(0), b).count() == 0


def test_proximity(spark):
    d = spark.createDataFrame([(1, "zero one two extra three four five"), (2, "one two three four"), (3, "four three two one"), (4, "one x y z two three four")], "doc_id bigint, text string")
    b = spark.createDataFrame([(1, "one two three four")], "item_id bigint, text string")
    got = {x.doc_id: [(f.start, f.end, f.exact) for f in x.found] for x in decontam.matches(d, b, slop=1).collect()}
    assert got == {1: [(1, 6, False)], 2: [(0, 4, True)], 3: [], 4: []}


# -- nearest neighbours ----------------------------------------------------------------------


def nearest_of(rows, k=5, every=10):
    """By brute force over vectors of one length, in whole numbers: ``{query: [(id, score)]}``."""
    from fractions import Fraction

    good = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for i, v in sorted(good):
        if i % every:
            continue
        a, scored = [Fraction(x) for x in v], []
        for j, w in good:
            if j != i and len(w) == len(v):
                b = [Fraction(x) for x in w]
                dot, size = sum(x * y for x, y in zip(a, b)), sum(x * x for x in a) * sum(x * x for x in b)
                score = float(dot * dot / size) ** 0.5 * (1 if dot > 0 else -1)
                scored.append((-round(score, 9), j))
        out[i] = [(j, -s) for s, j in sorted(scored)[:k]]
    return out


def test_ann_on_odd_rows(spark):
    r = np.random.default_rng(10)
    rows = [(k, r.standard_normal(8).tolist()) for k in range(120)] + [(200 + k, [1.0] * 8) for k in range(40)]
    rows += [(300, None), (301, [0.0] * 8), (302, [float("nan")] * 8), (303, [1.0, None] * 4), (305, [float("inf")] * 8), (None, [1.0] * 8), (5, rows[5][1]), (306, [])]
    rows += [(400 + k, (r.standard_normal(8) * 1e-200).tolist()) for k in range(20)] + [(430 + k, (r.standard_normal(8) * 1e200).tolist()) for k in range(20)]
    rows += [(460, [5e-324] + [0.0] * 7), (461, [1.7e308, -1.7e308] * 4), (470, [-0.0, 1.0] * 4), (471, [0.0, 1.0] * 4)]
    rows += [(500 + k, r.standard_normal(3).tolist()) for k in range(45)] + [(600, [1.0, 2.0]), (610, [2.0, 1.0, 0.0, 0.0]), (611, [1.0, 1.0, 1.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id bigint, embedding array<double>, rank int")
    v = ann.usable(df, "vec_id", "embedding").cache()
    want = nearest_of(rows)
    for how in ({"leaves": 10**6}, {}):  # every leaf, and as many as are found to be needed: all, in tables of a few leaves
        by = collections.defaultdict(list)
        for x in ann.search(v, v.where("id % 10 = 0"), **how).orderBy("query_id", "rank").collect():
            by[x.query_id].append((x.vec_id, round(x.score, 9)))
            assert len(by[x.query_id]) == x["rank"]
        assert {q: [i for i, _ in n] for q, n in by.items()} == {q: [i for i, _ in n] for q, n in want.items() if n}
        assert all(abs(a - b) < 1e-8 for q in by for (_, a), (_, b) in zip(by[q], want[q]))
    few = v.where("id in (1, 2, 3)")
    assert ann.search(few, few).count() == 6
    assert ann.search(v.limit(0), v.limit(0)).count() == 0


def test_ann_takes_fewer_leaves_of_clustered_vectors(spark, monkeypatch):
    monkeypatch.setattr(ann, "LEAF_ROWS", 16)
    r = np.random.default_rng(12)
    centres = r.standard_normal((40, 16)) * 4
    m = np.concatenate([centres[r.integers(0, 40, 2000)] + r.standard_normal((2000, 16)) * 0.3])
    v = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(m)], "id bigint, v array<double>").cache()
    taken, shares = [], []
    monkeypatch.setattr(ann, "leaves_for", lambda f, *a, own=ann.leaves_for: taken.append(own(f, *a)) or shares.append(taken[-1] / (f.trees << f.depth)) or taken[-1])
    assert [ann.depth_of(n, 10**6) for n in (0, 15, 16, 32, 1600, 10**5)] == [0, 0, 0, 1, 6, 12] and ann.depth_of(10**9, 8 * 64) == 6
    found = 0
    got = collections.defaultdict(set)
    for x in ann.search(v, v.where("id % 20 = 0")).collect():
        got[x.query_id].add(x.vec_id)
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    for q in range(0, 2000, 20):
        s = m @ m[q]
        s[q] = -9
        found += len(set(np.argsort(-s)[:5].tolist()) & got[q])
    assert found / 500 >= 0.9 and shares[0] < 0.25


@needs_data
def test_ann_recall(spark):
    got = collections.defaultdict(set)
    for x in ann.op10_ann(spark, DATA).collect():
        got[x.query_id].add(x.vec_id)
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    ids, m = np.array([x.vec_id for x in rows]), np.array([x.embedding for x in rows], dtype=float)
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    found = total = 0
    for i in np.flatnonzero(ids % 50 == 0):
        s = m @ m[i]
        s[i] = -9
        top = set(ids[np.argsort(-s)[:5]].tolist())
        found, total = found + len(top & got[ids[i]]), total + 5
    assert found / total >= 0.9
