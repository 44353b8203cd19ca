"""The pipeline, stage by stage, against plain Python over the smallest tables."""

import hashlib
import os
import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from weftline.llm import linededup, toxicity

from test_pair_operators import Sets, edits, hits_of, print_of

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")


def lines_left(docs):
    """Texts by id after line dedup, over all pairs of lines that a count of characters lets through."""
    places = {}
    for d, t in sorted(docs.items()):
        for p, x in enumerate(map(str.strip, t.split("\n") if t else [])):
            if len(x) >= linededup.LEAST_CHARS:
                places.setdefault(x, []).append((d, p))
    lines, sets = list(places), Sets()
    kinds = np.stack([np.bincount(np.frombuffer(x.encode("utf-32-le"), dtype="<u4") % 64, minlength=64) for x in lines])
    for i, x in enumerate(lines):
        sets.find(i)
        for j in np.flatnonzero(np.abs(kinds[:i] - kinds[i]).sum(axis=1) <= 4).tolist():
            if edits(x, lines[j]) <= 2:
                sets.join(i, j)
    first = {}
    for i, x in enumerate(lines):
        c = sets.find(i)
        first[c] = min([*places[x], *([first[c]] if c in first else [])])
    keep = {(d, p) for d, p in first.values()}
    at = {x: i for i, x in enumerate(lines)}
    return {d: "\n".join(x for p, x in enumerate(t.split("\n")) if x.strip() not in at or (d, p) in keep) if t else t for d, t in docs.items()}


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "simhash_dedup", "decontamination", "bpe"]
    now = {r.doc_id: r.text for r in docs.collect()}
    frames = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        frames[name] = spark.read.parquet(str(tmp_path / name))
        if name != "bpe":
            assert frames[name].schema.names == docs.schema.names
            docs = frames[name]
    text = lambda n: {r.doc_id: r.text for r in frames[n].collect()}

    lexicon = toxicity.learn(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet"))
    now = {d: t for d, t in now.items() if lexicon.score(t) < 0.5}
    assert text("toxicity") == now
    labelled = {r.doc_id for r in spark.read.parquet(f"{DATA}/labels.parquet").where("toxic = 0").collect()}
    assert len(labelled & set(now)) >= 0.98 * len(labelled)

    now = lines_left(now)
    assert text("line_dedup") == now

    prints = {d: print_of(t) for d, t in now.items()}
    sets = Sets()
    for a in set(prints.values()):
        sets.find(a)
        for b in set(prints.values()):
            if a != b and (a ^ b).bit_count() <= 3:
                sets.join(a, b)
    least = {}
    for d, p in prints.items():
        least[sets.find(p)] = min(d, least.get(sets.find(p), d))
    now = {d: t for d, t in now.items() if d in set(least.values())}
    assert text("simhash_dedup") == now

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    bad = {h[0] for h in hits_of(list(now.items()), items) if h[5]}
    now = {d: t for d, t in now.items() if d not in bad}
    assert text("decontamination") == now

    want = {d: hashlib.sha256((t or "").encode()).hexdigest() for d, t in now.items()}
    assert {r.doc_id: r.decoded_sha256 for r in frames["bpe"].collect()} == want
    whole = {(r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, DATA).collect()}
    assert whole == {(r.doc_id, r.n_tokens, r.ids_sha256) for r in frames["bpe"].collect()}


BENCH = "\x00"  # stands for a passage of the benchmark


def odd_rows():
    """``(doc_id, text, names of the stages that drop the row)``; ids repeat on unrelated texts."""
    r = random.Random(31)
    fresh = lambda: " ".join("".join(r.choice("bcdfghjklm") + r.choice("aeiou") for _ in range(3)) for _ in range(60))
    text = [fresh() for _ in range(6)]
    return [
        (1, None, ""), (2, "", "simhash_dedup"), (2, "", "simhash_dedup"), (None, "x", ""), (5, text[0], ""), (5, text[1], ""), (5, f"{fresh()} {BENCH} {fresh()}", "decontamination"),
        (5, "you idiot, you stupid moron, pathetic worthless scum", "toxicity"), (11, text[2], ""), (None, text[2] + " ", "simhash_dedup"), (7, text[3], ""), (8, text[3], "simhash_dedup"), (9, text[4] + "\nabc", ""),
        (12, text[4] + "\nabd", "simhash_dedup"), (10, text[5] * 700, ""),
    ]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")
@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_empty_and_odd_tables(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    item = max((x.text or "" for x in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()), key=len)
    rows = [(d, t and t.replace(BENCH, item), gone) for d, t, gone in odd_rows()]
    df = spark.createDataFrame([(d, t, "en", "a", len(t or ""), None, "y") for d, t, _ in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, _row string, places string")
    assert stage(spark, df.limit(0), DATA).count() == 0
    got = stage(spark, df, DATA)
    if name == "bpe":
        want = Counter((d, hashlib.sha256((t or "").encode()).hexdigest()) for d, t, _ in rows)
        assert Counter((x.doc_id, x.decoded_sha256) for x in got.collect()) == want
        return
    assert got.schema == df.schema
    left = Counter((x.doc_id, x.text) for x in got.collect())
    if name == "line_dedup":  # all rows stay; lines are compared without the white space around them
        cut = lambda d, t: "" if (d, t) in {(8, rows[10][1]), (None, rows[9][1])} else t if d != 12 else ""
        assert sum(left.values()) == len(rows) and left == Counter((d, cut(d, t)) for d, t, _ in rows)
    else:
        assert left == Counter((d, t) for d, t, gone in rows if gone != name)
