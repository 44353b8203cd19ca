"""Every query with SQL gives the rows that DuckDB gives."""

import datetime
import math
import os

import duckdb
import pytest

from weftline.plans import catalog, record_queries, report

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = ordered(tuple(plain(r[c]) for c in columns) for r in df.collect())
    result = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert got == ordered(tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")
@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_has_rows(spark, name):
    assert catalog.queries()[name](spark, DATA).count() > 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")
def test_reports_analyse_every_image(spark, tmp_path):
    """Brands of 125 images each, more than a hosted model is shown."""
    os.symlink(f"{DATA}/documents.parquet", tmp_path / "documents.parquet")
    c = duckdb.connect()
    c.execute(f"COPY (SELECT vec_id + 500 * k AS vec_id, embedding, label FROM '{DATA}/embeddings.parquet', range(5) r(k)) TO '{tmp_path}/embeddings.parquet'")
    for t in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    df = catalog.queries()["report_counts"](spark, str(tmp_path))
    got, want = df.collect(), c.execute(catalog.oracle_sql()["report_counts"])
    names = [d[0] for d in want.description]
    assert {r.images_analysed for r in got} == {125}
    assert ordered(tuple(r[n] for n in names) for r in got) == ordered(want.fetchall())
    shown = report.build(*record_queries._report_inputs(spark, str(tmp_path)), most_images=100)
    assert {r.images_analysed for r in shown.select("images_analysed").collect()} == {100}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")
def test_near_vectors_of_one_hash_are_linked(spark, tmp_path):
    """Other vectors of the same signs, copies, few bits turned, none, short and odd ones: every link of vectors is told."""
    c = duckdb.connect()
    turned = "list_transform(embedding, lambda x, i: CASE WHEN i <= 2 * k THEN -x ELSE x END)"
    odd = "SELECT 9000 AS vec_id, CAST(NULL AS FLOAT[]) AS embedding UNION ALL SELECT 9001, [] UNION ALL SELECT 9002, [1, NULL] UNION ALL SELECT 9003, ['nan'::FLOAT, -1] UNION ALL SELECT 9003, ['inf'::FLOAT, 0]"
    c.execute(f"CREATE TABLE embeddings AS SELECT vec_id, CAST(embedding AS FLOAT[]) AS embedding FROM '{DATA}/embeddings.parquet' WHERE vec_id < 30")
    c.execute(f"INSERT INTO embeddings SELECT vec_id + 1000 * (k + 1), {turned} FROM embeddings, range(10) r(k) UNION ALL SELECT vec_id + 20000, list_transform(embedding, lambda x: x * 2) FROM embeddings UNION ALL {odd}")
    c.execute(f"COPY embeddings TO '{tmp_path}/embeddings.parquet'")
    got, want = catalog.queries()["phash_pairs"](spark, str(tmp_path)).collect(), c.execute(catalog.oracle_sql()["phash_pairs"])
    names = [d[0] for d in want.description]
    assert ordered(tuple(r[n] for n in names) for r in got) == ordered(want.fetchall())
    members, apart = [(r.a, r.vec_id) for r in got if r.a == r.b], {(r.a, r.b): r.bits for r in got if r.a != r.b}
    told = sorted((min(u, v), max(u, v), 0 if a == b else n) for i, (a, u) in enumerate(members) for b, v in members[:i] if (n := 0 if a == b else apart.get((min(a, b), max(a, b)))) is not None)
    hashed = [(v, sum((k < len(e or []) and e[k] is not None and (e[k] > 0 or math.isnan(e[k]))) << 62 - k for k in range(63))) for v, e in c.execute("SELECT vec_id, embedding FROM embeddings").fetchall()]
    every = sorted((min(u, v), max(u, v), n) for i, (u, a) in enumerate(hashed) for v, b in hashed[:i] if (n := (a ^ b).bit_count()) <= 14)
    assert told == every and sum(n == 0 for *_, n in every) > 60
