from __future__ import annotations

import os

import pytest

import __spark_entry__
from marlstone.plans import queries as Q

DATA = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in Q.TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    fix = lambda v: round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted(repr([fix(r[k]) for k in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_same_rows_as_duckdb(spark, duck, name):
    got = Q.QUERIES[name](spark, DATA)
    want = duck.execute(Q.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(want.fetchall(), columns)


def same_as_duckdb(spark, folder, name, vectors):
    """The query on a table of these vectors, in the SQL's order."""
    table = spark.createDataFrame([(k, v, k % 3) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int")
    table.write.parquet(f"{folder}/embeddings.parquet")
    with duckdb.connect() as c:
        c.execute(f"create view embeddings as select * from '{folder}/embeddings.parquet/*.parquet'")
        want = c.execute(Q.ORACLE_SQL[name])
        columns = [d[0] for d in want.description]
        assert [tuple(r) for r in Q.QUERIES[name](spark, str(folder)).select(*columns).collect()] == want.fetchall()


def test_scores_equal_when_rounded_are_ties(spark, tmp_path):
    """Scores fall by less than 1e-5 from row to row, against the order of ids."""
    same_as_duckdb(spark, tmp_path, "cosine_topk", [[1.0, 0.0], *([1.0, 0.0001 * (41 - k)] for k in range(1, 41))])


def test_report_takes_rows_by_the_shown_score(spark, tmp_path):
    """Ranks among all rows, beyond 10; 1/32 is a half at four digits; scores under zero are compared as texts."""
    near = [[1.0, 0.0], *([1.0, 0.0001 * (41 - k)] for k in range(1, 41))]
    same_as_duckdb(spark, tmp_path / "near", "search_report", near)
    assert max(r["rank"] for r in Q.QUERIES["search_report"](spark, str(tmp_path / "near")).collect()) > 10
    halves = [[1.0, 0.0, 0.0, 0.0, 0.0], [1.0, 31.0, 7.0, 3.0, 2.0], [3.0, 31.0, 7.0, 2.0, 1.0], [5.0, 31.0, 1.0, 6.0, 1.0]]
    same_as_duckdb(spark, tmp_path / "halves", "search_report", halves + [[-x for x in v] for v in halves] + [[-1e-6, 1.0, 0.0, 0.0, 0.0]] + halves)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
