"""Every registered query against its SQL at the smallest scale, and streams against batches."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def canon(data, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(r[i] for i in order)) for r in data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = canon(df.collect(), df.columns)
    if name not in ORACLES:
        assert got
        return
    rel = con.execute(ORACLES[name])
    columns = [d[0] for d in rel.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == canon(rel.fetchall(), columns)


def test_stateful_stream_equals_batch(spark, rows):
    columns = ("video_id", "frame_idx", "cx", "cy", "interpolated")
    stream, batch = QUERIES["stateful_tracking"](spark, SF), QUERIES["kalman_ball"](spark, SF)
    assert rows(stream, *columns) == rows(batch, *columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
