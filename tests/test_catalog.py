"""Every query against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from lexiloom.plans.catalog import QUERIES, SQL


@pytest.fixture(scope="module")
def duck(sf_dir="/root/testdata/sf0.001"):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def table(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(round(r[i], 5) if isinstance(r[i], float) else r[i] for i in order) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, sf, name):
    got, want = QUERIES[name](spark, sf), duck.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert table(got.collect(), got.columns) == table(want.fetchall(), want.columns)
    spark.catalog.clearCache()


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
    assert set(SQL) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_stream_of_lines(spark, tmp_path):
    from lexiloom.streaming.counts import streamed_triples

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("h\ta/NN/nsubj/2 eats/VB/ROOT/0 b/NN/dobj/2\t4\n")
    (tmp_path / "in/b.txt").write_text("h\ta/NN/nsubj/2 eats/VB/ROOT/0 b/NN/dobj/2\t5\n")
    q = streamed_triples(spark.readStream.option("maxFilesPerTrigger", 1).text(str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("streamed").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.slot, r.word, r.cnt) for r in spark.table("streamed").collect()} == {("X", "a", 9), ("Y", "b", 9)}
