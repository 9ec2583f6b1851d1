import math
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.llm import sharding, topk


def brute(rows, queries, k):
    ok = lambda v: v is not None and all(x is not None and np.isfinite(x) for x in v)
    whole = lambda v: [math.floor(1024 * Fraction(x)) for x in v]
    have = [(i, whole(v)) for i, v in rows if i is not None and ok(v)]
    out = set()
    for q, v in queries:
        if q is None or not ok(v):
            continue
        v = whole(v)
        found = {(-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), i) for i, w in have if i != q and len(w) == len(v)}
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(found)[:k])}
    return out


@pytest.mark.parametrize("size", [400, 1 << 25])
def test_topk_is_exact(spark, monkeypatch, size):
    monkeypatch.setattr(topk, "TILE", 40 if size == 400 else 2048)
    r = random.Random(2)
    rows = [(i, [r.choice([-1.0, 0.0, 0.5, r.gauss(0, 1)]) for _ in range(4)]) for i in range(120)]
    rows += [(200, None), (201, [1.0, None, 0.0, 1.0]), (202, [float("nan")] * 4), (203, [float("inf"), 0.0, 0.0, 0.0]), (204, [1.0]), (205, [2.0]), (206, []), (207, []), (None, [1.0] * 4), (208, [1e18] * 4), (209, [1e18] * 4), (210, [1.7e306, 1.0, 0.0, -1.0]), (211, [1.0, -1.0, 0.0, 0.5])]
    rows += [(212, [0.25, 0.5, 0.75, i / 8]) for i in range(30)]  # one id, many vectors
    rows += [(300 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(60)] + rows[:5]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("x")).withColumn("score", F.lit(None))
    asked = df.filter("vec_id % 10 = 0 or (vec_id > 199 and vec_id <> 212) or vec_id is null")
    want = brute(rows, [x for x in rows if x[0] is None or x[0] % 10 == 0 or x[0] > 199 and x[0] != 212], 10)
    got = topk.top_k(df, asked, pass_bytes=size).collect()
    assert {tuple(x) for x in got} == want and len(got) == len(want)


def test_topk_of_nothing(spark, sf):
    df = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert topk.top_k(df, df).count() == 0


def test_topk_query_matches_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    assert {tuple(r) for r in topk.query(spark, sf).collect()} == set(con.sql(topk.SQL).fetchall())


def test_curve_visits_every_cell_by_steps(spark):
    at = [F.shiftright("id", s).bitwiseAND(15) for s in (8, 4, 0)]
    rows = spark.range(4096).select("id", sharding.hilbert_index(*at).alias("h")).orderBy("h").collect()
    assert [r.h for r in rows] == list(range(4096))
    cells = [(r.id >> 8, r.id >> 4 & 15, r.id & 15) for r in rows]
    assert all(sum(abs(a - b) for a, b in zip(x, y)) == 1 for x, y in zip(cells, cells[1:]))


@pytest.mark.parametrize("n", [0, 1, 7, 40, 333])
def test_shards_are_even_and_gapless(spark, documents, n):
    docs = documents([f"text {'x' * (i % 50)}" if i % 4 else "same" for i in range(n)]) if n else spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    rows = sharding.shard(docs, shards=40).collect()
    assert len(rows) == docs.count()
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(40))
    if rows:
        sizes = [len(slots.get(s, ())) for s in range(40)]
        assert max(sizes) - min(sizes) <= 1
    text = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    for r in rows:
        if r.doc_id is not None:
            raw = (text[r.doc_id] or "").encode()
            assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "rows", None)


def test_sharding_query_matches_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    rows = sharding.query(spark, sf)
    want = con.sql(sharding.SQL)
    assert rows.columns == want.columns and sorted(map(tuple, rows.collect())) == sorted(want.fetchall())


@pytest.mark.parametrize("fetch", [1, 4096])
def test_quantiles_of_whole_strings(spark, monkeypatch, fetch):
    monkeypatch.setattr(sharding, "FETCH", fetch)
    r = random.Random(1)
    texts = ["", "a", "ab", "é", "\U0001f600x", *[f"https://example.org/data/set-{i}" for i in range(40)], *["https://example.org/" + "".join(r.choice("abc") for _ in range(9)) for _ in range(50)]]
    rows = [t for t in texts for _ in range(r.randrange(1, 9))] + ["https://example.org/data/set-7"] * 120
    ordered = sorted(rows, key=str.encode)
    df = spark.createDataFrame([(t,) for t in rows], "value string").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    ranks = [1, 2, len(rows), *[-(-len(rows) * k // 16) for k in range(1, 16)]]
    assert sharding.quantiles(df, ranks) == [ordered[i - 1] for i in ranks]


def test_sources_with_one_beginning_have_many_levels(spark):
    rows = [(i, "x", "en", f"https://host-{i % 64:02}.example.org") for i in range(640)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    held = defaultdict(set)
    for r in got.collect():
        held[r.shard].add(rows[r.doc_id][3])
    assert max(map(len, held.values())) <= 8  # of 64


def test_shards_hold_few_values(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = defaultdict(set)
    lang = {r.doc_id: r.lang for r in docs.collect()}
    for r in sharding.query(spark, sf).collect():
        held[r.shard].add(lang[r.doc_id])
    assert sum(map(len, held.values())) / len(held) < 2.5


def test_shards_are_native(spark, sf):
    plan = sharding.query(spark, sf)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_write_shards(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sharding.write_shards(docs, str(tmp_path / "out"), shards=8)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and set(Counter(r.shard for r in back.collect())) == set(range(8))
