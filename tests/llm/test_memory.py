"""What workers hold at once: batches and slices of bounded size, and one set of workers."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from lexiloom.llm import bpe, common, neardup

LONG = [T.StructField("held", T.LongType())]
BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"


def held(docs):
    """Of each row, how many bytes of text the batch has that it came in, and how many its slice."""
    return common.arrow_map(docs, ["id"], "text", lambda: lambda texts: [[texts.buffers()[2].size] * len(texts)], LONG)


def test_batches_are_bounded_in_bytes(spark):
    docs = spark.range(0, 6000, 1, 1).selectExpr("id", "repeat('word ', if(id = 50, 2000000, 600)) AS text")
    rows = {r.id: r.held for r in held(docs).collect()}
    assert len(rows) == 6000 and rows[50] >= 10_000_000  # one long text is whole
    assert max(v for i, v in rows.items() if abs(i - 50) > 2000) <= 8 << 20


def test_a_sessions_own_bound_stays(spark):
    own = spark.newSession()
    own.conf.set(BOUND, "123456")
    common.ship(own)
    assert own.conf.get(BOUND) == "123456"


def test_hashing_holds_little_besides_its_slice(monkeypatch):
    monkeypatch.setattr(common.Powers, "up", np.ones(1, np.uint64))
    monkeypatch.setattr(common.Powers, "down", np.ones(1, np.uint64))
    words = [f"{i * 7919 % 100_003:05d}" for i in range(100_000)]
    texts = pa.array([" ".join(words[i : i + 400]) for i in range(0, 100_000, 200)] * 3, pa.large_string())
    scan = neardup._scan(5)()
    tracemalloc.start()
    try:
        sizes = np.concatenate([scan(texts.slice(a, b - a))[0] for a, b in common.slices(texts)])
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(sizes) == len(texts) and sizes[:499].tolist() == [396] * 499
    assert peak < 48_000_000


def test_sampling_starts_no_workers_of_its_own(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id long, text string, lang string")

    def refuse(*_):
        raise AssertionError("rows pass through Python workers")

    monkeypatch.setattr(type(spark.sparkContext), "parallelize", refuse)
    assert sorted(common.sample_texts(docs, "lang", "text", "id", 5)) == [("a", "x"), ("b", "y")]


def test_a_frequent_key_outlives_a_full_memo(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 20)
    made = []
    memo = bpe.Memo(lambda key: made.append(key) or key)
    for i in range(100):
        assert memo[-1] == -1 and memo[i] == i and len(memo) + len(memo.old) <= 20
    assert made.count(-1) == 1
