"""Exact top-k search by inner product: tiled matrix products, partial selection per tile, tree-merged top lists.

Vectors become whole numbers, floor(1024 * x) of every component, so scores are exact and do not depend on the
order of work. Queries are broadcast, as many as `pass_bytes` hold with their lists, and met by one pass over all rows: a
task multiplies tiles of its rows with blocks of queries, selects the best of each query and tile (by a unique composite
of score and id order, so ties are exact), merges them into the query's list, and returns k rows a query. Lists are
merged in two rounds, first per query and group of partitions, then per query.

Defined cases: vectors that are null, or that hold null or non-finite components, take no part; a query meets only
vectors of its own length, however long; rows with the query's id are never its candidates; rows alike in id and score
count once; queries of one id with several vectors share one list; fewer than k candidates give fewer rows; products beyond 64 bits are held at the 64-bit limits; a null id
takes no part; an empty table, or no queries, gives an empty result. Extra columns, of any names, are not read.

Scale: vectors are not shuffled; only k rows a query and task are. The driver holds the queries of one pass at a time,
of `pass_bytes` bytes at most, never all of them at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .common import col, ship

SCALE = 1024
#: Components from here on are whole numbers.
LARGEST = 2.0**900
TILE = 2048
#: Queries that a tile of rows is multiplied with at once.
QUERIES = 512
WORST = np.iinfo(np.int64).min
GROUPS = 32
FOUND = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType()), T.StructField("part", T.IntegerType())])


def whole(ids: pa.Array, vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Valid vectors by length: their ids, and their components as floor(1024 x) in float64."""
    vectors = vectors.cast(pa.list_(pa.float64()))
    ok = np.ones(len(vectors), bool)
    if vectors.null_count:
        ok &= vectors.is_valid().to_numpy(zero_copy_only=False)
    if ids.null_count:
        ok &= ids.is_valid().to_numpy(zero_copy_only=False)
    off = vectors.offsets.to_numpy()
    values = vectors.values
    flat = values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    ok &= bad[off[1:]] == bad[off[:-1]]
    ids = ids.fill_null(0).to_numpy()
    out = {}
    lengths = np.diff(off)
    for n in np.unique(lengths[ok]).tolist():
        rows = np.flatnonzero(ok & (lengths == n))
        part = flat[off[:-1][rows][:, None] + np.arange(n)[None, :]]
        if np.abs(part).max(initial=0) < LARGEST:
            out[n] = (ids[rows], np.floor(part * SCALE))
        else:  # whole already, and 1024 times it may be no double
            out[n] = (ids[rows], np.array([int(v) * SCALE if abs(v) >= LARGEST else int(np.floor(v * SCALE)) for v in part.ravel().tolist()], object).reshape(part.shape))
    return out


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Rows of x times rows of q, exact, as int64."""
    if x.dtype != object and q.dtype != object and float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, x.shape[1]) < 2**53:
        return (x @ q.T).astype(np.int64)
    a, b = (np.array([[int(v) for v in r] for r in m], object).reshape(m.shape) for m in (x, q))
    return np.clip(a.dot(b.T), -(2**63), 2**63 - 1).astype(np.int64) if x.shape[1] else np.zeros((len(x), len(q)), np.int64)


class Lists:
    """The k best (score, id) of each query so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.score = np.full((len(ids), k), WORST, np.int64)  # best first, ties by smaller id; `have` of them are real
        self.id = np.full((len(ids), k), np.iinfo(np.int64).max, np.int64)
        self.have = np.zeros(len(ids), np.int64)

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        order = np.lexsort((*x.T[::-1], ids)) if x.dtype != object and x.shape[1] else np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        if len(ids) > 1:  # rows alike in id and vector are one
            new = np.ones(len(ids), bool)
            new[1:] = (ids[1:] != ids[:-1]) | (x[1:] != x[:-1]).any(1)
            ids, x = ids[new], x[new]
        for a in range(0, len(ids), TILE):
            for b in range(0, len(self.ids), QUERIES):
                self.tile(ids[a : a + TILE], x[a : a + TILE], slice(b, min(b + QUERIES, len(self.ids))))

    def tile(self, own: np.ndarray, x: np.ndarray, part: slice) -> None:
        """Partial selection of a tile for some queries: the rows of the k + 1 highest keys (score, smaller id) of each, all queries at once."""
        score, n, asked = products(x, self.vectors[part]), len(own), self.ids[part]
        top = min(n, self.k + 1)  # one more, as the query's own row may be among them
        if n > top and np.abs(score).max() < 2**62 // n and len(np.unique(own)) == n:
            key = score * n + np.arange(n - 1, -1, -1, dtype=np.int64)[:, None]
            at = np.argpartition(key, n - top, axis=0)[n - top :]
            self.merge(part, np.take_along_axis(score, at, 0).T, own[at].T, asked)
        else:
            self.merge(part, score.T, np.broadcast_to(own, (len(asked), n)), asked)

    def merge(self, part: slice, score: np.ndarray, ids: np.ndarray, asked: np.ndarray) -> None:
        k = self.k
        real = np.concatenate([np.arange(k) < self.have[part, None], ids != asked[:, None]], 1)
        score = np.concatenate([self.score[part], score], 1)
        ids = np.concatenate([self.id[part], ids], 1)
        order = np.lexsort((ids, ~score, ~real), axis=1)
        score, ids, real = (np.take_along_axis(m, order, 1) for m in (score, ids, real))
        real[:, 1:] &= (score[:, 1:] != score[:, :-1]) | (ids[:, 1:] != ids[:, :-1])
        order = np.argsort(~real, axis=1, kind="stable")[:, :k]
        self.score[part], self.id[part] = np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)
        self.have[part] = np.minimum(real.sum(1), k)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, id and score of all lists."""
        real = np.arange(self.k) < self.have[:, None]
        return np.repeat(self.ids, self.have), self.id[real], self.score[real]


def top_k(vectors: DataFrame, queries: DataFrame, *, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", pass_bytes: int = 32 << 20) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best rows of vectors; both tables have the same two columns."""
    spark = vectors.sparkSession
    ship(spark)
    source = vectors.select(col(vec_id).cast("long").alias("vec_id"), col(vector).cast("array<double>").alias("v"))
    asked = queries.select(col(vec_id).cast("long").alias("vec_id"), col(vector).cast("array<double>").alias("v")).filter("vec_id is not null and v is not null")
    found = None

    def one(rows: list) -> DataFrame:
        by = whole(pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.float64())))
        shared = spark.sparkContext.broadcast(by)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            lists = {n: Lists(ids, q, k) for n, (ids, q) in shared.value.items()}
            for b in batches:
                for n, (ids, x) in whole(b.column(0), b.column(1)).items():
                    if n in lists:
                        lists[n].add(ids, x)
            part = TaskContext.get().partitionId() % GROUPS
            for x in lists.values():
                query, ids, score = x.rows()
                if len(ids):
                    yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(ids), pa.array(score), pa.array(np.full(len(ids), part, np.int32))], names=FOUND.names)

        return source.mapInArrow(run, FOUND)

    rows, size = [], 0
    for r in asked.toLocalIterator():
        if rows and size + 8 * (len(r[1]) + 2 * k + 2) > pass_bytes:
            found, rows, size = (one(rows) if found is None else found.unionByName(one(rows))), [], 0
        rows.append(r)
        size += 8 * (len(r[1]) + 2 * k + 2)
    if rows or found is None:
        found = one(rows) if found is None else found.unionByName(one(rows))
    best = [F.desc("score"), F.asc("vec_id")]
    near = found.dropDuplicates(["query_id", "part", "vec_id", "score"])
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "part").orderBy(*best))).filter(f"r <= {k}").drop("r")
    near = near.select("query_id", "vec_id", "score").dropDuplicates()
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*best))).filter(f"rank <= {k}").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, vectors.filter("vec_id % 100 = 0"))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s
)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 10
"""
