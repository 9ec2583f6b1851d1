"""Shared pieces: Arrow text slices, vectorised word hashing, bounded samples, written tables."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

#: Bytes of text that a worker handles at once; a longer text is a slice of its own. What hashing holds is some 70 times as much.
SLICE_BYTES = 400_000
#: Bytes of a batch of rows on its way to or from a worker (a longer row is a batch of its own): the JVM and the worker each hold a few.
BATCH_BYTES = 4 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_BASE_INV = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))


def ship(spark: SparkSession) -> None:
    """Let Python workers on this host import the package when the driver got it through sys.path alone, and get batches of BATCH_BYTES.

    A bound on batches that the session has set itself stays.
    """
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(bound, None) is None:
        spark.conf.set(bound, str(BATCH_BYTES))
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    have = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in have:
        env["PYTHONPATH"] = os.pathsep.join([root, *have])


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Unset, it is a local one for a local master, which has no other hosts, and an error elsewhere."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return path or "file:///tmp/checkpoints"


_open: list[list[DataFrame]] = []


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, reread: lineage ends there, and a lost executor costs no recomputation."""
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/lexiloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lexiloom_path = path
    for tables in _open:
        tables.append(out)
    return out


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Tables that written() makes within; those still in the list at the end are deleted."""
    made: list[DataFrame] = []
    _open.append(made)
    try:
        yield made
    finally:
        _open.remove(made)
        for t in made:
            dropped(t)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table made by written() that nothing reads any more."""
    path = getattr(df, "_lexiloom_path", None)
    if path:
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def free_name(wanted: str, taken: Sequence[str]) -> str:
    """wanted, with underscores before it until no column (in any case) has that name."""
    low = {x.lower() for x in taken}
    while wanted.lower() in low:
        wanted = "_" + wanted
    return wanted


def col(name: str) -> Column:
    """The column of exactly that name, whatever signs it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def numbered(df: DataFrame, prefix: str = "column_") -> tuple[DataFrame, dict[str, str]]:
    """df with its columns renamed at once to prefix and a number, and old name -> new name: no own name can clash with them."""
    names = {c: f"{prefix}{i}" for i, c in enumerate(df.columns)}
    return df.select(*[col(c).alias(n) for c, n in names.items()]), names


def spread_join(big: DataFrame, side: DataFrame, on: str, spread: str, how: str = "inner", share: int = 10_000, least: int = 256) -> DataFrame:
    """big joined with side, whose rows are unique by column on, however many rows of big one value of it has.

    A value with more than `least` rows and more than 1/`share` of all is hot: there are at most `share` of those, so
    their list can be broadcast. Rows of big with a hot value are dealt over pieces by a hash of column spread, and the
    one row of side is copied to each piece. big is read twice and should be a written table.
    """
    n, piece, pieces = (free_name(x, [*big.columns, *side.columns]) for x in ("n_rows", "piece", "pieces"))
    counts = big.groupBy(on).agg(F.count(F.lit(1)).alias(n))
    total = counts.agg(F.sum(n).alias(piece))
    hot = counts.crossJoin(F.broadcast(total)).filter((F.col(n) > least) & (F.col(n) > F.col(piece) / share)).select(on, F.ceil(F.col(n) / F.greatest(F.lit(float(least)), F.col(piece) / share)).cast("int").alias(pieces))
    rows = big.join(F.broadcast(hot), on, "left").withColumn(piece, F.pmod(F.xxhash64(F.lit(5), spread), F.coalesce(pieces, F.lit(1))).cast("int")).drop(pieces)
    copies = side.join(F.broadcast(hot), on, "left").withColumn(piece, F.explode(F.sequence(F.lit(0), F.coalesce(pieces, F.lit(1)) - 1))).drop(pieces)
    return rows.join(copies, [on, piece], how).drop(piece)


def arrow_map(df: DataFrame, keep: Sequence[str], text: str, make: Callable[[], Callable[[pa.Array], list]], fields: list[T.StructField]) -> DataFrame:
    """Columns keep of df, with columns fields computed from the text column, slice by slice.

    make() runs once a task and returns a function from a LargeString array (nulls kept) to one array or list
    for each field. A field replaces a kept column of its name. No shuffle, memory bounded by SLICE_BYTES or
    the longest text.
    """
    ship(df.sparkSession)
    new = {f.name.lower() for f in fields}
    keep = [c for c in keep if c.lower() not in new]
    source = df.select(*[col(c).alias(f"kept_{i}") for i, c in enumerate(keep)], col(text).cast("string").alias("text"))
    schema = T.StructType([*source.schema.fields[:-1], *[T.StructField(f"made_{i}", f.dataType) for i, f in enumerate(fields)]])
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).cast(pa.large_string())
            for a, b in slices(texts):
                part = texts.slice(a, b - a)
                made = [x if isinstance(x, pa.Array) else pa.array(x) for x in fn(part)]
                made = [x if x.type == k else x.cast(k) for x, k in zip(made, kinds)]
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(a, b - a) for i in range(len(keep))], *made], names=schema.names)

    return source.mapInArrow(run, schema).select(*[F.col(n).alias(c) for n, c in zip(schema.names, [*keep, *[f.name for f in fields]])])


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    _, off = buffers(texts)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1)
        yield a, b
        a = b


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts together, and where each begins (one more than texts); a null has no bytes."""
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = texts.buffers()
    off = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.empty(0, np.uint8)
    return data, off - off[0]


class Powers:
    """Powers of the hash base and of its inverse, grown as needed."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> None:
        if len(cls.up) < n:
            n = max(n, SLICE_BYTES + 1)
            grow = np.ones(n, np.uint64)
            grow[1:] = _BASE
            cls.up = np.cumprod(grow)
            grow[1:] = _BASE_INV
            cls.down = np.cumprod(grow)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _GOLD)


def mask_of(separators: Sequence[int]) -> np.ndarray:
    out = np.ones(256, bool)
    out[list(separators)] = False
    return out


def word_bounds(data: np.ndarray, off: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end (exclusive) of each run of mask bytes; runs end with their text."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    m = mask[data]
    st, en = m.copy(), m.copy()
    st[1:] &= ~m[:-1]
    en[:-1] &= ~m[1:]
    cut = off[1:-1]
    inner = cut[(cut > 0) & (cut < n)]
    st[inner] = m[inner]
    en[inner - 1] = m[inner - 1]
    return np.flatnonzero(st), np.flatnonzero(en) + 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes, the same wherever it stands."""
    if not len(starts):
        return np.empty(0, np.uint64)
    Powers.to(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[data] * Powers.up[: len(data)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * Powers.down[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each n consecutive words (across texts too; the caller drops those)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out, c = np.zeros(m, np.uint64), np.uint64(1)
    with np.errstate(over="ignore"):
        for k in range(n):
            out += words[k : k + m] * c
            c = np.uint64((int(c) * int(_BASE)) & (2**64 - 1))
    return mix64(out)


def crc_mod(column: str, n: int):
    """crc32 of a doc_id as text, modulo n (null for null)."""
    return F.crc32(col(column).cast("string")) % n


def unit_hash(*columns):
    """A number in [0, 1) that depends on the columns alone."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(1 << 53))


def _rated(df: DataFrame, label: str, want: int, most_rows: int) -> tuple[DataFrame | None, int, int]:
    """A row a label with the rate (share of its rows whose hash to look at), the rows to take of each, and how many labels there are."""
    counts = df.groupBy(label).count().filter(col(label).isNotNull()).limit(most_rows + 1).collect()
    if len(counts) > most_rows:
        raise ValueError(f"more than {most_rows} labels: a row of each would not fit the sample")
    if not counts:
        return None, 0, 0
    want = max(1, min(want, most_rows // len(counts)))
    rows = [(r[0], min(1.0, (4 * want + 64) / r[1])) for r in counts]
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = T.StructType([T.StructField(label, df.schema[label].dataType), T.StructField("rate", T.DoubleType())])
    made = pa.table([[r[i] for r in rows] for i in range(2)], schema=to_arrow_schema(kinds))  # a list would start workers that are kept beside those of the operators
    return df.sparkSession.createDataFrame(made, kinds), want, len(counts)


def sample_ids(labels: DataFrame, doc_id: str, label: str, want: int, most_rows: int = 16_000) -> DataFrame:
    """About 2 * want distinct rows (id, label) of each label, those with the smallest hashes: the same ones on every run."""
    labels = labels.select(col(doc_id).alias("id"), col(label).alias("label"))
    rates, want, _ = _rated(labels, "label", want, most_rows)
    if rates is None:
        return labels.limit(0)
    chosen = labels.join(F.broadcast(rates), "label").filter(unit_hash(F.lit(29), "id") < F.col("rate")).select("id", "label").distinct()
    order = Window.partitionBy("label").orderBy(F.xxhash64(F.lit(29), "id"), "id")
    return chosen.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= 2 * want).drop("place")


def sample_texts(df: DataFrame, label: str, text: str, doc_id: str, want: int, *, most_rows: int = 16_000, most_bytes: int = 64 << 20) -> list[tuple]:
    """(text, label) of `want` distinct rows of each label, or of all there are, by the smallest hashes of (doc_id, text).

    The same rows on every run. The bounds are on what is fitted, and documented: want rows a label, most_rows rows, and
    most_bytes bytes of text in equal parts for the labels, past which rows are left out (but not a label's first). No
    label is left out. Null texts and labels take no part. Rows are looked at by a hash before any shuffle.
    """
    rows = df.select(col(label).alias("label"), col(text).cast("string").alias("body"), col(doc_id).cast("string").alias("id")).filter("label is not null and body is not null")
    rates, want, labels = _rated(rows, "label", want, most_rows)
    if rates is None:
        return []
    part = most_bytes // labels
    rows = rows.join(F.broadcast(rates), "label").withColumn("h", F.xxhash64(F.lit(31), "id", "body"))
    rows = rows.filter(F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53)) < F.col("rate"))
    rows = rows.groupBy("label", "h").agg(F.first("body").alias("body"))
    order = Window.partitionBy("label").orderBy("h")
    rows = rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= want)
    so_far = F.sum(F.octet_length("body")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("so_far", so_far).filter((F.col("so_far") <= part) | (F.col("place") == 1))
    return sorted((r[0], r[1]) for r in rows.select("body", "label").collect())


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, text: str, doc_id: str, want: int, **bounds) -> list[tuple]:
    """(text, label) of about `want` rows of docs for each label 0 and 1 of the table labels, by sample_ids and sample_texts."""
    ids = sample_ids(labels.filter(col(label).isin(0, 1)), doc_id, label, want)
    rows = docs.select(col(doc_id).alias("id"), col(text).cast("string").alias("body")).join(F.broadcast(ids), "id")
    return sample_texts(rows, "label", "body", "id", want, **bounds)
