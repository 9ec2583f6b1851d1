"""Benchmark decontamination: a broadcast hash set of normalised item n-grams, scanned over every text's token windows.

Words: A-Z lower-cased, then maximal runs of 0-9, a-z and non-ASCII characters. A window is `window` consecutive
words of an item; an item with fewer words (but some) is one window. Each window hash that a text shares with the
set is verified byte by byte before it counts.

Defined cases: a null or word-less text has no words and no hits; a null or word-less item has no windows; a null
item id still makes hits but is not listed; equal item ids count once; repeated rows are scanned each for itself; a text
of any length is scanned whole; an empty benchmark leaves every text clean; an empty table gives an empty result. Extra
columns, of any names, pass through where asked for; a result column replaces one of its name.

Scale: documents are never shuffled for a benchmark of one chunk. Items are read one by one and broadcast in chunks of at
most `chunk_bytes` of UTF-8 text (or one longer item), as arrays: the normalised bytes, and a hash and two places for
each word, some 6 bytes for a byte of text. Each chunk is one pass; hits of several are merged by a digest of the
text, one row for each chunk and distinct text, and joined back with every digest dealt over SALTS tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F, types as T

from .common import LOWER, SLICE_BYTES, arrow_map, buffers, col, gram_hashes, mask_of, numbered, word_bounds, word_hashes

WORD = mask_of([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
BITS = 22
#: Tasks that the rows of one text are dealt over where hits of several chunks are joined back.
SALTS = 16
SPANS = T.ArrayType(T.StructType([T.StructField("first_word", T.LongType()), T.StructField("end_word", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", SPANS), T.StructField("clean_text", T.StringType())]


class WindowSet:
    """All windows of the items: their sorted hashes, by length, with the word each begins at, and a bit map for the first look."""

    def __init__(self, items: Iterable[tuple[str | None, str | None]], window: int):
        self.names: list[str | None] = []
        flat, begins, counts, hashes, size = [], [], [], [], 0
        items = iter(items)
        more = True
        while more:  # slice by slice, as the arrays of a slice's hashing are larger than its text
            part, length = [], 0
            while length < SLICE_BYTES and (more := (item := next(items, None)) is not None):
                self.names.append(item[0])
                part.append(item[1])
                length += len(item[1] or "")
            data, off = buffers(pa.array(part, pa.large_string()))
            data = LOWER[data]
            a, b = word_bounds(data, off, WORD)
            counts.append(np.diff(np.searchsorted(a, off)))
            hashes.append(word_hashes(data, a, b))
            keep = WORD[data]
            before = np.concatenate([[0], np.cumsum(keep)])
            flat.append(data[keep])  # words alone: each ends where the next begins
            begins.append(before[a] + size)
            size += int(before[-1])
        self.flat = np.concatenate(flat)
        self.begins = np.append(np.concatenate(begins), size).astype(np.int64 if size > 2**31 - 1 else np.int32)
        count, words = np.concatenate(counts), np.concatenate(hashes)
        self.first = np.concatenate([[0], np.cumsum(count)])
        self.by_length: dict[int, dict] = {}
        for n in np.unique(np.minimum(count, window)).tolist():
            if not n:
                continue
            own = np.flatnonzero(count == n) if n < window else np.flatnonzero(count >= n)
            at = np.repeat(self.first[own] - np.cumsum(count[own] - n + 1) + count[own] - n + 1, count[own] - n + 1) + np.arange((count[own] - n + 1).sum())
            grams = gram_hashes(words, n)[at]
            order = np.argsort(grams, kind="stable")
            bits = np.zeros(1 << BITS, bool)
            bits[(grams >> np.uint64(64 - BITS)).astype(np.int64)] = True
            self.by_length[n] = {"bits": np.packbits(bits), "hashes": grams[order], "at": at[order].astype(self.begins.dtype)}

    def words(self, at: int, n: int) -> bytes:
        """The n words from word `at` on, without what stands between them."""
        return self.flat[self.begins[at] : self.begins[at + n]].tobytes()

    def lengths(self, at: int, n: int) -> np.ndarray:
        return np.diff(self.begins[at : at + n + 1])

    def scan(self, texts: pa.Array) -> dict:
        """Of each text: words, hit words, items, and hit spans in words and in bytes."""
        data, off = buffers(texts)
        low = LOWER[data]
        starts, ends = word_bounds(low, off, WORD)
        first = np.searchsorted(starts, off)
        count = np.diff(first)
        doc = np.repeat(np.arange(len(texts)), count)
        hashes = word_hashes(low, starts, ends)
        edge = np.zeros(len(starts) + 1, np.int64)
        items: dict[int, set] = {}
        for n, w in self.by_length.items():
            grams = gram_hashes(hashes, n)
            place = (grams >> np.uint64(64 - BITS)).astype(np.int64)
            maybe = np.flatnonzero(w["bits"][place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1)
            maybe = maybe[doc[maybe] == doc[maybe + n - 1]]
            lo = np.searchsorted(w["hashes"], grams[maybe], "left")
            hi = np.searchsorted(w["hashes"], grams[maybe], "right")
            for i, a, b in zip(maybe[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist()):
                own, length = b"".join(low[starts[j] : ends[j]].tobytes() for j in range(i, i + n)), ends[i : i + n] - starts[i : i + n]
                same = [k for k in w["at"][a:b].tolist() if own == self.words(k, n) and (length == self.lengths(k, n)).all()]
                if same:
                    edge[i] += 1
                    edge[i + n] -= 1
                    found = items.setdefault(int(doc[i]), set())
                    found.update(self.names[k] for k in np.searchsorted(self.first, same, "right") - 1)
        hit = np.cumsum(edge[:-1]) > 0
        spans: list[list] = [[] for _ in range(len(texts))]
        if hit.any():
            side = np.diff(hit.astype(np.int8), prepend=0, append=0)
            for a, b in zip(np.flatnonzero(side == 1).tolist(), np.flatnonzero(side == -1).tolist()):
                while a < b:  # hits of neighbouring texts touch
                    d = int(doc[a])
                    e = min(b, int(first[d + 1]))
                    spans[d].append((a - int(first[d]), e - int(first[d]), int(starts[a] - off[d]), int(ends[e - 1] - off[d])))
                    a = e
        return {"n_words": count, "n_hit": np.bincount(doc[hit], minlength=len(texts)), "items": [sorted(x for x in items.get(i, ()) if x is not None) for i in range(len(texts))], "spans": spans, "data": data, "off": off}


def cut(text: bytes, spans: Sequence[tuple]) -> str:
    """text without the byte spans."""
    out, at = [], 0
    for _, _, a, b in spans:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]]).decode()


def _pass(docs: DataFrame, keep: Sequence[str], text: str, windows, clean: bool) -> DataFrame:
    """One scan with a broadcast WindowSet."""

    def make():
        own = windows.value

        def scan(texts: pa.Array) -> list:
            r = own.scan(texts)
            return [r["n_words"], r["n_hit"], pa.array(r["items"], pa.list_(pa.string())), _spans(r["spans"]), cleaned(texts, r["spans"]) if clean else pa.nulls(len(texts), pa.large_string())]

        return scan

    return arrow_map(docs, keep, text, make, FIELDS)


def _spans(spans: list[list[tuple]]) -> pa.Array:
    names = SPANS.elementType.names
    return pa.array([[dict(zip(names, s)) for s in x] for x in spans], pa.list_(pa.struct([(n, pa.int64()) for n in names])))


def cleaned(texts: pa.Array, spans: list[list[tuple]]) -> pa.Array:
    """The texts without their spans; one without spans is the same."""
    if not any(spans):
        return texts
    data, off = buffers(texts)
    new = pa.array([cut(data[a:b].tobytes(), s) if s else None for a, b, s in zip(off[:-1], off[1:], spans)], texts.type)
    return pa.compute.if_else(pa.array([bool(s) for s in spans]), new, texts)


def merged(spans: list[tuple]) -> list[tuple]:
    """Spans (first word, end word, start, end) joined where they touch or overlap."""
    out: list[tuple] = []
    for s in sorted(spans):
        if out and out[-1][1] >= s[0]:
            out[-1] = (out[-1][0], max(out[-1][1], s[1]), out[-1][2], max(out[-1][3], s[3]))
        else:
            out.append(tuple(s))
    return out


def _chunks(benchmark: DataFrame, item: str, item_text: str, window: int, chunk_bytes: int) -> list:
    """The items as broadcast WindowSets; the driver holds the items of one chunk at a time."""
    sc, out = benchmark.sparkSession.sparkContext, []
    rows = benchmark.select(col(item).cast("string"), col(item_text).cast("string").alias("body"), F.octet_length(col(item_text).cast("string"))).filter("body is not null").toLocalIterator()
    row = next(rows, None)
    while row is not None or not out:

        def chunk():
            nonlocal row
            size = 0
            while row is not None and (not size or size + row[2] <= chunk_bytes):
                size += row[2]
                yield row[0], row[1]
                row = next(rows, None)

        out.append(sc.broadcast(WindowSet(chunk(), window)))
    return out


def scan_benchmark(docs: DataFrame, benchmark: DataFrame, *, keep: Sequence[str] = ("doc_id",), text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 10, chunk_bytes: int = 8 << 20, clean: bool = False) -> DataFrame:
    """Columns keep of docs, with n_words, n_hit, items, spans (in words, and start and end in UTF-8 bytes) and, if clean, the text without its spans."""
    keep = [c for c in keep if c.lower() not in {f.name.lower() for f in FIELDS}]
    source, names = numbered(docs.select(*[col(c) for c in dict.fromkeys([*keep, text])]))
    kept, body = [names[c] for c in keep], names[text]
    chunks = _chunks(benchmark, item, item_text, window, chunk_bytes)
    if len(chunks) == 1:
        out = _pass(source, kept, body, chunks[0], clean)
        return out.select(*[F.col(names[c]).alias(c) for c in keep], *[f.name for f in FIELDS])
    source = source.withColumn("text_key", F.sha2(F.coalesce(F.col(body).cast("string"), F.lit("")), 256))
    one = [_pass(source, ["text_key"], body, c, False).filter("n_hit > 0").dropDuplicates(["text_key"]).select("text_key", "items", "spans") for c in chunks]
    hits = one[0]
    for x in one[1:]:
        hits = hits.unionByName(x)
    hits = hits.groupBy("text_key").agg(F.flatten(F.collect_list("items")).alias("all_items"), F.flatten(F.collect_list("spans")).alias("all_spans"))
    empty = source.sparkSession.sparkContext.broadcast(WindowSet([], window))
    plain = _pass(source.withColumn("body", F.col(body).cast("string")), [*kept, "body", "text_key"], body, empty, False).select(*kept, "body", "text_key", "n_words")
    salted = plain.withColumn("salt", (F.rand(3) * SALTS).cast("int"))
    joined = salted.join(hits.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["text_key", "salt"], "left").select(*kept, "n_words", "body", "all_items", "all_spans")
    schema = T.StructType([*[joined.schema[c] for c in kept], *FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(kept)
        for b in batches:
            spans = [merged([tuple(s.values()) for s in x or ()]) for x in b.column(k + 3).to_pylist()]
            items = [sorted(set(x or ())) for x in b.column(k + 2).to_pylist()]
            bodies = b.column(k + 1).cast(pa.large_string())
            new = cleaned(bodies, spans) if clean else pa.nulls(b.num_rows, pa.large_string())
            n_hit = [sum(s[1] - s[0] for s in x) for x in spans]
            yield pa.RecordBatch.from_arrays([*b.columns[:k], b.column(k), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), _spans(spans), new.cast(pa.string())], names=schema.names)

    return joined.mapInArrow(run, schema).select(*[F.col(names[c]).alias(c) for c in keep], *[f.name for f in FIELDS])


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", remove: str = "spans", **options) -> DataFrame:
    """docs, same columns: hit spans cut out of the texts (a text with no words left goes), or with remove="documents" hit rows gone.

    Null and clean texts stay as they are; repeated rows are treated alike; n_chars, if there is such a column, follows
    the text; other columns may be null and have any names; an empty table gives an empty one.
    """
    columns = docs.columns
    source, names = numbered(docs)
    out = scan_benchmark(source, benchmark, keep=source.columns, text=names[text], clean=True, **options)
    if remove == "documents":
        out = out.filter("n_hit = 0")
    else:
        body = F.when(F.col("n_hit") > 0, F.col("clean_text")).otherwise(F.col(names[text]).cast("string"))
        out = out.filter("n_hit = 0 or n_hit < n_words").withColumn(names[text], body)
        if "n_chars" in columns:
            n = names["n_chars"]
            out = out.withColumn(n, F.when(F.col("n_hit") > 0, F.length(names[text]).cast(docs.schema["n_chars"].dataType)).otherwise(F.col(n)))
    return out.select(*[F.col(names[c]).alias(c) for c in columns])


def query(spark, sf_dir: str) -> DataFrame:
    out = scan_benchmark(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def brute(docs: list[tuple], items: list[tuple], window: int = 10) -> dict:
    """The same for small lists of (id, text), by plain loops: id -> (n_words, n_hit, items)."""
    import re

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = {}
    for d, t in docs:
        w, hit, names = words(t), set(), set()
        for i, it in items:
            v = words(it)
            n = min(window, len(v))
            for k in range(len(v) - n + 1 if n else 0):
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == v[k : k + n]:
                        hit.update(range(j, j + n))
                        names.add(str(i))
        out[d] = (len(w), len(hit), sorted(names))
    return out


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), ig AS (
  SELECT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g
  FROM iw, LATERAL (SELECT unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i) WHERE len(w) > 0
), dg AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM dw, (SELECT DISTINCT n FROM ig), LATERAL (SELECT unnest(range(1, greatest(len(w) - n + 2, 1))) AS i)
), h AS (SELECT DISTINCT doc_id, i, n, item_id FROM dg JOIN ig USING (n, g)
), hw AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM h, LATERAL (SELECT unnest(range(i, i + n)) AS k) GROUP BY 1
), hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
