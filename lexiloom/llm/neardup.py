"""MinHash near-duplicate detection.

A text's set: the hashes of its distinct runs of `shingle` words (A-Z lower-cased, apart by ASCII white space); with
fewer words, of the whole sequence. Two texts are linked if 100 * |intersection| >= percent * |union|; a component
is what links connect, named by its smallest doc_id.

1. Scan: set size, a 128-bit set key, BANDS keys of ROWS universal-hash minima each, and a byte of every minimum.
2. Texts with one set are one class, represented by its smallest doc_id; only representatives go on.
3. Candidates share a band key. First every member of a bucket meets two of it, the smallest and one picked by a
   hash; such a pair passes a signature check (SLACK below the threshold) and is then confirmed on the full sets,
   made anew from the whole texts.
4. Where a bucket still spans several components, the members outside its largest one meet all others in tiles of at
   most TILE by TILE members and TILE_BYTES by TILE_BYTES of text: members of the largest component have no pair among
   themselves left to look at. First tiles hold signatures alone, and say which members agree with any of the other
   side. Only the texts of those go to the tile, where full sets confirm; pairs of one component are passed over.
5. Components by alternating large-star and small-star.

A pair at the threshold shares no band with probability (1 - 0.8**4)**28 < 1e-6, and one that shares a band is compared
in the first bucket it shares or is of one component already, unless its signatures, of 112 minima, agree in a share
SLACK below the threshold: over 4 standard deviations. Sets hold 64-bit hashes.

Defined cases: a null text, or one without words, has an empty set and is linked with nothing; rows with one doc_id
are one document; a null doc_id is linked with nothing, has no component and is kept; ties do not arise (the smallest
id names a component); a text of any length is hashed whole; an empty table gives an empty result. Extra columns, of any
names, are not read.

Scale: texts are never shuffled as a whole: only those of candidates are, found by a bit map (of a size made for their
count, up to MAP_BYTES) or, beyond that, by a semi-join. Buckets and classes of any size are met by aggregates with
partial sums, by joins that deal a hot value over many tasks (common.spread_join), or by tiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import _GOLD, LOWER, arrow_map, buffers, col, dropped, free_name, gram_hashes, mask_of, mix64, scratch, ship, slices, spread_join, word_bounds, word_hashes, written

WORD = mask_of([0x20, *range(0x09, 0x0E)])
BANDS, ROWS = 28, 4
TILE = 1024
TILE_BYTES = 4 << 20
#: How far a signature's share of equal bytes may lie below the threshold: over 4 standard deviations.
SLACK = 0.16
MAP_BYTES = 16 << 20
_N = BANDS * ROWS
_MUL = mix64(np.arange(1, _N + 1, dtype=np.uint64) * _GOLD) | np.uint64(1)
_ADD = mix64(np.arange(1001, _N + 1001, dtype=np.uint64) * _GOLD)
FIELDS = [T.StructField("n_shingles", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("set_key", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sig", T.BinaryType())]


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts in a row, in order within each text, and where each text's begin."""
    data, off = buffers(texts)
    low = LOWER[data]
    starts, ends = word_bounds(low, off, WORD)
    words = word_hashes(low, starts, ends)
    first = np.searchsorted(starts, off)
    count = np.diff(first)
    doc = np.repeat(np.arange(len(texts)), count)
    hashes, owner = [], []
    for k in range(1, n + 1):
        grams = gram_hashes(words, k) + np.uint64(k * int(_GOLD) % 2**64)
        if k == n:
            at = np.flatnonzero(doc[: len(grams)] == doc[k - 1 :]) if len(grams) else np.empty(0, np.int64)
        else:
            at = first[:-1][count == k]
        hashes.append(grams[at])
        owner.append(doc[at])
    x, doc = np.concatenate(hashes), np.concatenate(owner)
    order = np.lexsort((x, doc))
    x, doc = x[order], doc[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (doc[1:] != doc[:-1])
    x, doc = x[new], doc[new]
    return x, np.searchsorted(doc, np.arange(len(texts) + 1))


def _scan(n: int):
    def make():
        def scan(texts: pa.Array) -> list:
            x, at = shingle_sets(texts, n)
            size = np.diff(at)
            full = np.flatnonzero(size)
            begin = at[:-1][full]
            minima = np.empty((len(full), _N), np.uint64)
            keys = np.zeros((len(full), 2), np.uint64)
            if len(full):
                for i in range(_N):
                    minima[:, i] = np.minimum.reduceat(x * _MUL[i] + _ADD[i], begin)
                keys[:, 0] = np.add.reduceat(mix64(x), begin)
                keys[:, 1] = np.add.reduceat(mix64(x ^ _GOLD), begin)
                keys += size[full].astype(np.uint64)[:, None]
            minima = mix64(minima)
            sig = (minima & np.uint64(255)).astype(np.uint8)
            bands = np.zeros((len(full), BANDS), np.uint64)
            for r in range(ROWS):
                bands = mix64(bands + minima[:, r::ROWS] + np.uint64((r + 1) * int(_GOLD) % 2**64))
            bands = mix64(bands + np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLD).view(np.int64)
            set_key, band, signature = ([None] * len(texts) for _ in range(3))
            for j, i in enumerate(full.tolist()):
                set_key[i], signature[i], band[i] = keys[j].tobytes(), sig[j].tobytes(), bands[j]
            return [size, np.diff(buffers(texts)[1]), pa.array(set_key, pa.binary()), pa.array(band, pa.list_(pa.int64())), pa.array(signature, pa.binary())]

        return scan

    return make


PAIR = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _alike(pairs: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of a written table whose signatures agree in a share of at least `least`."""
    sigs = reps.select("rep", "sig")
    both = spread_join(pairs, sigs.withColumnsRenamed({"rep": "b", "sig": "sb"}), "b", "a").join(sigs.withColumnsRenamed({"rep": "a", "sig": "sa"}), "a").select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, _N) for c in (2, 3))
            yield pa.RecordBatch.from_arrays(list(b.select([0, 1]).filter(pa.array((x == y).mean(1) >= least)).columns), names=["a", "b"])

    return both.mapInArrow(run, PAIR)


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs (id, text) without most of those that ids (a column of a written table) lack: what a bit map lets through, or a semi-join."""
    ids = ids.toDF("id").distinct()
    bits = 1 << max(16, (8 * ids.count()).bit_length())
    if bits > 8 * MAP_BYTES:
        return docs.join(ids, "id", "left_semi")
    place = f"pmod(xxhash64(7, id), {bits})"
    word, bit = F.expr(f"shiftright({place}, 6)").alias("word"), F.expr(f"shiftleft(1L, cast(pmod({place}, 64) as int))")
    words = ids.select(word, bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    return docs.withColumn("word", word).join(F.broadcast(words), "word").filter(F.col("bits").bitwiseAND(bit) != 0).select("id", "text")


def shared(u: np.ndarray, v: np.ndarray) -> int:
    """How many of the sorted distinct numbers u are in v, which are too."""
    return int((v[np.minimum(np.searchsorted(v, u), len(v) - 1)] == u).sum())


def _confirmed(docs: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of the pairs (a written table; many may have one b) whose full sets are similar enough, as a written table."""
    texts = written(_texts_of(docs, pairs.select("a").union(pairs.select("b"))).groupBy("id").agg(F.first("text").alias("text")))
    both = spread_join(pairs, texts.withColumnsRenamed({"id": "b", "text": "tb"}), "b", "a").join(texts.withColumnsRenamed({"id": "a", "text": "ta"}), "a").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, right = b.column(2).cast(pa.large_string()), b.column(3).cast(pa.large_string())
            ok = np.zeros(b.num_rows, bool)
            for i, j in slices(left):
                x, at = shingle_sets(left.slice(i, j - i), n)
                y, bt = shingle_sets(right.slice(i, j - i), n)
                for k in range(j - i):
                    u, v = x[at[k] : at[k + 1]], y[bt[k] : bt[k + 1]]
                    if 100 * min(len(u), len(v)) >= percent * max(len(u), len(v)) > 0:
                        common = shared(u, v)
                        ok[i + k] = 100 * common >= percent * (len(u) + len(v) - common)
            yield pa.RecordBatch.from_arrays(list(b.select([0, 1]).filter(pa.array(ok)).columns), names=["a", "b"])

    return written(both.mapInArrow(run, PAIR).distinct())


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of every node of edges (a, b): comp is the smallest node that edges connect it with.

    Large-star: each node's larger neighbours go to the smallest of its neighbourhood. Small-star: each node and its
    smaller neighbours go to the smallest of them. In turn, until nothing changes; every round is a written table.
    """
    state = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    e = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    last = state(e)
    while last[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = spread_join(both.filter("v > u"), low, "u", "v").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        new = written(small)
        dropped(e)
        e, now = new, state(new)
        if now == last:
            break
        last = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def _tiles(members: DataFrame) -> DataFrame:
    """The tiles that members (key, band, rep, comp, n, n_bytes; a written table) of divided buckets meet in, a row a member and tile.

    A key's members are of its largest component (`most`) or not; each kind is dealt into blocks by a hash. A block of the
    others meets each block of the largest, itself, and each other block of the others: k members outside the largest
    component make m * k / TILE rows, not m * m / TILE.
    """
    sums = [F.count(F.lit(1)).alias("members"), F.sum("n_bytes").alias("n_bytes")]
    comps = members.groupBy("key", "comp").agg(*sums)
    largest = F.max_by("comp", F.struct("members", "comp"))
    keys = comps.groupBy("key").agg(largest.alias("most"), F.count(F.lit(1)).alias("comps"), F.sum("members").alias("members"), F.sum("n_bytes").alias("n_bytes"), F.max(F.struct("members", "comp", "n_bytes")).alias("m")).filter("comps > 1")
    blocks = lambda n, size: F.ceil(F.greatest(n / TILE, size / TILE_BYTES, F.lit(1))).cast("int")
    keys = keys.select("key", "most", blocks(F.col("m.members"), F.col("m.n_bytes")).alias("nm"), blocks(F.col("members") - F.col("m.members"), F.col("n_bytes") - F.col("m.n_bytes")).alias("no"))
    dealt = spread_join(members, keys, "key", "rep")
    h = F.xxhash64(F.lit(3), "rep")
    block = F.when(F.col("comp") == F.col("most"), -1 - F.pmod(h, F.col("nm"))).otherwise(F.pmod(h, F.col("no"))).cast("int")
    others, largest = F.sequence(F.lit(0), F.col("no") - 1), F.sequence(-F.col("nm"), F.lit(-1))
    dealt = dealt.withColumn("side", block).withColumn("other", F.explode(F.when(block < 0, others).otherwise(F.concat(others, largest))))
    return dealt.select(F.xxhash64("key", F.least("side", "other"), F.greatest("side", "other")).alias("tile"), "key", "band", "side", "other", "rep", "comp", "n")


def _met(rows: DataFrame, meet, schema: T.StructType) -> DataFrame:
    """meet(table of one tile) -> list of tuples, for each tile of rows (tile, ...)."""
    ordered = rows.select("tile", *[c for c in rows.columns if c != "tile"]).repartition("tile").sortWithinPartitions("tile", "key")

    def batch(found: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in range(len(schema))], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for b in batches:
            tile = b.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(tile)) + 1).tolist(), len(tile)] if len(tile) else [0]
            found = []
            for x, y in zip(edges[:-1], edges[1:]):
                if kept and kept[0].column(0)[0].as_py() != int(tile[x]):
                    found += meet(pa.Table.from_batches(kept))
                    kept = []
                kept.append(b.slice(x, y - x))
            yield batch(found)
        if kept:
            yield batch(meet(pa.Table.from_batches(kept)))

    return ordered.mapInArrow(run, schema)


class Tile:
    """The members of one tile (the columns of _tiles, then sig and bands), and which of them may be looked at together."""

    def __init__(self, t: pa.Table, percent: int):
        self.key, self.band, self.side, self.other, self.rep, self.comp, self.n = (t.column(c).to_numpy() for c in ("key", "band", "side", "other", "rep", "comp", "n"))
        self.sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(-1, _N)
        self.bands = t.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        self.percent, self.least = percent, percent / 100 - SLACK

    def partners(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Members after i whose signatures agree with its enough, and how much; each pair in the first band only whose whole key both have."""
        js = np.arange(i + 1, len(self.rep))
        ok = (self.key[js] == self.key[i]) & (self.comp[js] != self.comp[i]) & (self.rep[js] != self.rep[i])
        ok &= (self.side[js] != self.side[i]) | (self.side[i] == self.other[i])
        js = js[ok & (100 * np.minimum(self.n[js], self.n[i]) >= self.percent * np.maximum(self.n[js], self.n[i]))]
        if not len(js):
            return js, np.empty(0)
        alike = (self.sig[js] == self.sig[i]).mean(1)
        js, alike = js[alike >= self.least], alike[alike >= self.least]
        ok = ~(self.bands[js, : self.band[i]] == self.bands[i, : self.band[i]]).any(1)
        return js[ok], alike[ok]


HIT = T.StructType([T.StructField("tile", T.LongType()), T.StructField("rep", T.LongType())])


def _tiled_links(members: DataFrame, reps: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (a, b) among members of divided buckets: enough of them to connect what all links between different comps do."""
    ship(members.sparkSession)
    signed = written(_tiles(members).join(reps.select("rep", "sig", "bands"), "rep"))

    def hits(t: pa.Table) -> list[tuple[int, int]]:
        tile, some = Tile(t, percent), np.zeros(t.num_rows, bool)
        for i in range(t.num_rows - 1):
            js, _ = tile.partners(i)
            some[js] = True
            some[i] |= len(js) > 0
        number = t.column("tile")[0].as_py()
        return [(number, r) for r in np.unique(tile.rep[some]).tolist()]

    hit = written(_met(signed, hits, HIT))
    texts = _texts_of(docs, hit.select("rep")).groupBy("id").agg(F.first("text").alias("text"))
    full = spread_join(hit, texts.withColumnRenamed("id", "rep"), "rep", "tile").join(signed, ["tile", "rep"])

    def links(t: pa.Table) -> list[tuple[int, int]]:
        tile = Tile(t, percent)
        rep, comp, size = tile.rep.tolist(), tile.comp.tolist(), tile.n
        x, at = [], [0]
        texts = pa.concat_arrays([c.cast(pa.large_string()) for c in t.column("text").chunks])
        for a, b in slices(texts):
            own, ends = shingle_sets(texts.slice(a, b - a), n)
            x.append(own)
            at += (ends[1:] + at[-1]).tolist()
        x = np.concatenate(x)
        above: dict[int, int] = {}

        def root(c: int) -> int:
            while above.get(c, c) != c:
                c = above[c]
            return c

        out = []
        for i in range(len(rep) - 1):
            js, alike = tile.partners(i)
            u = x[at[i] : at[i + 1]]
            for j in js[np.argsort(-alike, kind="stable")].tolist():
                a, b = root(comp[i]), root(comp[j])
                if a != b:
                    common = shared(u, x[at[j] : at[j + 1]])
                    if 100 * common >= percent * int(size[i] + size[j] - common):
                        above[max(a, b)] = min(a, b)
                        out.append((rep[i], rep[j]))
        return out

    return written(_met(full, links, PAIR).distinct())


def near_duplicates(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, a row for each row of docs."""
    ship(docs.sparkSession)
    docs = docs.select(col(doc_id).cast("long").alias("id"), col(text).cast("string").alias("text"))
    least = percent / 100 - SLACK
    scanned = written(arrow_map(docs, ["id"], "text", _scan(shingle), FIELDS))
    with scratch() as made:
        reps = written(scanned.filter("n_shingles > 0 and id is not null").groupBy("set_key").agg(F.min("id").alias("rep"), *[F.first(c).alias(c) for c in ("n_shingles", "n_bytes", "bands", "sig")]))
        banded = written(reps.select("rep", F.col("n_shingles").alias("n"), "n_bytes", F.posexplode("bands").alias("band", "key")))
        picked = F.min(F.struct(F.xxhash64(F.lit(11), "key", "rep").alias("h"), "rep", "n"))
        buckets = banded.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("c"), picked.alias("d"), F.count(F.lit(1)).alias("members")).filter("members > 1")
        members = written(spread_join(banded, buckets.select("key", F.array("c", F.struct("d.rep", "d.n")).alias("centers")), "key", "rep"))
        pairs = members.select("rep", "n", F.explode("centers").alias("c")).filter("rep <> c.rep").filter(f"100 * least(n, c.n) >= {percent} * greatest(n, c.n)")
        pairs = written(pairs.select(F.greatest("rep", "c.rep").alias("a"), F.least("rep", "c.rep").alias("b")).distinct())
        links = _confirmed(docs, written(_alike(pairs, reps, least)), shingle, percent)
        comps = written(components(links))
        own = members.drop("centers").join(comps.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
        rest = _tiled_links(written(own), reps, docs, shingle, percent)
        comps = components(comps.select(F.col("node").alias("a"), F.col("comp").alias("b")).union(rest))
        classes = reps.select("set_key", "rep").join(comps.withColumnRenamed("node", "rep"), "rep").select("set_key", F.col("comp").alias("named"))
        single = reps.select("set_key", "rep").join(comps.withColumnRenamed("node", "rep"), "rep", "left_anti").select("set_key", F.col("rep").alias("named"))
        named = written(classes.union(single))
        made.remove(named)
    slim = scanned.select("id", "n_shingles", "set_key")
    out = spread_join(slim.filter("set_key is not null"), named, "set_key", "id", "left").select("id", "n_shingles", "named")
    out = out.unionByName(slim.filter("set_key is null").select("id", "n_shingles", F.lit(None).cast("long").alias("named")))  # no shuffle for empty sets
    component = F.when(F.col("id").isNotNull(), F.coalesce("named", "id"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def deduplicate(docs: DataFrame, *, doc_id: str = "doc_id", **options) -> DataFrame:
    """docs, same columns, with one document of each component: the one with the smallest id.

    Rows with a null id, a null text or no words stay; rows that repeat one id stay or go together; other columns may be
    null and have any names; an empty table gives an empty one.
    """
    gone = near_duplicates(docs, doc_id=doc_id, **options).filter("not kept").select(F.col("doc_id").alias(free_name("gone", docs.columns))).distinct()
    return docs.join(gone, col(doc_id).cast("long") == F.col(gone.columns[0]), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=4)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 3], chr(1)) AS g
  FROM w, LATERAL (SELECT unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i) WHERE len(ws) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.c >= 80 * (x.n + y.n - p.c)
), r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b
), m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d JOIN m ON m.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
