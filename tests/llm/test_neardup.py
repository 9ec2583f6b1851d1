import itertools
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from lexiloom.llm import neardup


def shingles(t, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(rows, n):
    sets = {i: shingles(t, n) for i, t in rows if i is not None}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def families(seed, edits, members=30, n=4):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(n):
        base = [r.choice(words) for _ in range(50)]
        for _ in range(members):
            t = list(base)
            for _ in range(r.randrange(edits)):
                t[r.randrange(len(t))] = r.choice(words)
            out.append(" ".join(t))
    return out


@pytest.mark.parametrize("n,tile", [(4, 512), (5, 8)])
def test_components_match_all_pairs(spark, documents, monkeypatch, n, tile):
    monkeypatch.setattr(neardup, "TILE", tile)
    texts = [*families(5, 6), *["", None, "a b", "A  B\x0b", "a b c d e", "x", "\x1c", "É e", "word " * 20_000] * 2]
    docs = documents(texts)
    want = brute(list(enumerate(texts)), n)
    rows = neardup.near_duplicates(docs, shingle=n).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    kept = neardup.deduplicate(docs, shingle=n)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None} == {i for i, (_, c) in want.items() if i == c}


def test_equal_signature_bytes_of_an_earlier_band_hide_no_pair(spark):
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words, "more"]))], "id long, text string")
    sig = bytes(range(neardup.BANDS * neardup.ROWS))
    bands = {i: [100 * b + (0 if b == 1 else i) for b in range(neardup.BANDS)] for i in (1, 2)}
    reps = spark.createDataFrame([(i, bytearray(sig), bands[i]) for i in (1, 2)], "rep long, sig binary, bands array<long>")
    rows = neardup.written(spark.createDataFrame([(100, 1, i, i, 55 + i, 200) for i in (1, 2)], "key long, band int, rep long, comp long, n long, n_bytes long"))
    assert [tuple(sorted(r)) for r in neardup._tiled_links(rows, reps, docs, 5, 80).collect()] == [(1, 2)]


@pytest.mark.parametrize("tile,tile_bytes", [(64, 1 << 22), (1024, 20_000)])
def test_tiles_of_a_large_bucket_lose_no_link(spark, monkeypatch, tile, tile_bytes):
    """A bucket of 2,000 texts, each two of similarity 0.7 to 0.9 or so and in components of their own: links of the tiles connect what all links do."""
    monkeypatch.setattr(neardup, "TILE", tile)
    monkeypatch.setattr(neardup, "TILE_BYTES", tile_bytes)
    r, m = random.Random(3), 2000
    stock = [f"w{i}" for i in range(60)]
    texts = [" ".join(stock[: 50 + i % 3] + [f"a{r.randrange(40)}" for _ in range(r.randrange(2, 9))]) for i in range(m)]
    x, at = neardup.shingle_sets(pa.array(texts, pa.large_string()), 1)
    sig_bands = neardup._scan(1)()(pa.array(texts, pa.large_string()))
    words, number = np.unique(x, return_inverse=True)
    matrix = np.zeros((m, len(words)), np.float32)
    matrix[np.repeat(np.arange(m), np.diff(at)), number] = 1
    both, size = matrix @ matrix.T, np.diff(at)
    linked = 100 * both >= 80 * (size[:, None] + size - both)
    band = [b.as_py() for b in sig_bands[3]]
    key = max({b[0] for b in band}, key=[b[0] for b in band].count)
    inside = [i for i in range(m) if band[i][0] == key]
    assert len(inside) > 100
    up = {i: i for i in inside}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    def join(pairs):
        for a, b in pairs:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
        out = {i: root(i) for i in inside}
        up.update({i: i for i in inside})
        return out

    want = join((i, j) for k, i in enumerate(inside) for j in inside[:k] if linked[i, j])
    rows = neardup.written(spark.createDataFrame([(key, 0, i, 0 if i in inside[:40] else i, int(size[i]), len(texts[i])) for i in inside], "key long, band int, rep long, comp long, n long, n_bytes long"))
    reps = spark.createDataFrame([(i, bytearray(sig_bands[4][i].as_py()), band[i]) for i in inside], "rep long, sig binary, bands array<long>")
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = [tuple(p) for p in neardup._tiled_links(rows, reps, docs, 1, 80).collect()]
    assert all(linked[a, b] for a, b in got)
    start = [(inside[0], i) for i in inside[1:40]]  # one component from before
    before = join(start + [(i, j) for k, i in enumerate(inside) for j in inside[:k] if linked[i, j]])
    assert join(start + got) == before and len(set(want.values())) < len(inside)


def test_hot_values_are_joined_whole(spark):
    big = neardup.written(spark.createDataFrame([(0 if i % 3 else i, i) for i in range(6000)], "k long, v long"))
    side = spark.createDataFrame([(i, str(i)) for i in range(3000)], "k long, s string")
    want = {(k, i, str(k)) for k, i in ((0 if i % 3 else i, i) for i in range(6000)) if k < 3000}
    assert {(r.k, r.v, r.s) for r in neardup.spread_join(big, side, "k", "v").collect()} == want
    assert neardup.spread_join(big, side, "k", "v", "left").count() == 6000


def test_nothing_to_link(spark, documents):
    docs = documents(["one two three four five", "six seven eight nine ten"])
    assert neardup.near_duplicates(docs).filter("not kept").count() == 0
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)], [(5, 5)]])
def test_star_components(spark, edges):
    got = {r.node: r.comp for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {x: min(nodes) for x in nodes}


def test_query_matches_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    assert {tuple(r) for r in neardup.query(spark, sf).collect()} == set(con.sql(neardup.SQL).fetchall())
