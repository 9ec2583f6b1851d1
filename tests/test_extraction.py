import itertools

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lexiloom.operators.parse import parse_lines, parse_tokens
from lexiloom.operators import paths
from lexiloom.operators.paths import extract_ngrams, extract_paths, noun_pair_paths


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_lines_and_counts(spark):
    got = parse_lines(lines(spark, "h\tn\t5\t9\t9", "h\tn\tabc", "h\tn\t 5 ", "h\tn\t", "h\tn", "", "h\tn\t+7", "h\tn\t99999999999999999999", "h\t\t3", None)).collect()
    assert sorted((r.ngram, r.cnt) for r in got) == [("", 3), ("n", 1), ("n", 1), ("n", 1), ("n", 5), ("n", 7)]


def test_tokens_are_read_from_the_right(spark):
    got = parse_tokens(parse_lines(lines(spark, "h\tand/or/NN/dobj/2  x/y/1 /NN/dep/0 a/NN/d/z b/V/r/-1\t1", "h\tnone\t1"))).collect()
    assert [[tuple(t) for t in r.tokens] for r in got] == [[("and/or", "NN", "dobj", 2), ("", "NN", "dep", 0), ("b", "V", "r", -1)]]


CASES = {
    "cancer/NN/nsubjpass/2 caused/VBN/ROOT/0 by/IN/prep/2 smoking/NN/pobj/3": [("N:<nsubjpass:V:caus:>prep:P:by:>pobj:N", "cancer", "smoke")],
    "dog/NN/nn/2 cat/NN/ROOT/0": [],
    "smoking/NN/nsubj/2 is/VBZ/ROOT/0 habit/NN/dobj/2": [],
    "man/NN/nsubj/3 has/VBZ/aux/3 eaten/VBN/ROOT/0 bread/NN/dobj/3": [("N:<nsubj:V:eaten:>dobj:N", "man", "bread")],
    "man/NN/nsubj/2 Was/VBZ/ROOT/0 eating/VBG/xcomp/2 bread/NN/dobj/3": [("N:<nsubj:V:Wa:>xcomp:V:eat:>dobj:N", "man", "bread")],
    "a/NN/x/9 runs/VB/ROOT/0 b/NN/dobj/2": [],
    "a/NN/nsubj/2 eats/VB/ROOT/0 b/NN/dobj/2 c/NN/conj/3": [("N:<nsubj:V:eat:>dobj:N", "a", "b"), ("N:<nsubj:V:eat:>dobj:W:b:>conj:N", "a", "c")],
    "Dog/NN/nsubj/2 eats/VB/ROOT/0 dog/NN/dobj/2": [("N:<nsubj:V:eat:>dobj:N", "Dog", "dog")],
    "a/NN/nsubj/2 eats/VB/xx/1": [],
    "bad a/NN/nsubj/2 eats/VB/ROOT/0 b/NN/dobj/2": [("N:<nsubj:V:eat:>dobj:N", "a", "b")],
}


@pytest.mark.parametrize("ngram", CASES)
def test_paths(spark, ngram):
    line = parse_lines(lines(spark, f"h\t{ngram}\t4"))
    for got in (extract_ngrams(line).collect(), extract_paths(parse_tokens(line)).collect()):
        assert sorted((r.path, r.x, r.y) for r in got) == sorted(CASES[ngram]) and all(r.cnt == 4 for r in got)


def shortest(heads, s, d):
    n = len(heads)
    near = {i: set() for i in range(1, n + 1)}
    for i, h in enumerate(heads, 1):
        if 1 <= h <= n:
            near[i].add(h)
            near[h].add(i)
    seen, todo = {s: 0}, [s]
    while todo:
        u = todo.pop(0)
        for v in near[u] - set(seen):
            seen[v] = seen[u] + 1
            todo.append(v)
    return seen.get(d)


def test_every_head_assignment_of_small_ngrams(spark):
    """Trees, forests and cycles: each path found has the length of a shortest one and walks along heads."""
    rows = [("h\t" + " ".join(f"w{i}/NN/d/{h}" for i, h in enumerate(hs)) + "\t1",) for hs in itertools.product(range(6), repeat=4)]
    got = noun_pair_paths(parse_tokens(parse_lines(spark.createDataFrame(rows, "value string")))).select(F.transform("tokens", lambda t: t["head"]).alias("h"), "src", "dst", "path").collect()
    found = {(tuple(r.h), r.src, r.dst): r.path for r in got}
    for hs in itertools.product(range(6), repeat=4):
        for s, d in itertools.combinations(range(1, 5), 2):
            want, path = shortest(hs, s, d), found.get((hs, s, d))
            assert (path is None) == (want is None)
            if path:
                assert len(path) == want + 1 and path[0] == s and path[-1] == d
                assert all(hs[a - 1] == b or hs[b - 1] == a for a, b in zip(path, path[1:]))


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab/ NV\t0123", max_size=30), max_size=8))
def test_any_text_parses(spark, values):
    line = parse_lines(lines(spark, *values, "h\tx\t1"))
    assert sorted(extract_ngrams(line).collect()) == sorted(extract_paths(parse_tokens(line)).collect())


def test_long_trees_and_many_nouns(spark, monkeypatch):
    """A chain of 300 words and a star of 60 nouns, in pieces of few pairs."""
    monkeypatch.setattr(paths, "MOST_PAIRS", 100)
    chain = " ".join(f"w{i}/{'NN' if i in (0, 299) else 'VB'}/d/{i}" for i in range(300))
    star = " ".join(["eat/VB/ROOT/0", *[f"n{i}/NN/obj/1" for i in range(60)]])
    got = extract_ngrams(parse_lines(lines(spark, f"h\t{chain}\t1", f"h\t{star}\t2")), stemmed=False).collect()
    long = [r for r in got if r.cnt == 1]
    assert [(r.x, r.y) for r in long] == [("w0", "w299")] and long[0].path == "N:>d:" + "".join(f"V:w{i}:>d:" for i in range(1, 299)) + "N"
    assert sorted((r.x, r.y, r.path) for r in got if r.cnt == 2) == sorted((f"n{i}", f"n{j}", "N:<obj:V:eat:>obj:N") for i in range(60) for j in range(i + 1, 60))
