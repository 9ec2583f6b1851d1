"""Dependency paths between the nouns of an n-gram.

A token has one head, so an acyclic n-gram is a forest and the path of two nouns goes up from the one to their lowest
common ancestor and down to the other. All pairs of a batch climb side by side, over flattened arrays of heads, in Arrow
functions: array expressions in the JVM are interpreted for each element, and are several times as slow. N-grams whose
heads form a cycle, which no correct parse has, may have two shortest paths; those alone are searched one by one. Words
are stemmed and lower-cased once for each distinct word of a batch.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.phrases import AUX
from ..functions.stem import porter
from ..plans.session import ship
from .parse import once

PATHS = T.ArrayType(T.IntegerType())
EXTRACTED = T.StructType([T.StructField("path", T.StringType()), T.StructField("x", T.StringType()), T.StructField("y", T.StringType()), T.StructField("cnt", T.LongType())])
#: Pairs of nouns that a worker handles at once.
MOST_PAIRS = 200_000


def is_noun(t: Column) -> Column:
    return t["pos"].startswith("N")


def is_verb(t: Column) -> Column:
    return t["pos"].startswith("V")


def is_preposition(t: Column) -> Column:
    return t["pos"].isin("IN", "TO")


def noun_positions(tokens: Column) -> Column:
    """1-based positions of the nouns."""
    at = F.transform(tokens, lambda t, i: F.when(is_noun(t), i + 1))
    return F.filter(at, lambda i: i.isNotNull())


def pairs_of(nouns: Column) -> Column:
    """Every two positions of a sorted list, the earlier first."""
    return F.flatten(F.transform(nouns, lambda a: F.transform(F.filter(nouns, lambda b: b > a), lambda b: F.struct(a.alias("src"), b.alias("dst")))))


def noun_pairs(parsed: DataFrame) -> DataFrame:
    """tokens, cnt, src and dst of every two nouns."""
    rows = once(parsed, ["tokens", "cnt"], nouns=noun_positions(F.col("tokens"))).filter(F.size("nouns") > 1)
    return rows.select("tokens", "cnt", F.inline(pairs_of(F.col("nouns"))))


def has_content_verb(tokens: Column, path: Column) -> Column:
    """Is a verb other than an auxiliary on the path?"""
    return F.exists(path, lambda p: is_verb(F.element_at(tokens, p)) & ~F.lower(F.element_at(tokens, p)["word"]).isin(AUX))


def searched(heads: list[int], s: int, d: int) -> list[int] | None:
    """The breadth-first shortest path between two places (from 0) of an n-gram with any heads, or None."""
    near: list[list[int]] = [[] for _ in heads]
    for i, h in enumerate(heads):
        if 1 <= h <= len(heads):
            near[i].append(h - 1)
            near[h - 1].append(i)
    back, todo = {s: s}, deque([s])
    while todo and d not in back:
        u = todo.popleft()
        for v in near[u]:
            if v not in back:
                back[v] = u
                todo.append(v)
    if d not in back:
        return None
    path = [d]
    while path[-1] != s:
        path.append(back[path[-1]])
    return path[::-1]


class Paths:
    """Of n-grams in a row (off: where each one's tokens begin) every two nouns that a path joins.

    a, b: the nouns' places in the row, the earlier first; node: the places of all paths in a row; at: where each path begins.
    """

    def __init__(self, off: np.ndarray, head: np.ndarray, noun: np.ndarray):
        n = len(head)
        size = np.diff(off)
        of = np.repeat(np.arange(len(size)), size)
        place = np.arange(n) - off[:-1][of] + 1
        up = np.where((head >= 1) & (head <= size[of]) & (head != place), off[:-1][of] + head - 1, n)  # n: above every root
        above, depth = np.append(up, n), np.append(up < n, False).astype(np.int64)
        for _ in range(int(size.max(initial=1)).bit_length() + 1):  # steps to the root, by doubling
            depth += depth[above]
            above = above[above]
        cyclic = np.zeros(len(size), bool)
        cyclic[of[above[:n] < n]] = True
        nouns = np.flatnonzero(noun)
        count = np.bincount(of[nouns], minlength=len(size))
        later = np.repeat(np.cumsum(count), count) - np.arange(len(nouns)) - 1  # nouns after each in its n-gram
        first = np.repeat(np.arange(len(nouns)), later)
        second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(later) - later, later)
        a, b = nouns[first], nouns[second]
        pair, order, node = [], [], []
        live = np.flatnonzero(~cyclic[of[a]])
        u, v, step = a[live], b[live], 0
        found = np.zeros(len(a), bool)
        while len(live):  # the deeper goes up, or both, until they meet
            same = u == v
            met = live[same & (u < n)]
            found[met] = True
            pair.append(met)
            order.append(np.full(len(met), step))
            node.append(u[same & (u < n)])
            live, u, v = live[~same], u[~same], v[~same]
            left, right = depth[u] >= depth[v], depth[v] >= depth[u]
            for side, who, sign in ((left, u, 1), (right, v, -1)):
                pair.append(live[side])
                order.append(np.full(int(side.sum()), step if sign > 0 else 4 * n - step))
                node.append(who[side])
            up_n = np.append(up, n)
            u, v = np.where(left, up_n[u], u), np.where(right, up_n[v], v)
            step += 1
        for p in np.flatnonzero(cyclic[of[a]]).tolist():
            lo = int(off[of[a[p]]])
            path = searched(head[lo : int(off[of[a[p]] + 1])].tolist(), int(a[p]) - lo, int(b[p]) - lo)
            if path:
                found[p] = True
                pair.append(np.full(len(path), p))
                order.append(np.arange(len(path)))
                node.append(np.array(path) + lo)
        pair, order, node = (np.concatenate([np.empty(0, np.int64), *x]) for x in (pair, order, node))
        keep = found[pair]  # walks that met nowhere go
        pair, order, node = pair[keep], order[keep], node[keep]
        self.node = node[np.lexsort((order, pair))]
        kept = np.flatnonzero(found)
        self.a, self.b, self.of = a[kept], b[kept], of[a[kept]]
        self.at = np.concatenate([[0], np.cumsum(np.bincount(pair, minlength=len(a))[kept])])
        self.place = place


def _offsets(lists: pa.Array) -> np.ndarray:
    """Where each list's elements begin among lists.flatten()."""
    return np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())]).astype(np.int64)


def _each(words: pa.Array, change: Callable) -> pa.Array:
    """change of every word, called once for each distinct one."""
    coded = pc.dictionary_encode(words)
    return pa.array([change(w) for w in coded.dictionary.to_pylist()]).take(coded.indices) if len(words) else pa.array([], pa.string())


def _flags(words: pa.Array, test: Callable) -> np.ndarray:
    return _each(words, test).to_numpy(zero_copy_only=False).astype(bool) if len(words) else np.zeros(0, bool)


def _pieces(off: np.ndarray, noun: np.ndarray) -> Iterator[tuple[int, int]]:
    """N-grams from ... to, with at most MOST_PAIRS pairs of nouns, or one n-gram with more."""
    k = np.diff(np.concatenate([[0], np.cumsum(noun)])[off])
    so_far = np.concatenate([[0], np.cumsum(k * (k - 1) // 2)])
    a = 0
    while a < len(k):
        b = max(a + 1, int(np.searchsorted(so_far, so_far[a] + MOST_PAIRS, "right")) - 1)
        yield a, b
        a = b


def noun_pair_paths(parsed: DataFrame) -> DataFrame:
    """tokens, cnt, src, dst and path (positions) of every two nouns that a path joins."""
    ship(parsed.sparkSession)
    schema = T.StructType([parsed.schema["tokens"], parsed.schema["cnt"], T.StructField("src", T.IntegerType()), T.StructField("dst", T.IntegerType()), T.StructField("path", PATHS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column(0)
            noun = _flags(tokens.flatten().field("pos"), lambda p: p.startswith("N"))
            for x, y in _pieces(_offsets(tokens), noun):
                own = tokens.slice(x, y - x)
                off, flat = _offsets(own), own.flatten()
                p = Paths(off, flat.field("head").to_numpy(), _flags(flat.field("pos"), lambda q: q.startswith("N")))
                path = pa.ListArray.from_arrays(pa.array(p.at, pa.int32()), pa.array(p.place[p.node], pa.int32()))
                rows = pa.array(p.of + x)
                yield pa.RecordBatch.from_arrays([tokens.take(rows), batch.column(1).take(rows), pa.array(p.place[p.a], pa.int32()), pa.array(p.place[p.b], pa.int32()), path], names=schema.names)

    return parsed.select("tokens", "cnt").mapInArrow(run, schema)


def _rendered(off: np.ndarray, word: pa.Array, pos: pa.Array, dep: pa.Array, head: np.ndarray, cnt: pa.Array, stemmed: bool) -> Iterator[pa.RecordBatch]:
    """The extractions of n-grams in a row."""
    noun, verb = _flags(pos, lambda p: p.startswith("N")), _flags(pos, lambda p: p.startswith("V"))
    preposition, content = _flags(pos, lambda p: p in ("IN", "TO")), verb & ~_flags(word, lambda w: w.lower() in AUX)
    low, stem = _each(word, str.lower), _each(word, porter) if stemmed else word
    label = pc.if_else(pa.array(verb), pc.binary_join_element_wise("V:", stem, ""), pc.binary_join_element_wise(pc.if_else(pa.array(preposition), "P:", "W:"), low, ""))
    for x, y in _pieces(off, noun):
        lo, hi = int(off[x]), int(off[y])
        p = Paths(off[x : y + 1] - lo, head[lo:hi], noun[lo:hi])
        size = np.diff(p.at)
        good = np.add.reduceat(content[lo:hi][p.node], p.at[:-1]) > 0 if len(size) else np.zeros(0, bool)
        node = p.node[np.repeat(good, size)]
        a, b, of, size = p.a[good], p.b[good], p.of[good], size[good]
        at = np.concatenate([[0], np.cumsum(size)])
        inner = np.ones(len(node), bool)
        inner[at[:-1]], inner[at[1:] - 1] = False, False
        last = np.zeros(len(node), bool)
        last[at[1:] - 1] = True
        then = np.append(node[1:], 0)[: len(node)]
        goes_up = head[lo:hi][node] == p.place[then]
        names = pc.if_else(pa.array(inner), label.take(pa.array(node + lo)), "N")
        relation = pc.if_else(pa.array(goes_up), pc.binary_join_element_wise(":<", dep.take(pa.array(node + lo)), ":", ""), pc.binary_join_element_wise(":>", dep.take(pa.array(then + lo)), ":", ""))
        parts = pc.binary_join_element_wise(names, pc.if_else(pa.array(last), "", relation), "")
        path = pc.binary_join(pa.ListArray.from_arrays(pa.array(at, pa.int32()), parts), "")
        yield pa.RecordBatch.from_arrays([path, stem.take(pa.array(a + lo)), stem.take(pa.array(b + lo)), cnt.take(pa.array(of + x))], names=EXTRACTED.names)


def _number(text: str) -> int | None:
    """A whole number of 32 bits, or None."""
    return int(text) if re.fullmatch("[+-]?[0-9]+", text, re.A) and -(2**31) <= int(text) < 2**31 else None


def split_tokens(ngrams: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array, pa.Array, np.ndarray]:
    """Tokens of n-grams, as parse_tokens has them: where each n-gram's begin, and words, tags, relations and heads."""
    lists = pc.split_pattern(pc.fill_null(ngrams, ""), " ")
    of, tokens = pc.list_parent_indices(lists).to_numpy(), lists.flatten()
    keep = pc.greater_equal(pc.count_substring(tokens, "/"), 3)
    of, tokens = of[keep.to_numpy(zero_copy_only=False)], tokens.filter(keep)
    parts = pc.split_pattern(tokens, "/", max_splits=3, reverse=True).flatten()
    word, pos, dep, head = (parts.take(pa.array(np.arange(k, len(parts), 4))) for k in range(4))
    number = _each(head, _number).cast(pa.int32()) if len(head) else pa.array([], pa.int32())
    valid = number.is_valid()
    of = of[valid.to_numpy(zero_copy_only=False)]
    return np.searchsorted(of, np.arange(len(ngrams) + 1)), word.filter(valid), pos.filter(valid), dep.filter(valid), number.filter(valid).to_numpy().astype(np.int64)


def extract_ngrams(lines: DataFrame, stemmed: bool = True) -> DataFrame:
    """path, x, y and cnt of every two nouns of each n-gram (ngram, cnt) whose path holds a content verb; x is the earlier noun."""
    ship(lines.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _rendered(*split_tokens(b.column(0).cast(pa.string())), b.column(1), stemmed)

    return lines.select("ngram", F.col("cnt").cast("long")).mapInArrow(run, EXTRACTED)


def extract_paths(parsed: DataFrame, stemmed: bool = True) -> DataFrame:
    """The same of tokens that are parsed already (tokens, cnt)."""
    ship(parsed.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column(0).flatten()
            yield from _rendered(_offsets(b.column(0)), *[flat.field(c).cast(pa.string()) for c in ("word", "pos", "dep")], flat.field("head").to_numpy().astype(np.int64), b.column(1), stemmed)

    return parsed.select("tokens", F.col("cnt").cast("long")).mapInArrow(run, EXTRACTED)
