"""Quality by nearest-neighbour voting in a latent-semantic space.

A text's terms are hashed byte trigrams of its lower-cased words, hashed byte pairs of its raw form (which show case,
symbols and layout), and how often a word repeats the one before it. Counts are damped, weighted by inverse document
frequency and normed. The space is spanned by the leading right singular vectors of the labelled sample's matrix.
Labelled vectors are broadcast; every text's vector is multiplied with all of them, block by block, and its NEAREST
neighbours vote with their cosines (negative ones with none), each class weighted by the inverse of its share.

Defined cases: null and empty texts have the zero vector, whose neighbours all have cosine 0: they get the score of a
vote without neighbours, 0.5; ties between neighbours go to the one that comes first in the sorted sample; texts
alike get scores alike, so repeated rows do; a text of any length is read whole; with labels of one class only every score
is that class, without labels 0; an empty table gives an empty result. Extra columns, of any names, pass through where
asked for; a result column replaces one of its name.

Scale: labelled texts are sampled by a hash, at most `sample` rows a class (a documented bound, see
common.sample_texts); the broadcast is
TERMS x RANK + sample x RANK numbers. Scoring is one pass, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import LOWER, arrow_map, buffers, crc_mod, labelled_texts, mask_of, word_bounds, word_hashes

SPACE = mask_of([0x20, *range(0x09, 0x0E)])
GRAMS, PAIRS = 4096, 2048
TERMS = GRAMS + PAIRS + 1
RANK = 48
NEAREST = 15
SAMPLE = 1200
BLOCK = 256


def counts(texts: pa.Array) -> np.ndarray:
    """A row of term counts for each text."""
    data, off = buffers(texts)
    n = len(texts)
    out = np.zeros((n, TERMS), np.float32)
    if not len(data):
        return out
    doc = np.repeat(np.arange(n), np.diff(off))
    low = LOWER[data].astype(np.uint32)
    for a, b in ((i, min(n, i + BLOCK)) for i in range(0, n, BLOCK)):
        lo, hi = int(off[a]), int(off[b])
        if hi - lo > 2:
            w, d = low[lo:hi], doc[lo:hi] - a
            same = d[2:] == d[:-2]
            h = ((w[:-2] * 31 + w[1:-1]) * 131 + w[2:]) * np.uint32(2654435761) >> np.uint32(20)
            out[a:b, :GRAMS] = np.bincount((d[2:] * GRAMS + h)[same], minlength=(b - a) * GRAMS).reshape(b - a, GRAMS)
        if hi - lo > 1:
            # letters of a case, digits and other classes stand for themselves, so that form shows
            w, d = _SHAPE[data[lo:hi]], doc[lo:hi] - a
            same = d[1:] == d[:-1]
            h = (w[:-1] * 45 + w[1:]).astype(np.int64)
            out[a:b, GRAMS:-1] = np.bincount((d[1:] * PAIRS + h)[same], minlength=(b - a) * PAIRS).reshape(b - a, PAIRS)
    starts, ends = word_bounds(data, off, SPACE)
    words = word_hashes(LOWER[data], starts, ends)
    if len(words) > 1:
        of = doc[starts]
        again = (words[1:] == words[:-1]) & (of[1:] == of[:-1])
        out[:, -1] = np.bincount(of[1:][again], minlength=n)
    return out


#: Byte classes: each ASCII symbol, then digits, lower case, upper case, the rest.
_SHAPE = np.full(256, 44, np.int32)
_SHAPE[[*range(48, 58)]], _SHAPE[[*range(97, 123)]], _SHAPE[[*range(65, 91)]] = 41, 42, 43
_symbols = [c for c in range(256) if c < 128 and not chr(c).isalnum() and (c > 31 or c in (9, 10, 13))]
_SHAPE[_symbols] = np.arange(len(_symbols)) % 41


class Model:
    def __init__(self, texts: Sequence[str], labels: Sequence[int]):
        order = sorted(range(len(texts)), key=lambda i: (texts[i], labels[i]))
        y = np.array([labels[i] for i in order], np.float32)
        self.only = float(y.mean()) if len(y) else 0.0
        self.labels = None
        if not 0 < self.only < 1:
            return
        raw = np.zeros((len(order), TERMS), np.float32)
        i = 0
        while i < len(order):
            raw[i : i + BLOCK] = counts(pa.array([texts[k] for k in order[i : i + BLOCK]], pa.large_string()))
            i += BLOCK
        self.idf = np.log((1 + len(raw)) / (1 + (raw > 0).sum(0))).astype(np.float32) + 0.1
        x = self.weighted(raw)
        self.axes = leading(x, RANK)
        self.vectors = self.normed(x @ self.axes)
        self.labels = y
        self.weight = np.where(y == 1, 0.5 / self.only, 0.5 / (1 - self.only)).astype(np.float32)

    def weighted(self, raw: np.ndarray) -> np.ndarray:
        """Damped, weighted and normed counts; each family of terms has a norm of its own."""
        x = np.log1p(raw) * self.idf
        x[:, :GRAMS] = self.normed(x[:, :GRAMS])
        x[:, GRAMS:-1] = self.normed(x[:, GRAMS:-1])
        x[:, -1] = 3 * raw[:, -1] / (8 + raw[:, GRAMS:-1].sum(1) / 6)
        return self.normed(x)

    @staticmethod
    def normed(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.labels is None:
            return np.full(len(texts), self.only)
        out = np.empty(len(texts))
        for a in range(0, len(texts), BLOCK):
            v = self.normed(self.weighted(counts(texts.slice(a, BLOCK))) @ self.axes)
            cosines = v @ self.vectors.T
            k = min(NEAREST, cosines.shape[1])
            near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
            w = np.maximum(np.take_along_axis(cosines, near, 1), 0) ** 2 * self.weight[near]
            total = w.sum(1)
            out[a : a + BLOCK] = np.where(total > 1e-9, (w * self.labels[near]).sum(1) / np.maximum(total, 1e-9), 0.5)
        return np.clip(out, 0, 1)


def leading(x: np.ndarray, rank: int, seed: int = 3, rounds: int = 6) -> np.ndarray:
    """The leading right singular vectors of x, as columns, by subspace iteration."""
    q = np.random.default_rng(seed).standard_normal((x.shape[1], min(rank + 16, *x.shape))).astype(np.float32)
    for _ in range(rounds):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    return np.ascontiguousarray((q @ v.T)[:, :rank])


def fit(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", label: str = "quality", sample: int = SAMPLE, **bounds) -> Model:
    """A model from at most `sample` labelled rows of each class (see common.sample_texts for the bounds)."""
    rows = labelled_texts(docs, labels, label, text, doc_id, sample, **bounds)
    return Model([t for t, _ in rows], [y for _, y in rows])


def score_quality(docs: DataFrame, model: Model, *, keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """Columns keep of docs, and score: 0 to 1, higher for likelier good."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = shared.value
        return lambda texts: [own.score(texts)]

    return arrow_map(docs, keep, text, make, [T.StructField("score", T.DoubleType())])


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = score_quality(docs, fit(docs, labels.filter(crc_mod("doc_id", 3) != 1)))
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
