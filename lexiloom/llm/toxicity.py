"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on windows of toxic texts and one on windows of ordinary texts. Every text
is cut into windows of WINDOW_WORDS words; each window is compressed under both, and the difference in length (bytes
that the toxic dictionary saves) is its evidence. A text's features are how many of its windows save at least so many
bytes, for a few thresholds, and the largest saving; a logistic calibration on held-in texts turns them into a score.

Training is alike for both classes, on whole windows. As most windows of a toxic text are ordinary, it goes in rounds:
texts are dealt into two folds, dictionaries of one fold (at first its windows as they are) measure the windows of the
other, and the toxic side goes on with the windows that save more than all but RARE of the ordinary texts' windows do,
the ordinary side with as many windows of its own, picked by a hash. Windows with a run of RUN words that another text
has too, copies, are not trained on. Both dictionaries have one size, a part of what they are trained on, and both stand
before the same common stock, a dictionary trained on ordinary text, so that what they share costs the same on both
sides. The round whose cross-fitted features tell the held-in classes apart best (area under the curve) is kept.

Defined cases: null and empty texts have no windows and get the score of a text without evidence; a text with no
white space is one window a WINDOW_BYTES piece; a text of any length is read whole; texts alike get scores alike, so
ties and repeated rows do; with fewer than two texts of a class to learn from every score is the share of toxic labels
(0 without labels); an empty table gives an empty result. Extra columns, of any names, pass through where asked for; a
result column replaces one of its name.

Scale: labelled texts are sampled by a hash, at most `sample` rows a class (a documented bound on what is fitted, see
common.sample_texts); the dictionaries, of at most some 200 KB, are broadcast. Scoring is one pass, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F, types as T

from .common import LOWER, arrow_map, buffers, crc_mod, gram_hashes, labelled_texts, mask_of, mix64, word_bounds, word_hashes

WORD = mask_of([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
WINDOW_WORDS = 8
WINDOW_BYTES = 128
#: Bytes of the common stock.
STOCK = 110_000
#: A class's dictionary has a byte for so many bytes that it is trained on, and LEAST bytes at least.
PER_BYTE, LEAST = 12, 1024
#: Bytes of each class's windows in the first round, when they are taken as they are.
START = 60_000
#: Share of ordinary texts' windows that may save as much as a window the toxic side goes on with.
RARE = 0.003
RUN = 4
ROUNDS = 3
#: How many toxic texts may be missed for one ordinary text that is not marked.
COST = 4
#: A hash chain long enough to find matches in all of a dictionary.
SETTINGS = {"strategy": zstandard.STRATEGY_LAZY2, "window_log": 19, "hash_log": 17, "chain_log": 17, "search_log": 7, "min_match": 4, "target_length": 16}
FRAME = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
THRESHOLDS = (2, 4, 6, 8, 10)
SAMPLE = 1500


def windows(texts: pa.Array) -> tuple[list[bytes], np.ndarray]:
    """Lower-cased windows of all texts, with spaces for what stands between words, and the text of each window."""
    data, off = buffers(texts)
    low = LOWER[data]
    starts, ends = word_bounds(low, off, WORD)
    first = np.searchsorted(starts, off)
    count = np.diff(first)
    doc = np.repeat(np.arange(len(texts)), count)
    low = np.where(WORD[low], low, np.uint8(32))
    place = np.arange(len(starts)) - np.repeat(first[:-1], count)
    begin = np.flatnonzero(place % WINDOW_WORDS == 0)
    last = np.minimum(np.append(begin[1:], len(starts))[: len(begin)], len(starts)) - 1
    raw = low.tobytes()
    out, of = [], []
    for a, b, d in zip(starts[begin].tolist(), ends[last].tolist() if len(begin) else [], doc[begin].tolist()):
        if b - a <= 2 * WINDOW_BYTES:
            out.append(raw[a:b])
            of.append(d)
        else:
            for i in range(a, b, WINDOW_BYTES):
                out.append(raw[i : min(b, i + WINDOW_BYTES)])
                of.append(d)
    return out, np.array(of, np.int64)


def copied(texts: Sequence[str]) -> list[bool]:
    """Of each window of the texts: has it a run of RUN words that another text has too?"""
    own, of = windows(pa.array(texts, pa.large_string()))
    data = np.frombuffer(b"\n".join(own), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(w) + 1 for w in own])])[:-1] if own else np.zeros(1, np.int64)
    off = np.append(off, len(data)) if own else off
    starts, ends = word_bounds(data, off, WORD)
    grams = gram_hashes(word_hashes(data, starts, ends), RUN)
    window = np.searchsorted(off, starts, "right") - 1
    whole = np.flatnonzero(window[: len(grams)] == window[RUN - 1 :]) if len(grams) else np.empty(0, np.int64)
    grams, window = grams[whole], window[whole]
    _, number = np.unique(grams, return_inverse=True)
    text = of[window]
    low, high = np.full(len(grams) + 1, len(texts)), np.full(len(grams) + 1, -1)
    np.minimum.at(low, number, text)
    np.maximum.at(high, number, text)
    out = np.zeros(len(own), bool)
    out[window[low[number] != high[number]]] = True
    return out


class Model:
    """Both dictionaries, and the calibration."""

    def __init__(self, toxic: Sequence[str], ordinary: Sequence[str]):
        self.share = len(toxic) / max(1, len(toxic) + len(ordinary))
        self.weights = None
        if len(toxic) < 2 or len(ordinary) < 2:
            return
        n = len(toxic)
        texts = [*toxic, *ordinary]
        own, of = windows(pa.array(texts, pa.large_string()))
        if not own:
            return
        bad, fold = of < n, of % 2
        if not bad.any() or bad.all():
            return
        fresh = ~copied(texts)
        order = np.argsort(mix64(np.arange(1, len(own) + 1, dtype=np.uint64)))  # windows in the order of a hash
        self.stock = trained([own[i] for i in order[~bad[order]].tolist()], STOCK, together=8)
        y = np.concatenate([np.ones(n), np.zeros(len(ordinary))])
        picked, best = fresh.copy(), -1.0
        for r in range(ROUNDS + 1):
            train = (lambda ws: b" ".join(ws)[:START]) if not r else (lambda ws: trained(ws, max(LEAST, sum(map(len, ws)) // PER_BYTE)))
            saved = np.zeros(len(own), np.int64)
            for k in (0, 1):
                self.learn(*[[own[i] for i in order[(picked & (bad == side) & (fold != k))[order]].tolist()] for side in (True, False)], train)
                here = np.flatnonzero(fold == k)
                saved[here] = self.savings([own[i] for i in here.tolist()])
            x = self.of_savings(saved, of, len(texts))
            weights = logistic(x, y)
            if r and (area := ranked(x @ weights, y)) > best:
                best, self.weights = area, weights
                self.learn(*[[own[i] for i in order[(picked & (bad == side))[order]].tolist()] for side in (True, False)], train)
                kept = self.dictionaries
            cut = max(1, float(np.quantile(saved[fresh & ~bad], 1 - RARE))) if (fresh & ~bad).any() else 1
            chosen = fresh & bad & (saved > cut)
            if chosen.sum() < 2:
                chosen = fresh & bad
            plain = order[(fresh & ~bad)[order]][: max(2, int(chosen.sum()))]
            picked = chosen.copy()
            picked[plain] = True
        self.dictionaries = kept
        del self.stock
        self.__dict__.pop("_made", None)

    def learn(self, toxic: list[bytes], ordinary: list[bytes], train) -> None:
        """Dictionaries of one size from whole windows of each class, each before the common stock."""
        sides = [train(toxic), train(ordinary)]
        size = min(map(len, sides))
        self.dictionaries = [x[len(x) - size :] + self.stock for x in sides]
        self.__dict__.pop("_made", None)

    def compressors(self) -> list:
        """Under the toxic and the ordinary dictionary."""
        if not hasattr(self, "_made"):
            self._made = []
            for content in self.dictionaries:
                how = zstandard.ZstdCompressionParameters(**SETTINGS, **FRAME)
                d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(compression_params=how)
                self._made.append(zstandard.ZstdCompressor(dict_data=d, compression_params=how))
        return self._made

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_made"}

    def savings(self, own: list[bytes]) -> np.ndarray:
        """Bytes that each window, between spaces, saves under the toxic dictionary."""
        lengths = []
        own = [b" " + w + b" " for w in own]
        for c in self.compressors():
            one = c.compress
            lengths.append(np.fromiter((len(one(w)) for w in own), np.int64, len(own)))
        return lengths[1] - lengths[0]

    @staticmethod
    def of_savings(saved: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
        """The features of n texts from their windows' savings."""
        count = np.bincount(of, minlength=n)
        most = np.full(n, -8, np.int64)
        np.maximum.at(most, of, saved)
        columns = [np.clip(most, -8, 24) / 8]
        for t in THRESHOLDS:
            k = np.bincount(of[saved >= t], minlength=n)
            columns += [np.log1p(k), k / np.maximum(count, 1) * 10]
        return np.stack([np.ones(n), np.log1p(count) / 4, *columns], 1)

    def features(self, texts: pa.Array) -> np.ndarray:
        own, of = windows(texts)
        return self.of_savings(self.savings(own) if own else np.empty(0, np.int64), of, len(texts))

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.share)
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ self.weights, -30, 30)))


def trained(samples: list[bytes], size: int, together: int = 1) -> bytes:
    """A zstandard dictionary trained on the samples, `together` of them at a time; too few samples are taken as they are."""
    joined = [b" " + b" ".join(samples[i : i + together]) + b" " for i in range(0, len(samples), together)]
    try:
        return zstandard.train_dictionary(size, joined, k=16 if together == 1 else 32, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(joined)[-size:]


def ranked(score: np.ndarray, y: np.ndarray) -> float:
    """The area under the curve: how often a row of class 1 scores above one of class 0, ties by half."""
    _, place, count = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(count) - (count - 1) / 2)[place]
    a, b = (y == 1).sum(), (y == 0).sum()
    return float((rank[y == 1].sum() - a * (a + 1) / 2) / (a * b))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 30) -> np.ndarray:
    """Weights of a ridge logistic regression (Newton steps): classes of one size, an error on class 0 as dear as COST on class 1."""
    w = np.zeros(x.shape[1])
    each = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 * COST / max(1, (y == 0).sum())) * len(y)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (each * (p - y)) + ridge * w
        h = (x * (each * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", sample: int = SAMPLE, **bounds) -> Model:
    """A model from at most `sample` labelled rows of each class (see common.sample_texts for the bounds)."""
    rows = labelled_texts(docs, labels, label, text, doc_id, sample, **bounds)
    return Model([t for t, y in rows if y == 1], [t for t, y in rows if y == 0])


def score_toxicity(docs: DataFrame, model: Model, *, keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """Columns keep of docs, and score: 0 to 1, higher for likelier toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = shared.value
        return lambda texts: [own.score(texts)]

    return arrow_map(docs, keep, text, make, [T.StructField("score", T.DoubleType())])


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, labels.filter(crc_mod("doc_id", 5) != 0))
    out = score_toxicity(docs, model)
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
