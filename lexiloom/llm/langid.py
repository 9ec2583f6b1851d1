"""Language identification: a linear-chain conditional random field over the words of code-switched text.

Each line of a text is a chain of words (runs of letters, lower-cased). A word's emission score for each language is
the sum of learned weights of its affixes, of its character n-grams (both hashed into tables), of its capitals-free
lexicon entry, and a bias; learned transitions link neighbours. Forward-backward gives every word a distribution over
languages. A text's language is the one with most expected letters, and the score is that share; its confidence is the
mean, over letters, of the probability of the word's likeliest language, whichever that is.

Training maximises the chains' conditional likelihood by Adam on about `sample` whole labelled texts a language.
Chains for training are spliced from pieces of texts in different languages now and then, so that transitions see
code switching; a word is labelled with its text's language. The lexicon holds the words seen often enough.

Defined cases: a null text, or one with no letter, is `und` with score and confidence 0; ties go to the language that
sorts first; with no labelled text every text with a letter is `und`; repeated rows get equal results; an empty table
gives an empty result; a text or line of any length is labelled whole. Extra columns, of any names, pass through where
asked for; a result column replaces one of its name.

Scale: one pass, no shuffle. The sample is bounded by `sample` rows a language and by common.sample_texts's rows and
bytes in all; every language is learned. The model's tables have a fixed size a language and are broadcast. Work is done
on each slice's distinct words, then on chains side by side, a long one in blocks that run side by side too.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from .common import _BASE, arrow_map, buffers, col, crc_mod, mix64, numbered, sample_texts

TABLE = 1 << 15
LEXICON = 20_000
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*|\n")
UND = "und"
#: Words that a chain is cut into for running side by side.
BLOCK = 128
#: Words whose features are made at once.
PIECE = 8192
FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("confidence", T.DoubleType())]


def features(words: Sequence[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all words in a row, and where each word's begin.

    n-grams of 1 to 4 letters of the word between its boundary marks, prefixes and suffixes of up to 4, the lexicon
    entry, and a bias; the first TABLE * 2 numbers are hashed.
    """
    n = len(words)
    if not n:
        return np.empty(0, np.int64), np.zeros(1, np.int64)
    joined = "".join([f"\x02{w}\x03" for w in words])
    c = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64)
    length = np.fromiter(map(len, words), np.int64, n) + 2
    begin = np.concatenate([[0], np.cumsum(length)[:-1]])
    of = np.repeat(np.arange(n), length)
    place = np.arange(len(c)) - begin[of]
    left = length[of] - place
    out, owner = [], []
    with np.errstate(over="ignore"):
        h = np.zeros(len(c), np.uint64)
        for k in range(1, 5):
            h = h[: len(c) - k + 1] * _BASE + c[k - 1 :]
            ok = left[: len(h)] >= k
            if k == 1:
                ok = ok & (c > 3)
            x = mix64(h * np.uint64(8) + np.uint64(k)) >> np.uint64(49)
            out.append(x[ok].astype(np.int64))
            owner.append(of[: len(h)][ok])
            edge = mix64(h * np.uint64(8) + np.uint64(k + 4)) >> np.uint64(49)
            if k > 1:
                pre, suf = place[: len(h)] == 0, left[: len(h)] == k
                sel = pre | suf
                out.append(TABLE + edge[sel].astype(np.int64))
                owner.append(of[: len(h)][sel])
    known = np.fromiter((lexicon.get(w, -1) for w in words), np.int64, n)
    out += [2 * TABLE + 1 + known[known >= 0], np.full(n, 2 * TABLE, np.int64)]
    owner += [np.flatnonzero(known >= 0), np.arange(n)]
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(out)[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])


def pieces(words: Sequence[str], lexicon: dict[str, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """features() of PIECE words at a time, which bounds what it holds besides its results."""
    for i in range(0, len(words), PIECE):
        f, at = features(words[i : i + PIECE], lexicon)
        yield f.astype(np.int32), at


def forward_backward(emit: np.ndarray, first: np.ndarray, length: np.ndarray, move: np.ndarray, start: np.ndarray, pairs: bool = False):
    """Marginals of every word (and, if asked for, expected transitions and log-likelihood's normaliser).

    emit: scores of the words of all chains in a row; first, length: where each chain is. Chains run side by side,
    longest first, each step on those that are that long.
    """
    n, k = emit.shape
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    steps = int(length[0]) if len(length) else 0
    active = np.searchsorted(-length, -np.arange(steps), "left")  # chains longer than t
    peak = emit.max(1)
    e = np.exp(emit - peak[:, None])
    a = np.empty_like(e)
    scale = np.empty(n, e.dtype)
    go = np.exp(move).astype(e.dtype)
    cur = None
    for t in range(steps):
        at = first[: active[t]] + t
        cur = e[at] * (np.exp(start).astype(e.dtype) if t == 0 else cur[: len(at)] @ go)
        s = cur.sum(1)
        cur = cur / s[:, None]
        a[at], scale[at] = cur, s
    b = np.empty_like(e)
    expected = np.zeros((k, k))
    nxt = None
    for t in range(steps - 1, -1, -1):
        at = first[: active[t]] + t
        now = np.ones((len(at), k), e.dtype)
        if t + 1 < steps and active[t + 1]:
            m = active[t + 1]
            w = e[at[:m] + 1] * nxt / scale[at[:m] + 1][:, None]
            now[:m] = w @ go.T
            if pairs:
                expected += (a[at[:m]].T.astype(np.float64) @ w) * go
        b[at] = nxt = now
    marginal = a * b
    marginal /= marginal.sum(1, keepdims=True)
    return (marginal, expected, float(np.log(scale).sum() + peak.sum())) if pairs else marginal


def marginals(emit: np.ndarray, first: np.ndarray, length: np.ndarray, move: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The marginals of forward_backward for chains of any length: it steps over a block's words and a chain's blocks, not a chain's words.

    Chains are cut into blocks. The product of a block's transitions and emissions, all blocks side by side, carries a
    message over it; so the messages at borders are found block by block, then those inside of all blocks side by side.
    """
    n, k = emit.shape
    e = np.exp(emit - emit.max(1, keepdims=True))
    go, begin = np.exp(move).astype(e.dtype), np.exp(start).astype(e.dtype)
    parts = -(-length // BLOCK)
    head = np.cumsum(parts) - parts  # a chain's first block
    chain = np.repeat(np.arange(len(first)), parts)
    at = first[chain] + (np.arange(len(chain)) - head[chain]) * BLOCK
    size = np.minimum(BLOCK, first[chain] + length[chain] - at)
    order = np.argsort(-size, kind="stable")  # blocks, longest first
    steps = int(size.max(initial=0))
    active = np.searchsorted(-size[order], -np.arange(steps), "left")
    normed = lambda x: x / np.maximum(x.sum(-1, keepdims=True), 1e-30)
    into, behind = np.tile(begin, (len(at), 1)), np.ones((len(at), k), e.dtype)  # messages to a block's first word, and to its last from behind
    if len(parts) and parts.max() > 1:
        long = order[parts[chain[order]] > 1]
        carry = np.zeros((len(at), k, k), e.dtype)
        carry[long] = np.eye(k)
        for t in range(1, steps):
            on = long[: np.searchsorted(-size[long], -t, "left")]
            c = carry[on] @ go * e[at[on] + t][:, None, :]
            carry[on] = c / np.maximum(c.sum((1, 2), keepdims=True), 1e-30)
        for b in range(1, int(parts.max())):
            here = head[parts > b] + b
            into[here] = normed(np.einsum("ij,ijk->ik", into[here - 1] * e[at[here - 1]], carry[here - 1]) @ go)
        for b in range(int(parts.max()) - 1, 0, -1):
            here = head[parts > b] + b
            behind[here - 1] = normed((e[at[here]] * np.einsum("ijk,ik->ij", carry[here], behind[here])) @ go.T)
    a, cur = np.empty_like(e), None
    for t in range(steps):
        own = order[: active[t]]
        cur = normed(e[at[own] + t] * (into[own] if t == 0 else cur[: len(own)] @ go))
        a[at[own] + t] = cur
    nxt = None
    for t in range(steps - 1, -1, -1):
        own = order[: active[t]]
        now = behind[own].copy()
        if t + 1 < steps and (m := active[t + 1]):
            now[:m] = normed((e[at[own[:m]] + t + 1] * nxt) @ go.T)
        a[at[own] + t] *= now
        nxt = now
    return normed(a)


class Model:
    def __init__(self, texts: Sequence[tuple[str, str]], rounds: int = 8, seed: int = 5):
        self.languages = sorted({x for _, x in texts})
        k = len(self.languages)
        self.lexicon: dict[str, int] = {}
        if not k:
            return
        number = {x: i for i, x in enumerate(self.languages)}
        chains = []
        for t, lang in sorted(texts):
            for line in (t.lower()).split("\n"):
                words = WORD.findall(line)
                chains += [(words[i : i + 40], number[lang]) for i in range(0, len(words), 40)]
        seen = [Counter() for _ in range(k)]
        for words, y in chains:
            seen[y].update(words)
        total = sum(seen, Counter())
        self.lexicon = {w: i for i, (w, c) in enumerate(sorted(total.items(), key=lambda p: (-p[1], p[0]))[:LEXICON]) if c >= 20}
        number_of: dict[str, int] = {}
        chains = [([number_of.setdefault(w, len(number_of)) for w in words], y) for words, y in chains]
        made = list(pieces(list(number_of), self.lexicon))
        self._features = np.concatenate([np.empty(0, np.int32), *[f for f, _ in made]])
        self._at = np.concatenate([[0], np.cumsum(np.concatenate([np.empty(0, np.int64), *[np.diff(at) for _, at in made]]))])
        del made, texts, seen, total, number_of
        rng = np.random.default_rng(seed)
        rng.shuffle(chains)
        self.table = np.zeros((2 * TABLE + 1 + LEXICON, k), np.float32)
        self.move, self.start = np.zeros((k, k)), np.zeros(k)
        self._place = np.zeros(len(self.table), np.int64)
        params = [self.table, self.move, self.start]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        step, size = 0, 128
        for r in range(rounds):
            order = rng.permutation(len(chains))
            for i in range(0, len(order), size):
                words, ys, lengths = [], [], []
                pick = order[i : i + size]
                j = 0
                while j < len(pick):
                    w, y = chains[pick[j]]
                    own, lab = list(w), [y] * len(w)
                    if rng.random() < 0.3 and j + 1 < len(pick):  # code switching: two pieces in one chain
                        j += 1
                        w2, y2 = chains[pick[j]]
                        cut = int(rng.integers(1, 12))
                        own, lab = own[:20] + w2[:cut] + own[20:], lab[:20] + [y2] * len(w2[:cut]) + lab[20:]
                    j += 1
                    if own:
                        words += own
                        ys += lab
                        lengths.append(len(own))
                if not words:
                    continue
                step += 1
                self._step(np.array(words), np.array(ys), np.array(lengths), params, moments, step, 0.05 * 0.75**r)
        del self._features, self._at, self._place
        self.table *= 0.5  # softer than the fit, which sees few distinct texts

    def _step(self, words, ys, lengths, params, moments, step, rate):
        k = len(self.languages)
        ids, inverse = np.unique(words, return_inverse=True)  # of the words' features only those rows of the table are read and changed
        lo, hi = self._at[ids], self._at[ids + 1]
        count = hi - lo
        begin = np.cumsum(count) - count
        f = self._features[np.repeat(lo - begin, count) + np.arange(count.sum())]
        used = np.flatnonzero(np.bincount(f, minlength=len(self.table)))
        self._place[used] = np.arange(len(used))
        emit = (np.add.reduceat(self.table[f], begin, axis=0) / 4)[inverse]
        f = self._place[f]
        first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        marginal, expected, _ = forward_backward(emit.astype(np.float64), first, lengths, self.move, self.start, True)
        error = marginal.copy()
        error[np.arange(len(ys)), ys] -= 1
        spread = np.repeat(np.stack([np.bincount(inverse, error[:, c], minlength=len(ids)) for c in range(k)], 1), count, axis=0) / 4
        g = np.stack([np.bincount(f, spread[:, c], minlength=len(used)) for c in range(k)], 1)
        inner = np.ones(len(ys), bool)
        inner[first] = False
        seen = np.zeros((k, k))
        np.add.at(seen, (ys[np.flatnonzero(inner) - 1], ys[inner]), 1)
        begun = marginal[first].sum(0) - np.bincount(ys[first], minlength=k)
        n = len(words)
        for i, (grad, rows) in enumerate(((g / n, used), ((expected - seen) / n, slice(None)), (begun / n, slice(None)))):
            p, (m, v) = params[i], moments[i]
            own = p[rows]
            grad = grad + 1e-6 * own
            new_m, new_v = 0.9 * m[rows] + 0.1 * grad, 0.99 * v[rows] + 0.01 * grad * grad
            m[rows], v[rows] = new_m, new_v
            p[rows] = own - rate * (new_m / (1 - 0.9**step)) / (np.sqrt(new_v / (1 - 0.99**step)) + 1e-7)

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Of each text its language, score and confidence."""
        n, k = len(texts), len(self.languages)
        data, off = buffers(texts)
        raw = data.tobytes()
        tokens: list[str] = []
        count = np.zeros(n, np.int64)
        for i, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
            own = WORD.findall(raw[a:b].decode().lower())
            count[i] = len(own)
            tokens += own
        if not tokens or not k:
            return [UND] * n, np.zeros(n), np.zeros(n)
        number: dict[str, int] = {}
        code = np.fromiter((number.setdefault(t, len(number)) for t in tokens), np.int64, len(tokens))
        ids = list(number)
        emit = np.concatenate([np.add.reduceat(self.table[f], at[:-1], axis=0) / 4 for f, at in pieces(ids, self.lexicon)])
        letters = np.fromiter(map(len, ids), np.int64, len(ids))
        doc = np.repeat(np.arange(n), count)
        real = code != number.get("\n", -1)
        edge = np.ones(len(code), bool)  # a chain begins after a line's end, and with each text
        edge[1:] = ~real[:-1] | (doc[1:] != doc[:-1])
        chain = np.cumsum(edge)
        code, doc, chain = code[real], doc[real], chain[real]
        if not len(code):
            return [UND] * n, np.zeros(n), np.zeros(n)
        first = np.flatnonzero(np.diff(chain, prepend=-1))
        length = np.diff(np.append(first, len(code)))
        marginal = marginals(emit[code], first, length, self.move, self.start)
        weight = letters[code]
        votes = np.stack([np.bincount(doc, marginal[:, c] * weight, minlength=n) for c in range(k)], 1)
        total = votes.sum(1)
        best = np.argmax(np.round(votes, 6), 1)
        score = np.clip(votes[np.arange(n), best] / np.maximum(total, 1e-9), 0, 1)
        sure = np.clip(np.bincount(doc, marginal.max(1) * weight, minlength=n) / np.maximum(total, 1e-9), 0, 1)
        return [self.languages[b] if t > 0 else UND for b, t in zip(best.tolist(), total.tolist())], np.where(total > 0, score, 0.0), np.where(total > 0, sure, 0.0)


def fit(docs: DataFrame, *, text: str = "text", label: str = "lang", doc_id: str = "doc_id", sample: int = 250, **bounds) -> Model:
    """A model from about `sample` whole labelled texts of each language (see common.sample_texts for the bounds)."""
    docs = docs.select(col(doc_id).alias("id"), col(text).alias("body"), col(label).cast("string").alias("label"))
    return Model(sample_texts(docs, "label", "body", "id", sample, **bounds))


def identify(docs: DataFrame, model: Model, *, keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """Columns keep of docs, with lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = shared.value
        return lambda texts: list(own.predict(texts))

    return arrow_map(docs, keep, text, make, FIELDS)


def accept(docs: DataFrame, model: Model, *, text: str = "text", least: float = 0.5) -> DataFrame:
    """docs, same columns, without those whose language is `und` or whose confidence is below least.

    A text is judged by how sure its words' labels are, not by one language's share, so one that switches between many
    languages stays. Null and letterless texts go; repeated rows stay or go together; other columns may be null; an empty
    table gives an empty one.
    """
    source, names = numbered(docs)
    out = identify(source, model, keep=list(names.values()), text=names[text])
    return out.filter((F.col("lang_pred") != UND) & (F.col("confidence") >= least)).select(*[F.col(n).alias(c) for c, n in names.items()])


def learnable(docs: DataFrame) -> DataFrame:
    """Rows that the contract allows to learn from."""
    return docs.filter(crc_mod("doc_id", 4) != 2)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(docs, fit(learnable(docs)))
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
