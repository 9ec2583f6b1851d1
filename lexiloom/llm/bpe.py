"""Byte-level BPE encoding and decoding with a given vocabulary of ranks.

Two tiers. A minimal perfect hash (hash and displace: one displacement a bucket, exactly as many slots as tokens)
resolves a pre-token that is in the vocabulary as a whole; the stored bytes confirm it. Any other pre-token is
merged from single bytes, held in a doubly linked list, by a heap of (rank, position): the lowest rank goes first,
the leftmost among equals, and entries that an earlier merge has made stale are passed over.

Defined cases: a null or empty text has no ids; decoded ids give back exactly the text's bytes; special-token
strings in a text are ordinary text; repeated rows are encoded each for itself; an empty table gives an empty result; a
text of any length is encoded whole, a pre-token of n bytes in time n log n. Extra columns, of any names, pass through
where asked for; a result column replaces one of its name.

Scale: one pass, no shuffle; the vocabulary (a file of fixed size, read on the driver) is broadcast. A worker keeps
the ids of pre-tokens it has met in a memo of at most MEMO entries of at most LONGEST signs, without the rarest.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Sequence
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from .common import arrow_map, buffers, col, ship

MEMO = 160_000
LONGEST = 48
#: White space as Unicode defines it; the regex library's own class also has the separators 1C to 1F.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
FIELDS = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
IDS = [T.StructField("ids", T.ArrayType(T.IntegerType()))]


class PerfectHash:
    """key -> value for a fixed set of byte strings; len(keys) slots."""

    def __init__(self, keys: Sequence[bytes], values: Sequence[int]):
        n = self.n = max(1, len(keys))
        self.buckets = n // 2 + 1
        shift = self.shift = [0] * self.buckets
        self.keys: list[bytes | None] = [None] * n
        self.values = [0] * n
        groups: dict[int, list[tuple[int, int]]] = {}
        for i, k in enumerate(keys):
            h = xxhash.xxh3_64_intdigest(k)
            groups.setdefault(h % self.buckets, []).append((h, i))
        free = [True] * n
        spare: list[int] = []
        for b, own in sorted(groups.items(), key=lambda x: (-len(x[1]), x[0])):
            if len(own) == 1:  # a bucket of one key names its slot outright
                spare = spare or [i for i in range(n) if free[i]]
                at = [spare.pop()]
                shift[b] = -1 - at[0]
            else:
                while len(set(at := [self.slot(h, shift[b]) for h, _ in own])) < len(at) or not all(free[x] for x in at):
                    shift[b] += 1
            for s, (_, i) in zip(at, own):
                free[s] = False
                self.keys[s], self.values[s] = keys[i], values[i]

    def slot(self, h: int, d: int) -> int:
        if d < 0:
            return -1 - d
        x = ((h >> 17) + d * ((h >> 40) | 1)) & 0xFFFFFFFFFFFFFFFF
        x = ((x ^ (x >> 31)) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
        return (x >> 20) % self.n

    def get(self, key: bytes) -> int:
        """The key's value, or -1."""
        h = xxhash.xxh3_64_intdigest(key)
        s = self.slot(h, self.shift[h % self.buckets])
        return self.values[s] if self.keys[s] == key else -1


class Memo(dict):
    """key -> make(key), of at most MEMO keys, none of them a text of over LONGEST signs.

    Half of them are new. When these are many, they become the old ones; an old one that is asked for is new again, so
    what is frequent is never made anew.
    """

    def __init__(self, make):
        self.make = make
        self.old: dict = {}

    def __missing__(self, key):
        out = self.old.get(key)
        if out is None:
            out = self.make(key)
        if isinstance(key, int) or len(key) <= LONGEST:
            if 2 * len(self) >= MEMO:
                self.old = dict(self)
                self.clear()
            self[key] = out
        return out


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.hash = PerfectHash(list(ranks), list(ranks.values()))
        self.pattern = pattern
        size = max(ranks.values(), default=-1) + 1
        self.single = [ranks.get(bytes([b]), -1) for b in range(256)]
        self.table = [b""] * size
        for k, v in ranks.items():
            self.table[v] = k
        self.start()

    def start(self) -> None:
        self.split = regex.compile(self.pattern.replace(r"[^\s", "[^" + SPACE).replace(r"(?!\S)", f"(?![^{SPACE}])").replace(r"\s+", f"[{SPACE}]+"))
        self.memo = Memo(self.word)
        self.pairs = Memo(self.joined)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("split", "memo", "pairs")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.start()

    def joined(self, key: int) -> int:
        """The rank of the joined bytes of tokens a and b, or -1; key: a, then b in its last 32 bits."""
        return self.hash.get(self.table[key >> 32] + self.table[key & 0xFFFFFFFF])

    def word(self, text: str) -> bytes:
        """The ids of one pre-token, little-endian."""
        raw = text.encode()
        whole = self.hash.get(raw)
        if whole >= 0:
            return whole.to_bytes(4, "little")
        n, single, pairs = len(raw), self.single, self.pairs
        ids = [single[b] for b in raw]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [r << 40 | i for i in range(n - 1) if (r := pairs[ids[i] << 32 | ids[i + 1]]) >= 0]
        heapify(heap)
        while heap:
            r = heappop(heap)
            i, r = r & 0xFFFFFFFFFF, r >> 40
            j = after[i]
            if ids[i] < 0 or j >= n or pairs[ids[i] << 32 | ids[j]] != r:
                continue  # stale
            ids[i], ids[j] = r, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (q := pairs[r << 32 | ids[k]]) >= 0:
                    heappush(heap, q << 40 | i)
            h = before[i]
            if h >= 0 and (q := pairs[ids[h] << 32 | r]) >= 0:
                heappush(heap, q << 40 | h)
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.memo.__getitem__, self.split.findall(text))), "<u4")

    def decode(self, ids: Sequence[int]) -> bytes:
        return b"".join(map(self.table.__getitem__, ids))


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a file of lines: token in base64, space, rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _codec(spark, path: str | None, pattern: str | None):
    import public_tokenizers

    return spark.sparkContext.broadcast(Codec(read_ranks(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), pattern or public_tokenizers.PATTERN))


def _texts(texts: pa.Array):
    data, off = buffers(texts)
    raw = data.tobytes()
    for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
        yield raw[a:b].decode()


def encode(docs: DataFrame, *, keep: Sequence[str] = ("doc_id",), text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Columns keep of docs, and ids: the token ids of the whole text."""
    shared = _codec(docs.sparkSession, path, pattern)

    def make():
        codec = shared.value
        return lambda texts: [pa.array([codec.encode(t).astype(np.int32) for t in _texts(texts)], pa.list_(pa.int32()))]

    return arrow_map(docs, keep, text, make, IDS)


def decode(docs: DataFrame, *, ids: str = "ids", out: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """docs with column out: the text of the ids (null for null; bytes that are no UTF-8 become U+FFFD)."""
    ship(docs.sparkSession)
    shared = _codec(docs.sparkSession, path, pattern)
    keep = [c for c in docs.columns if c.lower() != out.lower()]
    source = docs.select(*[col(c).alias(f"kept_{i}") for i, c in enumerate(keep)], col(ids).alias("ids"))

    def run(batches):
        codec = shared.value
        for b in batches:
            made = [None if x is None else codec.decode(x).decode("utf-8", "replace") for x in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(made, pa.string())], names=[*b.schema.names[:-1], "made"])

    made = source.mapInArrow(run, T.StructType([*source.schema.fields[:-1], T.StructField("made", T.StringType())]))
    return made.select(*[F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep)], F.col("made").alias(out))


def round_trip(docs: DataFrame, *, keep: Sequence[str] = ("doc_id",), text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Columns keep of docs, and how many ids the text has, the digest of the ids and that of the bytes decoded from them."""
    shared = _codec(docs.sparkSession, path, pattern)

    def make():
        codec = shared.value

        def fn(texts: pa.Array) -> list:
            n, a, b = [], [], []
            for t in _texts(texts):
                ids = codec.encode(t)
                n.append(len(ids))
                a.append(hashlib.sha256(ids.tobytes()).hexdigest())
                b.append(hashlib.sha256(codec.decode(ids.tolist())).hexdigest())
            return [n, a, b]

        return fn

    return arrow_map(docs, keep, text, make, FIELDS)


def query(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
