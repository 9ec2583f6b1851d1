"""Secret scans with corpus-wide ownership frequency.

Three base patterns (assign, access, hex) and one wider one (token: 20 or more key characters with upper-case,
lower-case and digits, of at least MIN_BITS bits a character) give candidates. Each candidate's value is hashed; the
hashes are aggregated over the whole corpus by distinct repositories and owners. A value that stands in more than
`most_repositories` repositories or with more than `most_owners` owners is a widely copied example; any other is
owner-specific. Owner-specific candidates get one more span, of kind `live`, over their value; base spans stay
whatever the frequency says.

Defined cases: a null or empty text has no spans; a null owner counts as one unnamed owner, a null repository as
one unnamed repository; repeated rows with one doc_id are one repository; ties in start go by kind in the order of
KINDS, then end; an empty table gives an empty result; a text of any length is scanned whole, in time that grows with
its length (its spans are walked in order). Extra columns, of any names, pass through where asked for.

Scale: texts are scanned once, without a shuffle, and leave only narrow rows, written to the shared folder. Counts
go (hash, owner, repository), (hash, owner), (hash), each combined before its shuffle, so a value with a third of
all rows is a few rows by then. Verdicts are joined back to candidates by hash alone, in a join Spark can split.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import arrow_map, buffers, col, numbered, ship, written

KINDS = ("assign", "access", "hex", "live")
#: The base patterns, fixed by the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}")
MIN_BITS = 3.5
_HEX = np.zeros(256, bool)
_HEX[[*range(48, 58), *range(97, 103)]] = True
_KEY = np.zeros(256, bool)
_KEY[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+/_-"]] = True
CANDIDATE = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("value_start", T.IntegerType()), T.StructField("hash", T.StringType())])
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value_start", pa.int32()), ("hash", pa.string())]))


def has_run(data: np.ndarray, off: np.ndarray, mask: np.ndarray, least: int) -> np.ndarray:
    """Of each text: has it `least` bytes of the mask in a row?"""
    out = np.zeros(len(off) - 1, bool)
    if len(data) < least:
        return out
    gaps = np.flatnonzero(~mask[data])
    gaps = np.concatenate([[-1], gaps, [len(data)]])
    at = gaps[:-1][np.diff(gaps) > least] + 1
    for a in at.tolist():  # may reach over texts
        first = int(np.searchsorted(off, a, "right")) - 1
        end = int(gaps[np.searchsorted(gaps, a, "right")])
        while first < len(out) and off[first] < end:
            if min(end, off[first + 1]) - max(a, off[first]) >= least:
                out[first] = True
            first += 1
    return out


def bits(value: str) -> float:
    n = len(value)
    return -sum(c / n * log2(c / n) for c in Counter(value).values())


def candidates(text: str, assign: bool = True, runs: bool = True, keys: bool = True) -> list[tuple[str, int, int, int, str]]:
    """(kind, start, end, start of the value, value), in code points."""
    out = []
    if assign:
        out += [("assign", *m.span(), m.start(2), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if keys:
        out += [("access", *m.span(), m.start(), m[0]) for m in ACCESS.finditer(text)]
    if runs:
        out += [("hex", *m.span(), m.start(), m[0]) for m in HEX.finditer(text)]
    if keys:
        taken = sorted((c[1], c[2]) for c in out)
        i, reach = 0, 0  # how far the base spans that begin before the token's end go; both walk once over the text
        for m in TOKEN.finditer(text):
            v = m[0]
            while i < len(taken) and taken[i][0] < m.end():
                reach = max(reach, taken[i][1])
                i += 1
            if reach <= m.start() and re.search("[a-z]", v) and re.search("[A-Z]", v) and re.search("[0-9]", v) and bits(v) >= MIN_BITS:
                out.append(("token", *m.span(), m.start(), v))
    order = {"assign": 0, "access": 1, "hex": 2, "token": 3}
    return sorted(out, key=lambda c: (c[1], order[c[0]], c[2]))


def _make():
    def scan(texts: pa.Array) -> list:
        data, off = buffers(texts)
        runs, keys = has_run(data, off, _HEX, 24), has_run(data, off, _KEY, 20)
        marks = np.concatenate([[0], np.cumsum((data == 58) | (data == 61))])
        assign = marks[off[1:]] > marks[off[:-1]]
        found, digest = [], []
        none = hashlib.sha256(b"").hexdigest()
        raw = data.tobytes()
        for i in range(len(texts)):
            own = []
            if assign[i] or runs[i] or keys[i]:
                own = candidates(raw[off[i] : off[i + 1]].decode(), assign[i], runs[i], keys[i])
            base = [c for c in own if c[0] != "token"]
            digest.append(hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b, _, _ in base).encode()).hexdigest() if base else none)
            found.append([{"kind": k, "start": a, "end": b, "value_start": v, "hash": hashlib.sha256(x.encode()).hexdigest()} for k, a, b, v, x in own])
        return [pa.array(found, _ARROW), digest]

    return scan


def scan_secrets(docs: DataFrame, *, keep: Sequence[str] = ("doc_id",), text: str = "text", repository: str = "doc_id", owner: str = "source", most_repositories: int = 3, most_owners: int = 2) -> DataFrame:
    """Columns keep of docs, with base_sha256 and candidates (an array of spans): each candidate's repositories, owners and whether it is live.

    A result column replaces a kept one of its name.
    """
    keep = [c for c in keep if c.lower() not in ("base_sha256", "candidates")]
    docs, names = numbered(docs.select(*[col(c) for c in dict.fromkeys([*keep, repository, owner, text])]), "k")
    rows = arrow_map(docs, [names[c] for c in dict.fromkeys([*keep, repository, owner])], names[text], _make, [T.StructField("found", T.ArrayType(CANDIDATE)), T.StructField("base_sha256", T.StringType())])
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()))
    each = rows.filter(F.size("found") > 0).select("row", F.coalesce(F.col(names[repository]).cast("string"), F.lit("")).alias("repo"), F.coalesce(F.col(names[owner]).cast("string"), F.lit("")).alias("own"), F.explode("found").alias("c")).select("row", "repo", "own", "c.*")
    counts = each.select("hash", "own", "repo").distinct().groupBy("hash", "own").agg(F.count(F.lit(1)).alias("n")).groupBy("hash").agg(F.sum("n").alias("repositories"), F.count(F.lit(1)).alias("owners"))
    judged = each.drop("repo", "own").join(counts, "hash").withColumn("live", (F.col("repositories") <= most_repositories) & (F.col("owners") <= most_owners))
    order = F.when(F.col("kind") == "assign", 0).when(F.col("kind") == "access", 1).when(F.col("kind") == "hex", 2).otherwise(3)
    listed = judged.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", order.alias("place"), "end", "kind", "value_start", "hash", "repositories", "owners", "live"))).alias("candidates"))
    empty = F.array().cast(listed.schema["candidates"].dataType)
    out = rows.filter(F.size("found") > 0).drop("found").join(listed, "row")  # rows without a candidate are not shuffled
    out = out.unionByName(rows.filter(F.size("found") == 0).drop("found").withColumn("candidates", empty))
    return out.select(*[F.col(names[c]).alias(c) for c in keep], "base_sha256", "candidates")


def all_spans(candidates: str = "candidates"):
    """kind:start:end of the base spans and of a `live` span over each owner-specific value, by start, kind and end."""
    base = F.transform(F.filter(candidates, lambda c: c["kind"] != "token"), lambda c: F.struct(c["start"].alias("s"), c["place"].alias("p"), c["end"].alias("e"), c["kind"].alias("k")))
    live = F.transform(F.filter(candidates, lambda c: c["live"]), lambda c: F.struct(c["value_start"].alias("s"), F.lit(3).alias("p"), c["end"].alias("e"), F.lit("live").alias("k")))
    return F.array_join(F.transform(F.array_sort(F.array_distinct(F.concat(base, live))), lambda c: F.concat_ws(":", c["k"], c["s"].cast("string"), c["e"].cast("string"))), ",")


def masked(text: str, spans: Sequence[tuple[int, int]], mark: str) -> str:
    """text with the mark for each of the spans, which are sorted; one that begins within another goes with it."""
    out, at = [], 0
    for a, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", owner: str = "source", mark: str = "[SECRET]", **options) -> DataFrame:
    """docs, same columns and rows: every base value, and every other live value, replaced by the mark.

    A null or empty text, and one without secrets, stays as it is; repeated rows are masked each, and count as one
    repository; n_chars, if there is such a column, follows the text; an empty table gives an empty one.
    """
    columns, chars = docs.columns, docs.schema["n_chars"].dataType if "n_chars" in docs.columns else None
    source, names = numbered(docs)
    found = scan_secrets(source, keep=list(names.values()), text=names[text], repository=names[doc_id], owner=names[owner], **options)
    chosen = F.filter("candidates", lambda c: (c["kind"] != "token") | c["live"])
    found = found.withColumn("cut", F.array_sort(F.transform(chosen, lambda c: F.struct(c["value_start"].alias("s"), c["end"].alias("e"))))).drop("candidates", "base_sha256")
    rest = [c for c in found.columns if c not in (names[text], "cut")]
    found = found.select(*rest, "cut", F.col(names[text]).cast("string").alias(names[text]))
    hit = found.filter(F.size("cut") > 0)
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cuts, bodies = b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1)
            new = pa.array([masked(t, [(c["s"], c["e"]) for c in own], mark) for t, own in zip(bodies.to_pylist(), cuts)], bodies.type)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], new], names=b.schema.names)

    hit = hit.mapInArrow(run, hit.schema)
    if chars is not None:
        hit = hit.withColumn(names["n_chars"], F.length(names[text]).cast(chars))
    out = hit.unionByName(found.filter(F.size("cut") == 0))
    return out.select(*[F.col(names[c]).alias(c) for c in columns])


def query(spark, sf_dir: str) -> DataFrame:
    out = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n = [F.expr(f"size(filter(candidates, c -> c.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return out.select("doc_id", *n, "base_sha256", all_spans().alias("spans"), F.size(F.filter("candidates", lambda c: c["live"])).cast("long").alias("n_live"))


_EITHER = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY]"
_ASSIGN_SQL = f"""({_EITHER})["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _matches_sql(kind: str, place: int, pattern: str, group: int = 0) -> str:
    return f"SELECT doc_id, own, '{kind}' AS kind, {place} AS place, regexp_extract_all(text, '{pattern}') AS x, regexp_extract_all(text, '{pattern}', {group}) AS v, string_split_regex(text, '{pattern}') AS gaps FROM t"


SQL = f"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS own, coalesce(text, '') AS text FROM documents
), m AS ({_matches_sql("assign", 0, _ASSIGN_SQL, 2)} UNION ALL {_matches_sql("access", 1, "AKIA[A-Z0-9]+")}
  UNION ALL {_matches_sql("hex", 2, "[0-9a-f]+")} UNION ALL {_matches_sql("token", 3, "[A-Za-z0-9+/_-]+")}
), l AS (SELECT *, list_transform(x, lambda a: length(a)) AS xl, list_transform(gaps, lambda a: length(a)) AS gl FROM m WHERE len(x) > 0
), e AS (
  SELECT doc_id, own, kind, place, x[i] AS x, v[i] AS v, CAST(list_sum(gl[1 : i]) + coalesce(list_sum(xl[1 : i - 1]), 0) AS BIGINT) AS s
  FROM l, LATERAL (SELECT unnest(list_filter(range(1, len(x) + 1), lambda i: length(v[i]) >= CASE kind WHEN 'assign' THEN 6 WHEN 'hex' THEN 24 ELSE 20 END)) AS i)
), b AS (SELECT *, s + length(x) AS e, s + length(x) - length(v) AS vs FROM e
), c AS (
  SELECT * FROM b WHERE kind <> 'token' OR (regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[0-9]')
    AND list_sum(list_transform(map_values(histogram_of), lambda n: -(n / length(v)) * log2(n / length(v)))) >= {MIN_BITS}
    AND NOT EXISTS (SELECT 1 FROM b o WHERE o.doc_id = b.doc_id AND o.kind <> 'token' AND o.s < b.e AND b.s < o.e))
), w AS (SELECT v, count(DISTINCT doc_id) AS repositories, count(DISTINCT own) AS owners FROM c GROUP BY v
), j AS (SELECT c.*, repositories <= 3 AND owners <= 2 AS live FROM c JOIN w USING (v)
), a AS (
  SELECT DISTINCT doc_id, s, place, e, kind FROM j WHERE kind <> 'token' UNION SELECT doc_id, vs, 3, e, 'live' FROM j WHERE live
), p AS (SELECT doc_id, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place, e) AS spans, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place, e) FILTER (kind <> 'live') AS base FROM a GROUP BY doc_id
), n AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, count(*) FILTER (live) AS n_live
  FROM j GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live
FROM t LEFT JOIN p USING (doc_id) LEFT JOIN n USING (doc_id)
""".replace("map_values(histogram_of)", "list_transform(list_distinct(string_split(v, '')), lambda s: len(list_filter(string_split(v, ''), lambda o: o = s)))")
