"""Sharding along a Hilbert curve, with DataFrame functions only.

Three metadata dimensions are quantised to 16 levels each: language and source by the sixteenths of their whole sorted
values (a value's level is the number of quantiles below it, so a level is a range of values and one value is one
level) and size by its logarithm. Rows are put in the order of the curve index of their cell, ties by a hash of the row
(the salt), then doc_id, checksum and size, and the order is cut into runs whose row counts differ by one at most (law
`rows`). A shard so holds few neighbouring values of each dimension, which file statistics can skip by.

Defined cases: a null text has size 16 and checksum 0; null metadata sorts as the empty string; with fewer rows
than shards some shards stay empty; repeated rows each get a slot of their own; a text of any length counts whole; an
empty table gives an empty result. Extra columns, of any names, are not read.

Scale: the text is read once, for its size and checksum; one shuffle of narrow rows by (cell, salt). The number of
salts follows the row count, so a cell with a third of all rows is spread over many groups. Offsets come from the
counts of the groups: at most 4096 cells in one task, and the salts of one cell in another. Quantiles are exact: each
dimension's distinct values are counted once, and the counts walked down by prefixes that hold a wanted rank, at most 15
at a time; no more than FETCH values ever come to the driver.
"""

from __future__ import annotations

import os

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import col

BITS = 4
LEVELS = 1 << BITS
#: Distinct values of one dimension that may come to the driver at once.
FETCH = 4096
#: Rows that a group of one cell and salt should have about.
GROUP_ROWS = 1 << 18
LEAST_SALTS = 32


def quantiles(values: DataFrame, ranks: list[int]) -> list[str]:
    """The values at the given ranks (from 1, sorted) of a table (value, n): distinct strings and how many rows have each.

    A pass counts, for each prefix that holds a wanted rank, the rows by the sign that follows it. A prefix grows by all
    that its values have in common, so passes are as many as the forks on the way to a value, not as its signs.
    """
    out: dict[int, str] = {}
    active = {"": (0, sorted(set(ranks)))}  # prefix -> rows before its first value, wanted ranks among its values
    while active:
        inside = F.lit(None).cast("int")
        for i, p in enumerate(active):
            inside = F.when(F.substring("value", 1, len(p)) == F.lit(p), i).otherwise(inside)
        lengths = F.get(F.array(*[F.lit(len(p) + 1) for p in active]), F.col("i"))
        rows = values.withColumn("i", inside).filter("i is not null")
        few = rows.limit(FETCH + 1).count() <= FETCH
        next_sign = F.col("value") if few else F.expr("substring(value, at, 1)")
        found = rows.withColumn("at", lengths).groupBy("i", next_sign.alias("s")).agg(F.sum("n").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")).collect()
        by: dict[int, list] = {}
        for r in found:
            by.setdefault(r["i"], []).append((r["lo"].encode(), r["n"], r["lo"], r["hi"]))
        new: dict[str, tuple[int, list[int]]] = {}
        for i, (before, wanted) in enumerate(active.values()):
            for _, n, lo, hi in sorted(by[i]):
                here = [w for w in wanted if before < w <= before + n]
                if here and lo == hi:
                    out |= dict.fromkeys(here, lo)
                elif here:
                    new[os.path.commonprefix([lo, hi])] = (before, here)
                before += n
        active = new
    return [out[r] for r in ranks]


def bounds_of(docs: DataFrame, column: Column, total: int) -> list[str]:
    """The 15 sixteenths of the column's sorted values (fewer, if equal)."""
    if not total:
        return []
    values = docs.select(column.alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n")).persist(StorageLevel.DISK_ONLY)
    try:
        found = quantiles(values, [-(-total * k // LEVELS) for k in range(1, LEVELS)])
    finally:
        values.unpersist()
    return sorted(set(found), key=str.encode)


def quantised(value: Column, bounds: list[str]) -> Column:
    """How many of the bounds lie below the value."""
    out = F.lit(0)
    for b in bounds:
        out = out + (value > F.lit(b)).cast("int")
    return out


def hilbert_index(x: Column, y: Column, z: Column, bits: int = BITS) -> Column:
    """Place on the curve of the cell (x, y, z), each below 2**bits (Skilling's transform, as folds over the bits)."""
    start = F.struct(x.cast("int").alias("a"), y.cast("int").alias("b"), z.cast("int").alias("c"))

    def turn(s, q):
        low = q - 1

        def one(s, name):
            v = s[name]
            t = s["a"].bitwiseXOR(v).bitwiseAND(low)
            on = v.bitwiseAND(q) != 0
            a = F.when(on, s["a"].bitwiseXOR(low)).otherwise(s["a"].bitwiseXOR(t))
            rest = {n: (F.when(on, s[n]).otherwise(s[n].bitwiseXOR(t)) if n == name else s[n]) for n in ("b", "c")}
            return F.struct(a.alias("a"), rest["b"].alias("b"), rest["c"].alias("c"))

        first = F.struct(F.when(s["a"].bitwiseAND(q) != 0, s["a"].bitwiseXOR(low)).otherwise(s["a"]).alias("a"), s["b"].alias("b"), s["c"].alias("c"))
        steps = F.array(F.lit("b"), F.lit("c"))
        return F.aggregate(steps, first, lambda t, n: F.when(n == "b", one(t, "b")).otherwise(one(t, "c")))

    masks = F.array(*[F.lit(1 << b) for b in range(bits - 1, 0, -1)])
    turned = F.aggregate(masks, start, turn)

    def gray(s):
        b = s["b"].bitwiseXOR(s["a"])
        return F.struct(s["a"].alias("a"), b.alias("b"), s["c"].bitwiseXOR(b).alias("c"))

    g = F.element_at(F.transform(F.array(turned), gray), 1)
    flip = lambda c: F.aggregate(masks, F.lit(0), lambda t, q: F.when(c.bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))
    done = F.transform(F.array(g), lambda s: F.struct(*[s[n].bitwiseXOR(flip(s["c"])).alias(n) for n in "abc"]))
    s = F.element_at(done, 1)
    out = F.lit(0)
    for b in range(bits - 1, -1, -1):
        for n in "abc":
            out = out * 2 + F.shiftright(s[n], b).bitwiseAND(1)
    return out


def shard(docs: DataFrame, *, shards: int = 40, doc_id: str = "doc_id", text: str = "text", dimensions: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, and the curve index of the row's cell."""
    total = docs.count()
    plain = [F.coalesce(col(d).cast("string"), F.lit("")) for d in dimensions]
    bounds = [bounds_of(docs, c, total) for c in plain]
    salts = max(LEAST_SALTS, -(-total // GROUP_ROWS))
    body = col(text).cast("string")
    rows = docs.select(
        col(doc_id).alias("doc_id"),
        (F.coalesce(F.octet_length(body), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32(body.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        *[quantised(c, b).alias(f"level{i}") for i, (c, b) in enumerate(zip(plain, bounds))],
    )
    mixed = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("text_crc32").cast("string"), F.col("size").cast("string"))), 1, 8), 16, 10).cast("long")
    level = F.least(F.lit(LEVELS - 1), F.greatest(F.lit(0), F.floor(F.log2("size")) - 4)).cast("int")
    rows = rows.select("doc_id", "size", "text_crc32", (F.col("level0") * LEVELS * LEVELS + F.col("level1") * LEVELS + level).alias("cell"), F.pmod(mixed, F.lit(salts)).cast("int").alias("salt"))
    counts = rows.groupBy("cell", "salt").agg(F.count(F.lit(1)).alias("n"))
    cells = counts.groupBy("cell").agg(F.sum("n").alias("n"))
    axis = [F.shiftright("cell", BITS * k).bitwiseAND(LEVELS - 1) for k in (2, 1, 0)]
    cells = cells.withColumn("curve", hilbert_index(*axis)).withColumn("before", F.sum("n").over(Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, -1))).select("cell", "curve", F.coalesce("before", F.lit(0)).alias("before"))
    within = Window.partitionBy("cell").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("inner", F.coalesce(F.sum("n").over(within), F.lit(0))).join(F.broadcast(cells), "cell").select("cell", "salt", "curve", (F.col("before") + F.col("inner")).alias("first"))
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("cell", "salt").orderBy("doc_id", "text_crc32", "size")) - 1)
    place = (F.col("first") + F.col("r")).cast("long")
    n, k = F.lit(total).cast("long"), F.lit(shards).cast("long")
    placed = ranked.join(offsets, ["cell", "salt"]).withColumn("place", place).withColumn("shard", F.expr(f"int((place * {shards}L) div greatest({total}L, 1L))"))
    begin = F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("place") - begin).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve")


def write_shards(docs: DataFrame, path: str, *, shards: int = 40, doc_id: str = "doc_id", **options) -> None:
    """docs as Parquet under path, a folder a shard; docs must have distinct ids. A shard's rows go to one task a shard: choose shards by size."""
    where = shard(docs, shards=shards, doc_id=doc_id, **options).select(F.col("doc_id").alias(doc_id), "shard", "slot")
    clash = {"shard", "slot"} & {c.lower() for c in docs.columns}
    if clash:
        raise ValueError(f"columns {sorted(clash)} are needed for the shards")
    docs.join(where, doc_id).repartition(shards, "shard").sortWithinPartitions("shard", "slot").drop("slot").write.partitionBy("shard").parquet(path)


def query(spark, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _curve_sql() -> str:
    """CTEs h0, h1, ...: Skilling's transform of level0, level1, level2 step by step, the last with the index, `curve`."""
    steps = ["h0 AS (SELECT *, level0 AS a, level1 AS b, level2 AS c FROM leveled)"]
    last = lambda: f"h{len(steps) - 1}"
    for q in (1 << k for k in range(BITS - 1, 0, -1)):
        for v in "abc":
            low = q - 1
            t = f"(xor(a, {v}) & {low})"
            new_a = f"CASE WHEN ({v} & {q}) <> 0 THEN xor(a, {low}) ELSE xor(a, {t}) END"
            if v == "a":
                new_a = f"CASE WHEN (a & {q}) <> 0 THEN xor(a, {low}) ELSE a END"
            rest = f", CASE WHEN ({v} & {q}) <> 0 THEN {v} ELSE xor({v}, {t}) END AS {v}" if v != "a" else ""
            drop = "a" if v == "a" else f"a, {v}"
            steps.append(f"h{len(steps)} AS (SELECT * EXCLUDE ({drop}), {new_a} AS a{rest} FROM {last()})")
    steps.append(f"h{len(steps)} AS (SELECT * EXCLUDE (b, c), xor(a, b) AS b, xor(c, xor(a, b)) AS c FROM {last()})")
    flip = "0"
    for q in (1 << k for k in range(BITS - 1, 0, -1)):
        flip = f"xor({flip}, CASE WHEN (c & {q}) <> 0 THEN {q - 1} ELSE 0 END)"
    steps.append(f"h{len(steps)} AS (SELECT * EXCLUDE (a, b, c), xor(a, {flip}) AS a, xor(b, {flip}) AS b, xor(c, {flip}) AS c FROM {last()})")
    bits = [f"((({n} >> {k}) & 1) << {3 * k + 2 - i})" for k in range(BITS) for i, n in enumerate("abc")]
    steps.append(f"placed AS (SELECT *, {' + '.join(bits)} AS curve FROM {last()})")
    return ", ".join(steps)


SQL = f"""
WITH crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS t
), d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(octet_length(encode(text)), 0) + 16 AS size,
    xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT)),
      lambda s, x: xor(s >> 8, t[xor(s & 255, x) + 1]), 4294967295::BIGINT), 4294967295) AS text_crc32
  FROM documents, crc
), n AS (SELECT count(*) AS n FROM d
), cuts0 AS (SELECT DISTINCT lang AS v FROM (SELECT lang, row_number() OVER (ORDER BY lang) AS r FROM d), n WHERE r IN (SELECT (n.n * k + {LEVELS - 1}) // {LEVELS} FROM range(1, {LEVELS}) AS x(k))
), cuts1 AS (SELECT DISTINCT source AS v FROM (SELECT source, row_number() OVER (ORDER BY source) AS r FROM d), n WHERE r IN (SELECT (n.n * k + {LEVELS - 1}) // {LEVELS} FROM range(1, {LEVELS}) AS x(k))
), leveled AS (
  SELECT doc_id, size, text_crc32, (SELECT count(*) FROM cuts0 WHERE v < lang) AS level0, (SELECT count(*) FROM cuts1 WHERE v < source) AS level1,
    least({LEVELS - 1}, greatest(0, CAST(floor(log2(size)) AS BIGINT) - 4)) AS level2,
    CAST('0x' || substr(md5(concat_ws(':', doc_id, text_crc32, size)), 1, 8) AS BIGINT) % greatest({LEAST_SALTS}, (n.n + {GROUP_ROWS - 1}) // {GROUP_ROWS}) AS salt
  FROM d, n
), {_curve_sql()}, r AS (
  SELECT *, row_number() OVER (ORDER BY curve, salt, doc_id, text_crc32, size) - 1 AS place FROM placed
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(place * 40 // n AS INTEGER) AS shard,
  CAST(place - ((place * 40 // n) * n + 39) // 40 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, CAST(curve AS INTEGER) AS curve
FROM r, n
"""
