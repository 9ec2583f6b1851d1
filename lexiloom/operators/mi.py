"""Pointwise mutual information of (path, slot, word), and its sum by (path, slot)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .counts import global_n, path_margins, word_margins

LEAST = 0.001


def mi_scores(triples: DataFrame, least: float = LEAST) -> DataFrame:
    """path, slot, word, mi for mi > least. The margins are joined by key; Spark broadcasts one only if it is small."""
    c, n, ps, sw = (F.col(x).cast("double") for x in ("cnt", "n", "ps", "sw"))
    joined = triples.join(path_margins(triples), ["path", "slot"]).join(word_margins(triples), ["slot", "word"]).crossJoin(F.broadcast(global_n(triples)))
    num, den = c * n, ps * sw
    return joined.filter((num > 0) & (den > 0)).select("path", "slot", "word", F.log(num / den).alias("mi")).filter(F.col("mi") > least)


def sum_mi(mi: DataFrame) -> DataFrame:
    return mi.groupBy("path", "slot").agg(F.sum("mi").alias("sum_mi"))
