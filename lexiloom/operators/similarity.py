"""Similarity of given pairs of paths: a ratio of shared to all information by slot, and its geometric mean."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.phrases import phrase_to_path
from ..functions.stem import stem
from .mi import sum_mi


def convert_pairs(phrases: DataFrame, normal: Callable[[Column], Column] = stem, convert=phrase_to_path) -> DataFrame:
    """p1, p2 of every row (phrase1, phrase2, other columns stay) both of whose phrases have a path."""
    rest = [c for c in phrases.columns if c not in ("phrase1", "phrase2")]
    return phrases.select(convert(F.col("phrase1"), normal).alias("p1"), convert(F.col("phrase2"), normal).alias("p2"), *rest).filter("p1 is not null and p2 is not null")


def canonical(pairs: DataFrame) -> DataFrame:
    """Distinct unordered pairs, the smaller path first."""
    rest = [c for c in pairs.columns if c not in ("p1", "p2")]
    return pairs.select(F.least("p1", "p2").alias("p1"), F.greatest("p1", "p2").alias("p2"), *rest).distinct()


def neighbours(pairs: DataFrame) -> DataFrame:
    """(path, neighbour) in both directions."""
    return pairs.select(F.explode(F.array(F.struct(F.col("p1").alias("path"), F.col("p2").alias("neighbour")), F.struct(F.col("p2").alias("path"), F.col("p1").alias("neighbour")))).alias("s")).select("s.*").distinct()


def overlap_numerators(mi: DataFrame, pairs: DataFrame) -> DataFrame:
    """p1, p2, num_x, num_y: information of words that both paths have in a slot; a path paired with itself shares none.

    Features are fanned out to their pairs and grouped by (pair, slot, word): a group of two is a shared word. No
    self-join, and the rows of a hot pair are combined before the shuffle by pair.
    """
    sides = pairs.filter("p1 <> p2").select("p1", "p2", F.explode(F.array("p1", "p2")).alias("path"))
    shared = sides.join(mi, "path").groupBy("p1", "p2", "slot", "word").agg(F.sum("mi").alias("both"), F.count(F.lit(1)).alias("k")).filter("k = 2")
    total = lambda s: F.coalesce(F.sum(F.when(F.col("slot") == s, F.col("both"))), F.lit(0.0))
    return shared.groupBy("p1", "p2").agg(total("X").alias("num_x"), total("Y").alias("num_y"))


def final_similarity(mi: DataFrame, pairs: DataFrame) -> DataFrame:
    """p1, p2, score of the canonical pairs of which a path at least has a feature; no shared word is 0."""
    pairs = canonical(pairs.select("p1", "p2"))
    sums = sum_mi(mi).groupBy("path").agg(*[F.sum(F.when(F.col("slot") == s, F.col("sum_mi"))).alias(f"s{s}") for s in "XY"])
    side = lambda p, k: sums.select(F.col("path").alias(p), F.lit(True).alias(f"has{k}"), F.col("sX").alias(f"x{k}"), F.col("sY").alias(f"y{k}"))
    known = pairs.join(side("p1", 1), "p1", "left").join(side("p2", 2), "p2", "left").filter("has1 or has2")  # a path without a sum has no feature
    rows = known.join(overlap_numerators(mi, pairs), ["p1", "p2"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))

    def ratio(num: str, a: str, b: str) -> Column:
        den = zero(a) + zero(b)
        return F.when(den > 0, zero(num) / den).otherwise(0.0)

    return rows.select("p1", "p2", F.sqrt(ratio("num_x", "x1", "x2") * ratio("num_y", "y1", "y2")).alias("score"))
