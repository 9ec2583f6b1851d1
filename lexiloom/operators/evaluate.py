"""Scored pairs against labelled ones: best F1, precision-recall curve, error samples.

The cumulative window is over the labelled pairs alone, a table made by hand, in one order; ties go by (p1, p2).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

FALLBACK = 0.01
SAMPLES = 5
DIGITS = 9


def score_map(scores: DataFrame) -> DataFrame:
    """The largest score of each unordered pair, of the positive ones; rounded, so that equal sums added in another order tie."""
    score = F.round("score", DIGITS)
    return scores.filter((score > 0) & ~F.isnan("score")).groupBy(F.least("p1", "p2").alias("p1"), F.greatest("p1", "p2").alias("p2")).agg(F.max(score).alias("score"))


def gold(pairs: DataFrame) -> DataFrame:
    """p1, p2, label of each unordered pair of (p1, p2, label); pos wins."""
    return pairs.groupBy(F.least("p1", "p2").alias("p1"), F.greatest("p1", "p2").alias("p2")).agg(F.max("label").alias("label"))


def label_scores(scores: DataFrame, gold: DataFrame) -> DataFrame:
    """Scored pairs that have a label."""
    return score_map(scores).join(gold, ["p1", "p2"])


def cumulative_pr(labelled: DataFrame, gold: DataFrame) -> DataFrame:
    """By falling score: rank, pairs true and false so far, precision, recall and F1."""
    order = Window.orderBy(F.desc("score"), "p1", "p2")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = labelled.withColumn("rank", F.row_number().over(order)).withColumn("tp", F.sum((F.col("label") == "pos").cast("long")).over(so_far)).withColumn("fp", F.sum((F.col("label") != "pos").cast("long")).over(so_far))
    total = gold.agg(F.sum((F.col("label") == "pos").cast("long")).alias("positives"))
    p, r = F.col("precision"), F.col("recall")
    return (
        ranked.crossJoin(F.broadcast(total))
        .withColumn("precision", F.col("tp") / (F.col("tp") + F.col("fp")))
        .withColumn("recall", F.when(F.col("positives") > 0, F.col("tp") / F.col("positives")).otherwise(0.0))
        .withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))
        .select("rank", "p1", "p2", "score", "label", "tp", "fp", "precision", "recall", "f1")
    )


def pr_curve(cumulative: DataFrame) -> DataFrame:
    return cumulative.select("rank", "recall", "precision")


def best_f1(cumulative: DataFrame) -> DataFrame:
    """One row: the first rank with the largest F1 (none for no labelled scores)."""
    return cumulative.orderBy(F.desc("f1"), "rank").limit(1).select(F.col("score").alias("threshold"), "f1", "precision", "recall")


def threshold(best: DataFrame) -> DataFrame:
    """The threshold, or the fallback for one that isn't positive."""
    return best.select(F.when(F.col("threshold") > 0, F.col("threshold")).otherwise(FALLBACK).alias("threshold"))


def missed_positives(scores: DataFrame, gold: DataFrame) -> DataFrame:
    return gold.filter("label = 'pos'").join(score_map(scores), ["p1", "p2"], "left_anti").select("p1", "p2")


def true_negatives(scores: DataFrame, gold: DataFrame, cut: DataFrame) -> DataFrame:
    """Negatives that score below the threshold, or not at all (0)."""
    scored = gold.filter("label <> 'pos'").join(score_map(scores), ["p1", "p2"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return scored.crossJoin(F.broadcast(cut)).filter("score < threshold").select("p1", "p2", "score")


def error_samples(scores: DataFrame, gold: DataFrame, cut: DataFrame, most: int = SAMPLES) -> DataFrame:
    """class (TP, FP, FN, TN), place, p1, p2, score: the first few of each class; scored misses come before unscored ones."""
    labelled = label_scores(scores, gold).crossJoin(F.broadcast(cut))
    positive, above = F.col("label") == "pos", F.col("score") >= F.col("threshold")
    kind = F.when(positive & above, "TP").when(above, "FP").when(positive, "FN")
    cols = ["class", "p1", "p2", "score"]
    rows = labelled.withColumn("class", kind).filter("class is not null").select(*cols)
    rows = rows.unionByName(missed_positives(scores, gold).select(F.lit("FN").alias("class"), "p1", "p2", F.lit(0.0).alias("score")))
    rows = rows.unionByName(true_negatives(scores, gold, cut).withColumn("class", F.lit("TN")).select(*cols))
    place = F.row_number().over(Window.partitionBy("class").orderBy(F.desc("score"), "p1", "p2"))
    return rows.withColumn("place", place).filter(F.col("place") <= most).select("class", "place", "p1", "p2", "score")
