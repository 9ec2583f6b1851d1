"""Triples and their margins. All margins are roll-ups of the triples, so the extractions are shuffled once."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def slots(extractions: DataFrame) -> DataFrame:
    """path, slot, word, cnt: a row for each end of each extraction."""
    return extractions.selectExpr("path", "stack(2, 'X', x, 'Y', y) as (slot, word)", "cnt")


def triples(extractions: DataFrame) -> DataFrame:
    return slots(extractions).groupBy("path", "slot", "word").agg(F.sum("cnt").alias("cnt"))


def word_margins(triples: DataFrame) -> DataFrame:
    return triples.groupBy("slot", "word").agg(F.sum("cnt").alias("sw"))


def path_margins(triples: DataFrame) -> DataFrame:
    return triples.groupBy("path", "slot").agg(F.sum("cnt").alias("ps"))


def global_n(triples: DataFrame) -> DataFrame:
    """One row: the sum over both slots."""
    return triples.agg(F.sum("cnt").alias("n"))


def margins_grouping_sets(triples: DataFrame) -> DataFrame:
    """Triples and all margins in one table, told apart by tag."""
    tag = F.when(F.grouping("word") + F.grouping("path") + F.grouping("slot") == 3, "GLOBAL").when(F.grouping("path") == 1, "SW_MARGIN").when(F.grouping("word") == 1, "PS_MARGIN").otherwise("TRIPLE")
    sets = [[F.col("path"), F.col("slot"), F.col("word")], [F.col("slot"), F.col("word")], [F.col("path"), F.col("slot")], []]
    return triples.groupingSets(sets, "path", "slot", "word").agg(tag.alias("tag"), F.sum("cnt").alias("cnt")).select("tag", "path", "slot", "word", "cnt")
