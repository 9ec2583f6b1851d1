"""The whole computation: corpus lines and phrase pairs to scores, and scores to figures."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession

from ..functions.phrases import phrase_to_path
from ..functions.stem import identity, stem
from ..operators import evaluate as ev
from ..operators.counts import triples
from ..operators.mi import mi_scores
from ..operators.parse import parse_lines
from ..operators.paths import extract_ngrams
from ..operators.similarity import convert_pairs, final_similarity
from ..sources.readers import read_corpus, read_pairs
from ..sources.sinks import write_tagged, write_tsv

LOG = logging.getLogger(__name__)


def triples_of(lines: DataFrame, stemmed: bool = True) -> DataFrame:
    return triples(extract_ngrams(parse_lines(lines), stemmed))


def score(lines: DataFrame, phrases: DataFrame, stemmed: bool = True) -> DataFrame:
    """p1, p2, score of the phrase pairs, over the corpus lines. The plan is lazy; triples and MI are kept for their consumers."""
    counted = triples_of(lines, stemmed).persist()
    mi = mi_scores(counted).persist()
    return final_similarity(mi, convert_pairs(phrases, stem if stemmed else identity, phrase_to_path))


def run(spark: SparkSession, corpus: str, positives: str, negatives: str, out: str, stemmed: bool = True) -> DataFrame:
    """Reads, scores and writes under out (stages `counts`, `mi`, `final`); raises ValueError where a stage has no rows.

    Each stage's table is read back from where it was written, so nothing is kept in memory or computed twice.
    """
    LOG.info("counting triples of %s", corpus)
    write_tagged(triples_of(read_corpus(spark, corpus), stemmed), f"{out}/counts")
    counted = spark.read.schema("path string, slot string, word string, cnt long, family string").parquet(f"{out}/counts").filter("family = 'triples'").select("path", "slot", "word", "cnt")
    if counted.isEmpty():
        raise ValueError("no triples: the corpus has no usable paths")
    LOG.info("mutual information")
    mi_scores(counted).write.parquet(f"{out}/mi")
    mi = spark.read.parquet(f"{out}/mi")
    phrases = read_pairs(spark, positives).unionByName(read_pairs(spark, negatives))
    pairs = convert_pairs(phrases, stem if stemmed else identity)
    usable = pairs.count()
    if lost := phrases.count() - usable:
        LOG.warning("%d phrase pairs have no two paths and are left out", lost)
    if not usable:
        raise ValueError("no test pair has two paths")
    scores = final_similarity(mi, pairs)
    write_tsv(scores, f"{out}/final")
    LOG.info("scores are in %s/final", out)
    return scores


def report(scores: DataFrame, gold: DataFrame) -> dict[str, DataFrame]:
    """best_f1, threshold, pr_curve and error_samples."""
    cumulative = ev.cumulative_pr(ev.label_scores(scores, gold), gold)
    best = ev.best_f1(cumulative)
    cut = ev.threshold(best)
    return {"best_f1": best, "threshold": cut, "pr_curve": ev.pr_curve(cumulative), "error_samples": ev.error_samples(scores, gold, cut)}
