"""Triple counts over a stream of corpus lines: counts add up, so a stream keeps them by key and a batch run takes over."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..plans.pipeline import triples_of


def streamed_triples(lines: DataFrame, stemmed: bool = True) -> DataFrame:
    """lines: a streaming DataFrame (value). Write the result in complete or update mode."""
    return triples_of(lines, stemmed)
