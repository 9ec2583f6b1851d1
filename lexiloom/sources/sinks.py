"""Tables to files: tagged outputs, and TAB-separated text."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.counts import margins_grouping_sets

TAGS = {"TRIPLE": "triples", "PS_MARGIN": "pathmargins", "SW_MARGIN": "wordmargins", "GLOBAL": "global"}


def write_tsv(df: DataFrame, path: str) -> None:
    """df without a header, fields apart by TABs, nothing quoted; an existing path is an error."""
    line = F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns])
    df.select(line.alias("value")).write.text(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


def write_tagged(triples: DataFrame, path: str) -> None:
    """Triples and their three margins under path, a folder each."""
    tag = F.col("tag")
    name = F.lit(None)
    for k, v in TAGS.items():
        name = F.when(tag == k, v).otherwise(name)
    margins_grouping_sets(triples).withColumn("family", name).write.partitionBy("family").parquet(path)
