"""Corpus lines to tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

def once(df: DataFrame, keep: list[str], **made: Column) -> DataFrame:
    """Columns keep, and those made, each computed once a row: a generator stops the optimizer from copying them into every use."""
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in made.items()]))))


def parse_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """ngram and cnt of each line with three fields or more; a count that is no whole number is 1."""
    fields = F.split(F.regexp_replace(F.col(value), r"\t+$", ""), "\t")
    count = F.get("f", F.lit(2))
    rows = once(lines, [], f=fields).filter(F.size("f") >= 3)
    return rows.select(F.get("f", F.lit(1)).alias("ngram"), F.coalesce(F.when(count.rlike(r"^[+-]?[0-9]+\z"), count.try_cast("bigint")), F.lit(1)).alias("cnt"))


def tokens(ngram: Column) -> Column:
    """Tokens word/POS/dep/head, read from the right; those that are not of that form are left out, which moves later ones up."""

    def token(t: Column) -> Column:
        k = F.size(F.split(t, "/"))
        back = lambda i: F.split_part(t, F.lit("/"), F.lit(-i))
        head = back(1)
        return F.struct(
            F.array_join(F.slice(F.split(t, "/"), 1, k - 3), "/").alias("word"),
            back(3).alias("pos"),
            back(2).alias("dep"),
            F.when((k >= 4) & head.rlike(r"^[+-]?[0-9]+\z"), head.try_cast("int")).alias("head"),
        )

    parts = F.filter(F.split(ngram, " +"), lambda t: (t != "") & (F.length(t) - F.length(F.replace(t, F.lit("/"))) >= 3))
    return F.filter(F.transform(parts, token), lambda t: t["head"].isNotNull())


def parse_tokens(parsed: DataFrame) -> DataFrame:
    """tokens and cnt of each n-gram that has a token."""
    return once(parsed, ["cnt"], tokens=tokens(F.col("ngram"))).select("tokens", "cnt").filter(F.size("tokens") > 0)
