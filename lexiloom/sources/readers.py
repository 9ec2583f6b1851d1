"""Corpus lines, gold pairs and scores from text, and corpora derived from the test tables."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.phrases import phrase_to_path_eval
from ..functions.stem import stem_lower

LOG = logging.getLogger(__name__)


def read_corpus(spark: SparkSession, paths: str) -> DataFrame:
    """Lines (value) of comma-separated paths, globs and compressed files included."""
    return spark.read.text(paths.split(","))


def read_pairs(spark: SparkSession, path: str, label: str | None = None) -> DataFrame:
    """phrase1, phrase2 (and label) of a file of TAB-separated pairs; lines with one field are left out."""
    fields = F.split("value", "\t")
    out = spark.read.text(path).filter(F.size(fields) >= 2).select(F.get(fields, F.lit(0)).alias("phrase1"), F.get(fields, F.lit(1)).alias("phrase2"))
    return out.withColumn("label", F.lit(label)) if label else out


def read_gold(spark: SparkSession, path: str, label: str, normal=stem_lower) -> DataFrame:
    """p1, p2, label: distinct unordered pairs by the evaluator's converter; a missing file has none, and is warned of."""
    try:
        pairs = read_pairs(spark, path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        LOG.warning("no gold file at %s", path)
        return spark.createDataFrame([], "p1 string, p2 string, label string")
    paths = pairs.select(phrase_to_path_eval(F.col("phrase1"), normal).alias("a"), phrase_to_path_eval(F.col("phrase2"), normal).alias("b")).filter("a is not null and b is not null")
    return paths.select(F.least("a", "b").alias("p1"), F.greatest("a", "b").alias("p2")).distinct().withColumn("label", F.lit(label))


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """p1, p2, score of TAB-separated result files: three fields or more, a number (not NaN), above 0."""
    fields = F.split(F.trim("value"), "\t")
    rows = spark.read.text(path).filter(F.size(fields) >= 3)
    return rows.select(F.get(fields, F.lit(0)).alias("p1"), F.get(fields, F.lit(1)).alias("p2"), F.get(fields, F.lit(2)).try_cast("double").alias("score")).filter("score > 0 and not isnan(score)")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are cores at least: these small tables come in one file, a corpus in many splits."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def star_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a corpus made from the sales tables: segment nouns, type verbs, part-name nouns, five templates by line number."""
    line = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag"))
    rows = line.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type"), "l_partkey")
    x, v, y = F.lower("c_mktsegment"), F.lower("p_type"), F.get(F.split("p_name", " "), F.lit(1))
    prep = F.when(F.col("l_returnflag") == "A", "in/IN").when(F.col("l_returnflag") == "N", "with/IN").otherwise("to/TO")
    even = ((F.length("p_type") + F.length("c_mktsegment")) % 2 == 0) & ((F.length("p_type") + F.length(y)) % 2 == 0)
    kind = F.col("l_linenumber") % 5
    ngram = (
        F.when(kind == 0, F.concat(x, F.lit("/NN/nsubj/2 "), v, F.lit("/VBZ/ROOT/0 "), y, F.lit("/NN/dobj/2")))
        .when(kind == 1, F.concat(x, F.lit("/NN/nsubj/2 "), v, F.lit("/VBZ/ROOT/0 "), prep, F.lit("/prep/2 "), y, F.lit("/NN/pobj/3")))
        .when(kind == 2, F.concat(x, F.lit("/NN/nsubjpass/2 "), v, F.lit("/VBN/ROOT/0 by/IN/prep/2 "), y, F.lit("/NN/pobj/3")))
        .when(kind == 3, F.concat(x, F.lit("/NN/nsubj/2 is/VBZ/ROOT/0 "), y, F.lit("/NN/dobj/2")))
        .otherwise(F.concat(x, F.lit("/NN/nn/2 "), y, F.lit("/NN/ROOT/0")))
    )
    count = F.when(even, F.col("l_quantity").cast("bigint")).otherwise(1)
    return rows.select(F.concat_ws("\t", v, ngram, count.cast("string")).alias("value"))


def document_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a corpus made from the documents: every three words in a row as noun, verb, noun."""
    words = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: w != "")
    docs = spread(table(spark, sf_dir, "documents").select("text")).select(words.alias("w")).filter(F.size("w") >= 3)
    at = docs.select("w", F.explode(F.sequence(F.lit(1), F.size("w") - 2)).alias("i"))
    a, b, c = (F.element_at("w", F.col("i") + k) for k in range(3))
    return at.select(F.concat(b, F.lit("\t"), a, F.lit("/NN/nsubj/2 "), b, F.lit("/VB/ROOT/0 "), c, F.lit("/NN/dobj/2\t1")).alias("value"))


def star_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """phrase1, phrase2, label: labelled pairs of phrases over the star corpus's verbs."""
    verbs = table(spark, sf_dir, "part").select(F.lower("p_type").alias("v")).distinct()
    phrases = verbs.select(F.explode(F.array(*[F.concat(F.lit("X "), F.col("v"), F.lit(s)) for s in (" Y", " in Y", " with Y", " to Y", " by Y", " badly enough at Y")])).alias("phrase"))
    other = phrases.withColumnRenamed("phrase", "phrase2")
    pairs = phrases.withColumnRenamed("phrase", "phrase1").join(other, F.col("phrase1") <= F.col("phrase2"))
    return pairs.withColumn("label", F.when((F.length("phrase1") + 2 * F.length("phrase2")) % 3 == 0, "pos").otherwise("neg"))


# Lines that a corpus may hold besides well-formed ones.
ODD_LINES = [
    "h\tsmoking/NN/nsubj/2 causes/VBZ/ROOT/0 cancer/NN/dobj/2\tabc",
    "short line",
    "h\ta/NN/nsubj/2 eats/VB/ROOT/0 b/NN/dobj/2 c/NN/conj/3\t+7",
    "h\tbad a/NN/nsubj/2 eats/VB/ROOT/0 b/NN/dobj/2 x/NN/y/z\t 5 ",
    "h\ta/NN/x/9 runs/VB/ROOT/0 b/NN/dobj/2\t3",
    "h\ta/NN/d/2 eats/VB/e/3 c/NN/f/2\t2\tmore\tfields",
    "h\tman/NN/nsubj/3 has/VBZ/aux/3 eaten/VBN/ROOT/0 of/IN/prep/3 the/DT/det/6 bread/NN/pobj/4 in/IN/prep/6 Towns/NNS/pobj/7\t99999999999999999999",
    "h\tdog/NN/nsubj/2  takes/VB/ROOT/0 and/or/NN/dobj/2 x/y/1 /NN/dep/2\t4",
    "h\t\t3",
    "h\tn\t",
]


def odd_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a corpus made from the events: the odd lines in turn, by the event's id."""
    lines = F.array(*[F.lit(x) for x in ODD_LINES])
    return spread(table(spark, sf_dir, "events").select("event_id")).select(F.element_at(lines, (F.col("event_id") % len(ODD_LINES) + 1).cast("int")).alias("value"))
