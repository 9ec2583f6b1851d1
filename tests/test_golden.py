import math

import pytest

from lexiloom.functions.phrases import phrase_to_path, phrase_to_path_eval
from lexiloom.operators import evaluate as ev
from lexiloom.operators.mi import mi_scores
from lexiloom.plans import pipeline
from lexiloom.sources.readers import read_gold, read_scores

CORPUS = [
    "cause\tsmoking/NN/nsubj/2 causes/VBZ/ROOT/0 cancer/NN/dobj/2\t10",
    "provoke\tsmoking/NN/nsubj/2 provokes/VBZ/ROOT/0 cancer/NN/dobj/2\t5",
    "cause\tvirus/NN/nsubj/2 causes/VBZ/ROOT/0 flu/NN/dobj/2\t3",
    "lead\tsmoking/NN/nsubj/2 leads/VBZ/ROOT/0 to/TO/prep/2 cancer/NN/pobj/3\t4",
    "chase\tdog/NN/nsubj/2 chases/VBZ/ROOT/0 cat/NN/dobj/2\tabc",
    "be\tsmoking/NN/nsubj/2 is/VBZ/ROOT/0 habit/NN/dobj/2\t7",
]
GOLD = {
    ("X cause Y", "X provoke Y"): 0.543749, ("X cause Y", "X lead to Y"): 0.543749, ("X lead to Y", "X provoke Y"): 1.0,
    ("X cause Y", "X chase Y"): 0.0, ("X cause Y", "X prevent Y"): 0.0, ("X prevent Y", "X avoid Y"): None,
    ("X cause Y", "X causes Y"): 0.0, ("X cause Y", "Y provoke X"): None,
}


def path(verb, prep=None):
    return f"N:<nsubj:V:{verb}:>prep:P:{prep}:>pobj:N" if prep else f"N:<nsubj:V:{verb}:>dobj:N"


def lines(spark):
    return spark.createDataFrame([(x,) for x in CORPUS], "value string")


def test_mutual_information(spark):
    counted = pipeline.triples_of(lines(spark))
    assert sum(r.cnt for r in counted.collect()) == 46
    mi = {(r.path, r.slot, r.word): round(r.mi, 6) for r in mi_scores(counted).collect()}
    want = {("caus", "smoke", "cancer"): 0.621838, ("caus", "viru", "flu"): 1.263692, ("provok", "smoke", "cancer"): 0.884202, ("chase", "dog", "cat"): 3.828641}
    for (v, x, y), value in want.items():
        assert mi[path(v), "X", x] == mi[path(v), "Y", y] == value
    assert mi[path("lead", "to"), "X", "smoke"] == 0.884202 and len(mi) == 10


@pytest.mark.parametrize("parts", [1, 7])
def test_scores(spark, parts):
    phrases = spark.createDataFrame([*GOLD, ("X provoke Y", "X cause Y")], "phrase1 string, phrase2 string").repartition(parts)
    got = {(r.p1, r.p2): round(r.score, 6) for r in pipeline.score(lines(spark).repartition(parts), phrases).collect()}
    caus, provok, lead = path("caus"), path("provok"), path("lead", "to")
    assert got == {(caus, provok): 0.543749, tuple(sorted((caus, lead))): 0.543749, tuple(sorted((lead, provok))): 1.0, tuple(sorted((caus, path("chase")))): 0.0, tuple(sorted((caus, path("prevent")))): 0.0, (caus, caus): 0.0}
    assert all(0 <= s <= 1 + 1e-9 for s in got.values())


def test_run_writes_and_fails_fast(spark, tmp_path):
    (tmp_path / "corpus.txt").write_text("\n".join(CORPUS))
    (tmp_path / "pos.txt").write_text("X cause Y\tX provoke Y\n\n")
    (tmp_path / "neg.txt").write_text("X cause Y\tX chase Y\nonly one\n")
    pipeline.run(spark, str(tmp_path / "corpus.txt"), str(tmp_path / "pos.txt"), str(tmp_path / "neg.txt"), str(tmp_path / "out"))
    scores = read_scores(spark, str(tmp_path / "out/final")).collect()
    assert [(r.p1, r.p2, round(r.score, 6)) for r in scores] == [(path("caus"), path("provok"), 0.543749)]
    assert {p.name for p in (tmp_path / "out/counts").glob("family=*")} == {"family=" + n for n in ("triples", "pathmargins", "wordmargins", "global")}
    (tmp_path / "empty.txt").write_text("nothing here\n")
    with pytest.raises(ValueError):
        pipeline.run(spark, str(tmp_path / "empty.txt"), str(tmp_path / "pos.txt"), str(tmp_path / "neg.txt"), str(tmp_path / "out2"))
    gold = read_gold(spark, str(tmp_path / "pos.txt"), "pos").collect()
    assert [(r.p1, r.p2, r.label) for r in gold] == [(path("caus"), path("provok"), "pos")]
    assert read_gold(spark, str(tmp_path / "missing.txt"), "neg").count() == 0


PHRASES = {
    "X cause Y": (path("caus"), path("caus")),
    "X die from Y": (path("die", "from"), path("die", "from")),
    "X be in Y": (path("in"), path("be", "in")),
    "X treat by Y": ("N:<nsubjpass:V:treat:>prep:P:by:>pobj:N", "N:<nsubjpass:V:treat:>agent:P:by:>pobj:N"),
    "Y resemble X": (None, path("resembl")),
    "X carry out with Y": (path("carryout", "with"), None),
    "X run fast with Y": (None, None),
    "": (None, None),
}


def test_converters(spark):
    df = spark.createDataFrame([(p,) for p in PHRASES], "p string")
    got = {r.p: (r.a, r.b) for r in df.select("p", phrase_to_path(df.p).alias("a"), phrase_to_path_eval(df.p).alias("b")).collect()}
    assert got == PHRASES


def test_evaluation(spark):
    scores = spark.createDataFrame([("a", "b", 0.9), ("b", "a", 0.95), ("a", "c", 0.8), ("a", "d", 0.8), ("a", "e", 0.3), ("a", "f", 0.0), ("x", "y", 0.99)], "p1 string, p2 string, score double")
    pairs = spark.createDataFrame([("b", "a", "pos"), ("a", "b", "neg"), ("a", "c", "neg"), ("a", "d", "pos"), ("a", "e", "pos"), ("a", "f", "neg"), ("q", "r", "pos"), ("s", "t", "neg")], "p1 string, p2 string, label string")
    gold = ev.gold(pairs)
    cumulative = ev.cumulative_pr(ev.label_scores(scores, gold), gold)
    rows = cumulative.orderBy("rank").collect()
    assert [(r.p2, r.tp, r.fp) for r in rows] == [("b", 1, 0), ("c", 1, 1), ("d", 2, 1), ("e", 3, 1)]
    best = ev.best_f1(cumulative).collect()[0]
    assert best.threshold == 0.3 and math.isclose(best.precision, 0.75) and math.isclose(best.recall, 0.75)
    cut = spark.createDataFrame([(0.5,)], "threshold double")
    found = {(r["class"], r.p1, r.p2) for r in ev.error_samples(scores, gold, cut).collect()}
    assert found == {("TP", "a", "b"), ("FP", "a", "c"), ("TP", "a", "d"), ("FN", "a", "e"), ("FN", "q", "r"), ("TN", "a", "f"), ("TN", "s", "t")}
    assert ev.best_f1(ev.cumulative_pr(ev.label_scores(scores.limit(0), gold), gold)).count() == 0


def test_streamed_triples(spark, tmp_path):
    from lexiloom.streaming.counts import streamed_triples

    (tmp_path / "in").mkdir()
    for i in range(2):
        (tmp_path / "in" / f"{i}.txt").write_text("\n".join(CORPUS))
    stream = spark.readStream.text(str(tmp_path / "in"))
    query = streamed_triples(stream).writeStream.outputMode("complete").format("memory").queryName("streamed").option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r.path, r.slot, r.word): r.cnt for r in spark.table("streamed").collect()}
    assert got == {(r.path, r.slot, r.word): 2 * r.cnt for r in pipeline.triples_of(lines(spark)).collect()}


def test_odd_scores_and_gold_files(spark, tmp_path, caplog):
    (tmp_path / "scores").write_text("a\tb\tNaN\na\tb\t0.5\nc\td\t-1\nc\td\nx\ty\tz\n")
    assert [tuple(r) for r in read_scores(spark, str(tmp_path / "scores")).collect()] == [("a", "b", 0.5)]
    nan = spark.createDataFrame([("a", "b", float("nan")), ("b", "a", 0.25)], "p1 string, p2 string, score double")
    assert [tuple(r) for r in ev.score_map(nan).collect()] == [("a", "b", 0.25)]
    with caplog.at_level("WARNING"):
        assert read_gold(spark, str(tmp_path / "none"), "pos").count() == 0
    assert "no gold file" in caplog.text
