import random

import pytest
from pyspark.sql import functions as F

from lexiloom.llm import decontam


def corpus(seed=4):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["É", "ÀB", "the"]
    items = [(i, " ".join(r.choice(words) for _ in range(r.choice([0, 1, 2, 5, 9, 10, 11, 25])))) for i in range(14)] + [(90, None), (None, "w1 w2 w3 w4"), (91, "?!"), (92, "the")]
    texts = []
    for _ in range(60):
        t = " ".join(r.choice(words) for _ in range(r.randrange(40)))
        if r.random() < 0.6:
            own = r.choice(items)[1] or ""
            t += ", " + own.upper().replace("É", "É") + "-" + t[:30]
        texts.append(t)
    return [*texts, "", None, "x" * 100_000, "W1 w2,w3.w4"], items


@pytest.mark.parametrize("chunk", [1 << 26, 60])
def test_hits_match_plain_search(spark, documents, chunk):
    texts, items = corpus()
    docs = documents(texts)
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("n_hit", F.lit("x"))
    want = decontam.brute(list(enumerate(texts)), items)
    rows = decontam.scan_benchmark(docs, bench, keep=["doc_id", "text", "n_words"], chunk_bytes=chunk, clean=True).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r.doc_id is not None:
            n, hit, names = want[r.doc_id]
            assert (r.n_words, r.n_hit, r["items"]) == (n, hit, sorted(x for x in names if x != "None"))
            assert sum(s.end_word - s.first_word for s in r.spans) == hit
            raw = (r.text or "").encode()
            if hit:
                assert r.clean_text == decontam.cut(raw, [tuple(s) for s in r.spans])


def test_removal_keeps_clean_documents_and_columns(spark, documents):
    texts, items = corpus(9)
    docs = documents(texts).withColumn("n_chars", F.length("text").cast("long"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    hits = {d: v for d, v in decontam.brute(list(enumerate(texts)), items).items()}
    out = decontam.decontaminate(docs, bench)
    assert out.columns == docs.columns
    rows = {r.doc_id: r for r in out.collect() if r.doc_id is not None}
    for d, (n, hit, _) in hits.items():
        if not hit:
            assert rows[d].text == texts[d]
        elif hit == n:
            assert d not in rows
        else:
            assert rows[d].text != texts[d] and rows[d].n_chars == len(rows[d].text)
    kept = {r.doc_id for r in decontam.decontaminate(docs, bench, remove="documents").collect() if r.doc_id is not None}
    assert kept == {d for d, v in hits.items() if not v[1]}


def test_one_text_many_times_with_many_chunks(spark):
    r = random.Random(1)
    items = [(i, " ".join(f"w{r.randrange(900)}" for _ in range(14))) for i in range(40)]
    text = "so " + ". ".join(t for _, t in items[::2]) + " end"
    docs = spark.range(10_000).select(F.col("id").alias("doc_id"), F.lit(text).alias("text"))
    out = decontam.scan_benchmark(docs, spark.createDataFrame(items, "item_id long, text string"), chunk_bytes=1000, clean=True)
    n, hit, names = decontam.brute([(0, text)], items)[0]
    got = out.groupBy("n_words", "n_hit", "items", "clean_text").count().collect()
    assert [(x.n_words, x.n_hit, x["items"], x["count"]) for x in got] == [(n, hit, names, 10_000)]


def test_windows_take_a_few_bytes_for_a_byte_of_items():
    import pickle

    r = random.Random(5)
    items = [(str(i), " ".join("".join(r.choice("abcdefgh") for _ in range(r.randrange(3, 9))) for _ in range(400))) for i in range(400)]
    size = sum(len(t) for _, t in items)
    assert len(pickle.dumps(decontam.WindowSet(items, 10))) < 6 * size + (1 << 20)


def test_empty_tables(spark, documents):
    docs, none = documents(["a b c", None]), spark.createDataFrame([], "item_id long, text string")
    assert decontam.scan_benchmark(docs, none).filter("n_hit > 0").count() == 0
    assert decontam.scan_benchmark(docs.limit(0), none).count() == 0
