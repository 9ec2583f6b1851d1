"""Every operator on a table whose other columns have the names that the operators use themselves."""

import pytest

from lexiloom.llm import bpe, decontam, langid, licenses, neardup, quality, secret_scan, sharding, topk, toxicity

NAMES = """d0 d1 k0 k1 column_0 column_1 _gone gone doc_text doc_doc_text candidates base_sha256 row found body text_in cut score
lang_pred confidence n_words n_hit items spans clean_text text_key all_items all_spans key band rep comp tile piece pieces n_rows
id label rate h place so_far size shard slot curve cell salt level0 value word bits n_shingles n_bytes set_key bands sig
component_id kept reports license ids n_tokens decoded_sha256 query_id rank part v hash repo own live text_crc32 law grown_shard""".split()
TEXTS = ["the one and only text that is here for all to see", None, "", "password=hunter22abc and ghp_aB3dE5fG7hI9jK1lM3nO5pQ7rS9tU so", "Released under the MIT License. " * 2, "der und die oder das ein"]


@pytest.fixture(scope="module")
def docs(spark):
    fields = ", ".join(["doc_id long", "text string", "lang string", "source string", "n_chars int", *[f"`{n}` string" for n in NAMES], "`odd ``name` string", "`with.dot` string"])
    rows = [(i, t, "aa", None if i % 2 else "s", 1, *[f"{n}{i}" for n in NAMES], "o", None) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[0], (None,) * len(rows[0])], fields)


def others(df):
    return [c for c in df.columns if c not in ("doc_id", "text", "n_chars")]


def same_rows(got, docs):
    """All columns but the text and its length are as before, in every row that is left."""
    assert got.columns == docs.columns
    quoted = ["`" + c.replace("`", "``") + "`" for c in ["doc_id", *others(docs)]]
    assert {tuple(r) for r in got.select(*quoted).collect()} <= {tuple(r) for r in docs.select(*quoted).collect()}


def test_filters_keep_columns_and_rows(spark, docs):
    model = langid.Model([(t, "aa") for t in TEXTS if t] + [("der die das", "bb")], rounds=1)
    bench = spark.createDataFrame([(1, "text that is here")], "item_id long, text string")
    for got in (langid.accept(docs, model, least=0.0), neardup.deduplicate(docs), secret_scan.redact(docs), decontam.decontaminate(docs, bench), decontam.decontaminate(docs, bench, chunk_bytes=1, remove="documents")):
        same_rows(got, docs)
    assert secret_scan.redact(docs).count() == docs.count()
    assert {r.doc_id: r.text for r in secret_scan.redact(docs).collect()}[3] == "password=[SECRET] and [SECRET] so"


def test_scans_keep_what_is_asked_for(spark, docs):
    model = langid.Model([(t, "aa") for t in TEXTS if t], rounds=1)
    bench = spark.createDataFrame([(1, "text that is here")], "item_id long, text string")
    both = spark.createDataFrame([(1, "other text of items that is not here at all"), (2, "only text that is here")], "item_id long, text string")
    tox, good = toxicity.Model(["a b", "c d"], ["e f", "g h"]), quality.Model(["a b", "c d"], [0, 1])
    made = {
        "identify": langid.identify(docs, model, keep=docs.columns),
        "secrets": secret_scan.scan_secrets(docs, keep=docs.columns),
        "licenses": licenses.scan_licenses(docs, keep=docs.columns),
        "one chunk": decontam.scan_benchmark(docs, bench, keep=docs.columns),
        "two chunks": decontam.scan_benchmark(docs, both, keep=docs.columns, chunk_bytes=1, clean=True),
        "ids": bpe.encode(docs, keep=docs.columns),
        "round trip": bpe.round_trip(docs, keep=docs.columns),
        "toxicity": toxicity.score_toxicity(docs, tox, keep=docs.columns),
        "quality": quality.score_quality(docs, good, keep=docs.columns),
        "decoded": bpe.decode(bpe.encode(docs, keep=[c for c in docs.columns if c != "ids"]), out="text"),
    }
    for name, got in made.items():
        low = [c.lower() for c in got.columns]
        assert len(low) == len(set(low)) and {c.lower() for c in docs.columns} <= set(low) | {"ids"}, name
        assert got.count() == docs.count(), name


def test_tables_of_results(spark, docs):
    assert neardup.near_duplicates(docs).count() == docs.count() == sharding.shard(docs).count()
    vectors = spark.createDataFrame([(i, [float(i), 1.0], "x", "y", "z") for i in range(5)], "vec_id long, embedding array<double>, query_id string, score string, v string")
    assert topk.top_k(vectors, vectors).count() == 20


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    model = langid.Model([], rounds=1)
    bench = spark.createDataFrame([(1, "text that is here")], "item_id long, text string")
    for got in (langid.accept(none, model), neardup.deduplicate(none), secret_scan.redact(none), decontam.decontaminate(none, bench), decontam.decontaminate(none, bench.limit(0))):
        assert got.columns == docs.columns and got.count() == 0
    for got in (bpe.round_trip(none), licenses.scan_licenses(none), sharding.shard(none), secret_scan.scan_secrets(none)):
        assert got.count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert toxicity.fit(none, labels).score is not None and quality.fit(none, labels).labels is None and langid.fit(none).languages == []
