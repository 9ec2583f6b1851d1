import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from lexiloom.llm import langid, quality, toxicity
from lexiloom.llm.common import sample_texts


def texts_of(seed, n, syllables, extra=()):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randrange(1, 4)))
    return [". ".join(" ".join([word() for _ in range(r.randrange(3, 15))] + ([r.choice(extra)] if extra and r.random() < 0.7 else [])) for _ in range(r.randrange(2, 9))) for _ in range(n)]


LANGUAGES = {"aa": ["th", "er", "ing", "and", "on"], "bb": ["sch", "ung", "ein", "der", "ü"], "cc": ["ción", "que", "los", "ñ", "as"]}


def test_language_of_whole_and_mixed_texts(spark, documents):
    rows = [(t, k) for i, (k, s) in enumerate(LANGUAGES.items()) for t in texts_of(i, 60, s)]
    model = langid.Model(rows, rounds=3)
    fresh = [(t, k) for i, (k, s) in enumerate(LANGUAGES.items()) for t in texts_of(i + 50, 20, s)]
    got, score, sure = model.predict(pa.array([t for t, _ in fresh], pa.large_string()))
    assert np.mean([g == k for g, (_, k) in zip(got, fresh)]) > 0.97 and ((score >= 0) & (score <= 1) & (sure >= score - 1e-9)).all()
    mixed = texts_of(90, 1, LANGUAGES["aa"])[0] * 4 + "\n" + texts_of(91, 1, LANGUAGES["bb"])[0]
    docs = documents([fresh[0][0], mixed, None, "", "12 !? 3", "\n\n", "x" * 100_000])
    out = {r.doc_id: r for r in langid.identify(docs, model).collect() if r.doc_id is not None}
    assert out[0].lang_pred == "aa" and out[1].lang_pred == "aa" and out[1].score < 0.99
    assert all((out[i].lang_pred, out[i].score) == ("und", 0.0) for i in (2, 3, 4, 5)) and out[6].lang_pred in LANGUAGES
    kept = langid.accept(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} & {2, 3, 4, 5} == set()
    empty = langid.Model([])
    assert empty.predict(pa.array(["abc", None], pa.large_string()))[0] == ["und", "und"]
    assert langid.identify(docs.limit(0), model).count() == 0


def test_forward_backward_against_enumeration():
    r = np.random.default_rng(1)
    emit, move, start = r.normal(size=(9, 3)), r.normal(size=(3, 3)), r.normal(size=3)
    first, length = np.array([0, 4, 5]), np.array([4, 1, 4])
    got, expected, total = langid.forward_backward(emit, first, length, move, start, True)
    want, pairs, logs = np.zeros_like(emit), np.zeros((3, 3)), 0.0
    for a, n in zip(first, length):
        weights = {}
        for path in np.ndindex(*[3] * n):
            weights[path] = np.exp(start[path[0]] + sum(emit[a + i, y] for i, y in enumerate(path)) + sum(move[x, y] for x, y in zip(path, path[1:])))
        z = sum(weights.values())
        logs += np.log(z)
        for path, w in weights.items():
            for i, y in enumerate(path):
                want[a + i, y] += w / z
            for x, y in zip(path, path[1:]):
                pairs[x, y] += w / z
    assert np.allclose(got, want) and np.allclose(expected, pairs) and np.isclose(total, logs)


def plain_features(word, lexicon):
    """Feature numbers of one word, by plain loops over its letters between marks."""
    mask, base = 2**64 - 1, 0xD6E8FEB86659FD93

    def mixed(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
        return x ^ (x >> 31)

    c = [2, *map(ord, word), 3]
    out = [2 * langid.TABLE] + ([2 * langid.TABLE + 1 + lexicon[word]] if word in lexicon else [])
    for k in range(1, 5):
        for i in range(len(c) - k + 1):
            h = 0
            for x in c[i : i + k]:
                h = (h * base + x) & mask
            if k > 1 or c[i] > 3:
                out.append(mixed((h * 8 + k) & mask) >> 49)
            if k > 1:
                out += [langid.TABLE + (mixed((h * 8 + k + 4) & mask) >> 49)] * (i == 0 or i + k == len(c))
    return out


def plain_predict(model, text):
    """Language, score and confidence of one text: chains by lines, forward-backward word by word."""
    votes, sure, letters = np.zeros(len(model.languages)), 0.0, 0
    for line in (text or "").lower().split("\n"):
        words = [w for w in langid.WORD.findall(line) if w != "\n"]
        if not words:
            continue
        e = [np.exp(np.sum([model.table[f].astype(float) for f in plain_features(w, model.lexicon)], 0) / 4) for w in words]
        e = [x / x.max() for x in e]
        go, ahead, behind = np.exp(model.move), [np.exp(model.start) * e[0]], [np.ones(len(votes))]
        for x in e[1:]:
            ahead.append(ahead[-1] / ahead[-1].sum() @ go * x)
        for x in e[:0:-1]:
            behind.append(go @ (x * behind[-1] / behind[-1].sum()))
        for w, a, b in zip(words, ahead, reversed(behind)):
            p = a * b / (a * b).sum()
            votes, sure, letters = votes + p * len(w), sure + p.max() * len(w), letters + len(w)
    if not letters:
        return "und", 0.0, 0.0
    best = int(np.argmax(np.round(votes, 6)))
    return model.languages[best], votes[best] / letters, sure / letters


def test_predictions_match_plain_loops(monkeypatch):
    rows = [(t, k) for i, (k, s) in enumerate(LANGUAGES.items()) for t in texts_of(i, 25, s)]
    model = langid.Model(rows, rounds=2)
    texts = [*texts_of(70, 4, LANGUAGES["aa"]), "Ein und\nthe and on\n\nque los " * 5, "", None, "12 !", "é " * 40, "Über den Ñ los"]
    for block in (128, 3):
        monkeypatch.setattr(langid, "BLOCK", block)
        got = model.predict(pa.array(texts, pa.large_string()))
        for t, lang, score, sure in zip(texts, *got):
            want = plain_predict(model, t)
            assert lang == want[0] and score == pytest.approx(want[1], abs=1e-4) and sure == pytest.approx(want[2], abs=1e-4)


@pytest.mark.parametrize("block", [1, 5, 128])
def test_blocks_of_chains_are_exact(monkeypatch, block):
    monkeypatch.setattr(langid, "BLOCK", block)
    r = np.random.default_rng(1)
    length = np.array([1, 4, 5, 6, 12, 23, 3, 40, 1])
    first = np.cumsum(length) - length
    emit, move, start = r.normal(size=(length.sum(), 3)) * 3, r.normal(size=(3, 3)), r.normal(size=3)
    assert np.allclose(langid.marginals(emit, first, length, move, start), langid.forward_backward(emit, first, length, move, start))


def test_a_long_line_takes_time_by_its_length():
    model = langid.Model([(t, k) for i, (k, s) in enumerate(LANGUAGES.items()) for t in texts_of(i, 10, s)], rounds=1)
    text = " ".join(texts_of(5, 40, LANGUAGES["aa"])).replace("\n", " ") * 60
    assert len(text) > 300_000
    began = time.time()
    assert model.predict(pa.array([text], pa.large_string()))[0] == ["aa"] and time.time() - began < 10


def test_every_language_is_learned(spark):
    rows = [(3 * i + j, f"w{chr(97 + i % 26)}{chr(97 + i // 26)} " * 6, f"l{i:02}") for i in range(70) for j in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, sample=2)
    assert model.languages == sorted({x for _, _, x in rows})


def test_samples_are_the_same_on_every_run_and_bounded(spark):
    rows = [(1, "the same row", "a")] * 300 + [(i, f"text {i} " + "x" * (i % 50), "a") for i in range(100, 400)] + [(7, "y" * 5000, "b"), (8, None, "b"), (9, "z", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    take = lambda df, **k: sample_texts(df, "lang", "text", "doc_id", 20, **k)
    got = take(docs)
    assert got == take(docs.repartition(7)) and len(got) == len(set(got)) and sorted({y for _, y in got}) == ["a", "b"]
    assert 10 <= sum(y == "a" for _, y in got) <= 20 and [t for t, y in got if y == "b"] == ["y" * 5000]
    small = take(docs, most_bytes=400)
    assert sum(len(t) for t, y in small if y == "a") <= 200 + 60 and [t for t, y in small if y == "b"] == ["y" * 5000]
    assert len(take(docs, most_rows=6)) == 4 and take(docs.limit(0)) == []
    with pytest.raises(ValueError):
        take(docs, most_rows=1)


def test_repeated_rows_get_equal_results(spark):
    texts = [*texts_of(1, 3, LANGUAGES["aa"]), *texts_of(2, 3, LANGUAGES["bb"])]
    docs = spark.createDataFrame([(i % 6, texts[i % 6]) for i in range(600)], "doc_id long, text string").repartition(8)
    lang = langid.Model([(t, "aa" if i < 3 else "bb") for i, t in enumerate(texts)], rounds=1)
    tox, good = toxicity.Model(texts[:3], texts[3:]), quality.Model(texts, [0, 0, 0, 1, 1, 1])
    for out in (langid.identify(docs, lang), toxicity.score_toxicity(docs, tox), quality.score_quality(docs, good)):
        assert out.distinct().count() == 6


def test_toxicity_ranks_held_out_texts(spark, documents):
    bad = ["wretchword", "vilename", "foulterm"]
    plain, toxic = texts_of(1, 200, LANGUAGES["aa"]), texts_of(2, 200, LANGUAGES["aa"], bad)
    model = toxicity.Model(toxic, plain)
    fresh = [*texts_of(3, 60, LANGUAGES["aa"]), *texts_of(4, 60, LANGUAGES["aa"], bad)]
    score = model.score(pa.array(fresh, pa.large_string()))
    assert np.mean(score[:60] < 0.5) > 0.9 and np.mean(score[60:] >= 0.5) > 0.85
    docs = documents([fresh[0], fresh[-1], None, "", "x" * 100_000])
    out = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, model).collect() if r.doc_id is not None}
    assert out[2] == out[3] and all(0 <= s <= 1 for s in out.values()) and np.isclose(out[0], score[0])
    assert toxicity.Model([], []).score(pa.array(["a"])).tolist() == [0.0] and toxicity.score_toxicity(docs.limit(0), model).count() == 0


def test_toxicity_scores_match_plain_loops():
    """Windows, savings, features and scores again, by plain loops and fresh compressors."""
    bad = ["wretchword", "vilename", "foulterm"]
    toxic, plain = texts_of(2, 80, LANGUAGES["aa"], bad), texts_of(1, 80, LANGUAGES["aa"])
    model = toxicity.Model(toxic, plain)
    texts = [*texts_of(7, 5, LANGUAGES["aa"], bad), "", "W1, w2;w3 " * 9, "x" * 700, "Ünd é"]

    def length(window, content):
        how = zstandard.ZstdCompressionParameters(**toxicity.SETTINGS, **toxicity.FRAME)
        c = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how)
        return len(c.compress(b" " + window + b" "))

    for t, score in zip(texts, model.score(pa.array(texts, pa.large_string()))):
        low = re.sub(rb"[A-Z]", lambda m: m[0].lower(), t.encode())
        found = [m.span() for m in re.finditer(rb"[0-9a-z\x80-\xff]+", low)]
        saved = []
        for i in range(0, len(found), toxicity.WINDOW_WORDS):
            a, b = found[i][0], found[min(i + toxicity.WINDOW_WORDS, len(found)) - 1][1]
            pieces = [(a, b)] if b - a <= 2 * toxicity.WINDOW_BYTES else [(k, min(b, k + toxicity.WINDOW_BYTES)) for k in range(a, b, toxicity.WINDOW_BYTES)]
            for x, y in pieces:
                w = re.sub(rb"[^0-9a-z\x80-\xff]", b" ", low[x:y])
                saved.append(length(w, model.dictionaries[1]) - length(w, model.dictionaries[0]))
        n = len(saved)
        x = [1, np.log1p(n) / 4, np.clip(max([-8, *saved]), -8, 24) / 8]
        for k in toxicity.THRESHOLDS:
            over = sum(s >= k for s in saved)
            x += [np.log1p(over), over / max(n, 1) * 10]
        assert score == pytest.approx(1 / (1 + np.exp(-np.dot(x, model.weights))))


def test_toxicity_dictionaries_are_of_whole_windows_of_one_size():
    bad = ["wretchword", "vilename", "foulterm"]
    toxic, plain = texts_of(2, 80, LANGUAGES["aa"], bad), texts_of(1, 80, LANGUAGES["aa"])
    model = toxicity.Model(toxic, plain)
    a, b = model.dictionaries
    assert len(a) == len(b)
    stock = next(i for i in range(len(a)) if a[i:] == b[i:])
    assert 0 < stock < len(a) and b"wret" in a[:stock] and b"wret" not in b
    assert toxicity.ranked(np.array([0.1, 0.4, 0.4, 0.8]), np.array([0, 1, 0, 1])) == 0.875


def test_windows_that_two_texts_have_are_not_trained_on():
    texts = ["a b c d e f g h i j k l m n o p", "q r s t u v w x", "z y x w v u t s a b c d e f g h", "only words of its own stand here now yes"]
    own, _ = toxicity.windows(pa.array(texts, pa.large_string()))
    assert dict(zip(own, toxicity.copied(texts))) == {b"a b c d e f g h": True, b"i j k l m n o p": False, b"q r s t u v w x": False, b"z y x w v u t s": False, b"only words of its own stand here": False, b"now yes": False} or len(own) == 7


def test_quality_votes(spark, documents):
    good = texts_of(1, 150, LANGUAGES["aa"])
    junk = lambda ts: [t.upper().replace(" ", "!! ") for t in ts]
    model = quality.Model([*good, *junk(texts_of(2, 60, LANGUAGES["aa"]))], [1] * 150 + [0] * 60)
    fresh = [*texts_of(3, 50, LANGUAGES["aa"]), *junk(texts_of(4, 50, LANGUAGES["aa"]))]
    score = model.score(pa.array(fresh, pa.large_string()))
    assert np.mean(score[:50] >= 0.5) > 0.95 and np.mean(score[50:] < 0.5) > 0.95
    docs = documents([fresh[0], fresh[-1], None, "", "x" * 100_000])
    out = {r.doc_id: r.score for r in quality.score_quality(docs, model).collect() if r.doc_id is not None}
    assert out[2] == out[3] == 0.5 and all(0 <= s <= 1 for s in out.values()) and np.isclose(out[0], score[0])
    assert quality.Model(["a"], [1]).score(pa.array(["b"])).tolist() == [1.0] and quality.score_quality(docs.limit(0), model).count() == 0


def test_neighbours_are_exact():
    model = quality.Model([*texts_of(1, 40, LANGUAGES["aa"]), *texts_of(2, 40, LANGUAGES["bb"])], [1] * 40 + [0] * 40)
    t = pa.array(texts_of(5, 3, LANGUAGES["bb"]), pa.large_string())
    v = model.normed(model.weighted(quality.counts(t)) @ model.axes)
    for i, s in enumerate(model.score(t)):
        near = sorted(range(80), key=lambda j: -float(v[i] @ model.vectors[j]))[: quality.NEAREST]
        w = [max(0.0, float(v[i] @ model.vectors[j])) ** 2 * model.weight[j] for j in near]
        assert s == pytest.approx(sum(a * model.labels[j] for a, j in zip(w, near)) / sum(w), abs=1e-4)


@pytest.mark.parametrize("module,mod,rest,held", [(toxicity, 5, 0, "toxic"), (quality, 3, 1, "quality")])
def test_queries_on_held_out_rows(spark, sf, module, mod, rest, held):
    rows = module.query(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == rest) and r.predicted == (r.score >= 0.5) for r in rows)


def test_language_query_on_held_out_rows(spark, sf):
    rows = langid.query(spark, sf).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows) and len(rows) == len(lang)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.95
