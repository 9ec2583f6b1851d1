"""Queries of the engine's own operators over corpora made from the test tables, with the SQL they must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.phrases import phrase_to_path, phrase_to_path_eval
from ..functions.stem import DERIVED, REMOVED, SHORTENED, identity, stem, stem_lower, stem_vocabulary
from ..operators import counts, evaluate as ev, paths, similarity as sim
from ..operators.mi import mi_scores, sum_mi
from ..operators.parse import parse_lines, parse_tokens
from ..sources.readers import document_corpus, odd_corpus, read_corpus, read_gold, read_pairs, read_scores, star_corpus, star_phrases, table
from ..sources.sinks import TAGS, write_tagged, write_tsv
from .session import scratch_path


def _parsed(s, d):
    return parse_tokens(parse_lines(star_corpus(s, d)))


def _extracted(s, d, stemmed=False):
    return paths.extract_ngrams(parse_lines(star_corpus(s, d)), stemmed)


def _triples(s, d, stemmed=False):
    return counts.triples(_extracted(s, d, stemmed))


def _mi(s, d, stemmed=False):
    return mi_scores(_triples(s, d, stemmed).persist()).persist()


def _pairs(s, d, stemmed=False):
    return sim.convert_pairs(star_phrases(s, d), stem if stemmed else identity)


def _scores(s, d, stemmed=False):
    return sim.final_similarity(_mi(s, d, stemmed), _pairs(s, d, stemmed)).persist()


def _gold(s, d, stemmed=False):
    return ev.gold(_pairs(s, d, stemmed))


def _judged(s, d, stemmed=False):
    """Scores, gold labels, and the ranking of the one by the other."""
    scores, gold = _scores(s, d, stemmed), _gold(s, d, stemmed).persist()
    return scores, gold, ev.cumulative_pr(ev.label_scores(scores, gold), gold)


def _cumulative(s, d):
    return _judged(s, d)[2]


def _with_cut(s, d):
    scores, gold, cumulative = _judged(s, d)
    return scores, gold, ev.threshold(ev.best_f1(cumulative)).persist()


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# Phrases that show every rule of the converters.
PHRASES = [
    "X cause Y", "X die from Y", "X be in Y", "X treat by Y", "X be treat by Y", "Y resemble X", "X carry out by Y",
    "X carry out with Y", "X run fast with Y", "X is Y", "X", "X Y", "X Go To Y", "X be give Up On Y", "X by Y", "",
]


def _phrases(s):
    return s.createDataFrame([(p,) for p in PHRASES], "phrase string")


def _parse_tokens(parsed):
    t = F.explode("tokens").alias("t")
    return parsed.select("cnt", t).groupBy("t.word", "t.pos", "t.dep", "t.head").agg(F.count(F.lit(1)).alias("n"), F.sum("cnt").alias("cnt")).select("word", "pos", "dep", "head", "n", "cnt")


def _noun_pairs(s, d):
    pairs = paths.noun_pairs(_parsed(s, d))
    return pairs.groupBy(F.element_at("tokens", F.col("src"))["word"].alias("x"), F.element_at("tokens", F.col("dst"))["word"].alias("y")).agg(F.count(F.lit(1)).alias("n"))


def _document_triples(s, d):
    return counts.triples(paths.extract_ngrams(parse_lines(document_corpus(s, d)), stemmed=False))


def _document_path_margins(s, d):
    return counts.path_margins(_document_triples(s, d)).groupBy("slot").agg(F.count(F.lit(1)).alias("paths"), F.sum("ps").alias("total"), F.max("ps").alias("most"))


def _stem_vocabulary(s, d):
    words = table(s, d, "documents").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("w")).filter("w <> ''")
    return stem_vocabulary(words, "w")


def _counted(df, *by):
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("cnt").alias("cnt"))


def _odd(s, d):
    return parse_lines(odd_corpus(s, d))


def _corpus_files(s, d):
    """The corpus as compressed files in two folders, read back by a glob and a path."""
    out = scratch_path(s)
    lines = star_corpus(s, d).withColumn("side", F.pmod(F.xxhash64("value"), F.lit(3)))
    for k in range(3):
        lines.filter(f"side = {k}").select("value").write.text(f"{out}/part{k}", compression="gzip" if k else None)
    return parse_lines(read_corpus(s, f"{out}/part[01],{out}/part2/*.gz"))


def _phrase_files(s, d):
    """Positive and negative pairs as files, with lines that are none; and a path where no file is."""
    out, phrases = scratch_path(s), star_phrases(s, d)
    for label in ("pos", "neg"):
        own = phrases.filter(F.col("label") == label).select("phrase1", "phrase2")
        write_tsv(own.unionByName(s.createDataFrame([("X Y", "one two three four five"), ("", "")], own.schema)), f"{out}/{label}")
        s.createDataFrame([("one field",), ("",)], "value string").write.mode("append").text(f"{out}/{label}")
    return f"{out}/pos", f"{out}/neg", f"{out}/none"


def _read_pairs(s, d):
    pos, neg, _ = _phrase_files(s, d)
    phrases = read_pairs(s, pos, "pos").unionByName(read_pairs(s, neg, "neg"))
    return ev.gold(sim.convert_pairs(phrases, identity))


def _read_gold(s, d):
    pos, neg, none = _phrase_files(s, d)
    return read_gold(s, pos, "pos", identity).unionByName(read_gold(s, neg, "neg", identity)).unionByName(read_gold(s, none, "neg"))


def _score_files(s, d):
    out, scores = scratch_path(s), _scores(s, d)
    write_tsv(scores, out)
    odd = ["a\tb", "a\tb\tNaN", "a\tb\t-1", "a\tb\t0", "a\tb\tx", "", "  p\tq\t0.5\tmore  "]
    s.createDataFrame([(x,) for x in odd], "value string").write.mode("append").text(out)
    return _rounded(read_scores(s, out), "score")


def _tagged_files(s, d):
    out = scratch_path(s)
    write_tagged(_triples(s, d), out)
    back = s.read.parquet(out)
    tag = F.create_map(*[F.lit(x) for k, v in TAGS.items() for x in (v, k)])
    return back.select(tag[F.col("family")].alias("tag"), "path", "slot", "word", "cnt")


QUERIES = {
    "parse_lines": lambda s, d: _counted(parse_lines(star_corpus(s, d)), "ngram"),
    "read_corpus_files": lambda s, d: _counted(_corpus_files(s, d), "ngram"),
    "read_phrase_files": _read_pairs,
    "read_gold_files": _read_gold,
    "read_score_files": _score_files,
    "write_tagged_files": _tagged_files,
    "odd_lines": lambda s, d: _counted(_odd(s, d), "ngram"),
    "odd_tokens": lambda s, d: _parse_tokens(parse_tokens(_odd(s, d))),
    "odd_paths": lambda s, d: _counted(paths.extract_ngrams(_odd(s, d)), "path", "x", "y"),
    "odd_noun_pair_paths": lambda s, d: _counted(paths.noun_pair_paths(parse_tokens(_odd(s, d))).withColumn("place", F.array_join("path", " ")), "place"),
    "extract_paths_stemmed": lambda s, d: _counted(_extracted(s, d, True), "path", "x", "y"),
    "triples_stemmed": lambda s, d: _triples(s, d, True),
    "mi_scores_stemmed": lambda s, d: _rounded(_mi(s, d, True), "mi"),
    "final_similarity_stemmed": lambda s, d: _rounded(_scores(s, d, True), "score"),
    "best_f1_stemmed": lambda s, d: _rounded(ev.best_f1(_judged(s, d, True)[2]), "threshold", "f1", "precision", "recall"),
    "phrase_to_path_stemmed": lambda s, d: _phrases(s).select("phrase", phrase_to_path(F.col("phrase")).alias("path")),
    "phrase_to_path_eval_stemmed": lambda s, d: _phrases(s).select("phrase", phrase_to_path_eval(F.col("phrase"), stem_lower).alias("path")),
    "parse_tokens": lambda s, d: _parse_tokens(_parsed(s, d)),
    "noun_pairs": _noun_pairs,
    "extract_paths": lambda s, d: _counted(_extracted(s, d), "path", "x", "y"),
    "reject_aux_and_nonverb": lambda s, d: paths.noun_pair_paths(_parsed(s, d)).groupBy(paths.has_content_verb(F.col("tokens"), F.col("path")).alias("kept")).agg(F.count(F.lit(1)).alias("n")),
    "slots": lambda s, d: counts.slots(_extracted(s, d)).groupBy("slot").agg(F.count(F.lit(1)).alias("n"), F.sum("cnt").alias("cnt")),
    "triples": _triples,
    "word_margins": lambda s, d: counts.word_margins(_triples(s, d)),
    "path_margins": lambda s, d: counts.path_margins(_triples(s, d)),
    "global_n": lambda s, d: counts.global_n(_triples(s, d)),
    "margins_grouping_sets": lambda s, d: counts.margins_grouping_sets(_triples(s, d)),
    "document_triples": _document_triples,
    "document_path_margins": _document_path_margins,
    "mi_scores": lambda s, d: _rounded(_mi(s, d), "mi"),
    "sum_mi": lambda s, d: _rounded(sum_mi(_mi(s, d)), "sum_mi"),
    "phrase_to_path": lambda s, d: _phrases(s).select("phrase", phrase_to_path(F.col("phrase"), identity).alias("path")),
    "phrase_to_path_eval": lambda s, d: _phrases(s).select("phrase", phrase_to_path_eval(F.col("phrase"), identity).alias("path")),
    "pair_canonical": lambda s, d: sim.canonical(_pairs(s, d).select("p1", "p2")),
    "pair_neighbors": lambda s, d: sim.neighbours(_pairs(s, d)),
    "gold_labels": _gold,
    "overlap_numerators": lambda s, d: _rounded(sim.overlap_numerators(_mi(s, d), sim.canonical(_pairs(s, d).select("p1", "p2"))), "num_x", "num_y"),
    "final_similarity": lambda s, d: _rounded(_scores(s, d), "score"),
    "score_map": lambda s, d: _rounded(ev.score_map(_scores(s, d)), "score"),
    "label_scores": lambda s, d: _rounded(ev.label_scores(_scores(s, d), _gold(s, d)), "score"),
    "cumulative_pr": lambda s, d: _rounded(_cumulative(s, d).drop("p1", "p2", "rank").groupBy("tp", "fp").agg(*[F.max(c).alias(c) for c in ("score", "precision", "recall", "f1")]), "score", "precision", "recall", "f1"),
    "pr_curve": lambda s, d: _rounded(ev.pr_curve(_cumulative(s, d)), "recall", "precision"),
    "best_f1": lambda s, d: _rounded(ev.best_f1(_cumulative(s, d)), "threshold", "f1", "precision", "recall"),
    "missed_positives": lambda s, d: ev.missed_positives(_scores(s, d), _gold(s, d)),
    "true_negatives": lambda s, d: _rounded(ev.true_negatives(*_with_cut(s, d)), "score"),
    "error_samples": lambda s, d: _rounded(ev.error_samples(*_with_cut(s, d)), "score"),
    "stem_vocabulary": _stem_vocabulary,
}

BASE = """base AS (
  SELECT lower(c_mktsegment) AS x, lower(p_type) AS v, split_part(p_name, ' ', 2) AS y, l_linenumber % 5 AS k,
    CASE l_returnflag WHEN 'A' THEN 'in' WHEN 'N' THEN 'with' ELSE 'to' END AS prep,
    CASE WHEN (length(p_type) + length(c_mktsegment)) % 2 = 0 AND (length(p_type) + length(split_part(p_name, ' ', 2))) % 2 = 0
      THEN CAST(l_quantity AS BIGINT) ELSE 1 END AS cnt
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN part ON p_partkey = l_partkey
)"""
NGRAM = """CASE k WHEN 0 THEN x || '/NN/nsubj/2 ' || v || '/VBZ/ROOT/0 ' || y || '/NN/dobj/2'
  WHEN 1 THEN x || '/NN/nsubj/2 ' || v || '/VBZ/ROOT/0 ' || prep || CASE prep WHEN 'to' THEN '/TO' ELSE '/IN' END || '/prep/2 ' || y || '/NN/pobj/3'
  WHEN 2 THEN x || '/NN/nsubjpass/2 ' || v || '/VBN/ROOT/0 by/IN/prep/2 ' || y || '/NN/pobj/3'
  WHEN 3 THEN x || '/NN/nsubj/2 is/VBZ/ROOT/0 ' || y || '/NN/dobj/2'
  ELSE x || '/NN/nn/2 ' || y || '/NN/ROOT/0' END"""
EXTRACTED = f"""{BASE}, ex AS (
  SELECT CASE k WHEN 0 THEN 'N:<nsubj:V:' || v || ':>dobj:N' WHEN 1 THEN 'N:<nsubj:V:' || v || ':>prep:P:' || prep || ':>pobj:N'
    ELSE 'N:<nsubjpass:V:' || v || ':>prep:P:by:>pobj:N' END AS path, x, y, cnt
  FROM base WHERE k < 3
)"""
TRIPLES = f"""{EXTRACTED}, sl AS (
  SELECT path, 'X' AS slot, x AS word, cnt FROM ex UNION ALL SELECT path, 'Y', y, cnt FROM ex
), tr AS (SELECT path, slot, word, CAST(sum(cnt) AS BIGINT) AS cnt FROM sl GROUP BY ALL)"""
MI = f"""{TRIPLES}, ps AS (SELECT path, slot, sum(cnt)::DOUBLE AS ps FROM tr GROUP BY ALL
), sw AS (SELECT slot, word, sum(cnt)::DOUBLE AS sw FROM tr GROUP BY ALL
), mi AS (
  SELECT path, slot, word, ln(cnt::DOUBLE * (SELECT sum(cnt) FROM tr)::DOUBLE / (ps.ps * sw.sw)) AS mi
  FROM tr JOIN ps USING (path, slot) JOIN sw USING (slot, word)
  WHERE ln(cnt::DOUBLE * (SELECT sum(cnt) FROM tr)::DOUBLE / (ps.ps * sw.sw)) > 0.001
)"""
PAIRS = """verbs AS (SELECT DISTINCT lower(p_type) AS w, lower(p_type) AS v FROM part
), phrases AS (
  SELECT 'X ' || w || s || ' Y' AS phrase, CASE s WHEN '' THEN 'N:<nsubj:V:' || v || ':>dobj:N' WHEN ' by' THEN 'N:<nsubjpass:V:' || v || ':>prep:P:by:>pobj:N'
    WHEN ' badly enough at' THEN NULL ELSE 'N:<nsubj:V:' || v || ':>prep:P:' || trim(s) || ':>pobj:N' END AS path
  FROM verbs, (VALUES (''), (' in'), (' with'), (' to'), (' by'), (' badly enough at')) AS t(s)
), pr AS (
  SELECT a.path AS p1, b.path AS p2, CASE WHEN (length(a.phrase) + 2 * length(b.phrase)) % 3 = 0 THEN 'pos' ELSE 'neg' END AS label
  FROM phrases a JOIN phrases b ON a.phrase <= b.phrase WHERE a.path IS NOT NULL AND b.path IS NOT NULL
), cp AS (SELECT DISTINCT least(p1, p2) AS p1, greatest(p1, p2) AS p2 FROM pr
), gold AS (SELECT least(p1, p2) AS p1, greatest(p1, p2) AS p2, max(label) AS label FROM pr GROUP BY 1, 2)"""
SCORES = f"""{MI}, {PAIRS}, sm AS (SELECT path, slot, sum(mi) AS s FROM mi GROUP BY ALL
), ov AS (
  SELECT p1, p2, coalesce(sum(a.mi + b.mi) FILTER (a.slot = 'X'), 0) AS num_x, coalesce(sum(a.mi + b.mi) FILTER (a.slot = 'Y'), 0) AS num_y
  FROM cp JOIN mi a ON a.path = p1 JOIN mi b ON b.path = p2 AND b.slot = a.slot AND b.word = a.word WHERE p1 <> p2 GROUP BY p1, p2
), den AS (
  SELECT p1, p2, coalesce(ov.num_x, 0) AS num_x, coalesce(ov.num_y, 0) AS num_y,
    coalesce((SELECT s FROM sm WHERE path = cp.p1 AND slot = 'X'), 0) + coalesce((SELECT s FROM sm WHERE path = cp.p2 AND slot = 'X'), 0) AS dx,
    coalesce((SELECT s FROM sm WHERE path = cp.p1 AND slot = 'Y'), 0) + coalesce((SELECT s FROM sm WHERE path = cp.p2 AND slot = 'Y'), 0) AS dy
  FROM cp LEFT JOIN ov USING (p1, p2) WHERE p1 IN (SELECT path FROM mi) OR p2 IN (SELECT path FROM mi)
), sc AS (SELECT p1, p2, round(sqrt((CASE WHEN dx > 0 THEN num_x / dx ELSE 0 END) * (CASE WHEN dy > 0 THEN num_y / dy ELSE 0 END)), 9) AS score FROM den
), ls AS (SELECT p1, p2, score, label FROM sc JOIN gold USING (p1, p2) WHERE score > 0
), cu AS (
  SELECT row_number() OVER o AS rank, p1, p2, score, label,
    sum(CASE WHEN label = 'pos' THEN 1 ELSE 0 END) OVER (o ROWS UNBOUNDED PRECEDING) AS tp,
    sum(CASE WHEN label <> 'pos' THEN 1 ELSE 0 END) OVER (o ROWS UNBOUNDED PRECEDING) AS fp
  FROM ls WINDOW o AS (ORDER BY score DESC, p1, p2)
), pf AS (
  SELECT *, tp / (tp + fp) AS precision, tp / (SELECT count(*) FROM gold WHERE label = 'pos') AS recall FROM cu
), cf AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM pf
), best AS (SELECT * FROM cf ORDER BY f1 DESC, rank LIMIT 1
), cut AS (SELECT CASE WHEN score > 0 THEN score ELSE 0.01 END AS threshold FROM best
), tn AS (
  SELECT p1, p2, coalesce(score, 0) AS score FROM gold LEFT JOIN (SELECT * FROM sc WHERE score > 0) USING (p1, p2)
  WHERE label <> 'pos' AND coalesce(score, 0) < (SELECT threshold FROM cut)
), mp AS (SELECT p1, p2 FROM gold WHERE label = 'pos' AND (p1, p2) NOT IN (SELECT (p1, p2) FROM ls))"""
DOCUMENT = r"""w AS (SELECT list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '') AS w FROM documents
), g AS (SELECT w[i] AS x, w[i + 1] AS v, w[i + 2] AS y FROM w, LATERAL (SELECT unnest(range(1, len(w) - 1)) AS i)
), tr AS (
  SELECT 'N:<nsubj:V:' || v || ':>dobj:N' AS path, slot, word, count(*) AS cnt
  FROM (SELECT v, 'X' AS slot, x AS word FROM g UNION ALL SELECT v, 'Y', y FROM g)
  WHERE v NOT IN ('be','am','is','are','was','were','been','being','do','does','did','have','has','had','will','would','shall','should','can','could','may','might','must')
  GROUP BY ALL
)"""
_AT = "list_filter(regexp_split_to_array(regexp_replace(regexp_replace(phrase, '^X\\s+', ''), '\\s+Y$', ''), '\\s+'), lambda x: x <> '')".replace("\\\\", "\\")
_AUX = "('be','am','is','are','was','were','been','being','do','does','did','have','has','had','will','would','shall','should','can','could','may','might','must')"
_PHRASES = "(VALUES " + ", ".join(f"('{p}')" for p in PHRASES) + ") AS t(phrase)"
CONVERTED = f"""WITH a AS (SELECT phrase, {_AT} AS w FROM {_PHRASES}
), b AS (SELECT phrase, w, len(w) AS n, CASE WHEN len(w) >= 2 AND lower(w[1]) IN {_AUX} THEN 1 ELSE 0 END AS s FROM a)
SELECT phrase, CASE WHEN n = 0 THEN NULL WHEN n - s >= 2 AND lower(w[n]) = 'by' THEN 'N:<nsubjpass:V:' || w[n - 1] || ':>prep:P:by:>pobj:N'
  WHEN n - s = 1 THEN 'N:<nsubj:V:' || w[s + 1] || ':>dobj:N' WHEN n - s = 2 THEN 'N:<nsubj:V:' || w[s + 1] || ':>prep:P:' || lower(w[s + 2]) || ':>pobj:N'
  WHEN n - s = 3 AND lower(w[s + 2]) IN ('up','down','out','in','off','on','over','through')
    THEN 'N:<nsubj:V:' || w[s + 1] || lower(w[s + 2]) || ':>prep:P:' || lower(w[s + 3]) || ':>pobj:N' END AS path FROM b"""
CONVERTED_EVAL = f"""WITH a AS (SELECT phrase, list_filter(regexp_split_to_array(translate(phrase, 'XY', ''), '\\s+'), lambda x: x <> '') AS w FROM {_PHRASES})
SELECT phrase, CASE WHEN len(w) = 1 THEN 'N:<nsubj:V:' || w[1] || ':>dobj:N' WHEN len(w) = 2 AND w[2] <> 'by' THEN 'N:<nsubj:V:' || w[1] || ':>prep:P:' || w[2] || ':>pobj:N'
  WHEN len(w) = 2 THEN 'N:<nsubjpass:V:' || w[1] || ':>agent:P:by:>pobj:N' END AS path FROM a"""

# Stems traced by hand, of the words of the sales tables and of PHRASES that are not their own.
STEMS = {
    "furniture": "furnitur", "machinery": "machineri", "automobile": "automobil", "building": "build", "large": "larg",
    "economy": "economi", "cause": "caus", "resemble": "resembl", "carry": "carri",
}
_STEM = "stems(w, s) AS (VALUES " + ", ".join(f"('{w}', '{s}')" for w, s in STEMS.items()) + ")"


def _stemmed(sql: str) -> str:
    """The SQL over the sales tables with every word, and every verb of a phrase, stemmed."""
    of = lambda w: f"coalesce((SELECT s FROM stems WHERE stems.w = {w}), {w})"
    base = BASE.replace("base AS (", "raw AS (", 1) + f", {_STEM}, base AS (SELECT {of('raw.x')} AS x, {of('raw.v')} AS v, {of('raw.y')} AS y, k, prep, cnt FROM raw)"
    verbs = f"verbs AS (SELECT w, {of('p.w')} AS v FROM (SELECT DISTINCT lower(p_type) AS w FROM part) p"
    return sql.replace(BASE, base).replace("verbs AS (SELECT DISTINCT lower(p_type) AS w, lower(p_type) AS v FROM part", verbs)


def _stemmed_phrases(sql: str, lower: bool = False) -> str:
    """The same for the fixed phrases: the verb is what stands behind V:."""
    verb = "split_part(substr(path, strpos(path, ':V:') + 3), ':', 1)"
    return f"WITH {_STEM}, t AS ({sql}) SELECT phrase, replace(path, ':V:' || {verb} || ':', ':V:' || coalesce((SELECT s FROM stems WHERE stems.w = {verb}), {f'lower({verb})' if lower else verb}) || ':') AS path FROM t"


def _porter_sql(words: str) -> str:
    """word, stem of the words (a query with a column word, a to z): the published algorithm, a step a CTE."""
    form = lambda x: f"list_reduce(list_prepend('', string_split({x}, '')), lambda a, c: a || CASE WHEN c = '' THEN '' WHEN c IN ('a', 'e', 'i', 'o', 'u') OR (c = 'y' AND right(a, 1) = 'c') THEN 'v' ELSE 'c' END)"
    steps = [f"s0 AS (SELECT DISTINCT word, word AS w FROM ({words}))"]

    def step(expression: str, **made: str) -> None:
        """w becomes the expression over w and the columns made, each of which may use those before."""
        source = f"s{len(steps) - 1}"
        for name, x in made.items():
            source = f"(SELECT *, {x} AS {name} FROM {source})"
        steps.append(f"s{len(steps)} AS (SELECT word, {expression} AS w FROM {source})")

    cut = lambda n: f"left(w, length(w) - {n})"
    m = lambda f: f"len(regexp_extract_all({f}, 'vc'))"
    short = lambda f, x: f"({f} LIKE '%cvc' AND right({x}, 1) NOT IN ('w', 'x', 'y'))"
    doubled = lambda f, x: f"(length({x}) > 1 AND right({x}, 1) = left(right({x}, 2), 1) AND {f} LIKE '%c')"
    step(f"CASE WHEN w LIKE '%sses' OR w LIKE '%ies' THEN {cut(2)} WHEN w LIKE '%s' AND w NOT LIKE '%ss' THEN {cut(1)} ELSE w END")
    repaired = f"CASE WHEN b LIKE '%at' OR b LIKE '%bl' OR b LIKE '%iz' THEN b || 'e' WHEN {doubled('f', 'b')} THEN CASE WHEN right(b, 1) IN ('l', 's', 'z') THEN b ELSE left(b, length(b) - 1) END WHEN {m('f')} = 1 AND {short('f', 'b')} THEN b || 'e' ELSE b END"
    step(
        f"CASE WHEN w LIKE '%eed' THEN CASE WHEN {m('f')} > 0 THEN {cut(1)} ELSE w END WHEN (w LIKE '%ed' OR w LIKE '%ing') AND f LIKE '%v%' THEN {repaired} ELSE w END",
        b=f"CASE WHEN w LIKE '%eed' OR w LIKE '%ing' THEN {cut(3)} ELSE {cut(2)} END", f=form("b"),
    )
    step(f"CASE WHEN w LIKE '%y' AND {form(cut(1))} LIKE '%v%' THEN {cut(1)} || 'i' ELSE w END")
    for table, least in ((DERIVED, 0), (SHORTENED, 0), ([(x, x[0] if x in ("sion", "tion") else "") for x in sorted(REMOVED, key=len, reverse=True)], 1)):
        found = "CASE " + " ".join(f"WHEN w LIKE '%{x}' THEN '{x}:{new}'" for x, new in table) + " ELSE '' END"
        keep = "length(split_part(r, ':', 1))"
        new = "split_part(r, ':', 2)"
        base = f"left(w, length(w) - {keep})" if not least else f"left(w, length(w) - {keep}) || {new}"
        step(f"CASE WHEN r <> '' AND {m('f')} > {least} THEN b{'' if least else ' || ' + new} ELSE w END", r=found, b=base, f=form("b"))
    step(
        f"CASE WHEN e LIKE '%l' AND {doubled('g', 'e')} AND k > 1 THEN left(e, length(e) - 1) ELSE e END",
        k=m(form("w")), h=form(cut(1)), e=f"CASE WHEN w LIKE '%e' AND (k > 1 OR (k = 1 AND NOT {short('h', cut(1))})) THEN {cut(1)} ELSE w END", g=form("e"),
    )
    return f"WITH {', '.join(steps)} SELECT word, CASE WHEN length(word) < 3 THEN word ELSE w END AS stem FROM s{len(steps) - 1}"


# What the odd lines hold, read by hand: number of the line, then the n-gram and count; tokens; paths; places.
ODD_PARSED = [
    (0, "smoking/NN/nsubj/2 causes/VBZ/ROOT/0 cancer/NN/dobj/2", 1), (2, "a/NN/nsubj/2 eats/VB/ROOT/0 b/NN/dobj/2 c/NN/conj/3", 7),
    (3, "bad a/NN/nsubj/2 eats/VB/ROOT/0 b/NN/dobj/2 x/NN/y/z", 1), (4, "a/NN/x/9 runs/VB/ROOT/0 b/NN/dobj/2", 3),
    (5, "a/NN/d/2 eats/VB/e/3 c/NN/f/2", 2),
    (6, "man/NN/nsubj/3 has/VBZ/aux/3 eaten/VBN/ROOT/0 of/IN/prep/3 the/DT/det/6 bread/NN/pobj/4 in/IN/prep/6 Towns/NNS/pobj/7", 1),
    (7, "dog/NN/nsubj/2  takes/VB/ROOT/0 and/or/NN/dobj/2 x/y/1 /NN/dep/2", 4), (8, "", 3),
]
ODD_TOKENS = [
    (0, "smoking", "NN", "nsubj", 2), (0, "causes", "VBZ", "ROOT", 0), (0, "cancer", "NN", "dobj", 2),
    (2, "a", "NN", "nsubj", 2), (2, "eats", "VB", "ROOT", 0), (2, "b", "NN", "dobj", 2), (2, "c", "NN", "conj", 3),
    (3, "a", "NN", "nsubj", 2), (3, "eats", "VB", "ROOT", 0), (3, "b", "NN", "dobj", 2),
    (4, "a", "NN", "x", 9), (4, "runs", "VB", "ROOT", 0), (4, "b", "NN", "dobj", 2),
    (5, "a", "NN", "d", 2), (5, "eats", "VB", "e", 3), (5, "c", "NN", "f", 2),
    (6, "man", "NN", "nsubj", 3), (6, "has", "VBZ", "aux", 3), (6, "eaten", "VBN", "ROOT", 0), (6, "of", "IN", "prep", 3),
    (6, "the", "DT", "det", 6), (6, "bread", "NN", "pobj", 4), (6, "in", "IN", "prep", 6), (6, "Towns", "NNS", "pobj", 7),
    (7, "dog", "NN", "nsubj", 2), (7, "takes", "VB", "ROOT", 0), (7, "and/or", "NN", "dobj", 2), (7, "", "NN", "dep", 2),
]
ODD_PATHS = [
    (0, "N:<nsubj:V:caus:>dobj:N", "smoke", "cancer"), (2, "N:<nsubj:V:eat:>dobj:N", "a", "b"), (2, "N:<nsubj:V:eat:>dobj:W:b:>conj:N", "a", "c"),
    (3, "N:<nsubj:V:eat:>dobj:N", "a", "b"), (5, "N:<d:V:eat:<e:N", "a", "c"), (6, "N:<nsubj:V:eaten:>prep:P:of:>pobj:N", "man", "bread"),
    (6, "N:<nsubj:V:eaten:>prep:P:of:>pobj:W:bread:>prep:P:in:>pobj:N", "man", "Town"), (7, "N:<nsubj:V:take:>dobj:N", "dog", "and/or"),
    (7, "N:<nsubj:V:take:>dep:N", "dog", ""), (7, "N:<dobj:V:take:>dep:N", "and/or", ""),
]
ODD_PLACES = [
    (0, "1 2 3"), (2, "1 2 3"), (2, "1 2 3 4"), (2, "3 4"), (3, "1 2 3"), (5, "1 2 3"), (6, "1 3 4 6"), (6, "1 3 4 6 7 8"), (6, "6 7 8"),
    (7, "1 2 3"), (7, "1 2 4"), (7, "3 2 4"),
]


def _odd_sql(rows: list[tuple], columns: str) -> str:
    """Rows of the odd lines, as often as the lines occur, with the line's count."""
    values = ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
    count = ", ".join(f"({r[0]}, {r[2]})" for r in ODD_PARSED)
    return f"SELECT {columns}, count(*) AS n, CAST(sum(c.cnt) AS BIGINT) AS cnt FROM events JOIN (VALUES {values}) AS o(k, {columns}) ON event_id % 10 = o.k JOIN (VALUES {count}) AS c(k, cnt) ON c.k = o.k GROUP BY ALL"


SQL = {
    "parse_lines": f"WITH {BASE} SELECT {NGRAM} AS ngram, count(*) AS n, CAST(sum(cnt) AS BIGINT) AS cnt FROM base GROUP BY 1",
    "parse_tokens": f"""WITH {BASE}, t AS (
      SELECT x AS word, 'NN' AS pos, CASE k WHEN 2 THEN 'nsubjpass' WHEN 4 THEN 'nn' ELSE 'nsubj' END AS dep, 2 AS head, cnt FROM base
      UNION ALL SELECT CASE k WHEN 3 THEN 'is' ELSE v END, CASE k WHEN 2 THEN 'VBN' ELSE 'VBZ' END, 'ROOT', 0, cnt FROM base WHERE k < 4
      UNION ALL SELECT CASE k WHEN 1 THEN prep ELSE 'by' END, CASE WHEN k = 1 AND prep = 'to' THEN 'TO' ELSE 'IN' END, 'prep', 2, cnt FROM base WHERE k IN (1, 2)
      UNION ALL SELECT y, 'NN', CASE WHEN k IN (1, 2) THEN 'pobj' WHEN k = 4 THEN 'ROOT' ELSE 'dobj' END, CASE WHEN k IN (1, 2) THEN 3 WHEN k = 4 THEN 0 ELSE 2 END, cnt FROM base)
      SELECT word, pos, dep, CAST(head AS INTEGER) AS head, count(*) AS n, CAST(sum(cnt) AS BIGINT) AS cnt FROM t GROUP BY ALL""",
    "noun_pairs": f"WITH {BASE} SELECT x, y, count(*) AS n FROM base GROUP BY ALL",
    "extract_paths": f"WITH {EXTRACTED} SELECT path, x, y, count(*) AS n, CAST(sum(cnt) AS BIGINT) AS cnt FROM ex GROUP BY ALL",
    "reject_aux_and_nonverb": f"WITH {BASE} SELECT k < 3 AS kept, count(*) AS n FROM base GROUP BY 1",
    "slots": f"WITH {TRIPLES} SELECT slot, count(*) AS n, CAST(sum(cnt) AS BIGINT) AS cnt FROM sl GROUP BY 1",
    "triples": f"WITH {TRIPLES} SELECT * FROM tr",
    "word_margins": f"WITH {TRIPLES} SELECT slot, word, CAST(sum(cnt) AS BIGINT) AS sw FROM tr GROUP BY ALL",
    "path_margins": f"WITH {TRIPLES} SELECT path, slot, CAST(sum(cnt) AS BIGINT) AS ps FROM tr GROUP BY ALL",
    "global_n": f"WITH {TRIPLES} SELECT CAST(sum(cnt) AS BIGINT) AS n FROM tr",
    "margins_grouping_sets": f"""WITH {TRIPLES} SELECT CASE WHEN grouping(word) + grouping(path) + grouping(slot) = 3 THEN 'GLOBAL' WHEN grouping(path) = 1 THEN 'SW_MARGIN' WHEN grouping(word) = 1 THEN 'PS_MARGIN' ELSE 'TRIPLE' END AS tag,
      path, slot, word, CAST(sum(cnt) AS BIGINT) AS cnt FROM tr GROUP BY GROUPING SETS ((path, slot, word), (slot, word), (path, slot), ())""",
    "document_triples": f"WITH {DOCUMENT} SELECT * FROM tr",
    "document_path_margins": f"WITH {DOCUMENT}, ps AS (SELECT path, slot, sum(cnt) AS ps FROM tr GROUP BY ALL) SELECT slot, count(*) AS paths, CAST(sum(ps) AS BIGINT) AS total, CAST(max(ps) AS BIGINT) AS most FROM ps GROUP BY slot",
    "mi_scores": f"WITH {MI} SELECT path, slot, word, round(mi, 6) AS mi FROM mi",
    "sum_mi": f"WITH {MI} SELECT path, slot, round(sum(mi), 6) AS sum_mi FROM mi GROUP BY ALL",
    "phrase_to_path": CONVERTED,
    "phrase_to_path_eval": CONVERTED_EVAL,
    "pair_canonical": f"WITH {PAIRS} SELECT p1, p2 FROM cp",
    "pair_neighbors": f"WITH {PAIRS} SELECT p1 AS path, p2 AS neighbour FROM pr UNION SELECT p2, p1 FROM pr",
    "gold_labels": f"WITH {PAIRS} SELECT p1, p2, label FROM gold",
    "overlap_numerators": f"WITH {SCORES} SELECT p1, p2, round(num_x, 6) AS num_x, round(num_y, 6) AS num_y FROM ov",
    "final_similarity": f"WITH {SCORES} SELECT p1, p2, round(score, 6) AS score FROM sc",
    "score_map": f"WITH {SCORES} SELECT p1, p2, round(score, 6) AS score FROM sc WHERE score > 0",
    "label_scores": f"WITH {SCORES} SELECT p1, p2, round(score, 6) AS score, label FROM ls",
    "cumulative_pr": f"WITH {SCORES} SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, round(score, 6) AS score, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM cf",
    "pr_curve": f"WITH {SCORES} SELECT CAST(rank AS INTEGER) AS rank, round(recall, 6) AS recall, round(precision, 6) AS precision FROM cf",
    "best_f1": f"WITH {SCORES} SELECT round(score, 6) AS threshold, round(f1, 6) AS f1, round(precision, 6) AS precision, round(recall, 6) AS recall FROM best",
    "missed_positives": f"WITH {SCORES} SELECT p1, p2 FROM mp",
    "true_negatives": f"WITH {SCORES} SELECT p1, p2, round(score, 6) AS score FROM tn",
    "error_samples": f"""WITH {SCORES}, e AS (
      SELECT CASE WHEN score >= threshold THEN (CASE label WHEN 'pos' THEN 'TP' ELSE 'FP' END) ELSE 'FN' END AS class, p1, p2, score FROM ls, cut WHERE label = 'pos' OR score >= threshold
      UNION ALL SELECT 'FN', p1, p2, 0 FROM mp UNION ALL SELECT 'TN', p1, p2, score FROM tn),
      r AS (SELECT class, row_number() OVER (PARTITION BY class ORDER BY score DESC, p1, p2) AS place, p1, p2, score FROM e)
      SELECT class, CAST(place AS INTEGER) AS place, p1, p2, round(score, 6) AS score FROM r WHERE place <= 5""",
}
_EVAL_PAIRS = PAIRS.replace(":>prep:P:by:>pobj:N'", ":>agent:P:by:>pobj:N'")
SQL |= {
    "read_corpus_files": SQL["parse_lines"],
    "read_phrase_files": SQL["gold_labels"],
    "read_gold_files": f"WITH {_EVAL_PAIRS} SELECT DISTINCT least(p1, p2) AS p1, greatest(p1, p2) AS p2, label FROM pr",
    "read_score_files": f"WITH {SCORES} SELECT p1, p2, round(score, 6) AS score FROM sc WHERE score > 0 UNION ALL SELECT 'p', 'q', 0.5",
    "write_tagged_files": SQL["margins_grouping_sets"],
    "odd_lines": _odd_sql([r[:2] for r in ODD_PARSED], "ngram"),
    "odd_tokens": _odd_sql(ODD_TOKENS, "word, pos, dep, head"),
    "odd_paths": _odd_sql(ODD_PATHS, "path, x, y"),
    "odd_noun_pair_paths": _odd_sql(ODD_PLACES, "place"),
    **{f"{q}_stemmed": _stemmed(SQL[q]) for q in ("extract_paths", "triples", "mi_scores", "final_similarity", "best_f1")},
    "phrase_to_path_stemmed": _stemmed_phrases(CONVERTED),
    "phrase_to_path_eval_stemmed": _stemmed_phrases(CONVERTED_EVAL, lower=True),
    "stem_vocabulary": _porter_sql("SELECT unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '')) AS word FROM documents"),
}
