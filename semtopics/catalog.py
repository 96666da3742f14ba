"""Registry of the engine's queries and of the SQL they are checked against.

Each query takes (spark, sf_dir) and runs over whole tables. Values of type double are
rounded to six places on both sides; ranks use the unrounded values."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as tx
from .functions import vector as vec
from .functions.words import ABBREVIATIONS, CLEANING, ENTITIES, PLACEHOLDERS, STOP_WORDS_EN
from .operators import cluster, corpus, evaluate, hierarchy, inference, keywords, similarity
from .operators import terms as term_ops
from .operators.encode import encode
from .plans import model as md
from .plans import report
from .plans.store import materialize
from .sources import models

QUERIES: dict = {}
SQL: dict[str, str] = {}

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS_EN)
_PATTERN = r"[\p{L}\p{N}]+(?:''[\p{L}\p{N}]+)*"
_TRIM = r"regexp_replace({0}, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g')"
_USABLE = "({t} IS NOT NULL AND {t} <> '' AND upper({t}) NOT IN (" + ", ".join(f"'{p}'" for p in PLACEHOLDERS) + "))"
_TOKENS = "list_filter(regexp_extract_all(lower(replace({0}, '’', '''')), '" + _PATTERN + "'), lambda w: length(w) >= 2 AND w NOT IN (" + _STOP + "))"


def _fill(pattern: str, value) -> str:
    return pattern.replace("{0}", str(value))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _r(c, places: int = 6):
    return F.round(c, places)


# ---------------------------------------------------------------- corpus

_T = _TRIM.format("text")


@query(f"SELECT doc_id, lang, CAST(length(text) AS BIGINT) AS n_chars FROM documents WHERE {_USABLE.format(t=_T)}")
def usable_documents(spark, sf_dir):
    d = corpus.usable_documents(_read(spark, sf_dir, "documents"), "text")
    return d.select("doc_id", "lang", F.length("text").cast("long").alias("n_chars"))


@query(f"SELECT min(doc_id) AS doc_id, text, arg_min(source, doc_id) FILTER (WHERE true) AS source, count(*) AS n FROM (SELECT doc_id, text, coalesce(source, '') AS source FROM documents) WHERE text IS NOT NULL AND {_T} <> '' GROUP BY text")
def dedupe_documents(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce("source", F.lit("")).alias("source"))
    return corpus.dedupe(d, "text", "doc_id")


@query(
    "WITH o AS (SELECT translation, row_id FROM feedback_translations WHERE translation IS NOT NULL AND " + _TRIM.format("translation") + " <> '')"
    " SELECT translation, min(row_id) AS row_id, count(*) AS n FROM (SELECT DISTINCT translation, row_id FROM o) GROUP BY translation"
)
def dedupe_translations(spark, sf_dir):
    m = _read(spark, sf_dir, "feedback_translations").select("translation", "row_id").distinct()
    return corpus.dedupe(m, "translation", "row_id")


_R = "regexp_replace({0}, '{1}', '{2}', 'g')"


def _chain(start: str) -> str:
    """The character cleaning in SQL, from the same table of fixed values."""
    t = start
    for entity, sign in ENTITIES:
        t = f"replace({t}, '{entity}', '{sign}')"
    for p, by in (*CLEANING, (r"\s+", " "), (r"^[ \t\r\n]+|[ \t\r\n]+$", "")):
        t = _R.format(t, p.replace("{B}", r"\b").replace("'", "''"), by.replace("'", "''"))
    return t


@query(f"SELECT ut, {_chain('ab')} AS text FROM mcse_data WHERE ab IS NOT NULL")
def clean_characters(spark, sf_dir):
    return _read(spark, sf_dir, "mcse_data").filter("ab is not null").select("ut", tx.clean_characters("ab").alias("text"))


@query()
def clean_corpus(spark, sf_dir):
    m = _read(spark, sf_dir, "mcse_data").select("ut", "py", F.col("ab").alias("text"))
    return corpus.clean_corpus(m, "text", numbers=True, roman_numerals=True, min_content=0.5)


@query(r"SELECT doc_id, round(CASE WHEN length(regexp_replace(text, '\s', '', 'g')) = 0 THEN 0 ELSE length(regexp_replace(text, '[^\p{L}]', '', 'g')) / length(regexp_replace(text, '\s', '', 'g')) END, 6) AS content FROM documents WHERE text IS NOT NULL")
def content_ratio(spark, sf_dir):
    return _read(spark, sf_dir, "documents").filter("text is not null").select("doc_id", _r(tx.content_ratio("text")).alias("content"))


@query(r"SELECT doc_id, regexp_replace(text, '\b[0-9]+\b', ' ', 'g') AS text FROM documents WHERE text IS NOT NULL")
def clean_numbers(spark, sf_dir):
    return _read(spark, sf_dir, "documents").filter("text is not null").select("doc_id", tx.clean_numbers("text").alias("text"))


@query()
def strip_list_markers(spark, sf_dir):
    return _read(spark, sf_dir, "documents").filter("text is not null").select("doc_id", tx.strip_list_markers("text").alias("text"))


# ---------------------------------------------------------------- segments


def _sentence_sql() -> str:
    """The sentence rules without look-around: periods that end nothing are hidden step by step."""
    dot = chr(0xE001)
    t = "translation"
    for p, by in ((r"[\x{2018}\x{2019}\x{201B}\x{2032}]", "''"), (r"[\x{201C}\x{201D}]", '"'), (r"[\x{2013}\x{2014}]", " - "), (r"\s+", " "), (r"^[ \t\r\n]+|[ \t\r\n]+$", "")):
        t = f"regexp_replace({t}, '{p}', '{by}', 'g')"
    for _ in range(8):  # at most eight periods inside one pair of brackets in these tables
        t = f"regexp_replace({t}, '(\\([^().]*)\\.([^()]*\\))', '\\1{dot}\\2', 'g')"
    for a in ABBREVIATIONS:
        parts = a[:-1].split(".")
        t = f"regexp_replace({t}, '(?i)\\b" + r"\.".join(f"({p})" for p in parts) + r"\.', '" + "".join(f"\\{i + 1}{dot}" for i in range(len(parts))) + "', 'g')"
    for _ in range(2):
        t = f"regexp_replace({t}, '([0-9])\\.([0-9])', '\\1{dot}\\2', 'g')"
    t = rf"regexp_replace(regexp_replace({t}, '([.?!])\s+', '\1@@', 'g'), '(\p{{Ll}}[.?!])(\p{{Lu}})', '\1@@\2', 'g')"
    parts = rf"list_filter(list_transform(string_split({t}, '@@'), lambda x: replace(regexp_replace(x, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g'), '{dot}', '.')), lambda x: x <> '' AND regexp_matches(x, '[\p{{L}}\p{{N}}]'))"
    return f"WITH p AS (SELECT row_id, {parts} AS ps FROM (SELECT DISTINCT row_id, translation FROM feedback_translations) WHERE translation IS NOT NULL) SELECT row_id, CAST(i AS INTEGER) AS segment, ps[i] AS text FROM p, range(1, 1 + len(ps)) r(i)"


@query(_sentence_sql())
def segment_messages(spark, sf_dir):
    m = _read(spark, sf_dir, "feedback_translations").select("row_id", "translation").distinct()
    return corpus.segment(m, "row_id", "translation", "sentence")


@query()
def segment_sentences(spark, sf_dir):
    return corpus.segment(_read(spark, sf_dir, "documents"), "doc_id", "text", "sentence")


@query()
def segment_clauses(spark, sf_dir):
    return corpus.segment(_read(spark, sf_dir, "documents"), "doc_id", "text", "clause", merge_below=3)


@query()
def segment_phrases_capped(spark, sf_dir):
    return corpus.segment(_read(spark, sf_dir, "documents"), "doc_id", "text", "phrase", max_tokens=12, min_content=0.3)


# ---------------------------------------------------------------- tokens and terms


@query(f"SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest({_fill(_TOKENS, 'text')}) AS term FROM documents) GROUP BY doc_id, term")
def token_counts(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").select("doc_id", F.explode(tx.tokens("text")).alias("term"))
    return d.groupBy("doc_id", "term").agg(F.count("*").alias("n"))


_UNITS = f"WITH u AS (SELECT doc_id, lang AS topic, {_fill(_TOKENS, 'text')} AS tokens FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL), "
_COUNTS = _UNITS + (
    "c0 AS (SELECT topic, term, count(*) AS n FROM (SELECT topic, unnest(tokens) AS term FROM u) GROUP BY topic, term), "
    "c AS (SELECT *, f FROM (SELECT *, sum(n) OVER (PARTITION BY term) AS f FROM c0) WHERE f >= {0}), "
    "l AS (SELECT topic, sum(n) AS len FROM c GROUP BY topic), a AS (SELECT sum(len) / count(*) AS a FROM l), v AS (SELECT count(DISTINCT term) AS v FROM c), "
)


def _scores(weight: str, tf: str = "n / len", least: int = 2, smooth: str = "0") -> str:
    idf = "ln(1 + a / f)" if weight == "ctfidf" else "ln(1 + (a - f + 0.5) / (f + 0.5))"
    return _fill(_COUNTS, least).replace("SELECT *, f FROM", "SELECT * FROM") + f"s AS (SELECT topic, term, {tf} * {idf} AS score, n AS frequency, (n + {smooth}) / (len + {smooth} * v) AS beta FROM c JOIN l USING (topic), a, v) "


def _units(spark, sf_dir) -> DataFrame:
    d = _read(spark, sf_dir, "documents").filter("lang is not null and text is not null")
    return d.select("doc_id", F.col("lang").alias("topic"), tx.tokens("text").alias("tokens"))


_TOP = "SELECT topic, term, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score, frequency FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, frequency DESC, term) AS rank FROM s) WHERE rank <= 10"


def _stored(spark, sf_dir, **settings) -> DataFrame:
    return term_ops.stored_terms(_units(spark, sf_dir), 10, min_term_frequency=2, **settings).withColumn("score", _r("score"))


@query(_scores("ctfidf") + _TOP)
def class_tfidf_terms(spark, sf_dir):
    return _stored(spark, sf_dir)


@query(_scores("bm25") + _TOP)
def bm25_terms(spark, sf_dir):
    return _stored(spark, sf_dir, weighting="bm25")


@query(_scores("ctfidf", "sqrt(n / len)") + _TOP)
def damped_terms(spark, sf_dir):
    return _stored(spark, sf_dir, reduce_frequent_words=True)


@query(_scores("ctfidf", smooth="0.1") + "SELECT topic, term, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score, frequency, round(beta, 6) AS beta FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY beta DESC, term) AS rank FROM s) WHERE rank <= 8")
def terms_by_beta(spark, sf_dir):
    t = term_ops.terms(_units(spark, sf_dir), 8, "beta", min_term_frequency=2, smoothing=0.1)
    return t.withColumn("score", _r("score")).withColumn("beta", _r("beta"))


@query(_scores("ctfidf") + "SELECT topic, string_agg(term, ' / ' ORDER BY rank) AS label FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, frequency DESC, term) AS rank FROM s) WHERE rank <= 3 GROUP BY topic")
def term_labels(spark, sf_dir):
    return term_ops.term_labels(term_ops.stored_terms(_units(spark, sf_dir), 10, min_term_frequency=2))


_ATOKENS = _fill(_TOKENS, "m.translation")


@query(
    f"WITH u AS (SELECT a.topic, {_ATOKENS} AS tokens FROM document_assignments a JOIN (SELECT DISTINCT row_id, translation FROM feedback_translations) m USING (row_id) WHERE a.topic IS NOT NULL AND m.translation IS NOT NULL), "
    + _scores("ctfidf")[len(_UNITS) :]
    + _TOP
)
def assigned_topic_terms(spark, sf_dir):
    """Class TF-IDF terms of the stored topics over all messages."""
    m = _read(spark, sf_dir, "feedback_translations").select("row_id", "translation").filter("translation is not null").dropDuplicates(["row_id"])
    a = _read(spark, sf_dir, "document_assignments").filter("topic is not null").select("row_id", "topic")
    u = a.join(m, "row_id").select("topic", tx.tokens("translation").alias("tokens"))
    return term_ops.stored_terms(u, 10, min_term_frequency=2).withColumn("score", _r("score"))


@query()
def collapsed_terms(spark, sf_dir):
    """Terms after inflections are collapsed to the most frequent form of their stem."""
    return term_ops.stored_terms(term_ops.collapse_inflections(_units(spark, sf_dir), "doc_id"), 10, min_term_frequency=2).withColumn("score", _r("score"))


@query(
    _UNITS
    + "g AS (SELECT doc_id, list_distinct(list_concat(tokens, list_transform(range(1, len(tokens)), lambda i: tokens[i] || ' ' || tokens[i + 1]))) AS g FROM u) SELECT doc_id, unnest(g) AS ngram FROM g"
)
def token_ngrams(spark, sf_dir):
    return _units(spark, sf_dir).select("doc_id", F.explode(tx.ngrams("tokens", 2)).alias("ngram"))


# ---------------------------------------------------------------- evaluation

_PRESENT = (
    _scores("ctfidf")
    + ", t AS (SELECT topic, term, rank FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, frequency DESC, term) AS rank FROM s) WHERE rank <= 10), "
    "p AS (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest(tokens) AS term FROM u) WHERE term IN (SELECT term FROM t)), nn AS (SELECT count(*) AS nn FROM u), "
    "d AS (SELECT term, count(*) AS df FROM p GROUP BY term), "
    "b AS (SELECT x.term AS ti, y.term AS tj, count(*) AS co FROM p x JOIN p y ON x.doc_id = y.doc_id AND x.term <> y.term GROUP BY 1, 2), "
    "q AS (SELECT a.topic, coalesce(b.co, 0) AS co, di.df AS di, dj.df AS dj, nn FROM t a JOIN t z ON a.topic = z.topic AND a.rank < z.rank LEFT JOIN b ON b.ti = a.term AND b.tj = z.term JOIN d di ON di.term = a.term JOIN d dj ON dj.term = z.term, nn) "
)


def _coherence(measure: str) -> str:
    value = "ln((co + 1) / di)" if measure == "umass" else "CASE WHEN co = 0 THEN -1.0 WHEN co = nn THEN 1.0 ELSE ln((co / nn) / ((di / nn) * (dj / nn))) / -ln(co / nn) END"
    return _PRESENT + f"SELECT topic, '{measure}' AS measure, n_terms, round(coherence, 6) AS coherence FROM (SELECT topic, avg({value}) AS coherence FROM q GROUP BY topic) RIGHT JOIN (SELECT topic, count(*) AS n_terms FROM t GROUP BY topic) USING (topic)"


def _coherent(spark, sf_dir, measure: str) -> DataFrame:
    u = materialize(_units(spark, sf_dir), "units")
    t = materialize(term_ops.stored_terms(u, 10, min_term_frequency=2), "terms")
    return evaluate.coherence(u, t, "doc_id", measure=measure)


@query(_coherence("npmi"))
def coherence_npmi(spark, sf_dir):
    return _coherent(spark, sf_dir, "npmi").withColumn("coherence", _r("coherence"))


@query(_coherence("umass"))
def coherence_umass(spark, sf_dir):
    return _coherent(spark, sf_dir, "umass").withColumn("coherence", _r("coherence"))


@query(_scores("ctfidf") + "SELECT round(count(DISTINCT term) / count(*), 6) AS topic_diversity FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, frequency DESC, term) AS rank FROM s) WHERE rank <= 10")
def topic_diversity(spark, sf_dir):
    t = term_ops.stored_terms(_units(spark, sf_dir), 10, min_term_frequency=2)
    return evaluate.topic_diversity(t).withColumn("topic_diversity", _r("topic_diversity"))


# ---------------------------------------------------------------- vectors

_V = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"
_DOT = "list_dot_product({0}, {1})"


@query(f"SELECT vec_id, CAST(i AS INTEGER) AS dim, round(v[i] / sqrt({_DOT.format('v', 'v')}), 6) AS value FROM (SELECT vec_id, {_V} AS v FROM embeddings), range(1, 65) r(i)")
def normalized_vectors(spark, sf_dir):
    e = _read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(vec.l2_normalize("embedding")).alias("dim", "value"))
    return e.select("vec_id", (F.col("dim") + 1).cast("int").alias("dim"), _r("value").alias("value"))


@query(
    f"WITH e AS (SELECT vec_id, v, sqrt({_DOT.format('v', 'v')}) AS n FROM (SELECT vec_id, {_V} AS v FROM embeddings)), "
    f"s AS (SELECT a.vec_id AS \"from\", b.vec_id AS \"to\", {_DOT.format('a.v', 'b.v')} / (a.n * b.n) AS similarity FROM e a JOIN e b ON a.vec_id <> b.vec_id) "
    'SELECT "from", "to", round(similarity, 6) AS similarity, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY "from" ORDER BY similarity DESC, "to") AS rank FROM s) WHERE rank <= 3'
)
def nearest_neighbours(spark, sf_dir):
    s = similarity.top_similar(_read(spark, sf_dir, "embeddings"), top=3)
    return s.select("from", "to", _r("similarity").alias("similarity"), F.col("rank").cast("int").alias("rank"))


_CENTRE = (
    f"WITH e AS (SELECT vec_id, label + 1 AS label, list_transform(v, lambda x: x / sqrt({_DOT.format('v', 'v')})) AS v FROM (SELECT vec_id, label, {_V} AS v FROM embeddings)), "
    "m AS (SELECT label, list(a ORDER BY i) AS c FROM (SELECT label, i, avg(v[i]) AS a FROM e, range(1, 65) r(i) GROUP BY label, i) GROUP BY label), "
    f"k AS (SELECT label AS topic, list_transform(c, lambda x: x / sqrt({_DOT.format('c', 'c')})) AS c FROM m), "
    f"d AS (SELECT vec_id, topic, greatest(0.0, 1 - {_DOT.format('v', 'c')}) AS distance FROM e, k) "
)


def _label_centres(spark, sf_dir) -> np.ndarray:
    """Means of unit vectors by label: labels x dimensions numbers."""
    e = _read(spark, sf_dir, "embeddings").select("label", F.posexplode(vec.l2_normalize("embedding")).alias("d", "x"))
    rows = e.groupBy("label", "d").agg(F.avg("x").alias("a")).orderBy("label", "d").collect()
    labels = sorted({r.label for r in rows})
    return np.array([[r.a for r in rows if r.label == k] for k in labels])


@query(_CENTRE + "SELECT vec_id, CAST(topic AS INTEGER) AS topic, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, topic) AS r FROM d) WHERE r = 1")
def nearest_centre(spark, sf_dir):
    a = cluster.assign_nearest(_read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>")), _label_centres(spark, sf_dir))
    return a.select("vec_id", "topic", _r("distance").alias("distance"))


@query(
    _CENTRE
    + ", w AS (SELECT vec_id, topic, -(2 / 0.15) * ln(greatest(distance, 1e-12)) AS w FROM d), x AS (SELECT vec_id, topic, exp(w - max(w) OVER (PARTITION BY vec_id)) AS x FROM w), p AS (SELECT vec_id, topic, x / sum(x) OVER (PARTITION BY vec_id) AS p FROM x) "
    "SELECT vec_id, CAST(topic AS INTEGER) AS topic, round(p, 6) AS probability, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, topic) AS INTEGER) AS rank FROM p"
)
def topic_membership(spark, sf_dir):
    m = inference.membership(_read(spark, sf_dir, "embeddings"), _label_centres(spark, sf_dir), "vec_id")
    return m.withColumn("probability", _r("probability"))


_MARGIN = _CENTRE + ", z AS (SELECT vec_id, topic, distance, lead(distance) OVER (PARTITION BY vec_id ORDER BY distance, topic) - distance AS margin, row_number() OVER (PARTITION BY vec_id ORDER BY distance, topic) AS r FROM d), y AS (SELECT z.*, text FROM z JOIN documents ON doc_id = vec_id WHERE r = 1 AND regexp_matches(text, '\\p{L}{2}'))"


@query(
    _MARGIN + ", f AS (SELECT *, row_number() OVER (PARTITION BY topic, text ORDER BY -margin, vec_id) AS first FROM y), g AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY -margin, length(text), text) AS rank FROM f WHERE first = 1) "
    "SELECT CAST(topic AS INTEGER) AS topic, CAST(rank AS INTEGER) AS rank, vec_id, text, round(distance, 6) AS distance, round(margin, 6) AS margin FROM g WHERE rank <= 3"
)
def margin_representatives(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text").filter("text is not null")
    u = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding").join(d, "vec_id")
    r = inference.representatives(u, _label_centres(spark, sf_dir), "vec_id", n=3)
    return r.withColumn("distance", _r("distance")).withColumn("margin", _r("margin")).withColumn("rank", F.col("rank").cast("int"))


@query(
    f"WITH e AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt({_DOT.format('v', 'v')})) AS v FROM (SELECT vec_id, label, {_V} AS v FROM embeddings)), "
    "m AS (SELECT label, list(a ORDER BY i) AS c FROM (SELECT label, i, avg(v[i]) AS a FROM e, range(1, 65) r(i) GROUP BY label, i) GROUP BY label), "
    f"j AS (SELECT vec_id, v, list_transform(c, lambda x: x / sqrt({_DOT.format('c', 'c')})) AS d FROM e JOIN m USING (label)), "
    f"b AS (SELECT vec_id, list_transform(range(1, 65), lambda i: 0.5 * (v[i] - {_DOT.format('v', 'd')} * d[i]) + 0.5 * d[i]) AS b FROM j) "
    f"SELECT vec_id, CAST(i AS INTEGER) AS dim, round(b[i] / sqrt({_DOT.format('b', 'b')}), 6) AS value FROM b, range(1, 65) r(i)"
)
def blended_vectors(spark, sf_dir):
    """Vectors blended with the mean vector of their label."""
    centres = _label_centres(spark, sf_dir)
    e = _read(spark, sf_dir, "embeddings")
    labels = [r[0] for r in e.select("label").distinct().orderBy("label").collect()]
    parents = spark.createDataFrame([(k, c.tolist()) for k, c in zip(labels, centres)], "label int, parent array<double>")
    out = e.join(F.broadcast(parents), "label").select("vec_id", F.posexplode(vec.blend("embedding", "parent", 0.5)).alias("dim", "value"))
    return out.select("vec_id", (F.col("dim") + 1).cast("int").alias("dim"), _r("value").alias("value"))


# ---------------------------------------------------------------- aggregates over assignments


@query("SELECT CAST(topic AS INTEGER) AS topic, count(*) AS n_documents, round(count(*) / (SELECT count(*) FROM document_assignments WHERE topic IS NOT NULL), 6) AS proportion, CAST(sum(translation_duplicate_count) AS DOUBLE) AS n_weighted, round(sum(translation_duplicate_count) / (SELECT sum(translation_duplicate_count) FROM document_assignments WHERE topic IS NOT NULL), 6) AS weighted_share FROM document_assignments WHERE topic IS NOT NULL GROUP BY topic")
def topic_sizes(spark, sf_dir):
    a = _read(spark, sf_dir, "document_assignments").filter("topic is not null").select(F.col("topic").cast("int"), "translation_duplicate_count")
    s = corpus.topic_sizes(a, weight_col="translation_duplicate_count")
    return s.withColumn("proportion", _r("proportion")).withColumn("weighted_share", _r("weighted_share"))


_PAIRS = "(SELECT m.exercise_id AS ex, CAST(a.topic AS INTEGER) AS topic FROM document_assignments a JOIN (SELECT DISTINCT row_id, exercise_id FROM feedback_translations) m USING (row_id) WHERE a.topic IS NOT NULL AND m.exercise_id IS NOT NULL)"


def _by_exercise(spark, sf_dir) -> DataFrame:
    m = _read(spark, sf_dir, "feedback_translations").select("row_id", "exercise_id").filter("exercise_id is not null").distinct()
    a = _read(spark, sf_dir, "document_assignments").filter("topic is not null").select("row_id", F.col("topic").cast("int"))
    return a.join(m, "row_id").select("exercise_id", "topic")


@query(f"SELECT topic, count(*) AS n_documents, round(count(*) / (SELECT count(DISTINCT ex) FROM {_PAIRS}), 6) AS proportion FROM (SELECT DISTINCT ex, topic FROM {_PAIRS}) GROUP BY topic")
def topic_sizes_by_document(spark, sf_dir):
    return corpus.topic_sizes(_by_exercise(spark, sf_dir), document_col="exercise_id").withColumn("proportion", _r("proportion"))


@query(
    f"WITH p AS {_PAIRS}, c AS (SELECT ex, topic, count(*) AS n FROM p GROUP BY ALL), s AS (SELECT ex, sum(n) AS n_segments FROM c GROUP BY ex), "
    "k AS (SELECT ex, n_segments, CAST(t AS INTEGER) AS topic FROM s, range(1, 13) r(t)) "
    "SELECT k.ex AS exercise_id, k.topic, round(coalesce(c.n, 0) / k.n_segments, 6) AS gamma, CAST(k.n_segments AS BIGINT) AS n_segments FROM k LEFT JOIN c ON c.ex = k.ex AND c.topic = k.topic"
)
def document_mixtures(spark, sf_dir):
    g = inference.gamma(_by_exercise(spark, sf_dir), 12, "exercise_id")
    return g.withColumn("gamma", _r("gamma"))


@query(
    f"WITH p AS {_PAIRS}, c AS (SELECT ex, topic, count(*) AS n FROM p GROUP BY ALL), g AS (SELECT ex, topic, n / sum(n) OVER (PARTITION BY ex) AS g, sum(n) OVER (PARTITION BY ex) AS s FROM c), k AS (SELECT *, row_number() OVER (PARTITION BY ex ORDER BY g DESC, topic) AS rank FROM g) "
    "SELECT ex AS exercise_id, CAST(rank AS INTEGER) AS rank, topic, round(g, 6) AS gamma, CAST(s AS BIGINT) AS n_segments FROM k WHERE rank <= 2"
)
def document_mixtures_top(spark, sf_dir):
    g = inference.gamma(_by_exercise(spark, sf_dir), 12, "exercise_id", top=2)
    return g.withColumn("gamma", _r("gamma")).withColumn("rank", F.col("rank").cast("int"))


@query(
    "WITH r AS (SELECT CAST(a.topic AS INTEGER) AS topic, a.document_id, m.translation AS text, a.cosine_distance_to_centroid AS distance FROM document_assignments a JOIN (SELECT DISTINCT row_id, translation FROM feedback_translations) m USING (row_id) WHERE a.topic IS NOT NULL AND a.document_id IS NOT NULL AND a.cosine_distance_to_centroid IS NOT NULL AND regexp_matches(m.translation, '\\p{L}{2}')), "
    "f AS (SELECT *, row_number() OVER (PARTITION BY topic, text ORDER BY distance, document_id) AS first FROM r), g AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY distance, document_id) AS rank FROM f WHERE first = 1) SELECT topic, CAST(rank AS INTEGER) AS rank, document_id, text, round(distance, 6) AS distance FROM g WHERE rank <= 3"
)
def stored_representatives(spark, sf_dir):
    m = _read(spark, sf_dir, "feedback_translations").select("row_id", F.col("translation").alias("text")).filter("text is not null").dropDuplicates(["row_id"])
    a = _read(spark, sf_dir, "document_assignments").filter("topic is not null and document_id is not null and cosine_distance_to_centroid is not null")
    d = a.select("row_id", F.col("topic").cast("int"), "document_id", F.col("cosine_distance_to_centroid").alias("distance")).join(m, "row_id")
    r = inference.stored_representatives(d, 3)
    return r.withColumn("distance", _r("distance")).withColumn("rank", F.col("rank").cast("int"))


# ---------------------------------------------------------------- models


def _corpus(spark, sf_dir, **settings) -> md.TopicCorpus:
    d = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    e = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return md.TopicCorpus(d.join(e, "doc_id"), id_col="doc_id", embedding_col="embedding", **settings)


def _lloyd_sql(k: int = 4, passes: int = 16) -> str:
    """Seeding and Lloyd passes unrolled; passes after the fixed point change nothing."""
    dist = "list_sum(list_transform(range(1, 65), lambda i: ({0}[i] - {1}[i]) * ({0}[i] - {1}[i])))"
    sql = f"WITH e AS MATERIALIZED (SELECT vec_id, list_transform(v, lambda x: x / sqrt({_DOT.format('v', 'v')})) AS v FROM (SELECT vec_id, {_V} AS v FROM embeddings)), "
    sql += "g AS MATERIALIZED (SELECT list(a ORDER BY i) AS c FROM (SELECT i, avg(v[i]) AS a FROM e, range(1, 65) r(i) GROUP BY i)), "
    sql += f"s1 AS MATERIALIZED (SELECT v AS c, 1 AS t FROM e, g ORDER BY {dist.format('v', 'g.c')} DESC, vec_id LIMIT 1), "
    for j in range(2, k + 1):
        sql += f"s{j} AS MATERIALIZED (SELECT * FROM s{j - 1} UNION ALL (SELECT v, {j} FROM (SELECT e.vec_id, any_value(e.v) AS v, min({dist.format('e.v', 's.c')}) AS d FROM e, s{j - 1} s GROUP BY e.vec_id) ORDER BY d DESC, vec_id LIMIT 1)), "
    sql += f"k0 AS MATERIALIZED (SELECT c, t FROM s{k}), "
    for p in range(1, passes + 1):
        sql += f"a{p} AS MATERIALIZED (SELECT vec_id, arg_min(t, struct_pack(d := d, t := t)) AS t FROM (SELECT e.vec_id, k.t, {dist.format('e.v', 'k.c')} AS d FROM e, k{p - 1} k) GROUP BY vec_id), "
        sql += f"k{p} AS MATERIALIZED (SELECT list(m ORDER BY i) AS c, t FROM (SELECT t, i, avg(v[i]) AS m FROM a{p} JOIN e USING (vec_id), range(1, 65) r(i) GROUP BY t, i) GROUP BY t), "
    sql += f"o AS (SELECT t, CAST(row_number() OVER (ORDER BY n DESC, t) AS INTEGER) AS topic FROM (SELECT t, count(*) AS n FROM a{passes} GROUP BY t)) SELECT vec_id, topic FROM a{passes} JOIN o USING (t)"
    return sql


@query(_lloyd_sql())
def topic_fit(spark, sf_dir):
    """Farthest-point seeds, Lloyd passes and renumbering on all embeddings, four topics."""
    e = materialize(_read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>")), "fit")
    seeds, _ = cluster.farthest_point_centers(e, 4, "vec_id")
    fit = cluster.lloyd(e, seeds, "vec_id")
    return cluster.assign_fit(e, fit.centers).select("vec_id", "topic")


@query()
def topic_model_topics(spark, sf_dir):
    m = md.TopicEstimator(4).fit_corpus(_corpus(spark, sf_dir))
    return m.topics.withColumn("withinss", _r("withinss")).withColumn("proportion", _r("proportion"))


@query()
def topic_model_summary(spark, sf_dir):
    return md.TopicEstimator(4).fit_corpus(_corpus(spark, sf_dir)).summary().withColumn("coherence", _r("coherence"))


@query(
    _CENTRE.replace("FROM e, k)", "FROM e, k), b AS (SELECT vec_id, topic FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, topic) AS r FROM d) WHERE r = 1), c AS (SELECT b.topic, i, avg(v[i]) AS m FROM b JOIN e USING (vec_id), range(1, 65) r(i) GROUP BY b.topic, i), u AS (SELECT e.vec_id, b.topic, v FROM e JOIN b USING (vec_id) JOIN documents ON doc_id = e.vec_id WHERE " + _USABLE.format(t=_T) + ")")
    + "SELECT CAST(topic AS INTEGER) AS topic, count(*) AS n_documents, round(count(*) / (SELECT count(*) FROM u), 6) AS proportion FROM u GROUP BY topic"
)
def seeded_sizes(spark, sf_dir):
    """Sizes of the topics of fixed seeds, by most similar label mean."""
    return seeded_topics(spark, sf_dir).select("topic", "n_documents", _r("proportion").alias("proportion"))


@query()
def seeded_topics(spark, sf_dir):
    """Fixed seeds: every vector goes to the most similar label mean; topics are not renumbered."""
    centres = _label_centres(spark, sf_dir)
    est = md.TopicEstimator(len(centres), seeds=centres, seed_names=[f"label {i}" for i in range(len(centres))], fixed_seeds=True)
    return est.fit_corpus(_corpus(spark, sf_dir)).topics.withColumn("withinss", _r("withinss"))


@query()
def topic_sweep(spark, sf_dir):
    s = md.compare_topics(_corpus(spark, sf_dir), (3, 5), keep_models=False).to_df()
    return s.select("segment", "n_topics", *[_r(c).alias(c) for c in ("coherence", "topic_diversity", "explained")], "converged")


@query()
def topic_hierarchy(spark, sf_dir):
    rows = hierarchy.merge_table(_label_centres(spark, sf_dir), [f"label {i}" for i in range(len(_label_centres(spark, sf_dir)))])
    return spark.createDataFrame(rows, "step int, height double, left string, right string").withColumn("height", _r("height"))


@query()
def reduced_topics(spark, sf_dir):
    return md.TopicEstimator(6).fit_corpus(_corpus(spark, sf_dir)).reduce_topics(3).topics.withColumn("withinss", _r("withinss"))


@query()
def document_keywords(spark, sf_dir):
    d = _read(spark, sf_dir, "mcse_data").select(F.col("ut").alias("document_id"), F.col("ti").alias("text")).filter("text is not null")
    return keywords.keywords(d, keywords.hashing_encoder(), n=5).withColumn("topic_similarity", _r("topic_similarity"))


@query()
def encoded_titles(spark, sf_dir):
    d = _read(spark, sf_dir, "mcse_data").select("ut", "ti").filter("ti is not null")
    e = encode(d, "ti", keywords.hashing_encoder(16))
    return e.select("ut", F.posexplode("embedding").alias("dim", "value")).withColumn("value", _r("value"))


@query(
    "WITH a AS (SELECT document_id, topic, topic_label, count(*) OVER (PARTITION BY topic) AS n, row_number() OVER (PARTITION BY topic ORDER BY document_id) AS r, count(*) OVER () AS t FROM document_assignments WHERE topic IS NOT NULL AND document_id IS NOT NULL), "
    "q AS (SELECT *, least(greatest(2, CAST(round(1000 * n / t) AS INTEGER)), n) AS q FROM a) SELECT document_id, topic, topic_label FROM q WHERE r * q // n > (r - 1) * q // n"
)
def topic_map_points(spark, sf_dir):
    """Evenly thinned points of every stored topic for a map (a report of bounded size)."""
    a = _read(spark, sf_dir, "document_assignments").filter("topic is not null and document_id is not null").select("document_id", "topic", "topic_label")
    return report.map_points(a, "document_id")


@query()
def model_registry(spark, sf_dir):
    return models.models(spark, True)
