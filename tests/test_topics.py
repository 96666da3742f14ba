import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from semtopics import errors
from semtopics.functions import text as tx
from semtopics.functions import vector as vec
from semtopics.operators import cluster, corpus, evaluate, hierarchy, inference, keywords, similarity
from semtopics.operators import terms as term_ops
from semtopics.plans import report
from semtopics.plans.model import SavedTopicModel, TopicCorpus, TopicEstimator, compare_topics

TEXTS = ["Stocks and bonds markets.", "Market stocks trade bonds.", "Cats chase small mice.", "Dogs and cats play.", "Mice fear hungry cats.", "Bonds and market rates."]
VECTORS = [[1.0, 0.1, 0.0], [0.9, 0.0, 0.1], [0.0, 1.0, 0.1], [0.1, 0.9, 0.0], [0.0, 0.8, 0.2], [1.0, 0.0, 0.2]]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.createDataFrame([(i + 1, t, v, f"m{i}") for i, (t, v) in enumerate(zip(TEXTS, VECTORS))], "id long, body string, e array<double>, topic_source string")


@pytest.fixture(scope="module")
def fitted(documents):
    return TopicEstimator(2).fit_corpus(TopicCorpus(documents, "body", "id", "e"))


def units(spark, texts, topics, minimum=1):
    df = spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate(zip(texts, topics))], "id int, text string, topic int")
    return df.withColumn("tokens", tx.tokens("text", [], minimum))


def test_class_tfidf(spark):
    out = term_ops.stored_terms(units(spark, ["Apple apple apple", "banana", "banana carrot"], [1, 1, 2])).orderBy("topic", "rank").collect()
    assert [r.term for r in out] == ["apple", "banana", "carrot", "banana"]
    np.testing.assert_allclose([r.score for r in out], [0.519860385419959, 0.229072682968539, 0.693147180559945, 0.458145365937078], atol=1e-12)


def test_weights(spark):
    u = units(spark, ["apple apple apple", "banana carrot"], [1, 2])
    score = {r.term: r.score for r in term_ops.stored_terms(u).collect()}
    assert score["apple"] == pytest.approx(math.log(1 + 2.5 / 3), abs=1e-12)
    assert {r.term: r.score for r in term_ops.stored_terms(u, weighting="bm25").collect()}["apple"] == pytest.approx(0, abs=1e-12)
    u = units(spark, ["apple apple banana", "carrot"], [1, 2])
    plain, damped = ({r.term: r.score for r in term_ops.stored_terms(u, reduce_frequent_words=d).collect()}["apple"] for d in (False, True))
    assert damped / plain == pytest.approx(math.sqrt(2 / 3) / (2 / 3))


def test_coherence(spark):
    rows = [["a", "b"], ["a", "b"], ["a", "c"], ["c"]]
    u = spark.createDataFrame(list(enumerate(rows)), "unit_id int, tokens array<string>")
    t = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3), (2, "a", 1)], "topic int, term string, rank int")
    umass = {r.topic: r.coherence for r in evaluate.coherence(u, t, "unit_id", measure="umass").collect()}
    assert umass[1] == pytest.approx((math.log(1) + math.log(2 / 3) + math.log(1 / 2)) / 3) and umass[2] is None
    npmi = lambda pij, pi, pj: math.log(pij / (pi * pj)) / -math.log(pij)
    got = {r.topic: r.coherence for r in evaluate.coherence(u, t, "unit_id").collect()}
    assert got[1] == pytest.approx((npmi(0.5, 0.75, 0.5) + npmi(0.25, 0.75, 0.5) - 1) / 3)
    assert evaluate.topic_diversity(t).first()[0] == pytest.approx(3 / 4)


def test_stems():
    words = {"running": "run", "relational": "relat", "conditional": "condit", "happiness": "happi", "generously": "generous", "flies": "fli", "dying": "die", "consolidation": "consolid", "agreed": "agre", "hopping": "hop", "caresses": "caress"}
    assert {w: term_ops.english_stem(w) for w in words} == words


def test_collapse(spark):
    u = spark.createDataFrame([(1, ["topics", "model"]), (2, ["topic", "topics", "models"]), (3, []), (4, None)], "id int, tokens array<string>")
    out = {r.id: r.tokens for r in term_ops.collapse_inflections(u, "id").collect()}
    assert out == {1: ["topics", "model"], 2: ["topics", "topics", "model"], 3: [], 4: None}


def test_vectors(spark):
    df = spark.createDataFrame([([0.6, 0.8], [0.0, 1.0]), ([0.0, 2.0], [0.0, 1.0])], "u array<double>, d array<double>")
    full, half = zip(*[(r[0], r[1]) for r in df.select(vec.blend("u", "d", 1.0), vec.blend("u", "d", 0.0)).collect()])
    np.testing.assert_allclose(full[0], [1, 0], atol=1e-12)
    np.testing.assert_allclose(full[1], [0, 1], atol=1e-12)
    np.testing.assert_allclose(half[0], [0, 1], atol=1e-12)
    one = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0])], "u array<double>, d array<double>").select(vec.blend("u", "d", 0.5)).first()[0]
    np.testing.assert_allclose(one, [2**-0.5] * 2)
    p = spark.createDataFrame([([[1.0, 4.0], [2.0, 8.0], [9.0, 9.0]], [1, 1, 0])], "t array<array<double>>, m array<int>")
    assert p.select(vec.pool("t", "m", False), vec.pool("t", "m", False, "cls")).first()[:] == ([1.5, 6.0], [1.0, 4.0])
    near = df.select(vec.nearest("u", [[1.0, 0.0], [0.0, 1.0]]).alias("n")).collect()
    assert [r.n.topic for r in near] == [2, 2]


def test_similarity(spark):
    e = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, [0.2, 0.8])], "vec_id long, embedding array<double>")
    top = {r["from"]: r.to for r in similarity.top_similar(e, top=1, block_rows=3).collect()}
    assert top == {1: 2, 2: 1, 3: 4, 4: 3}
    assert similarity.top_similar(e, top=None).count() == 16


def test_fit(fitted, documents):
    rows = {r.document_id: r.topic for r in fitted.documents.collect()}
    assert rows[1] == rows[2] == rows[6] and rows[3] == rows[4] == rows[5] != rows[1]
    assert fitted.diagnostics["converged"] and fitted.documents.columns[:6] == ["document_id", "document_name", "text", "topic", "label", "distance"]
    assert sum(r.n_documents for r in fitted.topics.collect()) == 6
    new = fitted.predict(documents, "body", "id", "e").collect()
    assert {r.document_id: r.topic for r in new} == rows
    assert fitted.gamma(top=1).count() == 6 and fitted.gamma().count() == 12
    assert {r.topic for r in fitted.representatives(1).collect()} == {1, 2}
    assert fitted.summary().count() == 2 and fitted.sizes(by="document").count() == 2 and fitted.terms(3, "beta").count() == 6
    p = fitted.membership().groupBy("unit_id").agg(F.sum("probability").alias("s")).collect()
    assert all(r.s == pytest.approx(1) for r in p)


def test_partition_invariance(spark, documents):
    a = documents.withColumnRenamed("id", "unit_id").withColumnRenamed("e", "embedding")
    fits = []
    for df in (a.coalesce(1), a.repartition(5), a.orderBy(F.desc("unit_id")).repartition(3)):
        seeds, ids = cluster.farthest_point_centers(df, 2)
        fits.append((ids, cluster.lloyd(df, seeds).centers.tolist()))
    assert fits[0] == fits[1] == fits[2]


def test_names_reduce_save(fitted, spark, tmp_path):
    named = fitted.name_topics({1: "money"})
    assert "money" in named.label_list()
    for bad in ({1: ""}, {1: "x", 2: "x"}, {9: "x"}):
        with pytest.raises(errors.BadTopicNames):
            fitted.name_topics(bad)
    with pytest.raises(errors.BadInput):
        fitted.reduce_topics(2)
    fitted.save(str(tmp_path / "m"))
    saved = SavedTopicModel(spark, str(tmp_path / "m"))
    assert saved.transform(fitted.corpus.units.select("unit_id", "embedding")).count() == 6


def test_reduce_and_hierarchy(documents):
    m = TopicEstimator(3).fit_corpus(TopicCorpus(documents, "body", "id", "e"))
    r = m.reduce_topics(2)
    assert sum(t.n_documents for t in r.topics.collect()) == 6 and r.n_topics == 2
    assert m.hierarchy().count() == 2 and m.hierarchy_summary().count() == 3
    d = np.array([[0, 1, 4], [1, 0, 2], [4, 2, 0.0]])
    assert [round(h, 6) for h, _, _ in hierarchy.merges(d)] == [1, 3] and [h for h, _, _ in hierarchy.merges(d, "single")] == [1, 2]
    assert hierarchy.cut(hierarchy.merges(d), 3, 2) == [0, 0, 1]


def test_sweep(documents):
    c = TopicCorpus(documents, "body", "id", "e")
    s = compare_topics(c, (2, 3))
    assert [r.n_topics for r in s.to_df().collect()] == [2, 3] and s.summary().count() == 1
    assert s.fitted(2).n_topics == 2
    with pytest.raises(errors.NoFittedModel):
        s.fitted(9)
    assert report.sweep_report(s.to_df()).count() == 6


def test_fixed_seeds(documents):
    est = TopicEstimator(3, seeds=[[1, 0, 0], [0, 1, 0], [0, 0, 1]], seed_names=["finance", "animals", "chemistry"], fixed_seeds=True)
    topics = {r.label: r.n_documents for r in est.fit_corpus(TopicCorpus(documents, "body", "id", "e")).topics.collect()}
    assert topics == {"finance": 3, "animals": 3, "chemistry": 0}


def test_errors(spark, documents):
    with pytest.raises(errors.NoEmbeddings):
        TopicCorpus(documents, "body", "id")
    zero = spark.createDataFrame([(1, "a b", [0.0, 0.0]), (2, "c d", [1.0, 0.0])], "id long, body string, e array<double>")
    with pytest.raises(errors.BadInput):
        TopicCorpus(zero, "body", "id", "e")
    same = spark.createDataFrame([(i, f"text {i}", [1.0, 0.0]) for i in range(4)], "id long, body string, e array<double>")
    with pytest.raises(errors.ClusteringFailed):
        TopicEstimator(2).fit_corpus(TopicCorpus(same, "body", "id", "e"))


def test_membership_and_gamma(spark):
    e = spark.createDataFrame([(1, [0.8, 0.6]), (2, [1.0, 1.0])], "id long, embedding array<double>")
    rows = inference.membership(e, np.eye(2), "id", sharpness=2.0).collect()
    p = {(r.id, r.topic): r.probability for r in rows}
    assert p[1, 1] == pytest.approx(0.8) and p[2, 1] == pytest.approx(0.5)
    a = spark.createDataFrame(list(zip([1, 1, 1, 1, 2, 2, 3], [2, 2, 3, 1, 3, 3, 1])), "document_id int, topic int")
    g = inference.gamma(a, 3, top=2).orderBy("document_id", "rank").collect()
    assert [(r.document_id, r.topic, r.gamma) for r in g] == [(1, 2, 0.5), (1, 1, 0.25), (2, 3, 1.0), (3, 1, 1.0)]


def test_sizes_weighted(spark):
    u = spark.createDataFrame([(1, 1, 3.0, 1), (2, 1, 1.0, 1), (3, 2, 1.0, 1)], "document_id int, topic int, w double, s int")
    rows = {r.topic: (r.n_documents, r.n_weighted) for r in corpus.topic_sizes(u, weight_col="w").collect()}
    assert rows == {1: (2, 4.0), 2: (1, 1.0)}


def test_keywords(spark):
    d = spark.createDataFrame([(1, "solar panels convert sunlight into power"), (2, "of the"), (3, None)], "document_id int, text string")
    out = keywords.keywords(d, keywords.hashing_encoder(), n=3).collect()
    assert {r.document_id for r in out} == {1} and [r["rank"] for r in out] == [1, 2, 3]
    assert keywords.mmr(np.array([0.9, 0.8, 0.1]), np.array([[1, 1, 0], [1, 1, 0], [0, 0, 1.0]]), 2, 0.9) == [0, 2]


def test_report(fitted):
    assert report.sizes_report(fitted.topics).count() == 2 and report.terms_report(fitted.terms(5), "beta", 2).count() == 4
    assert len(set(report.topic_palette(5))) == 5 and report.map_points(fitted.assigned, "unit_id", max_points=4).count() == 4
    assert report.map_layout(np.array(VECTORS)).shape == (6, 2)


def test_sql_functions(spark):
    from semtopics.functions import sql

    sql.register(spark)
    r = spark.sql("SELECT semtopics_content_ratio('A real sentence here.'), semtopics_tokens('Don’t STOP it'), semtopics_cosine(array(1D, 0D), array(3D, 4D)), semtopics_trim(' \t x\n')").first()
    assert r[0] == pytest.approx(17 / 18) and r[1] == ["don't", "stop", "it"] and r[2] == pytest.approx(0.6) and r[3] == "x"


def test_segmented_fit_with_seed_texts(spark):
    from semtopics.plans.model import topics

    def encoder(texts):
        return np.array([[sum(t.lower().count(w) for w in ("cat", "mice")) + 0.01, sum(t.lower().count(w) for w in ("stock", "bond")) + 0.02] for t in texts])

    df = spark.createDataFrame([(1, "Cats chase mice. Stocks and bonds fell."), (2, "Bonds rose. Cats slept."), (3, "Mice hid. Stocks rose.")], "document_id long, text string")
    m = topics(df, 2, seed_texts={"animals": "cats and mice", "money": ["stocks", "bonds"]}, encoder=encoder, fixed_seeds=True, segment="sentence")
    assert {r.label: r.n_documents for r in m.topics.collect()} == {"animals": 3, "money": 3}
    assert {(r.document_id, r.topic): r.gamma for r in m.gamma().collect()} == {(d, t): 0.5 for d in (1, 2, 3) for t in (1, 2)}
    assert {r.n_documents for r in m.sizes(by="document").collect()} == {3}
    assert m.predict(df, encoder=encoder).count() == 6
