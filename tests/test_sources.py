import json
import sys

import numpy as np
import pytest

from semtopics import errors, streaming
from semtopics.operators import encode as enc
from semtopics.operators.keywords import hashing_encoder
from semtopics.sources import files, models


def test_safetensors(tmp_path):
    m = np.arange(6, dtype="<f4").reshape(3, 2)
    path = str(tmp_path / "m.safetensors")
    files.write_safetensors(path, "embeddings", m)
    np.testing.assert_array_equal(files.read_safetensors(path), m)
    with pytest.raises(errors.ModelError):
        files.read_safetensors(path, "other")
    (tmp_path / "bad").write_bytes(b"x")
    with pytest.raises(errors.CacheInvalid):
        files.read_safetensors(str(tmp_path / "bad"))


def test_static_encoder():
    vocab = {"cats": 0, "mice": 1, "stocks": 2}
    x = enc.static_encode(["cats mice", "stocks", "none"], lambda t: [vocab[w] for w in t.split() if w in vocab], np.array([[1.0, 0], [0, 1], [3, 4]]))
    np.testing.assert_allclose(x, [[0.5, 0.5], [3, 4], [0, 0]])
    np.testing.assert_allclose(enc.normalize_matrix(x)[1], [0.6, 0.8])


def test_pool_matrix():
    h = np.arange(1, 13, dtype=float).reshape(2, 3, 2)
    out = enc.pool_matrix(h, np.array([[1, 1, 0], [1, 1, 1]]))
    np.testing.assert_allclose(out, [[2, 3], [9, 10]])


def test_texts_and_documents(spark):
    d = files.texts(spark, {"a": "one text", "b": " ", "c": None})
    assert d.count() == 3
    assert [r.document_name for r in files.documents(d, "text", "document_id", "document_name").collect()] == ["a"]


def test_registry(spark, tmp_path):
    assert models.models(spark).count() == 14 and "pooling" in models.models(spark, True).columns
    assert models.resolve("BAAI/bge-small-en-v1.5").pooling == "cls"
    with pytest.raises(errors.UnknownModel):
        models.resolve("no such model")
    with pytest.raises(errors.ModelNotInstalled):
        models.load_model(directory=str(tmp_path))
    assert not models.model_remove(directory=str(tmp_path)) and models.cache_size(str(tmp_path)) == 0
    assert [r.exists for r in models.model_status(spark, directory=str(tmp_path)).collect()] == [False, False]
    (tmp_path / "tokenizer.json").write_text("{}")
    (tmp_path / "config.json").write_text(json.dumps({"hidden_size": 8, "max_position_embeddings": 64}))
    (tmp_path / "model.onnx").write_bytes(b"")
    assert models.load_custom(str(tmp_path), "mine").dimensions == 8


def test_cache(spark, tmp_path):
    calls = []

    def encoder(texts):
        assert len(texts) == len(set(texts))
        return hashing_encoder(8)(texts)

    d = spark.createDataFrame([(1, "same text"), (2, "same text"), (3, "other")], "id int, text string")
    cache = enc.EmbeddingCache(spark, str(tmp_path / "cache"), "hash-8")
    first = {r.id: r.embedding for r in cache.encode(d, "text", encoder).collect()}
    again = {r.id: r.embedding for r in cache.encode(d, "text", encoder).collect()}
    assert first == again and first[1] == first[2] != first[3] and not calls
    assert spark.read.parquet(cache.path).count() == 2


def test_streams(spark, tmp_path):
    src = spark.createDataFrame([(1, "One part. Two parts.", [1.0, 0.0]), (2, "Three.", [0.0, 1.0])], "id long, text string, embedding array<double>")
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    streaming.write_files(streaming.segment_stream(stream, "id", level="sentence"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    streaming.write_files(streaming.assign_stream(stream, np.eye(2)), str(tmp_path / "out2"), str(tmp_path / "cp2")).awaitTermination()
    assert {r.id: r.topic for r in spark.read.parquet(str(tmp_path / "out2")).collect()} == {1: 1, 2: 2}


def test_core_runs_without_llm():
    code = "import sys; sys.modules['semtopics.llm'] = None; import __spark_entry__ as e; assert e.llm is None and e.queries() and not any(k.startswith('p1_') for k in e.queries())"
    import os
    import subprocess

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
