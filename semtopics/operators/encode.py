"""Texts to embeddings: lookup-mean and ONNX encoders inside Arrow batches, with a cache.

Each Python worker builds its session once. Batches can be sorted by length so little is
padded, and only distinct texts missing from the cache are encoded."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import BadInput, CacheRebuilt, ModelError
from ..sources.files import read_safetensors
from ..sources.models import EncoderSpec

_SESSIONS: dict = {}


def pool_matrix(hidden: np.ndarray, mask: np.ndarray, method: str = "mean") -> np.ndarray:
    if method == "cls":
        return hidden[:, 0, :]
    m = mask[:, :, None].astype(hidden.dtype)
    return (hidden * m).sum(1) / np.maximum(m.sum(1), 1e-9)


def normalize_matrix(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def static_encode(texts: list[str], ids_of: Callable[[str], list[int]], matrix: np.ndarray) -> np.ndarray:
    """Mean of the token rows; a text of unknown tokens only gives the zero vector."""
    out = np.zeros((len(texts), matrix.shape[1]))
    for i, t in enumerate(texts):
        ids = [k for k in ids_of(t) if 0 <= k < len(matrix)]
        if ids:
            out[i] = matrix[ids].mean(0)
    return out


def _session(spec: EncoderSpec):
    if spec not in _SESSIONS:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(spec.path("tokenizer.json"))
        if spec.engine == "static":
            _SESSIONS[spec] = (tokenizer, read_safetensors(spec.path("model.safetensors"), "embeddings"))
        else:
            import onnxruntime as ort

            options = ort.SessionOptions()
            options.intra_op_num_threads = spec.threads
            _SESSIONS[spec] = (tokenizer, ort.InferenceSession(spec.path("model.onnx"), options, providers=["CPUExecutionProvider"]))
    return _SESSIONS[spec]


def encode_texts(spec: EncoderSpec, texts: list[str], batch_size: int = 32, sort_by_length: bool = True) -> np.ndarray:
    tokenizer, model = _session(spec)
    if spec.engine == "static":
        unknown = tokenizer.token_to_id("[UNK]")
        return static_encode(texts, lambda t: [i for i in tokenizer.encode(t, add_special_tokens=False).ids if i != unknown], model)
    order = np.argsort([len(t.encode()) for t in texts], kind="stable") if sort_by_length else np.arange(len(texts))
    names = {i.name for i in model.get_inputs()}
    out = None
    for i in range(0, len(texts), batch_size):
        rows = order[i : i + batch_size]
        ids = [e.ids[: spec.max_tokens] for e in tokenizer.encode_batch([texts[r] for r in rows])]
        width = max(map(len, ids))
        x = np.full((len(ids), width), spec.pad_id, np.int64)
        mask = np.zeros((len(ids), width), np.int64)
        for k, e in enumerate(ids):
            x[k, : len(e)], mask[k, : len(e)] = e, 1
        feed = {"input_ids": x, "attention_mask": mask} | ({"token_type_ids": np.zeros_like(x)} if "token_type_ids" in names else {})
        hidden = model.run(None, {k: v for k, v in feed.items() if k in names})[0]
        pooled = pool_matrix(hidden, mask, spec.pooling)
        if not np.isfinite(pooled).all():
            raise ModelError("the model returned non-finite values")
        out = np.zeros((len(texts), pooled.shape[1])) if out is None else out
        out[rows] = pooled
    return out if out is not None else np.zeros((0, spec.dimensions))


def encode(df: DataFrame, text_col: str, encoder: EncoderSpec | Callable[[list[str]], np.ndarray], out_col: str = "embedding", normalize: bool = True, prefix: str | None = None, batch_size: int = 32) -> DataFrame:
    """``df`` with an embedding column. ``encoder`` is a spec or a function from texts to a matrix."""
    lead = prefix if prefix is not None else (encoder.prefix if isinstance(encoder, EncoderSpec) else "")
    at, names = df.columns.index(text_col), [*df.columns, out_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [lead + (t or "") for t in b.column(at).to_pylist()]
            x = encode_texts(encoder, texts, batch_size) if isinstance(encoder, EncoderSpec) else np.asarray(encoder(texts), float)
            x = normalize_matrix(x) if normalize else x
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(x), pa.list_(pa.float64()))], names=names)

    from pyspark.sql.types import ArrayType, DoubleType, StructType

    return df.mapInArrow(run, StructType([*df.schema.fields]).add(out_col, ArrayType(DoubleType())))


class EmbeddingCache:
    """Content-addressed embeddings in a Parquet table: key = sha256(settings, exact text)."""

    SCHEMA = "key string, embedding array<double>"

    def __init__(self, spark: SparkSession, path: str, settings: str):
        self.spark, self.path, self.settings = spark, path, settings

    def read(self) -> DataFrame:
        try:
            table = self.spark.read.parquet(self.path)
            if table.columns != ["key", "embedding"]:
                raise BadInput("unexpected columns")
            return table
        except Exception as e:  # missing or unreadable: start anew
            if "PATH_NOT_FOUND" not in str(e):
                warnings.warn(f"embedding cache {self.path} is rebuilt: {e}", CacheRebuilt, stacklevel=2)
            return self.spark.createDataFrame([], self.SCHEMA)

    def key(self, text):
        return F.sha2(F.concat(F.sha2(F.lit(self.settings), 256), F.lit("\x1f"), text), 256)

    def encode(self, df: DataFrame, text_col: str, encoder, **options) -> DataFrame:
        """Embeddings of all rows; distinct texts without an entry are encoded once and appended."""
        keyed = df.withColumn("_key", self.key(F.coalesce(F.col(text_col), F.lit(""))))
        missing = keyed.select("_key", text_col).dropDuplicates(["_key"]).join(self.read().select(F.col("key").alias("_key")), "_key", "left_anti")
        encode(missing, text_col, encoder, **options).select(F.col("_key").alias("key"), "embedding").write.mode("append").parquet(self.path)
        table = self.spark.read.parquet(self.path).dropDuplicates(["key"])
        return keyed.join(table, keyed._key == table.key).drop("_key", "key")
