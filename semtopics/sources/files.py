"""Sources: text collections, tables and safetensors matrices; sinks: tables of a model."""

from __future__ import annotations

import json
import struct
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CacheInvalid, ModelError
from ..functions import text as tx


def texts(spark: SparkSession, values, names=None) -> DataFrame:
    """document_id, document_name, text from a list (or mapping) of texts in memory."""
    if isinstance(values, dict):
        names, values = list(values), list(values.values())
    names = names or [""] * len(values)
    return spark.createDataFrame([(i + 1, n, v) for i, (n, v) in enumerate(zip(names, values))], "document_id long, document_name string, text string")


def documents(df: DataFrame, text_col: str, id_col: str, name_col: str | None = None) -> DataFrame:
    """Usable rows of any DataFrame as document_id, document_name, text and the other columns."""
    rest = [c for c in df.columns if c not in (text_col, id_col, name_col, "document_id", "document_name", "text")]
    name = F.col(name_col).cast("string") if name_col else F.lit("")
    return df.filter(tx.usable(text_col)).select(F.col(id_col).alias("document_id"), name.alias("document_name"), F.col(text_col).alias("text"), *rest)


def read_safetensors(path: str, name: str = "embeddings") -> np.ndarray:
    """A two-dimensional F32 tensor: 8-byte little-endian header length, JSON header, row-major data."""
    data = Path(path).read_bytes()
    if len(data) < 8:
        raise CacheInvalid(f"{path} is no safetensors file")
    (size,) = struct.unpack("<Q", data[:8])
    try:
        header = json.loads(data[8 : 8 + size])
    except ValueError as e:
        raise CacheInvalid(f"{path} has no readable header") from e
    if name not in header:
        raise ModelError(f"no tensor {name!r} in {path}")
    entry = header[name]
    if entry["dtype"] != "F32" or len(entry["shape"]) != 2:
        raise ModelError("only two-dimensional F32 tensors are read")
    start, end = entry["data_offsets"]
    return np.frombuffer(data[8 + size + start : 8 + size + end], "<f4").reshape(entry["shape"])


def write_safetensors(path: str, name: str, matrix: np.ndarray) -> None:
    body = np.ascontiguousarray(matrix, "<f4").tobytes()
    header = json.dumps({name: {"dtype": "F32", "shape": list(matrix.shape), "data_offsets": [0, len(body)]}}).encode()
    Path(path).write_bytes(struct.pack("<Q", len(header)) + header + body)
