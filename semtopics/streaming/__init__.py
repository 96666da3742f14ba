"""Streams: every row-wise operator works on ``readStream`` frames; these wire the usual ones."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from ..operators import cluster, corpus


def clean_stream(stream: DataFrame, text_col: str = "text", **settings) -> DataFrame:
    return corpus.clean_corpus(stream, text_col, **settings)


def segment_stream(stream: DataFrame, id_col: str, text_col: str = "text", level: str = "clause", **settings) -> DataFrame:
    return corpus.segment(stream, id_col, text_col, level, **settings)


def assign_stream(stream: DataFrame, centers: np.ndarray, vector_col: str = "embedding") -> DataFrame:
    """Topic and distance of every arriving vector; no state is kept."""
    return cluster.assign_nearest(stream, centers, vector_col)


def write_files(stream: DataFrame, path: str, checkpoint: str):
    """Exactly-once Parquet sink that ends when the available input is consumed."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
