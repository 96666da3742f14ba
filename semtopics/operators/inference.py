"""What a fitted model says about units: memberships, mixtures, representatives, labels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cluster import unit_matrix


def membership(units: DataFrame, centers: np.ndarray, id_col: str, vector_col: str = "embedding", sharpness: float = 1.15) -> DataFrame:
    """id, topic, probability, rank: fuzzy weights from cosine distances, in log space."""
    unit = centers / np.linalg.norm(centers, axis=1, keepdims=True)
    k, dim = unit.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = np.maximum(1.0 - unit_matrix(b.column(1), dim) @ unit.T, 1e-12)
            w = -(2.0 / (sharpness - 1.0)) * np.log(d)
            w = np.exp(w - w.max(1, keepdims=True))
            p = w / w.sum(1, keepdims=True)
            order = np.argsort(-p, axis=1, kind="stable")
            rank = np.empty_like(order)
            np.put_along_axis(rank, order, np.arange(1, k + 1)[None].repeat(len(p), 0), 1)
            rows = np.repeat(np.arange(len(p)), k)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(p))), pa.array(p.ravel()), pa.array(rank.ravel().astype(np.int32))], names=[id_col, "topic", "probability", "rank"])

    kind = units.schema[id_col].dataType.simpleString()
    return units.select(id_col, F.col(vector_col).cast("array<double>")).mapInArrow(run, f"`{id_col}` {kind}, topic int, probability double, rank int")


def gamma(assigned: DataFrame, n_topics: int, document_col: str = "document_id", topic_col: str = "topic", top: int | None = None) -> DataFrame:
    """document, topic, gamma, n_segments: shares of a document's segments over all topics,
    zeros included; with ``top`` the largest shares above zero only, with their rank.

    Zero filling explodes the list of topics per document, so no join of all pairs is made."""
    counts = assigned.groupBy(document_col, topic_col).agg(F.count("*").alias("n"))
    per = counts.groupBy(document_col).agg(F.map_from_entries(F.collect_list(F.struct(F.col(topic_col).cast("int"), "n"))).alias("m"), F.sum("n").alias("n_segments"))
    rows = per.select(document_col, F.explode(F.sequence(F.lit(1), F.lit(n_topics))).alias("topic"), "m", "n_segments")
    rows = rows.select(document_col, "topic", (F.coalesce(F.try_element_at("m", "topic"), F.lit(0)) / F.col("n_segments")).alias("gamma"), "n_segments")
    if top is None:
        return rows
    w = Window.partitionBy(document_col).orderBy(F.desc("gamma"), "topic")
    return rows.filter("gamma > 0").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select(document_col, "rank", "topic", "gamma", "n_segments")


def stored_representatives(documents: DataFrame, n: int = 3, id_col: str = "document_id", text_col: str = "text") -> DataFrame:
    """Per fitted topic the ``n`` nearest distinct texts with at least two letters in a row."""
    rows = documents.filter(F.col(text_col).rlike(r"\p{L}{2}"))
    first = rows.groupBy("topic", text_col).agg(F.min(F.struct("distance", id_col)).alias("b"))
    w = Window.partitionBy("topic").orderBy("distance", id_col)
    best = first.select("topic", text_col, "b.distance", F.col(f"b.{id_col}").alias(id_col))
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select("topic", "rank", id_col, text_col, "distance")


def margins(units: DataFrame, centers: np.ndarray, id_col: str, vector_col: str = "embedding", keep=()) -> DataFrame:
    """id, kept columns, topic, distance, margin: distance to the nearest centre, and how much
    farther the next one is."""
    unit = centers / np.linalg.norm(centers, axis=1, keepdims=True)
    dim = unit.shape[1]
    rows = units.select(id_col, *keep, F.col(vector_col).cast("array<double>").alias("_v"))

    names = [*rows.columns[:-1], "topic", "distance", "margin"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = np.maximum(0.0, 1.0 - unit_matrix(b.column(b.num_columns - 1), dim) @ unit.T)
            at = d.argmin(1)
            own = d[np.arange(len(d)), at]
            d[np.arange(len(d)), at] = np.inf
            margin = d.min(1) - own if d.shape[1] > 1 else np.full(len(d), np.nan)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array((at + 1).astype(np.int32)), pa.array(own), pa.array(margin, mask=np.isnan(margin))], names=names)

    from pyspark.sql.types import DoubleType, IntegerType, StructType

    schema = StructType(rows.schema.fields[:-1]).add("topic", IntegerType()).add("distance", DoubleType()).add("margin", DoubleType())
    return rows.mapInArrow(run, schema)


def representatives(units: DataFrame, centers: np.ndarray, id_col: str = "document_id", text_col: str = "text", vector_col: str = "embedding", n: int = 3, rank: str = "margin") -> DataFrame:
    """topic, rank, id, text, distance, margin: the clearest (or nearest) distinct texts of each
    topic, ties to the shorter text, then its order."""
    rows = margins(units, centers, id_col, vector_col, (text_col,)).filter(F.col(text_col).rlike(r"\p{L}{2}"))
    key = -F.col("margin") if rank == "margin" else F.col("distance")
    best = rows.groupBy("topic", text_col).agg(F.min(F.struct(key.alias("k"), F.col(id_col), F.col("distance"), F.col("margin"))).alias("b"))
    w = Window.partitionBy("topic").orderBy("b.k", F.length(text_col), text_col)
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select("topic", "rank", F.col(f"b.{id_col}").alias(id_col), text_col, "b.distance", "b.margin")


def shorten_label(text) -> Column:
    """At most 60 characters: longer ones are cut at the last space after the 30th of the first 57."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    head = F.substring(t, 1, 57)
    space = F.length(head) - F.length(F.substring_index(head, " ", -1))
    cut = F.when(space > 30, F.rtrim(F.substring(head, F.lit(1), space.cast("int")))).otherwise(head)
    return F.when(F.length(t) <= 60, t).otherwise(F.concat(cut, F.lit("...")))


def representative_labels(reps: DataFrame, text_col: str = "text") -> DataFrame:
    """topic, label from the first representative."""
    return reps.filter("rank = 1").select("topic", shorten_label(F.col(text_col)).alias("label"))


def with_labels(df: DataFrame, labels: DataFrame) -> DataFrame:
    """``label`` right after ``topic``; topics without one are called topic_<id>."""
    at = df.columns.index("topic") + 1
    columns = [*df.columns[:at], "label", *df.columns[at:]]
    joined = df.join(F.broadcast(labels), "topic", "left")  # one row per topic
    return joined.withColumn("label", F.coalesce("label", F.concat(F.lit("topic_"), F.col("topic")))).select(*columns)
