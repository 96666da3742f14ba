"""Tables behind the usual plots of a model, and a palette."""

from __future__ import annotations

import colorsys

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def topic_title(width: int = 45):
    """ "1. label", cut to ``width`` characters."""
    t = F.concat(F.col("topic").cast("string"), F.lit(". "), F.col("label"))
    return F.when(F.length(t) <= width, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, width - 3)), F.lit("...")))


def sizes_report(topics: DataFrame) -> DataFrame:
    return topics.select("topic", topic_title().alias("title"), "n_documents")


def terms_report(terms: DataFrame, metric: str = "score", n: int = 10) -> DataFrame:
    """topic, title, term, value, position by score, beta or frequency (ranked as beta)."""
    key = {"score": "score", "beta": "beta", "frequency": "beta"}[metric]
    w = Window.partitionBy("topic").orderBy(F.desc(key), "term")
    return terms.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= n).select("topic", topic_title().alias("title"), "term", F.col(metric).cast("double").alias("value"), "position")


def sweep_report(sweep: DataFrame) -> DataFrame:
    """Long form: segment, n_topics, metric, value."""
    return sweep.unpivot(["segment", "n_topics"], ["coherence", "topic_diversity", "explained"], "metric", "value")


def map_points(units: DataFrame, id_col: str = "unit_id", topic_col: str = "topic", max_points: int = 1000) -> DataFrame:
    """Stratified thinning: per topic max(2, round(max_points x share)) units, evenly spaced by id.
    A report of at most about ``max_points`` rows, for ``map_layout``."""
    total = units.agg(F.count("*").alias("_t"))
    sized = units.withColumn("_n", F.count("*").over(Window.partitionBy(topic_col))).join(F.broadcast(total))
    quota = F.least(F.greatest(F.lit(2), F.round(max_points * F.col("_n") / F.col("_t")).cast("int")), F.col("_n"))
    ranked = sized.withColumn("_q", quota).withColumn("_r", F.row_number().over(Window.partitionBy(topic_col).orderBy(id_col)))
    take = F.floor((F.col("_r") * F.col("_q")) / F.col("_n")) > F.floor(((F.col("_r") - 1) * F.col("_q")) / F.col("_n"))
    return ranked.filter(take).drop("_n", "_t", "_q", "_r")


def map_layout(vectors: np.ndarray) -> np.ndarray:
    """Classical scaling of cosine distances to two dimensions (of a thinned set)."""
    x = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    d2 = np.maximum(0.0, 1.0 - x @ x.T) ** 2
    j = np.eye(len(x)) - 1.0 / len(x)
    values, axes = np.linalg.eigh(-0.5 * j @ d2 @ j)
    top = np.argsort(-values)[:2]
    return axes[:, top] * np.sqrt(np.maximum(values[top], 0.0))


def topic_palette(n: int) -> list[str]:
    """``n`` evenly spaced hues of like lightness, as hex colours."""
    return ["#%02X%02X%02X" % tuple(round(255 * c) for c in colorsys.hls_to_rgb(i / max(n, 1), 0.45, 0.55)) for i in range(n)]
