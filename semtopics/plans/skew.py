"""Joins that hold when one key owns a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_unique(left: DataFrame, right: DataFrame, on: str, weight: str, total: int, share: int = 1000, how: str = "inner") -> DataFrame:
    """Join ``left`` with ``right``, which is unique on ``on`` and whose column ``weight``
    counts the left rows of each key (they sum to at most ``total``).

    Keys with more than ``total / share`` rows are joined by broadcast: by the pigeonhole
    principle there are fewer than ``share`` of them, whatever the data's size, so the
    broadcast has a proven bound and a hot key never lands in one task. All other keys
    take the shuffle join. ``how`` may be ``inner`` or ``left`` (then keys are matched
    either way exactly once)."""
    limit = max(1, total // share)
    hot = right.filter(F.col(weight) > limit)
    cold = right.filter(F.col(weight) <= limit)
    marked = left.join(F.broadcast(hot.select(F.col(on), F.lit(True).alias("_hot"))), on, "left")
    hot_rows = marked.filter(F.col("_hot")).drop("_hot").join(F.broadcast(hot), on, "inner")
    cold_rows = marked.filter(F.col("_hot").isNull()).drop("_hot").join(cold, on, how)
    return hot_rows.unionByName(cold_rows)
