"""Cosine similarity between two sets of vectors: long form and nearest neighbours.

Both sides are cut into blocks of about ``block_rows`` rows by id hash; every left block meets every
right block in one task on the executors, which keeps the best ``top`` rows of it, so no row
pairs are formed in the JVM and the driver sees no vectors. The candidates of a left row, ``top`` a
right block, are merged at the end."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cluster import check_vectors, unit_matrix

BLOCK_ROWS = 20_000


def top_similar(left: DataFrame, right: DataFrame | None = None, id_col: str = "vec_id", vector_col: str = "embedding", top: int | None = 5, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """from, to, similarity[, rank]: with ``top`` the nearest rows of ``right`` (ties to the lower
    id); without ``right`` the rows of ``left`` themselves, leaving each row's own pair out. The long
    form has a row for every pair of ``left`` and ``right``, as its size says."""
    same = right is None
    right = left if same else right
    n, dim = check_vectors(right, vector_col)
    kind = left.schema[id_col].dataType.simpleString()

    def blocks(rows: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        rows = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.pmod(F.xxhash64(id_col), F.lit(n_own)).cast("int").alias(own))
        return rows.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1)))).groupBy("l", "r")

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        b = b.sort_by("id")
        ids, matrix = b["id"].combine_chunks(), unit_matrix(b["v"].combine_chunks(), dim)
        out = [pa.table({"from": a["id"].slice(0, 0).combine_chunks(), "to": ids.slice(0, 0), "similarity": pa.array([], pa.float64())})]
        for i in range(0, a.num_rows if b.num_rows else 0, 1024):
            part = a.slice(i, 1024)
            own = part["id"].combine_chunks()
            sims = unit_matrix(part["v"].combine_chunks(), dim) @ matrix.T
            if same:
                sims = np.where(own.to_numpy(zero_copy_only=False)[:, None] == ids.to_numpy(zero_copy_only=False)[None], -np.inf if top else sims, sims)
            if top is None:
                at, to = np.divmod(np.arange(sims.size), len(ids))
            else:
                order = np.argsort(-sims, axis=1, kind="stable")[:, :top]
                at, to = np.repeat(np.arange(len(own)), order.shape[1]), order.ravel()
            value = sims[at, to]
            ok = np.isfinite(value)
            out.append(pa.table({"from": own.take(pa.array(at[ok])), "to": ids.take(pa.array(to[ok])), "similarity": value[ok]}))
        return pa.concat_tables(out)

    n_right = -(-n // block_rows)
    n_left = n_right if same else max(1, -(-left.count() // block_rows))
    lefts, rights = blocks(left, "l", n_left, "r", n_right), blocks(right, "r", n_right, "l", n_left)
    out = lefts.cogroup(rights).applyInArrow(compare, f"`from` {kind}, `to` {kind}, similarity double")
    if top is None:
        return out
    w = Window.partitionBy("from").orderBy(F.desc("similarity"), "to")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
