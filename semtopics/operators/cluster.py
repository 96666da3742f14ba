"""Deterministic clustering: farthest-point seeds, Lloyd passes, fixed seeds.

Sums of vectors are added as integers (coordinates in units of 2**-36), so a mean is the
same whatever the number of partitions and the order of rows. A partition sends K rows of D
numbers, which are added up on the executors; the driver gets K rows a pass, however many
partitions there are."""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import BadInput, ClusteringFailed, DimensionMismatch, NotConverged

_UNIT = float(2**36)
_BLOCK = 8192
_LOW = (1 << 30) - 1


def check_vectors(units: DataFrame, vector_col: str = "embedding") -> tuple[int, int]:
    """(rows, dimension) after one aggregate that rejects null, ragged, non-finite and zero vectors."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = ~F.exists(v, lambda x: x != 0)
    r = units.agg(F.count("*").alias("n"), F.min(F.size(v)).alias("lo"), F.max(F.size(v)).alias("hi"), F.sum(F.when(v.isNull(), 1).otherwise(0)).alias("nulls"), F.sum(F.when(bad, 1).otherwise(0)).alias("bad"), F.sum(F.when(zero, 1).otherwise(0)).alias("zero")).first()
    if not r.n:
        raise BadInput("no rows to cluster")
    if r.nulls or r.bad:
        raise BadInput(f"{(r.nulls or 0) + (r.bad or 0)} rows have a missing or non-finite embedding")
    if r.lo != r.hi:
        raise DimensionMismatch(f"embeddings have between {r.lo} and {r.hi} values")
    if r.zero:
        raise BadInput(f"{r.zero} rows have a zero embedding")
    return r.n, r.hi


def unit_matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Unit rows of a column of vectors; a null, ragged, non-finite or zero vector is an error that says so."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    if column.null_count or (lengths != dim).any():
        raise BadInput(f"every vector must have {dim} values")
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    if not (np.isfinite(norm) & (norm > 0)).all():
        raise BadInput("a vector is zero or not finite")
    return x / norm


def _squared(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Direct-difference squared distances (exact zeros for equal rows)."""
    out = np.empty((len(x), len(centers)))
    for k, c in enumerate(centers):
        out[:, k] = ((x - c) ** 2).sum(1)
    return out


def _vectors(units: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return units.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))


def mean_vector(rows: DataFrame, dim: int) -> np.ndarray:
    return _pass(rows, np.zeros((1, dim)), dim)[1][0]


def farthest_point_centers(units: DataFrame, n_topics: int, id_col: str = "unit_id", vector_col: str = "embedding", existing: np.ndarray | None = None, dim: int | None = None, n: int | None = None) -> tuple[np.ndarray, list[int]]:
    """Seed centres and the ids chosen: first the row farthest from the mean (or from the
    existing seeds), then always the row farthest from all chosen; ties to the lowest id."""
    rows = _vectors(units, id_col, vector_col)
    if dim is None or n is None:
        n, dim = check_vectors(units, vector_col)
    chosen = np.zeros((0, dim)) if existing is None else np.asarray(existing, float)
    mean = mean_vector(rows, dim)[None] if not len(chosen) else None
    ids: list[int] = []
    while len(chosen) < n_topics:
        targets, taken = (mean if not len(chosen) else chosen), set(ids)

        def run(batches: Iterator[pa.RecordBatch], targets=targets, taken=taken) -> Iterator[pa.RecordBatch]:
            best = None
            for b in batches:
                x, at = unit_matrix(b.column(1), dim), b.column(0).to_numpy()
                for i in range(0, len(x), _BLOCK):
                    d = _squared(x[i : i + _BLOCK], targets).min(1)
                    block = at[i : i + _BLOCK]
                    if taken:
                        d[np.isin(block, list(taken))] = -np.inf
                    top = d.max()
                    k = min(np.flatnonzero(d == top), key=lambda j: block[j])
                    if best is None or (-top, block[k]) < (-best[0], best[1]):
                        best = (float(top), int(block[k]), x[i + k].tolist())
            if best:
                yield pa.RecordBatch.from_arrays([pa.array([best[0]]), pa.array([best[1]], pa.int64()), pa.array([best[2]], pa.list_(pa.float64()))], names=["d", "id", "v"])

        far = rows.mapInArrow(run, "d double, id long, v array<double>").orderBy(F.desc("d"), "id").limit(1).collect()[0]
        if far.d <= 0:
            raise ClusteringFailed("n_topics cannot exceed the number of distinct document embeddings")
        ids.append(far.id)
        chosen = np.vstack([chosen, np.array(far.v)[None]])
    return chosen, ids


@dataclass
class Fit:
    centers: np.ndarray
    sizes: np.ndarray
    withinss: np.ndarray
    totss: float
    iterations: int
    converged: bool

    @property
    def betweenss(self) -> float:
        return self.totss - float(self.withinss.sum())


def _pass(rows: DataFrame, centers: np.ndarray, dim: int, by_cosine: bool = False, around: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, exact coordinate sums and within sums of squares by nearest centre."""
    k = len(centers)
    schema = "k int, n long, hi array<long>, lo array<long>"  # per centre: rows, and sums in two parts that can't overflow

    def table(count: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> pa.RecordBatch:
        lists = [pa.array(list(x), pa.list_(pa.int64())) for x in (hi, lo)]
        return pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(count), *lists], names=["k", "n", "hi", "lo"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, hi, lo = np.zeros(k, np.int64), np.zeros((k, dim + 1), np.int64), np.zeros((k, dim + 1), np.int64)
        for b in batches:
            x = unit_matrix(b.column(1), dim)
            for i in range(0, len(x), _BLOCK):
                part = x[i : i + _BLOCK]
                at = (part @ centers.T).argmax(1) if by_cosine else _squared(part, centers).argmin(1)
                apart = ((part - (centers if around is None else around)[at]) ** 2).sum(1)
                order = np.argsort(at, kind="stable")
                found, first, n = np.unique(at[order], return_index=True, return_counts=True)
                sums = np.add.reduceat(np.rint(np.column_stack([part, apart])[order] * _UNIT).astype(np.int64), first, axis=0)
                count[found] += n
                hi[found] += sums >> 30
                lo[found] += sums & _LOW
        yield table(count, hi, lo)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, hi, lo = np.zeros(k, np.int64), np.zeros((k, dim + 1), np.int64), np.zeros((k, dim + 1), np.int64)
        for b in batches:
            at = b.column(0).to_numpy()
            np.add.at(count, at, b.column(1).to_numpy())
            for total, column in ((hi, b.column(2)), (lo, b.column(3))):
                np.add.at(total, at, column.flatten().to_numpy().reshape(-1, dim + 1))
        own = np.flatnonzero(count)
        yield table(count, hi, lo).take(pa.array(own))

    count, total = np.zeros(k, np.int64), [[0] * (dim + 1) for _ in range(k)]
    for r in rows.mapInArrow(run, schema).repartition("k").mapInArrow(add, schema).collect():  # K rows of D numbers
        count[r.k], total[r.k] = r.n, [(h << 30) + x for h, x in zip(r.hi, r.lo)]
    means = np.array([[v / max(int(count[i]), 1) / _UNIT for v in total[i][:dim]] for i in range(k)])
    return count, means, np.array([t[dim] / _UNIT for t in total])


def lloyd(units: DataFrame, centers: np.ndarray, id_col: str = "unit_id", vector_col: str = "embedding", iter_max: int = 100, reorder: bool = True, fixed: bool = False) -> Fit:
    """Lloyd passes from given centres until the centres repeat exactly. ``fixed`` keeps the
    centres as they are: rows go to the most similar one, and topics may stay empty."""
    n, dim = check_vectors(units, vector_col)
    rows = _vectors(units, id_col, vector_col)
    mean = mean_vector(rows, dim)
    totss = float(_pass(rows, mean[None], dim)[2].sum())
    if fixed:
        centers = centers / np.linalg.norm(centers, axis=1, keepdims=True)
        count, means, _ = _pass(rows, centers, dim, True)
        within = _pass(rows, centers, dim, True, means)[2]
        return Fit(centers, count, within, totss, 0, True)
    if len(np.unique(centers, axis=0)) < len(centers):
        raise ClusteringFailed("initial centres are not distinct")
    converged, iterations = False, 0
    while iterations < iter_max:
        count, means, within = _pass(rows, centers, dim)
        iterations += 1
        if (count == 0).any():
            raise ClusteringFailed("a topic has no documents; use fewer topics")
        same = np.array_equal(means, centers)
        centers = means
        if same and iterations > 1:
            converged = True
            break
    if not converged:
        warnings.warn(f"not converged after {iter_max} passes", NotConverged, stacklevel=2)
        count, _, within = _pass(rows, centers, dim)  # else the last pass was about these centres
    if (count == 0).any():
        raise ClusteringFailed("a topic has no documents; use fewer topics")
    if reorder:
        order = sorted(range(len(centers)), key=lambda i: (-count[i], i))
        centers, count, within = centers[order], count[order], within[order]
    return Fit(centers, count, within, totss, iterations, converged)


def assign_fit(units: DataFrame, centers: np.ndarray, vector_col: str = "embedding", fixed: bool = False) -> DataFrame:
    """``units`` with topic (from 1, nearest raw centre) and distance (one less the cosine to it)."""
    return _assign(units, centers, vector_col, by_cosine=fixed)


def _assign(units: DataFrame, centers: np.ndarray, vector_col: str, by_cosine: bool) -> DataFrame:
    unit = centers / np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-300)
    dim = centers.shape[1]
    at_col = units.columns.index(vector_col)
    names = units.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = unit_matrix(b.column(at_col), dim)
            topic, distance = np.empty(len(x), np.int32), np.empty(len(x))
            for i in range(0, len(x), _BLOCK):
                part = x[i : i + _BLOCK]
                sims = part @ unit.T
                at = sims.argmax(1) if by_cosine else _squared(part, centers).argmin(1)
                topic[i : i + _BLOCK] = at + 1
                distance[i : i + _BLOCK] = np.maximum(0.0, 1.0 - sims[np.arange(len(part)), at])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(topic), pa.array(distance)], names=[*names, "topic", "distance"])

    from pyspark.sql.types import DoubleType, IntegerType, StructType

    out = StructType([*units.schema.fields]).add("topic", IntegerType()).add("distance", DoubleType())
    return units.mapInArrow(run, out)


def assign_nearest(units: DataFrame, centers: np.ndarray, vector_col: str = "embedding") -> DataFrame:
    """``units`` with topic and distance by cosine to unit centres, the first on ties: the rule
    for new texts, memberships and representatives."""
    return _assign(units, centers, vector_col, by_cosine=True)
