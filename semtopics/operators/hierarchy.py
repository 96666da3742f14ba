"""Topic hierarchy: agglomerative merges of topic centres, and cutting the tree.

Works on the driver on K x K numbers, K being the number of topics."""

from __future__ import annotations

import numpy as np

from ..errors import BadInput

METHODS = ("average", "single", "complete", "mcquitty", "ward.D", "ward.D2", "centroid", "median")


def center_distance(centers: np.ndarray) -> np.ndarray:
    unit = centers / np.linalg.norm(centers, axis=1, keepdims=True)
    d = np.maximum(0.0, 1.0 - unit @ unit.T)
    np.fill_diagonal(d, 0.0)
    return d


def merges(distance: np.ndarray, method: str = "average") -> list[tuple[float, int, int]]:
    """(height, left, right) per merge by the Lance-Williams update; negative numbers are topics
    (from -1), positive ones earlier merges (from 1). Ties go to the first pair."""
    if method not in METHODS:
        raise BadInput(f"method must be one of {METHODS}")
    squared = method in ("ward.D2",)
    d = distance.astype(float) ** 2 if squared else distance.astype(float).copy()
    k = len(d)
    size, name, alive = np.ones(k), [-(i + 1) for i in range(k)], list(range(k))
    out = []
    for step in range(1, k):
        i, j = min(((a, b) for x, a in enumerate(alive) for b in alive[x + 1 :]), key=lambda p: (d[p], p))
        height = float(np.sqrt(d[i, j]) if squared else d[i, j])
        left, right = sorted((name[i], name[j]), key=lambda n: (n > 0, abs(n)))
        out.append((height, left, right))
        ni, nj, dij = size[i], size[j], d[i, j]
        for h in alive:
            if h in (i, j):
                continue
            a, b, nh = d[i, h], d[j, h], size[h]
            if method == "single":
                v = min(a, b)
            elif method == "complete":
                v = max(a, b)
            elif method == "average":
                v = (ni * a + nj * b) / (ni + nj)
            elif method == "mcquitty":
                v = (a + b) / 2
            elif method == "centroid":
                v = (ni * a + nj * b) / (ni + nj) - ni * nj * dij / (ni + nj) ** 2
            elif method == "median":
                v = (a + b) / 2 - dij / 4
            else:
                v = ((ni + nh) * a + (nj + nh) * b - nh * dij) / (ni + nj + nh)
            d[i, h] = d[h, i] = v
        size[i], name[i] = ni + nj, step
        alive.remove(j)
    return out


def merge_table(centers: np.ndarray, labels: list[str], method: str = "average") -> list[tuple[int, float, str, str]]:
    """(step, height, left, right) with readable names."""

    def title(n: int) -> str:
        return f"topic {-n} ({labels[-n - 1]})" if n < 0 else f"merge {n}"

    return [(s + 1, h, title(a), title(b)) for s, (h, a, b) in enumerate(merges(center_distance(centers), method))]


def cut(tree: list[tuple[float, int, int]], k_topics: int, groups: int) -> list[int]:
    """Group of each topic (from 0, in order of first topic) when the tree is cut into ``groups``."""
    members: dict[int, list[int]] = {-(i + 1): [i] for i in range(k_topics)}
    for step in range(k_topics - groups):
        _, a, b = tree[step]
        members[step + 1] = members.pop(a) + members.pop(b)
    out = [0] * k_topics
    for g, m in enumerate(sorted(members.values(), key=min)):
        for t in m:
            out[t] = g
    return out


def summary(centers: np.ndarray, method: str = "average") -> list[tuple[int, int, float, int, float]]:
    """(topic, nearest_topic, distance, merge_step, merge_height) per topic, numbers from 1."""
    d = center_distance(centers)
    tree = merges(d, method)
    np.fill_diagonal(d, np.inf)
    out = []
    for t in range(len(d)):
        near = int(d[t].argmin())
        step = next(s for s, (_, a, b) in enumerate(tree) if -(t + 1) in (a, b))
        out.append((t + 1, near + 1, float(d[t, near]), step + 1, tree[step][0]))
    return out
