"""Keywords of documents: n-gram candidates, similarity to the document, maximal marginal relevance."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx


def mmr(relevance: np.ndarray, similarity: np.ndarray, n: int, diversity: float) -> list[int]:
    """Greedy choice of ``n`` candidates: most relevant first, then (1 - diversity) x relevance less
    diversity x the largest similarity to those chosen; the first wins ties."""
    if not len(relevance):
        return []
    chosen = [int(np.argmax(relevance))]
    while len(chosen) < min(n, len(relevance)):
        score = (1 - diversity) * relevance - diversity * similarity[:, chosen].max(1)
        score[chosen] = -np.inf
        chosen.append(int(np.argmax(score)))
    return chosen


def keywords(documents: DataFrame, encoder: Callable[[list[str]], np.ndarray], id_col: str = "document_id", text_col: str = "text", n: int = 10, max_ngram: int = 2, topic_diversity: float = 0.3, stop_words=None, min_token_length: int = 3) -> DataFrame:
    """id, rank, keyword, topic_similarity. ``encoder`` maps a list of texts to a matrix; it is
    called once per Arrow batch with the batch's documents and distinct candidates."""
    kind = documents.schema[id_col].dataType.simpleString()
    words = tx.tokens(text_col, stop_words, min_token_length)
    rows = documents.filter(F.col(text_col).isNotNull()).select(id_col, F.col(text_col).alias("t"), F.array_sort(tx.ngrams(words, max_ngram)).alias("c")).filter(F.size("c") > 0)

    def run(batches):
        for pdf in batches:
            pool = sorted({g for c in pdf.c for g in c})
            if not pool:
                continue
            x = np.asarray(encoder(list(pdf.t) + pool), float)
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            at = {g: len(pdf) + i for i, g in enumerate(pool)}
            out = []
            for d, (i, c) in enumerate(zip(pdf[id_col], pdf.c)):
                v = x[[at[g] for g in c]]
                relevance = v @ x[d]
                for rank, k in enumerate(mmr(relevance, v @ v.T, n, topic_diversity)):
                    out.append((i, rank + 1, c[k], float(relevance[k])))
            yield pd.DataFrame(out, columns=[id_col, "rank", "keyword", "topic_similarity"]).astype({"rank": "int32"})

    return rows.mapInPandas(run, f"`{id_col}` {kind}, rank int, keyword string, topic_similarity double")


def hashing_encoder(dimensions: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A model-free encoder for tests and demonstrations: hashed character trigrams."""

    def encode(texts: list[str]) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), dimensions))
        for i, t in enumerate(texts):
            t = f" {t.lower()} "
            for k in range(len(t) - 2):
                h = zlib.crc32(t[k : k + 3].encode())
                out[i, h % dimensions] += 1.0 if h & 65536 else -1.0
        return out

    return encode
