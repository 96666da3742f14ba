"""Vectors as array columns, by higher-order functions inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def as_double(v) -> Column:
    return col(v).cast("array<double>")


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(as_double(a), F.lit(0.0), lambda s, x: s + x * x))


def let(value, fn) -> Column:
    """``fn`` of a value that is computed once a row (a column inside a lambda would be
    computed anew for every element)."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def l2_normalize(a, lenient: bool = False) -> Column:
    """Unit vector; a zero vector gives null, or itself with ``lenient``."""
    v = as_double(a)
    n = norm(v)
    by = F.when(n < 1e-12, F.lit(1.0) if lenient else F.lit(None)).otherwise(n)
    return let(by, lambda d: F.transform(v, lambda x: x / d))


def cosine(a, b) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def blend(segment, document, alpha: float = 0.5) -> Column:
    """What a segment adds to its document, mixed with the document: alpha times the part of the
    unit segment vector orthogonal to the unit document vector, plus 1 - alpha times the latter."""
    vectors = F.struct(l2_normalize(segment, True).alias("u"), l2_normalize(document, True).alias("d"))

    def mix(p: Column) -> Column:
        return let(dot(p["u"], p["d"]), lambda along: F.zip_with(p["u"], p["d"], lambda x, y: alpha * (x - along * y) + (1 - alpha) * y))

    def unit(p: Column, m: Column) -> Column:
        return let(norm(m), lambda n: F.when(n < 1e-8, p["d"]).otherwise(F.transform(m, lambda x: x / n)))

    return let(vectors, lambda p: let(mix(p), lambda m: unit(p, m)))


def pool(token_embeddings, attention_mask, normalize: bool = True, method: str = "mean") -> Column:
    """One vector from token vectors: mean over unmasked tokens, or the first token."""
    t = col(token_embeddings).cast("array<array<double>>")
    m = col(attention_mask).cast("array<double>")
    if method == "cls":
        out = F.get(t, F.lit(0))
    else:
        pairs = F.zip_with(t, m, lambda x, w: F.struct(x.alias("t"), w.alias("m")))
        zero = F.transform(F.get(t, F.lit(0)), lambda x: F.lit(0.0))
        total = F.aggregate(pairs, zero, lambda s, p: F.zip_with(s, p["t"], lambda x, y: x + y * p["m"]))
        count = F.greatest(F.aggregate(m, F.lit(0.0), lambda s, x: s + x), F.lit(1e-9))
        out = let(count, lambda c: F.transform(total, lambda x: x / c))
    if not normalize:
        return out
    return let(out, lambda v: let(F.greatest(norm(v), F.lit(1e-12)), lambda n: F.transform(v, lambda x: x / n)))


def nearest(vector, centers: list[list[float]]) -> Column:
    """struct(topic, similarity): the centre of highest cosine, the first on ties, from 1.

    ``centers`` are unit vectors; the expression holds them as literals, so it is for a
    few small centres. Use ``operators.inference.assign`` otherwise."""
    table = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centers])
    sims = let(l2_normalize(vector), lambda v: F.transform(table, lambda c: dot(v, c)))
    return let(sims, lambda s: F.struct(F.array_position(s, F.array_max(s)).cast("int").alias("topic"), F.array_max(s).alias("similarity")))
