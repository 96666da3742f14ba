"""Corpus operators: usable rows, duplicates, cleaning, segmentation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import BadInput
from ..functions import segments as seg
from ..functions import text as tx


def usable_documents(df: DataFrame, text_col: str) -> DataFrame:
    """Rows whose text is neither null, blank nor a placeholder; other columns ride along."""
    return df.filter(tx.usable(text_col))


def dedupe(df: DataFrame, text_col: str, order_col: str) -> DataFrame:
    """Distinct non-blank texts with their number of copies ``n``; every other column comes
    from the first row by ``order_col``. One map-side combined aggregation; only the smallest
    row per text and partition is shuffled."""
    if "n" in df.columns:
        raise BadInput("the input already has a column 'n'")
    others = [c for c in df.columns if c != text_col]
    first = F.min_by(F.struct(*others), F.col(order_col)) if others else None
    rows = df.filter(F.col(text_col).isNotNull() & (tx.trim_ws(text_col) != ""))
    out = rows.groupBy(text_col).agg(first.alias("_first"), F.count("*").alias("n"))
    return out.select(*[F.col(f"_first.{c}").alias(c) if c != text_col else F.col(c) for c in df.columns], "n")


def clean_corpus(df: DataFrame, text_col: str, list_markers: bool = True, section_numbers: bool = True, numbers: bool = False, roman_numerals: bool = False, remove=None, min_content: float = 0.0) -> DataFrame:
    """Cleaned text in place of the raw one; null, emptied and low-content rows are dropped."""
    out = df.filter(F.col(text_col).isNotNull())
    if min_content > 0:
        out = out.filter(tx.content_ratio(tx.clean_characters(text_col)) >= min_content)
    out = out.withColumn(text_col, tx.clean_text(text_col, list_markers, section_numbers, numbers, roman_numerals, remove))
    return out.filter(F.col(text_col) != "")


def segment(df: DataFrame, id_col: str, text_col: str, level: str = "clause", merge_below: int = 0, abbreviations=None, max_tokens: int | None = None, token_counter=None, min_content: float = 0.0, keep=()) -> DataFrame:
    """(id, kept columns, segment, text): one row per part, numbered from 1 in each document."""
    if level not in seg.LEVELS:
        raise BadInput(f"level must be one of {seg.LEVELS}")
    parts = seg.segment_array(text_col, level, merge_below, abbreviations, max_tokens, token_counter)
    if min_content > 0:
        parts = F.filter(parts, lambda p: tx.content_ratio(p) >= min_content)
    rows = df.filter(F.col(text_col).isNotNull()).select(id_col, *keep, F.posexplode(parts).alias("segment", "_part"))
    return rows.select(id_col, *keep, (F.col("segment") + 1).cast("int").alias("segment"), F.col("_part").alias("text"))


def topic_sizes(units: DataFrame, topic_col: str = "topic", document_col: str | None = None, weight_col: str | None = None, segment_col: str | None = None) -> DataFrame:
    """topic, n_documents, proportion [, n_weighted, weighted_share].

    By unit, or with ``document_col`` by distinct (document, topic) pairs over distinct
    documents, weighted by the weight of the document's first segment in the topic."""
    if document_col:
        total = units.select(document_col).distinct().agg(F.count("*").alias("_n"))
        weight = F.min_by(weight_col, segment_col or weight_col) if weight_col else None
        per = units.groupBy(document_col, topic_col).agg(*( [weight.alias("_w")] if weight_col else [F.lit(1).alias("_w")]))
    else:
        total = units.agg(F.count("*").alias("_n"))
        per = units.select(topic_col, (F.col(weight_col) if weight_col else F.lit(1)).alias("_w"))
    sizes = per.groupBy(topic_col).agg(F.count("*").alias("n_documents"), F.sum("_w").cast("double").alias("n_weighted"))
    sizes = sizes.join(F.broadcast(total))  # one row
    out = sizes.select(topic_col, "n_documents", (F.col("n_documents") / F.col("_n")).alias("proportion"), "n_weighted")
    if not weight_col:
        return out.drop("n_weighted")
    whole = out.agg(F.sum("n_weighted").alias("_all"))
    return out.join(F.broadcast(whole)).select(topic_col, "n_documents", "proportion", "n_weighted", F.try_divide("n_weighted", "_all").alias("weighted_share"))
