"""Quality of topics: coherence of their terms, diversity, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import BadInput


def coherence(units: DataFrame, term_table: DataFrame, unit_col: str, tokens_col: str = "tokens", measure: str = "npmi", n_terms: int = 10, smoothing: float = 1.0) -> DataFrame:
    """topic, measure, n_terms, coherence: mean score of ordered pairs of a topic's top terms
    by their presence in units; null for topics with fewer than two terms.

    Only tokens that are top terms leave the explode (a broadcast of topics x n_terms words,
    bounded by those parameters), and pairs are formed inside a topic's terms only."""
    if measure not in ("npmi", "umass"):
        raise BadInput("measure must be 'npmi' or 'umass'")
    top = term_table.filter(F.col("rank") <= n_terms).select("topic", "term", "rank")
    wanted = F.broadcast(top.select("term").distinct())
    present = units.select(F.col(unit_col).alias("unit"), F.explode(F.array_distinct(tokens_col)).alias("term")).join(wanted, "term")
    total = units.agg(F.count("*").alias("units"))
    frequency = present.groupBy("term").agg(F.count("*").alias("df"))
    # terms present in a unit, paired within the unit: at most (topics x n_terms) ** 2 / 2 a unit
    held = present.groupBy("unit").agg(F.sort_array(F.collect_set("term")).alias("ts")).filter(F.size("ts") > 1)
    i = F.explode("ts").alias("a")
    both = held.select("ts", i).select("a", F.explode(F.filter("ts", lambda x: x > F.col("a"))).alias("b")).groupBy("a", "b").agg(F.count("*").alias("both"))
    first = top.select("topic", F.col("term").alias("ti"), F.col("rank").alias("ri"))
    later = top.select("topic", F.col("term").alias("tj"), F.col("rank").alias("rj"))
    pairs = first.join(later, "topic").filter("ri < rj").withColumn("a", F.least("ti", "tj")).withColumn("b", F.greatest("ti", "tj"))
    pairs = pairs.join(both, ["a", "b"], "left").join(frequency.select(F.col("term").alias("ti"), F.col("df").alias("di")), "ti", "left").join(frequency.select(F.col("term").alias("tj"), F.col("df").alias("dj")), "tj", "left").join(F.broadcast(total))
    n, co = F.col("units"), F.coalesce("both", F.lit(0))
    if measure == "umass":
        score = F.log((co + smoothing) / F.col("di"))
    else:
        p = co / n
        score = F.when(co == 0, F.lit(-1.0)).when(co == n, F.lit(1.0)).otherwise(F.try_divide(F.log(p / ((F.col("di") / n) * (F.col("dj") / n))), -F.log(p)))
    scored = pairs.groupBy("topic").agg(F.avg(score).alias("coherence"))
    sizes = top.groupBy("topic").agg(F.count("*").alias("n_terms"))
    return sizes.join(scored, "topic", "left").select("topic", F.lit(measure).alias("measure"), "n_terms", "coherence")


def mean_coherence(scores: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """One row: mean coherence over the scored topics, weighted by ``sizes`` (topic, n_documents) if given."""
    rows = scores.filter("coherence is not null")
    if sizes is None:
        return rows.agg(F.avg("coherence").alias("mean_coherence"))
    rows = rows.join(sizes.select("topic", "n_documents"), "topic")
    return rows.agg(F.try_divide(F.sum(F.col("coherence") * F.col("n_documents")), F.sum("n_documents")).alias("mean_coherence"))


def topic_diversity(term_table: DataFrame, n_terms: int = 10) -> DataFrame:
    """One row: distinct over pooled top terms."""
    return term_table.filter(F.col("rank") <= n_terms).agg(F.try_divide(F.countDistinct("term"), F.count("*")).alias("topic_diversity"))


def summarize(topics: DataFrame, scores: DataFrame) -> DataFrame:
    """topic, label, n_documents, proportion, coherence."""
    return topics.join(scores.select("topic", "coherence"), "topic", "left").select("topic", "label", "n_documents", "proportion", "coherence")
