"""Problem 1: how distinctive a term is for a record of a collection.

Method: for every term a mixture of two Poisson distributions (an *elite* one, for the
records the term is about, and a background one) is fitted by expectation-maximisation
on the term's frequency histogram. The posterior probability of the elite component
scores each occurrence count.

Plan: the only large step is one map-side combined ``groupBy(record, term).count()``.
Frequency histograms are grouped again per term (their length is bounded by the number of
distinct frequencies), and EM runs vectorised over batches of terms inside one Arrow UDF.

Frequencies are rates and need not be whole numbers: the factorial of the Poisson density is the same
in both components and cancels in the posterior.

Edge cases: null texts, records or terms give no rows; an empty table gives an empty
result with the same schema; repeated rows count as often as they come (deduplicate
before); extra columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from ..plans.store import materialize

#: Frequencies are rates per this many messages, so records of unlike size compare.
PER = 1000


def words(text: Column) -> Column:
    """Distinct words of a text: unbroken runs of letters, in lower case."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), r"[^\p{L}]+")), "")


def em_two_poisson(x: np.ndarray, n: np.ndarray, tolerance: float = 1e-7, max_steps: int = 5000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """EM for B histograms at once. ``x`` and ``n`` are B x H: frequency and number of
    records with it (0 for padding). Each histogram is fitted until its parameters move by less
    than ``tolerance`` of themselves, and then left alone, so its fit doesn't depend on the others.
    Returns the elite share, elite rate and background rate."""
    x, n = x.astype(float), n.astype(float)
    total = np.maximum(n.sum(1), 1e-12)
    mean = (x * n).sum(1) / total
    top = np.where(n > 0, x, 0).max(1)
    elite = np.maximum(top, 1e-3)
    back = np.maximum(np.where(total > 1, (mean * total - top) / np.maximum(total - 1, 1e-12), mean) * 0.5, 1e-3)
    share = 1.0 / np.maximum(total, 2.0)
    live = np.arange(len(x))
    for _ in range(max_steps):
        if not len(live):
            break
        xs, ns = x[live], n[live]
        post = elite_posterior(xs, share[live, None], elite[live, None], back[live, None])
        w1, w0 = post * ns, (1 - post) * ns
        s1, s0 = w1.sum(1), w0.sum(1)
        new_elite = np.maximum(np.where(s1 > 1e-9, (w1 * xs).sum(1) / np.maximum(s1, 1e-12), elite[live]), 1e-3)
        new_back = np.maximum(np.where(s0 > 1e-9, (w0 * xs).sum(1) / np.maximum(s0, 1e-12), back[live]), 1e-3)
        moved = np.maximum(np.abs(new_elite - elite[live]) / new_elite, np.abs(new_back - back[live]) / new_back)
        elite[live], back[live], share[live] = new_elite, new_back, np.clip(s1 / total[live], 1e-6, 1 - 1e-6)
        live = live[moved > tolerance]
    if len(live):
        warnings.warn(f"EM of {len(live)} terms not settled after {max_steps} steps", stacklevel=2)
    return share, elite, back


def elite_posterior(x, share, elite, back):
    """Posterior probability of the elite component for frequency ``x`` (log-odds form;
    the factorial cancels)."""
    odds = np.log(share) - np.log1p(-share) + x * (np.log(elite) - np.log(back)) - (elite - back)
    return 1.0 / (1.0 + np.exp(-np.clip(odds, -500, 500)))


def _fit(hist: pd.Series) -> pd.DataFrame:
    width = max((len(h) for h in hist), default=1) or 1
    x, n = np.zeros((len(hist), width)), np.zeros((len(hist), width))
    for i, h in enumerate(hist):
        for j, p in enumerate(h):
            x[i, j], n[i, j] = p["x"], p["n"]
    share, elite, back = em_two_poisson(x, n) if len(hist) else (np.zeros(0),) * 3
    return pd.DataFrame({"share": share, "elite": elite, "back": back})


def two_poisson_scores(freqs: DataFrame, record: str, term: str, freq: str, n_records: int) -> DataFrame:
    """Score every (record, term) row of ``freqs`` by the posterior probability of the
    elite component at its frequency.

    ``freqs``: one row per record and term with a frequency above 0;
    ``n_records``: size of the collection, of which the records without the term form the
    histogram's zero class. Adds ``elite_share``, ``elite_rate``, ``back_rate``, ``log_odds`` (of
    the elite component, which orders where the probability is all but 1) and ``score``.
    Grouping is by term only, so no task holds more than one histogram at a time."""
    freqs = freqs.filter(F.col(record).isNotNull() & F.col(term).isNotNull() & (F.col(freq) > 0))
    hist = freqs.groupBy(term, F.col(freq).alias("x")).agg(F.count("*").alias("n"))
    hist = hist.groupBy(term).agg(F.collect_list(F.struct(F.col("x").cast("double").alias("x"), "n")).alias("h"), F.sum("n").alias("_df"))
    zero = F.struct(F.lit(0.0).alias("x"), F.greatest(F.lit(n_records) - F.col("_df"), F.lit(0)).alias("n"))
    fit_udf = pandas_udf(_fit, "struct<share:double,elite:double,back:double>")
    fit = hist.select(term, fit_udf(F.concat("h", F.array(zero))).alias("fit"))
    rate = F.col("fit.elite"), F.col("fit.back")
    odds = F.log(F.col("fit.share")) - F.log1p(-F.col("fit.share")) + F.col(freq) * (F.log(rate[0]) - F.log(rate[1])) - (rate[0] - rate[1])
    score = 1 / (1 + F.exp(-F.greatest(F.least(odds, F.lit(500.0)), F.lit(-500.0))))
    return freqs.join(fit, term).select(*freqs.columns, F.col("fit.share").alias("elite_share"), rate[0].alias("elite_rate"), rate[1].alias("back_rate"), odds.alias("log_odds"), score.alias("score"))


def topic_word_scores(messages: DataFrame, assignments: DataFrame) -> DataFrame:
    """Words of each stored topic with their elite posterior.

    A record is a topic; a word's frequency in it is the number of its messages with the
    word per ``PER`` messages. ``messages``: row_id, translation (a row_id counts once,
    however often it was delivered). Returns topic, term, n_with (messages of the topic with the
    word), n_topic, n_all (messages with a topic), n_with_all, freq, score, ..."""
    topics = assignments.filter(F.col("topic").isNotNull() & F.col("row_id").isNotNull()).select("row_id", F.col("topic").cast("int").alias("topic"))
    once = messages.select("row_id", "translation").dropDuplicates(["row_id"])
    rows = topics.join(once, "row_id", "left").select("topic", "translation")
    # one pass: an empty term counts the topic's messages, the words count themselves
    counted = rows.select("topic", F.explode(F.concat(F.array(F.lit("")), F.coalesce(words(F.col("translation")), F.array().cast("array<string>")))).alias("term")).groupBy("topic", "term").agg(F.count("*").alias("n_with"))
    counted = materialize(counted, "p1-counted")
    sizes = counted.filter(F.col("term") == "").select("topic", F.col("n_with").alias("n_topic"))
    per_word = counted.filter(F.col("term") != "")
    return per_word.join(sizes, "topic").withColumn("freq", F.lit(PER) * F.col("n_with") / F.col("n_topic"))


def p1_table(messages: DataFrame, assignments: DataFrame) -> DataFrame:
    counts = topic_word_scores(messages, assignments)
    sizes = counts.select("topic", "n_topic").distinct()
    n_topics, n_all = sizes.agg(F.count("*"), F.coalesce(F.sum("n_topic"), F.lit(0))).first()
    scored = two_poisson_scores(counts, "topic", "term", "freq", n_topics)
    everywhere = counts.groupBy("term").agg(F.sum("n_with").alias("n_with_all"))
    return scored.join(everywhere, "term").withColumn("n_all", F.lit(n_all))


def p1_found(spark, sf_dir: str) -> DataFrame:
    """Words that mark a topic: the elite ones, kept where at least a tenth of the topic's
    messages contain them and ten times the share of all other messages."""
    t = p1_table(spark.read.parquet(f"{sf_dir}/feedback_translations.parquet"), spark.read.parquet(f"{sf_dir}/document_assignments.parquet"))
    n_o, w_o = F.col("n_all") - F.col("n_topic"), F.col("n_with_all") - F.col("n_with")
    exact = (10 * F.col("n_with") >= F.col("n_topic")) & (F.col("n_with") * n_o >= 10 * w_o * F.col("n_topic"))
    return t.filter((F.col("score") >= 0.5) & exact).select("topic", "term")


def p1_topic_terms(spark, sf_dir: str) -> DataFrame:
    """topic_terms rebuilt: per topic the 20 words of highest elite posterior (by its log odds), ties by word."""
    t = p1_table(spark.read.parquet(f"{sf_dir}/feedback_translations.parquet"), spark.read.parquet(f"{sf_dir}/document_assignments.parquet"))
    w = Window.partitionBy("topic").orderBy(F.desc("log_odds"), "term")
    return t.withColumn("term_rank", F.row_number().over(w)).filter("term_rank <= 20").select("topic", "term_rank", "term", F.col("n_with").alias("within_topic_frequency"), "score", "log_odds", "freq", "elite_rate", "back_rate")


QUERIES = {"p1_found": p1_found, "p1_topic_terms": p1_topic_terms}
SQL: dict[str, str] = {
    "p1_found": r"""
WITH m AS (SELECT DISTINCT row_id, translation FROM feedback_translations),
r AS (SELECT CAST(a.topic AS INTEGER) AS topic, a.row_id, m.translation FROM document_assignments a LEFT JOIN m USING (row_id) WHERE a.topic IS NOT NULL),
s AS (SELECT topic, count(*) AS n FROM r GROUP BY topic), total AS (SELECT sum(n) AS n_all FROM s),
w AS (SELECT topic, row_id, unnest(list_distinct(regexp_extract_all(lower(translation), '\p{L}+'))) AS term FROM r),
c AS (SELECT topic, term, count(*) AS n_with FROM w GROUP BY topic, term), e AS (SELECT term, sum(n_with) AS n_any FROM c GROUP BY term)
SELECT topic, term FROM c JOIN s USING (topic) JOIN e USING (term), total
WHERE n_with * 10 >= n AND n_with * (n_all - n) >= 10 * (n_any - n_with) * n"""
}
