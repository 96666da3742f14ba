"""Topic terms: class TF-IDF and BM25 weights, within-topic probabilities, inflections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from ..errors import BadInput
from ..plans.store import materialize


def term_counts(units: DataFrame, topic_col: str, tokens_col: str, min_term_frequency: int = 1) -> DataFrame:
    """topic, term, n: counts over the vocabulary of terms with at least ``min_term_frequency``
    occurrences in all. The explode is combined map-side, so (topic, term) pairs are shuffled,
    not tokens; the pairs are kept as a table, as all that follows is counted from them."""
    counts = units.select(F.col(topic_col).alias("topic"), F.explode(tokens_col).alias("term")).groupBy("topic", "term").agg(F.count("*").alias("n"))
    counts = counts.withColumn("f", F.sum("n").over(Window.partitionBy("term"))).filter(F.col("f") >= min_term_frequency)
    return materialize(counts, "term-counts")


def term_scores(units: DataFrame, topic_col: str = "topic", tokens_col: str = "tokens", n_topics: int | None = None, min_term_frequency: int = 1, weighting: str = "ctfidf", reduce_frequent_words: bool = False, smoothing: float = 0.0) -> DataFrame:
    """topic, term, score, frequency, beta for every term seen in a topic.

    With n the count of a term in a topic, L the topic's number of vocabulary tokens, A the
    mean of L over all topics and f the term's count in all: score = tf * ln(1 + A / f), or
    for ``bm25`` tf * ln(1 + (A - f + 0.5) / (f + 0.5)), with tf = n / L or its square root."""
    if weighting not in ("ctfidf", "bm25"):
        raise BadInput("weighting must be 'ctfidf' or 'bm25'")
    counts = term_counts(units, topic_col, tokens_col, min_term_frequency)
    lengths = counts.groupBy("topic").agg(F.sum("n").alias("length"))
    k = F.lit(n_topics) if n_topics else F.count("*")
    mean = lengths.agg((F.sum("length") / k).alias("a"))
    vocabulary = counts.agg(F.countDistinct("term").alias("v"))
    rows = counts.join(lengths, "topic").join(F.broadcast(mean)).join(F.broadcast(vocabulary))  # one row each
    f = F.greatest(F.col("f"), F.lit(1))
    tf = F.col("n") / F.greatest(F.col("length"), F.lit(1))
    tf = F.sqrt(tf) if reduce_frequent_words else tf
    idf = F.log(1 + F.col("a") / f) if weighting == "ctfidf" else F.log(1 + (F.col("a") - f + 0.5) / (f + 0.5))
    beta = F.try_divide(F.col("n") + smoothing, F.col("length") + smoothing * F.col("v"))
    return rows.select("topic", "term", (tf * idf).alias("score"), F.col("n").alias("frequency"), beta.alias("beta"))


def stored_terms(units: DataFrame, n_terms: int = 10, **settings) -> DataFrame:
    """topic, term, rank, score, frequency: ranked by score, count, then term."""
    w = Window.partitionBy("topic").orderBy(F.desc("score"), F.desc("frequency"), "term")
    return term_scores(units, **settings).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n_terms).select("topic", "term", "rank", "score", "frequency")


def terms(units: DataFrame, n: int = 10, sort_by: str = "score", **settings) -> DataFrame:
    """topic, term, rank, score, frequency, beta: ranked by score or beta, then term."""
    if sort_by not in ("score", "beta"):
        raise BadInput("sort_by must be 'score' or 'beta'")
    w = Window.partitionBy("topic").orderBy(F.desc(sort_by), "term")
    return term_scores(units, **settings).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select("topic", "term", "rank", "score", "frequency", "beta")


def term_labels(term_table: DataFrame, n: int = 3) -> DataFrame:
    """topic, label: the first terms joined by " / "."""
    top = term_table.filter(F.col("rank") <= n).groupBy("topic").agg(F.sort_array(F.collect_list(F.struct("rank", "term"))).alias("t"))
    return top.select("topic", F.array_join(F.transform("t", lambda t: t["term"]), " / ").alias("label"))


_VOWELS = "aeiouy"


def english_stem(word: str) -> str:
    """Stem by the published Porter2 ("english") algorithm."""
    if len(word) <= 2:
        return word
    special = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
    if word in special:
        return special[word]
    if word in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes"):
        return word
    w = word.lstrip("'")
    w = "".join("Y" if c == "y" and (i == 0 or w[i - 1] in _VOWELS) else c for i, c in enumerate(w))

    def region(start: int) -> int:
        for i in range(start + 1, len(w)):
            if w[i] not in _VOWELS and w[i - 1] in _VOWELS:
                return i + 1
        return len(w)

    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = region(0) if r1 is None else r1
    r2 = region(r1)

    def vowel(s: str) -> bool:
        return any(c in _VOWELS for c in s)

    def short_end(s: str) -> bool:
        if len(s) == 2:
            return s[0] in _VOWELS and s[1] not in _VOWELS
        return len(s) > 2 and s[-3] not in _VOWELS and s[-2] in _VOWELS and s[-1] not in _VOWELS + "wxY"

    for s in ("'s'", "'s", "'"):
        if w.endswith(s):
            w = w[: -len(s)]
            break
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and vowel(w[:-2]):
        w = w[:-1]
    if w in ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"):
        return w
    if w.endswith(("eedly", "eed")):
        end = 5 if w.endswith("eedly") else 3
        if len(w) - end >= r1:
            w = w[:-end] + "ee"
    else:
        for s in ("ingly", "edly", "ing", "ed"):
            if w.endswith(s):
                if vowel(w[: -len(s)]):
                    w = w[: -len(s)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif w[-2:] in ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"):
                        w = w[:-1]
                    elif short_end(w) and r1 >= len(w):
                        w += "e"
                break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWELS:
        w = w[:-1] + "i"
    for s, by in (("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", "")):
        if w.endswith(s):
            stem = w[: -len(s)]
            if len(stem) >= r1 and not (s == "ogi" and not stem.endswith("l")) and not (s == "li" and not stem.endswith(tuple("cdeghkmnrt"))):
                w = stem + by
            break
    for s, by in (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", "")):
        if w.endswith(s):
            stem = w[: -len(s)]
            if len(stem) >= r1 and not (s == "ative" and len(stem) < r2):
                w = stem + by
            break
    for s in ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic"):
        if w.endswith(s):
            stem = w[: -len(s)]
            if len(stem) >= r2 and not (s == "ion" and not stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not short_end(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


def collapse_inflections(units: DataFrame, id_col: str, tokens_col: str = "tokens") -> DataFrame:
    """``tokens_col`` with every token replaced by the most frequent form of its stem (ties
    alphabetical). Stems are made for distinct tokens only; the join back is on tokens."""
    stem = pandas_udf(lambda s: s.map(english_stem), "string")
    rows = units.select(id_col, F.posexplode(tokens_col).alias("_pos", "_token"))
    counts = rows.groupBy("_token").agg(F.count("*").alias("_n"))
    stems = counts.withColumn("_stem", stem("_token"))
    first = Window.partitionBy("_stem").orderBy(F.desc("_n"), "_token")
    shown = stems.withColumn("_shown", F.first("_token").over(first)).select("_token", "_shown")
    back = rows.join(shown, "_token").groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("_pos", "_shown"))).alias("_t"))
    back = back.select(id_col, F.transform("_t", lambda t: t["_shown"]).alias("_new"))
    empty = F.array().cast("array<string>")
    return units.join(back, id_col, "left").withColumn(tokens_col, F.coalesce("_new", F.when(F.col(tokens_col).isNotNull(), empty))).drop("_new")
