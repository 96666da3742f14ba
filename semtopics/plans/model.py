"""Topic corpus, estimator and model: one persisted table of units, a bounded set of centres,
and everything else as lazy DataFrames over them."""

from __future__ import annotations

import json
import warnings

import numpy as np
from pyspark.ml import Estimator, Model
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import BadInput, BadTopicNames, DimensionMismatch, NoEmbeddings, NoFittedModel
from ..functions import text as tx
from ..operators import cluster, corpus, evaluate, hierarchy, inference
from ..operators import terms as term_ops
from ..operators.encode import encode
from .store import materialize

#: Segments of a document are numbered inside its id's range: unit_id = document_id * SEGMENTS + segment.
SEGMENTS = 1 << 20
TOKEN_SETTINGS = ("stop_words", "min_token_length", "numbers", "roman_numerals", "section_numbers")


class TopicCorpus:
    """Units (documents or segments) with tokens and embeddings, prepared once for many fits.

    ``df`` needs the text, a whole-number id and either an embedding column (of the unit the
    fit works on) or an ``encoder``. Unusable texts are dropped; other columns are carried."""

    def __init__(self, df: DataFrame, text_col: str = "text", id_col: str = "document_id", embedding_col: str | None = None, encoder=None, name_col: str | None = None, segment: str | None = None, merge_below: int = 0, max_tokens: int | None = None, min_content: float = 0.0, stem: bool = False, **token_settings):
        unknown = set(token_settings) - set(TOKEN_SETTINGS)
        if unknown:
            raise BadInput(f"unknown settings: {sorted(unknown)}")
        if embedding_col is None and encoder is None:
            raise NoEmbeddings("give an embedding column or an encoder")
        if segment and embedding_col:
            raise BadInput("a segmented corpus needs an encoder; pass segments as rows to use embeddings of your own")
        self.spark = df.sparkSession
        self.metadata = [c for c in df.columns if c not in (text_col, id_col, name_col, embedding_col, "document_id", "document_name", "text", "embedding", "unit_id", "segment", "tokens")]
        name = F.col(name_col).cast("string") if name_col else F.lit("")
        rows = df.filter(tx.usable(text_col)).select(F.col(id_col).cast("long").alias("document_id"), name.alias("document_name"), F.col(text_col).alias("text"), *([F.col(embedding_col).cast("array<double>").alias("embedding")] if embedding_col else []), *self.metadata)
        self.segmented = bool(segment)
        if segment:
            rows = corpus.segment(rows, "document_id", "text", segment, merge_below, None, max_tokens, None, min_content, ("document_name", *self.metadata))
            rows = rows.withColumn("unit_id", F.col("document_id") * SEGMENTS + F.col("segment"))
        else:
            rows = rows.withColumn("unit_id", F.col("document_id"))
        rows = rows.withColumn("tokens", tx.tokens("text", **token_settings))
        if embedding_col is None:
            rows = encode(rows, "text", encoder)
        if stem:
            rows = term_ops.collapse_inflections(rows, "unit_id")
        lead = ["unit_id", "document_id", "document_name", *(["segment"] if segment else []), "text", "tokens", "embedding"]
        self.units = materialize(rows.select(*lead, *self.metadata), "corpus")
        self.settings = {"segment": segment, "merge_below": merge_below, "max_tokens": max_tokens, "min_content": min_content, "stem": stem} | token_settings
        self.n, self.dim = cluster.check_vectors(self.units)
        if self.n < 2:
            raise BadInput("fewer than two usable texts")

    def to_df(self) -> DataFrame:
        return self.units

    def __repr__(self) -> str:
        kind = f"{self.settings['segment']} segments" if self.segmented else "documents"
        return f"TopicCorpus({self.n} {kind}, {self.dim}-dimensional embeddings)"


class TopicModel(Model):
    """A fitted model. Tables: documents, topics, terms, representatives."""

    def __init__(self, corpus_: TopicCorpus, fit: cluster.Fit, settings: dict, fixed: bool = False, labels: dict[int, str] | None = None, assigned: DataFrame | None = None):
        super().__init__()
        self.corpus, self.fit, self.settings, self.fixed = corpus_, fit, settings, fixed
        self.centers, self.n_topics = fit.centers, len(fit.centers)
        units = corpus_.units
        self.assigned = assigned if assigned is not None else cluster.assign_fit(units, fit.centers, fixed=fixed)
        self.names = labels or {}
        self.reload()

    def reload(self) -> None:
        s, spark = self.settings, self.corpus.spark
        scored = term_ops.stored_terms(self.assigned, n_terms=s["n_terms"], n_topics=self.n_topics, min_term_frequency=s["min_term_frequency"], weighting=s["weighting"], reduce_frequent_words=s["reduce_frequent_words"])
        reps = inference.stored_representatives(self.assigned, s["n_representatives"], "unit_id")
        made = inference.representative_labels(reps) if s["label"] == "representative" else term_ops.term_labels(scored)
        ids = spark.createDataFrame([(i + 1, self.names.get(i + 1)) for i in range(self.n_topics)], "topic int, given string")
        self.labels = ids.join(F.broadcast(made), "topic", "left").select("topic", F.coalesce("given", "label", F.concat(F.lit("topic_"), F.col("topic"))).alias("label"))
        total = int(self.fit.sizes.sum())
        rows = [(i + 1, int(n), float(n) / total, float(w)) for i, (n, w) in enumerate(zip(self.fit.sizes, self.fit.withinss))]
        self.topics = inference.with_labels(spark.createDataFrame(rows, "topic int, n_documents long, proportion double, withinss double"), self.labels)
        lead = ["document_id", "document_name", *(["segment"] if self.corpus.segmented else []), "text", "topic", "distance"]
        self.documents = inference.with_labels(self.assigned.select(*lead, *self.corpus.metadata), self.labels)
        self.terms_table = inference.with_labels(scored, self.labels)
        where = ["document_id", "document_name", *(["segment"] if self.corpus.segmented else [])]
        reps = reps.join(self.assigned.select("unit_id", *where), "unit_id").select("topic", "rank", *where, "text", "distance")
        self.representatives_table = inference.with_labels(reps, self.labels)
        self.diagnostics = {"totss": self.fit.totss, "betweenss": self.fit.betweenss, "explained": self.fit.betweenss / self.fit.totss if self.fit.totss else 0.0, "iterations": self.fit.iterations, "converged": self.fit.converged}

    def table(self, what: str = "documents") -> DataFrame:
        tables = {"documents": self.documents, "topics": self.topics, "terms": self.terms_table, "representatives": self.representatives_table}
        if what not in tables:
            raise BadInput(f"what must be one of {sorted(tables)}")
        return tables[what]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return inference.with_labels(cluster.assign_nearest(dataset, self.centers), self.labels)

    def predict(self, df: DataFrame, text_col: str = "text", id_col: str = "document_id", embedding_col: str | None = "embedding", encoder=None) -> DataFrame:
        """document_id, document_name[, segment], text, topic, label, distance of new texts, cut as in the fit."""
        new = df.filter(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("document_id"), (F.col("document_name") if "document_name" in df.columns else F.lit("")).alias("document_name"), F.col(text_col).alias("text"), *([F.col(embedding_col).cast("array<double>").alias("embedding")] if encoder is None else []))
        if self.corpus.segmented and encoder is not None:
            c = self.corpus.settings
            new = corpus.segment(new, "document_id", "text", c["segment"], c["merge_below"], None, c["max_tokens"], None, c["min_content"], ("document_name",))
        if encoder is not None:
            new = encode(new, "text", encoder)
        return self._transform(new).drop("embedding")

    def terms(self, n: int = 10, sort_by: str = "score", stem: bool | None = None, **settings) -> DataFrame:
        """Ranked terms; token settings and ``stem`` cut the texts into other tokens than the fit's."""
        tokens = {k: settings.pop(k) for k in TOKEN_SETTINGS if k in settings}
        units, fitted = self.assigned, self.corpus.settings
        if tokens or stem is not None:
            own = {k: v for k, v in fitted.items() if k in TOKEN_SETTINGS}
            units = units.withColumn("tokens", tx.tokens("text", **(own | tokens)))
            if fitted["stem"] if stem is None else stem:
                units = term_ops.collapse_inflections(units, "unit_id")
        kept = {k: self.settings[k] for k in ("min_term_frequency", "weighting", "reduce_frequent_words")}
        return inference.with_labels(term_ops.terms(units, n, sort_by, n_topics=self.n_topics, **(kept | settings)), self.labels)

    def membership(self, df: DataFrame | None = None, id_col: str = "unit_id", sharpness: float = 1.15) -> DataFrame:
        return inference.membership(self.corpus.units if df is None else df, self.centers, id_col, sharpness=sharpness)

    def gamma(self, top: int | None = None, assigned: DataFrame | None = None) -> DataFrame:
        rows = cluster.assign_nearest(self.corpus.units, self.centers) if assigned is None else assigned
        return inference.gamma(rows, self.n_topics, top=top)

    def representatives(self, n: int = 3, rank: str = "margin", df: DataFrame | None = None) -> DataFrame:
        return inference.representatives(self.corpus.units if df is None else df, self.centers, "document_id", n=n, rank=rank)

    def sizes(self, by: str = "segment", weight_col: str | None = None) -> DataFrame:
        rows = corpus.topic_sizes(self.assigned, document_col="document_id" if by == "document" else None, weight_col=weight_col, segment_col="unit_id")
        return inference.with_labels(rows, self.labels)

    def coherence(self, measure: str = "npmi", n_terms: int = 10, smoothing: float = 1.0) -> DataFrame:
        return inference.with_labels(evaluate.coherence(self.assigned, self.terms_table, "unit_id", measure=measure, n_terms=n_terms, smoothing=smoothing), self.labels)

    def diversity(self, n_terms: int = 10) -> DataFrame:
        return evaluate.topic_diversity(self.terms_table, n_terms)

    def summary(self, measure: str = "npmi", n_terms: int = 10) -> DataFrame:
        return evaluate.summarize(self.topics, self.coherence(measure, n_terms))

    def name_topics(self, labels: dict[int, str]) -> TopicModel:
        """The model with other labels, distinct and not empty, for some or all topics."""
        values = list(labels.values())
        if any(not v or not str(v).strip() for v in values) or len(set(values)) < len(values):
            raise BadTopicNames("labels must be distinct and not empty")
        if any(k < 1 or k > self.n_topics for k in labels):
            raise BadTopicNames(f"topics are numbered from 1 to {self.n_topics}")
        return TopicModel(self.corpus, self.fit, self.settings, self.fixed, self.names | labels, self.assigned)

    def label_list(self) -> list[str]:
        return [r.label for r in self.labels.orderBy("topic").collect()]  # one row per topic

    def hierarchy(self, method: str = "average") -> DataFrame:
        rows = hierarchy.merge_table(self.centers, self.label_list(), method)
        return self.corpus.spark.createDataFrame(rows, "step int, height double, left string, right string")

    def hierarchy_summary(self, method: str = "average") -> DataFrame:
        names = self.label_list()
        rows = [(t, names[t - 1], n, names[n - 1], d, s, h) for t, n, d, s, h in hierarchy.summary(self.centers, method)]
        return self.corpus.spark.createDataFrame(rows, "topic int, label string, nearest_topic int, nearest_label string, distance double, merge_step int, merge_height double")

    def reduce_topics(self, n_topics: int, method: str = "average") -> TopicModel:
        """Cut the hierarchy into ``n_topics`` groups: centres are unit means of the members, numbered by size."""
        if not 2 <= n_topics < self.n_topics:
            raise BadInput(f"n_topics must lie between 2 and {self.n_topics - 1}")
        group = hierarchy.cut(hierarchy.merges(hierarchy.center_distance(self.centers), method), self.n_topics, n_topics)
        sizes = np.zeros(n_topics, np.int64)
        totals = np.zeros((n_topics, self.centers.shape[1]))
        raw = self.member_means()
        for t, g in enumerate(group):
            sizes[g] += self.fit.sizes[t]
            totals[g] += raw[t] * self.fit.sizes[t]
        order = sorted(range(n_topics), key=lambda g: (-sizes[g], g))
        new = {g: i for i, g in enumerate(order)}
        means = totals[order] / np.maximum(sizes[order], 1)[:, None]
        centers = means / np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-12)
        into = F.element_at(F.array(*[F.lit(new[g] + 1) for g in group]), F.col("topic"))
        moved = self.assigned.withColumn("topic", into.cast("int"))
        # within sums of squares about the members' mean: sum of |x|^2 (1 for unit rows) less n |mean|^2
        within = sizes[order] * (1.0 - (means**2).sum(1))
        unit = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in centers])
        from ..functions.vector import dot, l2_normalize

        moved = moved.withColumn("distance", F.greatest(F.lit(0.0), 1 - dot(l2_normalize("embedding"), F.element_at(unit, F.col("topic")))))
        fit = cluster.Fit(centers, sizes[order], within, self.fit.totss, self.fit.iterations, self.fit.converged)
        return TopicModel(self.corpus, fit, self.settings, True, None, moved)

    def member_means(self) -> np.ndarray:
        rows = cluster._vectors(self.corpus.units, "unit_id", "embedding")
        return cluster._pass(rows, self.centers, self.centers.shape[1], self.fixed)[1] if self.fixed else self.centers

    def save(self, path: str) -> None:
        """Tables as Parquet, centres and settings as JSON, under one folder."""
        for what in ("documents", "topics", "terms", "representatives"):
            self.table(what).write.mode("overwrite").parquet(f"{path}/{what}")
        state = {"centers": self.centers.tolist(), "diagnostics": self.diagnostics, "settings": {k: v for k, v in self.settings.items() if not callable(v)}, "sizes": [int(n) for n in self.fit.sizes]}
        self.corpus.spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1).write.mode("overwrite").text(f"{path}/state")

    def __repr__(self) -> str:
        d = self.diagnostics
        return f"TopicModel({self.n_topics} topics, explained {d['explained']:.3f}, {'converged' if d['converged'] else 'not converged'} after {d['iterations']} passes)"


class SavedTopicModel:
    """Tables and centres of a saved model; assigns new vectors."""

    def __init__(self, spark: SparkSession, path: str):
        state = json.loads(spark.read.text(f"{path}/state").first()[0])
        self.centers, self.diagnostics, self.settings = np.array(state["centers"]), state["diagnostics"], state["settings"]
        self.tables = {what: spark.read.parquet(f"{path}/{what}") for what in ("documents", "topics", "terms", "representatives")}

    def transform(self, df: DataFrame) -> DataFrame:
        return inference.with_labels(cluster.assign_nearest(df, self.centers), self.tables["topics"].select("topic", "label"))


class TopicEstimator(Estimator):
    """Fit topics on a TopicCorpus, or on a DataFrame with the arguments of one."""

    def __init__(self, n_topics: int = 10, iter_max: int = 100, n_terms: int = 10, n_representatives: int = 3, min_term_frequency: int = 1, weighting: str = "ctfidf", reduce_frequent_words: bool = False, label: str = "representative", seeds=None, seed_names=None, fixed_seeds: bool = False, **corpus_settings):
        super().__init__()
        self.n_topics, self.iter_max = n_topics, iter_max
        self.settings = {"n_terms": n_terms, "n_representatives": n_representatives, "min_term_frequency": min_term_frequency, "weighting": weighting, "reduce_frequent_words": reduce_frequent_words, "label": label}
        self.seeds, self.seed_names, self.fixed_seeds, self.corpus_settings = seeds, seed_names, fixed_seeds, corpus_settings

    def _fit(self, dataset) -> TopicModel:
        return self.fit_corpus(dataset if isinstance(dataset, TopicCorpus) else TopicCorpus(dataset, **self.corpus_settings))

    def fit_corpus(self, c: TopicCorpus) -> TopicModel:
        seeds = None if self.seeds is None else np.asarray(self.seeds, float)
        n_seeds = 0 if seeds is None else len(seeds)
        if seeds is not None:
            if seeds.ndim != 2 or seeds.shape[1] != c.dim:
                raise DimensionMismatch(f"seeds need {c.dim} values each")
            if not np.isfinite(seeds).all() or (np.linalg.norm(seeds, axis=1) == 0).any():
                raise BadInput("a seed is zero or not finite")
            seeds = seeds / np.linalg.norm(seeds, axis=1, keepdims=True)
        if n_seeds > self.n_topics or (self.fixed_seeds and n_seeds != self.n_topics):
            raise BadInput("fixed seeds need one seed per topic; otherwise at most n_topics seeds")
        if self.n_topics >= c.n and self.n_topics > 1:
            raise BadInput("n_topics must be smaller than the number of units")
        centers = seeds
        if n_seeds < self.n_topics:
            centers, _ = cluster.farthest_point_centers(c.units, self.n_topics, existing=seeds, dim=c.dim, n=c.n)
        fit = cluster.lloyd(c.units, centers, iter_max=self.iter_max, reorder=seeds is None, fixed=self.fixed_seeds)
        labels = {i + 1: n for i, n in enumerate(self.seed_names or []) if n}
        return TopicModel(c, fit, self.settings, self.fixed_seeds, labels)


class TopicSweep:
    """Fits of several numbers of topics (and corpora by level) with their quality."""

    COLUMNS = "segment string, n_topics int, coherence double, topic_diversity double, explained double, converged boolean"

    def __init__(self, corpora: dict[str, TopicCorpus], n_topics, measure: str = "npmi", n_terms: int = 10, keep_models: bool = True, coherence_weight: str = "none", **settings):
        rows, self.models = [], {}
        for level, c in corpora.items():
            ks = sorted(set(int(k) for k in n_topics))
            if c.n < 3 or any(k < 2 or k >= c.n for k in ks):
                raise BadInput("every n_topics must be at least 2 and below the number of units (at least 3)")
            for k in ks:
                with warnings.catch_warnings():
                    warnings.simplefilter("ignore")
                    m = TopicEstimator(k, **settings).fit_corpus(c)
                scores = m.coherence(measure, n_terms)
                mean = evaluate.mean_coherence(scores, m.topics if coherence_weight == "size" else None).first()[0]
                rows.append((level, k, mean, m.diversity(n_terms).first()[0], m.diagnostics["explained"], m.diagnostics["converged"]))
                if keep_models:
                    self.models[(level, k)] = m
        self.rows, self.spark = rows, next(iter(corpora.values())).spark

    def to_df(self) -> DataFrame:
        return self.spark.createDataFrame(self.rows, self.COLUMNS)

    def __repr__(self) -> str:
        best = max((r for r in self.rows if r[2] is not None), key=lambda r: r[2], default=None)
        return f"TopicSweep({len(self.rows)} candidates" + (f", most coherent: {best[1]} topics by {best[0]})" if best else ")")

    def fitted(self, n_topics: int, segment: str | None = None) -> TopicModel:
        for (level, k), m in self.models.items():
            if k == n_topics and segment in (None, level):
                return m
        raise NoFittedModel(f"no kept model with {n_topics} topics" + (f" for {segment}" if segment else ""))

    def summary(self) -> DataFrame:
        """Per level the most coherent number of topics (the smallest on ties)."""
        out = []
        for level in dict.fromkeys(r[0] for r in self.rows):
            own = [r for r in self.rows if r[0] == level]
            scored = [r for r in own if r[2] is not None and np.isfinite(r[2])]
            best = max(scored, key=lambda r: r[2]) if scored else (level, None, None, None, None, None)
            out.append((level, len(own), own[0][1], own[-1][1], best[1], best[2], best[3], best[4], all(r[5] for r in own)))
        return self.spark.createDataFrame(out, "segment string, n_candidates int, min_topics int, max_topics int, best_n_topics int, coherence double, topic_diversity double, explained double, all_converged boolean")


def compare_topics(corpora: TopicCorpus | dict[str, TopicCorpus], n_topics=(5, 10, 15, 20, 25, 30), **settings) -> TopicSweep:
    return TopicSweep(corpora if isinstance(corpora, dict) else {corpora.settings["segment"] or "document": corpora}, n_topics, **settings)


def select_topics(*args, **kwargs) -> TopicSweep:
    warnings.warn("select_topics() is now compare_topics()", DeprecationWarning, stacklevel=2)
    return compare_topics(*args, **kwargs)


def topics(df: DataFrame, n_topics: int = 10, seed_texts=None, encoder=None, **settings) -> TopicModel:
    """Fit in one call: corpus settings and estimator settings side by side. ``seed_texts`` (a list,
    or a dict of names to texts or lists of texts) are encoded with ``encoder``."""
    own = {k: settings.pop(k) for k in ("iter_max", "n_terms", "n_representatives", "min_term_frequency", "weighting", "reduce_frequent_words", "label", "seeds", "seed_names", "fixed_seeds") if k in settings}
    if seed_texts is not None:
        if encoder is None:
            raise NoEmbeddings("seed texts need an encoder")
        named = seed_texts if isinstance(seed_texts, dict) else {i: t for i, t in enumerate(seed_texts)}
        texts = [t if isinstance(t, str) else " ".join(t) for t in named.values()]
        own |= {"seeds": np.asarray(encoder(texts), float), "seed_names": [k if isinstance(k, str) else "" for k in named]}
    return TopicEstimator(n_topics, **own).fit_corpus(TopicCorpus(df, encoder=encoder, **settings))
