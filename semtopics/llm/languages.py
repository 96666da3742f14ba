"""Problem 7: missing or wrong language labels, and messages that mix languages.

Method: hyperdimensional profiles. Every letter has a random vector of +1/-1; an n-gram is
bound by multiplying its letters' vectors, each rotated by its place; a language prototype
bundles the vectors of its n-grams (trigrams of padded words and whole words) with
logarithmic weights, less the mean of all languages. A text is the bundle of its n-grams, so
its dot product with a prototype is the sum of its n-grams' dot products: these are computed
once on the driver for the n-grams of the training sample (unseen n-grams are
quasi-orthogonal to every prototype and count as 0; so do n-grams seen fewer than ``min_count``
times in every language's sample, which are noise). A message's words are labelled by the
best path over languages, where each change of language costs ``SWITCH``; runs of a language
become segments with a confidence (softmax over the languages' cosines, for which a text's norm is the
square root of its number of n-grams, as those are all but orthogonal).

Training: at most ``n_train`` rows per language, those of lowest id hash (a bounded,
documented sample); all messages are classified. Accents are also trained in stripped form,
and letters of another script inside a word are read as their look-alikes.

Plan: one Arrow pass without a shuffle over (id, text); paths are computed for whole batches
at a time. Edge cases: null and blank texts, and texts without letters, have no language and
give no segments; ties go to the first language in alphabetical order; very long texts are
labelled whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIMENSIONS = 8192
SWITCH = 0.37
#: ISO 639-2 codes of the languages met here, by 639-1 code.
THREE_LETTER = {"ces": "cs", "cze": "cs", "deu": "de", "ger": "de", "eng": "en", "hun": "hu", "mon": "mn", "pol": "pl", "ron": "ro", "rum": "ro", "rus": "ru", "slk": "sk", "slo": "sk", "ukr": "uk", "vie": "vi"}
#: Cyrillic letters and the Latin letters they look like.
_CYRILLIC, _LATIN = "аеорсухіјѕһкмтвн", "aeopcyxijshkmtbh"
_TO_LATIN, _TO_CYRILLIC = str.maketrans(_CYRILLIC, _LATIN), str.maketrans("aeopcyxi", "аеорсухі")
_WORD = re.compile(r"[^\W\d_]+")


def language_code(label: Column) -> Column:
    """Two-letter code of a label in any of its notations (``en``, ``EN``, ``en-GB``, ``eng``)."""
    base = F.lower(F.trim(F.split(label, "[-_]")[0]))
    table = F.create_map(*[F.lit(x) for pair in THREE_LETTER.items() for x in pair])
    return F.when(base == "", None).otherwise(F.coalesce(table[base], base))


def fold_word(word: str) -> str:
    if word.isascii():
        return word
    latin = sum(1 for c in word if c < "Ͱ")
    if 0 < latin < len(word):
        word = word.translate(_TO_LATIN) if latin * 2 >= len(word) else word.translate(_TO_CYRILLIC)
    return word


def ngrams(word: str) -> list[str]:
    padded = f"_{word}_"
    return [padded[i : i + 3] for i in range(len(padded) - 2)] + [padded]


def _stripped(word: str) -> str:
    flat = "".join(c for c in unicodedata.normalize("NFD", word) if unicodedata.category(c) != "Mn")
    return flat.translate(str.maketrans("đłøı", "dloi"))


def _letter(c: str, dimensions: int) -> np.ndarray:
    return (np.random.Generator(np.random.PCG64(ord(c))).integers(0, 2, dimensions, dtype=np.int8) * 2 - 1).astype(np.int8)


def _bind(gram: str, letters: dict, dimensions: int) -> np.ndarray:
    out = np.ones(dimensions, np.int8)
    for place, c in enumerate(gram):
        if c not in letters:
            letters[c] = _letter(c, dimensions)
        out *= np.roll(letters[c], place)
    return out


class Profiles:
    """Language prototypes and the dot products of known n-grams with them."""

    def __init__(self, samples: dict[str, list[str]], dimensions: int = DIMENSIONS, min_count: int = 3):
        self.languages = sorted(samples)
        counts: dict[str, Counter] = {}
        for language in self.languages:
            grams: Counter = Counter()
            words = Counter(fold_word(w) for t in samples[language] for w in _WORD.findall(t.lower()))
            for w, n in words.items():
                for form in {w, _stripped(w)}:
                    for g in ngrams(form):
                        grams[g] += n
            counts[language] = grams
        known = sorted({g for c in counts.values() for g, n in c.items() if n >= min_count})
        totals = {k: max(1, sum(c.values())) for k, c in counts.items()}
        weights = np.array([[np.log1p(counts[k][g] / totals[k] * 1e4) for k in self.languages] for g in known], np.float32).reshape(len(known), len(self.languages))
        letters: dict[str, np.ndarray] = {}
        block = 512
        prototypes = np.zeros((len(self.languages), dimensions), np.float32)
        for i in range(0, len(known), block):
            bound = np.stack([_bind(g, letters, dimensions) for g in known[i : i + block]]).astype(np.float32)
            prototypes += weights[i : i + block].T @ bound
        prototypes -= prototypes.mean(0)
        prototypes /= np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-9)
        self.table: dict[str, np.ndarray] = {}
        for i in range(0, len(known), block):
            bound = np.stack([_bind(g, letters, dimensions) for g in known[i : i + block]]).astype(np.float32)
            dots = bound @ prototypes.T / np.sqrt(dimensions)
            self.table.update(zip(known[i : i + block], dots.astype(np.float32)))


class _Words:
    """Scores of words, kept between batches of a worker."""

    def __init__(self, profiles: Profiles):
        self.profiles, self.ids, self.rows = profiles, {}, []
        self.zero = np.zeros(len(profiles.languages), np.float32)

    def scores(self, words: list[str]) -> np.ndarray:
        if len(self.ids) > 500_000:
            self.ids, self.rows = {}, []
        ids, rows, table = self.ids, self.rows, self.profiles.table
        out = []
        for w in words:
            at = ids.get(w)
            if at is None:
                at = ids[w] = len(rows)
                rows.append(sum((table[g] for g in ngrams(fold_word(w)) if g in table), self.zero))
            out.append(at)
        return np.array(rows, np.float32)[out] if len(out) * 4 > len(rows) else np.array([rows[i] for i in out], np.float32).reshape(len(out), -1)


def best_paths(scores: np.ndarray, lengths: np.ndarray, switch: float) -> np.ndarray:
    """Viterbi labels of many word sequences at once; ``scores`` is (words, languages), the
    sequences one after another with the given lengths."""
    labels = np.zeros(len(scores), np.int16)
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(lengths, kind="stable")
    k = scores.shape[1]
    i = 0
    while i < len(order):
        longest_fit = i
        while longest_fit < len(order) and (longest_fit - i + 1) * lengths[order[longest_fit]] <= 400_000:
            longest_fit += 1
        group = order[i : max(longest_fit, i + 1)]
        i += len(group)
        size = lengths[group]
        width = int(size.max()) if len(size) else 0
        if not width:
            continue
        at = np.minimum(starts[group][:, None] + np.arange(width), len(scores) - 1)
        inside = np.arange(width) < size[:, None]
        best = np.where(inside[:, :1, None], scores[at[:, :1]], 0)[:, 0]
        back = np.zeros((width, len(group), k), np.int16)
        here = np.arange(k, dtype=np.int16)
        for t in range(1, width):
            top = best.argmax(1)
            switched = best[np.arange(len(group)), top][:, None] - switch
            stay = best >= switched
            back[t] = np.where(stay, here, top[:, None])
            step = np.where(inside[:, t, None], scores[at[:, t]], 0)
            best = np.where(inside[:, t, None], np.where(stay, best, switched) + step, best)
            back[t] = np.where(inside[:, t, None], back[t], here)
        state = best.argmax(1).astype(np.int16)
        for t in range(width - 1, -1, -1):
            live = inside[:, t]
            labels[at[live, t]] = state[live]
            state = back[t][np.arange(len(group)), state]
    return labels


def language_segments(rows: DataFrame, id_col: str, text_col: str, profiles: Profiles, switch: float = SWITCH, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, segment, lang, confidence, start_char, n_words, kept columns): the language runs of each text."""
    columns = [id_col, "segment", "lang", "confidence", "start_char", "n_words", *keep]
    kept = [rows.schema[c].dataType.simpleString() for c in keep]
    schema = f"{id_col} long, segment int, lang string, confidence double, start_char int, n_words int" + "".join(f", {c} {t}" for c, t in zip(keep, kept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words(profiles)
        names = np.array(profiles.languages, object)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            found, lengths, starts = [], [], []
            for text in batch.column(1).to_pylist():
                words = list(_WORD.finditer(text)) if text else []
                found += [m.group().lower() for m in words]
                starts += [m.start() for m in words]
                lengths.append(len(words))
            lengths = np.array(lengths, np.int64)
            if not found:
                yield pa.RecordBatch.from_arrays([*[pa.array([], t) for t in (pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int32())], *[c.slice(0, 0) for c in batch.columns[2:]]], names=columns)
                continue
            scores = known.scores(found)
            labels = best_paths(scores, lengths, switch)
            doc = np.repeat(np.arange(len(lengths)), lengths)
            first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (labels[1:] != labels[:-1])])
            total = np.add.reduceat(scores, first, axis=0)
            n_words = np.diff(np.r_[first, len(doc)])
            grams = np.add.reduceat(np.array([len(w) + 1.0 for w in found]), first)
            cosine = total / np.sqrt(grams)[:, None]
            odds = np.exp(12.0 * (cosine - cosine.max(1, keepdims=True)))
            confidence = odds[np.arange(len(first)), labels[first]] / odds.sum(1)
            of = doc[first]
            segment = np.arange(len(first)) - np.searchsorted(of, of) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[of], pa.int64()), pa.array(segment, pa.int32()), pa.array(names[labels[first]], pa.string()), pa.array(confidence.astype(float)), pa.array(np.array(starts)[first] + 1, pa.int32()), pa.array(n_words, pa.int32()), *[c.take(pa.array(of)) for c in batch.columns[2:]]],
                names=columns,
            )

    return rows.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text"), *keep).filter(F.col(id_col).isNotNull() & F.col("text").isNotNull()).mapInArrow(run, schema)


def train(messages: DataFrame, n_train: int = 2000) -> Profiles:
    """Profiles from at most ``n_train`` rows per language: feedback by feedback_lang, and
    translations labelled English (whose few wrong labels a bundle outweighs)."""
    source = messages.select("row_id", language_code(F.col("feedback_lang")).alias("lang"), F.col("feedback").alias("text"))
    english = messages.select("row_id", language_code(F.col("translation_lang")).alias("lang"), F.col("translation").alias("text")).filter("lang = 'en'")
    labelled = source.unionByName(english).filter("lang is not null and text is not null")
    # rows of low id hash, half as many again as needed by each language's count, so no task
    # ever gets more than a sample; the window then takes exactly n_train of them
    counts = {r[0]: r[1] for r in labelled.groupBy("lang").count().collect()}  # one row per language
    if not counts:
        return Profiles({})
    span = 1 << 30
    share = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(span, int(span * 1.5 * n_train / n) + span // n + 1))])
    low = labelled.filter(F.pmod(F.xxhash64("row_id"), F.lit(span)) < share[F.col("lang")])
    w = Window.partitionBy("lang").orderBy(F.xxhash64("row_id"), "row_id", "text")
    sample = low.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= n_train)
    samples: dict[str, list[str]] = {}
    for lang, text in sample.select("lang", "text").orderBy("lang", "r").collect():  # languages x n_train short texts
        samples.setdefault(lang, []).append(text)
    return Profiles(samples)


def p7_segments(spark, sf_dir: str) -> DataFrame:
    """Language and confidence of every segment of every message."""
    messages = spark.read.parquet(f"{sf_dir}/feedback_translations.parquet")
    segments = language_segments(messages, "row_id", "translation", train(messages))
    return segments.dropDuplicates(["row_id", "segment"])


def p7_found(spark, sf_dir: str) -> DataFrame:
    """Messages whose label is missing, wrong or can't be right; one row per language contained."""
    messages = spark.read.parquet(f"{sf_dir}/feedback_translations.parquet")
    profiles = train(messages)
    # the label travels beside the text, so nothing is joined
    labelled = messages.select("row_id", "translation", language_code(F.col("translation_lang")).alias("label"))
    segments = language_segments(labelled, "row_id", "translation", profiles, keep=("label",))
    per = segments.groupBy("row_id").agg(F.collect_set("lang").alias("langs"), F.min("label").alias("label"))
    case = F.col("label").isNull() | (F.size("langs") > 1) | (F.col("label") != F.col("langs")[0])
    return per.filter(case).select("row_id", F.explode("langs").alias("lang"))


QUERIES = {"p7_found": p7_found, "p7_segments": p7_segments}
SQL: dict[str, str] = {}
