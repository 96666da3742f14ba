"""Problem 9: evaluation texts leaking into training text.

Method: a distributed positional inverted index. Every document gets its posting lists (terms in
order, the word positions of each) for the terms of the test items; the index is stored once,
for any number of items, in shards by document, and the lists of one batch are merged on
reading. Document frequencies, one small group-by over the index, are joined to the items'
words and say which terms of every window of an item are rarest. In a shard the lists of a
window's two rarest terms are intersected after subtracting their offsets (all windows at once:
the list of the rarest term is read, and the other term must stand at its offset), every
survivor's words are compared with the item's, and maximal runs of at least ``min_words`` words
are exact phrase matches. Runs half as long that follow one another within ``slack`` words in
both texts are joined to proximity matches, each run with all that follow within the slack;
those that overlap a phrase match are left out. Work is in proportion to the postings of the
rarest terms, not to documents times items.

Shards hold whole documents, so intersections need no shuffle: only document frequencies move.
Items are prepared by Spark and reach the tasks in blocks of at most ``ITEMS_PER_BLOCK``; more
blocks mean more passes over the index, not over the corpus.

Words are runs of letters, marks and digits in lower case; a word hyphenated over a line
break is joined. Edge cases: null and empty texts or ids give no rows; an item shorter than
``min_words`` words matches as a whole only; repeated documents and items give repeated rows once
per id; empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.store import materialize

ITEMS_PER_BLOCK = 20_000
#: Terms of all items up to which the index holds items' terms only; beyond it holds all terms.
MAX_VOCABULARY = 2_000_000
#: Most postings or words looked at in one step of a shard, to bound its memory.
_STEP = 4_000_000
_BROKEN = re.compile(r"(?<=[^\W\d_])[-‐­][ \t]*\r?\n[ \t]*(?=[^\W\d_])")
_GONE = dict.fromkeys((0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF))
_WORD = re.compile(r"[^\W_](?:[^\W_]|[̀-ͯऀ-෿ั-๎])*")


def words_of(text: str) -> list[str]:
    text = _BROKEN.sub("", text) if "\n" in text else text
    return _WORD.findall(text.translate(_GONE).lower() if not text.isascii() else text.lower())


class Terms:
    """Numbers of words: 63-bit hashes, -1 for words outside the vocabulary; kept per worker."""

    def __init__(self, vocabulary: np.ndarray | None = None):
        self.known, self.vocabulary = {}, None if vocabulary is None else set(vocabulary.tolist())

    def numbers(self, words: list[str]) -> np.ndarray:
        if len(self.known) > 1_000_000:
            self.known = {}
        out = list(map(self.known.get, words))
        if None in out:
            for w in {w for w, k in zip(words, out) if k is None}:
                h = int.from_bytes(blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") >> 1
                self.known[w] = h if self.vocabulary is None or h in self.vocabulary else -1
            out = list(map(self.known.get, words))
        return np.array(out, np.int64)


def item_words(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, words) of every distinct item with words, as numbers of terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in batches:
            words = [terms.numbers(words_of(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.int64()))], names=["item_id", "words"])

    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).dropna().distinct()
    return rows.mapInArrow(run, "item_id long, words array<long>").filter(F.size("words") > 0)


def positional_index(documents: DataFrame, id_col: str, text_col: str, vocabulary: np.ndarray | None) -> DataFrame:
    """(id, n_words, terms, counts, positions): a document's posting lists, term by term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Terms(vocabulary).numbers
        for batch in batches:
            sizes, terms, counts, positions = [], [], [], []
            for text in batch.column(1).to_pylist():
                ids = numbers(words_of(text))
                at = np.flatnonzero(ids >= 0)
                order = np.argsort(ids[at], kind="stable")
                t, c = np.unique(ids[at], return_counts=True)
                sizes.append(len(ids)), terms.append(t), counts.append(c.astype(np.int32)), positions.append(at[order].astype(np.int32))
            arrays = [batch.column(0), pa.array(sizes, pa.int32()), pa.array(terms, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int32())), pa.array(positions, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "n_words", "terms", "counts", "positions"])

    rows = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter(F.col("id").isNotNull() & F.col("text").isNotNull())
    return rows.mapInArrow(run, "id long, n_words int, terms array<long>, counts array<int>, positions array<int>")


class Shard:
    """The merged posting lists of a batch of index rows; positions run over all its documents,
    which are set apart by a word that equals none."""

    def __init__(self, batch: pa.RecordBatch):
        self.ids = batch.column(0).to_numpy()
        n_words = batch.column(1).to_numpy().astype(np.int64)
        self.base = np.cumsum(n_words + 1) - n_words
        terms, counts, positions = (batch.column(i).flatten().to_numpy() for i in (2, 3, 4))
        per_doc = np.diff(batch.column(4).offsets.to_numpy()) if len(self.ids) else np.zeros(0, np.int64)
        at = positions + np.repeat(self.base, per_doc)
        of = np.repeat(terms, counts)
        order = np.argsort(of, kind="stable")
        self.at, of = at[order], of[order]
        self.terms, first = np.unique(of, return_index=True)
        self.bounds = np.append(first, len(self.at))
        self.words = np.full(int(self.base[-1] + n_words[-1] + 1) if len(self.ids) else 1, -1, np.int64)
        self.words[self.at] = of

    def lists(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and length of the posting lists of ``terms`` in ``at``."""
        if not len(self.terms):
            return np.zeros(len(terms), np.int64), np.zeros(len(terms), np.int64)
        slot = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return self.bounds[slot], np.where(self.terms[slot] == terms, self.bounds[slot + 1] - self.bounds[slot], 0)

    def word(self, at: np.ndarray) -> np.ndarray:
        inside = (at >= 0) & (at < len(self.words))
        return np.where(inside, self.words[np.where(inside, at, 0)], -1)


def anchors(item: np.ndarray, frequency: np.ndarray, window: int) -> list[tuple[int, int]]:
    """The two rarest positions of every window of an item, the rarest first, each pair once."""
    rank = sorted(range(len(item)), key=lambda o: (frequency[o], o))
    pairs = set()
    for start in range(max(1, len(item) - window + 1)):
        inside = [o for o in rank if start <= o < start + window][:2]
        pairs.add((inside[0], inside[-1]))
    return sorted(pairs)


class Plan:
    """The windows of a block of items, as arrays."""

    def __init__(self, rows: list, min_words: int, proximity: bool):
        self.ids = np.array([r.item_id for r in rows], np.int64)
        self.items = [np.array(r.words, np.int64) for r in rows]
        self.need = np.array([min(min_words, len(x)) for x in self.items], np.int64)
        self.shortest = np.maximum(np.minimum(2, self.need), self.need // 2) if proximity else self.need
        found = [(k, *p) for k, r in enumerate(rows) for p in anchors(self.items[k], np.array(r.frequency), int(self.shortest[k]))]
        self.of, self.first, self.second = np.array(found, np.int64).reshape(-1, 3).T
        self.first_term = np.array([self.items[k][a] for k, a, _ in found], np.int64)
        self.second_term = np.array([self.items[k][b] for k, _, b in found], np.int64)

    def candidates(self, shard: Shard) -> np.ndarray:
        """Distinct (item, diagonal) at which both rarest terms of a window stand."""
        start, length = shard.lists(self.first_term)
        live, out = np.flatnonzero(length), [np.zeros((0, 2), np.int64)]
        step = (np.cumsum(length[live]) - length[live]) // _STEP
        for part in np.split(live, np.flatnonzero(np.diff(step)) + 1):
            n = length[part]
            w = np.repeat(part, n)
            at = shard.at[np.repeat(start[part] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            d = at - self.first[w]
            held = shard.word(d + self.second[w]) == self.second_term[w]
            out.append(np.unique(np.stack([self.of[w[held]], d[held]], axis=1), axis=0))
        return np.unique(np.concatenate(out), axis=0)

    def runs(self, shard: Shard) -> np.ndarray:
        """(item, place in the shard, offset in the item, length) of all maximal runs, sorted."""
        found = self.candidates(shard)
        out = [np.zeros((0, 4), np.int64)]
        of, first = np.unique(found[:, 0], return_index=True)
        for k, diagonals in zip(of, np.split(found[:, 1], first[1:])):
            item = self.items[k]
            step = max(1, _STEP // len(item))
            for lo in range(0, len(diagonals), step):
                d = diagonals[lo : lo + step]
                same = np.zeros((len(d), len(item) + 2), np.int8)
                same[:, 1:-1] = shard.word(d[:, None] + np.arange(len(item))) == item
                turn = np.diff(same, axis=1)
                row, begin = np.nonzero(turn == 1)
                length = np.nonzero(turn == -1)[1] - begin
                ok = length >= self.shortest[k]
                out.append(np.stack([np.full(ok.sum(), k), d[row[ok]] + begin[ok], begin[ok], length[ok]], axis=1))
        return np.unique(np.concatenate(out), axis=0)

    def matches(self, shard: Shard, slack: int, proximity: bool) -> list[tuple[int, int, str, int, int]]:
        runs = self.runs(shard)
        doc = np.searchsorted(shard.base, runs[:, 1], side="right") - 1
        phrase = runs[:, 3] >= self.need[runs[:, 0]]
        rows = [(int(shard.ids[j]), int(self.ids[k]), "phrase", int(n), int(p - shard.base[j] + 1)) for j, (k, p, _, n) in zip(doc[phrase], runs[phrase])]
        for i in range(len(runs) if proximity else 0):  # sorted by item, then place: all runs within the slack
            k, p, o, n = runs[i]
            for j in range(i + 1, len(runs)):
                if runs[j, 0] != k or doc[j] != doc[i] or runs[j, 1] - (p + n) > slack:
                    break
                _, q, u, m = runs[j]
                if q >= p + n and 0 <= u - (o + n) <= slack and n + m >= self.need[k]:
                    whole = runs[phrase & (runs[:, 0] == k) & (doc == doc[i])]
                    if not ((whole[:, 1] < q + m) & (p < whole[:, 1] + whole[:, 3])).any():
                        rows.append((int(shard.ids[doc[i]]), int(self.ids[k]), "proximity", int(n + m), int(p - shard.base[doc[i]] + 1)))
        return rows


def leaks(documents: DataFrame, id_col: str, text_col: str, items: DataFrame, item_col: str, item_text_col: str, min_words: int = 12, slack: int = 5, proximity: bool = True) -> DataFrame:
    """(doc_id, item_id, kind, n_words, first_word): phrase and proximity matches of the items
    in the documents; ``first_word`` is the match's word position in the document, from 1."""
    spark = documents.sparkSession
    held = materialize(item_words(items, item_col, item_text_col), "p9-items")
    words = held.select("item_id", F.posexplode("words").alias("at", "term"))
    terms = words.select("term").distinct()
    n_items, n_terms = held.count(), terms.count()
    if not n_items:
        return spark.createDataFrame([], _SCHEMA)
    vocabulary = None
    if n_terms <= MAX_VOCABULARY:  # else the index holds all terms; the matches are the same
        vocabulary = np.array([r[0] for r in terms.collect()], np.int64)  # at most MAX_VOCABULARY numbers
    index = materialize(positional_index(documents, id_col, text_col, vocabulary), "p9-index")
    frequency = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    rare = words.join(frequency, "term", "left").groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("n", F.lit(0)).alias("n")))), lambda x: x["n"]).alias("frequency"))
    n_blocks = -(-n_items // ITEMS_PER_BLOCK)
    plans = materialize(held.join(rare, "item_id").withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(n_blocks))), "p9-plans")
    out = None
    for block in range(n_blocks):
        rows = plans.filter(F.col("block") == block).orderBy("item_id").collect()  # about ITEMS_PER_BLOCK items
        if rows:
            found = _match(index, Plan(rows, min_words, proximity), slack, proximity)
            out = found if out is None else out.unionByName(found)
    return out


_SCHEMA = "doc_id long, item_id long, kind string, n_words int, first_word int"


def _match(index: DataFrame, plan: Plan, slack: int, proximity: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(zip(*plan.matches(Shard(batch), slack, proximity))) or [[]] * 5
            types = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "item_id", "kind", "n_words", "first_word"])

    return index.mapInArrow(run, _SCHEMA)


def p9_found(spark, sf_dir: str) -> DataFrame:
    """Documents and the items of which they contain at least 12 words in unbroken order."""
    found = leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", spark.read.parquet(f"{sf_dir}/eval_items.parquet"), "item_id", "text", proximity=False)
    return found.filter("n_words >= 12").select("doc_id", "item_id").distinct()


def p9_matches(spark, sf_dir: str) -> DataFrame:
    """All phrase and proximity matches with their place and length."""
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", spark.read.parquet(f"{sf_dir}/eval_items.parquet"), "item_id", "text").distinct()


QUERIES = {"p9_found": p9_found, "p9_matches": p9_matches}
_SQL_WORDS = r"regexp_extract_all(lower(regexp_replace(text, '(\p{L})-[ \t]*\r?\n[ \t]*(\p{L})', '\1\2', 'g')), '[\p{L}\p{N}][\p{L}\p{N}\p{M}]*')"
SQL: dict[str, str] = {
    "p9_found": f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents WHERE text IS NOT NULL), e AS (SELECT item_id, {_SQL_WORDS} AS w FROM eval_items WHERE text IS NOT NULL),
dw AS (SELECT doc_id, hash(w[i : i + 11]) AS h, w[i : i + 11] AS g FROM d, range(1, len(w) - 10) r(i)),
ew AS (SELECT item_id, hash(w[i : i + 11]) AS h, w[i : i + 11] AS g FROM e, range(1, len(w) - 10) r(i))
SELECT DISTINCT doc_id, item_id FROM dw JOIN ew ON dw.h = ew.h AND dw.g = ew.g""",
    # runs of 6 words and more as islands of equal 6-grams on a diagonal; items have 12 words and more
    "p9_matches": f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents WHERE text IS NOT NULL), e AS (SELECT item_id, {_SQL_WORDS} AS w FROM eval_items WHERE text IS NOT NULL),
dw AS (SELECT doc_id, i, w[i : i + 5] AS g FROM d, range(1, len(w) - 4) r(i)), ew AS (SELECT item_id, i AS j, w[i : i + 5] AS g FROM e, range(1, len(w) - 4) r(i)),
hits AS (SELECT DISTINCT doc_id, item_id, i, j FROM dw JOIN ew ON hash(dw.g) = hash(ew.g) AND dw.g = ew.g),
isles AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, i - j ORDER BY i) AS isle FROM hits),
runs AS (SELECT doc_id, item_id, min(i) AS p, min(j) AS o, count(*) + 5 AS n FROM isles GROUP BY doc_id, item_id, i - j, isle),
near AS (SELECT a.doc_id, a.item_id, a.p, a.n + b.n AS n, b.p + b.n AS upto FROM runs a JOIN runs b USING (doc_id, item_id) WHERE b.p BETWEEN a.p + a.n AND a.p + a.n + 5 AND b.o BETWEEN a.o + a.n AND a.o + a.n + 5 AND a.n + b.n >= 12)
SELECT doc_id, item_id, 'phrase' AS kind, CAST(n AS INTEGER) AS n_words, CAST(p AS INTEGER) AS first_word FROM runs WHERE n >= 12
UNION SELECT doc_id, item_id, 'proximity', CAST(n AS INTEGER), CAST(p AS INTEGER) FROM near WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.n >= 12 AND r.doc_id = near.doc_id AND r.item_id = near.item_id AND r.p < near.upto AND near.p < r.p + r.n)""",
}
