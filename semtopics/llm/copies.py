"""Problem 5: duplicates hidden by formatting differences.

Method: an incremental ledger. Every message gets two canonical keys: its letters and digits in
order, and its labelled parts in sorted order. The ledger keeps, in hash buckets, one entry per
pair of keys with its number of copies and its earliest representative. A new batch is aggregated
first, full-outer-joined against the buckets it touches only, counts are added and the earliest
representative is kept; it needs nothing of other batches. That a message without labels equals a
labelled one letter by letter is settled when classes are read from the ledger.

Keys are two independent 64-bit hashes of the canonical text (128 bits: at 10**10
messages a collision has a chance below 10**-17), so no text is ever shuffled and the
aggregation stays in generated code.

Skew: a message repeated in a third of all rows is combined before the shuffle; in the
join back to rows, hot keys (fewer than 1000 by the pigeonhole principle) are broadcast.

Edge cases: null, empty and whitespace-only messages are no messages and give no rows; a
message without letters and digits has the empty key, so all such messages are copies of
one another; a row_id counts once however often it was delivered; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from ..plans.skew import join_unique
from ..plans.store import drop_path, materialize, new_path

_SPACES = "".join(map(chr, (0x9, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)))
_GONE = "".join(map(chr, (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFE0E, 0xFE0F, 0xFEFF)))
#: A labelled part starts with one word and a colon; parts are set apart by these marks or by line breaks.
_BREAKS = r"\r\n\x0b\x0c\x{85}\x{2028}\x{2029}"
_PART = rf"[ ;|{_BREAKS}]*[;|{_BREAKS}][ ;|{_BREAKS}]*(?=\p{{L}}+ *:)"
_LABELLED = r"^[^\p{L}\p{N}]*\p{L}+ *:"


def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def folded(text: Column) -> Column:
    """Lower case, composed accents, plain spaces, no invisible characters. Only texts
    with combining marks pass through Python."""
    nfc = pandas_udf(_nfc, "string")
    marks = text.rlike(r"[\x{300}-\x{36f}]")
    text = F.coalesce(nfc(F.when(marks, text)), text)
    plain = F.translate(text, _SPACES + _GONE, " " * len(_SPACES))
    return F.replace(F.lower(plain), F.lit("ß"), F.lit("ss"))


def _letters(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{L}\p{N}\p{M}]+", "")


def _keys(text: Column, prefix: str) -> list[Column]:
    return [F.xxhash64(text).alias(f"{prefix}a"), F.xxhash64(F.lit(7), text).alias(f"{prefix}b")]


def canonical_keys(df: DataFrame, id_col: str, text_col: str, *carry: str) -> DataFrame:
    """id, carried columns, s_a/s_b (key of letters and digits in order) and p_a/p_b (key of
    the labelled parts in sorted order; equal to s_* for unlabelled messages)."""
    df = df.select(F.col(id_col).alias("row_id"), *carry, folded(F.col(text_col)).alias("t"))
    df = df.filter(F.col("row_id").isNotNull() & F.col("t").rlike(rf"[^ {_BREAKS}]"))
    parts = F.when(F.col("t").rlike(_LABELLED), F.split("t", _PART))
    df = df.select("row_id", *carry, _letters(F.col("t")).alias("s"), parts.alias("parts"))
    labelled = F.array_join(F.array_sort(F.array_remove(F.transform("parts", _letters), "")), "\u001f")
    df = df.select("row_id", *carry, "s", F.when(F.size("parts") >= 2, labelled).otherwise(F.col("s")).alias("p"))
    return df.select("row_id", *carry, *_keys(F.col("s"), "s_"), *_keys(F.col("p"), "p_"))


_KEYS = ["s_a", "s_b", "p_a", "p_b"]
#: Entries a bucket should hold, from which the number of buckets follows.
ENTRIES_PER_BUCKET = 1_000_000


class Ledger:
    """Counts of canonical keys in hash buckets, kept as versions in the shared folder.

    ``version_of`` says for each bucket which version holds it (at most ``n_buckets``
    entries); a merge reads and rewrites only the buckets its batch touches."""

    SCHEMA = "bucket int, s_a long, s_b long, p_a long, p_b long, copies long, first_row_id long"

    def __init__(self, spark: SparkSession, n_buckets: int = 16):
        self.spark, self.n_buckets = spark, n_buckets
        self.path = new_path(spark, "ledger")
        self.version, self.version_of = 0, {}

    def state(self, buckets: set[int] | None = None) -> DataFrame:
        out = self.spark.createDataFrame([], self.SCHEMA)
        wanted = {b: v for b, v in self.version_of.items() if buckets is None or b in buckets}
        for version in sorted(set(wanted.values())):
            held = [b for b, v in wanted.items() if v == version]
            part = self.spark.read.schema(self.SCHEMA).parquet(f"{self.path}/v{version}").filter(F.col("bucket").isin(held))
            out = part if len(set(wanted.values())) == 1 else out.unionByName(part)
        return out

    def merge(self, batch: DataFrame) -> None:
        """``batch``: the keys, copies, first_row_id; several rows of one pair of keys are combined first."""
        bucket = F.pmod(F.col("s_a"), F.lit(self.n_buckets)).cast("int").alias("bucket")
        new = batch.groupBy(bucket, *_KEYS).agg(F.sum("copies").alias("copies"), F.min("first_row_id").alias("first_row_id"))
        if self.version_of:
            # bucket numbers only: at most n_buckets rows come to the driver
            touched = {r[0] for r in batch.select(bucket).distinct().collect()}
            old = self.state(touched).select("bucket", *_KEYS, F.col("copies").alias("_c"), F.col("first_row_id").alias("_f"))
            new = new.join(old, ["bucket", *_KEYS], "full_outer").select(
                "bucket", *_KEYS, (F.coalesce("copies", F.lit(0)) + F.coalesce("_c", F.lit(0))).alias("copies"), F.least("first_row_id", "_f").alias("first_row_id")
            )
        else:
            touched = set(range(self.n_buckets))
        self.version += 1
        new.select("bucket", *_KEYS, "copies", "first_row_id").repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/v{self.version}")
        dead = set(self.version_of.values())
        self.version_of |= dict.fromkeys(touched, self.version)
        for version in dead - set(self.version_of.values()):
            drop_path(self.spark, f"{self.path}/v{version}")

    def classes(self) -> DataFrame:
        """One row per pair of keys with its number of rows ``n`` and its class's ``copies`` and ``first_row_id``.

        A message without labels joins the class of a labelled one with the same letters in order."""
        entries = self.state().drop("bucket")
        labelled = entries.filter((F.col("s_a") != F.col("p_a")) | (F.col("s_b") != F.col("p_b")))
        alias = labelled.groupBy("s_a", "s_b").agg(F.min(F.struct("p_a", "p_b")).alias("to"))
        to = [F.coalesce(F.col(f"to.{k}"), F.col(k)).alias(k[-1]) for k in ("p_a", "p_b")]
        keyed = entries.join(alias, ["s_a", "s_b"], "left").select(*_KEYS, *to, F.col("copies").alias("n"), F.col("first_row_id").alias("_first"))
        totals = keyed.groupBy("a", "b").agg(F.sum("n").alias("copies"), F.min("_first").alias("first_row_id"))
        return keyed.drop("_first").join(totals, ["a", "b"]).drop("a", "b")


def copy_classes(messages: DataFrame, id_col: str, text_col: str, batch_col: Column) -> tuple[DataFrame, DataFrame, int]:
    """Run the ledger over ``messages``, one batch for each value of ``batch_col`` in order.

    Returns (rows: row_id and keys; classes: see ``Ledger.classes``; number of rows)."""
    keyed = canonical_keys(messages.withColumn("_batch", batch_col), id_col, text_col, "_batch")
    once = keyed.groupBy("row_id").agg(F.min("_batch").alias("batch"), *[F.min(k).alias(k) for k in _KEYS])
    rows = materialize(once, "p5-rows")
    periods = [(r[0], r[1]) for r in rows.groupBy("batch").count().orderBy("batch").collect()]  # one row per load period
    total = sum(n for _, n in periods)
    ledger = Ledger(rows.sparkSession, max(16, -(-total // ENTRIES_PER_BUCKET)))
    for b, _ in periods:
        ledger.merge(rows.filter(F.col("batch").eqNullSafe(F.lit(b))).select(*_KEYS, F.lit(1).alias("copies"), F.col("row_id").alias("first_row_id")))
    return rows, ledger.classes(), total


def _load_year() -> Column:
    """The load period that forms one batch of the ledger."""
    return F.year("loaded_at")


def p5_found(spark, sf_dir: str) -> DataFrame:
    """Every message that is not the first of its copies, with that first one."""
    rows, classes, total = copy_classes(spark.read.parquet(f"{sf_dir}/feedback_translations.parquet"), "row_id", "translation", _load_year())
    repeated = classes.filter("copies > 1").select(F.struct("s_a", "s_b", "p_a", "p_b").alias("k"), "n", "first_row_id")
    found = join_unique(rows.select("row_id", F.struct("s_a", "s_b", "p_a", "p_b").alias("k")), repeated, "k", "n", total)
    return found.filter("row_id <> first_row_id").select("first_row_id", "row_id")


def p5_messages(spark, sf_dir: str) -> DataFrame:
    """One record per message: its first row_id, its number of copies and the text of the first."""
    messages = spark.read.parquet(f"{sf_dir}/feedback_translations.parquet")
    _, classes, _ = copy_classes(messages, "row_id", "translation", _load_year())
    first = classes.select("first_row_id", "copies").distinct()
    texts = messages.select(F.col("row_id").alias("first_row_id"), "translation").dropDuplicates(["first_row_id"])
    return first.join(texts, "first_row_id").select("first_row_id", "copies", "translation")


QUERIES = {"p5_found": p5_found, "p5_messages": p5_messages}
_SQL_BREAKS = r"\r\n\x0b\x0c\x{85}\x{2028}\x{2029}"
SQL: dict[str, str] = {
    "p5_found": rf"""
WITH o AS (SELECT DISTINCT row_id, translation FROM feedback_translations WHERE translation IS NOT NULL AND row_id IS NOT NULL),
f AS (SELECT row_id, replace(lower(regexp_replace(regexp_replace(nfc_normalize(translation), '[\x{{AD}}\x{{200B}}-\x{{200D}}\x{{2060}}\x{{FE0E}}\x{{FE0F}}\x{{FEFF}}]', '', 'g'), '[\t\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{202F}}\x{{205F}}\x{{3000}}]', ' ', 'g')), 'ß', 'ss') AS t FROM o),
b AS (SELECT row_id, t, CASE WHEN regexp_matches(t, '^[^\p{{L}}\p{{N}}]*\p{{L}}+ *:') THEN string_split(regexp_replace(t, '[ ;|{_SQL_BREAKS}]*[;|{_SQL_BREAKS}][ ;|{_SQL_BREAKS}]*(\p{{L}}+ *:)', chr(31) || '\1', 'g'), chr(31)) END AS parts FROM f WHERE regexp_matches(t, '[^ {_SQL_BREAKS}]')),
k AS (SELECT row_id, regexp_replace(t, '[^\p{{L}}\p{{N}}\p{{M}}]+', '', 'g') AS s, CASE WHEN len(parts) >= 2 THEN array_to_string(list_sort(list_filter(list_transform(parts, lambda x: regexp_replace(x, '[^\p{{L}}\p{{N}}\p{{M}}]+', '', 'g')), lambda x: x <> '')), chr(31)) END AS p FROM b),
a AS (SELECT s, min(p) AS p FROM k WHERE p IS NOT NULL GROUP BY s),
c AS (SELECT row_id, min(row_id) OVER (PARTITION BY coalesce(a.p, k.p, k.s)) AS first_row_id FROM k LEFT JOIN a USING (s))
SELECT first_row_id, row_id FROM c WHERE row_id <> first_row_id"""
}
SQL["p5_messages"] = SQL["p5_found"].replace("SELECT first_row_id, row_id FROM c WHERE row_id <> first_row_id", "SELECT first_row_id, copies, translation FROM (SELECT first_row_id, count(*) AS copies FROM c GROUP BY first_row_id) JOIN o ON row_id = first_row_id")
