"""Problem 10: per-document text statistics and the kind of text they tell.

Method: statistics per document, standardised over the whole collection, are fitted by a
Gaussian mixture (diagonal covariances) with expectation-maximisation. Components start at
the statistics of a few inspected examples of each kind; after the fit each component is
mapped to prose, list, table or junk by the posterior mass of the examples in it.

Plan: one small pass adds up letter pairs over all documents (their conditional frequencies tell
random letters from words of any language); one Arrow pass over whole texts computes the statistics,
with characters classified for whole batches at a time; every EM step is one pass over that
narrow table which adds up K x (2D + 1) numbers per partition, so nothing grows with the data but
the scans. Common words are the ``n_common`` words in most documents of the collection (counted over
all documents).

A statistic that says nothing of a text is null (word lengths, common words and odd tokens of a
script without spaces) and counts as the collection's mean in the mixture.

Edge cases: null, empty and blank texts have null statistics and kind null; a collection
without usable texts gives only such rows; ties go to the first component; repeated rows
count as often as they come; other columns are not read.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import NotConverged
from ..plans.store import materialize

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
#: Scripts written without spaces: every character counts as a word.
_DENSE = re.compile(r"[฀-๿぀-ヿ㐀-鿿가-힯຀-໿ក-៿က-႟]")
_INDIC = re.compile(r"[ऀ-෿฀-๿̀-ͯ]")
#: Characters that end a sentence, and those that may close it after them.
_ENDS, _CLOSERS = frozenset(".!?…。！？।॥؟"), "'\"”’»)]」"
_MARKER = re.compile(r"^\s*(?:[-–—*+•·◦▪>]|\[[ xX]?\]|\(?(?:\d{1,3}|[A-Za-z]|[ivxIVX]{1,4})[.)]|\d+(?:\.\d+)+\.?|[^\W\d_]+ \d+:)\s+\S")
_CELL = re.compile(r"\t|\||;(?! )|,(?! )| {2,}")
_NUMBER = re.compile(r"^[-+]?\d+(?:[.,]\d+)?%?$")
_PLAIN = re.compile(r"^[\W_]{0,3}(?:[^\W\d_]+(?:[-'’/.][^\W\d_]+)*|\d+(?:[.,:]\d+)*)[%\W_]{0,4}$")
_SPOILT = re.compile(r"[\u0080-\u009f�]|Ã.|â€.?|Â|Å.|Ä.")
FEATURES = ("words_per_line", "table_share", "list_share", "symbol_ratio", "digit_ratio", "mean_word_length", "repetition", "odd_token_share", "end_punctuation_share", "common_word_share", "spoilt_share", "separator_share", "letter_pair_fit")
KINDS = ("prose", "list", "table", "junk")


def _windowed_repetition(words: list[str], width: int = 40) -> float:
    """Share of words that repeat within stretches of ``width`` words; short texts count less."""
    if len(words) < 5:
        return 0.0
    distinct = [len(set(words[i : i + width])) / len(words[i : i + width]) for i in range(0, len(words), width) if len(words[i : i + width]) >= min(20, len(words))]
    return (1.0 - sum(distinct) / len(distinct)) * min(1.0, len(words) / 20)


def _is_row(line: str) -> bool:
    cells = [c.strip() for c in _CELL.split(line.strip().strip("|"))]
    if len(cells) < 3:
        return False
    numbers = sum(1 for c in cells if _NUMBER.match(c))
    short = sum(1 for c in cells if len(c) <= 24)
    return short >= 0.8 * len(cells) and (numbers >= 0.4 * len(cells) or (numbers == 0 and re.search(r"[\t|;,]", line) is not None and max(map(len, cells)) <= 16 and line.rstrip().rstrip(_CLOSERS)[-1:] not in _ENDS))


#: Letters are told apart by their code modulo this prime, which keeps the alphabets met in practice apart.
_CLASSES = 509
_SEPARATOR = re.compile(r"[·•;,|](?=[ \t])| / ")


@cache
def _character_table() -> np.ndarray:
    """Bits of the characters of the basic plane: 1 space, 2 letter, 4 digit, 8 combining mark of an Indic or Thai script."""
    table = np.zeros(0x10000, np.uint8)
    for code in range(0x10000):
        c = chr(code)
        table[code] = c.isspace() | c.isalpha() << 1 | c.isdigit() << 2
    for code in (*range(0x900, 0xE00), *range(0xE00, 0xE80), *range(0x300, 0x370)):
        if not table[code] & 2:
            table[code] |= 8
    return table


class Characters:
    """Characters of a batch of texts as one array, and what they are, added up per text."""

    def __init__(self, texts: list[str]):
        low = [t.lower() for t in texts]
        self.low, self.sizes = low, np.array([len(t) for t in low], np.int64)
        codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
        beyond = np.flatnonzero(codes > 0xFFFF)
        self.bits = _character_table()[np.where(codes > 0xFFFF, 0, codes)]
        self.bits[beyond] = [2 * chr(c).isalpha() + 4 * chr(c).isdigit() for c in codes[beyond]]
        self.of = np.repeat(np.arange(len(low)), self.sizes)
        letter = (self.bits & 2) > 0
        both = letter[:-1] & letter[1:] & (self.of[:-1] == self.of[1:]) if len(codes) else np.zeros(0, bool)
        at = np.flatnonzero(both)
        self.pair_of = self.of[at]
        self.pairs = (codes[at] % _CLASSES).astype(np.int64) * _CLASSES + codes[at + 1] % _CLASSES

    def count(self, bit: int, without: bool = False) -> np.ndarray:
        held = (self.bits & bit) > 0
        return np.bincount(self.of[held != without], minlength=len(self.low))


def pair_fits(counts: np.ndarray) -> np.ndarray:
    """Logarithm of the share of every second letter after a first one (one count added to each)."""
    table = counts.reshape(_CLASSES, _CLASSES).astype(float) + 1.0
    return np.log(table / table.sum(1, keepdims=True)).ravel().astype(np.float32)


def letter_pairs(documents: DataFrame, text_col: str) -> np.ndarray:
    """Counts of letter pairs over all documents (at most 509 x 509 numbers come to the driver)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_CLASSES * _CLASSES, np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                total += np.bincount(Characters(batch.column(0).slice(i, 256).to_pylist()).pairs, minlength=len(total))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], names=["pair", "n"])

    rows = documents.select(F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    found = rows.mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(_CLASSES * _CLASSES, np.int64)
    counts[found.pair.to_numpy(int)] = found.n.to_numpy(np.int64)
    return counts


def _plain(token: str) -> bool:
    return token.isalpha() or token.strip(".,;:!?()\"'“”").isalpha() or _PLAIN.match(token) is not None


def batch_statistics(texts: list[str | None], common: frozenset, fits: np.ndarray) -> list[tuple[int, list[float | None]] | None]:
    """Word count and the values of ``FEATURES`` of every text; None for a blank one."""
    used = [i for i, t in enumerate(texts) if t and not t.isspace()]
    out: list = [None] * len(texts)
    chars = Characters([texts[i] for i in used])
    solid, letters, digits, marks = chars.count(1, True), chars.count(2), chars.count(4), chars.count(8)
    n_pairs = np.bincount(chars.pair_of, minlength=len(used))
    fit = np.bincount(chars.pair_of, weights=fits[chars.pairs], minlength=len(used)) / np.maximum(n_pairs, 1)
    for k, i in enumerate(used):
        out[i] = statistics(texts[i], chars.low[k], common, int(solid[k]), int(letters[k]), int(digits[k]), int(marks[k]), float(fit[k]) if n_pairs[k] else None)
    return out


def statistics(text: str, low: str, common: frozenset, solid: int, letters: int, digits: int, marks: int, fit: float | None) -> tuple[int, list[float | None]]:
    lines = [x for x in text.splitlines() if x.strip()] or [text]
    words = _WORD.findall(low)
    dense = [] if low.isascii() else _DENSE.findall(low)
    is_dense = len(dense) > 0.3 * max(1, letters)
    units = dense if is_dense else words
    n_words = len(units)
    tokens = text.split()
    odd = None if is_dense or marks else sum(len(t) for t in tokens if not _plain(t)) / max(1, solid)
    row_chars = list_chars = ends = 0
    total = 0
    for line in lines:
        size = len(line.strip())
        total += size
        end = line.rstrip().rstrip(_CLOSERS)[-1:] in _ENDS
        ends += end
        if _CELL.search(line) and _is_row(line):
            row_chars += size
        elif not end:
            n = len(line.split())
            if not is_dense and (_MARKER.match(line) or n <= 6) and sum(c.isalpha() or c.isspace() for c in line) >= 0.4 * len(line):
                list_chars += size
        elif _MARKER.match(line) and len(line.split()) <= 8:
            list_chars += size
    values = [
        float(np.log1p(n_words / len(lines))),
        row_chars / max(1, total),
        list_chars / max(1, total),
        max(0, solid - letters - digits - marks) / max(1, solid),
        digits / max(1, solid),
        None if is_dense or not words else sum(map(len, words)) / len(words),
        _windowed_repetition(units),
        odd,
        ends / len(lines),
        None if is_dense or not words else sum(1 for w in words if w in common) / len(words),
        (0 if low.isascii() else len(_SPOILT.findall(text))) / max(1, solid),
        0.0 if is_dense else len(_SEPARATOR.findall(text)) / max(1, len(tokens)),
        None if is_dense else fit,
    ]
    return n_words, values


def common_words(documents: DataFrame, text_col: str, n_common: int = 300) -> frozenset:
    """The words in most documents of the whole collection (at most ``n_common`` come to the driver)."""
    words = documents.select(F.explode(F.array_distinct(F.split(F.lower(F.col(text_col)), r"[^\p{L}']+"))).alias("w")).filter("length(w) > 1")
    top = words.groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(n_common)
    return frozenset(r[0] for r in top.collect())


def document_statistics(documents: DataFrame, id_col: str, text_col: str, common: frozenset, fits: np.ndarray) -> DataFrame:
    names = ["doc_id", "word_count", *FEATURES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                rows = batch_statistics(part.column(1).to_pylist(), common, fits)
                counts = pa.array([r and r[0] for r in rows], pa.int64())
                columns = [pa.array([r and r[1][k] for r in rows], pa.float64()) for k in range(len(FEATURES))]
                yield pa.RecordBatch.from_arrays([part.column(0), counts, *columns], names=names)

    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, word_count long, " + ", ".join(f"{f} double" for f in FEATURES))


class Mixture:
    """Gaussian mixture with diagonal covariances over standardised columns."""

    def __init__(self, means: np.ndarray, kinds: list[str] | None = None, floor: float = 0.05):
        k, d = means.shape
        self.means, self.variances, self.weights = means.copy(), np.full((k, d), 0.5), np.full(k, 1.0 / k)
        self.floor, self.kinds = floor, kinds

    def posterior(self, x: np.ndarray) -> np.ndarray:
        inverse = 1.0 / self.variances
        quad = (x * x) @ inverse.T - 2.0 * x @ (self.means * inverse).T + (self.means**2 * inverse).sum(1)
        logp = np.log(self.weights + 1e-300) - 0.5 * (quad + np.log(self.variances).sum(1))
        logp -= logp.max(1, keepdims=True)
        p = np.exp(logp)
        return p / p.sum(1, keepdims=True)

    def sums(self, x: np.ndarray) -> np.ndarray:
        p = self.posterior(x)
        return np.concatenate([p.sum(0)[:, None], p.T @ x, p.T @ (x * x)], axis=1)

    def update(self, sums: np.ndarray) -> float:
        d = self.means.shape[1]
        n = sums[:, :1]
        live = n[:, 0] > 1e-6
        means = np.where(live[:, None], sums[:, 1 : d + 1] / np.maximum(n, 1e-12), self.means)
        variances = np.where(live[:, None], sums[:, d + 1 :] / np.maximum(n, 1e-12) - means**2, self.variances)
        moved = float(np.abs(means - self.means).max())
        self.means, self.variances, self.weights = means, np.maximum(variances, self.floor), (n[:, 0] + 1e-3) / (n.sum() + 1e-3 * len(n))
        return moved


_FAR = 8.0


def _matrix(batch: pa.RecordBatch, mean: np.ndarray, scale: np.ndarray, first: int) -> np.ndarray:
    """Standardised statistics; a missing one counts as the mean, and none as more than ``_FAR`` deviations."""
    x = np.stack([batch.column(first + k).to_numpy(zero_copy_only=False).astype(float) for k in range(len(FEATURES))], axis=1)
    return np.clip(np.nan_to_num((x - mean) / scale, nan=0.0), -_FAR, _FAR)


def fit_mixture(stats: DataFrame, mean: np.ndarray, scale: np.ndarray, mixture: Mixture, max_iterations: int = 60, tolerance: float = 0.02) -> Mixture:
    """EM over all rows of ``stats``; each step adds up sufficient statistics per partition."""
    rows = stats.filter("word_count is not null").select(*FEATURES)
    k, width = len(mixture.means), 2 * len(FEATURES) + 1
    for _ in range(max_iterations):

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((k, width))
            for batch in batches:
                for i in range(0, batch.num_rows, 4096):
                    total += mixture.sums(_matrix(batch.slice(i, 4096), mean, scale, 0))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * width)), pa.array(total.ravel())], names=["at", "v"])

        parts = rows.mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v"))
        sums = np.zeros(k * width)
        for at, v in parts.collect():  # K x (2D + 1) numbers
            sums[at] = v
        if mixture.update(sums.reshape(k, width)) < tolerance:
            return mixture
    warnings.warn(f"mixture still moving after {max_iterations} steps", NotConverged, stacklevel=2)
    return mixture


def examples() -> list[tuple[str, str, str]]:
    """Inspected examples (archetype, kind, text), written for this purpose."""
    nouns = "lamp river saddle window cabbage thimble ladder pocket basket candle violin meadow kettle anchor button".split()
    pick = lambda i: nouns[i % len(nouns)]
    row = lambda i, s, n: s.join([pick(i), *[f"{(7 * i + 3 * j) % 90 + 1}" if j % 2 else f"{(i * 1.37 + j) % 9:.2f}" for j in range(n)]])
    english = "The second group of pupils explained the task to each other in the morning session, although the effect was small. We found that a short hint improved the number of correct answers. There is a clear link between the two and later classes followed the same path. "
    czech = "Zkus to ještě jednou a podívej se na úlohu. Dnes jsi vyřešil celkem několik úloh. Přečti si otázku pomalu a začni od kroku pět. "
    russian = "Попробуй ещё раз и посмотри внимательно на задание. Прочитай вопрос медленно и начни с первого шага. Потом выбери правильную картинку. "
    hindi = "यह तरीका सरल और भरोसेमंद है। शिक्षकों ने हर सप्ताह नए संकेत लिखे। आगे और कक्षाओं को जोड़ा जाएगा। "
    japanese = "この方法は簡単で安定している。先生は毎日この道具を使うべきだろうか？今後はほかの学年も調べる予定である。"
    wrapped = "\n".join(english[i : i + 52] for i in range(0, len(english), 52))
    plain = re.sub(r"[^\w ]", "", english)
    out = [("prose", "prose", english * 2), ("prose lines", "prose", english.replace(". ", ".\n") * 2), ("prose wrapped", "prose", wrapped), ("prose upper", "prose", plain.upper() * 2), ("prose foreign", "prose", czech * 3), ("prose foreign", "prose", russian * 3), ("prose hindi", "prose", hindi * 2), ("prose dense", "prose", japanese * 2), ("prose with list", "prose", english * 2 + "\n- lamp\n- river\n" + english)]
    for mark in ("- ", "• ", "[x] ", "{}. ", "{}) ", "({}) "):
        out.append(("list marked", "list", "\n".join(mark.format(i + 1) + " ".join(pick(i * 3 + j) for j in range(1 + i % 3)) for i in range(14))))
    out.append(("list contents", "list", "\n".join(f"{i // 4 + 1}.{i % 4 + 1} {pick(i).title()} {pick(i + 2)} {'.' * (9 + i % 9)} {4 * i + 3}" for i in range(14))))
    out.append(("list contents", "list", "\n".join(f"{i // 4 + 1}.{i % 4 + 1} {pick(i + 5).title()} {'.' * (19 + i % 9)} {5 * i + 1}" for i in range(9))))
    out.append(("list bare", "list", "\n".join(" ".join(pick(i * 2 + j) for j in range(1 + i % 4)) for i in range(16))))
    out.append(("list bare", "list", "\n".join(f"{pick(i)}: {pick(i + 3)} {pick(i + 7)}" for i in range(14))))
    out.append(("list headed", "list", english.split(". ")[0] + ".\n\n" + "\n".join(f"- {pick(i)} {pick(i + 4)}" for i in range(16))))
    more = nouns + "garden wheel pepper blanket tunnel mirror copper spade willow hammer cushion lantern parcel feather barrel curtain pigeon marble trumpet needle cherry pillow bucket compass saucer paddle velvet acorn magnet ribbon turnip gravel puppet sponge thicket bonnet walnut cellar mitten pebble".split()
    for k, sign in enumerate((" · ", "; ", ", ", " • ", "; ", ", ")):
        inline = sign.join(" ".join(more[(i * 17 + j * 23 + k * 5) % len(more)] for j in range(1 + (i * 7 + k) % 3)) for i in range(30 + 15 * k))
        out.append(("list inline", "list", inline if k < 4 else english.split(". ")[0] + ".\n\n" + inline))
    for s, n in ((",", 4), (";", 5), ("\t", 3), (" | ", 5)):
        out.append(("table cells", "table", "\n".join(row(i, s, n) for i in range(12))))
    out.append(("table cells", "table", "\n".join("| " + row(i, " | ", 3) + " |" for i in range(12))))
    out.append(("table spaced", "table", "\n".join("".join(c.ljust(16) for c in row(i, ",", 4).split(",")).rstrip() for i in range(12))))
    out.append(("table headed", "table", "Table 3. " + english.split(". ")[0] + ".\n\n" + "\n".join(row(i, "\t", 4) for i in range(12))))
    out.append(("table numbers", "table", "\n".join("  ".join(f"{(i * 2.713 + j * 1.618) % 10:.3f}" for j in range(5)) for i in range(12))))
    noise = "$![~]@-?&|#<.//}>*_+{^%=;:\\"
    out.append(("junk signs", "junk", "\n".join("".join(noise[(i * 7 + j * j * 5 + j * 3) % len(noise)] for j in range(24)) for i in range(9))))
    code = "ABCDEFGHabcdefghijklmnop0123456789+/QRSTUVWXYZqrstuvwxyz"
    out.append(("junk encoded", "junk", "\n".join("".join(code[(i * 11 + j * j * 7 + j * 13) % len(code)] for j in range(76)) for i in range(6)) + "=="))
    out.append(("junk log", "junk", "\n".join(f"202{i % 5}-0{i % 9 + 1}-1{i % 9}T0{i % 9}:1{i % 9}:5{i % 9} {('INFO', 'WARN', 'DEBUG')[i % 3]} node-{i % 7} job={(i * 7919 + 123457) * 6271 % 16**8:08x} rc={i % 4}" for i in range(12))))
    random = "qwertyuiopasdfghjkl"
    for k in (3, 5):
        out.append(("junk letters", "junk", " ".join("".join(random[(i * i * k + i * 11 + j * j * 5 + j * (3 + i % 7)) % len(random)] for j in range(2 + (i * k) % 10)) for i in range(90))))
    spoilt = ["Ã©", "â€™", "Ä\x8d", "�", "Å“", "Â", "o", "a"]
    out.append(("junk spoilt", "junk", " ".join("".join(spoilt[(i * 5 + j * j * 3 + j) % 8] for j in range(4 + i % 4)) for i in range(60))))
    out.append(("junk repeated", "junk", "Click here now! " * 40))
    out.append(("junk repeated", "junk", " ".join("lamp" if i % 9 else "buy" for i in range(90))))
    return out


def classify(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, word_count, the statistics and the kind of every document."""
    common = common_words(documents, text_col)
    fits = pair_fits(letter_pairs(documents, text_col))
    stats = materialize(document_statistics(documents, id_col, text_col, common, fits), "p10-stats")
    sums = stats.agg(F.count("word_count").alias("n"), *[F.avg(f).alias(f"m_{f}") for f in FEATURES], *[F.stddev_pop(f).alias(f"s_{f}") for f in FEATURES]).first()
    if not sums.n:
        return stats.withColumn("kind", F.lit(None).cast("string"))
    mean = np.array([sums[f"m_{f}"] or 0.0 for f in FEATURES])
    scale = np.maximum(np.array([sums[f"s_{f}"] or 0.0 for f in FEATURES]), 0.02)
    inspected = [(a, k, v) for (a, k, _), (_, v) in zip(examples(), batch_statistics([t for _, _, t in examples()], common, fits))]
    x = np.array([[np.nan if f is None else f for f in v] for _, _, v in inspected])
    x = np.clip(np.nan_to_num((x - mean) / scale, nan=0.0), -_FAR, _FAR)
    kinds = [k for _, k, _ in inspected]
    archetypes = sorted({a for a, _, _ in inspected})
    starts = np.array([x[[i for i, e in enumerate(inspected) if e[0] == a]].mean(0) for a in archetypes])
    mixture = fit_mixture(stats, mean, scale, Mixture(starts))
    mass = mixture.posterior(x)  # examples x components
    votes = np.array([[mass[[k == kind for k in kinds], c].sum() for kind in KINDS] for c in range(len(archetypes))])
    start_kind = [next(k for a, k, _ in inspected if a == name) for name in archetypes]
    kind_of = np.array([KINDS.index(start_kind[c]) if votes[c].sum() < 0.05 else int(votes[c].argmax()) for c in range(len(archetypes))])
    names = ["doc_id", "word_count", *FEATURES, "kind"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            usable = np.flatnonzero(np.asarray(batch.column(1).is_valid()))
            kind = np.full(batch.num_rows, None, object)
            for i in range(0, len(usable), 4096):
                at = usable[i : i + 4096]
                p = mixture.posterior(_matrix(batch.take(pa.array(at)), mean, scale, 2))
                per_kind = np.stack([p[:, kind_of == k].sum(1) for k in range(len(KINDS))], axis=1)
                kind[at] = np.array(KINDS, object)[per_kind.argmax(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kind, pa.string())], names=names)

    out = stats.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in stats.dtypes) + ", kind string")
    out._mixture = (archetypes, kind_of, mixture, votes)
    return out


def p10_found(spark, sf_dir: str) -> DataFrame:
    """Non-blank documents that are not mainly prose, with their kind."""
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet")).filter("kind <> 'prose'").select("doc_id", "kind")


def p10_statistics(spark, sf_dir: str) -> DataFrame:
    """The statistics and the kind of every document."""
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"p10_found": p10_found, "p10_statistics": p10_statistics}
SQL: dict[str, str] = {}
