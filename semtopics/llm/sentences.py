"""Problem 6: sentence boundaries across languages and scripts.

Method: the standard character-property sentence-break rules (the properties ATerm and STerm for
the terminators of all scripts, closing marks, spaces, no break before a lower-case letter after
a full stop, none inside numbers), with quotation handling (a mark inside a quotation never ends
a sentence) and abbreviation suppression by language: a text's languages are told by their function
words, and only their abbreviations count; a text without any is held against all languages.
Additions: a boundary may lack its space ("done.Now"); scripts without terminators (Thai, Lao,
Khmer) break at the spaces between their letters; an empty line or paragraph separator, or a line
break before a list item, heading or label, ends a sentence, while other line breaks are spaces.

Plan: one Arrow pass per table, no shuffle but the join with the records asked for.
Edge cases: null and blank texts have no sentences; a text without any terminator is one
sentence; whitespace at either end belongs to no sentence; unpaired quotation marks are
ignored; very long texts are cut whole; repeated rows give their sentences once per key.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Abbreviations that never end a sentence, by language (fixed values, without the last period).
ABBREVIATIONS = {
    "en": "mr mrs ms messrs dr prof rev gen sen rep col capt lt sgt st mt no nos fig figs sec secs eq eqs ref refs tab vol vols ch chap pp p ed eds vs viz cf approx ca al e.g i.e dept univ inc ltd co est min max resp",
    "de": "z.b d.h u.a z.t s.o s.u bzw bspw vgl nr abb abs aufl bd bes evtl ggf inkl insb kap sog tab str hr fr",
    "cs": "např napr tj tzv č čís str obr kap sv doc mgr ing mudr judr p",
    "sk": "napr tj t.j tzv č str obr kap sv doc mgr ing",
    "pl": "np tj tzw nr rys rozdz str prof dr im ul ok ks św",
    "hu": "pl kb ún ill dr ifj id vö stb old",
    "ro": "ex nr dl dna d.ex pag fig art lit str cca",
    "ru": "напр т.е т.к т.н рис табл стр гл им ул г д см ср",
    "uk": "напр т.зв рис табл стор гл ім вул див пор",
    "vi": "tp ths ts gs pgs",
    "mn": "жнь ж.нь",
}
#: Abbreviations that may end one: they do before a capital letter (fixed values).
FINAL = {"etc", "a.m", "p.m", "am", "pm", "usw", "atd", "apod", "itd", "itp", "stb", "jr", "sr"}
#: Abbreviations only before a number (fixed values).
NUMBERED = {"no", "nos", "p", "pp", "nr", "č", "ch", "min", "max", "co", "id", "fr", "g", "pl", "ed", "est", "al", "ok", "art", "lit", "ill", "mt", "ex", "im", "ul", "str", "tab", "bd", "abs", "rep", "col", "old", "d", "г", "д", "им", "ts", "kb"}
#: Month names written with a capital after an ordinal day ("Am 3. Mai"; fixed values).
MONTHS = ("Januar", "Jänner", "Februar", "Feber", "März", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November", "Dezember")
#: Function words that tell a language (fixed values).
FUNCTION_WORDS = {
    "en": "the and of was were is are that this with for from they he she you not have has by we but which more than him his her i it",
    "de": "der die das und ist nicht mit ein eine auf für sich den dem von zu wird wurden auch wir haben",
    "cs": "je že jsou nebo jako pro byl byla při také který která jsem ještě úlohu když není máš jsi ho za než už po od",
    "sk": "je že sú alebo ako pre bol bola pri tiež ktorý ktorá som ešte keď úlohu nie máš si ho za než už po od",
    "pl": "jest że są albo jak dla był była przy także który która jeszcze się nie czy masz już za ją pod niż ile jego jej tylko teraz",
    "hu": "az egy és hogy nem van volt meg még mint ez csak vagy lehet",
    "ro": "și este nu cu pentru care din sunt mai pe că să un ești",
    "ru": "и не что это как был была для из он она ты на с по",
    "uk": "і не що це як був була для із він вона ти або є на з",
    "vi": "và của là có cho không được một những này trong với bạn",
    "mn": "ба нь юм байна байсан энэ чи вэ уу болон",
}
#: Letters that tell a language (fixed values); any of them counts as two words.
LETTERS = {"de": "ß", "cs": "řůě", "sk": "ľĺŕ", "pl": "łąęż", "hu": "őű", "ro": "șță", "uk": "іїєґ", "ru": "ыэъ", "mn": "өү", "vi": "ơưđ"}


def _stripped(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c)).replace("ł", "l")


_FUNCTION = {k: frozenset([*v.split(), *map(_stripped, v.split())]) for k, v in FUNCTION_WORDS.items()}
_LISTED = {k: frozenset([*v.split(), *map(_stripped, v.split())]) for k, v in ABBREVIATIONS.items()}
_NEVER = frozenset().union(*_LISTED.values())

_PLANE = "".join(map(chr, (*range(0x20, 0xD800), *range(0xE000, 0x20000))))
_STOP = "".join(regex.findall(r"\p{Sentence_Break=ATerm}", _PLANE))
#: The ellipsis ends a sentence here as a question mark does, though it has no such property.
_TERM = "".join(regex.findall(r"\p{Sentence_Break=STerm}", _PLANE)) + "…"
_CANDIDATE = re.compile(f"[{re.escape(_STOP + _TERM)}]+")
_CLOSERS = "\"'”’»)]}›」』】）〉》＂"
_PAIRS = {"“": "”", "«": "»", "„": "“”", "「": "」", "『": "』", "‹": "›", "《": "》", '"': '"'}
_OPENER = re.compile("[" + "".join(_PAIRS) + "]")
_NL = "(?:\r\n|[\n\r\x85 ])"
_PARAGRAPH = re.compile(rf"{_NL}[ \t]*{_NL}| ")
_LINE = re.compile(rf"{_NL}[ \t]*{_NL}\s*| \s*|{_NL}(?=[ \t]*(?:[-*+•–·]\s|#{{1,6}}\s|\d{{1,3}}[.)]\s|={{2,}}|\||[^\W\d_]+ ?: ))")
_SPACELESS = "฀-๿຀-໿ក-៿"
_SPACELESS_BREAK = re.compile(rf"(?<=[{_SPACELESS}])[  \t\n]+(?=[{_SPACELESS}])")
_DAY = re.compile(r"(?:^|\D)(?:[1-9]|[12]\d|3[01])$")
_TOKEN = re.compile(r"[^\s(\[{\"“«„「『]+$")


def quoted_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of outermost quotations whose marks pair up within a paragraph."""
    spans, n, limit = [], len(text), -1
    m = _OPENER.search(text)
    while m:
        i = m.start()
        close = _PAIRS[text[i]]
        if limit < i:  # the end of the paragraph
            end_of = _PARAGRAPH.search(text, i)
            limit = end_of.start() if end_of else n
        depth_open, ends = text[i], [text.find(c, i + 1, limit) for c in close]
        ends = [e for e in ends if e >= 0]
        if ends:
            end = min(ends)
            if depth_open in "“«「" and depth_open in text[i + 1 : end]:  # nested quotation of the same kind
                depth, j = 1, i + 1
                while j < limit and depth:
                    depth += (text[j] == depth_open) - (text[j] in close)
                    j += 1
                end = j - 1 if not depth else end
            spans.append((i, end))
            i = end
        m = _OPENER.search(text, i + 1)
    return spans


def languages_of(text: str) -> tuple[str, ...]:
    """The languages whose function words a text holds: that of most, and others with half as many."""
    low = text.lower()
    words = {w.strip(".,;:!?") for w in low.split()}
    hits = {k: len(words & v) + 2 * any(c in low for c in LETTERS.get(k, "")) for k, v in _FUNCTION.items()}
    most = max(hits.values())
    return tuple(k for k, n in hits.items() if 2 * n >= most) if most else tuple(hits)


#: Characters looked back for an abbreviation; the listed ones have ten at most.
_LOOK_BACK = 24


def _suppressed(text: str, at: int, after: str, languages) -> bool:
    """Whether the full stop at ``at`` belongs to an abbreviation or an initial; ``after`` is
    the next visible character, ``languages`` gives the text's languages."""
    m = _TOKEN.search(text, max(0, at - _LOOK_BACK), at)
    if not m:
        return False
    token = m.group().lower().lstrip("'’-–—/,;:")
    if not token:
        return False
    if token in FINAL:
        return not after.isupper() and after not in "\"“«„「¿"
    if token in _NEVER and any(token in _LISTED[k] for k in languages()):
        if token in NUMBERED:
            return after.isdigit() or (token in ("co", "est", "al", "ex", "st") and not after.isupper())
        return True
    if len(token) == 1 and token.isalpha():
        return True  # an initial, or half of a spaced abbreviation such as "z. B."
    return "." in token and all(len(p) <= 2 and p.isalpha() for p in token.split("."))  # U.S., Ph.D


def sentence_starts(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences of a text, as half-open character ranges from 0."""
    breaks = []
    spans = None
    n = len(text)
    found: list[tuple[str, ...]] = []

    def languages() -> tuple[str, ...]:
        if not found:
            found.append(languages_of(text))
        return found[0]

    for m in _CANDIDATE.finditer(text):
        at, end = m.start(), m.end()
        if spans is None:
            spans = quoted_spans(text)
        if any(s < at < e for s, e in spans):
            continue
        while end < n and text[end] in _CLOSERS and not (text[end] == '"' and any(s == end for s, _ in spans)):
            end += 1
        run = m.group()
        spaced = end
        while spaced < n and text[spaced].isspace():
            spaced += 1
        after = text[spaced] if spaced < n else ""
        if not after:
            continue
        stop_only = run.strip(_STOP) == ""
        if run[-1] in ".!?…":
            if spaced == end:  # no space: a boundary only between a word and a capital or an opening quotation
                before = text[at - 1] if at else " "
                if not (after.isupper() or after in "“«„" or after == '"') or not (before.islower() or before.isdigit() or before in "”»)\"" or (not before.isupper() and before.isalpha())):
                    continue
            shown = spaced
            while shown < n and not text[shown].isalnum() and not text[shown].isspace():
                shown += 1
            visible = text[shown] if after in "\"“«„'(¿¡[" and shown < n and text[shown].isalnum() else after
            if (stop_only or run.endswith("…")) and (visible.islower() or after in ",;:-–—"):
                continue
            if stop_only and len(run) == 1 and (_suppressed(text, at, after, languages) or (text.startswith(MONTHS, spaced) and _DAY.search(text, max(0, at - 3), at))):
                continue
            if not stop_only and after in ",;:":
                continue
            if len(run) >= 2 and stop_only and visible.islower():
                continue
        breaks.append((end, spaced))
    for m in _LINE.finditer(text):
        breaks.append((m.start(), m.end()))
    for m in _SPACELESS_BREAK.finditer(text):
        breaks.append((m.start(), m.end()))
    out, start = [], 0
    for end, following in sorted(set(breaks)):
        if end <= start:
            continue
        _add(out, text, start, end)
        start = following
    _add(out, text, start, n)
    return out


def _add(out: list, text: str, start: int, end: int) -> None:
    while start < end and (text[start].isspace() or text[start] in "​﻿"):
        start += 1
    while end > start and text[end - 1].isspace():
        end -= 1
    if any(c.isalnum() for c in text[start:end]):
        out.append((start, end))
    elif start < end and out:
        out[-1] = (out[-1][0], end)


def split_sentences(rows: DataFrame, key_col: str, text_col: str) -> DataFrame:
    """(key, sentence, start_char, text): one row per sentence; ``start_char`` counts
    Unicode characters of the raw text from 1."""
    key_type = rows.schema[key_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, number, start, parts = [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for k, (a, b) in enumerate(sentence_starts(text)):
                    at.append(i), number.append(k + 1), start.append(a + 1), parts.append(text[a:b])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int32()), pa.array(parts, pa.string())], names=[key_col, "sentence", "start_char", "text"])

    return rows.select(key_col, F.col(text_col).alias("text")).filter(F.col(key_col).isNotNull() & F.col("text").isNotNull()).mapInArrow(run, f"`{key_col}` {key_type}, sentence int, start_char int, text string")


def p6_found(spark, sf_dir: str) -> DataFrame:
    """The sentences of the records in sentence_sample."""
    sample = spark.read.parquet(f"{sf_dir}/sentence_sample.parquet").select("field_name", "record_key")
    messages = spark.read.parquet(f"{sf_dir}/feedback_translations.parquet").select("row_id", "translation")
    abstracts = spark.read.parquet(f"{sf_dir}/mcse_data.parquet").select("ut", "ab")
    ids = sample.filter("field_name = 'translation'").select(F.expr("try_cast(record_key as bigint)").alias("row_id")).distinct()
    uts = sample.filter("field_name = 'ab'").select(F.col("record_key").alias("ut")).distinct()
    once = messages.join(ids, "row_id", "left_semi").dropDuplicates(["row_id"])
    a = split_sentences(once, "row_id", "translation").select(F.lit("translation").alias("field_name"), F.col("row_id").cast("string").alias("record_key"), "start_char")
    b = split_sentences(abstracts.join(uts, "ut", "left_semi"), "ut", "ab").select(F.lit("ab").alias("field_name"), F.col("ut").alias("record_key"), "start_char")
    return a.unionByName(b)


def p6_sentences(spark, sf_dir: str) -> DataFrame:
    """Every sentence of every message and abstract."""
    messages = spark.read.parquet(f"{sf_dir}/feedback_translations.parquet").select("row_id", "translation")
    abstracts = spark.read.parquet(f"{sf_dir}/mcse_data.parquet").select("ut", "ab")
    a = split_sentences(messages, "row_id", "translation").dropDuplicates(["row_id", "sentence"])
    a = a.select(F.lit("translation").alias("field_name"), F.col("row_id").cast("string").alias("record_key"), "sentence", "start_char", "text")
    b = split_sentences(abstracts, "ut", "ab").select(F.lit("ab").alias("field_name"), F.col("ut").alias("record_key"), "sentence", "start_char", "text")
    return a.unionByName(b)


QUERIES = {"p6_found": p6_found, "p6_sentences": p6_sentences}
SQL: dict[str, str] = {}
