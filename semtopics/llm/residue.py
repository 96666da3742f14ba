"""Problem 3: template residue, filler and error pages in place of text.

Method: records are cut into units (sentences); a unit's *frame* is its constant words, with
fillings, numbers and codes masked, case and spacing folded. Units of one frame are aligned
filling by filling over the whole collection, which induces the template's slots: for every
slot the number of records and of distinct fillings is known. What stands in a slot is only
classified by its shape (``NOTATED``: a notation of a template language, a blank or an open
mark; ``BRACKETED``: ordinary words in brackets; ``BARE``: a variable name in running text):

* a notated filling is a variable name, a default or a blank by itself, so its slot is
  residue wherever it stands, even in a template met once;
* a bracketed or bare filling is residue if the alignment says so: the frame is shared by
  ``min_records`` records and one filling owns at least ``constant`` of the slot (a slot that
  was filled varies, one that was not retains its template's own name). A name introduced by a
  noun for names ("the column user_id") is mentioned, not left over;
* units that are notices or error pages (they open with one or turn to their reader, and do
  not report on one in running prose, ``_REPORT``) are residue; ones with weaker signs are only
  if the same page stands in ``min_records`` records.

A record of nothing but such units counts by its id, a unit inside a longer record by that
record's text, so an abstract delivered under several ids is no alignment by itself. Every unit of every
record is tested, whatever the record's length. Quotations, code and formulas are masked first.

Plan: one Arrow pass keeps only units with a sign (few); group-bys on their frames and slots
count records and fillings, and the counts join back by frame; hot ones by broadcast (fewer
than 1000 by their share). Edge cases: null and blank texts are no cases; an empty table
gives an empty result; repeated rows count once per id; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.skew import join_unique
from ..plans.store import materialize
from .sentences import quoted_spans, sentence_starts

#: Shapes of fillings that are a variable name, a default or a blank in any template.
NOTATED = re.compile(
    r"\{\{\s*[\w.]+(?:\s*\|\s*[\w.]+)*\s*\}\}"  # {{ name | default }}
    r"|\$\{[^{}\n]+\}|<%[^%]+%>|\#\{[\w.]+\}"
    r"|%[A-Za-z][A-Za-z]*(?:_[A-Za-z0-9]+)+%|%[A-Z]{3,}%|%\([A-Za-z_]\w*\)s"
    r"|\$[A-Za-z]{3,}(?:_[A-Za-z0-9]+)*\$"
    r"|\[\[[A-Za-z]+(?:_[A-Za-z0-9]+)+\]\]|\[\[[A-Z]{4,}\]\]"
    r"|(?<![\w\\}^_$])\{[A-Za-z]\w*(?:[._]\w+)*\}"
    r"|(?<![\w_])_{3,}(?![\w_])|\bX{2,}[.,]X{1,}\b|\bTODO\b|\bFIXME\b|\bTBD\b|\bTBA\b"
)
#: Ordinary words in brackets, and names in capitals in angle brackets.
BRACKETED = re.compile(r"(?<![\w\[\]\\])\[(?![xX ]\])[A-Za-z][A-Za-z _-]+\](?![\[(\w])|(?<![\w</])<(?:[A-Za-z]+(?: [A-Za-z]+)+|[A-Z]{3,}(?:_[A-Z]+)*)>")
#: Variable names in running text, unless they belong to a path, an address or a file name.
BARE = re.compile(r"(?<![\w/.@#:\\-])[A-Za-z]{2,}(?:_[A-Za-z0-9]{2,})+(?![\w/@(\[]|[.:]\w)")
#: Nouns that introduce a name, which is then mentioned and not left over.
_NAMING = re.compile(r"\b(?:columns?|flags?|variables?|fields?|functions?|packages?|parameters?|methods?|tables?|files?|class(?:es)?|options?|keys?|commands?|tags?|modules?|names?|identifiers?|attributes?|arguments?|spalten?|felde?r?)[ \t]+$", re.I)
#: The usual vocabulary of pseudo-Latin filler.
LOREM = frozenset(
    "lorem ipsum dolor sit amet consectetur consec tetur adipiscing adipisicing elit sed eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam quis nostrud exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat proident culpa officia deserunt mollit anim laborum vitae mauris fusce donec lectus felis orci augue porta rutrum sapien vestibulum curabitur pellentesque praesent phasellus maecenas aenean nunc nullam integer cras morbi quisque suspendisse tincidunt ornare pulvinar turpis ultrices vehicula vivamus".split()
)
_SUBJECT = r"(?:page|record|article|abstract|document|file|site|url|resource|seite|datei)"
#: Signs of a notice, an error page or filler, for a whole page or a unit of one.
STRONG_PAGE = re.compile(
    r"^\W*(?:abstract\W+)?(?:n/?a|nan|null|none|nil|undefined|unknown|tbd|tba|tbc|todo|to be (?:added|announced|completed|done|supplied)|not available|missing|empty|abstract)\W*$"
    r"|^\W*no (?:abstract|summary|description)\b.*$|\babstract (?:is )?(?:not|un)[ -]?(?:available|provided|found)|\babstract (?:is )?missing|^\W*abstract:? (?:none|n/?a|null)\W*$|\bkein(?:e)? (?:abstract|zusammenfassung)\b"
    r"|\b(?:enable|allow|activate|turn on|switch on|permit)\b[^.!?]*\b(?:javascript|java script|scripts?|cookies)\b|\bjavascript\b[^.!?]*\b(?:disabled|required|aktivieren|turned off)\b|\b(?:this|the) (?:site|page|website) (?:uses|requires|needs) (?:javascript|cookies)\b|\baktivieren sie\b"
    r"|\bwe use cookies\b|\baccept all\b[^.!?]*\breject all\b|\b(?:checking|update) your browser\b|\bbrowser is (?:not|no longer) supported\b|\byour browser does not\b"
    rf"|\b(?:4\d\d|5\d\d)\W*(?:the |page |http )?(?:not found|bad gateway|forbidden|unavailable|server error|error)\b|\berror \d{{3}}\b|\bfehler \d{{3}}\b|\b{_SUBJECT}\b[^.!?]*\b(?:could not be found|cannot be found|was not found|no longer exists?|has been moved|nicht gefunden)"
    r"|\binternal server error\b|\bbad gateway\b|\bservice (?:is )?(?:temporarily )?unavailable\b|\bgateway time-?out\b|\baccess denied\b|\byou do not have permission\b|\btoo many requests\b|\bhas been blocked\b|\bsession has (?:expired|timed out)\b|\bsomething went wrong\b|\bplease (?:try again later|sign in again|log in again)\b|\bcontact the administrator\b"
    r"|\btraceback \(most recent call last\)|\b[\w.]*(?:exception|error): |^\s*[\w]+(?:\.[\w]+)+(?:exception|error)\b|\bnull ?pointer|^\s*loading\W*(?:\.{2,}|…)|\bplease wait while\b"
    r"|\b(?:insert|type|enter|paste|write|put) (?:your|the|an) (?:abstract|text|summary|title)\b|\b(?:sample|dummy|placeholder|example) (?:abstract )?text\b\W*(?:here|\.)|\bgoes here\b",
    re.I | re.S,
)
WEAK_PAGE = re.compile(r"\b(?:error|fehler|browser|server|request|cookies?|javascript|scripts?|reload|redirect|captcha|permission|abstract|record|loading|expired|unavailable|blocked|forbidden|denied|administrator)\b", re.I)
_FILLER = re.compile(r"^(?:x{2,}|test|asdf\w*|qwerty|bla|blah|foo|bar|text)$", re.I)
_MASK = re.compile(r"\b[0-9a-f]*\d[0-9a-f]*\b", re.I)
_SPACE = re.compile(r"\s+")
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_CODE = re.compile(r"```.*?```|<(pre|code)\b.*?</\1>|\$\$.*?\$\$|\\\(.*?\\\)|\\begin\{(?:equation|align|verbatim)\*?\}.*?\\end\{\w+\*?\}|(?<![`\w])`[^`\n]+`(?![`\w])", re.S | re.I)
_STOPPED = re.compile(r"(?<=[.!?])\s+")
#: A unit that is nothing but a word for a missing text, anywhere in a text.
_EMPTY_UNIT = re.compile(r"(?:^|[.!?\n])[^\w.!?\n]*(?:abstract\W+)?(?:n/?a|nan|null|none|nil|undefined|unknown|tbd|tba|tbc|todo|to be (?:added|announced|completed|done|supplied)|not available|missing|empty|abstract)[^\w.!?\n]*(?:$|[.!?\n])")
#: Strings of which STRONG_PAGE needs one (or ``_ERROR``), and filler besides pseudo-Latin.
_ANCHORS = (
    "no abstract", "no description", "abstract not", "abstract is not", "abstract un", "abstract is un", "abstract missing", "abstract is missing", "abstract:", "abstract none",
    "abstract text", "abstract n", "the abstract", "your abstract", "an abstract", "kein", "script", "cookie", "aktivieren sie", "accept all", "your browser", "browser is", "not found", "gateway",
    "forbidden", "unavailable", "be found", "no longer exist", "been moved", "nicht gefunden", "access denied", "do not have permission", "too many requests", "been blocked", "session has",
    "something went wrong", "try again later", "sign in again", "log in again", "administrator", "traceback", "nullpointer", "null pointer", "loading", "please wait while", "your text", "the text", "an text",
    "your title", "the title", "an title", "summary", "sample text", "placeholder text", "example text", "dummy text", "goes here", "xx", "test test", "asdf", "qwerty", "bla", "foo", "text text",
)
_WEAK = ("error", "server", "request", "reload", "redirect", "captcha", "permission", "abstract", "record", "expired", "blocked", "denied", "browser", "fehler")
_ERROR = re.compile(r"error \d|(?:error|exception): |\d\W*(?:\w+ )?error|server error|fehler \d|\.\w*(?:exception|error)\b")
#: Words of one who reports on a notice, and of a notice that turns to its reader.
_REPORT = re.compile(r"\b(?:was|were|had|we|our(?! (?:servers?|sites?|website|pages?|services?|systems?)\b)|they|their|pupils?|students?|learners?|participants|teachers?|users|respondents|child(?:ren)?|class(?:es)?|classrooms?|schools?|study|studies|authors?|showed|reported|found that|confused|typed|among|messages?|wurden?|hatten?|wir|schüler\w*)\b", re.I)
_ADDRESS = re.compile(r"\b(?:please|you|your|sorry|(?:this|the) (?:page|site|website|record|article|server|request|url|browser)|bitte|sie|diese seite)\b", re.I)
#: A page with fewer weak signs than one in so many words has to address its reader.
WEAK_SHARE = 6


def mask_quotations(text: str) -> str:
    """Quotations, code and formulas blanked out; one that is most of the text stays."""
    spans = [s for s in quoted_spans(text) if s[1] - s[0] <= 0.6 * len(text.strip())]
    spans += [m.span() for m in _CODE.finditer(text)]
    if not spans:
        return text
    chars = list(text)
    for a, b in spans:
        for i in range(a + 1, min(b, len(chars))):
            if chars[i] != "\n":
                chars[i] = " "
    return "".join(chars)


def folded(unit: str) -> str:
    """Numbers and codes masked, case and spacing folded."""
    return _SPACE.sub(" ", _MASK.sub("0", unit.lower())).strip(" \t\n.,;:!?")


def fillings(unit: str) -> list[tuple[int, int, str]]:
    """(start, end, shape) of what looks like an unfilled slot, in order."""
    found = [(*m.span(), "notated") for m in NOTATED.finditer(unit)]
    for pattern, shape in ((BRACKETED, "bracketed"), (BARE, "bare")):
        if shape == "bare" and "_" not in unit:
            break
        for m in pattern.finditer(unit):
            a, b = m.span()
            if not any(x < b and a < y for x, y, _ in found) and not (shape == "bare" and _NAMING.search(unit, 0, a)):
                found.append((a, b, shape))
    return sorted(found)


def framed(unit: str, spans: list[tuple[int, int, str]]) -> tuple[str, list[str]]:
    """The frame of a unit and its fillings in order. A unit of fillings alone is its own frame."""
    parts, at = [], 0
    for a, b, _ in spans:
        parts.append(unit[at:a])
        at = b
    parts.append(unit[at:])
    frame = folded("\x00".join(parts))
    values = [folded(unit[a:b]) for a, b, _ in spans]
    return (frame if re.search(r"[^\W\d_]", frame) else folded(unit)), values


def filler_share(text: str) -> float:
    words = re.findall(r"[^\W\d_]+", text.lower())
    if not words:
        return 0.0
    latin = sum(1 for w in words if w in LOREM) / len(words)
    dull = sum(1 for w in words if _FILLER.match(w)) / len(words)
    return max(latin if len(words) >= 3 else 0.0, dull if len(words) >= 3 else 0.0)


def reports(unit: str) -> bool:
    """Whether a unit speaks of things in running prose; the words of the notice itself don't count."""
    return bool(_REPORT.search(STRONG_PAGE.sub(" ", unit)))


def notice(unit: str) -> bool:
    """Whether a unit is a notice: it opens with one or addresses its reader, and doesn't report."""
    m = STRONG_PAGE.search(unit)
    return bool(m) and (len(unit[: m.start()].split()) <= 3 or bool(_ADDRESS.search(unit))) and not reports(unit)


def anchored(low: str) -> bool:
    """Whether a text in lower case holds anything without which no page sign or filler can match."""
    if any(a in low for a in _ANCHORS) or _EMPTY_UNIT.search(low):
        return True
    if ("error" in low or "exception" in low or "fehler" in low) and _ERROR.search(low):
        return True
    words = low.split()
    if not LOREM.isdisjoint(words):
        return True
    weak = len(WEAK_PAGE.findall(low)) if any(a in low for a in _WEAK) else 0
    return weak > 0 and (weak * WEAK_SHARE >= len(words) or _ADDRESS.search(low) is not None)


def slotted(text: str) -> bool:
    """Whether a text holds anything that looks like an unfilled slot."""
    opened = any(x in text for x in ("{", "[[", "<%", "%(", "___", "X.", "X,", "TODO", "FIXME", "TBD", "TBA")) or text.count("%") > 1 or text.count("$") > 1
    if opened and NOTATED.search(text):
        return True
    return ("[" in text or "<" in text) and BRACKETED.search(text) is not None or "_" in text and BARE.search(text) is not None


def pages(plain: str, masked: str, units: list[str]) -> list[tuple[str, str, list[str], str]]:
    """Page signs of a record: every unit that is a notice, at any length of the record; where
    none is, pages left to the alignment: signs on most units, or weak signs."""
    strong = [u for u in units if STRONG_PAGE.search(u)]
    found = [("page", folded(u), [], "notice") for u in strong if notice(u)]
    if found:
        return found
    telling = any(reports(u) for u in units)
    if not telling and len(strong) * 2 >= len(units) and (STRONG_PAGE.search(plain) or STRONG_PAGE.search(masked)):
        return [("page", folded(plain), [], "alignment")]
    weak = [(u, len(WEAK_PAGE.findall(u))) for u in units]
    if not telling and sum(n for _, n in weak) * WEAK_SHARE >= len(plain.split()):
        return [("page", folded(plain), [], "alignment")]
    return [("page", folded(u), [], "alignment") for u, n in weak if n and _ADDRESS.search(u) and not reports(u)]


def signs(text: str) -> list[tuple[str, str, list[str], str]]:
    """(kind, frame, fillings, what decides) of the units of a record that look like residue; what
    decides is the shape of a filling (``notation``), a ``notice``, a ``filler`` or the ``alignment``."""
    if not text or not text.strip():
        return []
    slots = slotted(text)
    hinted = anchored(text.lower())
    if not slots and not hinted:
        return []
    out: list[tuple[str, str, list[str], str]] = []
    masked = mask_quotations(text)
    units = [masked[a:b] for a, b in sentence_starts(masked)]
    if hinted:
        plain = _SPACE.sub(" ", _TAG.sub(" ", masked)).strip()
        out += pages(plain, masked, [x for x in (_SPACE.sub(" ", _TAG.sub(" ", u)).strip() for u in units) if x])
        shares = [filler_share(u) for u in units]
        filler = sum(len(u) for u, x in zip(units, shares) if x >= 0.6)
        if filler >= 0.3 * len(plain) or any(x >= 0.8 and len(u.split()) >= 6 for u, x in zip(units, shares)):
            out.append(("filler", "", [], "filler"))
    if slots:
        for unit in (x for u in units for x in _STOPPED.split(u)):
            spans = fillings(unit)
            if spans:
                out.append(("slot", *framed(unit, spans), "notation" if any(x[2] == "notated" for x in spans) else "alignment"))
    return out


def covered(found: list[tuple[str, str, list[str], str]]) -> int:
    """Characters of a record that its signs make up, by the kind of sign that covers most."""
    size = {"page": 0, "slot": 0, "filler": 0}
    for kind, frame, values, _ in found:
        size[kind] += len(frame) + sum(map(len, values))
    return max(size.values())


def aligned_slots(units: DataFrame, min_records: int, constant: float) -> DataFrame:
    """(kind, frame) whose alignment has a slot of which one filling owns at least ``constant``
    (with one record counted against it) over at least ``min_records`` records; a page is an
    alignment without slots."""
    slots = units.select("kind", "frame", "source", F.posexplode(F.when(F.size("fillings") == 0, F.array(F.lit(""))).otherwise(F.col("fillings"))).alias("slot", "filling"))
    per = slots.distinct().groupBy("kind", "frame", "slot", "filling").agg(F.count("*").alias("n"))
    shares = per.groupBy("kind", "frame", "slot").agg(F.sum("n").alias("n"), F.max("n").alias("top"))
    agreed = shares.filter((F.col("n") >= min_records) & (F.col("top") >= constant * (F.col("n") + 1)))
    return agreed.select("kind", "frame").distinct()


def residue(records: DataFrame, id_col: str, text_col: str, min_records: int = 2, constant: float = 0.6) -> DataFrame:
    """(id, kind, template, n_records, n_fillings, decided_by): the residue units of every record;
    ``template`` is the frame, ``decided_by`` what made the unit residue."""
    id_type = records.schema[id_col].dataType.simpleString()
    names = ["id", "source", "kind", "frame", "fillings", "decided_by"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                found = signs(text)
                at += [i] * len(found)
                alone = bool(found) and covered(found) >= 0.8 * len(folded(text))
                rows += [(alone, *f) for f in found]
            whole, kind, frame, values, by = zip(*rows) if rows else ((),) * 5
            take = pa.array(at, pa.int64())
            source = pa.array([None if x else h for x, h in zip(whole, batch.column(1).take(take).to_pylist())], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), source, pa.array(kind, pa.string()), pa.array(frame, pa.string()), pa.array(values, pa.list_(pa.string())), pa.array(by, pa.string())], names=names)

    rows = records.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text")).filter("id is not null and text is not null")
    found = rows.mapInArrow(run, f"id {id_type}, source long, kind string, frame string, fillings array<string>, decided_by string")
    # a record of nothing but signs counts by id, a unit inside a longer one by the text it stands in
    units = materialize(found.withColumn("source", F.coalesce("source", F.xxhash64("id"))), "residue")
    per = units.groupBy("kind", "frame", "fillings").agg(F.count_distinct("id").alias("n"))
    forms = per.groupBy("kind", "frame").agg(F.sum("n").alias("n_records"), F.count("*").alias("n_fillings"))
    agreed = aligned_slots(units.filter("decided_by = 'alignment'"), min_records, constant).withColumn("agreed", F.lit(True))
    forms = forms.join(agreed, ["kind", "frame"], "left")
    # a frame may be that of a large share of the records ("N/A"): hot ones are joined by broadcast
    key = F.struct("kind", "frame").alias("k")
    mine = units.groupBy("id", "kind", "frame").agg(F.max("decided_by").alias("decided_by"))  # "notation" and "notice" come after "alignment"
    held = join_unique(mine.select("id", key, "decided_by"), forms.select(key, "n_records", "n_fillings", "agreed"), "k", "n_records", units.count())
    held = held.filter("decided_by <> 'alignment' or agreed")
    return held.select("id", F.col("k.kind").alias("kind"), F.col("k.frame").alias("template"), "n_records", "n_fillings", "decided_by")


def p3_found(spark, sf_dir: str) -> DataFrame:
    """Records whose abstract is, or contains, residue."""
    found = residue(spark.read.parquet(f"{sf_dir}/mcse_data.parquet"), "ut", "ab")
    return found.select(F.col("id").alias("ut")).distinct()


def p3_residue(spark, sf_dir: str) -> DataFrame:
    """The residue units themselves: kind, template, how many records share it and what decided."""
    return residue(spark.read.parquet(f"{sf_dir}/mcse_data.parquet"), "ut", "ab").withColumnRenamed("id", "ut")


QUERIES = {"p3_found": p3_found, "p3_residue": p3_residue}
SQL: dict[str, str] = {}
