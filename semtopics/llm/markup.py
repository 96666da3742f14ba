"""Problem 4: markup residue in text documents.

Method: tag-path ratios. Each record is parsed into nodes; a path runs from the root over all
open nodes to the innermost (``text/html:ul/html:li/markdown:strong``) and owns the text between
their marks. Over the whole collection the text length, punctuation and markup length of every
path are added up, text and punctuation ratios are smoothed along the path (a path shares the
figures of its parent with all below it) and fused into one score, and paths above a threshold
are content; their text makes up the clean text, in which headings, lists, code, tables and
formulas are written in one plain style. The text ratio is the geometric mean of a path's and its
parent's, so that plain text elsewhere, however much, can't make up for a path of marks; names
and layout of tags and commands have no length, so that cells and headings aren't lost for them.
Scripts, comments, keys, footnotes and arguments hold no text, as attributes do not. A record's
kinds of markup are the notations that this takes away: of every piece that lost marks, or whose
path is not content.

Plan: one Arrow pass parses each record once into pieces (path, output, sums), kept as a table;
sums are added up per path in the JVM (113 paths on sf0.1; a name that comes again folds its path,
so the grammar bounds their number), and the verdicts on the paths turn the pieces into clean text
and kinds in the JVM as well. Patterns are tried only on texts that hold a sign they need.
Edge cases: null and blank texts have no markup (kinds empty, clean text null or empty);
unclosed tags end with the text; plain signs (comparisons, prices, products, identifiers) are
no markup; very long texts are parsed whole; repeated rows stay as they come.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.store import materialize
from .residue import residue

#: Element names taken as HTML or journal XML; others in angle brackets are text.
TAGS = "a abbr article b big blockquote body br caption center cite code dd del div dl dt em figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label li link main meta nav noscript ol option p pre q s script section select small span strike strong style sub sup svg table tbody td tfoot th thead title tr tt u ul var".split()
_TAG = rf"</?(?:jats:[a-z-]+|mml:[a-z]+|(?:{'|'.join(TAGS)}))(?:\s[^<>]*)?/?>"
_ENTITY = r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});"
_LATEX_WORD = r"\\(?:[A-Za-z]{2,}\*?|[%&$#_{}\\,;:!~^'\"`=.])"

#: Grammar, in order of precedence: (path, signs of which a text needs one, pattern). Group 1,
#: where there is one, is the node's text.
GRAMMAR = [
    ("markdown/code", "```", r"(?m)^[ \t]*```[\w+-]*[ \t]*\n(.*?)\n?[ \t]*```|```[\w+-]*\s(.*?)```"),
    ("html/pre", "<", r"(?i)<pre\b[^>]*>(.*?)</pre>"),
    ("html/code", "<", r"(?i)<code\b[^>]*>(.*?)</code>"),
    ("html/script", "<", r"(?i)<(?:script|style)\b[^>]*>(.*?)</(?:script|style)>|<!--(.*?)-->"),
    ("latex/math", "$$ \\[ \\( \\begin", r"\$\$(.+?)\$\$|\\\[(.+?)\\\]|\\\((.+?)\\\)|\\begin\{(?:equation|align|gather|math)\*?\}(.+?)\\end\{(?:equation|align|gather|math)\*?\}"),
    ("latex/math", "$", r"(?<![\\$\w])\$(?![\s\d])((?:[^$\n\\]|\\.)+)\$(?![\w$])"),
    ("wiki/table", "{|", r"(?m)^[ \t]*\{\|(.*?)^[ \t]*\|\}"),
    ("html/tag", "<", rf"(?i)({_TAG})"),
    ("html/entity", "&", rf"({_ENTITY})"),
    ("wiki/link", "[[", r"\[\[(?!\s)([^\[\]\n]+?)\]\]"),
    ("wiki/template", "{{", r"\{\{(?:cite|Infobox|lang|main|see also)\b([^{}]*)\}\}"),
    ("wiki/emphasis", "''", r"(?<!')'''(?!')(.+?)'''(?!')|(?<!')''(?!')([^'\n]+(?:'[^'\n]+)*)''(?!')"),
    ("wiki/heading", "==", r"(?m)^[ \t]*={2,6}[ \t]*([^=\n]+?)[ \t]*={2,6}[ \t]*$"),
    ("wiki/list", "** *# *: #* #:", r"(?m)^[ \t]*(?:\*{2,}|\*[#:]+|\#[*:]+)[ \t]+([^\n]+)$"),
    ("wiki/ref", "<", r"(?i)<ref\b[^>]*>(.*?)</ref>"),
    ("latex/heading", "\\", r"\\(?:sub)*(?:section|paragraph|chapter)\*?\{([^{}]*)\}"),
    ("latex/cite", "\\", r"~?\\(?:cite[a-z]*|ref|eqref|label|footnote)\*?(?:\[[^\]]*\])?\{([^{}]*)\}"),
    ("latex/list", "\\item", r"(?s)\\item\b\s*(.*?)(?=\\item\b|\\end\b|$)"),
    ("latex/environment", "\\", r"\\(?:begin|end)\{([A-Za-z]+\*?)\}(?:\[[^\]]*\])?"),
    ("latex/command", "\\", r"\\[A-Za-z]{2,}\*?(?:\[[^\]]*\])?\{([^{}]*)\}"),
    ("latex/symbol", "\\", rf"({_LATEX_WORD})(?![A-Za-z])"),
    ("markdown/table", "--", r"(?m)((?:^[ \t]*\|.*\|[ \t]*\n)?^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*$(?:\n[ \t]*\|.*\|[ \t]*$)*)"),
    ("markdown/heading", "#", r"(?m)^[ \t]{0,3}\#{1,6}[ \t]+(\S[^\n]*?)[ \t]*\#*$"),
    ("markdown/image", "![", r"!\[([^\]\n]*)\]\([^()\s]*\)"),
    ("markdown/link", "](", r"\[([^\[\]\n]+)\]\((?:[a-z]+:|/|\#|\.)[^()\s]*(?:\s\"[^\"]*\")?\)"),
    ("markdown/strong", "** __", r"\*\*(?=\S)([^*\n]+?)(?<=\S)\*\*|(?<!\w)__(?=[^\s_])([^_\n]+?)(?<=[^\s_])__(?!\w)"),
    ("markdown/emphasis", "* _", r"(?<![\w*\\])\*(?=[^\s*])([^*\n]+?)(?<=[^\s*])\*(?![\w*])|(?<![\w\\])_(?=[^\s_])([^_\n]+?)(?<=[^\s_])_(?!\w)"),
    ("markdown/inline", "`", r"(?<![`\w])`([^`\n]+)`(?![`\w])"),
    ("markdown/list", "- + *", r"(?m)^[ \t]{0,6}[-+*][ \t]+(?:\[[ xX]\][ \t]+)?(\S[^\n]*)$"),
    ("markdown/quote", ">", r"(?m)^[ \t]{0,3}>[ \t]+(\S[^\n]*)$"),
    ("markdown/rule", "- *", r"(?m)^[ \t]*((?:-[ \t]*){3,}|(?:\*[ \t]*){3,})$"),
]
_DOTALL = ("markdown/code", "html/pre", "html/code", "html/script", "latex/math", "wiki/table", "wiki/ref")
_COMPILED = [(path, signs.split(" "), re.compile(p, re.S if path in _DOTALL else 0)) for path, signs, p in GRAMMAR]
#: What a formula between single dollar signs holds: a command or an operator, or it is one letter.
_FORMULA = re.compile(r"\\[A-Za-z]|[_^=<>]|^[A-Za-z]$")
#: Any character a construct needs; texts without one are plain.
_HINT = re.compile(r"[<&`*_#\[\\$|=~{]|''|(?m:^[ \t]{0,6}[-+>][ \t])")
_PUNCT = re.compile(r"[.,;:!?。，、；：！？।]")
#: Nodes that hold no text by the rules of their notation, as attributes of tags hold none:
#: scripts, styles and comments, keys and labels, footnotes, arguments, names and rules.
_UNSHOWN = {"html/script", "latex/cite", "latex/environment", "wiki/template", "wiki/ref", "markdown/rule"}
_BLOCKS = {"list", "heading", "table", "rule", "quote"}
_LINES = set("br p div tr ul ol table hr section jats:p jats:sec jats:title title".split())
_VOID = set("br hr img input link meta".split())
#: Elements that end an open one: tag -> (tags it ends, tags it does not look beyond).
_CLOSES = {"li": (("li",), ("ul", "ol")), "p": (("p",), ("div", "td", "th", "li", "section", "blockquote")), "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")), "tr": (("tr",), ("table",)), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",))}
_CODE_SPAN = re.compile(r"((?:<pre\b.*?</pre>|<code\b.*?</code>|```.*?```))", re.S | re.I)
#: Addresses in tags. A tag counts as one character of markup and those of its addresses: its name and
#: layout (style, class, width) say nothing of the text it holds.
_ADDRESS = re.compile(r"(?i)\s(?:xlink:)?(?:href|src|action|cite)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)")
_ESCAPED_TAG = re.compile(_TAG.replace("<", "&lt;", 1).replace("[^<>]*", "(?:(?!&[lg]t;)[^<>])*").removesuffix(">") + "&gt;", re.I)
_TWICE = re.compile(r"&amp;(#?\w{2,31};)")


def nodes(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, path, inner text) of the markup nodes of a text; the outermost wins, and
    the texts of nodes that may nest are parsed again by ``walk``."""
    if not text or not _HINT.search(text):
        return []
    out: list[tuple[int, int, str, str]] = []
    shown = list(text)
    current = text
    for path, signs, pattern in _COMPILED:
        if not any(x in text for x in signs):
            continue
        hits = []
        for m in pattern.finditer(current):
            group = next((k for k in range(1, (m.re.groups or 0) + 1) if m.start(k) >= 0), 0)
            if signs == ["$"] and not _FORMULA.search(m.group(group)):
                continue
            hits.append((m.start(), m.end(), m.start(group), m.end(group)))
        if path == "markdown/list" and len(hits) < 2 and not (hits and wiki(out) and text[hits[0][0] : hits[0][1]].lstrip().startswith("*")):
            continue
        for start, end, a, b in hits:
            name, inner = path, text[a:b]
            if path == "html/tag":
                name = "html/" + re.match(r"</?([\w:-]+)", inner).group(1).lower()
            out.append((start, end, name, inner))
            opaque = path in ("markdown/code", "html/pre", "html/code", "html/script", "latex/math", "html/tag", "html/entity", "markdown/inline", "latex/symbol", "markdown/table")
            blank = "\uffff"  # a sign no pattern accepts as space, word or line break
            if opaque or path == "wiki/table":
                for i in range(start, end):
                    if shown[i] != "\n":
                        shown[i] = blank
            else:  # the marks go, the text may hold further nodes
                for i in range(start, end):
                    if not a <= i < b and shown[i] != "\n":
                        shown[i] = blank
        if hits:
            current = "".join(shown)
    if wiki(out) and not any(p.startswith("markdown/") and p != "markdown/list" for _, _, p, _ in out):
        # one notation a record: "* item" beside wiki marks is a wiki list
        out = [(s, e, "wiki/list" if p == "markdown/list" and text[s:e].lstrip().startswith("*") else p, i) for s, e, p, i in out]
    return sorted(out)


def wiki(found: list) -> bool:
    return any(path.startswith("wiki/") for _, _, path, _ in found)


def _unescaped(text: str) -> str:
    """Escaped tags and twice escaped entities as the markup they stand for, outside code."""
    if "&" not in text:
        return text
    parts = _CODE_SPAN.split(text)  # every second part is code
    return "".join(x if k % 2 else _ESCAPED_TAG.sub(lambda m: html.unescape(m.group()), _TWICE.sub(r"&\1", x)) for k, x in enumerate(parts))


def _below(path: str, name: str) -> str:
    """The path of a node under ``path``; a name that comes again folds the path back to it,
    so nesting of any depth gives a bounded number of paths."""
    steps = path.split("/")
    return "/".join(steps[: steps.index(name) + 1]) if name in steps else f"{path}/{name}"


def walk(text: str, path: str = "text", depth: int = 0, cell: bool = False) -> Iterator[tuple[str, str, int, int]]:
    """(path, output, characters of text, characters of markup) of a text in order. A path runs
    from the root over all open nodes (``text/html:ul/html:li/markdown:strong``) and owns
    the text between their marks. Line breaks and list signs that replace marks count as no text,
    nor do blanks between marks. A tag or a mark of LaTeX counts as one, and an address in it by length."""
    at, stack = 0, [(None, path)]
    # a construct's text can't hold the construct itself, so the grammar ends the nesting long before
    again = (lambda x, p, cell=False: walk(x, p, depth + 1, cell)) if depth < 100 else (lambda x, p, cell=False: [(p, x, len(x), 0)])

    def own(x: str, m: int = 0, p: str | None = None):
        return (p or stack[-1][1], x, len(x) if x.strip() else 0, m)

    for start, end, name, inner in nodes(text):
        if start < at or (cell and name.split("/")[1] in _BLOCKS):  # a cell holds no lists or headings
            continue
        if at < start:
            yield own(text[at:start])
        at = end
        leaf = name.split("/")[1]
        child = _below(stack[-1][1], name.replace("/", ":"))
        m = 2 if name.startswith(("html/", "latex/")) else end - start - len(inner)
        if name.startswith("html/") and name != "html/entity" and inner == text[start:end]:  # a tag
            m = 1 + sum(map(len, _ADDRESS.findall(inner)))
            line = leaf in _LINES or bool(re.fullmatch(r"h[1-6]", leaf))
            if inner.startswith("</"):
                if leaf in ("td", "th"):
                    yield (stack[-1][1], "\t", 0, 0)
                opened = max((k for k, (tag, _) in enumerate(stack) if tag == leaf), default=0)
                yield (stack[opened][1] if opened else child, "", 0, m)
                if opened:
                    del stack[opened:]
                yield (stack[-1][1], "\n" if line else "", 0, 0)
                continue
            if leaf in _CLOSES:  # an item, cell or paragraph ends the one before it in the same list, row or block
                inside = max((k for k, (tag, _) in enumerate(stack) if tag in _CLOSES[leaf][1]), default=0)
                opened = next((k for k in range(inside + 1, len(stack)) if stack[k][0] in _CLOSES[leaf][0]), 0)
                if opened:
                    del stack[opened:]
            if line:
                yield (stack[-1][1], "\n", 0, 0)
            if leaf in _VOID or inner.endswith("/>"):
                yield (_below(stack[-1][1], name.replace("/", ":")), "", 0, m)
                continue
            stack.append((leaf, _below(stack[-1][1], name.replace("/", ":"))))
            yield (stack[-1][1], "\n- " if leaf == "li" else "", 0, m)
        elif name == "html/entity":  # a character of the text around it
            yield (child, "", 0, len(inner) - 1)
            yield own(html.unescape(inner))
        elif name in _UNSHOWN and not (name == "wiki/template" and re.match(r"\{\{lang\b", text[start:end])):
            yield (child, "", 0, end - start)
        elif leaf in ("pre", "code"):
            x = html.unescape(inner) if name == "html/code" else "\n" + html.unescape(re.sub(_TAG, "", inner)) + "\n"
            yield (child, x, len(inner), m)
        elif leaf == "heading":
            yield (stack[-1][1], "\n", 0, 0)
            yield (child, "", 0, m)
            yield from again(inner.strip(), child)
            yield (stack[-1][1], "\n", 0, 0)
        elif leaf == "list":
            yield (child, "\n- ", 0, m)
            yield from again(inner.strip(), child)
            if name.startswith("latex"):
                yield (child, "\n", 0, 0)
        elif leaf == "table":
            yield (stack[-1][1], "\n", 0, 0)
            yield (child, "", 0, m)
            for row in inner.split("\n"):
                if row.strip().startswith(("class", "|-")) or not row.strip(" \t|!:-"):
                    yield (child, "", 0, len(row))
                    continue
                for p, x, t, k in again(row.strip().strip("|!").strip(), child, True):
                    if p == child and t:  # marks between cells; those of links and the like are gone
                        cells = re.sub(r"\s*\|\|\s*|\s*!!\s*|\s*\|\s*", "\t", x)
                        x, t, k = cells, len(cells), k + len(x) - len(cells)
                    yield (p, x, t, k)
                yield (child, "\n", 0, 0)
        elif name in ("wiki/link", "wiki/template"):
            shown = inner.split("|")[-1]
            yield (child, "", 0, end - start - len(shown))
            yield from again(shown, child)
        elif name == "latex/symbol":
            x = inner[1:] if len(inner) == 2 and not inner[1].isalpha() else ("" if inner == "\\\\" else inner)
            yield (child, "", 0, 1)
            yield own(x)  # a character of the text around it
        elif leaf in ("inline", "math"):
            x = inner if leaf == "inline" else inner.strip()
            yield (child, x, len(x), m)
        else:
            yield (child, "", 0, m)
            yield from again(inner, child)
    if at < len(text):
        yield own(text[at:])


def pieces_of(text: str) -> list[tuple[str, str, int, int, int]]:
    """(path, output, characters of text, punctuation marks, characters of markup) in order; empty
    for a text without markup."""
    text = _unescaped(text)
    if not nodes(text):
        return []
    return [(path, out, t, len(_PUNCT.findall(out)) if t else 0, m) for path, out, t, m in walk(text)]


def path_sums(text: str) -> dict[str, list[int]]:
    """path -> [pieces, characters of text, punctuation marks, characters of markup]."""
    sums: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0, 0])
    for path, _, t, q, m in pieces_of(text) or [("text", text, len(text), len(_PUNCT.findall(text)), 0)]:
        for k, v in enumerate((1, t, q, m)):
            sums[path][k] += v
    return sums


def content_paths(stats: list[tuple[str, int, int, int, int]], threshold: float = 0.25) -> dict[str, bool]:
    """Which paths are content: text share and punctuation density of the text a path owns,
    each smoothed with the figures of its parent (with all that is below the parent), fused by
    their geometric mean and compared with the threshold (a share of what the collection's text
    would score without markup). A path that owns no text only breaks lines or sets list signs,
    and is content if a path below it is. Nothing else decides."""
    rows = {p: (t, q, m) for p, _, t, q, m in stats}
    below: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0])
    for p, figures in rows.items():
        steps = p.split("/")
        for k in range(1, len(steps) + 1):
            for x, v in enumerate(figures):
                below["/".join(steps[:k])][x] += v

    def score(own, parent) -> float:
        (t, q, m), (pt, pq, pm) = own, parent
        # a product: in a sum the parent's share alone lifts every path of a prose collection over the threshold
        text_ratio = (t / max(1, t + m) * pt / max(1, pt + pm)) ** 0.5
        punct_ratio = 0.8 * q / max(1, t) + 0.2 * pq / max(1, pt)
        return (text_ratio * (0.02 + punct_ratio)) ** 0.5

    base = (0.02 + below["text"][1] / max(1, below["text"][0])) ** 0.5
    parent = {p: below[p.rpartition("/")[0]] if "/" in p else (*below[p][:2], 0) for p in rows}  # no marks around the root
    content = {p for p in rows if rows[p][0] and score(rows[p], parent[p]) >= threshold * base}
    holds = {p[:k] for p in content for k in range(len(p)) if p[k] == "/"}
    return {p: p in content or (not rows[p][0] and p in holds) for p in rows}


_PIECE = "struct<path:string,out:string,t:int,q:int,m:int>"


def parsed(records: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, plain, pieces) of every record: the text itself where it holds no markup, else its pieces."""
    id_type = records.schema[id_col].dataType.simpleString()
    fields = [("path", pa.string()), ("out", pa.string()), ("t", pa.int32()), ("q", pa.int32()), ("m", pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [pieces_of(t) if t else [] for t in batch.column(1).to_pylist()]
            flat = [p for f in found for p in f]
            columns = [pa.array(c, t) for c, (_, t) in zip(zip(*flat) if flat else ((),) * 5, fields)]
            ends = pa.array([0, *accumulate(map(len, found))], pa.int32())
            pieces = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(columns, names=[n for n, _ in fields]))
            plain = pc.if_else(pa.array([not f for f in found], pa.bool_()), batch.column(1), pa.scalar(None, batch.column(1).type))
            yield pa.RecordBatch.from_arrays([batch.column(0), plain, pieces], names=["id", "plain", "pieces"])

    rows = records.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id is not null")
    return rows.mapInArrow(run, f"id {id_type}, plain string, pieces array<{_PIECE}>")


def clean_markup(records: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, kinds, clean_text) of every record: the text of content paths without marks, structure
    kept (headings and list items on their own lines, list items with "- ", code and formulas as
    they are, table cells by tabs), and the notations that were taken away."""
    parts = materialize(parsed(records, id_col, text_col), "p4-pieces")
    marks = F.regexp_count("plain", F.lit(_PUNCT.pattern)).alias("q")
    plain = parts.filter("plain is not null").select(F.lit("text").alias("path"), F.length("plain").alias("t"), marks, F.lit(0).alias("m"))
    marked = parts.select(F.explode("pieces").alias("p")).select("p.path", "p.t", "p.q", "p.m")
    sums = plain.unionByName(marked).groupBy("path").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in "tqm"])
    content = [p for p, ok in sorted(content_paths([tuple(r) for r in sums.collect()]).items()) if ok]  # one row per path of the grammar
    kept = lambda p: p["path"].isin(content)
    shown = lambda p: kept(p) | ((p["t"] == 0) & (p["out"] != "\n- "))  # noqa: E731  blanks and breaks part words everywhere
    clean = F.array_join(F.transform(F.filter("pieces", shown), lambda p: p["out"]), "")
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(clean, r"\n{3,}", "\n\n"), r"[ \t]+\n", "\n"), r"(?U)^\s+|\s+$", "")
    taken = F.filter("pieces", lambda p: (p["path"] != "text") & ((p["m"] > 0) | ~kept(p)))
    kinds = F.array_sort(F.array_distinct(F.transform(taken, lambda p: F.regexp_extract(p["path"], r"([a-z]+):[^/]*$", 1))))
    return parts.select("id", kinds.alias("kinds"), F.when(F.size("pieces") > 0, clean).otherwise(F.col("plain")).alias("clean_text"))


def p4_found(spark, sf_dir: str) -> DataFrame:
    """Records and the kinds of markup taken from them, without the records of p3_found."""
    records = spark.read.parquet(f"{sf_dir}/mcse_data.parquet")
    kinds = clean_markup(records, "ut", "ab").select(F.col("id").alias("ut"), F.explode("kinds").alias("markup")).distinct()
    return kinds.join(residue(records, "ut", "ab").select(F.col("id").alias("ut")).distinct(), "ut", "left_anti")


def p4_clean(spark, sf_dir: str) -> DataFrame:
    """Clean text and kinds of markup of every record."""
    return clean_markup(spark.read.parquet(f"{sf_dir}/mcse_data.parquet"), "ut", "ab").withColumnRenamed("id", "ut")


QUERIES = {"p4_found": p4_found, "p4_clean": p4_clean}
SQL: dict[str, str] = {}
