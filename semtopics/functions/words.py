"""Word lists and fixed values that results depend on."""

from __future__ import annotations

#: English stop words.
STOP_WORDS_EN = (
    "a about after again against all am an and any are as at be because been before being below between both but by "
    "can could did do does doing down during each few for from further had has have having he her here hers herself him "
    "himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other "
    "our ours ourselves out over own same she should so some such than that the their theirs them themselves then there "
    "these they this those through to too under until up very was we were what when where which while who whom why will "
    "with would you your yours yourself yourselves"
).split()

#: Abbreviations whose periods end no sentence.
ABBREVIATIONS = ["E.G.", "I.E.", "ET AL.", "VS.", "CF.", "FIG.", "FIGS.", "EQ.", "EQS.", "NO.", "NOS.", "VOL.", "PP.", "DR.", "PROF.", "ST.", "REF.", "REFS.", "U.S.", "U.K.", "PH.D.", "M.SC.", "B.SC.", "APPROX."]

#: Words that open a new clause, in the order they are tried.
HINGES = ["IN TERMS OF", "IN ORDER TO", "SUCH THAT", "AS WELL AS", "RATHER THAN", "WHEREAS", "WHEREBY", "WHICH", "WHERE", "WHILE", "BECAUSE", "ALTHOUGH", "THOUGH"]

#: Function words before which an over-long part may be cut.
BREAK_BEFORE = (
    "and but or nor yet so of in on to for with at by from as into about over under after before between through during "
    "against than upon within without toward towards across that which who whom whose when where while because a an the "
    "this these those"
).split()

#: Texts that stand for a missing one (compared in upper case after trimming).
PLACEHOLDERS = ["[NO ABSTRACT AVAILABLE]", "NO ABSTRACT AVAILABLE", "NA", "NULL"]


#: Entities and the signs they stand for, in the order they are replaced.
ENTITIES = (("&amp;", "&"), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'))

#: Patterns of the character cleaning and what takes their place, in order; results depend
#: on both. ``{B}`` is the start of a word in ASCII.
CLEANING = (
    (r"&#39;|&#8217;|&#8216;|&rsquo;|&lsquo;|&apos;", "'"),
    (r"</?[A-Za-z][^>]*>|<[A-Za-z]+/?>", " "),
    (r"(?i){B}(?:https?://|www\.|doi:\s*)\S+", " "),
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", " "),
    (r"\[[0-9][0-9,;\s-]*\]", " "),
    (r"(?i){B}pp?\.\s*[0-9]+(?:\s*[-\x{2013}]\s*[0-9]+)?", " "),
    (r"[\x{2018}\x{2019}\x{201B}\x{2032}]", "'"),
    (r"[\x{201C}\x{201D}]", '"'),
    (r"[\x{2013}\x{2014}]", " - "),
    (r"[\x{2022}\x{25CF}\x{25AA}\x{00B7}\x{2023}\x{2043}\x{2219}]", " "),
    (r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", " "),
    (r"[\x{200B}-\x{200D}\x{FEFF}\x{00AD}\x{FFFD}]", ""),
    (r"\x{00A0}", " "),
)

#: Signs between a list number and the break before it, and signs that are such a break.
MARKER_SKIPS, MARKER_BREAKS = " \t\r\n\"'(", ".:;!?"


def roman(n: int) -> str:
    """Canonical lower-case Roman numeral."""
    out = ""
    for value, sign in ((100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        while n >= value:
            out, n = out + sign, n - value
    return out


#: Canonical numerals of two letters and more up to 100, longest first for alternations.
ROMAN = sorted((r for r in map(roman, range(1, 101)) if len(r) > 1), key=lambda r: (-len(r), r))


def stop_words(language: str = "en", add=None, remove=None) -> list[str]:
    """Stop words of a language, lower case and sorted, with words added or removed."""
    if language != "en":
        from ..errors import BadInput

        raise BadInput(f"no stop words for language {language!r}; only 'en'")
    words = set(STOP_WORDS_EN) | {w.lower() for w in add or []}
    return sorted(words - {w.lower() for w in remove or []})


def abbreviations() -> list[str]:
    return sorted(ABBREVIATIONS)
