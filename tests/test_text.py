import pytest

from semtopics.functions import segments as seg
from semtopics.functions import text as tx
from semtopics.functions.words import ROMAN, abbreviations, stop_words
from semtopics.operators import corpus


def test_list_markers(column):
    cases = {
        "1. background 2. methods": "background methods",
        "(i) first (ii) second": "first second",
        "2 . one 3 . two ( i ) three": "one two three",
        "the concept of (civil) society in (2020) with 1.5 units": None,
        "IV. The sector expanded here.": "The sector expanded here.",
        "V. Capacity grew widely now.": "Capacity grew widely now.",
        "the case Smith v. Jones held": None,
        "edited by V. Nabokov here": None,
        "the reading was 5 V. today": None,
        "Rank is top 20. Good.": None,
        "Value for student 10.": None,
        "We chose option 1. It works.": None,
        "In week 2. Then week 3. Done.": None,
        "Steps: 1. Read 2. Write": "Steps: Read Write",
        "Steps 1. Read 2. Write 3. Stop": "Steps Read Write Stop",
        "Done. 1. First 2. Second": "Done. First Second",
    }
    assert column(tx.strip_list_markers, list(cases)) == [v or k for k, v in cases.items()]


def test_cleaning(column):
    assert column(tx.clean_text, ["Peer <b>support</b> improved outcomes [12] pp. 15-30 here.", "Full report at https://example.org/x.pdf and doi:10.1/y today.", "x < 3 and y > 2 held", None]) == ["Peer support improved outcomes here.", "Full report at and today.", "x < 3 and y > 2 held", ""]
    assert column(lambda c: tx.clean_text(c, numbers=True, roman_numerals=True), ["the year 2020 had chapter iv and covid19 studies"]) == ["the year had chapter and covid19 studies"]


def test_content_ratio(column):
    zero, blank, high, low = column(tx.content_ratio, ["45, 67, 89.", "   ", "A real sentence here.", "OJ No L 297, 24.11.1979, p. 1."])
    assert zero == 0 and blank == 0 and high > 0.9 and low < 0.4


def test_tokens(column):
    assert column(tx.tokens, ["Café déjà vu — 東京"]) == [["café", "déjà", "vu", "東京"]]
    assert column(lambda c: tx.tokens(c, ["and", "buried"]), ["Rock-n-roll isn’t dead and buried"]) == [["rock", "roll", "isn't", "dead"]]
    assert column(lambda c: tx.tokens(c, [], numbers="remove"), ["the year 2020 had 15 covid19 studies"]) == [["the", "year", "had", "covid19", "studies"]]
    assert column(lambda c: tx.tokens(c, [], roman_numerals="remove"), ["iv xii ml mm"]) == [["ml", "mm"]]
    assert column(lambda c: tx.tokens(c, [], section_numbers="remove"), ["12. in 2020 the 19 ones 1.2.3"]) == [["in", "2020", "the", "19", "ones"]]


def test_ngrams(column):
    assert column(lambda c: tx.ngrams(tx.tokens(c), 2), ["alpha beta alpha gamma", ""]) == [["alpha", "beta", "gamma", "alpha beta", "beta alpha", "alpha gamma"], []]


def test_word_lists():
    assert len(stop_words()) == 125 and "x" in stop_words(add=["X"]) and "the" not in stop_words(remove=["The"])
    assert len(abbreviations()) == 24 and "iv" in ROMAN and "c" not in ROMAN and "xcix" in ROMAN
    with pytest.raises(ValueError):
        stop_words("xx")


@pytest.mark.parametrize(
    "level, text, parts",
    [
        ("sentence", "SEE FIG. 3 FOR DETAILS. THE NEXT PART FOLLOWS.", ["SEE FIG. 3 FOR DETAILS.", "THE NEXT PART FOLLOWS."]),
        ("sentence", "THE TEST. THE MOST. THE LIST. EACH ONE IS SEPARATE.", ["THE TEST.", "THE MOST.", "THE LIST.", "EACH ONE IS SEPARATE."]),
        ("sentence", "ACCURACY REACHED 3.14 PERCENT OVERALL. IT THEN ROSE.", ["ACCURACY REACHED 3.14 PERCENT OVERALL.", "IT THEN ROSE."]),
        ("clause", "WE HAD TWO GOALS: SPEED AND CLARITY; BOTH WERE MET.", ["WE HAD TWO GOALS:", "SPEED AND CLARITY;", "BOTH WERE MET."]),
        ("clause", "WE PROPOSE A SIMULATOR WHICH RUNS ALONGSIDE THE PROCESSOR.", ["WE PROPOSE A SIMULATOR", "WHICH RUNS ALONGSIDE THE PROCESSOR."]),
        ("phrase", "THE TOOL COVERS TESTS, GRADING, AND FEEDBACK.", ["THE TOOL COVERS TESTS,", "GRADING,", "AND FEEDBACK."]),
        ("phrase", "WE USE A LANGUAGE (E.G., PYTHON, RUBY) HERE, THEN STOP.", ["WE USE A LANGUAGE (E.G., PYTHON, RUBY) HERE,", "THEN STOP."]),
        ("sentence", "It’s fast—it works. The end.", ["It's fast - it works.", "The end."]),
        ("sentence", "", []),
    ],
)
def test_segments(column, level, text, parts):
    assert column(lambda c: seg.segment_array(c, level), [text]) == [parts]


def test_merge_and_cap(column):
    assert column(lambda c: seg.segment_array(c, "phrase", 3), ["IT COVERS A, B, AND C IN ONE TOOL."]) == [["IT COVERS A, B,", "AND C IN ONE TOOL."]]
    assert column(lambda c: seg.segment_array(c, "phrase", 4), ["TESTS, GRADING, FEEDBACK, EXAMS."]) == [["TESTS, GRADING, FEEDBACK, EXAMS."]]
    long = "word " * 500 + "and more, then it stops."
    (parts,) = column(lambda c: seg.segment_array(c, "clause", max_tokens=20), [long])
    assert max(len(p.split()) for p in parts) <= 20 and " ".join(parts).split() == long.split()


def test_custom_abbreviation(column):
    assert column(lambda c: seg.segment_array(c, "sentence", abbreviations=["CIRCA."]), ["BUILT CIRCA. 1900 IN STONE. IT STANDS."]) == [["BUILT CIRCA. 1900 IN STONE.", "IT STANDS."]]


def test_dedupe(spark):
    values = ["b", "a", "b", None, "  ", "b", "a", "c"]
    df = spark.createDataFrame([(i, v, f"g{i}") for i, v in enumerate(values)], "i int, text string, grp string")
    out = corpus.dedupe(df, "text", "i").orderBy("i").collect()
    assert [(r.text, r.n, r.grp) for r in out] == [("b", 3, "g0"), ("a", 2, "g1"), ("c", 1, "g7")]
    with pytest.raises(ValueError):
        corpus.dedupe(df.withColumnRenamed("grp", "n"), "text", "i")


def test_clean_corpus_and_segment(spark):
    df = spark.createDataFrame([(1, "1. 2. 3."), (2, "A real sentence remains here."), (3, None)], "id int, text string")
    assert [r.id for r in corpus.clean_corpus(df, "text").collect()] == [2]
    rows = corpus.segment(spark.createDataFrame([(1, "One here. Two here."), (2, " "), (3, "Three.")], "id int, text string"), "id", "text", "sentence").orderBy("id", "segment").collect()
    assert [tuple(r) for r in rows] == [(1, 1, "One here."), (1, 2, "Two here."), (3, 1, "Three.")]


def test_usable(column):
    assert column(tx.usable, ["x", " ", None, "[no abstract available]", "na", "Null"]) == [True, False, False, False, False, False]


def test_chop_against_plain_search():
    import random

    from semtopics.functions.segments import BREAK_BEFORE, chop

    def plain(words, cap):
        out = []
        while len(words) > cap:
            back = [cap - k for k in range(max(1, int(0.25 * cap))) if cap - k >= 1 and words[cap - k].strip("\"'(),.;:").lower() in BREAK_BEFORE]
            cut = back[0] if back else cap
            out.append(" ".join(words[:cut]))
            words = words[cut:]
        return [*out, " ".join(words)]

    rng = random.Random(1)
    for _ in range(500):
        words = [rng.choice(["and", "of", "cat", "dog", "(the", "sun,"]) for _ in range(rng.randint(1, 40))]
        cap = rng.randint(1, 12)
        assert chop(words, cap) == plain(words, cap)
    assert chop(["aaaa", "bb", "c"], 3, [4, 2, 1]) == ["aaaa", "bb c"]


def test_vectors_are_checked():
    import pyarrow as pa
    import pytest

    from semtopics.errors import BadInput
    from semtopics.operators.cluster import unit_matrix

    kind = pa.list_(pa.float64())
    assert unit_matrix(pa.array([[3.0, 4.0]], kind), 2).tolist() == [[0.6, 0.8]]
    for bad in ([[1.0, 2.0], None], [[1.0]], [[0.0, 0.0]], [[1.0, float("nan")]]):
        with pytest.raises(BadInput):
            unit_matrix(pa.array(bad, kind), 2)
