"""Brute-force comparisons and edge cases of the training-data operators: nulls, empty and very
long texts, ties, repeated rows, empty tables, extra columns with clashing names."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from semtopics.llm import clusters, containers, copies, distinctive, languages, leaks, markup, quality, residue, sentences

LONG = "The pupils explained the task to each other. " * 20_000


# ------------------------------------------------------------------ 1


def test_two_poisson_separates():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.poisson(2, 90), rng.poisson(40, 10)])
    value, n = np.unique(x, return_counts=True)
    share, elite, back = (v[0] for v in distinctive.em_two_poisson(value[None], n[None]))
    assert share == pytest.approx(0.1, abs=0.03) and elite == pytest.approx(40, abs=4) and back == pytest.approx(2, abs=0.5)
    assert distinctive.elite_posterior(np.array([2.0, 40.0]), share, elite, back).round(3).tolist() == [0, 1]


def topic_tables(spark, rows):
    m = spark.createDataFrame([(i, t, "x") for i, (t, _) in enumerate(rows)], "row_id long, translation string, topic string")
    a = spark.createDataFrame([(i, k, 0.5, "y") for i, (_, k) in enumerate(rows)], "row_id long, topic int, score double, term string")
    return m, a


def test_topic_words(spark):
    rows = [("Look at the coin", 1)] * 30 + [("Look at the maze", 2)] * 30 + [("Look at the clock", 3)] * 30 + [(None, 1), ("", 2), ("coin", None)]
    m, a = topic_tables(spark, rows)
    t = distinctive.p1_table(m.union(m.limit(5)), a)
    top = {(r.topic, r.term) for r in t.filter("score >= 0.5 and n_with * 10 >= n_topic and n_with_all = n_with").collect()}
    assert top == {(1, "coin"), (2, "maze"), (3, "clock")}
    sizes = {r.topic: r.n_topic for r in t.select("topic", "n_topic").distinct().collect()}
    assert sizes == {1: 31, 2: 31, 3: 30}


def test_topic_words_empty(spark):
    m, a = topic_tables(spark, [("x", None)])
    assert distinctive.p1_table(m, a).count() == 0
    assert distinctive.p1_table(m.limit(0), a.limit(0)).count() == 0


# ------------------------------------------------------------------ 2


def vectors(spark, groups=3, size=60, dim=8, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim)) * 3
    rows = [(g * size + i, (centres[g] + rng.normal(size=dim) * 0.4).tolist()) for g in range(groups) for i in range(size)]
    return rows


def test_markov_clusters(spark):
    rows = vectors(spark)
    bad = [(900, None), (901, [0.0] * 8), (902, [1.0]), (903, [float("nan")] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, v, 7) for i, v in rows + rows[:5] + bad], "document_id long, e array<float>, cluster int")
    out = clusters.cluster_vectors(df, "document_id", "e", n_nodes=40).collect()
    assert len(out) == 185  # repeated rows stay, unusable ones go
    group = defaultdict(set)
    for r in out:
        group[r.document_id // 60].add(r.cluster)
    assert all(len(v) == 1 for v in group.values()) and len(set.union(*group.values())) == 3
    assert clusters.cluster_vectors(df.limit(0), "document_id", "e").count() == 0
    one = clusters.cluster_vectors(df.filter("document_id = 1"), "document_id", "e").collect()
    assert {(r.cluster, round(r.distance, 5)) for r in one} == {(0, 0.0)}


def test_small_groups_keep_their_cluster(spark):
    rng = np.random.default_rng(7)
    centres = np.eye(8) * 3
    rows = [(k * 1000 + i, (centres[k] + rng.normal(size=8) * 0.2).tolist()) for k, n in enumerate((900, 900, 3, 2, 3, 2)) for i in range(n)]
    df = spark.createDataFrame(rows, "document_id long, e array<float>")
    group = defaultdict(set)
    for r in clusters.cluster_vectors(df, "document_id", "e", n_nodes=16).collect():
        group[r.document_id // 1000].add(r.cluster)
    assert all(len(v) == 1 for v in group.values()) and len(set.union(*group.values())) == 6


def test_mcl_prunes_by_value_only(spark):
    n = 200  # more equal entries a column than any fixed number of places
    edges = [(i, j, 1.0) for i in range(n) for j in range(n)]
    out = clusters.markov_clusters(spark.createDataFrame(edges, "i long, j long, v double"), max_iterations=1)
    assert {round(r.flow, 9) for r in out.collect()} == {1 / n}


def test_mcl_on_two_cliques(spark):
    edges = [(i, j, 1.0) for block in ((0, 1, 2), (3, 4, 5)) for i in block for j in block] + [(2, 3, 0.05), (3, 2, 0.05)]
    out = {r.node: r.attractor for r in clusters.markov_clusters(spark.createDataFrame(edges, "i long, j long, v double"), inflation=2.0).collect()}
    assert out[0] == out[1] == out[2] != out[3] == out[4] == out[5]


# ------------------------------------------------------------------ 3, 4


@pytest.mark.parametrize(
    "text, found",
    [
        ("{{abstract}}", True), ("[No abstract available]", True), ("N/A", True), ("null ", True), ("Please enable JavaScript to view this abstract.", True),
        ("404 Not Found. The page you requested could not be found on this server.", True), ("Lorem ipsum dolor sit amet velit nulla magna.", True),
        ("Data were collected in <YEAR> by %TEAM_NAME%.", True), ("We study ___________ in a sample of ____ pupils.", True),
        ("test test test. test test test.", True), ("The effect was XX.XX here.", True),
        ("Hints such as “Well done, {name}!” were filled in.", False), ("A page that says “not found” confused 63 of the pupils. They left it.", False),
        ("Half of the class typed lorem ipsum or the word test instead of an essay in 61 cases.", False), ("The set {9, 8, 7} was shown first.", False),
        ("We set $\\alpha = 0.05$ and $n_{2} = 40$.", False), ("Costs fell from $75 to $5 per pupil.", False), ("It uses [[topic model|topic models]].", False), ("Reason #1 was lack of time [12].", False),
        ("", False), ("  ", False), (LONG, False),
    ],
)
def test_residue(text, found):
    assert any(s[3] != "alignment" for s in residue.signs(text)) is found


PROSE = "The weekly quiz raised the recall of key terms in small groups. A short story delayed the use of visual aids after a warm up. " * 3


@pytest.mark.parametrize(
    "text, found",
    [
        (PROSE + "Please enable JavaScript to view this page.", True), (PROSE + "502 Bad Gateway", True), ("No abstract available. " + PROSE, True),
        ("Access denied. You do not have permission to view this record. " + "Return to the search page and choose another entry from the list shown there. " * 5, True),
        ("Traceback (most recent call last): " + "File run, line 3, in fetch " * 12 + "KeyError: 'abstract'", True),
        (PROSE, False), (PROSE + "Pupils who met an internal server error left the task.", False), (PROSE + "An access denied notice was shown to 63 of the pupils.", False),
        ("Teachers reported that the service was unavailable, and error 404 confused the class.", False),
    ],
)
def test_residue_at_any_length(text, found):
    assert any(s[3] != "alignment" for s in residue.signs(text)) is found


def test_residue_by_alignment(spark):
    """Slots without a template notation are found by the records that share their frame."""
    texts = {
        "a1": "Dear user_name, the text is due on default_date. " + PROSE, "a2": PROSE + "Dear user_name, the text is due on default_date.",
        "b1": "The mean score was [INSERT MEAN] points. Pupils were glad.", "b2": "The mean score was [insert mean] points. " + PROSE,
        "c1": "The results show [MAIN RESULT] in every class.",  # seen once: nothing to align with
        "d1": "The column user_id and the flag is_new were logged 12 times. " + PROSE, "d2": "The column user_id and the flag is_new were logged 55 times.",  # names are mentioned
        "e1": "They drew the [red] ball. " + PROSE, "e2": "They drew the [blue] ball.", "e3": "They drew the [green] ball.", "e4": PROSE + "They drew the [big] ball.",  # filled: the filling varies
        "f1": "This article discusses error messages such as internal server error.", "f2": "This article discusses error messages such as bad gateway. " + PROSE,
        "g1": "Say [hello world] to them. " + PROSE, "g2": "Say [hello world] to them. " + PROSE,  # one text under two ids
        "h1": PROSE * 5 + "Sorry, this page could not be found on our server. " + PROSE * 3,
    }
    df = spark.createDataFrame([(k, v, 1) for k, v in texts.items()], "ut string, ab string, n_records int")
    out = residue.residue(df, "ut", "ab").collect()
    assert {r.id for r in out if r.decided_by == "alignment"} == {"a1", "a2", "b1", "b2"}
    assert {r.id for r in out} == {"a1", "a2", "b1", "b2", "h1"}
    assert {(r.template, r.n_records, r.n_fillings) for r in out if r.id[0] in "ab"} == {("dear \x00, the text is due on \x00", 2, 1), ("the mean score was \x00 points", 2, 1)}


def test_residue_frame(spark):
    df = spark.createDataFrame([("a", "{{title}}", "k"), ("b", "{{title}}", "k"), ("c", None, "k"), ("d", "A fine text about pupils.", "k"), ("a", "{{title}}", "k")], "ut string, ab string, template string")
    out = residue.residue(df, "ut", "ab").collect()
    assert {(r.id, r.n_records) for r in out} == {("a", 2), ("b", 2)}
    assert residue.residue(df.limit(0), "ut", "ab").count() == 0


MARKED = [
        ("a <b>bold</b> word", ["html"]), ("R&D staff and x < 3 and y > 2", []), ("AT&amp;T &lt;p&gt;", ["html"]), ("## Aim\n\ntext", ["markdown"]), ("a **bold** word", ["markdown"]),
        ("| a | b |\n|---|---:|\n|** 1 | 2 |", ["markdown"]), ("a*b*c and user_id is_new C# and 2 * 2", []), ("see [it](https://x.invalid/1.md)", ["markdown"]), ("- one\n- two", ["markdown"]),
        ("It uses [[model|models]]", ["wiki"]), ("'''bold''' and ''it''", ["wiki"]), ("== Aim ==\ntext", ["wiki"]), ("* [[one]]\n** two", ["wiki"]), ('{| class="wikitable"\n! a !! b\n|-\n| 1 || 2\n|}', ["wiki"]),
        ("About 52\\% of them", ["latex"]), ("\\section{Aim} text", ["latex"]), ("We set $n_{2} = 40$.", ["latex"]), ("from $75 to $5", []), ("see~\\cite{a2019}", ["latex"]),
        ("```r\nif a == b: x <- '''3'''\n```", ["markdown"]), ("<i>x</i> and \\textit{y}", ["html", "latex"]), ("", []), (None, []), ("\\begin{itemize}\n\\item a\n\\end{itemize}", ["latex"]),
]


def test_markup_kinds(spark):
    df = spark.createDataFrame([(i, t, "x") for i, (t, _) in enumerate(MARKED)], "doc long, text string, kinds string")
    out = {r.id: r.kinds for r in markup.clean_markup(df, "doc", "text").collect()}
    assert [out[i] for i in range(len(MARKED))] == [kinds for _, kinds in MARKED]


def test_markup_clean(spark):
    df = spark.createDataFrame([("a", "<h2>Aim</h2>We saw <i>two</i> things:<ul><li>one</li><li>two</li></ul>", 1), ("b", "# Aim\n\nThe **pace** rose. `f(x)`\n\n```r\nx <- 1\n```", 2), ("c", None, 3), ("d", LONG, 4), ("e", "$n_{2}$ and \\emph{more} of 5\\%", 5)], "ut string, ab string, kinds int")
    out = {r.id: r.clean_text for r in markup.clean_markup(df, "ut", "ab").collect()}
    assert out["a"] == "Aim\nWe saw two things:\n\n- one\n- two" or out["a"].split() == "Aim We saw two things: - one - two".split()
    assert out["b"].split() == "Aim The pace rose. f(x) x <- 1".split() and out["c"] is None and out["d"] == LONG and out["e"] == "n_{2} and more of 5%"
    assert markup.clean_markup(df.limit(0), "ut", "ab").count() == 0


def test_markup_kinds_frame(spark):
    df = spark.createDataFrame([("a", "a <b>bold</b> **word**"), ("b", "plain"), ("c", None), ("d", "![](x.png) <hr>")], "ut string, ab string")
    assert {r.id: r.kinds for r in markup.clean_markup(df, "ut", "ab").collect()} == {"a": ["html", "markdown"], "b": [], "c": [], "d": ["html", "markdown"]}


def test_markup_paths_decide(spark):
    menu = "<div><nav>" + "".join(f'<a href="https://x.invalid/section/{k}/page.html">p{k}</a>' for k in range(9)) + "</nav></div>"
    body = '<p>The pupils, as <a href="https://x.invalid/1">they said</a>, explained the task to each other. It went well.</p>'
    df = spark.createDataFrame([("a", menu + body), ("b", body * 3), ("c", "<pre><code>x &lt; 1</code></pre> and <b>more</b>.")], "ut string, ab string")
    out = {r.id: r.clean_text for r in markup.clean_markup(df, "ut", "ab").collect()}
    assert out["a"] == "The pupils, as they said, explained the task to each other. It went well."
    assert out["b"].count("as they said,") == 3 and out["c"].split() == "x < 1 and more.".split()
    sums = markup.path_sums("<ul><li>one<li>two **three**</ul>rest")
    assert {p: s[1] for p, s in sums.items()} == {"text": 4, "text/html:ul": 0, "text/html:ul/html:li": 7, "text/html:ul/html:li/markdown:strong": 5}
    # another collection, another verdict: the path of the links is content where they hold running text
    essays = spark.createDataFrame([("a", menu + body), *[(str(k), f'<div><nav><a href="/{k}">The pupils, as they said, explained the task; it went well. {PROSE}</a></nav></div>') for k in range(9)]], "ut string, ab string")
    rows = {r.id: r for r in markup.clean_markup(essays, "ut", "ab").collect()}
    assert rows["a"].clean_text.startswith("p0p1p2p3") and out["a"].startswith("The pupils") and rows["a"].kinds == ["html"]
    low = markup.content_paths([("text", 9, 9000, 200, 0), ("text/markdown:heading", 9, 90, 0, 40), ("text/html:h2", 9, 10, 0, 20_000)])
    assert low == {"text": True, "text/markdown:heading": True, "text/html:h2": False}


def test_markup_threshold_at_any_depth(spark):
    # a path is judged by its own figures however much plain text the collection holds
    for plain in (9_000, 9_000_000):
        found = markup.content_paths([("text", 9, plain, plain // 45, 0), ("text/html:h2", 9, 10, 0, 20_000), ("text/html:p", 9, 900, 20, 40), ("text/html:br", 9, 0, 0, 36)])
        assert found == {"text": True, "text/html:h2": False, "text/html:p": True, "text/html:br": False}
    assert markup.content_paths([("text", 9, 60, 0, 0), ("text/html:a", 9, 20, 3, 2000)]) == {"text": True, "text/html:a": False}
    # cells and items are kept whatever the length of tags and styles, and their rows stay apart
    style = ' class="result-table" style="text-align:right;font-size:9pt"'
    marked = {
        "table": f"<div{style}><table>\n<tr><td{style}>1</td><td{style}>2</td></tr>\n<tr><td>3</td><td>4</td></tr>\n</table></div> It rose.",
        "list": f"<html><body><ol{style}><li{style}>a</li><li>b</li></ol></body></html>",
        "link": f'See <p>it <a href="https://x.invalid/{"0" * 40}">here</a>, they said.</p>',
        "count": f'It rose.<a href="https://x.invalid/{"0" * 400}">p</a>',
        "blank": "It<b> </b>rose.",
        "menu": "".join(f'<ul><li><a href="https://x.invalid/section/{k}/page.html">p{k}</a></li></ul>' for k in range(9)) + "It rose.",
    }
    df = spark.createDataFrame([*marked.items(), *[(str(k), PROSE) for k in range(300)]], "ut string, ab string")
    out = {r.id: r for r in markup.clean_markup(df, "ut", "ab").collect()}
    assert [x.split() for x in out["table"].clean_text.split("\n") if x] == [["1", "2"], ["3", "4"], ["It", "rose."]]
    assert [x for x in out["list"].clean_text.split("\n") if x] == ["- a", "- b"]
    assert out["link"].clean_text.split() == "See it here, they said.".split()
    assert out["count"].clean_text == out["menu"].clean_text == out["blank"].clean_text == "It rose."
    assert all(out[k].kinds == ["html"] for k in marked) and out["0"].clean_text == PROSE and out["0"].kinds == []


# ------------------------------------------------------------------ 5


def brute_classes(texts):
    def letters(s):
        return "".join(c for c in s if c.isalnum())

    by = defaultdict(list)
    for i, t in texts:
        if t is None or not t.strip():
            continue
        s = t.lower().replace("ß", "ss")
        parts = [letters(p) for p in re.split(r"\s*[;|\r\n]\s*(?=[^\W\d_]+\s*:)", s)]
        parts = [p for p in parts if p]
        by["\x1f".join(sorted(parts)) if len(parts) > 1 and re.match(r"\W*[^\W\d_]+\s*:", s) else letters(s)].append(i)
    return {(min(v), i) for v in by.values() for i in set(v) if i != min(v)}


def run_copies(spark, rows):
    df = spark.createDataFrame([(i, t, y, "z") for i, t, y in rows], "row_id long, translation string, y int, first_row_id string")
    r, classes, total = copies.copy_classes(df, "row_id", "translation", F.col("y"))
    k = F.struct("s_a", "s_b", "p_a", "p_b").alias("k")
    found = copies.join_unique(r.select("row_id", k), classes.filter("copies > 1").select(k, "n", "first_row_id"), "k", "n", total, share=4)
    return {(x.first_row_id, x.row_id) for x in found.filter("row_id <> first_row_id").collect()}, classes


def test_copies(spark):
    rng = random.Random(3)
    base = ["One more go, Bo!", "Well done", "Hint: Look at it | Level: 3 | Helper: Bo", "Straße 3", "café", "cafe", "", None, "  ", "!!!", "Être là", LONG]
    rows = []
    for i in range(400):
        t = rng.choice(base[:1] * 15 + base)
        if t and t.startswith("Hint"):
            parts = t.split(" | ")
            rng.shuffle(parts)
            t = rng.choice([" | ", "; ", "\n", "\xa0|\u2003"]).join(parts)
        elif t:
            t = rng.choice([t, t.upper(), t.replace(" ", " \u200b\t") + "…", f"“{t}”", t.replace(",", " -")])
        rows.append((i, t, rng.choice([2023, 2024, None])))
    rows += rows[:20]
    got, classes = run_copies(spark, rows)
    assert got == brute_classes([(i, t) for i, t, _ in rows])
    assert classes.agg(F.sum("n")).first()[0] == len({i for i, t, _ in rows if t and t.strip()})


def test_copies_order_and_empty(spark):
    got, _ = run_copies(spark, [(5, "A: x; B: y", 1), (3, "B: y | A: x", 2), (7, "a x b y", 1), (9, "e\u0301te", 1), (8, "\u00e9te", 3)])
    assert got == {(3, 5), (3, 7), (8, 9)}
    assert run_copies(spark, [(1, None, 1)])[0] == set()


def test_ledger_touches_its_buckets_only(spark):
    ledger = copies.Ledger(spark, 4)
    batch = lambda rows: spark.createDataFrame([(a, b, a, b, n, first) for a, b, n, first in rows], "s_a long, s_b long, p_a long, p_b long, copies long, first_row_id long")
    ledger.merge(batch([(0, 1, 2, 10), (1, 1, 1, 11), (2, 5, 1, 12)]))
    ledger.merge(batch([(0, 1, 1, 4), (4, 9, 1, 20)]))
    assert {(r.s_a, r.s_b): (r.copies, r.first_row_id) for r in ledger.state().collect()} == {(0, 1): (3, 4), (1, 1): (1, 11), (2, 5): (1, 12), (4, 9): (1, 20)}
    assert ledger.version_of[0] == 2 and ledger.version_of[1] == 1
    # a labelled message of a later batch takes the unlabelled ones of its letters into its class
    ledger.merge(spark.createDataFrame([(1, 1, 70, 71, 2, 3)], "s_a long, s_b long, p_a long, p_b long, copies long, first_row_id long"))
    assert {(r.copies, r.first_row_id) for r in ledger.classes().filter("s_a = 1").collect()} == {(3, 3)}


# ------------------------------------------------------------------ 6


@pytest.mark.parametrize(
    "text, parts",
    [
        ("Dr. Bo met Mr. Vo vs. Mrs. Lo. He has card No. 3.", ["Dr. Bo met Mr. Vo vs. Mrs. Lo.", "He has card No. 3."]),
        ("It costs 3.5 cm, i.e. less.Now go on.", ["It costs 3.5 cm, i.e. less.", "Now go on."]),
        ("“Well done!” wrote Bo. “Is it ready? Yes.” asked Al and left.", ["“Well done!” wrote Bo.", "“Is it ready? Yes.” asked Al and left."]),
        ("They meet at 4 p.m. Bring cards. We met at 4 p.m. and left.", ["They meet at 4 p.m.", "Bring cards.", "We met at 4 p.m. and left."]),
        ("He waited ... and spoke. Why?! Go on…", ["He waited ... and spoke.", "Why?!", "Go on…"]),
        ("この方法は簡単だ！平均は3.5だ。「もう一度。」と言った。", ["この方法は簡単だ！", "平均は3.5だ。", "「もう一度。」と言った。"]),
        ("यह सरल है। क्या मदद है? हाँ।", ["यह सरल है।", "क्या मदद है?", "हाँ।"]),
        ("วิธีนี้ง่าย ครูเขียน", ["วิธีนี้ง่าย", "ครูเขียน"]),
        ("Nimm z. B. 9 Karten, d. h. weniger. Am 3. Mai hilft Bo.", ["Nimm z. B. 9 Karten, d. h. weniger.", "Am 3. Mai hilft Bo."]),
        ("Použij např. 20 kostek, tj. méně. Hotovo.", ["Použij např. 20 kostek, tj. méně.", "Hotovo."]),
        ("J. Bo and K. L. Vo coded it. See Fig. 3 and Sec. 5.1 for tasks, etc. used here.", ["J. Bo and K. L. Vo coded it.", "See Fig. 3 and Sec. 5.1 for tasks, etc. used here."]),
        ("  \n ", []), ("", []), ("no end", ["no end"]), ("!!!", []),
    ],
)
def test_sentences(text, parts):
    assert [text[a:b] for a, b in sentences.sentence_starts(text)] == parts


def test_sentence_frame(spark):
    df = spark.createDataFrame([(1, " Go on. Do it.", "x"), (2, None, "x"), (3, "", "x"), (4, LONG, "x")], "row_id long, translation string, sentence string")
    out = sentences.split_sentences(df, "row_id", "translation")
    assert [(r.row_id, r.sentence, r.start_char) for r in out.filter("row_id < 4").orderBy("sentence").collect()] == [(1, 1, 2), (1, 2, 9)]
    assert out.filter("row_id = 4").count() == 20_000 and sentences.split_sentences(df.limit(0), "row_id", "translation").count() == 0


@pytest.mark.parametrize(
    "text, parts",
    [
        ("He came from old. 3 men left.", 2), ("I like art. 5 more came.", 2), ("They gave him an ok. 7 came.", 2), ("First one here\r\n\r\nSecond one here", 2), ("One paragraph\u2029another one", 2),
        ("Siehe Abb. 3 und Nr. 4, das ist gut. Ende.", 2), ("Użyj np. 9 klocków, tj. mniej niż on. Koniec.", 2), ("Uzyj np. 9 klockow, tj. mniej niz on. Juz koniec.", 2), ("See p. 4 and fig. 5 of the book.", 1), ("Vezi pag. 3 și art. 5 din text.", 1),
    ],
)
def test_abbreviations_by_language(text, parts):
    assert len(sentences.sentence_starts(text)) == parts


# ------------------------------------------------------------------ 7

SAMPLES = {
    "en": ["Look at the task once more and give it another go.", "Well done, you solved every task today.", "Read the question slowly and start from the step."] * 3,
    "de": ["Versuch es noch einmal und schau dir die Aufgabe genau an.", "Sehr gut, du hast heute schon viele Aufgaben gelöst.", "Lies die Frage langsam und beginne bei dem Schritt."] * 3,
    "ru": ["Попробуй ещё раз и посмотри внимательно на задание.", "Отлично, сегодня ты уже решил много заданий.", "Прочитай вопрос медленно и начни с шага."] * 3,
}


def test_languages(spark):
    p = languages.Profiles(SAMPLES, dimensions=4096)
    rows = [(1, "Look at the question slowly."), (2, "Sehr gut, schau dir die Aufgabe an."), (3, "Попробуй ещё раз. Well done, you solved the task."), (4, "Lооk at the tаsk once more."), (5, None), (6, ""), (7, "12 + 3 = 15"), (8, LONG)]
    df = spark.createDataFrame([(i, t, "en") for i, t in rows], "row_id long, translation string, lang string")
    out = defaultdict(list)
    for r in languages.language_segments(df, "row_id", "translation", p).orderBy("row_id", "segment").collect():
        out[r.row_id].append(r.lang)
        assert 0 < r.confidence <= 1
    assert dict(out) == {1: ["en"], 2: ["de"], 3: ["ru", "en"], 4: ["en"], 8: ["en"]}
    assert languages.language_segments(df.limit(0), "row_id", "translation", p).count() == 0


def test_best_paths_against_brute_force():
    import itertools

    rng = np.random.default_rng(5)
    lengths = np.array([0, 1, 4, 6, 0, 3])
    scores = rng.normal(size=(int(lengths.sum()), 3)).astype(np.float32)
    labels = languages.best_paths(scores, lengths, 0.7)
    at = 0
    for n in lengths:
        part = scores[at : at + n]
        value = lambda path: sum(part[i, k] for i, k in enumerate(path)) - 0.7 * sum(a != b for a, b in zip(path, path[1:]))  # noqa: B023, E731
        best = max((value(p) for p in itertools.product(range(3), repeat=int(n))), default=0)
        assert value(labels[at : at + n].tolist()) == pytest.approx(best, abs=1e-5)
        at += n


def test_language_code(spark):
    df = spark.createDataFrame([(c,) for c in ("en", "EN", "en-GB", "eng", "de_DE", " ", None)], "c string")
    assert [r[0] for r in df.select(languages.language_code(F.col("c"))).collect()] == ["en", "en", "en", "en", "de", None, None]


# ------------------------------------------------------------------ 8


@pytest.mark.parametrize("capacity", [50, 128, 1000])
def test_packing(capacity):
    rng = random.Random(capacity)
    sizes = [rng.randint(1, capacity) for _ in range(600)]
    for windows in (containers.fill(sizes, capacity), containers.pack(sizes, capacity)):
        assert sorted(i for w in windows for i in w) == list(range(600))
        assert max(sum(sizes[i] for i in w) for w in windows) <= capacity
    assert len(windows) <= 1.05 * -(-sum(sizes) // capacity) + 1
    assert containers.pack([], capacity) == [] and containers.pack([capacity] * 3, capacity).__len__() == 3


def test_difference_balances():
    sizes = [random.Random(2).randint(1, 100) for _ in range(200)] + [7] * 20
    loads = [sum(sizes[i] for i in w) for w in containers.difference(sizes, 10)]
    assert len(loads) == 10 and max(loads) - min(loads) <= 3


def test_containers(spark):
    lengths = spark.createDataFrame([(i, n, "x") for i, n in enumerate([10, 0, 250, 60, 60, None, 128, 100])], "doc_id long, n_tokens long, piece string")
    out = containers.containers(lengths, {"nano": 128, "wide": 2048}).collect()
    nano = [r for r in out if r.encoder_name == "nano" and r.container_id is not None]
    load = defaultdict(int)
    for r in nano:
        load[r.container_id] += r.n_tokens
    assert max(load.values()) <= 128 and sum(load.values()) == 608
    assert sorted((r.first_token, r.n_tokens) for r in nano if r.doc_id == 2) == [(0, 128), (128, 122)]
    assert {r.doc_id for r in out if r.container_id is None} == {1, 5} and len({r.container_id for r in out if r.encoder_name == "wide" and r.container_id is not None}) == 1
    assert containers.containers(lengths.limit(0), {"nano": 128}).count() == 0


# ------------------------------------------------------------------ 9


def test_leaks_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(12, 40)))) for k in range(15)]
    docs = []
    for i in range(120):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 80))]
        if i % 3 == 0:
            k, text = rng.choice(items)
            src = text.split()
            a = rng.randint(0, len(src) - 5)
            words[5:5] = [w.upper() + rng.choice(["", ",", "\n"]) for w in src[a : a + rng.randint(5, 30)]]
        docs.append((i, " ".join(words)))
    docs += [(500, None), (501, ""), (502, "x " * 50_000 + items[0][1]), (0, docs[0][1])]
    want = set()
    for d, t in docs:
        w = " ".join(leaks.words_of(t or ""))
        for k, s in items:
            src = s.split()
            if any(f" {' '.join(src[j : j + 12])} " in f" {w} " for j in range(len(src) - 11)):
                want.add((d, k))
    df = spark.createDataFrame([(d, t, "q") for d, t in docs], "doc_id long, text string, item_id string")
    it = spark.createDataFrame([*items, (90, None), (91, "too short")], "item_id long, text string")
    got = leaks.leaks(df, "doc_id", "text", it, "item_id", "text", proximity=False)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and (502, 0) in want
    every = leaks.leaks(df, "doc_id", "text", it, "item_id", "text")
    assert {(r.doc_id, r.item_id) for r in every.filter("kind = 'phrase'").collect()} == want
    assert leaks.leaks(df.limit(0), "doc_id", "text", it, "item_id", "text").count() == 0
    assert leaks.leaks(df, "doc_id", "text", it.limit(0), "item_id", "text").count() == 0


def test_proximity_beside_phrases(spark):
    w = [f"w{i}" for i in range(20)]
    edited = w[:8] + ["other"] + w[8:16]
    it = spark.createDataFrame([(1, " ".join(w)), (2, "a b c d e f g h i j k l m n o p")], "item_id long, text string")
    df = spark.createDataFrame([(1, " ".join(w + ["x"] * 20 + edited)), (2, " ".join(edited)), (3, " ".join(w))], "doc_id long, text string")
    got = {(r.doc_id, r.kind, r.n_words, r.first_word) for r in leaks.leaks(df, "doc_id", "text", it, "item_id", "text").collect()}
    assert got == {(1, "phrase", 20, 1), (1, "proximity", 16, 41), (2, "proximity", 16, 1), (3, "phrase", 20, 1)}


def test_short_items_and_many_blocks(spark, monkeypatch):
    it = spark.createDataFrame([(1, "One two three."), (2, "alone"), (3, "a b c d e f g h i j k l m n")], "item_id long, text string")
    df = spark.createDataFrame([(1, "zero one two, three four alone"), (2, "one two"), (3, "x a b c d e f g h i j k l y alone")], "doc_id long, text string")
    want = {(1, 1, "phrase", 3, 2), (1, 2, "phrase", 1, 6), (3, 3, "phrase", 12, 2), (3, 2, "phrase", 1, 15)}
    assert {tuple(r) for r in leaks.leaks(df, "doc_id", "text", it, "item_id", "text").collect()} == want
    monkeypatch.setattr(leaks, "ITEMS_PER_BLOCK", 1)  # a pass over the index for every block of items
    monkeypatch.setattr(leaks, "MAX_VOCABULARY", 1)  # the index of all terms
    monkeypatch.setattr(leaks, "_STEP", 2)
    assert {tuple(r) for r in leaks.leaks(df, "doc_id", "text", it, "item_id", "text").collect()} == want


def test_broken_words():
    assert leaks.words_of("On Sat-\nurday 12 well-known Ｃａｆé, it’s") == ["on", "saturday", "12", "well", "known", "ｃａｆé", "it", "s"]


# ------------------------------------------------------------------ 10


def test_quality(spark):
    kinds = [(k, t) for _, k, t in quality.examples()]
    rows = [(i, t, k) for i, (k, t) in enumerate(kinds * 6)] + [(900, None, None), (901, "", None), (902, " \n\n ", None), (903, LONG, "prose"), (904, "ok", None)]
    df = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, kind string")
    out = {r.doc_id: r for r in quality.classify(df).collect()}
    right = sum(out[i].kind == k for i, _, k in rows if i < 900)
    assert right >= 0.95 * 6 * len(kinds) and all(out[i].kind is None and out[i].word_count is None for i in (900, 901, 902))
    assert out[903].word_count == 160_000 and out[904].kind in quality.KINDS
    assert quality.classify(df.limit(0)).count() == 0


def test_statistics():
    fits = quality.pair_fits(np.zeros(quality._CLASSES**2))
    (n, v), none, (_, rows), (_, dense) = quality.batch_statistics(["One two three.\nFour five!", " \n", "a,1,2.5\nb,2,3.5", "先生は毎日この道具を使う。😀 12"], frozenset({"one", "two"}), fits)
    s = dict(zip(quality.FEATURES, v))
    assert n == 5 and s["end_punctuation_share"] == 1 and s["common_word_share"] == pytest.approx(0.4) and s["mean_word_length"] == pytest.approx(3.8)
    assert none is None and rows[1] == 1.0
    t = dict(zip(quality.FEATURES, dense))
    assert t["mean_word_length"] is None and t["common_word_share"] is None and t["digit_ratio"] == pytest.approx(2 / 16) and t["symbol_ratio"] == pytest.approx(2 / 16)


# ------------------------------------------------------------------ contract


def test_registry():
    from semtopics.llm import registry

    assert {int(k[1:].split("_")[0]) for k in registry.QUERIES} == set(range(1, 11))
    assert all(f"p{n}_found" in registry.QUERIES for n in (1, 2, 3, 4, 5, 6, 7, 9, 10))
