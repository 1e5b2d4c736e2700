"""Text functions on the cases of the data model."""

import re
import time
import unicodedata

import pytest
from pyspark.sql import functions as F

from pairlake.functions import sections, text


def apply(spark, f, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("t"))).collect()]


def test_references_go_from_the_first_heading_on(spark):
    got = apply(spark, text.remove_references, "a\nReferences\nx\nReferences\ny", "a\nreferences\nx", "\nBIBLIOGRAPHY\n1", "a References b")
    assert got == ["a", "a\nreferences\nx", "", "a References b"]


def test_latex(spark):
    got = apply(spark, text.clean_latex, r"a \citep{x} b \textbf{bold} \ref{y}\eqref{z}\label{l}", r"\begin{figure}in\end{figure}", r"\subsection*{Title}x\noindent y\\")
    assert got == ["a  b bold ", "in", "\nTitle\nx y"]


def test_tags_boilerplate_addresses(spark):
    assert apply(spark, text.clean_xml, "<p>x <b>y</b></p>", "a < b and c > d") == ["x y", "a  d"]
    assert apply(spark, text.remove_boilerplate, "x\nCOPYRIGHT 2020 Y\nz", "Go to: here", "all rights reserved\x85more\nz") == ["x\nz", " here", "z"]
    assert apply(spark, text.remove_urls_emails, "see https://a.b/c?d, or (me@x.org) now") == ["see  or  now"]


def test_white_space_and_nfkc(spark):
    got = apply(spark, text.normalize_space, "ﬁber", "a  b\t c", "p\n\n\n\n\nq", "  x  ", "plain  ascii")
    assert got == ["fiber", "a b c", "p\n\nq", "x", "plain ascii"]


def test_clean_text_uses_latex_rules_by_source(spark):
    rows = spark.createDataFrame([(r"\emph{x}", "arxiv"), (r"\emph{x}", "pmc"), (r"\emph{x}", None), (None, "pmc")], "t string, s string")
    assert [r[0] for r in rows.select(text.clean_text(F.col("t"), F.col("s"))).collect()] == ["x", r"\emph{x}", r"\emph{x}", ""]


def test_context_filter(spark):
    words = "abcd " * 10
    got = apply(spark, text.filter_context, None, "", "x" * 49, f"  {words}x  ", "two " + "w" * 50, "1234 " * 12, ("ab 1 " * 12).strip(), ("ab 12 " * 12).strip(), ("abc 1 " * 12).strip(), "a b " + "c" * 1000)
    assert got == [None, None, None, f"{words}x", None, None, None, None, ("abc 1 " * 12).strip(), None]


@pytest.mark.parametrize(("given", "want"), [(None, []), ("background, methodology", ["background", "methodology"]), (" RESULT ,, ", ["result"])])
def test_intents_of_a_string(spark, given, want):
    assert apply(spark, text.intents_of_string, given) == [want]


def test_lists_of_lists(spark):
    rows = spark.createDataFrame([([["a", "b"], ["c"]],), ([None, ["a", None]],), ([[]],), (None,)], "c array<array<string>>")
    assert [r[0] for r in rows.select(text.flat_strings(F.col("c"))).collect()] == [["a", "b", "c"], ["a"], [], []]
    assert [r[0] for r in rows.select(text.label_list(F.col("c"))).collect()] == ["a,b,c", "a", "—", "—"]


def test_trigrams_and_overlap(spark):
    rows = spark.createDataFrame([("A b c d", "b C d"), ("a b", "a b c"), ("x y z x y z", "x y z")], "s string, a string")
    got = rows.select(F.size(text.trigrams(F.col("s"))), text.overlap_ratio(text.trigrams(F.col("s")), text.trigrams(F.col("a")))).collect()
    assert [tuple(r) for r in got] == [(2, 0.5), (0, None), (3, pytest.approx(1 / 3))]


def test_sentences_noise_and_middle(spark):
    assert apply(spark, text.sentences, "One. Two! (three) four? five") == [["One.", "Two!", "(three) four? five"]]
    assert apply(spark, text.is_noise, "[12], 13;", "see Fig. 3", "Table 2", "et al said", "a claim") == [True, True, True, True, False]
    assert apply(spark, text.middle_third, "abcdefghi", "abcdefgh", "ab", "a") == ["def", "cde", "a", ""]


def test_titles_tasks_and_answers(spark):
    rows = spark.createDataFrame([("deep graph networks", "(Deep) Graph"), ("x", "of a")], "c string, t string")
    assert [r[0] for r in rows.select(text.title_overlap(F.col("c"), F.col("t"))).collect()] == [0.5 + 0.5, 0.0]
    tasks = spark.createDataFrame([("classify", "x"), ("other", "x")], "k string, t string")
    assert [r[0] for r in tasks.select(text.task_prefixed(F.col("k"), F.col("t"))).collect()] == ["classify: x", "x"]
    assert apply(spark, text.paraphrase, '"quoted"\nmore') == ["quoted"]
    assert apply(spark, lambda c: text.prefixed("search_query", c, F.lit("")), "Title", None) == ["search_query: Title. ", None]


def test_sections(spark):
    body = "word " * 60
    doc = f"😀 lead\n# Introduction\n{body}\n2. Methods\n{body}\n\\section{{Results}}\nshort\nConclusions\n{body}\nMethods\nagain"
    got = apply(spark, sections.sections, doc, "Introduction\n" + "x" * 400, None)
    assert [s["section_type"] for s in got[0]] == ["introduction", "methods", "discussion"]
    assert got[0][0]["text"] == body.strip() and got[0][0]["start"] == doc.index("\n# Intro") + 1
    assert got[1] is None and got[2] is None


def test_section_lengths(spark):
    make = lambda n: "Overview\n" + "x" * n + "\nSummary\n" + "y" * 600
    got = apply(spark, sections.sections, make(199), make(200), make(16_001))
    assert [[s["section_type"] for s in g] for g in got] == [["discussion"], ["introduction", "discussion"], ["introduction", "discussion"]]
    assert len(got[2][0]["text"]) == 16_000


def plain_clean(t):
    """The cleaning chain in single steps, for texts without LaTeX."""
    t = re.sub(r"\n\s*(?:References|REFERENCES|Bibliography|BIBLIOGRAPHY)\s*\n.*", "", t, flags=re.S)
    t = re.sub(r"<[^>]+>", "", t)
    for p in (r"This article has been cited by other articles in PMC", r"Articles from .* are provided here courtesy of", r"External link\. Please review our privacy policy", r"Go to:"):
        t = re.sub(p, "", t, flags=re.I)
    t = re.sub(r"(?:©|Copyright|All rights reserved|Licensed under|Published by).*?(?:\n|$)", "", t, flags=re.I)
    t = re.sub(r"\S+@\S+\.\S+", "", re.sub(r"https?://\S+", "", t))
    t = re.sub(r"[^\S\n]+", " ", unicodedata.normalize("NFKC", t))
    return re.sub(r"\n{3,}", "\n\n", t).strip()


def test_cleaning_equals_single_steps(spark):
    import random

    r = random.Random(1)
    parts = ["a", "word", " ", "  ", "\n", "\n\n", "\t", "References", "Bibliography", "<p>", "<", ">", "</b >", "Go to:", "copyright 2", "©x", "http://x.y/z", "me@x.org", "@", "@@", ".", "x@y", "ﬁ", "½", "\u00a0", "\u2003", "é", "e\u0301", "😀"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(25))) for _ in range(600)] + ["", "   ", "\n References \n", "a@b.c", "@a@b.c", "a@b.", "x\n \n\nReferences\n\n y"]
    want = [plain_clean(t) for t in texts]
    assert apply(spark, text.clean_text, *texts) == want
    rows = spark.createDataFrame([(i, t, "pmc") for i, t in enumerate(texts)] + [(len(texts), None, "arxiv")], "i int, t string, s string")
    assert [x["cleaned"] for x in text.with_clean_text(rows, "t", "s").orderBy("i").collect()] == [*want, ""]


@pytest.mark.parametrize("run", [" ", "\n", "\t\n", "<", "x", "@", "1", "a@"])
def test_long_runs_take_linear_time(spark, run):
    t = "a" + run * (200_000 // len(run)) + "b"
    begin = time.monotonic()
    got = apply(spark, text.clean_text, t, "x. " + t + "c")
    assert all(x[0] in "ax" and x[-1] in "bc" for x in got if x)
    assert len(apply(spark, text.is_noise, run * 400, run * 400 + "z")) == 2
    assert time.monotonic() - begin < 20


def test_small_formats(spark):
    rows = spark.createDataFrame([("T ", " A", None), (None, "A", "B"), ("T", None, " ")], "t string, a string, b string")
    assert [x[0] for x in rows.select(text.candidate_text(F.col("t"), F.col("a"), F.col("b"))).collect()] == ["T. A", ". A B", "T."]
    assert apply(spark, text.doi_key, "10.1/X", None) == ["https://doi.org/10.1/X", None]
