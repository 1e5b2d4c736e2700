"""Text functions: cleaning, filters, tokens, formatting.

Regular expressions follow Unicode classes ("(?U)"), Unicode case folding where case
is ignored, and "." stopping only at a line feed ("(?d)"). They take time in proportion
to the text: a pattern that begins with a run (of white space, of other characters) is
held to the start of that run by a look-behind, and runs are possessive.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Patterns, phrases and prefixes of the data model.
REFERENCES = r"\n\s*+(?:References|REFERENCES|Bibliography|BIBLIOGRAPHY)\s*\n.*"
LATEX_CITATIONS = r"\\cite[a-z]*\{[^}]*\}"
LATEX_REFERENCES = r"\\(?:eq)?ref\{[^}]*\}|\\label\{[^}]*\}"
LATEX_ENVIRONMENTS = r"\\(?:begin|end)\{(?:document|figure|table|tabular|itemize|enumerate|description|thebibliography|abstract|acknowledgments?)\}"
LATEX_FORMATS = r"\\(?:textbf|textit|textrm|texttt|emph|underline)\{([^}]*)\}"
LATEX_SECTIONS = r"\\(?:sub)*section\*?\{([^}]*)\}"
LATEX_STRAY = r"\\(?:noindent|newpage|clearpage|bigskip|medskip|smallskip|\\)"
BOILERPLATE = r"(?:This article has been cited by other articles in PMC|Articles from .* are provided here courtesy of|External link\. Please review our privacy policy|Go to:)"
COPYRIGHT = r"(?:©|Copyright|All rights reserved|Licensed under|Published by).*?(?:\n|\z)"
LATEX_SOURCES = ("arxiv", "s2orc")
INTENT_PREFIXES = {"background": "cite_background", "methodology": "cite_method", "result": "cite_result"}
TASK_PREFIXES = ("search_query", "search_document", "classify", "cluster", "similarity")
NOISE = r"^(\s*+\[?\d++\]?\s*+[,;]?\s*+)++$|\bFig(?:ure)?\.?\s*\d+|\bTable\s*\d+|^et\s+al\b"
SENTENCE_BREAK = r"(?U)(?<=[.!?])\s++(?=[A-Z(])"


#: White space of Python and of the SQL: Unicode's, and the four separators of ASCII.
SPACES = "".join(map(chr, [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(c, F.lit(SPACES))


def remove_references(c: Column) -> Column:
    """Up to the first reference heading on a line of its own."""
    return F.regexp_replace(c, r"(?sU)(?<!\s)([^\S\n]*+)" + REFERENCES, "$1")


def clean_latex(c: Column) -> Column:
    """Without citations, references, environment tags and stray commands; formatted text and titles stay."""
    for pattern, by in (
        (LATEX_CITATIONS, ""),
        (LATEX_REFERENCES, ""),
        (LATEX_ENVIRONMENTS, ""),
        (LATEX_FORMATS, "$1"),
        (LATEX_SECTIONS, "\n$1\n"),
        (LATEX_STRAY, ""),
    ):
        c = F.regexp_replace(c, pattern, by)
    return c


def clean_xml(c: Column) -> Column:
    """Without tags; nothing after the last ">" can be one, so that stray "<" there are not tried."""
    rest = F.substring_index(c, ">", -1)
    whole = F.regexp_replace(F.substring(c, F.lit(1), F.length(c) - F.length(rest)), "<[^>]+>", "")
    return F.when(F.contains(c, F.lit(">")), F.concat(whole, rest)).otherwise(c)


def remove_boilerplate(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "(?iud)" + BOILERPLATE, ""), "(?iud)" + COPYRIGHT, "")


def remove_urls_emails(c: Column) -> Column:
    """An address is a run of other than white space with an "@" after its first character and a later dot inside."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)https?://\S+", ""), r"(?U)(?<!\S)\S[^\s@]*+@(?=\S+\.\S)\S++", "")


def _unchanged() -> str:
    """A character class of Latin, Greek, Cyrillic, punctuation and ideographs that NFKC leaves alone, whatever stands beside them."""
    ranges = [(0, 0x2FF), (0x370, 0x52F), (0x2010, 0x2027), (0x20A0, 0x20BF), (0x3001, 0x3029), (0x4E00, 0x9FFF)]
    fixed = [i for a, b in ranges for i in range(a, b + 1) if unicodedata.combining(chr(i)) == 0 and unicodedata.normalize("NFKC", chr(i)) == chr(i)]
    runs = []
    for i in fixed:
        if runs and runs[-1][1] == i - 1:
            runs[-1][1] = i
        else:
            runs.append([i, i])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in runs) + "]"


#: Texts of which Python makes NFKC at once.
NFKC_TEXTS = 256
UNCHANGED = rf"^{_unchanged()}*+\z"


@F.arrow_udf(StringType())
def _nfkc(texts: pa.Array) -> pa.Array:
    """NFKC part by part, so that few texts are Python strings at a time."""
    parts = [pa.array([x and unicodedata.normalize("NFKC", x) for x in texts.slice(i, NFKC_TEXTS).to_pylist()], pa.string()) for i in range(0, len(texts), NFKC_TEXTS)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def nfkc(c: Column) -> Column:
    """Unicode NFKC; Python gets a null for texts that it leaves alone."""
    return F.coalesce(_nfkc(F.when(~c.rlike(UNCHANGED), c)), c)


def collapse_space(c: Column) -> Column:
    """One space for white space other than line feeds, two line feeds for more, ends stripped."""
    return strip(F.regexp_replace(F.regexp_replace(c, r"(?U)[\s\x1c-\x1f&&[^\n]]+", " "), r"\n{3,}", "\n\n"))


def normalize_space(c: Column) -> Column:
    return collapse_space(nfkc(c))


def _stripped_of_markup(c: Column, source: Column | None) -> Column:
    c = remove_references(F.coalesce(c, F.lit("")))
    if source is not None:
        c = F.when(source.isin(*LATEX_SOURCES), clean_latex(c)).otherwise(c)
    return remove_urls_emails(remove_boilerplate(clean_xml(c)))


def clean_text(c: Column, source: Column | None = None) -> Column:
    """References, LaTeX (of sources that have it), tags, boilerplate, addresses, white space; null gives ''."""
    return normalize_space(_stripped_of_markup(c, source))


def with_clean_text(rows: DataFrame, text: str, source: str | None = None, name: str = "cleaned") -> DataFrame:
    """Rows with ``clean_text`` as a column: each step in a column of its own, so that none is evaluated twice."""
    rows = rows.withColumn(name, _stripped_of_markup(F.col(text), source and F.col(source)))
    rows = rows.withColumn("_nfkc", _nfkc(F.when(~F.col(name).rlike(UNCHANGED), F.col(name))))
    return rows.withColumn(name, collapse_space(F.coalesce("_nfkc", name))).drop("_nfkc")


def filter_context(c: Column, least: int = 50, most: int = 1_000) -> Column:
    """The stripped text if its length, word count and share of letters fit, else null."""
    s = strip(c)
    n = F.length(s)
    words = F.size(F.split(s, r"(?U)[\s\x1c-\x1f]+"))
    letters = F.length(F.regexp_replace(s, r"[^\p{L}]", ""))
    return F.when((n >= least) & (n <= most) & (words >= 3) & (2 * letters >= n), s)


def flat_strings(c: Column) -> Column:
    """A list of lists as one list; null lists and members go."""
    return F.coalesce(F.filter(F.flatten(F.filter(c, lambda x: x.isNotNull())), lambda x: x.isNotNull()), F.array().cast("array<string>"))


def intents_of(c: Column) -> Column:
    """Labels of a comma-separated string or a list: stripped, lower case, none empty."""
    return F.filter(F.transform(c, lambda x: F.lower(strip(x))), lambda x: x != "")


def intents_of_string(c: Column) -> Column:
    return intents_of(F.split(F.coalesce(c, F.lit("")), ","))


def prefixed(prefix: str, title: Column, body: Column) -> Column:
    """"prefix: T. A", null where a part is."""
    return F.concat(F.lit(prefix + ": "), title, F.lit(". "), body)


def task_prefixed(task: Column, c: Column) -> Column:
    """Prefix of a known task; unknown tasks have none."""
    return F.concat(F.when(task.isin(*TASK_PREFIXES), F.concat(task, F.lit(": "))).otherwise(""), c)


def candidate_text(*parts: Column, whole: bool = True) -> Column:
    """Title, abstract and body as "T. A B", each stripped, null as empty; the ``whole`` is stripped once more."""
    title, *rest = [strip(F.coalesce(p, F.lit(""))) for p in parts]
    joined = F.concat_ws(" ", F.concat(title, F.lit(".")), *rest)
    return strip(joined) if whole else joined


def tokens(c: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def trigrams(c: Column) -> Column:
    """The set of three-token windows."""
    return F.transform(
        F.array(tokens(c)),
        lambda t: F.when(
            F.size(t) >= 3,
            F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(t) - 3), lambda i: F.concat_ws(" ", F.get(t, i), F.get(t, i + 1), F.get(t, i + 2)))),
        ).otherwise(F.array().cast("array<string>")),
    )[0]


def overlap_ratio(s: Column, a: Column) -> Column:
    """Share of a set that another has; null for an empty set."""
    return F.when(F.size(s) > 0, F.size(F.array_intersect(s, a)) / F.size(s))


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, SENTENCE_BREAK), strip), lambda x: x != "")


def is_noise(c: Column) -> Column:
    """Reference marks alone, figures, tables, citation fragments."""
    return c.rlike("(?U)" + NOISE)


def middle_third(c: Column) -> Column:
    n = F.length(c)
    return F.substring(c, F.floor(n / 3).cast("int") + 1, (F.floor(2 * n / 3) - F.floor(n / 3)).cast("int"))


def title_words(c: Column) -> Column:
    """Words over three characters, lower case, outer punctuation stripped."""
    long = F.filter(F.split(F.lower(strip(c)), r"(?U)\s+"), lambda w: F.length(w) > 3)
    return F.array_distinct(F.transform(long, lambda w: F.regexp_replace(w, r"^[.,;:()\[\]]+|[.,;:()\[\]]+$", "")))


def title_overlap(context: Column, title: Column) -> Column:
    t = title_words(title)
    return F.coalesce(overlap_ratio(t, title_words(context)), F.lit(0.0))


def label_list(c: Column) -> Column:
    """Distinct labels of a list of lists, sorted and joined; a dash for none."""
    joined = F.array_join(F.array_sort(F.array_distinct(flat_strings(c))), ",")
    return F.when(joined == "", "—").otherwise(joined)


def doi_key(c: Column) -> Column:
    return F.concat(F.lit("https://doi.org/"), c)


def paraphrase(c: Column) -> Column:
    """First line of a generated answer, without the quotes around it."""
    line = F.get(F.split(strip(c), "\n"), F.lit(0))
    return F.regexp_replace(F.regexp_replace(strip(line), '^"+|"+$', ""), "^'+|'+$", "")
