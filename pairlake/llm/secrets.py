"""Secret scans: fixed patterns, and a randomness test battery with false-discovery control.

Three patterns give the base spans. The method looks at every other run of ``LEAST``
encoding characters or more, outside base spans; a run that fits no
encoding or does not look random is also split at its separators. The encoding with the smallest alphabet that has all
characters of a run is inferred (decimal digits are never secrets by themselves), and a battery
asks whether the run could be uniform over that alphabet: chi-squared of the
character counts, Wald-Wolfowitz runs about the alphabet's median, and lag-one
serial correlation. A run that any test rejects is not random.

Passing proves little for a short run, so each run also gets a p-value under the
opposite null, that it is written: its greatest likelihood under models of writing,
over its likelihood as a uniform draw from its alphabet. By Markov's inequality such
a ratio is below a with probability a at most, whichever of the models holds. The
models are chains of character classes (words and numbers keep to one class, title
case goes from upper to lower) with letters as frequent as in prose, so every
alphabet has power: by letter frequencies, by changes of class, or both. A run that a
test of the battery rejects has a p-value of one, so all three enter the control.
Of uniform keys that are one in a hundred runs of their length class, 90 % or more are
found from 28 characters on in every alphabet, 70 % at 20; runs under ``LEAST``
characters are not tested, as the battery tells little about them.
The Benjamini-Hochberg step over all runs of the corpus, within classes of length,
then bounds the share of false discoveries. Its table is a histogram of p-values by
length class, of fixed size whatever the corpus; p-values below 2**-99.5 share a cell and
count as its bound, which could matter to a step only beyond 2**89 runs.

Defined results: a null text is empty and has no spans. A null doc_id is reported as
such. Offsets are code points, the
end exclusive. Repeated rows are each scanned, and each counts in the histogram.
Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from math import erfc, exp, floor, log, log2, sqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, staged

#: Fixed values of the job: the base patterns and the least length of what must be long.
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_ASSIGN, LEAST_ACCESS = 8, 16
#: Kinds of spans, in the order in which they are listed at the same start.
KINDS = ("assign", "access", "hex", "random")

#: Runs that the method looks at, and the share of false discoveries and of missed uniform runs.
RUN = re.compile(r"[A-Za-z0-9+/_-]{20,}")
LEAST = 20
#: What is left of a run between separators of either kind.
SPLITS = (re.compile(r"[A-Za-z0-9+/]+"), re.compile(r"[A-Za-z0-9_-]+"))
DISCOVERY, MISSED = 0.001, 0.001
#: Cells of a p-value's base-two logarithm, and how far down they reach.
CELLS = 200

#: Inferred encodings, smallest alphabet first, with characters in the order of their values: fixed values.
ALPHABETS = (
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base62", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
#: Share of letters in prose of Latin script (English, German, French and Spanish on average), in thousandths: fixed values.
PROSE = dict(zip("abcdefghijklmnopqrstuvwxyz", (87, 16, 33, 44, 144, 15, 17, 31, 71, 4, 6, 44, 28, 78, 63, 23, 6, 66, 71, 70, 42, 11, 12, 3, 9, 6)))
#: Of the letters of other languages, names and abbreviations: a share that is spread evenly.
EVEN = 0.2
#: Models of writing: the chance of each class (lower, upper, digit, separator) after each class, as fixed values.
WRITING = (
    ((0.90, 0.03, 0.03, 0.04), (0.03, 0.90, 0.03, 0.04), (0.03, 0.03, 0.87, 0.07), (0.30, 0.30, 0.30, 0.10)),  # words of one case
    ((0.80, 0.08, 0.04, 0.08), (0.80, 0.12, 0.03, 0.05), (0.05, 0.05, 0.80, 0.10), (0.20, 0.50, 0.20, 0.10)),  # title and camel case
)
_LETTER = {c: log((1 - EVEN) * n / 1000 + EVEN / 26) for c, n in PROSE.items()}
#: Class and log-likelihood within the class of every character.
_CHARACTER = {c: (0, x) for c, x in _LETTER.items()} | {c.upper(): (1, x) for c, x in _LETTER.items()} | {c: (2, log(1 / 10)) for c in "0123456789"} | {c: (3, log(1 / 4)) for c in "+/_-"}
_CHANGE = tuple(tuple(tuple(map(log, row)) for row in model) for model in WRITING)


def upper_tail(z: float) -> float:
    return 0.5 * erfc(z / sqrt(2))


def chi_upper(x: float, k: int) -> float:
    """Upper tail of chi-squared by the Wilson-Hilferty cube root."""
    return upper_tail(((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / sqrt(2 / (9 * k)))


def encoding(run: str) -> tuple[str, str] | None:
    """Name and alphabet of the smallest encoding with all characters of a run; None for digits alone or no fit."""
    used = set(run)
    if used <= set("0123456789"):
        return None
    return next((x for x in ALPHABETS if used <= set(x[1])), None)


def battery(run: str) -> tuple[float, float] | None:
    """(least p-value of uniformity by the three tests, p-value of ordinary writing), None without an encoding.

    A run of one letter in all positions has no runs statistic and is not random.
    """
    found = encoding(run)
    if not found:
        return None
    alphabet = found[1]
    k, n = len(alphabet), len(run)
    value = {c: i for i, c in enumerate(alphabet)}
    x = [value[c] for c in run]
    counts: dict[int, int] = {}
    for v in x:
        counts[v] = counts.get(v, 0) + 1
    chi = k / n * sum(c * c for c in counts.values()) - n
    p_chi = chi_upper(max(chi, 1e-9), k - 1)
    high = [2 * v >= k for v in x]
    n1 = sum(high)
    n0 = n - n1
    if not n0 or not n1:
        p_runs = 0.0
    else:
        runs = 1 + sum(a != b for a, b in zip(high, high[1:]))
        mean = 1 + 2 * n0 * n1 / n
        variance = (mean - 1) * (mean - 2) / (n - 1)
        p_runs = 2 * upper_tail(abs(runs - mean) / sqrt(variance)) if variance > 0 else 0.0
    middle = sum(x) / n
    spread = sum((v - middle) ** 2 for v in x)
    serial = sum((a - middle) * (b - middle) for a, b in zip(x, x[1:])) / spread if spread else 1.0
    p_serial = 2 * upper_tail(abs(serial + 1 / n) * sqrt(n))
    return min(p_chi, p_runs, p_serial), written(run, k)


def written(run: str, k: int) -> float:
    """p-value of writing: greatest likelihood under the models over that of a uniform draw from k characters."""
    classes, within = zip(*map(_CHARACTER.__getitem__, run))
    change = max(sum(model[a][b] for a, b in zip(classes, classes[1:])) for model in _CHANGE)
    return exp(max(-700.0, min(0.0, log(1 / 4) + change + sum(within) + len(run) * log(k))))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, by start."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def length_class(n: int) -> int:
    return floor(2 * log2(n))


def cell_of(p: float) -> int:
    """The cell of a p-value, smaller values in higher cells; a cell stands for its largest value."""
    return CELLS - 1 if p <= 2.0 ** -(CELLS / 2) else min(CELLS - 1, floor(-2 * log2(p)))


def tested(run: str, start: int, out: dict[tuple[int, int], tuple[int, int, int, int, bool]]) -> None:
    """Put the runs to judge in a run at ``start`` into ``out``, by place.

    A run that looks uniform over an alphabet is judged as a whole. Else a key can be
    joined to something by separators, which are those of the other 64-letter alphabet
    or lie between words: the run is split at "-" and "_" and, again as a whole, at "+"
    and "/", and its pieces are treated alike. Pieces of the two splits can overlap.
    """
    if len(run) < LEAST or (start, start + len(run)) in out:
        return
    tests = battery(run)
    if tests:
        uniform = tests[0] * 3 >= MISSED
        out[start, start + len(run)] = (start, start + len(run), length_class(len(run)), cell_of(tests[1] if uniform else 1.0), uniform)
        if uniform:
            return
    for separators in SPLITS:
        pieces = list(separators.finditer(run))
        if len(pieces) > 1 or len(pieces[0][0] if pieces else "") < len(run):
            for m in pieces:
                tested(m[0], start + m.start(), out)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, bool]]:
    """(start, end, length class, cell, uniform) of the runs, without what base spans cover.

    A run of any length is judged as a whole first, in time in proportion to it; splits
    go at most three levels deep, as each takes two separators away.
    """
    out: dict[tuple[int, int], tuple[int, int, int, int, bool]] = {}
    passed, reach = 0, 0
    for m in RUN.finditer(text):
        free, start = [], max(m.start(), reach)
        while passed < len(base) and base[passed][0] < m.end():  # both go from left to right
            free.append((start, base[passed][0]))
            reach = max(reach, base[passed][2])
            start = max(start, reach)
            passed += 1
        for start, stop in [*free, (start, m.end())]:
            tested(text[start:stop], start, out)
    return sorted(out.values())


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


RUNS = "array<struct<start:int,end:int,length_class:int,cell:int,uniform:boolean>>"
SCANNED = f"doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, base string, runs {RUNS}"
_RUN_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("length_class", pa.int32()), ("cell", pa.int32()), ("uniform", pa.bool_())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n: list[list[int]] = [[], [], []]
        digest, listed, runs = [], [], []
        for text in batch.column("text"):
            text = text.as_py() or ""
            base = base_spans(text)
            for k in range(3):
                n[k].append(sum(1 for s in base if s[1] == k))
            listed.append(joined(base))
            digest.append(hashlib.sha256(listed[-1].encode()).hexdigest())
            runs.append([dict(zip(("start", "end", "length_class", "cell", "uniform"), c)) for c in candidates(text, base)])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *[pa.array(x, pa.int64()) for x in n], pa.array(digest, pa.string()), pa.array(listed, pa.string()), pa.array(runs, _RUN_TYPE)],
            ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "base", "runs"],
        )


def discovery_cells(histogram: DataFrame) -> dict[int, int]:
    """Benjamini-Hochberg per length class: the lowest cell whose p-values are discoveries.

    ``histogram`` has (length_class, cell, n): at most CELLS rows for each of a few
    dozen classes. A cell's p-values count as its largest.
    """
    rows: dict[int, dict[int, int]] = {}
    for r in histogram.collect():
        rows.setdefault(r["length_class"], {})[r["cell"]] = r["n"]
    out = {}
    for k, cells in rows.items():
        total, below, lowest = sum(cells.values()), 0, CELLS
        for cell in sorted(cells, reverse=True):
            below += cells[cell]
            if 2.0 ** (-cell / 2) <= DISCOVERY * below / total:
                lowest = cell
        out[k] = lowest
    return out


def scan(docs: DataFrame) -> DataFrame:
    """documents -> doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random.

    ``spans`` lists base spans and the method's, as kind:start:end.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan, SCANNED)
    rows = staged(rows, "secret-runs")  # a few numbers per document: texts are read once
    seen = rows.select(F.explode("runs").alias("r")).select("r.*")
    cells = discovery_cells(cut(seen.groupBy("length_class", "cell").agg(F.count(F.lit(1)).alias("n"))))
    table = F.array(*[F.lit(cells.get(k, CELLS)) for k in range(max(cells, default=0) + 1)])
    random = F.filter("runs", lambda r: r["uniform"] & (r["cell"] >= F.get(table, r["length_class"])))
    named = lambda kind, start, end: F.struct(start.cast("int").alias("s"), F.lit(kind).alias("k"), end.cast("int").alias("e"))
    part = lambda x, i: F.split(x, ":")[i]
    base = F.transform(
        F.filter(F.split("base", ","), lambda x: x != ""),
        lambda x: F.struct(part(x, 1).cast("int").alias("s"), (F.array_position(F.array(*map(F.lit, KINDS)), part(x, 0)) - 1).cast("int").alias("k"), part(x, 2).cast("int").alias("e")),
    )
    spans = F.array_sort(F.concat(base, F.transform(random, lambda r: named(KINDS.index("random"), r["start"], r["end"]))))
    text = F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(F.array(*map(F.lit, KINDS)), s["k"]), s["s"], s["e"])), ",")
    return rows.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", text.alias("spans"), F.size(random).cast("long").alias("n_random"))


def redact(text: str | None, spans: str, mark: str = "[SECRET]") -> str | None:
    """A text with its spans (as ``scan`` lists them) replaced by a mark; overlapping spans become one."""
    if not text or not spans:
        return text
    out, done = [], 0
    for start, end in sorted(tuple(map(int, s.split(":")[1:])) for s in spans.split(",")):
        if start >= done:
            out += [text[done:start], mark]
        done = max(done, end)
    return "".join([*out, text[done:]])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs by length class and cell, a few rows for each batch."""
    for batch in batches:
        seen: Counter[tuple[int, int]] = Counter()
        for text in batch.column("text"):
            text = text.as_py() or ""
            seen.update((k, cell) for _, _, k, cell, _ in candidates(text, base_spans(text)))
        columns = [[x[i] for x in seen] for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int32()) for c in columns], pa.array(list(seen.values()), pa.int64())], ["length_class", "cell", "n"])


def spans_of(text: str, cells: dict[int, int]) -> str:
    """All spans of a text, listed, given the cells of discoveries."""
    base = base_spans(text)
    random = [(s, KINDS.index("random"), e) for s, e, k, cell, uniform in candidates(text, base) if uniform and cell >= cells.get(k, CELLS)]
    return joined([*base, *random])


def redacted(docs: DataFrame) -> DataFrame:
    """Documents with what ``scan`` finds in each row's text replaced by a mark, and n_chars counted anew where it exists.

    Two passes over the texts, one for the histogram and one in which each row is
    scanned and redacted by itself: nothing is joined, so ids do not matter.
    """
    counts = docs.select("text").mapInArrow(_counts, "length_class int, cell int, n long")
    cells = discovery_cells(counts.groupBy("length_class", "cell").agg(F.sum("n").alias("n")))

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.schema.get_field_index("text")
            texts = [t and redact(t, spans_of(t, cells)) for t in (t.as_py() for t in batch.column("text"))]
            yield batch.set_column(i, batch.schema.field(i), pa.array(texts, batch.schema.field(i).type))

    out = docs.mapInArrow(replace, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(out.schema["n_chars"].dataType)) if "n_chars" in out.columns else out
