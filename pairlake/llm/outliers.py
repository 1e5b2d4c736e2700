"""Quality rules and robust multivariate outliers.

Base rules count words, symbols, repeated lines and repeated three-word windows of
every whole text. What passes them is judged as a point of five transformed
statistics against the minimum-covariance-determinant estimate of its language and
source. Points are standardised by medians and MADs; three deterministic starts
(these alone, the covariance of hyperbolic tangents and that of spatial signs, as in
Hubert, Rousseeuw and Verdonck, "A deterministic algorithm for robust location and
scatter", 2012) each take concentration steps, mean and covariance of the 75 % of
points nearest under the last estimate, three at least, until a step in which no
determinant falls below its least, and a group keeps the estimate of the least one. The square of each statistic's
floor is added to its variance, so that determinants stay above zero and a statistic
that hardly varies rejects nothing by itself. A document whose Mahalanobis distance,
scaled to a chi-squared quantile, exceeds the cutoff is rejected; one at the cutoff
stays. Documents of a language and source with few are judged by the estimate of
all documents of their language, or of the whole table if the language has few too.

Only DataFrame operations are used. Words of a text are never exploded into rows:
windows are hashed, sorted and compared inside the row. Quantiles per group come
from counts on a fixed grid, which are the same in any order of rows and aggregate
before the shuffle; a step shuffles a few numbers per group, start and grid cell.

Defined results: a null or empty text has no words and fails the base rules. Null
languages and sources are values of their own. In a table of which fewer than ``LEAST_GROUP`` documents pass
the base rules, no estimate exists and these are kept. Repeated rows count and are
judged each. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, beside, cut, let, staged, with_small

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"

#: Share of a group that the estimate is taken from, and the chi-squared quantiles with five degrees of
#: freedom at that share and at 0.999999: fixed values.
SHARE, CHI_AT_SHARE, CUTOFF = 0.75, 6.6257, 35.888
#: Starts of each group, concentration steps that all take and that any may take, and the fall of a log-determinant that calls for another.
STARTS, FIRST_STEPS, MOST_STEPS, FALL = 3, 3, 10, 1e-6
LEAST_GROUP = 50
#: Least standard deviations of the statistics, so that one that hardly varies in a group cannot reject by itself.
FLOORS = (0.35, 0.05, 0.04, 0.5, 0.1)
D = len(FLOORS)

_LOW44 = (1 << 20) - 1


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE + "+"), "")  # white space at either end leaves an empty string


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more.

    Windows are ordered by 44 bits of their hash with the place in the lower 20
    bits, so that one sort of longs brings equal ones together; neighbours count as
    equal if all 64 bits agree. Texts of a million words or more carry struct keys.
    """

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.xxhash64(F.get(w, i - 1), F.get(w, i), F.get(w, i + 1)))

    def covered(places: Column) -> Column:
        """Words under windows at these ascending places."""
        step = lambda at, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1), at + 3) - at)
        return F.aggregate(F.transform(places, step), F.lit(0), lambda a, x: a + x)

    def packed(h: Column) -> Column:
        keyed = F.transform(h, lambda x, i: x.bitwiseAND(F.lit(~_LOW44)).bitwiseOR(i.cast("long")))

        def places(s: Column) -> Column:
            def same(x: Column, j: Column) -> Column:
                here = F.get(h, x.bitwiseAND(F.lit(_LOW44)).cast("int"))
                near = lambda k: (F.get(s, k).bitwiseXOR(x) <= _LOW44) & (F.get(s, k).bitwiseXOR(x) >= 0) & (F.get(h, F.get(s, k).bitwiseAND(F.lit(_LOW44)).cast("int")) == here)
                return (F.coalesce(near(j + 1), F.lit(False))) | ((j > 0) & F.coalesce(near(F.greatest(j - 1, F.lit(0))), F.lit(False)))

            return F.sort_array(F.transform(F.filter(s, same), lambda x: x.bitwiseAND(F.lit(_LOW44)).cast("int")))

        return let(let(F.sort_array(keyed), places), covered)

    def wide(h: Column) -> Column:
        keyed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = lambda x, j: (F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))) | ((j > 0) & (F.get(s, F.greatest(j - 1, F.lit(0)))["h"] == x["h"]))
            return F.sort_array(F.transform(F.filter(s, same), lambda x: x["i"]))

        return let(let(keyed, places), covered)

    per_row = lambda h: F.when(F.size(h) <= _LOW44, packed(h)).otherwise(wide(h))
    return let(words, lambda w: F.when(F.size(w) < 3, F.lit(0)).otherwise(let(windows(w), per_row)))


def statistics(docs: DataFrame, *others: str) -> DataFrame:
    """documents -> doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed; and any others."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    counted = docs.select("doc_id", "lang", "source", *others, text.alias("text")).select(
        "doc_id", "lang", "source", *others,
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        let(_words(F.col("text")), lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeat_words(w).cast("long").alias("n_repeat_words"),
        )).alias("w"),
    )
    counted = counted.select("doc_id", "lang", "source", *others, "w.n_words", "w.word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def vector() -> list[Column]:
    """The transformed statistics."""
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return [
        F.log1p(F.col("n_words").cast("double")),
        F.log(chars / words),
        F.sqrt(F.col("n_symbols") / chars),
        F.log1p(F.col("n_dup_lines").cast("double")),
        F.sqrt(F.col("n_repeat_words") / words),
    ]


POOL = ["g_lang", "g_source"]


def _pools(rows: DataFrame) -> DataFrame:
    """g_lang, g_source and the groups whose estimates their rows belong to; ``own`` marks the one that judges them.

    Without any group large enough, there are none.
    """
    by_lang = Window.partitionBy("g_lang")
    counts = cut(rows.groupBy(*POOL).agg(F.count(F.lit(1)).alias("n")))
    counts = counts.withColumn("lang_n", F.sum("n").over(by_lang)).withColumn("few", F.col("n") < LEAST_GROUP).withColumn("few_too", F.col("few") & (F.col("lang_n") < LEAST_GROUP))
    by_language = F.col("few") & ~F.col("few_too")
    seen = counts.agg(F.sum("n").alias("n"), F.max("few_too").alias("few_too")).first()
    whole = bool(seen["few_too"]) and seen["n"] >= LEAST_GROUP
    group = lambda name, own: F.struct(name.alias("g"), own.alias("own"))
    groups = [
        F.when(~F.col("few"), group(F.concat_ws("\1", F.lit("both"), *POOL), F.lit(True))),
        F.when(F.max(by_language).over(by_lang), group(F.concat_ws("\1", F.lit("lang"), "g_lang"), by_language)),
        F.when(F.lit(whole), group(F.lit("all"), F.col("few_too"))),
    ]
    return cut(counts.select(*POOL, F.array_compact(F.array(*groups)).alias("groups")))


def _quantile(rows: DataFrame, keys: list[str], cell: Column, share: float) -> DataFrame:
    """keys, q: the least grid cell such that ``share`` of the group is at or below it."""
    counts = rows.groupBy(*keys, cell.cast("long").alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*keys).orderBy("cell")
    counts = counts.withColumns({"up_to": F.sum("n").over(order), "of": F.sum("n").over(Window.partitionBy(*keys))})
    return counts.where(F.col("up_to") >= F.lit(share) * F.col("of")).groupBy(*keys).agg(F.min("cell").alias("q"))


#: Cells per unit of a statistic, and per doubling of a squared distance.
GRID, LOG_GRID = 512, 64


def _start(rows: DataFrame) -> DataFrame:
    """g, m0.., s0..: medians and MADs (with floors) of the statistics."""

    def middles(of: DataFrame, values: list[Column], name: str) -> DataFrame:
        long = of.select("g", F.posexplode(F.array(*values)).alias("i", "x"))
        cells = _quantile(long, ["g", "i"], F.floor(F.col("x") * GRID), 0.5).withColumn("x", (F.col("q") + 0.5) / GRID)
        return cut(cells.groupBy("g").agg(*[F.max(F.when(F.col("i") == i, F.col("x"))).alias(f"{name}{i}") for i in range(D)]))

    medians = middles(rows, [F.col(f"x{i}") for i in range(D)], "m")
    mads = middles(with_small(rows, medians, "g"), [F.abs(F.col(f"x{i}") - F.col(f"m{i}")) for i in range(D)], "s")
    return medians.join(mads, "g").select("g", *[f"m{i}" for i in range(D)], *[F.greatest(1.4826 * F.col(f"s{i}"), F.lit(FLOORS[i])).alias(f"s{i}") for i in range(D)])


_PAIRS = [(i, j) for i in range(D) for j in range(i + 1)]
_SUMS = [f"avg(z{i}) as c{i}" for i in range(D)] + [f"avg(z{i} * z{j}) as p{i}{j}" for i, j in _PAIRS] + [f"first(f{i}) as f{i}" for i in range(D)]


def _factors() -> list[str]:
    """Covariance, its Cholesky factor l, row by row, and the inverse of that by forward substitution, each from those before."""
    out = [f"p{i}{j} - c{i} * c{j} + {f'f{i} * f{i}' if i == j else '0'} as v{i}{j}" for i, j in _PAIRS]
    for i, j in _PAIRS:
        rest = f"(v{i}{j}" + "".join(f" - l{i}{k} * l{j}{k}" for k in range(j)) + ")"
        out.append(f"sqrt{rest} as l{i}{i}" if i == j else f"{rest} / l{j}{j} as l{i}{j}")
    for i, j in sorted(_PAIRS, key=lambda x: (x[1], x[0])):
        rest = f"({1.0 if i == j else 0.0}D" + "".join(f" - l{i}{k} * u{k}{j}" for k in range(j, i)) + ")"
        out.append(f"{rest} / l{i}{i} as u{i}{j}")
    return out


_FACTORS = _factors()
_ROUNDED = [f"round(c{i}, 9) as c{i}" for i in range(D)] + [f"round(u{i}{j}, 9) as w{i}{j}" for i, j in _PAIRS] + ["round(2 * (" + " + ".join(f"ln(l{i}{i})" for i in range(D)) + "), 9) as logdet"]


def _estimate(near: DataFrame) -> DataFrame:
    """Mean, inverse Cholesky factor and log-determinant of the covariance of z0..: g, start, c0.., w00, w10, .., logdet."""
    est = near.groupBy("g", "start").agg(*map(F.expr, _SUMS))
    return est.selectExpr("*", *_FACTORS).selectExpr("g", "start", *_ROUNDED)


def _numbers() -> list[str]:
    return [*[f"c{i}" for i in range(D)], *[f"w{i}{j}" for i in range(D) for j in range(i + 1)], "logdet"]


def _first_estimates(rows: DataFrame) -> DataFrame:
    """The estimates that the starts begin from, about the median: the MADs alone, tangents and spatial signs."""
    z = [F.col(f"z{i}") for i in range(D)]
    norm = F.greatest(F.sqrt(reduce(lambda a, b: a + b, [x * x for x in z])), F.lit(1e-9))
    alike = [F.lit(0.0)] * D + [F.lit(1.0 if i == j else 0.0) for i, j in _PAIRS] + [F.lit(0.0)]
    plain = rows.select("g").distinct().select("g", F.lit(0).alias("start"), *[x.alias(name) for x, name in zip(alike, _numbers())])
    moved = lambda f, start: rows.select("g", F.lit(start).alias("start"), *[f(x).alias(f"z{i}") for i, x in enumerate(z)], *[f"f{i}" for i in range(D)])
    others = _estimate(moved(F.tanh, 1).unionByName(moved(lambda x: x / norm * D**0.5, 2)))
    return cut(plain.unionByName(others.withColumns({f"c{i}": F.lit(0.0) for i in range(D)})))


#: Squared Mahalanobis distance of z0.. under c0.. and w00.., which the row has.
_DISTANCE = " + ".join("pow(" + " + ".join(f"w{i}{j} * (z{j} - c{j})" for j in range(i + 1)) + ", 2)" for i in range(D))


def _cell(d: Column) -> Column:
    return F.floor(F.log2(d + 1e-6) * LOG_GRID)


def _standardised() -> dict[str, Column]:
    return {f"z{i}": (F.col(f"x{i}") - F.col(f"m{i}")) / F.col(f"s{i}") for i in range(D)}


def estimates(rows: DataFrame) -> DataFrame:
    """g and x0.. of points -> g, medians m0.., MADs s0.., estimate c0.., w00.., and ``scale``, by which distances are divided
    so that ``SHARE`` of a group is below CHI_AT_SHARE."""
    start = cut(_start(rows))
    sent = start.count() * STARTS <= BROADCAST_ROWS  # all tables per group here are a few dozen numbers wide
    points = beside(rows, start, "g", sent).withColumns(_standardised() | {f"f{i}": F.lit(FLOORS[i]) / F.col(f"s{i}") for i in range(D)})
    points = points.select("g", *[f"z{i}" for i in range(D)], *[f"f{i}" for i in range(D)])
    started = points.withColumn("start", F.explode(F.array(*map(F.lit, range(STARTS)))))
    cells = lambda of, est, keys: beside(of, est, keys, sent).withColumn("cell", _cell(F.expr(_DISTANCE))).drop(*_numbers())
    est, keys, found = _first_estimates(points), ["g", "start"], []
    for step in range(MOST_STEPS):
        seen = cells(started, est, keys)
        limit = _quantile(seen, keys, F.col("cell"), SHARE)
        est = cut(_estimate(beside(seen, limit, keys, sent).where(F.col("cell") <= F.col("q"))))
        found.append(est)
        if step >= FIRST_STEPS:
            # points in the cell at the limit come and go together, so a determinant can also rise by a little
            before = reduce(DataFrame.unionByName, [e.select(*keys, "logdet") for e in found[:-1]]).groupBy(*keys).agg(F.min("logdet").alias("was"))
            if est.join(before, keys).where(F.col("was") - F.col("logdet") > FALL).isEmpty():
                break
    numbers = F.min_by(F.struct(*_numbers()), F.struct("logdet", "start"))
    best = cut(reduce(DataFrame.unionByName, found).groupBy("g").agg(numbers.alias("e")).select("g", "e.*"))
    limit = _quantile(cells(points, best, "g"), ["g"], F.col("cell"), SHARE)
    scale = F.greatest(F.lit(1.0), F.pow(F.lit(2.0), (F.col("q") + 0.5) / LOG_GRID) / CHI_AT_SHARE)
    return cut(start.join(best, "g").join(limit.select("g", scale.alias("scale")), "g"))


def _scaled(rows: DataFrame) -> DataFrame:
    """Rows with x0.. and their group's estimates -> ``d2``, the scaled squared distance; null without any."""
    return rows.withColumns(_standardised()).withColumn("d2", F.expr(f"({_DISTANCE}) / scale"))


def distances(rows: DataFrame) -> DataFrame:
    """Rows with g and x0.. -> the same rows with ``d2``."""
    return with_small(rows, estimates(rows.select("g", *[f"x{i}" for i in range(D)])), "g").transform(_scaled).select(*rows.columns, "d2")


def _pooled(stats: DataFrame) -> DataFrame:
    """Rows of ``statistics`` with the columns of their pool and x0.."""
    names = {"g_lang": F.coalesce("lang", F.lit("\0")), "g_source": F.coalesce("source", F.lit("\0"))}
    return stats.withColumns(names | {f"x{i}": x for i, x in enumerate(vector())})


def fitted(stats: DataFrame) -> DataFrame:
    """Rows of ``statistics`` -> for each language and source, the estimate that judges its documents (nulls where none does)."""
    rows = _pooled(stats.where(~F.col("base_failed"))).select(*POOL, *[f"x{i}" for i in range(D)])
    pools = _pools(rows)
    grouped = with_small(rows, pools, POOL).withColumn("p", F.explode("groups")).select("p.g", *[f"x{i}" for i in range(D)])
    own = pools.select(*POOL, F.get(F.filter("groups", lambda p: p["own"]), F.lit(0))["g"].alias("g"))
    return cut(own.join(estimates(staged(grouped, "vectors")), "g", "left"))


def verdicts(stats: DataFrame, model: DataFrame, *others: str, cutoff: float = CUTOFF) -> DataFrame:
    """Rows of ``statistics`` and their model -> doc_id, the counts, base_failed, kept, distance; and any others."""
    far = with_small(_pooled(stats), model, POOL, "left").transform(_scaled).withColumn("d2", F.when(~F.col("base_failed"), F.col("d2")))
    kept = ~F.col("base_failed") & F.coalesce(F.col("d2") <= cutoff, F.lit(True))
    return far.select(*others, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.round("d2", 4).alias("distance"))


def judged(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """documents -> doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance."""
    stats = staged(statistics(docs), "statistics")
    return verdicts(stats, fitted(stats), cutoff=cutoff)


def kept_rows(docs: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns: each row carries itself, so ids may be null or repeated."""
    whole = docs.withColumn("_row", F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    stats = staged(statistics(whole, "_row"), "statistics")
    return verdicts(stats, fitted(stats), "_row").where("kept").select("_row.*")
