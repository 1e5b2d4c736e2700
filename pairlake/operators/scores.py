"""Aggregation of task scores over models, seeds and categories."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The benchmark's tasks by category, and each one's metric.
CATEGORIES = {
    "classification": ("Biomimicry", "DRSM", "SciDocs MAG", "SciDocs MeSH", "MeSH", "Fields of study"),
    "regression": ("Peer Review Score", "Max hIndex", "Tweet Mentions", "Citation Count", "Publication Year"),
    "proximity": ("SciDocs Cite", "SciDocs CoView", "SciDocs CoCite", "SciDocs CoRead", "Same Author Detection", "Highly Influential Citations"),
    "search": ("RELISH", "NFCorpus", "TREC-CoVID", "Search"),
}
METRICS = {
    "Biomimicry": "f1", "DRSM": "f1_macro", "SciDocs MAG": "f1_macro", "SciDocs MeSH": "f1_macro", "MeSH": "f1_macro", "Fields of study": "f1_macro",
    "Peer Review Score": "kendalltau", "Max hIndex": "kendalltau", "Tweet Mentions": "kendalltau", "Citation Count": "kendalltau", "Publication Year": "kendalltau",
    "SciDocs Cite": "map", "SciDocs CoView": "map", "SciDocs CoCite": "map", "SciDocs CoRead": "map", "Same Author Detection": "map", "Highly Influential Citations": "map",
    "RELISH": "ndcg", "NFCorpus": "ndcg", "TREC-CoVID": "ndcg", "Search": "ndcg",
}
REVIEWERS, REVIEWER_METRICS = "Paper-Reviewer Matching", ("hard_P_5", "hard_P_10", "soft_P_5", "soft_P_10")


def dimension(spark) -> DataFrame:
    """task, category, metric."""
    rows = [(t, c, METRICS[t]) for c, ts in CATEGORIES.items() for t in ts]
    return spark.createDataFrame(rows, "task string, category string, metric string")


def json_metric(document: Column, task: Column, metric: Column) -> Column:
    """A metric of a task in a result document, under "complete" first; null where missing."""
    own = F.try_element_at(F.from_json(document, "map<string,string>"), task)
    full = F.try_element_at(F.from_json(F.get_json_object(own, "$.complete"), "map<string,string>"), metric)
    plain = F.try_element_at(F.from_json(own, "map<string,string>"), metric)
    return F.when(F.get_json_object(own, "$.complete").isNotNull(), full).otherwise(plain).try_cast("double")


def primary_scores(results: DataFrame, tasks: DataFrame) -> DataFrame:
    """(model, document) -> model, task, category, score."""
    rows = results.join(F.broadcast(tasks))  # a few dozen tasks
    return rows.select("model", "task", "category", json_metric(F.col("document"), F.col("task"), F.col("metric")).alias("score")).where("score is not null")


def reviewer_scores(results: DataFrame) -> DataFrame:
    """model, score: mean of the four sub-metrics, null if one is missing."""
    parts = [json_metric(F.col("document"), F.lit(REVIEWERS), F.lit(m)) for m in REVIEWER_METRICS]
    return results.select("model", ((parts[0] + parts[1] + parts[2] + parts[3]) / 4).alias("score"))


def category_means(scores: DataFrame) -> DataFrame:
    return scores.groupBy("model", "category").agg(F.avg("score").alias("mean"))


def macro_average(scores: DataFrame) -> DataFrame:
    """model, macro: mean of category means; empty categories and those averaging 0 left out."""
    return category_means(scores).where(F.col("mean") > 0).groupBy("model").agg(F.avg("mean").alias("macro"))


def macro_all_categories(scores: DataFrame, n: int = 4) -> DataFrame:
    """model, macro: an empty category counts 0."""
    return category_means(scores).groupBy("model").agg((F.sum("mean") / n).alias("macro"))


def task_mean(scores: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """model, macro: mean of all task scores, with the extra ones (model, score)."""
    rows = scores.select("model", "score")
    rows = rows if extra is None else rows.unionByName(extra.select("model", "score"))
    return rows.groupBy("model").agg(F.avg("score").alias("macro"))


def macro_with_extra(scores: DataFrame, extra: DataFrame) -> DataFrame:
    """model, macro: the categories and one more of the extra scores."""
    rows = category_means(scores).select("model", "mean").unionByName(extra.where("score is not null").select("model", F.col("score").alias("mean")))
    return rows.groupBy("model").agg(F.avg("mean").alias("macro"))


def ordered(means: DataFrame) -> DataFrame:
    """Models by macro score, best first; equal ones share a place."""
    return means.withColumn("place", F.rank().over(Window.orderBy(F.col("macro").desc())))


def seed_pivot(scores: DataFrame, dims: list[int], base: int) -> DataFrame:
    """model and for each size its mean, sample deviation over seeds (0 for one) and per cent of the base size's mean."""
    rows = scores.groupBy("model", "dim").agg(F.avg("score").alias("mean"), F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("std"))
    wide = rows.groupBy("model").pivot("dim", dims).agg(F.first("mean").alias("mean"), F.first("std").alias("std"))
    return wide.select("model", *[F.col(f"{d}_{s}").alias(f"{s}_{d}") for d in dims for s in ("mean", "std")], *[(100 * F.col(f"{d}_mean") / F.col(f"{base}_mean")).alias(f"percent_{d}") for d in dims])


def task_by_model(scores: DataFrame, models: list[str]) -> DataFrame:
    """A column per model: 100 times the score, two places."""
    return scores.groupBy("task").pivot("model", models).agg(F.round(100 * F.first("score"), 2))


def task_variance(scores: DataFrame, least_models: int = 5) -> DataFrame:
    """task, n, mean, population std, range and a flag: STUCK under 1, DISCRIM over 3."""
    out = scores.groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), (F.max("score") - F.min("score")).alias("spread"))
    return out.where(F.col("n") >= least_models).withColumn("flag", F.when(F.col("std") < 1, "STUCK").when(F.col("std") > 3, "DISCRIM").otherwise(""))


def without_stuck(scores: DataFrame, least_models: int = 5) -> DataFrame:
    """Scores of the tasks that tell models apart."""
    return scores.join(task_variance(scores, least_models).where(F.col("flag") != "STUCK").select("task"), "task", "left_semi")


def seed_decomposition(scores: DataFrame, own: str, base: str) -> DataFrame:
    """task, means and population deviations over seeds of two models, their difference; greatest first."""
    rows = scores.groupBy("task", "model").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"))
    one = rows.where(F.col("model") == own).select("task", F.col("mean").alias("own_mean"), F.col("std").alias("own_std"))
    two = rows.where(F.col("model") == base).select("task", F.col("mean").alias("base_mean"), F.col("std").alias("base_std"))
    return one.join(two, "task").withColumn("delta", F.col("own_mean") - F.col("base_mean")).orderBy(F.col("delta").desc(), "task")


def losses(delta: DataFrame, n: int = 5) -> DataFrame:
    """The tasks of ``best_baseline`` where the own model is furthest behind."""
    return delta.where(F.col("delta") < 0).orderBy("delta", "task").limit(n)


def best_baseline(scores: DataFrame, own: str) -> DataFrame:
    """task, own score, best other model (first by name among equals), delta."""
    one = scores.where(F.col("model") == own).select("task", F.col("score").alias("own"))
    order = Window.partitionBy("task").orderBy(F.col("score").desc(), "model")
    rest = scores.where(F.col("model") != own).withColumn("rn", F.row_number().over(order)).where("rn = 1")
    return one.join(rest.select("task", F.col("model").alias("best_model"), F.col("score").alias("best")), "task").withColumn("delta", F.col("own") - F.col("best"))


def smoothed(rows: DataFrame, by: str, order: str, value: str, weight: float) -> DataFrame:
    """by, order, value, ema: s = w * s_before + (1 - w) * v, from the first value on.

    A recursion along a series, which a window can't say; a series (a training log) is one task's.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        return pdf.assign(ema=pdf[value].astype("float64").ewm(alpha=1 - weight, adjust=False).mean())

    return rows.select(by, order, value).groupBy(by).applyInPandas(run, f"{by} {kinds[by]}, {order} {kinds[order]}, {value} {kinds[value]}, ema double")


def distribution(rows: DataFrame, value: str) -> DataFrame:
    """value, share: the empirical distribution function at each distinct value."""
    counts = rows.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    order = Window.orderBy(value)
    total = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return counts.select(value, (F.sum("n").over(order) / total).alias("share"))


def length_stats(rows: DataFrame, value: str, limits: tuple[int, ...] = (512, 2_048, 8_192), *by: str) -> DataFrame:
    """n, median, p90, p95, p99, max and shares over the limits."""
    q = F.percentile(F.col(value), F.array(*[F.lit(x) for x in (0.5, 0.9, 0.95, 0.99)]))
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), q.alias("q"), F.max(value).alias("max"), *[F.avg((F.col(value) > x).cast("double")).alias(f"over_{x}") for x in limits])
    return out.select(*by, "n", *[F.get("q", F.lit(i)).alias(f"p{p}") for i, p in enumerate((50, 90, 95, 99))], "max", *[F.round(f"over_{x}", 6).alias(f"over_{x}") for x in limits])


def top_labels(rows: DataFrame, label: str, n: int = 8) -> DataFrame:
    return rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), label).limit(n)
