"""Papers and the citation graph."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from . import sampling, texts

#: Pairs of ids that one task may make distinct.
TASK_PAIRS = 2_000_000


def paper_pool(papers: DataFrame, abstracts: DataFrame | None = None, preview: int = 512, least: int = 50) -> DataFrame:
    """Titled papers with an abstract long enough: corpusid, title, abstract_preview, field_of_study, citationcount."""
    rows = papers if abstracts is None else papers.join(abstracts, "corpusid")
    rows = rows.where(F.col("title").isNotNull() & (F.length("abstract") >= least))
    count = F.coalesce("citationcount", F.lit(0)) if "citationcount" in rows.columns else F.lit(0)
    return rows.select("corpusid", "title", F.substring("abstract", 1, preview).alias("abstract_preview"), "field_of_study", count.cast("long").alias("citationcount"))


def tier(edges: DataFrame, influential: bool | None) -> DataFrame:
    """Edges of one tier, null in neither; None for all."""
    return edges if influential is None else edges.where(F.col("isinfluential") == F.lit(influential))


def within(edges: DataFrame, pool: DataFrame, least_citations: int = 0) -> DataFrame:
    """Edges with both ends in the pool (and cited often enough)."""
    ids = pool if least_citations <= 0 else pool.where(F.coalesce("citationcount", F.lit(0)) >= least_citations)
    ids = ids.select("corpusid")
    return edges.join(ids.withColumnRenamed("corpusid", "citing"), "citing", "left_semi").join(ids.withColumnRenamed("corpusid", "cited"), "cited", "left_semi")


def partitioned(edges: DataFrame, workers: int, worker: int) -> DataFrame:
    """The edges of one worker out of several."""
    return edges.where(F.col("citing") % workers == worker)


def first_k(rows: DataFrame, by: str, order: list[str], k: int) -> DataFrame:
    """At most k rows of each group, in a stated order."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rn") <= k).drop("rn")


def forward_adjacency(edges: DataFrame, k: int = 20) -> DataFrame:
    """citing, cited_ids: at most k references of each paper, by (cited, citationid); repeated edges stay."""
    kept = first_k(edges.select("citing", "cited", "citationid"), "citing", ["cited", "citationid"], k)
    return kept.groupBy("citing").agg(F.transform(F.sort_array(F.collect_list(F.struct("cited", "citationid"))), lambda s: s["cited"]).alias("cited_ids"))


def citing_pool(edges: DataFrame, n: int, seed: int) -> DataFrame:
    """n distinct citing papers (all if there are fewer)."""
    return sampling.exact(edges.where(F.col("citing").isNotNull() & F.col("cited").isNotNull()).select("citing").distinct(), n, seed, "citing")


def tasks_for(rows: DataFrame, n: float, per_task: int) -> int:
    """Tasks for n rows, so that none has many more than ``per_task``; all cores get one."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(n / per_task))


def cocitation(edges: DataFrame, k: int = 10, pool: DataFrame | None = None) -> DataFrame:
    """Distinct pairs x < y that some paper (of a pool, if given) cites together, from its first k citations by id.

    Tasks grow in number with the edges: an edge makes at most (k - 1) / 2 pairs.
    """
    edges = edges.where(F.col("cited").isNotNull()).select("citing", "cited", "citationid")
    n = tasks_for(edges, edges.count() * (k - 1) / 2, TASK_PAIRS)
    edges = edges if pool is None else edges.join(pool.select("citing"), "citing", "left_semi")
    refs = first_k(edges.repartition(n, "citing"), "citing", ["citationid", "cited"], k).drop("citationid")
    x, y = refs.withColumnRenamed("cited", "x"), refs.withColumnRenamed("cited", "y")
    return x.join(y, "citing").where(F.col("x") < F.col("y")).select("x", "y").repartition(n, "x", "y").distinct()


def enriched(pairs: DataFrame, papers: DataFrame, left: str, right: str, preview: int | None = None, least: int = 50, most: int = 5_000, many: bool = False) -> DataFrame:
    """Pairs of ids with formatted texts of both ends, abstracts within the length range.

    ``many`` is for narrow pairs of which a paper has dozens: see ``texts.with_texts``. Else pairs
    whose right end has no text go before they take up a text of the left one.
    """
    body = F.col("abstract") if preview is None else F.substring("abstract", 1, preview)
    side = papers.where(F.col("title").isNotNull() & F.length("abstract").between(least, most))
    anchor = side.select(F.col("corpusid").alias(left), text.prefixed("search_query", F.col("title"), body).alias("anchor"))
    positive = side.select(F.col("corpusid").alias(right), text.prefixed("search_document", F.col("title"), body).alias("positive"))
    return texts.with_texts(pairs if many else pairs.join(positive.select(right), right, "left_semi"), anchor, positive, few=not many)


def hop_lists(edges: DataFrame, adjacency: DataFrame) -> DataFrame:
    """citing, cited, hops: per edge the distinct papers that the cited one cites, other than its ends."""
    lists = adjacency.select(F.col("citing").alias("cited"), F.array_distinct("cited_ids").alias("hops"))
    rows = edges.select("citing", "cited").distinct().join(lists, "cited")
    return rows.withColumn("hops", F.filter("hops", lambda h: (h != F.col("citing")) & (h != F.col("cited"))))


def two_hop(edges: DataFrame, adjacency: DataFrame) -> DataFrame:
    """citing, cited, hop: papers that a cited paper cites, other than the citing and the cited one.

    ``adjacency`` has a row per paper, so edges taken once and lists without repeats give each row once.
    """
    return hop_lists(edges, adjacency).select("citing", "cited", F.explode("hops").alias("hop"))
