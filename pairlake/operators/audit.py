"""Overlap between training data and evaluation sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAIR = ("a", "b")


def as_id(c: Column, mapped: Column | None = None) -> Column:
    """An integer id, else the mapped one, else null."""
    own = F.trim(c).try_cast("bigint")
    return own if mapped is None else F.coalesce(own, mapped)


def candidate_universe(papers: DataFrame, least_abstract: int = 50, least_citations: int = 5) -> DataFrame:
    """Ids of papers that training could have used."""
    return papers.where((F.length("abstract") >= least_abstract) & (F.coalesce("citationcount", F.lit(0)) >= least_citations)).select("corpusid")


def fulltext_universe(papers: DataFrame, fulltext: DataFrame) -> DataFrame:
    """Ids of papers with a full text, by DOI in lower case."""
    dois = fulltext.where(F.col("has_full_text")).select(F.lower("doi").alias("k")).distinct()
    return papers.select("corpusid", F.lower("doi").alias("k")).join(dois, "k", "left_semi").select("corpusid").distinct()


def task_ids(rows: DataFrame, mapping: DataFrame, column: str = "paper_id") -> DataFrame:
    """id, unresolved: distinct ids of a paper task (null where one can't be resolved)."""
    joined = rows.where(F.col(column).isNotNull()).select(F.col(column).alias("doc_id")).join(mapping, "doc_id", "left")
    return joined.select(as_id(F.col("doc_id"), F.col("corpus_id")).alias("id"))


def paper_overlap(ids: DataFrame, universe: DataFrame, distinct: bool = False) -> DataFrame:
    """n, overlap, percent: ids of a task that are in the universe (counting its repeats unless distinct)."""
    known = ids.where(F.col("id").isNotNull()).select("id").distinct()
    pool = universe.select(F.col("corpusid").alias("id"))
    hits = known.join(pool.distinct() if distinct else pool, "id").agg(F.count(F.lit(1)).alias("overlap"))
    total = ids.agg(F.count_distinct("id").alias("n"), F.sum(F.col("id").isNull().cast("long")).alias("unresolved"))
    return total.join(F.broadcast(hits)).select("n", F.coalesce("unresolved", F.lit(0)).alias("unresolved"), "overlap", percent(F.col("overlap"), F.col("n")))


def percent(x: Column, n: Column) -> Column:
    return F.round(100.0 * x / F.greatest(n, F.lit(1)), 2).alias("percent")


def undirected(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """Distinct edges with the smaller end first: an equi-join key for either direction."""
    return edges.select(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b")).distinct()


def edge_overlap(task_edges: DataFrame, citations: DataFrame, universe: DataFrame) -> DataFrame:
    """n, overlap, percent: task edges that are citations in either direction, both ends in the universe."""
    ids = universe.select("corpusid").distinct()
    inside = lambda e: e.join(ids.withColumnRenamed("corpusid", "a"), "a", "left_semi").join(ids.withColumnRenamed("corpusid", "b"), "b", "left_semi")
    wanted = task_edges.select("src", "dst").distinct()
    keyed = wanted.select("src", "dst", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    hits = inside(keyed).join(inside(undirected(citations, "citing", "cited")), list(PAIR), "left_semi")
    total = wanted.agg(F.count(F.lit(1)).alias("n"))
    return hits.agg(F.count_distinct(F.struct("src", "dst")).alias("overlap")).join(F.broadcast(total)).select("n", "overlap", percent(F.col("overlap"), F.col("n")))


def edge_universe(citations: DataFrame, universe: DataFrame) -> DataFrame:
    """How many citations have both ends in the universe."""
    ids = universe.select("corpusid").distinct()
    inside = citations.join(ids.withColumnRenamed("corpusid", "citing"), "citing", "left_semi").join(ids.withColumnRenamed("corpusid", "cited"), "cited", "left_semi")
    return inside.agg(F.count(F.lit(1)).alias("edges"))


def cold_filter(tasks: DataFrame, universe: DataFrame) -> DataFrame:
    """task, id of test rows that training could have seen."""
    return tasks.join(universe.select(F.col("corpusid").alias("id")).distinct(), "id", "left_semi").select("task", "id").distinct()


def apply_cold_filter(rows: DataFrame, cold: DataFrame, embedded: DataFrame | None = None) -> DataFrame:
    """Rows of task and id: test rows outside the cold set, other splits whole; only embedded ones if given."""
    kept = rows.join(cold.withColumn("split", F.lit("test")), ["task", "split", "id"], "left_anti")
    return kept if embedded is None else kept.join(embedded.select("id").distinct(), "id", "left_semi")


def edge_task(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """(query_id, cand_id, score) of an edge task -> src, dst, score, unresolved.

    Ends as in ``task_ids``; a row counts as unresolved if an end can't be resolved,
    unless both ends are null.
    """
    names = mapping.select(F.col("doc_id"), F.col("corpus_id"))
    ends = rows.join(names.select(F.col("doc_id").alias("query_id"), F.col("corpus_id").alias("q")), "query_id", "left")
    ends = ends.join(names.select(F.col("doc_id").alias("cand_id"), F.col("corpus_id").alias("c")), "cand_id", "left")
    ends = ends.withColumns({"src": as_id(F.col("query_id"), F.col("q")), "dst": as_id(F.col("cand_id"), F.col("c")), "score": F.trim(F.col("score").cast("string")).try_cast("double")})
    lost = (F.col("src").isNull() | F.col("dst").isNull()) & (F.col("query_id").isNotNull() | F.col("cand_id").isNotNull())
    return ends.select("src", "dst", "score", lost.alias("unresolved"))


def endpoints(edges: DataFrame) -> DataFrame:
    """id: distinct ends of the rows of ``edge_task`` that have both."""
    both = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull())
    return both.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def positives(edges: DataFrame) -> DataFrame:
    """src, dst: distinct edges with both ends and a score above 0."""
    return edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("score") > 0)).select("src", "dst").distinct()


def citation_counts(ids: DataFrame, papers: DataFrame) -> DataFrame:
    """id (with its repeats), count: 0 where a paper or its count is missing."""
    counts = papers.select(F.col("corpusid").alias("id"), "citationcount").dropDuplicates(["id"])
    return ids.select("id").join(counts, "id", "left").select("id", F.coalesce("citationcount", F.lit(0)).cast("long").alias("count"))


def impact(counts: DataFrame, cap: float = 0.99, high: float = 0.9) -> DataFrame:
    """The rows with log_count (counts capped at a percentile) and is_high: at or above a percentile of the positive ones, 0 without any."""
    limits = counts.agg(F.percentile("count", cap).alias("cap"), F.coalesce(F.percentile(F.when(F.col("count") > 0, F.col("count")), high), F.lit(0.0)).alias("high"))
    rows = counts.join(F.broadcast(limits))  # one row
    return rows.select("id", "count", F.log1p(F.least(F.col("count"), F.col("cap"))).alias("log_count"), (F.col("count") >= F.col("high")).alias("is_high"))
