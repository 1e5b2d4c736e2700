"""Catalog of Parquet directories as named views, and readers of shard folders."""

from __future__ import annotations

import logging
import os
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger(__name__)

#: View -> folder under the data root: a fixed layout.
VIEWS = {
    "fulltext_papers": "fulltext/papers",
    "s2ag_papers": "s2ag/papers",
    "s2ag_abstracts": "s2ag/abstracts",
    "s2ag_citations": "s2ag/citations",
    "s2ag_tldrs": "s2ag/tldrs",
    "openalex_works": "openalex/works",
    "openalex_works_topics": "openalex/works_topics",
    "openalex_topics": "openalex/topics",
    "openalex_works_related_works": "openalex/works_related_works",
}
MISSING = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def root(path: str | None = None) -> str | None:
    """Data root: the argument, else the environment."""
    return path or os.environ.get("DATALAKE_PARQUET_ROOT")


class Catalog:
    """Views over a data root. Missing folders are skipped with a warning."""

    def __init__(self, spark: SparkSession, path: str | None = None, views: dict[str, str] | None = None) -> None:
        self.spark, self.path, self.views = spark, root(path), views or VIEWS
        self.found: list[str] = []

    def register(self) -> list[str]:
        """Names of the views that exist now. Folder names never become columns."""
        for name, folder in self.views.items():
            df = read_shards(self.spark, f"{self.path}/{folder}", merge=False)
            if df is None:
                log.warning("no %s under %s", folder, self.path)
                continue
            df.createOrReplaceTempView(name)
            self.found.append(name)
        return self.found

    def register_frame(self, name: str, rows: DataFrame | list[tuple], schema: str | None = None) -> DataFrame:
        """A frame, or rows in memory, as a view."""
        df = rows if isinstance(rows, DataFrame) else self.spark.createDataFrame(rows, schema)
        df.createOrReplaceTempView(name)
        return df

    def query(self, sql: str, args: list[Any] | dict[str, Any] | None = None) -> DataFrame:
        """A statement with positional or named parameters; stays a DataFrame until someone collects it."""
        return self.spark.sql(sql, args=args)

    def table(self, name: str, query: DataFrame, path: str, fresh: bool = False) -> DataFrame:
        """Write a query's rows and read them as a view; rows that are there already stay, unless ``fresh``."""
        query.write.mode("overwrite" if fresh else "ignore").parquet(path)
        df = self.spark.read.parquet(path)
        df.createOrReplaceTempView(name)
        return df


def read_shards(spark: SparkSession, path: str, pattern: str = "*.parquet", columns: list[str] | None = None, merge: bool = True) -> DataFrame | None:
    """Shards that match, schemas merged; None for a folder that is missing or has none."""
    try:
        df = spark.read.option("mergeSchema", str(merge).lower()).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").parquet(path)
    except AnalysisException as e:
        if e.getCondition() in MISSING:
            return None
        raise
    return df.select(*columns) if columns else df


def read_results(spark: SparkSession, path: str, excluded: tuple[str, ...] = ("baseline_results.json",)) -> DataFrame:
    """(model, document): JSON result files of a folder, named by their stems."""
    name = F.regexp_extract(F.col("_metadata.file_name"), r"([^/]*)\.json$", 1)
    df = spark.read.option("wholetext", "true").option("pathGlobFilter", "*.json").text(path).select(name.alias("model"), F.col("value").alias("document"), F.col("_metadata.file_name").alias("file"))
    return df.where(~F.col("file").isin(*excluded)).drop("file")


def find_task_results(spark: SparkSession, path: str, task: str) -> DataFrame:
    """(path, document) of "<task>.json" anywhere below a folder; the first by path for each model folder."""
    df = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", f"{task}.json").text(path)
    df = df.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("document"))
    model = F.regexp_extract(F.substring(F.col("path"), F.locate(path.rstrip("/"), F.col("path")) + len(path.rstrip("/")), F.length("path")), "^/([^/]+)", 1)
    return df.withColumn("model", model).groupBy("model").agg(F.min("path").alias("path"), F.min_by("document", "path").alias("document"))
