"""Sharded outputs, their indexes, statistics and reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_shards(rows: DataFrame, path: str, shard_rows: int = 500_000, compression: str = "zstd", mode: str = "overwrite", by: str | None = None) -> None:
    """Parquet files of at most ``shard_rows`` rows; one sub-folder for each value of ``by``."""
    writer = rows.write.mode(mode).option("maxRecordsPerFile", shard_rows).option("compression", compression)
    (writer.partitionBy(by) if by else writer).parquet(path)


def write_query(rows: DataFrame, path: str) -> None:
    """One snappy Parquet folder."""
    rows.write.mode("overwrite").option("compression", "snappy").parquet(path)


def write_tokens(rows: DataFrame, path: str, shard_mb: int = 256) -> None:
    """input_ids and attention_mask arrays, in files of about ``shard_mb`` (8 193 numbers make about 40 KB)."""
    per_row = 40 * 1024
    write_shards(rows.select("input_ids", "attention_mask"), path, max(1, shard_mb * 1024 * 1024 // per_row))


def write_stats(stats: DataFrame, path: str) -> None:
    stats.write.mode("overwrite").json(path)


def index(spark: SparkSession, path: str) -> DataFrame:
    """file, bytes, samples of each shard, in the order of their paths; samples are null where a shard can't be read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path)
    files = files.select("path", F.regexp_extract("path", "([^/]*)$", 1).alias("file"), F.col("length").alias("bytes"))
    df = spark.read.option("ignoreCorruptFiles", "true").option("recursiveFileLookup", "true").parquet(path)
    counts = df.groupBy(F.regexp_extract(F.col("_metadata.file_path"), "([^/]*)$", 1).alias("file")).agg(F.count(F.lit(1)).alias("samples"))
    return files.join(counts, "file", "left").orderBy("path").select("file", "bytes", "samples")


def shard_index(shards: DataFrame, compression: str = "zstd", size_limit: int = 256 * 1024 * 1024) -> str:
    """The index of token shards as a JSON document: version 2, an entry for each shard that can be read.

    An index lists files, so its length is theirs; rows stay where they are.
    """
    entries = [
        {
            "column_names": ["attention_mask", "input_ids"], "compression": compression, "format": "parquet", "hashes": [],
            "raw_data": {"basename": r["file"].rsplit(".", 1)[0], "bytes": 0, "hashes": {}}, "samples": r["samples"], "size_limit": size_limit,
            "version": 2, "zip_data": {"basename": r["file"], "bytes": r["bytes"], "hashes": {}},
        }
        for r in shards.where("samples is not null").toLocalIterator()
    ]
    return json.dumps({"version": 2, "shards": entries}, indent=2)


def merged(*parts: DataFrame) -> DataFrame:
    """Worker outputs as one frame; columns that a part lacks are null."""
    out = parts[0].select("*")
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def report(rows: DataFrame, path: str, title: str) -> str:
    """JSON lines beside a Markdown table of a small report; returns the Markdown."""
    rows.coalesce(1).write.mode("overwrite").json(path)
    head = "| " + " | ".join(rows.columns) + " |\n|" + "---|" * len(rows.columns)
    return f"# {title}\n\n{head}\n" + "\n".join("| " + " | ".join(str(v) for v in r) + " |" for r in rows.toLocalIterator()) + "\n"
