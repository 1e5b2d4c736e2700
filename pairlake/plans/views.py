"""The supplied tables in the roles of the data model, for Spark and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROLES = {"user": "background", "assistant": "methodology", "system": "result"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents: the title is the first 60 characters, the field the source, citations the id modulo 10."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("corpusid"), F.substring("text", 1, 60).alias("title"), F.col("text").alias("abstract"),
        F.col("source").alias("field_of_study"), (F.col("doc_id") % 10).alias("citationcount"), "lang", F.col("n_chars").alias("body_len"),
    )


PAPERS = "papers as (select doc_id as corpusid, substr(text, 1, 60) as title, text as abstract, source as field_of_study, doc_id % 10 as citationcount, lang, n_chars as body_len from documents)"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem: orders cite parts."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("citing"), F.col("l_partkey").alias("cited"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("citationid"), (F.col("l_returnflag") == "R").alias("isinfluential"),
    )


EDGES = "edges as (select l_orderkey as citing, l_partkey as cited, l_orderkey * 10 + l_linenumber as citationid, l_returnflag = 'R' as isinfluential from lineitem)"


def digraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with both ends in the documents' id space."""
    n = table(spark, sf_dir, "documents").count()
    return edges(spark, sf_dir).select((F.col("citing") % n).alias("citing"), (F.col("cited") % n).alias("cited"), "citationid", "isinfluential")


DIGRAPH = EDGES + ", digraph as (select citing % (select count(*) from documents) as citing, cited % (select count(*) from documents) as cited, citationid, isinfluential from edges)"


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as citations: contexts and intents by turn; a conversation cites the document of its number."""
    n = table(spark, sf_dir, "documents").count()
    role = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text", "role"))).alias("t"))
    return rows.select(
        F.col("conv_id").alias("citing"), (F.col("conv_id") % n).alias("cited"), F.col("conv_id").alias("citationid"), (F.col("conv_id") % 2 == 0).alias("isinfluential"),
        F.transform("t", lambda x: x["text"]).alias("contexts"), F.transform("t", lambda x: F.try_element_at(role, x["role"])).alias("intents"),
    )


def tldrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First turns as summaries of the document of the conversation's number."""
    n = table(spark, sf_dir, "documents").count()
    return table(spark, sf_dir, "conversations").where("turn = 0").select((F.col("conv_id") % n).alias("corpusid"), "conv_id", "text")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as task scores: type is the task, user modulo 8 the model, user modulo 3 the seed."""
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("task"), (F.col("user_id") % 8).cast("string").alias("model"), (F.col("user_id") % 3).alias("seed")).agg(F.avg("value").alias("score"))


SCORES = "scores as (select event_type as task, cast(user_id % 8 as varchar) as model, user_id % 3 as seed, avg(value) as score from events group by 1, 2, 3)"
