"""Token chunks, masking, splits and routing."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import digest, uniform
from ..functions.text import with_clean_text

LEAST_CHUNK, LEAST_TEXT = 64, 100
IGNORED = -100


def tokenized(docs: DataFrame, tokenizer: Callable[[], Callable[[list[str]], list[list[int]]]], key: str = "doc_id", text: str = "text", *others: str) -> DataFrame:
    """key, ids by an injected tokenizer, and any other columns; the factory runs once in each worker."""
    kept = [key, *others]
    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = tokenizer()
        for pdf in batches:
            yield pdf[kept].assign(ids=encode(pdf[text].fillna("").tolist()))

    return docs.select(*kept, text).mapInPandas(run, f"{kinds}, ids array<int>")


def corpus(docs: DataFrame, tokenizer, max_length: int, stride: int, cls: int, sep: int, pad: int) -> DataFrame:
    """Cleaned, tokenized and chunked documents with their source; texts under 100 characters go."""
    clean = with_clean_text(docs.select("doc_id", "source", "text"), "text", "source", "clean").select("doc_id", "source", F.col("clean").alias("text")).where(F.length("text") >= LEAST_TEXT)
    return chunked(tokenized(clean, tokenizer, "doc_id", "text", "source"), max_length, stride, cls, sep, pad)


def chunks(ids: Column, max_length: int, stride: int, cls: int, sep: int, pad: int) -> Column:
    """array<struct<input_ids, attention_mask>>: overlapping windows framed and padded; none under 64 tokens."""
    content = max_length - 2
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(ids) - 1, F.lit(0)), F.lit(content - stride)), lambda s: F.least(F.size(ids) - s, F.lit(content)) >= LEAST_CHUNK)

    def one(start: Column) -> Column:
        body = F.slice(ids, start + 1, F.lit(content))
        room = F.lit(content) - F.size(body)
        framed = F.concat(F.array(F.lit(cls)), body, F.array(F.lit(sep)), F.array_repeat(F.lit(pad), room))
        mask = F.concat(F.array_repeat(F.lit(1), F.size(body) + 2), F.array_repeat(F.lit(0), room))
        return F.struct(framed.alias("input_ids"), mask.cast("array<tinyint>").alias("attention_mask"))

    return F.transform(starts, one)


def chunked(rows: DataFrame, max_length: int, stride: int, cls: int, sep: int, pad: int) -> DataFrame:
    """The rows' other columns, chunk, input_ids, attention_mask."""
    others = [c for c in rows.columns if c != "ids"]
    return rows.select(*others, F.posexplode(chunks(F.col("ids"), max_length, stride, cls, sep, pad)).alias("chunk", "c")).select(*others, "chunk", "c.*")


def masked(rows: DataFrame, key: str, mask_id: int, vocabulary: int, special: tuple[int, ...], share: float = 0.3, seed: int = 42) -> DataFrame:
    """input_ids and labels for masked language modelling: of the chosen, 80 % masked, 10 % random, 10 % kept."""

    def h(tag: str, i: Column) -> Column:
        return F.md5(F.concat_ws(":", F.lit(f"{seed}:{tag}"), F.col(key).cast("string"), i.cast("string")).cast("binary"))

    def u(tag: str, i: Column) -> Column:
        return F.conv(F.substring(h(tag, i), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))

    def under(tag: str, i: Column, share: float) -> Column:
        """u < share, by the digits."""
        limit = math.ceil(share * (1 << 32))
        return F.lit(True) if limit >= 1 << 32 else h(tag, i) < F.lit(f"{max(0, limit):08x}")

    chosen = F.transform("input_ids", lambda x, i: (F.get("attention_mask", i) == 1) & ~x.isin(*special) & under("choose", i, share))
    rows = rows.withColumn("chosen", chosen)
    new = F.transform("input_ids", lambda x, i: F.when(~F.get("chosen", i), x).when(under("kind", i, 0.8), F.lit(mask_id)).when(under("half", i, 0.5), F.floor(u("word", i) * vocabulary).cast("int")).otherwise(x))
    labels = F.transform("input_ids", lambda x, i: F.when(F.get("chosen", i), x).otherwise(F.lit(IGNORED)))
    return rows.withColumns({"labels": labels, "masked_ids": new}).drop("input_ids", "chosen").withColumnRenamed("masked_ids", "input_ids")


def train_eval(rows: DataFrame, share: float, seed: int, *keys: str, by: str | None = None) -> DataFrame:
    """The rows with ``split``: the ceiling of the share, least by hash, is "eval" (in each class of ``by``)."""
    if by is None:  # an independent draw per key: exact in expectation, without a global order
        return rows.withColumn("split", F.when(uniform(seed, "split", *keys) < share, "eval").otherwise("train"))
    w = Window.partitionBy(by)
    rank = F.row_number().over(w.orderBy(digest(seed, "split", *keys), *keys))
    return rows.withColumn("split", F.when(rank <= F.ceil(F.count(F.lit(1)).over(w) * share), "eval").otherwise("train"))


def routed(mixed: DataFrame, threshold: float = 0.5) -> DataFrame:
    """signal_type, is_triplet, n, n_negatives: a signal with negatives on most rows trains on triplets."""
    filled = (F.coalesce("negative", F.lit("")) != "").cast("int")
    out = mixed.groupBy("signal_type").agg(F.count(F.lit(1)).alias("n"), F.sum(filled).alias("n_negatives"))
    return out.withColumn("is_triplet", F.col("n_negatives") > threshold * F.col("n"))


def training_rows(mixed: DataFrame) -> DataFrame:
    """Rows by route: triplet signals keep rows with a negative, others drop the column's value."""
    rows = mixed.join(routed(mixed).select("signal_type", "is_triplet"), "signal_type")
    has = F.coalesce("negative", F.lit("")) != ""
    return rows.where(~F.col("is_triplet") | has).withColumn("negative", F.when(F.col("is_triplet"), F.col("negative")))


